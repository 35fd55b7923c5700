"""Alignment of two tokenizers against plain loops over their tokens."""

import hashlib
from collections import Counter

import pandas as pd
import pytest
from tokenizers import Tokenizer

from provena.llm import alignment
from provena.llm.registry import BYTE_BPE, PIECE_BPE

from . import data

FILES = alignment.Pair(BYTE_BPE, PIECE_BPE)
ODD = [
    (40, "▁ is a blank for one side"), (41, "<|endoftext|> <unk> <s> <0x41>"), (None, "no id, twice"), (None, "no id, twice"), (None, None), (None, "another without id"), (46, "x"), (46, "x"),
    (46, "y"), (47, "   many   blanks  "), (48, "tab\tand\r\nbreaks\x85 "), (2**62 + 1, "a large id"), (-3, "an id below zero"), (50, "zwölf Boxkämpfer 😀😀 ́"), (51, "ab" * 3000),
]


def tokens(text):
    known = alignment.Vocabulary(FILES)
    tokenizer = Tokenizer.from_file(BYTE_BPE)
    tokenizer.encode_special_tokens = True
    a, b = tokenizer.encode(" " + (text or ""), add_special_tokens=False).ids, known.pieces.encode(text or "")
    out = []
    for ids, table in ((a, known.a), (b, known.b)):
        at, own = 0, []
        for i in ids:
            own.append((at, at + len(table[i]), i))
            at += len(table[i])
        out.append(own)
    same = text and all(b"".join(t[x[2]] for x in own) == (" " + text).encode() for own, t in zip(out, (known.a, known.b)))
    return out if same else [[], []]


def cut_and_linked(text):
    a, b = tokens(text)
    found, begin = [], 0
    for cut in sorted({x[1] for x in a} & {x[1] for x in b}):
        found.append((begin, cut, [x[2] for x in a if begin < x[1] <= cut], [x[2] for x in b if begin < x[1] <= cut]))
        begin = cut
    pairs, j = [], 0
    for x in a:
        while j and b[j - 1][1] > x[0]:
            j -= 1
        while j < len(b) and b[j][1] <= x[0]:
            j += 1
        k = j
        while k < len(b) and b[k][0] < x[1]:
            pairs.append((max(x[0], b[k][0]), min(x[1], b[k][1]), x[2], b[k][2]))
            k += 1
    return found, pairs, len(a), len(b)


def rows():
    return [r for r in data.rows() if r[0] != 12] + ODD  # 9,000 words are for the sweep below


@pytest.fixture(scope="module")
def wanted():
    return [(d, *cut_and_linked(t)) for d, t in rows()]


@pytest.mark.parametrize("size, work", [(alignment.SHEET, alignment.WORK), (50, 20)])
def test_digest(spark, wanted, size, work):
    count = Counter((a, b) for *_, pairs, _, _ in wanted for _, _, a, b in pairs)
    best = Counter()
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    want = []
    for d, found, pairs, n_a, n_b in wanted:
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for _, _, a, b in found)
        sha = hashlib.sha256(text.encode()).hexdigest() if found else ""
        want.append((d, n_a, n_b, len(found), len(pairs), sum(count[a, b] == best[b] for _, _, a, b in pairs), sum(count[a, b] for _, _, a, b in pairs), sha))
    docs = spark.createDataFrame(rows(), "doc_id long, text string")
    got = Counter(tuple(r) for r in alignment.digest(data.clash(docs), FILES, size, work).collect())
    assert got == Counter(want)


def test_groups_and_links(spark, wanted):
    docs = spark.createDataFrame(rows(), "doc_id long, text string")
    for work in (alignment.WORK, 30):
        got = Counter((r.doc_id, r.begin, r.end, tuple(r.a), tuple(r.b)) for r in alignment.groups(docs, FILES, work).collect())
        assert got == Counter((d, begin, end, tuple(a), tuple(b)) for d, found, *_ in wanted for begin, end, a, b in found)
        got = Counter((r.doc_id, r.begin, r.end, r.a, r.b) for r in alignment.links(docs, FILES, work).collect())
        assert got == Counter((d, *x) for d, _, pairs, *_ in wanted for x in pairs)


def test_a_long_text_in_many_parts(spark):
    """The same result however little of a text is swept at once, and little stays open meanwhile."""
    text = dict(data.rows())[12]
    docs = spark.createDataFrame([(1, text), (2, text), (3, text + " end"), (4, "")], "doc_id long, text string")
    whole, parts = (sorted(map(tuple, alignment.digest(docs, FILES, size, work).collect())) for size, work in ((alignment.SHEET, alignment.WORK), (1000, 500)))
    assert whole == parts and whole[0][1] > 9000 and whole[0][1:] == whole[1][1:] and whole[3][1:] == (0, 0, 0, 0, 0, 0, "")
    known = alignment.vocabulary(FILES)
    frames = [f.toPandas() for f in [alignment.events(alignment.keyed(docs), s, FILES, 500) for s in (alignment.A, alignment.B)]]
    stream = pd.concat(frames).sort_values(alignment.ORDER)
    sizes = [(len(p.ids[0]), sum(len(x) for own in p.docs[-1].open for x in own)) for p in alignment.sweep(iter([stream]), known, 500)]
    assert len(sizes) > 20 and max(kept for _, kept in sizes) <= 1000


def test_no_documents(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.digest(empty, FILES).count() == 0 and alignment.groups(empty, FILES).count() == 0
