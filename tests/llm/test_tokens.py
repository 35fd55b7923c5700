"""Packing, token files and attribution against the tokenizer itself."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from provena.llm import attribution, packing, token_files
from provena.llm.registry import BYTE_BPE, WORD_BPE
from provena.llm.tokens import Encoder

from . import data


def ids_of(path, text):
    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids


ODD = st.lists(st.sampled_from([*" \n\t\r\x0b\x1c\x85\xa0ab1.,'!é\u0301ßΣ中😀_", "the", " the", "'s", "<|endoftext|>", "İ", "K"]), max_size=25).map("".join)


@pytest.mark.parametrize("path", [BYTE_BPE, WORD_BPE])
def test_pieces_give_the_ids_of_the_whole(path):
    tokenizer, plain, spans = Tokenizer.from_file(path), Encoder(path), Encoder(path, offsets=True)

    @settings(max_examples=400, deadline=None)
    @given(ODD)
    def check(text):
        whole = tokenizer.encode(text, add_special_tokens=False)
        assert plain.ids([text])[0] == np.array(whole.ids, "<u4").tobytes()
        assert spans.spans(text).tolist() == [[i, *o] for i, o in zip(whole.ids, whole.offsets)]

    check()


@pytest.mark.parametrize("shape", [data.documents, lambda s: data.clash(data.documents(s))])
def test_packing_holds_each_id_once(spark, shape):
    docs = shape(spark)
    pieces = packing.pack(docs, BYTE_BPE, 256).collect()
    digest = packing.digest(packing.pack(docs, BYTE_BPE, 256)).collect()
    assert sorted((p.sequence_id, p.offset, zlib.crc32(p.ids)) for p in pieces) == sorted((p.sequence_id, p.offset, p.ids_crc32) for p in digest)
    want = sorted(tuple(ids_of(BYTE_BPE, t) + [1]) for _, t in data.rows())
    by_doc, by_window = {}, {}
    for p in pieces:
        by_window.setdefault(p.sequence_id, []).append(p)
        by_doc.setdefault((p.doc_id, p.doc_tokens), []).append(p)
    for window in by_window.values():
        at = 0
        for p in sorted(window, key=lambda p: p.offset):
            assert p.offset == at and len(p.ids) == 4 * p.length
            at += p.length
        assert at == 256 or at & (at - 1) == 0  # no padding
    got = []
    for (_, total), own in by_doc.items():
        own.sort(key=lambda p: p.start)
        copies = sum(p.length for p in own) // total
        starts = {p.start for p in own}
        assert 0 in starts and sum(p.length for p in own) == copies * total
        if copies == 1:
            got.append(tuple(np.frombuffer(b"".join(p.ids for p in own), "<u4").tolist()))
    assert set(got) <= set(want) and len(got) == len(want) - 2


def test_sum_of_squares_takes_the_choice_with_the_least_sum():
    r, state = np.random.default_rng(0), packing.SumOfSquares(32)
    for k in range(500):
        need = int(r.integers(1, 32))
        counts = state.count.copy()

        def total(h):
            c = counts.copy()
            c[h] -= h > 0
            c[h + need] += h + need < 32
            return int((c**2).sum())

        options = [0] + [h for h in range(1, 33 - need) if counts[h]]
        fill = state.level(need)
        assert fill in options and total(fill) == min(map(total, options))
        list(state.put(k, np.zeros(need, np.uint32)))
        assert state.count[1:32].tolist() == [len(w) for w in state.open[1:]]
    assert state.waiting == sum(h * len(w) for h, w in enumerate(state.open))


def test_little_is_cut_anew_after_small_tasks():
    """240 documents a task: of all ids, the second packers' ends cut at most one in twenty."""
    r, sizes = np.random.default_rng(1), []
    total, seen, second = 0, {}, packing.SumOfSquares(2048, 1 << 62)
    rows = []
    for task in range(200):
        first = packing.SumOfSquares(2048, task << 40)
        for k in range(240):
            n = int(min(30_000, r.lognormal(5.6, 1.1))) + 1
            sizes.append(n)
            total += n
            ids = np.full(n, len(sizes), "<u4")
            rows += list(first.put(len(sizes) - 1, ids))
        for doc, start, _, ids, whole, _, _ in list(first.unfinished()):
            rows += list(second.place((doc, start, np.frombuffer(ids, "<u4"), whole)))
    rows += list(second.close())
    assert second.cut < 0.05 * total
    fills = {}
    for doc, start, length, ids, whole, window, offset in rows:
        assert np.frombuffer(ids, "<u4").tolist() == [doc + 1] * length and whole == sizes[doc]
        seen.setdefault(doc, []).append((start, length))
        fills.setdefault(window, []).append((offset, length))
    for doc, parts in seen.items():
        parts.sort()
        assert [a for a, _ in parts] == [0, *np.cumsum([n for _, n in parts])[:-1]] and sum(n for _, n in parts) == sizes[doc]
    short = [sum(n for _, n in parts) for parts in fills.values() if sum(n for _, n in parts) < 2048]
    assert all(n & (n - 1) == 0 for n in short) and len(short) <= 11
    assert all([a for a, _ in sorted(p)] == [0, *np.cumsum([n for _, n in sorted(p)])[:-1]] for p in fills.values())


@pytest.mark.parametrize(("group", "wait"), [(100, 4_000_000), (8_000_000, 300)])
def test_packing_with_many_second_packers_and_a_small_memory(spark, monkeypatch, group, wait):
    monkeypatch.setattr(packing, "GROUP_IDS", group)
    monkeypatch.setattr(packing.SumOfSquares.__init__, "__defaults__", (0, wait))
    test_packing_holds_each_id_once(spark, data.documents)


def test_empty_tables(spark):
    none = data.documents(spark).limit(0)
    assert packing.pack(none, BYTE_BPE).count() == 0
    assert token_files.read_files(token_files.write_files(none, WORD_BPE)).count() == 0
    assert attribution.token_counts(none, BYTE_BPE).count() == 0


@pytest.mark.parametrize(("segment", "limit"), [(2_000_000, 200_000_000), (500, 1200), (500, 500), (1, 1)])
def test_token_files_round_trip(spark, monkeypatch, segment, limit):
    monkeypatch.setattr(token_files, "SEGMENT_IDS", segment)
    monkeypatch.setattr(token_files, "FILE_IDS", limit)
    docs = data.clash(data.documents(spark, [(None, "no id")]))
    read = sorted(token_files.digest(token_files.read_files(token_files.write_files(docs, WORD_BPE))).collect(), key=lambda r: r.start)
    want = sorted(((-1 if d is None else d), ids_of(WORD_BPE, t) + [2]) for d, t in data.rows() + [(None, "no id")])
    at = 0
    for r, (d, ids) in zip(read, want, strict=True):
        assert (-1 if r.doc_id is None else r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_any_token_of_a_file(tmp_path):
    file, docs = token_files.FileWriter(f"file://{tmp_path}/a/x.dac"), [[(k, np.arange(k, dtype=np.uint32) * 70_001 + k)] for k in range(1, 9)]
    for part in docs:
        file.add(part)
    assert file.close()[1:] == (8, 36)
    flat, read = [int(i) for part in docs for _, ids in part for i in ids], token_files.FileReader(f"file://{tmp_path}/a/x.dac")
    assert [read.token(i) for i in range(36)] == flat and [s.doc_ids for _, s in read.segments()] == [[k] for k in range(1, 9)]
    (tmp_path / "bad").write_bytes(b"x" * 40)
    with pytest.raises(ValueError):
        token_files.FileReader(f"file://{tmp_path}/bad")


def test_a_token_is_read_from_a_few_cells(tmp_path):
    file = token_files.FileWriter(f"file://{tmp_path}/x.dac")
    ids = (np.arange(300_000, dtype=np.uint64) ** 3 % 2**32).astype(np.uint32)
    for at in range(0, len(ids), 100_000):
        file.add([(at, ids[at : at + 100_000])])
    file.close()
    read, asked = token_files.FileReader(f"file://{tmp_path}/x.dac"), []

    class Counted:
        def __init__(self, file):
            self.file = file

        def read_at(self, n, offset):
            asked.append(n)
            return self.file.read_at(n, offset)

    read.file = Counted(read.file)
    for k in (0, 511, 512, 99_999, 100_000, 250_001, 299_999):
        asked.clear()
        assert read.token(k) == ids[k] and sum(asked) < 1000  # a header once, then cells
    asked.clear()
    assert [read.token(k) for k in range(0, 300_000, 997)] == ids[::997].tolist() and max(asked) <= 64


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=60), max_size=8))
def test_addressable_codes(docs):
    file = token_files.Reader(token_files.build([(k, np.array(x, np.uint32)) for k, x in enumerate(docs)]))
    flat = [i for x in docs for i in x]
    assert [file.token(i) for i in range(len(flat))] == flat
    assert [file.doc(k).tolist() for k in range(len(docs))] == docs


def test_token_counts_add_up_and_follow_the_rule(spark):
    rows = attribution.token_counts(data.clash(data.documents(spark)), BYTE_BPE).collect()
    total = {}
    for r in rows:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.n_tokens
    for d, t in dict(data.rows()).items():
        assert total[d] == len(ids_of(BYTE_BPE, t)) * sum(x[0] == d for x in data.rows())
    tokens = np.array([(0, 0, 4), (0, 4, 8), (0, 8, 9), (0, 20, 22)])
    owner, crossing = attribution.dealt(tokens, np.array([(0, 5), (5, 8), (8, 12)]))
    assert owner.tolist() == [0, 1, 2, -1] and crossing.tolist() == [False, True, False, False]
    assert attribution.dealt(np.array([(0, 4, 6)]), np.array([(0, 5), (5, 8)]))[0].tolist() == [0]  # a tie: the first


def counted(text, sections):
    """Section to (tokens, tokens that reach into others, first token), token by token."""
    out = {k: [0, 0, -1] for k in range(len(sections))}
    for n, (a, b) in enumerate(Tokenizer.from_file(BYTE_BPE).encode(text, add_special_tokens=False).offsets):
        b = max(b, a + 1)
        over = {k: min(b, e) - max(a, s) for k, (s, e) in enumerate(sections) if min(b, e) > max(a, s)}
        own = out.setdefault(max(over, key=lambda k: (over[k], -k)) if over else -1, [0, 0, -1])
        own[0] += 1
        own[1] += len(over) > 1
        own[2] = n if own[2] < 0 else own[2]
    return {k: tuple(v) for k, v in out.items()}


def test_sections_against_each_token(spark):
    texts = ["one two\nthree  four\n\n\nfive", "\n", "", "é ü 中文 😀\n😀😀 x", data.prose(300, 60).replace(" ", "\n"), data.prose(20_000, 61), "a" * 3000]
    rows = attribution.token_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), BYTE_BPE).collect()
    for d, text in enumerate(texts):
        ends = np.cumsum([len(x) + 1 for x in text.split("\n")]).tolist()
        ends[-1] = len(text)
        got = {r.section: (r.n_tokens, r.n_crossing, r.first_token) for r in rows if r.doc_id == d}
        assert got == counted(text, list(zip([0, *ends[:-1]], ends, strict=True)))
    given = [[(0, 3), (3, 9), (12, 20)], [(1, 2)], [(5, 6), (6, 7), (7, 30)]]
    text = "alpha beta gamma delta epsilon"
    docs = spark.createDataFrame([(k, text, g) for k, g in enumerate(given)], "doc_id long, text string, s array<struct<begin:long,end:long>>")
    rows = attribution.token_counts(docs, BYTE_BPE, "s").collect()
    for k, g in enumerate(given):
        assert {r.section: (r.n_tokens, r.n_crossing, r.first_token) for r in rows if r.doc_id == k} == counted(text, g)


def test_given_sections(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma", [(0, 5), (6, 10)]), (2, "x", None), (3, None, [])], "doc_id long, text string, s array<struct<begin:long,end:long>>")
    got = {(r.doc_id, r.section): r.n_tokens for r in attribution.token_counts(docs, BYTE_BPE, "s").collect()}
    assert sum(n for (d, _), n in got.items() if d == 1) == len(ids_of(BYTE_BPE, "alpha beta gamma"))
    assert (1, 0) in got and (1, 1) in got and (2, -1) in got and (3, -1) not in got


def test_unsure_and_plain_texts_by_character():
    import re
    import sys

    from provena.llm import tokens

    odd = re.compile("[\x1c-\x1f\x85᠎]")
    for k in range(sys.maxunicode + 1):
        text = f"a{chr(k)}b"
        assert tokens.unsure(text) == bool(odd.search(text)) and tokens.plain(text) == (not tokens.PLAIN.search(text))
