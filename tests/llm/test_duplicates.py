"""Near duplicates, repeated passages, fingerprints and leaks against brute force."""

import hashlib
import math
import os
import random
import re
from collections import Counter

import numpy as np
import pytest

from provena.llm import components, decontamination, fingerprints, near_dedup, suffix_dedup

from . import data


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def grouped(rows, cent):
    sets, parent = {}, {}
    for d, t in rows:
        sets.setdefault(d, []).append(shingle_set(t))

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if any(x and y and 100 * len(x & y) >= cent * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}


def family(n, edits, seed):
    """Copies of one text with changed words, so that some are linked through others only."""
    r, base = random.Random(seed), data.prose(150, seed).split(" ")
    for k in range(n):
        words = list(base)
        for _ in range(r.randint(0, edits)):
            words[r.randrange(len(words))] = f"edit{r.randint(0, 9)}"
        yield 1000 * seed + k, " ".join(words)


@pytest.mark.parametrize("cent", [85, 80])
@pytest.mark.parametrize("block", [256, 3])
def test_near_duplicates(spark, monkeypatch, cent, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "LEADER_ROUNDS", 2 if block > 3 else 0)
    more = list(family(40, 6, 1)) + list(family(25, 3, 2)) + [(500, "solo " * 3), (13, "é ü ß 中文 😀 " * 30)]
    docs = data.clash(data.documents(spark, more + [(None, "no id here at all")]))
    got = near_dedup.near_duplicates(docs, cent).collect()
    all_rows = data.rows() + more
    want = grouped(all_rows, cent)
    assert len(got) == len(all_rows) + 1
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert r.component_id == want[r.doc_id] and r.kept == (want[r.doc_id] == r.doc_id)
    sizes = {(r.doc_id, r.n_shingles) for r in got if r.doc_id is not None}
    assert sizes == {(d, len(shingle_set(t))) for d, t in all_rows}


def test_near_duplicates_of_nothing(spark):
    assert near_dedup.near_duplicates(data.documents(spark).limit(0)).count() == 0
    assert near_dedup.near_duplicates(data.documents(spark).where("doc_id in (4, 5, 6)")).where("kept").count() == 3


def test_one_large_group_is_found_whole(spark):
    """Near copies of one text, and as many texts that share most of it and are not linked."""
    base = data.prose(200, 600).split(" ")
    near = [(k, " ".join([*base[: k % 190], f"x{k}", *base[k % 190 + 1 :]])) for k in range(700)]
    apart = [(1000 + k, " ".join(base[:120]) + " " + data.prose(50, 700 + k)) for k in range(300)]
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(near + apart, "doc_id long, text string").repartition(8)).collect()}
    assert got == grouped(near[::70] + apart, 85) | {k: 0 for k, _ in near}


def kept_firsts(rows, h):
    """What stays of (doc_id, text, ...): the first of each component and all texts without words, each row that is equal once."""
    nodes = sorted({r[:2] for r in rows if shingle_set(r[1])}, key=lambda r: (r[0] is None, r[0] or 0, h[r[1]]))
    groups = grouped([(k, t) for k, (_, t) in enumerate(nodes)], 80)
    return Counter(n for k, n in enumerate(nodes) if groups[k] == k) + Counter(r[:2] for r in rows if not shingle_set(r[1]))


@pytest.mark.parametrize("plain", [True, False])
def test_keep_firsts(spark, plain):
    base = data.prose(90, 800)
    more = [] if plain else [(500, base), (500, data.prose(80, 801)), (500, data.prose(80, 801)), (501, base + " end"), (None, base), (None, data.prose(70, 802)), (None, data.prose(70, 802) + " x"), (None, None), (4, None), (4, None)]
    rows = [r for r in dict.fromkeys(data.rows()) if r] if plain else data.rows() + more
    shape = "doc_id long, text string, lang string, source string, n_chars long, Doc_Id string, again int, hash int, node int"
    docs = spark.createDataFrame([(*r, "en", "s", len(r[1] or ""), "no", 77, 2, 3) for r in rows], shape)
    left = near_dedup.keep_firsts(docs, 80)
    assert left.schema == docs.schema
    got = left.collect()
    assert Counter((r[0], r[1]) for r in got) == kept_firsts(rows, hashes(spark, rows))
    assert {tuple(r[5:]) for r in got} == {("no", 77, 2, 3)}
    assert near_dedup.keep_firsts(docs.limit(0), 80).count() == 0


def test_sketch_fills_and_estimates():
    r = np.random.default_rng(1)
    for n in (1, 3, 40, 1000):
        x = r.integers(0, 2**63, n).astype(np.uint64)
        assert (near_dedup.sketch(x) < np.iinfo(np.uint64).max).all()
    a = r.integers(0, 2**63, 1000).astype(np.uint64)
    b = np.concatenate([a[:800], r.integers(0, 2**63, 200).astype(np.uint64)])
    share = (near_dedup.sketch(a, 512) == near_dedup.sketch(b, 512)).mean()
    assert abs(share - 800 / 1200) < 0.08


@pytest.mark.parametrize("cent", [80, 85])
def test_a_pair_at_the_threshold_is_seldom_ruled_out(cent):
    n, p = near_dedup.FINE, cent / 100
    least = p - near_dedup.GIVE_UP * math.sqrt(p * (1 - p) / n)
    assert sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(n + 1) if k / n < least) < 1e-6


def test_components(spark):
    r = random.Random(3)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1060)]
    got = dict(map(tuple, components.components(spark.createDataFrame(links, "u long, v long")).collect()))
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in {n for a, b in links if a != b for n in (a, b)}}


def hashes(spark, rows):
    return {r.text: r.h for r in spark.createDataFrame([(t,) for _, t in rows if t is not None], "text string").selectExpr("text", "xxhash64(text) AS h").collect()}


def spans(rows, h):
    """Repeated spans of 50 words by comparing every passage."""
    seen, out = {}, {}
    for d, t in sorted({(d, t) for d, t in rows if t}, key=lambda r: (r[0] is None, r[0] or 0, h[r[1]])):
        w = [m.group() for m in re.finditer(r"[^ \t-\r]+", t)]
        for i in range(len(w) - 49):
            if seen.setdefault(tuple(w[i : i + 50]), (d, t, i)) != (d, t, i):
                out.setdefault((d, t), []).append(i)
    got = set()
    for (d, t), at in out.items():
        w = [m.span() for m in re.finditer(r"[^ \t-\r]+", t)]
        first = last = at[0]
        for i in [*at[1:], 10**9]:
            if i - last > 50:
                got.add((d, w[first][0], w[last + 49][1], first, last + 49, h[t]))
                first = i
            last = i
    return got


def repeating():
    passage = data.prose(70, 77)
    more = [(100 + k, data.prose(k, 200 + k) + " " + passage + "\n" + data.prose(9, 300 + k)) for k in range(0, 40, 7)]
    more += [(200, " ".join(passage.split(" ")[:50])), (201, " ".join(passage.split(" ")[:49]) + " end"), (202, passage + " " + passage), (202, passage + " " + passage)]
    # One doc_id with several texts, and none.
    more += [(300, data.prose(100, 400)), (300, data.prose(20, 401) + " " + passage), (300, data.prose(60, 402) + " " + data.prose(100, 400)), (None, passage), (None, data.prose(80, 403)), (None, data.prose(80, 403)), (None, "x " + data.prose(80, 403))]
    # More to the left with one document, more to the right with another.
    words = data.prose(90, 404).split(" ")
    return more + [(400, " ".join(words[:60])), (401, "a " + " ".join(words[20:])), (402, "b " + " ".join(words[5:80]) + " c"), (403, " ".join(words[30:82]))]


@pytest.mark.parametrize("apart", [1, 40])
def test_repeated_spans(spark, apart):
    rows = data.rows() + repeating()
    docs = data.clash(data.documents(spark, repeating())).repartition(apart)
    got = [tuple(r) for r in suffix_dedup.repeated_spans(docs).collect()]
    assert len(got) == len(set(got)) and set(got) == spans(rows, hashes(spark, rows))


def test_a_passage_in_thousands_of_documents(spark):
    passage = data.prose(60, 500)
    rows = [(k, f"{data.prose(k % 7, k)} {passage} {k} {data.prose(k % 5, k)}") for k in range(3000)] + [(5000 + k, passage) for k in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(30)
    got = suffix_dedup.repeated_spans(docs).collect()
    assert {r.doc_id for r in got} == {d for d, _ in rows} - {0} and len(got) == len(rows) - 1
    texts = dict(rows)
    assert all(passage in texts[r.doc_id][r.begin : r.end] for r in got)


def test_without_repeats(spark):
    rows = data.rows() + repeating()
    shape = "doc_id long, text string, lang string, source string, n_chars long, Doc_Id string, TEXT int, cuts int, h int"
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or ""), "no", 1, 2, 3) for d, t in rows], shape)
    left = suffix_dedup.without_repeats(docs)
    assert left.schema == docs.schema
    want, h, white = Counter(), hashes(spark, rows), " \t\n\v\f\r"
    cuts = spans(rows, h)
    for d, t in rows:
        own, kept, last = sorted(c[1:3] for c in cuts if t is not None and c[0] == d and c[5] == h[t]), [], 0
        if own:
            for a, b in own:
                kept.append(t[last:a].strip(white) if last else t[:a].rstrip(white))
                last = b
            t = "\n".join(x for x in [*kept, t[last:].lstrip(white)] if x)
        if not own or t.strip(white):
            want[d, t, len(t or ""), "no", 1, 2, 3] += 1
    assert Counter((r[0], r[1], *r[4:]) for r in left.collect()) == want
    passage = data.prose(60, 2)
    assert sum(passage in (t or "") for _, t, *_ in want) == 1 and 21 not in {d for d, *_ in want}
    assert suffix_dedup.without_repeats(docs.limit(0)).count() == 0


def test_fingerprints(spark):
    rows = sorted({(-1 if d is None else d, t or "") for d, t in data.rows()} | {(-1, "no id")})
    source = [(None if d < 0 else d, t) for d, t in rows]
    docs = data.clash(spark.createDataFrame(source, "doc_id long, text string"))
    got = sorted(fingerprints.edited_and_next(docs).collect(), key=lambda r: (-1 if r.doc_id is None else r.doc_id, r.n_chars))
    assert len(got) == len(rows)
    plain = {t: p for t, p in zip([t for _, t in source], [str(fingerprints.Print(t)) for _, t in source])}
    for k, (d, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        m = len(t) // 4
        edited = t[: len(t) - m] + after[:m]
        row = next(r for r in got if (-1 if r.doc_id is None else r.doc_id) == d and r.fingerprint == plain[t])
        assert row.n_chars == len(t) and row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert row.edited_fingerprint == str(fingerprints.Print(edited))
        assert row.near_edited == fingerprints.likeness(fingerprints.Print(t), fingerprints.Print(edited)) and row.near_next == fingerprints.likeness(fingerprints.Print(t), fingerprints.Print(after))
    assert fingerprints.edited_and_next(docs.limit(0)).count() == 0
    one = fingerprints.edited_and_next(spark.createDataFrame([(0, "alone")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0].near_next == 1


def test_prefix_hashes_answer_spans():
    r = random.Random(5)
    a, b = ("".join(r.choice("ab") for _ in range(300)) for _ in range(2))
    x, y = fingerprints.PrefixHash(a), fingerprints.PrefixHash(b)
    for _ in range(300):
        i, j, n = r.randrange(280), r.randrange(280), r.randrange(1, 20)
        assert (x.span(i, i + n) == y.span(j, j + n)) == (a[i : i + n] == b[j : j + n])
        k = 0
        while i + k < 300 and j + k < 300 and a[i + k] == b[j + k]:
            k += 1
        assert fingerprints.extension(x, i, y, j) == k


def shared_share(a, b):
    """2 m / (n + n'), m the code points of a in spans of 12 and more that b holds too, or in the common begin."""
    covered = np.zeros(len(a), bool)
    spans_ = {b[i : i + 12] for i in range(len(b) - 11)}
    for i in range(len(a) - 11):
        if a[i : i + 12] in spans_:
            covered[i : i + 12] = True
    covered[: len(os.path.commonprefix([a, b]))] = True
    return 2 * int(covered.sum()) / (len(a) + len(b))


def test_likeness_against_the_shared_text():
    r = random.Random(6)
    for n in (3, 8, 30, 43, 44, 60, 90, 300, 2000, 20_000):
        for _ in range(6):
            a, other = (data.prose(n, r.randrange(10**6))[:n] for _ in range(2))
            kept = a[: n - n // 4]
            # Texts, and how much of the first they hold for certain.
            for b, m in ((kept + other[: n // 4], len(kept)), (kept, len(kept)), ("new words first " + a, n), (a[: n // 3] + other[: n // 20] + a[n // 3 :], n), (a[n // 2 :] + a[: n // 2], n), (other, 0), (a + other, n)):
                p, q = fingerprints.Print(a), fingerprints.Print(b)
                got = fingerprints.likeness(p, q)
                assert (got == 1) == (a == b) and got == fingerprints.likeness(fingerprints.read_print(str(p)), fingerprints.read_print(str(q)))
                assert got <= shared_share(a, b) + 1e-9
                if b.startswith(kept) or n >= 300:
                    assert got >= 2 * m / (len(a) + len(b)) - (0.07 if b.startswith(kept) else 0.15), (n, m, got)
    for a, b in (("ab" * 500, "ab" * 400 + "x" * 100), ("a" * 4000, "a" * 3000 + "b" * 1000)):
        assert fingerprints.likeness(fingerprints.Print(a), fingerprints.Print(b)) >= 0.7
    assert fingerprints.likeness(fingerprints.Print(""), fingerprints.Print("")) == 1 and fingerprints.likeness(fingerprints.Print(""), fingerprints.Print("a")) == 0


def test_the_least_and_the_greatest_doc_id(spark):
    rows = [(-(2**63), "the first text of all " * 9), (0, "another text " * 20), (2**63 - 1, "the last of them")]
    got = {r.doc_id: r for r in fingerprints.edited_and_next(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for (d, t), (_, after) in zip(rows, [*rows[1:], rows[0]], strict=True):
        m = len(t) // 4
        assert got[d].edited_sha256 == hashlib.sha256((t[: len(t) - m] + after[:m]).encode()).hexdigest()


def edit_distance(a, b):
    """Least edits of a to any part of b."""
    row = [0] * (len(b) + 1)
    for i, c in enumerate(a, 1):
        new = [i]
        for j, d in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def test_leaks(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 300)
    r = random.Random(2)
    items = [(k, data.prose(25, 900 + k)) for k in range(8)] + [(50, None), (51, ""), (52, "!?"), (0, data.prose(25, 900))]
    docs = []
    for k, (i, t) in enumerate(items[:8]):
        chars = list(t)
        for _ in range(k):
            at = r.randrange(len(chars))
            chars[at : at + 1] = r.choice([[], ["q"], [chars[at], "z"]])
        docs.append((k, data.prose(50, k) + "  " + "".join(chars).upper().replace(" ", " \n") + "! " + data.prose(30, k + 40)))
    docs += [(20, data.prose(100, 70)), (21, None), (22, ""), (None, items[1][1])]
    df = data.clash(spark.createDataFrame(docs, "doc_id long, text string"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.leaks(df, bench).collect()
    want = set()
    for d, t in docs:
        for i, q in items[:8]:
            p = decontamination.plain(q)
            n = edit_distance(p, decontamination.plain(t or ""))
            if n <= len(p) * decontamination.RATE:
                want.add((d, i, n))
    assert {(x.doc_id, x.item_id, x.edits) for x in got} == want and len(want) >= 6
    texts = dict(docs)
    for x in got:
        part = decontamination.plain(texts[x.doc_id][x.start : x.end])
        assert edit_distance(decontamination.plain(dict(items)[x.item_id]), part) == x.edits
    clean = decontamination.without_leaks(spark.createDataFrame(docs, "doc_id long, text string"), bench)
    assert {r.doc_id for r in clean.collect()} == {d for d, _ in docs} - {d for d, _, _ in want}
    assert decontamination.leaks(df.limit(0), bench).count() == 0 and decontamination.leaks(df, bench.limit(0)).count() == 0


def test_short_items_are_whole_words(spark):
    items = [(1, "art"), (2, "A"), (3, "A b, c!"), (4, "the whole of a longer item of the benchmark"), (5, "art")]
    texts = ["start of it", "Art!", "an ART gallery", "banana", "it is a", "a b c", "xa b cx", "THE whole of a longer item of the benchmark", "xthe whole of a longer item of the benchmark", "", None, "art"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.item_id, r.edits): texts[r.doc_id][r.start : r.end] for r in decontamination.leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {
        (1, 1, 0): "Art", (1, 5, 0): "Art", (2, 1, 0): "ART", (2, 5, 0): "ART", (4, 2, 0): "a", (5, 2, 0): "a", (5, 3, 0): "a b c", (7, 2, 0): "a", (7, 4, 0): texts[7], (8, 2, 0): "a",
        (8, 4, 0): texts[8][1:], (11, 1, 0): "art", (11, 5, 0): "art",
    }


def test_leaks_in_a_very_long_text_and_repeated_rows(spark):
    item = data.prose(30, 950)
    text = data.prose(60_000, 951)
    middle = len(text) // 2
    rows = [(1, text[:middle] + " " + item + " " + text[middle:])] * 2 + [(2, text), (None, item), (3, None)]
    shape = "doc_id long, text string, TEXT int, Doc_Id int, keep int"
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], shape)
    bench = spark.createDataFrame([(7, item), (7, item)], "item_id long, text string")
    got = sorted(((r.doc_id or 0, r.item_id, r.edits, r.end - r.start) for r in decontamination.leaks(docs, bench).collect()))
    assert got == [(0, 7, 0, len(item)), (1, 7, 0, len(item)), (1, 7, 0, len(item))]
    clean = decontamination.without_leaks(docs, bench)
    assert clean.schema == docs.schema and sorted((r[0], *r[2:]) for r in clean.collect()) == [(2, 1, 2, 3), (3, 1, 2, 3)]


def test_myers_against_the_plain_table():
    r = random.Random(4)
    for _ in range(200):
        a, b = ("".join(r.choice("abc") for _ in range(r.randint(1, 12))) for _ in range(2))
        assert min([len(a), *decontamination.distances(a, b)]) == edit_distance(a, b)


def test_leaks_do_not_depend_on_blocks(spark, monkeypatch):
    words = "harbour lantern gravel meadow copper thunder orchard velvet marble signal".split()
    form = lambda k: " ".join(words[(k * 3 + i * i) % 10] + str(k) for i in range(12))
    items = [(7, form(1) + "!" * k) for k in range(6)] + [(8, form(1).upper())] + [(9, form(2)), (9, form(3)), (9, form(3))] + [(10 + k, form(10 + k)) for k in range(40)]
    docs = [(k, f"so {form(k)} and {form(k + 1)} then") for k in range(0, 52)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    one = sorted(map(tuple, decontamination.leaks(df, bench).collect()))
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 64)
    many = sorted(map(tuple, decontamination.leaks(df, bench).collect()))
    assert one == many and len({x[:2] for x in one}) == len(one) - 1  # both forms of item 9 in document 2
    assert [x[1] for x in one if x[0] == 0] == [7, 8] and [x[1] for x in one if x[0] == 2] == [9, 9]


def test_texts_without_repeats_do_not_move(spark):
    """Only texts that may have something to cut are joined with the cuts."""
    words = lambda seed, n: " ".join(f"w{seed}x{k}" for k in range(n))
    docs = [(k, words(k, 70)) for k in range(300)] + [(300 + k, words(k, 60)) for k in range(3)] + [(400, None), (None, words(5, 55))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    out = suffix_dedup.without_repeats(df)
    assert "Union" in out._jdf.queryExecution().executedPlan().toString()
    got = {(r.doc_id, r.text) for r in out.collect()}
    assert got == {x for x in docs if x[0] is not None and x[0] not in (300, 301, 302)} and out.count() == 301
