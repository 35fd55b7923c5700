"""Fill-in-middle and quality rules against plain Python, with every odd case."""

import hashlib
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from provena.llm import infill, rules
from provena.llm.common import noted

from . import data

SHAPE = "doc_id long, text string"
ODD = [
    (40, "a<P>b"), (41, "x <S"), (42, "S> y <"), (43, "<M>"), (None, "no id here, at all"), (None, None), (44, "1234567890" * 900), (45, "Ab" * 4000 + "."),
    (46, "x"), (46, "x"), (47, "ab ab ab ab"), (48, "a b c a b c x"), (49, "a b\na b\n \n \n a b"), (50, "😀é word 😀é word 😀é"), (51, "w " * 60), (-5, "minus five"),
]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def cut(doc_id, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, len(units), "plain", None, None, sha(text), sha(text)
    form = "spm" if h[3] % 100 < 20 else "psm"
    out = f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"
    return doc_id, len(units), form, len(p), len(m), sha(out), sha(text)


def key(row):
    return tuple((x is not None, x) for x in row)


@pytest.mark.parametrize("shape", [data.documents, lambda s, extra: data.clash(data.documents(s, extra))])
def test_fill_in_middle(spark, shape):
    more = [*ODD, *((k, f"Word{k % 7}, and {k}!") for k in range(100, 260))]
    got = [tuple(r) for r in infill.digest(infill.transformed(shape(spark, more))).collect()]
    assert sorted(got, key=key) == sorted((cut(*r) for r in [*data.rows(), *more]), key=key)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_fill_in_middle_of_nothing(spark):
    empty = spark.createDataFrame([], SHAPE)
    assert infill.digest(infill.transformed(empty)).count() == 0 and rules.judged(empty).count() == 0


def test_only_parts_of_blocks_move(spark):
    """Two blocks a document at most are taken apart again, however long it is."""
    docs = spark.createDataFrame([(k, "word, " * 5000) for k in range(20)], SHAPE)
    ends = infill.offsets(infill.requests(docs))
    assert ends.count() <= 40
    plan = ends._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan


def counted(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


@pytest.mark.parametrize("shape", [data.documents, lambda s, extra: data.clash(data.documents(s, extra))])
def test_measurements(spark, shape):
    rows = rules.judged(shape(spark, ODD)).collect()
    want = Counter((d, *counted(t)) for d, t in [*data.rows(), *ODD])
    assert Counter(tuple(r[:6]) for r in rows) == want
    for r in rows:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept)


def test_repeated_words_by_brute_force(spark):
    @settings(max_examples=8, deadline=None)
    @given(st.lists(st.lists(st.sampled_from(["a", "b", "c", " ", "\n", "\t", "é", "ab"]), max_size=40).map("".join), min_size=1, max_size=40))
    def check(texts):
        rows = rules.measured(spark.createDataFrame([*enumerate(texts)], SHAPE)).select("doc_id", *rules.COUNTS).collect()
        assert {r[0]: tuple(r[1:]) for r in rows} == {k: counted(t) for k, t in enumerate(texts)}

    check()


def test_policies_and_ablations_read_bits_only(spark):
    texts = [(k, ("word%d " % (k % 3)) * (10 + 20 * (k % 5)) + "### !!! " * (k % 7) + "LOUD " * (k % 11)) for k in range(300)]
    kept = rules.ledger(spark.createDataFrame(texts, SHAPE))
    bits = [r.failures for r in kept.collect()]
    assert len(set(bits)) > 5
    got = {(r.version, r.rule): (r.n_docs, r.n_kept, r.n_fail, r.n_only) for r in rules.by_policy(kept).collect()}
    for p in rules.POLICIES:
        for k, rule in enumerate(rules.RULES):
            if rule.name in p.rejects:
                own = [b & p.mask() for b in bits]
                assert got.pop((p.version, rule.name)) == (300, own.count(0), sum(b >> k & 1 for b in own), own.count(1 << k))
            # Taking a rule out keeps as many more as fail it alone.
            without = rules.Policy("x", tuple(n for n in p.rejects if n != rule.name))
            assert kept.where(rules.applied(kept, without)).count() == sum(b & without.mask() == 0 for b in bits)
    assert not got
    groups = {r.g: r for r in rules.by_group(kept.withColumn("g", F.col("doc_id") % 3), "g").collect()}
    for g, r in groups.items():
        own = [b for (k, _), b in zip(texts, [x.failures for x in kept.orderBy("doc_id").collect()]) if k % 3 == g]
        some, every, odd = 0, -1, 0
        for b in own:
            some, every, odd = some | b, every & b, odd ^ b
        assert (r.some, r.every, r.odd) == (some, every, odd)


def test_rules_stay_on_the_engine(spark):
    docs = data.documents(spark)
    with noted() as paths:
        rows = rules.judged(docs)
    assert paths and "Python" not in rows._jdf.queryExecution().executedPlan().toString()
    plan = rules.measured(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan  # each document where it is read
