"""The Bloom filter before the token join, and evidence of a huge project."""

from pyspark.sql import functions as F

from provena import synthetic as syn
from provena.operators import keys, matching, screen
from provena.operators.keys import ASKED, CORPUS
from provena.shared import written

ON = [*CORPUS, "key", "value"]


def test_no_partner_is_lost_and_few_others_stay(spark):
    shape = "model string, stage string, key string, value string"
    keys_ = spark.range(3000).selectExpr("'m' as model", "'s' as stage", "'accession' as key", "'GSE' || id * 7 as value")
    rows = spark.range(100_000).selectExpr("'m' as model", "'s' as stage", "if(id % 11 = 0, null, 'accession') as key", "'GSE' || id as value", "id")
    near = screen.screened(rows, keys_, ON, 3000)
    assert near.columns == rows.columns
    must = rows.join(keys_, ON, "left_semi").count()
    assert near.join(keys_, ON, "left_semi").count() == must > 1000 and near.count() < must + 1500
    assert screen.screened(rows, keys_, ON, 3000, most=1000).count() == 100_000  # too large to send: nothing is dropped
    assert screen.screened(rows, spark.createDataFrame([], shape), ON, 0).count() == 0


def test_tokens_are_dropped_before_they_move(spark):
    sf = "/root/testdata/sf0.001"
    t = syn.tables(spark, sf)
    listed = t.corpora.where("type not in ('C-vague', 'D', 'by-design')")
    asked = syn.pairs(spark, sf).join(listed.select(*CORPUS), CORPUS, "left_semi")
    targets = written(keys.usable(asked, listed, t.identifiers), "targets")
    attempts = written(keys.attempted(asked, listed, targets, t.absent), "attempts")
    plain, less = (matching.matches(targets, attempts, t.records, n) for n in (None, targets.count()))
    assert sorted(map(str, plain.collect())) == sorted(map(str, less.collect())) and plain.count() > 10
    tried = attempts.select(*ASKED, F.explode("keys_attempted").alias("key"))
    wanted = targets.select(*ASKED, "key", "value").distinct().join(tried, [*ASKED, "key"])
    tokens = matching.tokens(t.records)
    kept, met = screen.screened(tokens, wanted, ON, targets.count()).count(), tokens.join(wanted, ON, "left_semi").count()
    assert met <= kept <= met + 0.02 * tokens.count()


def test_one_project_with_most_rows(spark):
    """The rows of a huge project are dealt out to all tasks, and its ids come together as arrays."""
    n = 40_000
    own = spark.range(n).selectExpr("'m' as model", "'s' as stage", "'f' as source", "id as row", "if(id % 10 < 9, 'P', 'Q' || id) as project", "'GSM' || id % 30000 as sample", "id % 3 as cells")
    hits = spark.createDataFrame([("m", "s", "d", "f", -1, "P", None, None), ("m", "s", "e", "f", -2, "Q9", None, None)], "model string, stage string, dataset string, source string, row long, project string, sample string, cells long")
    rows = matching.evidence(hits, own)
    got = {r.dataset: r for r in matching.united(rows).collect()}
    samples = {f"GSM{k % 30000}" for k in range(n) if k % 10 < 9}
    assert got["d"].sample_ids == sorted(samples) and got["d"].cells == sum(k % 3 for k in range(n) if k % 10 < 9) and got["e"].sample_ids == ["GSM9"]
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        each = rows.groupBy(*ASKED, matching.sample_id(F.col("sample")).alias("sample_id")).agg(F.sum("cells").alias("cells"))
        sizes = sorted(r["count"] for r in each.groupBy(F.spark_partition_id()).count().collect())
        assert len(sizes) == 4 and sizes[-1] < 1.5 * sizes[0]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_tokens_are_screened_by_value_where_targets_are_too_many(spark):
    """40 corpora ask for the same 50 values: their 2,000 targets have no filter of 1,000 bytes, the values have."""
    text = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    corpora, none = spark.range(40).select(text("m", "id").alias("model"), F.lit("s").alias("stage")), F.array().cast("array<string>")
    wanted = corpora.crossJoin(spark.range(50).select(text("d", "id").alias("dataset"), F.lit("accession").alias("key"), text("GSE", "id").alias("value")))
    records = spark.range(4000).select(
        text("m", "id").alias("model"), F.lit("s").alias("stage"), F.lit("list").alias("source"), F.col("id").alias("row"), F.lit("P").alias("project"), F.lit(None).cast("string").alias("sample"), F.lit(1).cast("long").alias("cells"),
        F.array(text("GSE", "id")).alias("accessions"), none.alias("pmids"), none.alias("dois"),
    ).withColumn("model", F.concat(F.lit("m"), (F.col("row") % 80).cast("string")))
    plain, less = matching.met(wanted, records), matching.met(wanted, records, 2000, 1000)
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, less.collect())) and plain.count() == 40
    plan = less._jdf.queryExecution().optimizedPlan().toString()
    assert "words_" in plan and "LeftSemi" in plan


def test_what_is_tried_of_a_pair_equals_the_tables(spark):
    """``keys.tried`` tells in one row of a pair what usable, attempted and identified tell, without a shuffle by pair."""
    shape = "model string, stage string, keys_available array<string>, accession_types array<string>"
    corpora = spark.createDataFrame([("a", "s", ["accession", "pmid"], None), ("b", "s", ["pmid"], ["sra"]), ("c", "s", ["accession", "doi", "title"], []), ("d", "s", None, None)], shape)
    rows = [("x", 0, "geo", "gse1", "true", "one"), ("x", 1, "pmid", "7", "provisional", "two"), ("x", 2, "pmid", "8", "provisional", ""), ("y", 0, "sra", "srp1", "provisional", None), ("y", 1, "geo", "gse2", "false", "z"), ("z", 0, "url", "u", "true", None)]
    identifiers = spark.createDataFrame(rows, "dataset string, ord long, type string, value string, confirmed string, basis string")
    absent = spark.createDataFrame([("y", "pmid"), ("x", "pmid"), ("w", "doi"), ("z", "title")], "dataset string, key string")
    pairs = corpora.select("model", "stage").crossJoin(spark.createDataFrame([(d,) for d in "wxyz"], "dataset string"))
    targets = keys.usable(pairs, corpora, identifiers)
    attempts = keys.identified(keys.attempted(pairs, corpora, targets, absent), targets)
    one = keys.tried(pairs, corpora, identifiers, absent)
    shown = lambda df: sorted(map(str, df.collect()))
    assert shown(one.drop("targets")) == shown(attempts.select(*one.drop("targets").columns)) and one.count() == 16
    open_ = attempts.select("model", "stage", "dataset", F.explode("keys_attempted").alias("key"))
    assert shown(matching.wanted(one)) == shown(targets.join(open_, ["model", "stage", "dataset", "key"]).select("model", "stage", "dataset", "key", "value").distinct())


def test_rows_with_and_without_partner(spark):
    keys_ = spark.range(0, 7000, 7).withColumnRenamed("id", "h")
    rows = spark.range(20_000).selectExpr("if(id % 19 = 0, null, id) as h", "id")
    near, rest = screen.parted(rows, keys_, ["h"], 1000)
    got, left = ({r.id for r in x.collect()} for x in (near, rest))
    assert near.columns == rest.columns == rows.columns and got | left == set(range(20_000)) and not got & left
    assert {k for k in range(0, 7000, 7) if k % 19} <= got and len(got) < 1500
    every, nothing = screen.parted(rows, keys_, ["h"], 1000, most=10)
    assert every.count() == 20_000 and nothing is None
