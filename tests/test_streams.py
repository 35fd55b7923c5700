"""Arriving files in any order, and counts over any division into batches."""

import itertools
import os

import pytest
from pyspark.sql import functions as F

from provena.operators import matching
from provena.sources.lists import projected
from provena.streaming import arrivals, rollup

COLUMNS = ["study", "run", "size", "paper"]
ROLES = {"accession": ["study", "run"], "project": ["study"], "sample": ["run"], "cells": ["size"], "pmid": ["paper"]}
FILES = {
    "studies.csv": "study,run,size,paper\nSRP1,,,77\nSRP2,,,78\nSRP1,,,\n",
    "runs-a.csv": "study,run,size,paper\nSRP1,SRR11,5,\nSRP2,SRR21,7,\nSRP3,SRR31,1,79\n",
    "runs-b.csv": "study,run,size,paper\nSRP1,SRR12,6,\nSRP1,SRR12,6,\nSRP3,SRR32,2,\n",
    "papers.csv": "study,run,size,paper\nSRP3,,,79\n",
}
TARGETS = [("m", "s", "one", "accession", "SRP1"), ("m", "s", "one", "pmid", "77"), ("m", "s", "two", "pmid", "78"), ("m", "s", "three", "pmid", "79"), ("m", "s", "four", "accession", "SRR12")]
KEEP = ["model", "stage", "dataset", "source", "row", "sample", "cells"]


def targets(spark):
    return spark.createDataFrame(TARGETS, "model string, stage string, dataset string, key string, value string")


def batch(spark, folder):
    """The batch plan over the same files."""
    rows = spark.read.schema(", ".join(f"{c} string" for c in COLUMNS)).csv(f"{folder}/*.csv", header=True)
    rows = rows.withColumn("row", F.struct(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("source"), F.xxhash64(*COLUMNS).alias("row")))
    found = projected(rows, ROLES)
    records = found.select(F.lit("m").alias("model"), F.lit("s").alias("stage"), "row.source", "row.row", *(c for c in found.columns if c not in ("row", "join_cell")))
    tried = targets(spark).groupBy("model", "stage", "dataset").agg(F.collect_set("key").alias("keys_attempted"))
    return matching.evidence(matching.matches(targets(spark), tried, records), records)


@pytest.mark.parametrize("order", [k for k in itertools.permutations(FILES) if k[0] != "papers.csv"][::5])
def test_evidence_in_any_order_of_files(spark, tmp_path, order):
    (tmp_path / "in").mkdir()
    for k, name in enumerate(order):
        (tmp_path / "in" / name).write_text(FILES[name])
        os.utime(tmp_path / "in" / name, (1_700_000_000 + k, 1_700_000_000 + k))
    records = arrivals.arriving(spark, f"file://{tmp_path}/in", COLUMNS, ROLES, "m", "s", files=1)
    rows = arrivals.evidence(arrivals.hits(records, targets(spark)), records)
    run = rows.writeStream.format("memory").queryName(f"evidence_{abs(hash(order))}").outputMode("append").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    run.awaitTermination(240)
    assert run.exception() is None
    got = [tuple(r) for r in spark.table(f"evidence_{abs(hash(order))}").select(KEEP).collect()]
    want = [tuple(r) for r in batch(spark, tmp_path / "in").select(KEEP).collect()]
    assert sorted(got) == sorted(want) and len(got) == len(set(got))
    assert {(r[2], r[5]) for r in got} == {("one", "SRR11"), ("one", "SRR12"), ("two", "SRR21"), ("three", "SRR31"), ("three", "SRR32"), ("four", "SRR12")}


@pytest.fixture
def rows(spark):
    return spark.range(5000).selectExpr("if(id % 50 = 0, null, 'a' || id % 3) as a", "id % 7 as b", "id as x", "id % 11 as part")


def shown(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("batches", [1, 4, 11])
def test_any_batches_give_one_aggregation(spark, tmp_path, rows, batches):
    kept = rollup.Rollup(spark, f"file://{tmp_path}/counts", ["a", "b"], ["x"])
    with pytest.raises(ValueError):
        kept.counts()
    for k in range(batches):
        kept.add(rows.where(F.col("part") % batches == k), k)
        if k == 2:
            kept.compact()
            kept.add(rows.where(F.col("part") % batches == 1), 1)  # a replay of what is compacted
        kept.add(rows.where(F.col("part") % batches == k), k)  # a replay of the batch itself
    assert shown(kept.counts()) == shown(kept.partial(rows))
    kept.compact()
    kept.compact()
    assert shown(kept.counts()) == shown(kept.partial(rows)) and kept._numbers("parts", "batch") == []


def test_an_unfinished_compaction_counts_nothing_twice(spark, tmp_path, rows):
    kept = rollup.Rollup(spark, f"file://{tmp_path}/counts", ["a", "b"], ["x"])
    for k in range(3):
        kept.add(rows.where(F.col("part") % 3 == k), k)
    want = shown(kept.counts())
    kept.counts().write.parquet(f"file://{tmp_path}/counts/sums/upto=2")  # stored, and then lost before anything is deleted
    assert shown(kept.counts()) == want
    (tmp_path / "counts/sums/upto=2/_SUCCESS").unlink()  # lost while it was being stored
    assert shown(kept.counts()) == want


def test_a_stream_is_counted_as_it_comes(spark, tmp_path, rows):
    for k in range(5):
        rows.where(F.col("part") % 5 == k).coalesce(1).write.parquet(f"file://{tmp_path}/in/part{k}")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"file://{tmp_path}/in")
    kept = rollup.Rollup(spark, f"file://{tmp_path}/counts", ["a", "b"], ["x"])
    run = kept.follow(stream, f"file://{tmp_path}/state", every=2)
    run.awaitTermination(240)
    assert run.exception() is None and shown(kept.counts()) == shown(kept.partial(rows)) and kept._upto() >= 1
