"""All integrity constraints over a registry folder."""

from __future__ import annotations

import datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provena.operators import compare, guards, versions
from provena.plans import registry
from provena.plans.check import all_pairs, findings
from provena.sources import catalog, lists

def _files(spark: SparkSession, root: Path, t: dict[str, DataFrame]) -> DataFrame:
    """(path, sha256, parent) of every committed file that a source names and that is there."""
    s = t["sources"]
    named = s.select(F.explode(F.array_compact(F.concat(F.array("snapshot", "extract"), F.col("join_tables.snapshot")))).alias("name")).distinct()
    return lists.committed_facts(spark, root, named).select(F.col("name").alias("path"), "sha256", "parent")


def earlier(spark: SparkSession, root: str | Path, since: str | Path) -> DataFrame:
    """(model, reviewed_by, reviewed_date, content): what each model's entry was in an earlier state, under the id that it has now; new entries have no row."""
    entries = lambda place: catalog.documents(spark, place).where("kind = 'registry'").select("file", "text")
    models = lambda place: catalog.load(spark, place)["models"].withColumn("file", F.concat("file", F.lit(".yaml")))
    mapped = versions.renamed(entries(root), entries(since)).where("before is not null")
    old = models(since).select(F.col("file").alias("before"), "reviewed_by", "reviewed_date", guards.content(F.col("doc")).alias("content"))
    return models(root).select("file", "model").join(mapped, "file").join(old, "before").drop("file", "before")


def validate(spark: SparkSession, root: str | Path, today: str | None = None, stale_months: int = 12, allow_draft: bool = False, fetched: DataFrame | None = None, before: DataFrame | None = None, since: str | Path | None = None) -> DataFrame:
    """(code, severity, model, dataset, place, message) of every violation; errors first.

    ``since`` is the root of an earlier state, against which reviews are compared, also of entries that were renamed; ``before`` is such a comparison made elsewhere.
    """
    root = Path(root)
    everything = catalog.load(spark, root)
    if since is not None:
        before = earlier(spark, root, since)
    faults = everything["faults"]
    bad = {r.id for r in faults.where("kind = 'model'").select("id").distinct().collect()}
    good = [r.model for r in everything["models"].select("model").distinct().collect() if r.model not in bad]
    t, rerun = everything, None
    if good:
        tables, t, _ = registry.open_registry(spark, root, skip=True, models=good, tables=everything)
        own = tables.splits.select("model", "stage", "dataset")
        pairs = all_pairs(tables.corpora, t["datasets"].select("dataset")).unionByName(own)
        rerun = compare.differences(t["recorded"], findings(tables, pairs))
    elif bad:
        t = {k: v.limit(0) if "model" in v.columns else v for k, v in t.items()}
    day = today or datetime.date.today().isoformat()
    out = guards.issues(spark, t, {r.initials for r in everything["reviewers"].collect()}, _files(spark, root, t), day, stale_months, allow_draft, None, rerun, fetched, before)
    of = lambda kind: F.when(F.col("kind") == kind, F.col("id"))
    more = faults.select(F.lit("G00").alias("code"), F.lit("error").alias("severity"), of("model").alias("model"), of("dataset").alias("dataset"), F.lit("").alias("place"), "message")
    return out.unionByName(more).orderBy("severity", "code", "place")
