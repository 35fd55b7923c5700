"""The registry turned round to its datasets, and everything that is shown or given away of it."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provena import sinks
from provena.operators import keys, views
from provena.plans import registry
from provena.sources import catalog

#: Fixed value: the version of the ledger's shape.
VERSION = 3


@dataclass
class Ledger:
    """``models``, ``rows`` (one for each recorded finding, with its relation and whether it is a draft's), ``datasets`` (the inversion)."""

    models: DataFrame
    rows: DataFrame
    datasets: DataFrame


def build(t: dict[str, DataFrame]) -> Ledger:
    """The ledger of registry tables (see ``provena.sources.catalog``)."""
    drafts = t["models"].select("model", "draft")
    rows = keys.related(t["recorded"].drop("ord"), t["evaluated_on"]).join(drafts, "model")
    unchecked = t["discovery"].where("not checked").groupBy("model").agg(F.sort_array(F.collect_set("location")).alias("discovery_unchecked"))
    judged = t["evaluated_on"].groupBy("model").agg(F.sort_array(F.collect_list(F.struct("ord", "dataset"))).alias("e"))
    models = t["models"].drop("doc", "file").join(unchecked, "model", "left").join(judged, "model", "left")
    none = F.array().cast("array<string>")
    models = models.withColumn("discovery_unchecked", F.coalesce("discovery_unchecked", none)).withColumn("evaluated_on", F.coalesce(F.col("e.dataset"), none)).drop("e")
    return Ledger(models, rows, views.ledger(rows, t["datasets"].drop("doc", "file"), t["evaluated_on"]))


def ledger(spark: SparkSession, root: str | Path, datasets: list[str] | None = None) -> Ledger:
    """The ledger of a registry folder, of all datasets or some."""
    t = catalog.load(spark, root)
    out = build(t)
    if datasets:
        known = {r.dataset for r in t["datasets"].select("dataset").collect()}
        if unknown := set(datasets) - known:
            raise KeyError(f"unknown datasets: {sorted(unknown)}")
        some = F.col("dataset").isin(datasets)
        out = Ledger(out.models, out.rows.where(some), out.datasets.where(some))
    return out


def export_views(spark: SparkSession, root: str | Path, out: str) -> list[str]:
    """Writes the ledger, the page tables and the lookup index under ``out``, as JSON lines in a folder each; returns their names."""
    t = catalog.load(spark, root)
    made = build(t)
    found = {
        "models": made.models, "rows": made.rows, "datasets": made.datasets, "reuse": views.reuse_table(made.rows, t["evaluated_on"]), "cards": views.cards(made.rows), "classes": views.classes(made.models),
        "grouped": views.grouped(made.rows), "by_relation": views.by_relation(made.rows), "dataset_pages": views.dataset_rows(made.rows, made.models), "how_checked": views.how_checked(t["sources"], t["corpora"], t["models"], t["discovery"]),
        "judgment_calls": views.judgment_calls(made.rows, t["datasets"], t["corpora"]), "plausibility": views.plausibility(made.rows),
        "review_points": views.review_points(t, made.rows),
    }
    for name, rows in found.items():
        sinks.json_lines(rows, f"{out}/{name}")
    tables, t, failed = registry.open_registry(spark, root, skip=True, drafts=False)
    sinks.lookup_index(tables.records, t, failed, f"{out}/lookup")
    return [*found, "lookup"]

