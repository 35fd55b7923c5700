"""Checks over a registry folder: plan the sources, search all corpora at once, compare with what is recorded."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provena.operators import compare
from provena.plans.check import Tables, all_pairs, findings
from provena.sources import catalog, lists

RECORDS = "model string, stage string, source string, row long, project string, sample string, title string, citation string, cells long, accessions array<string>, pmids array<string>, dois array<string>"
UNLISTED = ("C-vague", "D", "by-design")


def _locator(spark: SparkSession, sources: DataFrame, root: str | Path, otherwise: Callable | str | Path | None) -> Callable[[dict], str]:
    """Where a source's list is. All files are hashed by tasks and met with the sources by a join; only with a function of the caller's are they looked for one by one here."""
    if callable(otherwise):
        return lists.committed(root, otherwise)
    joins = sources.select("model", "stage", F.explode("join_tables").alias("j")).select("model", "stage", F.col("j.name").alias("source"), F.col("j.snapshot").alias("snapshot"), F.col("j.sha256").alias("sha256"))
    own = sources.select("model", "stage", "source", "snapshot", "sha256", "url", "extract").unionByName(joins, allowMissingColumns=True)
    found = {(r.source, r.snapshot, r.extract, r.sha256): r for r in lists.located(own, root, otherwise).collect()}  # a row for each list file, which the plan names one by one

    def locate(source: dict) -> str:
        r = found[source.get("source") or source.get("name"), source.get("snapshot"), source.get("extract"), source["sha256"]]
        if r.problem:
            raise lists.SourceError(r.problem)
        return r.path

    return locate


def open_registry(spark: SparkSession, root: str | Path, models: list[str] | None = None, otherwise: Callable | str | Path | None = None, skip: bool = False, drafts: bool = True, tables: dict[str, DataFrame] | None = None) -> tuple[Tables, dict[str, DataFrame], dict[tuple, str]]:
    """The tables of a check, all registry tables, and what could not be opened by (model, stage).

    A source that is missing or changed raises, or with ``skip`` takes its whole corpus out of the tables of a check: a list is searched
    as a whole or not at all, so ``unsearched`` is always empty here. Without ``drafts`` entries that nobody has reviewed are left out.
    """
    t = tables or catalog.load(spark, root)
    if models:
        known = {r.model for r in t["models"].select("model").collect()}
        if unknown := set(models) - known:
            raise KeyError(f"unknown models: {sorted(unknown)}")
        t = {k: v.where(F.col("model").isin(models)) if "model" in v.columns else v for k, v in t.items()}
    if not drafts:
        reviewed = t["models"].where("not draft").select("model")
        t = {k: v.join(reviewed, "model", "left_semi") if "model" in v.columns else v for k, v in t.items()}
    locate, found, failed = _locator(spark, t["sources"], root, otherwise), None, {}
    types = {(r.model, r.stage): r for r in t["corpora"].select("model", "stage", "type", "resolver").collect()}
    by_corpus: dict[tuple, list[dict]] = {}
    for s in t["sources"].orderBy("model", "stage", "ord").collect():
        by_corpus.setdefault((s.model, s.stage), []).append(s.asDict(recursive=True))
    for corpus in sorted(types):
        sources = by_corpus.get(corpus, [])
        if types[corpus].type in UNLISTED:
            continue
        try:
            if types[corpus].resolver not in catalog.RESOLVERS:
                raise lists.SourceError(f"no resolver for {types[corpus].resolver!r} manifests")
            part = lists.records(spark, sources, locate)
        except (lists.SourceError, OSError) as e:
            if not skip:
                raise
            failed[corpus] = str(e)
            continue
        if part is not None:
            found = part if found is None else found.unionByName(part)
    corpora = t["corpora"].withColumn("unsearched", F.array().cast("array<string>"))
    if failed:
        corpora = corpora.join(spark.createDataFrame([*failed], "model string, stage string"), ["model", "stage"], "left_anti")
    records = found if found is not None else spark.createDataFrame([], RECORDS)
    return Tables(corpora, t["identifiers"], t["absent"], records, t["evaluated_on"], t["splits"]), t, failed


def check(spark: SparkSession, root: str | Path, models: list[str] | None = None, datasets: list[str] | None = None, otherwise: Callable | str | Path | None = None, skip: bool = False) -> DataFrame:
    """Findings of every corpus and dataset, or of some."""
    tables, t, _ = open_registry(spark, root, models, otherwise, skip)
    asked = t["datasets"].select("dataset")
    if datasets:
        if unknown := set(datasets) - {r.dataset for r in asked.collect()}:
            raise KeyError(f"unknown datasets: {sorted(unknown)}")
        asked = asked.where(F.col("dataset").isin(datasets))
    pairs = all_pairs(tables.corpora, asked)
    own = tables.splits.join(asked, "dataset", "left_semi").select("model", "stage", "dataset")
    return findings(tables, pairs.unionByName(own))


def rerun(spark: SparkSession, root: str | Path, models: list[str] | None = None, skip: bool = False) -> DataFrame:
    """Where recorded findings differ from a fresh run."""
    recorded = catalog.load(spark, root)["recorded"]
    return compare.differences(recorded, check(spark, root, models, skip=skip))
