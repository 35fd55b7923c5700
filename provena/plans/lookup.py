"""From typed lines to answers over a registry folder, in one call."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provena.operators import lookup as ops
from provena.plans import registry
from provena.sources import crosswalk, index

CACHE = "kind string, query string, accessions array<string>, pmids array<string>, doi string"


@dataclass
class Lookup:
    """``queries`` and ``identifiers`` as interpreted, ``answers`` of each query and corpus, ``coverage`` of each query."""

    queries: DataFrame
    identifiers: DataFrame
    answers: DataFrame
    coverage: DataFrame


def typed(spark: SparkSession, inputs: Iterable[str] | DataFrame) -> DataFrame:
    """(query_id, raw): lines that say something, numbered from 1 as typed; a DataFrame has the columns already."""
    if isinstance(inputs, DataFrame):
        return inputs.select("query_id", "raw")
    rows = spark.createDataFrame([(str(k), line) for k, line in enumerate(inputs, start=1)], "query_id string, value string")
    return ops.query_lines(rows, "query_id")


def lookup(spark: SparkSession, root: str | Path, inputs: Iterable[str] | DataFrame, cache: str | DataFrame | None = None, models: list[str] | None = None, include_drafts: bool = False, otherwise: Callable | None = None) -> Lookup:
    """Every input against every corpus of the registry, or of some models; drafts only with ``include_drafts``.

    ``cache`` is a crosswalk folder or table; without it nothing is expanded. A corpus whose list can't be opened here has an answer that says
    so. Answers also name the model, the sources searched and the review.
    """
    tables, t, failed = registry.open_registry(spark, root, models, otherwise, skip=True, drafts=include_drafts)
    return _answered(spark, inputs, cache, t | {"corpora": _corpora(spark, t, failed)}, tables.records)


def build_index(spark: SparkSession, root: str | Path, path: str, include_drafts: bool = False, otherwise: Callable | None = None, buckets: int = index.BUCKETS) -> None:
    """Store what lookups need of a registry folder: its reviewed entries, and drafts only with ``include_drafts``."""
    tables, t, failed = registry.open_registry(spark, root, None, otherwise, skip=True, drafts=include_drafts)
    index.write(tables.records, t | {"corpora": _corpora(spark, t, failed)}, path, buckets)


def lookup_stored(spark: SparkSession, path: str, inputs: Iterable[str] | DataFrame, cache: str | DataFrame | None = None, models: list[str] | None = None) -> Lookup:
    """The same answers as ``lookup`` gives over the lists, from a stored index alone; ``models`` reads their shelves only."""
    stored = index.open_index(spark, path, models)
    return _answered(spark, inputs, cache, {name: stored.small(name) for name in index.SMALL}, stored)


def _corpora(spark: SparkSession, t: dict[str, DataFrame], failed: dict[tuple, str]) -> DataFrame:
    why = spark.createDataFrame([(*corpus, text) for corpus, text in failed.items()], "model string, stage string, unavailable string")
    return t["corpora"].join(why, ["model", "stage"], "left")


def _answered(spark: SparkSession, inputs: Iterable[str] | DataFrame, cache: str | DataFrame | None, t: dict[str, DataFrame], records: DataFrame | index.Index) -> Lookup:
    if cache is None:
        cache = spark.createDataFrame([], CACHE)
    elif not isinstance(cache, DataFrame):
        cache = crosswalk.read(spark, cache)
    queries, identifiers = ops.interpreted(typed(spark, inputs), t["datasets"], t["identifiers"], cache)
    shown = t["models"].select("model", F.col("name").alias("model_name"), F.nullif("reviewed_by", F.lit("")).alias("reviewed_by"), "reviewed_date", "draft")
    # Each corpus brings what is shown beside its answers, so answers are not joined for it.
    rows = ops.answers(queries, identifiers, t["corpora"].join(shown, "model"), records, t["recorded"], more=["model_name", "reviewed_by", "reviewed_date", "draft", "sources_searched"])
    return Lookup(queries, identifiers, rows, ops.warned(queries, rows))
