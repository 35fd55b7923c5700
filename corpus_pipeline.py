"""The corpus pipeline: toxicity, near duplicates, repeated passages, benchmark leaks, packing.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. The
caller writes it as Parquet and passes what it reads back as the next stage's ``docs``. So when a
stage begins, the one before is stored, and the tables that its operators wrote on the way are deleted: those
of the same ``sf_dir`` and of that stage only. All stages keep extra columns, rows with a null doc_id and
rows that share a doc_id with other texts; null and empty texts pass the filters and are packed as an end id alone.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from provena.llm import decontamination, near_dedup, packing, suffix_dedup, toxicity
from provena.llm.common import dropped, new_path, noted
from provena.llm.registry import BYTE_BPE, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Tables that the last stage of an sf_dir has written on the way.
_tables: dict[str, tuple[str, list[str]]] = {}


def stage(before: Stage | None) -> Callable[[Stage], Stage]:
    """A stage that deletes the tables of the one before and notes its own."""

    def wrap(function: Stage) -> Stage:
        @wraps(function)
        def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            last, paths = _tables.pop(sf_dir, (None, []))
            if before is not None and last == before.__name__:
                dropped(spark, paths)
            with noted() as own:
                out = function(spark, docs, sf_dir)
            _tables[sf_dir] = function.__name__, own
            return out

        return run_stage

    return wrap


@stage(None)
def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with a score below 0.7; a null or empty text has a score too."""
    return toxicity.without_toxic(docs, toxicity.fitted(docs, table(spark, sf_dir, "labels")))


@stage(reject_toxic)
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: five-word shingles, similarity of 0.8 or more. Texts without words are in no group."""
    return near_dedup.keep_firsts(docs, 80)


@stage(drop_near_duplicates)
def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without passages of 50 words or more that an earlier place has; one that holds nothing else goes."""
    return suffix_dedup.without_repeats(docs)


@stage(cut_repeats)
def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no benchmark item within its error budget."""
    return decontamination.without_leaks(docs, table(spark, sf_dir, "benchmark"))


@stage(drop_leaks)
def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the training windows, with their ids; of all rows, repeated ones too."""
    return packing.pack(docs, BYTE_BPE)


STAGES = [
    ("toxicity", reject_toxic),
    ("near_dedup", drop_near_duplicates),
    ("suffix_dedup", cut_repeats),
    ("decontamination", drop_leaks),
    ("packing", pack_windows),
]

#: Trained scores, sketches and tokenizers have no form in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each but the last is stored in the shared folder.

    A stored stage is deleted when the next one is stored; what the last stage reads stays.
    """
    docs, stored = table(spark, sf_dir, "documents"), []
    for name, function in STAGES[:-1]:
        path = new_path(spark, f"stage-{name}")
        kept = function(spark, docs, sf_dir)
        kept.write.parquet(path)
        docs = spark.read.schema(kept.schema).parquet(path)
        dropped(spark, stored)
        stored = [path]
    out = STAGES[-1][1](spark, docs, sf_dir)
    _tables.pop(sf_dir, None)
    return out
