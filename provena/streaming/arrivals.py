"""A folder of list files as a stream: each new file's rows are matched when it arrives, and study hits are widened as their samples come.

The catalog's targets are a static side, so matching keeps no state. Evidence does: a study hit waits for the samples of its project and a sample for hits on its
project, in the state of a join of two streams, so evidence is the same in whatever order files come. Verdicts need whole lists and stay with the batch plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provena.operators import matching
from provena.operators.keys import ASKED, CORPUS
from provena.sources.lists import projected


def arriving(spark: SparkSession, folder: str, columns: list[str], roles: dict[str, list[str]], model: str, stage: str, files: int | None = None) -> DataFrame:
    """Records from CSV files that appear in a folder, at most so many ``files`` a batch; a record's source is its file, its row a hash of the row."""
    shape = ", ".join(f"`{c}` string" for c in columns)
    options = {"maxFilesPerTrigger": files} if files else {}
    rows = spark.readStream.schema(shape).options(**options).csv(folder, header=True, comment="#", quote='"', escape='"')
    rows = rows.withColumn("source", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))
    rows = rows.withColumn("row", F.xxhash64(*(f"`{c}`" for c in columns)))
    found = projected(rows.withColumn("row", F.struct("source", "row")), roles)
    return found.select(F.lit(model).alias("model"), F.lit(stage).alias("stage"), "row.source", "row.row", *(c for c in found.columns if c not in ("row", "join_cell")))


def hits(records: DataFrame, targets: DataFrame) -> DataFrame:
    """(model, stage, dataset, key, source, row, project, sample, cells) of arriving records that carry a target's token."""
    wanted = targets.select(*ASKED, "key", "value").distinct()
    each = matching.tokens(records, ["project", "sample", "cells"])
    return each.join(wanted, ["model", "stage", "key", "value"]).select(*ASKED, "key", *matching.ROW, "project", "sample", "cells")


def matched(records: DataFrame, targets: DataFrame) -> DataFrame:
    """(model, stage, dataset, key, source, row) of arriving records that carry a target's token."""
    return hits(records, targets).select(*ASKED, "key", *matching.ROW)


def evidence(found: DataFrame, records: DataFrame) -> DataFrame:
    """(model, stage, dataset, source, row, sample, cells): what ``matching.evidence`` gives of all files, each row as soon as its hit and its sample are there.

    ``found`` are hits on these records. State grows with the samples of projects and the distinct hits; it is keyed by project and by evidence row and lies in Spark's state store.
    """
    own = found.where("sample is not null").select(*ASKED, *matching.ROW, "sample", "cells")
    studies = found.where("sample is null and project is not null").select(*ASKED, "project").dropDuplicates()
    samples = records.where("sample is not null and project is not null").select(*CORPUS, *matching.ROW, "project", "sample", "cells")
    behind = studies.join(samples, [*CORPUS, "project"]).select(*ASKED, *matching.ROW, "sample", "cells")
    return own.union(behind).dropDuplicates()
