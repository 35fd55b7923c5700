"""The shared folder: intermediate tables that several later steps read.

They are written as Parquet, so each reader gets only the columns that it needs, and no lost executor makes a step run again. Nothing
deletes them unasked, as results are lazy and may still need them: wrap what computes and stores a result in ``scratch``.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where it is unset, a session on one machine (tests) gets a temporary one, a cluster an error."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="shared-")
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def shuffle_parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


_noted: ContextVar[list[str] | None] = ContextVar("noted", default=None)


@contextlib.contextmanager
def noted() -> Iterator[list[str]]:
    """The paths that are handed out within this context, and nowhere else."""
    paths: list[str] = []
    before = _noted.set(paths)
    try:
        yield paths
    finally:
        _noted.reset(before)


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    if (paths := _noted.get()) is not None:
        paths.append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.is_stored = True
    return out


def kept(df: DataFrame, columns: list[str], name: str) -> DataFrame:
    """``df`` itself if ``written`` gave it, else some of its columns, written."""
    return df if getattr(df, "is_stored", False) else written(df.select(*columns), name)


def exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def dropped(spark: SparkSession, paths: list[str]) -> None:
    """Delete the tables at these paths. Call it only when every result built on them has been stored."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while paths:
        path = jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(conf).delete(path, True)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what was written within it: ``with scratch(spark): registry.check(spark, root).write.parquet(out)``."""
    with noted() as paths:
        try:
            yield
        finally:
            dropped(spark, paths)
