"""Counts by some columns that are kept while batches arrive.

Each batch leaves its partial counts under its own number, so a batch that is run again replaces itself and counts once. Partial counts are added up where they are read,
and ``compact`` adds up those of finished batches for good. Counts and sums can be added in any order, so any division into batches gives what one aggregation of all rows gives.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


@dataclass
class Rollup:
    """Counts of rows and sums of ``measures`` for each combination of ``dims``; rows with a null among ``dims`` don't count. ``path`` is a folder of its own."""

    spark: SparkSession
    path: str
    dims: list[str]
    measures: list[str] = field(default_factory=list)

    def partial(self, rows: DataFrame) -> DataFrame:
        return rows.na.drop(subset=self.dims).groupBy(*self.dims).agg(F.count("*").alias("n"), *(F.sum(m).alias(m) for m in self.measures))

    def add(self, rows: DataFrame, batch: int) -> None:
        """Count one batch. Numbers ascend from 0, as a stream gives them; a number up to the last compaction has been counted and is left alone."""
        if batch > self._upto():
            self.partial(rows).write.mode("overwrite").parquet(f"{self.path}/parts/batch={batch}")

    def counts(self) -> DataFrame:
        """The counts of all batches so far."""
        rows = self._stored()
        return rows.groupBy(*self.dims).agg(F.sum("n").alias("n"), *(F.sum(m).alias(m) for m in self.measures))

    def compact(self) -> None:
        """Add up the partial counts of all batches so far. What it replaces is deleted only when the sum is stored, so a crash loses nothing and counts nothing twice."""
        numbers = self._numbers("parts", "batch")
        last = max([self._upto(), *numbers], default=-1)
        if not numbers or last <= self._upto():
            return
        old = self._numbers("sums", "upto")
        self.counts().write.mode("overwrite").parquet(f"{self.path}/sums/upto={last}")
        for name in (*(f"sums/upto={n}" for n in old), *(f"parts/batch={n}" for n in numbers if n <= last)):
            self._delete(name)

    def follow(self, stream: DataFrame, checkpoint: str, every: int = 100, **trigger) -> StreamingQuery:
        """Count a stream's batches as they come, and compact after every so many."""

        def take(rows: DataFrame, batch: int) -> None:
            self.add(rows, batch)
            if batch % every == every - 1:
                self.compact()

        return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

    def _stored(self) -> DataFrame:
        upto = self._upto()
        places = [f"{self.path}/sums/upto={upto}"] * (upto >= 0) + [f"{self.path}/parts/batch={n}" for n in self._numbers("parts", "batch") if n > upto]
        if not places:
            raise ValueError(f"no batch has been counted under {self.path}")
        return self.spark.read.parquet(*places)

    def _upto(self) -> int:
        return max(self._numbers("sums", "upto"), default=-1)

    def _numbers(self, kind: str, name: str) -> list[int]:
        """The numbers of finished folders: those with Spark's mark of success."""
        root, system = self._at(kind)
        if not system.exists(root):
            return []
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        found = [x.getPath() for x in system.listStatus(root)]
        return sorted(int(p.getName().removeprefix(f"{name}=")) for p in found if p.getName().startswith(f"{name}=") and system.exists(path(p, "_SUCCESS")))

    def _delete(self, name: str) -> None:
        place, system = self._at(name)
        system.delete(place, True)

    def _at(self, name: str):
        context = self.spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path, path.getFileSystem(context._jsc.hadoopConfiguration())
