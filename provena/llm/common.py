"""What the operators share: batches, range dealing, tolerant columns, and the shared folder's tables."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provena.shared import dropped, new_path, noted, shared_dir, written  # noqa: F401 (the operators take them from here)

_held: tuple[object, object] | None = None


def held(key: object, make: Callable[[], object]) -> object:
    """What an operator keeps in a Python worker between tasks; a worker keeps one thing only, so another key drops it."""
    global _held
    if _held is None or _held[0] != key:
        _held = None
        _give_back()
        _held = (key, make())
    return _held[1]


def _give_back() -> None:
    """Free memory that the last operator has left in this worker's allocators."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)  # only where the C library has it


#: Rows and bytes that a Python worker gets at once: texts are long, and a batch is held several times over. A longer text is a batch of its own.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20
_LIMITS = {"spark.sql.execution.arrow.maxRecordsPerBatch": BATCH_ROWS, "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES}


def small_batches(df: DataFrame) -> DataFrame:
    """Lowers the session's batch sizes for Python to ``BATCH_ROWS`` and ``BATCH_BYTES``, if they are larger; returns its argument.

    They stay lowered: plans read them when they run, and that may be after the operator has returned.
    """
    conf = df.sparkSession.conf
    for name, most in _LIMITS.items():
        now = conf.get(name, None)
        if now is None or not 0 < JavaSize.read(now) <= most:
            conf.set(name, str(most))
    return df


class JavaSize:
    """Numbers of the session's settings, with or without a unit of bytes."""

    UNITS = {"b": 0, "k": 10, "m": 20, "g": 30, "t": 40}

    @classmethod
    def read(cls, text: str) -> int:
        t = text.strip().lower().removesuffix("b") or "0"
        return int(t[:-1]) << cls.UNITS[t[-1]] if t[-1] in cls.UNITS else int(t)


def portions(texts: list[str], most: int = 64, size: int = 1 << 20) -> Iterator[slice]:
    """Slices of a list of texts: at most so many, and beyond one text at most so many characters."""
    at = held_ = 0
    for k, text in enumerate(texts):
        if k > at and (k - at >= most or held_ + len(text) > size):
            yield slice(at, k)
            at, held_ = k, 0
        held_ += len(text)
    if at < len(texts):
        yield slice(at, len(texts))


def shuffle_parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def place_of(names: list[str], name: str) -> int:
    """Where a column stands among others: the first of that name, else the first that differs in case only."""
    alike = [k for k, n in enumerate(names) if n == name] or [k for k, n in enumerate(names) if n.lower() == name.lower()]
    if not alike:
        raise ValueError(f"no column {name!r} among {names}")
    return alike[0]


def only(df: DataFrame, *kinds: tuple[str, str]) -> DataFrame:
    """The named columns, cast. All others are left behind, also such as differ in case only."""
    names = df.columns
    placed = df.toDF(*(f"_{k}" for k in range(len(names))))
    return small_batches(placed).select(*(F.col(f"_{place_of(names, name)}").cast(kind).alias(name) for name, kind in kinds))


def range_bounds(df: DataFrame, key: str, parts: int) -> list[int]:
    """Ascending existing values of a bigint key that cut the rows into at most ``parts`` ranges.

    The scan reads one column; the driver gets at most ``parts`` numbers.
    """
    if parts < 2:
        return []
    cuts = [i / parts for i in range(1, parts)]
    got = df.agg(F.percentile_approx(key, cuts, 10_000).alias("c")).first()["c"]
    return sorted(set(got or []))


def bucket_of(key: str, bounds: list[int]):
    """Index of the range that a bigint key falls into; null keys go to the first."""
    cuts = np.array(bounds, dtype=np.int64)

    @F.pandas_udf(T.IntegerType())
    def place(keys: pd.Series) -> pd.Series:
        null = keys.isna().to_numpy()
        at = np.searchsorted(cuts, keys.fillna(0).to_numpy(np.int64), side="right")
        return pd.Series(np.where(null, 0, at).astype(np.int32))

    return place(F.col(key)) if bounds else F.lit(0)


def text_of(values: Iterable) -> list[str]:
    """Python strings; null becomes empty."""
    return [v if isinstance(v, str) else "" for v in values]
