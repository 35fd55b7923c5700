"""A Bloom filter over key columns, as a table: what can't match is dropped before a shuffle.

The filter is in blocks of 512 bits, each a row of eight integers. A key's hash names its block, a second one some bits in it. Building it is one aggregation (bitwise OR by
block); testing is a broadcast join by block, in which rows whose bits aren't all set go. Rows that match are never lost, of the others about one in
two hundred stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits for each key, bits that a key sets, and the largest filter that is sent to the tasks: without one, more keys than that are joined as they are.
BITS, SET, MOST = 16, 5, 64 << 20
#: A row of the filter in memory: its number and an array of eight integers.
ROW = 104


def _block(on: list[str], blocks: int) -> Column:
    return F.pmod(F.xxhash64(*on), F.lit(blocks))


def _places(on: list[str]) -> list[Column]:
    """The bits of a key, 0 to 511."""
    h = F.xxhash64(F.lit(SET), *reversed(on))
    return [F.shiftrightunsigned(h, 9 * k).bitwiseAND(F.lit(511)).cast("int") for k in range(SET)]


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)))


def bloom(keys: DataFrame, on: list[str], n: int) -> DataFrame:
    """(block, words): the filter of at most n keys."""
    blocks = max(1, n * BITS // 512)
    each = keys.select(_block(on, blocks).alias("block"), F.explode(F.array(*_places(on))).alias("place"))
    word = lambda k: F.bit_or(F.when(F.shiftright("place", 6) == k, _bit(F.col("place"))).otherwise(F.lit(0).cast("long")))
    return each.groupBy("block").agg(F.array(*(word(k) for k in range(8))).alias("words"))


def fits(n: int, most: int = MOST) -> bool:
    """Whether a filter of n keys takes no more than ``most`` bytes."""
    return max(1, n * BITS // 512) * ROW <= most


def screened(rows: DataFrame, keys: DataFrame, on: list[str], n: int, most: int = MOST) -> DataFrame:
    """The rows that may have a partner among ``keys``, of which there are at most n; all rows if their filter would take more than ``most`` bytes."""
    if not fits(n, most):
        return rows
    near = _met(rows, keys, on, n, "inner")
    for test in _tests(on):
        near = near.where(test)
    return near.select(*rows.columns)


def parted(rows: DataFrame, keys: DataFrame, on: list[str], n: int, most: int = MOST) -> tuple[DataFrame, DataFrame | None]:
    """The rows that may have a partner among ``keys``, and those that have none; all rows and nothing if the filter would take more than ``most`` bytes."""
    if not fits(n, most):
        return rows, None
    met, test = _met(rows, keys, on, n, "left"), F.lit(True)
    for t in _tests(on):
        test &= t
    test = F.coalesce(test, F.lit(False))
    return met.where(test).select(*rows.columns), met.where(~test).select(*rows.columns)


def _met(rows: DataFrame, keys: DataFrame, on: list[str], n: int, how: str) -> DataFrame:
    words = F.broadcast(bloom(keys, on, n).withColumnRenamed("block", "block_").withColumnRenamed("words", "words_"))
    return rows.withColumn("block_", _block(on, max(1, n * BITS // 512))).join(words, "block_", how)


def _tests(on: list[str]) -> list[Column]:
    return [F.get("words_", F.shiftright(place, 6)).bitwiseAND(_bit(place)) != 0 for place in _places(on)]
