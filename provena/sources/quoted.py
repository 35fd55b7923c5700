"""CSV whose quoted fields hold line breaks, read in parallel.

Whether a line begins inside a quoted field depends on all lines before it. But what a line does to that state doesn't: begun outside quotes it ends inside or outside, and
begun inside likewise. So each line is one of four functions of two states: it keeps the state, turns it round, or ends inside or outside in any case. Functions are
composed within each part of the file by a window, then over the parts, of which there is one row each, and so every line learns its state; rows are
cut where a line begins outside.

A quote opens a field only at its begin; elsewhere it is text. Two quotes inside a quoted field are one. An unclosed quote makes the rest of the file one row, as it does
for any reader.
"""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Lines that are looked through for the first row, before all rows are.
HEAD = 100
#: Lines of a part, whose states are worked out in order: a file's block, which may hold millions, is several parts.
LINES = 1 << 16


def _open(text: Column) -> Column:
    """Whether text without doubled quotes, begun at a field, ends inside a quoted one: closed fields are taken out, and an opening quote is left."""
    return F.regexp_replace(text, '(^|,)"[^"]*"', "$1").rlike('(^|,)"')


def transitions(line: Column) -> tuple[Column, Column]:
    """Whether a line ends inside quotes if it begins outside (a comment doesn't), and if it begins inside."""
    text = F.replace(line, F.lit('""'), F.lit(""))
    closed = F.instr(text, '"')
    after = F.concat(F.lit("."), F.substr(text, closed + 1))
    return ~line.startswith("#") & _open(text), (closed == 0) | _open(after)


def _state(rows: DataFrame, sure: str, turns: str, *order: str, by: list[str]) -> DataFrame:
    """Adds ``known`` (the state after each row if a row up to it fixes the state, else null) and ``turned`` (whether the state is turned round since then, or since the begin)."""
    upto = (Window.partitionBy(*by) if by else Window.partitionBy()).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("sum_", F.sum(turns).over(upto))
    fixed = F.last(F.when(F.col(sure).isNotNull(), F.struct(F.col(sure).alias("s"), F.col("sum_").alias("n"))), ignorenulls=True).over(upto)
    rows = rows.withColumn("fixed_", fixed)
    turned = (F.col("sum_") - F.coalesce("fixed_.n", F.lit(0))) % 2 == 1
    return rows.withColumn("turned", turned).withColumn("known", F.when(F.col("fixed_").isNotNull(), F.col("fixed_.s") != F.col("turned"))).drop("sum_", "fixed_")


def records(spark: SparkSession, path: str) -> DataFrame:
    """(record, text): the file's rows in order, each as one text with its line breaks; comments and empty lines are no rows."""
    lines = spark.read.text(path, lineSep="\n").select(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), "value")
    # Ids of a block go up in the order of its lines, so that is how its parts follow each other.
    part = ["block", "chunk"]
    lines = lines.withColumn("chunk", F.expr(f"id div {LINES}"))
    outside, inside = transitions(F.col("value"))
    lines = lines.withColumn("o", outside).withColumn("i", inside)
    lines = lines.withColumn("sure", F.when(F.col("o") == F.col("i"), F.col("o"))).withColumn("turns", (F.col("o") & ~F.col("i")).cast("int"))
    lines = _state(lines, "sure", "turns", "id", by=part)
    # What each part does as a whole, and so the state in which it begins.
    parts = lines.groupBy(*part).agg(F.max_by(F.struct("known", "turned"), "id").alias("z")).select(*part, "z.*")
    parts = parts.select(*part, F.col("known").alias("sure"), F.when(F.col("known").isNull() & F.col("turned"), 1).otherwise(0).alias("turns"))
    parts = _state(parts, "sure", "turns", *part, by=[])
    ends = F.coalesce("known", "turned")
    parts = parts.select(*part, F.coalesce(F.lag(ends).over(Window.orderBy(*part)), F.lit(False)).alias("begins"))
    lines = lines.join(F.broadcast(parts), part)  # one small row for each part of the file
    own = Window.partitionBy(*part).orderBy("id")
    lines = lines.withColumn("after", F.coalesce("known", F.col("turned") != F.col("begins")))
    lines = lines.withColumn("before", F.coalesce(F.lag("after").over(own), F.col("begins")))
    nothing = F.col("value").startswith("#") | (F.trim(F.regexp_replace("value", "\r", "")) == "")
    lines = lines.where(F.col("before") | ~nothing).withColumn("starts", (~F.col("before")).cast("long"))
    lines = lines.withColumn("n", F.sum("starts").over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    counts = lines.groupBy(*part).agg(F.sum("starts").alias("own"))
    ahead = F.coalesce(F.sum("own").over(Window.orderBy(*part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lines = lines.join(F.broadcast(counts.select(*part, ahead.alias("ahead"))), part).withColumn("record", F.col("ahead") + F.col("n"))
    whole = ~F.col("before") & ~F.col("after")
    alone = lines.where(whole).select("record", F.col("value").alias("text"))
    pieces = lines.where(~whole).groupBy("record").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "id", "value"))), lambda x: x["value"]), "\n").alias("text"))
    return alone.unionByName(pieces).withColumn("text", F.regexp_replace("text", "\r$", ""))


def header(lines: list) -> list[str] | None:
    """The fields of the first row among a file's first lines; none if it isn't there, or isn't whole."""
    text = ""
    for (line,) in lines:
        if not text and (line.startswith("#") or not line.strip("\r ")):
            continue
        text += line
        # As many quotes that open as close: the row is whole.
        if text.count('"') % 2 == 0:
            return next(csv.reader([text.rstrip("\r")]), None)
        text += "\n"
    return None


def rows(spark: SparkSession, path: str) -> DataFrame:
    """The columns that the first row names, as text, and ``row``, from 1. Missing fields are null, further ones are left out, names that repeat get their place added."""
    found = records(spark, path)
    # The first row stands among the first lines, unless a great deal of comment goes before it.
    names = header(spark.read.text(path, lineSep="\n").limit(HEAD).collect())
    if names is None:
        first = found.where("record = 1").first()
        if first is None:
            return spark.createDataFrame([], "row long")
        names = header([first])
    options = {"quote": '"', "escape": '"', "multiLine": "true"}
    names = [name if names.count(name) == 1 else f"{name}{k}" for k, name in enumerate(names)]
    quote = "`{}` string".format
    shape = ", ".join(quote(name.replace("`", "``")) for name in names)
    cells = F.from_csv("text", F.lit(shape), options)
    return found.where("record > 1").select((F.col("record") - 1).alias("row"), cells.alias("x")).select("row", "x.*")
