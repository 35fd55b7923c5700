"""Which file of an earlier state a file comes from: by name, else by content, else by likeness.

Likeness is the share of bytes in lines that both files have, of the larger file. Pairs of files are compared only if they share one of the new file's rarest lines: those lines
of it, from the rarest on, that hold more bytes than may differ. Two files that are alike enough share at least one of them, so no pair is missed, and lines that stand
everywhere bring no pairs together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provena.shared import written

#: Percent of the larger file's bytes that must be shared.
ALIKE = 50


def _lines(files: DataFrame) -> DataFrame:
    """(file, line, times, bytes, size): a file's different lines, how often it has each and the bytes of all of these, and the bytes of the whole file."""
    each = files.select("file", F.explode(F.split("text", "\n")).alias("line"))
    each = each.groupBy("file", "line").agg(F.count("*").alias("times")).withColumn("bytes", F.col("times") * (F.octet_length("line") + 1))
    return each.withColumn("size", F.sum("bytes").over(Window.partitionBy("file")))


def alike(now: DataFrame, before: DataFrame, percent: int = ALIKE) -> DataFrame:
    """(file, before, shared, size): pairs of files (file, text) that share at least so many percent of the larger one's bytes."""
    new, old = written(_lines(now), "lines"), written(_lines(before), "lines")
    common = old.groupBy("line").agg(F.count("*").alias("files"))
    rare = Window.partitionBy("file").orderBy(F.col("files"), "line").rowsBetween(Window.unboundedPreceding, -1)
    # A line's place among the file's lines by rarity; lines that no old file has bring no pairs, but their bytes are what may differ.
    ranked = new.join(common, "line", "left").withColumn("files", F.coalesce("files", F.lit(0)))
    ranked = ranked.withColumn("ahead", F.coalesce(F.sum("bytes").over(rare), F.lit(0)))
    leading = ranked.where((100 * F.col("ahead") <= (100 - percent) * F.col("size")) & (F.col("files") > 0)).select("file", "line")
    pairs = leading.join(old.select(F.col("file").alias("before"), "line"), "line").select("file", "before").distinct()
    mine = new.select("file", "line", F.col("times").alias("n"), F.col("size").alias("a"))
    theirs = old.select(F.col("file").alias("before"), "line", F.col("times").alias("m"), F.col("size").alias("b"))
    width = F.octet_length("line") + 1
    both = pairs.join(mine, "file").join(theirs, ["before", "line"])
    shared = both.groupBy("file", "before").agg(F.sum(F.least("n", "m") * width).alias("shared"), F.max(F.greatest("a", "b")).alias("size"))
    return shared.where(100 * F.col("shared") >= percent * F.col("size"))


def _best(pairs: DataFrame, by: str, *order: Column) -> Column:
    return F.row_number().over(Window.partitionBy(by).orderBy(*order)) == 1


def renamed(now: DataFrame, before: DataFrame, percent: int = ALIKE) -> DataFrame:
    """(file, before): each file (file, text) with the earlier file that it comes from, or null if it is new. No earlier file is named twice.

    Files with an earlier file of their name come from it. Of the others, files of equal text go together, in order of their names, and then those most alike: in rounds, each pair that is the best
    of both its files.
    """
    same = now.join(before.select("file"), "file", "left_semi").select("file", F.col("file").alias("before"))
    new, old = now.join(before.select("file"), "file", "left_anti"), before.join(now.select("file"), "file", "left_anti")
    placed = lambda rows: rows.select("file", "text", F.row_number().over(Window.partitionBy("text").orderBy("file")).alias("n"))
    equal = written(placed(new).join(placed(old).withColumnRenamed("file", "before"), ["text", "n"]).select("file", "before"), "renamed")
    out = same.unionByName(equal)
    pairs = written(alike(new.join(equal, "file", "left_anti"), old.join(equal.select(F.col("before").alias("file")), "file", "left_anti"), percent), "alike")
    score = F.col("shared") / F.col("size")
    while pairs.limit(1).count():
        ranked = pairs.withColumn("own", _best(pairs, "file", score.desc(), F.col("before"))).withColumn("other", _best(pairs, "before", score.desc(), F.col("file")))
        chosen = written(ranked.where("own and other").select("file", "before"), "renamed")
        out = out.unionByName(chosen)
        pairs = written(pairs.join(chosen.select("file"), "file", "left_anti").join(chosen.select("before"), "before", "left_anti"), "alike")
    return now.select("file").join(out, "file", "left")
