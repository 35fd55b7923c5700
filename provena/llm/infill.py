"""Fill-in-the-middle: texts are cut at two token borders and written as prefix, suffix, middle or as suffix, prefix, middle.

Tokens are runs of A-Z and a-z, or any other single code point. Cuts are asked for by token ordinal and found by joins. Matches are exploded
with their positions on two levels, so that few rows move: blocks of ``BLOCK`` tokens, each one match of a pattern, whose running lengths are a
window over the document; then, of those blocks that hold a cut, the tokens up to it, with running lengths of their own. A request joins its block
by ordinal, the offsets of a document's cuts are aggregated, and the text is taken apart by substring. All of it is DataFrame expressions.

Requests, blocks and offsets belong to two 64-bit hashes of doc_id and text. So equal rows share one set of offsets, and whole texts move once, in the
join with their offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provena.llm.common import only

#: Tokens in a block, and the pattern of a block. It is possessive, so no word is split between blocks.
BLOCK = 64
BLOCKS = rf"(?:[A-Za-z]++|[^A-Za-z]){{1,{BLOCK}}}"
UNIT = "[A-Za-z]+|[^A-Za-z]"
#: The marks before each part.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 documents, those that are cut, and of 100 cut ones those with the suffix first.
CUT, SUFFIX_FIRST = 90, 20
KEY = ["k1", "k2"]


def requests(docs: DataFrame) -> DataFrame:
    """(doc_id, text, k1, k2, n, form, first, second): each document's number of tokens, its form, and the tokens before its two cuts.

    Four numbers are the first 8-digit groups of the hex SHA-256 of ``1:`` and doc_id in decimal (null: nothing). The cuts are the first two
    modulo n + 1, the smaller one first; the third says whether a text is cut at all, the fourth which part leads. Empty texts and texts that hold a
    mark stay plain.
    """
    rows = only(docs, ("doc_id", "long"), ("text", "string")).withColumn("text", F.coalesce("text", F.lit("")))
    digits = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring(digits, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]
    marked = F.col("text").contains(PREFIX) | F.col("text").contains(SUFFIX) | F.col("text").contains(MIDDLE)
    plain = (F.col("text") == "") | marked | (h[2] % 100 >= CUT)
    n = F.length(F.regexp_replace("text", "[A-Za-z]+", "a")).cast("long")
    rows = rows.withColumn("n", n).withColumn("form", F.when(plain, "plain").when(h[3] % 100 < SUFFIX_FIRST, "spm").otherwise("psm"))
    a, b = h[0] % (F.col("n") + 1), h[1] % (F.col("n") + 1)
    keys = [F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64("text", "doc_id", F.lit(1)).alias("k2")]
    return rows.select("doc_id", "text", *keys, "n", "form", F.least(a, b).alias("first"), F.greatest(a, b).alias("second"))


def offsets(rows: DataFrame) -> DataFrame:
    """(k1, k2, cut, offset): code points before cut 0 and cut 1 of every text that is cut; a cut before the first token has no row."""
    cut = rows.where("form <> 'plain'").withColumn("blocks", F.regexp_extract_all("text", F.lit(BLOCKS), F.lit(0)))
    # The token before each cut, and the block that holds it.
    asked = [F.col(name) - 1 for name in ("first", "second")]
    wanted = F.array(*(F.struct(F.lit(k).alias("cut"), a.alias("last"), F.get("blocks", F.floor(a / BLOCK).cast("int")).alias("part")) for k, a in enumerate(asked)))
    own = cut.select(*KEY, F.transform("blocks", F.length).alias("sizes"), wanted.alias("wanted"))
    # Equal rows have equal sizes and wishes, of which one stays; all that follows is dealt by key already.
    own = own.groupBy(*KEY).agg(F.first("sizes").alias("sizes"), F.first("wanted").alias("wanted"))
    blocks = own.select(*KEY, F.posexplode("sizes").alias("block", "size"))
    blocks = blocks.withColumn("before", F.sum("size").over(_up_to(*KEY, order="block")) - F.col("size"))
    cuts = own.select(*KEY, F.explode("wanted").alias("w")).select(*KEY, "w.*").where("last >= 0")
    holds = (F.col("last") >= F.col("block") * BLOCK) & (F.col("last") < (F.col("block") + 1) * BLOCK)
    found = cuts.alias("c").join(blocks.alias("b"), [F.col(f"c.{k}") == F.col(f"b.{k}") for k in KEY] + [holds])
    found = found.select(*(f"c.{k}" for k in KEY), "cut", "before", "part", (F.col("last") - F.col("block") * BLOCK).alias("last"))
    units = found.select(*KEY, "cut", "before", "last", F.posexplode(F.regexp_extract_all("part", F.lit(UNIT), F.lit(0))).alias("unit", "word")).where("unit <= last")
    units = units.select(*KEY, "cut", "before", "last", "unit", F.length("word").alias("size"))
    ends = F.col("before") + F.sum("size").over(_up_to(*KEY, "cut", order="unit"))
    return units.withColumn("offset", ends).where("unit = last").select(*KEY, "cut", "offset")


def _up_to(*names: str, order: str):
    return Window.partitionBy(*names).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def joined(form: Column, prefix: Column, middle: Column, suffix: Column) -> Column:
    """The parts under their marks, in the order of the form."""
    p, s, m = (F.concat(F.lit(mark), part) for mark, part in ((PREFIX, prefix), (SUFFIX, suffix), (MIDDLE, middle)))
    return F.when(form == "psm", F.concat(p, s, m)).otherwise(F.concat(s, p, m))


def restored(form: Column, output: Column) -> Column:
    """The text again. No part holds a mark and marks can't overlap, so a cut text has exactly three."""
    parts = F.split(output, "<[PSM]>")
    first, second, third = (F.get(parts, F.lit(k)) for k in (1, 2, 3))
    return F.when(form == "plain", output).when(form == "psm", F.concat(first, third, second)).otherwise(F.concat(second, third, first))


def transformed(docs: DataFrame) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every row.

    Null texts are empty and stay plain; a null doc_id is hashed as nothing; repeated rows each have a row; an empty table gives none; other columns are
    ignored. prefix_chars and middle_chars are null for plain texts.
    """
    rows = requests(docs)
    ends = offsets(rows).groupBy(*KEY).agg(F.max(F.when(F.col("cut") == 0, F.col("offset"))).alias("begin"), F.max(F.when(F.col("cut") == 1, F.col("offset"))).alias("end"))
    out = rows.select("doc_id", "text", *KEY, "n", "form").join(ends, KEY, "left")
    begin, end = (F.when(F.col("form") != "plain", F.coalesce(F.col(name), F.lit(0))).cast("long") for name in ("begin", "end"))
    out = out.select("doc_id", "text", "n", "form", begin.alias("begin"), end.alias("end"))
    part = lambda a, size: F.substr("text", (a + 1).cast("int"), size.cast("int"))
    b, e = F.col("begin"), F.col("end")
    whole = joined(F.col("form"), part(F.lit(0), b), part(b, e - b), part(e, F.length("text") - e))
    output = F.when(F.col("form") == "plain", F.col("text")).otherwise(whole)
    return out.select("doc_id", "n", "form", b.alias("prefix_chars"), (e - b).alias("middle_chars"), output.alias("output"))


def digest(rows: DataFrame) -> DataFrame:
    back = restored(F.col("form"), F.col("output"))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))
