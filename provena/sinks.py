"""What goes out: JSON, text reports, the lookup index, CSV, extracts and snapshots.

Tables of any size are written in parallel, as a folder of files. Extracts and snapshots are single files with a header of their own: their rows are sorted and written by
ranges, which one task then puts together.
"""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provena.functions import wording
from provena.sources import files

#: Fixed value: where a line of a report ends.
WIDTH = 110


def json_rows(rows: DataFrame) -> DataFrame:
    """(json): each row as one object, without what is null."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("json"))


def json_lines(rows: DataFrame, path: str) -> None:
    json_rows(rows).write.mode("overwrite").text(path)


def shortened(text, width: int = WIDTH):
    """A text column cut to a width, with three dots where something is left out."""
    return F.when(F.length(text) > width, F.concat(F.substring(text, 1, width - 3), F.lit("..."))).otherwise(text)


def report(rows: DataFrame) -> DataFrame:
    """(model, stage, place, line): findings as text, a heading for each verdict of a stage and a line for each dataset under it."""
    if "samples" not in rows.columns:
        rows = rows.withColumn("samples", F.size("sample_ids"))
    reason = F.coalesce("reason", F.lit(""))
    keys = F.concat(F.lit(" [tried: "), F.array_join("keys_attempted", ", "), F.lit("]"))
    what = F.when(F.col("verdict") == "PRESENT", F.concat(F.lit(" — "), wording.evidence_text())).when(reason != "", F.concat(F.lit(" — "), reason)).otherwise("")
    line = shortened(F.concat(F.lit("  "), "dataset", F.when(F.size("keys_attempted") > 0, keys).otherwise(""), what))
    own = rows.select("model", "stage", F.struct("verdict", F.lit(1).alias("level"), "dataset").alias("place"), line.alias("line"))
    heads = rows.groupBy("model", "stage", "verdict").agg(F.count("*").alias("n"))
    text = F.concat("verdict", F.lit(": "), wording.counted(F.col("n")))
    heads = heads.select("model", "stage", F.struct("verdict", F.lit(0).alias("level"), F.lit("").alias("dataset")).alias("place"), text.alias("line"))
    return heads.union(own).orderBy("model", "stage", "place")


def severities(issues: DataFrame) -> DataFrame:
    """(errors, warnings): how many of each an integrity check has found."""
    return issues.agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))


def checked(documents: DataFrame, issues: DataFrame) -> DataFrame:
    """(kind, files, errors, warnings): for each kind of registry file how many were checked, and what was found in all entries of that kind."""
    kind = F.when(F.col("model").isNull() & F.col("dataset").isNotNull(), "datasets").otherwise("registry")
    found = issues.groupBy(kind.alias("kind")).agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    each = documents.where("kind in ('datasets', 'registry')").groupBy("kind").agg(F.count("*").alias("files")).join(found, "kind", "left")
    return each.select("kind", "files", *(F.coalesce(n, F.lit(0)).alias(n) for n in ("errors", "warnings")))


def index_rows(records: DataFrame, sources: DataFrame) -> DataFrame:
    """(model, stage, row): each record as a compact JSON list [source number, project, sample, cells, accessions, pmids, dois].

    The source number counts from 0 in the order of the corpus's files; -1 for another file.
    """
    numbers = F.broadcast(sources.select("model", "stage", "source", "ord"))  # as many rows as there are files, which the driver has listed
    rows = records.join(numbers, ["model", "stage", "source"], "left")
    parts = [F.coalesce("ord", F.lit(-1)), F.col("project"), F.col("sample"), F.col("cells"), F.col("accessions"), F.col("pmids"), F.col("dois")]
    one = lambda c: F.coalesce(F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", ""), F.lit("null"))
    text = F.concat(F.lit("["), F.concat_ws(",", *(F.when(p.isNull(), "null").otherwise(one(p)) for p in parts)), F.lit("]"))
    return rows.select("model", "stage", text.alias("row"))


def lookup_index(records: DataFrame, t: dict[str, DataFrame], failed: dict[tuple, str], path: str) -> None:
    """What answering needs elsewhere: ``rows`` in folders by model and stage, and ``corpora``, ``catalog`` and ``recorded`` as JSON lines."""
    spark = records.sparkSession
    index_rows(records, t["sources"]).write.mode("overwrite").partitionBy("model", "stage").text(f"{path}/rows")
    why = spark.createDataFrame([(*corpus, text) for corpus, text in failed.items()], "model string, stage string, unavailable string")
    corpora = t["corpora"].drop("quote", "caveats", "corpus_ord").join(why, ["model", "stage"], "left").withColumn("checkable", ~F.col("type").isin("C-vague", "D", "by-design"))
    json_lines(corpora.withColumn("indexed", F.col("checkable") & F.col("unavailable").isNull()).orderBy("model", "stage"), f"{path}/corpora")
    provisional = F.col("confirmed") == "provisional"
    entry = F.when(provisional, F.array("type", "value", "confirmed", F.coalesce("basis", F.lit("")))).otherwise(F.array("type", "value"))
    known = t["identifiers"].where("confirmed in ('true', 'provisional')").groupBy("dataset").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", entry.alias("e")))), lambda x: x["e"]).alias("identifiers"))
    json_lines(t["datasets"].select("dataset", "name").join(known, "dataset", "left").orderBy("dataset"), f"{path}/catalog")
    json_lines(t["recorded"].orderBy("dataset", "model", "stage"), f"{path}/recorded")


def csv_line(columns: list[str]) -> Column:
    """Columns as comma-separated text; a field that holds a quote, a comma or a line break stands in quotes, null is empty."""
    def field(name: str) -> Column:
        text = F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))
        return F.when(text.rlike('[",\n\r]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)

    return F.concat_ws(",", *map(field, columns))


def csv_rows(rows: DataFrame) -> DataFrame:
    """(line): each row as comma-separated text."""
    return rows.select(csv_line(rows.columns).alias("line"))


def extract(rows: DataFrame, columns: list[str], path: str | Path, parent_sha256: str, said: list[str] | None = None) -> int:
    """Chosen columns of a list's rows, in order of ``row``, under comment lines that name the publisher's file; returns the number of rows."""
    head = [f"# {line}" for line in [*(said or []), f"derived-from-sha256: {parent_sha256}"]]
    return _one_file(rows, "row", columns, path, head)


def snapshot(rows: DataFrame, columns: list[str], path: str | Path, total_of: str, published: int, said: list[str] | None = None, check: Callable[[int, int], None] | None = None) -> int:
    """Some columns of a released table, ordered by the first, empty where null; raises if its total differs from the published one."""
    total = int(rows.agg(F.sum(F.col(total_of).cast("long"))).first()[0] or 0)
    if check:
        check(total, published)
    elif total != published:
        raise ValueError(f"{total_of} adds up to {total}, and {published} is published")
    return _one_file(rows.withColumn("order_", F.coalesce(F.col(columns[0]).cast("string"), F.lit(""))), "order_", columns, path, [f"# {line}" for line in said or []])


def _one_file(rows: DataFrame, order: str, columns: list[str], path: str | Path, head: list[str]) -> int:
    lines = rows.select(F.col(order).alias("order_"), csv_line(columns).alias("line"))
    files.joined(lines, ["order_"], str(path), [*head, _header(columns)])
    return rows.count()


def _header(columns: list[str]) -> str:
    quoted = ('"' + c.replace('"', '""') + '"' if any(x in c for x in '",\n\r') else c for c in columns)
    return ",".join(quoted)
