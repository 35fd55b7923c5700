"""The crosswalk cache: what an accession, a PMID or a DOI is known to be linked with.

Only the cache is read. A miss is an answer of its own; live requests are out of this engine's scope.
"""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provena.functions import identifiers as ids
from provena.sources import files

SCHEMA = "query string, accessions array<string>, pmids array<string>, doi string, pmcid string, title string, organism string, samples array<array<string>>, retrieved string, sources array<string>"


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(kind, query, accessions, pmids, doi, ..., samples as structs) from folder/kind/name.json files."""
    rows = spark.read.schema(SCHEMA).option("multiLine", True).json(f"{folder}/*/*.json").withColumn("path", F.input_file_name())
    kind = F.element_at(F.split("path", "/"), -2)
    samples = F.transform("samples", lambda s: F.struct(F.element_at(s, 1).alias("accession"), F.element_at(s, 2).alias("title")))
    return rows.withColumn("kind", kind).withColumn("samples", samples).drop("path")


def store(records: DataFrame, folder: str) -> None:
    """Store records (kind, query, and any of ``SCHEMA``'s other columns; samples as accession and title), a file each, written by tasks. Of records with one kind and query one stays."""
    name = F.concat("kind", F.lit("/"), F.when(F.col("kind") == "doi", ids.encode_doi(F.col("query"))).otherwise(F.col("query")), F.lit(".json"))
    pair = lambda s: F.array(s["accession"], s["title"])
    given = [F.transform(c, pair).alias(c) if c == "samples" else F.col(c) for c in (part.split()[0] for part in SCHEMA.split(", ")) if c in records.columns]
    files.write(records.dropDuplicates(["kind", "query"]).select(name.alias("name"), F.to_json(F.struct(*given)).alias("body")), folder)


def write(folder: str | Path, kind: str, record: dict) -> Path:
    """Store one record under its encoded query."""
    name = record["query"].strip().lower().replace("_", "~5f").replace("/", "_") if kind == "doi" else record["query"]
    path = Path(folder) / kind / f"{name}.json"
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(record, indent=2, sort_keys=True) + "\n", encoding="utf-8")
    return path


def resolve(inputs: DataFrame, cache: DataFrame) -> DataFrame:
    """(input, kind, value, hit, accessions, pmids, doi, ...) for identifiers in the column ``input``."""
    c = ids.classify(F.col("input"))
    rows = inputs.withColumn("kind", c["kind"]).withColumn("value", c["value"])
    known = cache.withColumn("value", F.when(F.col("kind") == "doi", F.lower("query")).otherwise(F.col("query"))).withColumn("hit", F.lit(True))
    return rows.join(known, ["kind", "value"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def expanded(tokens: DataFrame, cache: DataFrame) -> DataFrame:
    """(query_id, token, accessions, pmids, dois, linked, note): what each typed token adds to its query.

    A series adds its accessions, PMIDs and DOI; a sample or E- accession only PMIDs and DOI, so a sample is never
    widened to its series; a PMID or DOI adds PMIDs and DOI, and links to its series. A miss adds a note.
    Tokens are (query_id, token, key).
    """
    none = F.array().cast("array<string>")
    rows = resolve(tokens.where(ids.expandable(F.col("token"))).withColumn("input", F.col("token")), cache)
    series = F.filter("accessions", lambda a: F.upper(a).startswith("GSE"))
    return rows.select(
        "query_id", "token",
        F.when(F.upper("token").startswith("GSE") & F.col("hit"), F.col("accessions")).otherwise(none).alias("accessions"),
        F.coalesce("pmids", none).alias("pmids"), F.when(F.col("doi").isNotNull(), F.array(ids.doi(F.col("doi")))).otherwise(none).alias("dois"),
        F.when(F.col("key").isin("pmid", "doi") & F.col("hit"), series).otherwise(none).alias("linked"),
        F.when(~F.col("hit"), F.concat(F.col("token"), F.lit(" is not in the crosswalk, so only what was typed is searched"))).alias("note"),
    )
