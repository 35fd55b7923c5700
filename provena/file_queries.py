"""Queries for files, sinks, stored replies, display text and page tables, with their SQL.

Files are written into the shared folder from the benchmark tables and read back by the engine's own sources.
"""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pandas as pd
import yaml
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provena import sinks
from provena import synthetic as syn
from provena.catalog_queries import flat, query, read
from provena.functions import identifiers as ids
from provena.functions import wording
from provena.operators import chains, keys, lookup, views
from provena.plans import ledger as ledgers
from provena.plans import lookup as lookups
from provena.shared import new_path, shuffle_parts, written
from provena.sources import catalog, crosswalk, files, lists, replies, requests

def pk() -> Column:
    return F.col("p_partkey")


def sk() -> Column:
    return F.col("s_suppkey")


def text(*parts: str | Column) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part")


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "supplier")


# Files in -----------------------------------------------------------------------------------------------------------------


@query("csv_scan", "SELECT row_number() OVER (ORDER BY o_orderkey) AS row_number, 'GSE' || o_orderkey || CASE WHEN o_orderkey % 3 = 0 THEN ', \"x\"' ELSE '' END AS id, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderpriority END AS note FROM orders")
def csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as a line of a list with comments, empty cells, commas and quotes, read back with consecutive row numbers."""
    path, k = new_path(spark, "csv") + "/list.csv", F.col("o_orderkey")
    rows = read(spark, sf_dir, "orders").select(k, text("GSE", k, F.when(k % 3 == 0, ', "x"').otherwise("")).alias("id"), F.when(k % 4 != 0, F.col("o_orderpriority")).alias("note"))
    lines = rows.select(k, F.concat(F.when(k % 50 == 0, F.lit("# a page ends here\n")).otherwise(""), sinks.csv_line(["id", "note"])).alias("line"))
    files.joined(lines, ["o_orderkey"], path, ["# a list", "id,note"])
    return lists.read_list(spark, path).withColumnRenamed("row", "row_number")


@query("csv_quoted", """SELECT row_number() OVER (ORDER BY k, n, note) AS row_number, 'GSM' || k || '-' || n AS id, note FROM (SELECT l_orderkey AS k, l_linenumber AS n,
    CASE WHEN l_linenumber % 3 = 0 THEN CAST(CAST(l_shipdate AS DATE) AS VARCHAR) || chr(10) || '"' || l_returnflag || '",' || chr(10) || chr(10) || '# ' || l_linestatus ELSE l_returnflag || ' by rail' END AS note FROM lineitem)""")
def csv_quoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line item as a row of one list, in which every third has a note over four lines, read back in parallel parts."""
    path = new_path(spark, "quoted") + "/list.csv"
    note = F.when(F.col("l_linenumber") % 3 == 0, text(F.col("l_shipdate").cast("date"), '\n"', F.col("l_returnflag"), '",\n\n# ', F.col("l_linestatus"))).otherwise(text(F.col("l_returnflag"), " by rail"))
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", text("GSM", F.col("l_orderkey"), "-", F.col("l_linenumber")).alias("id"), note.alias("note"))
    files.joined(rows.select("l_orderkey", "l_linenumber", "note", sinks.csv_line(["id", "note"]).alias("line")), ["l_orderkey", "l_linenumber", "note"], path, ["# a list with notes", "id,note"])
    return lists.read_list(spark, path).withColumnRenamed("row", "row_number")


MAIN, REL = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def workbook(frame: pd.DataFrame) -> bytes:
    """A workbook of (name, size) rows, with an empty row after each."""
    cell = lambda ref, v: f'<c r="{ref}" t="inlineStr"><is><t>{escape(v)}</t></is></c>'
    rows = "".join(f'<row>{cell(f"A{n}", name)}<c r="B{n}"><v>{size}.0</v></c></row><row></row>' for n, (name, size) in enumerate(zip(frame["p_name"], frame["p_size"], strict=True), start=2))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{REL}"><sheets><sheet name="one" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>')
        z.writestr("xl/worksheets/s.xml", f'<worksheet xmlns="{MAIN}"><sheetData><row>{cell("A1", " name")}{cell("B1", "size ")}</row>{rows}</sheetData></worksheet>')
    return out.getvalue()


@query("xlsx_scan", "SELECT p_brand AS brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS row_number, p_name AS name, CAST(p_size AS VARCHAR) || '.0' AS size FROM part")
def xlsx_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A workbook for each brand, written by tasks and read back a task each."""
    path = new_path(spark, "xlsx")

    def book(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"name": [f"{key[0]}.xlsx"], "body": [workbook(frame.sort_values("p_partkey"))]})

    files.write(parts(spark, sf_dir).groupBy("p_brand").applyInPandas(book, "name string, body binary"), path)
    return lists.workbooks(spark, path).select(F.regexp_replace("file", r"\.xlsx$", "").alias("brand"), F.col("row").alias("row_number"), "name", "size")


def dumped(doc: dict) -> str:
    return yaml.dump(doc, Dumper=getattr(yaml, "CSafeDumper", yaml.SafeDumper))


def entry_files(k: int) -> Iterator[tuple[str, str]]:
    """The YAML files of a supplier: its dataset, some twice, and its model."""
    known = [{"type": "geo", "value": f"GSE{k}", "confirmed": "provisional" if k % 3 == 0 else k % 3 == 1, **({"basis": "its title"} if k % 3 == 0 else {})}, {"type": "pmid", "value": k + 1, "confirmed": True}]
    one = {"schema_version": 1, "id": f"d{k}", "name": f"Set {k}", "kind": views.KINDS[k % 4], "identifiers": known}
    for n, doc in enumerate([one] + [one | {"name": f"Later set {k}"}] * (k % 10 == 3)):
        yield f"datasets/d{k}-{n}.yaml", dumped(doc)
    finding = {"dataset": f"d{k}", "verdict": "PRESENT", "keys_attempted": ["accession"], "matched_on": ["accession"], "match_level": "dataset", "overlap_level": "study", "samples": k % 4, "cells": 1000 * k} if k % 2 else {"dataset": f"d{k}", "verdict": "NOT CHECKABLE"}
    corpus = {"stage": "training", "manifest": {"type": "A" if k % 2 else "D", "quote": "q", "as_of": "2026-01-31"}, "result": {"checked": "2026-02-01", "sources_searched": ["s"], "findings": [finding], "caveats": ["c"] * (k % 3)}}
    review = {"review": {"by": "QR" if k % 4 else " ", "date": "2026-02-02", "checked": ["paper"]}} if k % 5 else {"provenance": {"verified_by": "QR" if k % 4 else "", "verified_date": "2025-05-05"}}
    judged = sorted({f"d{k}", f"d{k // 2 + 1}"})
    doc = {"schema_version": 3, "id": f"m{k}", "model": f"Model {k}", "model_class": "task-specific" if k % 7 == 0 else "foundation", "paper": {}, "discovery": {"methods": {"checked": k % 6 != 0}}, "evaluated_on": [{"dataset": d} for d in judged], "corpora": [corpus], **review}
    yield f"registry/m{k}.yaml", dumped(doc)


def registry(spark: SparkSession, sf_dir: str) -> str:
    """A registry folder with a dataset and a model for each supplier, written by tasks; some datasets come twice, some documents are malformed."""

    def docs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([x for k in frame["s_suppkey"].tolist() for x in entry_files(k)], columns=["name", "body"])

    # The table is small and the documents are not, so suppliers are dealt out first.
    rows = suppliers(spark, sf_dir).select("s_suppkey").repartition(4 * shuffle_parts(spark), "s_suppkey").mapInPandas(docs, "name string, body string")
    more = [("registry/broken.yaml", "- only\n- a list\n"), ("reviewers.yaml", "reviewers:\n- initials: QR\n")]
    root = new_path(spark, "registry")
    files.write(rows.union(spark.createDataFrame(more, "name string, body string")), root)
    return root


@query("yaml_catalog", """SELECT 'd' || s_suppkey AS dataset, CASE WHEN s_suppkey % 10 = 3 THEN 'Later set ' ELSE 'Set ' END || s_suppkey AS name, 'GSE' || s_suppkey AS geo, CASE s_suppkey % 3 WHEN 0 THEN 'provisional' WHEN 1 THEN 'true' ELSE 'false' END AS confirmed, CAST(s_suppkey + 1 AS VARCHAR) AS pmid FROM supplier""")
def yaml_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog entries from YAML: of equal ids the last, three states of confirmed, values as text."""
    t = catalog.load(spark, registry(spark, sf_dir))
    of = lambda kind, name: t["identifiers"].where(F.col("type") == kind).select("dataset", F.col("value").alias(name), *(["confirmed"] if kind == "geo" else []))
    return t["datasets"].select("dataset", "name").join(of("geo", "geo"), "dataset").join(of("pmid", "pmid"), "dataset")


@query("yaml_registry", """SELECT 'm' || s_suppkey AS model, s_suppkey % 4 = 0 AS draft, CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE 'QR' END AS reviewed_by, CASE WHEN s_suppkey % 5 <> 0 THEN '2026-02-02' ELSE '2025-05-05' END AS reviewed_date, CASE WHEN s_suppkey % 2 = 1 THEN 'A' ELSE 'D' END AS type, '2026-01-31' AS as_of, s_suppkey % 4 <> 0 AS listed FROM supplier""")
def yaml_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry entries from YAML: reviews of two shapes, drafts, dates as text, and whether the reviewer is listed."""
    t = catalog.load(spark, registry(spark, sf_dir))
    known = t["reviewers"].select(F.col("initials").alias("reviewed_by"), F.lit(True).alias("known")).distinct()
    rows = t["models"].join(t["corpora"].select("model", "type", "as_of"), "model").join(known, "reviewed_by", "left")
    return rows.select("model", "draft", "reviewed_by", "reviewed_date", "type", "as_of", F.coalesce("known", F.lit(False)).alias("listed"))


@query("source_hash", "SELECT 's' || s_suppkey || '.txt' AS name, sha256('list ' || s_suppkey || chr(10)) AS sha256 FROM supplier")
def source_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each supplier, written and hashed by tasks."""
    path = new_path(spark, "hashed")
    files.write(suppliers(spark, sf_dir).select(text("s", sk(), ".txt").alias("name"), text("list ", sk(), "\n").alias("body")), path)
    return files.facts(files.listed(spark, path, "*.txt")).select(F.element_at(F.split("path", "/"), -1).alias("name"), "sha256")


@query("located_sources", "SELECT s_suppkey AS k, CASE s_suppkey % 6 WHEN 0 THEN 'snapshot' WHEN 2 THEN 'folder' WHEN 3 THEN 'extract' ELSE 'error' END AS found FROM supplier")
def located_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each source is found: its snapshot, the publisher's folder, its extract, or nowhere, as a hash or a named parent differs."""
    root, other, way = new_path(spark, "root"), new_path(spark, "publisher"), sk() % 6
    body = text("id\nGSE", sk(), "\n")
    rows = suppliers(spark, sf_dir).select(
        sk().alias("k"), way.alias("way"), body.alias("body"), F.sha2(body, 256).alias("sha256"), text("s", sk()).alias("source"), text("https://h.example/a%20", sk(), ".csv?v=1").alias("url"),
        F.when(way < 2, text("s", sk(), ".csv")).alias("snapshot"), F.when(way.isin(3, 4), text("x", sk(), ".csv")).alias("extract"),
    )
    named = F.when(F.col("way") == 3, F.col("sha256")).otherwise("b" * 64)
    files.write(rows.where("way < 2").select(F.col("snapshot").alias("name"), F.when(F.col("way") == 0, F.col("body")).otherwise("other").alias("body")).union(
        rows.where("way in (3, 4)").select("extract", text("# from it\n# derived-from-sha256: ", named, "\n", F.col("body")))), root)
    files.write(rows.where("way in (2, 3, 4)").select(text("a ", F.col("k"), ".csv").alias("name"), F.when(F.col("way") == 2, F.col("body")).otherwise("other").alias("body")), other)
    return lists.located(rows, root, other).select("k", F.coalesce("how", F.lit("error")).alias("found"))


@query("crosswalk_cache", "SELECT 'doi' AS kind, '10.1000/a_' || s_suppkey AS query, 'GSE' || s_suppkey AS accessions, s_suppkey % 2 = 0 AS hit FROM supplier")
def crosswalk_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOIs looked up in a cache folder that knows every second one; its records are written by tasks, a file each."""
    path = new_path(spark, "cache")
    rows = suppliers(spark, sf_dir).select(sk(), text("10.1000/a_", sk()).alias("doi"))
    sample = F.array(F.struct(F.lit("GSM1").alias("accession"), F.lit("t").alias("title")))
    crosswalk.store(rows.where("s_suppkey % 2 = 0").select(F.lit("doi").alias("kind"), F.col("doi").alias("query"), F.array(text("GSE", sk())).alias("accessions"), F.array().cast("array<string>").alias("pmids"), "doi", sample.alias("samples")), path)
    found = crosswalk.resolve(rows.select(sk(), F.upper("doi").alias("input")), crosswalk.read(spark, path))
    return found.select("kind", F.col("value").alias("query"), text("GSE", sk()).alias("accessions"), F.col("hit") & (F.coalesce(flat("accessions"), F.lit("")) == text("GSE", sk())) & (F.size("samples") == 1)).toDF("kind", "query", "accessions", "hit").withColumn("hit", F.coalesce("hit", F.lit(False)))


def index_page(address: str) -> bytes:
    """A transport that answers searches for even numbers and knows no others."""
    number = int(address.rpartition("=")[2])
    if number % 2:
        raise requests.Refused(404)
    return json.dumps({"esearchresult": {"idlist": [str(number // 2)]}}).encode()


def at_once(seconds: float) -> None:
    """No waiting: the transport is no server."""


@query("requests_asked", "SELECT 'https://index.example/search?term=' || s_suppkey AS address, CASE WHEN s_suppkey % 2 = 0 THEN 200 ELSE 404 END AS status, CASE WHEN s_suppkey % 2 = 0 THEN CAST(s_suppkey // 2 AS VARCHAR) END AS found FROM supplier")
def requests_asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search for each supplier, asked by tasks and stored; every address comes twice and is asked once."""
    rows = suppliers(spark, sf_dir).select(text("https://index.example/search?term=", sk()).alias("address"))
    got = written(requests.asked(rows.union(rows), index_page, lanes=4, sleep=at_once), "replies")
    return got.select("address", "status", F.get_json_object("body", "$.esearchresult.idlist[0]").alias("found"))


# Stored replies -----------------------------------------------------------------------------------------------------------


def stored(spark: SparkSession, sf_dir: str) -> chains.Replies:
    """Replies about a series, a sample, a paper, a DOI and an array study for each part; papers of every fifth part are linked with nothing."""
    p = parts(spark, sf_dir)
    samples = F.transform(F.array(pk(), pk() * 0), lambda k: F.struct(text("GSM", k).alias("accession"), F.when(k == 0, "zero").otherwise(F.col("p_name")).alias("title")))
    sra = F.transform(F.array(F.lit("BioProject"), F.lit("SRA")), lambda t: F.struct(t.alias("relationtype"), F.when(t == "SRA", text("SRP", pk())).otherwise("no").alias("targetobject")))
    series = F.struct(
        F.lit("GSE").alias("entrytype"), text("GSE", pk()).alias("accession"), F.col("p_name").alias("title"), F.col("p_type").alias("taxon"), F.array(text(pk()), text(pk() + 1)).alias("pubmedids"), samples.alias("samples"), text("PRJNA", pk()).alias("bioproject"), sra.alias("extrelations"),
    )
    own = F.struct(
        F.lit("GSM").alias("entrytype"), text("GSM", pk()).alias("accession"), F.lit("a sample").alias("title"), F.col("p_type").alias("taxon"), F.when(pk() % 4 == 0, F.array(text(pk() + 7))).otherwise(F.array().cast("array<string>")).alias("pubmedids"),
        F.array().cast("array<struct<accession:string,title:string>>").alias("samples"), F.lit("").alias("bioproject"), F.array().cast("array<struct<relationtype:string,targetobject:string>>").alias("extrelations"),
    )
    both = F.concat(F.lit('{"result":{"uids":["1","2"],"1":'), F.to_json(own), F.lit(',"2":'), F.to_json(series), F.lit("}}"))
    gds = p.withColumn("body", both).select(F.explode(F.array(text("GSE", pk()), text("GSM", pk()), text(pk()))).alias("key"), "body")
    named = F.transform(F.array(F.lit("pubmed"), F.lit("doi")), lambda t: F.struct(t.alias("idtype"), F.when(t == "doi", text("10.1000/p", pk())).otherwise(text(pk())).alias("value")))
    article = F.struct(text("About ", F.col("p_name")).alias("title"), named.alias("articleids"))
    summary = F.concat(F.lit('{"result":{"uids":["'), text(pk()), F.lit('"],"'), text(pk()), F.lit('":'), F.to_json(article), F.lit("}}"))
    pubmed = p.select(text(pk()).alias("key"), summary.alias("body"))
    links = p.select(text(pk()).alias("pmid"), F.when(pk() % 5 == 0, '{"linksets":[]}').otherwise('{"linksets":[{"linksetdbs":[{"links":["1","2"]}]}]}').alias("body"))
    searches = p.select(F.lit("pubmed").alias("db"), text('"10.1000/p', pk(), '"[DOI]').alias("term"), F.when(pk() % 6 == 0, '{"esearchresult":{"idlist":[]}}').otherwise(text('{"esearchresult":{"idlist":["', pk(), '","1"]}}')).alias("body"))
    study = text('{"section":{"attributes":[{"name":"Title","value":"Study ', pk(), '"}],"subsections":[{"type":"Author"},{"type":"Publication","accno":"', pk(), '","attributes":[{"name":"DOI","value":"10.1000/p', pk(), '"}]}]}}')
    studies = p.select(text("E-MTAB-", pk()).alias("accession"), study.alias("body"))
    # A paper without links has no entries to be asked for.
    gds = gds.where(~F.col("key").rlike(r"^\d+$") | (F.col("key").try_cast("long") % 5 != 0))
    return chains.Replies(searches, gds, pubmed, links, studies)


@query("reply_gds", "SELECT key, uid, CASE uid WHEN '1' THEN 'GSM' ELSE 'GSE' END AS entrytype, CASE uid WHEN '1' THEN '' ELSE 'GSM0,GSM' || p_partkey END AS samples, CASE uid WHEN '2' THEN 'SRP' || p_partkey END AS sra FROM (SELECT p_partkey, unnest(['GSE' || p_partkey, 'GSM' || p_partkey]) AS key FROM part) CROSS JOIN (VALUES ('1'), ('2')) u(uid)")
def reply_gds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = replies.gds(replies.summaries(stored(spark, sf_dir).gds.where("key like 'GS%'"), "key"), "key")
    return rows.select("key", "uid", "entrytype", F.array_join("samples.accession", ",").alias("samples"), "sra")


@query("reply_pubmed", "SELECT CAST(p_partkey AS VARCHAR) AS pmid, 'About ' || p_name AS title, '10.1000/p' || p_partkey AS doi FROM part")
def reply_pubmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replies.pubmed(replies.summaries(stored(spark, sf_dir).pubmed)).select("pmid", "title", "doi")


PAPER_DOI = "CASE WHEN {0} <= (SELECT max(p_partkey) FROM part) THEN '10.1000/p' || ({0}) END"


@query(
    "chain_geo",
    f"""SELECT 'GSE' || p_partkey AS query, 'GSE' || p_partkey || ',PRJNA' || p_partkey || ',SRP' || p_partkey AS accessions, p_partkey || ',' || (p_partkey + 1) AS pmids, '10.1000/p' || p_partkey AS doi, p_name AS title, 'GSM0,GSM' || p_partkey AS samples FROM part
    UNION ALL SELECT 'GSM' || p_partkey, 'GSM' || p_partkey, CASE WHEN p_partkey % 4 = 0 THEN CAST(p_partkey + 7 AS VARCHAR) ELSE p_partkey || ',' || (p_partkey + 1) END, CASE WHEN p_partkey % 4 = 0 THEN {PAPER_DOI.format('p_partkey + 7')} ELSE '10.1000/p' || p_partkey END, 'a sample', CASE WHEN p_partkey % 4 = 0 THEN '' ELSE 'GSM0,GSM' || p_partkey END FROM part""",
)
def chain_geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = parts(spark, sf_dir).select(F.explode(F.array(text("GSE", pk()), text("GSM", pk()))).alias("query"))
    rows = chains.geo(asked, stored(spark, sf_dir))
    return rows.select("query", F.array_join("accessions", ",").alias("accessions"), F.array_join("pmids", ",").alias("pmids"), "doi", "title", F.array_join("samples.accession", ",").alias("samples"))


PAPER = "CASE WHEN p_partkey % 5 = 0 THEN '' ELSE 'GSE' || p_partkey || ',PRJNA' || p_partkey || ',SRP' || p_partkey END AS accessions, CAST(p_partkey AS VARCHAR) AS pmids, '10.1000/p' || p_partkey AS doi, 'About ' || p_name AS title, CASE WHEN p_partkey % 5 <> 0 THEN p_type END AS organism"


@query("chain_pmid", f"SELECT CAST(p_partkey AS VARCHAR) AS query, {PAPER}, CASE WHEN p_partkey % 5 = 0 THEN 2 ELSE 3 END AS sources FROM part")
def chain_pmid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chains.papers(parts(spark, sf_dir).select(text(pk()).alias("query")), stored(spark, sf_dir))
    return rows.select("query", F.array_join("accessions", ",").alias("accessions"), F.array_join("pmids", ",").alias("pmids"), "doi", "title", "organism", F.size("sources").alias("sources"))


@query("chain_doi", f"SELECT '10.1000/p' || p_partkey AS query, {PAPER}, CASE WHEN p_partkey % 5 = 0 THEN 3 ELSE 4 END AS sources FROM part WHERE p_partkey % 6 <> 0")
def chain_doi(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chains.dois(parts(spark, sf_dir).select(text("10.1000/p", pk()).alias("query")), stored(spark, sf_dir))
    return rows.select("query", F.array_join("accessions", ",").alias("accessions"), F.array_join("pmids", ",").alias("pmids"), "doi", "title", "organism", F.size("sources").alias("sources"))


@query("chain_arrayexpress", "SELECT 'E-MTAB-' || p_partkey AS query, CAST(p_partkey AS VARCHAR) AS pmids, '10.1000/p' || p_partkey AS doi, 'Study ' || p_partkey AS title FROM part")
def chain_arrayexpress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chains.arrays(parts(spark, sf_dir).select(text("E-MTAB-", pk()).alias("query")), stored(spark, sf_dir)).select("query", F.array_join("pmids", ",").alias("pmids"), "doi", "title")


@query("chain_resolve", "SELECT CASE p_partkey % 4 WHEN 0 THEN 'gse' || p_partkey WHEN 1 THEN CAST(p_partkey AS VARCHAR) WHEN 2 THEN '10.1000/P' || p_partkey ELSE 'what ' || p_partkey END AS input, CASE p_partkey % 4 WHEN 0 THEN 'geo' WHEN 1 THEN 'pubmed' WHEN 2 THEN 'doi' END AS kind, CASE WHEN p_partkey % 4 = 1 AND p_partkey % 3 = 0 THEN 'cache' WHEN p_partkey % 4 = 3 OR p_partkey % 4 = 2 AND p_partkey % 6 = 0 THEN NULL ELSE 'replies' END AS hit FROM part")
def chain_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers of all kinds: from the cache, else through their chain, else with a note."""
    p = parts(spark, sf_dir)
    asked = p.select(F.when(pk() % 4 == 0, text("gse", pk())).when(pk() % 4 == 1, text(pk())).when(pk() % 4 == 2, text("10.1000/P", pk())).otherwise(text("what ", pk())).alias("input"))
    cache = p.where("p_partkey % 3 = 0").select(F.lit("pubmed").alias("kind"), text(pk()).alias("query"), F.array(F.lit("GSE1")).alias("accessions"), F.array(text(pk())).alias("pmids"), F.lit(None).cast("string").alias("doi"))
    rows = chains.resolved(asked, cache, stored(spark, sf_dir))
    return rows.where(F.col("hit").isNotNull() == F.col("note").isNull()).select("input", "kind", "hit")


@query("chain_citation", "SELECT p_partkey AS k, 'nat-methods_2021_' || p_size || '_' || p_partkey || '_wu' AS key, CASE WHEN p_partkey % 3 = 1 THEN CAST(p_partkey AS VARCHAR) END AS pmid, p_partkey % 3 <> 0 AS known FROM part")
def chain_citation(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = parts(spark, sf_dir)
    line = text("Wu, X. et al. A map of ", F.col("p_name"), ". Nat. Methods ", F.col("p_size"), ", ", pk(), "–", pk() + 9, " (2021).")
    key = text("nat-methods_2021_", F.col("p_size"), "_", pk(), "_wu")
    matched = p.where("p_partkey % 3 <> 0").select(key.alias("key"), text("nat methods|2021|", F.col("p_size"), "|x|", F.when(pk() % 3 == 1, text(pk())).otherwise("NOT_FOUND")).alias("reply"))
    found = chains.citations(p.select(line.alias("line")), matched)
    return found.select(F.regexp_extract("line", r", (\d+)–", 1).cast("long").alias("k"), "key", "pmid", "known")


# Display text -------------------------------------------------------------------------------------------------------------


@query("slug_text", "SELECT p_partkey AS k, trim(regexp_replace(lower(p_name || ' Ea ' || p_brand), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part")
def slug_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts(spark, sf_dir).select(pk().alias("k"), wording.slug(text(F.col("p_name"), " Éa ", F.col("p_brand"))).alias("slug"))


@query("match_reply", "SELECT p_partkey AS k, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_partkey AS VARCHAR) END AS pmid FROM part")
def match_reply(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts(spark, sf_dir).select(pk().alias("k"), ids.ecitmatch(text("nature|2020|", F.col("p_size"), "|", F.when(pk() % 2 == 0, text(pk())).otherwise("NOT_FOUND"), "\n")).alias("pmid"))


@query("list_text", """SELECT p_partkey AS k, array_to_string(list_slice(v, 1, 3), ', ') || CASE WHEN len(v) > 3 THEN ' and ' || (len(v) - 3) || ' more' ELSE '' END AS examples, CASE WHEN len(v) = 0 THEN '[]' ELSE '[''' || array_to_string(v, ''', ''') || ''']' END AS shown FROM (SELECT p_partkey, list_transform(range(1, p_size % 7 + 1), lambda x: 'e' || x) AS v FROM part)""")
def list_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_size") % 7
    v = F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda x: text("e", x))).otherwise(F.array().cast("array<string>"))
    return parts(spark, sf_dir).select(pk().alias("k"), wording.examples(v).alias("examples"), wording.shown_list(v).alias("shown"))


@query(
    "label_text",
    """SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN 'Yes' WHEN 1 THEN 'No' WHEN 2 THEN 'Inconclusive' ELSE 'Not checkable' END AS short, CASE p_partkey % 3 WHEN 0 THEN 'PMID ' WHEN 1 THEN 'DOI ' ELSE '' END || p_name AS label, CASE WHEN p_partkey % 5 = 0 THEN 'no review yet' ELSE 'signed ' || p_brand || ' on 2026-01-01' END AS provenance,
    'https://r.example/issues/new?template=correction.yml&title=%5Bcorrection%5D%20' || replace(p_name, ' ', '%20') AS correction, 'https://r.example/blob/main/' || CASE WHEN p_partkey % 2 = 0 THEN 'registry' ELSE 'datasets' END || '/' || p_partkey || '.yaml' AS source, 'https://r.example/issues/new?template=add-dataset.yml&title=%5Badd-dataset%5D%20GSE' || p_partkey AS addition, 'https://r.example/blob/main/docs/RULES.md' AS rules FROM part""",
)
def label_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda *v: F.element_at(F.array(*map(F.lit, v)), (pk() % len(v) + 1).cast("int"))
    return parts(spark, sf_dir).select(
        pk().alias("k"), wording.short(pick("PRESENT", "NOT PRESENT", "INCONCLUSIVE", "NOT CHECKABLE")).alias("short"), wording.identifier_label(pick("pmid", "doi", "geo"), F.col("p_name")).alias("label"),
        wording.provenance_text(pk() % 5 == 0, F.col("p_brand"), F.lit("2026-01-01")).alias("provenance"), wording.correction_url("https://r.example", F.col("p_name")).alias("correction"), wording.source_url("https://r.example", F.when(pk() % 2 == 0, "model").otherwise("dataset"), text(pk())).alias("source"),
        wording.addition_url("https://r.example", text("GSE", pk())).alias("addition"), wording.rules_url("https://r.example").alias("rules"),
    )


ANSWERS = """SELECT p_partkey AS k, 'M' || CAST(p_size AS STRING) AS model_name, 'training' AS stage, CASE p_partkey % 5 WHEN 0 THEN 'PRESENT' WHEN 1 THEN 'NOT PRESENT' WHEN 2 THEN 'INCONCLUSIVE' WHEN 3 THEN 'NOT CHECKABLE' ELSE 'PRESENT' END AS verdict, CASE WHEN p_partkey % 5 = 4 THEN 'one part.' END AS by_design,
    p_partkey % 3 AS samples, CASE WHEN p_partkey % 2 = 0 THEN p_partkey * 1000 END AS cells, ['pmid', 'accession'] AS matched_on, ['s1', 's2'] AS sources_searched, ['accession', 'pmid'] AS keys_attempted, CASE WHEN p_partkey % 4 = 0 THEN ['doi'] ELSE [] END AS keys_absent, CASE WHEN p_partkey % 5 = 2 THEN 'no exact key could be attempted: ' || p_name || '.' END AS reason,
    CASE WHEN p_partkey % 7 = 0 THEN 'provisional' END AS identity, CASE WHEN p_partkey % 14 = 0 THEN 'its title.' END AS identity_basis, 'study' AS overlap_level FROM part"""


@query(
    "answer_sentences",
    f"""SELECT k, CASE verdict WHEN 'PRESENT' THEN 'Yes' WHEN 'NOT PRESENT' THEN 'No' WHEN 'INCONCLUSIVE' THEN 'Inconclusive' ELSE 'Not checkable' END || ': ' || CASE WHEN by_design IS NOT NULL THEN 'by design, ' || model_name || ' (training) was trained on this dataset except for one part; that is no exposure.'
    WHEN verdict = 'PRESENT' THEN 'the training data of ' || model_name || ' hold it' || CASE WHEN samples > 0 AND cells IS NOT NULL THEN ' with ' || samples || ' samples, ' || format('{{:,}}', cells) || ' cells' WHEN samples > 0 THEN ' with ' || samples || ' samples' WHEN cells IS NOT NULL THEN ' with ' || format('{{:,}}', cells) || ' cells' ELSE '' END || ', found by PMID and accession.'
    WHEN verdict = 'NOT PRESENT' THEN 'the training data of ' || model_name || ' do not hold it; s1, s2 were searched by accession and PMID' || CASE WHEN len(keys_absent) > 0 THEN ' (the dataset has no DOI)' ELSE '' END || '.' WHEN verdict = 'INCONCLUSIVE' THEN reason ELSE model_name || ' has published no list of its training data.' END
    || CASE WHEN identity IS NULL THEN '' ELSE ' The dataset''s identity is provisional: ' || CASE WHEN identity_basis IS NULL THEN 'no basis is recorded' ELSE 'its title' END || '.' END AS sentence FROM ({ANSWERS})""",
)
def answer_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syn.both(spark, sf_dir, ANSWERS).select("k", wording.answer_text().alias("sentence"))


# A reason as each code of the decision table records it, for every part; both engines read it.
REASONS = """SELECT p_partkey AS k, CASE p_partkey % 9 WHEN 0 THEN 'no match, but 2 entries of this list cannot be searched exactly (x)' WHEN 1 THEN 'no exact key could be attempted: ' || p_name WHEN 2 THEN 'no match on accession; this manifest needs pmid'
    WHEN 3 THEN 'no match, but manifest source a was not searched' WHEN 4 THEN 'same publication, matched on PMID' WHEN 5 THEN 'matched on title only — not an exact identifier' WHEN 6 THEN 'the manifest source b is not confirmed' WHEN 7 THEN 'no manifest was published' ELSE p_name END AS reason FROM part"""


@query(
    "evidence_words",
    f"""SELECT a.k, CASE WHEN by_design IS NOT NULL THEN 'chosen by its authors for training, apart from one part.' WHEN verdict = 'PRESENT' THEN CASE WHEN samples > 0 AND cells IS NOT NULL THEN samples || ' listed samples, ' || format('{{:,}}', cells) || ' cells' WHEN samples > 0 THEN samples || ' listed samples' WHEN cells IS NOT NULL THEN format('{{:,}}', cells) || ' cells' ELSE 'listed as a study' END
    WHEN a.reason IS NULL AND len(keys_absent) = 0 THEN 'nothing to show' ELSE concat_ws('; ', a.reason, CASE WHEN len(keys_absent) > 0 THEN 'has no DOI to search for' END) END AS evidence,
    CASE a.k % 9 WHEN 0 THEN 'parts of its list name no dataset' WHEN 1 THEN 'nothing that its list prints is known of the dataset' WHEN 2 THEN 'a further identifier must be known before the dataset can be ruled out' WHEN 3 THEN 'one of its files is still to be searched' WHEN 4 THEN 'only the publication is in its list'
    WHEN 5 THEN 'what was found is no identifier' WHEN 6 THEN 'nobody has confirmed one of its files' WHEN 7 THEN 'its training data were never listed' END AS why FROM ({ANSWERS}) AS a""",
)
def evidence_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    why = syn.both(spark, sf_dir, REASONS).select("k", wording.why_text(wording.why(F.col("reason"))).alias("why"))
    return syn.both(spark, sf_dir, ANSWERS).select("k", wording.evidence_text().alias("evidence")).join(why, "k")


# Sinks and page tables ------------------------------------------------------------------------------------------------------


@query("csv_export", r'''SELECT s_suppkey || ',' || CASE WHEN s_suppkey % 3 = 0 THEN '"' || s_name || ', ""x"""' ELSE s_name END || ',' || CASE WHEN s_suppkey % 2 = 0 THEN CAST(s_nationkey AS VARCHAR) ELSE '' END AS line FROM supplier''')
def csv_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = suppliers(spark, sf_dir).select(sk(), F.when(sk() % 3 == 0, text(F.col("s_name"), ', "x"')).otherwise(F.col("s_name")), F.when(sk() % 2 == 0, F.col("s_nationkey")))
    return sinks.csv_rows(rows.toDF("a", "b", "c"))


@query("json_export", """SELECT '{"k":' || s_suppkey || CASE WHEN s_suppkey % 2 = 0 THEN ',"name":"' || s_name || '"' ELSE '' END || ',"keys":["a","b"]}' AS json FROM supplier""")
def json_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = suppliers(spark, sf_dir).select(sk().alias("k"), F.when(sk() % 2 == 0, F.col("s_name")).alias("name"), F.array(F.lit("a"), F.lit("b")).alias("keys"))
    path = new_path(spark, "json")
    sinks.json_lines(rows, path)
    return spark.read.text(path).withColumnRenamed("value", "json")


@query("index_export", """SELECT model, stage, '[' || CASE source WHEN 'samples' THEN 1 ELSE 0 END || ',"GEO-GSE' || k || '",' || coalesce('"' || sample || '"', 'null') || ',' || coalesce(CAST(cells AS VARCHAR), 'null') || ',["GSE' || k || '"' || CASE WHEN sample IS NULL THEN '' ELSE ',"GSM' || r || '"' END || ']]' AS row_text FROM row_ WHERE source = 'samples' OR k IN (SELECT o_orderkey FROM orders)""")
def index_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compact rows of the lookup index, without their papers."""
    files = syn.base(spark, sf_dir, "corpus").select("model", "stage", F.explode(F.array(F.struct(F.lit("studies").alias("source"), F.lit(0).alias("ord")), F.struct(F.lit("samples").alias("source"), F.lit(1).alias("ord")))).alias("f")).select("model", "stage", "f.*")
    rows = sinks.index_rows(syn.records(spark, sf_dir), files)
    return rows.select("model", "stage", F.regexp_replace("row", r",\[[^\]]*\],\[[^\]]*\]\]$", "]").alias("row_text"))


@query("extract_rows", "SELECT row_number() OVER (ORDER BY s_suppkey) AS row_number, CAST(s_nationkey AS VARCHAR) AS s_nationkey, s_name, repeat('c', 64) AS parent FROM supplier")
def extract_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chosen columns written as an extract and read back, with the parent that it names."""
    path = new_path(spark, "extract") + "/x.csv"
    rows = suppliers(spark, sf_dir).select(sk().alias("row"), "s_name", "s_acctbal", "s_nationkey")
    sinks.extract(rows, ["s_nationkey", "s_name"], path, "c" * 64, ["from the supplier table"])
    parent = files.facts(files.listed(spark, path.rpartition("/")[0])).first().parent
    return lists.read_list(spark, path).withColumn("parent", F.lit(parent)).withColumnRenamed("row", "row_number")


@query("snapshot_rows", "SELECT 'p' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS id, CASE WHEN p_partkey % 4 <> 0 THEN p_brand END AS owner, CAST(p_size AS VARCHAR) AS cells FROM part")
def snapshot_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A release written as a snapshot, whose total must be the published one, and read back."""
    path = new_path(spark, "snapshot") + "/s.csv"
    p = parts(spark, sf_dir).select(text("p", F.lpad(pk().cast("string"), 9, "0")).alias("id"), F.when(pk() % 4 != 0, F.col("p_brand")).alias("owner"), F.col("p_size").alias("cells"))
    sinks.snapshot(p, ["id", "owner", "cells"], path, "cells", int(p.agg(F.sum("cells")).first()[0]))
    return lists.read_list(spark, path).drop("row")


@query("ledger_plan", """SELECT 'd' || s_suppkey AS dataset, 'm' || s_suppkey AS model, CASE WHEN s_suppkey % 2 = 1 THEN 'PRESENT' ELSE 'NOT CHECKABLE' END AS verdict, 'reported-eval' AS relation, s_suppkey % 4 = 0 AS draft, s_suppkey % 6 = 0 AS unsearched FROM supplier""")
def ledger_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of a registry folder: each recorded finding with its relation, draft mark and whether a place is unsearched."""
    led = ledgers.ledger(spark, registry(spark, sf_dir))
    return led.rows.join(led.models.select("model", (F.size("discovery_unchecked") > 0).alias("unsearched")), "model").select("dataset", "model", "verdict", "relation", "draft", "unsearched")


@query("page_classes", "SELECT CASE WHEN s_suppkey % 7 = 0 THEN 'task-specific' ELSE 'foundation' END AS model_class, CAST(min(CASE WHEN s_suppkey % 7 = 0 THEN 2 ELSE 1 END) AS INTEGER) AS place, array_to_string(list('m' || s_suppkey ORDER BY lower('Model ' || s_suppkey)), ',') AS models FROM supplier GROUP BY 1")
def page_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = ledgers.ledger(spark, registry(spark, sf_dir))
    return views.classes(led.models).select("model_class", F.col("place").cast("int").alias("place"), F.array_join("models", ",").alias("models"))


@query("page_datasets", "SELECT 'd' || s_suppkey AS dataset, CAST(1 AS INTEGER) AS place, 'Model ' || s_suppkey AS model_name, s_suppkey % 4 = 0 AS draft, CASE WHEN s_suppkey % 2 = 0 THEN 'nothing to show' WHEN s_suppkey % 4 > 0 THEN (s_suppkey % 4) || ' listed samples, ' || format('{:,}', 1000 * s_suppkey) || ' cells' END AS evidence FROM supplier")
def page_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = ledgers.ledger(spark, registry(spark, sf_dir))
    return views.dataset_rows(led.rows, led.models).select("dataset", "place", "model_name", "draft", "evidence")


@query("page_checks", "SELECT 'm' || s_suppkey AS model, s_suppkey % 5 <> 0 AND s_suppkey % 4 <> 0 AS paper_read, false AS manifest_read, CASE WHEN s_suppkey % 6 = 0 THEN 'methods' ELSE '' END AS unsearched FROM supplier")
def page_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = catalog.load(spark, registry(spark, sf_dir))
    rows = views.how_checked(t["sources"], t["corpora"], t["models"], t["discovery"])
    done = lambda name: F.filter("checks", lambda c: c["check"] == name)[0]["done"]
    return rows.select("model", done("paper").alias("paper_read"), done("manifest").alias("manifest_read"), F.array_join("unsearched", ",").alias("unsearched"))


@query("page_judgments", "SELECT 'm' || s_suppkey AS model, 'caveats as worded: ' || (s_suppkey % 3) AS call FROM supplier WHERE s_suppkey % 3 > 0")
def page_judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = catalog.load(spark, registry(spark, sf_dir))
    return views.judgment_calls(t["recorded"], t["datasets"], t["corpora"]).select("model", "call")


@query(
    "lookup_plan",
    """SELECT CAST(s.s_suppkey AS VARCHAR) AS query_id, 'm' || c.s_suppkey AS model, s.s_suppkey = c.s_suppkey AS recorded, CASE WHEN s.s_suppkey = c.s_suppkey THEN 'recorded' WHEN c.s_suppkey % 2 = 0 THEN 'no_manifest' ELSE 'not_indexed' END AS code, 'Model ' || c.s_suppkey AS model_name
    FROM supplier s JOIN supplier c ON c.s_suppkey % 4 <> 0""",
)
def lookup_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every dataset's name looked up in every reviewed model of a registry folder, in one call."""
    names = suppliers(spark, sf_dir).select(text(sk()).alias("query_id"), text(" d", sk(), " ").alias("raw"))
    found = lookups.lookup(spark, registry(spark, sf_dir), names)
    return found.answers.select("query_id", "model", "recorded", "code", "model_name")


@query("lookup_matrix", "SELECT 'q' || p_partkey AS query_id, CASE WHEN p_partkey % 3 = 0 THEN 'PRESENT' ELSE 'NOT PRESENT' END AS one, CASE WHEN p_partkey % 2 = 0 THEN 'INCONCLUSIVE' END AS two FROM part")
def lookup_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = parts(spark, sf_dir)
    one = p.select(text("q", pk()).alias("query_id"), F.lit("m").alias("model"), F.lit("a").alias("stage"), F.when(pk() % 3 == 0, "PRESENT").otherwise("NOT PRESENT").alias("verdict"))
    two = p.where("p_partkey % 2 = 0").select(text("q", pk()), F.lit("m"), F.lit("b"), F.lit("INCONCLUSIVE"))
    return lookup.matrix(one.union(two), [("m", "a"), ("m", "b")]).toDF("query_id", "one", "two")


@query("lookup_coverage", "SELECT 'q' || p_partkey AS query_id, CASE WHEN p_partkey % 4 = 3 THEN '' ELSE 'm1,m2' END AS searched, CASE WHEN p_partkey % 4 IN (0, 1) THEN 'publication-level match' ELSE '' END AS warnings FROM part")
def lookup_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = parts(spark, sf_dir)
    queries = p.select(text("q", pk()).alias("query_id"), F.when(pk() % 4 == 0, "paper").when(pk() % 4 == 3, "unrecognised").otherwise("dataset").alias("kind"))
    rows = p.where("p_partkey % 4 <> 3").select(text("q", pk()).alias("query_id"), F.explode(F.array(F.lit("m2"), F.lit("m1"), F.lit("m2"))).alias("model"), F.when(pk() % 4 == 1, "publication").otherwise("dataset").alias("match_level"))
    return lookup.warned(queries, rows).select("query_id", F.array_join("searched", ",").alias("searched"), F.array_join("warnings", ",").alias("warnings"))


@query("dual_typing", "SELECT p_partkey AS k, CASE WHEN p_partkey % 2 = 0 THEN 'cellxgene_collection,cellxgene_dataset' ELSE 'cellxgene_dataset' END AS types FROM part")
def dual_typing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A typed UUID is offered as a collection too where a list names collections."""
    p = parts(spark, sf_dir).select(text(pk()).alias("dataset"))
    typed = p.select("dataset", F.lit(0).cast("long").alias("ord"), F.lit("cellxgene_dataset").alias("type"), F.lit("AAAAAAAA-0000-0000-0000-000000000001").alias("value"), F.lit("true").alias("confirmed"), F.lit("").alias("basis"))
    shape = "model string, stage string, accession_types array<string>"
    corpora = spark.createDataFrame([("m0", "s", ["cellxgene_collection", "cellxgene_dataset"]), ("m1", "s", ["cellxgene_dataset"])], shape)
    asked = p.withColumn("model", text("m", F.col("dataset").cast("long") % 2)).withColumn("stage", F.lit("s"))
    rows = keys.usable(asked, corpora, lookup.both_types(typed))
    return rows.groupBy(F.col("dataset").cast("long").alias("k")).agg(F.array_join(F.sort_array(F.collect_set("type")), ",").alias("types"))


@query("finding_json", "SELECT 'd' || p_partkey AS dataset, CASE WHEN p_partkey % 2 = 0 THEN '{\"dataset\":\"d' || p_partkey || '\",\"verdict\":\"PRESENT\",\"keys_attempted\":[\"accession\"],\"matched_on\":[\"accession\"],\"match_level\":\"dataset\",\"overlap_level\":\"sample\",\"samples\":2,\"sample_ids\":[\"a\",\"b\"],\"cells\":' || p_size || '}' ELSE '{\"dataset\":\"d' || p_partkey || '\",\"verdict\":\"NOT CHECKABLE\",\"reason\":\"none\"}' END AS finding FROM part")
def finding_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    from provena.plans.check import as_findings

    yes, none, no = pk() % 2 == 0, F.array().cast("array<string>"), F.lit(None).cast("string")
    rows = parts(spark, sf_dir).select(
        F.lit("m").alias("model"), F.lit("s").alias("stage"), text("d", pk()).alias("dataset"), F.when(yes, "PRESENT").otherwise("NOT CHECKABLE").alias("verdict"), F.array(F.lit("accession")).alias("keys_attempted"), none.alias("keys_absent"),
        F.when(yes, F.array(F.lit("accession"))).otherwise(none).alias("matched_on"), F.when(yes, "dataset").alias("match_level"), no.alias("identity"), no.alias("identity_basis"), no.alias("by_design"), F.lit("sample").alias("overlap_level"),
        F.when(yes, F.array(F.lit("a"), F.lit("b"))).otherwise(none).alias("sample_ids"), F.col("p_size").cast("long").alias("cells"), F.when(~yes, "none").alias("reason"),
    )
    return as_findings(rows).select("dataset", "finding")
