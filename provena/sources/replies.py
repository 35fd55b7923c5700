"""Stored JSON replies of publication indexes, as tables: one reply in each row, its text in the column ``body``.

Fixed values: the names of fields in the replies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GDS = """entrytype string, accession string, title string, taxon string, pubmedids array<string>, samples array<struct<accession:string,title:string>>,
    bioproject string, extrelations array<struct<relationtype:string,targetobject:string>>"""
PUBMED = "title string, articleids array<struct<idtype:string,value:string>>"
LINKS = "linksets array<struct<linksetdbs:array<struct<links:array<string>>>>>"
STUDY = """section struct<attributes:array<struct<name:string,value:string>>,
    subsections:array<struct<type:string,accno:string,attributes:array<struct<name:string,value:string>>>>>"""


def _some(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def summaries(replies: DataFrame, *more: str) -> DataFrame:
    """(``more``, place, uid, entry) of summary replies: one row for each uid, in the reply's order, with the entry's JSON."""
    each = F.posexplode(F.map_entries(F.from_json(F.get_json_object("body", "$.result"), "map<string,string>"))).alias("place", "e")
    return replies.select(*more, each).select(*more, "place", F.col("e.key").alias("uid"), F.col("e.value").alias("entry")).where("uid <> 'uids'")


def gds(entries: DataFrame, *more: str) -> DataFrame:
    """GEO entries: (``more``, uid, entrytype, accession, title, organism, pmids, samples by accession, bioproject, sra)."""
    rows = entries.select(*more, "uid", F.from_json("entry", GDS).alias("g"))
    links = F.filter("g.extrelations", lambda r: r["relationtype"] == "SRA")
    samples = F.array_sort(F.filter("g.samples", lambda s: _some(s["accession"]).isNotNull()), lambda a, b: F.when(a["accession"] < b["accession"], -1).when(a["accession"] > b["accession"], 1).otherwise(0))
    none = F.array().cast("array<string>")
    return rows.select(
        *more, "uid", "g.entrytype", "g.accession", _some(F.col("g.title")).alias("title"), _some(F.col("g.taxon")).alias("organism"), F.coalesce("g.pubmedids", none).alias("pmids"),
        F.coalesce(samples, F.array().cast("array<struct<accession:string,title:string>>")).alias("samples"), _some(F.col("g.bioproject")).alias("bioproject"), F.get(links, F.lit(0))["targetobject"].alias("sra"),
    )


def pubmed(entries: DataFrame, *more: str) -> DataFrame:
    """Articles: (``more``, pmid, title, doi, pmcid); of several ids of one type the last."""
    rows = entries.select(*more, F.col("uid").alias("pmid"), F.from_json("entry", PUBMED).alias("p"))
    named = lambda kind: F.try_element_at(F.filter("p.articleids", lambda a: a["idtype"] == kind), F.lit(-1))["value"]
    return rows.select(*more, "pmid", _some(F.col("p.title")).alias("title"), named("doi").alias("doi"), named("pmc").alias("pmcid"))


def found(replies: DataFrame, *more: str) -> DataFrame:
    """(``more``, uids) of search replies."""
    ids = F.from_json(F.get_json_object("body", "$.esearchresult.idlist"), "array<string>")
    return replies.select(*more, F.coalesce(ids, F.array().cast("array<string>")).alias("uids"))


def linked(replies: DataFrame, *more: str) -> DataFrame:
    """(``more``, uids) of link replies: the first database of the first set."""
    sets = F.from_json("body", LINKS)["linksets"]
    links = F.get(F.get(sets, F.lit(0))["linksetdbs"], F.lit(0))["links"]
    return replies.select(*more, F.coalesce(links, F.array().cast("array<string>")).alias("uids"))


def studies(replies: DataFrame, *more: str) -> DataFrame:
    """(``more``, title, organism, pmid, doi) of study replies; of several publications the last that has each id."""
    rows = replies.select(*more, F.from_json("body", STUDY)["section"].alias("s"))

    def attribute(attributes: Column, name: str) -> Column:
        return F.get(F.filter(attributes, lambda a: a["name"] == name), F.lit(0))["value"]

    papers = F.filter("s.subsections", lambda x: x["type"] == "Publication")
    pmids = F.filter(F.transform(papers, lambda x: x["accno"]), lambda a: a.rlike(r"^\d+$"))
    dois = F.filter(F.transform(papers, lambda x: _some(attribute(x["attributes"], "DOI"))), lambda d: d.isNotNull())
    last = lambda values: F.try_element_at(values, F.lit(-1))
    return rows.select(*more, attribute(F.col("s.attributes"), "Title").alias("title"), attribute(F.col("s.attributes"), "Organism").alias("organism"), last(pmids).alias("pmid"), last(dois).alias("doi"))
