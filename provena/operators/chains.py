"""From an identifier to the accessions, papers and samples that it belongs to, over stored replies.

``Replies`` holds what the indexes said; nothing is requested here. Records are (kind, query, accessions, pmids, doi, pmcid, title,
organism, samples, sources), in the shape of the crosswalk cache.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provena.functions import identifiers as ids
from provena.sources import replies

SAMPLES = "array<struct<accession:string,title:string>>"
# How records name the replies that they come from.
FOUND_GDS, TOLD_GDS, FOUND_PUBMED, TOLD_PUBMED, LINKED, STUDY = "esearch.fcgi?db=gds", "esummary.fcgi?db=gds", "esearch.fcgi?db=pubmed", "esummary.fcgi?db=pubmed", "elink.fcgi?dbfrom=pubmed&db=gds", "biostudies:studies"
RECORD = ["kind", "query", "accessions", "pmids", "doi", "pmcid", "title", "organism", "samples", "sources"]


@dataclass
class Replies:
    """Stored replies, each table with a ``body``.

    ``searches`` (db, term), ``gds`` and ``pubmed`` (key: the term, or the PMID that was asked about), ``links`` (pmid), ``studies`` (accession).
    """

    searches: DataFrame
    gds: DataFrame
    pubmed: DataFrame
    links: DataFrame
    studies: DataFrame


def _once(values: Column) -> Column:
    return F.array_distinct(F.array_compact(values))


def _no(kind: str) -> Column:
    return F.lit(None).cast(kind)


def geo(queries: DataFrame, r: Replies) -> DataFrame:
    """Records of series and samples in the column ``query``; none without an entry of the asked type.

    A sample without papers takes those of its series, and its samples if it has none. DOI and PMC id are the first paper's.
    """
    # Queries and papers may be millions of short texts, which Spark takes for less than they are: they are dealt out, never sent whole through the driver.
    entries = replies.gds(replies.summaries(r.gds.join(queries.withColumnRenamed("query", "key").hint("merge"), "key", "left_semi"), "key"), "key", "place")
    first = lambda kind: F.min_by(F.struct("title", "organism", "pmids", "samples", "bioproject", "sra"), F.when(F.col("entrytype") == kind, F.col("place")))
    rows = entries.groupBy("key").agg(first("GSE").alias("series"), first("GSM").alias("sample"), F.bool_or(F.col("entrytype") == "GSE").alias("has_series"), F.bool_or(F.col("entrytype") == "GSM").alias("has_sample"))
    single = F.substring("key", 1, 3) == "GSM"
    rows = rows.where(F.when(single, F.col("has_sample")).otherwise(F.col("has_series"))).withColumn("own", F.when(single, F.col("sample")).otherwise(F.col("series")))
    borrows = single & (F.size("own.pmids") == 0) & F.col("has_series")
    rows = rows.select("key", "own", F.when(borrows, F.col("series.pmids")).otherwise(F.col("own.pmids")).alias("pmids"), F.when(borrows & (F.size("own.samples") == 0), F.col("series.samples")).otherwise(F.col("own.samples")).alias("samples"))
    papers = replies.pubmed(replies.summaries(r.pubmed)).groupBy("pmid").agg(F.max(F.struct("doi", "pmcid")).alias("p"))
    rows = rows.withColumn("pmid", F.get("pmids", F.lit(0))).join(papers.hint("merge"), "pmid", "left")
    sources = F.array_compact(F.array(F.lit(FOUND_GDS), F.lit(TOLD_GDS), F.when(F.size("pmids") > 0, TOLD_PUBMED)))
    return rows.select(
        F.lit("geo").alias("kind"), F.col("key").alias("query"), _once(F.array("key", "own.bioproject", "own.sra")).alias("accessions"), "pmids", "p.doi", "p.pmcid", "own.title", "own.organism", "samples", sources.alias("sources"),
    )


def papers(queries: DataFrame, r: Replies) -> DataFrame:
    """Records of PMIDs in the column ``query``: all series that the paper is linked with, in the reply's order."""
    own = replies.pubmed(replies.summaries(r.pubmed)).groupBy("pmid").agg(F.max(F.struct("title", "doi", "pmcid")).alias("p"))
    asked = queries.select(F.col("query").alias("pmid")).distinct().join(own, "pmid")
    links = replies.linked(r.links, "pmid").join(asked, "pmid", "left_semi")
    entries = replies.gds(replies.summaries(r.gds.withColumnRenamed("key", "pmid").join(asked, "pmid", "left_semi"), "pmid"), "pmid", "place").where("entrytype = 'GSE'")
    per = entries.groupBy("pmid").agg(F.sort_array(F.collect_list(F.struct("place", "organism", F.array("accession", "bioproject", "sra").alias("a"), "samples"))).alias("s"))
    rows = asked.join(links, "pmid", "left").join(per, "pmid", "left")
    order = lambda a, b: F.when(a["accession"] < b["accession"], -1).when(a["accession"] > b["accession"], 1).otherwise(0)
    samples = F.array_sort(F.array_distinct(F.flatten("s.samples")), order)
    any_link = F.coalesce(F.size("uids"), F.lit(0)) > 0
    sources = F.array_compact(F.array(F.lit(TOLD_PUBMED), F.lit(LINKED), F.when(any_link, TOLD_GDS)))
    return rows.select(
        F.lit("pubmed").alias("kind"), F.col("pmid").alias("query"), F.coalesce(_once(F.flatten("s.a")), F.array().cast("array<string>")).alias("accessions"), F.array("pmid").alias("pmids"), "p.doi", "p.pmcid", "p.title",
        F.get("s.organism", F.lit(0)).alias("organism"), F.coalesce(samples, F.array().cast(SAMPLES)).alias("samples"), sources.alias("sources"),
    )


def dois(queries: DataFrame, r: Replies) -> DataFrame:
    """Records of DOIs in the column ``query``: the record of the first paper that a search finds, under the DOI."""
    term = F.concat(F.lit('"'), "query", F.lit('"[DOI]'))
    hits = replies.found(r.searches.where("db = 'pubmed'"), "term")
    first = queries.select("query", term.alias("term")).join(hits, "term").select("query", F.get("uids", F.lit(0)).alias("pmid")).where("pmid is not null")
    own = papers(first.select(F.col("pmid").alias("query")), r).drop("kind").withColumnRenamed("query", "pmid")
    rows = first.join(own, "pmid").withColumn("kind", F.lit("doi")).withColumn("sources", F.concat(F.array(F.lit(FOUND_PUBMED)), "sources"))
    return rows.select(*RECORD)


def arrays(queries: DataFrame, r: Replies) -> DataFrame:
    """Records of E- accessions in the column ``query``."""
    rows = queries.select(F.col("query").alias("accession")).distinct().join(replies.studies(r.studies, "accession"), "accession")
    return rows.select(
        F.lit("arrayexpress").alias("kind"), F.col("accession").alias("query"), F.array("accession").alias("accessions"), F.array_compact(F.array("pmid")).alias("pmids"), "doi", _no("string").alias("pmcid"), "title", "organism",
        F.array().cast(SAMPLES).alias("samples"), F.array(F.lit(STUDY)).alias("sources"),
    )


def resolved(inputs: DataFrame, cache: DataFrame, r: Replies | None = None) -> DataFrame:
    """(input, kind, query, hit, note, ...) for identifiers in the column ``input``: from the cache, else through the chain of their kind.

    ``hit`` is cache, replies or null; without one the note says why. What is no identifier of a known kind has no kind.
    """
    c = ids.classify(F.col("input"))
    asked = inputs.select("input", c["kind"].alias("kind"), c["value"].alias("query")).distinct()
    named = F.when(F.col("kind") == "doi", F.lower("query")).otherwise(F.col("query"))
    for name, kind in (("pmcid", "string"), ("title", "string"), ("organism", "string"), ("samples", SAMPLES), ("sources", "array<string>")):
        if name not in cache.columns:
            cache = cache.withColumn(name, _no(kind))
    known = cache.withColumn("query", named).select(*RECORD).withColumn("hit", F.lit("cache"))
    rows = asked.join(known, ["kind", "query"], "left")
    if r is not None:
        missing = asked.join(known, ["kind", "query"], "left_anti").select("kind", "query").distinct()
        of = lambda kind: missing.where(F.col("kind") == kind).select("query")
        fresh = geo(of("geo"), r).unionByName(papers(of("pubmed"), r)).unionByName(dois(of("doi"), r)).unionByName(arrays(of("arrayexpress"), r))
        rows = asked.join(known.unionByName(fresh.withColumn("hit", F.lit("replies"))), ["kind", "query"], "left")
    note = F.when(F.col("kind").isNull(), "not an accession, PMID or DOI that can be resolved").when(F.col("hit").isNull(), F.concat(F.lit("nothing is stored for "), "input"))
    return rows.select("input", *RECORD[:2], "hit", note.alias("note"), *RECORD[2:])


def citations(lines: DataFrame, matched: DataFrame) -> DataFrame:
    """(line, key, pmid, known): citations in the column ``line`` through stored match replies (key, reply).

    A stored reply without a PMID is an answer as well: ``known`` without a pmid. A line of another shape has no key.
    """
    from provena.functions import wording

    c = lines.withColumn("c", wording.citation(F.col("line"))).withColumn("has", F.col("c").isNotNull())
    key = wording.citation_key(F.col("c.journal"), F.col("c.year"), F.col("c.volume"), F.col("c.first_page"), F.col("c.author"))
    rows = c.select("line", F.when(F.col("has"), key).alias("key"))
    answers = matched.groupBy("key").agg(F.max(F.struct(ids.ecitmatch(F.col("reply")).alias("pmid"))).alias("a"))
    return rows.join(answers, "key", "left").select("line", "key", F.col("a.pmid").alias("pmid"), F.col("a").isNotNull().alias("known"))
