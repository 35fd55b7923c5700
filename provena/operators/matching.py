"""Identifier match: catalog targets against the tokens of published lists.

``records`` is (model, stage, source, row, project, sample, cells, accessions, pmids, dois), one for each row of a
list. The three kinds of token become one relation, so the match is one equi-join on (model, stage, key, value);
written as a disjunction it would be a nested loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provena.functions import identifiers as ids
from provena.operators.keys import ASKED, CORPUS, exact, filled, searchable
from provena.operators.screen import MOST, fits, screened

ROW = ["source", "row"]
#: The columns of records that matching reads.
READ = [*CORPUS, *ROW, "project", "sample", "cells", "accessions", "pmids", "dois"]


def tokens(records: DataFrame, more: list[str] | None = None) -> DataFrame:
    """(model, stage, source, row, key, value) and ``more`` columns of the record. Rows without tokens have none; nothing matches on null.

    A row's token lists hold each token once, so there is nothing to deduplicate here.
    """
    own = [*CORPUS, *ROW, *(more or [])]
    each = F.array(*(F.struct(F.lit(key).alias("key"), F.col(column).alias("values")) for key, column in (("accession", "accessions"), ("pmid", "pmids"), ("doi", "dois"))))
    pairs = records.select(*own, F.explode(each).alias("t"))
    return pairs.select(*own, "t.key", F.explode("t.values").alias("value"))


def matches(targets: DataFrame, attempts: DataFrame, records: DataFrame, n_targets: int | None = None) -> DataFrame:
    """(model, stage, dataset, key, source, row, project, sample, cells, listed) for every attempted key whose token equals a target.

    All keys are always tried: a hit on one doesn't end the search on others. What later steps need of the record comes along, so
    the record isn't joined again; ``listed`` is its first accession. With the number of targets known (stored tables tell it for nothing), tokens that equal
    none of them are dropped where they are read, before they would be shuffled.
    """
    tried = attempts.select(*ASKED, F.explode("keys_attempted").alias("key"))
    return met(targets.select(*ASKED, "key", "value").distinct().join(tried, [*ASKED, "key"]), records, n_targets)


def met(wanted: DataFrame, records: DataFrame, n_targets: int | None = None, most: int = MOST) -> DataFrame:
    """``matches`` of what is tried: (model, stage, dataset, key, value), each once.

    Targets are as many as pairs. Where their filter would be too large, tokens are held against the values and against the keys of their corpus, which are fewer.
    """
    rows = records.withColumn("listed", F.get("accessions", F.lit(0)))
    facts = ["project", "sample", "cells", "listed"]
    each = tokens(rows, facts)
    if n_targets is not None and fits(n_targets, most):
        each = screened(each, wanted, [*CORPUS, "key", "value"], n_targets, most)
    elif n_targets is not None:
        each = each.join(F.broadcast(wanted.select(*CORPUS, "key").distinct()), [*CORPUS, "key"], "left_semi")  # a few rows for each corpus
        values = wanted.agg(F.approx_count_distinct(F.struct("key", "value"))).first()[0]  # sizes the filter, decides nothing
        each = screened(each, wanted, ["key", "value"], values, most)
    found = wanted.join(each, [*CORPUS, "key", "value"])
    # Two targets of one key may hit the same row, whose facts are then the same.
    return found.select(*ASKED, "key", *ROW, *facts).distinct()


def wanted(rows: DataFrame) -> DataFrame:
    """(model, stage, dataset, key, value) of the rows of ``keys.tried``."""
    return rows.select(*ASKED, F.explode("targets").alias("t")).select(*ASKED, "t.*")


def hits(targets: DataFrame, attempts: DataFrame, records: DataFrame) -> DataFrame:
    """(model, stage, dataset, key, source, row) of the matches."""
    return matches(targets, attempts, records).select(*ASKED, "key", *ROW)


def named(records: DataFrame, corpora: DataFrame, identifiers: DataFrame) -> DataFrame:
    """(model, stage, dataset, hits): for each token that is a dataset's identifier, under a key that its corpus can be searched on, the bit of its key, and the same bit higher up if the file isn't unconfirmed.

    Tokens are held against the catalog and not against pairs, of which there are many more, so pairs needn't be shuffled by token; what wasn't asked is left out where pairs are at hand (``hit_keys``).
    """
    known = searchable(identifiers).where("value is not null").select("dataset", "key", "type", "value")
    usable = corpora.select(*CORPUS, exact(filled(F.col("keys_available"))).alias("open_"), "accession_types", F.col("unconfirmed").alias("doubted_"))
    each = tokens(records).join(F.broadcast(usable), CORPUS).where(F.array_contains("open_", F.col("key")))
    sure = ~F.coalesce(F.array_contains("doubted_", F.col("source")), F.lit(False))
    bit = F.lit(0)
    for at, key in enumerate(ids.EXACT_KEYS):
        bit = F.when(F.col("key") == key, 1 << at).otherwise(bit)
    each = each.select(*CORPUS, "key", "value", "accession_types", F.when(sure, bit * (1 + (1 << len(ids.EXACT_KEYS)))).otherwise(bit).alias("hits"))
    found = screened(each, known, ["key", "value"], known.count()).join(known, ["key", "value"])
    fit = (F.col("key") != "accession") | F.col("accession_types").isNull() | F.array_contains("accession_types", F.col("type"))
    return found.where(fit).select(*ASKED, "hits")


def hit_keys(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """(model, stage, dataset, keys_hit, keys_hit_confirmed) of the pairs, each once, with what ``named`` found.

    Pairs and hits are dealt together, by dataset, so what is joined by dataset next moves no pair again.
    """
    n = len(ids.EXACT_KEYS)
    asked = pairs.select(*ASKED, F.lit(1 << 2 * n).alias("hits"))
    rows = asked.unionByName(found).repartition("dataset").groupBy(*ASKED).agg(F.bit_or("hits").alias("hits"))
    of = lambda up: F.array_sort(F.array_compact(F.array(*(F.when(F.col("hits").bitwiseAND(1 << at + up) != 0, key) for at, key in enumerate(ids.EXACT_KEYS)))))
    return rows.where(F.col("hits") >= 1 << 2 * n).select(*ASKED, of(0).alias("keys_hit"), of(n).alias("keys_hit_confirmed"))


def evidence(found: DataFrame, records: DataFrame) -> DataFrame:
    """(model, stage, dataset, source, row, sample, cells): the sample rows behind the matches, each once.

    A match on a sample row is that row. A match on a study row is every sample row of its project in the same corpus;
    a sample match is never widened.
    """
    own = found.where("sample is not null").select(*ASKED, *ROW, "sample", "cells")
    samples = records.where("sample is not null and project is not null").select(*CORPUS, *ROW, "project", "sample", "cells")
    studies = found.where("sample is null and project is not null").select(*ASKED, "project").distinct()
    return own.union(studies.join(samples, [*CORPUS, "project"]).select(*ASKED, *ROW, "sample", "cells")).distinct()


def sample_id(sample: Column) -> Column:
    """The first accession in a sample cell, else the cell as it is."""
    found = ids.accessions(sample)
    return F.when(F.size(found) > 0, F.element_at(found, 1)).otherwise(sample)


def united(rows: DataFrame) -> DataFrame:
    """(model, stage, dataset, sample_ids, cells) of evidence, the ids sorted and each once.

    First by dataset and sample, which deals a huge project out; what is then one row for each sample is gathered in arrays by the tasks that hold it, and the arrays of
    a dataset, one from each task, are put together at last.
    """
    each = rows.groupBy(*ASKED, sample_id(F.col("sample")).alias("sample_id")).agg(F.sum("cells").alias("cells"))
    return each.groupBy(*ASKED).agg(F.sort_array(F.collect_list("sample_id")).alias("sample_ids"), F.sum("cells").alias("cells"))


def summary(attempts: DataFrame, found: DataFrame, records: DataFrame, corpora: DataFrame) -> DataFrame:
    """The attempts with what ``matches`` found.

    Adds keys_hit, keys_hit_confirmed (on rows of sources that aren't unconfirmed), listed_accessions, sample_ids,
    cells, overlap_level, match_level. Cells add up over evidence rows, never over join multiplicity.
    """
    rows = found.join(corpora.select(*CORPUS, "unconfirmed"), CORPUS)
    sure = ~F.coalesce(F.array_contains("unconfirmed", F.col("source")), F.lit(False))
    matched = rows.groupBy(*ASKED).agg(
        F.sort_array(F.collect_set("key")).alias("keys_hit"),
        F.sort_array(F.collect_set(F.when(sure, F.col("key")))).alias("keys_hit_confirmed"),
        F.sort_array(F.collect_set("listed")).alias("listed_accessions"),
    )
    behind = united(evidence(found, records))
    out = attempts.join(matched, ASKED, "left").join(behind, ASKED, "left")
    for name in ("keys_hit", "keys_hit_confirmed", "listed_accessions", "sample_ids"):
        out = out.withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    paper = F.arrays_overlap("keys_hit", F.array(F.lit("pmid"), F.lit("doi")))
    return out.withColumn("overlap_level", F.when(F.size("keys_hit") > 0, F.when(F.size("sample_ids") > 0, "sample").otherwise("study"))).withColumn(
        "match_level", F.when(F.array_contains("keys_hit", "accession"), "dataset").when(paper, "publication")
    )


def first_answers(tables: DataFrame) -> DataFrame:
    """(id, collection, doi): of several tables (ord, row, dataset_id, collection_id, collection_doi) the first that has an id."""
    rows = tables.select(ids.accession(F.col("dataset_id")).alias("id"), ids.accession(F.col("collection_id")).alias("collection"), F.coalesce("collection_doi", F.lit("")).alias("doi"), "ord", "row")
    best = F.min_by(F.struct("collection", "doi"), F.struct("ord", "row"))
    return rows.groupBy("id").agg(best.alias("b")).select("id", "b.*")


def through_collections(records: DataFrame, answers: DataFrame) -> DataFrame:
    """Adds to each record the collections and DOIs of the ids in its ``join_cell``, after its own tokens, once.

    Many records share a cell, so answers are put together for each cell, and records are joined by it.
    """
    cells = records.select("join_cell").distinct().select("join_cell", F.posexplode(ids.accessions(F.col("join_cell"))).alias("at", "id"))
    joined = cells.join(answers, "id").groupBy("join_cell").agg(F.sort_array(F.collect_list(F.struct("at", "collection", "doi"))).alias("j"))
    rows = records.join(joined, "join_cell", "left").select(*records.columns, "j")
    more = lambda column: F.coalesce(column, F.array().cast("array<string>"))
    found = F.flatten(F.transform(F.col("j.doi"), ids.dois))
    return rows.withColumn("accessions", F.array_distinct(F.concat("accessions", more(F.col("j.collection"))))).withColumn("dois", F.array_distinct(F.concat("dois", more(found)))).drop("j", "join_cell")
