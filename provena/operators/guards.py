"""Integrity constraints: each one a query whose rows are the violations.

``issues`` runs them over the tables of a registry; the small functions before it are the query shapes that they share.
Rows are (code, severity, model, dataset, place, message). Entries that break their structure (G00) are left out of all later rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from provena.functions import identifiers as ids
from provena.functions import wording
from provena.operators.keys import CORPUS, exact, filled, searchable
from provena.operators.views import REVIEW_CHECKS
from provena.shared import written

ISSUES = "code string, severity string, model string, dataset string, place string, message string"
# Rules that only warn.
WARNINGS = ["G05", "G17", "G18", "G25"]


def dangling(rows: DataFrame, known: DataFrame, on: str = "dataset") -> DataFrame:
    """The rows whose reference doesn't exist."""
    return rows.join(known.select(on).distinct(), on, "left_anti")


def numbered(issues: DataFrame) -> DataFrame:
    """Adds ``n``, from 1, among a model's violations: errors first, then by rule and place."""
    return issues.withColumn("n", F.row_number().over(Window.partitionBy("model").orderBy("severity", "code", "place")))


def repeated(rows: DataFrame, on: list[str]) -> DataFrame:
    """Keys that occur more than once, and how often."""
    return rows.groupBy(*on).agg(F.count("*").alias("n")).where("n > 1")


def missing_keys(attempts: DataFrame, corpora: DataFrame) -> DataFrame:
    """The attempts with required keys that are neither attempted nor recorded as not existing."""
    rows = attempts.join(corpora.select(*CORPUS, "requires_keys"), CORPUS)
    rest = F.array_except(F.array_except(filled(F.col("requires_keys")), F.col("keys_attempted")), F.col("keys_absent"))
    return rows.withColumn("missing", F.sort_array(rest)).where(F.size("missing") > 0)


def stale(rows: DataFrame, today: str, months: int, date: str = "as_of") -> DataFrame:
    """Rows whose date is more than so many calendar months ago."""
    return rows.withColumn("months", wording.months_since(F.col(date), F.lit(today).cast("date"))).where(F.col("months") > months)


def content(doc: Column) -> Column:
    """What the findings of an entry rest on: its corpora and its evaluations, as they stand in its JSON."""
    part = lambda name: F.coalesce(F.get_json_object(doc, f"$.{name}"), F.lit(""))
    return F.concat(part("corpora"), F.lit("\n"), part("evaluated_on"))


def _issue(rows: DataFrame, code: str, message: Column, place: Column | None = None) -> DataFrame:
    have = lambda c: F.col(c) if c in rows.columns else F.lit(None).cast("string")
    severity = "warning" if code in WARNINGS else "error"
    return rows.select(F.lit(code).alias("code"), F.lit(severity).alias("severity"), have("model").alias("model"), have("dataset").alias("dataset"), (place if place is not None else F.lit("")).alias("place"), message.alias("message"))


def _gathered(t: dict[str, DataFrame]) -> DataFrame:
    """The recorded findings with what rules hold against them: whether their dataset is in the catalog, what their corpus says, the keys that usable identifiers back, those that only provisional ones do, and those recorded as not existing.

    Corpora are broadcast, a row for each, and a dataset's identifiers come as an array, so findings are dealt once, by dataset.
    """
    col = F.col
    corpora = t["corpora"].select(*CORPUS, "type", "keys_available", "requires_keys", "accession_types", "sources", "sources_searched", "unconfirmed", "unresolved")
    own = searchable(t["identifiers"]).groupBy("dataset").agg(F.collect_list(F.struct("key", "type", "confirmed")).alias("ids"))
    none = t["absent"].where(col("key").isin(ids.EXACT_KEYS)).groupBy("dataset").agg(F.collect_set("key").alias("none"))
    catalog = t["datasets"].select("dataset").distinct().withColumn("in_catalog_", F.lit(True))
    rows = t["recorded"].join(F.broadcast(corpora), CORPUS, "left").join(catalog, "dataset", "left").join(own, "dataset", "left").join(none, "dataset", "left")
    fits = lambda x: (x["key"] != "accession") | col("accession_types").isNull() | F.array_contains("accession_types", x["type"])
    rows = rows.withColumn("ids", F.filter("ids", fits)).withColumn("backed", filled(F.array_distinct(col("ids.key"))))
    rows = rows.withColumn("provisional", F.filter("backed", lambda k: F.forall("ids", lambda x: (x["key"] != k) | (x["confirmed"] == "provisional"))))
    return rows.withColumn("in_catalog_", F.coalesce("in_catalog_", F.lit(False))).drop("ids")


def issues(spark: SparkSession, t: dict[str, DataFrame], reviewers: set[str], files: DataFrame, today: str, stale_months: int = 12, allow_draft: bool = False, broken: list[tuple[str, str]] | None = None, rerun: DataFrame | None = None, fetched: DataFrame | None = None, before: DataFrame | None = None, codes: set[str] | None = None) -> DataFrame:
    """All violations of the rules over registry tables ``t`` (see ``provena.sources.catalog``), or of those in ``codes``.

    ``files`` is (path, exists, sha256, parent) of committed files; ``broken`` are (id, message) of malformed entries; ``rerun``
    are differences from a fresh run; ``fetched`` is (model, stage, source, sha256 or null) of sources fetched anew; ``before`` is the earlier
    (model, reviewed_by, reviewed_date, content) for comparison, with the ``content`` of its documents.
    """
    bad = [b for b, _ in broken or []]
    t = {k: v.where(~F.col("model").isin(bad)) if bad and "model" in v.columns else v for k, v in t.items()}
    say, col, shown = F.lit, F.col, wording.shown_list
    out = [spark.createDataFrame([("G00", "error", b, None, "", m) for b, m in broken or []], ISSUES)]

    def add(rows: DataFrame, code: str, *more: Column) -> None:
        if codes is None or code in codes:
            out.append(_issue(rows, code, *more))

    models, corpora, datasets = t["models"], t["corpora"], t["datasets"]
    place = F.concat_ws("/", "stage", "dataset")
    every, stored = _gathered(t), codes is None or len(codes) > 1
    if stored:
        # Some thirty rules read these rows.
        one = Window.partitionBy(*CORPUS, "dataset")
        every = written(every.withColumn("times_", F.count("*").over(one)).withColumn("nth_", F.row_number().over(one.orderBy("verdict"))), "findings")

    # Names and references.
    add(models.where("model <> file"), "G12", F.concat(say("the id must equal the file name "), col("file")))
    add(datasets.where("dataset <> file"), "G12", F.concat(say("the id must equal the file name "), col("file")))
    add(repeated(models, ["model"]), "G12", say("the id is used more than once"))
    add(dangling(t["evaluated_on"], datasets), "G02", say("evaluated dataset is not in the catalog"))
    add(every.where("not in_catalog_"), "G02", say("dataset of a finding is not in the catalog"), place)
    add(every.where("times_ > 1 and nth_ = 1") if stored else repeated(t["recorded"], [*CORPUS, "dataset"]), "G16", say("the dataset appears more than once in this corpus"), place)

    # Reviews.
    if codes is None or "G10" in codes:
        draft = _issue(models.where("reviewed_by = ''"), "G10", say("the entry is not reviewed"))
        out.append(draft.withColumn("severity", say("warning")) if allow_draft else draft)
    add(models.where((col("reviewed_by") != "") & ~col("reviewed_by").isin(sorted(reviewers) or [""])), "G10", say("the reviewer is not listed"))
    left = F.array_except(F.array(*map(F.lit, REVIEW_CHECKS)), filled(col("review_checked")))
    add(models.where(col("reviewed_by").isin(sorted(reviewers) or [""]) & (col("reviewed_by") != "")).withColumn("left", left).where(F.size("left") > 0), "G25", F.concat(say("the review did not cover "), F.array_join("left", ", ")))
    gives = F.from_json("paper", "doi string, pmid string, absent array<struct<key:string>>")
    paper = models.withColumn("p", gives).withColumn("key", F.explode(F.array_distinct(filled(col("p.absent.key")))))
    add(paper.where((col("key") == "doi") & col("p.doi").isNotNull() | (col("key") == "pmid") & col("p.pmid").isNotNull()), "G27", F.concat(say("the paper gives and denies its "), col("key")))
    if before is not None:
        now = models.select("model", "reviewed_by", "reviewed_date", content(col("doc")).alias("content"))
        old = before.select("model", *(col(c).alias(f"old_{c}") for c in ("reviewed_by", "reviewed_date", "content")))
        same = col("reviewed_by").eqNullSafe(col("old_reviewed_by")) & col("reviewed_date").eqNullSafe(col("old_reviewed_date"))
        add(now.join(old, "model").where((col("reviewed_by") != "") & same & (col("content") != col("old_content"))), "G03", say("findings changed under an unchanged review"))

    # Sources.
    add(stale(corpora, today, stale_months), "G05", F.concat(say("as_of is "), col("months").cast("string"), say(" months old")), col("stage"))
    sources, f = t["sources"], files
    committed = sources.where("snapshot is not null").select(*CORPUS, col("snapshot").alias("path"), "sha256")
    tables = sources.select(*CORPUS, F.explode("join_tables").alias("j")).select(*CORPUS, col("j.snapshot").alias("path"), "j.sha256")
    for rows in (committed, tables):
        joined = rows.join(f.withColumnRenamed("sha256", "found"), "path", "left")
        add(joined.where("found is null or found <> sha256"), "G20", F.concat(col("path"), say(" is missing or has another hash")), col("stage"))
    extracts = sources.where("extract is not null").select(*CORPUS, col("extract").alias("path"), "sha256").join(f.select("path", "parent"), "path", "left")
    add(extracts.where("parent is null or parent <> sha256"), "G22", F.concat(col("path"), say(" is missing or names another file")), col("stage"))
    named = sources.where("columns is not null").withColumn("odd", F.array_except(F.flatten(F.map_values("roles")), "columns"))
    add(named.where(F.size("odd") > 0), "G19", F.concat(say("roles name missing columns "), shown(col("odd"))), col("stage"))
    add(sources.where(col("join_column").isNotNull() & ~F.array_contains(filled(col("columns")), col("join_column"))), "G19", say("the join column is not among the columns"), col("stage"))
    if fetched is not None and (codes is None or "G04" in codes):
        new = sources.where("snapshot is null").join(fetched.withColumnRenamed("sha256", "found"), [*CORPUS, "source"])
        changed = _issue(new.where("found is null or found <> sha256 or acquired = 'supplied'"), "G04", F.when(col("found").isNull(), "the source can't be reached").when(col("found") != col("sha256"), "the source has changed").otherwise("the supplied file equals the source, and could be recorded as fetched"), col("stage"))
        out.append(changed.withColumn("severity", F.when(col("message") == "the source has changed", "error").otherwise("warning")))
    listed = corpora.where("type in ('A', 'A+')").withColumn("odd", F.array_except(filled(col("sources_searched")), filled(col("sources"))))
    add(listed.where(F.size("odd") > 0), "G07", F.concat(say("searched sources that the list doesn't have: "), shown(col("odd"))), col("stage"))

    # By-design stages.
    own = t["evaluated_on"].select("model", "dataset").distinct()
    add(t["splits"].join(own, ["model", "dataset"], "left_anti"), "G29", say("a by-design split must be one of the model's own evaluations"), place)
    theirs = every.join(F.broadcast(t["splits"].select(*CORPUS).distinct()), CORPUS, "left_semi")  # at most a row for each corpus
    add(t["splits"].join(theirs, [*CORPUS, "dataset"], "left_anti"), "G29", say("the split has no finding"), place)
    known = every.where("in_catalog_ and type is not null")
    design = known.where("by_design is not null or type = 'by-design'")
    add(design.where("type <> 'by-design'"), "G29", say("by_design is only for a by-design stage"), place)
    said = design.where("type = 'by-design'").join(t["splits"].select(*CORPUS, "dataset", "held_out"), [*CORPUS, "dataset"], "left")
    add(said.where(~col("by_design").eqNullSafe(col("held_out"))), "G29", say("by_design differs from the split"), place)

    # Findings of searched lists.
    rows = known.where("by_design is null and type <> 'by-design'")
    for name in ("keys_attempted", "keys_absent", "matched_on", "keys_available", "requires_keys", "sources", "sources_searched", "unconfirmed", "unresolved"):
        rows = rows.withColumn(name, filled(col(name)))
    tried, hit, v = col("keys_attempted"), col("matched_on"), col("verdict")
    some = lambda a: F.size(a) > 0
    weak = some(hit) & ~some(F.array_except(hit, F.array(*map(F.lit, ids.WEAK_KEYS))))
    derived = F.sort_array(F.array_except(F.array_intersect(filled(col("none")), exact(col("keys_available"))), "keys_attempted"))
    rows = rows.withColumn("derived", derived)
    add(rows.where((v == "PRESENT") & ~some(exact(hit))), "G01", say("PRESENT needs a match on an exact key"), place)
    add(rows.where(v.isin("PRESENT", "NOT PRESENT") & some(tried) & ~some(exact(tried))), "G01", say("only inexact keys were tried"), place)
    add(rows.where(weak & (v != "INCONCLUSIVE")), "G01", say("a match on inexact keys must be INCONCLUSIVE"), place)
    add(rows.where(some(col("keys_available")) & some(F.array_except(F.array_union(tried, hit), "keys_available"))), "G13", say("keys that the list doesn't have"), place)
    add(rows.where(some(F.array_except(hit, tried))), "G13", say("matched keys must have been attempted"), place)
    add(rows.where(some(F.array_except(exact(tried), "backed"))), "G15", say("an attempted key has no usable identifier"), place)
    add(rows.where(F.sort_array("keys_absent") != col("derived")), "G24", F.concat(say("keys_absent should be "), shown(col("derived"))), place)
    both = t["absent"].join(t["identifiers"].where("confirmed in ('true', 'provisional')").select("dataset", ids.identifier_key(col("type")).alias("key")).distinct(), ["dataset", "key"], "left_semi")
    add(both, "G24", F.concat(col("key"), say(" is recorded as not existing beside a usable one")))
    no = rows.where(v == "NOT PRESENT")
    rest = F.array_except(F.array_except("requires_keys", "keys_attempted"), F.array_intersect("keys_absent", "derived"))
    add(no.where(some(rest)), "G14", say("required keys were not attempted"), place)
    add(no.where(some(F.array_except(F.array_intersect("backed", exact(col("keys_available"))), "keys_attempted"))), "G14", say("a usable key was not attempted"), place)
    add(no.where(col("type").isin("A", "A+") & some(F.array_except("sources", "sources_searched"))), "G08", say("sources were not searched"), place)
    add(no.where(some(col("unconfirmed"))), "G09", say("absence rests on an unconfirmed source"), place)
    add(rows.where((v == "PRESENT") & some(col("unconfirmed")) & ~some(F.array_except("sources", "unconfirmed"))), "G09", say("every source is unconfirmed"), place)
    add(no.where(some(col("unresolved"))), "G28", say("entries of the list can't be searched"), place)
    bare = rows.where((v == "PRESENT") & (F.coalesce("identity_note", say("")) == ""))
    add(bare.where("match_level = 'publication'"), "G21", say("a match on the paper needs an identity note"), place)
    add(bare.where((col("match_level") == "dataset") & ~F.array_contains("matched_on", "accession")), "G21", say("a match on the dataset needs an accession"), place)
    again = rows.withColumnRenamed("identity", "recorded").withColumn("identity", F.when(F.arrays_overlap("provisional", "keys_attempted"), "provisional"))
    add(again.where(~col("identity").eqNullSafe(col("recorded"))), "G23", F.concat(say("identity should be "), F.coalesce("identity", say("confirmed"))), place)
    unchecked = t["discovery"].where("not checked").select("model").distinct()
    add(rows.where(v == "NOT CHECKABLE").join(F.broadcast(unchecked), "model", "left_semi"), "G11", say("places of publication are unchecked"), place)
    add(no.select("model").distinct().join(unchecked, "model"), "G18", say("absences while places of publication are unchecked"))
    seen = every.select("model", "dataset").distinct()
    add(t["evaluated_on"].join(datasets.select("dataset"), "dataset", "left_semi").join(seen, ["model", "dataset"], "left_anti"), "G17", say("an evaluated dataset has no finding"))
    if rerun is not None:
        add(rerun, "G26", F.concat(col("field"), say(" is recorded as "), F.coalesce("recorded", say("none")), say(", and comes out as "), F.coalesce("fresh", say("none"))), place)
    result = out[0] if broken or len(out) == 1 else out[1]
    for part in out[1 if broken else 2 :]:
        result = result.unionByName(part)
    return result
