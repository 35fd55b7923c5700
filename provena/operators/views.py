"""What follows from findings: ledger, exposure, reuse, grids, grouped pages, review points.

``rows`` are findings with (model, stage, dataset, relation, verdict, by_design, reason, ...). Nothing here adds up
verdicts into a number for a model; counts of verdicts are given for one stage only, as a review aid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provena.functions import wording
from provena.operators.keys import CORPUS

# The order in which kinds of dataset are shown, and the parts of a review.
KINDS = ["perturbation", "observational", "multimodal", "spatial"]
REVIEW_CHECKS = ["paper", "manifest", "evaluated_on", "judgment_calls", "plausibility"]


def placed(value: Column, order: list[str]) -> Column:
    """Rank in a given order; others come last."""
    at = F.array_position(F.array(*map(F.lit, order)), value)
    return F.when(at > 0, at).otherwise(len(order) + 1)


def exposed(rows: DataFrame) -> DataFrame:
    """Findings that are exposure: PRESENT, and not by design."""
    return rows.where((F.col("verdict") == "PRESENT") & (F.coalesce("by_design", F.lit("")) == ""))


def evaluated_by(evaluated_on: DataFrame) -> DataFrame:
    """(dataset, evaluated_by): the models that evaluate on each dataset, sorted."""
    return evaluated_on.groupBy("dataset").agg(F.sort_array(F.collect_set("model")).alias("evaluated_by"))


def reuse(rows: DataFrame, evaluated_on: DataFrame) -> DataFrame:
    """(dataset, in_training_of, stage, evaluated_by): in one model's training data, and another evaluates on it."""
    trained = exposed(rows).select("dataset", F.col("model").alias("in_training_of"), "stage")
    judged = evaluated_on.select("dataset", F.col("model").alias("evaluated_by")).distinct()
    return trained.join(judged, "dataset").where("in_training_of <> evaluated_by")


def reuse_table(rows: DataFrame, evaluated_on: DataFrame) -> DataFrame:
    """One row for each dataset and training stage, with the sorted models that evaluate on it."""
    return reuse(rows, evaluated_on).groupBy("dataset", "in_training_of", "stage").agg(F.sort_array(F.collect_set("evaluated_by")).alias("evaluated_by"))


def grid(rows: DataFrame, models: list[str], datasets: DataFrame | None = None) -> DataFrame:
    """Datasets by models: each cell the stages' verdicts, in order of stage. With ``datasets``, all of them, by kind."""
    cell = F.concat_ws(": ", "stage", "verdict")
    out = rows.groupBy("dataset").pivot("model", models).agg(F.array_join(F.sort_array(F.collect_set(cell)), "; "))
    out = out.select("dataset", *(F.nullif(F.col(f"`{m}`"), F.lit("")).alias(m) for m in models))
    if datasets is None:
        return out
    return datasets.select("dataset", "name", "kind").join(out, "dataset", "left").orderBy(placed(F.col("kind"), KINDS), F.lower("name"), "dataset")


def grouped(rows: DataFrame) -> DataFrame:
    """Findings of a stage with one verdict and reason as one row, with the keys if all share them."""
    keys = F.coalesce(F.array_join("keys_attempted", ","), F.lit(""))
    return rows.withColumn("k", keys).groupBy(*CORPUS, "verdict", "by_design", "reason").agg(
        F.count("*").alias("n"), F.sort_array(F.collect_set("dataset")).alias("datasets"), F.when(F.count_distinct("k") == 1, F.min("k")).alias("shared_keys")
    )


def phrases(rows: DataFrame, corpora: DataFrame) -> DataFrame:
    """(model, stage, place, phrase): why findings of a stage are open, in a few words, by weight; ``in part`` where that isn't true of all its open findings."""
    open_ = rows.where(F.col("verdict").isin("INCONCLUSIVE", "NOT CHECKABLE")).withColumn("code", wording.why(F.col("reason")))
    per = open_.groupBy(*CORPUS, "code").agg(F.count("*").alias("n"))
    stage = Window.partitionBy(*CORPUS)
    per = per.withColumn("all", F.sum("n").over(stage)).where("code is not null").join(corpora.select(*CORPUS, "unresolved"), CORPUS, "left")
    some = F.size(F.coalesce("unresolved", F.array().cast("array<string>")))
    parts = F.when((F.col("code") == "unresolved_entries") & (some > 0), F.concat(some.cast("string"), F.lit(" "))).otherwise("")
    partly = F.when((F.col("n") < F.col("all")) & (F.col("code") != "unresolved_entries"), "in part: ").otherwise("")
    return per.select(*CORPUS, placed(F.col("code"), [*wording.PHRASES]).alias("place"), F.concat(partly, parts, wording.why_text(F.col("code"))).alias("phrase")).orderBy(*CORPUS, "place")


def cards(rows: DataFrame) -> DataFrame:
    """For each stage the reported evaluations in three columns: present, by design, and all else."""
    own = rows.where("relation = 'reported-eval'")
    kept = lambda test: F.sort_array(F.collect_set(F.when(test, F.col("dataset"))))
    design = F.coalesce("by_design", F.lit("")) != ""
    yes = F.col("verdict") == "PRESENT"
    return own.groupBy(*CORPUS).agg(kept(yes & ~design).alias("present"), kept(design).alias("by_design"), kept(~yes & ~design).alias("rest"))


def classes(models: DataFrame) -> DataFrame:
    """(place, model_class, models): a section for each class of model that has members, foundation models first; members by name."""
    group = F.when(F.col("model_class") == "task-specific", F.col("model_class")).otherwise("foundation")
    rows = models.withColumn("model_class", group).groupBy("model_class").agg(F.sort_array(F.collect_list(F.struct(F.lower("name").alias("k"), "model"))).alias("m"))
    return rows.select(placed(F.col("model_class"), ["foundation", "task-specific"]).alias("place"), "model_class", F.col("m.model").alias("models")).orderBy("place")


def dataset_rows(rows: DataFrame, models: DataFrame) -> DataFrame:
    """A dataset page's findings, in the order in which it shows them: (dataset, place, model, model_name, draft, stage, relation, verdict, evidence, identity, identity_basis)."""
    named = rows.drop("draft").join(models.select("model", F.col("name").alias("model_name"), "draft"), "model")
    order = F.row_number().over(Window.partitionBy("dataset").orderBy(F.lower("model_name"), "stage"))
    return named.select("dataset", order.alias("place"), "model", "model_name", "draft", "stage", "relation", "verdict", wording.evidence_text().alias("evidence"), "identity", "identity_basis")


def by_relation(rows: DataFrame) -> DataFrame:
    """For each stage and relation the findings, sorted by dataset."""
    return rows.groupBy(*CORPUS, "relation").agg(F.sort_array(F.collect_list(F.struct("dataset", "verdict"))).alias("findings"))


def judgment_calls(rows: DataFrame, datasets: DataFrame, corpora: DataFrame) -> DataFrame:
    """(model, dataset, stage, place, call): what rests on a person's judgment, in words; caveats are counted once for each model."""
    named = rows.join(datasets.select("dataset", "name"), "dataset", "left")
    subject = F.concat(F.coalesce(F.nullif(F.col("name"), F.lit("")), F.col("dataset")), F.lit(" in "), F.col("stage"))
    given = lambda name: F.coalesce(F.col(name), F.lit("")) != ""
    calls = [
        F.when(F.col("identity") == "provisional", F.lit("is the dataset meant")),
        F.when(F.size("keys_absent") > 0, F.concat(F.lit("has no "), wording.key_names(F.col("keys_absent"), " and no "))),
        F.when(given("identity_note"), F.lit("is what its paper was matched for")),
        F.when(given("by_design"), F.concat(F.lit("was left out of training in part: "), F.col("by_design"))),
    ]
    said = F.transform(F.array_compact(F.array(*calls)), lambda call: F.concat(subject, F.lit(": "), call))
    out = named.select("model", "dataset", "stage", F.posexplode(said).alias("place", "call"))
    nothing = F.lit(None).cast("string")
    caveats = corpora.groupBy("model").agg(F.sum(F.greatest(F.size("caveats"), F.lit(0))).alias("n")).where("n > 0")
    return out.unionByName(caveats.select("model", nothing.alias("dataset"), nothing.alias("stage"), F.lit(9).alias("place"), F.concat(F.lit("caveats as worded: "), F.col("n").cast("string")).alias("call")))


def review_points(t: dict[str, DataFrame], rows: DataFrame) -> DataFrame:
    """(model, check, place, point): what a reviewer looks at under each part of a review, from registry tables ``t`` and the ledger's rows.

    The paper's address and keys; for each corpus what was published and what of it can't be searched; the datasets of the paper's evaluations; judgment calls; and how many findings
    have each verdict.
    """
    point = lambda check, place, text: [F.lit(check).alias("check"), place.cast("long").alias("place"), text.alias("point")]
    names = t["datasets"].select("dataset", F.coalesce(F.nullif(F.col("name"), F.lit("")), F.col("dataset")).alias("shown"))
    p = F.from_json("paper", "journal string, published string, doi string, pmid string, openreview string, url string, preprint string, absent array<struct<key:string>>")
    paper = t["models"].withColumn("p", p)
    keys = [F.concat(F.lit(label + " "), F.col(f"p.{name}")) for name, label in (("doi", "DOI"), ("pmid", "PMID"), ("openreview", "OpenReview"), ("url", "at"))]
    lines = [
        F.concat_ws("; ", F.nullif(F.concat_ws(" ", "p.journal", "p.published"), F.lit("")), *keys),
        F.when(F.size("p.absent") > 0, F.concat(F.lit("said to have no "), wording.key_names(F.col("p.absent.key"), " and no "))),
        F.concat(F.lit("an earlier preprint is "), F.col("p.preprint")),
    ]
    papers = paper.select("model", F.posexplode(F.array(*lines)).alias("n", "line")).where("line <> ''").select("model", *point("paper", F.col("n"), F.col("line")))
    given = t["sources"].groupBy(*CORPUS).agg(
        F.sort_array(F.collect_list(F.struct("ord", F.concat(F.col("source"), F.coalesce(F.concat(F.lit(" of "), wording.counted(F.col("records")), F.lit(" rows")), F.lit(""))).alias("s")))).alias("g"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce(F.col("join_tables.name"), F.array().cast("array<string>")))))).alias("through"),
    )
    kept = t["splits"].groupBy(*CORPUS).agg(F.count_distinct("dataset").alias("kept"))
    c = t["corpora"].join(given, CORPUS, "left").join(kept, CORPUS, "left")
    target = F.from_json("pointer", "corpus string, release string")
    listed = F.concat_ws(", ", F.array_join(F.col("g.s"), " and "), F.concat(wording.counted(F.col("totals")["cells"]), F.lit(" cells in all")), F.when(F.size("through") > 0, F.concat(F.lit("joined through "), F.array_join("through", " and "))))
    what = (
        F.when(F.col("type") == "by-design", F.concat(F.lit("trains by design on evaluations of its own: "), F.coalesce("kept", F.lit(0)).cast("string")))
        .when(F.col("type").isin("C-vague", "D"), "published no list")
        .when(F.col("type") == "B", F.concat(F.lit("took part of "), F.concat_ws(" ", F.coalesce(target["corpus"], F.lit("a public corpus")), target["release"])))
        .otherwise(F.concat(F.lit("published "), listed))
    )
    closed = F.when(F.size("unresolved") > 0, F.concat(F.lit("names without their datasets: "), F.size("unresolved").cast("string")))
    manifest = c.select("model", "corpus_ord", "stage", F.posexplode(F.array(what, closed)).alias("n", "line")).where("line is not null")
    manifest = manifest.select("model", *point("manifest", F.col("corpus_ord") * 2 + F.col("n"), F.concat("stage", F.lit(": "), "line")))
    judged = t["evaluated_on"].groupBy("model", "dataset").agg(F.min("ord").alias("ord")).join(names, "dataset", "left")
    judged = judged.groupBy("model").agg(F.sort_array(F.collect_list(F.struct("ord", F.coalesce("shown", "dataset").alias("s")))).alias("e"))
    judged = judged.select("model", *point("evaluated_on", F.lit(0), F.concat(F.size("e").cast("string"), F.lit(": "), F.array_join("e.s", ", "))))
    calls = judgment_calls(rows, t["datasets"], t["corpora"])
    calls = calls.select("model", *point("judgment_calls", F.row_number().over(Window.partitionBy("model").orderBy(F.col("dataset").isNull(), "dataset", "stage", "place")) - 1, F.col("call")))
    per = rows.where("by_design is null").join(names, "dataset", "left").withColumn("shown", F.coalesce("shown", "dataset")).groupBy(*CORPUS).agg(
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("verdict") == "PRESENT", F.col("shown")))), ", ").alias("present"),
        *(F.count_if(F.col("verdict") == v).alias(v) for v in ("NOT PRESENT", "INCONCLUSIVE", "NOT CHECKABLE")),
    )
    others = [F.when(F.col(f"`{v}`") > 0, F.concat(F.lit(f"{v} "), F.col(f"`{v}`").cast("string"))) for v in ("NOT PRESENT", "INCONCLUSIVE", "NOT CHECKABLE")]
    per = per.join(t["corpora"].select(*CORPUS, "corpus_ord"), CORPUS)
    verdicts = per.select("model", *point("plausibility", F.col("corpus_ord"), F.concat_ws("; ", F.concat("stage", F.lit(": present "), F.coalesce(F.nullif(F.col("present"), F.lit("")), F.lit("none"))), *others)))
    out = papers
    for part in (manifest, judged, calls, verdicts):
        out = out.unionByName(part)
    return out


def in_order(rows: DataFrame) -> DataFrame:
    """Adds ``place``, from 1, among the findings of a stage: the model's own evaluations first, then by dataset."""
    order = Window.partitionBy(*CORPUS).orderBy(placed(F.col("relation"), ["reported-eval", "catalog"]), "dataset")
    return rows.withColumn("place", F.row_number().over(order))


def plausibility(rows: DataFrame) -> DataFrame:
    """(model, stage, present, counts): for one stage the datasets present and how many findings have each other verdict."""
    n = lambda v: F.count_if(F.col("verdict") == v)
    return rows.groupBy(*CORPUS).agg(
        F.sort_array(F.collect_set(F.when(F.col("verdict") == "PRESENT", F.col("dataset")))).alias("present"),
        n("NOT PRESENT").alias("not_present"), n("INCONCLUSIVE").alias("inconclusive"), n("NOT CHECKABLE").alias("not_checkable"),
    )


def confirmations(sources: DataFrame) -> DataFrame:
    """How many files each way of confirmation stands behind, and how many were supplied by hand."""
    return sources.groupBy("confirmation").agg(F.count("*").alias("files"), F.count_if(F.col("acquired") == "supplied").alias("supplied"))


def how_checked(sources: DataFrame, corpora: DataFrame, models: DataFrame, discovery: DataFrame) -> DataFrame:
    """(model, by_hash, by_snapshot, rerun, not_rerun, checks, unsearched): what the engine checks of a model, what a person has, and what is open.

    ``rerun`` are the stages all of whose files are committed; ``checks`` the review's parts with whether they are done, none for a draft.
    """
    how = sources.groupBy("model").agg(F.count_if(F.col("confirmation") == "url_hash").alias("by_hash"), F.count_if(F.col("confirmation") == "api_snapshot").alias("by_snapshot"))
    stage = sources.groupBy(*CORPUS).agg(F.bool_and(F.col("snapshot").isNotNull() | F.col("extract").isNotNull()).alias("all")).join(corpora.select(*CORPUS, "corpus_ord"), CORPUS)
    kept = lambda test: F.transform(F.sort_array(F.collect_list(F.when(test, F.struct("corpus_ord", "stage")))), lambda x: x["stage"])
    stages = stage.groupBy("model").agg(kept(F.col("all")).alias("rerun"), kept(~F.col("all")).alias("not_rerun"))
    open_ = discovery.where("not checked").groupBy("model").agg(F.sort_array(F.collect_set("location")).alias("unsearched"))
    done = lambda x: F.array_contains(F.coalesce("review_checked", F.array().cast("array<string>")), x) & ~F.col("draft")
    checks = F.transform(F.array(*map(F.lit, REVIEW_CHECKS)), lambda x: F.struct(x.alias("check"), done(x).alias("done")))
    rows = models.select("model", "draft", "review_checked")
    for part in (how, stages, open_):
        rows = rows.join(part, "model", "left")
    none = F.array().cast("array<string>")
    return rows.select("model", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("by_hash", "by_snapshot")), *(F.coalesce(c, none).alias(c) for c in ("rerun", "not_rerun")), checks.alias("checks"), F.coalesce("unsearched", none).alias("unsearched"))


def cell_counts(rows: DataFrame, dims: list[str]) -> DataFrame:
    """How many rows there are for each combination of some columns; rows with a null among them don't count."""
    return rows.na.drop(subset=dims).groupBy(*dims).agg(F.count("*").alias("n"))


def totals(records: DataFrame) -> DataFrame:
    """Rows, cells, distinct projects, rows without any token, and rows with several PMIDs, for each source."""
    bare = (F.size("accessions") == 0) & (F.size("pmids") == 0) & (F.size("dois") == 0)
    return records.groupBy(*CORPUS, "source").agg(
        F.count("*").alias("n_rows"), F.sum("cells").alias("cells"), F.count_distinct("project").alias("projects"), F.count_if(bare).alias("blank"), F.count_if(F.size("pmids") > 1).alias("several_pmids")
    )


def absent_projects(records: DataFrame) -> DataFrame:
    """(model, stage, source, other, projects): how many projects of one file of a list stand in no row of another file; no row where all do."""
    own = records.where("project is not null").groupBy(*CORPUS, "project").agg(F.collect_set("source").alias("own"))
    every = records.groupBy(*CORPUS).agg(F.collect_set("source").alias("every"))
    pairs = own.groupBy(*CORPUS, F.array_sort("own").alias("own")).agg(F.count("*").alias("n")).join(every, CORPUS)
    each = pairs.select(*CORPUS, "n", F.explode("own").alias("source"), F.array_except("every", "own").alias("others")).select(*CORPUS, "n", "source", F.explode("others").alias("other"))
    return each.groupBy(*CORPUS, "source", "other").agg(F.sum("n").alias("projects"))


def ledger(rows: DataFrame, datasets: DataFrame, evaluated_on: DataFrame) -> DataFrame:
    """One row for each dataset of the catalog: who trained on it, who evaluates on it, where they meet."""
    found = exposed(rows).groupBy("dataset").agg(F.sort_array(F.collect_list(F.struct("model", "stage"))).alias("exposure"))
    met = reuse(rows, evaluated_on).groupBy("dataset").agg(F.sort_array(F.collect_list(F.struct("in_training_of", "stage", "evaluated_by"))).alias("reuse"))
    out = datasets
    for part in (evaluated_by(evaluated_on), found, met):
        out = out.join(part, "dataset", "left")
    for name in ("evaluated_by", "exposure", "reuse"):
        out = out.withColumn(name, F.coalesce(name, F.array().cast(out.schema[name].dataType)))
    return out.orderBy("dataset")
