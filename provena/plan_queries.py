"""Queries over whole registry folders with published lists: regions are models, brands datasets, and each region's list has the orders that its suppliers took part in.

There are as many of both at any size; the lists grow with the tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provena import sinks
from provena import synthetic as syn
from provena.catalog_queries import PARTS, flat, query, read
from provena.operators import guards, keys, views
from provena.plans import ledger as ledgers
from provena.plans import lookup as lookups
from provena.plans import registry as registries
from provena.plans import validate as validation
from provena.shared import new_path, written
from provena.sources import catalog, files

KEYS = ["accession"]
PLACES = ["data_availability", "code_availability", "supplementary_files", "methods", "github_repo", "hf_model_card", "hf_dataset_card", "archive_deposits", "preprint_vs_published"]
# A brand is known by its first order, and a region's list has the orders of its suppliers.
PARTS |= {
    "q_brand": "SELECT 'b' || substr(p_brand, 7) AS dataset, p_brand AS name, min(l_orderkey) AS k FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY p_brand",
    "q_list": "SELECT DISTINCT 'n' || n_regionkey AS model, l_orderkey AS k FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey",
    "q_cell": "SELECT m.model, m.n, b.dataset, b.k, l.k IS NOT NULL AS held FROM (SELECT 'n' || r_regionkey AS model, r_regionkey AS n FROM region) m CROSS JOIN q_brand b LEFT JOIN q_list l ON l.model = m.model AND l.k = b.k",
}


def entries(regions: list[int], brands: list[tuple[str, str, int]]) -> Iterator[tuple[str, str]]:
    """The YAML of some regions and brands."""
    for dataset, name, k in brands:
        yield f"datasets/{dataset}.yaml", yaml.safe_dump({"schema_version": 1, "id": dataset, "name": name, "kind": "observational", "identifiers": [{"type": "geo", "value": f"GSE{k}", "confirmed": True}]})
    for n in regions:
        source = {"name": "studies", "url": f"https://lists.example/n{n}.csv", "extract": f"lists/n{n}.csv", "sha256": f"{n:064d}", "acquired": "fetched", "confirmation": {"method": "url_hash"}, "columns": ["study", "note"], "roles": {"accession": ["study"], "project": "study"}, "records": 1000 + n}
        result = {"checked": "2026-02-01", "sources_searched": ["studies"], "findings": [], "caveats": ["c"] * (n % 2)}
        manifest = {"type": "A", "quote": "q", "as_of": "2026-01-31", "resolver": "table", "keys_available": KEYS, "requires_keys": KEYS, "sources": [source], "unresolved_entries": [{"entry": "x", "kind": "collection"}] * (n % 5 == 3)}
        paper = {"doi": f"10.1000/n{n}", "journal": "J. Maps", "published": "2026-01"}
        doc = {"schema_version": 3, "id": f"n{n}", "model": f"Region {n}", "model_class": "foundation", "paper": paper, "discovery": {p: {"checked": True, "found": False} for p in PLACES}, "evaluated_on": [{"dataset": "b11"}, {"dataset": "b22"}]}
        yield f"registry/n{n}.yaml", yaml.safe_dump(doc | {"corpora": [{"stage": "training", "manifest": manifest, "result": result}], "review": {"by": "QR" if n % 4 else "", "date": "2026-02-02", "checked": views.REVIEW_CHECKS}})


def folder(spark: SparkSession, sf_dir: str) -> str:
    """The registry folder, all of its files written by tasks."""
    item, root = read(spark, sf_dir, "lineitem"), new_path(spark, "regions")
    brands = item.join(read(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey")).groupBy("p_brand").agg(F.min("l_orderkey").alias("k"))
    studies = item.join(read(spark, sf_dir, "supplier"), F.col("s_suppkey") == F.col("l_suppkey")).join(read(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    studies = written(studies.select("n_regionkey", "l_orderkey").distinct(), "studies")

    def docs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            regions = frame["n"].dropna().astype(int).tolist()
            own = frame.dropna(subset=["brand"])
            brands = [("b" + b[6:], b, int(k)) for b, k in zip(own["brand"], own["k"], strict=True)]
            yield pd.DataFrame([*entries(regions, brands)], columns=["name", "body"])

    nothing = F.lit(None)
    wanted = read(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("n"), nothing.cast("string").alias("brand"), nothing.cast("long").alias("k"))
    wanted = wanted.union(brands.select(nothing.cast("long"), "p_brand", F.col("k").cast("long")))
    files.write(wanted.mapInPandas(docs, "name string, body string").union(spark.createDataFrame([("reviewers.yaml", "reviewers:\n- initials: QR\n")], "name string, body string")), root)

    # A list is one file by its nature, so each is put together from ranges.
    for (n,) in read(spark, sf_dir, "region").select("r_regionkey").orderBy("r_regionkey").collect():
        lines = studies.where(F.col("n_regionkey") == n).select("l_orderkey", F.concat(F.lit("GEO-GSE"), F.col("l_orderkey").cast("string"), F.lit(',"of one\norder"')).alias("line"))
        files.joined(lines, ["l_orderkey"], f"{root}/lists/n{n}.csv", [f"# derived-from-sha256: {n:064d}", "study,note"])
    return root


VERDICT = "CASE WHEN held THEN 'PRESENT' WHEN n % 5 = 3 THEN 'INCONCLUSIVE' ELSE 'NOT PRESENT' END"
CODE = "CASE WHEN held THEN 'present' WHEN n % 5 = 3 THEN 'unresolved_entries' ELSE 'not_present' END"


@query("check_plan", f"SELECT model, 'training' AS stage, dataset, CASE WHEN dataset IN ('b11', 'b22') THEN 'reported-eval' ELSE 'catalog' END AS relation, {VERDICT} AS verdict, {CODE} AS code, 'accession' AS keys_attempted, CASE WHEN held THEN 'accession' ELSE '' END AS matched_on FROM q_cell")
def check_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every brand in every region's list, in one call over the folder."""
    rows = registries.check(spark, folder(spark, sf_dir))
    return rows.select("model", "stage", "dataset", "relation", "verdict", "code", flat("keys_attempted").alias("keys_attempted"), flat("matched_on").alias("matched_on"))


@query("check_restricted", f"SELECT model, dataset, {VERDICT} AS verdict FROM q_cell WHERE model IN ('n3', 'n4') AND dataset IN ('b11', 'b23', 'b22')")
def check_restricted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The named models and datasets only; the other lists aren't read."""
    return registries.check(spark, folder(spark, sf_dir), ["n3", "n4"], ["b11", "b23", "b22"]).select("model", "dataset", "verdict")


ANSWERS = f"SELECT b.dataset AS query_id, c.model, {CODE} AS code, {VERDICT} AS verdict FROM q_brand b JOIN q_cell c USING (dataset) WHERE c.n % 4 <> 0"


def _typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every brand's name, as a person types it."""
    brands = read(spark, sf_dir, "part").select("p_brand").distinct()
    return brands.select(F.concat(F.lit("b"), F.substring("p_brand", 7, 9)).alias("query_id"), F.concat(F.lit("  "), F.upper("p_brand")).alias("raw"))


@query("lookup_lists", ANSWERS)
def lookup_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every brand looked up by name in the reviewed regions, over their lists."""
    return lookups.lookup(spark, folder(spark, sf_dir), _typed(spark, sf_dir)).answers.select("query_id", "model", "code", "verdict")


@query("lookup_index", ANSWERS)
def lookup_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a stored index of the folder; no list is read."""
    path = new_path(spark, "index")
    lookups.build_index(spark, folder(spark, sf_dir), path, buckets=8)
    return lookups.lookup_stored(spark, path, _typed(spark, sf_dir)).answers.select("query_id", "model", "code", "verdict")


@query("validate_plan", """SELECT code, severity, model, dataset FROM (SELECT 'G10' AS code, 'warning' AS severity, 'n' || r_regionkey AS model, CAST(NULL AS VARCHAR) AS dataset FROM region WHERE r_regionkey % 4 = 0
    UNION ALL SELECT 'G17', 'warning', 'n' || r_regionkey, d FROM region, (VALUES ('b11'), ('b22')) AS x(d))""")  # fmt: skip
def validate_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rules at once: unreviewed entries, and evaluations without a finding."""
    return validation.validate(spark, folder(spark, sf_dir), today="2026-03-01", allow_draft=True).select("code", "severity", "model", "dataset")


@query("files_checked", """SELECT 'datasets' AS kind, (SELECT count(*) FROM q_brand) AS files, 0 AS errors, 0 AS warnings UNION ALL SELECT 'registry', count(*), 0, 2 * count(*) + count(*) FILTER (r_regionkey % 4 = 0) FROM region""")
def files_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = folder(spark, sf_dir)
    return sinks.checked(catalog.documents(spark, root), validation.validate(spark, root, today="2026-03-01", allow_draft=True))


@query("review_lists", """SELECT 'n' || r_regionkey AS model, check_, place, point FROM (SELECT r_regionkey, 'paper' AS check_, 0 AS place, 'J. Maps 2026-01; DOI 10.1000/n' || r_regionkey AS point FROM region
    UNION ALL SELECT r_regionkey, 'manifest', 0, 'training: published studies of ' || format('{:,}', 1000 + r_regionkey) || ' rows' FROM region
    UNION ALL SELECT r_regionkey, 'manifest', 1, 'training: names without their datasets: 1' FROM region WHERE r_regionkey % 5 = 3
    UNION ALL SELECT r_regionkey, 'evaluated_on', 0, '2: Brand#11, Brand#22' FROM region UNION ALL SELECT r_regionkey, 'judgment_calls', 0, 'caveats as worded: 1' FROM region WHERE r_regionkey % 2 = 1)""")  # fmt: skip
def review_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reviewer looks at, for each region."""
    t = catalog.load(spark, folder(spark, sf_dir))
    return views.review_points(t, ledgers.build(t).rows).withColumnRenamed("check", "check_")


@query("issue_order", """SELECT model, code, dataset, row_number() OVER (PARTITION BY model ORDER BY severity, code, dataset) AS place FROM (SELECT model, 'error' AS severity, 'G02' AS code, dataset FROM evaluated_on WHERE CAST(substr(dataset, 2) AS BIGINT) % 17 = 0
    UNION ALL SELECT 'm' || s_suppkey, 'warning', 'G05', '' FROM supplier UNION ALL SELECT 'm' || s_suppkey, 'error', 'G12', '' FROM supplier)""")  # fmt: skip
def issue_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's violations in the order in which they are shown: errors first, then by rule and place."""
    known = syn.base(spark, sf_dir, "datasets").where(F.substring("dataset", 2, 20).cast("long") % 17 != 0)
    rows = guards.dangling(syn.base(spark, sf_dir, "evaluated_on"), known).select("model", F.lit("error").alias("severity"), F.lit("G02").alias("code"), F.col("dataset").alias("place"))
    model = F.concat(F.lit("m"), F.col("s_suppkey").cast("string"))
    for severity, code in (("warning", "G05"), ("error", "G12")):
        rows = rows.union(read(spark, sf_dir, "supplier").select(model, F.lit(severity), F.lit(code), F.lit("")))
    return guards.numbered(rows).select("model", "code", F.col("place").alias("dataset"), F.col("n").alias("place"))


@query("finding_order", "SELECT model, stage, dataset, row_number() OVER (PARTITION BY model, stage ORDER BY CASE WHEN e.dataset IS NULL THEN 1 ELSE 0 END, dataset) AS place FROM pairs p LEFT JOIN evaluated_on e USING (model, dataset)")
def finding_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings of a stage in the order of a report: the model's own evaluations first, then by dataset."""
    rows = keys.related(syn.pairs(spark, sf_dir), syn.base(spark, sf_dir, "evaluated_on"))
    return views.in_order(rows).select("model", "stage", "dataset", "place")


@query("projects_absent", "SELECT model, stage, a AS source, CASE a WHEN 'studies' THEN 'samples' ELSE 'studies' END AS other, count(*) AS projects FROM (SELECT model, stage, k, min(s) AS a FROM (SELECT DISTINCT model, stage, k, source AS s FROM row_ WHERE NOT (source = 'samples' AND k % 4 = 1) AND NOT (source = 'studies' AND (k % 4 = 2 OR k NOT IN (SELECT o_orderkey FROM orders)))) GROUP BY ALL HAVING count(*) = 1) GROUP BY ALL")
def projects_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projects of one file of a list that its other file lacks; a quarter of the projects is taken out of each file for that."""
    k = F.regexp_extract("project", r"(\d+)$", 1).cast("long")
    rows = syn.records(spark, sf_dir).where(~((F.col("source") == "samples") & (k % 4 == 1)) & ~((F.col("source") == "studies") & (k % 4 == 2)))
    return views.absent_projects(rows)
