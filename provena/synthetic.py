"""A synthetic registry over the benchmark tables, the same in both engines that compare results.

Suppliers are models, return flags stages, parts datasets, orders the studies of a list and line items its samples.
``BASE`` holds SQL that both engines read; ``tables`` builds the operators' inputs from it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provena.functions import identifiers as ids
from provena.plans.check import Tables

BASE = {
    "study": """SELECT DISTINCT 'm' || CAST(l_suppkey AS STRING) AS model, 's' || l_returnflag AS stage, l_orderkey AS k FROM lineitem""",
    "sample": """SELECT 'm' || CAST(l_suppkey AS STRING) AS model, 's' || l_returnflag AS stage, l_orderkey AS k, l_linenumber AS n,
        CAST(sum(l_quantity) AS BIGINT) AS cells FROM lineitem GROUP BY l_suppkey, l_returnflag, l_orderkey, l_linenumber""",
    "cell": """SELECT o_orderkey AS k, CASE o_orderkey % 7 WHEN 0 THEN '' WHEN 1 THEN CAST(o_orderkey % 2000 + 1 AS STRING)
        WHEN 2 THEN CAST(o_orderkey % 2000 + 1 AS STRING) || ' || ' || CAST(o_orderkey % 1999 + 1 AS STRING)
        WHEN 3 THEN CAST(o_orderkey % 2000 + 1 AS STRING) || ';' || CAST(o_orderkey % 1999 + 1 AS STRING)
        WHEN 4 THEN 'doi:10.1000/x' || CAST(o_orderkey % 2000 AS STRING) || '.' WHEN 5 THEN CAST(o_orderkey % 2000 + 1 AS STRING) || '.0'
        ELSE ' n/a ' END AS pmid_cell FROM orders""",
    "pairs": """SELECT DISTINCT 'm' || CAST(l_suppkey AS STRING) AS model, 's' || l_returnflag AS stage, 'd' || CAST(l_partkey AS STRING) AS dataset FROM lineitem""",
    "identifiers": """SELECT 'd' || CAST(p_partkey AS STRING) AS dataset, CAST(0 AS BIGINT) AS ord, 'geo' AS type, 'gse' || CAST(p_partkey * 11 AS STRING) AS value,
            CASE p_size % 5 WHEN 3 THEN 'provisional' WHEN 4 THEN 'false' ELSE 'true' END AS confirmed, 'base ' || p_brand AS basis FROM part
        UNION ALL SELECT 'd' || CAST(p_partkey AS STRING), CAST(1 AS BIGINT), 'pmid', CAST(p_partkey + 1 AS STRING), CASE WHEN p_size % 7 = 3 THEN 'provisional' ELSE 'true' END, 'paper ' || p_type FROM part WHERE p_partkey % 3 <> 0
        UNION ALL SELECT 'd' || CAST(p_partkey AS STRING), CAST(2 AS BIGINT), 'doi', ' 10.1000/X' || CAST(p_partkey AS STRING), 'true', CAST(NULL AS STRING) FROM part WHERE p_partkey % 4 = 0
        UNION ALL SELECT 'd' || CAST(p_partkey AS STRING), CAST(3 AS BIGINT), 'url', 'https://example.org/' || CAST(p_partkey AS STRING), 'true', CAST(NULL AS STRING) FROM part WHERE p_partkey % 5 = 0""",
    "absent": """SELECT 'd' || CAST(p_partkey AS STRING) AS dataset, 'pmid' AS key FROM part WHERE p_partkey % 6 = 0""",
    "corpus": """SELECT 'm' || CAST(s_suppkey AS STRING) AS model, 's' || f AS stage, s_suppkey AS s,
        CASE s_suppkey % 7 WHEN 1 THEN 'A+' WHEN 2 THEN 'B' WHEN 3 THEN 'C-vague' WHEN 4 THEN 'D' WHEN 5 THEN 'by-design' ELSE 'A' END AS type,
        s_suppkey % 7 <> 2 AS can_prove_presence FROM supplier CROSS JOIN (SELECT DISTINCT l_returnflag AS f FROM lineitem) AS flags""",
    "evaluated_on": """SELECT DISTINCT 'm' || CAST(l_suppkey AS STRING) AS model, 'd' || CAST(l_partkey AS STRING) AS dataset FROM lineitem WHERE l_linenumber % 2 = 0""",
    "datasets": """SELECT 'd' || CAST(p_partkey AS STRING) AS dataset, p_name || ' ' || CAST(p_partkey AS STRING) AS name,
        CASE p_size % 4 WHEN 0 THEN 'perturbation' WHEN 1 THEN 'observational' WHEN 2 THEN 'multimodal' ELSE 'spatial' END AS kind FROM part""",
}


def base(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of ``BASE``."""
    sql, given = BASE[name], {}
    for table in ("lineitem", "orders", "part", "supplier"):
        if f"FROM {table}" in sql:
            given[table] = spark.read.parquet(f"{sf_dir}/{table}.parquet")
            sql = sql.replace(f"FROM {table}", f"FROM {{{table}}}")
    return spark.sql(sql, **given)


def both(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A statement over the driver's tables or ``corpus``, in the words that both engines read but for lists: [...] is array(...) here."""
    # Between quotes nothing changes.
    parts = sql.split("'")
    parts[::2] = [p.replace("[]", "CAST(array() AS array<string>)").replace("[", "array(").replace("]", ")") for p in parts[::2]]
    sql, given = "'".join(parts).replace("{", "{{").replace("}", "}}"), {}
    for source in ("lineitem", "orders", "part", "supplier", "corpus"):
        if f"FROM {source}" in sql:
            given[source] = spark.read.parquet(f"{sf_dir}/{source}.parquet") if source != "corpus" else base(spark, sf_dir, source)
            sql = sql.replace(f"FROM {source}", f"FROM {{{source}}}")
    return spark.sql(sql, **given)


def corpora(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpora with their key lists, unconfirmed files and entries that can't be searched."""
    rows = base(spark, sf_dir, "corpus")
    lit = lambda *v: F.array(*map(F.lit, v)) if v else F.array().cast("array<string>")
    s = F.col("s")
    have = F.when(s % 3 == 0, lit("accession")).when(s % 3 == 1, lit("accession", "pmid")).otherwise(lit("accession", "pmid", "doi"))
    rows = rows.withColumn("keys_available", have).withColumn("requires_keys", F.when(s % 2 == 0, have).otherwise(lit("accession")))
    rows = rows.withColumn("accession_types", F.when(s % 4 == 3, lit("arrayexpress"))).withColumn("unconfirmed", F.when(s % 5 == 0, lit("studies")).otherwise(lit()))
    return rows.withColumn("unresolved", F.when(s % 6 == 5, lit("e1", "e2", "e3", "e4")).otherwise(lit())).withColumn("unsearched", lit()).drop("s")


def raw_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both files' rows as a publisher would print them: (model, stage, source, row, project, sample, pmid, cells).

    Line items are dealt by project once: the samples of a project, its studies and their cells then meet where they are, and so does what is joined by project later.
    """
    named = lambda c: F.concat(F.lit("GEO-GSE"), F.col(c).cast("string")).alias("project")
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    lines = lines.select(named("l_orderkey"), F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), "l_suppkey", "l_returnflag", "l_quantity").repartition("project")
    each = lines.groupBy("project", "k", "l_suppkey", "l_returnflag", "n").agg(F.sum("l_quantity").cast("long").alias("cells"))
    study = each.groupBy("project", "k", "l_suppkey", "l_returnflag").agg(F.collect_list(F.struct("n", "cells")).alias("samples"))
    papers = base(spark, sf_dir, "cell").select(named("k"), "pmid_cell").groupBy("project").agg(F.collect_list("pmid_cell").alias("papers"))
    shape = "array<struct<source:string,row:bigint,sample:string,pmid:string,cells:string>>"
    text = lambda c: c.cast("string")
    number = lambda s: F.col("k") * 10 + s["n"]
    one = F.transform("papers", lambda p: F.struct(F.lit("studies"), F.col("k").cast("long"), text(F.lit(None)), p, text(F.lit(None)))).cast(shape)
    two = F.transform("samples", lambda s: F.struct(F.lit("samples"), number(s).cast("long"), F.concat(F.lit("GEO-GSM"), text(number(s))), text(F.lit(None)), F.concat(s["cells"], F.lit(".0")))).cast(shape)
    rows = study.join(papers, "project", "left").withColumn("r", F.explode(F.concat(F.coalesce(one, F.array().cast(shape)), two)))
    model, stage = F.concat(F.lit("m"), text(F.col("l_suppkey"))), F.concat(F.lit("s"), F.col("l_returnflag"))
    return rows.select(model.alias("model"), stage.alias("stage"), "r.source", "r.row", "project", "r.sample", "r.pmid", "r.cells")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = raw_list(spark, sf_dir)
    found = F.array_distinct(F.concat(ids.accessions(F.col("project")), ids.accessions(F.col("sample"))))
    return rows.select("model", "stage", "source", "row", "project", "sample", ids.cells(F.col("cells")).alias("cells"), found.alias("accessions"), ids.pmids(F.col("pmid")).alias("pmids"), ids.dois(F.col("pmid")).alias("dois"))


def splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By-design stages train on every third dataset that they are asked about."""
    design = base(spark, sf_dir, "corpus").where("type = 'by-design'").select("model", "stage")
    part = F.substring("dataset", 2, 20).cast("long")
    rows = base(spark, sf_dir, "pairs").join(F.broadcast(design), ["model", "stage"], "left_semi").where(part % 3 == 0)
    return rows.withColumn("held_out", F.concat(F.lit("part "), (part % 2).cast("string")))


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    b = lambda name: base(spark, sf_dir, name)
    return Tables(corpora(spark, sf_dir), b("identifiers"), b("absent"), records(spark, sf_dir), b("evaluated_on"), splits(spark, sf_dir))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The triples that the synthetic registry asks about: those that share a line item, not all of ``plans.check.all_pairs``."""
    return base(spark, sf_dir, "pairs")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pairs`` as line items have them, a triple as often as it has line items."""
    x = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return rows.select(x("m", "l_suppkey").alias("model"), x("s", "l_returnflag").alias("stage"), x("d", "l_partkey").alias("dataset"))
