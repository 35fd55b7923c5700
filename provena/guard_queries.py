"""One query for each integrity rule, over a synthetic registry with faults of every kind.

Its tables are written once, in SQL that both engines read: ``TABLES``. Suppliers are models, parts datasets, and each (supplier, return flag,
part) of a line item is a recorded finding whose fields follow from its numbers, so that every rule is broken by some.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provena import sinks
from provena import synthetic as syn
from provena.catalog_queries import PARTS, query
from provena.operators import guards, versions

TODAY = "2026-10-01"
ALL_CHECKS = "['paper', 'manifest', 'evaluated_on', 'judgment_calls', 'plausibility']"
HASH = "'" + "a" * 64 + "'"
TABLES = {
    "g_models": f"""SELECT 'm' || CAST(s_suppkey AS STRING) AS model, CASE WHEN s_suppkey % 50 = 7 THEN 'other' ELSE 'm' || CAST(s_suppkey AS STRING) END AS file, CASE s_suppkey % 11 WHEN 3 THEN '' WHEN 4 THEN 'ZZ' ELSE 'QR' END AS reviewed_by,
        CASE WHEN s_suppkey % 3 = 0 THEN '2026-02-02' ELSE '2026-01-01' END AS reviewed_date, CASE WHEN s_suppkey % 9 = 2 THEN ['paper', 'manifest'] ELSE {ALL_CHECKS} END AS review_checked,
        CASE s_suppkey % 10 WHEN 6 THEN '{{"doi":"10.1/x","absent":[{{"key":"doi"}},{{"key":"pmid"}}]}}' WHEN 7 THEN '{{"pmid":"5","absent":[{{"key":"doi"}}]}}' ELSE '{{"doi":"10.1/x"}}' END AS paper,
        '{{"corpora":[' || CAST(s_suppkey % 4 AS STRING) || '],"evaluated_on":[]}}' AS doc, s_suppkey % 4 AS n FROM supplier
        UNION ALL SELECT 'm' || CAST(s_suppkey AS STRING), 'm' || CAST(s_suppkey AS STRING), 'QR', '2026-01-01', {ALL_CHECKS}, '{{"doi":"10.1/x"}}', '{{"corpora":[9],"evaluated_on":[]}}', 9 FROM supplier WHERE s_suppkey % 31 = 5""",
    "g_datasets": """SELECT 'd' || CAST(p_partkey AS STRING) AS dataset, CASE WHEN p_partkey % 97 = 5 THEN 'other' ELSE 'd' || CAST(p_partkey AS STRING) END AS file FROM part WHERE p_partkey % 19 <> 0""",
    "g_discovery": """SELECT 'm' || CAST(s_suppkey AS STRING) AS model, 'methods' AS location, s_suppkey % 6 <> 1 AS checked FROM supplier
        UNION ALL SELECT 'm' || CAST(s_suppkey AS STRING), 'archive_deposits', s_suppkey % 5 <> 2 FROM supplier""",
    "g_corpora": """SELECT model, stage, s, CASE WHEN type = 'A' AND s % 2 = 0 THEN 'A+' ELSE type END AS type, CASE WHEN s % 4 = 0 THEN '2024-01-15' WHEN s % 4 = 1 THEN 'unknown' ELSE '2026-03-01' END AS as_of,
        CASE s % 3 WHEN 0 THEN ['accession'] WHEN 1 THEN ['accession', 'pmid'] ELSE ['accession', 'pmid', 'doi'] END AS keys_available, CASE WHEN s % 2 = 0 THEN ['accession', 'pmid'] ELSE ['accession'] END AS requires_keys,
        CASE WHEN s % 4 = 3 THEN ['arrayexpress'] END AS accession_types, ['studies', 'samples'] AS sources, CASE s % 8 WHEN 1 THEN ['studies'] WHEN 2 THEN ['studies', 'samples', 'more'] ELSE ['samples', 'studies'] END AS sources_searched,
        CASE s % 5 WHEN 0 THEN ['studies'] WHEN 1 THEN ['samples', 'studies'] ELSE [] END AS unconfirmed, CASE WHEN s % 6 = 5 THEN ['one', 'two'] ELSE [] END AS unresolved FROM corpus""",
    "g_recorded": """SELECT model, stage, dataset, verdict, keys_attempted, keys_absent, matched_on, match_level, identity, identity_note, by_design FROM (
        SELECT 'm' || CAST(s AS STRING) AS model, 's' || f AS stage, 'd' || CAST(p AS STRING) AS dataset, CASE (s + p) % 5 WHEN 0 THEN 'PRESENT' WHEN 1 THEN 'NOT PRESENT' WHEN 2 THEN 'INCONCLUSIVE' WHEN 3 THEN 'NOT CHECKABLE' ELSE 'NOT PRESENT' END AS verdict,
        CASE p % 4 WHEN 0 THEN ['accession', 'pmid'] WHEN 1 THEN ['accession'] WHEN 2 THEN ['pmid', 'title'] ELSE ['title'] END AS keys_attempted, CASE WHEN p % 12 = 0 OR p % 7 = 1 THEN ['pmid'] ELSE [] END AS keys_absent,
        CASE (s + 2 * p) % 5 WHEN 0 THEN ['accession'] WHEN 1 THEN ['title'] WHEN 2 THEN ['pmid'] WHEN 3 THEN ['doi', 'accession'] ELSE [] END AS matched_on,
        CASE p % 3 WHEN 0 THEN 'dataset' WHEN 1 THEN 'publication' END AS match_level, CASE WHEN p % 8 = 3 THEN 'provisional' END AS identity, CASE WHEN p % 2 = 0 THEN 'seen' END AS identity_note,
        CASE WHEN s % 7 = 5 THEN 'part ' || CAST(p % 3 AS STRING) WHEN p % 53 = 1 THEN 'half' END AS by_design FROM (SELECT DISTINCT l_suppkey AS s, l_returnflag AS f, l_partkey AS p FROM lineitem) AS l
        UNION ALL SELECT 'm' || CAST(s AS STRING), 's' || f, 'd' || CAST(p AS STRING), 'INCONCLUSIVE', [], [], [], CAST(NULL AS STRING), CAST(NULL AS STRING), CAST(NULL AS STRING), CAST(NULL AS STRING) FROM (SELECT DISTINCT l_suppkey AS s, l_returnflag AS f, l_partkey AS p FROM lineitem) AS l WHERE p % 41 = 7) AS x""",
    "g_evaluated": """SELECT DISTINCT 'm' || CAST(l_suppkey AS STRING) AS model, 'd' || CAST(l_partkey + l_linenumber % 2 AS STRING) AS dataset FROM lineitem""",
    "g_splits": """SELECT DISTINCT 'm' || CAST(l_suppkey AS STRING) AS model, 's' || l_returnflag AS stage, 'd' || CAST(l_partkey + l_linenumber % 3 AS STRING) AS dataset, 'part ' || CAST((l_partkey + l_linenumber % 3) % 2 AS STRING) AS held_out
        FROM lineitem WHERE l_suppkey % 7 = 5""",
    "g_sources": f"""SELECT model, stage, CAST('studies' AS STRING) AS source, CASE WHEN s % 3 = 0 THEN 'lists/' || CAST(s % 9 AS STRING) || '.csv' END AS snapshot, CASE WHEN s % 3 = 1 THEN 'lists/' || CAST(s % 9 AS STRING) || '.csv' END AS extract, {HASH} AS sha256,
        CASE WHEN s % 2 = 0 THEN 'fetched' ELSE 'supplied' END AS acquired, ['id', 'paper'] AS columns, CASE WHEN s % 10 = 4 THEN ['id', 'pmid'] ELSE ['id', 'paper'] END AS used, CASE s % 12 WHEN 5 THEN 'id' WHEN 6 THEN 'link' END AS join_column FROM corpus""",
    # Committed files that are there, with their hash and the parent that they name.
    "g_files": f"""SELECT DISTINCT 'lists/' || CAST(s_suppkey % 9 AS STRING) || '.csv' AS path, CASE WHEN s_suppkey % 9 = 3 THEN 'changed' ELSE {HASH} END AS sha256, CASE WHEN s_suppkey % 9 = 1 THEN 'of another' ELSE {HASH} END AS parent FROM supplier WHERE s_suppkey % 9 NOT IN (4, 6)""",
    "g_fetched": f"""SELECT model, stage, 'studies' AS source, CASE s % 5 WHEN 0 THEN CAST(NULL AS STRING) WHEN 1 THEN 'changed' ELSE {HASH} END AS sha256 FROM corpus""",
    "g_before": """SELECT 'm' || CAST(s_suppkey AS STRING) AS model, 'QR' AS reviewed_by, '2026-01-01' AS reviewed_date, CASE WHEN s_suppkey % 2 = 0 THEN '[' || CAST(s_suppkey % 4 AS STRING) || ']' || chr(10) || '[]' ELSE 'earlier' END AS content FROM supplier""",
    "g_rerun": """SELECT 'm' || CAST(l_suppkey AS STRING) AS model, 's' || l_returnflag AS stage, 'd' || CAST(l_partkey AS STRING) AS dataset, 'cells' AS field, CAST(l_quantity AS STRING) AS recorded, CAST(NULL AS STRING) AS fresh FROM lineitem WHERE l_linenumber = 7""",
}
# What several statements read.
PARTS |= TABLES | {
    "g_known": "SELECT r.*, c.type, c.s, c.keys_available, c.requires_keys, c.accession_types, c.sources, c.sources_searched, c.unconfirmed, c.unresolved, r.stage || '/' || r.dataset AS place FROM g_recorded r JOIN (SELECT dataset FROM g_datasets) d USING (dataset) JOIN g_corpora c USING (model, stage)",
    "g_rows": "SELECT * FROM g_known WHERE by_design IS NULL AND type <> 'by-design'",
    "g_target": """SELECT r.model, r.stage, r.dataset, CASE i.type WHEN 'pmid' THEN 'pmid' WHEN 'doi' THEN 'doi' ELSE 'accession' END AS key, i.confirmed FROM (SELECT DISTINCT model, stage, dataset, accession_types FROM g_rows) r JOIN identifiers i USING (dataset)
        WHERE i.type <> 'url' AND i.confirmed IN ('true', 'provisional') AND (i.type IN ('pmid', 'doi') OR r.accession_types IS NULL OR list_contains(r.accession_types, i.type))""",
    "g_backed": "SELECT model, stage, dataset, list_distinct(list(key)) AS backed FROM g_target GROUP BY ALL",
    "g_prov": "SELECT model, stage, dataset, list(key) AS keys FROM (SELECT model, stage, dataset, key FROM g_target GROUP BY ALL HAVING bool_and(confirmed = 'provisional')) GROUP BY ALL",
    "g_full": """SELECT r.*, coalesce(b.backed, []) AS backed, CASE WHEN a.dataset IS NOT NULL AND list_contains(r.keys_available, 'pmid') AND NOT list_contains(r.keys_attempted, 'pmid') THEN ['pmid'] ELSE [] END AS derived
        FROM g_rows r LEFT JOIN g_backed b USING (model, stage, dataset) LEFT JOIN (SELECT DISTINCT dataset FROM absent) a USING (dataset)""",
    "g_open": "SELECT DISTINCT model FROM g_discovery WHERE NOT checked",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of ``TABLES`` in Spark."""
    return syn.both(spark, sf_dir, TABLES[name])


def issues(spark: SparkSession, sf_dir: str, code: str | None = None) -> DataFrame:
    """(severity, model, dataset, place) of the violations of one rule, or of all."""
    of = lambda name: table(spark, sf_dir, name)
    sources = of("g_sources").withColumn("roles", F.create_map(F.lit("accession"), "used"))
    sources = sources.withColumn("join_tables", F.array().cast("array<struct<name:string,snapshot:string,sha256:string>>"))
    t = {
        "models": of("g_models"), "datasets": of("g_datasets"), "discovery": of("g_discovery"), "corpora": of("g_corpora"), "recorded": of("g_recorded"), "evaluated_on": of("g_evaluated"), "splits": of("g_splits"), "sources": sources,
        "identifiers": syn.base(spark, sf_dir, "identifiers"), "absent": syn.base(spark, sf_dir, "absent"),
    }
    found = guards.issues(spark, t, {"QR"}, of("g_files"), TODAY, rerun=of("g_rerun"), fetched=of("g_fetched"), before=of("g_before"), codes={code} if code else None)
    return found.select("severity", "model", "dataset", "place")


def _lacks(a: str, b: str) -> str:
    """Whether list a holds something that list b doesn't."""
    return f"len(list_filter({a}, lambda x: NOT list_contains({b}, x))) > 0"


EXACT = "['accession', 'doi', 'pmid']"
EVERY = "len(list_intersect({0}, " + EXACT + ")) {1} 0"


def _from(where: str, rows: str = "g_rows", severity: str = "error") -> str:
    return f"SELECT '{severity}' AS severity, model, dataset, place FROM {rows} WHERE {where}"


def _of_models(sql: str, severity: str = "error", place: str = "''") -> str:
    return f"SELECT '{severity}' AS severity, model, CAST(NULL AS VARCHAR) AS dataset, {place} AS place FROM {sql}"


NO = "verdict = 'NOT PRESENT'"
RULES = {
    "G01": [_from(f"verdict = 'PRESENT' AND {EVERY.format('matched_on', '=')}"), _from(f"verdict IN ('PRESENT', 'NOT PRESENT') AND len(keys_attempted) > 0 AND {EVERY.format('keys_attempted', '=')}"), _from("matched_on = ['title'] AND verdict <> 'INCONCLUSIVE'")],
    "G02": ["SELECT 'error' AS severity, model, dataset, '' AS place FROM g_evaluated WHERE dataset NOT IN (SELECT dataset FROM g_datasets)", "SELECT 'error', model, dataset, stage || '/' || dataset FROM g_recorded WHERE dataset NOT IN (SELECT dataset FROM g_datasets)"],
    "G03": [_of_models("g_models m JOIN g_before b USING (model, reviewed_by, reviewed_date) WHERE '[' || m.n || ']' || chr(10) || '[]' <> b.content")],
    "G04": [_of_models("g_sources JOIN g_fetched f USING (model, stage, source) WHERE snapshot IS NULL AND f.sha256 = 'changed'", "error", "stage"), _of_models("g_sources g JOIN g_fetched f USING (model, stage, source) WHERE snapshot IS NULL AND (f.sha256 IS NULL OR f.sha256 = g.sha256 AND acquired = 'supplied')", "warning", "stage")],
    "G05": [_of_models("g_corpora WHERE as_of = '2024-01-15'", "warning", "stage")],
    "G07": [_of_models(f"g_corpora WHERE type IN ('A', 'A+') AND {_lacks('sources_searched', 'sources')}", place="stage")],
    "G08": [_from(f"{NO} AND type IN ('A', 'A+') AND {_lacks('sources', 'sources_searched')}")],
    "G09": [_from(f"{NO} AND len(unconfirmed) > 0"), _from(f"verdict = 'PRESENT' AND len(unconfirmed) > 0 AND NOT {_lacks('sources', 'unconfirmed')}")],
    "G10": [_of_models("g_models WHERE reviewed_by <> 'QR'")],
    "G11": [_from("verdict = 'NOT CHECKABLE' AND model IN (SELECT model FROM g_open)")],
    "G12": [_of_models("g_models WHERE model <> file"), "SELECT 'error', NULL, dataset, '' FROM g_datasets WHERE dataset <> file", _of_models("(SELECT model FROM g_models GROUP BY model HAVING count(*) > 1)")],
    "G13": [_from(f"{_lacks('list_concat(keys_attempted, matched_on)', 'keys_available')}"), _from(_lacks("matched_on", "keys_attempted"))],
    "G14": [
        _from(f"{NO} AND len(list_filter(requires_keys, lambda x: NOT list_contains(keys_attempted, x) AND NOT (list_contains(keys_absent, x) AND list_contains(derived, x)))) > 0", "g_full"),
        _from(f"{NO} AND len(list_filter(backed, lambda x: list_contains(keys_available, x) AND NOT list_contains(keys_attempted, x))) > 0", "g_full"),
    ],
    "G15": [_from(f"len(list_filter(keys_attempted, lambda x: list_contains({EXACT}, x) AND NOT list_contains(backed, x))) > 0", "g_full")],
    "G16": ["SELECT 'error' AS severity, model, dataset, stage || '/' || dataset AS place FROM g_recorded GROUP BY model, stage, dataset HAVING count(*) > 1"],
    "G17": ["SELECT 'warning' AS severity, model, dataset, '' AS place FROM g_evaluated e JOIN (SELECT dataset FROM g_datasets) USING (dataset) WHERE NOT EXISTS (SELECT 1 FROM g_recorded r WHERE r.model = e.model AND r.dataset = e.dataset)"],
    "G18": [_of_models(f"(SELECT DISTINCT model FROM g_rows WHERE {NO}) WHERE model IN (SELECT model FROM g_open)", "warning")],
    "G19": [_of_models(f"g_sources WHERE {_lacks('used', 'columns')}", place="stage"), _of_models("g_sources WHERE join_column = 'link'", place="stage")],
    "G20": [_of_models("g_sources g LEFT JOIN g_files f ON f.path = g.snapshot WHERE snapshot IS NOT NULL AND (f.sha256 IS NULL OR f.sha256 <> g.sha256)", place="stage")],
    "G21": [_from("verdict = 'PRESENT' AND identity_note IS NULL AND match_level = 'publication'"), _from("verdict = 'PRESENT' AND identity_note IS NULL AND match_level = 'dataset' AND NOT list_contains(matched_on, 'accession')")],
    "G22": [_of_models("g_sources g LEFT JOIN g_files f ON f.path = g.extract WHERE extract IS NOT NULL AND (f.parent IS NULL OR f.parent <> g.sha256)", place="stage")],
    "G23": [_from("identity IS DISTINCT FROM CASE WHEN len(list_intersect(coalesce(keys, []), keys_attempted)) > 0 THEN 'provisional' END", "g_rows LEFT JOIN g_prov USING (model, stage, dataset)")],
    "G24": [_from("keys_absent <> derived", "g_full"), "SELECT 'error', NULL, dataset, '' FROM absent JOIN (SELECT DISTINCT dataset FROM identifiers WHERE type = 'pmid' AND confirmed IN ('true', 'provisional')) USING (dataset)"],
    "G25": [_of_models("g_models WHERE reviewed_by = 'QR' AND len(review_checked) < 5", "warning")],
    "G26": ["SELECT 'error' AS severity, model, dataset, stage || '/' || dataset AS place FROM g_rerun"],
    "G27": [_of_models("g_models WHERE paper LIKE '%\"doi\":%\"absent\"%'")],
    "G28": [_from(f"{NO} AND len(unresolved) > 0")],
    "G29": [
        "SELECT 'error' AS severity, model, dataset, stage || '/' || dataset AS place FROM g_splits s WHERE NOT EXISTS (SELECT 1 FROM g_evaluated e WHERE e.model = s.model AND e.dataset = s.dataset)",
        "SELECT 'error', model, dataset, stage || '/' || dataset FROM g_splits s WHERE NOT EXISTS (SELECT 1 FROM g_recorded r WHERE r.model = s.model AND r.stage = s.stage AND r.dataset = s.dataset)",
        _from("by_design IS NOT NULL AND type <> 'by-design'", "g_known"),
        _from("type = 'by-design' AND by_design IS DISTINCT FROM held_out", "g_known LEFT JOIN g_splits USING (model, stage, dataset)"),
    ],
}

for _code, _parts in RULES.items():
    query(f"guard_{_code.lower()}", " UNION ALL ".join(_parts))(partial(issues, code=_code))


@query("guard_severities", "SELECT count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings FROM (" + " UNION ALL ".join(f"SELECT severity FROM ({' UNION ALL '.join(p)})" for p in RULES.values()) + ")")
def guard_severities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many errors and warnings all rules find."""
    return sinks.severities(issues(spark, sf_dir))


# Registry files of two states: of each supplier twelve lines, eight of them its own. Every fifth file has another name now, of which every second also changed two lines; every fifth one is new.
@query(
    "review_renames",
    """SELECT CASE WHEN s_suppkey % 5 = 0 THEN 'n' ELSE 'm' END || s_suppkey || CASE WHEN s_suppkey % 5 = 1 THEN 'x' ELSE '' END || '.yaml' AS file, CASE WHEN s_suppkey % 5 <> 1 THEN 'm' || s_suppkey || '.yaml' END AS before FROM supplier""",
)
def review_renames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which earlier file each registry file comes from."""
    k = F.col("s_suppkey")
    s = k.cast("string")
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    everywhere = F.array(*(F.lit(f"a line of every file, number {n}") for n in range(4)))
    own = lambda kind: F.transform(F.sequence(F.lit(1), F.lit(8)), lambda n: F.concat(F.when((kind == 2) | (kind == 1) & (n < 3), F.lit("now line ")).otherwise("line "), n.cast("string"), F.lit(" of "), s, F.lit(", "), F.col("s_name")))
    text = lambda kind: F.array_join(F.concat(everywhere, own(kind)), "\n")
    before = rows.select(F.concat(F.lit("m"), s, F.lit(".yaml")).alias("file"), text(F.lit(0)).alias("text"))
    name = F.concat(F.when(k % 5 == 0, "n").otherwise("m"), s, F.when(k % 5 == 1, "x").otherwise(""), F.lit(".yaml"))
    now = rows.select(name.alias("file"), text(F.when(k % 10 == 0, 1).when(k % 5 == 1, 2).otherwise(0)).alias("text"))
    return versions.renamed(now, before)
