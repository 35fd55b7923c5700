"""Queries over whole tables: each against its SQL on small tables, and that nothing asked for is left out."""

from collections import Counter

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from provena import catalog_queries
from provena.shared import noted

PARTS, SUPPLIERS, ORDERS = 40, 16, 450


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    """Part 3k of size 7 and others, papers and series that orders name, and line items that leave most triples out."""
    folder = tmp_path_factory.mktemp("sf")
    lines = [(k, k * 7 % PARTS, (k * 5 + n) % SUPPLIERS, n, float(k % 50 + 1), "ANR"[(k + n) % 3]) for k in range(ORDERS) for n in (1, 2)]
    lines += [(p * 11, p, (p + 3) % SUPPLIERS, 3, 2.0, "A") for p in range(PARTS)]
    put = {
        "part": {"p_partkey": range(PARTS), "p_name": [f"blue lace {k % 3}" for k in range(PARTS)], "p_size": [k % 9 + 1 for k in range(PARTS)], "p_brand": ["B1"] * PARTS, "p_type": ["T"] * PARTS},
        "supplier": {"s_suppkey": range(SUPPLIERS)}, "orders": {"o_orderkey": range(ORDERS)},
        "lineitem": dict(zip(("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag"), zip(*lines, strict=True), strict=True)),
    }
    for name, columns in put.items():
        pq.write_table(pa.table({c: list(v) for c, v in columns.items()}), folder / f"{name}.parquet")
    return folder


def both(spark, folder, name):
    """The rows of the query, after they were found equal to those of its SQL."""
    rows = catalog_queries.QUERIES[name](spark, str(folder))
    got = rows.collect()
    with duckdb.connect() as c:
        for table in ("part", "supplier", "orders", "lineitem"):
            c.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
        want = c.execute(catalog_queries.SQL[name])
        assert rows.columns == [d[0] for d in want.description]
        assert Counter(map(tuple, got)) == Counter(want.fetchall())
    return got


def test_every_order_is_interpreted(spark, tables):
    rows = both(spark, tables, "query_interpretation")
    assert {r.query_id for r in rows if r.linked_from is None} == {str(k) for k in range(ORDERS)}
    by_way = Counter(int(r.query_id) % 5 for r in rows if r.catalog_id and r.linked_from is None)
    assert by_way[2] == by_way[4] == ORDERS // 5 and by_way[3] > 0
    assert any(r.catalog_id for r in rows if r.linked_from)


def test_every_answer_is_returned(spark, tables):
    rows = both(spark, tables, "lookup_answers")
    assert len(rows) == PARTS * SUPPLIERS * 3
    assert {r.code for r in rows} >= {"recorded", "by_design_stage", "no_manifest", "present", "not_present", "unconfirmed_source", "superset"}
    assert all(r.recorded == (r.code == "recorded") for r in rows)


def test_the_grid_has_all_datasets_and_models(spark, tables):
    rows = both(spark, tables, "dataset_grid")
    cells = [c for r in rows for s in ("sA", "sN", "sR") for c in (r[s] or "").split("; ") if c]
    assert {r.dataset for r in rows} == {f"d{p}" for p in range(PARTS)} and {c.split(": ")[0] for c in cells} == {f"m{s}" for s in range(SUPPLIERS)}
    found = catalog_queries.QUERIES["check_findings"](spark, str(tables)).count()
    assert len(cells) == found


#: Views that verdicts alone decide, with the tables that they store.
VIEWS = {
    "dataset_grid": ["corpora"],
    "stage_cards": ["corpora"],
    "ledger_rows": ["corpora", "exposure"],
    "reuse_map": ["corpora"],
    "reuse_table": ["corpora"],
    "group_findings_by_reason": ["corpora"],
    "stage_plausibility": ["corpora"],
    "unconfirmed_cap": ["corpora"],
    "exposure_rows": ["corpora"],
    "superset_cap": ["corpora"],
}


@pytest.mark.parametrize("name", VIEWS)
def test_views_store_no_list_and_no_pairs(spark, tables, name):
    with noted() as paths:
        both(spark, tables, name)
    assert sorted(p.rpartition("/")[2].rpartition("-")[0] for p in paths) == VIEWS[name]


def test_verdicts_are_those_of_findings(spark, tables):
    shown = ["model", "stage", "dataset", "relation", "verdict", "code", "keys_attempted", "keys_absent", "matched_on", "by_design"]
    t = catalog_queries.syn.tables(spark, str(tables))
    one = catalog_queries.findings(t, catalog_queries.syn.pairs(spark, str(tables))).select(shown)
    two = catalog_queries.verdicts(t, catalog_queries.syn.lines(spark, str(tables)), related=True).select(shown)
    assert Counter(map(str, one.collect())) == Counter(map(str, two.collect()))


def test_records_with_collections_move_once(spark, tables):
    """Records are dealt by project, not once more by model, stage and row."""
    both(spark, tables, "lookup_join_records")
    plan = catalog_queries.QUERIES["lookup_join_records"](spark, str(tables))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(project" in plan and "hashpartitioning(model" not in plan


def test_lists_are_parsed_and_stored_once(spark, tables):
    """Findings, the lookup and the stored index read one table of records."""
    with noted() as paths:
        catalog_queries.lookup_answers(spark, tables)
    assert sum("/records-" in p for p in paths) == 1


def test_findings_are_dealt_once_for_all_rules(spark, tables):
    """Rules on recorded findings read one table, in which it stands whether a dataset is known and how often a finding occurs, and shuffle nothing for it."""
    from provena import guard_queries
    from provena.operators import guards

    of = lambda name: guard_queries.table(spark, str(tables), f"g_{name}")
    t = {name: of(name) for name in ("models", "datasets", "corpora", "recorded", "discovery", "splits")} | {"evaluated_on": of("evaluated")}
    t["sources"] = of("sources").selectExpr("*", "map('accession', used) as roles", "cast(array() as array<struct<name:string,snapshot:string,sha256:string>>) as join_tables")
    t |= {name: guard_queries.syn.base(spark, str(tables), name) for name in ("identifiers", "absent")}
    found = guards.issues(spark, t, {"QR"}, of("files"), guard_queries.TODAY, codes={"G16", "G23"})
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    twice = t["recorded"].groupBy("model", "stage", "dataset").count().where("count > 1").count()
    assert found.where("code = 'G16'").count() == twice > 0
