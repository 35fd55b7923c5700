"""Matching, verdicts, checks, guards, views and lookups over small tables and a small registry."""

import copy
import json
import os
import shutil
import subprocess
import sys
import zipfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from provena.operators import compare, lookup, matching, verdict, views
from provena.plans import lookup as lookups
from provena.plans import registry as plans
from provena.plans.validate import validate
from provena.sources import catalog, crosswalk, files, lists

from . import toy

# Each condition of the decision table, and its code.
CASES = [
    (dict(type="by-design"), "by_design_stage"), (dict(type="C-vague"), "no_manifest"), (dict(type="D"), "no_manifest"), (dict(checkable=False), "no_manifest"),
    (dict(unconfirmed=["s"]), "unconfirmed_source"), (dict(unconfirmed=["s"], keys_hit=["accession"]), "unconfirmed_source"), (dict(unconfirmed=["s"], keys_hit=["accession", "pmid"], keys_hit_confirmed=["accession"]), "present"),
    (dict(unconfirmed=["s"], keys_hit=["accession", "pmid"], keys_hit_confirmed=["pmid"]), "same_publication"), (dict(keys_hit=["accession"], can_prove_presence=False), "superset"), (dict(keys_hit=["pmid"], can_prove_presence=False), "superset"),
    (dict(keys_hit=["pmid"]), "same_publication"), (dict(keys_hit=["doi"], listed_accessions=["GSE1"]), "same_publication"), (dict(keys_hit=["accession"]), "present"), (dict(keys_hit=["title"]), "weak_only"),
    (dict(unsearched=["x"], keys_attempted=["accession"]), "unsearched"), (dict(), "no_exact_key"), (dict(keys_attempted=["title"]), "no_exact_key"), (dict(keys_attempted=["accession"], requires_keys=["accession", "pmid"]), "missing_required_key"),
    (dict(keys_attempted=["accession"], requires_keys=["accession", "pmid"], keys_absent=["pmid"]), "not_present"), (dict(keys_attempted=["accession"], unresolved=["a"]), "unresolved_entries"),
    (dict(keys_attempted=["accession"], unresolved=["a", "b", "c", "d"]), "unresolved_entries"), (dict(keys_attempted=["accession"], requires_keys=["accession"]), "not_present"),
]


def test_decision_table(spark):
    shape = "k long, type string, checkable boolean, can_prove_presence boolean, " + ", ".join(f"{a} array<string>" for a in verdict.ARRAYS)
    rows = [(k, c.get("type", "A"), c.get("checkable", True), c.get("can_prove_presence", True), *(c.get(a) for a in verdict.ARRAYS)) for k, (c, _) in enumerate(CASES)]
    got = {r.k: r for r in verdict.decided(spark.createDataFrame(rows, shape)).collect()}
    assert [got[k].code for k in range(len(CASES))] == [code for _, code in CASES]
    assert {c for _, c in CASES} == set(verdict.VERDICTS)
    for k, (_, code) in enumerate(CASES):
        assert got[k].verdict == verdict.VERDICTS[code] and (got[k].reason is None) == (code in ("present", "not_present"))
    assert "a, b, c and 1 more" in got[20].reason and got[19].reason.startswith("no match, but 1 entry of")


RECORD = "model string, stage string, source string, row long, project string, sample string, cells long, accessions array<string>, pmids array<string>, dois array<string>"


def test_evidence_widens_studies_only(spark):
    rows = [
        ("m", "s", "study", 1, "GEO-GSE1", None, None, ["GSE1"], ["7"], []), ("m", "s", "samples", 1, "GEO-GSE1", "GEO-GSM1", 10, ["GSE1", "GSM1"], [], []),
        ("m", "s", "samples", 2, "GEO-GSE1", "GEO-GSM2", 5, ["GSE1", "GSM2"], [], []), ("m", "t", "samples", 3, "GEO-GSE1", "GSM3", 100, ["GSE1", "GSM3"], [], []), ("m", "s", "study", 2, None, None, None, [], ["7"], []),
    ]
    records = spark.createDataFrame(rows, RECORD)
    asked = lambda value, key: spark.createDataFrame([("m", "s", "d", key, value)], "model string, stage string, dataset string, key string, value string")
    attempts = spark.createDataFrame([("m", "s", "d", ["accession", "pmid"], [])], "model string, stage string, dataset string, keys_attempted array<string>, keys_absent array<string>")
    corpora = spark.createDataFrame([("m", "s", ["samples"])], "model string, stage string, unconfirmed array<string>")

    def found(value, key):
        targets = asked(value, key)
        return matching.summary(attempts, matching.matches(targets, attempts, records), records, corpora).first()

    by_pmid = found("7", "pmid")
    assert by_pmid.sample_ids == ["GSM1", "GSM2"] and by_pmid.cells == 15 and by_pmid.match_level == "publication" and by_pmid.overlap_level == "sample"
    by_sample = found("GSM1", "accession")
    assert by_sample.sample_ids == ["GSM1"] and by_sample.cells == 10 and by_sample.keys_hit_confirmed == []
    by_series = found("GSE1", "accession")
    assert by_series.cells == 15 and by_series.keys_hit_confirmed == ["accession"] and by_series.listed_accessions == ["GSE1"]
    none = found("GSE90", "accession")
    assert none.keys_hit == [] and none.cells is None and none.overlap_level is None
    plan = matching.hits(asked("7", "pmid"), attempts, records)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_first_table_wins(spark):
    tables = spark.createDataFrame([("AAAAAAAA-0000-0000-0000-000000000001", "c1", None, 0, 5), ("aaaaaaaa-0000-0000-0000-000000000001", "c2", "10.1000/x", 1, 1)], "dataset_id string, collection_id string, collection_doi string, ord int, row int")
    answers = matching.first_answers(tables)
    assert [tuple(r) for r in answers.collect()] == [("aaaaaaaa-0000-0000-0000-000000000001", "C1", "")]
    rec = spark.createDataFrame([("m", "s", "f", 1, None, "x", None, ["X1"], [], [], "aaaaaaaa-0000-0000-0000-000000000001"), ("m", "s", "f", 2, None, "y", None, [], [], [], None)], RECORD + ", join_cell string")
    got = {r.row: (r.accessions, r.dois) for r in matching.through_collections(rec, answers).collect()}
    assert got == {1: (["X1", "C1"], [""][:0]), 2: ([], [])}


def test_check_of_a_small_registry(spark, tmp_path):
    root = toy.write(tmp_path, [toy.entry(tmp_path), toy.draft(tmp_path)])
    got = {(r.stage, r.dataset): r for r in plans.check(spark, root).collect()}
    listed = {d: (got["pretraining", d].verdict, got["pretraining", d].code) for d in toy.DATASETS}
    assert listed == {
        "harbor-atlas": ("PRESENT", "present"), "meadow-screen": ("INCONCLUSIVE", "missing_required_key"), "reef": ("INCONCLUSIVE", "same_publication"), "canyon": ("INCONCLUSIVE", "same_publication"),
        "tundra": ("NOT PRESENT", "not_present"), "lagoon": ("NOT PRESENT", "not_present"), "orchard": ("INCONCLUSIVE", "no_exact_key"),
    }
    harbor, reef, canyon = (got["pretraining", d] for d in ("harbor-atlas", "reef", "canyon"))
    assert harbor.cells == 42 and harbor.sample_ids == ["SRR1", "SRR2"] and harbor.relation == "reported-eval" and reef.relation == "catalog"
    assert reef.sample_ids == ["SRR3"] and "DRP8999" in reef.reason and canyon.identity == "provisional" and canyon.identity_basis == "named in a talk of its authors"
    assert got["pretraining", "tundra"].keys_absent == ["pmid"] and got["tuning", "meadow-screen"].code == "by_design" and len([k for k in got if k[0] == "tuning"]) == 1
    assert {r.code for (s, _), r in got.items() if s == "first"} == {"no_manifest"}
    second = {d: got["second", d].code for d in toy.DATASETS}
    assert second.pop("meadow-screen") == "superset" and second.pop("lagoon") == "not_present" and set(second.values()) == {"missing_required_key", "no_exact_key"}
    assert got["second", "meadow-screen"].cells == 100
    assert plans.rerun(spark, root).count() == 0
    found = {(r.code, r.severity, r.model) for r in validate(spark, root, today="2026-10-01", allow_draft=True).collect()}
    assert found == {("G10", "warning", "south")}
    from provena.plans.check import as_findings

    out = {r.dataset: json.loads(r.finding) for r in as_findings(plans.check(spark, root, models=["north"], datasets=["harbor-atlas", "lagoon"])).collect()}
    assert out["harbor-atlas"]["samples"] == 2 and "reason" not in out["lagoon"] and set(out) == {"harbor-atlas", "lagoon"}
    with pytest.raises(KeyError):
        plans.check(spark, root, models=["nobody"])
    (root / "extracts/runs.csv").write_text("# changed\n")
    with pytest.raises(lists.SourceError):
        plans.check(spark, root)
    assert {(r.model, r.stage) for r in plans.check(spark, root, skip=True).collect()} == {("north", "tuning"), ("south", "first"), ("south", "second")}


def _set(path, value):
    def change(doc):
        *way, last = path
        for k in way:
            doc = doc[k]
        if value is None:
            doc.pop(last)
        else:
            doc[last] = value

    return change


A, F0, F1 = ["corpora", 0, "manifest"], ["corpora", 0, "result", "findings", 0], ["corpora", 0, "result", "findings", 1]
SEARCHED, TUNED = ["corpora", 0, "result", "sources_searched"], ["corpora", 1, "result", "findings", 0]
MUTATIONS = [
    ("G00", _set([*A, "quote"], None)), ("G00", _set([*F1, "verdict"], "PERHAPS")), ("G01", _set([*F0, "matched_on"], ["title"])), ("G02", _set([*F0, "dataset"], "no-such")), ("G02", _set(["evaluated_on", 2, "dataset"], "no-such")),
    ("G05", _set([*A, "as_of"], "2025-01-31")), ("G07", lambda d: d["corpora"][0]["result"]["sources_searched"].append("a third list")), ("G08", _set(SEARCHED, ["runs"])),
    ("G09", lambda d: d["corpora"][0]["manifest"]["sources"][1].update(confirmation={"method": "none"}, acquired="supplied", supplied_by="a reader")), ("G10", _set(["review", "by"], " ")), ("G10", _set(["review", "by"], "XX")),
    ("G11", _set([*F1, "verdict"], "NOT CHECKABLE")), ("G12", _set(["id"], "renamed")), ("G13", _set([*F0, "keys_attempted"], ["accession", "doi"])), ("G14", _set([*F1, "keys_attempted"], ["pmid"])), ("G15", _set([*F0, "keys_attempted"], ["accession", "doi"])),
    ("G16", _set([*F1, "dataset"], "harbor-atlas")), ("G17", lambda d: d["evaluated_on"].append({"dataset": "orchard"})), ("G18", _set(["discovery", "methods"], {"checked": False})), ("G19", _set([*A, "sources", 1, "roles", "cells"], "n_cells")),
    ("G20", _set([*A, "sources", 0, "snapshot"], "snapshots/gone.csv")), ("G21", _set([*F0, "match_level"], "publication")), ("G22", _set([*A, "sources", 1, "sha256"], "0" * 64)), ("G23", lambda d: d["corpora"][0]["result"]["findings"][1].update(identity="provisional", identity_basis="a guess")),
    ("G24", _set([*F1, "keys_absent"], ["doi"])), ("G25", _set(["review", "checked"], ["manifest", "paper"])), ("G26", _set([*F0, "cells"], 41)), ("G26", _set([*F0, "sample_ids"], ["SRR2"])), ("G27", _set(["paper", "absent"], [{"key": "doi"}])),
    ("G28", _set([*A, "unresolved_entries"], [{"entry": "a consortium's release", "kind": "collection"}])), ("G29", _set([*TUNED, "by_design"], "one donor")), ("G29", _set([*F0, "by_design"], "half")), ("G29", _set(["corpora", 1, "manifest", "splits"], [{"dataset": "reef", "held_out": "x"}])),
]


@pytest.fixture(scope="module")
def fired(spark, tmp_path_factory):
    """The codes that each mutated entry gives, all entries in one registry."""
    root, docs = tmp_path_factory.mktemp("mutated"), []
    for k, (code, change) in enumerate(MUTATIONS):
        doc = copy.deepcopy(toy.entry(root)) | {"id": f"m{k}"}
        if code == "G11":
            doc["discovery"]["github_repo"] = {"checked": False}
        change(doc)
        docs.append(doc)
    toy.write(root, docs)
    (root / "registry/renamed.yaml").rename(root / "registry/other.yaml")
    out: dict[str, set] = {}
    for r in validate(spark, root, today="2026-10-01").collect():
        out.setdefault(r.model, set()).add(r.code)
    return out


@pytest.mark.parametrize("k", range(len(MUTATIONS)))
def test_each_guard_fires(fired, k):
    code = MUTATIONS[k][0]
    assert code in fired["renamed" if code == "G12" else f"m{k}"]


def test_source_drift_and_review_diff(spark, tmp_path):
    root = toy.write(tmp_path)
    gone = spark.createDataFrame([("north", "pretraining", "runs", "c" * 64), ("north", "pretraining", "studies", None)], "model string, stage string, source string, sha256 string")
    rows = {(r.code, r.severity) for r in validate(spark, root, today="2026-10-01", fetched=gone).collect()}
    assert rows == {("G04", "error"), ("G04", "warning")}
    before = spark.createDataFrame([("north", "QR", "2026-08-22", "{}")], "model string, reviewed_by string, reviewed_date string, content string")
    assert "G03" in {r.code for r in validate(spark, root, today="2026-10-01", before=before).collect()}


def test_compare_is_null_safe(spark):
    shape = "model string, stage string, dataset string, verdict string, keys_attempted array<string>, keys_absent array<string>, identity string, by_design string, matched_on array<string>, cells long, sample_ids array<string>"
    a = spark.createDataFrame([("m", "s", "d", "INCONCLUSIVE", ["b", "a"], None, None, None, ["x"], 1, None), ("m", "s", "e", "PRESENT", [], [], None, None, ["x"], 1, None)], shape)
    b = spark.createDataFrame([("m", "s", "d", "INCONCLUSIVE", ["a", "b"], [], None, None, [], None, []), ("m", "s", "e", "PRESENT", [], [], "provisional", None, ["x"], 2, [])], shape)
    assert {(r.dataset, r.field) for r in compare.differences(a, b).collect()} == {("e", "identity"), ("e", "cells")}


def test_views(spark):
    rows = spark.createDataFrame(
        [("a", "s", "d1", "PRESENT", None, None, ["accession"]), ("b", "s", "d1", "PRESENT", "half", None, []), ("a", "s", "d2", "INCONCLUSIVE", None, "no exact key could be attempted: x", []), ("a", "s", "d3", "INCONCLUSIVE", None, "other", [])],
        "model string, stage string, dataset string, verdict string, by_design string, reason string, keys_attempted array<string>",
    )
    judged = spark.createDataFrame([("a", "d1"), ("b", "d1"), ("b", "d1"), ("c", "d1")], "model string, dataset string")
    assert {tuple(r) for r in views.reuse(rows, judged).collect()} == {("d1", "a", "s", "b"), ("d1", "a", "s", "c")}
    names = spark.createDataFrame([("d1", "D", "x"), ("d9", "N", "perturbation")], "dataset string, name string, kind string")
    led = {r.dataset: r for r in views.ledger(rows, names, judged).collect()}
    assert led["d1"].evaluated_by == ["a", "b", "c"] and [e.model for e in led["d1"].exposure] == ["a"] and led["d9"].reuse == []
    assert not any("score" in c or "rank" in c for c in views.ledger(rows, names, judged).columns)
    assert [r.dataset for r in views.grid(rows, ["a", "b"], names).collect()] == ["d9", "d1"]
    why = views.phrases(rows, spark.createDataFrame([("a", "s", [])], "model string, stage string, unresolved array<string>")).collect()
    assert len(why) == 1 and why[0].phrase.startswith("in part: ")


def test_lookup(spark, tmp_path):
    root = toy.write(tmp_path, [toy.entry(tmp_path), toy.draft(tmp_path)])
    crosswalk.write(tmp_path / "cache", "pubmed", {"query": "8301", "accessions": ["GSE8888", "DRP8999"], "pmids": ["8301"], "doi": None, "samples": []})
    crosswalk.write(tmp_path / "cache", "geo", {"query": "GSE8888", "accessions": ["GSE8888", "DRP8999"], "pmids": ["8301"], "doi": "10.5555/Z", "samples": [["GSM8889", "t"]]})
    crosswalk.write(tmp_path / "cache", "geo", {"query": "GSM8889", "accessions": ["GSM8889", "GSE8888"], "pmids": ["8301"], "doi": None, "samples": []})
    lines = ["HARBOR ATLAS", "see SRP8101 # a note", "PMID 8301", "GSM8889", "nothing known", "# only a note", "GSE777"]
    found = lookups.lookup(spark, root, lines, cache=f"{tmp_path}/cache")
    q = {r.query_id: r for r in found.queries.collect()}
    assert (q["1"].kind, q["1"].catalog_id) == ("dataset", "harbor-atlas") and q["2"].catalog_id == "harbor-atlas" and q["5"].kind == "unrecognised"
    assert q["3"].kind == "paper" and q["3/GSE8888"].linked_from == "PMID 8301" and len(q["7"].notes) == 1 and len(q) == 7
    own = {}
    for r in found.identifiers.collect():
        own.setdefault(r.query_id, set()).add((r.type, r.value))
    assert own["4"] == {("geo", "GSM8889"), ("pmid", "8301")}  # a sample is never widened to its series
    assert own["3/GSE8888"] == {("geo", "GSE8888"), ("sra", "DRP8999"), ("pmid", "8301"), ("doi", "10.5555/z")} and own["3"] == {("pmid", "8301")}
    got = {(r.query_id, r.stage): r for r in found.answers.collect()}
    assert {s for _, s in got} == {"pretraining", "tuning"}  # drafts only if asked for
    one = got["1", "pretraining"]
    assert one.recorded and one.verdict == "PRESENT" and one.samples == 2 and (one.model_name, one.reviewed_by, one.draft) == ("North", "QR", False) and one.sources_searched == ["studies", "runs"]
    assert got["1", "tuning"].code == "by_design_stage" and not got["1", "tuning"].recorded
    assert got["3", "pretraining"].code == "same_publication" and got["3/GSE8888", "pretraining"].code == "present" and ("5", "tuning") not in got
    warn = {r.query_id: (r.warnings, r.searched) for r in found.coverage.collect()}
    assert warn["3"] == ([lookup.DISCLAIMER], ["north"]) and warn["1"] == ([], ["north"])
    drafts = lookups.lookup(spark, root, lines[:1], cache=f"{tmp_path}/cache", include_drafts=True, models=["south"])
    assert {(r.model, r.stage, r.code, r.draft) for r in drafts.answers.collect()} == {("south", "first", "recorded", True), ("south", "second", "missing_required_key", True)}
    (root / "extracts/runs.csv").unlink()
    closed = lookups.lookup(spark, root, ["GSE777", "reef"])
    assert {(r.query_id, r.code) for r in closed.answers.where("stage = 'pretraining'").collect()} == {("1", "not_indexed"), ("2", "not_indexed")}
    with pytest.raises(KeyError):
        lookups.lookup(spark, root, lines, models=["nobody"])


def test_workbook_and_files(spark, tmp_path):
    head = '<?xml version="1.0"?>'
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    sheet = f'{head}<worksheet xmlns="{main}"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>n</t></is></c></row><row></row><row><c r="A3" t="s"><v>1</v></c><c r="B3"><v>12.0</v></c></row><row><c r="B4"><v>3</v></c></row></sheetData></worksheet>'
    with zipfile.ZipFile(tmp_path / "x.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="S" r:id="rId7"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships><Relationship Id="rId7" Target="worksheets/s.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'{head}<sst xmlns="{main}"><si><t> id </t></si><si><t>GSE1</t></si></sst>')
        z.writestr("xl/worksheets/s.xml", sheet)
    rows = lists.read_list(spark, tmp_path / "x.xlsx")
    assert [tuple(r) for r in rows.orderBy("row").collect()] == [(1, "GSE1", "12.0"), (2, None, "3")] and rows.columns == ["row", "id", "n"]
    (tmp_path / "a.csv").write_text('# one\nid,n\n"GSE1, GSE2",5\n# two\n,\n')
    rows = lists.projected(lists.read_list(spark, tmp_path / "a.csv"), {"accession": ["id", "missing"], "cells": ["n"]})
    assert [(r.row, r.accessions, r.cells) for r in rows.orderBy("row").collect()] == [(1, ["GSE1", "GSE2"], 5), (2, [], None)]
    assert [r.sha256 for r in files.facts(files.listed(spark, f"file://{tmp_path}", "a.csv")).collect()] == [toy.digest(tmp_path / "a.csv")]
    with pytest.raises(lists.SourceError):
        lists.in_folder(tmp_path)({"url": "https://h.org/x/a.csv?q=1", "sha256": "0"})
    assert lists.in_folder(tmp_path)({"url": "https://h.org/x/a.csv?q=1", "sha256": toy.digest(tmp_path / "a.csv")}).name == "a.csv"


def test_dates_stay_text():
    assert catalog.load_yaml("id: a\nday: 2026-01-02\n")["day"] == "2026-01-02"


def test_arriving_lists(spark, tmp_path):
    from provena.streaming import arrivals

    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.csv").write_text("id,pmid\nGSE1,\nx,7\n")
    targets = spark.createDataFrame([("m", "s", "d1", "accession", "GSE1"), ("m", "s", "d2", "pmid", "7"), ("m", "s", "d2", "pmid", "8")], "model string, stage string, dataset string, key string, value string")
    rows = arrivals.arriving(spark, str(folder), ["id", "pmid"], {"accession": ["id"], "pmid": ["pmid"]}, "m", "s")
    stream = arrivals.matched(rows, targets).writeStream.format("memory").queryName("arrived").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        stream.processAllAvailable()
        (folder / "b.csv").write_text("id,pmid\ny,8\n")
        stream.processAllAvailable()
    finally:
        stream.stop()
    got = {(r.dataset, r.key, r.source) for r in spark.table("arrived").collect()}
    assert got == {("d1", "accession", "a.csv"), ("d2", "pmid", "a.csv"), ("d2", "pmid", "b.csv")}


@pytest.mark.parametrize("gone", ["folders", "left-over folder", "library"])
def test_entry_module_without_the_operators(tmp_path, gone):
    """Without both folders, with what Python leaves of them, and without a library that only the operators need."""
    here = Path(__file__).resolve().parent.parent
    shutil.copytree(here / "provena", tmp_path / "provena", ignore=shutil.ignore_patterns("__pycache__", *(["llm"] if gone != "library" else [])))
    for name in ("__spark_entry__.py", *(["corpus_pipeline.py"] if gone == "library" else [])):
        shutil.copy(here / name, tmp_path / name)
    if gone == "left-over folder":
        (tmp_path / "provena/llm/__pycache__").mkdir(parents=True)
    code = "import sys, warnings; warnings.simplefilter('ignore')\n" + ("sys.modules['xxhash'] = None\n" if gone == "library" else "") + "import __spark_entry__ as e; assert e.llm is None and len(e.queries()) > 40 and not any(n.startswith('op') for n in e.queries()); assert set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=str(tmp_path), env=os.environ | {"PYTHONPATH": str(tmp_path)})
