"""Ledger, sinks, stored replies and requests."""

import json

import pytest
from pyspark.sql import functions as F

from provena import sinks
from provena.operators import chains, views
from provena.plans import ledger as ledgers
from provena.plans import registry
from provena.shared import scratch, shared_dir
from provena.sources import crosswalk, lists, replies, requests

from . import toy


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    folder = tmp_path_factory.mktemp("registry")
    south = toy.draft(folder)
    south["discovery"]["methods"] = {"checked": False}
    south["evaluated_on"].append({"dataset": "meadow-screen"})
    return toy.write(folder, [toy.entry(folder), south])


def test_ledger(spark, root):
    led = ledgers.ledger(spark, root)
    models = {r.model: r for r in led.models.collect()}
    assert models["south"].draft and not models["north"].draft and models["south"].discovery_unchecked == ["methods"] and models["north"].evaluated_on == ["harbor-atlas", "meadow-screen", "lagoon"]
    rows = {(r.model, r.stage, r.dataset): r for r in led.rows.collect()}
    assert len(rows) == 4 and rows["south", "first", "harbor-atlas"].draft and rows["north", "pretraining", "lagoon"].relation == "reported-eval"
    data = {r.dataset: r for r in led.datasets.collect()}
    assert set(data) == set(toy.DATASETS) and data["harbor-atlas"].evaluated_by == ["north", "south"] and data["orchard"].evaluated_by == []
    assert [tuple(x) for x in data["harbor-atlas"].reuse] == [("north", "pretraining", "south")]
    assert data["meadow-screen"].exposure == []  # by design is no exposure
    assert {r.dataset for r in ledgers.ledger(spark, root, ["reef", "lagoon"]).datasets.collect()} == {"reef", "lagoon"}
    with pytest.raises(KeyError):
        ledgers.ledger(spark, root, ["no-such"])


def test_page_tables(spark, root):
    _, t, _ = registry.open_registry(spark, root)
    led = ledgers.build(t)
    assert [tuple(r)[1:] for r in views.classes(led.models).collect()] == [("foundation", ["north"]), ("task-specific", ["south"])]
    page = [tuple(r)[1:] for r in views.dataset_rows(led.rows, led.models).where("dataset = 'harbor-atlas'").orderBy("place").collect()]
    assert [(p[0], p[1], p[3], p[4], p[6]) for p in page] == [(1, "north", False, "pretraining", "PRESENT"), (2, "south", True, "first", "NOT CHECKABLE")] and page[0][7] == "2 listed samples, 42 cells"
    how = {r.model: r for r in views.how_checked(t["sources"], t["corpora"], t["models"], t["discovery"]).collect()}
    assert (how["north"].by_hash, how["north"].by_snapshot, how["north"].rerun, how["north"].unsearched) == (2, 0, ["pretraining"], [])
    assert (how["south"].by_snapshot, how["south"].rerun, how["south"].unsearched) == (1, ["second"], ["methods"])
    assert all(c.done for c in how["north"].checks) and not any(c.done for c in how["south"].checks)
    calls = {r.model: r.call for r in views.judgment_calls(led.rows, t["datasets"], t["corpora"]).where("dataset is null").collect()}
    assert calls == {"north": "caveats as worded: 1"}


def lines(folder):
    return [json.loads(x) for f in sorted(folder.glob("*.txt")) for x in f.read_text().splitlines()]


def test_export(spark, root, tmp_path):
    names = ledgers.export_views(spark, root, f"file://{tmp_path}")
    assert all((tmp_path / n).is_dir() for n in names)
    assert {r["dataset"] for r in lines(tmp_path / "datasets")} == set(toy.DATASETS) and len(lines(tmp_path / "rows")) == 4
    corpora = {(r["model"], r["stage"]): r for r in lines(tmp_path / "lookup/corpora")}
    assert set(corpora) == {("north", "pretraining"), ("north", "tuning")} and corpora["north", "pretraining"]["indexed"] and not corpora["north", "tuning"]["checkable"]
    catalog = {r["dataset"]: r["identifiers"] for r in lines(tmp_path / "lookup/catalog") if "identifiers" in r}
    assert catalog["canyon"] == [["scp", "SCP8401", "provisional", "named in a talk of its authors"], ["pmid", "8402"]] and catalog["reef"] == [["pmid", "8301"]]
    rows = lines(tmp_path / "lookup/rows/model=north/stage=pretraining")
    assert [0, "DRP8999", None, None, ["DRP8999"], ["8301"], []] in rows and [1, "SRP8101", "SRR2", 30, ["SRR2", "SRP8101"], [], []] in rows and len(rows) == 7


def test_report_and_csv(spark, root):
    rows = registry.check(spark, root, models=["north"], datasets=["harbor-atlas", "reef", "lagoon"])
    text = [r.line for r in sinks.report(rows).collect()]
    assert text[0] == "INCONCLUSIVE: 1" and text[1].startswith("  reef [tried: pmid] — same publication") and len(text[1]) == 110 and text[1].endswith("...")
    assert "  harbor-atlas [tried: accession, pmid] — 2 listed samples, 42 cells" in text
    odd = spark.createDataFrame([("a,b", 'say "x"', None, 1.5), ("two\nlines", "plain", "", 2.0)], "a string, b string, c string, d double")
    assert [r.line for r in sinks.csv_rows(odd).collect()] == ['"a,b","say ""x""",,1.5', '"two\nlines",plain,,2.0']
    assert tuple(sinks.severities(spark.createDataFrame([("error",), ("error",), ("warning",)], "severity string")).first()) == (2, 1)


def test_extract_and_snapshot(spark, root, tmp_path):
    rows = lists.read_list(spark, root / "extracts/runs.csv")
    assert sinks.extract(rows, ["size", "run"], tmp_path / "x.csv", "e" * 64, ["two columns"]) == 3
    assert (tmp_path / "x.csv").read_text() == "# two columns\n# derived-from-sha256: " + "e" * 64 + "\nsize,run\n12,SRR1\n30.0,SRR2\n7,SRR3\n" and lists.declared_parent(tmp_path / "x.csv") == "e" * 64
    pool = lists.read_list(spark, root / "snapshots/pool.csv")
    assert sinks.snapshot(pool, ["owner", "link", "size"], tmp_path / "s.csv", "size", 111) == 2
    assert (tmp_path / "s.csv").read_text() == "owner,link,size\nowner-1,doi:10.5555/meadow.1,100\nowner-2,,11\n"
    with pytest.raises(ValueError):
        sinks.snapshot(pool, ["owner"], tmp_path / "s.csv", "size", 112)


def test_lists_keep_their_order_in_parts(spark, tmp_path):
    path = tmp_path / "long.csv"
    path.write_text("# head\nid,n\n" + "".join(f"GSE{k},{k}\n" + ("# between\n" if k % 7 == 0 else "") for k in range(20_000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "30000")
    try:
        rows = lists.read_list(spark, path)
        assert rows.rdd.getNumPartitions() > 4 and rows.where("cast(n as long) + 1 <> row or id <> 'GSE' || n").count() == 0 and rows.count() == 20_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    path.write_text('id,n\n"two\nlines",1\n\nx\n"a ""b""",2,3\n')
    assert [tuple(r) for r in lists.read_list(spark, path).orderBy("row").collect()] == [(1, "two\nlines", "1"), (2, "x", None), (3, 'a "b"', "2")]
    path.write_text("# nothing\n")
    assert lists.read_list(spark, path).count() == 0
    path.write_text("id,n\n")
    assert lists.read_list(spark, path).columns == ["row", "id", "n"] and lists.read_list(spark, path).count() == 0


def body(**fields):
    return json.dumps(fields)


@pytest.fixture(scope="module")
def stored(spark):
    series = {"entrytype": "GSE", "accession": "GSE71", "title": "A series", "taxon": "Homo sapiens", "pubmedids": ["501", "502"], "samples": [{"accession": "GSM73", "title": "c"}, {"accession": "GSM72", "title": "b"}, {"accession": "", "title": "none"}], "bioproject": "PRJNA7", "extrelations": [{"relationtype": "X", "targetobject": "no"}, {"relationtype": "SRA", "targetobject": "SRP7"}]}
    sample = {"entrytype": "GSM", "accession": "GSM72", "title": "b", "taxon": "Homo sapiens", "pubmedids": [], "samples": [], "bioproject": "", "extrelations": []}
    other = series | {"accession": "GSE70", "samples": [{"accession": "GSM72", "title": "b"}], "bioproject": "PRJNA6", "extrelations": [], "taxon": "Mus musculus"}
    paper = lambda k: {"title": f"Paper {k}", "articleids": [{"idtype": "doi", "value": f"10.5555/p{k}"}, {"idtype": "pmc", "value": f"PMC{k}"}]}
    summary = lambda **entries: body(result={"uids": list(entries), **entries})
    gds = [("GSE71", summary(a=sample, b=series)), ("GSM72", summary(x=series, y=sample)), ("501", summary(b=series, c=other, d=sample)), ("GSE404", summary())]
    searches = [("pubmed", '"10.5555/p501"[DOI]', body(esearchresult={"idlist": ["501", "9"]})), ("pubmed", '"10.5555/none"[DOI]', body(esearchresult={"idlist": []}))]
    study = body(section={"attributes": [{"name": "Title", "value": "An array"}, {"name": "Organism", "value": "Homo sapiens"}], "subsections": [{"type": "Author"}, {"type": "Publication", "accno": "601", "attributes": [{"name": "DOI", "value": "10.5555/E"}]}, {"type": "Publication", "accno": "x", "attributes": []}]})
    make = spark.createDataFrame
    return chains.Replies(
        make(searches, "db string, term string, body string"), make(gds, "key string, body string"), make([("all", summary(**{"501": paper(501), "502": paper(502), "503": paper(503)}))], "key string, body string"),
        make([("501", body(linksets=[{"linksetdbs": [{"links": ["b", "c", "d"]}]}])), ("503", body(linksets=[]))], "pmid string, body string"), make([("E-MTAB-5", study)], "accession string, body string"),
    )


def test_chains(spark, stored):
    cache = spark.createDataFrame([("pubmed", "502", ["GSE1"], ["502"], None)], "kind string, query string, accessions array<string>, pmids array<string>, doi string")
    asked = ["gse71", "GSM72", "501", "502", "503", "10.5555/P501", "10.5555/none", "e-mtab-5", "GSE404", "what"]
    got = {r.input: r for r in chains.resolved(spark.createDataFrame([(a,) for a in asked], "input string"), cache, stored).collect()}
    gse, gsm, pmid, doi, array = (got[a] for a in ("gse71", "GSM72", "501", "10.5555/P501", "e-mtab-5"))
    assert (gse.accessions, gse.pmids, gse.doi, gse.pmcid, gse.title, gse.organism) == (["GSE71", "PRJNA7", "SRP7"], ["501", "502"], "10.5555/p501", "PMC501", "A series", "Homo sapiens") and [s.accession for s in gse.samples] == ["GSM72", "GSM73"]
    assert (gsm.accessions, gsm.pmids, gsm.title) == (["GSM72"], ["501", "502"], "b") and [s.accession for s in gsm.samples] == ["GSM72", "GSM73"]  # from its series
    assert pmid.accessions == ["GSE71", "PRJNA7", "SRP7", "GSE70", "PRJNA6"] and [tuple(s) for s in pmid.samples] == [("GSM72", "b"), ("GSM73", "c")] and pmid.organism == "Homo sapiens" and len(pmid.sources) == 3
    assert doi.query == "10.5555/p501" and doi.accessions == pmid.accessions and doi.pmids == ["501"] and doi.sources[0] == "esearch.fcgi?db=pubmed"
    assert (array.query, array.pmids, array.doi, array.title) == ("E-MTAB-5", ["601"], "10.5555/E", "An array")
    assert got["502"].hit == "cache" and got["503"].hit == "replies" and got["503"].accessions == [] and got["503"].title == "Paper 503"
    assert {a for a in asked if got[a].hit is None} == {"10.5555/none", "GSE404", "what"} and got["what"].kind is None and got["GSE404"].note
    only = {r.input: r.hit for r in chains.resolved(spark.createDataFrame([("502",), ("501",)], "input string"), cache).collect()}
    assert only == {"502": "cache", "501": None}


def test_citations(spark):
    rows = spark.createDataFrame([("Wu, X. et al. A map. Nat. Methods 5, 10–19 (2021).",), ("Li, Y. B title. Cell 7, 1 (2020).",), ("nothing",)], "line string")
    matched = spark.createDataFrame([("nat-methods_2021_5_10_wu", "nat methods|2021|5|10|wu||77"), ("cell_2020_7_1_li", "cell|2020|7|1|li||NOT_FOUND")], "key string, reply string")
    got = {r.line[:2]: (r.key, r.pmid, r.known) for r in chains.citations(rows, matched).collect()}
    assert got == {"Wu": ("nat-methods_2021_5_10_wu", "77", True), "Li": ("cell_2020_7_1_li", None, True), "no": (None, None, False)}


def test_requests():
    now, slept, asked = [0.0], [], []

    def sleep(s):
        slept.append(round(s, 3))
        now[0] += s

    answers = [requests.Refused(429), requests.Refused(503), b'{"esearchresult": {"idlist": ["1"]}}']

    def fetch(address):
        asked.append(address)
        x = answers.pop(0)
        if isinstance(x, Exception):
            raise x
        return x

    index = requests.Index(fetch, key="k", spacing=requests.Spacing(10, lambda: now[0], sleep), sleep=sleep)
    assert index.search("gds", "GSE1[ACCN]")["esearchresult"]["idlist"] == ["1"] and len(asked) == 3 and slept == [0.5, 1.0]
    assert "api_key=k" in asked[0] and "term=GSE1%5BACCN%5D" in asked[0]
    answers[:] = [b"a|b|9", b"{}", requests.Refused(404)]
    assert index.match("a|b") == "a|b|9" and slept[2:] == [0.1]
    index.links("pubmed", "gds", "9")
    with pytest.raises(requests.Refused):
        index.summary("gds", ["1", "2"])
    answers[:] = [requests.Refused(500)] * 4
    with pytest.raises(requests.Refused):
        index.search("gds", "x")


def test_requests_by_tasks(spark, tmp_path):
    """Every lane keeps its share of the rate, refusals are rows, and what fails for a while is asked for again."""
    log = f"{tmp_path}/log"

    def fetch(address):
        with open(log, "a") as f:
            f.write(address + "\n")
        n = int(address[1:])
        if n == 5 and open(log).read().split().count("a5") < 3:
            raise requests.Refused(503)
        if n % 4 == 1 and n != 5:
            raise requests.Refused(404)
        return f"body {n}".encode()

    def sleep(seconds):
        with open(f"{tmp_path}/slept", "a") as f:
            f.write(f"{seconds}\n")

    rows = spark.createDataFrame([(f"a{k % 12}",) for k in range(36)] + [(None,)], "address string")
    got = {r.address: (r.status, r.body) for r in requests.asked(rows, fetch, per_second=8, lanes=2, sleep=sleep).collect()}
    assert got == {f"a{k}": (404, None) if k in (1, 9) else (200, f"body {k}") for k in range(12)}
    calls = open(log).read().split()
    assert len(calls) == 14 and calls.count("a5") == 3
    waits = [float(x) for x in open(f"{tmp_path}/slept")]
    assert {0.5, 1.0} <= set(waits) and sum(0.2 < w <= 0.25 for w in waits) >= 8  # two lanes at four a second each


def test_cached_replies_are_read_as_tables(spark, tmp_path):
    (tmp_path / "a.json").write_text(body(result={"uids": ["7"], "7": {"title": "T", "articleids": []}}))
    rows = spark.read.text(f"{tmp_path}/*.json", wholetext=True).withColumnRenamed("value", "body")
    assert [tuple(r) for r in replies.pubmed(replies.summaries(rows)).collect()] == [("7", "T", None, None)]
    crosswalk.write(tmp_path / "cache", "doi", {"query": "10.5555/a_b", "accessions": [], "pmids": [], "doi": "10.5555/a_b", "samples": [["GSM1", "t"]]})
    assert [tuple(r.samples[0]) for r in crosswalk.read(spark, f"{tmp_path}/cache").collect()] == [("GSM1", "t")]


def test_scratch_is_deleted(spark, root, tmp_path):
    folder = shared_dir(spark).removeprefix("file://") + "/tables"
    import os

    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    with scratch(spark):
        registry.check(spark, root, models=["north"], datasets=["lagoon"]).write.parquet(f"file://{tmp_path}/out")
    assert set(os.listdir(folder)) == before and spark.read.parquet(f"file://{tmp_path}/out").where(F.col("stage") == "pretraining").count() == 1


def test_lists_that_cannot_be_opened_add_nothing_to_the_plan(spark, tmp_path):
    """Sixty corpora without their lists are taken out by one join; a filter for each made plans of thousands of corpora too deep."""
    from provena.sources import catalog

    def table(name, **columns):
        empty = spark.createDataFrame([], catalog.SCHEMAS[name])
        made = spark.range(61).select(*(c.alias(n) for n, c in columns.items())) if columns else empty
        return empty.unionByName(made, allowMissingColumns=True)

    model = F.concat(F.lit("m"), F.col("id").cast("string"))
    t = {name: table(name) for name in catalog.SCHEMAS}
    t["corpora"] = table("corpora", model=model, stage=F.lit("s"), type=F.when(F.col("id") == 60, "D").otherwise("A"), resolver=F.lit("none such"))
    tables, _, failed = registry.open_registry(spark, tmp_path, skip=True, tables=t)
    assert len(failed) == 60 and [r.model for r in tables.corpora.select("model").collect()] == ["m60"]
    assert tables.corpora._jdf.queryExecution().logical().toString().count("Filter") < 10


def test_queries_and_papers_of_series_are_not_sent_through_the_driver(spark):
    """However small Spark takes them for, both joins of the GEO chain are dealt by key."""
    body = lambda e: json.dumps({"result": {"uids": ["1"], "1": e}})
    series = body({"entrytype": "GSE", "accession": "GSE5", "title": "t", "taxon": "o", "pubmedids": ["9"], "samples": [], "bioproject": "PRJNA5", "extrelations": []})
    told = spark.createDataFrame([("GSE5", series), ("GSE6", series)], "key string, body string")
    paper = spark.createDataFrame([("9", json.dumps({"result": {"uids": ["9"], "9": {"title": "p", "articleids": [{"idtype": "doi", "value": "10.1/p"}]}}}))], "key string, body string")
    rows = chains.geo(spark.createDataFrame([("GSE5",)], "query string"), chains.Replies(told, told, paper, told, told))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("SortMergeJoin") == 2
    assert [(r.query, r.doi, r.pmids) for r in rows.collect()] == [("GSE5", "10.1/p", ["9"])]


def test_small_documents_share_tasks(spark, tmp_path):
    """A registry of many small files is read by as many tasks as there is work for, whatever Spark counts for opening a file."""
    from provena.shared import shuffle_parts
    from provena.sources import catalog

    for k in range(120):
        (tmp_path / "datasets").mkdir(exist_ok=True)
        (tmp_path / "datasets" / f"d{k}.yaml").write_text(f"id: d{k}\nname: Set {k}\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    try:
        rows = catalog.documents(spark, tmp_path)
        most = catalog.TASKS * max(shuffle_parts(spark), spark.sparkContext.defaultParallelism)
        assert rows.rdd.getNumPartitions() <= most < 120 and rows.count() == 120
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
