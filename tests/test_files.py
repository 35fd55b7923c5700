"""Files written, hashed and put together by tasks."""

import hashlib

import pytest
from pyspark.sql import functions as F

from provena import sinks
from provena.sources import crosswalk, files, lists

SHAPE = "name string, body string"


def test_a_file_for_each_row(spark, tmp_path):
    rows = spark.createDataFrame([(f"sub {k % 3}/f{k}.txt", f"body {k}\n" * k) for k in range(40)] + [("none.txt", None)], SHAPE).repartition(5)
    files.write(rows, f"file://{tmp_path}/out")
    files.write(spark.createDataFrame([("f.bin", bytearray(b"\x00\xff"))], "name string, body binary"), str(tmp_path / "out"))
    found = {str(p.relative_to(tmp_path / "out")): p.read_bytes() for p in (tmp_path / "out").rglob("*") if p.is_file() and not p.name.startswith(".")}
    assert found == {f"sub {k % 3}/f{k}.txt": (f"body {k}\n" * k).encode() for k in range(40)} | {"none.txt": b"", "f.bin": b"\x00\xff"}
    facts = {r.path.rsplit("/", 1)[1]: r for r in files.facts(files.listed(spark, f"file://{tmp_path}/out")).collect()}
    assert len(facts) == 40 and all(facts[n.rsplit("/", 1)[-1]].sha256 == hashlib.sha256(b).hexdigest() for n, b in found.items() if b)


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    @F.udf("string")
    def body(k):
        if k == 17:
            raise ValueError("a task fails")
        return "x"

    rows = spark.range(40).repartition(4).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("name"), body("id").alias("body"))
    (tmp_path / "out").mkdir()
    (tmp_path / "out/before").write_text("stays")
    with pytest.raises(Exception):
        files.write(rows, f"file://{tmp_path}/out")
    assert [p.name for p in (tmp_path / "out").rglob("*")] == ["before"]


def test_facts_of_a_file_in_chunks(spark, tmp_path, monkeypatch):
    data = b"# head\n# derived-from-sha256: " + b"a" * 64 + b"\nid\n" + b"0123456789" * 2_000_000
    (tmp_path / "large.csv").write_bytes(data)
    (tmp_path / "late.csv").write_text("".join(f"# line {k}\n" for k in range(10)) + "# derived-from-sha256: b\n")
    (tmp_path / "none.csv").write_text("id\n# derived-from-sha256: c\n")
    got = {r.path.rsplit("/", 1)[1]: r for r in files.facts(files.listed(spark, f"file://{tmp_path}", "*.csv")).collect()}
    assert (got["large.csv"].size, got["large.csv"].sha256, got["large.csv"].parent) == (len(data), hashlib.sha256(data).hexdigest(), "a" * 64)
    assert got["late.csv"].parent is None and got["none.csv"].parent is None
    assert files.listed(spark, f"file://{tmp_path}", "*.nothing").count() == 0


def test_one_file_from_ranges(spark, tmp_path):
    rows = spark.range(30_000).select((F.lit(30_000) - F.col("id")).alias("k"), F.concat(F.lit("line "), (F.lit(30_000) - F.col("id")).cast("string")).alias("line"))
    files.joined(rows, ["k"], f"file://{tmp_path}/out/x.txt", ["# head"])
    assert (tmp_path / "out/x.txt").read_text() == "# head\n" + "".join(f"line {k}\n" for k in range(1, 30_001))
    assert [p.name for p in (tmp_path / "out").iterdir() if not p.name.startswith(".")] == ["x.txt"]
    files.joined(rows.limit(0), ["k"], f"file://{tmp_path}/out/empty.txt", ["# head"])
    assert (tmp_path / "out/empty.txt").read_text() == "# head\n"


def test_an_extract_reads_as_it_was(spark, tmp_path):
    odd = [(k, f"GSE{k}", 'say "x", \n twice' if k % 3 else None) for k in range(1, 500)]
    rows = spark.createDataFrame(odd, "row long, id string, note string").repartition(7)
    assert sinks.extract(rows, ["note", "id"], f"file://{tmp_path}/x.csv", "d" * 64, ["two columns"]) == 499
    assert [tuple(r) for r in lists.read_list(spark, tmp_path / "x.csv").orderBy("row").collect()] == [(k, note, i) for k, i, note in odd]


def test_sources_are_located_by_joins(spark, tmp_path):
    root, other = tmp_path / "root", tmp_path / "publisher"
    (root / "lists").mkdir(parents=True)
    other.mkdir()
    sha = hashlib.sha256(b"whole").hexdigest()
    (root / "lists/s.csv").write_bytes(b"whole")
    (root / "lists/bad.csv").write_bytes(b"changed")
    (root / "lists/x.csv").write_text(f"# derived-from-sha256: {sha}\nid\n")
    (other / "a+b c.csv").write_bytes(b"whole")
    (other / "d.csv").write_bytes(b"changed")
    rows = [
        ("one", "https://h/s.csv", sha, "lists/s.csv", None, "snapshot", "lists/s.csv"),
        ("two", "https://h/a+b%20c.csv?v=2#x", sha, "lists/bad.csv", None, None, None),  # a snapshot has nothing to fall back on
        ("three", "https://h/q/a+b%20c.csv?v=2#x", sha, None, "lists/x.csv", "folder", "a+b c.csv"),
        ("four", "https://h/d.csv", sha, None, "lists/x.csv", "extract", "lists/x.csv"),
        ("five", "https://h/d.csv", "0" * 64, None, "lists/x.csv", None, None),
        ("six", "https://h/gone.csv", sha, None, None, None, None),
        ("seven", None, sha, None, None, None, None),
    ]
    sources = spark.createDataFrame([r[:5] for r in rows], "source string, url string, sha256 string, snapshot string, extract string")
    got = {r.source: r for r in lists.located(sources, root, other).collect()}
    for name, *_, how, path in rows:
        assert got[name].how == how and (got[name].path or "").endswith(path or "") and (got[name].problem is None) == (how is not None), name
    alone = {r.source: r.how for r in lists.located(sources, root).collect()}
    assert alone["three"] == "extract" and alone["one"] == "snapshot" and alone["six"] is None


def test_cache_records_by_tasks(spark, tmp_path):
    shape = "kind string, query string, accessions array<string>, pmids array<string>, doi string, samples array<struct<accession:string,title:string>>"
    rows = [("doi", "10.5555/a_b", ["GSE1"], [], "10.5555/a_b", [("GSM1", "t")]), ("geo", "GSE2", ["GSE2"], ["7"], None, [])]
    crosswalk.store(spark.createDataFrame(rows * 2, shape), f"file://{tmp_path}/cache")
    got = {r.query: r for r in crosswalk.read(spark, f"file://{tmp_path}/cache").collect()}
    assert set(got) == {"10.5555/a_b", "GSE2"} and got["10.5555/a_b"].samples[0].title == "t" and got["GSE2"].kind == "geo" and got["GSE2"].pmids == ["7"]
