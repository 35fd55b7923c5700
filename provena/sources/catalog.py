"""YAML catalog and registry folders as tables.

Each file is read and parsed by a task, which gives the rows of all tables that it holds; they are stored once, and each table reads its own. Of catalog entries with equal
ids the last file's stays. Malformed documents have no rows, and what is wrong with the others' structure is a table too.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provena.operators import structure
from provena.shared import exists, new_path, shuffle_parts
from provena.sources.lists import address


# The parser of libyaml, where it is there.
_Safe = getattr(yaml, "CSafeLoader", yaml.SafeLoader)


class _Loader(_Safe):
    """Dates stay text."""


_Loader.yaml_implicit_resolvers = {k: [(tag, rx) for tag, rx in v if tag != "tag:yaml.org,2002:timestamp"] for k, v in _Safe.yaml_implicit_resolvers.items()}


def load_yaml(text: str) -> object:
    return yaml.load(text, _Loader)


def tri(confirmed: object) -> str:
    """The three states of ``confirmed`` as text."""
    return confirmed if confirmed == "provisional" else "true" if confirmed is True else "false"


SCHEMAS = {
    "datasets": "dataset string, file string, name string, title string, kind string, organism array<string>, note string, doc string",
    "identifiers": "dataset string, ord long, type string, value string, confirmed string, basis string, via string",
    "absent": "dataset string, key string, basis string, checked string",
    "models": "model string, file string, name string, version string, model_class string, paper string, reviewed_by string, reviewed_date string, review_checked array<string>, disputed string, draft boolean, doc string",
    "discovery": "model string, location string, checked boolean, found string",
    "evaluated_on": "model string, ord long, dataset string, task string, obtained_from string",
    "corpora": "model string, stage string, corpus_ord long, name string, type string, resolver string, quote string, as_of string, keys_available array<string>, requires_keys array<string>, accession_types array<string>, sources array<string>, sources_searched array<string>, unconfirmed array<string>, unresolved array<string>, caveats array<string>, can_prove_presence boolean, pointer string, totals map<string,long>",
    "sources": "model string, stage string, source string, ord long, url string, sha256 string, extract string, snapshot string, acquired string, confirmation string, columns array<string>, roles map<string,array<string>>, join_column string, join_tables array<struct<name:string,snapshot:string,sha256:string>>, records long",
    "splits": "model string, stage string, ord long, dataset string, held_out string",
    "faults": "kind string, id string, message string",
    "reviewers": "initials string",
    "recorded": "model string, stage string, ord long, dataset string, verdict string, keys_attempted array<string>, keys_absent array<string>, matched_on array<string>, match_level string, overlap_level string, identity string, identity_basis string, identity_note string, by_design string, samples long, sample_ids array<string>, cells long, reason string, note string",
}
# Resolvers by name, and whether a match in their lists can prove presence.
RESOLVERS = {"table": True, "xlsx_table": True, "xlsx_two_table": True, "census_snapshot": False}


def _texts(values) -> list[str] | None:
    return None if values is None else [str(v) for v in values]


def _entry(d: str, stem: str, doc: dict) -> Iterator[tuple[str, tuple]]:
    """The rows of one catalog entry, each with its table."""
    yield "datasets", (d, stem, str(doc.get("name", "")), doc.get("title"), doc.get("kind"), doc.get("organism"), doc.get("note"), json.dumps(doc, sort_keys=True))
    for k, i in enumerate(doc.get("identifiers") or []):
        yield "identifiers", (d, k, i.get("type"), str(i.get("value")), tri(i.get("confirmed")), i.get("basis"), i.get("via"))
    for a in doc.get("absent") or []:
        yield "absent", (d, a.get("key"), a.get("basis"), a.get("checked"))
    for message in structure.dataset_faults(doc):
        yield "faults", ("dataset", d, message)


def _model(m: str, stem: str, doc: dict) -> Iterator[tuple[str, tuple]]:
    """The rows of one registry entry, each with its table."""
    wrong = list(structure.entry_faults(doc))
    for message in wrong:
        yield "faults", ("model", m, message)
    old = doc.get("provenance") or {}
    review = doc.get("review") if isinstance(doc.get("review"), dict) else {"by": old.get("verified_by"), "date": old.get("verified_date")}
    by = (review.get("by") or "").strip()
    yield "models", (m, stem, doc.get("model"), doc.get("version"), doc.get("model_class"), json.dumps(doc.get("paper"), sort_keys=True), by, review.get("date"), list(review.get("checked") or []), json.dumps(doc["disputed"]) if doc.get("disputed") else None, not by, json.dumps(doc, sort_keys=True))
    for place, x in (doc.get("discovery") or {}).items():
        yield "discovery", (m, place, bool(x.get("checked")), None if x.get("found") is None else str(x["found"]))
    for k, x in enumerate(doc.get("evaluated_on") or []):
        yield "evaluated_on", (m, k, x.get("dataset"), x.get("task"), x.get("obtained_from"))
    for n, corpus in enumerate(doc.get("corpora") or []):
        yield from _corpus(m, n, corpus)


def _corpus(m: str, n: int, corpus: dict) -> Iterator[tuple[str, tuple]]:
    s, man, result = corpus["stage"], corpus["manifest"], corpus.get("result") or {}
    files = man.get("sources") or []
    doubted = [x["name"] for x in files if (x.get("confirmation") or {}).get("method") == "none"]
    unresolved = [x["entry"] for x in man.get("unresolved_entries") or []]
    yield "corpora", (m, s, n, corpus.get("name"), man["type"], man.get("resolver"), man.get("quote"), man.get("as_of"), man.get("keys_available"), man.get("requires_keys"), _texts(man.get("accession_types")), [x["name"] for x in files], result.get("sources_searched"), doubted, unresolved, result.get("caveats"), RESOLVERS.get(man.get("resolver"), False), json.dumps(man["pointer"]) if man.get("pointer") else None, man.get("totals"))
    for k, x in enumerate(files):
        roles = {r: (c if isinstance(c, list) else [c]) for r, c in (x.get("roles") or {}).items()}
        join = x.get("join") or {}
        tables = [{"name": t.get("name"), "snapshot": t.get("snapshot"), "sha256": t.get("sha256")} for t in join.get("tables") or []]
        yield "sources", (m, s, x["name"], k, x.get("url"), x.get("sha256"), x.get("extract"), x.get("snapshot"), x.get("acquired"), (x.get("confirmation") or {}).get("method"), x.get("columns"), roles, join.get("column"), tables, x.get("records"))
    for k, x in enumerate(man.get("splits") or []):
        yield "splits", (m, s, k, x["dataset"], x["held_out"])
    for k, f in enumerate(result.get("findings") or []):
        yield "recorded", (m, s, k, f["dataset"], f["verdict"], f.get("keys_attempted"), f.get("keys_absent"), f.get("matched_on"), f.get("match_level"), f.get("overlap_level"), f.get("identity"), f.get("identity_basis"), f.get("identity_note"), f.get("by_design"), f.get("samples"), _texts(f.get("sample_ids")), f.get("cells"), f.get("reason"), f.get("note"))


def _columns(name: str) -> list[str]:
    """Column names of a table; commas inside types are no separators."""
    return [part.split()[0] for part in SCHEMAS[name].replace("map<string,", "map<string;").replace("string,snapshot", "string;snapshot").replace("string,sha256", "string;sha256").split(", ")]


def _file_rows(kind: str, file: str, text: str) -> list[tuple]:
    """(table, kind, id, file, row) of one file, the row as JSON without what is null."""
    doc, stem = load_yaml(text), file.rpartition(".")[0]
    if kind == "reviewers":
        found = [("reviewers", (r["initials"],)) for r in (doc or {}).get("reviewers", [])]
    elif not isinstance(doc, dict) or not doc.get("id"):
        found = []
    else:
        found = [*(_entry if kind == "datasets" else _model)(doc["id"], stem, doc)]
    key = str(doc.get("id")) if isinstance(doc, dict) else None
    return [(table, kind, key, file, json.dumps({c: v for c, v in zip(_columns(table), row, strict=True) if v is not None})) for table, row in found]


#: Tasks that read documents, for each core or part of a shuffle.
TASKS = 4
PARSED = "table string, kind string, id string, file string, row string"


def documents(spark: SparkSession, root: str | Path) -> DataFrame:
    """(kind, file, text) of all files of a registry folder."""
    base, out = address(root), spark.createDataFrame([], "kind string, file string, text string")
    for kind in ("datasets", "registry", "reviewers"):
        place = f"{base}/{kind}" if kind != "reviewers" else f"{base}/reviewers.yaml"
        if exists(spark, place):
            rows = spark.read.text(place, wholetext=True, pathGlobFilter="*.yaml")
            out = out.union(rows.select(F.lit(kind), F.col("_metadata.file_name"), "value"))
    # Spark counts a small file as 4 MB, so a task gets few of them, and there would be more tasks than there is work for.
    return out.coalesce(TASKS * max(shuffle_parts(spark), spark.sparkContext.defaultParallelism))


def load(spark: SparkSession, root: str | Path) -> dict[str, DataFrame]:
    """All tables of ``SCHEMAS`` from a root with ``datasets`` and ``registry`` folders and a list of reviewers."""

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [x for r in frame.itertuples() for x in _file_rows(r.kind, r.file, r.text or "")]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in PARSED.split(", ")])

    path = new_path(spark, "registry")
    documents(spark, root).mapInPandas(parse, PARSED).write.partitionBy("table").parquet(path)
    stored = spark.read.schema(PARSED).parquet(path)
    # Of catalog entries with one id the last file's, and no fault of the others.
    last = stored.where("kind = 'datasets' and table = 'datasets'").groupBy(F.lit("datasets").alias("kind"), "id").agg(F.max("file").alias("file"))
    out = {}
    for name, shape in SCHEMAS.items():
        rows = stored.where(F.col("table") == name)
        if name in ("datasets", "identifiers", "absent"):
            rows = rows.join(last, ["kind", "id", "file"], "left_semi")
        out[name] = rows.select(F.from_json("row", shape).alias("r")).select("r.*")
    return out
