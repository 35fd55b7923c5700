"""Published list files: found and verified first, then read through their declared roles.

A file that is missing or changed raises before any plan is built: a search is whole or not done.
"""

from __future__ import annotations

import hashlib
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path
from urllib.parse import unquote, urlparse
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from provena.functions import identifiers as ids
from provena.shared import written
from provena.sources import files, quoted


class SourceError(Exception):
    """A list file is missing, or isn't the one that was recorded."""


def sha256_file(path: str | Path) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def address(path: str | Path) -> str:
    """A local path as an address that Spark reads; other addresses stay as they are."""
    text = str(path)
    return text if "://" in text else "file://" + (text.removeprefix("file:") if text.startswith("file:") else str(Path(text).absolute()))


def committed_facts(spark: SparkSession, root: str | Path, named: DataFrame) -> DataFrame:
    """(name, path, size, sha256, parent) of the files under the root with one of the given names, relative to it."""
    base = F.lit(address(root).split("://", 1)[1].rstrip("/") + "/")
    place = F.regexp_replace("path", r"^\w+:/+", "/")
    name = F.substr(place, F.instr(place, base) + F.length(base)).alias("name")
    found = files.listed(spark, address(root)).withColumn("name", name).join(named, "name", "left_semi")
    return files.facts(found.select("path", "size")).withColumn("name", name)


def located(sources: DataFrame, root: str | Path, folder: str | Path | None = None) -> DataFrame:
    """The sources with ``path`` and ``how`` (snapshot, folder or extract), or ``problem`` where a list isn't there or isn't the recorded one.

    The files that sources name under the root and those in the publisher's folder are hashed by tasks, and met by name. A source with a snapshot has nothing else; the others
    are looked for in the folder, under the last part of their address, and then as an extract that names them.
    """
    spark = sources.sparkSession
    named = sources.select(F.explode(F.array_compact(F.array("snapshot", "extract"))).alias("name")).distinct()
    inside = written(committed_facts(spark, root, named).withColumnRenamed("path", "at"), "facts")
    kept = lambda column, own: inside.select(F.col("name").alias(column), F.col("at").alias(f"{own}_at"), F.col("sha256").alias(f"{own}_sha256"), F.col("parent").alias(f"{own}_parent"))
    last = F.element_at(F.split(F.regexp_replace(F.regexp_replace("url", r"^\w+://[^/?#]*", ""), "[?#].*$", ""), "/"), -1)
    rows = sources.withColumn("file_", F.url_decode(F.replace(last, F.lit("+"), F.lit("%2B"))))
    rows = rows.join(kept("snapshot", "s"), "snapshot", "left").join(kept("extract", "e"), "extract", "left")
    if folder is not None:
        found = files.facts(files.listed(spark, address(folder)))
        found = found.select(F.element_at(F.split("path", "/"), -1).alias("file_"), F.col("path").alias("f_at"), F.col("sha256").alias("f_sha256"))
        rows = rows.join(written(found, "facts"), "file_", "left")
    else:
        rows = rows.withColumn("f_at", F.lit(None).cast("string")).withColumn("f_sha256", F.lit(None).cast("string"))
    whole, own, cut = (F.col("s_sha256") == F.col("sha256")), (F.col("f_sha256") == F.col("sha256")), (F.col("e_parent") == F.col("sha256"))
    fixed = F.col("snapshot").isNotNull()
    how = F.when(fixed & whole, "snapshot").when(~fixed & own, "folder").when(~fixed & cut, "extract")
    said = F.when(fixed, F.concat("snapshot", F.lit(" is missing or has another hash than the recorded one"))).when(
        F.col("extract").isNotNull(), F.concat("extract", F.lit(" is missing or names another file than the recorded one"))
    ).otherwise(F.concat(F.coalesce("source", F.lit("the source")), F.lit(" is not committed" if folder is None else " is neither committed nor, as recorded, in the folder")))
    path = F.when(how == "snapshot", F.col("s_at")).when(how == "folder", F.col("f_at")).when(how == "extract", F.col("e_at"))
    return rows.select(*(F.col(c) for c in sources.columns), how.alias("how"), path.alias("path"), F.when(how.isNull(), said).alias("problem"))


def declared_parent(path: str | Path, lines: int = 10) -> str | None:
    """The hash of the publisher's file that an extract names among its first comment lines."""
    with open(path, encoding="utf-8") as f:
        for _, line in zip(range(lines), f, strict=False):
            if not line.startswith("#"):
                return None
            _, mark, rest = line.partition("derived-from-sha256:")
            if mark:
                return rest.strip()
    return None


def in_folder(folder: str | Path) -> Callable[[dict], Path]:
    """Finds a source by the file name in its address, and checks its hash."""

    def locate(source: dict) -> Path:
        path = Path(folder) / unquote(urlparse(source["url"]).path).rsplit("/", 1)[-1]
        if not path.is_file():
            raise SourceError(f"{path} is missing")
        if sha256_file(path) != source["sha256"]:
            raise SourceError(f"{path} has another hash than the recorded one")
        return path

    return locate


def committed(root: str | Path, otherwise: Callable[[dict], Path] | None = None) -> Callable[[dict], Path]:
    """Finds a source's snapshot, else asks ``otherwise``, else its extract."""

    def locate(source: dict) -> Path:
        if name := source.get("snapshot"):
            path = Path(root) / name
            if not path.is_file() or sha256_file(path) != source["sha256"]:
                raise SourceError(f"{name} is missing or has another hash than the recorded one")
            return path
        failed = None
        if otherwise:
            try:
                return otherwise(source)
            except SourceError as e:
                failed = e
        if name := source.get("extract"):
            path = Path(root) / name
            if not path.is_file() or declared_parent(path) != source["sha256"]:
                raise SourceError(f"{name} is missing or names another file than the recorded one")
            return path
        raise failed or SourceError(f"{source.get('name') or source.get('source')} is not committed")

    return locate


def _sheet(path: str) -> Iterator[list[str | None]]:
    """The rows of a workbook's first sheet, as the cells are stored."""
    main = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    rel = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
    system, at = files.opened(path)
    with system.open_input_file(at) as stored, zipfile.ZipFile(stored) as z:
        words = []
        if "xl/sharedStrings.xml" in z.namelist():
            words = ["".join(t.text or "" for t in si.iter(f"{main}t")) for si in ElementTree.parse(z.open("xl/sharedStrings.xml")).getroot()]
        first = ElementTree.parse(z.open("xl/workbook.xml")).getroot().find(f"{main}sheets")[0].get(rel)
        links = {x.get("Id"): x.get("Target") for x in ElementTree.parse(z.open("xl/_rels/workbook.xml.rels")).getroot()}
        target = links[first].lstrip("/")
        with z.open(target if target.startswith("xl/") else f"xl/{target}") as f:
            for _, node in ElementTree.iterparse(f):
                if node.tag != f"{main}row":
                    continue
                row: dict[int, str | None] = {}
                for n, cell in enumerate(node):
                    letters = "".join(c for c in cell.get("r") or "" if c.isalpha())
                    at = sum((ord(c) - 64) * 26**k for k, c in enumerate(reversed(letters))) - 1 if letters else n
                    value = cell.find(f"{main}v")
                    if cell.get("t") == "inlineStr":
                        row[at] = "".join(t.text or "" for t in cell.iter(f"{main}t"))
                    elif value is not None and value.text is not None:
                        row[at] = words[int(value.text)] if cell.get("t") == "s" else value.text
                yield [row.get(k) for k in range(max(row, default=-1) + 1)]
                node.clear()


def sheet_rows(path: str | Path) -> Iterator[dict[str, str | None]]:
    """Rows by column name; the header is stripped and rows without any cell are skipped."""
    rows = _sheet(str(path))
    names = [(c or "").strip() for c in next(rows, [])]
    for row in rows:
        if any(c is not None for c in row):
            yield {n: row[k] if k < len(row) else None for k, n in enumerate(names)}


class WorkbookSource(DataSource):
    """``spark.read.format("workbook").load(path)``: a workbook or a folder of workbooks with the same columns, one task for each; all columns are text, ``row`` counts from 1 in each file.

    A folder's rows also have ``file``, the name of theirs.
    """

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def _books(self) -> tuple[list[str], bool]:
        from pyarrow import fs

        path = self.options["path"]
        system, at = files.opened(path)
        if system.get_file_info(at).type != fs.FileType.Directory:
            return [path], False
        inside = system.get_file_info(fs.FileSelector(at, recursive=True))
        found = sorted(x.path for x in inside if x.type == fs.FileType.File and x.path.endswith((".xlsx", ".xlsm")) and not x.base_name.startswith(("_", ".")))
        return [path.rstrip("/") + x.removeprefix(at.rstrip("/")) for x in found], True

    def schema(self) -> str:
        books, many = self._books()
        names = next(_sheet(books[0]), []) if books else []
        return ", ".join(["row long", *(["file string"] if many else []), *(f"`{(n or '').strip()}` string" for n in names)])

    def reader(self, schema) -> DataSourceReader:
        books, many = self._books()
        return _WorkbookReader(books, many, schema.names[1 + many :])


class _WorkbookReader(DataSourceReader):
    def __init__(self, books: list[str], many: bool, names: list[str]):
        self.books, self.many, self.names = books, many, names

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(book) for book in self.books]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        file = [partition.value.rsplit("/", 1)[-1]] * self.many
        for n, row in enumerate(sheet_rows(partition.value), start=1):
            yield n, *file, *(row.get(c) for c in self.names)


def workbooks(spark: SparkSession, path: str | Path) -> DataFrame:
    spark.dataSource.register(WorkbookSource)
    return spark.read.format("workbook").load(address(path))


def read_list(spark: SparkSession, path: str | Path) -> DataFrame:
    """A list file's rows as text columns beside ``row``, which counts from 1 in the file's order.

    CSV of any size is read in parallel, with line breaks inside quotes too. Lines that begin with # are dropped where a row would begin. A workbook is read by one task.
    """
    if str(path).endswith((".xlsx", ".xlsm")):
        return workbooks(spark, path)
    path = address(path)
    lines = spark.read.text(path).where(~F.col("value").startswith("#"))
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"')))
    if lines.where(quotes % 2 == 1).limit(1).count():
        return quoted.rows(spark, path)
    rows = spark.read.csv(path, header=True, comment="#", quote='"', escape='"')
    if not rows.columns:
        return spark.createDataFrame([], "row long")
    return numbered(rows.select("*", F.col("_metadata.file_block_start").alias("block_"))).drop("block_")


def numbered(rows: DataFrame) -> DataFrame:
    """Adds ``row`` to rows read from one file, with ``block_``, the place in the file where their part begins.

    The parts are counted first. A row's number is its place in its part and the rows of all parts before, which come by a join with one small row for each part of the file
    (20 MB for a million parts).
    """
    placed = rows.withColumn("id_", F.monotonically_increasing_id())
    parts = placed.groupBy("block_").agg(F.count("*").alias("n_"), F.min("id_").alias("first_"))
    before = F.coalesce(F.sum("n_").over(Window.orderBy("block_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("block_", (before - F.col("first_") + 1).alias("shift_"))
    placed = placed.join(F.broadcast(parts), "block_")
    return placed.select((F.col("id_") + F.col("shift_")).alias("row"), *(F.col(f"`{c}`") for c in rows.columns))


def projected(rows: DataFrame, roles: dict[str, list[str]], join_column: str | None = None) -> DataFrame:
    """Rows as records, through roles: role to column names; only ``accession`` may name several.

    A column that isn't there reads as empty. Blank cells give null or no tokens.
    """
    if not roles:
        raise ValueError("a source without roles can't be read")
    nothing = F.lit(None).cast("string")

    def cell(role: str) -> Column:
        name = (roles.get(role) or [None])[0]
        return F.col(f"`{name}`") if name in rows.columns else nothing

    def words(role: str) -> Column:
        t = ids.text(cell(role))
        return F.when(t != "", t).alias(role)

    found = [ids.accessions(F.col(f"`{c}`")) for c in roles.get("accession", []) if c in rows.columns]
    accessions = F.array_distinct(F.concat(*found)) if found else F.array().cast("array<string>")
    joined = F.col(f"`{join_column}`") if join_column in rows.columns else nothing
    return rows.select(
        "row", words("project"), words("sample"), words("title"), words("citation"), ids.cells(cell("cells")).alias("cells"), accessions.alias("accessions"),
        ids.pmids(cell("pmid")).alias("pmids"), F.array_distinct(F.concat(ids.dois(cell("doi")), ids.dois(cell("pmid")))).alias("dois"), joined.alias("join_cell"),
    )


def records(spark: SparkSession, sources: list[dict], locate: Callable[[dict], Path]) -> DataFrame:
    """The records of all files of all sources: rows of the ``sources`` table as dicts."""
    from provena.operators import matching

    out = None
    for s in sources:
        part = projected(read_list(spark, locate(s)), s["roles"], s.get("join_column"))
        part = part.select(F.lit(s["model"]).alias("model"), F.lit(s["stage"]).alias("stage"), F.lit(s["source"]).alias("source"), *part.columns)
        if s.get("join_column"):
            tables = None
            for k, t in enumerate(s["join_tables"]):
                rows = read_list(spark, locate(t if isinstance(t, dict) else t.asDict())).withColumn("ord", F.lit(k))
                tables = rows if tables is None else tables.unionByName(rows, allowMissingColumns=True)
            part = matching.through_collections(part, matching.first_answers(tables))
        else:
            part = part.drop("join_cell")
        out = part if out is None else out.unionByName(part)
    return out
