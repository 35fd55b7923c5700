"""Files as rows, handled by tasks: written one for each row with a commit, hashed as streams, and put together in order.

Paths are addresses of a store that pyarrow opens (local, HDFS, object stores). The driver lists names and moves finished files; their contents stay with the tasks.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

#: Bytes that a task reads at once, and how many of a file's first bytes are looked through for comments.
CHUNK, HEAD = 8 << 20, 64 << 10
FACTS = "path string, size long, sha256 string, parent string"


def opened(path: str):
    """The file system and the place in it of an address, or of a local path."""
    from pyarrow import fs

    text = str(path)
    if text.startswith("file:"):
        text = "/" + text[5:].lstrip("/")
    if "://" not in text:
        return fs.LocalFileSystem(), text
    return fs.FileSystem.from_uri(quote(text, safe="/:@"))


@dataclass
class Written(WriterCommitMessage):
    stage: str
    names: list[str]


class FilesSource(DataSource):
    """``rows.write.format("files").mode("append").save(folder)``: each row (name, body) a file of the folder, whose name may hold slashes.

    Tasks write beside the folder's files, under a stage of their own; files get their names only when all tasks have ended, so a failed write leaves nothing that is read. Of
    rows with equal names the file of one stays.
    """

    @classmethod
    def name(cls) -> str:
        return "files"

    def schema(self) -> str:
        return "name string, body string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _FilesWriter(self.options["path"].rstrip("/"), f"_stage-{uuid.uuid4().hex}")


class _FilesWriter(DataSourceWriter):
    def __init__(self, folder: str, stage: str):
        self.folder, self.stage = folder, stage

    def write(self, iterator: Iterator) -> Written:
        system, at = opened(self.folder)
        own, names = f"{self.stage}/{uuid.uuid4().hex}", []
        for name, body in iterator:
            place = f"{at}/{own}/{name}"
            system.create_dir(place.rpartition("/")[0], recursive=True)
            with system.open_output_stream(place) as out:
                out.write(body if isinstance(body, (bytes, bytearray)) else (body or "").encode())
            names.append(name)
        return Written(own, names)

    def commit(self, messages: list) -> None:
        system, at = opened(self.folder)
        system.create_dir(at, recursive=True)
        known = {at}
        for message in messages:
            for name in message.names if message else []:
                above = f"{at}/{name}".rpartition("/")[0]
                if above not in known:
                    system.create_dir(above, recursive=True)
                    known.add(above)
                system.move(f"{at}/{message.stage}/{name}", f"{at}/{name}")
        self._clear(system, at)

    def abort(self, messages: list) -> None:
        self._clear(*opened(self.folder))

    def _clear(self, system, at: str) -> None:
        from pyarrow import fs

        if system.get_file_info(f"{at}/{self.stage}").type == fs.FileType.Directory:
            system.delete_dir(f"{at}/{self.stage}")


def write(rows: DataFrame, folder: str) -> None:
    """Write each row (name, body) as a file of the folder."""
    rows.sparkSession.dataSource.register(FilesSource)
    rows.select("name", "body").write.format("files").mode("append").save(str(folder))


def listed(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """(path, size) of the files anywhere under a folder whose name fits; no rows if there are none. Spark's readers pass over empty files, and so does this."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).schema("path string, modificationTime timestamp, length long, content binary")
    return rows.load(str(folder)).select("path", F.col("length").alias("size"))


def _parent(head: bytes, lines: int) -> str | None:
    """The hash that a file's first comment lines name as its publisher's file."""
    for line in head.decode("utf-8", "replace").split("\n")[:lines]:
        if not line.startswith("#"):
            return None
        _, mark, rest = line.partition("derived-from-sha256:")
        if mark:
            return rest.strip()
    return None


def facts(found: DataFrame, lines: int = 10) -> DataFrame:
    """(path, size, sha256, parent) of listed files of any size: each is read as a stream by one task, as its hash wants it whole and in order."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, size in zip(frame["path"], frame["size"], strict=True):
                system, at = opened(path)
                digest, head = hashlib.sha256(), b""
                with system.open_input_stream(at) as f:
                    while chunk := f.read(CHUNK):
                        head = head or bytes(chunk[:HEAD])
                        digest.update(chunk)
                yield pd.DataFrame({"path": [path], "size": [size], "sha256": [digest.hexdigest()], "parent": [_parent(head, lines)]})

    # One large file shouldn't wait behind another: listed files are dealt out by path.
    parts = max(1, int(found.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    return found.repartition(parts, "path").mapInPandas(read, FACTS)


def joined(rows: DataFrame, order: list[str], path: str, head: list[str]) -> None:
    """Write the column ``line`` of rows, in order, as one file under some first lines.

    The rows are sorted and written by ranges, as parts in the shared folder; then one task streams the parts into the file, which gets its name when it is whole. No row
    passes through the driver.
    """
    from provena.shared import dropped, new_path

    spark, place = rows.sparkSession, new_path(rows.sparkSession, "ranges")
    rows.orderBy(*order).select("line").write.text(place)
    names = sorted(r.path for r in listed(spark, place, "part-*").select("path").collect())

    def put(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _ in frames:
            system, at = opened(path)
            system.create_dir(at.rpartition("/")[0], recursive=True)
            fresh = f"{at}.{uuid.uuid4().hex}"
            with system.open_output_stream(fresh) as out:
                out.write("".join(f"{line}\n" for line in head).encode())
                for name in names:
                    source, where = opened(name)
                    with source.open_input_stream(where) as f:
                        while chunk := f.read(CHUNK):
                            out.write(chunk)
            system.move(fresh, at)
            yield pd.DataFrame({"done": [at]})

    spark.range(1).coalesce(1).mapInPandas(put, "done string").collect()
    dropped(spark, [place])
