"""Directly addressable codes: token-id files with random access to any token.

A segment keeps each id as one or more chunks of ``WIDTHS`` bits. Level 0 has the lowest chunk of all
ids and a bitmap that says which ids go on; level 1 has the next chunk of those, and so on. A rank
directory (set bits before each block of 512) turns a position in one level into the position in
the next, so any id is read from a few array cells, without decoding its neighbours.

Layout of a segment, little-endian: ``DAC1``, u32 size of the header, header (JSON: widths, levels, docs),
then per level chunks (u8), bitmap (bits, low first), rank directory (u64), at last doc_id (i64),
null flags (u8) and starts (i64, one more than documents).

A file is a row of segments, a list of them (JSON: offset, size, documents, ids of each), u64 size of the list, ``DACF``. It is written
and read a segment at a time. Files are opened with pyarrow, so the shared folder must be in a store that pyarrow opens by its address.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from provena.llm.common import new_path, only, range_bounds, shuffle_parts, text_of, written
from provena.llm.tokens import encoder

WIDTHS = (8, 8, 8, 8)
BLOCK = 512
#: A segment ends once it holds this many ids, and a file once its segments do.
SEGMENT_IDS, FILE_IDS = 2_000_000, 200_000_000
FILES = "part int, number int, path string, n_docs long, n_ids long"


def build(docs: list[tuple[int | None, np.ndarray]]) -> bytes:
    """The bytes of one segment."""
    rest = np.concatenate([ids for _, ids in docs]).astype(np.uint32) if docs else np.zeros(0, np.uint32)
    levels, blobs = [], []
    for width in WIDTHS:
        more = rest >> width > 0 if len(levels) < len(WIDTHS) - 1 else np.zeros(len(rest), bool)
        chunks = (rest & ((1 << width) - 1)).astype(np.uint8)
        bits = np.packbits(more, bitorder="little")
        ranks = np.concatenate([[0], np.cumsum(np.add.reduceat(more, np.arange(0, len(more), BLOCK), dtype=np.int64))]) if len(more) else np.zeros(1)
        levels.append([len(chunks), len(bits), len(ranks)])
        blobs += [chunks.tobytes(), bits.tobytes(), ranks.astype("<u8").tobytes()]
        rest = rest[more] >> width
        if not len(rest):
            break
    starts = np.cumsum([0, *(len(ids) for _, ids in docs)])
    head = json.dumps({"widths": WIDTHS, "levels": levels, "docs": len(docs)}).encode()
    null = np.array([d is None for d, _ in docs], np.uint8)
    return b"".join([b"DAC1", struct.pack("<I", len(head)), head, *blobs, np.array([d or 0 for d, _ in docs], "<i8").tobytes(), null.tobytes(), starts.astype("<i8").tobytes()])


class Reader:
    """Reads one segment's bytes: ``token(i)`` by rank, ``tokens(a, b)`` for a range, ``doc(k)`` for a document."""

    def __init__(self, data: bytes):
        if data[:4] != b"DAC1":
            raise ValueError("not a token file")
        size = struct.unpack_from("<I", data, 4)[0]
        head, at = json.loads(data[8 : 8 + size]), 8 + size
        self.widths, self.levels = head["widths"], []
        for n, n_bits, n_ranks in head["levels"]:
            chunks = np.frombuffer(data, np.uint8, n, at)
            bits = np.frombuffer(data, np.uint8, n_bits, at + n)
            ranks = np.frombuffer(data, "<u8", n_ranks, at + n + n_bits)
            self.levels.append((chunks, bits, ranks))
            at += n + n_bits + 8 * n_ranks
        n = head["docs"]
        null = np.frombuffer(data, np.uint8, n, at + 8 * n)
        self.doc_ids = [None if z else int(d) for d, z in zip(np.frombuffer(data, "<i8", n, at), null, strict=True)]
        self.starts = np.frombuffer(data, "<i8", n + 1, at + 9 * n)

    def _rank(self, level: int, at: int) -> int:
        """Set bits before a position."""
        _, bits, ranks = self.levels[level]
        block = at // BLOCK
        inside = np.unpackbits(bits[block * BLOCK // 8 : at // 8 + 1], bitorder="little")[: at - block * BLOCK]
        return int(ranks[block]) + int(inside.sum())

    def token(self, at: int) -> int:
        value = shift = 0
        for level, (chunks, bits, _) in enumerate(self.levels):
            value |= int(chunks[at]) << shift
            if not bits[at >> 3] >> (at & 7) & 1:
                break
            shift += self.widths[level]
            at = self._rank(level, at)
        return value

    def tokens(self, a: int, b: int) -> np.ndarray:
        out = np.zeros(b - a, np.uint32)
        where, shift = np.arange(b - a), 0
        for level, (chunks, bits, _) in enumerate(self.levels):
            if a == b:
                break
            out[where] |= chunks[a:b].astype(np.uint32) << np.uint32(shift)
            first = a // 8
            more = np.unpackbits(bits[first : (b + 7) // 8], bitorder="little")[a - 8 * first : b - 8 * first].astype(bool)
            where, shift = where[more], shift + self.widths[level]
            if len(where):
                a = self._rank(level, a)
                b = a + len(where)
            else:
                break
        return out

    def doc(self, k: int) -> np.ndarray:
        return self.tokens(int(self.starts[k]), int(self.starts[k + 1]))


class FileWriter:
    """Writes one file, segment by segment."""

    def __init__(self, path: str):
        from pyarrow import fs

        system, at = fs.FileSystem.from_uri(path)
        system.create_dir(at.rpartition("/")[0], recursive=True)
        self.path, self.out, self.segments, self.at, self.ids = path, system.open_output_stream(at), [], 0, 0

    def add(self, docs: list[tuple[int | None, np.ndarray]]) -> None:
        data = build(docs)
        self.out.write(data)
        self.segments.append([self.at, len(data), len(docs), sum(len(ids) for _, ids in docs)])
        self.at += len(data)
        self.ids += self.segments[-1][3]

    def close(self) -> tuple[str, int, int]:
        """(path, documents, ids)."""
        listed = json.dumps(self.segments).encode()
        self.out.write(listed + struct.pack("<Q", len(listed)) + b"DACF")
        self.out.close()
        return self.path, sum(x[2] for x in self.segments), self.ids


class FileReader:
    """Reads a file: ``segments`` one by one, ``token(i)`` from its own segment only."""

    def __init__(self, path: str):
        from pyarrow import fs

        system, at = fs.FileSystem.from_uri(path)
        self.file = system.open_input_file(at)
        size = self.file.size()
        listed, mark = struct.unpack("<Q4s", self.file.read_at(12, size - 12))
        if mark != b"DACF":
            raise ValueError(f"{path} is not a token file")
        self.listed = json.loads(self.file.read_at(listed, size - 12 - listed))
        self.starts = np.cumsum([0, *(x[3] for x in self.listed)])
        self._levels: dict[int, list[tuple[int, int, int, int]]] = {}

    def segment(self, k: int) -> Reader:
        return Reader(self.file.read_at(self.listed[k][1], self.listed[k][0]))

    def segments(self) -> Iterator[tuple[int, Reader]]:
        """(ids before it, segment) of each segment."""
        for k in range(len(self.listed)):
            yield int(self.starts[k]), self.segment(k)

    def token(self, at: int) -> int:
        """One token, from a few cells of the file: for each level a chunk and a byte of the bitmap, and where the id goes on a rank and the bitmap of a part of a block."""
        k = int(np.searchsorted(self.starts, at, side="right")) - 1
        at -= int(self.starts[k])
        value = shift = 0
        for width, chunks, bits, ranks in self._places(k):
            value |= self.file.read_at(1, chunks + at)[0] << shift
            if not self.file.read_at(1, bits + (at >> 3))[0] >> (at & 7) & 1:
                break
            shift += width
            block = at // BLOCK
            before = np.frombuffer(self.file.read_at(at // 8 + 1 - block * BLOCK // 8, bits + block * BLOCK // 8), np.uint8)
            inside = np.unpackbits(before, bitorder="little")[: at - block * BLOCK]
            at = struct.unpack("<Q", self.file.read_at(8, ranks + 8 * block))[0] + int(inside.sum())
        return value

    def _places(self, k: int) -> list[tuple[int, int, int, int]]:
        """(width, place of the chunks, of the bitmap, of the ranks) of each level of a segment, from its header; kept, as it is small."""
        if k not in self._levels:
            begin = self.listed[k][0]
            mark, size = struct.unpack("<4sI", self.file.read_at(8, begin))
            if mark != b"DAC1":
                raise ValueError("not a token file")
            head, at, found = json.loads(self.file.read_at(size, begin + 8)), begin + 8 + size, []
            for width, (n, n_bits, n_ranks) in zip(head["widths"], head["levels"], strict=False):
                found.append((width, at, at + n, at + n + n_bits))
                at += n + n_bits + 8 * n_ranks
            self._levels[k] = found
        return self._levels[k]


def write_files(docs: DataFrame, tokenizer: str, end_id: int = 2, folder: str | None = None) -> DataFrame:
    """Encode every text, append ``end_id``, write files in ascending doc_id order; returns their list.

    The list has (part, number, path, n_docs, n_ids), ordered by part and number. Texts are encoded where they
    are read; only ids move. Rows of equal doc_id are ordered by their ids; null doc_ids come
    first; null texts are empty; an empty table gives no files; other columns are ignored. A file's name is new for each
    attempt and the list names those of finished tasks only, so lost executors leave at most
    unlisted files.
    """
    spark = docs.sparkSession
    docs = only(docs, ("doc_id", "long"), ("text", "string"))
    folder = folder or new_path(spark, "token-files")
    if "://" not in folder:
        folder = f"file://{folder}" if folder.startswith("/") else folder.replace("file:/", "file:///", 1)
    bounds = range_bounds(docs, "doc_id", shuffle_parts(spark))
    end = np.array([end_id], "<u4").tobytes()

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(tokenizer)
        cuts = np.array(bounds, np.int64)
        for frame in frames:
            texts = text_of(frame["text"])
            for at in range(0, len(texts), 256):
                key = frame["doc_id"].iloc[at : at + 256]
                null = key.isna().to_numpy()
                part = np.where(null, 0, np.searchsorted(cuts, key.fillna(0).to_numpy(np.int64), side="right"))
                ids = [narrow(x + end) for x in enc.ids(texts[at : at + 256])]
                yield pd.DataFrame({"part": part.astype(np.int32), "doc_id": key.astype("Int64").to_numpy(), "ids": ids})

    def store(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept, size, part, number, file = [], 0, None, 0, None

        def close() -> pd.DataFrame:
            path, n_docs, n_ids = file.close()
            return pd.DataFrame({"part": [part], "number": [number], "path": [path], "n_docs": [n_docs], "n_ids": [n_ids]})

        for frame in frames:
            for p, doc, ids in zip(frame["part"].tolist(), frame["doc_id"].tolist(), frame["ids"], strict=True):
                if kept and (p != part or size >= SEGMENT_IDS):
                    file.add(kept)
                    kept, size = [], 0
                if file and (p != part or file.ids >= FILE_IDS):
                    yield close()
                    file, number = None, number + 1 if p == part else 0
                part = p
                file = file or FileWriter(f"{folder}/{part:06d}-{number:06d}-{uuid.uuid4().hex}.dac")
                kept.append((None if pd.isna(doc) else int(doc), widen(ids)))
                size += len(kept[-1][1])
        if kept:
            file.add(kept)
            yield close()

    coded = docs.mapInPandas(encode, "part int, doc_id long, ids binary")
    dealt = coded.repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions("doc_id", "ids")
    return written(dealt.mapInPandas(store, FILES), "token-file-list")


def narrow(ids: bytes) -> bytes:
    """A byte that gives the width, then the ids with two bytes each if they fit."""
    x = np.frombuffer(ids, "<u4")
    return b"2" + x.astype("<u2").tobytes() if not len(x) or x.max() < 1 << 16 else b"4" + ids


def widen(ids: bytes) -> np.ndarray:
    return np.frombuffer(ids, "<u2" if ids[:1] == b"2" else "<u4", offset=1)


def read_files(files: DataFrame) -> DataFrame:
    """(doc_id, start, ids) of the documents in listed files; start counts the ids of all files before.

    The driver adds up one number for each part, of which there are as many as shuffle partitions at most; files are added up within
    their part.
    """
    spark = files.sparkSession
    sums, bases = files.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect(), []
    total = 0
    for part, n in sums:
        bases.append((part, total))
        total += n
    before = Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    listed = files.withColumn("before", F.coalesce(F.sum("n_ids").over(before), F.lit(0).cast("long")))
    listed = listed.join(F.broadcast(spark.createDataFrame(bases, "part int, first long")), "part").select("path", (F.col("first") + F.col("before")).alias("base"))

    def load(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, base in zip(frame["path"], frame["base"], strict=True):
                for first, segment in FileReader(path).segments():
                    for at in range(0, len(segment.doc_ids), 256):
                        ks = range(at, min(at + 256, len(segment.doc_ids)))
                        yield pd.DataFrame({
                            "doc_id": pd.array([segment.doc_ids[k] for k in ks], "Int64"),
                            "start": [int(base + first + segment.starts[k]) for k in ks],
                            "ids": [segment.doc(k).astype("<u4").tobytes() for k in ks],
                        })

    return listed.repartition(shuffle_parts(spark), "path").mapInPandas(load, "doc_id long, start long, ids binary")


def digest(read: DataFrame) -> DataFrame:
    return read.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
