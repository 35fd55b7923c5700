"""Alignment of two tokenizers: one sweep over the places where their tokens end.

Both encode a document's bytes, so a place where tokens of both end cuts both rows of tokens into groups, and an A and a B token are linked where their
bytes overlap. ``events`` gives each side's token ends as rows, a run of tokens each (ids; their bytes, and so their ends, follow from the vocabulary). The
union of both sides is dealt by document and sorted by offset within partitions, and ``sweep`` streams through it. What it carries from one batch of
rows to the next is the open group of the last document, whatever the document's length; all else it has passed on. Within a batch it works on marks, one
for each byte, with numpy.

How many links hold an id pair is counted over all documents. Links are gathered in sheets of some million links, each with the distinct pairs of
its documents. Pairs are counted by sheet and then over sheets, and every sheet gets back the counts of its own pairs by a join, so neither the driver nor
a task ever holds all pairs.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from provena.llm.common import held, only, portions, written
from provena.llm.tokens import Encoder, byte_letters

A, B = 0, 1
#: Tokens in one row of events, tokens that a sweep works on at once, and links after which a sheet ends.
RUN, WORK, SHEET = 1 << 17, 1 << 19, 3_000_000
EVENTS = "k1 long, k2 long, doc_id long, no_id boolean, side int, begin long, ids binary"
ORDER = ["k1", "k2", "doc_id", "begin", "side"]


@dataclass(frozen=True)
class Pair:
    """The files of the two tokenizers: A of byte-level BPE, B of pieces with byte fallback."""

    a: str
    b: str


class Vocabulary:
    """Bytes of every id of both sides, and the ids of texts. ``texts`` stand without the blank that both sides put before them."""

    def __init__(self, files: Pair):
        import sentencepiece

        self.files, self._coder = files, None
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=files.b)
        self.b = [self._piece(i) for i in range(self.pieces.get_piece_size())]
        back = {letter: byte for byte, letter in byte_letters().items()}
        known = self.coder.tokenizer.get_vocab()
        self.a = [b""] * (max(known.values()) + 1)
        for token, i in known.items():
            self.a[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        self.sizes = [np.array([len(x) for x in side], np.int64) for side in (self.a, self.b)]

    @property
    def coder(self) -> Encoder:
        if self._coder is None:
            self._coder = Encoder(self.files.a, plain=True)
        return self._coder

    def _piece(self, i: int) -> bytes:
        piece = self.pieces.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.pieces.is_byte(i) else piece.replace("▁", " ").encode()

    def encoded(self, side: int, texts: list[str]) -> list[np.ndarray | None]:
        """Ids of each text; none where it is empty or where their bytes aren't its bytes after a blank."""
        if side == A:
            found = [np.frombuffer(x, "<u4") for x in self.coder.ids([" " + t for t in texts])]
        else:
            found = [np.array(x, np.uint32) for x in self.pieces.encode(texts, num_threads=1)]
        of = (self.a if side == A else self.b).__getitem__
        return [ids if text and b"".join(map(of, ids.tolist())) == b" " + text.encode() else None for ids, text in zip(found, texts, strict=True)]


def vocabulary(files: Pair) -> Vocabulary:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return held(("alignment", files), lambda: Vocabulary(files))


def packed(values: np.ndarray) -> bytes:
    """Integers below 2^32, byte by byte, compressed: small ones take little room."""
    return b"%d:" % len(values) + pa.compress(np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), "zstd", asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    n, _, rest = data.partition(b":")
    planes = np.frombuffer(pa.decompress(rest, 4 * int(n), "zstd", asbytes=True), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def keyed(docs: DataFrame) -> DataFrame:
    """(k1, k2, doc_id, no_id, text): two 64-bit hashes tell rows apart that share a doc_id. A null doc_id is 0 with a mark, as pandas has no null integers."""
    rows = only(docs, ("doc_id", "long"), ("text", "string")).withColumn("text", F.coalesce("text", F.lit("")))
    keys = [F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64("text", "doc_id", F.lit(1)).alias("k2")]
    return rows.select(*keys, F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("no_id"), "text")


def events(rows: DataFrame, side: int, files: Pair, run: int = RUN) -> DataFrame:
    """(k1, k2, doc_id, side, begin, ids): runs of one side's tokens, whole texts encoded at once; a text without tokens has one row that begins at -1."""

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = vocabulary(files)
        for frame in frames:
            texts = frame["text"].tolist()
            for at in portions(texts, 256, 1 << 21):
                found, keys = [], frame.iloc[at]
                for k, ids in enumerate(known.encoded(side, texts[at])):
                    if ids is None:
                        found.append((k, -1, b""))
                        continue
                    ends = np.cumsum(known.sizes[side][ids])
                    found += [(k, int(ends[i - 1]) if i else 0, packed(ids[i : i + run])) for i in range(0, len(ids), run)]
                own = keys.iloc[[k for k, _, _ in found]]
                yield pd.DataFrame({
                    **{name: own[name].to_numpy() for name in ("k1", "k2", "doc_id", "no_id")}, "side": np.int32(side),
                    "begin": [b for _, b, _ in found], "ids": [x for _, _, x in found],
                })

    return rows.mapInPandas(encode, EVENTS)


@dataclass
class Document:
    """One document of the sweep: rows that equal it, what was counted so far, and the tokens of its open group."""

    key: tuple
    first: tuple
    copies: int = 1
    last: tuple | None = None
    n: list[int] = field(default_factory=lambda: [0, 0])
    groups: int = 0
    links: int = 0
    bytes: int = 0
    hash: object = None
    open: list[list[np.ndarray]] = field(default_factory=lambda: [[], []])


@dataclass
class Part:
    """Closed groups of some documents, in order. Places are bytes from the begin of the part; ``bounds`` are the documents' ends there."""

    docs: list[Document]
    done: list[bool]
    bounds: np.ndarray
    #: Ids and ends of both sides' tokens.
    ids: list[np.ndarray]
    ends: list[np.ndarray]
    #: Where groups end, the group of each token, and the number of groups of each document.
    cuts: np.ndarray
    groups: list[np.ndarray]
    n_groups: np.ndarray
    #: Of each link its end and the two tokens, and the number of links of each document.
    link_ends: np.ndarray
    link_tokens: list[np.ndarray]
    n_links: np.ndarray

    def owner(self, counts: np.ndarray) -> np.ndarray:
        """The place of each group's or link's document."""
        return np.repeat(np.arange(len(self.docs)), counts)


def sweep(frames: Iterator[pd.DataFrame], known: Vocabulary, work: int = WORK) -> Iterator[Part]:
    """Parts of a stream of events, sorted by ``ORDER``; every document comes once, over one or more parts. Repeated rows are counted as copies."""
    docs: list[Document] = []
    waiting = 0
    for frame in frames:
        columns = [frame[name].tolist() for name in ("k1", "k2", "doc_id", "no_id", "begin", "side", "ids")]
        for k1, k2, doc_id, no_id, begin, side, ids in zip(*columns, strict=True):
            key, place = (k1, k2, None if no_id else doc_id), (begin, side)
            if not docs or docs[-1].key != key:
                if waiting >= work:
                    yield _closed(docs, known, True)
                    docs, waiting = [], 0
                docs.append(Document(key, place))
            elif place == docs[-1].last:  # a repeated row
                docs[-1].copies += place == docs[-1].first
                continue
            doc = docs[-1]
            doc.last = place
            if doc.first[0] >= 0:
                doc.open[side].append(unpacked(ids))
                waiting += len(doc.open[side][-1])
            if waiting >= 2 * work:  # a long document: what is closed goes on
                yield _closed(docs, known, False)
                docs = docs[-1:]
                waiting = sum(len(x) for own in docs[0].open for x in own)
                work = max(work, waiting)  # a group that stays open is not swept again and again
    if docs:
        yield _closed(docs, known, True)


def _closed(docs: list[Document], known: Vocabulary, ended: bool) -> Part:
    """The part up to the last place where both sides end; the rest stays open in the last document, unless it has ended."""
    none = np.zeros(0, np.uint32)
    ids = [np.concatenate([none, *(x for d in docs for x in d.open[side])]) for side in (A, B)]
    ends = [np.cumsum(known.sizes[side][ids[side]]) for side in (A, B)]
    size = int(max((e[-1] for e in ends if len(e)), default=0))
    marks = [np.zeros(size + 1, bool) for _ in ends]
    for mark, e in zip(marks, ends, strict=True):
        mark[e] = True
    both = marks[A] & marks[B]
    cuts = np.flatnonzero(both)
    last = int(cuts[-1]) if len(cuts) else 0
    whole = [int(sum(known.sizes[A][x].sum() for x in d.open[A])) for d in docs[:-1]]
    bounds = np.cumsum([*whole, 0])
    bounds[-1] = last  # of the last document what is closed; all of it if it has ended
    kept = [int(np.searchsorted(e, last, side="right")) for e in ends]
    rest = [i[k:] for i, k in zip(ids, kept, strict=True)]
    ids, ends = [i[:k] for i, k in zip(ids, kept, strict=True)], [e[:k] for e, k in zip(ends, kept, strict=True)]
    either = np.flatnonzero((marks[A] | marks[B])[: last + 1])
    tokens = [np.cumsum(m[: last + 1], dtype=np.int32)[either] - m[either] for m in marks]  # tokens that have ended before
    closed = np.cumsum(both, dtype=np.int32)
    per = [np.diff(np.searchsorted(x, bounds, side="right"), prepend=0) for x in (*ends, cuts, either)]
    for d, a, b, n_groups, n_links in zip(docs, *(x.tolist() for x in per), strict=True):
        d.open = [[], []]
        d.n = [d.n[A] + a, d.n[B] + b]
        d.groups += n_groups
        d.links += n_links
    docs[-1].open = [[r] if len(r) else [] for r in rest]
    return Part(docs, [True] * (len(docs) - 1) + [ended], bounds, ids, ends, cuts, [closed[e] - both[e] for e in ends], per[2], either, tokens, per[3])


class Writer:
    """Groups as text: ``a1,a2|b1;a3|b2,b3`` in decimal ids. Every id with each mark behind it is looked up in a table of bytes."""

    def __init__(self, known: Vocabulary):
        n = max(len(known.a), len(known.b))
        self.width = len(str(n - 1)) + 1
        self.table = np.zeros((3, n, self.width), np.uint8)
        for i in range(n):
            for k, mark in enumerate(",|;"):
                text = f"{i}{mark}".encode()
                self.table[k, i, : len(text)] = np.frombuffer(text, np.uint8)

    def add(self, part: Part) -> None:
        """Pass each document's groups of this part to its hash."""
        group = part.groups
        per = [np.bincount(g, minlength=len(part.cuts)) for g in group]
        upto = [np.cumsum(p) for p in per]
        places = [np.arange(len(group[A])) + (upto[B] - per[B])[group[A]], np.arange(len(group[B])) + upto[A][group[B]]]
        ids, marks = np.zeros(len(group[A]) + len(group[B]), np.int64), np.zeros(len(group[A]) + len(group[B]), np.int8)
        for side in (A, B):
            ids[places[side]] = part.ids[side]
            marks[places[side][upto[side] - 1]] = 1 + side
        cells = self.table[marks, ids]
        shown = cells != 0
        text = cells[shown].tobytes()
        size = np.concatenate([[0], np.cumsum(shown.sum(1))])
        rows = np.concatenate([[0], upto[A] + upto[B]])[np.cumsum(part.n_groups)]
        at = 0
        for doc, end in zip(part.docs, size[rows].tolist(), strict=True):
            if end > at:
                fresh = doc.hash is None
                doc.hash = doc.hash or hashlib.sha256()
                doc.hash.update((b"" if fresh else b";") + text[at : end - 1])
            at = end


def aligned(docs: DataFrame, files: Pair, shape: str, emit: Callable[[Iterator[Part], Vocabulary], Iterator[pd.DataFrame]], work: int = WORK) -> DataFrame:
    """What ``emit`` makes of the parts of each partition's sweep."""
    rows = keyed(docs)
    union = events(rows, A, files, min(RUN, work)).unionByName(events(rows, B, files, min(RUN, work)))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = vocabulary(files)
        yield from emit(sweep(frames, known, work), known)

    return union.repartition("k1", "k2").sortWithinPartitions(*ORDER).mapInPandas(run, shape)


def groups(docs: DataFrame, files: Pair, work: int = WORK) -> DataFrame:
    """(doc_id, k1, k2, begin, end, a, b): each group with its bytes, counted in the text after its leading blank, and both sides' ids."""

    def emit(parts: Iterator[Part], known: Vocabulary) -> Iterator[pd.DataFrame]:
        for p in parts:
            owner = p.owner(p.n_groups)
            base = np.array([d.bytes for d in p.docs]) - np.concatenate([[0], p.bounds[:-1]])
            starts = np.concatenate([[0], p.cuts[:-1]]) if len(p.cuts) else p.cuts
            sides = [np.split(i, np.searchsorted(e, p.cuts[:-1], side="right")) if len(p.cuts) else [] for i, e in zip(p.ids, p.ends, strict=True)]
            yield _rows(p, owner, {"begin": starts + base[owner], "end": p.cuts + base[owner], "a": [x.astype(np.int32) for x in sides[A]], "b": [x.astype(np.int32) for x in sides[B]]})
            _passed(p)

    return aligned(docs, files, "doc_id long, k1 long, k2 long, begin long, end long, a array<int>, b array<int>", emit, work)


def links(docs: DataFrame, files: Pair, work: int = WORK) -> DataFrame:
    """(doc_id, k1, k2, begin, end, a, b): each linked A and B token with the bytes that both hold."""

    def emit(parts: Iterator[Part], known: Vocabulary) -> Iterator[pd.DataFrame]:
        for p in parts:
            owner = p.owner(p.n_links)
            base = np.array([d.bytes for d in p.docs]) - np.concatenate([[0], p.bounds[:-1]])
            starts = np.concatenate([[0], p.link_ends[:-1]]) if len(p.link_ends) else p.link_ends
            yield _rows(p, owner, {"begin": starts + base[owner], "end": p.link_ends + base[owner], "a": p.ids[A][p.link_tokens[A]].astype(np.int32), "b": p.ids[B][p.link_tokens[B]].astype(np.int32)})
            _passed(p)

    return aligned(docs, files, "doc_id long, k1 long, k2 long, begin long, end long, a int, b int", emit, work)


def _rows(p: Part, owner: np.ndarray, columns: dict) -> pd.DataFrame:
    keys = [p.docs[k].key for k in owner]
    frame = pd.DataFrame({"doc_id": pd.array([k[2] for k in keys], "Int64"), "k1": [k[0] for k in keys], "k2": [k[1] for k in keys], **columns})
    return frame.iloc[np.repeat(np.arange(len(owner)), [p.docs[k].copies for k in owner])]


def _passed(p: Part) -> None:
    for d, a, b in zip(p.docs, [0, *p.bounds[:-1].tolist()], p.bounds.tolist(), strict=True):
        d.bytes += b - a


SHEETS = (
    "sheet long, doc_id array<long>, no_id array<boolean>, copies array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>, "
    "pairs array<long>, totals array<long>, rows binary, steps binary, times binary"
)


def sheets(docs: DataFrame, files: Pair, size: int = SHEET, work: int = WORK) -> DataFrame:
    """Counts and digests of documents, some thousand a row, with the distinct id pairs of their links.

    ``pairs`` (A id * 2^32 + B id, ascending) and ``totals`` count the sheet's links. For each document ``rows`` has how many distinct pairs it has; ``steps`` and
    ``times`` have their places in ``pairs``, as steps from the one before, and how often the document links them.
    """

    def emit(parts: Iterator[Part], known: Vocabulary) -> Iterator[pd.DataFrame]:
        writer, docs_, found, gathered, wide = Writer(known), [], [], 0, len(known.b)
        bits = (len(known.a) * wide).bit_length()
        for p in parts:
            writer.add(p)
            if docs_ and docs_[-1] is p.docs[0]:
                docs_.pop()
            code = p.ids[A][p.link_tokens[A]].astype(np.int64) * wide + p.ids[B][p.link_tokens[B]]
            found.append(_counted(p.owner(p.n_links) + len(docs_) << bits | code, None))
            docs_ += p.docs
            gathered += len(code)
            if gathered >= size and p.done[-1]:
                yield _sheet(docs_, found, bits, wide)
                docs_, found, gathered = [], [], 0
        if docs_:
            yield _sheet(docs_, found, bits, wide)

    return aligned(docs, files, SHEETS, emit, work)


def _counted(keys: np.ndarray, times: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, with the sum of their times (once each, if none are given)."""
    if times is None:
        keys = np.sort(keys)
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        return keys[first], np.diff(first, append=len(keys))
    if (np.diff(keys) > 0).all():
        return keys, times
    order = np.argsort(keys, kind="stable")
    keys, times = keys[order], times[order]
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[first], np.add.reduceat(times, first)


def _sheet(docs: list[Document], found: list[tuple], bits: int, wide: int) -> pd.DataFrame:
    keys, times = _counted(*(np.concatenate(x) for x in zip(*found, strict=True)))
    owner = keys >> bits
    pairs, place = np.unique(keys & (1 << bits) - 1, return_inverse=True)
    copies = np.array([d.copies for d in docs], np.int64)
    totals = np.zeros(len(pairs), np.int64)
    np.add.at(totals, place, times * copies[owner])
    rows = np.bincount(owner, minlength=len(docs))
    steps = np.diff(place, prepend=0)
    begins = (np.cumsum(rows) - rows)[rows > 0]
    steps[begins] = place[begins]
    row = {
        "sheet": int.from_bytes(os.urandom(8), "little", signed=True), "doc_id": [d.key[2] or 0 for d in docs], "no_id": [d.key[2] is None for d in docs], "copies": copies.tolist(),
        "n_a": [d.n[A] for d in docs], "n_b": [d.n[B] for d in docs], "n_groups": [d.groups for d in docs], "n_links": [d.links for d in docs],
        "groups_sha256": [d.hash.hexdigest() if d.hash else "" for d in docs], "pairs": (pairs // wide << 32) + pairs % wide, "totals": totals,
        "rows": packed(rows), "steps": packed(steps), "times": packed(times),
    }
    return pd.DataFrame({name: pd.Series([value], dtype=object if name != "sheet" else np.int64) for name, value in row.items()})


def pair_counts(kept: DataFrame) -> DataFrame:
    """(pair, n, best): over all sheets how many links hold each pair, and whether no other pair of its B id has more."""
    each = kept.select(F.explode(F.arrays_zip("pairs", "totals")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.totals").alias("n"))
    top = F.max("n").over(Window.partitionBy(F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))))
    return each.withColumn("best", F.col("n") == top)


DIGEST = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def digest(docs: DataFrame, files: Pair, size: int = SHEET, work: int = WORK) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row.

    n_best counts the links whose pair is, over all documents, its B id's most frequent, ties included; count_sum adds up the counts of the links' pairs.
    Texts that are null, empty or not given back by both sides' bytes have zeros and an empty digest. Repeated rows each have a row and each count; rows of one doc_id
    with other texts are documents of their own; an empty table gives no rows; other columns are ignored.
    """
    kept = written(sheets(docs, files, size, work), "sheets")
    wanted = kept.select("sheet", F.posexplode("pairs").alias("place", "pair")).join(pair_counts(kept), "pair").select(F.col("sheet").alias("own"), "place", "n", "best")

    def finish(sheet: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
        n, best = np.zeros(len(counts), np.int64), np.zeros(len(counts), bool)
        n[counts["place"]], best[counts["place"]] = counts["n"], counts["best"]
        r = sheet.iloc[0]
        rows, steps, times = (unpacked(r[name]).astype(np.int64) for name in ("rows", "steps", "times"))
        run, ends = np.cumsum(steps), np.cumsum(rows)
        # Steps begin anew with each document.
        place = run - np.repeat(np.concatenate([[0], run])[ends - rows], rows)
        sums = [np.diff(np.concatenate([[0], np.cumsum(x)])[ends], prepend=0) for x in (times * best[place], times * n[place])]
        ids = pd.array(r["doc_id"], "Int64")
        ids[np.asarray(r["no_id"], bool)] = pd.NA
        own = {name: r[name] for name in ("n_a", "n_b", "n_groups", "n_links")}
        frame = pd.DataFrame({"doc_id": ids, **own, "n_best": sums[0], "count_sum": sums[1], "groups_sha256": r["groups_sha256"]})
        return frame.iloc[np.repeat(np.arange(len(rows)), np.asarray(r["copies"]))]

    return kept.drop("pairs", "totals").groupBy("sheet").cogroup(wanted.groupBy("own")).applyInPandas(finish, DIGEST)
