"""Sum-of-squares online packing of tokenised documents into training windows.

A packer walks documents once. Full windows are cut off a document's front; the rest is
placed by the sum-of-squares rule: with N(h) partially filled windows of fill h, choose the fill
(or a new window) whose change makes the sum of N(h)^2 smallest. N lives in one level array of
``size`` counters.

Each task packs its own documents. What is in windows still open at its end, and only that, goes on to
second packers, each of which gets about ``GROUP_IDS`` ids from all tasks and places them by the same rule.
At the end of a second packer the fullest open windows stay as the rule has built them, and the emptiest are cut up to fill
their gaps; what then remains is written as windows of power-of-two lengths, which need no padding.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provena.llm.common import only, portions, text_of, written
from provena.llm.tokens import encoder

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
NAMES = [x.split()[0] for x in PIECES.split(", ")]
#: Rows come out in batches of about this many bytes of ids.
BATCH = 2_000_000
#: Ids for one second packer.
GROUP_IDS = 8_000_000


class SumOfSquares:
    """The level array and the open windows by fill. A piece is (doc, start, ids, doc_tokens).

    At most ``open_tokens`` ids wait in open windows; beyond that they are closed, which bounds the memory. ``placed`` and ``cut``
    count the ids that the rule has placed and those that were cut anew when windows were closed.
    """

    def __init__(self, size: int, first_id: int = 0, open_tokens: int = 4_000_000):
        self.size, self.next_id, self.limit = size, first_id, open_tokens
        self.placed = self.cut = 0
        self._clear()

    def _clear(self) -> None:
        self.count = np.zeros(self.size + 1, np.int64)
        self.into = np.ones(self.size + 1, np.int64)  # change of the sum when a window reaches a fill
        self.into[self.size] = 0
        self.out = np.full(self.size + 1, 2**40, np.int64)  # and when one leaves it; huge where there is none
        self.open: list[list[list]] = [[] for _ in range(self.size)]
        self.waiting = 0

    def _add(self, fill: int, by: int) -> None:
        self.count[fill] += by
        n = self.count[fill]
        self.into[fill] = 2 * n + 1
        self.out[fill] = 1 - 2 * n if n else 2**40

    def level(self, need: int) -> int:
        """The fill to build on, 0 for a new window; of equal choices the fullest."""
        change = self.into[need + 1 :] + self.out[1 : self.size - need + 1]
        if not len(change):
            return 0
        best = len(change) - 1 - int(np.argmin(change[::-1]))
        return best + 1 if change[best] <= self.into[need] else 0

    def rows(self, window: list) -> Iterator[tuple]:
        at = 0
        for doc, start, ids, total in window:
            yield doc, start, len(ids), ids.tobytes(), total, self.next_id, at
            at += len(ids)
        self.next_id += 1

    def put(self, doc, ids: np.ndarray) -> Iterator[tuple]:
        """Place a whole document; yields the rows of the windows that are full."""
        total, whole = len(ids), len(ids) // self.size * self.size
        for start in range(0, whole, self.size):
            yield from self.rows([(doc, start, ids[start : start + self.size], total)])
        if whole < total:
            yield from self.place((doc, whole, ids[whole:].copy(), total))

    def place(self, piece: tuple) -> Iterator[tuple]:
        """Place one piece, shorter than a window, by the rule."""
        need = len(piece[2])
        self.placed += need
        fill = self.level(need)
        window = self.open[fill].pop() if fill else []
        if fill:
            self._add(fill, -1)
        window.append(piece)
        if fill + need == self.size:
            self.waiting -= fill
            yield from self.rows(window)
        else:
            self._add(fill + need, 1)
            self.open[fill + need].append(window)
            self.waiting += need

    def unfinished(self) -> Iterator[tuple]:
        """The rows of all open windows as they are; then none is open."""
        for level in range(self.size - 1, 0, -1):
            for window in self.open[level]:
                yield from self.rows(window)
        self._clear()

    def close(self) -> Iterator[tuple]:
        """Fill the gaps of the fullest open windows with what the emptiest hold; the remainder in powers of two."""
        windows = deque((level, w) for level in range(self.size - 1, 0, -1) for w in self.open[level])
        self._clear()
        spare: deque[tuple] = deque()
        while windows:
            fill, window = windows.popleft()
            while fill < self.size and (spare or windows):
                if not spare:
                    spare.extend(windows.pop()[1])
                part = _cut(spare, self.size - fill)
                window.append(part)
                fill += len(part[2])
                self.cut += len(part[2])
            if fill == self.size:
                yield from self.rows(window)
            else:
                spare.extendleft(reversed(window))
        left = sum(len(p[2]) for p in spare)
        self.cut += left
        while left:
            room = min(self.size, 1 << (left.bit_length() - 1))
            left -= room
            head = []
            while room:
                head.append(_cut(spare, room))
                room -= len(head[-1][2])
            yield from self.rows(head)


def _cut(pieces: deque, room: int) -> tuple:
    """The first piece, or as much of it as there is room for; the rest stays."""
    doc, start, ids, total = pieces.popleft()
    if len(ids) > room:
        pieces.appendleft((doc, start + room, ids[room:], total))
    return doc, start, ids[:room], total


class _Out:
    """Rows, given out as frames of bounded size."""

    def __init__(self, columns: list[str]):
        self.columns, self.rows, self.size = columns, [], 0

    def add(self, rows: Iterator[tuple], *more) -> Iterator[pd.DataFrame]:
        for row in rows:
            self.rows.append((*row, *more))
            self.size += len(row[3])
            if self.size > BATCH or len(self.rows) >= 10_000:
                yield from self.rest()

    def rest(self) -> Iterator[pd.DataFrame]:
        if self.rows:
            yield pd.DataFrame(self.rows, columns=self.columns).astype({"doc_id": "Int64"})
            self.rows, self.size = [], 0


def pack(docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 1) -> DataFrame:
    """Pieces (doc_id, start, length, ids, doc_tokens, sequence_id, offset) of every document.

    ``ids`` holds little-endian unsigned 32-bit ids; ``end_id`` follows each document. Null or empty
    texts give one piece that is the end id alone; a null doc_id stays null; repeated rows, also of one doc_id, are packed
    each; an empty table gives no rows; columns other than doc_id and text are ignored.

    Texts are encoded once, where they are read; the first packers' windows are written in the shared folder, and of these
    only the open ones are shuffled. A task holds at most ``open_tokens`` waiting ids.
    """
    end = np.array([end_id], "<u4").tobytes()

    def first(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(tokenizer)
        state, out = SumOfSquares(size, TaskContext.get().partitionId() << 40), _Out([*NAMES, "open"])
        for frame in frames:
            docs_, texts = frame["doc_id"].tolist(), text_of(frame["text"])
            for part in portions(texts):
                for doc, ids in zip(docs_[part], enc.ids(texts[part]), strict=True):
                    yield from out.add(state.put(None if pd.isna(doc) else int(doc), np.frombuffer(ids + end, "<u4")), False)
                    if state.waiting > state.limit:
                        yield from out.add(state.unfinished(), True)
        yield from out.add(state.unfinished(), True)
        yield from out.rest()

    def second(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, out, now = None, _Out(NAMES), None
        for frame in frames:
            for group, doc, start, ids, total in zip(*(frame[c].tolist() for c in ("group", "doc_id", "start", "ids", "doc_tokens")), strict=True):
                if group != now:
                    if state:
                        yield from out.add(state.close())
                    state, now = SumOfSquares(size, 1 << 62 | group << 40), group
                yield from out.add(state.place((None if pd.isna(doc) else int(doc), start, np.frombuffer(ids, "<u4"), total)))
                if state.waiting > state.limit:
                    yield from out.add(state.close())
        if state:
            yield from out.add(state.close())
        yield from out.rest()

    packed = written(only(docs, ("doc_id", "long"), ("text", "string")).mapInPandas(first, PIECES + ", open boolean"), "packed")
    full = packed.where("not open").select(*NAMES)
    waiting = packed.where("open").agg(F.sum("length")).first()[0] or 0
    if not waiting:
        return full
    groups = math.ceil(waiting / GROUP_IDS)
    left = packed.where("open").withColumn("group", F.pmod(F.xxhash64("sequence_id"), F.lit(groups)).cast("int"))
    dealt = left.repartitionById(groups, F.col("group")).sortWithinPartitions("group", "sequence_id", "offset")
    return full.union(dealt.mapInPandas(second, PIECES))


def digest(pieces: DataFrame) -> DataFrame:
    """The pieces with a checksum in the place of their ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
