"""Benchmark passages in documents, with edits: pigeonhole pieces, then Myers' bit-parallel distance.

Texts and items are compared in a plain form: letters, digits and underscores in lower case, any
other run of characters as one space. An item of m plain characters may have floor(``RATE`` * m)
edits. It is split into one piece more than that; an occurrence within the budget leaves one piece
untouched, so all pieces of all items go into one automaton, each hit gives a diagonal, and the
text along nearby diagonals is checked with Myers' algorithm.

An item without a budget (fewer than 1 / ``RATE`` plain characters) is found only as whole words, so "art" is not in "start"; it is found
wherever these words stand, also if it is a single one. Longer items may be found inside a word, as the edits next to them would allow that anyhow.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provena.llm.common import held, only, place_of, small_batches, text_of, written

RATE = 0.05
#: Items are sent to the tasks in blocks of about this many bytes of text, one pass over the documents for each block. An automaton
#: takes about fifty times as much of a worker's memory. The driver holds one block at a time.
BLOCK_BYTES = 4_000_000
LEAKS = "doc_id long, item_id long, start long, end long, edits long"

APART = re.compile(r"\W+")


def lowered(text: str) -> str:
    """Lower case with as many code points as before."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def plain(text: str) -> str:
    return APART.sub(" ", lowered(text)).strip(" ")


def places(text: str) -> list[int]:
    """For each character of ``plain(text)`` its place in the text."""
    out: list[int] = []
    for m in re.finditer(r"\w+", lowered(text)):
        if out:
            out.append(m.start() - 1)
        out.extend(range(m.start(), m.end()))
    return out


def distances(pattern: str, text: str) -> Iterator[int]:
    """For each character of the text, the least edit distance of the pattern to a part that ends there."""
    m = len(pattern)
    at: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        at[c] |= 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    for c in text:
        eq = at.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        score += 1 if ph & top else -1 if mh & top else 0
        ph, mh = ph << 1 & full, mh << 1 & full
        pv, mv = mh | ~(xv | ph) & full, ph & xv
        yield score


def occurrence(item: str, text: str, budget: int) -> tuple[int, int, int] | None:
    """(edits, start, end) with the fewest edits, then the first end, then the longest part; or nothing."""
    at = text.find(item)
    if at >= 0:
        return 0, at, at + len(item)
    best, end = budget + 1, 0
    for k, d in enumerate(distances(item, text)):
        if d < best:
            best, end = d, k + 1
    if best > budget:
        return None
    back = text[max(0, end - len(item) - best) : end][::-1]
    size = max(k + 1 for k, d in enumerate(distances(item[::-1], back)) if d == best)
    return best, end - size, end


class Scanner:
    """Finds items in texts. An item is (ids, plain form); no form comes twice and none is empty."""

    def __init__(self, items: list[tuple[list[int], str]], rate: float = RATE):
        import ahocorasick

        self.items: list[tuple[str, int, list[int]]] = []
        pieces: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for keys, form in sorted(items, key=lambda x: x[1]):
            budget = math.floor(rate * len(form))
            if not budget:
                form = f" {form} "
            cuts = [len(form) * k // (budget + 1) for k in range(budget + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                pieces[form[a:b]].append((len(self.items), a))
            self.items.append((form, budget, keys))
        self.automaton = ahocorasick.Automaton()
        for piece, owners in pieces.items():
            self.automaton.add_word(piece, (len(piece), owners))
        if pieces:
            self.automaton.make_automaton()

    def found(self, text: str, first: bool = False) -> list[tuple[int, int, int, int]]:
        """(item, edits, start, end) per item in places of a plain text; ``first``: one is enough."""
        text = f" {text} "  # every word stands between blanks
        lines: dict[int, set[int]] = defaultdict(set)
        if self.items:
            for end, (size, owners) in self.automaton.iter(text):
                for item, offset in owners:
                    lines[item].add(end + 1 - size - offset)
        out = []
        for item, starts in sorted(lines.items()):
            form, budget, keys = self.items[item]
            best, regions = None, []
            for a in sorted(starts):
                a, b = max(0, a - budget), a + len(form) + budget
                if regions and a <= regions[-1][1]:
                    regions[-1][1] = b
                else:
                    regions.append([a, b])
            for a, b in regions:
                if got := occurrence(form, text[a:b], budget):
                    got = got[0], got[1] + a, got[2] + a
                    best = min(best, got) if best else got
                    if not best[0]:
                        break
            if best:
                edits, a, b = best
                if not budget:
                    a, b = a + 1, b - 1
                # Without the blanks round the text, which an edit may have taken in.
                out += [(key, edits, max(0, a - 1), min(b - 1, len(text) - 2)) for key in keys]
                if first:
                    break
        return out


def _ready(block: "Block") -> Scanner:
    """The scanner of a broadcast block."""
    return held(("scanner", block.id), lambda: Scanner(*block.value))


class Block:
    def __init__(self, sent, number: int):
        self.sent, self.id = sent, number

    @property
    def value(self):
        return self.sent.value


def forms(benchmark: DataFrame) -> DataFrame:
    """(form, keys): each plain form of the items once, with the distinct ids that have it, so that no way of dealing them out changes what is found."""

    @F.pandas_udf("string")
    def form(texts: pd.Series) -> pd.Series:
        return texts.map(plain)

    items = only(benchmark, ("item_id", "long"), ("text", "string")).where("item_id is not null and text is not null")
    return items.select("item_id", form("text").alias("form")).where("form <> ''").groupBy("form").agg(F.sort_array(F.collect_set("item_id")).alias("keys"))


def blocks(benchmark: DataFrame, rate: float) -> Iterator[Block]:
    """The items in broadcasts of a bounded size, each form in one of them."""
    spark = benchmark.sparkSession
    items = written(forms(benchmark), "items")
    size = items.agg(F.sum(F.octet_length("form") + 64 + 8 * F.size("keys"))).first()[0] or 0
    n = max(1, math.ceil(size / BLOCK_BYTES))
    for k in range(n):
        rows = [(r.keys, r.form) for r in items.where(F.pmod(F.xxhash64("form"), F.lit(n)) == k).select("keys", "form").toLocalIterator()]
        sent = spark.sparkContext.broadcast((rows, rate))
        yield Block(sent, sent._jbroadcast.id())


def leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """(doc_id, item_id, start, end, edits): the best occurrence of each item in each document.

    start and end count the document's code points. Null and empty texts and items match nothing;
    repeated documents give rows each. An item is an id and a plain form: rows of one id with equal forms are one item, with different forms as many, each with its
    rows. A null item_id is left out, a null doc_id is kept; empty tables give no rows; other columns are ignored.
    """
    docs = only(docs, ("doc_id", "long"), ("text", "string"))
    out = None
    for block in blocks(benchmark, rate):

        def scan(frames: Iterator[pd.DataFrame], block: Block = block) -> Iterator[pd.DataFrame]:
            scanner = _ready(block)
            for frame in frames:
                rows = []
                for doc, text in zip(frame["doc_id"].tolist(), text_of(frame["text"]), strict=True):
                    if got := scanner.found(plain(text)):
                        at = places(text)
                        rows += [(doc, key, at[a], at[b - 1] + 1, edits) for key, edits, a, b in got if b > a]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "start", "end", "edits"]).astype({"doc_id": "Int64"})

        part = docs.mapInPandas(scan, LEAKS)
        out = part if out is None else out.union(part)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """The documents in which no item occurs; their columns stay as they are. No shuffle.

    Null and empty texts hold nothing and stay, as do rows with a null doc_id without an item; repeated rows are judged each. Column names may
    differ in case only; the text is the one that ``only`` takes.
    """
    names = docs.columns
    at = place_of(names, "text")
    docs = small_batches(docs).toDF(*(f"_{k}" for k in range(len(names))))
    for block in blocks(benchmark, rate):

        def clean(batches: Iterator[pa.RecordBatch], block: Block = block) -> Iterator[pa.RecordBatch]:
            scanner = _ready(block)
            for batch in batches:
                keep = [not scanner.found(plain(t or ""), first=True) for t in batch.column(at).to_pylist()]
                yield batch.filter(pa.array(keep, pa.bool_()))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs.toDF(*names)
