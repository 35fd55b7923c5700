"""Repeated passages by sparse suffix arrays.

Words are runs without ASCII white space, as written. Suffixes are retained at minimiser positions
only: of each ``WINDOW`` neighbouring five-word grams the one with the least hash. Any two equal
passages of ``LEAST`` words choose the same first position, at most ``WINDOW`` - 1 words after
their begin, so they agree on the ``LEAST`` - ``WINDOW`` + 1 words from there.

1. The retained suffixes of all texts are sorted and each is compared with its neighbours. Those that share their first
   ``REST`` words with a neighbour are matches. They are sorted by a hash of these words and not by the alphabet, as only
   neighbours that share all of them count.
2. Matches are extended in their texts: to the left by up to ``WINDOW`` - 1 words and to the right up to ``LEAST``, for all
   begins that lead to this position. A neighbour in the order of step 1 can't decide this, as another suffix may
   share less to the right and more to the left; so the extended passages of ``LEAST`` words are sorted again, by text, and compared
   with their neighbour before. One that has an equal one before it (of a smaller doc_id, or at a place before) is a repeat.
   Repeats that touch or overlap join to spans.

Passages are compared by 128 bits: two sums of word hashes with a multiplier for each place, stirred; among 10^13 passages a false
pair has a chance of about 10^-13. Step 1 uses 64 bits, as step 2 checks its matches.

A batch of texts (4 MB) is compared within itself first, and sends each suffix or passage on once; so one that stands in every document
reaches its task once a batch. A text that equals one with a smaller doc_id is a repeat as a whole and is not extended.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from provena.llm.common import held, only, place_of, text_of, written
from provena.operators.screen import parted, screened

LEAST, WINDOW, GRAM = 50, 16, 5
REST = LEAST - WINDOW + 1
#: Odd multipliers of the rolling sums.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
SUFFIXES = "key long, h long, place int, shared boolean"
PASSAGES = "k1 long, k2 long, again boolean, doc_id long, h long, place int, last int, begin int, end int"


def words_of(text: str) -> list[bytes]:
    """The runs without ASCII white space, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").split()


def word_spans(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the same runs, in code points."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    inside = np.concatenate([[False], (codes != 32) & ((codes < 9) | (codes > 13)), [False]])
    return np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & ~inside[1:])


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        got = xxhash.xxh3_64_intdigest(word)
        if len(self) < 300_000 and len(word) <= 32:
            self[word] = got
        return got


def _stir(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a multiplier and of its inverse modulo 2^64, up to n."""
    if base not in _tables or len(_tables[base][0]) <= n:
        size = max(1024, 1 << n.bit_length())
        _tables[base] = tuple(np.concatenate([[np.uint64(1)], np.cumprod(np.full(size, b, np.uint64))]) for b in (base, pow(base, -1, 2**64)))
    return _tables[base]


def leftmost_least(values: np.ndarray) -> np.ndarray:
    """For each window of ``WINDOW`` values the place of the first least one, by doubling the windows."""
    at, size = np.arange(len(values)), 1
    while size < WINDOW:
        step = min(size, WINDOW - size)
        right = values[step:] < values[:-step]
        at, values = np.where(right, at[step:], at[:-step]), np.where(right, values[step:], values[:-step])
        size += step
    return at


class Suffixes:
    """The retained suffixes of one text of at least ``LEAST`` words."""

    def __init__(self, words: list[bytes]):
        self.hashes = np.fromiter(map(held("passage words", _Hashes).__getitem__, words), np.uint64, len(words))
        self.sums = [self._sums(0)]
        self.chosen = leftmost_least(self.passages(np.arange(len(words) - GRAM + 1), GRAM))[: len(words) - LEAST + 1]

    def _sums(self, k: int) -> np.ndarray:
        n = len(self.hashes)
        out = np.zeros(n + 1, np.uint64)
        np.cumsum((_stir(self.hashes) if k else self.hashes) * _powers(BASES[k], n)[0][:n], out=out[1:])
        return out

    def passages(self, begins: np.ndarray, size: int, k: int = 0) -> np.ndarray:
        """64 bits for the passages of a size at some words; k = 1 gives another 64."""
        if k == len(self.sums):
            self.sums.append(self._sums(k))
        sums = self.sums[k]
        return _stir((sums[begins + size] - sums[begins]) * _powers(BASES[k], len(self.hashes))[1][begins])

    def suffixes(self) -> np.ndarray:
        return np.unique(self.chosen)


def _alone(h: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Keys that no passage has, for rows that need no more comparing."""
    return _stir(h.view(np.uint64) + (place.astype(np.uint64) + np.uint64(1)) * np.uint64(BASES[0]))


def _retained(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(key, h, place, shared) for each retained suffix of each text; of those that share a key in a batch one keeps it."""
    for frame in frames:
        out, seen = [], set()
        for h, text in zip(frame["h"].tolist(), text_of(frame["text"]), strict=True):
            words = words_of(text)
            if len(words) >= LEAST and h not in seen:
                seen.add(h)
                s = Suffixes(words)
                own = s.suffixes()
                out.append((s.passages(own, REST), np.full(len(own), h, np.int64), own))
        if out:
            key, h, place = (np.concatenate(x) for x in zip(*out, strict=True))
            order = np.argsort(key, kind="stable")
            key, h, place = key[order], h[order], place[order]
            later = np.concatenate([[False], key[1:] == key[:-1]])
            shared = later | np.concatenate([later[1:], [False]])
            key = np.where(later, _alone(h, place), key)
            yield pd.DataFrame({"key": key.view(np.int64), "h": h, "place": place.astype(np.int32), "shared": shared})


def _extended(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Passages of ``LEAST`` words round the matches; ``again``: no need to compare further, as the batch or the list of copies shows it."""
    for frame in frames:
        out, runs, seen = [], [], set()
        for n, (doc, h, h2, text, places, firsts) in enumerate(zip(*(frame[c].tolist() for c in ("doc_id", "h", "h2", "text", "places", "firsts")), strict=True)):
            doc = None if doc is None or pd.isna(doc) else int(doc)
            words = words_of(text)
            if len(words) < LEAST or (doc, h, h2) in seen:
                continue
            seen.add((doc, h, h2))
            least = min((x["least"] for x in (firsts if firsts is not None else ()) if x["h2"] == h2), default=None)
            if least is not None and (doc is None or doc > least):
                begins, ends = word_spans(text)
                runs.append((doc, h, 0, len(words) - LEAST, begins[0], ends[-1]))
            elif places is not None:
                s = Suffixes(words)
                own = np.flatnonzero(np.isin(s.chosen, np.asarray(places)))
                if len(own):
                    begins, ends = word_spans(text)
                    out.append((s.passages(own, LEAST), s.passages(own, LEAST, 1), np.full(len(own), n), own, begins[own], ends[own + LEAST - 1]))
        if out:
            k1, k2, row, place, begin, end = (np.concatenate(x) for x in zip(*out, strict=True))
            docs, h = frame["doc_id"].astype("Int64").array[row], frame["h"].to_numpy(np.int64)[row]
            null = np.asarray(docs.isna())
            order = np.lexsort((place, h, docs.to_numpy(np.int64, na_value=0), null, k2, k1))
            again = np.zeros(len(k1), bool)
            again[order[1:]] = (k1[order[1:]] == k1[order[:-1]]) & (k2[order[1:]] == k2[order[:-1]])
            yield pd.DataFrame({"k1": k1.view(np.int64), "k2": k2.view(np.int64), "again": again, "doc_id": docs, "h": h, "place": place, "last": place, "begin": begin, "end": end})[~again]
            at = np.flatnonzero(again)
            if len(at):
                # Neighbouring repeats of one text go on as one run.
                cut = np.flatnonzero((row[at[1:]] != row[at[:-1]]) | (place[at[1:]] != place[at[:-1]] + 1))
                first, last = at[np.concatenate([[0], cut + 1])], at[np.concatenate([cut, [len(at) - 1]])]
                yield _runs(docs[first], h[first], place[first], place[last], begin[first], end[last])
        if runs:
            doc, h, place, last, begin, end = zip(*runs, strict=True)
            yield _runs(pd.array(doc, "Int64"), np.array(h, np.int64), np.array(place), np.array(last), np.array(begin), np.array(end))


def _runs(doc, h: np.ndarray, place: np.ndarray, last: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pd.DataFrame:
    key = _alone(h, place)
    return pd.DataFrame({"k1": key.view(np.int64), "k2": _stir(key).view(np.int64), "again": True, "doc_id": doc, "h": h, "place": place, "last": last, "begin": begin, "end": end})


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, begin, end, first_word, last_word, text_hash) of passages that an earlier place has word for word.

    A passage has ``LEAST`` words or more; begin and end are code points, words count from 0. The
    earlier place is of a smaller doc_id, or in the same document; a null doc_id comes after all others. Rows that share a doc_id are
    documents of their own if their texts differ, told apart by ``text_hash``, and the one with the smaller hash is earlier; equal rows are one
    document. Null and short texts repeat nothing; an empty table gives no rows; other columns are ignored.

    Texts are read twice. For the second time they are joined with the matches, before which a Bloom filter leaves out texts without any, so these don't move.
    """
    docs = only(docs, ("doc_id", "long"), ("text", "string")).where("text is not null")
    docs = docs.withColumn("h", F.xxhash64("text")).withColumn("h2", F.xxhash64(F.lit(1), "text"))
    suffixes = docs.select("h", "text").mapInPandas(_retained, SUFFIXES)
    near = Window.partitionBy("key").orderBy("h", "place")
    own = F.struct("h", "place")
    matched = suffixes.withColumn("before", F.lag(own).over(near) != own).withColumn("after", F.lead(own).over(near) != own).where("shared or before or after")
    places = matched.groupBy("h").agg(F.collect_set("place").alias("places"))

    alike = docs.groupBy("h", "h2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count_if(F.col("doc_id").isNull()).alias("nulls"))
    copied = alike.where("least < most or least is not null and nulls > 0").groupBy("h").agg(F.collect_list(F.struct("h2", "least")).alias("firsts"))
    wanted = written(places.join(copied, "h", "full"), "matches")

    near = screened(docs, wanted.select("h"), ["h"], wanted.count())
    passages = near.join(wanted, "h").select("doc_id", "h", "h2", "text", "places", "firsts").mapInPandas(_extended, PASSAGES)
    order = Window.partitionBy("k1", "k2").orderBy(F.asc_nulls_last("doc_id"), "h", "place")
    own = F.struct("doc_id", "h", "place")
    before = F.lag(own).over(order)
    repeats = passages.withColumn("found", F.col("again") | before.isNotNull() & ~before.eqNullSafe(own)).where("found")

    order = Window.partitionBy("doc_id", "h").orderBy("place", "last")
    reach = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    apart = repeats.select("doc_id", "h", "place", "last", "begin", "end", F.coalesce(F.col("place") > reach + LEAST, F.lit(True)).cast("int").alias("new"))
    joined = apart.withColumn("part", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = joined.groupBy("doc_id", "h", "part").agg(F.min("begin").alias("begin"), F.max("end").alias("end"), F.min("place").alias("first_word"), (F.max("last") + (LEAST - 1)).alias("last_word"))
    return spans.select("doc_id", *(F.col(c).cast("long").alias(c) for c in ("begin", "end", "first_word", "last_word")), F.col("h").alias("text_hash"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """The documents with repeated passages cut out of their texts; columns stay, ``n_chars`` is counted anew.

    White space round a cut becomes one line break. Documents without repeats stay as they are; a
    document of which nothing is left is dropped. Rows with a null doc_id are cut too, as the last ones; equal rows all stay. Column names
    may differ in case only; the text and the doc_id are those that ``only`` takes.
    """
    names, white = docs.columns, " \t\n\v\f\r"
    at, size = place_of(names, "text"), names.index("n_chars") if "n_chars" in names else None

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            texts, cuts = columns[at].to_pylist(), columns.pop().to_pylist()
            keep = [True] * len(texts)
            for i, (text, spans) in enumerate(zip(texts, cuts, strict=True)):
                if spans and text is not None:
                    rest, last = [], 0
                    for x in spans:
                        rest.append(text[last : x["begin"]].strip(white) if last else text[: x["begin"]].rstrip(white))
                        last = x["end"]
                    rest.append(text[last:].lstrip(white))
                    texts[i] = "\n".join(p for p in rest if p)
                    keep[i] = bool(texts[i].strip(white))
            columns[at] = pa.array(texts, columns[at].type)
            if size is not None:
                sizes = [len(t) if x and t is not None else n for t, x, n in zip(texts, cuts, columns[size].to_pylist(), strict=True)]
                columns[size] = pa.array(sizes, columns[size].type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:-1]).filter(pa.array(keep, pa.bool_()))

    spans = repeated_spans(docs).groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_list(F.struct("begin", "end"))).alias("cuts"))
    placed = docs.toDF(*(f"_{k}" for k in range(len(names))))
    cuts = written(spans, "cuts")
    doc, text = F.col(f"_{place_of(names, 'doc_id')}").cast("long"), F.col(f"_{at}").cast("string")
    # Texts that have nothing to cut stay where they are read.
    near, rest = parted(placed.withColumn("h_", F.xxhash64(text)), cuts.select(F.col("text_hash").alias("h_")), ["h_"], cuts.count())
    joined = near.join(cuts, doc.eqNullSafe(F.col("doc_id")) & (F.col("h_") == F.col("text_hash")), "left")
    out = joined.select(*placed.columns, "cuts").mapInArrow(cut, placed.schema)
    return (out if rest is None else out.union(rest.select(*placed.columns))).toDF(*names)
