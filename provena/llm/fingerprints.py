"""Document fingerprints from prefix polynomial hashes.

For a text, two arrays hold the sums of (code point + 1) * base^place modulo two primes, for every
prefix. From them the hash of any span follows in constant time, so spans of one or two texts are
compared in constant time, and their longest common extension is found by binary search.

A fingerprint is the text's length, its whole hash, and some entries of the prefix arrays: ``GRID`` or fewer at multiples of a power of two,
and ``KEPT`` at places that the content selects, those whose span of ``SPAN`` code points occurs once and has the least hashes (with these hashes, to find them
again). Any span between two kept places can be compared with a span of another text. So the
likeness of two fingerprints adds up the text that both share: from the begin, the longest common extension on the grid; from
each common place, the longest extension over the common places that follow at the same distances, the end among them. With m shared
code points it is 2 m / (n + n'), and 1 for equal texts only. It seldom says too much (a span hash has 62 bits, a common place 32), and falls short by
up to the distance of two kept places, a few hundredths of the text, at each change.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provena.llm.common import bucket_of, only, range_bounds, shuffle_parts, text_of

PRIMES = (2**31 - 1, 2**31 - 19)
BASES = (911382323, 972663749)
SPAN, KEPT, GRID = 12, 64, 64
EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

_tables: list[tuple[np.ndarray, np.ndarray]] = [(np.ones(1, np.uint64), np.ones(1, np.uint64))] * 2


def _powers(k: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse modulo its prime, up to n; made once, by doubling."""
    up, down = _tables[k]
    if len(up) <= n:
        p = np.uint64(PRIMES[k])
        inverse = pow(BASES[k], -1, PRIMES[k])
        while len(up) <= n:
            m = len(up)
            up = np.concatenate([up, up * np.uint64(pow(BASES[k], m, PRIMES[k])) % p])
            down = np.concatenate([down, down * np.uint64(pow(inverse, m, PRIMES[k])) % p])
        _tables[k] = up, down
    return _tables[k]


class PrefixHash:
    """The prefix arrays of one text."""

    def __init__(self, text: str):
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
        self.n, self.sums = len(codes), []
        for k, prime in enumerate(PRIMES):
            up, _ = _powers(k, self.n)
            p = np.uint64(prime)
            # Each term is below 2^31, so the running sum of up to 2^33 terms needs no reduction on the way.
            self.sums.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * up[: self.n] % p) % p]))

    def spans(self, begins: np.ndarray, size: int) -> np.ndarray:
        """62-bit hashes of the spans of a size at some places."""
        out = np.zeros(len(begins), np.uint64)
        for k, prime in enumerate(PRIMES):
            p, sums, down = np.uint64(prime), self.sums[k], _powers(k, self.n)[1]
            out = out << np.uint64(31) | (sums[begins + size] + p - sums[begins]) * down[begins] % p
        return out

    def span(self, begin: int, end: int) -> int:
        return int(self.spans(np.array([begin]), end - begin)[0])

    def windows(self, size: int) -> np.ndarray:
        """Hashes of all spans of a size, in order."""
        last, out = self.n - size + 1, np.zeros(self.n - size + 1, np.uint64)
        for k, prime in enumerate(PRIMES):
            p, sums, down = np.uint64(prime), self.sums[k], _powers(k, self.n)[1]
            out = out << np.uint64(31) | (sums[size:] + p - sums[:last]) * down[:last] % p
        return out


def _longest(most: int, equal: Callable[[int], bool]) -> int:
    """The largest number up to ``most`` for which ``equal`` holds, if it holds for all below; 0 always counts as equal."""
    low, high = 0, most
    while low < high:
        mid = (low + high + 1) // 2
        if equal(mid):
            low = mid
        else:
            high = mid - 1
    return low


def extension(a: PrefixHash, i: int, b: PrefixHash, j: int) -> int:
    """How many code points the suffixes at i and j have in common at their begin."""
    return _longest(min(a.n - i, b.n - j), lambda k: a.span(i, i + k) == b.span(j, j + k))


def _stir(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


#: A kept place: where, the hash of its span, and its prefix sums modulo both primes.
PLACE = np.dtype([("at", "<u4"), ("key", "<u4"), ("sum", "<u8")])


class Print:
    """A fingerprint: ``head`` (length and whole hash), prefix sums on the grid, and the kept places in order."""

    def __init__(self, text: str):
        h = PrefixHash(text)
        self.n = h.n
        self.head = f"{h.n:x}-{h.span(0, h.n):016x}" if h.n else "0-0"
        self.grid = self._sums(h, np.arange(0, h.n + 1, self.step())[1:])
        at, key = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        if h.n >= SPAN:
            values = _stir(h.windows(SPAN)) >> np.uint64(32)
            some = np.argpartition(values, 3 * KEPT)[: 3 * KEPT] if len(values) > 6 * KEPT else np.arange(len(values))
            key, at = self._least(values, some)
            if len(key) < KEPT and len(some) < len(values):
                key, at = self._least(values, np.arange(len(values)))
            order = np.argsort(at)
            key, at = key[order], at[order]
        self.places = np.zeros(len(at), PLACE)
        self.places["at"], self.places["key"], self.places["sum"] = at, key, self._sums(h, at)

    def step(self) -> int:
        """The distance of the grid: a power of two, so that one text's grid holds another's or the other way round."""
        return 1 << max(0, (max(self.n - 1, 0) // GRID).bit_length())

    @staticmethod
    def _sums(h: PrefixHash, at: np.ndarray) -> np.ndarray:
        return h.sums[0][at] << np.uint64(31) | h.sums[1][at]

    @staticmethod
    def _least(values: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ``KEPT`` least hashes among some places; those that occur once, and only then others, at their first place."""
        some = np.sort(some)
        key, first, times = np.unique(values[some], return_index=True, return_counts=True)
        kept = np.argsort(times > 1, kind="stable")[:KEPT]
        return key[kept], some[first[kept]]

    def __str__(self) -> str:
        return f"{self.head}-{self.grid.astype('<u8').tobytes().hex()}-{self.places.tobytes().hex()}"


def read_print(text: str) -> Print:
    """The fingerprint that a string holds."""
    out = Print.__new__(Print)
    size, whole, grid, places = text.split("-")
    out.n, out.head = int(size, 16), f"{size}-{whole}"
    out.grid, out.places = np.frombuffer(bytes.fromhex(grid), "<u8"), np.frombuffer(bytes.fromhex(places), PLACE)
    return out


def _span(begin: int, low: int, high: int) -> tuple[int, int]:
    """The hash of the span from ``begin``, from the prefix sums at both ends."""
    out = []
    for k, shift in enumerate((31, 0)):
        a, b = (int(x) >> shift & 0x7FFFFFFF for x in (low, high))
        out.append((b - a) * int(_powers(k, begin)[1][begin]) % PRIMES[k])
    return tuple(out)


def likeness(a: Print, b: Print) -> float:
    """0 to 1; see above."""
    if a.head == b.head:
        return 1.0
    if not a.n or not b.n:
        return 0.0
    covered = []
    step = max(a.step(), b.step())
    x, y = a.grid[step // a.step() - 1 :: step // a.step()], b.grid[step // b.step() - 1 :: step // b.step()]
    if alike := _longest(min(len(x), len(y)), lambda k: x[k - 1] == y[k - 1]):
        covered.append((0, alike * step))
    _, i, j = np.intersect1d(a.places["key"], b.places["key"], assume_unique=True, return_indices=True)
    order = np.argsort(i)
    p, q = (np.append(x.places[k[order]], np.array([(x.n, 0, int(x.head.split("-")[1], 16))], PLACE)) for x, k in ((a, i), (b, j)))  # and the ends
    at, to = p["at"].astype(np.int64), q["at"].astype(np.int64)
    k = 0
    while k < len(at):
        ahead = np.flatnonzero(at[k:] - at[k] != to[k:] - to[k])  # the first place that stands elsewhere
        most = (int(ahead[0]) if len(ahead) else len(at) - k) - 1
        far = _longest(most, lambda m: _span(at[k], p["sum"][k], p["sum"][k + m]) == _span(to[k], q["sum"][k], q["sum"][k + m]))  # noqa: B023
        covered.append((int(at[k]), min(int(at[k + far]) + SPAN, a.n)))
        k += far + 1
    shared = last = 0
    for begin, end in sorted(covered):
        shared += max(0, end - max(begin, last))
        last = max(last, end)
    return min(2 * shared, a.n + b.n - 1) / (a.n + b.n)  # below 1, as the texts differ


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, fingerprint) of every text; null is empty, other columns are ignored. No shuffle."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), 500):
                texts = text_of(frame["text"].iloc[at : at + 500])
                yield pd.DataFrame({"doc_id": frame["doc_id"].iloc[at : at + 500].astype("Int64"), "n_chars": [len(t) for t in texts], "fingerprint": [str(Print(t)) for t in texts]})

    return only(docs, ("doc_id", "long"), ("text", "string")).mapInPandas(run, "doc_id long, n_chars long, fingerprint string")


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def edited_and_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and its edited text, with their likeness and that to the next document.

    In the edited text the last floor(n / 4) code points are replaced by as many first ones (or
    all) of the next document in ascending doc_id; after the last comes the first. Null texts are
    empty; null doc_ids come first; rows of one doc_id are ordered by text, and the least text
    stands before the next doc_id's; a lone document is its own next; an empty table gives no rows; other columns are ignored.

    Documents are dealt once, into ranges of doc_id that are cut at existing values; the first
    document of each range also goes, marked, to the range before.
    """
    spark = docs.sparkSession
    docs = only(docs, ("doc_id", "long"), ("text", "string"))
    bounds = range_bounds(docs, "doc_id", shuffle_parts(spark))
    least, nulls = docs.agg(F.min("doc_id"), F.count_if(F.col("doc_id").isNull())).first()
    last = len(bounds)
    at = docs.withColumn("previous", F.try_subtract("doc_id", F.lit(1).cast("long")))  # null before the least number of all
    at = at.withColumn("range", bucket_of("doc_id", bounds)).withColumn("below", bucket_of("previous", bounds))
    first = F.col("doc_id").isNull() if nulls else F.col("doc_id") == F.lit(least).cast("long")
    copies = F.array(
        F.struct(F.col("range").alias("to"), F.lit(0).alias("ahead")),
        F.when(F.col("range") != F.col("below"), F.struct((F.col("range") - 1).alias("to"), F.lit(1).alias("ahead"))),
        F.when(first, F.struct(F.lit(last).alias("to"), F.lit(1).alias("ahead"))),
    )
    sent = at.select("doc_id", "text", F.explode(F.array_compact(copies)).alias("c")).select("doc_id", "text", "c.*")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, held, done = [], None, False

        def row(doc, text: str, own: Print, after: str, after_print: Print) -> tuple:
            m = len(text) // 4
            edited = text[: len(text) - m] + after[:m]
            new = Print(edited)
            return doc, len(text), _digest(edited), str(own), str(new), likeness(own, new), likeness(own, after_print)

        names = [x.split()[0] for x in EDITED.split(", ")]
        for frame in frames:
            for doc, text, ahead in zip(frame["doc_id"].tolist(), text_of(frame["text"]), frame["ahead"], strict=True):
                if done:
                    continue
                own = Print(text)
                if held:
                    rows.append(row(*held, text, own))
                done = bool(ahead)
                held = (None if pd.isna(doc) else int(doc), text, own)
                if len(rows) >= 500:
                    yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})
                    rows = []
        if rows:
            yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})

    dealt = sent.repartitionById(last + 1, F.col("to")).sortWithinPartitions("ahead", F.asc_nulls_first("doc_id"), F.asc_nulls_first("text"))
    return dealt.mapInPandas(run, EDITED)
