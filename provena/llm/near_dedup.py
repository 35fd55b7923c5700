"""Near duplicates by fast similarity sketching, banding, and exact verification.

A document's set holds its distinct five-word shingles. The sketch has ``COORDS`` coordinates.
In round i every shingle is placed in one hashed bin with the value i + fraction; a bin keeps its
least value. The first ``COORDS`` rounds hash the bin, the next ones place all shingles in one bin
each, so every coordinate is filled at the latest after twice as many rounds, and the share of
equal coordinates is concentrated round the Jaccard similarity as if they were independent.

Steps, none of which gathers a group in one place:

1. Equal word sequences are one class (partial aggregation); only its smallest doc_id goes on.
2. Bands of coordinates give buckets, of five from a threshold of 0.85 and of four below it. A pair
   at the threshold shares no band with a chance of 4e-7 at 0.85, and of 5e-8 at 0.80.
3. A few rounds pair each member of a bucket with one leader only, check the pairs on full sets,
   and merge what is linked. Most links of a large group follow from these.
4. For buckets that still hold several components, pairs across components are made where an exact
   bound allows a link. A large bucket is cut into blocks of ``BLOCK`` members and each pair of blocks is a group of its own. The bound uses the set sizes and the number of shingles that no other
   candidate has: those cannot be shared. A sketch estimate far below the threshold also rules a
   pair out (``GIVE_UP`` standard deviations below). All other pairs are checked.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provena.llm.common import held, only, place_of, shuffle_parts, small_batches, text_of, written
from provena.llm.components import components

WORDS = 5
COORDS = 128
#: Coordinates of the candidates' second sketch, by which pairs are ruled out.
FINE = 256
#: Members of a bucket that one group compares with each other or with as many others.
BLOCK = 256
#: Rounds of leader pairs before pairs across components are made.
LEADER_ROUNDS = 2
#: An estimate so many standard deviations below the threshold rules a pair out. By the exact binomial tail a pair at
#: the threshold is lost so with a chance of 5.8e-7 (0.85, at most 187 of 256) or 5.0e-7 (0.80, at most 171).
GIVE_UP = 5.2

MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def stir(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose bits depend on all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words, kept up to a bound."""

    def __missing__(self, word: bytes) -> int:
        got = xxhash.xxh3_64_intdigest(word)
        if len(self) < 300_000 and len(word) <= 32:
            self[word] = got
        return got


def words_of(text: str) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def shingles(words: list[bytes]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; fewer words than ``WORDS`` are one shingle."""
    if not words:
        return np.zeros(0, np.uint64)
    a = np.fromiter(map(held("word hashes", WordHashes).__getitem__, words), np.uint64, len(words))
    if len(a) < WORDS:
        return stir((a * MIX[: len(a)]).sum(keepdims=True) + np.uint64(len(a)))
    last = len(a) - WORDS + 1
    total = a[:last] * MIX[0]
    for j in range(1, WORDS):
        total += a[j : j + last] * MIX[j]
    return np.unique(stir(total))


def sketch(items: np.ndarray, coords: int = COORDS) -> np.ndarray:
    """The fast similarity sketch of a non-empty set of 64-bit hashes: one value per coordinate."""
    out = np.full(coords, np.iinfo(np.uint64).max)
    for i in range(2 * coords):
        h = stir(items + np.uint64((i + 1) * int(MIX[0]) % 2**64))
        value = h >> np.uint64(16)
        if i < coords:
            # Bin above value: after sorting, the first of each bin is its least.
            both = np.sort(((h & np.uint64(0xFFFF)) % np.uint64(coords)) << np.uint64(48) | value)
            bins = both >> np.uint64(48)
            first = both[np.concatenate([[True], bins[1:] != bins[:-1]])]
            at = (first >> np.uint64(48)).astype(np.int64)
            out[at] = np.minimum(out[at], np.uint64(i) << np.uint64(48) | first & np.uint64(0xFFFFFFFFFFFF))
        else:
            out[i - coords] = min(out[i - coords], np.uint64(i) << np.uint64(48) | value.min())
        if i < coords and (out >> np.uint64(48) <= i).all():
            break
    return out


def rows_of(cent: int) -> int:
    """Coordinates in a band."""
    return 5 if cent >= 85 else 4


def bands(drawn: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit bucket key per band."""
    n = len(drawn) // rows
    grid = drawn[: rows * n].reshape(n, rows)
    return stir((grid * MIX[None, :rows]).sum(axis=1, dtype=np.uint64) + np.arange(n, dtype=np.uint64)).astype(np.int64)


def _describe(rows_: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), 512):
                rows = {"doc_id": frame["doc_id"].iloc[at : at + 512].astype("Int64").to_numpy(), "n": [], "k1": [], "k2": [], "keys": []}
                for text in text_of(frame["text"].iloc[at : at + 512]):
                    words = words_of(text)
                    items = shingles(words)
                    key = np.frombuffer(xxhash.xxh3_128_digest(b" ".join(words)), "<i8")
                    rows["n"].append(len(items))
                    rows["k1"].append(int(key[0]))
                    rows["k2"].append(int(key[1]))
                    rows["keys"].append(bands(sketch(items), rows_).tolist() if len(items) else [])
                yield pd.DataFrame(rows)

    return run


def _sets(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(doc_id, n, items, drawn): the full set and the finer sketch of each text that has words."""
    for frame in frames:
        for at in range(0, len(frame), 256):
            rows = {"doc_id": [], "n": [], "items": [], "drawn": []}
            for doc, text in zip(frame["doc_id"].iloc[at : at + 256], text_of(frame["text"].iloc[at : at + 256]), strict=True):
                items = shingles(words_of(text))
                if len(items):
                    rows["doc_id"].append(doc)
                    rows["n"].append(len(items))
                    rows["items"].append(items.tobytes())
                    rows["drawn"].append((stir(sketch(items, FINE)) & np.uint64(0xFFFF)).astype("<u2").tobytes())
            yield pd.DataFrame(rows)


def _linked(per: int, cent: int):
    """Whether two packed sets have per * intersection >= cent * union."""

    @F.pandas_udf(T.BooleanType())
    def linked(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b, strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            out.append(per * both >= cent * (len(x) + len(y) - both))
        return pd.Series(out, dtype=bool)

    return linked


def verified(pairs: DataFrame, sets: DataFrame, cent: int) -> DataFrame:
    """The pairs (a, b) that are linked on full sets."""
    one = sets.select(F.col("doc_id").alias("a"), F.col("items").alias("x"))
    two = sets.select(F.col("doc_id").alias("b"), F.col("items").alias("y"))
    return pairs.select("a", "b").join(one, "a").join(two, "b").where(_linked(100, cent)("x", "y")).select("a", "b").distinct()


def _blocks(ready: DataFrame) -> DataFrame:
    """The members of each bucket in groups (key, low, high): all pairs within a block, and all between two blocks, are in one group each."""
    large = ready.groupBy("key").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks")).where("blocks > 1")
    own = ready.join(written(large, "large-buckets"), "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = own.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    each = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return each.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other")).drop("other", "blocks")


def _across(cent: int):
    """Pairs of one group across components that an exact bound and the estimate allow."""
    least = cent / 100 - GIVE_UP * math.sqrt(cent / 100 * (1 - cent / 100) / FINE)

    def pairs(now: tuple, rows: list) -> Iterator[pd.DataFrame]:
        if len(rows) < 2:
            return
        rows.sort(key=lambda r: r[2])
        ids, comp, block = (np.array([r[k] for r in rows]) for k in (0, 1, 6))
        n, most = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
        drawn = np.stack([np.frombuffer(r[4], "<u2") for r in rows])
        keys = np.stack([r[5] for r in rows])
        here = np.argwhere(keys == now[0])
        place = int(here[0][1]) if len(here) else 0
        for i in range(len(ids) - 1):
            top = np.searchsorted(n, min(most[i], n[i] * 100 // cent), side="right")
            js = np.arange(i + 1, top)
            js = js[(comp[js] != comp[i]) & (most[js] >= n[i])]
            if now[1] != now[2]:
                js = js[block[js] != block[i]]
            js = js[(keys[js, :place] != keys[i, :place]).all(axis=1)]  # the first band that they share
            js = js[(drawn[js] == drawn[i]).mean(axis=1) >= least]
            if len(js):
                yield pd.DataFrame({"a": np.minimum(ids[i], ids[js]), "b": np.maximum(ids[i], ids[js])})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept, now = [], None
        for frame in frames:
            for key, low, high, *row in zip(*(frame[c] for c in ("key", "low", "high", "doc_id", "comp", "n", "most", "drawn", "keys", "block")), strict=True):
                if (key, low, high) != now:
                    yield from pairs(now, kept)
                    kept, now = [], (key, low, high)
                kept.append(row)
        yield from pairs(now, kept)

    return run


def near_duplicates(docs: DataFrame, cent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row; linked at similarity >= cent / 100.

    Null, empty and wordless texts have no shingles and are alone. Rows that share a doc_id are one
    document, each with its own n_shingles. A null doc_id takes part in nothing: component_id is
    null and the row is kept. An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    docs = only(docs, ("doc_id", "long"), ("text", "string"))
    base = written(docs.mapInPandas(_describe(rows_of(cent)), "doc_id long, n long, k1 long, k2 long, keys array<long>"), "described")
    full = base.where("n > 0 and doc_id is not null")
    classes = written(full.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep")), "classes")
    firsts = full.join(classes.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id", "k1", "k2"])

    rows = firsts.select("doc_id", F.explode("keys").alias("key"))
    shared = rows.groupBy("key").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("key")
    buckets = written(rows.join(shared, "key").distinct(), "buckets")
    members = written(buckets.select("doc_id").distinct(), "candidates")
    n = members.count()
    sets = written(docs.join(members, "doc_id", "left_semi").mapInPandas(_sets, "doc_id long, n long, items binary, drawn binary"), "sets") if n else None

    links = tried = None
    comp = members.withColumn("comp", F.col("doc_id"))
    if n:
        sizes = buckets.groupBy("key").agg(F.count("*").alias("size"))
        placed = written(buckets.join(buckets.join(sizes, "key").groupBy("doc_id").agg(F.sum("size").alias("near")), "doc_id"), "placed")
    for turn in range(LEADER_ROUNDS if n else 0):
        # The leader of a bucket is the member with most company over all buckets; later by lot, weighed so.
        lot = F.lit(1.0) if not turn else F.pmod(F.xxhash64("doc_id", F.lit(turn)), F.lit(1024)) + 16
        order = F.struct(F.col("near") * lot, -F.col("doc_id"))
        now = placed.join(comp, "doc_id")
        lead = now.groupBy("key").agg(F.max_by(F.struct("doc_id", "comp"), order).alias("lead"), F.min("comp").alias("c1"), F.max("comp").alias("c2")).where("c1 <> c2").select("key", "lead.*").toDF("key", "leader", "leader_comp")
        votes = now.join(lead, "key").where("comp <> leader_comp").groupBy("doc_id", "leader").agg(F.count("*").alias("votes"))
        pairs = votes.select("doc_id", "leader", "votes", F.least("doc_id", "leader").alias("a"), F.greatest("doc_id", "leader").alias("b"))
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        best = F.max_by(F.struct("a", "b"), F.struct("votes", -F.col("leader")))
        pairs = written(pairs.groupBy("doc_id").agg(best.alias("p")).select("p.*").distinct(), "pairs")
        tried = pairs.union(tried) if tried is not None else pairs
        found = verified(pairs, sets, cent)
        links = written(found.union(links) if links is not None else found, "links")
        comp = _joined(members, links)
    if n:
        placed = buckets.join(comp, "doc_id")
        mixed = placed.groupBy("key").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2")).where("c1 <> c2").select("key")
        open_ = written(placed.join(mixed, "key"), "open-buckets")
        rare = _rare(sets)
        facts = sets.join(rare, "doc_id", "left").join(open_.select("doc_id").distinct(), "doc_id", "left_semi")
        # |x & y| <= n - rare, and cent * (n + m) <= (100 + cent) * |x & y|: so a partner has at most this many.
        facts = facts.selectExpr("doc_id", "n", "drawn", f"((n - coalesce(rare, 0)) * {100 + cent}) div {cent} - n AS most")
        facts = facts.where(F.col("n") * cent <= F.col("most") * 100)
        own = firsts.select("doc_id", "keys").dropDuplicates(["doc_id"])
        ready = open_.join(facts, "doc_id").join(own, "doc_id")
        group = ["key", "low", "high"]
        dealt = _blocks(written(ready, "open-members")).repartition(shuffle_parts(spark), *group).sortWithinPartitions(*group)
        pairs = dealt.mapInPandas(_across(cent), "a long, b long").distinct()
        found = verified(pairs, sets, cent)
        links = written(found.union(links) if links is not None else found, "links")
        comp = _joined(members, links)

    same = full.select("doc_id", "k1", "k2").distinct().join(classes, ["k1", "k2"]).where("doc_id <> rep").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    # A doc_id with several texts ties their classes together; usually there is none.
    each = full.groupBy("doc_id").agg(F.min("k1").alias("a"), F.max("k1").alias("b"), F.min("k2").alias("c"), F.max("k2").alias("d"))
    if each.where("a <> b or c <> d").limit(1).count():
        alike = links.select("a", "b").union(same.select("v", "u")) if links is not None else same.select(F.col("v").alias("a"), F.col("u").alias("b"))
        final = _joined(full.select("doc_id").distinct(), alike)
    else:
        least = same.select(F.col("u").alias("doc_id"), F.col("v").alias("rep"))
        of_rep = comp.withColumnRenamed("doc_id", "rep")
        final = least.join(of_rep, "rep", "left").select("doc_id", F.coalesce("comp", "rep").alias("comp")).union(comp.select("doc_id", "comp"))
    out = base.select("doc_id", F.col("n").alias("n_shingles")).join(final, "doc_id", "left")
    id_ = F.when(F.col("n_shingles") > 0, F.coalesce("comp", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", id_.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _joined(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(doc_id, comp) of the nodes under the links so far."""
    found = components(links.toDF("u", "v"))
    return written(nodes.join(found.toDF("doc_id", "comp"), "doc_id", "left").withColumn("comp", F.coalesce("comp", "doc_id")), "comp")


def _rare(sets: DataFrame) -> DataFrame:
    """For each candidate the number of its shingles that no other candidate has."""

    def unpack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), 256):
                part = frame.iloc[at : at + 256]
                sizes = part["items"].map(len).to_numpy() // 8
                yield pd.DataFrame({"item": np.frombuffer(b"".join(part["items"]), np.int64), "doc_id": np.repeat(part["doc_id"].to_numpy(), sizes)})

    seen = sets.select("doc_id", "items").mapInPandas(unpack, "item long, doc_id long")
    alone = seen.groupBy("item").agg(F.count("*").alias("c"), F.min("doc_id").alias("doc_id")).where("c = 1")
    return alone.groupBy("doc_id").agg(F.count("*").alias("rare"))


#: Two hashes of a text, which tell texts of one doc_id apart.
HASH = ["hash", "hash2"]


def keep_firsts(docs: DataFrame, cent: int = 80) -> DataFrame:
    """One document of each component, the one with the smallest doc_id; columns stay as they are.

    Unlike texts of one doc_id are documents of their own, and so are texts without a doc_id, which come last: of each
    component the row with the smallest (doc_id, hash of the text) stays; texts are told apart by 128 bits. Of rows equal in doc_id and text one stays. Null, empty
    and wordless texts are in no component and all stay. An empty table stays empty. Column names may differ in case only;
    the text and the doc_id are those that ``only`` takes.
    """
    names = docs.columns
    placed = small_batches(docs).toDF(*(f"_{k}" for k in range(len(names))))
    doc, text = F.col(f"_{place_of(names, 'doc_id')}").cast("long"), F.col(f"_{place_of(names, 'text')}").cast("string")
    rows = placed.withColumn("doc_id", doc).withColumn("hash", F.xxhash64(text)).withColumn("hash2", F.xxhash64(F.lit(1), text)).withColumn("text", text)

    seen = written(rows.where("text is not null").groupBy("doc_id", *HASH).agg(F.count("*").alias("times")), "seen")
    by_text = seen.groupBy("doc_id").agg(F.count("*").alias("texts")).where("doc_id is null or texts > 1").limit(1).count() > 0
    if by_text:
        # Numbers in the order of (doc_id, hash) stand for the texts.
        order = [F.asc_nulls_last("doc_id"), *map(F.asc, HASH)]
        nodes = seen.repartitionByRange(shuffle_parts(docs.sparkSession), *order).sortWithinPartitions(*order)
        nodes = written(nodes.select("doc_id", *HASH, F.monotonically_increasing_id().alias("node")), "nodes")
        given = _with(rows, nodes, "inner").select(F.col("node").alias("doc_id"), "text")
    else:
        given = rows.select("doc_id", "text")
    gone = near_duplicates(given, cent).where("not kept").select("doc_id").distinct()
    if by_text:
        rest = _with(rows, written(nodes.join(gone.withColumnRenamed("doc_id", "node"), "node", "left_semi").select("doc_id", *HASH), "gone"), "left_anti")
    else:
        rest = rows.join(written(gone, "gone"), "doc_id", "left_anti")
    twice = seen.where("times > 1").select("doc_id", *HASH)
    if twice.limit(1).count():
        worded = F.col("text").rlike(r"[^ \t-\r]")
        plain = [c for c, kind in placed.dtypes if not any(k in kind for k in ("map<", "variant"))]
        again = F.row_number().over(Window.partitionBy("doc_id", *HASH).orderBy(F.xxhash64(*plain)))
        some = _with(rest.where(worded), twice, "left_semi").withColumn("again", again).where("again = 1").drop("again")
        rest = rest.where(~F.coalesce(worded, F.lit(False))).unionByName(_with(rest.where(worded), twice, "left_anti")).unionByName(some)
    return rest.select(*placed.columns).toDF(*names)


def _with(rows: DataFrame, others: DataFrame, how: str) -> DataFrame:
    """The rows joined on doc_id, null or not, and hash."""
    others = others.withColumnsRenamed({name: f"other_{name}" for name in ("doc_id", *HASH)})
    same = [F.col(name) == F.col(f"other_{name}") for name in HASH]
    return rows.join(others, [F.col("doc_id").eqNullSafe(F.col("other_doc_id")), *same], how)
