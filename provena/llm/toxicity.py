"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

A text is lower-cased and cut into words (runs of letters and digits). Each word has two inputs:
the embedding of the word itself and the mean of the embeddings of its character n-grams (threes
within word marks, and its first four and five characters), both by hash. Two recurrent passes
run over a window of ``WINDOW`` words, attention weighs their states, and a logistic unit gives the
window's score. All windows at steps of ``STEP`` words are scored, and the highest one scores the text.

Training knows labels of whole texts only. It starts the first dimension of each embedding from
smoothed log-odds, takes from toxic texts the windows that look most toxic so far and from others
those and a random one, and chooses anew between rounds. A tenth and a half of the sample is kept
from the network and fits the scale of the final score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provena.llm.common import held, only, place_of, small_batches, text_of

#: Bound of the training sample: so many toxic and other texts, chosen by hash, of at most so many code points.
TOXIC_SAMPLE, OTHER_SAMPLE, SAMPLE_CHARS = 1500, 4000, 20_000
WINDOW, STEP = 32, 16
WORD_BITS, CHAR_BITS, EMBED, HIDDEN, ATTENTION = 16, 15, 8, 8, 4
#: A round takes all chosen windows in batches, again and again until it has made so many steps.
ROUNDS, STEPS, BATCH = 3, 100, 256
#: Words and n-grams in fewer texts of the sample have no embedding of their own: their rows stay 0.
FEW = 4
REJECT = 0.7

WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def grams(word: str) -> list[int]:
    """Hashes of a word's character n-grams."""
    b = f"<{word}>".encode("utf-8", "surrogatepass")
    mask = (1 << CHAR_BITS) - 1
    out = [crc32(b[i : i + 3]) & mask for i in range(max(1, len(b) - 2))]
    if len(b) > 5:
        out.append(crc32(b[:5], 1) & mask)
    if len(b) > 6:
        out.append(crc32(b[:6], 2) & mask)
    return out


def inputs(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, n-gram hashes one after the other, and where each word's begin."""
    mask = (1 << WORD_BITS) - 1
    whole = np.fromiter((crc32(w.encode("utf-8", "surrogatepass"), 3) & mask for w in words), np.int64, len(words))
    parts = [grams(w) for w in words]
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    return whole, np.array([g for p in parts for g in p], np.int64), np.cumsum(sizes) - sizes


def windows(n: int) -> np.ndarray:
    """First words of the windows of a text of n words; the last one ends with the text."""
    if n <= WINDOW:
        return np.zeros(1 if n else 0, np.int64)
    return np.unique(np.append(np.arange(0, n - WINDOW, STEP), n - WINDOW))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def summed(where: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct numbers, and for each the sum of its rows."""
    order = np.argsort(where, kind="stable")
    where = where[order]
    first = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]]))
    return where[first], np.add.reduceat(rows[order], first, axis=0)


class Network:
    """Parameters, forward pass, and gradients."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        f = np.float32
        self.word = (0.1 * r.standard_normal((1 << WORD_BITS, EMBED))).astype(f)
        self.char = (0.1 * r.standard_normal((1 << CHAR_BITS, EMBED))).astype(f)
        self.p: dict[str, np.ndarray] = {}
        for d in "fb":
            self.p["W" + d] = (r.standard_normal((2 * EMBED, 3 * HIDDEN)) / np.sqrt(2 * EMBED)).astype(f)
            self.p["U" + d] = (r.standard_normal((HIDDEN, 3 * HIDDEN)) / np.sqrt(HIDDEN)).astype(f)
            self.p["b" + d] = np.zeros(3 * HIDDEN, f)
        self.p["A"] = (r.standard_normal((2 * HIDDEN, ATTENTION)) / np.sqrt(2 * HIDDEN)).astype(f)
        self.p["a"] = (r.standard_normal(ATTENTION) / np.sqrt(ATTENTION)).astype(f)
        self.p["o"] = (r.standard_normal(2 * HIDDEN) / np.sqrt(2 * HIDDEN)).astype(f)
        self.p["c"] = np.zeros(1, f)
        self.scale, self.shift, self.empty = 1.0, 0.0, 0.0

    def embed(self, whole: np.ndarray, parts: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """The input rows of some words."""
        if not len(whole):
            return np.zeros((0, 2 * EMBED), np.float32)
        sizes = np.diff(np.append(begins, len(parts)))
        return np.hstack([self.word[whole], np.add.reduceat(self.char[parts], begins, axis=0) / sizes[:, None].astype(np.float32)])

    def _pass(self, d: str, gates: np.ndarray, index: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States (windows, places, HIDDEN) of one direction; gates holds each word's input to the gates."""
        U, n, h = self.p["U" + d], HIDDEN, np.zeros((len(index), HIDDEN), np.float32)
        out = np.empty((len(index), index.shape[1], HIDDEN), np.float32)
        for t in range(index.shape[1]) if d == "f" else range(index.shape[1] - 1, -1, -1):
            x, u = gates[index[:, t]], h @ U
            zr = x[:, : 2 * n] + u[:, : 2 * n]
            zr *= 0.5
            np.tanh(zr, out=zr)
            zr += 1
            zr *= 0.5  # the logistic function of the sum
            z, r = zr[:, :n], zr[:, n:]
            new = r * u[:, 2 * n :]
            new += x[:, 2 * n :]
            np.tanh(new, out=new)
            if keep is not None:
                keep.append((t, h, z, r, new, u[:, 2 * n :]))
            h = h - new
            h *= z
            h += new
            out[:, t] = h
        return out

    def logits(self, rows: np.ndarray, index: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """One number for each window; index points into rows, and -1 stands behind a short text's end."""
        rows = np.vstack([rows, np.zeros((1, 2 * EMBED), np.float32)])  # what -1 points to
        trace: dict[str, list] = {"f": [], "b": []}
        states = np.concatenate([self._pass(d, rows @ self.p["W" + d] + self.p["b" + d], index, trace[d] if keep is not None else None) for d in "fb"], axis=2)
        tops = np.tanh(states @ self.p["A"])
        e = np.where(index < 0, np.float32(-1e9), tops @ self.p["a"])
        e = np.exp(e - e.max(axis=1, keepdims=True))
        weight = e / e.sum(axis=1, keepdims=True)
        pooled = (weight[:, None, :] @ states)[:, 0]
        if keep is not None:
            keep.update(rows=rows, trace=trace, states=states, tops=tops, weight=weight, pooled=pooled)
        return pooled @ self.p["o"] + self.p["c"][0]

    def gradients(self, index: np.ndarray, k: dict, d_out: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Of the parameters and of the input rows, for the given gradient of the logits."""
        g = {"o": k["pooled"].T @ d_out, "c": d_out.sum(keepdims=True)}
        d_pooled = d_out[:, None] * self.p["o"]
        d_weight = (k["states"] @ d_pooled[:, :, None])[:, :, 0]
        d_states = k["weight"][:, :, None] * d_pooled[:, None, :]
        d_e = k["weight"] * (d_weight - (k["weight"] * d_weight).sum(axis=1, keepdims=True))
        g["a"] = np.einsum("bt,bta->a", d_e, k["tops"])
        d_pre = d_e[:, :, None] * self.p["a"] * (1 - k["tops"] ** 2)
        g["A"] = np.einsum("bts,bta->sa", k["states"], d_pre)
        d_states = d_states + d_pre @ self.p["A"].T
        d_rows = np.zeros_like(k["rows"])
        for at, d in ((0, "f"), (HIDDEN, "b")):
            U, W, d_x = self.p["U" + d], self.p["W" + d], np.zeros((*index.shape, 3 * HIDDEN), k["rows"].dtype)
            g["U" + d], d_h = np.zeros_like(U), np.zeros((len(index), HIDDEN), np.float32)
            for t, h, z, r, new, un in reversed(k["trace"][d]):
                d_h = d_h + d_states[:, t, at : at + HIDDEN]
                d_new = d_h * (1 - z) * (1 - new**2)
                d_z = d_h * (h - new) * z * (1 - z)
                d_r = d_new * un * r * (1 - r)
                d_x[:, t] = np.hstack([d_z, d_r, d_new])
                d_u = np.hstack([d_z, d_r, d_new * r])
                g["U" + d] += h.T @ d_u
                d_h = d_h * z + d_u @ U.T
            some, total = summed(index.ravel(), d_x.reshape(-1, 3 * HIDDEN))
            d_gates = np.zeros((len(k["rows"]), 3 * HIDDEN), d_x.dtype)
            d_gates[some] = total
            g["W" + d], g["b" + d] = k["rows"].T @ d_gates, d_gates.sum(axis=0)
            d_rows += d_gates @ W.T
        return g, d_rows[:-1]


class Sample:
    """Training texts as word numbers over one list of distinct words."""

    def __init__(self, texts: list[str]):
        known: dict[str, int] = {}
        self.docs = [np.array([known.setdefault(w, len(known)) for w in words_of(t)], np.int64) for t in texts]
        self.whole, self.parts, self.begins = inputs(list(known))
        self.sizes = np.diff(np.append(self.begins, len(self.parts)))

    def words(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sizes = self.sizes[some]
        begins = np.cumsum(sizes) - sizes
        flat = np.repeat(self.begins[some] - begins, sizes) + np.arange(sizes.sum())
        return self.whole[some], self.parts[flat], begins

    def cut(self, doc: int) -> np.ndarray:
        return cut(self.docs[doc])


def cut(words: np.ndarray) -> np.ndarray:
    """The windows of a text as rows of word numbers, -1 behind the end of a short text."""
    at = windows(len(words))
    if not len(at):
        return np.zeros((0, WINDOW), np.int64)
    if len(words) < WINDOW:
        words = np.append(words, np.full(WINDOW - len(words), -1))
    return words[at[:, None] + np.arange(WINDOW)]


def _log_odds(net: Network, s: Sample, docs: np.ndarray, y: np.ndarray) -> None:
    """The first dimension of the embeddings, from the shares of toxic texts among those that hold them."""
    share = y[docs].mean()
    for table, bits in ((net.word, WORD_BITS), (net.char, CHAR_BITS)):
        seen = np.zeros((2, 1 << bits))
        for d in docs:
            own = np.unique(s.docs[d])
            if len(own):
                whole, parts, _ = s.words(own)
                seen[int(y[d]), np.unique(whole if bits == WORD_BITS else parts)] += 1
        p = (seen[1] + 8 * share) / (seen.sum(axis=0) + 8)
        table[:, 0] = np.clip(np.log(p / (1 - p)) - np.log(share / (1 - share)), -4, 4) / 2
        table[seen.sum(axis=0) < FEW] = 0


def _best(net: Network, s: Sample, docs: np.ndarray, first: bool) -> list[np.ndarray]:
    """For each text its windows' scores so far."""
    rows = net.embed(s.whole, s.parts, s.begins)
    odds = np.append(np.maximum(rows[:, 0] + rows[:, EMBED], 0), 0)
    out = []
    for at in range(0, len(docs), 64):
        cuts = [s.cut(d) for d in docs[at : at + 64]]
        w = np.concatenate(cuts)
        if first or not len(w):
            score = odds[w].sum(axis=1)
        else:
            own, place = np.unique(w, return_inverse=True)
            missing = int(own[0] < 0)
            score = net.logits(rows[own[missing:]], place.reshape(w.shape) - missing)
        out += np.split(score, np.cumsum([len(c) for c in cuts])[:-1])
    return out


def train(texts: list[str], labels: list[int], seed: int = 7) -> Network:
    """A network from whole texts and their labels; without both labels a constant one."""
    net, rng = Network(seed), np.random.default_rng(seed)
    y = np.array(labels, np.float32)
    share = float(y.mean()) if len(y) else 0.0
    net.empty = share
    if share in (0.0, 1.0):
        net.scale, net.shift = 0.0, -20.0 if share == 0 else 20.0
        return net
    s = Sample(texts)
    order = rng.permutation(len(y))
    rest, docs = order[: len(y) * 15 // 100], order[len(y) * 15 // 100 :]
    if len({*y[docs]}) < 2 or len({*y[rest]}) < 2:
        rest = docs = order
    _log_odds(net, s, docs, y)
    moment = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    sums = {"word": np.full(len(net.word), 1e-4, np.float32), "char": np.full(len(net.char), 1e-4, np.float32)}
    step = 0
    for turn in range(ROUNDS):
        taken, marks = [], []
        for d, score in zip(docs, _best(net, s, docs, turn == 0), strict=True):
            if len(score):
                top = np.argsort(-score, kind="stable")[: 2 if y[d] else 3]
                pick = top[:1] if y[d] and len(top) > 1 and turn == 0 and score[top[1]] <= 0 else top
                if not y[d]:
                    pick = np.unique(np.append(pick, rng.integers(len(score))))
                taken.append(s.cut(d)[pick])
                marks.append(np.full(len(pick), y[d], np.float32))
        x, t = np.concatenate(taken), np.concatenate(marks)
        parts_ = max(1, len(x) // min(BATCH, max(16, len(x) // 8)))
        for _ in range(-(-STEPS // parts_)):
            for at in np.array_split(rng.permutation(len(x)), parts_):
                w = x[at]
                own, index = np.unique(w, return_inverse=True)
                index = index.reshape(w.shape)
                if own[0] < 0:
                    own, index = own[1:], index - 1
                whole, parts, begins = s.words(own)
                keep: dict = {}
                out = net.logits(net.embed(whole, parts, begins), index, keep)
                g, d_rows = net.gradients(index, keep, ((sigmoid(out) - t[at]) / len(at)).astype(np.float32))
                step += 1
                for k, v in g.items():
                    m = moment[k]
                    m[0] += 0.1 * (v - m[0])
                    m[1] += 0.001 * (v * v - m[1])
                    net.p[k] -= (0.005 * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
                sizes = np.diff(np.append(begins, len(parts)))
                for name, at_, d in (("word", whole, d_rows[:, :EMBED]), ("char", parts, np.repeat(d_rows[:, EMBED:] / sizes[:, None], sizes, axis=0))):
                    some, total = summed(at_, d)
                    usual = getattr(net, name)[some].any(axis=1)
                    some, total = some[usual], total[usual]
                    sums[name][some] += (total**2).mean(axis=1)
                    getattr(net, name)[some] -= 0.02 * total / np.sqrt(sums[name][some])[:, None]
    _fit_scale(net, np.array([b.max() if len(b) else 0.0 for b in _best(net, s, rest, False)]), y[rest])
    return net


def _fit_scale(net: Network, top: np.ndarray, y: np.ndarray) -> None:
    """Logistic scale of the highest logit, with a weak pull to the scale 1 and both kinds weighing the same."""
    a, b = 1.0, 0.0
    weight = np.where(y > 0, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    for _ in range(500):
        d = (sigmoid(a * top + b) - y) * weight
        a -= 0.05 * ((d * top).mean() + 0.02 * (a - 1))
        b -= 0.05 * (d.mean() + 0.002 * b)
    net.scale, net.shift = float(max(a, 1e-3)), float(b)


class Scorer:
    """Scores texts with a network; keeps the input rows of words it has met, up to a bound."""

    MOST = 300_000

    def __init__(self, net: Network):
        self.net = net
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.rows = np.zeros((1 << 12, 2 * EMBED), np.float32)

    def _numbers(self, texts: list[list[str]]) -> list[np.ndarray]:
        if len(self.known) > self.MOST:
            self._clear()
        known, first = self.known, len(self.known)
        new = []
        out = []
        for words in texts:
            got = [*map(known.get, words)]
            if None in got:
                for k, (w, at) in enumerate(zip(words, got, strict=True)):
                    if at is None:
                        if w not in known:
                            known[w] = len(known)
                            new.append(w)
                        got[k] = known[w]
            out.append(np.array(got, np.int64))
        if new:
            while len(self.rows) < len(known):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.rows[first : len(known)] = self.net.embed(*inputs(new))
        return out

    def scores(self, texts: list[str]) -> list[float]:
        net = self.net
        if not net.scale:
            return [float(sigmoid(np.array(net.shift)))] * len(texts)
        parts = [cut(w) for w in self._numbers([words_of(t) for t in texts])]
        sizes = np.array([len(p) for p in parts])
        top = np.full(len(texts), -np.inf)
        if sizes.sum():
            index = np.concatenate(parts)
            owner = np.repeat(np.arange(len(texts)), sizes)
            for at in range(0, len(index), 4096):
                w = index[at : at + 4096]
                own, place = np.unique(w, return_inverse=True)
                place = place.reshape(w.shape)
                if own[0] < 0:
                    own, place = own[1:], place - 1
                np.maximum.at(top, owner[at : at + 4096], net.logits(self.rows[own], place))
        score = sigmoid(net.scale * top + net.shift)
        return [float(x) if n else net.empty for x, n in zip(score, sizes, strict=True)]


def fitted(docs: DataFrame, labels: DataFrame, toxic: int = TOXIC_SAMPLE, other: int = OTHER_SAMPLE, chars: int = SAMPLE_CHARS) -> Network:
    """Trains on a bounded sample of labelled texts whose crc32(doc_id as text) mod 3 is not 1.

    Labels other than 0 and 1, null doc_ids and texts, longer texts, and labels without a document take no places of the sample. Of several
    texts of one doc_id the least is taken.
    """
    marks = only(labels, ("doc_id", "long"), ("toxic", "int")).where("doc_id is not null and toxic in (0, 1)").where(~held_out()).distinct()
    texts = only(docs, ("doc_id", "long"), ("text", "string")).where(F.length("text") <= chars)
    marks = marks.join(texts.select("doc_id").distinct(), "doc_id", "left_semi")
    some = [marks.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for k, n in ((1, toxic), (0, other))]
    chosen = some[0].union(some[1])  # so few rows that they may be sent to all tasks
    rows = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: (r.doc_id, r.toxic, r.text))
    return train([r.text for r in rows], [r.toxic for r in rows])


def held_out():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1


def _ready(sent, number: int) -> Scorer:
    """One scorer in each worker, so that its words serve all tasks."""
    return held(("scorer", number), lambda: Scorer(sent.value))


def scored(docs: DataFrame, net: Network) -> DataFrame:
    """(doc_id, score) of every whole text, 0 to 1.

    Null, empty and wordless texts get the share of toxic texts in the sample. Repeated rows give
    rows each; an empty table gives none; other columns are ignored. No shuffle.
    """
    sent = docs.sparkSession.sparkContext.broadcast(net)
    number = sent._jbroadcast.id()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = _ready(sent, number)
        for frame in frames:
            for at in range(0, len(frame), 128):
                part = frame.iloc[at : at + 128]
                yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64"), "score": scorer.scores(text_of(part["text"]))})

    return only(docs, ("doc_id", "long"), ("text", "string")).mapInPandas(run, "doc_id long, score double")


def judged(docs: DataFrame, net: Network) -> DataFrame:
    """Adds held_out and predicted (1 from a score of ``REJECT``) to the scores."""
    rows = scored(docs, net)
    return rows.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= REJECT).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, net: Network) -> DataFrame:
    """The documents whose score is below ``REJECT``; columns stay as they are.

    Null, empty and wordless texts have the score that ``scored`` gives them; rows with a null doc_id and repeated rows are scored like
    others. Column names may differ in case only; the text is the one that ``only`` takes. No shuffle.
    """
    names = docs.columns
    at_text = place_of(names, "text")
    sent = docs.sparkSession.sparkContext.broadcast(net)
    number = sent._jbroadcast.id()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _ready(sent, number)
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                keep = [x < REJECT for x in scorer.scores(text_of(part.column(at_text).to_pylist()))]
                yield part.filter(pa.array(keep, pa.bool_()))

    placed = small_batches(docs).toDF(*(f"_{k}" for k in range(len(names))))
    return placed.mapInArrow(run, placed.schema).toDF(*names)
