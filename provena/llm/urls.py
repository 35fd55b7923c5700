"""URL filter: host and path rules first, then gradient-boosted trees over lexical features.

All of it is DataFrame and SQL expressions. The trees learn from URLs that a rule decides: each
level of a tree is one aggregate of gradients by node, feature and bin over a bounded sample, and the
driver sees only those sums. A finished model is one expression of sums of nested conditions.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provena.llm.common import only, written

#: At most how many different labelled URLs the trees learn from, chosen by hash; all of them if there are fewer.
SAMPLE = 50_000
TREES, DEPTH, RATE, BINS, RIDGE = 12, 3, 0.4, 16, 1.0
#: Parts of the sample, dealt by host. A row's suffix statistics come from the other parts, and a row of part 0 has none, like a suffix never seen.
FOLDS, WEIGHT = 4, 10
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    allow: bool

    @property
    def text(self) -> str:
        return self.host + self.path


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; path: then up to ``?``, ``#`` or the end.

    Null URLs and those without ``://`` have neither.
    """
    shape = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(url, shape, 1), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, shape, 2), F.lit(""))


def fits(rule: Rule, host: str = "host", path: str = "path") -> Column:
    h = F.col(host)
    return ((h == rule.host) | h.endswith("." + rule.host)) & F.col(path).startswith(rule.path)


def ruled(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """Adds ``rule`` (the longest that fits, of equally long ones the one with the longer host, then the smaller text) and ``allow``; null where none fits."""
    order = sorted(rules, key=lambda r: (-len(r.text), -len(r.host), r.text))
    rule, allow = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    for r in reversed(order):
        rule, allow = F.when(fits(r), r.text).otherwise(rule), F.when(fits(r), F.lit(r.allow)).otherwise(allow)
    return pages.withColumn("rule", rule).withColumn("allow", allow)


def lexical(pages: DataFrame) -> DataFrame:
    """Adds the features that a URL has by itself."""
    url = F.coalesce("url", F.lit(""))
    size = F.greatest(F.length(url), F.lit(1))
    # Share of each distinct character, by what is left when it is taken out.
    entropy = F.expr(
        "aggregate(transform(filter(array_distinct(split(coalesce(url, ''), '')), c -> c <> ''), c -> (length(url) - length(replace(url, c, ''))) / length(url)), 0D, (a, p) -> a - p * log2(p))"
    )
    labels = F.split("host", r"\.")
    return pages.select(
        "*",
        F.length(url).cast("double").alias("f_length"),
        F.length("path").cast("double").alias("f_path"),
        F.size(F.split("path", "/")).cast("double").alias("f_depth"),
        (F.length(F.regexp_replace(url, "[^0-9]", "")) / size).alias("f_digits"),
        entropy.alias("f_entropy"),
        F.length(F.regexp_replace(F.regexp_extract(url, r"(?s)\?([^#]*)", 1), "[^=&]", "")).cast("double").alias("f_params"),
        F.size(labels).cast("double").alias("f_labels"),
        F.element_at(labels, -1).alias("suffix1"),
        F.concat_ws(".", F.slice(F.concat(F.array(F.lit(""), F.lit("")), labels), -2, 2)).alias("suffix2"),
        F.regexp_extract("path", "^/([^/]*)", 1).alias("segment"),
    )


STATS = {"suffix1": "f_suffix1", "suffix2": "f_suffix2", "segment": "f_segment"}
FEATURES = ["f_length", "f_path", "f_depth", "f_digits", "f_entropy", "f_params", "f_labels", *STATS.values()]


class Model:
    """Suffix statistics, a prior, and trees as nested (feature, threshold, left, right) or leaf values."""

    def __init__(self, prior: float, share: float, stats: dict[str, DataFrame], trees: list):
        self.prior, self.share, self.stats, self.trees = prior, share, stats, trees

    def with_stats(self, pages: DataFrame) -> DataFrame:
        """Adds the suffix statistics: tables of at most ``SAMPLE`` rows or so, which bounds the broadcast."""
        for key, name in STATS.items():
            pages = pages.join(F.broadcast(self.stats[key]), key, "left") if key in self.stats else pages.withColumn(name, F.lit(None).cast("double"))
            pages = pages.withColumn(name, F.coalesce(name, F.lit(self.share)))
        return pages

    def margin(self) -> Column:
        """Log-odds of block."""
        total = F.lit(self.prior)
        for tree in self.trees:
            total = total + _value(tree)
        return total


def _value(tree) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    feature, cut, left, right = tree
    return F.when(F.col(feature) <= cut, _value(left)).otherwise(_value(right))


def _leaf_of(tree, path: str = "r") -> Column:
    """The name of the leaf that a row reaches."""
    if not isinstance(tree, tuple):
        return F.lit(path)
    feature, cut, left, right = tree
    return F.when(F.col(feature) <= cut, _leaf_of(left, path + "0")).otherwise(_leaf_of(right, path + "1"))


def train(labelled: DataFrame, sample: int = SAMPLE, trees: int = TREES) -> Model:
    """Fits block (``allow`` false) from pages with lexical features and a label.

    Without labels everything is allowed; with one kind only, that is the verdict for all.
    """
    labelled = labelled.where("allow is not null")
    n, order = labelled.count(), F.pmod(F.xxhash64("url"), F.lit(1 << 60))
    if n > sample:
        # A url counts once, however often it occurs; the hash picks about as many rows as are wanted, and the limit makes that a bound.
        labelled = labelled.where(order < math.ceil((1 << 60) * sample / n)).dropDuplicates(["url"]).orderBy(order, "url").limit(sample)
    fold = F.pmod(F.xxhash64("host"), F.lit(FOLDS)).alias("fold")
    rows = written(labelled.select("url", *FEATURES[:-3], *STATS, fold, (~F.col("allow")).cast("double").alias("y")), "urls")
    n, ones = rows.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0.0))).first()
    share = (ones + 0.5) / (n + 1) if n else 0.0
    prior = math.log(share / (1 - share)) if n else -20.0
    if not n or ones in (0, n):
        return Model(math.copysign(20.0, prior), share, {}, [])
    stats = {}
    for key, name in STATS.items():
        smooth = (F.sum("y") + WEIGHT * share) / (F.count("*") + WEIGHT)
        stats[key] = written(rows.groupBy(key).agg(smooth.alias(name)), "suffixes")
    model = Model(prior, share, stats, [])
    rows = written(_out_of_fold(rows, share).select("y", *FEATURES), "features")
    cuts = rows.agg(*(F.percentile_approx(f, [i / BINS for i in range(1, BINS)], 1000).alias(f) for f in FEATURES)).first()
    cuts = {f: sorted(set(cuts[f])) for f in FEATURES}
    bins = [F.struct(F.lit(f).alias("f"), sum(((F.col(f) > c).cast("int") for c in cuts[f]), F.lit(0)).alias("b")) for f in FEATURES]
    for _ in range(trees):
        p = 1 / (1 + F.exp(-model.margin()))
        model.trees.append(_grown(rows.withColumn("g", F.col("y") - p).withColumn("h", p * (1 - p)), bins, cuts))
    return model


def _out_of_fold(rows: DataFrame, share: float) -> DataFrame:
    """Adds the suffix statistics as they look from outside: from other hosts' labels, or as never seen. So the trees learn how far to trust them, and what to go by without."""
    for key, name in STATS.items():
        per, every = rows.groupBy(key, "fold").agg(F.sum("y").alias("s"), F.count("*").alias("n")), Window.partitionBy(key)
        other = (F.sum("s").over(every) - F.col("s") + WEIGHT * share) / (F.sum("n").over(every) - F.col("n") + WEIGHT)
        per = per.select(key, "fold", F.when(F.col("fold") == 0, share).otherwise(other).alias(name))
        rows = rows.join(F.broadcast(per), [key, "fold"])  # as many rows as the sample at most
    return rows


def held_out(pages: DataFrame, rules: list[Rule], fold: int = 0) -> dict[str, float]:
    """How well the trees judge hosts that they haven't seen: log loss and accuracy over one part of the hosts that rules decide, learnt from the others, and the log loss of their share alone."""
    rows = only(pages, ("page_id", "long"), ("url", "string"))
    host, path = host_and_path(F.col("url"))
    rows = lexical(ruled(rows.withColumn("host", host).withColumn("path", path), rules)).where("allow is not null")
    own = F.pmod(F.xxhash64("host", F.lit(1)), F.lit(FOLDS)) == fold
    model = train(rows.where(~own))
    p = 1 / (1 + F.exp(-model.margin()))
    y, q = (~F.col("allow")).cast("double"), F.greatest(F.least(F.col("p"), F.lit(1 - 1e-6)), F.lit(1e-6))
    loss = lambda x: F.avg(-(y * F.log(x) + (1 - y) * F.log(1 - x)))
    flat = F.lit(min(max(model.share, 1e-6), 1 - 1e-6))
    found = model.with_stats(rows.where(own)).withColumn("p", p).agg(F.count("*").alias("n"), loss(q).alias("loss"), loss(flat).alias("share_loss"), F.avg(((F.col("p") >= 0.5) == (y == 1)).cast("double")).alias("accuracy"))
    return found.first().asDict()


def _grown(rows: DataFrame, bins: list[Column], cuts: dict[str, list[float]]):
    """One tree, a level at a time; the driver gets one row for each node, feature and bin."""
    tree: object = None
    leaf = lambda g, h: RATE * g / (h + RIDGE)
    for _ in range(DEPTH):
        node = _leaf_of(tree) if tree is not None else F.lit("r")
        sums = rows.select(node.alias("node"), "g", "h", F.explode(F.array(*bins)).alias("x")).groupBy("node", "x.f", "x.b").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
        split = {}
        for name in {r.node for r in sums}:
            best = (1e-6, None)
            for f, at in cuts.items():
                own = sorted((r.b, r.g, r.h) for r in sums if r.node == name and r.f == f)
                g, h = sum(x[1] for x in own), sum(x[2] for x in own)
                a = b = 0.0
                for k, gk, hk in own[:-1]:
                    a, b = a + gk, b + hk
                    gain = a * a / (b + RIDGE) + (g - a) ** 2 / (h - b + RIDGE) - g * g / (h + RIDGE)
                    if gain > best[0] and k < len(at):
                        best = gain, (f, at[k], leaf(a, b), leaf(g - a, h - b))
            if best[1]:
                split[name] = best[1]
        if not split:
            break
        tree = _placed(tree, split, "r")
    return tree if tree is not None else 0.0


def _placed(tree, split: dict, path: str):
    if not isinstance(tree, tuple):
        return split.get(path, tree if tree is not None else 0.0)
    return tree[0], tree[1], _placed(tree[2], split, path + "0"), _placed(tree[3], split, path + "1")


def judged(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every page.

    The rule's verdict, else block where the trees' probability of block is 0.5 or more; ``score``
    is that probability for all rows. Null and empty URLs have empty host and path, fit no rule and are
    scored like others; repeated rows stay; an empty table gives no rows; other columns are ignored.
    """
    rows = only(pages, ("page_id", "long"), ("url", "string"))
    host, path = host_and_path(F.col("url"))
    rows = lexical(ruled(rows.withColumn("host", host).withColumn("path", path), rules))
    model = train(rows)
    score = 1 / (1 + F.exp(-model.margin()))
    scored = model.with_stats(rows).withColumn("score", score)
    verdict = F.when(F.coalesce("allow", F.col("score") < 0.5), "allow").otherwise("block")
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
