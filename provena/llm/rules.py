"""Quality rules as a ledger of bits: each rule is evaluated once, and policies are masks over what is stored.

``ledger`` measures every document and stores the measurements with one integer, in which bit k says that rule k fails. A policy is a version with
the rules that reject; it is applied by one bitwise AND to the stored integer, so a new version reads no text. Ablations come from the same
integers: they are counted by value, of which there are at most two for each rule to the power of their number, and then compared with masks.

All of it is DataFrame expressions. Sorting a document's 3-word windows by hash, words and place puts equal windows next to each other, so repeats are found
without exploding rows or comparing all pairs; one document's windows are held at once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provena.llm.common import only, written

#: White space between words, and symbols.
SPACE, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MEASURES = [*COUNTS, "n_lines", "n_marks", "n_upper", "n_letters"]
#: Words in a window that may repeat.
WINDOW = 3


@dataclass(frozen=True)
class Rule:
    """What fails under a rule, as a condition on the measurements."""

    name: str
    fails: Callable[[], Column]


def _share(part: str, whole: str, percent: int) -> Callable[[], Column]:
    return lambda: 100 * F.col(part) > percent * F.col(whole)


#: A rule's place is its bit, so rules are only ever added at the end.
RULES = [
    Rule("few_words", lambda: F.col("n_words") < 50),
    Rule("repeated_words", _share("n_repeat_words", "n_words", 50)),
    Rule("symbols", _share("n_symbols", "n_words", 10)),
    Rule("repeated_lines", _share("n_dup_lines", "n_lines", 50)),
    Rule("shouting", _share("n_marks", "n_words", 20)),
    Rule("upper_case", _share("n_upper", "n_letters", 50)),
    Rule("long_words", lambda: F.col("word_chars") > 20 * F.col("n_words")),
    Rule("short_words", lambda: F.col("word_chars") < 2 * F.col("n_words")),
]


@dataclass(frozen=True)
class Policy:
    """A version and the names of the rules that reject."""

    version: str
    rejects: tuple[str, ...]

    def mask(self, rules: list[Rule] = RULES) -> int:
        bits = {rule.name: 1 << k for k, rule in enumerate(rules)}
        return sum(bits[name] for name in self.rejects)


BASE = Policy("base", ("few_words", "repeated_words"))
STRICT = Policy("2", tuple(rule.name for rule in RULES))
POLICIES = [BASE, Policy("1", ("few_words", "repeated_words", "symbols", "repeated_lines")), STRICT]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """The runs of characters other than white space."""
    return F.filter(F.split(F.translate(text, SPACE[1:], " " * (len(SPACE) - 1)), " "), lambda w: w != "")


def repeated(tokens: Column, size: int = WINDOW) -> Column:
    """How many words lie in a window of ``size`` words that occurs twice or more in the list.

    Windows are sorted by their words, so equal ones are neighbours; a 64-bit hash leads only to make comparing fast. Of the places of repeated windows, in
    order, each adds the words up to the next place, at most ``size``.
    """

    def of(w: Column) -> Column:
        n = F.size(w) - size + 1
        at = lambda i: [F.get(w, i + k) for k in range(size)]
        windows = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.xxhash64(*at(i)).alias("h"), *(x.alias(f"w{k}") for k, x in enumerate(at(i))), i.alias("i")))
        return F.when(n > 1, let(F.sort_array(windows), covered)).otherwise(0)

    def covered(s: Column) -> Column:
        same = lambda a, b: (a["h"] == b["h"]) & F.coalesce(_all(a[f"w{k}"] == b[f"w{k}"] for k in range(size)), F.lit(False))
        twin = lambda x, i: same(x, F.get(s, i + 1)) | F.when(i > 0, same(x, F.get(s, i - 1))).otherwise(False)
        places = F.sort_array(F.transform(F.filter(s, lambda x, i: F.coalesce(twin(x, i), F.lit(False))), lambda x: x["i"]))
        return let(places, lambda p: F.aggregate(F.zip_with(p, F.slice(p, 2, F.size(p)), lambda a, b: F.least(F.coalesce(b - a, F.lit(size)), F.lit(size))), F.lit(0), lambda total, x: total + x))

    return let(tokens, of)


def _all(conditions) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id and ``MEASURES``) of every row; a null text has no words, lines or symbols.

    n_dup_lines are lines with a word that equal an earlier one, of n_lines lines with a word; n_marks are exclamation marks, n_upper letters whose lower case
    differs, of n_letters letters.
    """
    rows = only(docs, ("doc_id", "long"), ("text", "string")).withColumn("text", F.coalesce("text", F.lit("")))
    lines = F.filter(F.split("text", "\n"), lambda line: F.btrim(line, F.lit(SPACE)) != "")
    count = lambda pattern: F.regexp_count("text", F.lit(pattern))
    rows = rows.select("doc_id", "text", words(F.col("text")).alias("w"), lines.alias("l"))
    own = {
        "n_words": F.size("w"),
        "word_chars": F.length(F.array_join("w", "")),
        "n_symbols": count(f"[{SYMBOLS}]"),
        "n_dup_lines": F.size("l") - F.size(F.array_distinct("l")),
        "n_repeat_words": repeated(F.col("w")),
        "n_lines": F.size("l"),
        "n_marks": count("!"),
        "n_upper": F.length("text") - F.length(F.regexp_replace("text", r"\p{Lu}+", "")),
        "n_letters": F.length("text") - F.length(F.regexp_replace("text", r"\p{L}+", "")),
    }
    return rows.select("doc_id", *(own[name].cast("long").alias(name) for name in MEASURES))


def ledger(docs: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """(doc_id, ``MEASURES``, failures): stored in the shared folder, each rule evaluated once. Repeated rows stay; an empty table gives an empty ledger."""
    bits = F.lit(0).cast("long")
    for k, rule in enumerate(rules):
        bits = bits.bitwiseOR(F.when(rule.fails(), F.lit(1 << k)).otherwise(0).cast("long"))
    return written(measured(docs).withColumn("failures", bits), "ledger")


def applied(rows: DataFrame, policy: Policy, rules: list[Rule] = RULES) -> Column:
    """Whether a policy keeps a row of the ledger."""
    return F.col("failures").bitwiseAND(F.lit(policy.mask(rules)).cast("long")) == 0


def by_policy(rows: DataFrame, policies: list[Policy] = POLICIES, rules: list[Rule] = RULES) -> DataFrame:
    """(version, rule, n_docs, n_kept, n_fail, n_only): what each policy keeps, and for each of its rules the documents that fail it and those that fail no other rule of
    the policy, which are kept once the rule is taken out. Read from counts of equal bits, without a text or a measurement."""
    counts = rows.groupBy("failures").agg(F.count("*").alias("n"))
    wanted = [(p.version, r.name, p.mask(rules), 1 << k) for p in policies for k, r in enumerate(rules) if r.name in p.rejects]
    masks = F.explode(F.array(*(F.struct(F.lit(v).alias("version"), F.lit(r).alias("rule"), F.lit(m).cast("long").alias("mask"), F.lit(b).cast("long").alias("bit")) for v, r, m, b in wanted)))
    each = counts.select("failures", "n", masks.alias("m")).select("n", "m.*", F.col("failures").bitwiseAND(F.col("m.mask")).alias("own"))
    number = lambda condition: F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))
    return each.groupBy("version", "rule").agg(
        F.sum("n").alias("n_docs"),
        number(F.col("own") == 0).alias("n_kept"),
        number(F.col("own").bitwiseAND(F.col("bit")) != 0).alias("n_fail"),
        number(F.col("own") == F.col("bit")).alias("n_only"),
    )


def by_group(rows: DataFrame, *names: str) -> DataFrame:
    """For each group: the bits of rules that some document fails, that all fail, and that an odd number fails."""
    return rows.groupBy(*names).agg(F.bit_or("failures").alias("some"), F.bit_and("failures").alias("every"), F.bit_xor("failures").alias("odd"))


def judged(docs: DataFrame, policy: Policy = STRICT) -> DataFrame:
    """(doc_id, ``COUNTS``, base_failed, kept, failures) of every row. Null texts have no words, so they fail."""
    rows = ledger(docs)
    return rows.select("doc_id", *COUNTS, (~applied(rows, BASE)).alias("base_failed"), applied(rows, policy).alias("kept"), "failures")
