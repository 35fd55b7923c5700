"""Reply trees as training conversations: paths by self-joins, ranked branches, a reversible template.

Paths are enumerated by doubling: jump tables give each message its ancestor 1, 2, 4, ... steps up
(each table is the one before joined with itself), and a path grows from its leaf by one join with
each table. So a chain of n messages takes log2(n) rounds, and only chosen leaves get paths.

Template: a system turn is ``[SYS] text [/SYS]``, a user turn ``[INST] text [/INST]``, an assistant
turn ``[OUT] text</s>``, another role ``[ROLE role] text [/ROLE]``; a conversation begins with
``<s>``. Inside texts and roles a backslash stands before each of ``\\``, ``[``, ``]`` and ``<``, so no
control string can arise from them, and removing it gives the text back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from provena.llm.common import only, shuffle_parts, text_of, written

#: A row of output holds at most this many turns; longer conversations go on in the next row.
PART = 256
PARTS = "tree string, leaf long, part long, formatted string, loss array<struct<begin:long,end:long>>"
DIGEST = "tree string, leaf long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

MARKS = {"system": ("[SYS] ", " [/SYS]"), "user": ("[INST] ", " [/INST]"), "assistant": ("[OUT] ", "</s>")}
TURN = re.compile(
    r"\[SYS\] (?P<system>(?:[^\\\[]|\\.)*?) \[/SYS\]|\[INST\] (?P<user>(?:[^\\\[]|\\.)*?) \[/INST\]"
    r"|\[OUT\] (?P<assistant>(?:[^\\<]|\\.)*+)</s>|\[ROLE (?P<role>(?:[^\\\]]|\\.)*+)\] (?P<other>(?:[^\\\[]|\\.)*?) \[/ROLE\]",
    re.S,
)


def escaped(text: str) -> str:
    return re.sub(r"[\\\[\]<]", r"\\\g<0>", text)


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def formatted(role: str, text: str) -> tuple[str, int, int]:
    """A turn, and where its escaped text begins and ends."""
    begin, end = MARKS.get(role) or (f"[ROLE {escaped(role)}] ", " [/ROLE]")
    inner = escaped(text)
    return f"{begin}{inner}{end}", len(begin), len(begin) + len(inner)


def turns_of(text: str) -> Iterator[tuple[str, str, int, int]]:
    """(role, text, begin, end) of the turns in formatted text; begin and end are those of the escaped text."""
    at = 3 if text.startswith("<s>") else 0
    while at < len(text):
        m = TURN.match(text, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        kind = next(k for k in ("system", "user", "assistant", "other") if m[k] is not None)
        yield (kind if kind != "other" else unescaped(m["role"])), unescaped(m[kind]), m.start(kind), m.end(kind)
        at = m.end()


def _paths(messages: DataFrame, leaves: DataFrame) -> DataFrame:
    """(tree, leaf, msg, up): all messages above each leaf and the leaf itself, with their distance."""
    jump = written(messages.where("parent is not null and parent <> msg").select("tree", "msg", F.col("parent").alias("to")), "jump")
    paths, step = leaves.select("tree", "leaf", F.col("leaf").alias("msg"), F.lit(0).cast("long").alias("up")), 1
    while jump.limit(1).count():
        more = paths.join(jump, ["tree", "msg"]).select("tree", "leaf", F.col("to").alias("msg"), (F.col("up") + step).alias("up"))
        paths = written(paths.union(more), "paths")
        far = jump.select("tree", F.col("msg").alias("to"), F.col("to").alias("far"))
        jump = written(jump.join(far, ["tree", "to"]).select("tree", "msg", F.col("far").alias("to")), "jump")
        step *= 2
    return paths


def best_paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """(tree, leaf, depth, role, text) of the ``branches`` best root-to-leaf paths of each tree.

    Messages are (tree string, msg long, parent long, role, text, score double); of rows that share (tree, msg), repeated ones too, the
    least (parent, role, text, score) counts, null before all; rows with a null tree or msg are left out. A root has no parent; a message whose parent is
    missing is a root as well. A branch's score is the mean of its messages' scores, null counts as 0; ties go to the smaller leaf. Messages on a
    cycle have no leaf and don't appear. Null and empty texts are kept as they are; an empty table gives no rows; other columns are ignored.
    """
    rows = only(messages, ("tree", "string"), ("msg", "long"), ("parent", "long"), ("role", "string"), ("text", "string"), ("score", "double"))
    # A struct with a null field comes before others.
    least = F.min(F.struct("parent", "role", "text", "score")).alias("m")
    return _best(rows.where("tree is not null and msg is not null").groupBy("tree", "msg").agg(least).select("tree", "msg", "m.*"), branches)


def _best(messages: DataFrame, branches: int) -> DataFrame:
    """The same of messages whose (tree, msg) is unique."""
    # A cycle would never run out of jumps: what can't be reached from a root within the rounds is cut off first.
    above = messages.where("parent is not null").select("tree", F.col("parent").alias("msg")).distinct()
    leaves = messages.join(above, ["tree", "msg"], "left_anti").select("tree", F.col("msg").alias("leaf"))
    known = messages.select("tree", F.col("msg").alias("parent"))
    sound = messages.join(known, ["tree", "parent"], "left_semi").select("tree", "msg", "parent")
    edges = _acyclic(sound)
    if branches < 1:
        return messages.limit(0).select("tree", F.col("msg").alias("leaf"), F.lit(0).cast("long").alias("depth"), "role", "text", F.lit(0).alias("rank"))
    chosen = _ranked(messages, edges, leaves).where(F.col("rank") <= branches)
    chosen = written(chosen, "leaves")
    paths = _paths(edges, chosen.select("tree", "leaf"))
    ends = paths.groupBy("tree", "leaf").agg(F.max("up").alias("last")).join(chosen, ["tree", "leaf"])
    return paths.join(messages, ["tree", "msg"]).join(ends, ["tree", "leaf"]).select("tree", "leaf", (F.col("last") - F.col("up")).alias("depth"), "role", "text", "rank")


def _ranked(messages: DataFrame, edges: DataFrame, leaves: DataFrame) -> DataFrame:
    """(tree, leaf, rank): leaves by the mean score of their branch, from sums that are carried up along jumps of doubling length; no path is written out for it.

    A tree's only leaf is its best.
    """
    n = F.count("*").over(Window.partitionBy("tree"))
    counted = leaves.withColumn("n", n)
    alone = counted.where("n = 1").select("tree", "leaf", F.lit(1).alias("rank"))
    several = counted.where("n > 1").select("tree", "leaf")
    if not several.limit(1).count():
        return alone
    trees = several.select("tree").distinct()
    own = messages.join(trees, "tree", "left_semi").select("tree", "msg", F.coalesce("score", F.lit(0.0)).alias("sum"), F.lit(1).cast("long").alias("n"))
    to = edges.select("tree", "msg", F.col("parent").alias("to"))
    state = written(own.join(to, ["tree", "msg"], "left"), "sums")
    while state.where("to is not null").limit(1).count():
        far = state.select("tree", F.col("msg").alias("to"), F.col("sum").alias("more"), F.col("n").alias("further"), F.col("to").alias("far"))
        up = state.join(far, ["tree", "to"], "left")
        state = written(up.select("tree", "msg", (F.col("sum") + F.coalesce("more", F.lit(0.0))).alias("sum"), (F.col("n") + F.coalesce("further", F.lit(0))).alias("n"), F.col("far").alias("to")), "sums")
    scored = several.join(state.withColumnRenamed("msg", "leaf"), ["tree", "leaf"])
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc(F.col("sum") / F.col("n")), "leaf"))
    return scored.select("tree", "leaf", rank.alias("rank")).unionByName(alone)


def _acyclic(edges: DataFrame) -> DataFrame:
    """The edges without those whose parent is not smaller, if message ids don't order the tree; else all."""
    if not edges.where("parent >= msg").limit(1).count():
        return edges
    # Ids in any order: peel roots off, level by level by doubling, until nothing new is reached.
    reach = written(edges.select("tree", "msg", F.col("parent").alias("to")), "reach")
    n = edges.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    step = 1
    while step <= n and reach.limit(1).count():
        far = reach.select("tree", F.col("msg").alias("to"), F.col("to").alias("far"))
        reach = written(reach.join(far, ["tree", "to"]).select("tree", "msg", F.col("far").alias("to")), "reach")
        step *= 2
    # What still has an ancestor that far up hangs on a cycle.
    return edges.join(reach.select("tree", "msg").distinct(), ["tree", "msg"], "left_anti")


def format_paths(paths: DataFrame) -> DataFrame:
    """(tree, leaf, part, formatted, loss): each path as text in rows of at most ``PART`` turns.

    ``loss`` lists the spans, in code points of the row's text, of assistant texts as escaped. Null
    roles and texts are empty. Rows of a path are walked in order and never held together.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, part, turns, size, texts, loss = None, 0, 0, 0, [], []

        def row() -> pd.DataFrame:
            return pd.DataFrame({"tree": [key[0]], "leaf": [key[1]], "part": [part], "formatted": ["".join(texts)], "loss": [loss]})

        for frame in frames:
            for tree, leaf, role, text in zip(frame["tree"], frame["leaf"], text_of(frame["role"]), text_of(frame["text"]), strict=True):
                if key != (tree, leaf) or turns == PART:
                    if key:
                        yield row()
                    part = part + 1 if key == (tree, leaf) else 0
                    key, turns, texts, loss = (tree, leaf), 0, [] if part else ["<s>"], []
                    size = sum(map(len, texts))
                turn, begin, end = formatted(role, text)
                if role == "assistant":
                    loss.append({"begin": size + begin, "end": size + end})
                texts.append(turn)
                size, turns = size + len(turn), turns + 1
        if key:
            yield row()

    dealt = paths.select("tree", "leaf", "depth", "role", "text").repartition(shuffle_parts(paths.sparkSession), "tree", "leaf")
    return dealt.sortWithinPartitions("tree", "leaf", "depth").mapInPandas(run, PARTS)


def digest(parts: DataFrame) -> DataFrame:
    """Counts and checksums of conversations, read back from formatted rows."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        names = [x.split()[0] for x in DIGEST.split(", ")]

        def row() -> tuple:
            n, turns, chars, loss, size = state
            return *key, n, turns.hexdigest(), chars, loss.hexdigest(), size

        for frame in frames:
            rows = []
            for tree, leaf, text, loss in zip(frame["tree"], frame["leaf"], frame["formatted"], frame["loss"], strict=True):
                if key != (tree, leaf):
                    if key:
                        rows.append(row())
                    key, state = (tree, leaf), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said, _, _ in turns_of(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                for x in loss:
                    said = unescaped(text[x["begin"] : x["end"]])
                    state[2] += len(said)
                    state[3].update(said.encode("utf-8", "surrogatepass"))
                state[4] += len(text)
            yield pd.DataFrame(rows, columns=names)
        if key:
            yield pd.DataFrame([row()], columns=names)

    dealt = parts.repartition(shuffle_parts(parts.sparkSession), "tree", "leaf")
    return dealt.sortWithinPartitions("tree", "leaf", "part").mapInPandas(run, DIGEST)


def linear(conversations: DataFrame) -> DataFrame:
    """Messages of tables (conv_id, turn, role, text): each row answers the one before.

    Rows of one turn are ordered by role and text, null first; repeated rows stay. The tree is the
    conv_id as text, ``null`` where it is null.
    """
    rows = only(conversations, ("conv_id", "long"), ("turn", "long"), ("role", "string"), ("text", "string"))
    rows = rows.withColumn("tree", F.coalesce(F.col("conv_id").cast("string"), F.lit("null")))
    place = F.row_number().over(Window.partitionBy("tree").orderBy(F.asc_nulls_first("turn"), F.asc_nulls_first("role"), F.asc_nulls_first("text")))
    rows = rows.withColumn("msg", place.cast("long"))
    parent = F.when(F.col("msg") > 1, F.col("msg") - 1)
    return rows.select("tree", "msg", parent.alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def formatted_conversations(conversations: DataFrame) -> DataFrame:
    """Each conversation as formatted rows. An empty table gives none; other columns are ignored."""
    return format_paths(_best(written(linear(conversations), "messages"), 1))
