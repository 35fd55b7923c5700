"""Which identifiers of a dataset can be searched in which corpus, and under which keys.

Tables: ``pairs`` (model, stage, dataset) says what is asked; ``corpora`` has one row for each (model, stage) with
the arrays keys_available, requires_keys, accession_types (null: no restriction; empty: nothing is usable),
unconfirmed, unsearched, unresolved; ``identifiers`` is (dataset, type, value, confirmed, basis) with confirmed in
true, false, provisional; ``absent`` is (dataset, key).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provena.functions import identifiers as ids

CORPUS = ["model", "stage"]
ASKED = [*CORPUS, "dataset"]


def exact(keys: Column) -> Column:
    return F.array_intersect(keys, F.array(*map(F.lit, ids.EXACT_KEYS)))


def filled(keys: Column) -> Column:
    """A null array as an empty one: null would poison set operations."""
    return F.coalesce(keys, F.array().cast("array<string>"))


def searchable(identifiers: DataFrame) -> DataFrame:
    """Confirmed and provisional identifiers of a matchable type, with their key and canonical value."""
    rows = identifiers.withColumn("key", ids.identifier_key(F.col("type"))).where("key is not null and confirmed in ('true', 'provisional')")
    return rows.withColumn("value", ids.canonical(F.col("key"), F.col("value")))


def usable(pairs: DataFrame, corpora: DataFrame, identifiers: DataFrame) -> DataFrame:
    """(model, stage, dataset, key, type, value, confirmed, basis) that may be tried in each corpus."""
    limits = corpora.select(*CORPUS, "accession_types")
    rows = pairs.select(*ASKED).join(limits, CORPUS).join(searchable(identifiers), "dataset")
    fits = (F.col("key") != "accession") | F.col("accession_types").isNull() | F.array_contains("accession_types", F.col("type"))
    return rows.where(fits).drop("accession_types")


def attempted(pairs: DataFrame, corpora: DataFrame, targets: DataFrame, absent: DataFrame) -> DataFrame:
    """(model, stage, dataset, keys_attempted, keys_absent), sorted, for every pair asked.

    Attempted: the keys of usable identifiers that the corpus can be searched on. Absent: keys recorded as not
    existing for the dataset, that the corpus has and that aren't attempted.
    """
    have = targets.groupBy(*ASKED).agg(F.collect_set("key").alias("have"))
    none = absent.where(F.col("key").isin(ids.EXACT_KEYS)).groupBy("dataset").agg(F.collect_set("key").alias("none"))
    rows = pairs.select(*ASKED).join(corpora.select(*CORPUS, "keys_available"), CORPUS).join(have, ASKED, "left").join(none, "dataset", "left")
    open_ = exact(filled(F.col("keys_available")))
    rows = rows.withColumn("keys_attempted", F.sort_array(F.array_intersect(filled(F.col("have")), open_)))
    rows = rows.withColumn("keys_absent", F.sort_array(F.array_except(F.array_intersect(filled(F.col("none")), open_), F.col("keys_attempted"))))
    return rows.select(*ASKED, "keys_attempted", "keys_absent")


def provisional(targets: DataFrame) -> DataFrame:
    """(model, stage, dataset, provisional_keys, basis): keys all of whose usable identifiers are provisional.

    The basis joins the distinct bases of all such keys, in order of key and identifier.
    """
    order = F.col("ord") if "ord" in targets.columns else F.lit(0)
    per_key = targets.groupBy(*ASKED, "key").agg(
        F.bool_and(F.col("confirmed") == "provisional").alias("only"),
        F.sort_array(F.collect_list(F.when(F.coalesce("basis", F.lit("")) != "", F.struct(order.alias("o"), "basis")))).alias("bases"),
    )
    rows = per_key.where("only").groupBy(*ASKED).agg(F.sort_array(F.collect_list(F.struct("key", F.col("bases.basis").alias("b")))).alias("k"))
    basis = F.array_join(F.array_distinct(F.flatten(F.col("k.b"))), " ")
    return rows.select(*ASKED, F.col("k.key").alias("provisional_keys"), F.when(basis != "", basis).alias("basis"))


def identified(attempts: DataFrame, targets: DataFrame) -> DataFrame:
    """Adds identity (provisional or null) and identity_basis to rows with keys_attempted."""
    rows = attempts.join(provisional(targets), ASKED, "left")
    rests = F.arrays_overlap(filled(F.col("provisional_keys")), F.col("keys_attempted"))
    return rows.withColumn("identity", F.when(rests, "provisional")).withColumn("identity_basis", F.when(rests, F.col("basis"))).drop("provisional_keys", "basis")


def tried(pairs: DataFrame, corpora: DataFrame, identifiers: DataFrame, absent: DataFrame) -> DataFrame:
    """What ``usable``, ``attempted`` and ``identified`` tell of each pair, in one row: the pairs with keys_attempted, keys_absent, identity, identity_basis and ``targets``, an array of (key, value) that are tried.

    A dataset's identifiers are few, so they come to each pair as an array, and nothing of a pair is shuffled but the pair.
    """
    order = F.col("ord") if "ord" in identifiers.columns else F.lit(0)
    each = searchable(identifiers).groupBy("dataset").agg(F.collect_list(F.struct("key", "type", "value", "confirmed", order.alias("o"), "basis")).alias("ids"))
    none = absent.where(F.col("key").isin(ids.EXACT_KEYS)).groupBy("dataset").agg(F.collect_set("key").alias("none"))
    per = each.join(none, "dataset", "full")
    rows = pairs.join(F.broadcast(corpora.select(*CORPUS, "keys_available", "accession_types")), CORPUS).join(per, "dataset", "left")
    fits = lambda x: (x["key"] != "accession") | F.col("accession_types").isNull() | F.array_contains("accession_types", x["type"])
    usable_ = F.coalesce(F.filter("ids", fits), F.array().cast(each.schema["ids"].dataType))
    rows = rows.withColumn("ids", usable_).withColumn("have", F.sort_array(F.array_distinct(F.col("ids.key"))))
    open_ = exact(filled(F.col("keys_available")))
    rows = rows.withColumn("keys_attempted", F.sort_array(F.array_intersect("have", open_)))
    rows = rows.withColumn("keys_absent", F.sort_array(F.array_except(F.array_intersect(filled(F.col("none")), open_), F.col("keys_attempted"))))
    only = F.filter("have", lambda k: F.forall("ids", lambda x: (x["key"] != k) | (x["confirmed"] == "provisional")))
    of = lambda k: F.sort_array(F.transform(F.filter("ids", lambda x: (x["key"] == k) & (F.coalesce(x["basis"], F.lit("")) != "")), lambda x: F.struct(x["o"], x["basis"].alias("basis"))))
    rows = rows.withColumn("only", only)
    rows = rows.withColumn("basis", F.array_join(F.array_distinct(F.flatten(F.transform("only", lambda k: F.transform(of(k), lambda x: x["basis"])))), " "))
    rests = F.arrays_overlap("only", "keys_attempted")
    targets = F.array_distinct(F.transform(F.filter("ids", lambda x: F.array_contains("keys_attempted", x["key"]) & x["value"].isNotNull()), lambda x: F.struct(x["key"].alias("key"), x["value"].alias("value"))))
    rows = rows.withColumn("identity", F.when(rests, "provisional")).withColumn("identity_basis", F.when(rests & (F.col("basis") != ""), F.col("basis"))).withColumn("targets", targets)
    return rows.select(*pairs.columns, "keys_attempted", "keys_absent", "identity", "identity_basis", "targets")


def related(rows: DataFrame, evaluated_on: DataFrame) -> DataFrame:
    """Adds relation: reported-eval where the model's paper evaluates on the dataset, else catalog."""
    own = evaluated_on.select("model", "dataset").distinct().withColumn("own", F.lit(True))
    return rows.join(own, ["model", "dataset"], "left").withColumn("relation", F.when(F.col("own"), "reported-eval").otherwise("catalog")).drop("own")
