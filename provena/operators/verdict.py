"""The decision table: one ordered condition per code; the first that holds decides.

Verdicts say whether a dataset is in a training list. They state exposure, not effect, and are never summed up into a
score of a model.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provena.functions import wording
from provena.operators.keys import exact, filled

# Codes in the order in which they are tried, and their verdicts.
VERDICTS = {
    "by_design_stage": "INCONCLUSIVE",
    "no_manifest": "NOT CHECKABLE",
    "unconfirmed_source": "INCONCLUSIVE",
    "superset": "INCONCLUSIVE",
    "same_publication": "INCONCLUSIVE",
    "present": "PRESENT",
    "weak_only": "INCONCLUSIVE",
    "unsearched": "INCONCLUSIVE",
    "no_exact_key": "INCONCLUSIVE",
    "missing_required_key": "INCONCLUSIVE",
    "unresolved_entries": "INCONCLUSIVE",
    "not_present": "NOT PRESENT",
}
ARRAYS = ["keys_attempted", "keys_hit", "keys_hit_confirmed", "listed_accessions", "requires_keys", "keys_absent", "unconfirmed", "unsearched", "unresolved"]


def _some(keys: Column) -> Column:
    return F.size(keys) > 0


def decided(rows: DataFrame) -> DataFrame:
    """Adds verdict, code and reason.

    Rows have type (of manifest), checkable, can_prove_presence, and the arrays of ``ARRAYS``; null arrays are
    empty. With unconfirmed sources only hits in confirmed ones count, for all later conditions.
    """
    for name in ARRAYS:
        rows = rows.withColumn(name, filled(F.col(name)) if name in rows.columns else F.array().cast("array<string>"))
    doubt = _some(F.col("unconfirmed"))
    sure = F.array_intersect("keys_hit_confirmed", "keys_hit")
    hit = F.when(doubt, sure).otherwise(F.col("keys_hit"))
    needs = F.array_except(F.array_except("requires_keys", "keys_attempted"), "keys_absent")
    rows = rows.withColumn("hit_", hit).withColumn("needs_", F.sort_array(needs))
    found, named = _some(exact(F.col("hit_"))), F.array_contains("hit_", "accession")
    tests = {
        "by_design_stage": F.col("type") == "by-design",
        "no_manifest": F.col("type").isin("C-vague", "D") | ~F.coalesce("checkable", F.lit(True)),
        "unconfirmed_source": doubt & ~found,
        "superset": found & ~F.col("can_prove_presence"),
        "same_publication": found & ~named,
        "present": found,
        "weak_only": _some(F.col("hit_")),
        "unsearched": _some(F.col("unsearched")),
        "no_exact_key": ~_some(exact(F.col("keys_attempted"))),
        "missing_required_key": _some(F.col("needs_")),
        "unresolved_entries": _some(F.col("unresolved")),
    }
    code = None
    for name, test in tests.items():
        code = F.when(test, name) if code is None else code.when(test, name)
    rows = rows.withColumn("code", code.otherwise("not_present"))
    verdict = F.element_at(F.create_map(*(F.lit(x) for pair in VERDICTS.items() for x in pair)), F.col("code"))
    return rows.withColumn("verdict", verdict).withColumn("reason", _reason()).drop("hit_", "needs_")


def _reason() -> Column:
    """The wording that recorded findings carry. Present and absent findings have none."""
    lit, shown = F.lit, wording.shown_list
    exact_hit = F.sort_array(exact(F.col("hit_")))
    upper = lambda keys: F.array_join(F.transform(keys, F.upper), "/")
    listed = F.when(_some(F.col("listed_accessions")), F.concat(lit("the manifest lists "), F.array_join(F.sort_array("listed_accessions"), ", "))).otherwise("the manifest row names no accession")
    n = F.size("unresolved")
    texts = {
        "by_design_stage": lit("this stage trains on parts of the model's own evaluation datasets, by design; it has no list to search for other datasets"),
        "no_manifest": lit("no manifest was published to search"),
        "unconfirmed_source": F.concat(
            lit("the manifest "), F.when(_some(F.col("keys_hit")), "matched (only in an unconfirmed file)").otherwise("did not match"), lit(", but source(s) "), shown(F.col("unconfirmed")),
            lit(" are not confirmed as the paper's file (supplied, no url_hash / totals / author confirmation)"),
        ),
        "superset": F.concat(
            lit("found in the pointed-to corpus, which the model trained on a subset of — a superset cannot prove presence."),
            F.when(F.array_contains("hit_", "accession"), "").otherwise(" The match is also on the paper, not the dataset."),
        ),
        "same_publication": F.concat(lit("same publication, matched on "), upper(exact_hit), lit(" only — "), listed, lit("; confirm it is the same dataset")),
        "weak_only": F.concat(lit("matched on "), shown(F.sort_array("hit_")), lit(" only — not an exact identifier")),
        "unsearched": F.concat(lit("no match, but manifest source(s) "), shown(F.col("unsearched")), lit(" were not searched")),
        "no_exact_key": lit("no exact key could be attempted: the dataset has no confirmed identifier of a kind this manifest carries"),
        "missing_required_key": F.concat(
            lit("no match on "), shown(F.sort_array("keys_attempted")), lit(", but this manifest needs "), shown(F.sort_array("requires_keys")),
            lit(" attempted before absence can be claimed; the dataset has no confirmed "), F.array_join("needs_", "/"), lit(" identifier, and none is recorded as not existing"),
        ),
        "unresolved_entries": F.concat(
            lit("no match, but "), n.cast("string"), F.when(n == 1, " entry").otherwise(" entries"), lit(" of this list cannot be searched exactly ("), wording.examples(F.col("unresolved")),
            lit(") — collections whose datasets are not listed, or sources named without an identifier; the dataset may be inside one"),
        ),
    }
    out = None
    for code, text in texts.items():
        out = F.when(F.col("code") == code, text) if out is None else out.when(F.col("code") == code, text)
    return out
