"""Recorded findings against a fresh run, field by field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provena.operators.keys import ASKED, filled

#: Compared always, and only where either side says PRESENT.
ALWAYS, IF_PRESENT = ["verdict", "keys_attempted", "keys_absent", "identity", "by_design"], ["matched_on", "cells", "sample_ids"]
LISTS = {"keys_attempted", "keys_absent", "matched_on", "sample_ids"}


def _shown(side: str, name: str) -> Column:
    column = F.col(f"{side}.{name}")
    return F.array_join(F.sort_array(filled(column)), ",") if name in LISTS else column.cast("string")


def differences(recorded: DataFrame, fresh: DataFrame) -> DataFrame:
    """(model, stage, dataset, field, recorded, fresh) for each field that differs; null equals null.

    Lists are compared sorted and shown joined by commas. Findings that the run doesn't have are left out.
    """
    on = [F.col(f"r.{k}") == F.col(f"f.{k}") for k in ASKED]
    rows = recorded.alias("r").join(fresh.alias("f"), on)
    present = (F.col("r.verdict") == "PRESENT") | (F.col("f.verdict") == "PRESENT")
    each = [F.struct(F.lit(n).alias("field"), _shown("r", n).alias("recorded"), _shown("f", n).alias("fresh"), (F.lit(True) if n in ALWAYS else present).alias("counts")) for n in ALWAYS + IF_PRESENT]
    out = rows.select(*(F.col(f"r.{k}").alias(k) for k in ASKED), F.explode(F.array(*each)).alias("x")).select(*ASKED, "x.*")
    return out.where(F.col("counts") & ~F.col("recorded").eqNullSafe(F.col("fresh"))).drop("counts")
