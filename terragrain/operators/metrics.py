"""Counts of what passes through a job, without a further pass over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def observed(rows: DataFrame, valid: Column, name: str = "progress") -> tuple[DataFrame, Observation]:
    """``rows``, and an observation that has ``rows`` and ``valid`` once an action has run over them."""
    seen = Observation(name)
    return rows.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(F.coalesce(valid, F.lit(False))).alias("valid")), seen
