"""Scorecards, check results and review states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Statuses that block a pass.
BLOCKING = ["FAIL", "ERROR"]


def check_status(checked: Column, findings: Column) -> Column:
    """FAIL with findings, NOT_CHECKED without objects (an empty check never passes), else PASS."""
    return F.when(findings > 0, "FAIL").when(checked == 0, "NOT_CHECKED").otherwise("PASS")


def verdict(checks: DataFrame, group: list[str]) -> DataFrame:
    """Per group: number of checks, blocking ones, and whether it passes."""
    blocking = F.col("status").isin(BLOCKING)
    return checks.groupBy(*group).agg(F.count("*").alias("checks"), F.count_if(blocking).alias("blocking"), (~F.bool_or(blocking)).alias("passed"))


def difference(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Added, removed and changed rows of two scorecards: key, change, field, before, after (values as text)."""
    cells = lambda df, name: df.select(key, F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias(name)) for f in fields))).alias("_c")).select(key, "_c.*")
    joined = cells(before, "before").withColumn("_b", F.lit(1)).join(cells(after, "after").withColumn("_a", F.lit(1)), [key, "field"], "full_outer")
    change = F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "removed").when(~F.col("before").eqNullSafe(F.col("after")), "changed")
    return joined.withColumn("change", change).filter("change is not null").select(key, "field", "change", "before", "after")


def review_state(reports: Column, wanted_reports: int, sessions: Column, wanted_sessions: int, findings: Column) -> Column:
    """INCOMPLETE until all reports of different sessions are there, then REPAIR_REQUIRED with findings, else REVIEWED."""
    return F.when((reports < wanted_reports) | (sessions < wanted_sessions), "INCOMPLETE").when(findings > 0, "REPAIR_REQUIRED").otherwise("REVIEWED")

