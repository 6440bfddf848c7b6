"""Set reconciliation, reference audits, conflict-aware deduplication and folds. Findings are rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def differences(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that only one side has: the keys and ``side`` (left or right). Duplicates on a side count once."""
    a, b = left.select(*keys).distinct(), right.select(*keys).distinct()
    return a.join(b, keys, "left_anti").withColumn("side", F.lit("left")).unionByName(b.join(a, keys, "left_anti").withColumn("side", F.lit("right")))


def mismatches(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Full outer comparison: keys, ``status`` (missing_left, missing_right, changed, same) and the columns that differ."""
    a = left.select(*keys, F.struct(*columns).alias("_a"))
    b = right.select(*keys, F.struct(*columns).alias("_b"))
    joined = a.join(b, keys, "full_outer")
    changed = F.filter(F.array(*(F.when(~F.col(f"_a.{c}").eqNullSafe(F.col(f"_b.{c}")), F.lit(c)) for c in columns)), lambda x: x.isNotNull())
    status = F.when(F.col("_a").isNull(), "missing_left").when(F.col("_b").isNull(), "missing_right").when(F.size(changed) > 0, "changed").otherwise("same")
    return joined.select(*keys, status.alias("status"), F.when(status == "changed", changed).otherwise(F.array().cast("array<string>")).alias("changed"))


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str, code: str, row_key: Column) -> DataFrame:
    """Violation rows (code, key) for non-null references without a parent."""
    known = parent.select(F.col(parent_key).alias("_parent")).distinct()
    return child.filter(F.col(child_key).isNotNull()).join(known, F.col(child_key) == F.col("_parent"), "left_anti").select(F.lit(code).alias("code"), row_key.cast("string").alias("key"))


def audit(*findings: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, findings)


def conflicts(rows: DataFrame, key: str, payload: Column) -> DataFrame:
    """Merge rows of one key: ``copies``, ``payloads`` (different ones) and ``conflict`` (more than one)."""
    grouped = rows.select(F.col(key), F.sha2(payload.cast("string"), 256).alias("_p")).groupBy(key)
    return grouped.agg(F.count("*").alias("copies"), F.count_distinct("_p").alias("payloads")).withColumn("conflict", F.col("payloads") > 1)


def fold(rows: DataFrame, key: Column, member: Column) -> DataFrame:
    """One row a key with its sorted different members."""
    return rows.groupBy(key.alias("key")).agg(F.array_sort(F.collect_set(member)).alias("members"), F.count("*").alias("copies"))


def is_sorted_unique(values: Column) -> Column:
    return F.array_sort(F.array_distinct(values)) == values


def severity(code_set: Column, failing: list[str]) -> Column:
    """PASS without codes, FAIL with a failing one, else PARTIAL (honest unknowns remain)."""
    return F.when(F.size(code_set) == 0, "PASS").when(F.arrays_overlap(code_set, F.array(*map(F.lit, failing))), "FAIL").otherwise("PARTIAL")
