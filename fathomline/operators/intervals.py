"""Inclusive integer ranges and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merged(ranges: DataFrame, group: list[str], low: str, high: str) -> DataFrame:
    """Ranges of a group merged where they overlap or are adjacent: group, low, high, parts, total (sum of lengths)."""
    ahead = Window.partitionBy(*group).orderBy(low, high).rowsBetween(Window.unboundedPreceding, -1)
    so_far = Window.partitionBy(*group).orderBy(low, high).rowsBetween(Window.unboundedPreceding, 0)
    opens = ranges.withColumn("_top", F.max(high).over(ahead)).withColumn("_new", (F.col("_top").isNull() | (F.col(low) > F.col("_top") + 1)).cast("int"))
    return opens.withColumn("_island", F.sum("_new").over(so_far)).groupBy(*group, "_island").agg(F.min(low).alias(low), F.max(high).alias(high), F.count("*").alias("parts"), F.sum(F.col(high) - F.col(low) + 1).alias("total")).drop("_island")


def coverage(ranges: DataFrame, group: list[str], low: str, high: str) -> DataFrame:
    """Per group: islands, covered length, duplicated length (sum of lengths beyond the merged ones) and the gaps between islands."""
    own = merged(ranges, group, low, high)
    return own.groupBy(*group).agg(
        F.count("*").alias("islands"), F.sum(F.col(high) - F.col(low) + 1).alias("covered"), (F.sum("total") - F.sum(F.col(high) - F.col(low) + 1)).alias("duplicated"),
        (F.max(high) - F.min(low) + 1 - F.sum(F.col(high) - F.col(low) + 1)).alias("missing"),
    )


def uncovered(points: DataFrame, ranges: DataFrame, group: list[str], low: str, high: str) -> DataFrame:
    """Rows of ``points`` (group, low, high) that no merged range of ``ranges`` holds whole.

    Both sides lie in one order; the last island that begins at or before a point is the only one that can hold it.
    """
    islands = merged(ranges, group, low, high).select(*group, low, high, F.lit(True).alias("_island"))
    both = islands.unionByName(points.select(*group, low, high, F.lit(False).alias("_island")))
    so_far = Window.partitionBy(*group).orderBy(F.col(low), F.desc("_island")).rowsBetween(Window.unboundedPreceding, 0)
    held = both.withColumn("_top", F.last(F.when(F.col("_island"), F.col(high)), ignorenulls=True).over(so_far))
    return held.filter(~F.col("_island") & F.coalesce(F.col(high) > F.col("_top"), F.lit(True))).select(*group, low, high)


def runs(rows: DataFrame, group: list[str], order: list[str], broken: Column) -> DataFrame:
    """Unbroken runs: group, ``run`` (number of the break before), ``length`` without the breaking rows."""
    window = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    marked = rows.withColumn("_broken", broken.cast("int")).withColumn("run", F.sum("_broken").over(window))
    return marked.groupBy(*group, "run").agg(F.sum(1 - F.col("_broken")).alias("length"))


def density(rows: DataFrame, group: list[str], order: list[str], noted: Column, limit: int = 8, share: int = 12, star: Column | None = None, floor: int = 5) -> DataFrame:
    """Annotation density: lines, notes, longest run without a note, runs of ``limit`` or more, notes needed, passed.

    Groups whose ``star`` holds (for any row) need ``floor`` notes at least, but never more than they have lines.
    """
    keyed = rows.withColumn("_noted", noted).withColumn("_star", F.lit(False) if star is None else F.coalesce(star, F.lit(False)))
    own = runs(keyed, group, order, F.col("_noted")).groupBy(*group).agg(F.max("length").alias("max_run"), F.count_if(F.col("length") >= limit).alias("bad_runs"))
    totals = keyed.groupBy(*group).agg(F.count("*").alias("key_lines"), F.count_if("_noted").alias("notes"), F.bool_or("_star").alias("_star"))
    plain = F.ceil(F.col("key_lines") / share)
    need = F.when(F.col("_star"), F.least("key_lines", F.greatest(F.lit(floor).cast("long"), plain))).otherwise(plain)
    return totals.join(own, group).withColumn("need", need).withColumn("passed", (F.col("max_run") < limit) & (F.col("notes") >= F.col("need"))).drop("_star")
