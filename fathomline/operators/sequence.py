"""Operators over ordered rows: as-of joins, pairing, transitions, chains and order checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _over(group: list[str], order: list[str]):
    return Window.partitionBy(*group).orderBy(*order)


def last_before(rows: DataFrame, group: list[str], order: list[str], value: Column, when: Column, reach: int | None = None) -> Column:
    """As-of backward: the latest ``value`` of an earlier row where ``when`` holds, at most ``reach`` rows back."""
    return F.last(F.when(when, value), ignorenulls=True).over(_over(group, order).rowsBetween(Window.unboundedPreceding if reach is None else -reach, -1))


def first_after(group: list[str], order: list[str], value: Column, when: Column) -> Column:
    """As-of forward: the earliest ``value`` of a later row where ``when`` holds."""
    return F.first(F.when(when, value), ignorenulls=True).over(_over(group, order).rowsBetween(1, Window.unboundedFollowing))


def pairs(rows: DataFrame, group: list[str], order: list[str], kind: str, begin: str, end: str, at: Column) -> DataFrame:
    """Each ``end`` with the ``begin`` that directly precedes it among begins and ends; ``open`` is false without one.

    Duration is never negative.
    """
    own = rows.filter(F.col(kind).isin(begin, end))
    w = _over(group, order)
    seen = own.withColumn("_kind", F.lag(kind).over(w)).withColumn("_at", F.lag(at).over(w)).filter(F.col(kind) == end)
    matched = F.coalesce(F.col("_kind") == begin, F.lit(False))
    return seen.withColumn("matched", matched).withColumn("duration", F.when(matched, F.greatest(F.lit(0), at - F.col("_at")))).drop("_kind", "_at")


def transitions(rows: DataFrame, group: list[str], order: list[str], state: str, allowed: dict[str, list[str]]) -> DataFrame:
    """Steps that the table of allowed ones lacks: the rows with ``before``. First rows of a group are free."""
    table = F.create_map(*(x for k, v in allowed.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    stepped = rows.withColumn("before", F.lag(state).over(_over(group, order))).filter(F.col("before").isNotNull())
    return stepped.filter(~F.coalesce(F.array_contains(table[F.col("before")], F.col(state)), F.lit(False)))


def chain(rows: DataFrame, group: list[str], order: str, parent: Column, own: Column) -> DataFrame:
    """Check an append-only log: revisions contiguous from 1, each linked to its predecessor's digest."""
    w = _over(group, [order])
    linked = rows.withColumn("_row", F.row_number().over(w)).withColumn("_link", F.lag(own).over(w))
    return linked.withColumn("contiguous", F.col(order) == F.col("_row")).withColumn("linked", parent.eqNullSafe(F.col("_link"))).drop("_row", "_link")


def duplicates(rows: DataFrame, group: list[str], key: str) -> DataFrame:
    """Neighbours in key order that are equal."""
    return rows.withColumn("_prev", F.lag(key).over(_over(group, [key]))).filter(F.col(key) == F.col("_prev")).drop("_prev")


def introduced_late(units: DataFrame, needs: DataFrame, unit: str, position: str, need: str) -> DataFrame:
    """Needs (unit, need) whose ``need`` is no unit or does not stand strictly before the unit."""
    at = units.select(F.col(unit).alias(need), F.col(position).alias("_need_at"))
    placed = needs.join(units.select(unit, F.col(position).alias("_at")), unit).join(at, need, "left")
    return placed.filter(F.col("_need_at").isNull() | (F.col("_need_at") >= F.col("_at"))).select(unit, need)
