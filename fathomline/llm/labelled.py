"""Bounded training samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def remainder(doc_id, divisor: int):
    """crc32 of doc_id as text, modulo ``divisor``."""
    return F.crc32(doc_id.cast("string")) % divisor


def sample(docs: DataFrame, labels: DataFrame, column: str, keep, per_class: int, max_chars: int) -> tuple[list[tuple[str, int]], dict[int, int]]:
    """(text, label) pairs and the number of usable labels by class.

    ``keep(doc_id column)`` tells the rows that may be learnt from. Of each class the ``per_class`` labels with the
    smallest hash of doc_id are taken; texts over ``max_chars`` characters are left out of the sample, so it has a
    fixed bound. Null and other labels than 0 and 1 do not count.
    """
    usable = labels.filter(F.col(column).isin(0, 1) & keep(F.col("doc_id"))).groupBy("doc_id").agg(F.max(column).cast("int").alias("label"))
    counts = {r.label: r["count"] for r in usable.groupBy("label").count().collect()}
    order = F.xxhash64("doc_id")
    picked = usable.filter("label = 0").orderBy(order, "doc_id").limit(per_class).union(usable.filter("label = 1").orderBy(order, "doc_id").limit(per_class))
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").filter(F.length("text") <= max_chars)
    found = sorted((r.doc_id, r.text, r.label) for r in rows.select("doc_id", "text", "label").collect())
    return [(t, y) for _, t, y in found], {0: counts.get(0, 0), 1: counts.get(1, 0)}
