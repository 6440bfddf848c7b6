"""Claims against evidence: citation resolution, dispositions and audit status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Evidence levels that support a claim on their own; fixed values.
QUALIFYING = ["E0", "E1", "E2", "E3", "E4", "E5"]
PROVISIONAL = "E6"


def resolve(citations: DataFrame, evidence: DataFrame) -> DataFrame:
    """Citations (claim, ref) with ``resolved``, the evidence's ``level`` and a reason code where it has none.

    An id that stands for evidence of different levels is a conflict and resolves nothing, whichever order it comes in.
    """
    known = evidence.groupBy(F.col("id").alias("ref")).agg(F.min("level").alias("level"), (F.count_distinct("level") > 1).alias("_conflict"))
    joined = citations.join(known, "ref", "left").withColumn("level", F.when(~F.col("_conflict"), F.col("level")))
    reason = F.when(F.col("_conflict"), "EVIDENCE_CONFLICT").when(F.col("level").isNull(), "EVIDENCE_NOT_FOUND")
    return joined.withColumn("resolved", F.col("level").isNotNull()).withColumn("reason", reason).drop("_conflict")


def dispositions(resolved: DataFrame, strict: bool = True, claims: DataFrame | None = None) -> DataFrame:
    """One row a claim: SUPPORTED, INFERENCE or UNVERIFIED.

    Strict: anything unresolved makes a claim UNVERIFIED, any provisional evidence an INFERENCE even beside qualifying
    one. Not strict: qualifying evidence supports whatever else is cited. ``claims`` (claim) adds those without a
    citation, which are UNVERIFIED.
    """
    own = resolved.groupBy("claim").agg(F.count("*").alias("refs"), F.bool_and("resolved").alias("all_resolved"), F.bool_or(F.coalesce(F.col("level").isin(QUALIFYING), F.lit(False))).alias("qualified"), F.bool_or(F.coalesce(F.col("level") == PROVISIONAL, F.lit(False))).alias("provisional"))
    if claims is not None:
        own = claims.select("claim").distinct().join(own, "claim", "left").select("claim", F.coalesce("refs", F.lit(0)).alias("refs"), F.coalesce("all_resolved", F.lit(True)).alias("all_resolved"), *(F.coalesce(c, F.lit(False)).alias(c) for c in ("qualified", "provisional")))
    tail = F.when(F.col("qualified"), "SUPPORTED").when(F.col("provisional"), "INFERENCE").otherwise("UNVERIFIED")
    strict_tail = F.when(F.col("provisional"), "INFERENCE").when(F.col("qualified"), "SUPPORTED").otherwise("UNVERIFIED")
    return own.withColumn("disposition", F.when(~F.col("all_resolved"), "UNVERIFIED").otherwise(strict_tail if strict else tail))


def uncited_provisional(cited: DataFrame, items: DataFrame, citations: DataFrame) -> DataFrame:
    """Claims that cite a provisional item without all the evidence behind it: (claim, item, missing).

    ``cited`` (claim, item), ``items`` (item, ref: a row for each evidence behind a provisional item, ref null for one
    without any, which always counts as missing), ``citations`` (claim, ref).
    """
    wanted = cited.select("claim", "item").distinct().join(items.select("item", "ref").distinct(), "item")
    lacking = wanted.join(citations.select("claim", "ref").distinct(), ["claim", "ref"], "left_anti")
    return lacking.groupBy("claim", "item").agg(F.count("*").alias("missing"))


def linkage_findings(nodes: DataFrame, linked: DataFrame, cited: DataFrame, evidence: DataFrame) -> DataFrame:
    """(node, code) where provisional evidence and the status of a node do not go together.

    ``nodes`` (node, scope, status), ``linked`` (node, ref: evidence of the graph items that the node refers to), ``cited``
    (node, ref). E6_LINK_INVALID: the provisional evidence linked and cited are different sets, or the status is not the
    one that follows. REFERENCE_MISSING: a general node with references or another status, or a project node without any.
    """
    soft = evidence.filter(F.col("level") == PROVISIONAL).select(F.col("id").alias("ref")).distinct()
    sides = linked.select("node", "ref", F.lit(1).alias("side")).union(cited.select("node", "ref", F.lit(2))).distinct()
    both = sides.join(soft, "ref").groupBy("node", "ref").agg(F.sum("side").alias("sides"))
    seen = both.groupBy("node").agg(F.bool_and(F.col("sides") == 3).alias("_same"), F.bool_or(F.col("sides") >= 2).alias("_cited"))
    refs = sides.groupBy("node").agg(F.count("*").alias("_refs"))
    own = nodes.join(seen, "node", "left").join(refs, "node", "left")
    any_ref, general = F.col("_refs").isNotNull(), F.col("scope") == "GENERAL_LEARNING"
    expected = F.when(F.coalesce("_cited", F.lit(False)), "E6_PROVISIONAL").otherwise("UNVERIFIED_TEACHING")
    code = (
        F.when(general, F.when(any_ref | (F.col("status") != "UNVERIFIED_TEACHING"), "REFERENCE_MISSING"))
        .when((F.col("scope") != "PROJECT_SPECIFIC") | ~any_ref, "REFERENCE_MISSING")
        .when(~F.coalesce("_same", F.lit(True)) | (F.col("status") != expected), "E6_LINK_INVALID")
    )
    return own.select("node", code.alias("code")).filter("code IS NOT NULL")


def overlap_verdicts(claims: DataFrame, units: DataFrame, claim: str, unit: str, refs: str) -> DataFrame:
    """Per claim: the one unit that shares a reference with it, or NONE, or AMBIGUOUS where there are several.

    Counted by reference first, so that a claim meets each reference's smallest and largest unit, not all its units;
    a claim is ambiguous exactly if these differ.
    """
    a = claims.select(claim, F.explode(F.array_distinct(refs)).alias("_ref"))
    b = units.select(unit, F.explode(F.array_distinct(refs)).alias("_ref")).groupBy("_ref").agg(F.min(unit).alias("_least"), F.max(unit).alias("_most"))
    own = a.join(b, "_ref").groupBy(claim).agg(F.min("_least").alias(unit), F.max("_most").alias("_most"))
    verdict = F.when(F.col(unit).isNull(), "NONE").when(F.col(unit) == F.col("_most"), "MATCHED").otherwise("AMBIGUOUS")
    return claims.select(claim).distinct().join(own, claim, "left").select(claim, F.when(verdict == "MATCHED", F.col(unit)).alias(unit), verdict.alias("verdict"))


def status(claims: DataFrame, critical: Column) -> DataFrame:
    """One row: FAIL if a claim is unresolved or a critical one unsupported, PARTIAL if another is, else PASS."""
    fails = F.bool_or(~F.col("all_resolved") | (critical & (F.col("disposition") != "SUPPORTED")))
    partly = F.bool_or(F.col("disposition") != "SUPPORTED")
    return claims.agg(F.count("*").alias("claims"), F.count_if(F.col("disposition") == "SUPPORTED").alias("supported"), F.when(fails, "FAIL").when(partly, "PARTIAL").otherwise("PASS").alias("status"))


def overlaps(left: DataFrame, right: DataFrame, left_key: str, right_key: str, refs: str) -> DataFrame:
    """Pairs of keys whose reference arrays share an element, with the number shared: an equi-join on exploded elements.

    References that only one side has never meet, and equal elements of one row count once.
    """
    a = left.select(left_key, F.explode(F.array_distinct(refs)).alias("_ref"))
    b = right.select(right_key, F.explode(F.array_distinct(refs)).alias("_ref"))
    return a.join(b, "_ref").groupBy(left_key, right_key).agg(F.count("*").alias("shared"))


def overlaps_by_reference(left: DataFrame, right: DataFrame, left_key: str, right_key: str, refs: str) -> DataFrame:
    """Per reference that both sides have: how many keys of each side have it, and the number of pairs that share it.

    Both sides are counted before they meet, so no pair is made; the pairs of all references add up to the ``shared``
    of ``overlaps``. Null keys and references and repeats do not count.
    """
    a = left.select(left_key, F.explode(refs).alias("ref")).groupBy("ref").agg(F.count_distinct(left_key).alias("left_keys")).filter("left_keys > 0")
    b = right.select(right_key, F.explode(refs).alias("ref")).groupBy("ref").agg(F.count_distinct(right_key).alias("right_keys")).filter("right_keys > 0")
    return a.join(b, "ref").withColumn("pairs", F.col("left_keys") * F.col("right_keys"))
