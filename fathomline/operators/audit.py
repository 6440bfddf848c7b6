"""A coverage audit in one plan: index, coverage, Git's own listing and the payloads meet once by path, every rule is a column."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.functions import paths

# Classifications that need a reason, modes of links and submodules with their kinds, problems of payloads.
NEED_REASON = ["IGNORED_WITH_REASON", "UNKNOWN"]
LINK_KINDS = {"120000": "symlink", "160000": "gitlink"}
UNSAFE, HONEST = "UNSAFE_PATH", "UNKNOWN_REMAINS"
# End of fixed values.


@dataclass(frozen=True)
class Declared:
    """What the two artifacts state about themselves, and the revision that Git has."""

    file_count: int
    tracked_file_count: int
    unknown_count: int
    index_revision: str
    coverage_revision: str
    revision: str


def _once(rows: DataFrame, name: str) -> DataFrame:
    """One row a path: the smallest of its rows as a struct, and how many there are."""
    columns = [c for c in rows.columns if c != "path"]
    return rows.groupBy("path").agg(F.min(F.struct(*columns)).alias(name), F.count("*").alias(f"{name}_n"))


def coverage_findings(index: DataFrame, coverage: DataFrame, truth: DataFrame, payload: DataFrame, declared: Declared, rule_ids: list[str], surfaces: list[str], complete: bool = False) -> DataFrame:
    """(code, path) of all that does not hold; the path is null for what concerns an artifact as a whole.

    ``index`` (path, object_id, byte_count, sha256, content_kind, tracked), ``coverage`` (path, classification, surface,
    secondary, rule_id, reason), ``truth`` (path, mode, object_id), ``payload`` (path, byte_count, sha256, problem). The
    payload of an unsafe path, or of a path whose object is another one, is not looked at; a wrong size hides a wrong
    digest. Unknown files are findings only where completeness is asked for. A null path is unsafe.
    """
    sides = {"i": index, "c": coverage, "t": truth, "p": payload}
    rows = None
    for name, side in sides.items():
        one = _once(side, name).withColumnRenamed("path", f"{name}_path")
        rows = one.withColumnRenamed(f"{name}_path", "path") if rows is None else rows.join(one, F.col("path").eqNullSafe(F.col(f"{name}_path")), "full_outer").withColumn("path", F.coalesce("path", f"{name}_path")).drop(f"{name}_path")
    has = {name: F.col(f"{name}_n").isNotNull() for name in sides}
    i, c, t, p = ((lambda column, name=name: F.col(f"{name}.{column}")) for name in sides)
    safe = F.coalesce(paths.normalized(F.col("path")) == F.col("path"), F.lit(False))
    listed = has["i"] | has["c"]
    kind = F.try_element_at(F.create_map(*(F.lit(x) for pair in LINK_KINDS.items() for x in pair)), t("mode"))
    special = i("content_kind").isin(*LINK_KINDS.values())
    same_object = i("object_id").isNull() | (i("object_id") == t("object_id"))
    looked = has["i"] & has["t"] & safe & same_object
    problem = F.coalesce(p("problem"), F.when(~has["p"], F.lit("MISSING")))
    secondary = F.coalesce(c("secondary"), F.array().cast("array<string>"))
    odd_surface = F.array_contains(secondary, c("surface")) | (F.array_sort(F.array_distinct(secondary)) != secondary) | (F.size(F.array_except(secondary, F.array(*map(F.lit, surfaces)))) > 0)
    size_differs = ~i("byte_count").eqNullSafe(p("byte_count"))
    tests: list[tuple[str, Column]] = [
        ("DUPLICATE_PATH", (F.col("i_n") > 1) | (F.col("c_n") > 1)), (UNSAFE, listed & ~safe), ("PATH_SET_MISMATCH", listed & (has["i"] != has["c"]) | has["i"] & ~has["t"] | has["t"] & ~has["i"]),
        ("CLASSIFICATION_POLICY_MISMATCH", has["c"] & c("rule_id").isNotNull() & ~c("rule_id").isin(rule_ids)), ("SURFACE_INVALID", has["c"] & odd_surface),
        ("REASON_MISSING", c("classification").isin(NEED_REASON) & (F.coalesce(c("reason"), F.lit("")) == "")), ("TRACKED_FLAG_INVALID", has["i"] & ~F.coalesce(i("tracked"), F.lit(False))),
        (HONEST, F.lit(complete) & (c("classification") == "UNKNOWN")), ("VCS_OBJECT_MISMATCH", has["i"] & has["t"] & ~same_object), ("CONTENT_KIND_MISMATCH", has["i"] & has["t"] & F.when(kind.isNotNull(), ~kind.eqNullSafe(i("content_kind"))).otherwise(special)),
        ("SNAPSHOT_PATH_UNSAFE", looked & (problem == UNSAFE)), ("SNAPSHOT_FILE_MISSING", looked & problem.isNotNull() & (problem != UNSAFE)),
        ("SNAPSHOT_SIZE_MISMATCH", looked & problem.isNull() & size_differs), ("SNAPSHOT_HASH_MISMATCH", looked & problem.isNull() & ~size_differs & ~i("sha256").eqNullSafe(p("sha256"))),
    ]
    codes = F.filter(F.array(*(F.when(F.coalesce(test, F.lit(False)), code) for code, test in tests)), lambda x: x.isNotNull())
    each = rows.select("path", F.explode(codes).alias("code")).select("code", "path")
    whole = index.agg(F.count("*").alias("files")).crossJoin(coverage.agg(F.count("*").alias("entries"), F.count_if(F.col("classification") == "UNKNOWN").alias("unknown")))  # one row each
    stated = [("COUNT_MISMATCH", (F.col("files") != declared.file_count) | (F.col("entries") != declared.tracked_file_count)), ("UNKNOWN_COUNT_MISMATCH", F.col("unknown") != declared.unknown_count), ("REVISION_MISMATCH", F.lit(declared.index_revision != declared.coverage_revision or declared.index_revision != declared.revision))]
    overall = whole.select(F.explode(F.filter(F.array(*(F.when(test, code) for code, test in stated)), lambda x: x.isNotNull())).alias("code"), F.lit(None).cast("string").alias("path"))
    return each.unionByName(overall)


def coverage_status(findings: DataFrame, coverage: DataFrame) -> DataFrame:
    """One row: status (FAIL with findings, PARTIAL with unknown files, else PASS), violations, unknown_files, coverage_entries."""
    counts = coverage.agg(F.count("*").alias("coverage_entries"), F.count_if(F.col("classification") == "UNKNOWN").alias("unknown_files"))
    rows = findings.agg(F.count("*").alias("violations")).crossJoin(counts)
    return rows.select(F.when(F.col("violations") > 0, "FAIL").when(F.col("unknown_files") > 0, "PARTIAL").otherwise("PASS").alias("status"), "violations", "unknown_files", "coverage_entries")
