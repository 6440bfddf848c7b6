"""Runs of units that advance step by step over an append-only log, and recover from a stop between writing and recording.

A step of all runs is three things in this order: choose one action a run, write what the actions make, record the new
states with digests of what was written. Each is a table of its own below one folder, written only if it is not there. So
whoever dies in between leaves either nothing, or output that no revision records; ``resume`` makes that output again,
compares, and records it or tells which units need a decision.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.operators import workflow
from fathomline.sources.artifacts import append_revision

#: Makes (run, unit, state, then any columns of its own) of (run, unit, action): the same rows each time it is asked.
Work = Callable[[DataFrame], DataFrame]
STATES = ["run", "unit", "position", "route", "state", "has_candidate", "has_reports", "digest"]
RECONCILE = "ATTEMPT_RECONCILIATION_REQUIRED"


@dataclass(frozen=True)
class Journal:
    """The log and the outputs of runs below ``folder``, which driver and executors share."""

    spark: SparkSession
    folder: str

    def _path(self, name: str):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def has(self, name: str) -> bool:
        fs, path = self._path(name)
        return fs.exists(path)

    def output(self, revision: int) -> str:
        return f"outputs/step={revision:06d}"

    def revision(self) -> int:
        """The number of the last whole revision; -1 before the first. Revisions have no gaps."""
        number = -1
        while self.has(f"log/state_revision={number + 1:06d}/_SUCCESS"):
            number += 1
        return number

    def states(self, revision: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/log/state_revision={revision:06d}")

    def record(self, states: DataFrame, revision: int) -> None:
        append_revision(states.select(*STATES), f"{self.folder}/log", revision)


def start(journal: Journal, units: DataFrame) -> None:
    """Revision 0: ``units`` (run, unit, position, route, state, has_candidate, has_reports); an error where a log is already."""
    journal.record(units.withColumn("digest", F.lit(None).cast("string")), 0)


def digests(rows: DataFrame) -> DataFrame:
    """(run, unit, digest): the number of a unit's rows and two sums over their hashes, whatever their order."""
    columns = [F.col(c) for c in sorted(rows.columns)]
    one, two = F.xxhash64(F.lit(1), *columns).cast("decimal(38,0)"), F.xxhash64(F.lit(2), *columns).cast("decimal(38,0)")
    return rows.groupBy("run", "unit").agg(F.concat_ws(":", F.count("*"), F.sum(one), F.sum(two)).alias("digest"))


def _actions(journal: Journal, needs: DataFrame, revision: int) -> DataFrame:
    """(run, unit, action, waiting), one row a run that is not at its end."""
    return workflow.next_actions(journal.states(revision), needs)


def _recorded(states: DataFrame, acts: DataFrame, made: DataFrame) -> DataFrame:
    """The states after a step: a unit's new state and digest where it acted."""
    new = made.groupBy("run", "unit").agg(F.first("state").alias("_state")).join(digests(made), ["run", "unit"]).withColumnRenamed("digest", "_digest")
    blocked = acts.filter("action = 'BLOCK_PREREQUISITE'").select("run", "unit", F.lit("BLOCKED_PREREQUISITE").alias("_blocked"))
    joined = states.join(new, ["run", "unit"], "left").join(blocked, ["run", "unit"], "left")
    return joined.withColumn("state", F.coalesce("_blocked", "_state", "state")).withColumn("digest", F.coalesce("_digest", "digest"))


def _makes(acts: DataFrame) -> DataFrame:
    return acts.filter("action IS NOT NULL AND action <> 'BLOCK_PREREQUISITE'").select("run", "unit", "action")


def advance(journal: Journal, needs: DataFrame, work: Work, most: int = 1) -> tuple[int, str]:
    """Up to ``most`` steps; (last revision, why it ended): LIMIT, DONE (nothing is left to do), WAITING, or what ``resume`` is for.

    ``needs`` (unit, need). Every run takes one action a step, chosen by ``workflow.next_actions``.
    """
    revision = journal.revision()
    for _ in range(most):
        if journal.has(journal.output(revision + 1)) or journal.has(f"log/state_revision={revision + 1:06d}"):
            return revision, RECONCILE
        acts = _actions(journal, needs, revision)
        if acts.filter("action IS NOT NULL").isEmpty():
            return revision, "DONE" if acts.isEmpty() else "WAITING"
        work(_makes(acts)).write.mode("errorifexists").parquet(f"{journal.folder}/{journal.output(revision + 1)}")
        made = journal.spark.read.parquet(f"{journal.folder}/{journal.output(revision + 1)}")
        journal.record(_recorded(journal.states(revision), acts, made), revision + 1)
        revision += 1
    return revision, "LIMIT"


def resume(journal: Journal, needs: DataFrame, work: Work) -> tuple[int, DataFrame]:
    """(last revision, findings (run, unit, code)); with findings nothing is recorded.

    Recorded outputs are read again, and a unit whose digest is another one by now is OUTPUT_CHANGED. Output of a next step
    that no revision records is adopted if the work, done again, gives the same rows for the same units; else every unit
    that differs is ATTEMPT_RECONCILIATION_REQUIRED, and so are all that act where the output was not written to its end.
    """
    revision = journal.revision()
    states = journal.states(revision)
    none = states.select("run", "unit", F.lit("").alias("code")).limit(0)
    if revision > 0 and journal.has("outputs"):
        whole = journal.spark.read.option("mergeSchema", "true").parquet(*(f"{journal.folder}/{journal.output(n)}" for n in range(1, revision + 1)))
        steps = whole.withColumn("_step", F.regexp_extract(F.col("_metadata.file_path"), r"step=(\d+)", 1))
        last = steps.groupBy("run", "unit").agg(F.max("_step").alias("_step"))
        now = digests(steps.join(last, ["run", "unit", "_step"]).drop("_step"))
        changed = states.filter("digest IS NOT NULL").select("run", "unit", F.col("digest").alias("_was")).join(now, ["run", "unit"], "left").filter(~F.col("_was").eqNullSafe(F.col("digest")))
        found = changed.select("run", "unit", F.lit("OUTPUT_CHANGED").alias("code"))
        if not found.isEmpty():
            return revision, found
    name = journal.output(revision + 1)
    if not journal.has(name):
        return revision, none
    acts = _actions(journal, needs, revision)
    if not journal.has(f"{name}/_SUCCESS") or journal.has(f"log/state_revision={revision + 1:06d}"):
        return revision, _makes(acts).select("run", "unit", F.lit(RECONCILE).alias("code"))
    made = journal.spark.read.parquet(f"{journal.folder}/{name}")
    again = digests(work(_makes(acts))).withColumnRenamed("digest", "_again")
    differs = digests(made).join(again, ["run", "unit"], "full_outer").filter(~F.col("digest").eqNullSafe(F.col("_again")))
    found = differs.select("run", "unit", F.lit(RECONCILE).alias("code"))
    if not found.isEmpty():
        return revision, found
    journal.record(_recorded(states, acts, made), revision + 1)
    return revision + 1, none


def stale(recorded: DataFrame, now: DataFrame) -> DataFrame:
    """(name, code) of a run's inputs (name, sha256) that are not what they were: INPUT_CHANGED, INPUT_MISSING or INPUT_NEW."""
    both = recorded.select("name", F.col("sha256").alias("_was"), F.lit(True).alias("_r")).join(now.select("name", "sha256", F.lit(True).alias("_n")), "name", "full_outer")
    code = F.when(F.col("_n").isNull(), "INPUT_MISSING").when(F.col("_r").isNull(), "INPUT_NEW").when(~F.col("_was").eqNullSafe(F.col("sha256")), "INPUT_CHANGED")
    return both.select("name", code.alias("code")).filter("code IS NOT NULL")
