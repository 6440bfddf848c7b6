"""Unit workflows: routes, readiness, next actions, repair decisions and transitions of attempts, as tables and rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# States and the steps between them.
ALLOWED = {
    "BLOCKED_UPSTREAM": ["BLOCKED_UPSTREAM"],
    "PLANNED": ["PLANNED", "PREPARED", "BLOCKED_PREREQUISITE"],
    "PREPARED": ["PREPARED", "BUILT_DRAFT"],
    "BUILT_DRAFT": ["BUILT_DRAFT", "AWAITING_REVIEW"],
    "AWAITING_REVIEW": ["AWAITING_REVIEW", "REVIEWED_DRAFT", "BLOCKED_REVIEW", "REVIEW_INCOMPLETE_STOP"],
    "REVIEWED_DRAFT": ["REVIEWED_DRAFT"],
    "BLOCKED_PREREQUISITE": ["BLOCKED_PREREQUISITE"],
    "BLOCKED_REVIEW": ["BLOCKED_REVIEW", "REPAIR_READY", "UPSTREAM_REQUIRED", "STOP_UNSUPPORTED", "REVIEW_INCOMPLETE_STOP", "REPAIR_LIMIT_REACHED"],
    "REPAIR_READY": ["REPAIR_READY", "PREPARED"],
    "UPSTREAM_REQUIRED": ["UPSTREAM_REQUIRED"],
    "STOP_UNSUPPORTED": ["STOP_UNSUPPORTED"],
    "REVIEW_INCOMPLETE_STOP": ["REVIEW_INCOMPLETE_STOP"],
    "REPAIR_LIMIT_REACHED": ["REPAIR_LIMIT_REACHED"],
}
BLOCKED_STATES = ["BLOCKED_UPSTREAM", "BLOCKED_PREREQUISITE", "BLOCKED_REVIEW", "UPSTREAM_REQUIRED", "STOP_UNSUPPORTED", "REVIEW_INCOMPLETE_STOP", "REPAIR_LIMIT_REACHED"]
WAITING_STATES = ["PREPARED", "AWAITING_REVIEW", "REPAIR_READY"]
OPEN_ROUTES = ["PHASE6A_PROJECT_CLAIM", "D2A_GENERAL_LEARNING"]
DISPOSITIONS = {"": ["SAME_SNAPSHOT_REPAIR", "UPSTREAM_REQUIRED", "STOP_UNSUPPORTED", "REVIEW_INCOMPLETE", "REPAIR_LIMIT_REACHED"], "SAME_SNAPSHOT_REPAIR": ["UPSTREAM_REQUIRED", "STOP_UNSUPPORTED", "REVIEW_INCOMPLETE", "REPAIR_LIMIT_REACHED"]}
TEACHING_EDIT, UPSTREAM = "TEACHING_EDIT_POSSIBLE", "UPSTREAM_CLAIM_REQUIRED"
# End of fixed values.


def route(origin: Column, scope: Column, has_refs: Column, readiness: Column) -> Column:
    """Route of a unit from its origin, scope, references and readiness; null for combinations that do not exist."""
    general = (origin == "CANDIDATE") & (scope == "GENERAL_LEARNING") | (origin == "PREREQUISITE_PRIMER") & scope.isin("GENERAL_LEARNING", "PROJECT_SPECIFIC")
    project = (origin == "CANDIDATE") & (scope == "PROJECT_SPECIFIC")
    return (
        F.when(general & has_refs, "BLOCKED_UNSUPPORTED")
        .when(general, "D2A_GENERAL_LEARNING")
        .when(project & ~has_refs, "UPSTREAM_REQUIRED")
        .when(project & (readiness == "READY"), "PHASE6A_PROJECT_CLAIM")
        .when(project & (readiness == "NO_QUALIFYING_SUPPORTED_CLAIM"), "UPSTREAM_REQUIRED")
        .when(project & (readiness == "CLAIM_SCOPE_AMBIGUOUS"), "BLOCKED_UNSUPPORTED")
    )


def route_state(chosen: Column) -> Column:
    return F.when(chosen.isin(*OPEN_ROUTES), "PLANNED").otherwise("BLOCKED")


def readiness(units: DataFrame, needs: DataFrame) -> DataFrame:
    """(unit, ready, blocked): all prerequisites reviewed; any of them blocked. Units without prerequisites are ready."""
    states = units.select(F.col("unit").alias("need"), F.col("state").alias("_state"))
    seen = needs.join(states, "need").groupBy("unit").agg(F.bool_and(F.col("_state") == "REVIEWED_DRAFT").alias("ready"), F.bool_or(F.col("_state").isin(*BLOCKED_STATES)).alias("blocked"))
    return units.select("unit").join(seen, "unit", "left").select("unit", F.coalesce("ready", F.lit(True)).alias("ready"), F.coalesce("blocked", F.lit(False)).alias("blocked"))


def expected_action(state: Column, open_route: Column, has_candidate: Column, has_reports: Column) -> Column:
    """What a unit waits for or does next, by its state and the files that are there."""
    return (
        F.when(state.isin("PLANNED", "REPAIR_READY"), F.when(open_route, "PREPARE").otherwise("BLOCKED_UPSTREAM"))
        .when(state == "PREPARED", F.when(has_candidate, "BUILD").otherwise("WAITING_FOR_WRITER"))
        .when(state == "BUILT_DRAFT", "PREPARE_REVIEW")
        .when(state == "AWAITING_REVIEW", F.when(has_reports, "FINALIZE_REVIEW").otherwise("WAITING_FOR_REVIEW"))
    )


def next_actions(units: DataFrame, needs: DataFrame, run: str = "run") -> DataFrame:
    """The one action of each run: units in progress first, then planned ones, both in position order.

    ``units`` has run, unit, position, state, route, has_candidate, has_reports. A planned unit with a blocked
    prerequisite is to be blocked; one whose prerequisites are not all reviewed waits. A run in which nothing can act
    shows the first reason to wait (action null).
    """
    own = units.filter(F.col("route").isin(*OPEN_ROUTES)).join(readiness(units, needs), "unit")
    acts = expected_action(F.col("state"), F.lit(True), F.col("has_candidate"), F.col("has_reports"))
    busy = F.col("state").isin("PREPARED", "BUILT_DRAFT", "AWAITING_REVIEW")
    chosen = F.when(busy, acts).when(F.col("state") == "PLANNED", F.when(F.col("blocked"), "BLOCK_PREREQUISITE").when(~F.col("ready"), "WAITING_FOR_PREREQUISITES").otherwise(acts))
    rows = own.withColumn("_act", chosen).filter("_act is not null").withColumn("_waits", F.col("_act").startswith("WAITING"))
    order = Window.partitionBy(run).orderBy("_waits", (~busy).cast("int"), "position")
    first = rows.withColumn("_at", F.row_number().over(order)).filter("_at = 1")
    return first.select(run, F.when(~F.col("_waits"), F.col("unit")).alias("unit"), F.when(~F.col("_waits"), F.col("_act")).alias("action"), F.when(F.col("_waits"), F.col("_act")).alias("waiting"))


def triage(role: Column, kind: Column, issue: Column, action: Column, teaching_issues: list[str]) -> Column:
    """Whether a review finding is a same-facts edit or needs new claims first."""
    rewrite = (role == "EVIDENCE") & (kind == "GENERAL") & (issue == "PROJECT_FACT_UNMARKED") & (action == "MARK_AS_CLAIM_OR_REWRITE_AS_GENERAL")
    return F.when(rewrite | (role == "BEGINNER") & issue.isin(*teaching_issues), TEACHING_EDIT).otherwise(UPSTREAM)


def repair(findings: DataFrame, statuses: DataFrame, key: str) -> DataFrame:
    """Repair decision of each review: from its state, its reports, and the classes of its findings.

    ``statuses`` has key, review_state, reports (number of the two that are there); ``findings`` has key, class.
    """
    seen = findings.groupBy(key).agg(F.bool_or(F.col("class") == UPSTREAM).alias("_up"), F.bool_and(F.col("class") == TEACHING_EDIT).alias("_edits"))
    decision = (
        F.when(F.col("review_state") == "REVIEWED_DRAFT", "NO_REPAIR")
        .when(F.col("review_state") == "REVIEW_INCOMPLETE", "REVIEW_INCOMPLETE")
        .when(F.col("review_state") != "REPAIR_REQUIRED", "STOP_UNSUPPORTED")
        .when(F.col("reports") < 2, "REPORTS_MISSING")
        .when(F.col("_up"), "UPSTREAM_REQUIRED")
        .when(F.col("_edits"), "SAME_SNAPSHOT_REPAIR")
        .otherwise("STOP_UNSUPPORTED")
    )
    return statuses.join(seen, key, "left").select(key, decision.alias("decision"))


def bad_steps(log: DataFrame, key: str, order: str, fixed: list[str]) -> DataFrame:
    """Violations between neighbouring revisions of a unit: (key, revision, code).

    Codes: STATE_NOT_ALLOWED, IMMUTABLE_CHANGED (a column of ``fixed``), ATTEMPT_COUNT (fewer, or more than one new),
    DIGESTS_NOT_APPENDED, DISPOSITION_NOT_ALLOWED. The log has state, attempts (number), digests (array), disposition.
    """
    w = Window.partitionBy(key).orderBy(order)
    before = {c: F.lag(c).over(w).alias(f"_{c}") for c in ("state", "attempts", "digests", "disposition", *fixed)}
    steps = log.select("*", *before.values()).filter("_state is not null")
    table = lambda pairs: F.create_map(*(x for k, v in pairs.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    within = lambda pairs, old, new: F.coalesce(F.array_contains(F.try_element_at(table(pairs), old), new), F.lit(False))
    old, new = F.coalesce("_disposition", F.lit("")), F.coalesce("disposition", F.lit(""))
    tests = {
        "STATE_NOT_ALLOWED": ~within(ALLOWED, F.col("_state"), F.col("state")),
        "IMMUTABLE_CHANGED": ~F.struct(*fixed).eqNullSafe(F.struct(*(F.col(f"_{c}").alias(c) for c in fixed))),
        "ATTEMPT_COUNT": ~(F.col("attempts") - F.col("_attempts")).between(0, 1),
        "DIGESTS_NOT_APPENDED": F.slice("digests", F.lit(1), F.size("_digests")) != F.col("_digests"),
        "DISPOSITION_NOT_ALLOWED": (old != new) & ~within(DISPOSITIONS, old, new),
    }
    codes = F.filter(F.array(*(F.when(test, code) for code, test in tests.items())), lambda x: x.isNotNull())
    return steps.select(key, order, F.explode(codes).alias("code"))


def rollup_state(state: Column) -> Column:
    """State of a run from its units' states (an aggregate); blocked units come first, then whether all agree, then waits."""
    return (
        F.when(F.bool_or(state.isin(*BLOCKED_STATES)), "PARTIAL_BLOCKED")
        .when(F.bool_and(state == "REVIEWED_DRAFT"), "DRAFTS_REVIEWED")
        .when(F.bool_and(state == "PLANNED"), "READY")
        .when(F.bool_or(state.isin(*WAITING_STATES)), "WAITING_EXTERNAL")
        .otherwise("ACTIVE")
    )


def open_attempt(units: DataFrame, limit: int = 3) -> DataFrame:
    """Units blocked in review with attempts left: the next attempt's number and the digest it links back to."""
    ready = units.filter((F.col("state") == "BLOCKED_REVIEW") & F.col("attempts").between(1, limit - 1))
    return ready.select("unit", (F.col("attempts") + 1).alias("attempt"), F.try_element_at("digests", F.lit(-1)).alias("predecessor"), F.lit("REPAIR_READY").alias("state"))


def upgraded(units: DataFrame) -> DataFrame:
    """Units of a first-version state in the form of the next one: no repair disposition yet, and a list of attempts that
    holds the original one if there is an attempt. ``finding`` is STATE_BINDING_INVALID where that is not the first."""
    first = F.col("attempt_id") == "attempt-0001"
    attempt = F.struct(F.col("attempt_id"), F.col("state").alias("execution_state"), F.lit("ORIGINAL").alias("disposition"), F.lit(None).cast("string").alias("predecessor"))
    none = F.array().cast("array<struct<attempt_id: string, execution_state: string, disposition: string, predecessor: string>>")
    return units.withColumn("repair_disposition", F.lit(None).cast("string")).withColumn("attempts", F.when(first, F.array(attempt)).otherwise(none)).withColumn("finding", F.when(F.col("attempt_id").isNotNull() & ~first, "STATE_BINDING_INVALID"))
