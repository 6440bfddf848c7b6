"""Workflow and Markdown queries over units derived from the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.functions import code
from fathomline.operators import extraction, lines, markdown, workflow
from fathomline.plans.registry import query, table

_STATES = list(workflow.ALLOWED)
_LIST = "[" + ", ".join(f"'{s}'" for s in _STATES) + "]"
_BLOCKED = ", ".join(f"'{s}'" for s in workflow.BLOCKED_STATES)
#: Units: parts in runs by brand, with a state, a route and files derived from their keys.
_UNITS = f"""u AS (SELECT p_brand AS run, p_partkey AS unit, p_partkey AS position, {_LIST}[1 + (p_partkey * 7 + p_size) % {len(_STATES)}] AS state,
  CASE p_partkey % 3 WHEN 0 THEN 'PHASE6A_PROJECT_CLAIM' WHEN 1 THEN 'D2A_GENERAL_LEARNING' ELSE 'UPSTREAM_REQUIRED' END AS route, p_size % 2 = 0 AS has_candidate, p_size % 3 = 0 AS has_reports FROM part),
n AS (SELECT p_partkey AS unit, p_partkey // 2 AS need FROM part WHERE p_partkey > 1),
r AS (SELECT u.unit, coalesce(bool_and(v.state = 'REVIEWED_DRAFT'), true) AS ready, coalesce(bool_or(v.state IN ({_BLOCKED})), false) AS blocked FROM u LEFT JOIN n USING (unit) LEFT JOIN u v ON v.unit = n.need GROUP BY u.unit)"""


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.element_at(F.array(*map(F.lit, _STATES)), ((F.col("p_partkey") * 7 + F.col("p_size")) % len(_STATES) + 1).cast("int"))
    route = F.when(F.col("p_partkey") % 3 == 0, "PHASE6A_PROJECT_CLAIM").when(F.col("p_partkey") % 3 == 1, "D2A_GENERAL_LEARNING").otherwise("UPSTREAM_REQUIRED")
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("run"), F.col("p_partkey").alias("unit"), F.col("p_partkey").alias("position"), state.alias("state"), route.alias("route"), (F.col("p_size") % 2 == 0).alias("has_candidate"), (F.col("p_size") % 3 == 0).alias("has_reports"))


def needs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").filter("p_partkey > 1").selectExpr("p_partkey AS unit", "p_partkey div 2 AS need")


@query(f"WITH {_UNITS} SELECT * FROM r")
def unit_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether all prerequisites of a unit are reviewed, or any is blocked."""
    return workflow.readiness(units(spark, sf_dir), needs(spark, sf_dir))


@query(f"""
WITH {_UNITS}, a AS (SELECT u.*, state IN ('PREPARED', 'BUILT_DRAFT', 'AWAITING_REVIEW') AS busy,
  CASE WHEN state = 'PREPARED' THEN CASE WHEN has_candidate THEN 'BUILD' ELSE 'WAITING_FOR_WRITER' END WHEN state = 'BUILT_DRAFT' THEN 'PREPARE_REVIEW'
  WHEN state = 'AWAITING_REVIEW' THEN CASE WHEN has_reports THEN 'FINALIZE_REVIEW' ELSE 'WAITING_FOR_REVIEW' END
  WHEN state = 'PLANNED' THEN CASE WHEN blocked THEN 'BLOCK_PREREQUISITE' WHEN NOT ready THEN 'WAITING_FOR_PREREQUISITES' ELSE 'PREPARE' END END AS act FROM u JOIN r USING (unit) WHERE route <> 'UPSTREAM_REQUIRED'),
f AS (SELECT *, act LIKE 'WAITING%' AS waits, row_number() OVER (PARTITION BY run ORDER BY act LIKE 'WAITING%', NOT busy, position) AS spot FROM a WHERE act IS NOT NULL)
SELECT run, CASE WHEN NOT waits THEN unit END AS unit, CASE WHEN NOT waits THEN act END AS action, CASE WHEN waits THEN act END AS waiting FROM f WHERE spot = 1""")
def next_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one action of each run."""
    return workflow.next_actions(units(spark, sf_dir), needs(spark, sf_dir))


@query(f"""
WITH {_UNITS} SELECT run, CASE WHEN bool_or(state IN ({_BLOCKED})) THEN 'PARTIAL_BLOCKED' WHEN bool_and(state = 'REVIEWED_DRAFT') THEN 'DRAFTS_REVIEWED' WHEN bool_and(state = 'PLANNED') THEN 'READY'
  WHEN bool_or(state IN ('PREPARED', 'AWAITING_REVIEW', 'REPAIR_READY')) THEN 'WAITING_EXTERNAL' ELSE 'ACTIVE' END AS run_state FROM (SELECT run || ':' || (unit % 40) AS run, state FROM u) GROUP BY run""")
def run_state_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run's state from its units' states."""
    own = units(spark, sf_dir).withColumn("run", F.concat_ws(":", "run", F.expr("unit % 40")))
    return own.groupBy("run").agg(workflow.rollup_state(F.col("state")).alias("run_state"))


@query("""
SELECT c_custkey AS unit, CASE WHEN c_custkey % 4 = 0 OR c_custkey % 4 = 1 THEN CASE WHEN c_nationkey % 2 = 0 THEN 'BLOCKED_UNSUPPORTED' ELSE 'D2A_GENERAL_LEARNING' END
  ELSE CASE WHEN c_nationkey % 2 = 1 THEN 'UPSTREAM_REQUIRED' WHEN c_custkey % 3 = 0 THEN 'PHASE6A_PROJECT_CLAIM' WHEN c_custkey % 3 = 1 THEN 'UPSTREAM_REQUIRED' ELSE 'BLOCKED_UNSUPPORTED' END END AS route FROM customer""")
def unit_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decision table of routes."""
    kind = F.col("c_custkey") % 4
    origin = F.when(kind == 1, "PREREQUISITE_PRIMER").otherwise("CANDIDATE")
    scope = F.when(kind == 0, "GENERAL_LEARNING").otherwise("PROJECT_SPECIFIC")
    ready = F.element_at(F.array(*map(F.lit, ("READY", "NO_QUALIFYING_SUPPORTED_CLAIM", "CLAIM_SCOPE_AMBIGUOUS"))), (F.col("c_custkey") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("unit"), workflow.route(origin, scope, F.col("c_nationkey") % 2 == 0, ready).alias("route"))


@query("""
WITH s AS (SELECT o_orderkey AS review, CASE o_orderkey % 4 WHEN 0 THEN 'REVIEWED_DRAFT' WHEN 1 THEN 'REVIEW_INCOMPLETE' ELSE 'REPAIR_REQUIRED' END AS review_state, CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 2 END AS reports FROM orders),
f AS (SELECT l_orderkey AS review, CASE WHEN l_linenumber % 2 = 0 OR l_returnflag <> 'R' THEN 'E' ELSE 'U' END AS class FROM lineitem),
g AS (SELECT review, bool_or(class = 'U') AS up, bool_and(class = 'E') AS edits FROM f GROUP BY review)
SELECT review, CASE WHEN review_state = 'REVIEWED_DRAFT' THEN 'NO_REPAIR' WHEN review_state = 'REVIEW_INCOMPLETE' THEN 'REVIEW_INCOMPLETE' WHEN reports < 2 THEN 'REPORTS_MISSING' WHEN up THEN 'UPSTREAM_REQUIRED' WHEN edits THEN 'SAME_SNAPSHOT_REPAIR' ELSE 'STOP_UNSUPPORTED' END AS decision
FROM s LEFT JOIN g USING (review)""")
def repair_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repair decisions from review states, reports and classified findings."""
    key = F.col("o_orderkey")
    state = F.when(key % 4 == 0, "REVIEWED_DRAFT").when(key % 4 == 1, "REVIEW_INCOMPLETE").otherwise("REPAIR_REQUIRED")
    statuses = table(spark, sf_dir, "orders").select(key.alias("review"), state.alias("review_state"), F.when(key % 7 == 0, 1).otherwise(2).alias("reports"))
    role = F.when((F.col("l_linenumber") % 2 == 0) | (F.col("l_returnflag") != "R"), "BEGINNER").otherwise("EVIDENCE")
    found = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("review"), workflow.triage(role, F.lit("CLAIM"), F.lit("TERM_UNEXPLAINED"), F.lit(""), ["TERM_UNEXPLAINED"]).alias("class"))
    return workflow.repair(found, statuses, "review")


@query(f"""
WITH l AS (SELECT conv_id AS unit, turn AS revision, {_LIST}[1 + (conv_id + turn // 2) % {len(_STATES)}] AS state, turn // 3 AS attempts, conv_id % 5 + CASE WHEN turn = 4 THEN 1 ELSE 0 END AS fixed FROM conversations),
s AS (SELECT *, lag(state) OVER w AS before, lag(attempts) OVER w AS old_attempts, lag(fixed) OVER w AS old_fixed FROM l WINDOW w AS (PARTITION BY unit ORDER BY revision))
SELECT unit, revision, 'STATE_NOT_ALLOWED' AS code FROM s WHERE before IS NOT NULL AND (before, state) NOT IN (VALUES {", ".join(f"('{a}', '{b}')" for a, bs in workflow.ALLOWED.items() for b in bs)})
UNION ALL SELECT unit, revision, 'IMMUTABLE_CHANGED' FROM s WHERE before IS NOT NULL AND fixed <> old_fixed
UNION ALL SELECT unit, revision, 'ATTEMPT_COUNT' FROM s WHERE before IS NOT NULL AND (attempts - old_attempts < 0 OR attempts - old_attempts > 1)""")
def attempt_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations between neighbouring revisions of units with attempts."""
    state = F.element_at(F.array(*map(F.lit, _STATES)), ((F.col("conv_id") + F.expr("turn div 2")) % len(_STATES) + 1).cast("int"))
    log = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("unit"), F.col("turn").alias("revision"), state.alias("state"), F.expr("turn div 3").alias("attempts"), F.array(F.lit("d")).alias("digests"), F.lit(None).cast("string").alias("disposition"), (F.col("conv_id") % 5 + (F.col("turn") == 4).cast("int")).alias("fixed")
    )
    return workflow.bad_steps(log, "unit", "revision", ["fixed"])


@query("""
SELECT conv_id AS book, '## Contents' || chr(10) || string_agg('- [' || role || '](#unit-' || turn || ')', chr(10) ORDER BY turn) || chr(10) || chr(10) || '## Lessons' || chr(10) || chr(10)
  || string_agg('<a id="unit-' || turn || '"></a>' || chr(10) || '## ' || role || chr(10) || chr(10) || text, chr(10) || chr(10) ORDER BY turn) || chr(10) AS text FROM conversations GROUP BY conv_id""")
def book_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units in order as one text with contents."""
    turns = table(spark, sf_dir, "conversations").withColumn("anchor", F.concat(F.lit("unit-"), "turn"))
    return markdown.rendered(turns.withColumnRenamed("conv_id", "book"), "book", "turn", "anchor", "role", "text")


@query("""
WITH a AS (SELECT conv_id, 't' || (turn // 2 + CASE WHEN conv_id % 3 = 0 THEN turn % 2 ELSE 0 END) AS target FROM conversations), l AS (SELECT conv_id, 't' || (turn + 1) AS target FROM conversations),
c AS (SELECT conv_id, target, count(*) AS n FROM a GROUP BY ALL)
SELECT conv_id, 'ANCHOR_DUPLICATE' AS code, target FROM c WHERE n > 1
UNION ALL SELECT conv_id, CASE WHEN n IS NULL THEN 'FRAGMENT_UNRESOLVED' ELSE 'FRAGMENT_AMBIGUOUS' END, target FROM l LEFT JOIN c USING (conv_id, target) WHERE n IS NULL OR n > 1""")
def anchor_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors that occur twice and links that meet none or several."""
    turns = table(spark, sf_dir, "conversations")
    spread = F.when(F.col("conv_id") % 3 == 0, F.col("turn") % 2).otherwise(0)
    anchors = turns.select("conv_id", F.concat(F.lit("t"), F.expr("turn div 2") + spread).alias("target"))
    return markdown.link_findings(anchors, turns.select("conv_id", F.concat(F.lit("t"), F.col("turn") + 1).alias("target")), "conv_id")


@query("""
SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: x || ' // :L' || i), chr(10)) AS block, text AS bare FROM documents""")
def numbered_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines of texts with their numbers behind them, and the way back."""
    docs = table(spark, sf_dir, "documents").withColumn("block", markdown.numbered_block(F.col("text"), F.lit(1), F.size(F.split("text", "\n"))))
    return docs.select("doc_id", "block", markdown.stripped_block(F.col("block")).alias("bare"))


@query("""
WITH l AS (SELECT doc_id, unnest(string_split('```' || chr(10) || text || chr(10) || '```' || chr(10) || lang || chr(10) || source, chr(10))) AS line, generate_subscripts(string_split('```' || chr(10) || text || chr(10) || '```' || chr(10) || lang || chr(10) || source, chr(10)), 1) AS line_no FROM documents),
t AS (SELECT doc_id, len(string_split(text, chr(10))) + 2 AS close FROM documents)
SELECT doc_id, line_no, line FROM l JOIN t USING (doc_id) WHERE line_no > close""")
def visible_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines outside fenced blocks (each text is fenced, two lines follow)."""
    fenced = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("```\n"), "text", F.lit("\n```\n"), "lang", F.lit("\n"), "source").alias("text"))
    blocks = extraction.fences(fenced).withColumn("doc_id", F.col("doc_id").cast("long"))
    return markdown.visible(lines.exploded(fenced, "doc_id", "text"), blocks, "doc_id").select("doc_id", "line_no", "line")


@query(r"""
SELECT source, CAST(sum(len(list_filter(string_split(regexp_replace(text, '([.!?])[\t\n\f\r ]+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> ''))) AS BIGINT) AS sentences FROM documents GROUP BY source""")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs split after sentence ends."""
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.sum(F.size(code.sentences(F.col("text"))).cast("long")).alias("sentences"))
