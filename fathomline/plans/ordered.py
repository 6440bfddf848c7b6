"""Windows, intervals, pairing, transitions and as-of joins over the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.operators import intervals, sequence
from fathomline.plans.registry import query, table

#: Steps that the transition query allows.
ALLOWED = {"signup": ["view", "click"], "view": ["view", "click", "purchase"], "click": ["view", "click", "purchase", "error"], "purchase": ["view", "signup"], "error": ["error", "view"]}
_ALLOWED_SQL = ", ".join(f"('{a}', '{b}')" for a, bs in ALLOWED.items() for b in bs)

_RANGES = "SELECT l_suppkey AS supplier, date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS low, date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) + CAST(l_quantity AS BIGINT) AS high FROM lineitem"
_MERGED = f"""
r AS ({_RANGES}),
o AS (SELECT *, max(high) OVER (PARTITION BY supplier ORDER BY low, high ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM r),
i AS (SELECT *, sum(CASE WHEN top IS NULL OR low > top + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY supplier ORDER BY low, high ROWS UNBOUNDED PRECEDING) AS island FROM o),
m AS (SELECT supplier, island, min(low) AS low, max(high) AS high, count(*) AS parts, sum(high - low + 1) AS total FROM i GROUP BY supplier, island)"""


def ship_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.unix_date(F.col("l_shipdate").cast("date")).cast("long")
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("supplier"), day.alias("low"), (day + F.col("l_quantity").cast("long")).alias("high"))


@query(f"""
WITH {_MERGED}
SELECT supplier, count(*) AS islands, CAST(sum(high - low + 1) AS BIGINT) AS covered, CAST(sum(total) - sum(high - low + 1) AS BIGINT) AS duplicated, CAST(max(high) - min(low) + 1 - sum(high - low + 1) AS BIGINT) AS missing
FROM m GROUP BY supplier""")
def interval_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inclusive ranges merged where they touch: covered, duplicated and missing days."""
    return intervals.coverage(ship_ranges(spark, sf_dir), ["supplier"], "low", "high")


@query(f"WITH {_MERGED} SELECT supplier, low, high, parts, CAST(total AS BIGINT) AS total FROM m")
def interval_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The merged ranges themselves."""
    return intervals.merged(ship_ranges(spark, sf_dir), ["supplier"], "low", "high")


@query(f"""
WITH {_MERGED}, p AS (SELECT DISTINCT supplier, low + 20 AS low, high + 40 AS high FROM r)
SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.supplier = p.supplier AND m.low <= p.low AND p.high <= m.high)""")
def uncovered_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wanted ranges that no merged range holds whole."""
    own = ship_ranges(spark, sf_dir)
    wanted = own.select("supplier", (F.col("low") + 20).alias("low"), (F.col("high") + 40).alias("high")).distinct()
    return intervals.uncovered(wanted, own, ["supplier"], "low", "high")


_RUNS = """
b AS (SELECT *, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS broken FROM events),
n AS (SELECT *, sum(broken) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM b),
l AS (SELECT user_id, run, sum(1 - broken) AS length FROM n GROUP BY user_id, run)"""


@query(f"WITH {_RUNS} SELECT user_id, CAST(max(length) AS BIGINT) AS longest, count(*) FILTER (length >= 8) AS long_runs FROM l GROUP BY user_id")
def run_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest run of events without a purchase, and runs of eight or more."""
    own = intervals.runs(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type") == "purchase")
    return own.groupBy("user_id").agg(F.max("length").alias("longest"), F.count_if(F.col("length") >= 8).alias("long_runs"))


@query(f"""
WITH {_RUNS}, t AS (SELECT user_id, count(*) AS key_lines, count(*) FILTER (event_type = 'purchase') AS notes FROM events GROUP BY user_id),
x AS (SELECT user_id, CAST(max(length) AS BIGINT) AS max_run, count(*) FILTER (length >= 8) AS bad_runs FROM l GROUP BY user_id)
SELECT user_id, key_lines, notes, max_run, bad_runs, CAST(ceil(key_lines / 12.0) AS BIGINT) AS need, max_run < 8 AND notes >= ceil(key_lines / 12.0) AS passed FROM t JOIN x USING (user_id)""")
def density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotation density: notes needed, notes there, and the longest run without one."""
    return intervals.density(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type") == "purchase")


@query("""
WITH k AS (SELECT *, lag(event_type) OVER w AS before_kind, lag(epoch_us(ts)) OVER w AS before_ms FROM events WHERE event_type IN ('signup', 'purchase') WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, user_id, coalesce(before_kind = 'signup', false) AS matched, CASE WHEN before_kind = 'signup' THEN greatest(0, epoch_us(ts) - before_ms) END AS duration FROM k WHERE event_type = 'purchase'""")
def begin_end_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every end with the begin before it, its duration in microseconds, and ends without a begin."""
    own = sequence.pairs(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type", "signup", "purchase", F.unix_micros(F.col("ts").cast("timestamp")))
    return own.select("event_id", "user_id", "matched", "duration")


@query("""
WITH k AS (SELECT user_id, event_id, ts, lag(event_type) OVER w AS before_kind, epoch_us(ts) - lag(epoch_us(ts)) OVER w AS ms, event_type FROM events WHERE event_type IN ('signup', 'purchase') WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
p AS (SELECT user_id % 8 AS phase, ms, ts, event_id FROM k WHERE event_type = 'purchase' AND before_kind = 'signup')
SELECT phase, count(*) AS n, CAST(sum(ms) AS BIGINT) AS total_us, CAST(floor(median(ms)) AS BIGINT) AS median_us, max_by(ms, (ts, event_id)) AS last_us FROM p GROUP BY phase""")
def phase_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count, sum, truncated median and last duration of each phase."""
    own = sequence.pairs(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type", "signup", "purchase", F.unix_micros(F.col("ts").cast("timestamp"))).filter("matched")
    return own.groupBy((F.col("user_id") % 8).alias("phase")).agg(
        F.count("*").alias("n"), F.sum("duration").alias("total_us"), F.floor(F.median("duration")).alias("median_us"), F.max_by("duration", F.struct("ts", "event_id")).alias("last_us")
    )


@query(f"""
WITH s AS (SELECT event_id, user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
SELECT event_id, user_id, before, event_type FROM s WHERE before IS NOT NULL AND (before, event_type) NOT IN (VALUES {_ALLOWED_SQL})""")
def state_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps between states that the table of allowed ones lacks."""
    return sequence.transitions(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type", ALLOWED).select("event_id", "user_id", "before", "event_type")


@query("""
SELECT event_id, user_id, last_value(CASE WHEN event_type = 'view' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_view
FROM events QUALIFY event_type = 'purchase'""")
def asof_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last view before each purchase."""
    events = table(spark, sf_dir, "events")
    found = events.withColumn("last_view", sequence.last_before(events, ["user_id"], ["ts", "event_id"], F.col("event_id"), F.col("event_type") == "view"))
    return found.filter("event_type = 'purchase'").select("event_id", "user_id", "last_view")


@query("""
SELECT event_id, user_id, last_value(CASE WHEN event_type = 'view' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS last_view
FROM events QUALIFY event_type = 'purchase'""")
def asof_backward_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As above, at most five rows back."""
    events = table(spark, sf_dir, "events")
    found = events.withColumn("last_view", sequence.last_before(events, ["user_id"], ["ts", "event_id"], F.col("event_id"), F.col("event_type") == "view", reach=5))
    return found.filter("event_type = 'purchase'").select("event_id", "user_id", "last_view")


@query("""
SELECT event_id, user_id, first_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_click
FROM events QUALIFY event_type = 'error'""")
def asof_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first click after each error."""
    events = table(spark, sf_dir, "events")
    found = events.withColumn("next_click", sequence.first_after(["user_id"], ["ts", "event_id"], F.col("event_id"), F.col("event_type") == "click"))
    return found.filter("event_type = 'error'").select("event_id", "user_id", "next_click")


_CHAIN = "SELECT conv_id, turn + 1 AS revision, sha256(role || ':' || text) AS own, CASE WHEN turn % 7 = 3 THEN sha256('x') ELSE lag(sha256(role || ':' || text)) OVER (PARTITION BY conv_id ORDER BY turn) END AS parent FROM conversations"


@query(f"""
WITH c AS ({_CHAIN}), l AS (SELECT *, revision = row_number() OVER w AS contiguous, parent IS NOT DISTINCT FROM lag(own) OVER w AS linked FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY revision))
SELECT conv_id, count(*) AS revisions, bool_and(contiguous) AS contiguous, count(*) FILTER (NOT linked) AS broken FROM l GROUP BY conv_id""")
def chain_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Append-only logs: contiguous revisions, each linked to the digest before it."""
    from pyspark.sql import Window

    turns = table(spark, sf_dir, "conversations")
    own = F.sha2(F.concat("role", F.lit(":"), "text"), 256)
    before = F.lag("own").over(Window.partitionBy("conv_id").orderBy("turn"))
    log = turns.select("conv_id", "turn", (F.col("turn") + 1).alias("revision"), own.alias("own")).withColumn("parent", F.when(F.col("turn") % 7 == 3, F.sha2(F.lit("x"), 256)).otherwise(before))
    checked = sequence.chain(log, ["conv_id"], "revision", F.col("parent"), F.col("own"))
    return checked.groupBy("conv_id").agg(F.count("*").alias("revisions"), F.bool_and("contiguous").alias("contiguous"), F.count_if(~F.col("linked")).alias("broken"))


@query("""
WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations)
SELECT conv_id, bool_and(turn = pos) AS contiguous, count(*) FILTER (before = role) AS repeated_roles, min_by(role, turn) AS first_role FROM t GROUP BY conv_id""")
def turn_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Position checks: contiguous order, alternating roles, first role."""
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    turns = table(spark, sf_dir, "conversations").withColumn("pos", F.row_number().over(w) - 1).withColumn("before", F.lag("role").over(w))
    return turns.groupBy("conv_id").agg(F.bool_and(F.col("turn") == F.col("pos")).alias("contiguous"), F.count_if(F.col("before") == F.col("role")).alias("repeated_roles"), F.min_by("role", "turn").alias("first_role"))


@query("""
WITH p AS (SELECT user_id, event_type, ts, lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts) AS prev FROM (SELECT user_id, event_type, date_trunc('hour', ts) AS ts FROM events))
SELECT user_id, event_type, ts FROM p WHERE ts = prev""")
def duplicate_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours in key order that are equal."""
    hours = table(spark, sf_dir, "events").select("user_id", "event_type", F.date_trunc("hour", "ts").alias("ts"))
    return sequence.duplicates(hours, ["user_id", "event_type"], "ts")


@query("""
WITH u AS (SELECT p_partkey AS unit, row_number() OVER (ORDER BY p_size, p_partkey) AS position FROM part),
n AS (SELECT p_partkey AS unit, p_partkey // 2 AS need FROM part WHERE p_partkey > 1)
SELECT n.unit, n.need FROM n JOIN u ON u.unit = n.unit LEFT JOIN u v ON v.unit = n.need WHERE v.position IS NULL OR v.position >= u.position""")
def order_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units whose prerequisite does not stand before them."""
    part = table(spark, sf_dir, "part")
    units = part.select(F.col("p_partkey").alias("unit"), F.struct("p_size", "p_partkey").alias("position"))  # the order itself is the position
    needs = part.filter("p_partkey > 1").select(F.col("p_partkey").alias("unit"), F.expr("p_partkey div 2").alias("need"))
    return sequence.introduced_late(units, needs, "unit", "position", "need")


@query("""
WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS spot, count(*) OVER (PARTITION BY user_id, run) AS length FROM (
  SELECT *, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM events) WHERE event_type <> 'purchase')
SELECT user_id, event_id FROM r WHERE length >= 8 AND spot % 7 = 0""")
def annotation_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh row of runs of eight or more."""
    from pyspark.sql import Window

    so_far = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    events = table(spark, sf_dir, "events").withColumn("run", F.sum((F.col("event_type") == "purchase").cast("int")).over(so_far)).filter("event_type <> 'purchase'")
    island = Window.partitionBy("user_id", "run")
    placed = events.withColumn("at", F.row_number().over(island.orderBy("ts", "event_id"))).withColumn("length", F.count("*").over(island))
    return placed.filter("length >= 8 and at % 7 = 0").select("user_id", "event_id")
