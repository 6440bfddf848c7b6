"""Graph operators over edge tables (src, dst): containment, closure, levels, cycles and propagation.

Iterations write what is new in each round as a table into the folder that ``spark.checkpoint.dir`` names, join it to the
edges, and carry only counts to the driver. Only ``closure`` makes all pairs; reachability
questions walk a frontier instead, whose rounds follow the longest way walked and whose rows are nodes.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.functions.ids import stable_id
from fathomline.functions.storage import shared_root

#: Rounds after which the tables of a walk are written as one.
COMPACT = 32
#: Hashes whose least ones tell nodes apart, and steps of marks that are taken in one job.
MARKS, STEPS = 4, 4


def _kept(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, and its lineage ends there."""
    path = f"{shared_root(df.sparkSession)}/graph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _union(frames: list[DataFrame]) -> DataFrame:
    """One frame of all; a long list becomes one table, so that plans stay short."""
    if len(frames) > COMPACT:
        frames[:] = [_kept(reduce(DataFrame.unionByName, frames))]
    return reduce(DataFrame.unionByName, frames)


def containment(parents: DataFrame, source: Column, target: Column, member: Column) -> DataFrame:
    """CONTAINS edges with content-addressed ids."""
    return parents.select(stable_id("EDGE", F.lit("CONTAINS"), source, target, member).alias("id"), F.lit("CONTAINS").alias("type"), source.alias("src"), target.alias("dst"), F.lit("VERIFIED").alias("certainty")).distinct()


def closure(edges: DataFrame) -> DataFrame:
    """All (src, dst, depth) with the smallest depth, by doubling: after n rounds paths of up to 2**n edges are known."""
    known = _kept(edges.select("src", "dst").distinct().withColumn("depth", F.lit(1).cast("long")))
    size, before = known.count(), -1
    while size != before:
        left = known.select("src", F.col("dst").alias("mid"), F.col("depth").alias("d1"))
        right = known.select(F.col("src").alias("mid"), "dst", F.col("depth").alias("d2"))
        longer = left.join(right, "mid").select("src", "dst", (F.col("d1") + F.col("d2")).alias("depth"))
        known = _kept(known.unionByName(longer).groupBy("src", "dst").agg(F.min("depth").alias("depth")))
        size, before = known.count(), size
    return known


def _core(edges: DataFrame) -> DataFrame:
    """Edges that are left when nodes without incoming or without outgoing edges are taken away again and again."""
    now = _kept(edges.select("src", "dst").distinct())
    size, before = now.count(), -1
    while size and size != before:
        ahead = now.join(now.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
        now = _kept(ahead.join(ahead.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
        size, before = now.count(), size
    return now


def _marked(edges: DataFrame) -> DataFrame:
    """(side, node, marks): of all nodes that are reached from a node (side 0) or reach it (side 1), itself included, the least, and the least hashes.

    Marks go one edge a step, ``STEPS`` steps a table, until a step moves none. Rows are nodes and edges, never pairs.
    """
    names = [f"mark{k}" for k in range(MARKS + 1)]
    nodes = edges.select("src").union(edges.select("dst")).distinct().toDF("node")
    sides = F.explode(F.array(F.lit(0), F.lit(1)))
    own = nodes.select(sides.alias("side"), F.col("node").alias("at"), F.col("node").alias("to"))
    arcs = _kept(edges.select(F.lit(0).alias("side"), F.col("dst").alias("at"), F.col("src").alias("to")).union(edges.select(F.lit(1), "src", "dst")).union(own))
    now = nodes.select(sides.alias("side"), "node", F.col("node").alias(names[0]), *(F.xxhash64("node", F.lit(k)).alias(names[k]) for k in range(1, MARKS + 1)))
    while True:
        for step in range(STEPS):
            least = [F.min(c).alias(c) for c in names]
            if step == STEPS - 1:
                least += [F.max(F.when(F.col("at") == F.col("to"), F.col(c))).alias(f"was_{c}") for c in names]
            now = arcs.join(now.withColumnRenamed("node", "at"), ["side", "at"]).groupBy("side", "to").agg(*least).withColumnRenamed("to", "node")
        moved = reduce(Column.__or__, (F.col(c) < F.col(f"was_{c}") for c in names))
        now = _kept(now.select("side", "node", *names, moved.alias("moved")))
        if now.filter("moved").isEmpty():
            return now.select("side", "node", F.struct(*names).alias("marks"))
        now = now.drop("moved")


def cyclic(edges: DataFrame) -> DataFrame:
    """Nodes that reach themselves.

    Nodes outside all cycles are peeled off first. Nodes of one cycle reach the same nodes and are reached from the same
    ones, so an edge between nodes whose marks differ is on no cycle and goes. When none goes any more, all nodes that
    edges join have one least node, which each of them reaches and is reached from: what is left are cycles. The
    hashes only make more edges differ at once.
    """
    left = _core(edges)
    size = left.count()
    while size:
        marks = _marked(left)
        both = marks.groupBy("node").agg(F.max(F.when(F.col("side") == 0, F.col("marks"))).alias("ahead"), F.max(F.when(F.col("side") == 1, F.col("marks"))).alias("behind"))
        both = both.select("node", F.struct("ahead", "behind").alias("marks"))
        ends = left.join(both.toDF("src", "from"), "src").join(both.toDF("dst", "into"), "dst")
        left = _core(ends.filter(F.col("from") == F.col("into")))
        size, before = left.count(), size
        if size == before:
            break
    return left.select(F.col("src").alias("node")).distinct()


def levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, level): length of the longest path that ends in the node, by peeling nodes without open prerequisites.

    ``edges`` go from a prerequisite (src) to what needs it (dst). Nodes on or behind a cycle get a null level. A round
    writes its new nodes and the edges that are still open, nothing that is finished.
    """
    fresh = _kept(nodes.select("node").distinct().join(edges.select(F.col("dst").alias("node")).distinct(), "node", "left_anti").withColumn("level", F.lit(0).cast("long")))
    done, left, level = [fresh], _kept(edges.select("src", "dst").distinct()), 0
    while not fresh.isEmpty():
        level += 1
        gone = fresh.select(F.col("node").alias("src"))
        rest = _kept(left.join(gone, "src", "left_anti"))
        met = left.join(gone, "src", "left_semi").select(F.col("dst").alias("node")).distinct()
        fresh = _kept(met.join(rest.select(F.col("dst").alias("node")).distinct(), "node", "left_anti").withColumn("level", F.lit(level).cast("long")))
        done.append(fresh)
        left = rest
        _union(done)
    return nodes.select("node").distinct().join(_union(done), "node", "left")


def reached(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(node): the nodes of ``start`` and all that edges lead to from them, by a frontier."""
    fresh = _kept(start.select("node").distinct())
    seen = [fresh]
    while not fresh.isEmpty():
        ahead = edges.join(fresh.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node")).distinct()
        fresh = _kept(ahead.join(_union(seen), "node", "left_anti"))
        seen.append(fresh)
    return _union(seen)


def blocked(nodes: DataFrame, edges: DataFrame, root: Column) -> DataFrame:
    """(node, blocked): whether the node or anything it depends on is blocked at its root."""
    hit = reached(edges, nodes.filter(root)).withColumn("_hit", F.lit(True))
    return nodes.select("node").distinct().join(hit, "node", "left").select("node", F.coalesce("_hit", F.lit(False)).alias("blocked"))


def primers(units: DataFrame, needs: DataFrame, edges: DataFrame) -> DataFrame:
    """(position, concept): concepts to introduce before a unit: its needs with all prerequisites, first needed there.

    ``units`` (unit, position), ``needs`` (unit, concept), ``edges`` from prerequisite to concept. The smallest position
    is handed down the edges; only concepts whose position became smaller go on.
    """
    least = lambda df: df.groupBy("concept").agg(F.min("position").alias("position"))
    fresh = _kept(least(needs.join(units, "unit")))
    known = [fresh]
    while not fresh.isEmpty():
        handed = least(edges.join(fresh.withColumnRenamed("concept", "dst"), "dst").select(F.col("src").alias("concept"), "position"))
        so_far = least(_union(known)).withColumnRenamed("position", "_now")
        fresh = _kept(handed.join(so_far, "concept", "left").filter(F.col("_now").isNull() | (F.col("position") < F.col("_now"))).select("concept", "position"))
        known.append(fresh)
    return least(_union(known)).select("position", "concept")


def ordered(nodes: DataFrame, edges: DataFrame, key: str = "node") -> DataFrame:
    """(node, level, position): a total order in which every node stands behind its prerequisites: by level, then key.

    Positions come from counts of the levels before and a window within a level. Nodes on or behind a cycle have none.
    """
    from pyspark.sql import Window

    own = levels(nodes, edges).filter("level IS NOT NULL")
    sizes = own.groupBy("level").agg(F.count("*").alias("n"))  # one row a level
    before = sizes.withColumn("_before", F.coalesce(F.sum("n").over(Window.orderBy("level").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    placed = own.join(before, "level").withColumn("position", F.col("_before") + F.row_number().over(Window.partitionBy("level").orderBy(key)))
    return placed.select("node", "level", "position")
