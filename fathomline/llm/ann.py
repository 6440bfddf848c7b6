"""Nearest neighbours by inner product: inverted file, product-quantised residuals, exact reranking within bounds.

Equal vectors collapse to one class that keeps its smallest ids, so copies neither fill a list nor a result. Coarse
centroids and codebooks are fitted on a bounded sample; every class is then assigned to a list and its residual coded.
Neighbouring lists form groups of bounded size; a list that holds a third of all rows is cut into blocks instead. A
query first scans the group of its own list, which gives a floor for its k-th best score, then every other group with a
list that may still reach the floor: no vector x of a list with centroid c has q.x over q.c + |q| max|x - c|. Within a
cell, scores come from asymmetric distance tables; a row whose score plus |q| times its coding error may reach the
floor is scored exactly. So nothing is lost, and where the bounds exclude little, the work is that of all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathomline.llm.common import written

#: The index is fitted on so many vectors at most, of so many bytes; a list for every 16 of them at most.
SAMPLE_ROWS, SAMPLE_BYTES = 40_960, 32 << 20
MAX_LISTS = SAMPLE_ROWS // 16
CODES = 256
CELL_ROWS, CELL_QUERIES, CELL_BYTES = 8192, 4096, 32 << 20
#: Relative to the lengths of both vectors: more than rounding to 32 bits and in sums takes from a bound.
SLACK = 1e-4


@dataclass(frozen=True)
class Index:
    centroids: np.ndarray
    books: list[np.ndarray]
    edges: list[int]

    def assign(self, x: np.ndarray) -> np.ndarray:
        return _nearest(x, self.centroids)

    def encode(self, x: np.ndarray, lists: np.ndarray) -> np.ndarray:
        rest = x - self.centroids[lists]
        return np.column_stack([_nearest(rest[:, a:b], book) for a, b, book in zip(self.edges, self.edges[1:], self.books, strict=False)]).astype(np.uint8)

    def decode(self, codes: np.ndarray, lists: np.ndarray) -> np.ndarray:
        return self.centroids[lists].astype(np.float64) + np.concatenate([book[codes[:, k]] for k, book in enumerate(self.books)], axis=1)

    def scores(self, q: np.ndarray, codes: np.ndarray, lists: np.ndarray) -> np.ndarray:
        """(query, row): inner products of the queries with the coded rows, from tables of the queries' parts and the codes."""
        q = q.astype(np.float32)
        out = (q @ self.centroids.T).take(lists, axis=1)
        for k, (a, b, book) in enumerate(zip(self.edges, self.edges[1:], self.books, strict=False)):
            out += (q[:, a:b] @ book.T).take(codes[:, k], axis=1)
        return out


def _nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    half = (centers**2).sum(1) / 2
    return np.concatenate([(x[i : i + 4096] @ centers.T - half).argmax(1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


def kmeans(x: np.ndarray, k: int, rounds: int = 10, seed: int = 7) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centers = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = _nearest(x, centers)
        sums, counts = np.zeros_like(centers, dtype=np.float64), np.bincount(near, minlength=len(centers))
        np.add.at(sums, near, x)
        full = counts > 0
        centers[full] = (sums[full] / counts[full, None]).astype(x.dtype)
        if not full.all():
            centers[~full] = x[rng.choice(len(x), int((~full).sum()))]
    return centers


def fit(sample: np.ndarray, lists: int, part: int = 4) -> Index:
    scale = np.abs(sample).max(initial=0) or 1
    x = (sample / scale).astype(np.float32)
    centroids = kmeans(x, lists)
    rest = x - centroids[_nearest(x, centroids)]
    dim = x.shape[1]
    edges = [*range(0, dim, part), dim]
    books = [kmeans(rest[:, a:b], CODES, seed=11 + a) * np.float32(scale) for a, b in zip(edges, edges[1:], strict=False)]
    return Index(centroids * np.float32(scale), books, edges)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _packed(column: pa.ChunkedArray | pa.Array, dtype: type, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(-1, width)


def grouped(centroids: np.ndarray, rows: list[int], size: int) -> tuple[list[int], list[int]]:
    """Group of each list, and blocks of each group: lists next to each other along the main axis, up to ``size`` rows a group."""
    centred = centroids - centroids.mean(0)
    axis = np.linalg.svd(centred, full_matrices=False)[2][0] if np.isfinite(centred).all() else np.ones(centroids.shape[1])
    group, held = [0] * len(rows), [0]
    for i in np.argsort(centred @ axis, kind="stable").tolist():
        if held[-1] and held[-1] + rows[i] > size:
            held.append(0)
        group[i] = len(held) - 1
        held[-1] += rows[i]
    return group, [max(1, -(-n // size)) for n in held]


def reaching(q: np.ndarray, floor: np.ndarray, centroids: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """(query, list): whether a vector at most ``radius`` from the list's centroid may have the floor as its inner product."""
    length = np.sqrt((q**2).sum(1))[:, None]
    most = q @ centroids.T + length * (radius + SLACK * (np.sqrt((centroids**2).sum(1)) + radius))
    return ~(most < floor[:, None])


def best_rows(q: np.ndarray, near: np.ndarray, margin: np.ndarray, floor: float, x: np.ndarray, names: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows with the ``count`` best exact scores of at least ``floor``, ties to smaller names, and their scores.

    ``near`` is within ``margin`` of the exact score.
    """
    if len(near) > 8 * count:
        floor = np.fmax(floor, np.partition(near - margin, -count)[-count])
    rows = np.flatnonzero(~(near + margin < floor))
    if len(rows) > count:
        rough = x[rows] @ q
        rows = rows[~(rough < np.partition(rough, -count)[-count] - 1e-9 * np.sqrt(q @ q) * np.sqrt((x[rows] ** 2).sum(1).max()))]
    score = np.zeros(len(rows))
    for d in range(len(q)):  # one order of additions for all rows, so that equal scores tie wherever they are computed
        score += q[d] * x[rows, d]
    top = np.lexsort((names[rows], -score))[:count]
    return rows[top], score[top]


def search(vectors: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): for each vec_id divisible by ``every`` its ``k`` nearest rows.

    Vectors null, zero, holding null or non-finite components, or of another length than most take no part, nor do
    rows with a null vec_id. Rows that repeat a vec_id count once; if their vectors differ, the one with the smallest
    hash does. Ties go to the smaller vec_id. Components beyond 32 bits only make the search slower. With no vector at
    all the result is empty. Other columns are ignored.
    """
    spark = vectors.sparkSession
    usable = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("vector")).filter(
        F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < math.inf)) & F.exists("vector", lambda x: x != 0)
    )
    empty = "query_id bigint, rank int, vec_id bigint, score double"
    sizes = usable.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], empty)
    dim = sizes[0].dim
    rows = usable.filter(F.size("vector") == dim)
    hashes = rows.select("vec_id", F.xxhash64("vector").alias("hash")).groupBy("vec_id").agg(F.min("hash").alias("least"), F.max("hash").alias("most"))
    twice = written(hashes.filter("least < most").select(F.col("vec_id").alias("id"), "least"))
    if not twice.isEmpty():  # seldom; else the vectors need not meet their ids
        rows = rows.join(twice, (F.col("vec_id") == F.col("id")) & (F.xxhash64("vector") > F.col("least")), "left_anti")
    classes = written(rows.groupBy("vector").agg(F.min("vec_id").alias("class")))
    members = written(rows.join(classes, "vector").select("class", "vec_id").distinct())
    count = classes.count()
    lists = max(1, min(MAX_LISTS, round(math.sqrt(count))))
    bound = max(256, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * dim)))
    sample = np.array([r.vector for r in classes.orderBy(F.xxhash64("class"), "class").limit(bound).select("vector").collect()])
    index = fit(sample, min(lists, max(1, len(sample) // 16)))
    wide = index.centroids.astype(np.float64)
    cell_rows = max(256, min(CELL_ROWS, CELL_BYTES // (8 * dim)))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column("vector"), dim)
            near = index.assign(x.astype(np.float32))
            codes = index.encode(x.astype(np.float32), near)
            decoded = index.decode(codes, near)
            error = np.sqrt(((x - decoded) ** 2).sum(1)) + SLACK * sum(np.sqrt((y**2).sum(1)) for y in (x, decoded, wide[near]))
            far = np.sqrt(((x - wide[near]) ** 2).sum(1))
            raw = [pa.array([r.tobytes() for r in m], pa.binary()) for m in (codes, x)]
            yield pa.RecordBatch.from_arrays([b.column("class"), pa.array(near, pa.int32()), raw[0], pa.array(error), pa.array(far), raw[1]], names=["class", "list", "code", "error", "far", "vector"])

    coded = written(classes.mapInArrow(code, "class bigint, list int, code binary, error double, far double, vector binary"))
    extents = {r["list"]: r for r in coded.groupBy("list").agg(F.count("*").alias("rows"), F.max("far").alias("far")).collect()}  # MAX_LISTS at most
    group_of, blocks_of = grouped(wide, [extents[i].rows if i in extents else 0 for i in range(len(wide))], cell_rows)
    radius = np.array([extents[i].far if i in extents else 0.0 for i in range(len(wide))])
    places = F.broadcast(spark.createDataFrame([(i, g, blocks_of[g]) for i, g in enumerate(group_of)], "list int, group int, blocks int"))
    sizes = F.broadcast(spark.createDataFrame(list(enumerate(blocks_of)), "group int, blocks int"))
    rows = coded.join(places, "list").withColumn("block", F.expr("pmod(xxhash64(class), blocks)"))
    asked = members.filter(F.col("vec_id") % every == 0).select("class").distinct()
    asking = written(coded.join(asked, "class", "left_semi").join(places, "list").select(F.col("class").alias("query"), "vector", "group"))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = np.array(group_of)
        for b in batches:
            home, floor = b.column("group").to_numpy(), b.column("floor").to_numpy()
            reached = np.zeros((b.num_rows, len(blocks_of)), bool)
            at, lists = np.nonzero(reaching(_packed(b.column("vector"), np.float64, dim), floor, wide, radius))
            reached[at, of[lists]] = True
            reached[np.arange(b.num_rows), home] = False
            at, groups = np.nonzero(reached)
            where = pa.array(at)
            yield pa.RecordBatch.from_arrays([b.column("query").take(where), b.column("vector").take(where), pa.array(groups, pa.int32()), b.column("floor").take(where)], names=["query", "vector", "group", "floor"])

    def cell(table: pa.Table, queries: pa.Table) -> pa.Table:
        out = ([np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)])
        if table.num_rows and queries.num_rows:
            names, lists, error = (table.column(c).to_numpy() for c in ("class", "list", "error"))
            codes, x = _packed(table.column("code"), np.uint8, len(index.books)), _packed(table.column("vector"), np.float64, dim)
            q, floor = _packed(queries.column("vector"), np.float64, dim), queries.column("floor").to_numpy()
            for lo in range(0, len(q), 64):
                for i, near in enumerate(index.scores(q[lo : lo + 64], codes, lists), lo):
                    found, score = best_rows(q[i], near.astype(np.float64), error * np.sqrt(q[i] @ q[i]), floor[i], x, names, k + 1)
                    out[0].append(np.full(len(found), i))
                    out[1].append(names[found])
                    out[2].append(score)
        at, found, score = map(np.concatenate, out)
        return pa.table({"query": queries.column("query").take(pa.array(at)), "class": pa.array(found), "score": pa.array(score)})

    def scan(routes: DataFrame) -> DataFrame:
        """(query, class, score): the best of each cell that a query goes to."""
        shares = F.broadcast(routes.groupBy("group").agg(F.ceil(F.count("*") / CELL_QUERIES).alias("shares")))  # a row a group
        left = rows.join(shares, "group").select("group", "block", F.explode(F.expr("sequence(0L, shares - 1)")).alias("share"), "class", "list", "code", "error", "vector")
        right = routes.join(shares, "group").join(sizes, "group").select("group", F.explode(F.expr("sequence(0L, blocks - 1L)")).alias("block"), F.expr("pmod(xxhash64(query), shares)").alias("share"), "query", "vector", "floor")
        key = ("group", "block", "share")
        return written(left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(cell, "query bigint, class bigint, score double"))

    order = Window.partitionBy("query").orderBy(F.desc("score"), "class")
    first = scan(asking.withColumn("floor", F.lit(-math.inf)))
    floors = first.withColumn("at", F.row_number().over(order)).filter(F.col("at") == k + 1).select("query", F.col("score").alias("floor"))
    others = asking.join(floors, "query", "left").select("query", "vector", "group", F.coalesce("floor", F.lit(-math.inf)).alias("floor"))
    second = scan(written(others.mapInArrow(route, "query bigint, vector binary, group int, floor double")))
    exact = first.unionByName(second).withColumn("at", F.row_number().over(order)).filter(F.col("at") <= k + 1).drop("at")
    first = Window.partitionBy("class").orderBy("vec_id")
    smallest = members.withColumn("at", F.row_number().over(first)).filter(F.col("at") <= k + 1).select("class", "vec_id")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    best = exact.join(smallest, "class").withColumn("at", F.row_number().over(order)).filter(F.col("at") <= k + 1)
    answers = best.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("at", "vec_id", "score"))).alias("found"))
    own = members.filter(F.col("vec_id") % every == 0).select(F.col("class").alias("query"), F.col("vec_id").alias("query_id"))
    others = F.expr(f"slice(filter(found, x -> x.vec_id <> query_id), 1, {k})")
    return own.join(answers, "query").select("query_id", F.posexplode(others).alias("pos", "hit")).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), "hit.vec_id", "hit.score")
