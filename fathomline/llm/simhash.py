"""SimHash near-duplicates by pigeonhole blocks.

Fingerprints are made in Arrow batches; equal ones collapse to one class before anything is joined. A 64-bit
fingerprint is cut into ``distance + 2`` blocks, so that two within ``distance`` bits agree on at least two of them;
each pair of blocks is one blocking key. Classes that share a key are compared by Hamming distance. A key that more
than ``GROUP`` classes share is not paired: there every class also takes the keys of its one-bit neighbours in the
free bits, and classes that meet on such a key are at most two bits apart, so each links to the smallest one there
and no link between different groups is lost. Distances over two are refused, since this would not hold for them.
Components come from alternating star contraction, all in DataFrames.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm.common import map_texts, private, written

GROUP = 64
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str, words_each: int = 3) -> int:
    """Signed 64-bit SimHash: A-Z lower-cased, ASCII white space splits words, shingles by XXH64 with seed 42.

    A bit is set where more than half of the shingle hashes have it; repeats count; no word at all gives zero.
    """
    import xxhash

    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - words_each + 1)
    begin = np.concatenate(([0], ends[: n - 1] + 1)).tolist()
    end = ends[-n:].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], 42) for a, b in zip(begin, end, strict=True)), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for lo in range(0, n, 65536):
        bits = np.unpackbits(hashes[lo : lo + 65536].view(np.uint8), bitorder="little")
        counts += bits.reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, words_each: int = 3, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per row: the columns ``keep`` and bits (the fingerprint as a signed long; zero for null texts and those without a word)."""
    return map_texts(docs, list(keep), "bits bigint", lambda: lambda texts: [[fingerprint(t, words_each) for t in texts]])


def _blocks(count: int) -> list[tuple[int, int]]:
    """(shift, width) of ``count`` blocks that cover 64 bits."""
    edges = [64 * i // count for i in range(count + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _mask(blocks: tuple[tuple[int, int], ...]) -> int:
    mask = sum(((1 << w) - 1) << s for s, w in blocks)
    return mask - (1 << 64) if mask >> 63 else mask


def links(bits: DataFrame, distance: int = 2) -> DataFrame:
    """Links (a, b), a < b, that join all classes of ``bits.bits`` (distinct) within ``distance`` bits of each other."""
    if not 0 <= distance <= 2:
        raise ValueError("distances of 0 to 2 bits are supported")
    masks = [_mask(pair) for pair in combinations(_blocks(distance + 2), 2)]
    keyed = bits.select("bits", F.posexplode(F.array(*(F.col("bits").bitwiseAND(F.lit(m)) for m in masks))).alias("part", "key"))
    sizes = keyed.groupBy("part", "key").agg(F.count("*").alias("size")).filter("size > 1")
    shared = written(keyed.join(sizes, ["part", "key"]))
    small, large = shared.filter(F.col("size") <= GROUP).select("part", "key", "bits"), shared.filter(F.col("size") > GROUP)
    near = F.bit_count(F.col("bits").bitwiseXOR(F.col("other"))) <= distance
    pairs = small.join(small.withColumnRenamed("bits", "other"), ["part", "key"]).filter((F.col("bits") < F.col("other")) & near).select(F.col("bits").alias("a"), F.col("other").alias("b"))
    free = F.element_at(F.array(*(F.array(*(F.lit(1 << i if i < 63 else -(1 << 63)) for i in range(64) if not m >> i & 1)) for m in masks)), F.col("part") + 1)
    flips = F.concat(F.array(F.lit(0).cast("long")), free) if distance == 2 else F.array(F.lit(0).cast("long")) if distance == 0 else None
    if flips is None:  # one bit apart: the pair itself is one flip, met on the cleared bit with its position
        spots = large.select("bits", F.explode(free).alias("flip")).select("bits", F.struct(F.col("bits").bitwiseAND(F.bitwise_not(F.col("flip"))).alias("v"), "flip").alias("spot"))
    else:
        spots = large.select("bits", F.explode(flips).alias("flip")).select("bits", F.col("bits").bitwiseXOR(F.col("flip")).alias("spot"))
    spots = spots.distinct()
    meets = spots.groupBy("spot").agg(F.min("bits").alias("a"), F.count("*").alias("n")).filter("n > 1").drop("n")
    stars = spots.join(meets, "spot").filter(F.col("bits") > F.col("a")).select("a", F.col("bits").alias("b"))
    return pairs.unionByName(stars).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable over ``edges`` (a, b), by alternating large-star and small-star steps.

    Each step is a group-by with a minimum and a join back; it is written to the shared folder, so that lineage stays
    short. Only the count and a checksum of the links reach the driver.
    """
    now, seen = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct()), None
    while True:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select("b", "a"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).filter("a < b").distinct()
        down = large.select(F.col("b").alias("u"), F.col("a").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.col("m").alias("a"), F.explode(F.array("u", "v")).alias("b")).filter("a < b").distinct()
        now = written(small)
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            return now.select(F.col("b").alias("node"), F.col("a").alias("root"))
        seen = mark


def groups(classes: DataFrame, distance: int) -> DataFrame:
    """The distinct fingerprints ``classes.bits`` with their other columns and ``root``, the same for all that links join."""
    roots = components(links(classes.select("bits"), distance))
    return classes.join(roots, classes.bits == roots.node, "left").withColumn("root", F.coalesce("root", "bits")).drop("node")


def near_duplicates(docs: DataFrame, words_each: int = 3, distance: int = 2) -> DataFrame:
    """Per row: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable over links, itself included).

    Null and empty texts have fingerprint zero and are linked like any other. Rows with a null doc_id are returned and
    link, but never name a component unless no row of it has an id. Repeated rows are returned as often as they occur.
    """
    rows = written(fingerprints(docs, words_each))
    homes = groups(written(rows.groupBy("bits").agg(F.min("doc_id").alias("first"))), distance)
    least = homes.groupBy("root").agg(F.min("first").alias("component_id"))
    named = homes.join(least, "root").select("bits", "component_id")
    return rows.join(named, "bits").select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, words_each: int = 3, distance: int = 2) -> DataFrame:
    """The rows of ``docs``, with all their columns, that stay: one of each group of near-duplicates.

    It is the row with the smallest doc_id (null last); among rows that share it, the one with the smallest hash of all
    columns, whichever order they come in. Rows equal in every column are one row. Null and empty texts form one group.
    """
    keys = private(docs, "row_hash_a", "row_hash_b")
    hashed = [c for c in docs.columns if "map<" not in docs.schema[c].dataType.simpleString()]
    keyed = docs.withColumns({k: F.xxhash64(F.lit(k), *hashed) for k in keys})
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *keys)
    rows = written(fingerprints(keyed, words_each, ("doc_id", *keys)))
    homes = groups(written(rows.groupBy("bits").agg(F.min(rank).alias("best"))), distance)
    stay = homes.groupBy("root").agg(F.min("best").alias("best")).select(*(F.col(f"best.{k}").alias(k) for k in keys))
    return keyed.join(stay, keys, "left_semi").dropDuplicates(keys).select(*docs.columns)
