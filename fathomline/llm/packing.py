"""Mixture-controlled packing into fixed windows by deficit round-robin over source queues.

A queue holds its source's documents in order, cut into packets of at most one window. In every round a queue's deficit
grows by its quota (its target share of the window, in 1/65536 tokens); it sends packets while they fit, and what is left
stays for the next rounds. So packet ``p`` goes out in the round in which the quotas so far reach its end in the queue,
``ceil(end << 16 / quota)``: deficits are carried over windows in closed form, and every partition finds the rounds of its
own packets without a hand-over. Rounds are laid end to end (within a round by source) and windows cut from them, so none
has a gap and only the last one is padded. After any number of rounds a queue is less than one packet from its target,
while documents up to a window long stay whole but for the border of a window.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathomline.llm.common import bases, map_texts, written
from fathomline.llm.tokens import encoder

FRACTION = 16
#: Rows of a block that one task orders and numbers: documents of a queue, and rounds (one holds about a window).
BLOCK_ROWS, BLOCK_ROUNDS = 4096, 1024
PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, source string"


def token_table(docs: DataFrame, path: str, end_id: int = 0) -> DataFrame:
    """row (unique), doc_id, source, n_tokens, ids (little-endian unsigned 32-bit, the end id last), check (their crc32), written to the shared folder."""

    def make():
        own = encoder(path)

        def work(texts: list[str]) -> list:
            ids, edges = own.encode(texts)
            parts = [np.append(ids[a:b], end_id).astype("<u4").tobytes() for a, b in zip(edges, edges[1:], strict=False)]
            return [[len(p) // 4 for p in parts], pa.array(parts, pa.binary()), list(map(zlib.crc32, parts))]

        return work

    table = map_texts(docs, ["doc_id", "source"], "n_tokens bigint, ids binary, check bigint", make)
    return written(table.select(F.monotonically_increasing_id().alias("row"), "*"))


def rounds(table: DataFrame, window: int, targets: dict[str, float] | None) -> DataFrame:
    """Packets of the documents of ``token_table`` with their rounds: row, source, start, length, end (in the queue), round."""
    totals = table.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.ceil(F.count("*") / BLOCK_ROWS).alias("blocks"))
    given = targets or {}
    if given and min(given.values()) <= 0:
        raise ValueError("targets must be positive")
    everything = totals.agg(F.sum("tokens").alias("tokens")).first().tokens or 1
    weight = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for p in given.items() for x in p)), F.col("source")) if given else F.lit(None).cast("double"), F.col("tokens") / everything)
    weighed = totals.withColumn("weight", weight)
    whole = weighed.agg(F.sum("weight").alias("weight")).first().weight or 1.0
    quota = F.greatest(F.lit(1), F.floor(F.lit(float(window << FRACTION)) * F.col("weight") / whole)).cast("long")
    queues = weighed.select(F.col("source").alias("_queue"), "blocks", quota.alias("quota"))
    slim = table.select("row", "doc_id", "source", "n_tokens", "check")
    placed = slim.join(queues, F.col("source").eqNullSafe(F.col("_queue"))).withColumn("block", F.expr("pmod(xxhash64(row), blocks)")).drop("_queue", "blocks")
    begins = bases(placed.groupBy("source", "block").agg(F.sum("n_tokens").alias("tokens")), ["source"], "block", "tokens", "base").withColumnRenamed("source", "_queue").withColumnRenamed("block", "_block")
    order = Window.partitionBy("source", "block").orderBy(F.col("doc_id").asc_nulls_last(), "check", "row").rowsBetween(Window.unboundedPreceding, -1)
    lined = placed.withColumn("running", F.coalesce(F.sum("n_tokens").over(order), F.lit(0))).join(begins, F.col("source").eqNullSafe(F.col("_queue")) & (F.col("block") == F.col("_block")))
    cut = lined.select("row", "source", "quota", (F.col("base") + F.col("running")).alias("at"), "n_tokens", F.explode(F.expr(f"sequence(0L, n_tokens - 1, {window}L)")).alias("start"))
    length = F.least(F.lit(window).cast("long"), F.col("n_tokens") - F.col("start"))
    packets = cut.select("row", "source", "quota", "start", length.alias("length"), (F.col("at") + F.col("start") + length).alias("end"))
    # ceil(end * 65536 / quota) in whole numbers, exact beyond 2**47 tokens a queue
    number = F.expr(f"(end div quota << {FRACTION}) + ((end % quota << {FRACTION}) + quota - 1) div quota")
    return packets.select("row", "source", "start", "length", "end", number.alias("round"))


def places(packets: DataFrame) -> DataFrame:
    """(row, packets): the array of (start, length, place) of each document; ``place`` counts from the first round's first token."""
    blocked = packets.withColumn("block", F.expr(f"round div {BLOCK_ROUNDS}"))
    begins = bases(blocked.groupBy("block").agg(F.sum("length").alias("tokens")), [], "block", "tokens", "base")
    order = Window.partitionBy("block").orderBy("round", "source", "end").rowsBetween(Window.unboundedPreceding, -1)
    lined = blocked.withColumn("running", F.coalesce(F.sum("length").over(order), F.lit(0))).join(begins, "block")
    return lined.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "length", (F.col("base") + F.col("running")).alias("place")))).alias("packets"))


def pack(docs: DataFrame, path: str, window: int = 1024, targets: dict[str, float] | None = None, end_id: int = 0) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source.

    ``targets`` weighs sources against each other (default: their share of all tokens; sources it lacks keep that
    share); every source has a queue of its own. Null texts are empty and consist of the end id alone; a null source is
    a queue; rows with null or repeated doc_id are packed as they come; an empty table gives no piece; other columns are
    ignored. Only doc_id, source, length and checksum are ordered; the ids move once, to their packets.
    """
    table = token_table(docs, path, end_id)
    sent = places(rounds(table, window, targets)).withColumnRenamed("row", "_row")
    joined = table.join(sent.hint("shuffle_hash"), F.col("row") == F.col("_row")).select("doc_id", "source", "n_tokens", "ids", "packets")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                held = part.column("packets")
                of = np.repeat(np.arange(part.num_rows), held.value_lengths().to_numpy(zero_copy_only=False))
                start, size, place = (x.to_numpy(zero_copy_only=False) for x in held.flatten().flatten())
                head = np.minimum(size, window - place % window)
                two = np.flatnonzero(head < size)
                of, start = np.concatenate((of, of[two])), np.concatenate((start, (start + head)[two]))
                place, size = np.concatenate((place, (place + head)[two])), np.concatenate((head, (size - head)[two]))
                ids = part.column("ids").to_pylist()
                crc = [zlib.crc32(memoryview(ids[d])[4 * s : 4 * (s + m)]) for d, s, m in zip(of.tolist(), start.tolist(), size.tolist(), strict=True)]
                where = pa.array(of)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(where), *map(pa.array, (start, size, crc)), part.column("n_tokens").take(where), *map(pa.array, (place // window, place % window)), part.column("source").take(where)],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"],
                )

    return joined.mapInArrow(cut, PIECES)
