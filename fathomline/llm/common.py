"""Helpers that several operators share: the shared scratch folder, text batches and running sums over blocks."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathomline.functions.storage import shared_root

CHUNK_CHARS = 2_000_000


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder name below the folder that driver and executors share."""
    return f"{shared_root(spark)}/fathomline-{uuid.uuid4().hex}"


def written(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """``df`` as a table in the shared folder: its lineage ends there, so a lost executor costs no recomputation."""
    path = shared_dir(df.sparkSession)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def file_contents(spark: SparkSession, folder: str, pattern: str, manifest: DataFrame | None = None) -> DataFrame:
    """(file, content) of the files below ``folder``. One that ``manifest`` (file, ...) has and the folder has not is an error.

    Only names are listed for that; files which are not in the manifest are the caller's to leave out.
    """
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).withColumn("file", F.element_at(F.split("path", "/"), -1))
    if manifest is not None:
        lost = [r.file for r in manifest.select("file").join(found.select("file"), "file", "left_anti").limit(5).collect()]
        if lost:
            raise FileNotFoundError(f"files of the manifest are not in {folder}: {', '.join(lost)}")
    return found.select("file", "content")


def private(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` does not have, made of ``names``."""
    taken, tail = {c.lower() for c in df.columns}, ""
    while any(f"_{n}{tail}" in taken for n in names):
        tail += "_"
    return [f"_{n}{tail}" for n in names]


def ranges(texts: pa.Array, limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Row ranges of a column of texts that hold about ``limit`` characters each (one text at least)."""
    start, size = 0, 0
    for i, length in enumerate(pc.utf8_length(texts).to_pylist()):
        size += length or 0
        if size >= limit:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def map_texts(df: DataFrame, keep: list[str], schema: str, make: Callable[[], Callable[[list[str]], list]]) -> DataFrame:
    """Arrow map over (``keep`` columns, text): ``make()`` runs once a task and returns texts -> list of columns.

    ``schema`` names the columns that follow ``keep``. A null text counts as empty. One row comes out for each row in.
    """
    source = df.select(*keep, "text")
    full = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in source.schema.fields[:-1]) + ", " + schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for lo, hi in ranges(batch.column("text")):
                part = batch.slice(lo, hi - lo)
                made = work([x or "" for x in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *(x if isinstance(x, pa.Array) else pa.array(x) for x in made)], names=[*keep, *names])

    names = [x.split()[0] for x in schema.split(", ")]
    return source.mapInArrow(run, full)


def text_column(make: Callable[[], Callable[[list[str]], list]], kind: str):
    """A column function of a text for filters; ``make()`` runs once a task, texts come in lists of bounded size. Null counts as empty."""
    import pandas as pd
    from pyspark.sql.functions import pandas_udf

    def run(batches):
        work = make()
        for texts in batches:
            held = pa.array(texts, pa.string())
            made = [y for lo, hi in ranges(held) for y in work([x or "" for x in held.slice(lo, hi - lo).to_pylist()])]
            yield pd.Series(made, dtype={"double": float, "boolean": bool}[kind])

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return pandas_udf(run, kind)


def bases(sums: DataFrame, keys: list[str], block: str, value: str, name: str) -> DataFrame:
    """(``keys``, ``block``, ``name``): the sum of ``value`` over the key's smaller blocks, in two levels so that no task has all blocks."""
    tall = sums.withColumn("_tall", F.expr(f"{block} div 1024"))
    above = tall.groupBy(*keys, "_tall").agg(F.sum(value).alias("_sum"))
    ahead = lambda part, order: Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    none = [F.lit(0).alias("_all")] if not keys else []
    above = above.select("*", *none).withColumn("_base", F.coalesce(F.sum("_sum").over(ahead(keys or ["_all"], "_tall")), F.lit(0)))
    near = tall.withColumn("_near", F.coalesce(F.sum(value).over(ahead([*keys, "_tall"], block)), F.lit(0)))
    same = [F.col(f"_a.{k}").eqNullSafe(F.col(f"_b.{k}")) for k in [*keys, "_tall"]]
    joined = near.alias("_a").join(above.alias("_b"), on=same)
    return joined.select(*(F.col(f"_a.{k}") for k in [*keys, block]), (F.col("_near") + F.col("_base")).alias(name))
