"""JSON artifacts and traces: strict reading, canonical writing and append-only revisions."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_artifacts(spark: SparkSession, path: str) -> DataFrame:
    """(path, document) of JSON files; repeated keys and malformed text are errors when the document is used."""
    files = spark.read.text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.parse_json("value").alias("document"))


def strict(text: Column) -> Column:
    """The document, or null where the text repeats a key or is no JSON."""
    return F.try_parse_json(text)


def read_trace(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object a line; a bad line ends the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def canonical_json(value: Column) -> Column:
    """JSON text with sorted keys, an indent of two and a final line break; NaN and infinities are errors."""
    import pandas as pd
    from pyspark.sql.functions import pandas_udf

    def dumps(texts):
        return pd.Series([None if t is None else json.dumps(json.loads(t), sort_keys=True, indent=2, ensure_ascii=False, allow_nan=False) + "\n" for t in texts], dtype=object)

    dumps.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return pandas_udf(dumps, "string")(F.to_json(value, {"ignoreNullFields": "false"}))


def unknown_keys(text: Column, known: list[str]) -> Column:
    """Top-level keys that a closed schema does not have."""
    return F.array_except(F.json_object_keys(text), F.array(*map(F.lit, known)))


def append_revision(rows: DataFrame, path: str, revision: int) -> None:
    """Write one revision of a log; a revision that is there already is an error, so nothing is ever replaced."""
    rows.write.mode("errorifexists").parquet(f"{path}/state_revision={revision:06d}")


def read_revisions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("basePath", path).parquet(path)
