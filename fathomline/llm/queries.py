"""The queries, and the SQL of those that SQL can express: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fathomline.llm import ann, bpe, infill, jaccard, packing, quality, rangecoder, repetition, simhash, substring, toxicity, warc, whitening


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op6_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition(table(spark, sf_dir, "documents"))


def op7_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    done = substring.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "text", F.size("removed_spans").cast("long").alias("n_removed"), F.expr("aggregate(removed_spans, 0L, (n, x) -> n + x.end - x.begin)").alias("removed_chars"), "removed_spans")


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op9_rangecoder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rangecoder.round_trip(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.digests(table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deviations are longs here; one that no long can hold (from some hundred million vectors on) is null, the operator has them as decimals."""
    from pyspark.sql import functions as F

    rows = whitening.whiten(table(spark, sf_dir, "embeddings"))
    return rows.withColumn("deviation", F.col("deviation").try_cast("bigint"))


def op13_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_bpe, op2_quality, op3_packing, op4_warc, op5_toxicity, op6_repetition, op7_substring, op8_ann, op9_rangecoder, op10_simhash, op11_infill, op12_whitening, op13_jaccard)}

ORACLES = {
    "op11_infill": """
WITH hashed AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), cut AS (
  SELECT doc_id, text, length(text) - length(replace(text, chr(10), '')) + CASE WHEN text = '' OR text[-1] = chr(10) THEN 0 ELSE 1 END AS n,
         CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4
  FROM hashed
), ranked AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS low, greatest(h1 % (n + 1), h2 % (n + 1)) AS high, string_split(text, chr(10)) AS lines FROM cut
), placed AS (
  SELECT *, least(length(text), CASE WHEN low = 0 THEN 0 ELSE length(array_to_string(lines[1:low], chr(10))) + 1 END) AS a,
         least(length(text), CASE WHEN high = 0 THEN 0 ELSE length(array_to_string(lines[1:high], chr(10))) + 1 END) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM ranked
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form <> 'plain' THEN CAST(a AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(b - a AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text
                        WHEN 'psm' THEN '<P>' || substr(text, 1, CAST(a AS BIGINT)) || '<S>' || substr(text, CAST(b AS BIGINT) + 1) || '<M>' || substr(text, CAST(a AS BIGINT) + 1, CAST(b - a AS BIGINT))
                        ELSE '<S>' || substr(text, CAST(b AS BIGINT) + 1) || '<P>' || substr(text, 1, CAST(a AS BIGINT)) || '<M>' || substr(text, CAST(a AS BIGINT) + 1, CAST(b - a AS BIGINT)) END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM placed
""",
}
