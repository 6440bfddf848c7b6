"""Python sources made of the orders' lines, nested functions and classes whose names, calls and parameters follow the columns; spans of bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.operators import audit, scopes, spans
from fathomline.plans.registry import query, table

#: Lines of an order as scopes: each is defined in the one before (the first in the module, 0), a class where it was returned,
#: and calls a name; a function of a large quantity has a parameter that may hide definitions.
_SCOPES = """
l AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag, l_quantity) AS i, 'f' || (l_partkey % 3) AS name, 'f' || (l_suppkey % 4) AS called, l_returnflag = 'R' AS is_class, l_returnflag <> 'R' AND l_quantity > 40 AS hides FROM lineitem),
b AS (SELECT k, i - 1 AS scope, name, i AS defined FROM l UNION ALL SELECT k, i, called, NULL FROM l WHERE hides),
o AS (SELECT k, scope, name, CASE WHEN count(*) = 1 THEN max(defined) END AS defined FROM b GROUP BY ALL),
q AS (SELECT k, i, string_agg(name, '.' ORDER BY i) OVER (PARTITION BY k ORDER BY i) AS symbol, is_class FROM l),
u AS (SELECT l.k, l.i, l.called, max(o.scope) AS owner FROM l LEFT JOIN o ON o.k = l.k AND o.name = l.called AND o.scope <= l.i AND (o.scope = l.i OR o.scope = 0 OR NOT (SELECT is_class FROM l x WHERE x.k = l.k AND x.i = o.scope)) GROUP BY ALL)"""


def order_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, text): a Python file for each order."""
    own = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_quantity", F.concat(F.lit("f"), F.expr("l_partkey % 3")).alias("name"), F.concat(F.lit("f"), F.expr("l_suppkey % 4")).alias("called"), (F.col("l_returnflag") == "R").alias("is_class"), (F.col("l_quantity") > 40).alias("large")).alias("l"))
    lined = own.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l")).alias("ls"))
    pad = lambda i: F.repeat(F.lit(" "), i)
    head = lambda x: F.when(x["is_class"], F.concat(F.lit("class "), x["name"], F.lit(":\n"))).otherwise(F.concat(F.lit("def "), x["name"], F.lit("("), F.when(x["large"], x["called"]).otherwise(""), F.lit("):\n")))
    text = F.array_join(F.transform("ls", lambda x, i: F.concat(pad(i), head(x), pad(i + 1), x["called"], F.lit("()\n"))), "")
    return lined.select(F.concat("l_orderkey", F.lit(".py")).alias("path"), text.alias("text"))


@query(f"""
WITH {_SCOPES}
SELECT u.k || '.py' AS path, q.symbol AS source, t.symbol AS target, CASE WHEN t.symbol IS NULL THEN 'name:' || u.called END AS unresolved, CAST(2 * u.i AS BIGINT) AS line
FROM u JOIN q ON q.k = u.k AND q.i = u.i LEFT JOIN o ON o.k = u.k AND o.scope = u.owner AND o.name = u.called LEFT JOIN q t ON t.k = u.k AND t.i = o.defined""")
def scope_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of nested functions and classes with the definition that each one means, by the rules of lexical scopes."""
    found = scopes.facts(scopes.rows(order_sources(spark, sf_dir))).filter("kind = 'CALL_CANDIDATE'")
    return found.select("path", "source", "target", "unresolved", F.col("line_start").alias("line"))


@query(r"""
WITH t AS (SELECT doc_id, replace(replace(coalesce(text, ''), '. ', '.' || chr(13) || chr(10)), ', ', ',' || chr(13)) AS text FROM documents),
s AS (SELECT doc_id, text, list_filter(string_split(regexp_replace(text, '(\r\n|\r|\n)', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS ls FROM t),
n AS (SELECT doc_id, text, ls, len(ls) AS n, len(ls) // 3 + 1 AS a, len(ls) // 2 + 1 AS b FROM s)
SELECT doc_id, CAST(n AS BIGINT) AS lines, CASE WHEN b <= n THEN CAST(strlen(array_to_string(ls[1:a - 1], '')) AS BIGINT) END AS begin, CASE WHEN b <= n THEN CAST(strlen(array_to_string(ls[a:b], '')) AS BIGINT) END AS bytes,
       CASE WHEN b <= n THEN sha256(array_to_string(ls[a:b], '')) END AS sha256 FROM n""")
def byte_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every document, with line ends of three kinds: the number of lines, and the bytes and digest of its middle lines."""
    text = F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit(". "), F.lit(".\r\n")), F.lit(", "), F.lit(",\r"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.encode(text, "UTF-8").alias("payload")).withColumn("lines", F.size(spans.byte_lines(F.col("payload"))).cast("long"))
    span = spans.byte_span(F.col("payload"), F.expr("lines div 3 + 1"), F.expr("lines div 2 + 1"))
    return docs.withColumn("span", span).select("doc_id", "lines", F.col("span.begin").cast("long").alias("begin"), F.octet_length("span.bytes").cast("long").alias("bytes"), F.sha2("span.bytes", 256).alias("sha256"))


@query("""
WITH d AS (SELECT doc_id AS k, CASE WHEN doc_id % 43 = 12 THEN '../' || doc_id ELSE source || '/' || doc_id || '.md' END AS path, doc_id % 11 <> 3 AS covered, doc_id % 29 <> 8 AS indexed FROM documents),
f AS (SELECT k, path, covered, indexed, indexed AND k % 31 <> 9 AND k % 43 <> 12 AS looked FROM d)
SELECT code, path FROM (
  SELECT 'UNSAFE_PATH' AS code, path FROM f WHERE k % 43 = 12 AND (covered OR indexed)
  UNION ALL SELECT 'PATH_SET_MISMATCH', path FROM f WHERE (covered <> indexed) OR NOT indexed
  UNION ALL SELECT 'CLASSIFICATION_POLICY_MISMATCH', path FROM f WHERE covered AND k % 23 = 7
  UNION ALL SELECT 'SURFACE_INVALID', path FROM f WHERE covered AND k % 19 = 6
  UNION ALL SELECT 'REASON_MISSING', path FROM f WHERE covered AND k % 7 = 2 AND k % 3 = 0
  UNION ALL SELECT 'UNKNOWN_REMAINS', path FROM f WHERE covered AND k % 7 = 2
  UNION ALL SELECT 'VCS_OBJECT_MISMATCH', path FROM f WHERE indexed AND k % 31 = 9
  UNION ALL SELECT 'CONTENT_KIND_MISMATCH', path FROM f WHERE indexed AND k % 37 = 10
  UNION ALL SELECT 'SNAPSHOT_FILE_MISSING', path FROM f WHERE looked AND k % 41 = 11
  UNION ALL SELECT 'SNAPSHOT_SIZE_MISMATCH', path FROM f WHERE looked AND k % 41 <> 11 AND k % 17 = 5
  UNION ALL SELECT 'SNAPSHOT_HASH_MISMATCH', path FROM f WHERE looked AND k % 41 <> 11 AND k % 17 <> 5 AND k % 13 = 4
  UNION ALL SELECT 'COUNT_MISMATCH', NULL UNION ALL SELECT 'UNKNOWN_COUNT_MISMATCH', NULL UNION ALL SELECT 'REVISION_MISMATCH', NULL)""")
def coverage_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: their index and coverage against the listing and the payloads, with defects of every kind."""
    k = F.col("doc_id")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.when(k % 43 == 12, F.concat(F.lit("../"), k)).otherwise(F.concat("source", F.lit("/"), k, F.lit(".md"))).alias("path"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("payload"))
    own = docs.select("doc_id", "path", F.octet_length("payload").cast("long").alias("byte_count"), F.sha2("payload", 256).alias("sha256"), F.sha1("payload").alias("object_id"))
    index = own.filter(k % 29 != 8).select("path", F.when(k % 31 == 9, "0").otherwise(F.col("object_id")).alias("object_id"), (F.col("byte_count") + (k % 17 == 5).cast("long")).alias("byte_count"), F.when(k % 13 == 4, "0").otherwise(F.col("sha256")).alias("sha256"), F.lit("text").alias("content_kind"), F.lit(True).alias("tracked"))
    unknown = k % 7 == 2
    coverage = own.filter(k % 11 != 3).select("path", F.when(unknown, "UNKNOWN").otherwise("CLASSIFIED").alias("classification"), F.lit("other").alias("surface"), F.when(k % 19 == 6, F.array(F.lit("other"))).otherwise(F.array(F.lit("docs"))).alias("secondary"), F.when(k % 23 == 7, "none").otherwise("rule").alias("rule_id"), F.when(unknown & (k % 3 > 0), "not yet").alias("reason"))
    truth = own.select("path", F.when(k % 37 == 10, "120000").otherwise("100644").alias("mode"), "object_id")
    payload = own.select("path", "byte_count", "sha256", F.when(k % 41 == 11, "MISSING").alias("problem"))
    return audit.coverage_findings(index, coverage, truth, payload, audit.Declared(-1, -1, -1, "a", "b", "a"), ["rule"], ["docs", "other"], complete=True)
