"""Inventories, classification, reconciliation and reference audits over the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.functions import paths
from fathomline.functions.ids import stable_id, tuple_sha256
from fathomline.operators import classify, reconcile
from fathomline.plans.registry import query, table

#: Paths that the classification queries deal out to the documents, each with what must come out, written by hand:
#: path, rule, surface, classification, other surfaces, media type, content kind.
CASES = [
    ("vendor/zlib/inflate.c", "path:vendor", "vendor", "VENDOR", "", "text/x-c", "text"),
    ("Vendor/lib.c", "extension:known", "other", "CLASSIFIED", "", "text/x-c", "text"),
    ("vendor/.env", "safety:tracked-env", "environment", "IGNORED_WITH_REASON", "", "text/plain", "text"),
    ("web/dist/static/bundle.css", "path:generated", "generated", "GENERATED", "asset", "text/css", "text"),
    (".github/workflows/release.yaml", "name:ci", "ci", "CLASSIFIED", "tooling", "application/x-yaml", "text"),
    ("pkg/.github/workflows/x.yaml", "path:tooling", "tooling", "CLASSIFIED", "", "application/x-yaml", "text"),
    (".circleci/run.sh", "name:ci", "ci", "CLASSIFIED", "", "text/x-shellscript", "text"),
    ("Jenkinsfile", "name:ci", "ci", "CLASSIFIED", "", "text/x-groovy", "text"),
    ("deploy/Dockerfile.worker", "name:infrastructure", "infrastructure", "CLASSIFIED", "", "text/plain", "text"),
    ("images/base.dockerfile", "name:infrastructure", "infrastructure", "CLASSIFIED", "asset", "text/plain", "text"),
    ("charts/web/values.yaml", "name:infrastructure", "infrastructure", "CLASSIFIED", "", "application/x-yaml", "text"),
    ("k8s/db/seed/job.yaml", "name:infrastructure", "infrastructure", "CLASSIFIED", "database", "application/x-yaml", "text"),
    ("requirements-dev.txt", "name:lockfile", "lockfile", "CLASSIFIED", "", "text/plain", "text"),
    ("requirements.in", "fallback:unknown", "other", "UNKNOWN", "", "text/plain", "text"),
    ("conda/environment.lock", "name:lockfile", "lockfile", "CLASSIFIED", "", "text/plain", "text"),
    ("tools/mvnw", "name:build-wrapper", "build", "CLASSIFIED", "tooling", "text/plain", "text"),
    ("native/CMakeLists.txt", "name:build", "build", "CLASSIFIED", "", "text/x-cmake", "text"),
    ("lib/App.csproj", "name:build", "build", "CLASSIFIED", "", "text/plain", "text"),
    ("src/main/resources/application-dev.yml", "name:configuration", "configuration", "CLASSIFIED", "", "application/x-yaml", "text"),
    ("application-notes.md", "extension:known", "documentation", "CLASSIFIED", "", "text/markdown", "text"),
    ("config/logging.yaml", "name:configuration", "configuration", "CLASSIFIED", "", "application/x-yaml", "text"),
    ("settings/base.ini", "path:configuration", "configuration", "CLASSIFIED", "", "text/x-ini", "text"),
    (".env.sample", "name:environment", "environment", "CLASSIFIED", "", "text/plain", "text"),
    (".env.production", "safety:tracked-env", "environment", "IGNORED_WITH_REASON", "", "text/plain", "text"),
    (".envrc", "safety:tracked-env", "environment", "IGNORED_WITH_REASON", "", "text/plain", "text"),
    ("web/vite.config.mts", "name:tooling", "tooling", "CLASSIFIED", "", "text/typescript", "text"),
    ("acme.code-workspace", "name:tooling", "tooling", "CLASSIFIED", "", "text/plain", "text"),
    (".husky/pre-commit", "path:tooling", "tooling", "CLASSIFIED", "", "text/plain", "text"),
    ("release/app.tar.sha256", "extension:checksum", "asset", "CLASSIFIED", "", "text/plain", "text"),
    ("spec/fixtures/users.yml", "path:fixture", "fixture", "CLASSIFIED", "test", "application/x-yaml", "text"),
    ("db/migrations/0001_init.sql", "path:migration", "migration", "CLASSIFIED", "database", "text/x-sql", "text"),
    ("sql/V12__add_index.sql", "path:migration", "migration", "CLASSIFIED", "database", "text/x-sql", "text"),
    ("sql/v1_2__x.sql", "path:database", "database", "CLASSIFIED", "", "text/x-sql", "text"),
    ("src/test/java/org/acme/OrderIT.java", "path:test", "test", "CLASSIFIED", "", "text/x-java", "text"),
    ("api/handler_test.go", "path:test", "test", "CLASSIFIED", "api", "text/x-go", "text"),
    ("web/src/cart.spec.ts", "path:test", "test", "CLASSIFIED", "", "text/typescript", "text"),
    ("it_smoke.py", "path:test", "test", "CLASSIFIED", "", "text/x-python", "text"),
    ("src/latest.py", "path:test", "test", "CLASSIFIED", "", "text/x-python", "text"),
    ("src/Tests.cs", "path:test", "test", "CLASSIFIED", "", "text/x-csharp", "text"),
    ("docs/api/index.html", "path:documentation", "documentation", "CLASSIFIED", "api", "text/html", "text"),
    ("LICENSE", "path:documentation", "documentation", "CLASSIFIED", "", "text/plain", "text"),
    ("README", "path:documentation", "documentation", "CLASSIFIED", "", "text/plain", "text"),
    ("security.py", "extension:known", "other", "CLASSIFIED", "", "text/x-python", "text"),
    ("NOTICE.dat", "fallback:unknown", "other", "UNKNOWN", "", "text/plain", "text"),
    ("scripts/deploy.sh", "path:script", "script", "CLASSIFIED", "", "text/x-shellscript", "text"),
    ("cmd/server/main.go", "path:cli", "cli", "CLASSIFIED", "backend", "text/x-go", "text"),
    ("mcp-server/index.ts", "path:mcp", "mcp", "CLASSIFIED", "", "text/typescript", "text"),
    ("schemas/order.json", "path:database", "database", "CLASSIFIED", "", "application/json", "text"),
    ("public/favicon.ico", "path:asset", "asset", "CLASSIFIED", "", "image/vnd.microsoft.icon", "binary"),
    ("ui/views/logo.svg", "path:frontend", "frontend", "CLASSIFIED", "", "image/svg+xml", "text"),
    ("agents/pages/service/model.py", "path:frontend", "frontend", "CLASSIFIED", "agent,backend", "text/x-python", "text"),
    ("services/billing/app.rb", "path:backend", "backend", "CLASSIFIED", "", "text/x-ruby", "text"),
    ("shop/src/main/java/org/acme/Order.java", "path:backend", "backend", "CLASSIFIED", "", "text/x-java", "text"),
    ("shop/main/src/kotlin/Order.kt", "extension:known", "other", "CLASSIFIED", "", "text/x-kotlin", "text"),
    ("rest/routes.py", "path:api", "api", "CLASSIFIED", "", "text/x-python", "text"),
    ("core/entity/user.rs", "path:domain", "domain", "CLASSIFIED", "", "text/x-rust", "text"),
    ("rag/index.wasm", "path:agent", "agent", "CLASSIFIED", "", "application/wasm", "binary"),
    ("a.ts", "extension:known", "other", "CLASSIFIED", "", "text/typescript", "text"),
    ("notes.adoc", "extension:known", "documentation", "CLASSIFIED", "", "text/x-asciidoc", "text"),
    ("data.odd", "fallback:unknown", "other", "UNKNOWN", "", "text/plain", "text"),
]


def _quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


CASES_SQL = f"""
  SELECT doc_id, c.* EXCLUDE (spot) FROM documents JOIN (VALUES {", ".join(f"({i}, {_quoted(c)})" for i, c in enumerate(CASES))}) AS c(spot, path, rule_id, surface, classification, secondary, media, kind) ON spot = doc_id % {len(CASES)}"""
_PATHS_SQL = f"SELECT doc_id, path, string_split(path, '/')[1:-2] AS dirs FROM ({CASES_SQL})"


def sample_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = F.array(*(F.lit(c[0]) for c in CASES))
    return table(spark, sf_dir, "documents").select("doc_id", F.element_at(listed, (F.col("doc_id") % len(CASES) + 1).cast("int")).alias("path"))


@query(f"SELECT doc_id, path, rule_id, surface, classification, secondary, CASE WHEN classification IN ('CLASSIFIED', 'UNKNOWN') THEN 'LOCATED' ELSE 'NOT_APPLICABLE' END AS teaching FROM ({CASES_SQL})")
def classify_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered rules over file paths: first match, classification, other surfaces and teaching status."""
    done = classify.classified(sample_files(spark, sf_dir)).withColumn("secondary", F.array_join("secondary", ","))
    return done.withColumn("teaching", classify.teaching_status(F.col("classification")))


@query(f"""
SELECT rule_id, surface, secondary, count(*) AS files, count(*) FILTER (classification = 'UNKNOWN') AS unknown FROM (
  SELECT CASE WHEN doc_id % 5 = 0 THEN 'override:exact-path' ELSE rule_id END AS rule_id, CASE WHEN doc_id % 5 = 0 THEN 'tooling' ELSE surface END AS surface,
    CASE WHEN doc_id % 5 = 0 THEN '' ELSE secondary END AS secondary, CASE WHEN doc_id % 5 = 0 THEN 'CLASSIFIED' ELSE classification END AS classification FROM ({CASES_SQL})) GROUP BY ALL""")
def classify_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An exact-path override wins over all rules and leaves no other surface."""
    files = sample_files(spark, sf_dir)
    given = files.filter("doc_id % 5 = 0").select("doc_id", F.struct(F.lit("tooling").alias("surface"), F.lit("CLASSIFIED").alias("classification")).alias("given"))
    done = classify.classified(files.join(given, "doc_id", "left"), override="given")
    return done.groupBy("rule_id", "surface", F.array_join("secondary", ",").alias("secondary")).agg(F.count("*").alias("files"), F.count_if(F.col("classification") == "UNKNOWN").alias("unknown"))


@query(r"""
WITH o AS (SELECT CASE WHEN doc_id % 41 = 0 THEN '../d' || doc_id WHEN doc_id % 37 = 0 THEN './d/1' ELSE 'd/' || doc_id END AS raw,
    CASE WHEN quality = 0 THEN 'kernel' ELSE 'test' END AS surface, CASE WHEN toxic = 1 THEN 'UNKNOWN' ELSE 'VENDOR' END AS classification, CASE WHEN doc_id % 11 = 0 THEN ' ' ELSE 'seen' END AS reason FROM labels),
p AS (SELECT *, CASE WHEN raw LIKE '../%' THEN '' ELSE regexp_replace(raw, '^\./', '') END AS path FROM o)
SELECT path, CASE WHEN path = '' THEN 'PATH_UNSAFE' WHEN surface = 'kernel' THEN 'SURFACE_UNKNOWN' WHEN classification = 'UNKNOWN' THEN 'CLASSIFICATION_NOT_ALLOWED' ELSE 'REASON_EMPTY' END AS code FROM p
  WHERE path = '' OR surface = 'kernel' OR classification = 'UNKNOWN' OR reason = ' '
UNION ALL SELECT path, 'PATH_REPEATED' FROM p WHERE path <> '' GROUP BY path HAVING count(*) > 1
UNION ALL SELECT DISTINCT path, 'PATH_NOT_TRACKED' FROM p WHERE path <> '' AND path NOT IN (SELECT 'd/' || doc_id FROM documents WHERE doc_id % 13 <> 0)""")
def override_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overrides that cannot be used: values, reasons, unsafe, repeated and untracked paths."""
    key = F.col("doc_id")
    raw = F.when(key % 41 == 0, F.concat(F.lit("../d"), key)).when(key % 37 == 0, F.lit("./d/1")).otherwise(F.concat(F.lit("d/"), key))
    given = table(spark, sf_dir, "labels").select(
        raw.alias("path"), F.when(F.col("quality") == 0, "kernel").otherwise("test").alias("surface"), F.when(F.col("toxic") == 1, "UNKNOWN").otherwise("VENDOR").alias("classification"), F.when(key % 11 == 0, " ").otherwise("seen").alias("reason")
    )
    tracked = table(spark, sf_dir, "documents").filter("doc_id % 13 <> 0").select(F.concat(F.lit("d/"), "doc_id").alias("path"))
    return classify.override_findings(given, tracked)


@query(f"SELECT media, kind, count(*) AS files FROM ({CASES_SQL}) GROUP BY media, kind")
def media_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Media type by name and extension, and the content kind that follows."""
    media = sample_files(spark, sf_dir).select(classify.media_type(F.col("path")).alias("media"))
    return media.withColumn("kind", classify.content_kind(F.col("media"))).groupBy("media", "kind").agg(F.count("*").alias("files"))


@query(f"""
SELECT doc_id, substr(full_path, length('repo/src') + 1) AS below, regexp_replace(replace(regexp_replace(path, '\\.py$', ''), '/', '.'), '(^|\\.)__init__$', '') AS module, len(string_split(path, '/')) AS parents
FROM (SELECT doc_id, path, 'repo/' || source || '/' || path AS full_path FROM ({_PATHS_SQL}) JOIN documents USING (doc_id)) WHERE full_path LIKE 'repo/src1/%'""")
def paths_under_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefix filter on whole components, rebased paths, module names and the number of directories above."""
    files = sample_files(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    full = files.withColumn("full_path", F.concat(F.lit("repo/"), "source", F.lit("/"), "path")).filter(paths.is_under(F.col("full_path"), "repo/src1"))
    below = F.concat(F.lit("1/"), paths.rebased(F.col("full_path"), "repo/src1"))
    return full.select("doc_id", below.alias("below"), paths.module_name(F.col("path")).alias("module"), F.size(paths.ancestors(F.col("path"))).cast("long").alias("parents"))


@query("SELECT doc_id, sha256(text) AS sha256, strlen(text) AS bytes, substr(text, 1, 64) AS sample FROM documents")
def inventory_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content digest, size and sample of every text."""
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("bytes"), F.substring("text", 1, 64).alias("sample"))


@query("""
SELECT sha256(text) AS key, count(*) AS copies, array_to_string(list_sort(list(DISTINCT source)), ',') AS members
FROM documents GROUP BY text HAVING count(*) > 1""")
def evidence_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal contents merged, with the sorted sources that have them."""
    own = reconcile.fold(table(spark, sf_dir, "documents"), F.sha2("text", 256), F.col("source"))
    return own.filter("copies > 1").select("key", "copies", F.array_join("members", ",").alias("members"))


@query("""
SELECT p_name, count(*) AS copies, count(DISTINCT p_brand || '|' || p_type) AS payloads, count(DISTINCT p_brand || '|' || p_type) > 1 AS conflict
FROM part GROUP BY p_name""")
def conflict_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal ids merge when their payloads agree and conflict when they do not."""
    return reconcile.conflicts(table(spark, sf_dir, "part"), "p_name", F.concat_ws("|", "p_brand", "p_type"))


@query("""
SELECT doc_id, 'left' AS side FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)
UNION ALL SELECT doc_id, 'right' FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)""")
def reconcile_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that only one of two inventories has."""
    return reconcile.differences(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"])


@query("""
SELECT side, count(*) AS missing, array_to_string(list_sort(list(doc_id))[1:5], ',') AS first_five FROM (
  SELECT doc_id, 'left' AS side FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)
  UNION ALL SELECT doc_id, 'right' FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)) GROUP BY side""")
def reconcile_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of both differences and their five smallest ids; the ids are ranked, not collected."""
    from pyspark.sql import Window

    found = reconcile.differences(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"])
    counts = found.groupBy("side").agg(F.count("*").alias("missing"))
    low = found.withColumn("_at", F.row_number().over(Window.partitionBy("side").orderBy("doc_id"))).filter("_at <= 5")
    named = low.groupBy("side").agg(F.array_join(F.array_sort(F.collect_list("doc_id")), ",").alias("first_five"))
    return counts.join(named, "side").select("side", "missing", "first_five")


@query("""
WITH a AS (SELECT doc_id, sha256(text) AS sha, length(text) AS size FROM documents WHERE doc_id % 7 <> 0),
b AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN sha256(text || 'x') ELSE sha256(text) END AS sha, CASE WHEN doc_id % 13 = 0 THEN n_chars + 1 ELSE n_chars END AS size FROM documents WHERE doc_id % 5 <> 0)
SELECT doc_id, CASE WHEN a.sha IS NULL THEN 'missing_left' WHEN b.sha IS NULL THEN 'missing_right' WHEN a.sha <> b.sha OR a.size <> b.size THEN 'changed' ELSE 'same' END AS status,
  CASE WHEN a.sha IS NULL OR b.sha IS NULL THEN '' ELSE concat_ws(',', CASE WHEN a.sha <> b.sha THEN 'sha' END, CASE WHEN a.size <> b.size THEN 'size' END) END AS changed
FROM a FULL JOIN b USING (doc_id)""")
def payload_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded against rescanned content: missing on a side, changed digest or size."""
    docs = table(spark, sf_dir, "documents")
    a = docs.filter("doc_id % 7 <> 0").select("doc_id", F.sha2("text", 256).alias("sha"), F.length("text").cast("long").alias("size"))
    b = docs.filter("doc_id % 5 <> 0").select(
        "doc_id", F.when(F.expr("doc_id % 11 = 0"), F.sha2(F.concat("text", F.lit("x")), 256)).otherwise(F.sha2("text", 256)).alias("sha"), (F.col("n_chars") + F.expr("int(doc_id % 13 = 0)")).alias("size")
    )
    return reconcile.mismatches(a, b, ["doc_id"], ["sha", "size"]).withColumn("changed", F.array_join("changed", ","))


@query("""
SELECT 'ORDER_CUSTOMER' AS code, CAST(o_orderkey AS VARCHAR) AS key FROM orders WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 0)
UNION ALL SELECT 'LINE_ORDER', l_orderkey || ':' || l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 50 <> 0)
UNION ALL SELECT 'LINE_PART', l_orderkey || ':' || l_linenumber FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part)
UNION ALL SELECT 'SUPPLIER_NATION', CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_nationkey <> 3)
UNION ALL SELECT 'NATION_REGION', CAST(n_nationkey AS VARCHAR) FROM nation WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region)""")
def reference_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References without a target, one violation row each (some targets are left out so that there are some)."""
    t = lambda name: table(spark, sf_dir, name)
    line = F.concat_ws(":", "l_orderkey", "l_linenumber")
    return reconcile.audit(
        reconcile.orphans(t("orders"), t("customer").filter("c_custkey % 10 <> 0"), "o_custkey", "c_custkey", "ORDER_CUSTOMER", F.col("o_orderkey")),
        reconcile.orphans(t("lineitem"), t("orders").filter("o_orderkey % 50 <> 0"), "l_orderkey", "o_orderkey", "LINE_ORDER", line),
        reconcile.orphans(t("lineitem"), t("part"), "l_partkey", "p_partkey", "LINE_PART", line),
        reconcile.orphans(t("supplier"), t("nation").filter("n_nationkey <> 3"), "s_nationkey", "n_nationkey", "SUPPLIER_NATION", F.col("s_suppkey")),
        reconcile.orphans(t("nation"), t("region"), "n_regionkey", "r_regionkey", "NATION_REGION", F.col("n_nationkey")),
    )


@query("""
WITH v AS (SELECT o_custkey AS k, list_distinct(list(CASE WHEN o_totalprice > 400000 THEN 'PRICE_LIMIT' WHEN o_orderstatus = 'P' THEN 'STATUS_OPEN' END)) AS codes FROM orders GROUP BY o_custkey)
SELECT CASE WHEN len(list_filter(codes, lambda x: x IS NOT NULL)) = 0 THEN 'PASS' WHEN list_contains(codes, 'PRICE_LIMIT') THEN 'FAIL' ELSE 'PARTIAL' END AS status, count(*) AS customers FROM v GROUP BY 1""")
def audit_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PASS, PARTIAL or FAIL from the set of violation codes of a group."""
    code = F.when(F.col("o_totalprice") > 400000, "PRICE_LIMIT").when(F.col("o_orderstatus") == "P", "STATUS_OPEN")
    own = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set(code).alias("codes"))
    return own.groupBy(reconcile.severity(F.col("codes"), ["PRICE_LIMIT"]).alias("status")).agg(F.count("*").alias("customers"))


@query("""
SELECT doc_id, 'FILE-' || substr(sha256('["' || source || '","' || lang || '"]'), 1, 24) AS file_id, sha256('["DOC",null,"' || lang || '"]') AS tuple_sha, 'unit-' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 16) AS anchor FROM documents""")
def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers from digests of canonical tuples."""
    anchor = F.concat(F.lit("unit-"), F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 16))
    return table(spark, sf_dir, "documents").select("doc_id", stable_id("FILE", F.col("source"), F.col("lang")).alias("file_id"), tuple_sha256(F.lit("DOC"), F.lit(None).cast("string"), F.col("lang")).alias("tuple_sha"), anchor.alias("anchor"))


@query("""
SELECT count(*) AS indexed, count(l.doc_id) AS entries, count(*) FILTER (l.quality IS NULL) AS unknown, greatest(0, count(*) - count(*) FILTER (l.quality IS NULL)) AS covered, count(*) FILTER (l.quality = 0) AS violations
FROM documents d LEFT JOIN labels l USING (doc_id)""")
def coverage_measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indexed, entered, unknown and covered rows, and violations."""
    joined = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").withColumn("_entry", F.lit(1)), "doc_id", "left")
    unknown = F.count_if(F.col("quality").isNull())
    return joined.agg(F.count("*").alias("indexed"), F.count("_entry").alias("entries"), unknown.alias("unknown"), F.greatest(F.lit(0), F.count("*") - unknown).alias("covered"), F.count_if(F.col("quality") == 0).alias("violations"))


@query("""
SELECT lang, source, count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY lang, source ORDER BY lang, source""")
def canonical_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in canonical order."""
    return table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("files"), F.sum("n_chars").alias("chars")).orderBy("lang", "source")


@query("""
SELECT kind, count(*) AS ids FROM (
  SELECT 'both' AS kind, doc_id FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels)
  UNION ALL SELECT 'any', doc_id FROM (SELECT doc_id FROM documents UNION SELECT item_id FROM benchmark)) GROUP BY kind""")
def id_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intersection and union of id sets."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    both = docs.intersect(table(spark, sf_dir, "labels").select("doc_id")).withColumn("kind", F.lit("both"))
    either = docs.union(table(spark, sf_dir, "benchmark").select("item_id")).distinct().withColumn("kind", F.lit("any"))
    return both.unionByName(either).groupBy("kind").agg(F.count("*").alias("ids"))
