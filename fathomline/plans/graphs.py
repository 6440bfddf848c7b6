"""Graphs and claims over the supplied tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathomline.functions import paths
from fathomline.operators import claims, graph, order, project
from fathomline.plans.registry import query, table

#: The containment of regions, nations, customers and suppliers as (src, dst) names.
_EDGES = """
SELECT 'region:' || n_regionkey AS src, 'nation:' || n_nationkey AS dst FROM nation
UNION ALL SELECT 'nation:' || c_nationkey, 'customer:' || c_custkey FROM customer
UNION ALL SELECT 'nation:' || s_nationkey, 'supplier:' || s_suppkey FROM supplier"""


def containment_edges_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    def of(name: str, parent: str, parent_key: str, child: str, child_key: str) -> DataFrame:
        return table(spark, sf_dir, name).select(F.concat(F.lit(f"{parent}:"), parent_key).alias("src"), F.concat(F.lit(f"{child}:"), child_key).alias("dst"))

    return reduce(DataFrame.union, (of("nation", "region", "n_regionkey", "nation", "n_nationkey"), of("customer", "nation", "c_nationkey", "customer", "c_custkey"), of("supplier", "nation", "s_nationkey", "supplier", "s_suppkey")))


@query(f"""
SELECT 'EDGE-' || substr(sha256('["CONTAINS","' || src || '","' || dst || '","tables"]'), 1, 24) AS id, 'CONTAINS' AS type, src, dst, 'VERIFIED' AS certainty FROM ({_EDGES})""")
def containment_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CONTAINS edges with content-addressed ids."""
    return graph.containment(containment_edges_table(spark, sf_dir), F.col("src"), F.col("dst"), F.lit("tables"))


@query(f"""
WITH RECURSIVE e AS ({_EDGES}), c AS (SELECT src, dst, 1 AS depth FROM e UNION ALL SELECT c.src, e.dst, c.depth + 1 FROM c JOIN e ON e.src = c.dst)
SELECT src, dst, CAST(min(depth) AS BIGINT) AS depth FROM c GROUP BY src, dst""")
def closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transitive closure with the smallest depth."""
    return graph.closure(containment_edges_table(spark, sf_dir))


#: A prerequisite graph: a part needs the parts at half and at a third of its key.
_NEEDS = "SELECT p_partkey // 2 AS src, p_partkey AS dst FROM part WHERE p_partkey > 1 UNION SELECT p_partkey // 3, p_partkey FROM part WHERE p_partkey > 2"


def part_needs(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return part.filter("p_partkey > 1").selectExpr("p_partkey div 2 AS src", "p_partkey AS dst").union(part.filter("p_partkey > 2").selectExpr("p_partkey div 3", "p_partkey")).distinct()


@query(f"""
WITH RECURSIVE e AS ({_NEEDS}), l AS (SELECT p_partkey AS node, 0 AS level FROM part UNION ALL SELECT e.dst, l.level + 1 FROM l JOIN e ON e.src = l.node)
SELECT node, CAST(max(level) AS BIGINT) AS level FROM l GROUP BY node""")
def dependency_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level of each node: the longest chain of prerequisites below it."""
    return graph.levels(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node")), part_needs(spark, sf_dir))


@query(f"SELECT dst AS concept, array_to_string(list_sort(list(src)), ',') AS needs FROM ({_NEEDS}) GROUP BY dst")
def prerequisite_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sorted direct prerequisites."""
    return part_needs(spark, sf_dir).groupBy(F.col("dst").alias("concept")).agg(F.array_join(F.array_sort(F.collect_list("src")), ",").alias("needs"))


@query(f"""
WITH RECURSIVE e AS ({_NEEDS}), b AS (SELECT p_partkey AS node FROM part WHERE p_size = 7 UNION SELECT e.dst FROM b JOIN e ON e.src = b.node)
SELECT p_partkey AS node, p_partkey IN (SELECT node FROM b) AS blocked FROM part""")
def blocked_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks handed on to everything that depends on a blocked node."""
    nodes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), "p_size")
    return graph.blocked(nodes, part_needs(spark, sf_dir), F.col("p_size") == 7)


@query(f"""
WITH RECURSIVE e AS ({_NEEDS}), c AS (SELECT src, dst FROM e UNION SELECT c.src, e.dst FROM c JOIN e ON e.src = c.dst),
w AS (SELECT p_partkey AS unit, p_size * 1000000 + p_partkey AS position FROM part)
SELECT min(position) AS position, concept FROM (SELECT unit, unit AS concept FROM w UNION SELECT w.unit, c.src FROM w JOIN c ON c.dst = w.unit) JOIN w USING (unit) GROUP BY concept""")
def primers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concepts to introduce just before the first unit that needs them; units stand in order of size."""
    units = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("unit"), F.expr("p_size * 1000000 + p_partkey").alias("position"))
    return graph.primers(units, units.select("unit", F.col("unit").alias("concept")), part_needs(spark, sf_dir))


@query(f"""
WITH RECURSIVE e AS ({_NEEDS}), l AS (SELECT p_partkey AS node, 0 AS level FROM part UNION ALL SELECT e.dst, l.level + 1 FROM l JOIN e ON e.src = l.node),
m AS (SELECT node, CAST(max(level) AS BIGINT) AS level FROM l GROUP BY node)
SELECT node, level, row_number() OVER (ORDER BY level, node) AS position FROM m""")
def dependency_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A total order of the nodes behind their prerequisites: by level, then key."""
    return graph.ordered(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node")), part_needs(spark, sf_dir))


#: The prerequisites, and for some parts an edge back to an ancestor.
_LOOPED = f"{_NEEDS} UNION SELECT p_partkey, p_partkey // 4 FROM part WHERE p_partkey % 97 = 0"


@query(f"""
WITH RECURSIVE e AS ({_LOOPED}), c AS (SELECT src, dst FROM e UNION SELECT c.src, e.dst FROM c JOIN e ON e.src = c.dst)
SELECT DISTINCT src AS node FROM c WHERE src = dst""")
def acyclic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes on a cycle; a valid graph has none, this one has some."""
    back = table(spark, sf_dir, "part").filter("p_partkey % 97 = 0").selectExpr("p_partkey AS src", "p_partkey div 4 AS dst")
    return graph.cyclic(part_needs(spark, sf_dir).union(back))


_CITED = "SELECT l_orderkey AS claim, l_suppkey AS ref FROM lineitem"
#: Every 31st supplier stands for evidence of two levels.
_EVIDENCE = """SELECT s_suppkey AS id, CASE WHEN s_suppkey % 31 = 5 THEN NULL WHEN s_suppkey % 9 = 0 THEN 'E6' ELSE 'E' || (s_suppkey % 6) END AS level, s_suppkey % 31 = 5 AS conflict FROM supplier WHERE s_suppkey % 23 <> 0"""
_RESOLVED = f"r AS (SELECT c.claim, c.ref, e.level, e.level IS NOT NULL AS resolved, CASE WHEN e.conflict THEN 'EVIDENCE_CONFLICT' WHEN e.level IS NULL THEN 'EVIDENCE_NOT_FOUND' END AS reason FROM ({_CITED}) c LEFT JOIN ({_EVIDENCE}) e ON e.id = c.ref)"
_OWN = "g AS (SELECT claim, count(*) AS refs, bool_and(resolved) AS all_resolved, bool_or(coalesce(level IN ('E0','E1','E2','E3','E4','E5'), false)) AS qualified, bool_or(coalesce(level = 'E6', false)) AS provisional FROM r GROUP BY claim), o AS (SELECT o_orderkey AS claim, coalesce(refs, 0) AS refs, coalesce(all_resolved, true) AS all_resolved, coalesce(qualified, false) AS qualified, coalesce(provisional, false) AS provisional FROM orders LEFT JOIN g ON claim = o_orderkey)"


def resolved_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    cited = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("claim"), F.col("l_suppkey").alias("ref"))
    level = F.when(F.col("s_suppkey") % 9 == 0, "E6").otherwise(F.concat(F.lit("E"), F.col("s_suppkey") % 6))
    given = table(spark, sf_dir, "supplier").filter("s_suppkey % 23 <> 0").select(F.col("s_suppkey").alias("id"), level.alias("level"))
    return claims.resolve(cited, given.union(given.filter("id % 31 = 5").select("id", F.lit("E9"))))


def all_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("claim"))


@query(f"WITH {_RESOLVED} SELECT coalesce(level, 'none') AS level, resolved, reason, count(*) AS citations FROM r GROUP BY ALL")
def citation_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations with their evidence's level, or the reason why they do not resolve."""
    return resolved_citations(spark, sf_dir).groupBy(F.coalesce("level", F.lit("none")).alias("level"), "resolved", "reason").agg(F.count("*").alias("citations"))


@query(f"WITH {_RESOLVED}, {_OWN} SELECT *, CASE WHEN NOT all_resolved THEN 'UNVERIFIED' WHEN provisional THEN 'INFERENCE' WHEN qualified THEN 'SUPPORTED' ELSE 'UNVERIFIED' END AS disposition FROM o")
def claim_dispositions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strict dispositions: provisional evidence makes an inference."""
    return claims.dispositions(resolved_citations(spark, sf_dir), claims=all_claims(spark, sf_dir))


@query(f"WITH {_RESOLVED}, {_OWN} SELECT *, CASE WHEN NOT all_resolved THEN 'UNVERIFIED' WHEN qualified THEN 'SUPPORTED' WHEN provisional THEN 'INFERENCE' ELSE 'UNVERIFIED' END AS disposition FROM o")
def claim_dispositions_lenient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dispositions where qualifying evidence supports whatever else is cited."""
    return claims.dispositions(resolved_citations(spark, sf_dir), strict=False, claims=all_claims(spark, sf_dir))


@query(f"""
WITH {_RESOLVED}, {_OWN}, d AS (SELECT *, CASE WHEN NOT all_resolved THEN 'UNVERIFIED' WHEN provisional THEN 'INFERENCE' WHEN qualified THEN 'SUPPORTED' ELSE 'UNVERIFIED' END AS disposition FROM o)
SELECT count(*) AS claims, count(*) FILTER (disposition = 'SUPPORTED') AS supported, CASE WHEN bool_or(NOT all_resolved OR (claim % 5 = 0 AND disposition <> 'SUPPORTED')) THEN 'FAIL' WHEN bool_or(disposition <> 'SUPPORTED') THEN 'PARTIAL' ELSE 'PASS' END AS status FROM d""")
def claim_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of all claims; every fifth is critical."""
    return claims.status(claims.dispositions(resolved_citations(spark, sf_dir), claims=all_claims(spark, sf_dir)), F.col("claim") % 5 == 0)


@query("""
WITH c AS (SELECT DISTINCT l_orderkey AS claim, l_suppkey * 100 + l_linenumber AS ref FROM lineitem),
u AS (SELECT DISTINCT l_partkey AS unit, l_suppkey * 100 + l_linenumber AS ref FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 40),
j AS (SELECT claim, min(unit) AS low, max(unit) AS high FROM c JOIN u USING (ref) GROUP BY claim)
SELECT claim, CASE WHEN low = high THEN low END AS unit, CASE WHEN low IS NULL THEN 'NONE' WHEN low = high THEN 'MATCHED' ELSE 'AMBIGUOUS' END AS verdict FROM (SELECT DISTINCT claim FROM c) LEFT JOIN j USING (claim)""")
def claim_unit_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every claim the unit that shares a reference with it, or that there is none or more than one."""
    lines = table(spark, sf_dir, "lineitem").withColumn("ref", F.col("l_suppkey") * 100 + F.col("l_linenumber"))
    left = lines.groupBy(F.col("l_orderkey").alias("claim")).agg(F.collect_set("ref").alias("refs"))
    right = lines.filter("l_returnflag = 'R' AND l_quantity > 40").groupBy(F.col("l_partkey").alias("unit")).agg(F.collect_set("ref").alias("refs"))
    return claims.overlap_verdicts(left, right, "claim", "unit", "refs")


@query("""
WITH cited AS (SELECT DISTINCT l_orderkey AS claim, l_partkey AS item FROM lineitem), items AS (SELECT DISTINCT p_partkey AS item, CASE WHEN p_partkey % 35 = 0 THEN NULL ELSE p_partkey % 10 + k END AS ref FROM part, (VALUES (0), (1)) v(k) WHERE p_partkey % 5 = 0),
refs AS (SELECT DISTINCT l_orderkey AS claim, l_suppkey % 12 AS ref FROM lineitem)
SELECT claim, item, count(*) AS missing FROM cited JOIN items USING (item) WHERE NOT EXISTS (SELECT 1 FROM refs WHERE refs.claim = cited.claim AND refs.ref = items.ref) GROUP BY claim, item""")
def provisional_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims that cite a provisional item (every fifth part is one) without all the evidence behind it."""
    lines, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part").filter("p_partkey % 5 = 0")
    items = part.select(F.col("p_partkey").alias("item"), F.explode(F.array(F.lit(0), F.lit(1))).alias("k")).select("item", F.when(F.col("item") % 35 != 0, F.col("item") % 10 + F.col("k")).alias("ref"))
    cited = lines.select(F.col("l_orderkey").alias("claim"), F.col("l_partkey").alias("item"))
    return claims.uncited_provisional(cited, items, lines.select(F.col("l_orderkey").alias("claim"), (F.col("l_suppkey") % 12).alias("ref")))


@query("""
WITH n AS (SELECT c_custkey AS node, CASE WHEN c_custkey % 4 = 0 THEN 'GENERAL_LEARNING' ELSE 'PROJECT_SPECIFIC' END AS scope, CASE WHEN c_custkey % 3 = 0 THEN 'E6_PROVISIONAL' ELSE 'UNVERIFIED_TEACHING' END AS status FROM customer),
l AS (SELECT DISTINCT o_custkey AS node, o_orderkey % 40 AS ref FROM orders WHERE o_orderpriority < '3'), c AS (SELECT DISTINCT o_custkey AS node, o_orderkey % 40 AS ref FROM orders WHERE o_orderpriority < '4'),
v AS (SELECT node, bool_and(sides = 3) AS same, bool_or(sides >= 2) AS cited FROM (SELECT node, ref, sum(side) AS sides FROM (SELECT *, 1 AS side FROM l UNION ALL SELECT *, 2 FROM c) WHERE ref % 7 = 0 GROUP BY node, ref) GROUP BY node),
r AS (SELECT DISTINCT node FROM (SELECT node FROM l UNION ALL SELECT node FROM c)),
x AS (SELECT n.node, CASE WHEN scope = 'GENERAL_LEARNING' THEN CASE WHEN r.node IS NOT NULL OR status <> 'UNVERIFIED_TEACHING' THEN 'REFERENCE_MISSING' END WHEN r.node IS NULL THEN 'REFERENCE_MISSING'
  WHEN NOT coalesce(same, true) OR status <> CASE WHEN coalesce(cited, false) THEN 'E6_PROVISIONAL' ELSE 'UNVERIFIED_TEACHING' END THEN 'E6_LINK_INVALID' END AS code FROM n LEFT JOIN v USING (node) LEFT JOIN r ON r.node = n.node)
SELECT node, code FROM x WHERE code IS NOT NULL""")
def linkage_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes whose provisional evidence, references and status do not go together."""
    key = F.col("c_custkey")
    nodes = table(spark, sf_dir, "customer").select(key.alias("node"), F.when(key % 4 == 0, "GENERAL_LEARNING").otherwise("PROJECT_SPECIFIC").alias("scope"), F.when(key % 3 == 0, "E6_PROVISIONAL").otherwise("UNVERIFIED_TEACHING").alias("status"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("node"), (F.col("o_orderkey") % 40).alias("ref"), "o_orderpriority")
    evidence = spark.range(40).select("id", F.when(F.col("id") % 7 == 0, "E6").otherwise("E1").alias("level"))
    return claims.linkage_findings(nodes, orders.filter("o_orderpriority < '3'").select("node", "ref"), orders.filter("o_orderpriority < '4'").select("node", "ref"), evidence)


@query("""
WITH o AS (SELECT l_suppkey AS ref, count(DISTINCT l_orderkey) AS claims FROM lineitem GROUP BY l_suppkey), u AS (SELECT l_suppkey AS ref, count(DISTINCT l_partkey) AS units FROM lineitem GROUP BY l_suppkey)
SELECT ref, claims, units, claims * units AS pairs FROM o JOIN u USING (ref)""")
def claim_unit_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per reference, how many of all claims and all units have it, and the pairs that share it."""
    lines = table(spark, sf_dir, "lineitem")
    left = lines.groupBy(F.col("l_orderkey").alias("claim")).agg(F.collect_set("l_suppkey").alias("refs"))
    right = lines.groupBy(F.col("l_partkey").alias("unit")).agg(F.collect_set("l_suppkey").alias("refs"))
    return claims.overlaps_by_reference(left, right, "claim", "unit", "refs").withColumnsRenamed({"left_keys": "claims", "right_keys": "units"})


_FILES = "SELECT doc_id, 'r/' || source || '/' || lang || '/f' || doc_id AS path, doc_id % 17 = 0 AS manifest FROM documents"


@query(f"""
WITH f AS ({_FILES}), m AS (SELECT DISTINCT CASE doc_id % 2 WHEN 0 THEN 'r/' || split_part(path, '/', 2) ELSE 'r/' || split_part(path, '/', 2) || '/' || split_part(path, '/', 3) END AS dir FROM f WHERE manifest)
SELECT doc_id, (SELECT max_by(dir, length(dir)) FROM m WHERE starts_with(f.path, m.dir || '/')) AS manifest_dir FROM f""")
def nearest_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deepest directory above a file that holds a manifest: ancestors exploded, equi-joined, deepest kept."""
    files = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("r/"), "source", F.lit("/"), "lang", F.lit("/f"), "doc_id").alias("path"))
    parts = F.split("path", "/")
    deep = F.array_join(F.slice(parts, 1, F.when(F.col("doc_id") % 2 == 0, 2).otherwise(3)), "/")
    manifests = files.filter("doc_id % 17 = 0").select(deep.alias("dir")).distinct()
    above = files.select("doc_id", F.explode(paths.ancestors(F.col("path"))).alias("dir"))
    found = above.join(manifests, "dir").groupBy("doc_id").agg(F.max_by("dir", F.length("dir")).alias("manifest_dir"))
    return files.select("doc_id").join(found, "doc_id", "left")


@query(f"""
WITH {_RESOLVED}, m AS (SELECT DISTINCT CAST(claim AS VARCHAR) AS src, CAST(ref AS VARCHAR) AS dst, level FROM r WHERE resolved)
SELECT 'node' AS part, CAST(o_orderkey AS VARCHAR) AS id, 'Claim' AS type, o_orderstatus AS label, CAST(NULL AS BOOLEAN) AS provisional FROM orders
UNION ALL SELECT DISTINCT 'node', dst, 'Evidence', level, level = 'E6' FROM m
UNION ALL SELECT 'edge', 'CLAIM-EVIDENCE-' || sha256('["claim-evidence","snap","' || src || '","' || dst || '"]'), src, dst, NULL FROM m""")
def claim_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims and the evidence that they resolve to, as nodes and edges with content-addressed ids."""
    own = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("claim"), F.col("o_orderstatus").alias("text"))
    nodes, edges = project.claim_overlay(own, resolved_citations(spark, sf_dir), "snap")
    return nodes.select(F.lit("node").alias("part"), "*").union(edges.select(F.lit("edge"), "id", "src", "dst", F.lit(None).cast("boolean")))


#: Symbols are parts, relations are lines of orders, roles are suppliers of parts; files are part types.
_KINDS = "['IMPORTS', 'CALL_CANDIDATE', 'EXTENDS', 'GUESSES'][1 + l_linenumber % 4]"


def _facts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    part, line = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    path = F.concat(F.when(F.col("p_partkey") % 41 == 0, "../").otherwise("src/"), F.col("p_size"))
    symbols = part.select(F.concat(F.lit("S"), "p_partkey").alias("id"), path.alias("path"), F.array(F.concat(F.lit("E"), F.col("p_size") % 12)).alias("evidence_ids"))
    symbols = symbols.union(part.filter("p_partkey % 50 = 7").select(F.concat(F.lit("S"), "p_partkey"), F.lit("src/1"), F.array(F.lit("E1"))))
    kind = F.element_at(F.array(*map(F.lit, ("IMPORTS", "CALL_CANDIDATE", "EXTENDS", "GUESSES"))), F.col("l_linenumber") % 4 + 1)
    relations = line.select(F.concat_ws(":", F.lit("R"), "l_orderkey", "l_linenumber").alias("id"), kind.alias("kind"), F.concat(F.lit("src/"), F.col("l_quantity").cast("int")).alias("path"), F.concat(F.lit("S"), "l_partkey").alias("source_id"), F.when(F.col("l_suppkey") % 3 != 0, F.concat(F.lit("S"), F.col("l_partkey") + F.col("l_suppkey"))).alias("target_id"), F.array(F.lit("E1")).alias("evidence_ids"))
    roles = line.select(F.concat_ws(":", F.lit("O"), "l_partkey", "l_suppkey").alias("id"), F.when(F.col("l_suppkey") % 2 == 0, "page_candidate").otherwise("test_candidate").alias("kind"), F.lit("src/1").alias("path"), F.concat(F.lit("S"), "l_partkey").alias("symbol_id"), F.array(F.lit("E1")).alias("evidence_ids")).distinct()
    files = spark.range(1, 46).select(F.concat(F.lit("src/"), "id").alias("path"))
    return symbols, relations, roles, files, spark.range(10).select(F.concat(F.lit("E"), "id").alias("id"))


@query(f"""
WITH s AS (SELECT 'S' || p_partkey AS id, CASE WHEN p_partkey % 41 = 0 THEN NULL ELSE p_size END AS size, p_size % 12 AS e FROM part),
r AS (SELECT 'R:' || l_orderkey || ':' || l_linenumber AS id, {_KINDS} AS kind, CAST(l_quantity AS INTEGER) AS size, l_partkey AS a, CASE WHEN l_suppkey % 3 <> 0 THEN l_partkey + l_suppkey END AS b FROM lineitem)
SELECT id, 'IDENTITY_CONFLICT' AS code FROM (SELECT 'S' || p_partkey AS id FROM part WHERE p_partkey % 50 = 7 AND NOT (p_size = 1 AND p_partkey % 41 <> 0))
UNION SELECT id, 'IDENTITY_CONFLICT' FROM r GROUP BY id HAVING count(DISTINCT kind || '|' || size || '|' || a || '|' || coalesce(CAST(b AS VARCHAR), '')) > 1
UNION SELECT id, 'SOURCE_PATH_INVALID' FROM s WHERE size IS NULL OR size > 45 UNION SELECT id, 'SOURCE_PATH_INVALID' FROM r WHERE size > 45 OR size < 1
UNION SELECT id, 'EVIDENCE_MISSING' FROM s WHERE e > 9 UNION SELECT id, 'KIND_INVALID' FROM r WHERE kind = 'GUESSES'
UNION SELECT id, 'SYMBOL_MISSING' FROM r WHERE a NOT IN (SELECT p_partkey FROM part) OR b NOT IN (SELECT p_partkey FROM part)""")
def fact_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols, relations and roles whose identity, path, evidence, kind or ends do not hold."""
    return project.fact_findings(*_facts(spark, sf_dir))


@query("SELECT 'S' || l_partkey AS symbol_id, array_to_string(list_sort(list(kind)), ',') AS kinds FROM (SELECT DISTINCT l_partkey, l_suppkey, CASE WHEN l_suppkey % 2 = 0 THEN 'page_candidate' ELSE 'test_candidate' END AS kind FROM lineitem) GROUP BY l_partkey")
def symbol_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kinds of roles of each symbol."""
    return project.roles_by_symbol(_facts(spark, sf_dir)[2]).withColumn("kinds", F.array_join("kinds", ","))


@query(f"""
SELECT type, src, dst FROM (SELECT 'CONTAINS' AS type, 'FILE:' || CASE WHEN p_partkey % 41 = 0 THEN '../' ELSE 'src/' END || p_size AS src, 'S' || p_partkey AS dst FROM part
UNION SELECT 'CONTAINS', 'FILE:src/1', 'S' || p_partkey FROM part WHERE p_partkey % 50 = 7
UNION SELECT {_KINDS}, 'S' || l_partkey, 'S' || (l_partkey + l_suppkey) FROM lineitem WHERE l_suppkey % 3 <> 0)""")
def fact_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of files, symbols and their relations."""
    symbols, relations, _, files, _ = _facts(spark, sf_dir)
    return project.graph_projection(files, symbols, relations)[1]


@query("""
WITH n AS (SELECT o_custkey AS node, list_sort(list('P' || o_orderkey % 30)) AS refs FROM orders GROUP BY o_custkey)
SELECT node, 'INPUT_INVALID' AS code FROM n WHERE len(refs) <> len(list_distinct(refs)) UNION SELECT node, 'REFERENCE_MISSING' FROM (SELECT node, unnest(refs) AS ref FROM n) WHERE ref IN ('P7', 'P9')""")
def reference_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of references that repeat one, and references that stand for nothing."""
    own = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("node")).agg(F.array_sort(F.collect_list(F.concat(F.lit("P"), F.col("o_orderkey") % 30))).alias("refs"))
    return project.reference_findings(own, "node", "refs", spark.range(30).filter("id NOT IN (7, 9)").select(F.concat(F.lit("P"), "id").alias("id")))


@query("""
WITH l AS (SELECT l_orderkey AS k, l_orderkey * 1000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS node, l_partkey AS rank FROM lineitem),
t AS (SELECT *, max(rank * 10000000000 + node) OVER (PARTITION BY k ORDER BY node) AS top FROM l)
SELECT node, row_number() OVER (ORDER BY top, node) AS position FROM t""")
def heap_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines in the order of a heap on their parts, where each line of an order has the one before as its prerequisite."""
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"))
    own = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 1000 + place).alias("node"), F.col("l_partkey").alias("rank"), F.lit("").alias("key"), place.alias("place"))
    own = graph._kept(own)  # nodes and edges are read several times
    return order.heap_order(own.drop("place"), own.filter("place > 1").select((F.col("node") - 1).alias("src"), F.col("node").alias("dst")))
