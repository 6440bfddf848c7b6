"""Contracts, manifests, Python facts, Markdown tables, edits and line predicates over rows derived from the supplied tables.

Where the SQL cannot hold the rule itself, the input is dealt out of a list of cases with what must come out, written by hand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.functions import code
from fathomline.functions.ids import canonical_tuple, concept_label
from fathomline.operators import classify, contracts, extraction, lines, markdown, project, workflow
from fathomline.plans.inventory import CASES_SQL, sample_files
from fathomline.plans.registry import query, table
from fathomline.sources import artifacts, manifests

ORDER = {
    "type": "object", "required": ["artifact_kind", "schema_version", "id", "status"], "additionalProperties": False,
    "properties": {
        "artifact_kind": {"const": "order"}, "schema_version": {"type": "string", "pattern": r"^1\.\d+\.\d+$"}, "id": {"type": "integer", "minimum": 100}, "status": {"enum": ["O", "F"]}, "price": {"type": "number", "maximum": 300000},
        "tags": {"type": "array", "maxItems": 1, "items": {"type": "string", "minLength": 1}},
    },
}


@query("""
WITH o AS (SELECT o_orderkey AS k, o_orderstatus AS s, o_totalprice AS p FROM orders)
SELECT k AS id, '$.artifact_kind' AS path, 'KIND' AS code FROM o WHERE k % 11 = 5 AND k % 13 <> 0
UNION ALL SELECT k, '$', 'JSON' FROM o WHERE k % 13 = 0
UNION ALL SELECT k, v.path, v.code FROM (SELECT * FROM o WHERE k % 11 <> 5 AND k % 13 <> 0), LATERAL (
  SELECT '$.status' AS path, 'REQUIRED' AS code WHERE k % 7 = 1 UNION ALL SELECT '$.id', 'TYPE' WHERE k % 7 = 2 UNION ALL SELECT '$.id', 'MINIMUM' WHERE k % 7 <> 2 AND k < 100
  UNION ALL SELECT '$.note', 'UNEXPECTED' WHERE k % 7 = 3 UNION ALL SELECT '$.tags', 'MAXITEMS' WHERE k % 7 = 4 UNION ALL SELECT '$.tags[1]', 'TYPE' WHERE k % 7 = 4 UNION ALL SELECT '$.tags[0]', 'MINLENGTH' WHERE k % 7 = 5
  UNION ALL SELECT '$.status', 'VALUE_NOT_LISTED' WHERE k % 7 <> 1 AND s = 'P' UNION ALL SELECT '$.price', 'MAXIMUM' WHERE p > 300000) v""")
def contract_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations of a closed schema by JSON documents, some of another kind, some with a repeated key."""
    k = F.col("o_orderkey")
    part = lambda *cells: F.concat(*(F.lit(c) if isinstance(c, str) else c for c in cells))
    text = part(
        '{"artifact_kind":"', F.when(k % 11 == 5, "other").otherwise("order"), '","schema_version":"1.0.0","id":', F.when(k % 7 == 2, part('"', k, '"')).otherwise(k.cast("string")),
        F.when(k % 7 == 1, "").otherwise(part(',"status":"', F.col("o_orderstatus"), '"')), ',"price":', F.col("o_totalprice").cast("decimal(20,2)"), F.when(k % 7 == 3, ',"note":true').otherwise(""),
        ',"tags":["', F.when(k % 7 == 5, "").otherwise("a"), '"', F.when(k % 7 == 4, ",5").otherwise(""), "]", F.when(k % 13 == 0, ',"tags":[]').otherwise(""), "}",
    )
    rows = table(spark, sf_dir, "orders").select(k.alias("id"), artifacts.strict(text).alias("document"))
    return contracts.artifact_findings(rows, "id", "document", {("order", "1.0.0"): ORDER})


@query("""
WITH f AS (SELECT doc_id, doc_id % 5 AS kind FROM documents)
SELECT doc_id || '/Requirements-Dev.TXT' AS path, 'requirements' AS section, 'pkg' || doc_id AS name, '1.' || doc_id AS version FROM f WHERE kind = 0
UNION ALL SELECT doc_id || '/Requirements-Dev.TXT', 'requirements', 'other', '' FROM f WHERE kind = 0
UNION ALL SELECT doc_id || '/package.json', s, n || doc_id, '^' || doc_id FROM f, (VALUES ('dependencies', 'a'), ('peerDependencies', 'b')) v(s, n) WHERE kind = 1 AND doc_id % 3 > 0
UNION ALL SELECT doc_id || '/package.json', 'MALFORMED', '', '' FROM f WHERE kind = 1 AND doc_id % 3 = 0
UNION ALL SELECT doc_id || '/pyproject.toml', s, n, x FROM f, LATERAL (SELECT 'dependencies' AS s, 'flask' AS n, CAST(doc_id AS VARCHAR) AS x UNION ALL SELECT 'build', 'hatchling', '') v WHERE kind = 2
UNION ALL SELECT doc_id || '/pom.xml', CASE doc_id % 4 WHEN 0 THEN 'MALFORMED' WHEN 1 THEN 'MALFORMED' ELSE 'dependencies' END, CASE WHEN doc_id % 4 > 1 THEN 'h' || doc_id || ':b' ELSE '' END, CASE WHEN doc_id % 4 > 1 THEN '1.' || doc_id ELSE '' END FROM f WHERE kind = 3
UNION ALL SELECT doc_id || '/package-lock.json', s, n, x FROM f, LATERAL (SELECT 'lock' AS s, 'left' AS n, '2.' || doc_id AS x WHERE doc_id % 2 = 0 UNION ALL SELECT 'lock', '@s/deep', '' WHERE doc_id % 2 = 0 UNION ALL SELECT 'MALFORMED', '', '' WHERE doc_id % 2 = 1) v WHERE kind = 4""")
def manifest_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages of requirement files, package.json, pyproject, Maven and npm lock files, one of a kind for each document, some of them broken."""
    i = F.col("doc_id").cast("string")
    fill = lambda text: F.replace(F.lit(text), F.lit("#ID#"), i)
    kinds = [
        ("Requirements-Dev.TXT", "# a comment\npkg#ID#==1.#ID#  # pinned\n-r base.txt\n\nOther>=2\n"), ("package.json", '{"dependencies": {"a#ID#": "^#ID#"}, "peerDependencies": {"b#ID#": "^#ID#"}}'),
        ("pyproject.toml", '[project]\ndependencies = ["Flask==#ID#"]\n[build-system]\nrequires = ["hatchling"]\n'), ("pom.xml", '<project xmlns="http://maven.apache.org/POM/4.0.0"><dependencies><dependency><groupId>g#ID#</groupId></dependency><dependency><groupId>h#ID#</groupId><artifactId> b </artifactId><version>1.#ID#</version></dependency></dependencies></project>'),
    ]
    lock = F.when(F.col("doc_id") % 2 == 0, fill('{"lockfileVersion": 3, "packages": {"": {"name": "own"}, "node_modules/left": {"version": "2.#ID#"}, "node_modules/a/node_modules/@s/deep": {}}}')).otherwise(F.lit('{"lockfileVersion": 9}'))
    pick = lambda cells, last: F.element_at(F.array(*cells, last), (F.col("doc_id") % 5 + 1).cast("int"))
    broken = F.when((F.col("doc_id") % 5 == 1) & (F.col("doc_id") % 3 == 0), "[1]").when((F.col("doc_id") % 5 == 3) & (F.col("doc_id") % 4 == 0), "<!DocType p><project/>").when((F.col("doc_id") % 5 == 3) & (F.col("doc_id") % 4 == 1), "<project><dependencies>")
    files = table(spark, sf_dir, "documents").select(F.concat_ws("/", i, pick([F.lit(n) for n, _ in kinds], F.lit("package-lock.json"))).alias("path"), F.coalesce(broken, pick([fill(t) for _, t in kinds], lock)).alias("text"))
    return manifests.stack(files).unionByName(manifests.package_lock(files))


@query("""
SELECT p.doc_id || '.py' AS path, kind, name, owner, target, CAST(line_start AS BIGINT) AS line_start, CAST(line_end AS BIGINT) AS line_end FROM documents p, LATERAL (
  SELECT 'IMPORTS' AS kind, 'join' AS name, NULL AS owner, 'os.path.join' AS target, 1 AS line_start, 1 AS line_end
  UNION ALL SELECT 'FUNCTION', 'f' || doc_id, NULL, NULL, 2, 3 UNION ALL SELECT 'CALL_CANDIDATE', 'join', 'f' || doc_id, NULL, 3, 3
  UNION ALL SELECT 'CLASS', 'C', NULL, NULL, 4, 6 UNION ALL SELECT 'EXTENDS', 'C', NULL, 'Base.Inner', 4, 4 UNION ALL SELECT 'METHOD', 'C.run', 'C', NULL, 5, 6 UNION ALL SELECT 'CALL_CANDIDATE', 'f' || doc_id, 'C.run', NULL, 6, 6) v WHERE doc_id % 10 <> 3
UNION ALL SELECT doc_id || '.py', 'SKIPPED', 'SYNTAX_ERROR', NULL, NULL, NULL, NULL FROM documents WHERE doc_id % 10 = 3""")
def python_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols, imports, bases and calls of Python files; a tenth of the files is no Python."""
    source = F.concat(F.lit("from os.path import join\ndef f"), "doc_id", F.lit("(x):\n    return join(x)\nclass C(Base.Inner):\n    def run(self):\n        return f"), "doc_id", F.lit("(1)\n"))
    files = table(spark, sf_dir, "documents").select(F.concat("doc_id", F.lit(".py")).alias("path"), F.when(F.col("doc_id") % 10 == 3, F.concat(F.lit("def :"), "text")).otherwise(source).alias("text"))
    return extraction.python_facts(files)


@query("""
SELECT path, name, defined_at FROM (SELECT doc_id || '.py' AS path, 'f' || doc_id AS name, 2 AS defined_at FROM documents WHERE doc_id % 10 <> 3 UNION ALL SELECT doc_id || '.py', 'join', NULL FROM documents WHERE doc_id % 10 <> 3)""")
def python_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls whose name is defined once in their file, with the line."""
    return extraction.resolved_calls(python_symbols(spark, sf_dir)).select("path", "name", "defined_at")


#: Line, what is left of it, whether it is a key line, whether its comment is in CJK script; written by hand.
LINES = [
    ("int  x =\t1; // :L12 说明", "int x = 1;", True, True), ("    return a; // :L7", "return a;", False, False), ("foo(); // 调用", "foo(); // 调用", True, True), ('say("你好");', 'say("你好");', True, False), ("// 注释", "// 注释", True, True),
    ("import java.util.List;", "import java.util.List;", False, False), ("package a.b;", "package a.b;", False, False), ("export const a = 1", "export const a = 1", False, False), ("", "", False, False), ("  \t ", "", False, False), ("});", "});", False, False),
    ("private String name;", "private String name;", False, False), ("String name = load();", "String name = load();", True, False), (" * Apache License, Version 2.0", "* Apache License, Version 2.0", False, False), ("x = 1 # :L3-5 第一步", "x = 1", True, True),
    ("SELECT 1 -- :44", "SELECT 1", True, False), ("call(a, b) /* 块 */", "call(a, b) /* 块 */", True, False), ("# 标题", "# 标题", True, True), ("[ ] , ;", "[ ] , ;", False, False), ("exported = 1", "exported = 1", True, False),
]


@query(f"""
SELECT doc_id, norm, is_key, cjk FROM documents JOIN (VALUES {", ".join("(" + str(i) + ", '" + n.replace("'", "''") + f"', {k}, {c})" for i, (_, n, k, c) in enumerate(LINES))}) AS v(spot, norm, is_key, cjk) ON spot = doc_id % {len(LINES)}""")
def line_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised code, key lines and comments in CJK script, for lines with notes, tabs, marks and declarations."""
    line = F.element_at(F.array(*(F.lit(x[0]) for x in LINES)), (F.col("doc_id") % len(LINES) + 1).cast("int"))
    return table(spark, sf_dir, "documents").withColumn("line", line).select("doc_id", code.normalized(F.col("line")).alias("norm"), code.is_key_line(F.col("line")).alias("is_key"), code.has_cjk_comment(F.col("line")).alias("cjk"))


#: Table rows and their cells, with backslashes and pipes; written by hand.
ROWS = [(r"| a | b |", "a;b"), (r"| a \| b | c |", r"a \| b;c"), (r"a |  b |c", "a;b;c"), (r"| x \\| y |", r"x \\;y"), (r"| only |", "only"), (r"| a | b \|", r"a;b \|"), (r"|  | z |", ";z"), (r"a \\\| b", r"a \\\| b"), ("no pipe", "no pipe")]


@query(f"""
SELECT doc_id, cells FROM documents JOIN (VALUES {", ".join(f"({i}, '{c}')" for i, (_, c) in enumerate(ROWS))}) AS v(spot, cells) ON spot = doc_id % {len(ROWS)}""")
def table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of table rows; a pipe behind an odd number of backslashes belongs to its cell."""
    row = F.element_at(F.array(*(F.lit(x[0]) for x in ROWS)), (F.col("doc_id") % len(ROWS) + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(markdown.table_cells(row), ";").alias("cells"))


@query("""
SELECT conv_id, CAST(line AS BIGINT) AS start, CAST(2 AS BIGINT) AS columns, ok AS separator_ok FROM (SELECT DISTINCT conv_id FROM conversations), LATERAL (SELECT 2 AS line, true AS ok UNION ALL SELECT 6, conv_id % 2 = 0) v""")
def pipe_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where pipe tables begin, and whether the row below the header marks the columns."""
    rule = F.when(F.col("conv_id") % 2 == 0, "| :--- | ---: |").otherwise("| -- | x |")
    text = F.concat(F.lit("text\n| a | b \\| c |\n|---|:---:|\n| 1 | 2 |\n\n| d | e |\n"), rule, F.lit("\nend | of\n"))
    own = table(spark, sf_dir, "conversations").select("conv_id").distinct().withColumn("text", text)
    return markdown.tables(lines.exploded(own, "conv_id", "text"), "conv_id")


@query("""
WITH t AS (SELECT doc_id, len(string_split(text, chr(10))) AS n FROM documents)
SELECT CAST(doc_id AS VARCHAR) AS doc_id, open_line, close_line, language, lines, anomaly FROM t, LATERAL (
  SELECT 1 AS open_line, n + 2 AS close_line, 'py' AS language, n AS lines, NULL AS anomaly UNION ALL SELECT n + 3, NULL, '', 2, 'UNCLOSED' UNION ALL SELECT n + 4, NULL, 'js', NULL, 'LABELLED_FENCE_INSIDE_BLOCK') v""")
def fence_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fenced blocks with language and length, a labelled fence inside a block, and a block that never closes."""
    own = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("```py\n"), "text", F.lit("\n```\n~~~\n~~~js\nx")).alias("text"))
    return extraction.fences(own)


_HEADED = "SELECT conv_id, turn + 1 AS line_no, CASE WHEN turn % 5 = 4 THEN text ELSE repeat('#', CAST((conv_id + turn * turn) % 5 + 1 AS INTEGER)) || ' ' || role || turn END AS line FROM conversations"


@query(f"""
WITH l AS ({_HEADED}), h AS (SELECT conv_id, line_no, length(regexp_extract(line, '^(#+) ', 1)) AS level, regexp_replace(line, '^#+ ', '') AS heading FROM l WHERE regexp_matches(line, '^#{{1,5}} .')),
a AS (SELECT l.conv_id, l.line_no, h.heading, h.line_no AS spot FROM l JOIN h ON h.conv_id = l.conv_id AND h.line_no < l.line_no AND h.level >= 2 AND NOT EXISTS (SELECT 1 FROM h x WHERE x.conv_id = h.conv_id AND x.line_no > h.line_no AND x.line_no < l.line_no AND x.level <= h.level))
SELECT l.conv_id, l.line_no, coalesce(string_agg(trim(heading), ' > ' ORDER BY spot), '') AS chain FROM l LEFT JOIN a ON a.conv_id = l.conv_id AND a.line_no = l.line_no GROUP BY l.conv_id, l.line_no""")
def heading_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The headings above each line, outermost first."""
    turn = F.col("turn")
    line = F.when(turn % 5 == 4, F.col("text")).otherwise(F.concat(F.repeat(F.lit("#"), ((F.col("conv_id") + turn * turn) % 5 + 1).cast("int")), F.lit(" "), "role", turn))
    own = table(spark, sf_dir, "conversations").select("conv_id", (turn + 1).alias("line_no"), line.alias("line"))
    return lines.heading_chain(own, "conv_id").select("conv_id", "line_no", F.array_join("chain", " > ").alias("chain"))


def _rows(*cells: str) -> str:
    """SQL text of lines."""
    return " || chr(10) || ".join(cells)


@query(f"""
WITH d AS (SELECT doc_id, '§b' || doc_id AS own, coalesce(text, '') AS text FROM documents), e AS (SELECT *, {_rows("'a'", "own", "text")} AS body FROM d), f AS (SELECT *, body || CASE WHEN right(body, 1) = chr(10) THEN '' ELSE chr(10) END AS ended FROM e)
SELECT doc_id AS doc, CASE doc_id % 7 WHEN 0 THEN ended || 'new' || chr(10) WHEN 2 THEN {_rows("'a'", "'top'", "own", "text")} WHEN 3 THEN {_rows("'a'", "'B' || doc_id", "text")} WHEN 4 THEN {_rows("'a'", "own || ' done'", "text")}
  WHEN 6 THEN ended || {_rows("'x'", "'y'", "''")} ELSE body END AS text, doc_id % 7 NOT IN (1, 5) AS changed, CASE WHEN doc_id % 7 = 5 THEN 'ANCHOR_MISSING' END AS conflict FROM f
UNION ALL SELECT -1 - doc_id, CASE WHEN doc_id % 2 = 0 THEN {_rows("''", "'new'", "''")} END, doc_id % 2 = 0, CASE WHEN doc_id % 2 = 1 THEN 'TEXT_MISSING' END FROM d""")
def anchored_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits of documents in order: sections and lines added, lines put before an anchor, replaced or repaired, a conflict; and of texts that are not there."""
    i = F.col("doc_id")
    own = F.concat(F.lit("§b"), i)
    docs = table(spark, sf_dir, "documents").select(i.alias("doc"), F.concat_ws("\n", F.lit("a"), own, F.coalesce("text", F.lit(""))).alias("text"))
    edit = lambda when, number, op, anchor, block, expected=None, marker=None, doc=i: F.when(when, F.struct(doc.alias("doc"), F.lit(number).alias("number"), F.lit(op).alias("op"), anchor.alias("anchor"), block.alias("block"), (F.lit(None).cast("string") if expected is None else expected).alias("expected"), F.lit(marker).cast("string").alias("marker")))
    nothing, text, of = F.lit(None).cast("string"), F.lit, lambda n: i % 7 == n
    todo = [
        edit(of(0), 1, "append_section", nothing, text("new\n\n")), edit(of(1), 1, "ensure_line", nothing, text(" a ")), edit(of(2), 1, "insert_before_anchor", own, text("top")), edit(of(3), 1, "replace_anchor_line", own, F.concat(F.lit("B"), i), text("b")),
        edit(of(4), 1, "update_line", own, F.concat(own, F.lit(" done")), own), edit(of(5), 1, "append_section", nothing, text("lost")), edit(of(5), 2, "insert_before_anchor", text("§zzz"), text("x")), edit(of(6), 2, "ensure_line", nothing, text("y")), edit(of(6), 1, "append_section", nothing, text("x")), edit(of(6), 3, "append_section", nothing, text("y"), None, "x\ny"),
        edit(i >= 0, 1, "append_section", nothing, text("new"), doc=-1 - i), edit(i % 2 == 1, 2, "ensure_line", nothing, text("q"), doc=-1 - i),
    ]
    edits = table(spark, sf_dir, "documents").select(F.explode(F.filter(F.array(*todo), lambda e: e.isNotNull())).alias("e")).select("e.*")
    return extraction.edited(docs, edits)


@query("""
SELECT doc_id AS doc, section, CASE WHEN (doc_id + section) % 3 = 0 THEN 'part ' || lang ELSE 'base ' || source END AS body FROM documents, (VALUES (1), (2)) v(section)""")
def section_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections with the parts that stand in for them, in the base's order and keys."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "lang", "source", F.explode(F.array(F.lit(1), F.lit(2))).alias("section"))
    parts = docs.filter("(doc + section) % 3 = 0").select("doc", "section", F.concat(F.lit("part "), "lang").alias("body"))
    return extraction.overlay(docs.select("doc", "section", F.concat(F.lit("base "), "source").alias("body")), parts)


_WORD = "[A-Za-z_][0-9A-Za-z_]*"


@query(f"""
WITH names AS (SELECT DISTINCT unnest(regexp_extract_all(text, '{_WORD}')) AS name FROM benchmark UNION SELECT unnest(['track', 't', 'margin', 'script'])),
l AS (SELECT page_id, unnest(string_split(html, chr(10))) AS line, generate_subscripts(string_split(html, chr(10)), 1) AS line_no FROM pages),
t AS (SELECT page_id, line_no, regexp_extract_all(line, '{_WORD}|[^\\t\\n\\x0b\\f\\r 0-9A-Za-z_]') AS w FROM l),
p AS (SELECT page_id, line_no, w, unnest(w) AS name, generate_subscripts(w, 1) AS i FROM t),
c AS (SELECT page_id, line_no, bool_or(name = '.' AND regexp_matches(coalesce(w[i + 1], ''), '^[0-9A-Za-z_]') AND coalesce(w[i + 2], '') = '(') AS calls FROM p GROUP BY ALL),
m AS (SELECT page_id, line_no, name, bool_or(i > 1 AND w[i - 1] IN ('class', 'def', 'enum', 'interface', 'record')) AS declared,
      bool_or(i > 1 AND w[i - 1] = 'new' OR coalesce(w[i + 1], '') = '(' OR regexp_matches(coalesce(w[i + 1], ''), '^[0-9A-Za-z_]') AND coalesce(w[i + 2], '') = '=' AND coalesce(w[i + 3], '') <> '=') AS used FROM p SEMI JOIN names USING (name) GROUP BY ALL)
SELECT page_id, line_no, name, CASE WHEN declared THEN 'DECLARATION' WHEN used OR calls THEN 'USE' ELSE 'MENTION' END AS kind FROM m JOIN c USING (page_id, line_no)""")
def call_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of pages that declare, use or mention one of the benchmark's words or of some names of scripts."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit(_WORD), F.lit(0))).alias("name"))
    names = words.union(words.sparkSession.createDataFrame([("track",), ("t",), ("margin",), ("script",)], "name string"))
    return extraction.call_sites(lines.exploded(table(spark, sf_dir, "pages").select("page_id", "html"), "page_id", "html"), "page_id", names)


@query("""
SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(1 AS BIGINT) AS line_no, 'Thing' || (doc_id % 9) AS name FROM documents WHERE doc_id % 9 > 4""")
def prose_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in prose that no source has; names inside fenced blocks do not count."""
    text = F.concat(F.lit("See `Thing"), F.col("doc_id") % 9, F.lit("` and `low`.\n```\n`Absent`\n```\nThe end of `Thing1`."))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), text.alias("text"))
    return extraction.prose_findings(lines.exploded(docs, "doc_id", "text"), extraction.fences(docs), "doc_id", spark.range(5).select(F.concat(F.lit("Thing"), "id").alias("name")))


@query("""
SELECT doc_id, '["' || CASE doc_id % 4 WHEN 0 THEN 'a\\u0001b' WHEN 1 THEN 'tab\\t' WHEN 2 THEN 'q\\"\\\\' ELSE 'line\\n\\b\\f\\r\\u001f' END || '",null]' AS text FROM documents""")
def canonical_tuples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compact JSON of tuples with control characters, quotes and backslashes."""
    value = F.element_at(F.array(*map(F.lit, ("a\x01b", "tab\t", 'q"\\', "line\n\b\f\r\x1f"))), (F.col("doc_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", canonical_tuple(value, F.lit(None).cast("string")).alias("text"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Caf' || chr(233) WHEN 1 THEN 'plain' WHEN 2 THEN NULL ELSE chr(506) || ' b' END AS label FROM documents")
def concept_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels in composed form without white space around; nothing left is null."""
    value = F.element_at(F.array(*map(F.lit, (" Cafe\u0301 ", "plain\n", " \t", "A\u030a\u0301 b"))), (F.col("doc_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", concept_label(value).alias("label"))


@query("""
SELECT c_custkey AS unit, CASE WHEN c_custkey % 7 = 0 THEN 'PROJECT_REFERENCES_PRESENT'
  WHEN c_custkey % 3 = 0 THEN CASE WHEN c_custkey % 2 = 0 OR c_custkey % 5 = 0 THEN 'UNIT_ORIGIN_SCOPE_INVALID' WHEN c_custkey % 4 > 0 THEN 'UNIT_METADATA_INVALID' END
  WHEN c_custkey % 3 = 1 THEN CASE WHEN c_custkey % 5 <> 0 OR c_custkey % 4 < 3 THEN 'UNIT_METADATA_INVALID' END ELSE 'UNIT_ORIGIN_SCOPE_INVALID' END AS error FROM customer""")
def general_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which units the general teaching path takes, and why it refuses the others."""
    k = F.col("c_custkey")
    origin = F.when(k % 3 == 0, "CANDIDATE").when(k % 3 == 1, "PREREQUISITE_PRIMER").otherwise("OTHER")
    key = F.when(k % 5 != 0, F.concat(F.lit("k"), k))
    error = project.general_unit_error(origin, F.when(k % 2 == 0, "PROJECT_SPECIFIC").otherwise("GENERAL_LEARNING"), key, k % 7 == 0, k % 4)
    return table(spark, sf_dir, "customer").select(k.alias("unit"), error.alias("error"))


@query(r"""
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'KEY_UNKNOWN' WHEN regexp_matches(text, '(?i)sk-[A-Za-z0-9]|api[_-]?key|secret|passwd|password|BEGIN [A-Z ]*PRIVATE KEY|ghp_') THEN 'SECRET' END AS refused FROM documents""")
def guarded_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts that may not be written: unknown keys, values that look like secrets."""
    key = F.when(F.col("doc_id") % 3 == 0, "colour").otherwise("model")
    return table(spark, sf_dir, "documents").select("doc_id", project.guarded(key, F.col("text")).alias("refused"))


@query("""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS rows, doc_id % 5 AS a, doc_id % 5 + doc_id % 3 - 1 AS b FROM documents)
SELECT doc_id, CASE WHEN a >= 1 AND b >= a AND b <= len(rows) THEN array_to_string(rows[a:b], chr(10)) END AS span FROM d""")
def line_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of texts by number; ranges that are not there are null."""
    docs = table(spark, sf_dir, "documents").selectExpr("doc_id", "text", "int(doc_id % 5) AS a", "int(doc_id % 5 + doc_id % 3 - 1) AS b")
    return lines.spans(docs, "doc_id", "text", "a", "b").select("doc_id", "span")


@query("""
SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, reason FROM documents, LATERAL (SELECT 2 AS line_no, 'TEXT_BLOCK' AS reason UNION ALL SELECT 3, 'TEXT_BLOCK' UNION ALL SELECT 5, 'CONTINUED' UNION ALL SELECT 7, 'TEXT_BLOCK' WHERE doc_id % 2 = 0) v""")
def protected_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines within text blocks of three quotes and lines that go on behind a backslash."""
    text = F.concat(F.lit('a = """x\nin\n"""\nb = """one line"""\nc = 1 + \\\n2'), F.when(F.col("doc_id") % 2 == 0, '"""\nopen').otherwise("\nend")).alias("text")
    return lines.protected(lines.exploded(table(spark, sf_dir, "documents").select("doc_id", text), "doc_id", "text"), "doc_id")


@query("""
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN lang WHEN 2 THEN '# coding: latin-1' || chr(10) || 'caf' || chr(233) END AS text, CASE doc_id % 4 WHEN 1 THEN 'BINARY_SOURCE' WHEN 3 THEN 'UNSUPPORTED_ENCODING' END AS skipped FROM documents""")
def decoded_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources decoded by their own coding line; binary ones and other codings are skipped."""
    kinds = F.array(F.encode("lang", "UTF-8"), F.lit(bytearray(b"a\x00b")), F.lit(bytearray("# coding: latin-1\ncafé".encode("latin-1"))), F.lit(bytearray(b"# coding: cp1252\nx")))
    payload = F.element_at(kinds, (F.col("doc_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", code.decoded(payload).alias("d")).select("doc_id", "d.*")


#: Heading, what the section goes by, paragraph, its list items, text, the types that it declares; written by hand.
WORDING = [
    ("## ⑨ 八股讲解", "⑨", "前言 **其一，**甲 **其二，**乙", "前言|- **其一，**甲|- **其二，**乙", "public class Foo { enum Bar { A } }", "Foo,Bar"),
    ("索引 A", "索引", "只有 **其一，**甲", None, "@interface Note {} interface lower {}", "Note"), ("## Plain ", "Plain", "no list", None, "subclass Foo", ""), ("### ① x", "### ① x", "**其三，**c **其四，**d **其五，**e", "**其三，**c|- **其四，**d|- **其五，**e", "record R(int a) class", "R"),
]


@query(f"""
SELECT doc_id, section, items, types FROM documents JOIN (VALUES {", ".join(f"({i}, '{a}', " + ("NULL" if b is None else f"'{b}'") + f", '{c}')" for i, (_, a, _, b, _, c) in enumerate(WORDING))}) AS v(spot, section, items, types) ON spot = doc_id % {len(WORDING)}""")
def wording(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What sections go by, lists within paragraphs, and types that a text declares."""
    pick = lambda k: F.element_at(F.array(*(F.lit(x[k]) for x in WORDING)), (F.col("doc_id") % len(WORDING) + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", code.section_key(pick(0)).alias("section"), F.array_join(code.enumeration(pick(2)), "|").alias("items"), F.array_join(code.declared_classes(pick(4)), ",").alias("types"))


@query("""
SELECT p_partkey AS unit, CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END AS attempts, CASE WHEN p_partkey % 3 = 0 THEN p_brand END AS execution_state, CASE WHEN p_partkey % 3 = 1 THEN 'STATE_BINDING_INVALID' END AS finding FROM part""")
def upgraded_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of a first-version state in the next version's form."""
    attempt = F.when(F.col("p_partkey") % 3 == 0, "attempt-0001").when(F.col("p_partkey") % 3 == 1, "attempt-0002")
    own = workflow.upgraded(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("unit"), F.col("p_brand").alias("state"), attempt.alias("attempt_id")))
    return own.select("unit", F.size("attempts").alias("attempts"), F.try_element_at("attempts", F.lit(1)).getField("execution_state").alias("execution_state"), "finding")


@query("""
SELECT l_orderkey AS claim, array_to_string(list_sort(list_distinct(list_concat(list('N' || l_partkey % 50), coalesce(list('N' || l_suppkey % 60) FILTER (l_linenumber % 2 = 0), [])))), ',') AS nodes,
  coalesce(array_to_string(list_sort(list_distinct(list('f' || l_suppkey % 60) FILTER (l_linenumber % 2 = 1))), ','), '') AS paths FROM lineitem GROUP BY l_orderkey""")
def claim_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of claims with cited symbols among the nodes and cited files among the paths."""
    odd = F.col("l_linenumber") % 2 == 1
    cited = F.struct(F.when(odd, "file").otherwise("symbol").alias("kind"), F.concat(F.when(odd, "f").otherwise("N"), F.col("l_suppkey") % 60).alias("value"))
    own = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("claim")).agg(F.collect_list(F.concat(F.lit("N"), F.col("l_partkey") % 50)).alias("node_ids"), F.collect_list(cited).alias("citations"))
    done = project.claim_references(own.withColumn("edge_ids", F.lit(None).cast("array<string>")).withColumn("evidence_ids", F.lit(None).cast("array<string>")))
    return done.select("claim", F.array_join("nodes", ",").alias("nodes"), F.array_join("paths", ",").alias("paths"))


def _book(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    k = F.col("p_partkey")
    route = F.when(k % 3 == 0, "PHASE6A_PROJECT_CLAIM").when(k % 3 == 1, "D2A_GENERAL_LEARNING").otherwise("UPSTREAM_REQUIRED")
    part = table(spark, sf_dir, "part")
    plan = part.select(k.alias("unit"), k.alias("position"), route.alias("route"), F.when(k % 4 == 0, "BLOCKED").otherwise("PLANNED").alias("plan_state"), F.when(k > 1, F.array(F.expr("p_partkey div 2"))).otherwise(F.array().cast("array<bigint>")).alias("prerequisites"))
    attempts = F.array(F.struct(F.lit("attempt-0001").alias("attempt_id"), F.when(F.col("unit") % 2 == 0, "BLOCKED_REVIEW").otherwise("REVIEWED_DRAFT").alias("execution_state")))
    state = plan.withColumn("position", F.col("position") + (F.col("unit") % 29 == 0).cast("int")).withColumn("attempts", attempts)
    chosen = part.filter("p_partkey % 5 = 0 OR p_partkey % 7 = 1").select(F.when(k % 211 == 0, -k).otherwise(k).alias("unit"), F.when(k % 10 == 5, "attempt-0002").otherwise("attempt-0001").alias("attempt"))
    return project.book_selection(plan, state, chosen)


_BOOK = """p AS (SELECT p_partkey AS k, CASE p_partkey % 3 WHEN 0 THEN 'PHASE6A_PROJECT_CLAIM' WHEN 1 THEN 'D2A_GENERAL_LEARNING' ELSE 'UPSTREAM_REQUIRED' END AS route FROM part),
c AS (SELECT CASE WHEN p_partkey % 211 = 0 THEN -p_partkey ELSE p_partkey END AS k, CASE WHEN p_partkey % 10 = 5 THEN 'attempt-0002' ELSE 'attempt-0001' END AS attempt FROM part WHERE p_partkey % 5 = 0 OR p_partkey % 7 = 1)"""


@query(f"""
WITH {_BOOK} SELECT p.k AS unit, p.k AS position, CASE WHEN attempt IS NULL THEN 'NOT_SELECTED' ELSE 'SELECTED' END AS selection, attempt, CASE WHEN attempt IS NULL THEN 'NOT_SELECTED' WHEN route = 'D2A_GENERAL_LEARNING' THEN 'INCLUDED' ELSE 'NOT_SUPPLIED' END AS answer FROM p LEFT JOIN c USING (k)""")
def book_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All units of a plan with the attempts chosen for the book."""
    return _book(spark, sf_dir)[0]


@query(f"""
WITH {_BOOK}, f AS (SELECT k AS unit, CASE WHEN k % 29 = 0 THEN 'STATE_BINDING_INVALID' WHEN attempt IS NULL THEN NULL WHEN k % 4 = 0 OR route = 'UPSTREAM_REQUIRED' THEN 'UNIT_NOT_SELECTABLE' WHEN attempt <> 'attempt-0001' THEN 'ATTEMPT_NOT_AVAILABLE' WHEN k % 2 = 0 THEN 'ATTEMPT_NOT_REVIEWED' END AS code FROM p LEFT JOIN c USING (k))
SELECT * FROM f WHERE code IS NOT NULL UNION ALL SELECT k, 'UNIT_NOT_IN_PLAN' FROM c WHERE k < 0
UNION ALL SELECT k, 'PREREQUISITE_NOT_SELECTED' FROM c WHERE k > 1 AND k // 2 NOT IN (SELECT k FROM c)""")
def book_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What forbids a selection: state against plan, routes, attempts, prerequisites."""
    return _book(spark, sf_dir)[1]


#: Path below a document's own folder, and whether it is a page of the package there; written by hand.
PAGES = [
    ("app/page.tsx", True), ("app/shop/[id]/page.js", True), ("src/app/page.mts", False), ("src/app/x/page.ts", True), ("app/page.test.tsx", False), ("app/Page.tsx", False), ("lib/app/page.tsx", False), ("pages/index.jsx", True), ("src/pages/a/b.ts", True), ("pages/api/x.ts", False), ("pages/api.ts", False),
    ("pages/_app.tsx", False), ("pages/apiary.ts", True), ("pages/readme.md", False), ("sub/pages/x.ts", True), ("package.json", False), ("sub/package.json", False),
]


@query(f"""
SELECT doc_id || '/' || path AS path, CASE WHEN path LIKE 'sub/%' THEN doc_id || '/sub' ELSE CAST(doc_id AS VARCHAR) END AS package FROM documents, (VALUES {", ".join(f"('{p}', {y})" for p, y in PAGES)}) AS v(path, page)
WHERE page AND CASE WHEN path LIKE 'sub/%' THEN doc_id % 2 = 0 ELSE doc_id % 3 = 0 END""")
def next_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose nearest package manifest declares the framework; a package below decides for itself."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    files = docs.select("doc_id", F.explode(F.array(*(F.lit(p) for p, _ in PAGES))).alias("p")).select("doc_id", "p", F.concat_ws("/", "doc_id", "p").alias("path"))
    declaring = files.filter("(p = 'package.json' AND doc_id % 3 = 0) OR (p = 'sub/package.json' AND doc_id % 2 = 0)")
    return project.next_pages(files.select("path"), declaring.select("path"))


@query(f"""
SELECT CASE WHEN path LIKE '%.py' THEN 'python' WHEN path LIKE '%.java' THEN 'java' WHEN regexp_matches(path, '\\.(js|jsx|ts|tsx)$') AND (surface = 'frontend' OR list_contains(string_split(secondary, ','), 'frontend')) THEN 'frontend' ELSE 'outside' END AS family, count(*) AS files
FROM (SELECT doc_id || '/' || path AS path, surface, secondary FROM ({CASES_SQL})) GROUP BY 1""")
def parser_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by the parser that is there for them."""
    own = classify.classified(sample_files(spark, sf_dir)).withColumn("path", F.concat_ws("/", "doc_id", "path"))
    return project.families(own)
