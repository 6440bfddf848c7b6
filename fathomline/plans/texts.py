"""Lines, sections, attribution, links and scorecards over the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.functions import code
from fathomline.operators import fidelity as fid
from fathomline.operators import lines as L
from fathomline.operators import scorecard
from fathomline.plans.registry import query, table
from fathomline.sources import artifacts

_LINES = "lines AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents)"


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.exploded(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(f"""
WITH {_LINES}, o AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM lines)
SELECT doc_id, count(*) AS n_lines, CAST(max(off) AS BIGINT) AS last_offset, CAST(max(length(line)) AS BIGINT) AS longest, count(*) FILTER (length(line) > 300) AS long_lines FROM o GROUP BY doc_id""")
def line_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and where they begin."""
    own = L.with_offsets(document_lines(spark, sf_dir), "doc_id")
    return own.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.max("offset").alias("last_offset"), F.max(F.length("line")).cast("long").alias("longest"), F.count_if(F.length("line") > 300).alias("long_lines"))


@query(f"""
WITH {_LINES}, h AS (SELECT *, length(line) < 40 AS head FROM lines),
s AS (SELECT *, sum(CASE WHEN head THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS section FROM h)
SELECT doc_id, CAST(section AS BIGINT) AS section, min(CASE WHEN head THEN line END) AS heading, min(line_no) AS first_line, count(*) AS lines FROM s GROUP BY doc_id, section""")
def section_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections that short lines open."""
    return L.sections(document_lines(spark, sf_dir), "doc_id", F.length("line") < 40)


@query(f"""
WITH {_LINES}, f AS (SELECT *, coalesce(sum(CASE WHEN length(line) < 40 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 OR length(line) < 40 AS inside FROM lines)
SELECT doc_id, count(*) FILTER (inside) AS inside, count(*) FILTER (NOT inside) AS outside FROM f GROUP BY doc_id""")
def fence_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines between toggling lines, by parity."""
    own = L.masked(document_lines(spark, sf_dir), "doc_id", F.length("line") < 40)
    return own.groupBy("doc_id").agg(F.count_if("inside").alias("inside"), F.count_if(~F.col("inside")).alias("outside"))


@query(f"""
WITH {_LINES}, h AS (SELECT *, last_value(CASE WHEN length(line) < 40 THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS heading FROM lines)
SELECT doc_id, line_no, heading FROM h""")
def nearest_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The heading at or above each line."""
    return L.nearest_heading(document_lines(spark, sf_dir), "doc_id", F.length("line") < 40).select("doc_id", "line_no", "heading")


@query(f"""
WITH {_LINES}, q AS (SELECT DISTINCT item_id AS query, line FROM (SELECT item_id, unnest(string_split(replace(text, '. ', '.' || chr(10)), chr(10))) AS line FROM benchmark) WHERE trim(line) <> ''),
i AS (SELECT DISTINCT doc_id AS owner, line FROM (SELECT doc_id, unnest(string_split(replace(text, '. ', '.' || chr(10)), chr(10))) AS line FROM documents)),
s AS (SELECT query, count(*) AS lines FROM q GROUP BY query), v AS (SELECT query, owner, count(*) AS hits FROM q JOIN i USING (line) GROUP BY query, owner),
e AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY hits DESC, owner) AS spot FROM v JOIN s USING (query) WHERE hits >= ceil(lines * 0.85 - 1e-9))
SELECT s.query, s.lines, coalesce(hits, 0) AS hits, owner FROM s LEFT JOIN e ON e.query = s.query AND spot = 1""")
def attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each benchmark item the document that has most of its sentences, if one has 85 % of them; all documents are searched."""
    split = lambda name, key, alias: L.exploded(table(spark, sf_dir, name).select(F.col(key).alias(alias), F.replace("text", F.lit(". "), F.lit(".\n")).alias("text")), alias, "text")
    return L.attribution(split("benchmark", "item_id", "query"), split("documents", "doc_id", "owner"), "query", "owner", 0.85)


@query(f"""
WITH {_LINES}, k AS (SELECT line, count(DISTINCT doc_id) > 1 AS shared FROM lines GROUP BY line)
SELECT source, count(*) AS lines, count(*) FILTER (shared) AS covered, count(*) FILTER (shared) * 1000 >= count(*) * 995 AS passed FROM lines JOIN k USING (line) GROUP BY source""")
def reverse_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each source's lines that another document has as well."""
    own = document_lines(spark, sf_dir)
    named = own.join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    shared = own.groupBy("line").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("a < b")
    return L.coverage(named, shared, ["source"]).withColumn("passed", F.col("covered") * 1000 >= F.col("lines") * 995)


@query(f"""
WITH {_LINES}, u AS (SELECT doc_id, line, min(line_no) AS line_no FROM lines GROUP BY doc_id, line HAVING count(*) = 1)
SELECT doc_id, count(*) AS unique_lines, CAST(sum(line_no) AS BIGINT) AS place_sum FROM u GROUP BY doc_id""")
def unique_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that can be located by their text alone."""
    return L.unique_places(document_lines(spark, sf_dir), "doc_id").groupBy("doc_id").agg(F.count("*").alias("unique_lines"), F.sum("line_no").alias("place_sum"))


@query(f"""
WITH {_LINES}
SELECT doc_id, line_no, trim(regexp_replace(regexp_replace(line, '[\\t\\n\\x0b\\f\\r ]*(//|#|--)[\\t\\n\\x0b\\f\\r ]*:L?[0-9]+(-[0-9]+)?[ \\t]*.*$', ''), '[\\t\\n\\x0b\\f\\r ]+', ' ', 'g')) AS norm, regexp_matches(line, '[一-鿿]') AS cjk,
  regexp_replace(regexp_replace(lower(trim(regexp_replace(regexp_replace(line, '<[^>]*>', '', 'g'), '[`*~]', '', 'g'))), '[^\\p{{L}}\\p{{N}}_\\t\\n\\x0b\\f\\r -]', '', 'g'), '[\\t\\n\\x0b\\f\\r ]+', '-', 'g') AS slug
FROM lines""")
def line_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised code, script test and anchors of all lines."""
    own = document_lines(spark, sf_dir)
    return own.select("doc_id", "line_no", code.normalized(F.col("line")).alias("norm"), code.has_cjk(F.col("line")).alias("cjk"), code.slug(F.col("line")).alias("slug"))


@query("""
SELECT v.version, CASE WHEN version LIKE '%x' THEN NULL ELSE list_transform(string_split(v.version, '.'), lambda x: TRY_CAST(x AS INTEGER)) >= [2, 10] END AS strict FROM (SELECT DISTINCT (p_size % 4) || '.' || (p_partkey % 15) || CASE WHEN p_partkey % 7 = 0 THEN 'x' ELSE '' END AS version FROM part) v""")
def version_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dotted versions compared part by part; some have a part that is no number."""
    versions = table(spark, sf_dir, "part").select(F.concat_ws(".", F.expr("p_size % 4"), F.expr("(p_partkey % 15) || IF(p_partkey % 7 = 0, 'x', '')")).alias("version")).distinct()
    return versions.withColumn("strict", code.version_at_least(F.col("version"), "2.10"))


@query("""
SELECT page_id, len(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS links, len(list_distinct(regexp_extract_all(html, 'href="([^"]*)"', 1))) AS targets, len(regexp_extract_all(html, '<h[1-6][^>]*>')) AS headings, len(regexp_extract_all(html, '<script')) AS scripts FROM pages""")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, different targets, headings and scripts of pages (as data; nothing is followed)."""
    links = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    count = lambda pattern: F.regexp_count("html", F.lit(pattern)).cast("long")
    return table(spark, sf_dir, "pages").select("page_id", F.size(links).cast("long").alias("links"), F.size(F.array_distinct(links)).cast("long").alias("targets"), count("<h[1-6][^>]*>").alias("headings"), count("<script").alias("scripts"))


@query("""
WITH l AS (SELECT page_id, unnest(list_distinct(regexp_extract_all(html, 'href="([^"]*)"', 1))) AS target FROM pages),
n AS (SELECT target, count(*) AS pages FROM l GROUP BY target)
SELECT page_id, count(*) FILTER (n.pages = 1) AS own, count(*) FILTER (n.pages > 1) AS shared FROM l JOIN n USING (target) GROUP BY page_id""")
def link_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets that one page links to, and those that several do."""
    links = table(spark, sf_dir, "pages").select("page_id", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)))).alias("target"))
    counts = links.groupBy("target").agg(F.count("*").alias("pages"))
    return links.join(counts, "target").groupBy("page_id").agg(F.count_if(F.col("pages") == 1).alias("own"), F.count_if(F.col("pages") > 1).alias("shared"))


_CARD = """SELECT source, count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS chars, count(*) FILTER (n_chars > 5000) AS long_files, count(*) FILTER (lang = 'en') AS english FROM documents WHERE doc_id % 2 = {} GROUP BY source"""
_FIELDS = ["files", "chars", "long_files", "english"]


def _card(spark: SparkSession, sf_dir: str, half: int | None) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    docs = docs if half is None else docs.filter(F.col("doc_id") % 2 == half)
    return docs.groupBy("source").agg(F.count("*").alias("files"), F.sum("n_chars").alias("chars"), F.count_if(F.col("n_chars") > 5000).alias("long_files"), F.count_if(F.col("lang") == "en").alias("english"))


@query(_CARD.replace("WHERE doc_id % 2 = {} ", ""))
def corpus_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of measures a source."""
    return _card(spark, sf_dir, None)


@query(f"""
SELECT count(*) AS sources, CAST(sum(files) AS BIGINT) AS files, CAST(sum(chars) AS BIGINT) AS chars, count(*) FILTER (long_files > 0) AS with_long FROM ({_CARD.replace("WHERE doc_id % 2 = {} ", "")})""")
def scorecard_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of the scorecard."""
    return _card(spark, sf_dir, None).agg(F.count("*").alias("sources"), F.sum("files").alias("files"), F.sum("chars").alias("chars"), F.count_if(F.col("long_files") > 0).alias("with_long"))


@query(
    f"WITH a AS ({_CARD.format(0)}), b AS ({_CARD.format(1)}) "
    + " UNION ALL ".join(
        f"SELECT source, '{f}' AS field, CASE WHEN a.source IS NULL THEN 'added' WHEN b.source IS NULL THEN 'removed' ELSE 'changed' END AS change, CAST(a.{f} AS VARCHAR) AS before, CAST(b.{f} AS VARCHAR) AS after FROM a FULL JOIN b USING (source) WHERE a.{f} IS DISTINCT FROM b.{f}"
        for f in _FIELDS
    )
)
def scorecard_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Added, removed and changed measures between two halves."""
    return scorecard.difference(_card(spark, sf_dir, 0), _card(spark, sf_dir, 1), "source", _FIELDS)


@query("""
WITH c AS (SELECT source, lang, count(*) FILTER (n_chars > 300) AS checked, count(*) FILTER (n_chars > 8000) AS findings FROM documents GROUP BY source, lang),
s AS (SELECT *, CASE WHEN findings > 0 THEN 'FAIL' WHEN checked = 0 THEN 'NOT_CHECKED' ELSE 'PASS' END AS status FROM c)
SELECT source, count(*) AS checks, count(*) FILTER (status IN ('FAIL', 'ERROR')) AS blocking, NOT bool_or(status IN ('FAIL', 'ERROR')) AS passed FROM s GROUP BY source""")
def check_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Check rows and verdicts; an empty check never passes."""
    own = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count_if(F.col("n_chars") > 300).alias("checked"), F.count_if(F.col("n_chars") > 8000).alias("findings"))
    return scorecard.verdict(own.withColumn("status", scorecard.check_status(F.col("checked"), F.col("findings"))), ["source"])


@query("""
SELECT conv_id, count(DISTINCT role) AS reports, count(DISTINCT turn // 2) AS sessions, count(*) FILTER (contains(text, '?')) AS findings,
  CASE WHEN count(DISTINCT role) < 2 OR count(DISTINCT turn // 2) < 2 THEN 'INCOMPLETE' WHEN count(*) FILTER (contains(text, '?')) > 0 THEN 'REPAIR_REQUIRED' ELSE 'REVIEWED' END AS state
FROM conversations GROUP BY conv_id""")
def review_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review states from different reports, sessions and findings."""
    own = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count_distinct("role").alias("reports"), F.count_distinct(F.expr("turn div 2")).alias("sessions"), F.count_if(F.contains("text", F.lit("?"))).alias("findings"))
    return own.withColumn("state", scorecard.review_state(F.col("reports"), 2, F.col("sessions"), 2, F.col("findings")))


@query("""
WITH q AS (SELECT conv_id, turn AS place, text FROM conversations WHERE role = 'user'), a AS (SELECT conv_id, turn - 1 AS place, text FROM conversations WHERE role = 'assistant')
SELECT conv_id, place, q.text IS NOT NULL AS asked, a.text IS NOT NULL AS answered, CASE WHEN q.text IS NULL OR a.text IS NULL THEN NULL ELSE sha256(q.text) = sha256(a.text) END AS echoed FROM q FULL JOIN a USING (conv_id, place)""")
def question_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions against answers, one to one, with what either side lacks."""
    turns = table(spark, sf_dir, "conversations")
    q = turns.filter("role = 'user'").select("conv_id", F.col("turn").alias("place"), F.sha2("text", 256).alias("q"))
    a = turns.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("place"), F.sha2("text", 256).alias("a"))
    return q.join(a, ["conv_id", "place"], "full_outer").select("conv_id", "place", F.col("q").isNotNull().alias("asked"), F.col("a").isNotNull().alias("answered"), (F.col("q") == F.col("a")).alias("echoed"))


@query("""SELECT event_id, user_id, event_id % 3 <> 1 AS is_json, CASE WHEN event_id % 3 <> 1 THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k, CASE WHEN event_id % 3 <> 1 THEN len(json_keys(props)) END AS keys FROM events""")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON fields of the events, strictly parsed; a third repeats a key and is therefore no document."""
    props = F.when(F.col("event_id") % 3 == 1, F.regexp_replace("props", r"\}\s*$", ', "k": 0}')).otherwise(F.col("props"))
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", artifacts.strict(props).alias("v"))
    return rows.select("event_id", "user_id", F.col("v").isNotNull().alias("is_json"), F.try_variant_get("v", "$.k", "bigint").alias("k"), F.size(F.map_keys(F.try_variant_get("v", "$", "map<string, variant>"))).cast("long").alias("keys"))


@query("""
SELECT source, CAST(sum(len(list_filter(string_split(replace(text, chr(10), chr(0)), chr(0)), lambda x: x <> ''))) AS BIGINT) AS records FROM documents GROUP BY source""")
def nul_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records between NUL bytes, empty ones dropped."""
    parts = F.filter(F.split(F.replace("text", F.lit("\n"), F.lit("\0")), "\0"), lambda x: x != "")
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.sum(F.size(parts).cast("long")).alias("records"))


@query("""
SELECT class, disposition, count(*) AS findings FROM (SELECT CASE WHEN event_type = 'error' THEN 'EVIDENCE' WHEN event_type = 'view' THEN 'STYLE' ELSE 'BEGINNER' END AS class, CASE WHEN value > 50 THEN 'REPAIR' ELSE 'NOTE' END AS disposition FROM events) GROUP BY class, disposition""")
def triage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings by class and disposition."""
    kind = F.when(F.col("event_type") == "error", "EVIDENCE").when(F.col("event_type") == "view", "STYLE").otherwise("BEGINNER")
    return table(spark, sf_dir, "events").groupBy(kind.alias("class"), F.when(F.col("value") > 50, "REPAIR").otherwise("NOTE").alias("disposition")).agg(F.count("*").alias("findings"))


#: Normalised code lines of the SQL below: notes off, white space collapsed; blank lines and comments are left out.
_NORM = r"trim(regexp_replace(regexp_replace(line, '[\t\n\x0b\f\r ]*(//|#|--)[\t\n\x0b\f\r ]*:L?[0-9]+(-[0-9]+)?[ \t]*.*$', ''), '[\t\n\x0b\f\r ]+', ' ', 'g'))"
_PIECES = "unnest(string_split(replace(text, '. ', '.' || chr(10)), chr(10))) AS line, generate_subscripts(string_split(replace(text, '. ', '.' || chr(10)), chr(10)), 1) AS i"


@query(f"""
WITH q AS (SELECT * FROM (SELECT item_id AS block, i, {_NORM} AS line FROM (SELECT item_id, {_PIECES} FROM benchmark)) WHERE line <> '' AND NOT regexp_matches(line, '^(//|/\\*|\\*|#|--)')),
o AS (SELECT DISTINCT doc_id AS owner, line FROM (SELECT doc_id, {_NORM} AS line FROM (SELECT doc_id, {_PIECES} FROM documents)) WHERE line <> '' AND NOT regexp_matches(line, '^(//|/\\*|\\*|#|--)')),
b AS (SELECT block, count(*) AS lines, count(DISTINCT line) AS kinds FROM q GROUP BY block HAVING count(*) >= 2),
named AS (SELECT block, doc_id AS owner FROM b JOIN documents ON block % 5 = 0 AND doc_id IN (block, block + 1)),
votes AS (SELECT block, owner, count(*) AS hits FROM (SELECT DISTINCT block, line FROM q) JOIN o USING (line) WHERE block NOT IN (SELECT block FROM named) GROUP BY ALL),
voted AS (SELECT block, owner FROM (SELECT *, row_number() OVER (PARTITION BY block ORDER BY hits DESC, owner) AS spot FROM votes JOIN b USING (block) WHERE hits >= ceil(kinds * 0.85 - 1e-9)) WHERE spot = 1),
pairs AS (SELECT * FROM named UNION ALL SELECT * FROM voted),
bare AS (SELECT doc_id AS owner, regexp_replace(text, '[\\t\\n\\x0b\\f\\r ]+', '', 'g') AS bare FROM documents),
forms AS (SELECT block, owner, i, line, unnest(list_distinct([line, CASE WHEN trim(split_part(line, '//', 1)) <> '' THEN trim(split_part(line, '//', 1)) ELSE line END])) AS form FROM q JOIN pairs USING (block)),
met AS (SELECT f.block, f.owner, f.i, f.line, bool_or(o.line IS NOT NULL OR length(replace(f.form, ' ', '')) >= 8 AND contains(bare, replace(f.form, ' ', ''))) AS known FROM forms f LEFT JOIN o ON o.owner = f.owner AND o.line = f.form JOIN bare ON bare.owner = f.owner GROUP BY ALL),
lost AS (SELECT block, owner, count(*) FILTER (NOT known) AS lost FROM met GROUP BY ALL),
best AS (SELECT block, arg_min(owner, struct_pack(l := lost, o := owner)) AS owner, min(lost) AS lost FROM lost GROUP BY block),
gone AS (SELECT block, count(*) AS n FROM met JOIN best USING (block, owner) WHERE NOT known AND line NOT IN (SELECT line FROM o WHERE owner % 2 = 0) GROUP BY block)
SELECT b.block, b.lines, owner, lost, CASE WHEN lost IS NOT NULL THEN coalesce(n, 0) END AS snapshot_lost, lost - coalesce(n, 0) AS evolved FROM b LEFT JOIN best USING (block) LEFT JOIN gone USING (block)""")
def fidelity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as blocks of sentences against all documents: the owner, by a named document or by votes, the lost lines, and those that documents of even ids lack too."""
    split = F.replace("text", F.lit(". "), F.lit(".\n"))
    items, docs = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents")
    sources = docs.select(F.col("doc_id").alias("owner"), F.concat(F.lit("D"), "doc_id").alias("class"), split.alias("text"))
    named = items.filter("item_id % 5 = 0").select(F.col("item_id").alias("block"), F.explode(F.array("item_id", F.col("item_id") + 1)).alias("id")).select("block", F.concat(F.lit("D"), "id").alias("class"))
    blocks = L.exploded(items.select(F.col("item_id").alias("block"), split.alias("text")), "block", "text")
    old = fid.code_lines(L.exploded(sources.filter("owner % 2 = 0").select("owner", "text"), "owner", "text"), "owner").select("line")
    return fid.fidelity(blocks, named, sources, old, least_lines=2)
