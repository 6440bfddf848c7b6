"""Table-generating extraction from source files and Markdown: one file gives many rows."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Files over these sizes are skipped with a code; fixed values.
MAX_BYTES, MAX_NODES = 1 << 20, 50_000
PYTHON_FACTS = "path string, kind string, name string, owner string, target string, line_start bigint, line_end bigint"
FENCES = "doc_id string, open_line bigint, close_line bigint, language string, lines bigint, anomaly string"


def _python_facts(path: str, text: str) -> Iterator[tuple]:
    if len(text.encode()) > MAX_BYTES:
        yield path, "SKIPPED", "SOURCE_TOO_LARGE", None, None, None, None
        return
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        yield path, "SKIPPED", "SYNTAX_ERROR", None, None, None, None
        return
    if sum(1 for _ in ast.walk(tree)) > MAX_NODES:
        yield path, "SKIPPED", "TOO_MANY_NODES", None, None, None, None
        return
    todo: list[tuple[ast.AST, str | None, bool]] = [(tree, None, False)]
    while todo:
        node, owner, in_class = todo.pop()
        for child in ast.iter_child_nodes(node):
            inside, within = owner, in_class
            if isinstance(child, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
                name = child.name if owner is None else f"{owner}.{child.name}"
                is_class = isinstance(child, ast.ClassDef)
                yield path, "CLASS" if is_class else "METHOD" if in_class else "FUNCTION", name, owner, None, child.lineno, child.end_lineno
                for base in child.bases if is_class else ():
                    yield path, "EXTENDS", name, owner, ast.unparse(base), child.lineno, child.lineno
                inside, within = name, is_class
            elif isinstance(child, ast.Import):
                for alias in child.names:
                    yield path, "IMPORTS", alias.asname or alias.name, owner, alias.name, child.lineno, child.end_lineno
            elif isinstance(child, ast.ImportFrom):
                for alias in child.names:
                    yield path, "IMPORTS", alias.asname or alias.name, owner, "." * child.level + ".".join(filter(None, (child.module, alias.name))), child.lineno, child.end_lineno
            elif isinstance(child, ast.Call) and isinstance(child.func, (ast.Name, ast.Attribute)):
                yield path, "CALL_CANDIDATE", ast.unparse(child.func), owner, None, child.lineno, child.end_lineno
            todo.append((child, inside, within))


def python_facts(files: DataFrame) -> DataFrame:
    """Symbols, imports, base classes and calls of Python files (path, text), or one SKIPPED row with a code."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in PYTHON_FACTS.split(", ")]
        for batch in batches:
            rows = [r for path, text in zip(batch["path"], batch["text"], strict=True) for r in _python_facts(path, text or "")]
            yield pd.DataFrame(rows, columns=columns).astype({"line_start": "Int64", "line_end": "Int64"})

    return files.filter(F.col("path").endswith(".py")).select("path", "text").mapInPandas(run, PYTHON_FACTS)


def resolved_calls(facts: DataFrame) -> DataFrame:
    """Calls whose name is defined exactly once in their file, with the definition's line; others have none."""
    defined = facts.filter(F.col("kind").isin("CLASS", "FUNCTION")).groupBy("path", "name").agg(F.count("*").alias("n"), F.min("line_start").alias("defined_at"))
    calls = facts.filter("kind = 'CALL_CANDIDATE'").select("path", "name", "owner", "line_start")
    return calls.join(defined.filter("n = 1").drop("n"), ["path", "name"], "left")


def _fences(lines: list[str]) -> Iterator[tuple]:
    opened, marker, language = None, "", ""
    for number, line in enumerate(lines, 1):
        m = re.match(r" {0,3}(`{3,}|~{3,})\s*([^`]*)$", line)
        if not m:
            continue
        if opened is None:
            opened, marker, language = number, m[1], m[2].strip()
        elif m[1][0] == marker[0] and len(m[1]) >= len(marker) and not m[2].strip():
            yield opened, number, language, number - opened - 1, None
            opened = None
        elif m[2].strip():
            yield number, None, m[2].strip(), None, "LABELLED_FENCE_INSIDE_BLOCK"
    if opened is not None:
        yield opened, None, language, len(lines) - opened, "UNCLOSED"


def fences(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fenced blocks of Markdown, and anomalies: labelled fences inside a block, blocks that never close."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in FENCES.split(", ")]
        for batch in batches:
            rows = [(k, *r) for k, t in zip(batch["k"], batch["t"], strict=True) for r in _fences((t or "").split("\n"))]
            yield pd.DataFrame(rows, columns=columns).astype({"open_line": "Int64", "close_line": "Int64", "lines": "Int64"})

    return docs.select(F.col(key).cast("string").alias("k"), F.col(text).alias("t")).mapInPandas(run, FENCES)


def overlay(base: DataFrame, parts: DataFrame) -> DataFrame:
    """Sections (doc, section, body) with the parts' bodies where they have one; order and keys are the base's."""
    return base.join(parts.select("doc", "section", F.col("body").alias("_part")), ["doc", "section"], "left").withColumn("body", F.coalesce("_part", "body")).drop("_part")


def planned(lines: DataFrame, plan: DataFrame) -> DataFrame:
    """Replacements (doc, anchor) with the number of lines that equal the anchor; exactly one is OK."""
    hits = lines.join(plan.select("doc", "anchor").distinct(), (lines.doc == plan.doc) & (lines.line == plan.anchor), "inner").groupBy(plan.doc, plan.anchor).agg(F.count("*").alias("hits"))
    found = plan.select("doc", "anchor").distinct().join(hits, ["doc", "anchor"], "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    return found.withColumn("status", F.when(F.col("hits") == 1, "OK").when(F.col("hits") == 0, "ANCHOR_MISSING").otherwise("ANCHOR_AMBIGUOUS"))


#: What an edit does: adds at the end, adds unless it is there, or acts on the one line that holds its anchor.
ADDING, ANCHORED = ("append_section", "ensure_line"), ("insert_before_anchor", "replace_anchor_line", "update_line")
_STATE = "struct<text: string, code: string>"


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _after(state: Column, edit: Column, there: Column) -> Column:
    """The state (text, code of the first conflict) after one edit, as an expression over the array of the text's lines."""
    text, op, block, wanted = state["text"], edit["op"], F.coalesce(edit["block"], F.lit("")), F.coalesce(edit["expected"], F.lit(""))
    rows = F.split(text, "\n", -1)
    holding = lambda lines: F.size(F.filter(lines, lambda row: F.contains(row, edit["anchor"])))
    at = F.array_position(F.transform(rows, lambda row: F.contains(row, edit["anchor"])), True)
    line, anchored, update = F.get(rows, (at - 1).cast("int")), op.isin(*ANCHORED), op == "update_line"
    put = F.split(F.when(update, F.regexp_replace(block, r"^\n+|\n+$", "")).otherwise(F.regexp_replace(block, r"\n+$", "")), "\n", -1)
    taken = F.when(op == "insert_before_anchor", 0).otherwise(1)
    spliced = F.concat(F.slice(rows, F.lit(1), at - 1), put, F.slice(rows, at + taken, F.size(rows)))
    same = F.when(update, _stripped(line) == _stripped(block)).otherwise(F.contains(text, edit["marker"]))
    idle = F.coalesce(same, F.lit(False)) & (update | (edit["marker"] != "")) | (op == "ensure_line") & F.exists(rows, lambda row: _stripped(row) == _stripped(block))
    code = (
        F.when(~there & (op != "append_section"), "TEXT_MISSING").when(~op.isin(*ADDING, *ANCHORED), "EDIT_UNKNOWN")
        .when(~update & idle, None)
        .when(anchored & (holding(rows) == 0), "ANCHOR_MISSING").when(anchored & (holding(rows) > 1), "ANCHOR_AMBIGUOUS")
        .when((op == "replace_anchor_line") & ~F.contains(line, wanted), "ANCHOR_CHANGED")
        .when(update & ~idle & (_stripped(line) != _stripped(wanted)), "ANCHOR_CHANGED")
        .when(update & ~idle & (holding(spliced) != 1), "ANCHOR_LOST")
    )
    ended = F.concat(F.when(op == "ensure_line", F.regexp_replace(text, r"\n+$", "")).when(text.endswith("\n"), F.left(text, F.length(text) - 1)).otherwise(text), F.lit("\n"))
    added = F.concat(ended, F.regexp_replace(block, F.when(op == "ensure_line", r"^\n+|\n+$").otherwise(r"\n+$"), F.lit("")), F.lit("\n"))
    done = F.when(idle, text).when(anchored, F.array_join(spliced, "\n")).otherwise(added)
    after = F.transform(F.array(code), lambda c: F.struct(F.when(c.isNull(), done).otherwise(text).alias("text"), c.alias("code")))
    return F.when(state["code"].isNotNull(), state).otherwise(F.get(after, 0)).cast(_STATE)


def edited(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """(doc, text, changed, conflict): each text after its edits, in order, each on the result of the one before.

    ``docs`` (doc, text), ``edits`` (doc, number, op, anchor, block, expected, marker). A text with a conflict stays as it
    was, with the first conflict's code. A text that is null or has no row takes appended sections alone, whatever came
    before. An edit whose marker the text has is done already; an update is done when the line is as it should be. The
    edits are a fold over the lines of each text, so all runs in the JVM.
    """
    order = F.array_sort(F.collect_list(F.struct("number", "op", "anchor", "block", "expected", "marker")))
    todo = edits.groupBy("doc").agg(order.alias("_edits"))
    rows = docs.join(todo, "doc", "full_outer")
    text = F.coalesce("text", F.lit(""))
    first = F.struct(text.alias("text"), F.lit(None).cast("string").alias("code")).cast(_STATE)
    rows = rows.withColumn("_done", F.when(F.col("_edits").isNotNull(), F.aggregate("_edits", first, lambda state, edit: _after(state, edit, F.col("text").isNotNull()))))
    changed = F.col("_done.code").isNull() & F.coalesce(F.col("_done.text") != text, F.lit(False))
    return rows.select("doc", F.when(changed, F.col("_done.text")).otherwise(F.col("text")).alias("text"), changed.alias("changed"), F.col("_done.code").alias("conflict"))


def prose_findings(lines: DataFrame, fences: DataFrame, key: str, names: DataFrame) -> DataFrame:
    """(key, line_no, name) of names in backticks, outside fenced blocks, that no source has.

    ``names`` (name) are those of the sources; a name is an identifier of four letters or more with a capital.
    """
    from fathomline.operators.markdown import visible

    found = visible(lines, fences, key).select(key, "line_no", F.explode(F.array_distinct(F.regexp_extract_all("line", F.lit(r"`([A-Za-z_]*[A-Z][A-Za-z0-9_]*)`"), F.lit(1)))).alias("name")).filter("length(name) >= 4")
    return found.join(names.select("name").distinct(), "name", "left_anti").select(key, "line_no", "name")


#: Words that declare the name behind them.
DECLARING = ["class", "def", "enum", "interface", "record"]


def call_sites(lines: DataFrame, key: str, names: DataFrame) -> DataFrame:
    """(key, line_no, name, kind) of lines that have a name: DECLARATION, USE or MENTION.

    A line is read as tokens, identifiers and single marks; a name is told by the tokens around it. It is declared behind
    a word that declares, and used when made by ``new``, called, followed by a variable that is assigned, or in a line that
    calls something of an object. Names meet the lines by an equi-join. Null lines have none.
    """
    tokens = F.regexp_extract_all("line", F.lit(r"[A-Za-z_]\w*|[^\s\w]"), F.lit(0))
    own = lines.select(key, "line_no", tokens.alias("tokens"))
    at = lambda i, d: F.coalesce(F.get("tokens", (i + d).cast("int")), F.lit(""))
    word = lambda t: t.rlike(r"^\w")
    places = F.sequence(F.lit(0), F.size("tokens") - 1)
    calls = F.exists(places, lambda i: (at(i, 0) == ".") & word(at(i, 1)) & (at(i, 2) == "("))
    own = own.filter("size(tokens) > 0").withColumn("calls", calls)
    told = F.transform(
        F.filter(places, lambda i: word(at(i, 0))),
        lambda i: F.struct(
            at(i, 0).alias("name"), at(i, -1).isin(*DECLARING).alias("declared"),
            ((at(i, -1) == "new") | (at(i, 1) == "(") | word(at(i, 1)) & (at(i, 2) == "=") & (at(i, 3) != "=")).alias("used"),
        ),
    )
    met = own.select(key, "line_no", "calls", F.explode(told).alias("t")).select(key, "line_no", "calls", "t.*").join(names.select("name").distinct(), "name")
    found = met.groupBy(key, "line_no", "name").agg(F.max("declared").alias("declared"), F.max(F.col("used") | F.col("calls")).alias("used"))
    return found.select(key, "line_no", "name", F.when(F.col("declared"), "DECLARATION").when(F.col("used"), "USE").otherwise("MENTION").alias("kind"))
