"""Markdown texts as line tables: visible lines, tables, anchors and links, ordered rendering and numbered source blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def visible(lines: DataFrame, fences: DataFrame, key: str) -> DataFrame:
    """Lines outside fenced blocks; a block that never closes hides the rest of its text.

    ``fences`` (key, open_line, close_line) is grouped to one row a text first, so the join is an equi-join.
    """
    ranges = fences.filter(F.col("close_line").isNotNull() | F.col("lines").isNotNull()).groupBy(key).agg(F.collect_list(F.struct("open_line", "close_line")).alias("_fences"))
    joined = lines.join(ranges, key, "left")
    hidden = F.exists("_fences", lambda f: (F.col("line_no") >= f.open_line) & (f.close_line.isNull() | (F.col("line_no") <= f.close_line)))
    return joined.filter(~F.coalesce(hidden, F.lit(False))).drop("_fences")


def table_cells(line: Column) -> Column:
    """Cells of a pipe table's row; a pipe after an odd number of backslashes belongs to its cell."""
    bare = F.regexp_replace(F.trim(line), r"^\||(?<!\\)((?:\\\\)*)\|$", "$1")
    return F.transform(F.split(bare, r"(?<=(?<!\\)(?:\\\\){0,20})\|"), lambda x: F.trim(x))


def tables(lines: DataFrame, key: str) -> DataFrame:
    """Pipe tables: (key, start, columns, separator_ok) where a header row is followed by a row of as many cells."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy("line_no")
    rows = lines.withColumn("_next", F.lead("line").over(w)).withColumn("_before", F.coalesce(F.lag("line").over(w), F.lit("")))
    heads = rows.filter(F.contains("line", F.lit("|")) & F.contains("_next", F.lit("|")) & ~F.contains("_before", F.lit("|")))
    cells, rule = table_cells(F.col("line")), table_cells(F.col("_next"))
    marked = F.forall(rule, lambda c: F.replace(c, F.lit(" "), F.lit("")).rlike("^:?-{3,}:?$"))
    return heads.filter((F.size(cells) >= 2) & (F.size(rule) >= 2)).select(key, F.col("line_no").alias("start"), F.size(cells).cast("long").alias("columns"), ((F.size(cells) == F.size(rule)) & marked).alias("separator_ok"))


def link_findings(anchors: DataFrame, links: DataFrame, key: str) -> DataFrame:
    """Codes for anchors that occur twice and links that meet no anchor or several: (key, code, target)."""
    counted = anchors.groupBy(key, "target").agg(F.count("*").alias("_n"))
    twice = counted.filter("_n > 1").select(key, F.lit("ANCHOR_DUPLICATE").alias("code"), "target")
    met = links.join(counted, [key, "target"], "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    code = F.when(F.col("_n") == 0, "FRAGMENT_UNRESOLVED").when(F.col("_n") > 1, "FRAGMENT_AMBIGUOUS")
    return twice.unionByName(met.select(key, code.alias("code"), "target").filter("code is not null"))


def rendered(units: DataFrame, book: str, position: str, anchor: str, title: str, body: str) -> DataFrame:
    """One text a book: contents with a link to each unit, then the units in order."""
    parts = units.groupBy(book).agg(F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), F.col(anchor).alias("a"), F.col(title).alias("t"), F.col(body).alias("b")))).alias("_u"))
    contents = F.array_join(F.transform("_u", lambda u: F.concat(F.lit("- ["), u.t, F.lit("](#"), u.a, F.lit(")"))), "\n")
    bodies = F.array_join(F.transform("_u", lambda u: F.concat(F.lit('<a id="'), u.a, F.lit('"></a>\n## '), u.t, F.lit("\n\n"), u.b)), "\n\n")
    return parts.select(book, F.concat(F.lit("## Contents\n"), contents, F.lit("\n\n## Lessons\n\n"), bodies, F.lit("\n")).alias("text"))


def numbered_block(text: Column, first: Column, last: Column) -> Column:
    """Lines ``first`` to ``last`` (from 1, inclusive), each with its number behind it."""
    lines = F.slice(F.split(text, "\n"), first, last - first + 1)
    return F.array_join(F.transform(lines, lambda x, i: F.concat(x, F.lit(" // :L"), (first + i).cast("string"))), "\n")


def stripped_block(block: Column) -> Column:
    """The inverse of ``numbered_block``."""
    return F.regexp_replace(block, r"(?m) // :L\d+$", "")
