"""Line tables: explode, sections, masks, attribution by an inverted index, and coverage of lines by other texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def exploded(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no from 1, line)."""
    return docs.select(key, F.posexplode(F.split(text, "\n")).alias("_pos", "line")).select(key, (F.col("_pos") + 1).cast("long").alias("line_no"), "line")


def with_offsets(lines: DataFrame, key: str) -> DataFrame:
    """Lines with the code-point offset where each begins."""
    before = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    return lines.withColumn("offset", F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0)))


def masked(lines: DataFrame, key: str, toggles: Column) -> DataFrame:
    """``inside``: whether an odd number of toggling lines came before; the toggling lines themselves count as inside."""
    before = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    marked = lines.withColumn("_toggle", toggles.cast("int"))
    return marked.withColumn("inside", (F.coalesce(F.sum("_toggle").over(before), F.lit(0)) % 2 == 1) | (F.col("_toggle") == 1)).drop("_toggle")


def sections(lines: DataFrame, key: str, heading: Column) -> DataFrame:
    """One row a section (0: what stands before the first heading): heading, first line, number of lines."""
    so_far = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumn("_head", heading).withColumn("section", F.sum(F.col("_head").cast("long")).over(so_far))
    return marked.groupBy(key, "section").agg(F.min(F.when(F.col("_head"), F.col("line"))).alias("heading"), F.min("line_no").alias("first_line"), F.count("*").alias("lines"))


def spans(docs: DataFrame, key: str, text: str, first: str, last: str) -> DataFrame:
    """``docs`` with ``span``, the lines ``first`` to ``last`` (from 1, inclusive); null where there are no such lines."""
    rows = F.split(text, "\n")
    valid = (F.col(first) >= 1) & (F.col(last) >= F.col(first)) & (F.col(last) <= F.size(rows))
    return docs.withColumn("span", F.when(valid, F.array_join(F.slice(rows, F.col(first), F.col(last) - F.col(first) + 1), "\n")))


def protected(lines: DataFrame, key: str) -> DataFrame:
    """Lines (key, line_no, reason) that take no note: within a text block of three quotes, or continued by a backslash."""
    before = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    quotes = F.regexp_count("line", F.lit('"""'))
    inside = F.coalesce(F.sum(quotes).over(before), F.lit(0)) % 2 == 1
    marked = lines.withColumn("_in", inside)
    reason = F.when(F.rtrim("line").endswith("\\"), "CONTINUED").when(F.col("_in"), "TEXT_BLOCK")
    return marked.select(key, "line_no", reason.alias("reason")).filter("reason IS NOT NULL")


def section_findings(found: DataFrame, key: str) -> DataFrame:
    """(key, heading, code): headings that occur twice in a text."""
    return found.filter("heading IS NOT NULL").groupBy(key, "heading").agg(F.count("*").alias("n")).filter("n > 1").select(key, "heading", F.lit("SECTION_DUPLICATE").alias("code"))


def heading_chain(lines: DataFrame, key: str) -> DataFrame:
    """Lines with ``chain``: the texts of the headings (levels 2 to 5) above, outermost first, each level higher than the next.

    A heading of level 1 ends the search upwards. One pass keeps the last heading of each level and where it stands.
    """
    level = F.length(F.regexp_extract("line", r"^(#{1,5}) .", 1))
    rows = lines.withColumn("_level", level)
    before = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    spot = lambda n: F.max(F.when(F.col("_level") == n, F.col("line_no"))).over(before)
    text = lambda n: F.last(F.when(F.col("_level") == n, F.trim(F.regexp_replace("line", "^#+ ", ""))), ignorenulls=True).over(before)
    marked = rows.withColumns({f"_at{n}": F.coalesce(spot(n), F.lit(-1)) for n in range(1, 6)} | {f"_text{n}": text(n) for n in range(2, 6)})
    higher = lambda n: [F.col(f"_at{n}") > F.col(f"_at{m}") for m in range(1, n)]
    # a level counts if it stands behind all higher levels' headings and behind the title
    kept = [F.when(reduce(lambda a, b: a & b, higher(n)), F.col(f"_text{n}")) for n in range(2, 6)]
    return marked.withColumn("chain", F.filter(F.array(*kept), lambda x: x.isNotNull())).drop("_level", *(f"_at{n}" for n in range(1, 6)), *(f"_text{n}" for n in range(2, 6)))


def nearest_heading(lines: DataFrame, key: str, heading: Column) -> DataFrame:
    """Lines with the last heading at or above them."""
    so_far = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("heading", F.last(F.when(heading, F.col("line")), ignorenulls=True).over(so_far))


def attribution(queries: DataFrame, index: DataFrame, query: str, owner: str, least: float, ties: str = "smallest") -> DataFrame:
    """Owner of each query text: the one that has most of its lines, if it has the share ``least`` of them.

    Both sides are (key, line); blank lines do not count, and a line counts once for a query and an owner. Among equals the
    smaller owner is chosen, with ``ties`` = "none" no one. An owner that may lack ``m`` lines has one of any ``m + 1``
    others, so candidates come from the query's rarest lines only, and only they are counted in full: a line that every
    text has makes no pairs unless it is among a query's rarest.
    """
    solid = F.trim("line") != ""
    asked = queries.filter(solid).select(query, "line").distinct()
    own = index.filter(solid).join(asked.select("line").distinct(), "line", "left_semi").select(owner, "line").distinct()
    often = own.groupBy("line").agg(F.count("*").alias("_often"))
    sizes = asked.groupBy(query).agg(F.count("*").alias("lines"))
    rare = Window.partitionBy(query).orderBy(F.coalesce("_often", F.lit(0)), "line")
    needed = F.ceil(F.col("lines") * F.lit(least) - 1e-9)
    ranked = asked.join(often, "line", "left").withColumn("_at", F.row_number().over(rare)).join(sizes, query)
    rarest = ranked.filter(F.col("_at") <= F.col("lines") - needed + 1).select(query, "line")
    candidates = rarest.join(own, "line").select(query, owner).distinct()
    votes = candidates.join(asked, query).join(own, [owner, "line"]).groupBy(query, owner).agg(F.count("*").alias("hits"))
    enough = votes.join(sizes, query).filter(F.col("hits") >= needed)
    best = enough.groupBy(query).agg(F.max("hits").alias("hits"))
    first = enough.join(best, [query, "hits"]).groupBy(query, "hits").agg(F.min(owner).alias(owner), F.count("*").alias("_equal"))
    chosen = first if ties == "smallest" else first.filter("_equal = 1")
    return sizes.join(chosen.drop("_equal"), query, "left").select(query, "lines", F.coalesce("hits", F.lit(0)).alias("hits"), owner)


def coverage(lines: DataFrame, other: DataFrame, group: list[str]) -> DataFrame:
    """Share of a group's lines that occur anywhere in ``other``."""
    known = other.select("line").distinct().withColumn("_hit", F.lit(1))
    joined = lines.join(known, "line", "left")
    return joined.groupBy(*group).agg(F.count("*").alias("lines"), F.count("_hit").alias("covered"))


def unique_places(lines: DataFrame, key: str) -> DataFrame:
    """Lines that stand exactly once in their text, with their number."""
    return lines.groupBy(key, "line").agg(F.count("*").alias("_n"), F.min("line_no").alias("line_no")).filter("_n = 1").drop("_n")
