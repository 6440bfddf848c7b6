"""Whether the lines of code blocks are those of a source: owners by class name or by votes, lost lines, and lines of old snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.functions import code
from fathomline.operators.graph import _kept
from fathomline.operators.lines import attribution

#: Blocks of fewer code lines have no owner; a line without white space has so many characters at least to be looked for in a text.
LEAST_LINES, LEAST_CHARS = 5, 8


def code_lines(lines: DataFrame, key: str) -> DataFrame:
    """(key, line_no, line): normalised lines that are neither blank nor comments; null lines are left out."""
    norm = code.normalized(F.col("line"))
    return lines.select(key, "line_no", norm.alias("line")).filter((F.col("line") != "") & ~F.col("line").rlike(code.COMMENT))


def without_space(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+", "")


def _candidates(blocks: DataFrame, own: DataFrame, classes: DataFrame, sources: DataFrame, share: float) -> DataFrame:
    """(block, owner): the sources of a class that the block names, or else the one source that most of its lines vote for."""
    named = classes.join(sources.select("owner", "class"), "class").select("block", "owner").distinct()
    others = blocks.join(named.select("block").distinct(), "block", "left_anti")
    voted = attribution(others.select("block", "line"), own.select("owner", "line"), "block", "owner", share).filter("owner IS NOT NULL").select("block", "owner")
    return named.unionByName(voted)


def fidelity(blocks: DataFrame, classes: DataFrame, sources: DataFrame, snapshot: DataFrame | None = None, share: float = 0.85, least_lines: int = LEAST_LINES) -> DataFrame:
    """(block, lines, owner, lost, snapshot_lost, evolved) of blocks with ``least_lines`` code lines or more.

    ``blocks`` (block, line_no, line), ``classes`` (block, class) that a block names, ``sources`` (owner, class, text),
    ``snapshot`` (line) normalised lines of an old version. A line is found in a source if it, or it without a trailing
    comment, is one of its lines, or stands in its text when all white space is taken out of both, so folded lines count.
    The owner is the candidate that has fewest lines lost (the smaller one of equals); without a candidate it and the
    counts are null. ``snapshot_lost`` are lost lines that the snapshot lacks too, ``evolved`` the others; both are null
    without a snapshot. Each candidate's text meets the lost lines of a block once, as one row. Of sources and snapshot only
    lines that blocks ask for are shuffled, and of texts those of owners that lack a line.
    """
    rows = code_lines(blocks, "block")
    sizes = rows.groupBy("block").agg(F.count("*").alias("lines")).filter(F.col("lines") >= least_lines)
    rows = _kept(rows.join(sizes.select("block"), "block", "left_semi"))
    sizes = rows.groupBy("block").agg(F.count("*").alias("lines"))
    each = F.explode(F.array_distinct(F.filter(code.variants(F.col("line")), lambda x: x != "")))
    asked = rows.select(each.alias("line")).distinct()
    own = code_lines(sources.select("owner", F.posexplode(F.split("text", "\n")).alias("line_no", "line")), "owner").select("owner", "line")
    own = _kept(own.join(asked, "line", "left_semi").distinct())  # all that is ever looked for
    pairs = _kept(_candidates(rows, own, classes.join(sizes.select("block"), "block", "left_semi"), sources, share))
    forms = rows.join(pairs, "block").select("block", "owner", "line_no", "line", each.alias("form"))
    known = own.withColumnRenamed("line", "form").withColumn("known", F.lit(True))
    met = forms.join(known, ["owner", "form"], "left").groupBy("block", "owner", "line_no", "line").agg(F.max("known").alias("known"), F.collect_set("form").alias("forms"))
    open_ = _kept(met.filter("known IS NULL").groupBy("block", "owner").agg(F.collect_list(F.struct("line_no", "line", "forms")).alias("open")))
    texts = sources.join(open_.select("owner").distinct(), "owner", "left_semi").groupBy("owner").agg(F.min("text").alias("text")).select("owner", without_space(F.col("text")).alias("bare"))
    inside = lambda bare: lambda x: F.exists(x["forms"], lambda f: (F.length(without_space(f)) >= LEAST_CHARS) & F.contains(bare, without_space(f)))
    lost = open_.join(texts, "owner").select("block", "owner", F.filter("open", lambda x: ~inside(F.col("bare"))(x)).alias("gone"))
    counted = pairs.join(lost, ["block", "owner"], "left").withColumn("lost", F.coalesce(F.size("gone"), F.lit(0)).cast("long"))
    best = _kept(counted.groupBy("block").agg(F.min_by(F.struct("owner", "lost", "gone"), F.struct("lost", "owner")).alias("b")).select("block", "b.*"))
    out = sizes.join(best, "block", "left")
    if snapshot is None:
        none = F.lit(None).cast("long")
        return out.select("block", "lines", "owner", "lost", none.alias("snapshot_lost"), none.alias("evolved"))
    gone = best.select("block", F.explode("gone.line").alias("line"))
    old = snapshot.select("line").join(gone.select("line").distinct(), "line", "left_semi").distinct()
    new = gone.join(old, "line", "left_anti").groupBy("block").agg(F.count("*").alias("missing"))
    missing = F.when(F.col("lost").isNotNull(), F.coalesce("missing", F.lit(0)))
    return out.join(new, "block", "left").select("block", "lines", "owner", "lost", missing.alias("snapshot_lost"), (F.col("lost") - missing).alias("evolved"))
