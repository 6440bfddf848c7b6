"""Substring deduplication by hashing paragraphs, lines and sentences.

A unit is a paragraph of several lines, a run of short lines, a line, or a sentence of one: lower-cased, white space
collapsed, of at least ``MIN_WORDS`` words or ``MIN_UNSPACED`` characters of scripts that set no spaces. So a repeated line
of short sentences goes as a whole, as does a verse or list of short lines, and a long sentence goes from a line that is
otherwise new. Units are grouped by a 128-bit digest over the whole corpus. The occurrence in the document with the
smallest doc_id, at the smallest offset there, stays; all others are removed, with the code-point offsets of the original
text and the keeper's doc_id on record. A unit that goes with a longer one is not recorded on its own.

The group-by is a partial minimum, so a line that every document has costs a row for each map task; only digests that
more than one document has are joined back, which adaptive execution can split by skew.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm.common import private, ranges, written

#: Shorter units are never compared (1 compares all).
MIN_WORDS, MIN_UNSPACED = 6, 24
#: A line without the white space around it.
LINE = re.compile(r"\S(?:[^\n]*\S)?")
#: What stands between paragraphs: a line of white space alone.
BLANK = re.compile(r"\n[^\S\n]*\n\s*")
#: What stands between the sentences of a line; marks of unspaced scripts need no white space.
BORDER = re.compile(r"(?<=[.!?。！？])\s+|(?<=[。！？])(?=[^\s。！？])")
#: Characters of scripts without spaces: Thai to Khmer, kana, Han.
UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff]")
UNITS = "doc_id bigint, body bigint, digest binary, begin int, end int, local boolean"
NO_ID = (1 << 63) - 1


def _normal(text: str, min_words: int) -> str | None:
    """The normalised unit, or null if it is too short."""
    words = text.lower().split()
    if len(words) >= min_words or not text.isascii() and len(UNSPACED.findall(text)) >= MIN_UNSPACED:
        return " ".join(words)
    return None


def units(text: str, min_words: int = MIN_WORDS) -> Iterator[tuple[bytes, int, int]]:
    """(digest, begin, end) of the units of a text by begin, longer ones first; none has the span of another."""
    import xxhash

    def found(lo: int, hi: int) -> Iterator[tuple[bytes, int, int]]:
        unit = _normal(text[lo:hi], min_words)
        if unit is not None:
            yield xxhash.xxh3_128_digest(unit.encode("utf-8", "surrogatepass")), lo, hi

    blanks = [m.span() for m in BLANK.finditer(text)]
    for start, stop in zip([0, *(b for _, b in blanks)], [*(a for a, _ in blanks), len(text)], strict=True):
        lines = [m.span() for m in LINE.finditer(text, start, stop)]
        if len(lines) > 1:
            yield from found(lines[0][0], lines[-1][1])
        short = [_normal(text[a:b], min_words) is None for a, b in lines]
        for k, (begin, end) in enumerate(lines):
            if short[k]:
                if k == 0 or not short[k - 1]:  # a run of short lines begins
                    last = k
                    while last + 1 < len(lines) and short[last + 1]:
                        last += 1
                    if k < last and last - k + 1 < len(lines):
                        yield from found(begin, lines[last][1])
                continue
            yield from found(begin, end)
            borders = [m.span() for m in BORDER.finditer(text, begin, end)]
            if borders:
                for lo, hi in zip([begin, *(b for _, b in borders)], [*(a for a, _ in borders), end], strict=True):
                    yield from found(lo, hi)


def unit_table(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """All units, written to the shared folder; ``local`` marks those that occur earlier in the same row's text.

    ``body`` is a hash of the text, so that rows which share a doc_id but not a text are told apart.
    """
    source = docs.select("doc_id", F.xxhash64("text").alias("body"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in ranges(batch.column("text")):
                part, out = batch.slice(lo, hi - lo), []
                for doc_id, body, text in zip(*(part.column(c).to_pylist() for c in ("doc_id", "body", "text")), strict=True):
                    seen: set[bytes] = set()
                    for digest, begin, end in units(text, min_words):
                        out.append((doc_id, body, digest, begin, end, digest in seen))
                        seen.add(digest)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.bool_()), strict=True)], names=["doc_id", "body", "digest", "begin", "end", "local"])

    return written(source.mapInArrow(run, UNITS))


def removals(found: DataFrame) -> DataFrame:
    """(doc_id, body, spans): the removed stretches of each text, in order, with the doc_id that keeps the unit."""
    rank = F.coalesce("doc_id", F.lit(NO_ID))
    once = found.filter(~F.col("local"))
    firsts = once.groupBy("digest").agg(F.min(rank).alias("first"), F.max(rank).alias("last")).filter("first < last").drop("last")
    elsewhere = once.join(firsts, "digest").filter(rank > F.col("first")).select("doc_id", "body", "begin", "end", F.col("first").alias("kept_in"))
    # a repeat within a text goes whether or not its first occurrence there stays
    here = found.filter("local").select("doc_id", "body", "begin", "end", F.col("doc_id").alias("kept_in"))
    outer_first = F.sort_array(F.collect_set(F.struct("begin", (-F.col("end")).alias("to"), "kept_in")))
    gone = elsewhere.union(here).groupBy("doc_id", "body").agg(outer_first.alias("spans"))
    return gone.withColumn("spans", F.transform("spans", lambda x: F.struct(x["begin"].alias("begin"), (-x["to"]).alias("end"), x["kept_in"].alias("kept_in"))))


def _cut():
    """A column function (text, begins, ends) -> (text without the spans, numbers of the spans that lie in no earlier one)."""
    import pandas as pd
    from pyspark.sql.functions import pandas_udf

    def cut(texts, begins, ends):
        kept_text, numbers = [], []
        for text, begin, end in zip(texts, begins, ends, strict=True):
            parts, used, at, to = [], [], 0, 0
            for k, (a, b) in enumerate(zip(begin, end, strict=True) if text is not None and begin is not None else ()):
                if a < to:  # a sentence of a removed line
                    continue
                parts.append(text[at:a])
                used.append(k)
                to = b
                at = b + (b < len(text) and text[b].isspace())  # the white space that followed the unit goes with it
            kept_text.append("".join((*parts, text[at:])) if used else text)
            numbers.append(used)
        return pd.DataFrame({"text": pd.Series(kept_text, dtype=object), "used": pd.Series(numbers, dtype=object)})

    cut.__annotations__ = {"texts": pd.Series, "begins": pd.Series, "ends": pd.Series, "return": pd.DataFrame}
    return pandas_udf(cut, "text string, used array<int>")


def dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The rows of ``docs`` with all their columns, ``text`` without repeated units, and a last column ``removed_spans``.

    ``removed_spans`` is an array of (begin, end, kept_in) in code points of the original text, empty where nothing is
    removed. Null texts stay null, empty ones empty; a null doc_id ranks last (kept_in is then null for repeats in the
    same text). Rows that share a doc_id count as one document: a unit that both have stays in both. A column
    of ``docs`` named ``removed_spans`` is replaced.
    """
    doc, body, spans, own, done = private(docs, "doc", "body", "spans", "hash", "done")
    gone = removals(unit_table(docs, min_words)).select(F.col("doc_id").alias(doc), F.col("body").alias(body), F.col("spans").alias(spans))
    kept = [docs[c] for c in docs.columns if c != "removed_spans"]
    joined = docs.select(*kept, F.xxhash64("text").alias(own)).join(gone, F.col("doc_id").eqNullSafe(F.col(doc)) & (F.col(own) == F.col(body)), "left")
    cut = joined.withColumn(done, _cut()("text", F.col(f"{spans}.begin"), F.col(f"{spans}.end")))
    columns = [F.col(f"{done}.text").alias(c) if c == "text" else F.col(c) for c in docs.columns if c != "removed_spans"]
    return cut.select(*columns, F.expr(f"transform({done}.used, k -> {spans}[k])").alias("removed_spans"))
