"""Lines and spans over bytes: a line ends with LF, CR or CRLF, offsets and digests are those of the bytes.

Bytes are read as Latin-1, a character for each byte, so all of this is string functions in the row, without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.functions import paths
from fathomline.functions.ids import json_string

#: Kinds of files that hold no text of their own, the longest excerpt, the level that an excerpt's evidence has.
NO_TEXT = ["binary", "symlink", "gitlink"]
MOST_LINES, SOURCE_LEVEL = 20, "E1"


def byte_lines(payload: Column) -> Column:
    """The lines of a payload with their ends, as Latin-1 texts; what follows the last end is a line if there is anything."""
    return F.filter(F.split(F.decode(payload, "ISO-8859-1"), r"(?<=\n)|(?<=\r)(?!\n)", -1), lambda x: x != "")


def byte_span(payload: Column, first: Column, last: Column) -> Column:
    """(begin, bytes) of the lines ``first`` to ``last`` (from 1, inclusive); null where the payload has no such lines."""
    held = F.array(byte_lines(payload))  # bound once
    valid = lambda rows: (first >= 1) & (last >= first) & (last <= F.size(rows))
    cut = lambda rows, lo, n: F.array_join(F.slice(rows, lo, n), "")
    made = F.transform(held, lambda rows: F.when(valid(rows), F.struct(F.length(cut(rows, F.lit(1), (first - 1).cast("int"))).alias("begin"), F.encode(cut(rows, first.cast("int"), (last - first + 1).cast("int")), "ISO-8859-1").alias("bytes"))))
    return F.when(payload.isNotNull() & first.isNotNull() & last.isNotNull(), F.get(made, 0))


def documentation_evidence(selections: DataFrame, files: DataFrame, revision: str, kind: str) -> DataFrame:
    """(path, line_start, line_end, id, file_sha256, span_sha256, span_bytes, error) of each selection of lines of Markdown files.

    ``selections`` (path, line_start, line_end), ``files`` (path, payload, tracked, content_kind). ``error`` tells what a
    selection lacks, its other columns are null then: PATH_INVALID (not canonical, or no Markdown), SELECTION_REPEATED,
    FILE_UNKNOWN (or not tracked), FILE_NO_TEXT (of another kind, with a NUL byte, or no UTF-8), RANGE_INVALID.
    """
    asked = selections.groupBy("path", "line_start", "line_end").agg(F.count("*").alias("_times"))
    rows = asked.join(files.select("path", "payload", "tracked", "content_kind", F.lit(True).alias("_there")), "path", "left")
    bare = F.col("payload")
    text = bare.cast("string")
    # a byte-order mark is part of UTF-8 text
    plain = ~F.col("content_kind").isin(NO_TEXT) & (F.position(F.lit(b"\x00"), bare) == 0) & F.is_valid_utf8(text)
    rows = rows.withColumn("_span", byte_span(bare, F.col("line_start"), F.col("line_end")))
    error = (
        F.when(~F.coalesce(paths.normalized(F.col("path")) == F.col("path"), F.lit(False)) | ~F.lower("path").endswith(".md"), "PATH_INVALID")
        .when(F.col("_times") > 1, "SELECTION_REPEATED").when(~F.coalesce(F.col("_there") & F.col("tracked"), F.lit(False)), "FILE_UNKNOWN")
        .when(~F.coalesce(plain, F.lit(False)), "FILE_NO_TEXT").when(F.col("_span").isNull(), "RANGE_INVALID")
    )
    rows = rows.withColumn("error", error)
    file_sha, span_sha = F.sha2("payload", 256), F.sha2("_span.bytes", 256)
    parts = [json_string(F.lit("repository_documentation")), json_string(F.lit(revision)), json_string(F.lit(kind)), json_string(F.col("path")), F.col("line_start").cast("string"), F.col("line_end").cast("string"), json_string(file_sha), json_string(span_sha)]
    identity = F.concat(F.lit("EVID-"), F.substring(F.sha2(F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]")), 256), 1, 24))
    good = lambda c: F.when(F.col("error").isNull(), c)
    return rows.select("path", "line_start", "line_end", good(identity).alias("id"), good(file_sha).alias("file_sha256"), good(span_sha).alias("span_sha256"), good(F.octet_length("_span.bytes")).cast("long").alias("span_bytes"), "error")


def excerpt_findings(excerpts: DataFrame, evidence: DataFrame, files: DataFrame, most_lines: int = MOST_LINES) -> DataFrame:
    """(doc, spot, code) of excerpts that do not stand for what they cite; an excerpt without a row here holds.

    ``excerpts`` (doc, spot, evidence, path, first, last, shown, sha256), where ``shown`` is the text between the fences
    without the line feed before the closing one; ``evidence`` (id, level, path, line_start, line_end); ``files`` (path,
    payload). Codes, the first that applies: RANGE (or too many lines), EVIDENCE (unknown, not of a source, of another path
    or other lines), SOURCE (no such file or lines), BODY (the bytes differ: the closing fence's line feed may stand for the
    file's last one, and may be missing there), DIGEST.
    """
    known = evidence.select(F.col("id").alias("evidence"), "level", F.col("path").alias("_path"), "line_start", "line_end")
    rows = excerpts.join(known, "evidence", "left").join(files.select("path", "payload"), "path", "left")
    rows = rows.withColumn("_span", byte_span(F.col("payload"), F.col("first"), F.col("last")))
    shown = F.encode(F.coalesce("shown", F.lit("")), "UTF-8")
    body = F.col("_span.bytes")
    same = (F.concat(shown, F.encode(F.lit("\n"), "UTF-8")) == body) | (shown == body) & (F.right(F.decode(body, "ISO-8859-1"), F.lit(1)) != "\n")
    cited = (F.col("level") == SOURCE_LEVEL) & (F.col("_path") == F.col("path")) & (F.col("line_start") <= F.col("first")) & (F.col("last") <= F.col("line_end"))
    no = lambda c: ~F.coalesce(c, F.lit(False))
    code = (
        F.when(no((F.col("first") >= 1) & (F.col("first") <= F.col("last")) & (F.col("last") - F.col("first") < most_lines)), "RANGE").when(no(cited), "EVIDENCE")
        .when(F.col("_span").isNull(), "SOURCE").when(no(same), "BODY").when(no(F.sha2(body, 256) == F.col("sha256")), "DIGEST")
    )
    return rows.select("doc", "spot", code.alias("code")).filter("code IS NOT NULL")
