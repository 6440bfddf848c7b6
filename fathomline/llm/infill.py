"""Fill-in-the-middle transformation with a two-pass matcher in constant memory.

A text is cut into units by a pattern. The first pass counts them; two hashes of the document's id give two ranks; the
second pass advances a lazy iterator of matches to the smaller rank and then on to the larger one. No list of units or of
their places is ever held, whatever the text's length: besides the text there are two integers and one match.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.llm.common import ranges

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Lines with their line feed, the last one perhaps without.
LINES = r"[^\n]*\n|[^\n]+"
FIELDS = "n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"


def numbers(doc_id: int | None, seed: int) -> tuple[int, int, int, int]:
    """The first four groups of eight hexadecimal digits of the sha256 of ``seed:doc_id`` (a null id: nothing after the colon)."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[k : k + 4]) for k in range(0, 16, 4))  # type: ignore[return-value]


def _after(walk: Iterator[re.Match], steps: int, at: int) -> int:
    """Where the match ends that is ``steps`` further on (``at`` for none)."""
    for match in islice(walk, steps):
        at = match.end()
    return at


def spots(text: str, pattern: re.Pattern, h1: int, h2: int) -> tuple[int, int, int]:
    """(number of units, end of the prefix, end of the middle) in code points."""
    n = sum(1 for _ in pattern.finditer(text))
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    walk = pattern.finditer(text)
    first = _after(walk, low, 0)
    return n, first, _after(walk, high - low, first)


def transform(docs: DataFrame, seed: int = 7, pattern: str = LINES, percent: int = 100, spm_percent: int = 50) -> DataFrame:
    """Per row: doc_id, n (units), form, prefix_chars, middle_chars, output.

    ``percent`` of the documents are transformed, ``spm_percent`` of them suffix first; both choices depend on doc_id and
    ``seed`` alone. Null texts count as empty ones, whose form is plain, as is that of texts that hold a mark; plain
    texts come out as they are, with null lengths. A null doc_id hashes like an empty one; repeated rows are repeated.
    Matches of ``pattern`` have to lie side by side: what is behind the last one taken goes to the next part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = re.compile(pattern)
        for batch in batches:
            for lo, hi in ranges(batch.column("text")):
                part, out = batch.slice(lo, hi - lo), []
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    text = text or ""
                    h1, h2, h3, h4 = numbers(doc_id, seed)
                    n, a, b = spots(text, units, h1, h2)
                    if not text or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= percent:
                        out.append((n, "plain", None, None, text))
                    elif h4 % 100 < spm_percent:
                        out.append((n, "spm", a, b - a, "".join((SUFFIX, text[b:], PREFIX, text[:a], MIDDLE, text[a:b]))))
                    else:
                        out.append((n, "psm", a, b - a, "".join((PREFIX, text[:a], SUFFIX, text[b:], MIDDLE, text[a:b]))))
                made = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *made], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {FIELDS}")


def restored(output: Column, form: Column) -> Column:
    """The text that ``transform`` took, from its output and form alone.

    No part holds a mark, and no end of a part makes one together with the mark behind it, so the first occurrence of each
    mark is the one that was set.
    """

    def parts(second: str) -> tuple[Column, Column, Column]:
        body = F.substr(output, F.lit(4))
        one = F.substring_index(body, second, 1)
        rest = F.substr(body, F.length(one) + 4)
        two = F.substring_index(rest, MIDDLE, 1)
        return one, two, F.substr(rest, F.length(two) + 4)

    prefix, suffix, middle = parts(SUFFIX)
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = parts(PREFIX)
    return F.when(form == "psm", psm).when(form == "spm", F.concat(prefix, middle, suffix)).otherwise(output)


def digests(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: the lengths of ``transform`` and the sha256 of its output and of the text rebuilt from it."""
    made = transform(docs)
    back = restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))
