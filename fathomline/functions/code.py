"""Expressions over source and prose lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = r"[\x{4e00}-\x{9fff}]"
#: A line-number note at the end of a line, behind the mark of a comment: ``// :L12 text``, ``# :L12-14``; a fixed value.
NOTE = r"\s*(?://|#|--)\s*:L?(\d+(?:-\d+)?)[ \t]*(.*)$"


def without_note(line: Column) -> Column:
    return F.regexp_replace(line, NOTE, "")


def normalized(line: Column) -> Column:
    """Note dropped, white space collapsed and trimmed."""
    return F.trim(F.regexp_replace(without_note(line), r"\s+", " "))


# What makes a licence, punctuation alone, a comment, a bare declaration; words of exempt and historical headings.
LICENSE = r"Licensed to the Apache|Apache License|WITHOUT WARRANTIES|limitations under the License"
PUNCTUATION_ONLY = r"^[{}()\[\];,<>\s]*$"
COMMENT = r"^\s*(//|/\*|\*|#|--)"
BARE_DECLARATION = r"^\s*(?:public|private|protected|static|final|\s)*[A-Za-z_][\w<>\[\],\.\s]*\s+\w+\s*;\s*$"
EXEMPT = r"(?i)手写|No-Framework|不用框架|等价实现|反例|反面对照|对照实现|穿透卡|穿透|示例|演示|伪代码|八股|面试|卡[一二三四五六七八九十0-9]|L0-L4|L1-L4|例 \d|Tiny|样例节选"
HISTORICAL = r"(?i)【历史版本|历史版本示例|历史快照|已被阶段\s*\d+"
LINE_NUMBER = r"(//|#|--)\s*:L?\d+"
STAR = "★"
# End of fixed values.


def note_text(line: Column) -> Column:
    """What follows the line number in a note; empty without one."""
    return F.regexp_extract(line, NOTE, 2)


def is_key_line(line: Column, in_license: Column | None = None, in_text: Column | None = None) -> Column:
    """Lines that carry logic: not blank, no licence, no package, import or export, not punctuation or a declaration alone, no text block."""
    bare = F.trim(F.regexp_replace(without_note(line), r"\s+", " "))
    held = F.coalesce(in_license, F.lit(False)) if in_license is not None else F.lit(False)
    held = held | F.coalesce(in_text, F.lit(False)) if in_text is not None else held
    return ~held & (bare != "") & ~bare.rlike(LICENSE) & ~bare.rlike(r"^(package|import|export) ") & ~bare.rlike(PUNCTUATION_ONLY) & ~bare.rlike(BARE_DECLARATION)


def has_cjk_comment(line: Column) -> Column:
    """CJK text in the note, behind ``//``, or anywhere in a line that is a comment."""
    bare = without_note(line)
    tail = F.substring(bare, F.length(F.substring_index(bare, "//", 1)) + 1, F.length(bare))
    return has_cjk(note_text(line)) | has_cjk(tail) | bare.rlike(COMMENT) & has_cjk(bare)


def is_exempt(section: Column, chapter: Column, mark: Column, block: Column) -> Column:
    """Blocks that need no source: by a word of their section or chapter, under 9.x, or under a usage mark without line numbers."""
    empty = lambda c: F.coalesce(c, F.lit(""))
    return empty(section).rlike(EXEMPT) | empty(chapter).rlike(EXEMPT) | empty(section).rlike(r"^#{3,5}\s*9\.") | (empty(mark) != "") & ~empty(block).rlike(LINE_NUMBER)


def is_historical(section: Column, chain: Column) -> Column:
    """The section's heading, or any above it, declares an old version."""
    return F.coalesce(section, F.lit("")).rlike(HISTORICAL) | F.coalesce(F.exists(chain, lambda h: h.rlike(HISTORICAL)), F.lit(False))


def is_star(section: Column, chain: Column) -> Column:
    """The section's heading, or any above it, has a star."""
    return F.contains(F.coalesce(section, F.lit("")), F.lit(STAR)) | F.coalesce(F.exists(chain, lambda h: F.contains(h, F.lit(STAR))), F.lit(False))


def variants(line: Column) -> Column:
    """The line, and the line without a trailing ``//`` comment."""
    return F.array(line, F.trim(F.substring_index(line, "//", 1)))


def has_cjk(text: Column) -> Column:
    return text.rlike(CJK)


def version_at_least(version: Column, least: str) -> Column:
    """Compare dotted numbers part by part (``2.10`` is above ``2.9``); null where a part is no number."""
    want = F.array(*(F.lit(int(x)) for x in least.split(".")))
    parts = F.transform(F.split(version, r"\."), lambda x: F.when(x.rlike(r"^\d+$"), x.try_cast("int")))
    return F.when(F.forall(parts, lambda x: x.isNotNull()), parts >= want)


def slug(heading: Column) -> Column:
    """Anchor of a heading: marks and tags dropped, lower case, words joined by hyphens."""
    bare = F.lower(F.trim(F.regexp_replace(F.regexp_replace(heading, r"<[^>]*>", ""), r"[`*~]", "")))
    return F.regexp_replace(F.regexp_replace(bare, r"[^\p{L}\p{N}_\s-]", ""), r"\s+", "-")


def escaped_markdown(text: Column) -> Column:
    out = text
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(plain), F.lit(entity))
    return F.regexp_replace(out, r"([\\`*_{}\[\]()#+.!|-])", r"\\$1")


def sentences(paragraph: Column) -> Column:
    """A paragraph split after sentence ends."""
    return F.filter(F.split(paragraph, r"(?<=[.!?])[\t\n\f\r ]+"), lambda x: x != "")


#: Numbers that name a section whatever its wording, and how a list within a sentence counts.
CIRCLED = "①②③④⑤⑥⑦⑧⑨⑩⑪⑫⑬⑭⑮⑯"
ENUMERATED = r"(?=\*\*其[一二三四五六]，)"


def section_key(heading: Column) -> Column:
    """What a section goes by: its circled number, or ``索引``, or else its text."""
    body = F.trim(F.regexp_replace(heading, "^## ", ""))
    mark = F.regexp_extract(body, f"^([{CIRCLED}]|索引)", 1)
    return F.when(mark != "", mark).otherwise(body)


def enumeration(paragraph: Column) -> Column:
    """The lead and the items of a list within a paragraph, items with a dash; null with fewer than two items."""
    parts = F.filter(F.transform(F.split(paragraph, ENUMERATED), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.size(parts) >= 3, F.transform(parts, lambda x, i: F.when(i == 0, x).otherwise(F.concat(F.lit("- "), x))))


def declared_classes(text: Column) -> Column:
    """Names of the types that a text declares, in order."""
    return F.regexp_extract_all(text, F.lit(r"(?:\b(?:class|interface|enum|record)|@interface)\s+([A-Z][A-Za-z0-9_]*)"), F.lit(1))


def decoded(payload: Column) -> Column:
    """(text, skipped) of a source's bytes: UTF-8 with or without a mark, or Latin-1 where a coding line says so."""
    import io
    import tokenize

    import pandas as pd
    from pyspark.sql.functions import pandas_udf

    def read(payloads):
        out = []
        for raw in payloads:
            try:
                if raw is None or b"\0" in raw:
                    out.append((None, "BINARY_SOURCE" if raw is not None else None))
                    continue
                name, _ = tokenize.detect_encoding(io.BytesIO(raw).readline)
                known = name.lower().replace("_", "-") in ("utf-8", "utf-8-sig", "latin-1", "iso-8859-1")
                out.append((raw.decode(name), None) if known else (None, "UNSUPPORTED_ENCODING"))
            except (SyntaxError, UnicodeError, LookupError):
                out.append((None, "UNSUPPORTED_ENCODING"))
        return pd.DataFrame(out, columns=["text", "skipped"])

    read.__annotations__ = {"payloads": pd.Series, "return": pd.DataFrame}
    return pandas_udf(read, "text string, skipped string")(payload)
