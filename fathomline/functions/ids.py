"""Content-addressed identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_string(value: Column) -> Column:
    """A string as a JSON literal: quotes, backslashes and all control characters below a space escaped, others as they are."""
    short = {"\b": "\\b", "\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r"}
    out = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    escaped = out
    for c in map(chr, range(32)):
        escaped = F.replace(escaped, F.lit(c), F.lit(short.get(c, f"\\u{ord(c):04x}")))
    return F.concat(F.lit('"'), F.when(out.rlike(r"[\x00-\x1f]"), escaped).otherwise(out), F.lit('"'))


def canonical_tuple(*parts: Column) -> Column:
    """Compact JSON array of string parts; a null part is ``null``."""
    items = [F.coalesce(json_string(p), F.lit("null")) for p in parts]
    return F.concat(F.lit("["), F.concat_ws(",", *items), F.lit("]"))


def tuple_sha256(*parts: Column) -> Column:
    return F.sha2(canonical_tuple(*parts), 256)


def stable_id(prefix: str, *parts: Column, digits: int = 24) -> Column:
    """``prefix-`` and the first hex digits of the tuple's digest."""
    return F.concat(F.lit(f"{prefix}-"), F.substring(tuple_sha256(*parts), 1, digits))


def concept_label(label: Column) -> Column:
    """Composed form (NFC) and no white space around; null where nothing is left."""
    import unicodedata

    import pandas as pd
    from pyspark.sql.functions import pandas_udf

    def normal(labels):
        return pd.Series([None if x is None else unicodedata.normalize("NFC", x).strip() or None for x in labels], dtype=object)

    normal.__annotations__ = {"labels": pd.Series, "return": pd.Series}
    own = pandas_udf(normal, "string")
    # ASCII is composed already; an expression with Python in it runs it for all rows, so only its result is chosen
    plain = F.regexp_replace(label, r"^[\s\x1c-\x1f\x{85}]+|[\s\x1c-\x1f\x{85}]+$", "")
    return F.when(label.rlike(r"^[\x00-\x7f]*$"), F.when(plain != "", plain)).otherwise(own(label))
