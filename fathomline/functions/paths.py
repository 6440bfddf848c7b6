"""Path expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_under(path: Column, prefix: str) -> Column:
    """The path equals the prefix or lies below it; an empty prefix holds every path."""
    return F.lit(True) if not prefix else (path == prefix) | path.startswith(prefix + "/")


def rebased(path: Column, prefix: str) -> Column:
    return path if not prefix else F.substring(path, len(prefix) + 2, 1 << 30)


def normalized(path: Column) -> Column:
    """Leading ``./`` dropped; null where the path is no safe relative one (empty, absolute, backslash, drive, dot parts)."""
    bare = F.regexp_replace(path, r"^(\./)+", "")
    bad = (bare == "") | bare.contains("\\") | bare.rlike(r"^/|^[A-Za-z]:|(^|/)\.{0,2}(/|$)")
    return F.when(~bad, bare)


def components(path: Column) -> Column:
    """Directories of a path, as written."""
    parts = F.split(path, "/")
    return F.slice(parts, F.lit(1), F.size(parts) - 1)


def name(path: Column) -> Column:
    return F.lower(F.element_at(F.split(path, "/"), -1))


def extension(path: Column) -> Column:
    """Last suffix in lower case if it is alphanumeric; a dot file without a stem has none."""
    return F.regexp_extract(name(path), r"^.+\.([a-z0-9]+)$", 1)


def module_name(path: Column) -> Column:
    """Dotted module name of a source path, without a final ``__init__``."""
    return F.regexp_replace(F.translate(F.regexp_replace(path, r"\.py$", ""), "/", "."), r"(^|\.)__init__$", "")


def ancestors(path: Column) -> Column:
    """All directories above a path, deepest first; the root is the empty string."""
    parts = components(path)
    return F.transform(F.sequence(F.size(parts), F.lit(0)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
