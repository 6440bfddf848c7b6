"""Contracts of JSON artifacts: a schema becomes column tests over parsed documents, every violation is a row.

Supported keywords: type, const, enum, required, properties, additionalProperties (false or a schema), items, minItems,
maxItems, minLength, maxLength, pattern, minimum, maximum. Documents are VARIANT columns, so all tests run in the JVM.
"""

from __future__ import annotations

import json
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYWORDS = {"type", "const", "enum", "required", "properties", "additionalProperties", "items", "minItems", "maxItems", "minLength", "maxLength", "pattern", "minimum", "maximum"}
ANNOTATIONS = {"$schema", "$id", "title", "description"}
#: JSON types, and how the kind of a parsed value begins. Integers of 19 to 38 digits are decimals without a fraction; longer ones are read as doubles.
TYPES = {"object": ("OBJECT",), "array": ("ARRAY",), "string": ("STRING",), "boolean": ("BOOLEAN",), "integer": ("BIGINT", r"DECIMAL\((19|2\d|3\d),0\)"), "number": ("BIGINT", "DOUBLE", "FLOAT", "DECIMAL"), "null": ("VOID",)}
_NONE = "array<struct<path: string, code: string>>"


def check_schema(schema, path: str = "$") -> None:
    """ValueError for a schema that is no object, or has a keyword or type that the tests do not cover."""
    if not isinstance(schema, dict):
        raise ValueError(f"{path}: a schema must be an object")
    if unknown := set(schema) - KEYWORDS - ANNOTATIONS:
        raise ValueError(f"{path}: unsupported keywords {sorted(unknown)}")
    declared = schema.get("type", [])
    if unknown := set([declared] if isinstance(declared, str) else declared) - TYPES.keys():
        raise ValueError(f"{path}: unsupported types {sorted(unknown)}")
    for name, child in schema.get("properties", {}).items():
        check_schema(child, f"{path}.{name}")
    for name in ("items", "additionalProperties"):
        if isinstance(child := schema.get(name, True), dict) or not isinstance(child, bool):
            check_schema(child, f"{path}.{name}")


def _no_finding() -> Column:
    return F.array().cast(_NONE)


def _let(value: Column, body) -> Column:
    """``body`` of a value and its kind, each computed once, whatever the number of places that use it."""
    bound = F.array(F.struct(value.alias("v"), F.schema_of_variant(value).alias("k")))
    return F.get(F.transform(bound, lambda x: body(x["v"], x["k"])), 0)


def _finding(bad: Column, path: Column, code: str) -> Column:
    return F.when(F.coalesce(bad, F.lit(False)), F.array(F.struct(path.alias("path"), F.lit(code).alias("code")))).otherwise(F.array().cast(_NONE))


def _is(kind: Column, names: list[str]) -> Column:
    """Whether the kind of a value is one of these types."""
    begins = [b for n in names for b in TYPES[n]]
    return F.coalesce(kind.rlike("^(" + "|".join(begins) + ")"), F.lit(False))


def _equals(value: Column, kind: Column, wanted) -> Column:
    kinds = {bool: ("boolean", "boolean"), int: ("integer", "decimal(38,0)"), float: ("number", "double"), str: ("string", "string")}
    if wanted is None:
        return _is(kind, ["null"])
    if isinstance(wanted, (list, dict)):  # the parser puts an object's keys in order, so equal values have equal texts
        return F.to_json(value) == F.to_json(F.parse_json(F.lit(json.dumps(wanted))))
    if isinstance(wanted, int) and not isinstance(wanted, bool):
        return _is(kind, ["integer"]) & (F.try_variant_get(value, "$", "decimal(38,0)") == F.lit(str(wanted)).cast("decimal(38,0)"))
    name, sql = kinds[type(wanted)]
    return _is(kind, [name]) & (F.try_variant_get(value, "$", sql) == F.lit(wanted))


def _tests(value: Column, kind: Column, schema: dict, path: Column) -> Column:
    """Findings of one value that is there; what fails by constant, list or type is not looked into."""
    listed = [schema["const"]] if "const" in schema else schema.get("enum")
    declared = schema.get("type")
    kinds = [declared] if isinstance(declared, str) else declared
    one = lambda code: F.array(F.struct(path.alias("path"), F.lit(code).alias("code")))
    deeper = []
    text, number = F.try_variant_get(value, "$", "string"), F.try_variant_get(value, "$", "double")
    exact, whole = F.try_variant_get(value, "$", "decimal(38,0)"), _is(kind, ["integer"])
    bound = lambda n: F.lit(str(n)).cast("decimal(38,0)")
    below = lambda n: F.when(whole, exact < bound(n)).otherwise(number < float(n)) if isinstance(n, int) else number < n
    above = lambda n: F.when(whole, exact > bound(n)).otherwise(number > float(n)) if isinstance(n, int) else number > n
    for word, of, bad in (("minLength", "string", lambda n: F.length(text) < n), ("maxLength", "string", lambda n: F.length(text) > n), ("pattern", "string", lambda p: ~text.rlike(p)), ("minimum", "number", lambda n: below(n)), ("maximum", "number", lambda n: above(n))):
        if word in schema:
            deeper.append(_finding(_is(kind, [of]) & bad(schema[word]), path, word.upper()))
    known, extra, required = schema.get("properties", {}), schema.get("additionalProperties", True), schema.get("required", [])
    child = lambda name: F.try_variant_get(value, f"$['{name}']", "variant")
    for name in {**dict.fromkeys(required), **known}:
        at, sub = F.concat(path, F.lit(f".{name}")), known.get(name)
        missing = _is(kind, ["object"]) if name in required else F.lit(False)
        deeper.append(_let(child(name), lambda v, k, at=at, sub=sub, missing=missing: F.when(v.isNull(), _finding(missing, at, "REQUIRED")).otherwise(_no_finding() if sub is None else _tests(v, k, sub, at))))
    if extra is not True:
        members = F.coalesce(F.map_entries(F.when(_is(kind, ["object"]), F.try_variant_get(value, "$", "map<string, variant>"))), F.array().cast("array<struct<key: string, value: variant>>"))
        others = F.filter(members, lambda m: ~m["key"].isin(*known)) if known else members
        at = lambda m: F.concat(path, F.lit("."), m["key"])
        deeper.append(F.transform(others, lambda m: F.struct(at(m).alias("path"), F.lit("UNEXPECTED").alias("code"))) if extra is False else F.flatten(F.transform(others, lambda m: _let(m["value"], lambda v, k: _tests(v, k, extra, at(m))))))
    if {"items", "minItems", "maxItems"} & schema.keys():
        members = F.when(_is(kind, ["array"]), F.try_variant_get(value, "$", "array<variant>"))
        if "minItems" in schema:
            deeper.append(_finding(F.size(members) < schema["minItems"], path, "MINITEMS"))
        if "maxItems" in schema:
            deeper.append(_finding(F.size(members) > schema["maxItems"], path, "MAXITEMS"))
        if schema.get("items"):
            each = F.transform(members, lambda x, i: _let(x, lambda v, k: _tests(v, k, schema["items"], F.concat(path, F.lit("["), i.cast("string"), F.lit("]")))))
            deeper.append(F.coalesce(F.flatten(each), _no_finding()))
    out = F.concat(*deeper) if len(deeper) > 1 else deeper[0] if deeper else _no_finding()
    if kinds:
        out = F.when(_is(kind, kinds), out).otherwise(one("TYPE"))
    if listed is not None:
        same = reduce(or_, (F.coalesce(_equals(value, kind, x), F.lit(False)) for x in listed))
        out = F.when(same, out).otherwise(one("VALUE_NOT_LISTED"))
    return out


def findings(rows: DataFrame, key: str, document: str, schema: dict) -> DataFrame:
    """(key, path, code): what each document violates. A null document (no JSON, or a repeated key) is one finding, JSON."""
    check_schema(schema)
    value = F.col(document)
    own = F.when(value.isNull(), F.array(F.struct(F.lit("$").alias("path"), F.lit("JSON").alias("code")))).otherwise(_let(value, lambda v, k: _tests(v, k, schema, F.lit("$"))))
    return rows.select(key, F.explode(own).alias("_f")).select(key, "_f.path", "_f.code")


def artifact_findings(rows: DataFrame, key: str, document: str, registry: dict[tuple[str, str], dict]) -> DataFrame:
    """As ``findings``, each document by the schema of its artifact_kind and schema_version.

    A version that is not of three numbers is VERSION, one of a major number that no schema has MAJOR, and another pair
    without a schema KIND.
    """
    named = rows.withColumn("_kind", F.try_variant_get(document, "$.artifact_kind", "string")).withColumn("_version", F.try_variant_get(document, "$.schema_version", "string"))
    which = [(F.coalesce((F.col("_kind") == k) & (F.col("_version") == v), F.lit(False)), schema) for (k, v), schema in registry.items()]
    none = F.lit(True)
    for match, _ in which:
        none = none & ~match
    version = F.coalesce("_version", F.lit(""))
    code = (
        F.when(F.col(document).isNull(), "JSON").when(~version.rlike(r"^(0|[1-9]\d*)\.(0|[1-9]\d*)\.(0|[1-9]\d*)$"), "VERSION")
        .when(~F.substring_index(version, ".", 1).isin(*{v.split(".")[0] for _, v in registry}), "MAJOR").otherwise("KIND")
    )
    at = F.when(code == "JSON", "$").when(code == "KIND", "$.artifact_kind").otherwise("$.schema_version")
    out = named.filter(none).select(key, at.alias("path"), code.alias("code"))
    for match, schema in which:
        out = out.unionByName(findings(named.filter(match), key, document, schema))
    return out
