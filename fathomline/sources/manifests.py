"""Facts from build manifests, each from a table (path, text)."""

from __future__ import annotations

import tomllib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.functions.paths import extension

FACTS = ["path", "section", "name", "version"]


def _named(files: DataFrame, pattern: str) -> DataFrame:
    """Files by name, in any case."""
    return files.filter(F.lower("path").rlike(pattern))


def requirements(files: DataFrame) -> DataFrame:
    """Packages of requirement files; comments, options and blank lines are skipped."""
    lines = _named(files, r"(^|/)requirements([-_][a-z0-9_.-]+)?\.txt$").select("path", F.explode(F.split("text", "\r?\n")).alias("line"))
    wanted = lines.withColumn("line", F.trim(F.regexp_replace("line", r"(^|\s)#.*$", ""))).filter("line <> '' and not startswith(line, '-')")
    name = F.lower(F.regexp_extract("line", r"^([A-Za-z0-9][A-Za-z0-9._-]*)", 1))
    return wanted.select("path", F.lit("requirements").alias("section"), name.alias("name"), F.regexp_extract("line", r"==\s*([^\s;]+)", 1).alias("version")).filter("name <> ''")


def package_json(files: DataFrame) -> DataFrame:
    """One fact for each package and dependency section, and a row MALFORMED for files that are no JSON object."""
    sections = ["dependencies", "devDependencies", "peerDependencies", "optionalDependencies"]
    own = _named(files, r"(^|/)package\.json$")
    parsed = own.select("path", F.from_json("text", "struct<" + ", ".join(f"{s}: map<string, string>" for s in sections) + ">").alias("m"))
    rows = [parsed.select("path", F.lit(s).alias("section"), F.explode(f"m.{s}").alias("name", "version")) for s in sections]
    object_ = F.coalesce(F.schema_of_variant(F.try_parse_json("text")).startswith("OBJECT"), F.lit(False))
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3]).unionByName(_malformed(own.filter(~object_)))


def _malformed(files: DataFrame) -> DataFrame:
    return files.select("path", F.lit("MALFORMED").alias("section"), F.lit("").alias("name"), F.lit("").alias("version"))


def pom(files: DataFrame) -> DataFrame:
    """Direct dependencies of Maven files as ``group:artifact`` with their version, and a row MALFORMED for other files.

    A dependency that lacks either part gives no fact. Files with a document type or an entity are refused, in any case.
    """
    known = "dependencies struct<dependency: array<struct<groupId: string, artifactId: string, version: string>>>, broken string"
    own = _named(files, r"(^|/)pom\.xml$").withColumn("_refused", F.coalesce(F.col("text"), F.lit("")).rlike(r"(?i)<!\s*(doctype|entity)\b"))
    read = own.withColumn("_m", F.from_xml(F.when(~F.col("_refused"), F.col("text")), known, {"ignoreNamespace": "true", "columnNameOfCorruptRecord": "broken"}))
    root = F.coalesce(F.col("text"), F.lit("")).rlike(r"^\s*(<\?[^>]*>\s*|<!--(?s:.*?)-->\s*)*<(\w+:)?project[\s/>]")
    fine = ~F.col("_refused") & F.col("_m.broken").isNull() & root
    part = lambda name: F.trim(F.col(f"d.{name}"))
    each = read.filter(fine).select("path", F.explode("_m.dependencies.dependency").alias("d")).filter((part("groupId") != "") & (part("artifactId") != ""))
    facts = each.select("path", F.lit("dependencies").alias("section"), F.concat_ws(":", part("groupId"), part("artifactId")).alias("name"), F.coalesce(part("version"), F.lit("")).alias("version"))
    return facts.unionByName(_malformed(read.filter(~fine)))


def pyproject(files: DataFrame) -> DataFrame:
    """Project dependencies and build requirements of TOML manifests, and a row MALFORMED for files that are no TOML."""
    import pandas as pd
    from pyspark.sql.functions import pandas_udf

    def parse(texts):
        out = []
        for text in texts:
            try:
                data = tomllib.loads(text or "")
            except tomllib.TOMLDecodeError:
                out.append(None)
                continue
            project, build = data.get("project"), data.get("build-system")
            found = [("dependencies", x) for x in (project if isinstance(project, dict) else {}).get("dependencies", [])]
            out.append([{"section": s, "requirement": x} for s, x in found + [("build", x) for x in (build if isinstance(build, dict) else {}).get("requires", [])] if isinstance(x, str)])
        return pd.Series(out, dtype=object)

    parse.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    facts = pandas_udf(parse, "array<struct<section: string, requirement: string>>")
    read = _named(files, r"(^|/)pyproject\.toml$").select("path", facts("text").alias("_facts"))
    rows = read.select("path", F.explode("_facts").alias("f"))
    found = rows.select("path", "f.section", F.lower(F.regexp_extract("f.requirement", r"^([A-Za-z0-9][A-Za-z0-9._-]*)", 1)).alias("name"), F.regexp_extract("f.requirement", r"==\s*([^\s;]+)", 1).alias("version"))
    return found.unionByName(_malformed(read.filter("_facts IS NULL")))


def is_manifest(path: Column) -> Column:
    """Files that facts come from, by name in any case."""
    return F.lower(F.element_at(F.split(path, "/"), -1)).rlike(r"^(pyproject\.toml|pom\.xml|package\.json|package-lock\.json|requirements([-_][a-z0-9_.-]+)?\.txt)$")


def languages(files: DataFrame) -> DataFrame:
    """(path, language) by suffix, for tracked text files that are neither generated, vendored nor left out.

    ``files`` (path, classification, content_kind).
    """
    table = {"cjs": "JavaScript", "cts": "TypeScript", "java": "Java", "js": "JavaScript", "jsx": "JavaScript", "mjs": "JavaScript", "mts": "TypeScript", "py": "Python", "pyi": "Python", "ts": "TypeScript", "tsx": "TypeScript"}
    known = F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), extension(F.col("path")))
    own = files.filter(~F.col("classification").isin("GENERATED", "VENDOR", "IGNORED_WITH_REASON") & (F.col("content_kind") == "text"))
    return own.select("path", known.alias("language")).filter("language IS NOT NULL")


def package_lock(files: DataFrame) -> DataFrame:
    """Locked packages with their versions, and a row MALFORMED for files of another form.

    Versions 2 and 3 name them by path under ``packages``, version 1 under ``dependencies``.
    """
    own = _named(files, r"(^|/)package-lock\.json$").withColumn("_v", F.try_parse_json("text"))
    kind = F.try_variant_get("_v", "$.lockfileVersion", "int")
    held = "map<string, variant>"
    listed = F.when(kind == 1, F.try_variant_get("_v", "$.dependencies", held)).when(kind.isin(2, 3), F.try_variant_get("_v", "$.packages", held))
    rows = own.select("path", kind.alias("_kind"), listed.alias("_m"))
    bad = _malformed(rows.filter("_m IS NULL"))
    each = rows.select("path", F.explode(F.map_entries("_m")).alias("e")).filter("e.key <> ''")
    return bad.unionByName(each.select("path", F.lit("lock").alias("section"), F.regexp_replace("e.key", r"^(.*/)?node_modules/", "").alias("name"), F.coalesce(F.try_variant_get("e.value", "$.version", "string"), F.lit("")).alias("version")))


def lock_conflicts(files: DataFrame) -> DataFrame:
    """Directories with lock files of more than one package manager."""
    managers = {"package-lock.json": "npm", "npm-shrinkwrap.json": "npm", "yarn.lock": "yarn", "pnpm-lock.yaml": "pnpm", "bun.lockb": "bun"}
    table = F.create_map(*(F.lit(x) for p in managers.items() for x in p))
    parts = F.split("path", "/")
    own = files.select(F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/").alias("dir"), F.try_element_at(table, F.element_at(parts, -1)).alias("manager")).filter("manager is not null")
    return own.groupBy("dir").agg(F.array_sort(F.collect_set("manager")).alias("managers")).filter("size(managers) > 1")


def stack(files: DataFrame) -> DataFrame:
    """All facts."""
    return requirements(files).unionByName(package_json(files)).unionByName(pom(files)).unionByName(pyproject(files)).distinct()
