"""Projections of static facts and claims to nodes and edges, and what keeps a fact, a unit or a reference from being used."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.functions.ids import tuple_sha256
from fathomline.functions.paths import normalized
from fathomline.operators.graph import _kept

# Fixed values.
RELATION_KINDS = ["CALL_CANDIDATE", "DEFINES", "EXPORTS", "EXTENDS", "IMPLEMENTS", "IMPORTS", "ROUTE_TO", "USES_API"]
ROLE_KINDS = ["api_client_candidate", "component_candidate", "data_model_candidate", "hook_candidate", "page_candidate", "store_candidate", "test_candidate"]
FACT_KEYS = ["batch_files", "batch_lines", "contract_version", "gate_failed_rules", "gate_ms", "gate_version", "injected_lines", "model", "model_calls", "model_chars", "repair_count", "source_files", "source_lines", "tool_calls", "verify_cmd", "verify_ms"]
SECRET = r"(?i)sk-[A-Za-z0-9]|api[_-]?key|secret|passwd|password|BEGIN [A-Z ]*PRIVATE KEY|ghp_"
# End of fixed values.
#: Rows of a path and a folder above it that a task joins.
ROWS_A_TASK = 500_000


def claim_overlay(claims: DataFrame, resolved: DataFrame, snapshot: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, type, label, provisional) of claims and of the evidence they resolve to, and EVIDENCED_BY edges (id, src, dst).

    ``claims`` (claim, text), ``resolved`` as ``claims.resolve`` gives it. Edge ids hold the snapshot's key.
    """
    met = resolved.filter("resolved").select(F.col("claim").cast("string").alias("src"), F.col("ref").cast("string").alias("dst"), "level").distinct()
    own = claims.select(F.col("claim").cast("string").alias("id"), F.lit("Claim").alias("type"), F.col("text").alias("label"), F.lit(None).cast("boolean").alias("provisional"))
    evidence = met.select(F.col("dst").alias("id"), F.lit("Evidence").alias("type"), F.col("level").alias("label"), (F.col("level") == "E6").alias("provisional")).distinct()
    edges = met.select(F.concat(F.lit("CLAIM-EVIDENCE-"), tuple_sha256(F.lit("claim-evidence"), F.lit(snapshot), F.col("src"), F.col("dst"))).alias("id"), "src", "dst")
    return own.unionByName(evidence), edges


def fact_findings(symbols: DataFrame, relations: DataFrame, roles: DataFrame, files: DataFrame, evidence: DataFrame) -> DataFrame:
    """(id, code) of facts that do not hold together.

    ``symbols`` (id, path, evidence_ids, ...), ``relations`` (id, kind, path, source_id, target_id, evidence_ids), ``roles``
    (id, kind, path, symbol_id, evidence_ids), ``files`` (path), ``evidence`` (id). IDENTITY_CONFLICT: an id with different
    payloads; SOURCE_PATH_INVALID; EVIDENCE_MISSING; KIND_INVALID; SYMBOL_MISSING.
    """
    known, paths, symbol_ids = evidence.select(F.col("id").alias("_ref")).distinct(), files.select(F.col("path").alias("_path")).distinct(), symbols.select(F.col("id").alias("_ref")).distinct()
    found = []
    for facts, kinds in ((symbols, None), (relations, RELATION_KINDS), (roles, ROLE_KINDS)):
        payload = F.sha2(F.to_json(F.struct(*facts.columns)), 256)
        twice = facts.groupBy("id").agg(F.count_distinct(payload).alias("n")).filter("n > 1")
        found.append(twice.select("id", F.lit("IDENTITY_CONFLICT").alias("code")))
        placed = facts.withColumn("_safe", normalized(F.col("path")))
        found.append(placed.join(paths, F.col("_safe") == F.col("_path"), "left_anti").select("id", F.lit("SOURCE_PATH_INVALID").alias("code")))
        cited = facts.select("id", F.explode("evidence_ids").alias("_ref"))
        found.append(cited.join(known, "_ref", "left_anti").select("id", F.lit("EVIDENCE_MISSING").alias("code")))
        if kinds:
            found.append(facts.filter(~F.coalesce(F.col("kind").isin(*kinds), F.lit(False))).select("id", F.lit("KIND_INVALID").alias("code")))
    ends = relations.select("id", F.col("source_id").alias("_ref"), F.lit(True).alias("_must")).union(relations.select("id", "target_id", F.lit(False))).union(roles.select("id", "symbol_id", F.lit(True)))
    found.append(ends.filter("_must OR _ref IS NOT NULL").join(symbol_ids, "_ref", "left_anti").select("id", F.lit("SYMBOL_MISSING").alias("code")))
    return reduce(DataFrame.unionByName, found).distinct()


def roles_by_symbol(roles: DataFrame) -> DataFrame:
    """(symbol_id, kinds): the sorted kinds of each symbol's roles; repeated records count once."""
    return roles.select("id", "kind", "symbol_id").distinct().groupBy("symbol_id").agg(F.array_sort(F.collect_list("kind")).alias("kinds"))


def graph_projection(files: DataFrame, symbols: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, type) of files and symbols, and edges (type, src, dst): files contain symbols, relations link symbols.

    A relation without a target stays out; equal edges are one.
    """
    nodes = files.select(F.concat(F.lit("FILE:"), "path").alias("id"), F.lit("File").alias("type")).unionByName(symbols.select("id", F.lit("Symbol").alias("type"))).distinct()
    inside = symbols.select(F.lit("CONTAINS").alias("type"), F.concat(F.lit("FILE:"), "path").alias("src"), F.col("id").alias("dst"))
    linked = relations.filter("target_id IS NOT NULL").select(F.col("kind").alias("type"), F.col("source_id").alias("src"), F.col("target_id").alias("dst"))
    return nodes, inside.unionByName(linked).distinct()


def reference_findings(nodes: DataFrame, key: str, refs: str, known: DataFrame) -> DataFrame:
    """(key, code): INPUT_INVALID where an array of references is null, holds an empty one or is not sorted and unique; REFERENCE_MISSING."""
    bad = F.col(refs).isNull() | F.exists(refs, lambda x: x.isNull() | (x == "")) | (F.array_sort(F.array_distinct(refs)) != F.col(refs))
    wrong = nodes.filter(F.coalesce(bad, F.lit(True))).select(key, F.lit("INPUT_INVALID").alias("code"))
    cited = nodes.select(key, F.explode(refs).alias("_ref")).filter("_ref <> ''")
    missing = cited.join(known.select(F.col("id").alias("_ref")).distinct(), "_ref", "left_anti").select(key, F.lit("REFERENCE_MISSING").alias("code"))
    return wrong.unionByName(missing).distinct()


def general_unit_error(origin: Column, scope: Column, unit_key: Column, has_refs: Column, primer_fields: Column) -> Column:
    """Why a unit is none of the general teaching path, or null. ``primer_fields`` counts the primer's three fields that are filled."""
    keyed = F.coalesce(unit_key, F.lit("")) != ""
    candidate = F.when((scope != "GENERAL_LEARNING") | ~keyed, "UNIT_ORIGIN_SCOPE_INVALID").when(primer_fields > 0, "UNIT_METADATA_INVALID")
    primer = F.when(~scope.isin("GENERAL_LEARNING", "PROJECT_SPECIFIC"), "UNIT_ORIGIN_SCOPE_INVALID").when(unit_key.isNotNull() | (primer_fields < 3), "UNIT_METADATA_INVALID")
    return F.when(has_refs, "PROJECT_REFERENCES_PRESENT").when(origin == "CANDIDATE", candidate).when(origin == "PREREQUISITE_PRIMER", primer).otherwise("UNIT_ORIGIN_SCOPE_INVALID")


def guarded(key: Column, value: Column) -> Column:
    """Why a fact of a trace may not be written, or null: a key that is not listed, a value that looks like a secret."""
    return F.when(~F.coalesce(key.isin(*FACT_KEYS), F.lit(False)), "KEY_UNKNOWN").when(F.coalesce(value.rlike(SECRET), F.lit(False)), "SECRET")


def claim_references(claims: DataFrame) -> DataFrame:
    """(claim, nodes, edges, evidence, paths): sorted and unique; cited symbols count as nodes, cited files as paths.

    ``claims`` (claim, node_ids, edge_ids, evidence_ids, citations: array of (kind, value)); null arrays are empty.
    """
    none = F.array().cast("array<string>")
    listed = lambda c: F.coalesce(F.col(c), none)
    cited = lambda kind: F.coalesce(F.transform(F.filter("citations", lambda x: x["kind"] == kind), lambda x: x["value"]), none)
    clean = lambda c: F.array_sort(F.array_distinct(c))
    return claims.select("claim", clean(F.concat(listed("node_ids"), cited("symbol"))).alias("nodes"), clean(listed("edge_ids")).alias("edges"), clean(listed("evidence_ids")).alias("evidence"), clean(cited("file")).alias("paths"))


def book_selection(plan: DataFrame, state: DataFrame, chosen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of the plan with what was chosen for the book, and findings (unit, code) that forbid it.

    ``plan`` (unit, position, route, plan_state, prerequisites), ``state`` the same columns and attempts (array of
    attempt_id, execution_state), ``chosen`` (unit, attempt).
    """
    shared = ["position", "route", "plan_state", "prerequisites"]
    bound = state.select("unit", F.struct(*shared).alias("_state"), "attempts")
    picked = chosen.select("unit", F.col("attempt").alias("_attempt"))
    rows = plan.join(bound, "unit", "left").join(picked, "unit", "left")
    taken = F.filter("attempts", lambda a: a["attempt_id"] == F.col("_attempt"))
    open_route = (F.col("plan_state") == "PLANNED") & F.col("route").isin("D2A_GENERAL_LEARNING", "PHASE6A_PROJECT_CLAIM")
    code = (
        F.when(~F.struct(*shared).eqNullSafe(F.col("_state")), "STATE_BINDING_INVALID")
        .when(F.col("_attempt").isNull(), None)
        .when(~open_route, "UNIT_NOT_SELECTABLE")
        .when(F.coalesce(F.size(taken), F.lit(0)) != 1, "ATTEMPT_NOT_AVAILABLE")
        .when(F.get(taken, 0)["execution_state"] != "REVIEWED_DRAFT", "ATTEMPT_NOT_REVIEWED")
    )
    answer = F.when(F.col("_attempt").isNull(), "NOT_SELECTED").when(F.col("route") == "D2A_GENERAL_LEARNING", "INCLUDED").otherwise("NOT_SUPPLIED")
    lines = rows.select("unit", "position", F.when(F.col("_attempt").isNull(), "NOT_SELECTED").otherwise("SELECTED").alias("selection"), F.col("_attempt").alias("attempt"), answer.alias("answer"))
    own = rows.select("unit", code.alias("code")).filter("code IS NOT NULL")
    unknown = chosen.join(plan.select("unit"), "unit", "left_anti").select("unit", F.lit("UNIT_NOT_IN_PLAN").alias("code"))
    wanted = plan.join(picked, "unit", "left_semi").select("unit", F.explode("prerequisites").alias("_need"))
    missing = wanted.join(chosen.select(F.col("unit").alias("_need")), "_need", "left_anti").select("unit", F.lit("PREREQUISITE_NOT_SELECTED").alias("code")).distinct()
    return lines, own.unionByName(unknown).unionByName(missing)


def is_next_page(path: Column, root: Column) -> Column:
    """Pages by their place below a package: ``app/**/page.*`` or ``pages/**`` without the API and names that begin with a mark."""
    own = F.when(root == "", path).when(path.startswith(F.concat(root, F.lit("/"))), F.substring(path, F.length(root) + 2, F.length(path)))
    suffix = r"\.(js|jsx|ts|tsx)$"
    app = own.rlike(r"^(src/)?app/(.*/)?page" + suffix)
    pages = own.rlike(r"(?i)^(src/)?pages/.*" + suffix) & ~own.rlike(r"^(src/)?pages/api(/|\.[^./]*$)") & ~own.rlike(r"(^|/)_[^/]*$")
    return F.coalesce(app | pages, F.lit(False))


def may_be_next_page(path: Column) -> Column:
    """Whether there may be a package below which the path is a page."""
    suffix = r"\.(js|jsx|ts|tsx)$"
    return path.rlike(r"(^|/)app/(.*/)?page" + suffix) | path.rlike(r"(?i)(^|/)pages/.*" + suffix) & ~path.rlike(r"(^|/)_[^/]*$")


def next_pages(files: DataFrame, declaring: DataFrame, rows_a_task: int = ROWS_A_TASK) -> DataFrame:
    """(path, package): pages whose nearest package.json declares ``next``.

    ``files`` (path), ``declaring`` (path: package.json files that do). The nearest one decides, whether it does or not.
    Only paths that are a page below some folder are looked up. Tasks are as many as paths and folders ask for, since the
    compressed size of such rows, by which Spark would choose, tells little of the memory that they take. Folders above
    more than ``rows_a_task`` paths, as the root is, are few and meet their manifests where the paths are.
    """
    from fathomline.functions.paths import ancestors

    manifests = files.filter(F.col("path").rlike(r"(^|/)package\.json$")).select("path").distinct()
    marked = manifests.join(declaring.select("path", F.lit(1).alias("_declares")).distinct(), "path", "left")
    roots = marked.select(F.regexp_replace("path", r"/?package\.json$", "").alias("package"), F.coalesce("_declares", F.lit(0)).alias("_declares"))
    above = files.select("path").filter(may_be_next_page(F.col("path"))).select("path", F.explode(ancestors(F.col("path"))).alias("package"))
    often = _kept(above.groupBy("package").agg(F.count("*").alias("_often")).filter(F.col("_often") > rows_a_task))
    tasks = files.agg(F.sum(F.length("path") - F.length(F.replace("path", F.lit("/"))) + 1)).first()[0] or 0
    tasks = -(-tasks // rows_a_task) + 1
    hot = F.broadcast(often.select("package"))
    seldom = above.join(hot, "package", "left_anti").repartition(tasks, "package").join(roots.hint("merge"), "package")
    above = seldom.unionByName(above.join(F.broadcast(_kept(roots.join(hot, "package", "left_semi"))), "package"))
    # one number, so that groups are hashed and not sorted: the length of the package, then whether it declares
    found = above.select("path", (2 * F.length("package") + F.col("_declares")).alias("_n")).repartition(tasks, "path").groupBy("path").agg(F.max("_n").alias("_n"))
    nearest = found.filter("_n % 2 = 1").select("path", F.expr("substring(path, 1, _n div 2)").alias("package"))
    return nearest.filter(is_next_page(F.col("path"), F.col("package")))


def families(files: DataFrame) -> DataFrame:
    """(family, files) of classified files that a parser is there for: python, java, and frontend ones by surface; others are outside.

    ``files`` (path, surface, secondary: array).
    """
    name = F.lower(F.regexp_extract("path", r"[^/.][^/]*(\.[^./]+)$", 1))
    web = name.isin(".js", ".jsx", ".ts", ".tsx") & ((F.col("surface") == "frontend") | F.array_contains("secondary", "frontend"))
    family = F.when(name == ".py", "python").when(name == ".java", "java").when(web, "frontend").otherwise("outside")
    return files.groupBy(family.alias("family")).agg(F.count_distinct("path").alias("files"))
