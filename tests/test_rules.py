"""Hard inputs of manifests, contracts, edits, versions and call sites."""

import json

import pytest
from pyspark.sql import functions as F

from fathomline.functions import code
from fathomline.operators import classify, contracts, extraction
from fathomline.sources import artifacts, manifests


def test_maven_files(spark):
    dependency = lambda **parts: "<dependency>" + "".join(f"<{k}>{v}</{k}>" for k, v in parts.items()) + "</dependency>"
    project = lambda *d: f'<?xml version="1.0"?>\n<!-- c -->\n<project xmlns="http://maven.apache.org/POM/4.0.0"><dependencies>{"".join(d)}</dependencies></project>'
    files = [
        ("pom.xml", project(dependency(groupId="g"), dependency(groupId="h", artifactId="b", version="1"), dependency(artifactId="c"), dependency(groupId=" i ", artifactId="d"))), ("a/pom.xml", "<project><dependencies>"), ("b/POM.XML", "<!  Doctype x><project/>"),
        ("c/pom.xml", "<other/>"), ("d/pom.xml", ""), ("e/pom.xml", None), ("f/pom.xml", "<project/>"), ("g/pom.xml", "<project><x><dependencies>" + dependency(groupId="n", artifactId="o") + "</dependencies></x></project>"),
    ]
    got = {tuple(r) for r in manifests.pom(spark.createDataFrame(files, "path string, text string")).collect()}
    assert got == {("pom.xml", "dependencies", "h:b", "1"), ("pom.xml", "dependencies", "i:d", ""), *((f"{d}/pom.xml", "MALFORMED", "", "") for d in "acde"), ("b/POM.XML", "MALFORMED", "", "")}


def test_names_of_manifests_in_any_case(spark):
    files = spark.createDataFrame([("Requirements.TXT", "A==1\n"), ("x/Package.JSON", '{"dependencies": {"b": "2"}}'), ("y/package.json", "[]"), ("z/package.json", "{"), ("PyProject.toml", "= =")], "path string, text string")
    assert files.filter(manifests.is_manifest(F.col("path"))).count() == 5
    got = {tuple(r) for r in manifests.stack(files).collect()}
    assert got == {("Requirements.TXT", "requirements", "a", "1"), ("x/Package.JSON", "dependencies", "b", "2"), ("y/package.json", "MALFORMED", "", ""), ("z/package.json", "MALFORMED", "", ""), ("PyProject.toml", "MALFORMED", "", "")}


def test_versions_with_other_parts(spark):
    rows = spark.createDataFrame([("2.x",), ("2.10",), ("2.9",), ("",), (None,), ("99999999999.1",), ("3",)], "v string")
    assert [r.s for r in rows.select(code.version_at_least(F.col("v"), "2.10").alias("s")).collect()] == [None, True, False, None, None, None, True]


def found(spark, schema, *documents):
    rows = spark.createDataFrame([(i, json.dumps(d) if not isinstance(d, str) else d) for i, d in enumerate(documents)], "id long, text string")
    return {(r.id, r.path, r.code) for r in contracts.findings(rows.select("id", artifacts.strict(F.col("text")).alias("d")), "id", "d", schema).collect()}


def test_contracts_of_large_integers_and_structures(spark):
    assert found(spark, {"type": "integer", "minimum": 2**70}, 12345678901234567890, 2**70, 2**70 + 1, "1.0", "1.5") == {(0, "$", "MINIMUM"), (3, "$", "TYPE"), (4, "$", "TYPE")}
    assert found(spark, {"const": 2**65}, 2**65, 2**65 + 1) == {(1, "$", "VALUE_NOT_LISTED")}
    assert found(spark, {"maximum": 9007199254740992}, 9007199254740993, 9007199254740992) == {(0, "$", "MAXIMUM")}
    assert found(spark, {"enum": [[1, {"b": 2, "a": [None]}], {"x": 1}, {}, []]}, [1, {"a": [None], "b": 2}], {"x": 1}, {"x": 2}, {}, [], [1], None) == {(2, "$", "VALUE_NOT_LISTED"), (5, "$", "VALUE_NOT_LISTED"), (6, "$", "VALUE_NOT_LISTED")}


def test_contract_versions(spark):
    rows = spark.createDataFrame([(i, json.dumps({"artifact_kind": k, "schema_version": v})) for i, (k, v) in enumerate([("a", "1.0.0"), ("a", "1.1.0"), ("a", "2.0.0"), ("a", "1.0"), ("b", "1.0.0"), ("a", None)])] + [(9, "{")], "id long, text string")
    got = contracts.artifact_findings(rows.select("id", artifacts.strict(F.col("text")).alias("d")), "id", "d", {("a", "1.0.0"): {"type": "object"}})
    assert {(r.id, r.code) for r in got.collect()} == {(1, "KIND"), (2, "MAJOR"), (3, "VERSION"), (4, "KIND"), (5, "VERSION"), (9, "JSON")}


EDITS = "doc long, number int, op string, anchor string, block string, expected string, marker string"
CASES = [
    # text, edits (op, anchor, block, expected, marker), what comes out, conflict
    (None, [("append_section", None, "new\n\n", None, None)], "\nnew\n", None),
    (None, [("append_section", None, "new", None, None), ("ensure_line", None, "q", None, None)], None, "TEXT_MISSING"),
    (None, [("update_line", "a", "b", "a", None)], None, "TEXT_MISSING"),
    ("", [("append_section", None, "x", None, None)], "\nx\n", None),
    ("a\n\n", [("append_section", None, "x\ny\n", None, None)], "a\n\nx\ny\n", None),
    ("a\n\n\n", [("ensure_line", None, "\n b \n", None, None)], "a\n b \n", None),
    ("a\n  b\t\nc", [("ensure_line", None, "b", None, None)], "a\n  b\t\nc", None),
    ("a\nb\nc", [("insert_before_anchor", "b", "1\n2\n\n", None, None)], "a\n1\n2\nb\nc", None),
    ("b", [("insert_before_anchor", "b", "", None, None)], "\nb", None),
    ("a\nb\nbb", [("insert_before_anchor", "b", "1", None, None)], None, "ANCHOR_AMBIGUOUS"),
    ("a", [("replace_anchor_line", "z", "1", None, None)], None, "ANCHOR_MISSING"),
    ("a\nold b", [("replace_anchor_line", "b", "new\n", "old", None)], "a\nnew", None),
    ("a\nold b", [("replace_anchor_line", "b", "new", "other", None)], None, "ANCHOR_CHANGED"),
    ("a\nold b", [("replace_anchor_line", "b", "", None, None)], "a\n", None),
    ("a\n b \nc", [("update_line", "b", "\nb c\n", "b", None)], "a\nb c\nc", None),
    ("a\n b \nc", [("update_line", "b", "b", "anything", "a")], "a\n b \nc", None),
    ("a\nb", [("update_line", "b", "x", "b", None)], None, "ANCHOR_LOST"),
    ("a\nb", [("update_line", "b", "b2", "c", None)], None, "ANCHOR_CHANGED"),
    ("a\nb", [("append_section", None, "x", None, "b")], "a\nb", None),
    ("a\nb", [("append_section", None, "x", None, "")], "a\nb\nx\n", None),
    ("a\nb", [("erase", None, "x", None, None)], None, "EDIT_UNKNOWN"),
    ("a", [("append_section", None, "b", None, None), ("insert_before_anchor", "b", "m", None, None), ("update_line", "m", "m2", "m", None)], "a\nm2\nb\n", None),
    ("a", [("append_section", None, "b", None, None), ("insert_before_anchor", "q", "m", None, None), ("append_section", None, "c", None, None)], None, "ANCHOR_MISSING"),
    ("a", [], "a", None),
]


def test_edits_case_by_case(spark):
    docs = spark.createDataFrame([(i, t) for i, (t, _, _, _) in enumerate(CASES) if i != 1], "doc long, text string")
    edits = spark.createDataFrame([(i, n, *e) for i, (_, todo, _, _) in enumerate(CASES) for n, e in enumerate(todo)], EDITS)
    got = {r.doc: (r.text, r.changed, r.conflict) for r in extraction.edited(docs, edits).collect()}
    assert got == {i: (text if conflict else want, not conflict and (text or "") != want, conflict) for i, (text, _, want, conflict) in enumerate(CASES)}


@pytest.mark.parametrize(
    ("line", "kind"),
    [
        ("public class Name {", "DECLARATION"), ("def Name(x):", "DECLARATION"), ("record Name(int a)", "DECLARATION"), ("Name x = make()", "USE"), ("x = new Name", "USE"), ("Name(1)", "USE"), ("a.Name (1)", "USE"), ("go(Name); x.run()", "USE"), ("// see Name above", "MENTION"),
        ("Name x == y", "MENTION"), ("Names", None), ("aName()", None), ("", None), (None, None), ("return Name", "MENTION"),
    ],
)
def test_call_sites_by_tokens(spark, line, kind):
    rows = spark.createDataFrame([(1, 1, line)], "k long, line_no long, line string")
    got = extraction.call_sites(rows, "k", spark.createDataFrame([("Name",), ("Other",)], "name string")).collect()
    assert [(r.name, r.kind) for r in got] == ([("Name", kind)] if kind else [])


def test_names_of_tests(spark):
    names = {"test_a.py": True, "it-x.js": True, "a_test.go": True, "a.spec.ts": True, "atest.rb": True, "ATests.java": True, "FooIT.java": True, "latest.txt": False, "testing.py": False, "a_spec": False, "contest.md": False}
    rows = spark.createDataFrame([(n,) for n in names], "path string")
    own, parts = classify._taken_apart(rows, "path")
    assert {r.path: r.t for r in own.select("path", classify.is_test_name(parts).alias("t")).collect()} == names
