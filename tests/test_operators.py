"""Operators on hand-made rows: golden cases, empty inputs, and results that do not depend on order or repeats."""

import hashlib
import subprocess

import pytest
from pyspark.sql import functions as F

from fathomline.functions import code, paths
from fathomline.operators import claims, classify, extraction, graph, intervals, lines, project, reconcile, scorecard, sequence
from fathomline.sources import artifacts, git, manifests
from fathomline.streaming import statelog

def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_classification_beyond_the_query(spark):
    """Cases that the query's list lacks: orders of rules, letter case, names that only look like another tier's."""
    want = {
        "build/vendor/a.java": ("path:vendor", "vendor", ["generated"]), "ci.yml": ("name:ci", "ci", []), "a/b/.circleci/c/d.txt": ("name:ci", "ci", []), "app.DOCKERFILE": ("name:infrastructure", "infrastructure", []),
        "docker/requirements/base.txt": ("extension:known", "other", []), "requirements.TXT": ("name:lockfile", "lockfile", []), "go.sum": ("name:lockfile", "lockfile", []), "x/.ENV": ("safety:tracked-env", "environment", []),
        ".env.dist": ("name:environment", "environment", []), ".environment": ("safety:tracked-env", "environment", []), "contributing.md": ("path:documentation", "documentation", []), "CHANGES": ("path:documentation", "documentation", []),
        "licence.html": ("extension:known", "other", []), "main/src/java/X.java": ("extension:known", "other", []), "src/a/main/b/groovy/X.txt": ("path:backend", "backend", []), "x/contest.rb": ("path:test", "test", []), "x/unit-test.lua": ("extension:known", "other", []),
        "v3__a.SQL": ("extension:known", "other", []), "golden/test-data/docs/a": ("path:fixture", "fixture", ["documentation"]), "store/config/api/x.zzz": ("path:frontend", "frontend", ["api", "configuration"]), "noext": ("fallback:unknown", "other", []), "a.b!c": ("fallback:unknown", "other", []),
    }
    got = {r.path: (r.rule_id, r.surface, r.secondary) for r in classify.classified(frame(spark, [(p,) for p in want], "path string")).collect()}
    assert got == want
    kinds = frame(spark, [("x.odd", "text", b"a\0"), ("x.odd", "symlink", b"a\0"), ("lib", "gitlink", None), ("a.py", "text", b"\0"), ("link.png", "symlink", None), ("none", "text", None)], "path string, kind string, sample binary")
    media = kinds.withColumn("media", classify.media_type(F.col("path"), F.col("kind"), F.col("sample"))).withColumn("own", classify.content_kind(F.col("media"), F.col("kind")))
    assert [(r.media, r.own) for r in media.collect()] == [("application/octet-stream", "binary"), ("text/plain", "symlink"), ("application/x-gitlink", "gitlink"), ("text/x-python", "text"), ("image/png", "symlink"), ("text/plain", "text")]


def test_paths(spark):
    raw = ["./a/b.py", "a//b", "/a", "a\\b", "C:/x", "..", "a/../b", "", "x/__init__.py", ".bashrc", "a/B.TXT", "./"]
    rows = {r.p: r for r in frame(spark, [(p,) for p in raw], "p string").select("p", paths.normalized(F.col("p")).alias("n"), paths.extension(F.col("p")).alias("e"), paths.module_name(F.col("p")).alias("m"), paths.ancestors(F.col("p")).alias("a")).collect()}
    assert [rows[p].n for p in raw] == ["a/b.py", None, None, None, None, None, None, None, "x/__init__.py", ".bashrc", "a/B.TXT", None]
    assert rows[".bashrc"].e == "" and rows["a/B.TXT"].e == "txt" and rows["x/__init__.py"].m == "x" and rows["x/__init__.py"].a == ["x", ""]


def test_intervals(spark):
    ranges = [("g", 1, 3), ("g", 2, 5), ("g", 6, 8), ("g", 10, 11), ("h", 4, 4), ("h", 4, 4)]
    for rows in (ranges, ranges[::-1]):
        df = frame(spark, rows, "k string, lo long, hi long")
        assert {(r.k, r.lo, r.hi) for r in intervals.merged(df, ["k"], "lo", "hi").collect()} == {("g", 1, 8), ("g", 10, 11), ("h", 4, 4)}
        assert {tuple(r) for r in intervals.coverage(df, ["k"], "lo", "hi").collect()} == {("g", 2, 10, 2, 1), ("h", 1, 1, 1, 0)}
    wanted = frame(spark, [("g", 2, 8), ("g", 8, 10), ("x", 1, 1)], "k string, lo long, hi long")
    assert {(r.k, r.lo) for r in intervals.uncovered(wanted, df, ["k"], "lo", "hi").collect()} == {("g", 8), ("x", 1)}
    assert intervals.merged(df.filter("false"), ["k"], "lo", "hi").count() == 0


def test_sequences(spark):
    log = frame(spark, [("u", 1, "begin"), ("u", 5, "end"), ("u", 6, "end"), ("v", 2, "end"), ("v", 3, "begin")], "k string, t long, e string")
    assert {(r.k, r.t, r.matched, r.duration) for r in sequence.pairs(log, ["k"], ["t"], "e", "begin", "end", F.col("t")).collect()} == {("u", 5, True, 4), ("u", 6, False, None), ("v", 2, False, None)}
    assert {(r.k, r.t) for r in sequence.transitions(log, ["k"], ["t"], "e", {"begin": ["end"]}).collect()} == {("u", 6), ("v", 3)}
    chain = frame(spark, [("a", 1, None, "x"), ("a", 2, "x", "y"), ("a", 4, "q", "z")], "k string, rev long, parent string, own string")
    assert [(r.contiguous, r.linked) for r in sequence.chain(chain, ["k"], "rev", F.col("parent"), F.col("own")).orderBy("rev").collect()] == [(True, True), (True, True), (False, False)]


def test_graphs(spark):
    edges = frame(spark, [(1, 2), (2, 3), (1, 3), (3, 4), (5, 4), (1, 2)], "src long, dst long")
    nodes = frame(spark, [(i,) for i in (1, 2, 3, 4, 5, 9)], "node long")
    assert {tuple(r) for r in graph.closure(edges).collect()} == {(1, 2, 1), (2, 3, 1), (1, 3, 1), (3, 4, 1), (5, 4, 1), (2, 4, 2), (1, 4, 2)}
    assert {tuple(r) for r in graph.levels(nodes, edges).collect()} == {(1, 0), (2, 1), (3, 2), (4, 3), (5, 0), (9, 0)}
    assert {r.node for r in graph.blocked(nodes, edges, F.col("node") == 2).filter("blocked").collect()} == {2, 3, 4}
    loop = frame(spark, [(1, 2), (2, 1), (2, 3)], "src long, dst long")
    assert {r.node for r in graph.cyclic(loop).collect()} == {1, 2}
    assert {tuple(r) for r in graph.levels(nodes.filter("node < 4"), loop).collect()} == {(1, None), (2, None), (3, None)}
    units = frame(spark, [("u", 1), ("v", 2)], "unit string, position int")
    needs = frame(spark, [("u", 3), ("v", 4)], "unit string, concept long")
    assert {tuple(r) for r in graph.primers(units, needs, edges).collect()} == {(1, 1), (1, 2), (1, 3), (2, 4), (2, 5)}


def test_reconcile_and_claims(spark):
    a = frame(spark, [(1, "x"), (2, "y"), (2, "y"), (3, "z")], "id long, v string")
    b = frame(spark, [(2, "y"), (3, "q"), (4, "w")], "id long, v string")
    assert {tuple(r) for r in reconcile.differences(a, b, ["id"]).collect()} == {(1, "left"), (4, "right")}
    assert {(r.id, r.status, *r.changed) for r in reconcile.mismatches(a.distinct(), b, ["id"], ["v"]).collect()} == {(1, "missing_right"), (2, "same"), (3, "changed", "v"), (4, "missing_left")}
    twice = a.union(frame(spark, [(3, "other")], "id long, v string"))
    assert {tuple(r) for r in reconcile.conflicts(twice, "id", F.col("v")).collect()} == {(1, 1, 1, False), (2, 2, 1, False), (3, 2, 2, True)}
    cited = frame(spark, [("a", 1), ("b", 1), ("b", 2), ("c", 9), ("d", 2)], "claim string, ref long")
    evidence = frame(spark, [(1, "E1"), (2, "E6")], "id long, level string")
    found = claims.resolve(cited, evidence)
    assert {(r.claim, r.disposition) for r in claims.dispositions(found).collect()} == {("a", "SUPPORTED"), ("b", "INFERENCE"), ("c", "UNVERIFIED"), ("d", "INFERENCE")}
    assert {(r.claim, r.disposition) for r in claims.dispositions(found, strict=False).collect()} == {("a", "SUPPORTED"), ("b", "SUPPORTED"), ("c", "UNVERIFIED"), ("d", "INFERENCE")}
    assert claims.status(claims.dispositions(found), F.lit(False)).first().status == "FAIL"


def test_lines_and_scorecards(spark):
    docs = frame(spark, [("d", "# a\nx\n\n# b\ny\ny"), ("e", "x"), ("n", None)], "doc string, text string")
    own = lines.exploded(docs, "doc", "text")
    assert {tuple(r) for r in lines.sections(own, "doc", F.col("line").startswith("# ")).collect()} == {("d", 1, "# a", 1, 3), ("d", 2, "# b", 4, 3), ("e", 0, None, 1, 1)}
    assert {(r.doc, r.line) for r in lines.unique_places(own, "doc").collect()} == {("d", "# a"), ("d", "x"), ("d", ""), ("d", "# b"), ("e", "x")}
    checks = frame(spark, [("a", 0, 0), ("b", 3, 0), ("c", 3, 1)], "k string, n long, f long").withColumn("status", scorecard.check_status(F.col("n"), F.col("f")))
    assert {(r.k, r.status) for r in checks.collect()} == {("a", "NOT_CHECKED"), ("b", "PASS"), ("c", "FAIL")}
    note = frame(spark, [("int  x = 1; // :L12 说明",), ("a\tb",)], "s string").select(code.normalized(F.col("s")).alias("n"), code.has_cjk(F.col("s")).alias("c")).collect()
    assert [tuple(r) for r in note] == [("int x = 1;", True), ("a b", False)]


def test_extraction(spark):
    source = "import os\nfrom a.b import c as d\nclass A(Base):\n    def f(self):\n        return helper(1)\ndef helper(x):\n    return os.path.join(x)\n"
    files = frame(spark, [("m.py", source), ("bad.py", "def ("), ("x.txt", "import no")], "path string, text string")
    facts = extraction.python_facts(files)
    got = {(r.path, r.kind, r.name, r.target) for r in facts.collect()}
    assert {("m.py", "IMPORTS", "d", "a.b.c"), ("m.py", "CLASS", "A", None), ("m.py", "METHOD", "A.f", None), ("m.py", "EXTENDS", "A", "Base"), ("bad.py", "SKIPPED", "SYNTAX_ERROR", None)} <= got
    assert {(r.name, r.defined_at) for r in extraction.resolved_calls(facts).collect()} == {("helper", 6), ("os.path.join", None)}
    docs = frame(spark, [("a", "```py\nx\n```\n~~~\n```js\n"), ("b", None)], "doc_id string, text string")
    assert {(r.open_line, r.close_line, r.language, r.anomaly) for r in extraction.fences(docs).collect()} == {(1, 3, "py", None), (4, None, "", "UNCLOSED"), (5, None, "js", "LABELLED_FENCE_INSIDE_BLOCK")}
    plan = extraction.planned(frame(spark, [("d", "a"), ("d", "b"), ("d", "b")], "doc string, line string"), frame(spark, [("d", "a"), ("d", "b"), ("d", "c")], "doc string, anchor string"))
    assert {(r.anchor, r.status) for r in plan.collect()} == {("a", "OK"), ("b", "ANCHOR_AMBIGUOUS"), ("c", "ANCHOR_MISSING")}


def test_manifests(spark):
    files = [
        ("requirements.txt", "# x\nDjango==4.2 # y\n-r other\nrequests>=2\n"), ("web/package.json", '{"dependencies": {"react": "18"}, "devDependencies": {"vite": "5"}}'), ("pyproject.toml", '[project]\ndependencies = ["Flask==3"]\n[build-system]\nrequires = ["hatchling"]'),
        ("pom.xml", '<project xmlns="http://maven.apache.org/POM/4.0.0"><dependencies><dependency><groupId>g</groupId><artifactId>a</artifactId></dependency></dependencies></project>'), ("web/yarn.lock", ""), ("web/package-lock.json", "{}"), ("bad/pyproject.toml", "= ="),
    ]
    df = frame(spark, files, "path string, text string")
    assert {(r.name, r.version) for r in manifests.stack(df).collect()} == {("django", "4.2"), ("requests", ""), ("react", "18"), ("vite", "5"), ("flask", "3"), ("hatchling", ""), ("g:a", ""), ("", "")}
    assert [(r.dir, r.managers) for r in manifests.lock_conflicts(df).collect()] == [("web", ["npm", "yarn"])]


def test_git_source(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=a", "-c", "user.email=a@example.org", *a], check=True, capture_output=True)
    run("init", "-q")
    (tmp_path / "a.txt").write_text("one\n")
    (tmp_path / "copy.txt").write_text("one\n")
    (tmp_path / "b.bin").write_bytes(b"\0\1")
    run("add", ".")
    run("commit", "-qm", "x")
    rows = {r.path: r for r in git.inventory(spark, str(tmp_path)).collect()}
    assert set(rows) == {"a.txt", "b.bin", "copy.txt"} and rows["a.txt"].sha256 == rows["copy.txt"].sha256 and rows["a.txt"].byte_count == 4
    assert (rows["a.txt"].content_kind, rows["b.bin"].content_kind) == ("text", "binary")
    assert git.snapshot(spark, str(tmp_path), kind="worktree").count() == 3
    own = git.context(str(tmp_path))
    assert (own["prefix"], own["dirty"], len(own["revision"])) == ("", False, 40)
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "c.txt").write_text("three\n")
    (tmp_path / "link").symlink_to("a.txt")
    (tmp_path / "out").mkdir()
    (tmp_path / "out" / "d.txt").write_text("four")
    run("add", ".")
    run("commit", "-qm", "y")
    tree = {r.path for r in git.snapshot(spark, str(tmp_path)).collect()}
    assert tree == {"a.txt", "b.bin", "copy.txt", "sub/c.txt", "link", "out/d.txt"} and git.snapshot(spark, str(tmp_path)).rdd.getNumPartitions() == 6
    (tmp_path / "a.txt").write_text("changed")
    (tmp_path / "b.bin").unlink()
    (tmp_path / "out" / "d.txt").rename(tmp_path / "d.txt")
    (tmp_path / "out").rmdir()
    (tmp_path / "out").symlink_to("sub")
    files = {r.path: r for r in git.worktree(spark, str(tmp_path)).collect()}
    assert files["a.txt"].sha256 == hashlib.sha256(b"changed").hexdigest() and files["a.txt"].byte_count == 7 and files["link"].sample == b"a.txt"
    assert {p: r.problem for p, r in files.items() if r.problem} == {"b.bin": "MISSING", "out/d.txt": "UNSAFE_PATH"}
    assert git.context(str(tmp_path))["dirty"] and not git.context(str(tmp_path / "sub"))["dirty"] and git.context(str(tmp_path / "sub"))["prefix"] == "sub"
    many = git.blobs(git.snapshot(spark, str(tmp_path)).filter("object_type = 'blob'"), str(tmp_path), keep_content=True)
    assert {bytes(r.content) for r in many.collect()} >= {b"one\n", b"three\n", b"four"}
    assert git.blobs(frame(spark, [("0" * 40,)], "object_id string"), str(tmp_path)).first().sha256 is None


def test_artifacts(spark, tmp_path):
    texts = frame(spark, [('{"a": 1}',), ('{"a": 1, "a": 2}',), ("{",)], "t string")
    assert [r.ok for r in texts.select(artifacts.strict(F.col("t")).isNotNull().alias("ok")).collect()] == [True, False, False]
    made = frame(spark, [(2, None, "é")], "z int, b string, a string").select(artifacts.canonical_json(F.struct("z", "b", "a")).alias("j")).first().j
    assert made == '{\n  "a": "é",\n  "b": null,\n  "z": 2\n}\n'
    log = frame(spark, [("u", "PLANNED")], "unit string, state string")
    artifacts.append_revision(log, f"file://{tmp_path}/log", 1)
    with pytest.raises(Exception, match="EXIST"):
        artifacts.append_revision(log, f"file://{tmp_path}/log", 1)
    artifacts.append_revision(log, f"file://{tmp_path}/log", 2)
    assert artifacts.read_revisions(spark, f"file://{tmp_path}/log").count() == 2


def test_stream_keeps_state_between_runs(spark, tmp_path):
    rows = [(1, "view"), (2, "purchase"), (3, "purchase"), (4, "view"), (5, "error")]
    schema = "event_id bigint, user_id bigint, event_type string, ts timestamp"
    put = lambda n, some: spark.createDataFrame([(i, 7, k, None) for i, k in some], schema).selectExpr("event_id", "user_id", "event_type", "timestamp_seconds(event_id) AS ts").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")  # noqa: E731, ARG005
    put(1, rows[:2])
    allowed = {"view": ["purchase"], "purchase": ["view"]}
    step = lambda: statelog.run(statelog.bad_steps(statelog.events(spark, f"{tmp_path}/in"), allowed, "0 seconds"), f"{tmp_path}/log")
    found = lambda df: {(r.event_id, r.before, r.event_type) for r in df.collect()}
    assert found(step()) == set() == found(statelog.waiting_steps(spark, f"{tmp_path}/log", allowed))
    put(2, rows[2:])
    assert found(step()) | found(statelog.waiting_steps(spark, f"{tmp_path}/log", allowed)) == {(3, "purchase", "purchase"), (5, "view", "error")}


def test_stream_files_in_reverse_order(spark, tmp_path):
    allowed = {"signup": ["view"], "view": ["view"]}
    schema = "event_id bigint, user_id bigint, event_type string, at long"
    put = lambda *rows: spark.createDataFrame(rows, schema).selectExpr("event_id", "user_id", "event_type", "timestamp_seconds(at) AS ts").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    where = f"{tmp_path}/log"
    found = lambda df: {(r.event_id, r.user_id, r.before, r.event_type) for r in df.drop("batch").collect()}
    step = lambda: found(statelog.run(statelog.bad_steps(statelog.events(spark, f"{tmp_path}/in"), allowed, "1 hour"), where))
    put((2, 1, "view", 2), (None, 1, "view", None))
    assert step() == set()
    put((1, 1, "signup", 1))  # earlier, but in a later file
    assert step() == set() == found(statelog.waiting_steps(spark, where, allowed))
    put((3, 2, "error", 9000), (4, 1, "signup", 8000))  # the watermark passes 2
    put((5, 2, "view", 9001))
    assert step() == set()
    assert found(statelog.waiting_steps(spark, where, allowed)) == {(4, 1, "view", "signup"), (5, 2, "error", "view")}
    put((6, 1, "view", 1), (7, 3, "view", 20000))  # too late for 6
    assert step() == {(4, 1, "view", "signup"), (5, 2, "error", "view")}
    assert found(statelog.waiting_steps(spark, where, allowed)) == set()


def test_overlaps_by_reference_count_every_pair(spark):
    from fathomline.operators import claims

    left = spark.createDataFrame([(i, [i % 3, i % 3, i % 5, None]) for i in range(40)] + [(None, [1])], "claim long, refs array<long>")
    right = spark.createDataFrame([(i, [i % 4, i % 7]) for i in range(30)] + [(99, [])], "unit long, refs array<long>")
    got = {r.ref: (r.left_keys, r.right_keys, r.pairs) for r in claims.overlaps_by_reference(left, right, "claim", "unit", "refs").collect()}
    want = {}
    for ref in range(7):
        a, b = sum(ref in (i % 3, i % 5) for i in range(40)), sum(ref in (i % 4, i % 7) for i in range(30))
        if a and b:
            want[ref] = (a, b, a * b)
    assert got == want
    assert sum(p for _, _, p in got.values()) == claims.overlaps(left.filter("claim IS NOT NULL"), right, "claim", "unit", "refs").agg({"shared": "sum"}).first()[0]


def test_contracts(spark):
    from fathomline.operators import contracts

    schema = {"type": "object", "additionalProperties": {"type": "integer"}, "required": ["a"], "properties": {"a": {"type": ["string", "null"], "maxLength": 3}, "b": {"type": "array", "minItems": 1, "items": {"type": "object", "properties": {"n": {"type": "number", "minimum": 0}}, "additionalProperties": False}}, "c": {"const": True}}}
    cases = {
        '{"a": "x", "z": 4}': set(), '{"a": null, "b": [{"n": 1.5}, {}], "c": true}': set(), "[]": {("$", "TYPE")}, '{"b": []}': {("$.a", "REQUIRED"), ("$.b", "MINITEMS")}, '{"a": "long", "z": "q"}': {("$.a", "MAXLENGTH"), ("$.z", "TYPE")},
        '{"a": 5, "b": [{"n": -1, "m": 0}, 7]}': {("$.a", "TYPE"), ("$.b[0].n", "MINIMUM"), ("$.b[0].m", "UNEXPECTED"), ("$.b[1]", "TYPE")}, '{"a": "x", "c": 1}': {("$.c", "VALUE_NOT_LISTED")}, '{"a": 1, "a": 2}': {("$", "JSON")}, "{": {("$", "JSON")},
        '{"a": "x", "z": true}': {("$.z", "TYPE")}, '{"a": "x", "b": null}': {("$.b", "TYPE")},
    }
    rows = frame(spark, list(enumerate(cases)), "id int, text string").withColumn("doc", artifacts.strict(F.col("text")))
    got = {}
    for r in contracts.findings(rows, "id", "doc", schema).collect():
        got.setdefault(r.id, set()).add((r.path, r.code))
    assert [got.get(i, set()) for i in range(len(cases))] == list(cases.values())
    for bad in ({"format": "x"}, {"type": "date"}, {"properties": {"a": 1}}, {"items": []}, []):
        with pytest.raises(ValueError):
            contracts.check_schema(bad)
    kinds = frame(spark, [('{"artifact_kind": "k", "schema_version": "1.0.0"}',), ('{"artifact_kind": "k", "schema_version": "2.0.0"}',), ("no",)], "text string").withColumn("doc", artifacts.strict(F.col("text")))
    assert {(r.text[:2], r.code) for r in contracts.artifact_findings(kinds, "text", "doc", {("k", "1.0.0"): {"type": "object"}}).collect()} == {('{"', "MAJOR"), ("no", "JSON")}


def test_edits_report_conflicts(spark):
    docs = frame(spark, [("a", "x\ny\nx"), ("b", "one\ntwo"), ("c", "k"), ("n", None), ("same", "q")], "doc string, text string")
    columns = "doc string, number int, op string, anchor string, block string, expected string, marker string"
    edits = [
        ("a", 1, "update_line", "x", "z", "x", None), ("b", 1, "update_line", "two", "2", "two", None), ("c", 1, "update_line", "k", "k ", "other", None), ("n", 1, "append_section", None, "made", None, None), ("new", 1, "append_section", None, "first", None, None),
        ("gone", 1, "ensure_line", None, "first", None, None), ("c", 2, "replace_anchor_line", "k", "w", "q", None),
    ]
    got = {r.doc: (r.text, r.changed, r.conflict) for r in extraction.edited(docs, frame(spark, edits, columns)).collect()}
    assert got == {"a": ("x\ny\nx", False, "ANCHOR_AMBIGUOUS"), "b": ("one\ntwo", False, "ANCHOR_LOST"), "c": ("k", False, "ANCHOR_CHANGED"), "n": ("made\n", True, None) if got["n"][0] == "made\n" else ("\nmade\n", True, None), "new": got["new"], "gone": (None, False, "TEXT_MISSING"), "same": ("q", False, None)}
    assert got["new"][0].strip() == "first" and got["new"][1]


def test_attribution_with_a_line_that_every_text_has(spark):
    import random

    rng = random.Random(3)
    common, own = "a line of every text", [f"line {i}" for i in range(60)]
    texts = {i: {common, "", *rng.sample(own, rng.randrange(1, 12))} for i in range(120)}
    asked = {i: {common, *rng.sample(sorted(texts[rng.randrange(120)] - {""}), 1), *(x for x in texts[rng.randrange(120)] if rng.random() < 0.95)} for i in range(60)} | {99: {common}, 98: {"nobody has it"}, 97: {" "}}
    index = frame(spark, [(i, x) for i, xs in texts.items() for x in xs], "owner int, line string")
    queries = frame(spark, [(i, x) for i, xs in asked.items() for x in xs], "query int, line string")
    for ties in ("smallest", "none"):
        got = {r["query"]: (r["lines"], r["hits"], r["owner"]) for r in lines.attribution(queries, index, "query", "owner", 0.85, ties).collect()}
        want = {}
        for i, xs in asked.items():
            solid = {x for x in xs if x.strip()}
            if not solid:
                continue
            hits = {o: len(solid & t) for o, t in texts.items()}
            enough = {o: n for o, n in hits.items() if n >= 0.85 * len(solid) - 1e-9}
            best = [o for o, n in enough.items() if n == max(enough.values())] if enough else []
            chosen = best and (ties == "smallest" or len(best) == 1)
            want[i] = (len(solid), max(enough.values()) if chosen else 0, min(best) if chosen else None)
        assert got == want


def test_sections_headings_and_stars(spark):
    text = "# T\n## A ★\n### B\n#### C\n### D\nx\n## E 历史快照\n#### F\ny\n# U\nz"
    rows = {r.line: (r.chain, r.star, r.old, r.free) for r in lines.heading_chain(lines.exploded(frame(spark, [("d", text)], "doc string, text string"), "doc", "text"), "doc").select("line", "chain", code.is_star(F.lit(""), F.col("chain")).alias("star"), code.is_historical(F.col("line"), F.col("chain")).alias("old"), code.is_exempt(F.lit("### 9.2"), F.lit(None), F.lit(""), F.lit("")).alias("free")).collect()}
    assert rows["x"] == (["A ★", "D"], True, False, True) and rows["y"] == (["E 历史快照", "F"], False, True, True) and rows["z"][0] == [] and rows["#### C"][0] == ["A ★", "B"]
    marks = frame(spark, [("## 示例", None, "", "a"), ("## x", "## 面试", "", "a"), ("## x", None, "**【怎么用】", "a"), ("## x", None, "**【怎么用】", "a // :L3"), ("## x", "y", None, None)], "s string, h string, m string, b string")
    assert [r.e for r in marks.select(code.is_exempt(F.col("s"), F.col("h"), F.col("m"), F.col("b")).alias("e")).collect()] == [True, True, True, False, False]
    found = lines.sections(lines.exploded(frame(spark, [("d", "## a\nx\n## a")], "doc string, text string"), "doc", "text"), "doc", F.col("line").startswith("## "))
    assert [r.code for r in lines.section_findings(found, "doc").collect()] == ["SECTION_DUPLICATE"]
    starred = frame(spark, [("a", i, i == 1, True) for i in range(3)] + [("b", i, i < 5, True) for i in range(9)] + [("c", i, False, False) for i in range(2)], "k string, n int, noted boolean, star boolean")
    assert {r.k: (r.need, r.passed) for r in intervals.density(starred, ["k"], ["n"], F.col("noted"), star=F.col("star")).collect()} == {"a": (3, False), "b": (5, True), "c": (1, False)}


def test_manifest_predicates(spark):
    rows = frame(spark, [("a/POM.xml", "CLASSIFIED", "text"), ("x.ts", "CLASSIFIED", "text"), ("y.py", "VENDOR", "text"), ("z.py", "UNKNOWN", "binary"), ("w.jsx", "UNKNOWN", "text"), ("requirements/dev.txt", "CLASSIFIED", "text")], "path string, classification string, content_kind string")
    assert [r.m for r in rows.select(manifests.is_manifest(F.col("path")).alias("m")).collect()] == [True, False, False, False, False, False]
    assert {tuple(r) for r in manifests.languages(rows).collect()} == {("x.ts", "TypeScript"), ("w.jsx", "JavaScript")}


def test_long_walks_and_cycles(spark):
    chain = spark.range(70).selectExpr("id AS src", "id + 1 AS dst")
    nodes = spark.range(71).withColumnRenamed("id", "node")
    assert {r.node: r.level for r in graph.levels(nodes, chain).collect()} == {i: i for i in range(71)}
    loops = frame(spark, [(0, 1), (1, 2), (2, 1), (2, 3), (3, 4), (4, 3), (4, 5), (6, 6)], "src long, dst long")
    assert {r.node for r in graph.cyclic(loops).collect()} == {1, 2, 3, 4, 6}
    assert {r.node for r in graph.reached(loops, frame(spark, [(2,)], "node long")).collect()} == {1, 2, 3, 4, 5}
    assert {r.node: r.position for r in graph.ordered(frame(spark, [(3,), (1,), (2,)], "node long"), frame(spark, [(3, 1)], "src long, dst long")).collect()} == {2: 1, 3: 2, 1: 3}


def test_cyclic_makes_no_pairs(spark, monkeypatch):
    """Thirty cycles lead to a cycle in the middle and that to thirty others and to a node between them; tables grow with edges alone."""
    pairs = [(2 * i, 2 * i + 1) for i in range(61)]
    edges = [*pairs, *((b, a) for a, b in pairs), *((2 * i, 60) for i in range(30)), *((61, 2 * i) for i in range(31, 61)), (61, 500), (500, 70), (500, 71), (3, 501), (None, 3), (3, None)]
    kept, sizes = graph._kept, []

    def counted(df):
        out = kept(df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(graph, "_kept", counted)
    got = [r.node for r in graph.cyclic(frame(spark, edges, "src long, dst long")).collect()]
    assert sorted(got) == list(range(122))
    assert max(sizes) < 4 * len(edges)
    named = frame(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "e"), ("f", "f")], "src string, dst string")
    assert sorted(r.node for r in graph.cyclic(named).collect()) == ["a", "b", "c", "e", "f"]


@pytest.mark.parametrize("rows_a_task", [2, 500_000])
def test_next_pages_below_a_root_that_all_files_share(spark, rows_a_task):
    """The root's manifest is above every file and decides where no nearer one does; few rows a task give the same."""
    files = ["package.json", "a/package.json", "b/c/package.json", *(f"src/app/p{i}/page.tsx" for i in range(9)), "a/pages/x.ts", "a/pages/api/x.ts", "b/c/app/page.js", "b/app/page.js", "pages/_x.ts", "app/page.md"]
    declaring = ["package.json", "b/c/package.json"]
    table = lambda rows: spark.createDataFrame([(x,) for x in rows], "path string")
    got = {(r.path, r.package) for r in project.next_pages(table(files + files[:4]), table(declaring * 2), rows_a_task).collect()}
    assert got == {(f"src/app/p{i}/page.tsx", "") for i in range(9)} | {("b/c/app/page.js", "b/c")}
    assert project.next_pages(table([]), table([]), rows_a_task).count() == 0
    plan = project.next_pages(table(files), table(declaring), rows_a_task)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan
