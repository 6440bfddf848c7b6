"""Steps of runs that stop between writing and recording; byte spans with every kind of line end."""

import hashlib
import json
import re

import pytest
from pyspark.sql import functions as F

from fathomline.operators import runs, spans

UNITS = "run string, unit string, position long, route string, state string, has_candidate boolean, has_reports boolean"
NEXT = {"PREPARE": "PREPARED", "BUILD": "BUILT_DRAFT", "PREPARE_REVIEW": "AWAITING_REVIEW", "FINALIZE_REVIEW": "REVIEWED_DRAFT"}


def work(acts):
    after = F.create_map(*(F.lit(x) for p in NEXT.items() for x in p))
    return acts.select("run", "unit", F.try_element_at(after, F.col("action")).alias("state"), F.concat("unit", F.lit(" by "), "action").alias("text"))


def begun(spark, folder):
    journal = runs.Journal(spark, f"file://{folder}")
    open_route = "PHASE6A_PROJECT_CLAIM"
    rows = [("r1", "a", 1, open_route, "PLANNED", True, True), ("r1", "b", 2, open_route, "PLANNED", True, True), ("r2", "c", 1, open_route, "PLANNED", False, True), ("r2", "d", 2, "BLOCKED_UNSUPPORTED", "BLOCKED_UPSTREAM", True, True)]
    runs.start(journal, spark.createDataFrame(rows, UNITS))
    return journal, spark.createDataFrame([("b", "a")], "unit string, need string")


def states(journal):
    return {r.unit: r.state for r in journal.states(journal.revision()).collect()}


def test_steps_to_the_end(spark, tmp_path):
    journal, needs = begun(spark, tmp_path)
    with pytest.raises(Exception, match="EXIST"):
        runs.start(journal, journal.states(0).drop("digest"))
    assert runs.advance(journal, needs, work) == (1, "LIMIT") and states(journal) == {"a": "PREPARED", "b": "PLANNED", "c": "PREPARED", "d": "BLOCKED_UPSTREAM"}
    assert runs.advance(journal, needs, work, most=20) == (8, "WAITING")  # c has no writer's text
    assert states(journal) == {"a": "REVIEWED_DRAFT", "b": "REVIEWED_DRAFT", "c": "PREPARED", "d": "BLOCKED_UPSTREAM"}
    revision, found = runs.resume(journal, needs, work)
    assert revision == 8 and found.isEmpty()


def test_stop_between_write_and_record(spark, tmp_path, monkeypatch):
    journal, needs = begun(spark, tmp_path)
    runs.advance(journal, needs, work, most=2)
    real = runs.Journal.record

    def stop(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(runs.Journal, "record", stop)
    with pytest.raises(KeyboardInterrupt):
        runs.advance(journal, needs, work)
    monkeypatch.setattr(runs.Journal, "record", real)
    assert journal.revision() == 2 and runs.advance(journal, needs, work) == (2, runs.RECONCILE)
    other = lambda acts: work(acts).withColumn("text", F.concat("text", F.lit("!")))
    revision, found = runs.resume(journal, needs, other)
    assert revision == 2 and {tuple(r) for r in found.collect()} == {("r1", "a", runs.RECONCILE)}
    revision, found = runs.resume(journal, needs, work)
    assert revision == 3 and found.isEmpty() and states(journal)["a"] == "AWAITING_REVIEW"
    assert runs.advance(journal, needs, work) == (4, "LIMIT")
    # output of a recorded step that is another one by now
    folder = next(tmp_path.glob("outputs/step=000004"))
    spark.createDataFrame([("r1", "a", "REVIEWED_DRAFT", "tampered")], "run string, unit string, state string, text string").write.mode("overwrite").parquet(f"file://{folder}")
    revision, found = runs.resume(journal, needs, work)
    assert revision == 4 and {tuple(r) for r in found.collect()} == {("r1", "a", "OUTPUT_CHANGED")}


def test_stop_while_writing(spark, tmp_path):
    journal, needs = begun(spark, tmp_path)
    (tmp_path / "outputs" / "step=000001").mkdir(parents=True)
    revision, found = runs.resume(journal, needs, work)
    assert revision == 0 and {tuple(r) for r in found.collect()} == {("r1", "a", runs.RECONCILE), ("r2", "c", runs.RECONCILE)}


def test_stale_inputs(spark):
    frame = lambda *rows: spark.createDataFrame(rows, "name string, sha256 string")
    assert {tuple(r) for r in runs.stale(frame(("a", "1"), ("b", "2"), ("c", "3")), frame(("a", "1"), ("b", "x"), ("d", "4"))).collect()} == {("b", "INPUT_CHANGED"), ("c", "INPUT_MISSING"), ("d", "INPUT_NEW")}


PAYLOADS = [b"", b"one", b"one\n", b"\n\n", b"a\rb\r\nc\nd", b"\r\n\r\r\n", b"\xff\x00\xe9\n\x85x\x0by\r", "é日\r\nü".encode()]


def test_byte_lines_and_spans(spark):
    rows = spark.createDataFrame([(i, bytearray(p), a, b) for i, p in enumerate(PAYLOADS) for a in range(4) for b in range(5)] + [(99, None, 1, 1)], "k long, payload binary, a long, b long")
    for r in rows.withColumn("s", spans.byte_span(F.col("payload"), F.col("a"), F.col("b"))).collect():
        lines = re.findall(rb"[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+", bytes(r.payload or b""))
        if r.payload is None or not 1 <= r.a <= r.b <= len(lines):
            assert r.s is None
        else:
            assert (r.s.begin, bytes(r.s.bytes)) == (len(b"".join(lines[: r.a - 1])), b"".join(lines[r.a - 1 : r.b]))


def test_documentation_evidence(spark):
    files = [("a.md", b"\xef\xbb\xbfone\r\ntwo\rthree", True, "text"), ("b.MD", b"x\n", False, "text"), ("c.md", b"a\x00b", True, "text"), ("d.md", b"\xff\n", True, "text"), ("e.md", b"->t", True, "symlink"), ("f.txt", b"x", True, "text")]
    asked = [("a.md", 2, 3), ("a.md", 1, 4), ("a.md", 0, 1), ("a.md", 2, 1), ("a.md", 1, 1), ("a.md", 1, 1), ("b.MD", 1, 1), ("c.md", 1, 1), ("d.md", 1, 1), ("e.md", 1, 1), ("f.txt", 1, 1), ("./a.md", 1, 1), ("../a.md", 1, 1), ("none.md", 1, 1), ("a.md", None, 1)]
    got = {(r.path, r.line_start, r.line_end): r for r in spans.documentation_evidence(spark.createDataFrame(asked, "path string, line_start long, line_end long"), spark.createDataFrame(files, "path string, payload binary, tracked boolean, content_kind string"), "rev", "git_tree").collect()}
    good = got["a.md", 2, 3]
    digest = lambda x: hashlib.sha256(x).hexdigest()
    identity = json.dumps(["repository_documentation", "rev", "git_tree", "a.md", 2, 3, digest(files[0][1]), digest(b"two\rthree")], separators=(",", ":"))
    assert (good.error, good.span_bytes, good.span_sha256, good.id) == (None, 9, digest(b"two\rthree"), "EVID-" + digest(identity.encode())[:24])
    codes = {k: r.error for k, r in got.items() if r.error}
    assert codes == {
        ("a.md", 1, 4): "RANGE_INVALID", ("a.md", 0, 1): "RANGE_INVALID", ("a.md", 2, 1): "RANGE_INVALID", ("a.md", None, 1): "RANGE_INVALID", ("a.md", 1, 1): "SELECTION_REPEATED", ("b.MD", 1, 1): "FILE_UNKNOWN", ("none.md", 1, 1): "FILE_UNKNOWN",
        ("c.md", 1, 1): "FILE_NO_TEXT", ("d.md", 1, 1): "FILE_NO_TEXT", ("e.md", 1, 1): "FILE_NO_TEXT", ("f.txt", 1, 1): "PATH_INVALID", ("./a.md", 1, 1): "PATH_INVALID", ("../a.md", 1, 1): "PATH_INVALID",
    }
    assert all(r.id is None and r.span_bytes is None for k, r in got.items() if k in codes)


def test_excerpts(spark):
    source = b"one\ntwo\r\nthree\nfour"
    digest = lambda x: hashlib.sha256(x).hexdigest()
    rows = [
        ("ok", "e", "p", 1, 1, "one", digest(b"one\n")), ("crlf", "e", "p", 2, 3, "two\r\nthree", digest(b"two\r\nthree\n")), ("end", "e", "p", 3, 4, "three\nfour", digest(b"three\nfour")), ("more", "e", "p", 4, 4, "four\n", digest(b"four")), ("body", "e", "p", 1, 1, "One", digest(b"one\n")),
        ("sha", "e", "p", 1, 1, "one", digest(b"one")), ("range", "e", "p", 2, 1, "", ""), ("long", "long", "q", 1, 21, "", ""), ("level", "low", "p", 1, 1, "one", digest(b"one\n")), ("lines", "part", "p", 1, 2, "one\ntwo", ""), ("path", "e", "q", 1, 1, "x", ""), ("unknown", "zz", "p", 1, 1, "one", ""),
        ("beyond", "long", "q", 2, 3, "", ""), ("nothing", "e", "p", None, 1, None, None),
    ]
    excerpts = spark.createDataFrame([(d, 1, *r) for d, *r in rows], "doc string, spot long, evidence string, path string, first long, last long, shown string, sha256 string")
    evidence = spark.createDataFrame([("e", "E1", "p", 1, 4), ("low", "E2", "p", 1, 4), ("part", "E1", "p", 1, 1), ("long", "E1", "q", 1, 90)], "id string, level string, path string, line_start long, line_end long")
    files = spark.createDataFrame([("p", source), ("q", b"x")], "path string, payload binary")
    got = {r.doc: r.code for r in spans.excerpt_findings(excerpts, evidence, files).collect()}
    assert got == {"more": "BODY", "body": "BODY", "sha": "DIGEST", "range": "RANGE", "long": "RANGE", "level": "EVIDENCE", "lines": "EVIDENCE", "path": "EVIDENCE", "unknown": "EVIDENCE", "beyond": "SOURCE", "nothing": "RANGE"}
