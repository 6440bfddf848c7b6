"""Lines of blocks against sources: class first, votes, folded lines, trailing comments, snapshots; a history of commits."""

import subprocess

from pyspark.sql import functions as F

from fathomline.operators import fidelity
from fathomline.sources import git

ALPHA = "package a;\nclass Alpha {\n  int one = 1;\n  void run() {\n    call(first,\n         second);\n  }\n  // note\n}\n"
BETA = "class Beta {\n  int one = 1;\n  int two = 2;\n  int three = 3;\n  int four = 4;\n  int five = 5;\n}\n"


def test_owners_and_lost_lines(spark):
    sources = spark.createDataFrame([("a", "Alpha", ALPHA), ("b", "Beta", BETA), ("c", "Beta", "class Beta {\n  int two = 2;\n}"), ("d", "None", None)], "owner string, class string, text string")
    blocks = {
        "folded": ["class Alpha {", "int one = 1;", "void run() {", "call(first, second);", "}"], "commented": ["class Alpha {", "int one = 1; // :L3 the first", "int one = 1; // plain", "void run() {", "made up here", "}"],
        "voted": ["int one = 1;", "int two = 2;", "int three = 3;", "int four = 4;", "int five = 5;", "// a comment", ""], "best": ["int two = 2;", "int three = 3;", "int four = 4;", "int five = 5;", "old line"], "short": ["int one = 1;", "// :L2", "# x", "int two = 2;", "}", ""],
        "nobody": ["q1", "q2", "q3", "q4", "q5"], "comments": ["// a", "// b", "// c", "// d", "// e"],
    }
    rows = spark.createDataFrame([(k, i, line) for k, ls in blocks.items() for i, line in enumerate(ls)] + [("nulls", i, None) for i in range(9)], "block string, line_no long, line string")
    classes = spark.createDataFrame([("folded", "Alpha"), ("commented", "Alpha"), ("best", "Beta"), ("nobody", "Gone"), ("short", "Alpha")], "block string, class string")
    snapshot = spark.createDataFrame([("old line",), ("x",)], "line string")
    got = {r.block: tuple(r)[1:] for r in fidelity.fidelity(rows, classes, sources, snapshot).collect()}
    assert got == {"folded": (5, "a", 0, 0, 0), "commented": (6, "a", 1, 1, 0), "voted": (5, "b", 0, 0, 0), "best": (5, "b", 1, 0, 1), "nobody": (5, None, None, None, None)}
    assert {tuple(r)[3:] for r in fidelity.fidelity(rows, classes, sources).filter("block = 'best'").collect()} == {(1, None, None)}
    assert fidelity.fidelity(rows.limit(0), classes, sources).count() == 0


def test_history_of_four_commits(spark, tmp_path, monkeypatch):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=a", "-c", "user.email=a@example.org", *a], check=True, capture_output=True)
    run("init", "-q")

    def commit(**files):
        for name, text in files.items():
            path = tmp_path / name.replace("__", "/").replace("_", ".")
            path.parent.mkdir(exist_ok=True)
            path.unlink(missing_ok=True) if text is None else path.write_bytes(text)
        run("add", "-A")
        run("commit", "-qm", "x")

    commit(a_java=b"int a;\nint b;\n", s__b_java=b"int  b;\n// note\n", c_txt=b"text\n")
    commit(a_java=b"int a2;\n", s__b_java=b"int  b;\n// note\n")
    commit(a_java=None, d_java=b"int a;\nint b;\n", e_java=b"\xff bad\n")
    commit(a_java=b"int a2;\n")
    commits = git.revisions(str(tmp_path))
    told = git.history(spark, str(tmp_path), commits)
    for number, revision in enumerate(commits):
        want = {(r.path, r.object_id) for r in git.snapshot(spark, str(tmp_path), revision).collect()}
        assert {(r.path, r.object_id) for r in git.at(told, number).collect()} == want
    assert told.filter("path = 'a.java'").count() == 3 and told.filter("path = 'c.txt'").count() == 1
    asked = []
    real = git.blobs
    monkeypatch.setattr(git, "blobs", lambda ids, root, keep_content=False: (asked.append(sorted(r.object_id for r in ids.select("object_id").distinct().collect())), real(ids, root, keep_content))[1])
    lines = {}
    for r in git.snapshot_lines(told, str(tmp_path), ".java", [0, 1, 2, 3]).collect():
        lines.setdefault(r.number, set()).add(r.line)
    assert lines == {0: {"int a;", "int b;"}, 1: {"int a2;", "int b;"}, 2: {"int a;", "int b;", "� bad"}, 3: {"int a2;", "int a;", "int b;", "� bad"}}
    assert [len(x) for x in asked] == [4]  # four different blobs in nine pairs of commit and path
    assert {r.line for r in git.snapshot_lines(told, str(tmp_path), ".java").collect()} == set().union(*lines.values())
    assert git.history(spark, str(tmp_path), []).count() == 0 and git.history(spark, str(tmp_path), commits[:1]).filter(F.col("until").isNotNull()).count() == 0


def test_sources_are_read_for_lines_once_and_for_texts_once(spark):
    """Rows of sources that are computed: for their classes, for the lines that blocks ask for, and for the texts of owners that lack a line."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    own = [("a", "Alpha", ALPHA), ("b", "Beta", BETA), *((f"z{i}", f"Z{i}", f"only {i}\n" * 3) for i in range(30))]
    sources = spark.createDataFrame(own, "owner string, class string, text string").mapInPandas(counted, "owner string, class string, text string")
    lines = {"voted": ["int two = 2;", "int three = 3; // old", "int four = 4;", "int five = 5;"], "named": ["class Alpha {", "int one = 1;", "gone", "call(first, second);"]}
    blocks = spark.createDataFrame([(k, i, line) for k, ls in lines.items() for i, line in enumerate(ls)], "block string, line_no long, line string")
    got = fidelity.fidelity(blocks, spark.createDataFrame([("named", "Alpha")], "block string, class string"), sources, spark.createDataFrame([("gone",)], "line string"), share=0.7, least_lines=2)
    assert {tuple(r) for r in got.collect()} == {("voted", 4, "b", 0, 0, 0), ("named", 4, "a", 1, 0, 1)}
    assert seen.value <= 4 * len(own)
