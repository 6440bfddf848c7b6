"""The audit of a repository made by the test: a clean one, and one of every defect."""

import subprocess

from pyspark.sql import functions as F

from fathomline.operators import audit
from fathomline.sources import git

INDEX = "path string, object_id string, byte_count long, sha256 string, content_kind string, tracked boolean"
COVERAGE = "path string, classification string, surface string, secondary array<string>, rule_id string, reason string"


def repository(folder):
    run = lambda *a: subprocess.run(["git", "-C", str(folder), "-c", "user.name=a", "-c", "user.email=a@example.org", *a], check=True, capture_output=True)
    run("init", "-q")
    for name in ("a", "b", "c", "d"):
        (folder / f"{name}.txt").write_text(f"text {name}\n")
    (folder / "link").symlink_to("a.txt")
    run("add", ".")
    run("commit", "-qm", "x")


def test_audit_of_a_tree_and_a_worktree(spark, tmp_path):
    repository(tmp_path)
    root = str(tmp_path)
    index = git.inventory(spark, root).select("path", "object_id", "byte_count", "sha256", "content_kind", F.lit(True).alias("tracked"))
    coverage = index.select("path", F.lit("CLASSIFIED").alias("classification"), F.lit("other").alias("surface"), F.array().cast("array<string>").alias("secondary"), F.lit("r").alias("rule_id"), F.lit("because").alias("reason"))
    revision = git.context(root)["revision"]
    stated = audit.Declared(5, 5, 0, revision, revision, revision)
    check = lambda i, c, p, d=stated, complete=False: {tuple(r) for r in audit.coverage_findings(i, c, git.snapshot(spark, root), p, d, ["r"], ["other", "test"], complete).collect()}
    tree = git.tree_payload(spark, root)
    assert check(index, coverage, tree) == set() == check(index, coverage, git.worktree(spark, root).select("path", "byte_count", "sha256", "problem"))
    assert audit.coverage_status(spark.createDataFrame([], "code string, path string"), coverage).first().status == "PASS"
    (tmp_path / "a.txt").write_text("text A\n")
    (tmp_path / "b.txt").write_text("longer text\n")
    (tmp_path / "c.txt").unlink()
    (tmp_path / "link").unlink()
    (tmp_path / "link").write_text("a.txt")
    worktree = git.worktree(spark, root).select("path", "byte_count", "sha256", "problem")
    assert check(index, coverage, worktree) == {("SNAPSHOT_HASH_MISMATCH", "a.txt"), ("SNAPSHOT_SIZE_MISMATCH", "b.txt"), ("SNAPSHOT_FILE_MISSING", "c.txt"), ("SNAPSHOT_FILE_MISSING", "link")}


def test_every_defect_of_the_artifacts(spark, tmp_path):
    repository(tmp_path)
    root = str(tmp_path)
    truth, tree = git.snapshot(spark, root), git.tree_payload(spark, root)
    real = {r.path: r for r in git.inventory(spark, root).collect()}
    row = lambda p, **k: (p, k.get("object_id", real[p].object_id), real[p].byte_count, real[p].sha256, k.get("kind", real[p].content_kind), k.get("tracked", True))
    index = [row("a.txt"), row("a.txt"), row("b.txt", object_id="0" * 40), row("c.txt", kind="symlink", tracked=None), row("link", kind="text"), ("../up", None, 1, "x", "text", True), (None, None, 1, "x", "text", True)]
    coverage = [("a.txt", "CLASSIFIED", "other", ["other"], "r", None), ("b.txt", "IGNORED_WITH_REASON", "other", ["test", "other"], "q", ""), ("c.txt", "UNKNOWN", "test", ["zzz"], None, None), ("link", "CLASSIFIED", "test", None, "r", None), ("../up", "CLASSIFIED", "test", [], "r", None), ("gone.txt", "CLASSIFIED", "test", [], "r", None)]
    stated = audit.Declared(6, 6, 2, "x", "y", "x")
    found = audit.coverage_findings(spark.createDataFrame(index, INDEX), spark.createDataFrame(coverage, COVERAGE), truth, tree, stated, ["r"], ["other", "test"], True)
    assert {tuple(r) for r in found.collect()} == {
        ("DUPLICATE_PATH", "a.txt"), ("SURFACE_INVALID", "a.txt"), ("VCS_OBJECT_MISMATCH", "b.txt"), ("REASON_MISSING", "b.txt"), ("SURFACE_INVALID", "b.txt"), ("CLASSIFICATION_POLICY_MISMATCH", "b.txt"), ("CONTENT_KIND_MISMATCH", "c.txt"), ("TRACKED_FLAG_INVALID", "c.txt"),
        ("REASON_MISSING", "c.txt"), ("SURFACE_INVALID", "c.txt"), ("UNKNOWN_REMAINS", "c.txt"), ("CONTENT_KIND_MISMATCH", "link"), ("UNSAFE_PATH", "../up"), ("PATH_SET_MISMATCH", "../up"), ("UNSAFE_PATH", None), ("PATH_SET_MISMATCH", None), ("PATH_SET_MISMATCH", "gone.txt"),
        ("PATH_SET_MISMATCH", "d.txt"), ("COUNT_MISMATCH", None), ("UNKNOWN_COUNT_MISMATCH", None), ("REVISION_MISMATCH", None),
    }
    assert audit.coverage_status(found, spark.createDataFrame(coverage, COVERAGE)).first().status == "FAIL"
