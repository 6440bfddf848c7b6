"""Readers and expressions that no query calls."""

import json

import pytest
from pyspark.sql import functions as F

from fathomline.functions import code
from fathomline.operators import workflow
from fathomline.sources import artifacts


def test_artifact_files_and_traces(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"kind": "x",\n "n": [1, 2]}')
    (tmp_path / "b.json").write_text('{"kind": "y"}')
    got = artifacts.read_artifacts(spark, f"file://{tmp_path}/*.json")
    assert {(r.path.rsplit("/", 1)[-1], r.kind) for r in got.select("path", F.variant_get("document", "$.kind", "string").alias("kind")).collect()} == {("a.json", "x"), ("b.json", "y")}
    (tmp_path / "c.json").write_text('{"a": 1, "a": 2}')
    with pytest.raises(Exception, match="(?i)duplicate|malformed"):
        artifacts.read_artifacts(spark, f"file://{tmp_path}/c.json").select(F.to_json("document")).collect()
    (tmp_path / "t.jsonl").write_text("".join(json.dumps({"step": i, "state": s}) + "\n" for i, s in enumerate("ab")))
    assert [tuple(r) for r in artifacts.read_trace(spark, f"file://{tmp_path}/t.jsonl", "step int, state string").orderBy("step").collect()] == [(0, "a"), (1, "b")]
    (tmp_path / "bad.jsonl").write_text('{"step": 1}\n{"step": \n')
    with pytest.raises(Exception, match="(?i)malformed|failfast"):
        artifacts.read_trace(spark, f"file://{tmp_path}/bad.jsonl", "step int, state string").collect()


def test_unknown_keys(spark):
    rows = spark.createDataFrame([('{"a": 1, "c": {"b": 2}, "d": null}',), ("{}",), ("[1]",), (None,)], "t string")
    assert [r.k for r in rows.select(artifacts.unknown_keys(F.col("t"), ["a", "b"]).alias("k")).collect()] == [["c", "d"], [], None, None]


def test_line_forms_and_escapes(spark):
    rows = spark.createDataFrame([("x(); // note",), ("x();",), ("// all",)], "t string")
    assert [r.v for r in rows.select(code.variants(F.col("t")).alias("v")).collect()] == [["x(); // note", "x();"], ["x();", "x();"], ["// all", ""]]
    marks = spark.createDataFrame([("a<b> & *c* [d](e) #1 x_y `z` | \\",), ("plain",), ("",)], "t string")
    assert [r.e for r in marks.select(code.escaped_markdown(F.col("t")).alias("e")).collect()] == ["a&lt;b&gt; & ".replace("& ", "&amp; ") + "\\*c\\* \\[d\\]\\(e\\) \\#1 x\\_y \\`z\\` \\| \\\\", "plain", ""]


def test_attempts_and_states_of_routes(spark):
    units = spark.createDataFrame([("a", "BLOCKED_REVIEW", 1, ["x", "y"]), ("b", "BLOCKED_REVIEW", 2, ["z"]), ("c", "BLOCKED_REVIEW", 3, ["z"]), ("d", "PREPARED", 1, ["z"]), ("e", "BLOCKED_REVIEW", 0, []), ("f", "BLOCKED_REVIEW", 1, [])], "unit string, state string, attempts int, digests array<string>")
    assert {tuple(r) for r in workflow.open_attempt(units).collect()} == {("a", 2, "y", "REPAIR_READY"), ("b", 3, "z", "REPAIR_READY"), ("f", 2, None, "REPAIR_READY")}
    rows = spark.createDataFrame([("PHASE6A_PROJECT_CLAIM",), ("D2A_GENERAL_LEARNING",), ("UPSTREAM_REQUIRED",), (None,)], "r string")
    assert [r.s for r in rows.select(workflow.route_state(F.col("r")).alias("s")).collect()] == ["PLANNED", "PLANNED", "BLOCKED", "BLOCKED"]
