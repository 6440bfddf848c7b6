"""The pipeline against its operators' brute-force versions, stage by stage."""

import os

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="tables are not here")
def test_stages(spark):
    from fathomline.llm import repetition, toxicity
    from tests.llm.test_operators import brute_fingerprint, brute_removed, components

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r.doc_id: r for r in docs.collect()}
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    frame = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, SF)
        after = {r.doc_id: r for r in frame.collect()}
        assert frame.columns == docs.columns and frame.count() == len(after)
        if name == "toxicity":
            scorer = toxicity.Scorer(model.plain, model.toxic)
            want = {i for i, r in before.items() if model.scores([scorer.features(r.text)])[0] < 0.5}
        elif name == "quality_rules":
            want = {i for i, r in before.items() if repetition.measure(r.text)[6]}
        elif name == "near_dedup":
            bits = {i: brute_fingerprint(r.text) for i, r in before.items()}
            groups = components(bits.values())
            want = {i for i in bits if i == min(j for j in bits if bits[j] in groups[bits[i]])}
        else:
            want, first = set(before), {}
            for i in sorted(before):
                removed = brute_removed(i, before[i].text, first)
                kept = "".join(c for k, c in enumerate(before[i].text) if not any(a <= k < b for a, b in removed))
                assert "".join(after[i].text.split()) == "".join(kept.split())
                assert after[i].n_chars == len(after[i].text)
        assert set(after) == want, name
        frame = spark.createDataFrame(list(after.values()), docs.schema)
        before = after
    pieces = corpus_pipeline.STAGES[-1][1](spark, frame, SF).toPandas()
    assert set(pieces.doc_id) == set(before) and (pieces.groupby("sequence_id").length.sum().iloc[:-1] == 1024).all()
    assert corpus_pipeline.run(spark, SF).count() == len(pieces)


@pytest.mark.skipif(not os.path.isdir(SF), reason="tables are not here")
def test_stages_take_odd_rows(spark):
    """Nulls in any column, empty and very long texts, repeated rows and ids, clashing names, no rows at all."""
    from tests.llm.test_operators import LONG

    schema = "doc_id long, text string, lang string, source string, n_chars int, bits string, _doc string, score string, tags array<string>"
    plain = "One plain sentence of words that nobody else has written here, number {}; it goes on for a while so that no rule finds it short."
    row = lambda i, text, source="s": (i, text, "en", source, 1, "b", "d", None, ["t"])
    rows = [row(1, plain.format("one")), row(1, plain.format("one")), row(1, LONG), row(2, None), row(3, ""), row(None, plain.format("seven hundred and two, quite another one"), None), row(None, None), (None,) * 9, row(4, "dup " * 100), row(5, LONG + " end")]
    for frame in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema), spark.createDataFrame(rows, schema).drop("n_chars", "tags")):
        docs = frame
        for name, stage in corpus_pipeline.STAGES[:-1]:
            kept = stage(spark, docs, SF)
            assert kept.columns == frame.columns and kept.dtypes == frame.dtypes
            after = kept.collect()
            if name == "toxicity":
                assert len(after) == docs.count()  # nothing here is toxic
            elif name == "quality_rules":
                assert all(r.text for r in after)
            elif name == "near_dedup":
                assert len(after) == len({(r.doc_id, r.text) for r in after})
                if after:
                    assert [r.doc_id for r in after].count(None) == 1 and {r.text for r in after if r.doc_id == 1} == {plain.format("one"), LONG}
            docs = spark.createDataFrame(after, frame.schema)
        pieces = corpus_pipeline.STAGES[-1][1](spark, frame, SF)
        assert pieces.select("doc_id").distinct().count() == frame.select("doc_id").distinct().count()
        assert pieces.filter("start = 0").count() == frame.count()
