"""Files of a manifest that are gone, or shorter than they were written, never make rows vanish in silence."""

import pytest
from pyspark.sql import functions as F

from fathomline.llm import rangecoder, warc
from fathomline.llm.queries import tokenizer


def test_lost_archive_is_an_error_and_a_short_one_a_gap(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://x/{i}", f"<p>page {i}</p>") for i in range(8)], "page_id bigint, url string, html string").repartition(4)
    folder = f"file://{tmp_path}/warc"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # a file for each partition
    manifest = warc.write_archives(pages, folder)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert warc.read_archives(spark, folder, manifest).count() == 8
    files = sorted(tmp_path.glob("warc/*.warc.gz"))
    # cut a file behind its first record, so that what is left is whole
    first = next(x for x in warc.salvage(files[0].read_bytes()))
    data = files[0].read_bytes()
    files[0].write_bytes(data[: first.length])
    rows = warc.read_archives(spark, folder, manifest)
    gaps = rows.filter("gap IS NOT NULL").collect()
    assert [(r.offset, r.length, r.gap) for r in gaps] == ([(first.length, len(data) - first.length, "file ends early")] if first.length < len(data) else [])
    files[1].unlink()
    with pytest.raises(FileNotFoundError, match=files[1].name):
        warc.read_archives(spark, folder, manifest)
    assert warc.read_archives(spark, folder).filter(F.col("gap").isNull()).count() < 8  # without a manifest there is nothing to miss


def test_lost_id_file_is_an_error(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text number {i}") for i in range(8)], "doc_id bigint, text string")
    folder = f"file://{tmp_path}/ids"
    manifest = rangecoder.write_files(docs, tokenizer("word_bpe_49k.json"), folder)
    assert rangecoder.read_files(spark, folder, manifest).count() == 8
    next(tmp_path.glob("ids/*.ids")).unlink()
    with pytest.raises(FileNotFoundError, match=".ids"):
        rangecoder.read_files(spark, folder, manifest)
