"""Bounds of the pipeline's stages change what is held at once, never the result."""

import pyarrow as pa
from pyspark.sql import functions as F

from shelfcast.llm import line_dedup, near_dedup


def test_lines_of_several_sites_are_counted_whatever_their_sketch_says(spark, monkeypatch):
    monkeypatch.setattr(line_dedup.F, "hll_sketch_estimate", lambda sketch: F.lit(1).cast("long"))
    line = "a line that three sites hold"
    docs = [(i, f"{line}\nown words of document number {i}", site) for i, site in enumerate("abc")]
    docs += [(9, "a line that two sites hold", "a"), (10, "a line that two sites hold", "b"), (11, "a line of one site only", "a")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string")
    found = {r["doc_id"]: r["lines_removed"] for r in line_dedup.without_boilerplate(frame).collect()}
    assert found == {0: 0, 1: 1, 2: 1, 9: 0, 10: 0, 11: 0}


def test_texts_are_signed_a_few_at_a_time(monkeypatch):
    texts = [f"word{i} " * 40 + f"end {i}" for i in range(30)] + ["", None]
    ids = pa.array(range(len(texts)), pa.int64())
    batch = pa.RecordBatch.from_arrays([ids, ids, ids, pa.array(texts, pa.string())], ["doc_id", "v1", "v2", "text"])
    whole = list(near_dedup._signatures(5)(iter([batch])))
    monkeypatch.setattr(near_dedup, "SIGNED_BYTES", 500)
    parts = list(near_dedup._signatures(5)(iter([batch])))
    assert len(whole) == 1 and len(parts) > 10
    assert pa.Table.from_batches(parts).to_pylist() == pa.Table.from_batches(whole).to_pylist()
