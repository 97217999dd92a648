"""Rows in, rows out: what the pipeline's stages keep of odd rows, and columns that clash with inner ones."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from shelfcast.llm import line_dedup, mixing, near_dedup

A = "one two three four five six seven eight nine ten eleven twelve"
B = "eins zwei drei vier fuenf sechs sieben acht neun zehn elf zwoelf"
C = "un deux trois quatre cinq six sept huit neuf dix onze douze"


def kept(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted((tuple(r) for r in near_dedup.without_near_copies(docs).collect()), key=str)


def test_near_copies_are_told_apart_by_id_and_text(spark):
    assert kept(spark, [(1, A), (None, A), (None, B)]) == sorted([(1, A), (None, B)], key=str)
    assert kept(spark, [(1, A), (5, A), (5, B)]) == [(1, A), (5, B)]
    assert kept(spark, [(7, C), (7, C)]) == [(7, C)]
    wordless = [(None, None), (None, None), (3, ""), (3, "")]
    found = kept(spark, [(None, C), (None, C.upper()), *wordless])
    assert [r for r in found if not r[1]] == sorted(wordless, key=str) and len(found) == 5
    assert kept(spark, []) == []


CLASHING = ["row", "of", "doc", "version", "_cuts", "lines_removed", "_doc", "_version", "_gone", "_source", "_copies", "hash", "size", "each", "rank", "a", "b"]


@pytest.mark.parametrize("stage", [line_dedup.without_boilerplate, near_dedup.without_near_copies, mixing.mixed])
def test_columns_of_any_name_pass(spark, stage):
    line = "the very same line stands on every site"
    rows = [(i, f"{line}\n{t}", s) for i, (t, s) in enumerate([(A, "x"), (B, "y"), (C, "z"), (A, "x")])] + [(None, None, None), (9, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").select("*", *[F.lit("mine").alias(c) for c in CLASHING])
    made = stage(docs)
    assert set(made.columns) == set(docs.columns)
    out = made.collect()
    assert out
    for c in CLASHING:
        if c != "lines_removed" or stage is not line_dedup.without_boilerplate:
            assert {r[c] for r in out} == {"mine"}
    if stage is line_dedup.without_boilerplate:
        assert {r["doc_id"]: r["lines_removed"] for r in out} == {0: 0, 1: 1, 2: 1, 3: 1, None: 0, 9: 0}


def test_stages_on_odd_and_empty_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate([A, A, B])] + [(None, C, "fr", None, 1), (None, None, None, None, None), (7, "", "en", "x", 0), (8, C, "fr", "y", 5), (8, C, "fr", "y", 5)]
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, "")
        if name != "packing":
            assert made.columns == docs.columns
        assert made.count() > 0
        assert stage(spark, docs.limit(0), "").count() == 0
    near = corpus_pipeline.near_copies(spark, docs, "")
    assert sorted((str(r["doc_id"]), r["text"]) for r in near.where("text <> ''").collect()) == [("0", A), ("2", B), ("8", C)]
