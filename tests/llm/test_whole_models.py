"""Language models keep all n-grams, however many there are and however they are held."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfcast.llm import language_id


def test_no_ngram_is_left_out(spark):
    letters = random.Random(1)
    texts = ["".join(letters.choices("abcdefghijklmnopqrstuvwxyz", k=60_000)) for _ in range(8)]
    models = language_id.train(spark.createDataFrame([(t, "x") for t in texts], "text string, lang string"))
    grams = {("    " + t + " ")[i : i + 5] for t in texts for i in range(len(t) + 1)}
    assert len(models.models[0].seen[4].hashes) == len(grams) > 400_000


@pytest.fixture(scope="module")
def docs(spark):
    words = random.Random(2)
    own = {lang: ["".join(words.choices(abc, k=words.randint(2, 9))) for _ in range(200)] for lang, abc in (("x", "abcdefgé"), ("y", "efghijkl"), ("z", "日本語中文大小"))}
    rows = [(i, " ".join(words.choices(own[lang], k=60)), lang) for i, lang in enumerate("xyz" * 20)]
    rows += [(100, None, "x"), (101, "", "y"), (102, "12 34", "x"), (103, "abc efg", None), (0, "twice abc", "x"), (0, "twice abc", "x"), (None, "hijkl " * 400_000, "y")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


@pytest.mark.parametrize("slice_ngrams, most_bytes, passes", [(1500, 10**9, 1), (1500, 40_000, 3)])
def test_slices_and_passes_give_the_same(spark, docs, monkeypatch, slice_ngrams, most_bytes, passes):
    find = lambda: sorted(language_id.identified(docs, F.lit(True)).collect(), key=str)
    want = find()
    whole = language_id.train(docs)
    monkeypatch.setattr(language_id, "SLICE_NGRAMS", slice_ngrams)
    monkeypatch.setattr(language_id, "MOST_BYTES", most_bytes)
    models = language_id.train(docs)
    if passes == 1:
        parts = [models]
    else:
        assert models.passes >= passes
        parts = [models.part(at) for at in range(models.passes)]
    assert parts[0].models[0].slices > 2 and all(p.languages == whole.languages for p in parts)
    codes, _ = language_id._codes([r["text"] for r in docs.where("doc_id < 100").collect()] + ["quite another text", "日本 abc"])
    codes = np.unique(codes)
    for i, model in enumerate(whole.models):
        got = np.prod([p.models[i].probabilities(codes) for p in parts], axis=0)
        assert np.allclose(got, model.probabilities(codes), rtol=1e-6)
    got = find()
    assert len(got) == len(want) == docs.count()
    for a, b in zip(got, want):
        assert (a["doc_id"], a["lang_pred"], a["n_symbols"], a["rejected"]) == (b["doc_id"], b["lang_pred"], b["n_symbols"], b["rejected"])
        for c in ("cross_entropy", "score"):
            assert a[c] is b[c] is None or a[c] == pytest.approx(b[c], rel=1e-6)
