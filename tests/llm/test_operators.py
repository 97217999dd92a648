"""Each operator against reference SQL, brute force, an exact round trip or held-out rows; and the odd cases."""

import hashlib
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from shelfcast.llm import (
    components, fingerprints, language_id, line_dedup, mixing, near_dedup, neighbours, packing, quality, queries, token_files, tool_calls,
)
from shelfcast.llm.tokens import Encoder
from shelfcast.storage import fresh_path

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, bin string, key string, label int"


@pytest.fixture(scope="module")
def documents(spark):
    return queries.table(spark, SF, "documents")


@pytest.fixture(scope="module")
def texts(documents):
    return {r["doc_id"]: r["text"] or "" for r in documents.collect()}


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, empty and long texts, repeated rows, and columns named like inner ones."""
    long = " ".join(f"word{i % 977} and{i}" for i in range(60_000))
    rows = [
        (1, None, None, None, None, "x", "y", 0), (2, "", "en", "a", 0, "x", "y", 0), (None, "no id here at all today", "en", "a", 1, None, None, None),
        (3, "the same five words again here\nshort", "en", "a", 1, "x", "y", 0), (4, "the same five words again here\nshort", "en", "b", 1, "x", "y", 0),
        (5, "THE same five words again here\nother", None, "c", 1, "x", "y", 0), (5, "THE same five words again here\nother", None, "c", 1, "x", "y", 0),
        (6, long, "en", None, 1, "x", "y", 0), (7, "...!!! 123", "en", "a", 1, "x", "y", 0), (8, "un deux trois quatre cinq six", "fr", "b", 1, "x", "y", 0),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, name):
    connection = duckdb.connect()
    for t in ("documents", "conversations", "benchmark"):
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = connection.sql(queries.ORACLES[name]).select(", ".join(f'"{c}"' for c in columns)).fetchall()
    got = [tuple(r) for r in df.select(*columns).collect()]
    assert len(got) > 0
    assert Counter(got) == Counter(want)


def test_nearest_reaches_the_recall(spark):
    vectors = queries.table(spark, SF, "embeddings")
    rows = vectors.collect()
    ids = np.array([r["vec_id"] for r in rows])
    unit = np.array([r["embedding"] for r in rows], float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    found = queries.QUERIES["op1_nearest_vectors"](spark, SF).collect()
    hits = 0
    asked = ids[ids % 50 == 0]
    for q in asked:
        score = unit @ unit[ids == q][0]
        score[ids == q] = -9
        best = set(ids[np.lexsort((ids, -score))[:5]].tolist())
        own = sorted((r for r in found if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == [1, 2, 3, 4, 5]
        for r in own:
            assert abs(r["score"] - score[ids == r["vec_id"]][0]) < 1e-12
        hits += len(best & {r["vec_id"] for r in own})
    assert hits >= 0.9 * 5 * len(asked)


def test_nearest_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (50, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0])]
    rows += [(7, [1.0, 0.0]), (7, [1.0, 0.0]), (8, [1.0]), (None, [1.0, 0.0]), (9, [float("inf"), 1.0]), (10, [])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("h1", F.lit("extra"))
    found = neighbours.nearest(vectors, F.col("vec_id") % 50 == 0).collect()
    assert [(r[0], r[1], r[2]) for r in sorted(found)] == [
        (0, 1, 1), (0, 2, 7), (0, 3, 50), (0, 4, 2), (50, 1, 0), (50, 2, 1), (50, 3, 7), (50, 4, 2),
    ]
    assert neighbours.nearest(vectors.limit(0), F.col("vec_id") % 50 == 0).collect() == []


def test_language_of_held_out_texts(spark, documents):
    found = queries.QUERIES["op2_language"](spark, SF).join(documents.select("doc_id", "lang"), "doc_id").collect()
    assert len(found) == documents.count()
    held = [r for r in found if r["held_out"]]
    assert held and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in found)
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in found)
    assert np.mean([r["rejected"] for r in found]) < 0.02


def test_language_odd_texts(odd, empty):
    found = {(r["doc_id"], r["lang_pred"], r["rejected"]) for r in language_id.identified(odd, F.lit(True)).collect()}
    assert {(1, "und", True), (2, "und", True), (7, "und", True)} <= found
    assert {x[1] for x in found} <= {"und", "en", "fr"}
    assert language_id.identified(empty, F.lit(True)).count() == 0
    assert {r["lang_pred"] for r in language_id.identified(odd, F.lit(False)).collect()} == {"und"}


def _kneser_ney(texts, symbols):
    """Interpolated Kneser-Ney over dictionaries, by the textbook; probability of a 5-tuple of symbols."""
    grams = Counter()
    for text in texts:
        padded = [0] * 4 + [ord(c) if c.isalpha() else 0 for c in text.lower() + " "]
        grams.update(tuple(padded[i : i + 5]) for i in range(len(padded) - 4))
    tables = {5: grams}
    for k in range(4, 0, -1):
        tables[k] = Counter(g[1:] for g in tables[k + 1])
    sums, kinds, discounts = {}, {}, {}
    for k, table in tables.items():
        sums[k], kinds[k] = Counter(), Counter()
        for g, n in table.items():
            sums[k][g[:-1]] += n
            kinds[k][g[:-1]] += 1
        ones, twos = (sum(n == wanted for n in table.values()) for wanted in (1, 2))
        discounts[k] = min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones else 0.1

    def p(gram):
        k = len(gram)
        if k == 0:
            return 1 / symbols
        total = sums[k][gram[:-1]]
        if total == 0:
            return p(gram[1:])
        d = discounts[k]
        return max(tables[k][gram] - d, 0) / total + d * kinds[k][gram[:-1]] / total * p(gram[1:])

    return tables, p


def test_kneser_ney_against_dictionaries(spark):
    texts = ["abra cadabra alakazam", "abracadabra", "a barbara had a banana", "abracadabra"]
    rows = [(t, "x") for t in texts] + [("uno due tre", "y"), (None, "x"), ("zzz", None)]
    models = language_id.train(spark.createDataFrame(rows, "text string, lang string"))
    alphabet = {ord(c) for t, lang in rows if t and lang for c in t if c.isalpha()} | {0}
    tables, p = _kneser_ney(texts, len(alphabet) + 1)
    model = models.models[models.languages.index("x")]
    code = lambda g: sum(s << (12 * (len(g) - 1 - i)) for i, s in enumerate(g))
    seen = list(tables[5])
    asked = seen + [(*g[:-1], s) for g in seen for s in (ord("q"), ord("a"), 0)] + [(113, 97, 98, 114, 97), (113,) * 5]
    got = model.probabilities(np.array([code(g) for g in asked], np.uint64))
    assert np.allclose(got, [p(g) for g in asked], rtol=1e-5)
    for context in (seen[3][:-1], (1, 2, 3, 4)):
        every = np.array([code((*context, s)) for s in alphabet | {ord("q")}], np.uint64)
        assert abs(model.probabilities(every).sum() - 1) < 1e-5


def test_pruned_models_still_sum_to_one(spark):
    texts = [" ".join(f"{a}{b}{c}" for a in "abcde" for b in "fgh" for c in "ijkl"[: i % 4 + 1]) for i in range(20)]
    models = language_id.train(spark.createDataFrame([(t, "x") for t in texts], "text string, lang string"), most=40)
    model = models.models[0]
    assert len(model.seen[4].hashes) <= 60
    symbols = {0, ord("q"), *(ord(c) for t in texts for c in t if c.isalpha())}
    context = (ord("a") << 36) | (ord("f") << 24)
    every = np.array([(context | (ord("i") << 12)) | s for s in symbols], np.uint64)
    assert abs(model.probabilities(every).sum() - 1) < 1e-5


def test_known_language_keeps_rows_as_they_are(spark, odd, empty):
    clashing = odd.selectExpr("*", "'mine' AS of", "'own' AS _gone", "1 AS version")
    kept = language_id.with_known_language(clashing, F.lit(True))
    assert kept.columns == clashing.columns
    rows = kept.collect()
    assert {r["doc_id"] for r in rows} == {None, 3, 4, 5, 6, 8} and len(rows) == 7
    assert {(r["of"], r["_gone"], r["version"]) for r in rows} == {("mine", "own", 1)}
    assert language_id.with_known_language(empty, F.lit(True)).count() == 0


def test_fingerprints_brute_force(spark, texts):
    found = {r["doc_id"]: r for r in queries.QUERIES["op3_fingerprints"](spark, SF).collect()}
    ids = sorted(texts)
    assert sorted(found) == ids
    for i, doc in enumerate(ids):
        own, after = texts[doc], texts[ids[(i + 1) % len(ids)]]
        half = len(own) // 2
        edited = own[: len(own) - half] + after[:half]
        row = found[doc]
        assert (row["n_chars"], row["edited_sha256"]) == (len(own), hashlib.sha256(edited.encode()).hexdigest())
        assert (row["fingerprint"], row["edited_fingerprint"]) == (fingerprints.fingerprint(own), fingerprints.fingerprint(edited))
        assert row["near_next"] == fingerprints.likeness(fingerprints.fingerprint(own), fingerprints.fingerprint(after))
    assert np.mean([r["near_edited"] for r in found.values()]) > 0.3 > np.mean([r["near_next"] for r in found.values()])


def test_fingerprints_locate_edits(odd, empty):
    one, other = "first line\nsecond line\n\nthird line", "first line\nchanged line\n\nthird line"
    assert fingerprints.edited_paragraphs(fingerprints.fingerprint(one), fingerprints.fingerprint(other)) == ([1], [1])
    assert len({fingerprints.fingerprint(t) for t in ("", "\n", "\n\n", "a", "a\n", "a\n\n", " a", "a.b", "a. b")}) == 9
    assert fingerprints.edits_by_next(odd).count() == odd.count()
    assert fingerprints.edits_by_next(empty).count() == 0


def test_tool_calls_odd_cases(spark):
    calls = spark.createDataFrame(
        [
            (1, 1, "a", "t", '{"x": 1}', []), (1, 2, "b", "t", '{"y": true, "x": "q"}', ["a", "zz"]), (1, 3, "a", "t", '{"x": 2}', []),
            (2, 1, "c", "t", "not json", ["d"]), (2, 2, "d", "t", None, ["c"]), (2, 3, None, "u", "{}", None), (1, 4, "e", "t", '{"x": 5}', ["b"]),
        ],
        "conv_id long, seq long, call_id string, name string, arguments string, needs array<string>",
    )
    results = spark.createDataFrame([(1, 9, "a", "late"), (1, 5, "a", "early"), (7, 1, "a", "orphan")], "conv_id long, seq long, call_id string, content string")
    found = {(r["conv_id"], r["seq"]): r for r in tool_calls.linked(calls, results, {"t": {"x": ("integer", True)}}).collect()}
    assert len(found) == 7
    assert found[1, 1]["record"] == '{"arguments":{"x":1},"id":"a","level":0,"name":"t","result":"early","status":"linked"}'
    assert (found[1, 1]["n_results"], found[1, 3]["status"]) == (2, "duplicate")
    assert found[1, 2]["problems"] == "unknown y; x is not integer; no call zz"
    assert (found[1, 2]["level"], found[1, 4]["level"], found[2, 1]["level"]) == (1, 2, None)
    assert found[2, 1]["problems"] == "not a JSON object" and found[2, 2]["problems"] == "missing x"
    assert found[2, 3]["problems"] == "unknown tool"
    none = tool_calls.linked(calls.limit(0), results.limit(0), {})
    assert none.count() == 0


def test_quality_of_held_out_rows(spark):
    labels = {r["doc_id"]: r["quality"] for r in queries.table(spark, SF, "labels").collect()}
    found = queries.QUERIES["op5_quality"](spark, SF).collect()
    assert len(found) == queries.table(spark, SF, "documents").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.3) for r in found)
    judged = [(r["predicted"], labels[r["doc_id"]]) for r in found if r["held_out"] and r["doc_id"] in labels]
    assert judged and np.mean([a == b for a, b in judged]) > 0.8


def test_quality_tells_the_rarer_label_apart(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in queries.table(spark, sf, "labels").collect()}
    found = queries.QUERIES["op5_quality"](spark, sf).collect()
    held = [(r["score"], r["predicted"], labels[r["doc_id"]]) for r in found if r["held_out"] and labels.get(r["doc_id"]) is not None]
    good, bad = [s for s, _, label in held if label == 1], [s for s, _, label in held if label == 0]
    assert len(bad) >= 5
    assert np.mean([(g > b) + (g == b) / 2 for g in good for b in bad]) > 0.9
    assert np.mean([p == 0 for _, p, label in held if label == 0]) > 0.6


def test_quality_odd_cases(spark, odd, empty):
    labels = spark.createDataFrame([(3, 1), (4, None), (5, 1)], "doc_id long, quality int")
    assert {round(r["score"], 3) for r in quality.scored(odd, labels, F.lit(True)).collect()} == {1.0}
    assert quality.scored(odd, labels.limit(0), F.lit(True)).count() == odd.count()
    assert quality.scored(empty, labels, F.lit(True)).count() == 0


def test_line_dedup_odd_cases(odd, empty):
    rows = sorted(((r["doc_id"] or 0), r["text"], r["lines_removed"]) for r in line_dedup.without_boilerplate(odd).collect() if r["text"] is not None)
    kept = [(a, b, c) for a, b, c in rows if a in (3, 4, 5)]
    assert kept == [(3, "the same five words again here\nshort", 0), (4, "short", 1), (5, "other", 1), (5, "other", 1)]
    assert line_dedup.without_boilerplate(odd).count() == odd.count()
    assert line_dedup.without_boilerplate(empty).count() == 0


def test_encoder_gives_the_librarys_ids():
    import pyarrow as pa

    own = Encoder(queries.tokenizer())
    given = ["It's 'sad' 12²½ É", "<|endoftext|> x", "", None, "a\x1cb\x85c\xa0d İΣσ́ 한국 ß'll're", "é ẞ\tb\n", "reed*** a$$$!!"]
    want = own.tokenizer.encode_batch([t or "" for t in given], add_special_tokens=False)
    assert own.by_word
    assert [np.frombuffer(x, own.kind).tolist() for x in own.encode(pa.array(given))] == [e.ids for e in want]


def _ids(text, end):
    own = Encoder(queries.tokenizer()).tokenizer
    return [*own.encode(text, add_special_tokens=False).ids, end]


def test_token_files_round_trip(spark, documents, texts):
    path = fresh_path(spark, "tokens")
    token_files.write_tokens(documents, path, queries.tokenizer(), end_id=1)
    start = 0
    found = {r["doc_id"]: r for r in token_files.read_tokens(spark, path).collect()}
    assert len(found) == len(texts)
    tokenizer = Encoder(queries.tokenizer()).tokenizer
    for doc in sorted(texts):
        ids = [*tokenizer.encode(texts[doc], add_special_tokens=False).ids, 1]
        row = found[doc]
        assert (row["start"], row["n_tokens"], row["ids"]) == (start, len(ids), ids)
        assert row["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    some = token_files.read_tokens(spark, path, [3, 17, 10**9]).collect()
    assert sorted((r["doc_id"], r["ids"]) for r in some) == [(d, found[d]["ids"]) for d in (3, 17)]


def test_token_files_odd_cases(spark, odd, empty):
    for docs in (odd, empty):
        path = fresh_path(spark, "tokens")
        token_files.write_tokens(docs, path, queries.tokenizer())
        found = token_files.read_tokens(spark, path, with_ids=False).collect()
        assert len(found) == docs.count()
        assert sum(r["n_tokens"] for r in found) == max([r["start"] + r["n_tokens"] for r in found], default=0)


def test_packing_places_every_piece_once(spark, documents, texts):
    rows = packing.packed_documents(documents, queries.tokenizer()).collect()
    tokenizer = Encoder(queries.tokenizer()).tokenizer
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for doc, text in texts.items():
        own = sorted(by_doc[doc], key=lambda r: r["piece"])
        assert [i for r in own for i in r["ids"]] == [*tokenizer.encode(text, add_special_tokens=False).ids, 0]
        assert [r["length"] for r in own[:-1]] == [2048] * (len(own) - 1)
    for own in by_sequence.values():
        place = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == place
            place += r["length"]
        assert place <= 2048
    least = sum(r["length"] for r in rows) / 2048
    assert len(by_sequence) <= least * 1.05 + 1


def test_packing_rounds_join_underfull_bins(spark, odd, empty):
    items = spark.range(3000).select("id", ((F.col("id") * 37) % 700 + 1).alias("length")).repartition(40)
    placed = packing.pack(items).collect()
    assert len(placed) == 3000
    fills = Counter()
    for r in placed:
        fills[r["sequence_id"]] += r["length"]
    assert max(fills.values()) <= 2048 and len(fills) <= sum(fills.values()) / 2048 * 1.06 + 1
    assert packing.packed_documents(empty, queries.tokenizer()).count() == 0
    assert {r["doc_id"] for r in packing.packed_documents(odd, queries.tokenizer(), with_ids=False).collect()} == {None, *range(1, 9)}


def _shingles(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def _groups(rows):
    sets = [(doc, _shingles(text or "")) for doc, text in rows]
    top = list(range(len(sets)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                top[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(sets):
        least[root(i)] = min(least.get(root(i), doc), doc)
    return sorted((doc, len(s), least[root(i)], doc == least[root(i)]) for i, (doc, s) in enumerate(sets))


def test_near_dedup_brute_force(spark, texts):
    found = sorted(map(tuple, queries.QUERIES["op9_near_dedup"](spark, SF).collect()))
    assert found == _groups(texts.items())


def test_near_dedup_of_many_copies_below_and_above_the_threshold(spark, monkeypatch):
    rng = np.random.default_rng(7)
    base, rows = [f"w{i}" for i in range(160)], []
    for doc in range(220):
        words = list(base)
        for at in rng.choice(160, rng.integers(0, 7), replace=False):
            words[at] = f"x{doc}_{at}"
        rows.append((doc, " ".join(words)))
    monkeypatch.setattr(near_dedup, "BLOCK_TEXTS", 50)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, near_dedup.near_groups(docs).collect())) == _groups(rows)


def test_near_dedup_odd_cases(odd, empty):
    found = {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_groups(odd).collect()}
    assert {(1, 0, 1, True), (2, 0, 2, True), (3, 3, 3, True), (4, 3, 3, False), (None, 2, None, True)} <= found
    assert near_dedup.near_groups(odd).count() == odd.count()
    assert near_dedup.near_groups(empty).count() == 0


def test_components_of_a_chain(spark):
    links = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).repartition(7)
    assert {r["label"] for r in components.connected(links).collect()} == {0}


def test_mixing_odd_cases(odd, empty):
    rows = mixing.taken(odd).collect()
    assert len(rows) == odd.count() and all(r["taken"] <= 3 * r["size"] for r in rows)
    assert sum({r["source_size"]: r["target"] for r in rows}.values()) <= sum(r["size"] for r in rows) + 1e-6
    assert mixing.taken(empty).count() == 0
    assert mixing.mixed(odd).columns == odd.columns


def test_pipeline_runs_every_stage(spark, documents):
    docs = documents
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == documents.columns, name
        assert docs.count() > 0 and docs.select("doc_id").subtract(before.select("doc_id")).isEmpty(), name
        if name == "near_dedup":
            assert near_dedup.near_groups(docs).where("not kept").isEmpty()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.where("piece = 0").count() == docs.count()
