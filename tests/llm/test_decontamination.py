"""Benchmark passages against SQL on the tables, and a plain search on made-up texts."""

import random
import re
from collections import Counter

import duckdb
import pytest

from shelfcast.llm import decontamination, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items, window=10):
    words = lowered(text)
    hit, held = set(), set()
    for item, own in items:
        own = lowered(own)
        size = min(window, len(own))
        for p in range(len(own) - size + 1) if own else ():
            for at in range(len(words) - size + 1):
                if words[at : at + size] == own[p : p + size]:
                    hit |= set(range(at, at + size))
                    if item is not None:
                        held.add(str(item))
    return len(words), len(hit), tuple(sorted(held))


@pytest.mark.parametrize("bounds", [{}, {"most_shingles": 0, "most_bytes": 0}])
def test_brute_force(spark, bounds):
    random.seed(2)
    words = ["Une", "deux", "TROIS", "é", "x1", "und", "the", "of", "Éa\u0301", "😀7", "\x7f"]
    text = lambda n: " ".join(random.choice(words) + random.choice(["", ",", "-", "\n"]) for _ in range(n))
    items = [(i, text(random.choice([0, 1, 2, 3, 7, 10, 11, 30]))) for i in range(25)]
    items += [(None, text(12)), (3, items[3][1]), (77, None), (78, "..."), (79, items[5][1].upper())]
    docs = [(i, text(random.choice([0, 1, 5, 40, 200]))) for i in range(60)]
    docs += [(i + 100, f"{text(6)} {random.choice(items)[1]} {text(6)} {random.choice(items)[1]}") for i in range(40)]
    docs += [(None, items[0][1]), (None, text(30)), (7, docs[9][1]), docs[70], docs[70], (5, None), (6, ""), (8, text(20_000))]
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS v1", "'x' AS words", "2 AS h1", "3 AS shingle")
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS h1", "2 AS own")
    found = decontamination.contamination(frame, bench, **bounds).collect()
    got = Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in found)
    assert got == Counter((d, *brute(t, items)) for d, t in docs)
    assert all(sum(s["length"] for s in r["spans"]) == r["n_hit"] for r in found)
    assert sum(n for (_, _, hit, _), n in got.items() if hit) > 30


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert [tuple(r) for r in decontamination.contamination(docs, items.limit(0)).collect()] == [(1, 3, 0, [], [])]
    assert decontamination.contamination(docs.limit(0), items).collect() == []


def test_query_matches_sql_on_more_rows(spark):
    sf = "/root/testdata/sf0.01"
    connection = duckdb.connect()
    for t in ("documents", "benchmark"):
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = queries.QUERIES["op12_decontamination"](spark, sf)
    columns = sorted(df.columns)
    want = connection.sql(queries.ORACLES["op12_decontamination"]).select(", ".join(columns)).fetchall()
    got = [tuple(r) for r in df.select(*columns).collect()]
    assert Counter(got) == Counter(want)
    assert sum(r["contaminated"] for r in df.collect()) > 5
