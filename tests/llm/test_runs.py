"""Periodic runs against a brute-force search by period."""

import hashlib
import random
import re
import zlib

from pyspark.sql import functions as F

from shelfcast.llm import queries, runs

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words, least=12):
    """Runs by trying every period: stretches of places that agree with the place so far ahead."""
    found, n = {}, len(words)
    for period in range(1, n // 2 + 1):
        at = 0
        while at + period < n:
            start = at
            while at + period < n and words[at] == words[at + period]:
                at += 1
            length = at - start + period
            if at > start and length >= max(least, 2 * period):
                found.setdefault((start, length), period)
            at += 1
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda r: (r[0], r[2]))


def test_runs_brute_force():
    random.seed(3)
    texts = []
    for _ in range(2000):
        words = [b"w%d" % random.randrange(random.randint(1, 4)) for _ in range(random.randint(0, 60))]
        if len(words) > 3 and random.random() < 0.5:
            a = random.randrange(len(words))
            p = 1 + random.randrange(max(1, (len(words) - a) // 3))
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(len(words))]
        texts.append(words)
    for least in (1, 2, 5, 12):
        for begin in range(0, len(texts), 50):
            part = texts[begin : begin + 50]
            assert runs.find_runs(part, least) == [brute(t, least) for t in part]


def test_long_periodic_texts():
    one = [b"a"] * 60_000
    line = [w for i in range(4000) for w in [*(b"l%d" % j for j in range(8)), b"%d" % i]]
    nested = ([b"x%d" % i for i in range(5)] + [b"a"] * 50) * 40
    assert runs.find_runs([one, line, nested]) == [
        [(0, 60_000, 1)], [], [(0, 2200, 55), *((5 + 55 * i, 50, 1) for i in range(40))],
    ]


def test_query_brute_force(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in queries.table(spark, SF, "documents").collect()}
    found = queries.QUERIES["op13_periodic_runs"](spark, SF).collect()
    assert sorted(r["doc_id"] for r in found) == sorted(texts)
    with_runs = 0
    for r in found:
        words = WORD.findall(texts[r["doc_id"]])
        h, n = zlib.crc32(str(r["doc_id"]).encode()), len(words)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        if n > 3000:
            continue  # trying every period takes too long; the long texts are compared above
        want = brute(words)
        best = min(want, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        dropped = {i for s, m, q in want for i in range(s + q, s + m)}
        left = " ".join(w for i, w in enumerate(words) if i not in dropped)
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(want), *best)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if want else None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in want).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(left.encode()).hexdigest()
        with_runs += bool(want)
    assert with_runs > 10


def test_odd_rows(spark):
    again = "we say it again and again " * 4
    rows = [(1, None, "r"), (2, "", "r"), (None, again, "r"), (3, again, None), (3, again, None), (4, "\n \t", "r"), (5, "é " * 12, "r"), (6, "one two", "r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string").withColumn("collapsed", F.lit(1))
    found = [(r[0], r[1], [tuple(x) for x in r[2]], r[3]) for r in runs.periodic_runs(docs).collect()]
    once = "we say it again and again"
    assert sorted(found, key=str) == sorted(
        [(1, 0, [], ""), (2, 0, [], ""), (None, 24, [(0, 24, 6)], once), (3, 24, [(0, 24, 6)], once), (3, 24, [(0, 24, 6)], once),
         (4, 0, [], ""), (5, 12, [(0, 12, 1)], "é"), (6, 2, [], "one two")], key=str)
    assert runs.periodic_runs(docs.limit(0)).count() == 0
