"""Approximate nearest neighbours by cosine, with shifted space-filling curves.

Vectors are projected to a few dimensions in several random ways; a Hilbert curve
through the shifted cells of each projection gives every vector a key, and range
partitioning ranks the keys of each curve. A query's candidates are the vectors within
``window`` ranks of its own on any curve. Blocks of ranks are searched on their own: a
vector goes to one block per curve, a query to every block that its window touches. The
best of all blocks and curves are merged; scores are cosines of the original vectors in
double precision.

The window is measured, not guessed: for a bounded sample of queries the exact
neighbours are found by one pass over all rows, and the window is the number of ranks
within which ``RECALL`` of them lie on some curve. Structureless data need wide windows.

Equal vectors are searched once: each is represented by its first ids, so that a vector
that a third of all rows share neither fills windows nor makes a hot group.

Cases: vectors that are null, zero, empty or hold null or non-finite components, and
rows without an id, take no part; vectors of different lengths are never neighbours;
repeated rows count once; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordering import RUN, run_offsets, sorted_runs
from ..storage import materialize
from .common import hash128

CURVES, DIMENSIONS, BITS = 16, 8, 4
#: Vectors that set the cell borders, and queries that set the window, at most.
SAMPLE_VECTORS, SAMPLE_QUERIES = 2048, 64
RECALL = 0.97
BLOCK = 2048
#: Queries that one search of a block takes; with more, the block is searched in parts.
QUERIES_AT_ONCE = 8192
SEED = 5


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place of each row of cell numbers on the Hilbert curve through ``2 ** bits`` cells a dimension."""
    x = cells.T.astype(np.uint32)
    dims = len(x)
    for level in range(bits - 1, 0, -1):
        bit, below = np.uint32(1 << level), np.uint32((1 << level) - 1)
        for d in range(dims):
            turned = (x[d] & bit) != 0
            swap = np.where(turned, 0, (x[0] ^ x[d]) & below).astype(np.uint32)
            x[0] ^= np.where(turned, below, swap).astype(np.uint32)
            x[d] ^= swap
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    flips = np.zeros(x.shape[1], np.uint32)
    for level in range(bits - 1, 0, -1):
        flips ^= np.where((x[-1] & np.uint32(1 << level)) != 0, np.uint32((1 << level) - 1), np.uint32(0))
    x ^= flips
    keys = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, -1, -1):
        for d in range(dims):
            keys = (keys << 1) | ((x[d] >> np.uint32(level)) & 1)
    return keys


class Curves:
    """Projections, shifts and cell borders of all curves, fitted to a sample of vectors."""

    def __init__(self, sample: np.ndarray):
        rng = np.random.default_rng(SEED)
        size = sample.shape[1]
        self.projections, self.borders = [], []
        for _ in range(CURVES):
            turn = rng.normal(size=(size, min(DIMENSIONS, size)))
            self.projections.append(np.linalg.qr(turn)[0])
            shares = (np.arange(1, 1 << BITS) - rng.uniform(0, 1, size=(turn.shape[1], 1))) / (1 << BITS)
            along = _unit(sample) @ self.projections[-1]
            self.borders.append([np.quantile(along[:, d], np.clip(shares[d], 0, 1)) for d in range(turn.shape[1])])

    def keys(self, vectors: np.ndarray) -> np.ndarray:
        """One column of keys per curve."""
        unit = _unit(vectors)
        made = []
        for projection, borders in zip(self.projections, self.borders):
            along = unit @ projection
            cells = np.stack([np.searchsorted(b, along[:, d]) for d, b in enumerate(borders)], axis=1)
            made.append(hilbert_keys(cells, BITS))
        return np.stack(made, axis=1)


def _unit(vectors: np.ndarray) -> np.ndarray:
    # scaled by the largest component first, so that squares neither overflow nor vanish
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, from the original vectors; the same for a pair wherever it is computed."""
    a, b = _scaled(a), _scaled(b)
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def _scaled(x: np.ndarray) -> np.ndarray:
    # by a power of two, which changes no digit
    x = np.ascontiguousarray(x)
    return x * np.exp2(-np.frexp(np.abs(x).max(axis=1, keepdims=True))[1].astype(np.float64))


def _matrix(column: pa.ChunkedArray | pa.Array, size: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id``, ``vector`` and its hashes ``h1``, ``h2`` of the rows that take part."""
    vector = F.col(f"`{vector_col}`").cast("array<double>")
    finite = F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), vector.alias("vector"))
    rows = rows.where(F.col("vec_id").isNotNull() & finite & F.exists("vector", lambda x: x != 0))
    one, two = hash128(F.col("vector"))
    return rows.select("vec_id", "vector", F.size("vector").alias("size"), one.alias("h1"), two.alias("h2"))


def _top(rows: DataFrame, k: int, best: str = "score") -> DataFrame:
    order = Window.partitionBy("q1", "q2").orderBy(F.desc(best), "first_id", "h1", "h2")
    return rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k).drop("_n")


def _exact(distinct: DataFrame, queries: list, k: int, size: int) -> DataFrame:
    """The ``k`` nearest of a bounded list of queries, by one pass over all vectors."""
    marks = np.array([(q["h1"], q["h2"]) for q in queries], np.int64)
    own = np.array([q["vector"] for q in queries], np.float64)

    def run(batches):
        for batch in batches:
            vectors = _matrix(batch.column("vector"), size)
            h1, h2, first = (batch.column(c).to_numpy() for c in ("h1", "h2", "first_id"))
            scores = _unit(own) @ _unit(vectors).T
            scores[(marks[:, :1] == h1) & (marks[:, 1:] == h2)] = -np.inf
            near = np.argsort(-scores, axis=1, kind="stable")[:, :k]
            q = np.repeat(np.arange(len(own)), near.shape[1])
            at = near.ravel()
            good = scores[q, at] > -np.inf
            q, at = q[good], at[good]
            yield _found_rows(marks[q, 0], marks[q, 1], h1[at], h2[at], first[at], scores[q, at])

    return _top(distinct.select("h1", "h2", "first_id", "vector").mapInArrow(run, _FOUND), k)


_FOUND = "q1 long, q2 long, h1 long, h2 long, first_id long, score double"


def _found_rows(*columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [c.split()[0] for c in _FOUND.split(", ")])


def _ranks(distinct: DataFrame, curves: Curves, size: int) -> DataFrame:
    """``h1``, ``h2`` and ``ranks``: the rank on every curve. Only keys are sorted, not vectors."""

    def run(batches):
        for batch in batches:
            keys = curves.keys(_matrix(batch.column("vector"), size))
            yield pa.RecordBatch.from_arrays(
                [batch.column("h1"), batch.column("h2"), pa.array(list(keys), pa.list_(pa.int64()))], ["h1", "h2", "keys"]
            )

    keyed = distinct.select("h1", "h2", "vector").mapInArrow(run, "h1 long, h2 long, keys array<long>")
    flat = materialize(keyed.select("h1", "h2", F.posexplode("keys").alias("curve", "key")), "keys")
    runs = sorted_runs(flat, [F.col(c) for c in ("curve", "key", "h1", "h2")])
    before = run_offsets(runs, {"before": F.count("*")}, ["curve"])
    first = runs.groupBy("curve", RUN).agg(F.min("_at").alias("begin"))
    # one row per curve and partition
    steps = F.broadcast(before.join(first, ["curve", RUN]))
    placed = runs.join(steps, ["curve", RUN]).select(
        "h1", "h2", "curve", (F.col("_at") - F.col("begin") + F.col("before")).alias("rank")
    )
    listed = F.transform(F.sort_array(F.collect_list(F.struct("curve", "rank"))), lambda x: x["rank"])
    return materialize(placed.groupBy("h1", "h2").agg(listed.alias("ranks")), "ranks")


def _window(ranks: DataFrame, exact: DataFrame) -> int:
    """Ranks within which the wanted share of exact neighbours lies on the nearest curve."""
    own = ranks.select(F.col("h1").alias("q1"), F.col("h2").alias("q2"), F.col("ranks").alias("own"))
    apart = exact.join(ranks, ["h1", "h2"]).join(own, ["q1", "q2"]).select(
        F.array_min(F.zip_with("ranks", "own", lambda a, b: F.abs(a - b))).alias("apart")
    )
    found = np.array([r["apart"] for r in apart.collect()])  # SAMPLE_QUERIES times k numbers
    return int(np.quantile(found, RECALL)) + 1 if len(found) else 1


def _searched(k: int, window: int, size: int):
    def run(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy()
        vectors = _matrix(table.column("vector"), size)
        rank, h1, h2, first = (table.column(c).to_numpy() for c in ("rank", "h1", "h2", "first_id"))
        ask, give = np.flatnonzero(asks), np.flatnonzero(~asks)
        unit = _unit(vectors[give]) if len(give) else None
        made = [[np.zeros(0, np.int64)] * 5 + [np.zeros(0)]]
        for begin in range(0, len(ask) if len(give) else 0, 256):
            own = ask[begin : begin + 256]
            scores = _unit(vectors[own]) @ unit.T
            scores[np.abs(rank[own][:, None] - rank[give]) > window] = -np.inf
            scores[(h1[own][:, None] == h1[give]) & (h2[own][:, None] == h2[give])] = -np.inf
            wide = min(k + 3, scores.shape[1])
            near = np.argpartition(-scores, wide - 1, axis=1)[:, :wide]
            q = np.repeat(np.arange(len(own)), wide)
            at = near.ravel()
            good = scores[q, at] > -np.inf
            q, at = own[q[good]], give[at[good]]
            score = cosines(vectors[q], vectors[at]) if len(q) else np.zeros(0)
            order = np.lexsort((first[at], -score, q))
            q, at, score = q[order], at[order], score[order]
            place = np.arange(len(q)) - np.searchsorted(q, q)
            q, at, score = q[place < k], at[place < k], score[place < k]
            made.append([h1[q], h2[q], h1[at], h2[at], first[at], score])
        return pa.Table.from_batches([_found_rows(*[np.concatenate(c) for c in zip(*made)])])

    return run


def _search(distinct: DataFrame, k: int, size: int) -> DataFrame:
    """Nearest distinct vectors of every distinct query vector: ``q1``, ``q2``, ``h1``, ``h2``, ``first_id``, ``score``."""
    count, asking = distinct.agg(F.count("*"), F.coalesce(F.sum(F.col("asks").cast("long")), F.lit(0))).first()

    def some(rows: DataFrame, n: int, of: int) -> list:
        share = int(min(1.0, 1.5 * n / max(1, of)) * (2**31 - 1))
        return rows.where(F.col("h2").bitwiseAND(F.lit(2**31 - 1)) <= share).orderBy("h2", "h1").limit(n).collect()

    curves = Curves(np.array([r["vector"] for r in some(distinct.select("h1", "h2", "vector"), SAMPLE_VECTORS, count)] or [[1.0] * size]))
    ranks = _ranks(distinct, curves, size)
    sample = some(distinct.where("asks").select("h1", "h2", "vector"), SAMPLE_QUERIES, asking)
    window = _window(ranks, _exact(distinct, sample, k, size)) if sample else 1
    parts = max(1, round((2 * window + BLOCK) * asking / max(1, count) / QUERIES_AT_ONCE))

    placed = distinct.join(ranks, ["h1", "h2"]).select("h1", "h2", "first_id", "vector", "asks", F.posexplode("ranks").alias("curve", "rank"))
    block = F.floor(F.col("rank") / BLOCK)
    touched = F.sequence(F.greatest(F.floor((F.col("rank") - window) / BLOCK), F.lit(0)), F.floor((F.col("rank") + window) / BLOCK))
    given = placed.select("*", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), block.alias("block")).withColumn("asks", F.lit(False))
    asked = placed.where("asks").select("*", F.pmod("h1", F.lit(parts)).cast("int").alias("part"), F.explode(touched).alias("block"))
    columns = "curve", "part", "block", "asks", "rank", "h1", "h2", "first_id", "vector"
    groups = given.select(*columns).unionByName(asked.select(*columns)).groupBy("curve", "part", "block")
    return _top(groups.applyInArrow(_searched(k, window, size), _FOUND).distinct(), k)


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` nearest found of every query row: ``query_id``, ``rank`` (from 1), ``vec_id``, ``score``.

    ``is_query`` is a condition on ``vec_id``. Ties go to the smaller id.
    """
    rows = usable(vectors, id_col, vector_col)
    first = Window.partitionBy("h1", "h2").orderBy("vec_id")
    firsts = rows.distinct().withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= k + 1)
    ids = firsts.groupBy("h1", "h2").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    queries = materialize(rows.where(is_query).select("vec_id", "h1", "h2").distinct(), "queries")
    asking = queries.select("h1", "h2").distinct().withColumn("asks", F.lit(True))
    distinct = firsts.where("_n = 1").drop("_n").join(ids, ["h1", "h2"]).join(asking, ["h1", "h2"], "left")
    distinct = materialize(
        distinct.select("h1", "h2", "size", "vector", "ids", F.col("vec_id").alias("first_id"), F.coalesce("asks", F.lit(False)).alias("asks")), "distinct"
    )
    found = None
    for (size,) in sorted(map(tuple, distinct.select("size").distinct().collect())):
        own = _search(distinct.where(F.col("size") == size), k, size)
        found = own if found is None else found.unionByName(own)
    if found is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    alike = distinct.where("asks").select(F.col("h1").alias("q1"), F.col("h2").alias("q2"), F.lit(1.0).alias("score"), "ids")
    near = found.join(distinct.select("h1", "h2", "ids"), ["h1", "h2"]).select("q1", "q2", "score", "ids").unionByName(alike)
    # at most (k + 1) ** 2 ids for each distinct query vector
    entry = F.struct((-F.col("score")).alias("order"), F.col("id").alias("id"))
    listed = near.select("q1", "q2", "score", F.explode("ids").alias("id")).groupBy("q1", "q2").agg(F.sort_array(F.collect_set(entry)).alias("all"))
    best = listed.select(F.col("q1").alias("h1"), F.col("q2").alias("h2"), F.slice("all", 1, k + 1).alias("best"))
    joined = queries.join(best, ["h1", "h2"])
    others = F.slice(F.filter("best", lambda x: x["id"] != F.col("vec_id")), 1, k)
    return joined.select(F.col("vec_id").alias("query_id"), F.posexplode(others).alias("at", "e")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("e.id").alias("vec_id"), (-F.col("e.order")).alias("score")
    )
