"""Hard negatives of anchors, by certified search of an inverted multi-index.

Vectors become integers, so inner products are exact. Each vector is cut into two halves
and each half goes to the nearest centre of its codebook; a pair of centres is a cell. For
an anchor, ``a . c + |a| r`` bounds the inner product of its half with every half of a
centre ``c`` whose members lie within radius ``r``. A cell's bound is the sum of its two
half bounds, and a heap yields cells by falling bound (multi-sequence order). A search
wants the best ``k`` rows of a score window; it stops when the next bound is below the
window or below the ``k``-th row found, for then no unseen row can matter. So results are
exact, whatever the codebooks; these only decide how early a search stops.

Positives are searched first, then, per positive, the window of negatives below it. A round
of a search lets every open anchor visit the next cells of its order, four times as many as
in the round before; anchors and cells meet by shard, and the best rows are merged per
anchor by aggregation. Codebooks are fitted to at most ``SAMPLE`` rows; radii are taken
over all rows, and all rows are indexed.

Rows of one vector and label differ only in their ids, and at most the first ``n + 1`` of
them can be among the first ``n``: the others are left out of the index. Anchors of one
vector and label are searched once. So a vector that a third of all rows share makes no hot
cell. A large cell is spread over several shards, and many anchors over several parts.

Cases: rows without an id, a label or a vector, and rows with null or non-finite components,
take no part; vectors of different lengths never meet, and empty ones meet each other with
score 0; ids name rows, so no row of an anchor's id is its positive; repeated rows count
once; scores beyond 64 bits count as the nearest 64-bit number, components beyond 1e300 as
that; a window without rows gives no rows, as do empty tables; other columns are not
looked at.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize
from .common import hash128, shuffle_partitions

#: Rows that codebooks are fitted to, and their most centres and fitting rounds.
SAMPLE, CENTRES, FITTING = 8192, 256, 8
#: Rows of a cell that a codebook aims at, of a shard, and anchors of a part, at most.
CELL_ROWS, SHARD_ROWS, PART_ANCHORS = 64, 32_768, 32_768
FIRST_CELLS = 16
SEED = 11
_TOP = 2**63 - 1
_EXACT = 2.0**53
_LARGEST = 1e300


@dataclass
class Index:
    """Centres and radii of both halves, and the cells that hold rows."""

    size: int
    centres: list[np.ndarray]
    radii: list[np.ndarray]
    filled: set[int]
    shards: dict[int, range]

    def bounds(self, anchor: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Per half, what no inner product with a centre's members exceeds, and what none falls below."""
        above, below = [], []
        for half, centres, radii in zip(_halves(anchor[None, :]), self.centres, self.radii):
            middle = centres @ half[0]
            reach = np.sqrt((half * half).sum()) * radii
            slack = 1e-9 * (np.abs(middle) + reach) + 1e-6
            above.append(np.nan_to_num(middle + reach + slack, nan=np.inf, posinf=np.inf))
            below.append(np.nan_to_num(middle - reach - slack, nan=-np.inf, neginf=-np.inf))
        return above, below

    def cells(self, anchor: np.ndarray):
        """Filled cells ``(bound, lower bound, cell)`` by falling bound, by a heap over two sorted lists."""
        (one, two), (low_one, low_two) = self.bounds(anchor)
        i_order, j_order = np.argsort(-one, kind="stable").tolist(), np.argsort(-two, kind="stable").tolist()
        one, two, low_one, low_two = one.tolist(), two.tolist(), low_one.tolist(), low_two.tolist()
        heap = [(-(one[i_order[0]] + two[j_order[0]]), 0, 0)]
        while heap:
            bound, i, j = heapq.heappop(heap)
            a, b = i_order[i], j_order[j]
            if (cell := a * len(two) + b) in self.filled:
                yield -bound, low_one[a] + low_two[b], cell
            if j + 1 < len(j_order):
                heapq.heappush(heap, (-(one[a] + two[j_order[j + 1]]), i, j + 1))
            if j == 0 and i + 1 < len(i_order):
                heapq.heappush(heap, (-(one[i_order[i + 1]] + two[b]), i + 1, 0))


def _halves(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cut = (vectors.shape[1] + 1) // 2
    return vectors[:, :cut], vectors[:, cut:]


def _matrix(column: pa.ChunkedArray | pa.Array, size: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), size)


def products(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact integer inner products: in doubles while they hold every sum, else in Python's integers."""
    if not anchors.shape[1]:
        return np.zeros((len(anchors), len(rows)), np.int64)
    most = np.abs(anchors).max(initial=0) * np.abs(rows).max(initial=0) * anchors.shape[1]
    if most < _EXACT:
        return (anchors @ rows.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    return np.clip(whole(anchors) @ whole(rows).T, -_TOP, _TOP).astype(np.int64)


def _centres(sample: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """K-means of a bounded sample."""
    centres = sample[rng.choice(len(sample), min(k, len(sample)), replace=False)]
    for _ in range(FITTING):
        nearest = _nearest(sample, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        n = np.bincount(nearest, minlength=len(centres))
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def _nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(axis=1) - 2 * rows @ centres.T).argmin(axis=1)


def usable(vectors: DataFrame, scale: float, id_col: str, vector_col: str, label: Column) -> DataFrame:
    """``vec_id``, ``label``, ``vector`` (integers, as doubles), its ``size`` and hashes of the rows that take part."""
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), label.cast("string").alias("label"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite)
    # floor() gives a long; doubles from 2 ** 53 on are whole
    scaled = lambda x: F.greatest(F.least(x * scale, F.lit(_LARGEST)), F.lit(-_LARGEST))
    whole = F.transform("vector", lambda x: F.when(F.abs(scaled(x)) < _EXACT, F.floor(scaled(x)).cast("double")).otherwise(scaled(x)))
    rows = rows.select("vec_id", "label", whole.alias("vector"))
    one, two = hash128(F.col("vector"))
    return rows.select("vec_id", "label", "vector", F.size("vector").alias("size"), one.alias("h1"), two.alias("h2"))


def build(rows: DataFrame, size: int) -> tuple[Index, DataFrame]:
    """The index of rows of one length, and the stored rows with their ``shard`` and ``cell``."""
    n = rows.count()
    centres = max(1, min(CENTRES, int(np.sqrt(n / CELL_ROWS))))
    share = min(1.0, 1.5 * SAMPLE / max(1, n))
    some = rows.where(F.col("h2").bitwiseAND(F.lit(2**31 - 1)) <= int(share * (2**31 - 1))).orderBy("h2", "h1", "vec_id", "label").limit(SAMPLE)
    picked = [r["vector"] for r in some.select("vector").collect()] or [[0.0] * size]
    sample = np.array(picked, np.float64).reshape(len(picked), size)
    rng = np.random.default_rng(SEED)
    books = [_centres(half, centres, rng) for half in _halves(sample)]

    def placed(batches):
        for batch in batches:
            halves = _halves(_matrix(batch.column("vector"), size))
            near = [_nearest(half, book) for half, book in zip(halves, books)]
            apart = [np.sqrt(((half - book[at]) ** 2).sum(axis=1)) for half, book, at in zip(halves, books, near)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *map(pa.array, (near[0] * len(books[1]) + near[1], near[0], near[1], apart[0], apart[1]))],
                [*batch.schema.names, "cell", "a", "b", "apart_a", "apart_b"],
            )

    columns = "vec_id long, label string, vector array<double>, h1 long, h2 long"
    kept = rows.select("vec_id", "label", "vector", "h1", "h2").mapInArrow(placed, f"{columns}, cell long, a long, b long, apart_a double, apart_b double")
    kept = materialize(kept, "placed")
    # at most CENTRES ** 2 rows
    held = kept.groupBy("cell", "a", "b").agg(F.count("*").alias("n"), F.max("apart_a").alias("apart_a"), F.max("apart_b").alias("apart_b")).collect()
    radii = [np.zeros(len(book)) for book in books]
    for r in held:
        radii[0][r["a"]] = max(radii[0][r["a"]], r["apart_a"])
        radii[1][r["b"]] = max(radii[1][r["b"]], r["apart_b"])
    # neighbouring cells share a shard; a cell beyond a shard's rows is spread over several
    most = max(1, min(SHARD_ROWS, n // shuffle_partitions(rows) + 1))
    shard, filled, first = 0, 0, []
    for r in sorted(held, key=lambda r: r["cell"]):
        if filled and filled + r["n"] > most:
            shard, filled = shard + 1, 0
        spread = -(-r["n"] // most)
        first.append((r["cell"], shard, spread))
        filled += r["n"]
        if spread > 1:
            shard, filled = shard + spread, 0
    places = rows.sparkSession.createDataFrame(first or [(0, 0, 1)], "cell long, first int, spread int")
    dealt = kept.join(F.broadcast(places), "cell").withColumn("shard", F.col("first") + F.pmod(F.xxhash64("vec_id", "label"), F.col("spread")).cast("int"))
    shards = {cell: range(at, at + spread) for cell, at, spread in first}
    index = Index(size, books, [r * (1 + 1e-9) + 1e-6 for r in radii], set(shards), shards)
    return index, materialize(dealt.select("shard", "cell", "vec_id", "label", "vector"), "index")


_ASK = "key string, label string, vector array<double>, same boolean, part int, wants array<struct<ceil: bigint, floor: bigint>>"


def _visits(index: Index, k: int, more: int):
    """Per open anchor and shard, which cells to visit next."""

    def run(batches):
        for batch in batches:
            rows = batch.to_pylist()
            vectors = _matrix(batch.column("vector"), index.size)
            asks: dict[str, list] = {c: [] for c in ("key", "shard", "part", "label", "same", "vector", "wants", "cells")}
            for row, vector in zip(rows, vectors):
                wants = row["wants"]
                # from here on down a row can still be wanted: the window's end, or a tie with the k-th row found
                least = min((max(w["floor"], -best[k - 1]["below"]) if len(best) >= k else w["floor"] for w, best in zip(wants, row["best"])), default=_TOP)
                highest = max((w["ceil"] for w in wants), default=-_TOP)
                chosen: dict[int, list[int]] = {}
                for at, (above, below, cell) in enumerate(index.cells(vector)):
                    if above < least or at >= row["visited"] + more:
                        break
                    if at >= row["visited"] and below <= highest:
                        for shard in index.shards[cell]:
                            chosen.setdefault(shard, []).append(cell)
                    elif at >= row["visited"]:
                        chosen.setdefault(-1, [])  # nothing to see there, but the search goes on
                for shard, cells in chosen.items():
                    for name, value in zip(asks, (row["key"], shard, row["part"], row["label"], row["same"], row["vector"], wants, cells)):
                        asks[name].append(value)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(asks["key"], pa.string()), pa.array(asks["shard"], pa.int32()), pa.array(asks["part"], pa.int32()), pa.array(asks["label"], pa.string()),
                    pa.array(asks["same"], pa.bool_()), pa.array(asks["vector"], pa.list_(pa.float64())),
                    pa.array(asks["wants"], pa.list_(pa.struct([("ceil", pa.int64()), ("floor", pa.int64())]))), pa.array(asks["cells"], pa.list_(pa.int64())),
                ],
                list(asks),
            )

    return run


def _met(size: int, k: int):
    """The best rows of a shard for each anchor and window that visits it."""

    def run(key, asks: pa.Table, rows: pa.Table) -> pa.Table:
        made: dict[str, list] = {c: [] for c in ("key", "want", "below", "vec_id")}
        if asks.num_rows and rows.num_rows:
            order = np.argsort(rows.column("cell").to_numpy(), kind="stable")
            cells = rows.column("cell").to_numpy()[order]
            vectors, ids = _matrix(rows.column("vector"), size)[order], rows.column("vec_id").to_numpy()[order]
            names, labels = np.unique(np.array([*rows.column("label").to_pylist(), *asks.column("label").to_pylist()], object).astype(str), return_inverse=True)
            of_row, of_ask = labels[: len(order)][order], labels[len(order) :]
            keys, same = asks.column("key").to_pylist(), asks.column("same").to_numpy(zero_copy_only=False)
            wants, asked, own = asks.column("wants").to_pylist(), asks.column("cells").to_pylist(), _matrix(asks.column("vector"), size)
            by_cell: dict[int, list[int]] = {}
            for i, some in enumerate(asked):
                for cell in some:
                    by_cell.setdefault(cell, []).append(i)
            found: dict[int, list] = {}
            for cell, who in by_cell.items():
                a, b = np.searchsorted(cells, [cell, cell + 1])
                if a == b:
                    continue
                for begin in range(0, len(who), 512):
                    some = who[begin : begin + 512]
                    scores = products(own[some], vectors[a:b])
                    right = (of_row[a:b] == of_ask[some][:, None]) == same[some][:, None]
                    for i, line, good in zip(some, scores, right):
                        at = np.flatnonzero(good)
                        if len(at):
                            found.setdefault(i, []).append((line[at], ids[a:b][at]))
            for i, parts in found.items():
                scores, own_ids = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
                order = np.lexsort((own_ids, -scores))
                scores, own_ids = scores[order], own_ids[order]
                for n, want in enumerate(wants[i]):
                    a = int(np.searchsorted(-scores, -want["ceil"], "left"))
                    b = min(int(np.searchsorted(-scores, -want["floor"], "right")), a + k)
                    made["key"] += [keys[i]] * max(0, b - a)
                    made["want"] += [n] * max(0, b - a)
                    made["below"] += (-scores[a:b]).tolist()
                    made["vec_id"] += own_ids[a:b].tolist()
        return pa.table({"key": pa.array(made["key"], pa.string()), "want": pa.array(made["want"], pa.int32()), "below": pa.array(made["below"], pa.int64()), "vec_id": pa.array(made["vec_id"], pa.int64())})

    return run


def search(asks: DataFrame, index: Index, rows: DataFrame, k: int, first_cells: int = FIRST_CELLS) -> DataFrame:
    """Stored: for every ask (columns ``_ASK``) and window ``want`` the first ``k`` rows of the window, ``best``.

    A row is wanted if its label is the anchor's (``same``) or another, and its score is from ``floor`` to
    ``ceil`` of a window. Rows come by falling score, then id; ``below`` is the negated score.
    """
    fresh = F.transform("wants", lambda w: F.array().cast("array<struct<below: bigint, vec_id: bigint>>"))
    state = materialize(asks.select("*", F.lit(0).cast("long").alias("visited"), fresh.alias("best")), "state")
    open_, done, more = state, [], first_cells
    schema = "key string, shard int, part int, label string, same boolean, vector array<double>, wants array<struct<ceil: bigint, floor: bigint>>, cells array<bigint>"
    while True:
        visits = materialize(open_.mapInArrow(_visits(index, k, more), schema), "visits")
        going = visits.select("key").distinct()
        done.append(open_.join(going, "key", "left_anti").select("key", F.posexplode("best").alias("want", "best")))
        if visits.isEmpty():
            break
        real = visits.where("shard >= 0")
        # a shard goes once to every part of the anchors that visits it
        touched = real.select(F.col("shard").alias("at"), F.col("part").alias("of")).distinct()
        wanted = rows.join(touched, F.col("shard") == F.col("at")).drop("shard")
        met = real.groupBy("shard", "part").cogroup(wanted.groupBy("at", "of")).applyInArrow(
            _met(index.size, k), "key string, want int, below long, vec_id long"
        )
        # each shard sends at most k rows for a window
        best = met.groupBy("key", "want").agg(F.slice(F.sort_array(F.collect_list(F.struct("below", "vec_id"))), 1, k).alias("found"))
        listed = best.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("want", "found"))).alias("found"))
        nothing = F.array().cast("array<struct<below: bigint, vec_id: bigint>>")
        merged = F.transform("best", lambda old, i: F.slice(F.sort_array(F.concat(old, F.coalesce(F.try_element_at("found", i), nothing))), 1, k))
        joined = open_.join(going, "key", "left_semi").join(listed, "key", "left").withColumn("best", merged)
        open_ = materialize(joined.withColumn("visited", F.col("visited") + more).drop("found"), "state")
        more *= 4
    found = done[0]
    for part in done[1:]:
        found = found.unionByName(part)
    return materialize(found, "searched")


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, n_positives: int = 5, n_negatives: int = 5, least: int = 80, scale: float = 256.0,
    id_col: str = "vec_id", vector_col: str = "embedding", label: Column | None = None,
) -> DataFrame:
    """Per anchor and positive the first negatives of the window: ``anchor_id``, ``positive_id``, ``rank``, ``negative_id`` and both scores.

    ``is_anchor`` is a condition on ``vec_id``. A positive is one of the first ``n_positives`` other rows of
    the anchor's label, a negative a row of another label whose score is from ``least`` hundredths of the
    positive's up to that. Higher scores come first, ties by id.
    """
    rows = usable(vectors, scale, id_col, vector_col, F.col("label") if label is None else label)
    first = Window.partitionBy("h1", "h2", "size", "label").orderBy("vec_id")
    keep = max(n_positives, n_negatives) + 1
    distinct = rows.distinct().withColumn("n", F.row_number().over(first)).where(F.col("n") <= keep).drop("n")
    distinct = materialize(distinct, "distinct")
    anchors = materialize(rows.where(is_anchor).distinct().withColumn("key", F.concat_ws("_", "h1", "h2", "label")), "anchors")
    made = None
    for (size,) in sorted(map(tuple, anchors.select("size").distinct().collect())):
        index, placed = build(distinct.where(F.col("size") == size), size)
        own = anchors.where(F.col("size") == size)
        parts = max(1, -(-own.count() // PART_ANCHORS))
        asks = own.groupBy("key").agg(F.first("label").alias("label"), F.first("vector").alias("vector"))
        asks = asks.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int"))
        every = F.array(F.struct(F.lit(_TOP).alias("ceil"), F.lit(-_TOP).alias("floor")))
        asks = materialize(asks.select("key", "label", "vector", F.lit(True).alias("same"), "part", every.alias("wants")), "asks")
        # one more than wanted, as an anchor meets itself
        near = search(asks, index, placed, n_positives + 1)
        one = near.select("key", F.explode("best").alias("e")).select("key", (-F.col("e.below")).alias("score"), F.col("e.vec_id").alias("vec_id"))
        scores = one.groupBy("key").agg(F.sort_array(F.collect_set("score"), asc=False).alias("scores"))
        hundredths = F.lit(least).cast("decimal(5,0)") / F.lit(100).cast("decimal(3,0)")
        floor = lambda p: F.ceil(p.cast("decimal(20,0)") * hundredths).cast("long")
        windows = F.filter(F.transform("scores", lambda p: F.struct(p.alias("ceil"), floor(p).alias("floor"))), lambda w: (w["floor"] <= w["ceil"]) & (w["ceil"] < _TOP))
        wanting = asks.join(scores, "key").select("key", "label", "vector", F.lit(False).alias("same"), "part", windows.alias("wants"))
        wanting = materialize(wanting.where(F.size("wants") > 0), "wanting")
        below = search(wanting, index, placed, n_negatives)
        negatives = below.join(wanting.select("key", "wants"), "key").select("key", F.get("wants", F.col("want"))["ceil"].alias("score"), "best")
        # an anchor's positives: the first ones found that are not itself; at most n_positives + 1 found for each key
        listed = near.select("key", F.col("best").alias("found"))
        others = F.slice(F.filter("found", lambda e: e["vec_id"] != F.col("vec_id")), 1, n_positives)
        pairs = own.select("key", "vec_id").distinct().join(listed, "key").select("key", F.col("vec_id").alias("anchor_id"), F.explode(others).alias("p"))
        pairs = pairs.select("key", "anchor_id", F.col("p.vec_id").alias("positive_id"), (-F.col("p.below")).alias("score"))
        joined = pairs.join(negatives, ["key", "score"]).select("anchor_id", "positive_id", "score", F.posexplode("best").alias("at", "e"))
        part = joined.select(
            "anchor_id", "positive_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("e.vec_id").alias("negative_id"),
            F.col("score").alias("positive_score"), (-F.col("e.below")).alias("negative_score"),
        )
        made = part if made is None else made.unionByName(part)
    if made is None:
        return vectors.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return made
