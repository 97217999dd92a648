"""Near-duplicate documents: SuperMinHash signatures, banding, exact checks and components.

1. One pass over the texts gives every document the size of its shingle set, a 128-bit
   hash of its words and one key per band; equal word sequences then count as one text.
2. In each bucket of a band the text with most bucket mates is the hub and every other
   is checked against it: as many checks as members. Confirmed links give components.
3. Where a bucket still holds several components, its texts meet in blocks of bounded
   size, each in one task, and their full shingle sets are compared there by matrix
   products. Only links that join components leave a task, never pairs.

All checks compare full shingle sets; no two texts that share a bucket and are not yet
connected go unchecked, so no link between different texts is lost.
With 32 bands of 4 places a pair at similarity 0.75 shares a bucket with probability
1 - 5e-6, and a likelier pair with more.

Cases: null texts and texts without words have no shingles, stay and are linked with
nothing; fewer than five words are one shingle; repeated rows and equal texts are one
component; a null id is in no component's minimum unless it is alone; rows are told apart
by id and text, so ids may be null or shared by several texts; an empty table gives no
rows; other columns, whatever their names, are not looked at, or pass unchanged.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize
from .common import chunks, hash128, lean
from .components import connected
from .shingles import band_keys, distinct, normalized, shingles, superminhash

WORDS = 5
#: Similarity from which texts are linked, in hundredths.
LEAST = 75
PLACES, BANDS = 128, 32
#: Texts and shingles of a block, in which the texts of a bucket are compared with each other.
BLOCK_TEXTS, BLOCK_SHINGLES = 1024, 500_000
_CACHED_SHINGLES = 2_000_000
#: Bytes of text that a task signs at once; its tables take some hundred times as much.
SIGNED_BYTES = 250_000


def _signatures(words: int):
    def run(batches):
        import zstandard

        press = zstandard.ZstdCompressor(level=1)
        for rows in chunks(batches, "text", SIGNED_BYTES):
            texts = [normalized(t or "") for t in rows.column("text").to_numpy(zero_copy_only=False).tolist()]
            hashes, at = shingles(texts, words)
            sets = distinct(hashes, at)
            keys = band_keys(superminhash(hashes, at, PLACES), BANDS)
            some = [len(s) > 0 for s in sets]
            marks = [hashlib.blake2b(t, digest_size=16).digest() if s else None for t, s in zip(texts, some)]
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("doc_id"), rows.column("v1"), rows.column("v2"), pa.array([len(s) for s in sets], pa.int64()), pa.array(marks, pa.binary()),
                    pa.array([int.from_bytes(m[:8], "little", signed=True) if m else None for m in marks], pa.int64()),
                    pa.array([k if s else None for k, s in zip(keys, some)], pa.list_(pa.int64())),
                    pa.array([press.compress(t) if s else None for t, s in zip(texts, some)], pa.binary()),
                ],
                ["doc_id", "v1", "v2", "n_shingles", "mark", "node", "keys", "packed"],
            )

    return run


def _checks(words: int, least: int):
    """For rows (a, b, packed_a, packed_b): whether the full shingle sets are near."""

    def run(batches):
        import zstandard

        press = zstandard.ZstdDecompressor()
        kept: OrderedDict[bytes, np.ndarray] = OrderedDict()
        held = 0

        def shingle_set(packed: bytes) -> np.ndarray:
            nonlocal held
            found = kept.pop(packed, None)
            if found is None:
                found = distinct(*shingles([press.decompress(packed)], words))[0]
                held += len(found)
            kept[packed] = found
            while held > _CACHED_SHINGLES and len(kept) > 1:
                held -= len(kept.popitem(last=False)[1])
            return found

        for batch in batches:
            near = []
            for x, y in zip(batch.column("packed_a").to_pylist(), batch.column("packed_b").to_pylist()):
                own, other = shingle_set(x), shingle_set(y)
                small, large = sorted((len(own), len(other)))
                if 100 * small < least * large:
                    near.append(False)
                    continue
                both = np.concatenate([own, other])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                near.append(100 * common >= least * (len(own) + len(other) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(near, pa.bool_())], ["a", "b", "near"])

    return run


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, by products of incidence matrices over the shingles that several sets hold."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    terms, at, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.cumsum(n > 1) - 1
    many = n[at] > 1
    owner, at = owner[many], column[at[many]]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    total = np.zeros((len(sets), len(sets)))
    width = 4096
    for begin in range(0, int(at[-1]) + 1 if len(at) else 0, width):
        low, high = np.searchsorted(at, [begin, begin + width])
        part = np.zeros((len(sets), min(width, int(at[-1]) + 1 - begin)), np.float32)
        part[owner[low:high], at[low:high] - begin] = 1
        total += part @ part.T
    return total


def _met(words: int, least: int):
    """For texts sorted by block of a bucket: links that join components, found by comparing all full sets of a block."""

    def joined(rows: list[tuple], sets: list[np.ndarray]):
        labels = np.array([r[1] for r in rows])
        if (labels == labels[0]).all():
            return
        sizes = np.array([len(s) for s in sets])
        common = _common(sets)
        near = 100 * common >= least * (sizes[:, None] + sizes - common)
        near &= labels[:, None] != labels
        tops = {x: x for x in labels.tolist()}

        def top(x):
            while tops[x] != x:
                x = tops[x]
            return x

        for x, y in zip(*np.nonzero(np.triu(near, 1))):
            one, two = top(int(labels[x])), top(int(labels[y]))
            if one != two:
                tops[max(one, two)] = min(one, two)
                yield rows[x][0], rows[y][0]

    def run(batches):
        import zstandard

        press = zstandard.ZstdDecompressor()
        held: list[tuple] = []
        last = None

        def block():
            found = shingles([press.decompress(r[2]) for r in held], words)
            return list(joined(held, distinct(*found)))

        for batch in batches:
            links = []
            columns = [batch.column(c).to_pylist() for c in ("key", "i", "j", "node", "label", "packed")]
            for key, i, j, node, label, packed in zip(*columns):
                if (key, i, j) != last and held:
                    links += block()
                    held = []
                last = (key, i, j)
                held.append((node, label, packed))
            yield _link_rows(links)
        if held:
            yield _link_rows(block())

    return run


def _link_rows(links: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["a", "b"])


def _confirmed(pairs: DataFrame, texts: DataFrame, words: int, least: int) -> DataFrame:
    """Checks stored ``pairs`` (a, b); returns all of them with ``near``, stored."""
    with_a = pairs.join(texts.select(F.col("node").alias("a"), F.col("packed").alias("packed_a"), F.col("n_shingles").alias("n_a")), "a")
    with_b = with_a.join(texts.select(F.col("node").alias("b"), F.col("packed").alias("packed_b"), F.col("n_shingles").alias("n_b")), "b")
    possible = with_b.where(100 * F.least("n_a", "n_b") >= least * F.greatest("n_a", "n_b"))
    return materialize(possible.select("a", "b", "packed_a", "packed_b").mapInArrow(lean(_checks(words, least)), "a long, b long, near boolean"), "checked")


def _key(id_col: str, text_col: str) -> list[Column]:
    """What tells rows apart: the id and 128 bits of the text."""
    one, two = hash128(F.col(f"`{text_col}`").cast("string"))
    return [F.col(f"`{id_col}`").cast("long").alias("doc_id"), one.alias("v1"), two.alias("v2")]


def _components(docs: DataFrame, words: int, least: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Every row with ``n_shingles`` and the ``mark`` of its words; per mark its ``label`` and ``component``, the smallest id."""
    picked = docs.select(*_key(id_col, text_col), F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = "doc_id long, v1 long, v2 long, n_shingles long, mark binary, node long, keys array<long>, packed binary"
    signed = materialize(picked.mapInArrow(lean(_signatures(words)), schema), "signed")

    # equal texts: one row stands for all, the first by id, wherever it lies
    texts_ids = signed.where("mark is not null").groupBy("mark", "node").agg(
        F.min(F.coalesce("doc_id", F.lit(2**63 - 1))).alias("own")
    )
    texts_ids = materialize(texts_ids, "ids")
    texts = signed.where("mark is not null").select("node", "mark", "n_shingles", "keys", "packed", F.coalesce("doc_id", F.lit(2**63 - 1)).alias("own"))
    texts = materialize(texts.join(texts_ids.select("mark", "own"), ["mark", "own"], "left_semi").drop("own"), "distinct")
    keyed = texts.select("node", F.explode("keys").alias("key"))

    # buckets of more than one text; the hub is the text with most bucket mates over all its
    # bands: what copies were made from shares bands with more of them than they with each other
    buckets = materialize(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    shared = materialize(keyed.join(buckets, "key"), "shared")
    mates = shared.groupBy("node").agg(F.sum("n").alias("mates"))
    members = shared.select("key", "node").join(mates, "node")
    hubs = members.groupBy("key").agg(F.max(F.struct("mates", "node")).alias("h")).select("key", F.col("h.node").alias("hub"))
    found = members.join(hubs, "key").where("node <> hub")
    pairs = materialize(found.select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b")).distinct(), "pairs")
    checked = _confirmed(pairs, texts, words, least)
    links = checked.where("near").select("a", "b")
    labels = connected(links)

    # buckets that still hold several components: their texts meet in blocks
    own = shared.select("key", "node").join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    sizes = texts.select("node", "n_shingles")
    mixed_keys = own.groupBy("key").agg(F.min("label").alias("l"), F.max("label").alias("h")).where("l < h").select("key")
    members = materialize(own.join(mixed_keys, "key", "left_semi").join(sizes, "node"), "mixed")
    if not members.isEmpty():
        blocks = F.greatest(F.ceil(F.count("*") / BLOCK_TEXTS), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int")
        dealt = members.join(members.groupBy("key").agg(blocks.alias("blocks")), "key").select(
            "key", "node", "label", F.pmod(F.xxhash64("node"), "blocks").cast("int").alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
        )
        placed = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "label")
        with_text = placed.join(texts.select("node", "packed"), "node")
        order = ["key", "i", "j"]
        met = with_text.repartition(*order).sortWithinPartitions(*order, "node").mapInArrow(lean(_met(words, least)), "a long, b long")
        more = materialize(met, "met")
        if not more.isEmpty():
            labels = connected(links.unionByName(more))

    labelled = texts_ids.join(labels, "node", "left").select("mark", "own", F.coalesce("label", "node").alias("label"))
    least_id = labelled.groupBy("label").agg(F.min("own").alias("component"))
    return signed, labelled.join(least_id, "label").select("mark", "label", "component")


def near_groups(docs: DataFrame, words: int = WORDS, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` (smallest id reachable) and ``kept`` of every row."""
    signed, by_mark = _components(docs, words, least, id_col, text_col)
    component = F.when(F.col("component") < 2**63 - 1, F.col("component"))
    grouped = signed.select("doc_id", "n_shingles", "mark").join(by_mark, "mark", "left")
    return grouped.select(
        "doc_id", "n_shingles",
        F.when(F.col("mark").isNull(), F.col("doc_id")).otherwise(component).alias("component_id"),
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def without_near_copies(docs: DataFrame, words: int = WORDS, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group: the one of smallest id, a null id last, then by the text's hash.

    Of rows of the same id and text one stays. Rows without words are in no group and all stay.
    """
    signed, by_mark = _components(docs, words, least, id_col, text_col)
    rank = F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("id"), F.col("doc_id").isNull().alias("last"), "v1", "v2")
    rows = signed.select("doc_id", "v1", "v2", "mark").join(by_mark.select("mark", "label"), "mark")
    versions = materialize(rows.groupBy("label", "doc_id", "v1", "v2").agg(F.count("*").alias("n")).withColumn("rank", rank), "versions")
    best = versions.groupBy("label").agg(F.min("rank").alias("best"))
    judged = versions.join(best, "label").select(F.struct("doc_id", "v1", "v2").alias("of"), "n", (F.col("rank") == F.col("best")).alias("stays"))
    judged = materialize(judged.where("n > 1 or not stays"), "judged")
    # a row's own columns stay inside a struct, so no name of theirs can clash
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.struct(*_key(id_col, text_col)).alias("of"))
    same = F.col("a.of").eqNullSafe(F.col("b.of"))
    alone = keyed.alias("a").join(judged.alias("b"), same, "left_anti").select("row.*")
    repeated = judged.where("stays")
    if repeated.isEmpty():
        return alone
    some = keyed.alias("a").join(repeated.alias("b"), same, "left_semi")
    numbered = some.withColumn("n", F.row_number().over(Window.partitionBy("of").orderBy(F.to_json("row"))))
    return alone.unionByName(numbered.where("n = 1").select("row.*"))
