"""Best-fit packing of token pieces into sequences, by hierarchical residual packing.

Round 0 packs the pieces where they are: every task best-fits windows of its own
rows, longest first. Bins that are nearly full are done. The others become items of
the next round, which deals them to fewer tasks, best-fits them again and so on up a
tree, until one task holds all that is left or a round no longer joins any.
A bin moves as a whole, so a piece's place is its offset plus the shifts of its bins.

Cases: null and empty texts are one end id; an empty table gives no rows; repeated
rows are packed as often as they come; other columns are not looked at.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialize
from .common import lean
from .tokens import encoded_texts, encoder

SIZE = 2048
#: A bin with less room than this is done.
NEARLY_FULL = 8
#: Items that one task best-fits at a time.
WINDOW = 60_000
#: A round that joins fewer than one in so many bins is the last.
LEAST_GAIN = 200


def best_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of every item and the fill of every bin: longest item first, tightest bin first."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    fills: list[int] = []
    with_room: list[list[int]] = [[] for _ in range(size + 1)]
    rooms = 0  # bit r is set if a bin has room r
    for item in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[item])
        fitting = rooms >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            own = with_room[room].pop()
            if not with_room[room]:
                rooms ^= 1 << room
        else:
            room, own = size, len(fills)
            fills.append(0)
        bins[item], offsets[item] = own, fills[own]
        fills[own] += length
        left = room - length
        if left:
            if not with_room[left]:
                rooms |= 1 << left
            with_room[left].append(own)
    return bins, offsets, np.array(fills, np.int64)


def _fitted(rows: pa.Table, length: str, size: int, base: int) -> tuple[list[pa.Array], int]:
    bins, offsets, fills = best_fit(rows.column(length).to_numpy(), size)
    fill = fills[bins]
    made = [bins + base, offsets, fill, fill <= size - NEARLY_FULL]
    return [pa.array(x) for x in made], len(fills)


def _packing(size: int, length: str, level: int):
    """Appends ``bin``, ``at`` (offset in it), ``fill`` (of the bin) and ``open`` (not nearly full)."""

    def run(batches):
        base = (level << 56) | (TaskContext.get().partitionId() << 32)
        held: list[pa.RecordBatch] = []

        def flush():
            nonlocal base, held
            rows = pa.Table.from_batches(held)
            columns, made = _fitted(rows, length, size, base)
            base, held = base + made, []
            for name, column in zip(("bin", "at", "fill", "open"), columns):
                rows = rows.append_column(name, column)
            yield from rows.to_batches(max_chunksize=10_000)

        count = used = 0
        for batch in batches:
            held.append(batch)
            count, used = count + len(batch), used + batch.nbytes
            if count >= WINDOW or used >= 64_000_000:
                yield from flush()
                count = used = 0
        if held:
            yield from flush()

    return run


def pack(items: DataFrame, length: str = "length", size: int = SIZE) -> DataFrame:
    """``items`` with ``sequence_id`` and ``offset``: no sequence holds more than ``size``.

    ``items`` must have lengths from 1 to ``size``; columns of its own named like the
    added ones are refused.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema.fields)
    return _packed(items, None, schema, items.columns, length, size)


def _packed(rows: DataFrame, making, schema: str, columns: list[str], length: str, size: int) -> DataFrame:
    """Packs the items that ``making`` yields from batches of ``rows``, by default the rows themselves.

    Items are made and packed in one Python worker: two operators would hold two workers for each task.
    """
    clash = {"sequence_id", "offset", "bin", "at", "fill", "open", "parent", "shift"} & set(columns)
    if clash:
        raise ValueError(f"columns in the way: {sorted(clash)}")
    added = "bin long, at long, fill long, open boolean"
    first = _packing(size, length, 0)
    run = first if making is None else lambda batches: first(making(batches))
    placed = materialize(rows.mapInArrow(lean(run), f"{schema}, {added}"), "placed")

    # one row for each bin that is still open: the piece at offset 0 stands for it
    left = placed.where("open and at = 0").select(F.col("bin").alias("item"), F.col("fill").alias("length"))
    rounds: list[DataFrame] = []
    count, level = left.count(), 1
    while count > 1 and level < 64:
        tasks = max(1, -(-count // WINDOW))
        dealt = left.repartition(tasks, F.xxhash64("item", F.lit(level))).sortWithinPartitions(F.desc("length"), "item")
        joined = materialize(dealt.mapInArrow(lean(_packing(size, "length", level)), f"item long, length long, {added}"), "round")
        rounds.append(joined.select("item", F.col("bin").alias("parent"), F.col("at").alias("shift")))
        left = joined.where("open and at = 0").select(F.col("bin").alias("item"), F.col("fill").alias("length"))
        bins = joined.where("at = 0").count()
        if tasks == 1 or count - bins < count / LEAST_GAIN:
            break
        count, level = left.count(), level + 1

    final = None
    for own in reversed(rounds):
        if final is None:
            final = own
        else:
            above = final.select(F.col("item").alias("parent"), F.col("parent").alias("top"), F.col("shift").alias("more"))
            final = own.join(above, "parent", "left").select(
                "item", F.coalesce("top", "parent").alias("parent"), (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift")
            )
    names = [F.col(f"`{c}`") for c in columns]
    if final is None:
        return placed.select(*names, F.col("bin").alias("sequence_id"), F.col("at").alias("offset"))
    done = placed.where("not open").select(*names, F.col("bin").alias("sequence_id"), F.col("at").alias("offset"))
    moved = placed.where("open").join(final, F.col("bin") == F.col("item"))
    return done.unionByName(
        moved.select(*names, F.col("parent").alias("sequence_id"), (F.col("at") + F.col("shift")).alias("offset"))
    )


def _cut(tokenizer: str, end_id: int, size: int, with_ids: bool):
    """From batches of ``doc_id`` and ``text`` to pieces."""

    def run(batches):
        width = encoder(tokenizer).kind.itemsize
        for rows, encoded in encoded_texts(batches, tokenizer, end_id):
            made = []
            for doc, ids in zip(rows.column("doc_id").to_pylist(), encoded):
                for piece, begin in enumerate(range(0, len(ids), size * width)):
                    own = np.frombuffer(ids[begin : begin + size * width], encoder(tokenizer).kind).astype("<u4")
                    made.append((doc, piece, begin // width, len(own), zlib.crc32(own), own.astype("<i4") if with_ids else None))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())][: 6 if with_ids else 5]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), k) for c, k in zip(zip(*made), kinds)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(kinds)],
            )

    return run


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"cast(`{text_col}` as string) as text")


def _piece_schema(with_ids: bool) -> str:
    return "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")


def pieces(
    docs: DataFrame, tokenizer: str, end_id: int = 0, size: int = SIZE, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Every whole text as pieces of at most ``size`` ids: ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32`` and ``ids``."""
    return _texts(docs, id_col, text_col).mapInArrow(lean(_cut(tokenizer, end_id, size, with_ids)), _piece_schema(with_ids))


def packed_documents(
    docs: DataFrame, tokenizer: str, end_id: int = 0, size: int = SIZE, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """All pieces of all texts with their place: ``sequence_id`` and ``offset``."""
    schema = _piece_schema(with_ids)
    columns = [field.split()[0] for field in schema.split(", ")]
    return _packed(_texts(docs, id_col, text_col), _cut(tokenizer, end_id, size, with_ids), schema, columns, "length", size)
