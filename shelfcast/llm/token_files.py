"""Token ids on disk: every document its own zstandard frame under one shared dictionary.

A file set holds three Parquet tables, written and read by Spark alone:

* ``head``: one row with the dictionary, its hash and the width of an id;
* ``ranges``: tokens before each range of documents, one row per write task;
* ``blocks``: rows of up to ``BLOCK_BYTES``: the frames of documents in ascending id
  order, back to back, with ids, token counts and an offset index. A reader of few
  documents prunes blocks by their first and last id and opens those frames only.

Texts are encoded and compressed before the one shuffle, which moves frames. Nulls and
empty texts are one end id; a null id sorts first; repeated rows are each kept, ordered
by their frame; an empty table gives empty files; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import FIRST_KEY, range_bounds, shuffle_partitions
from .tokens import encoded_texts, encoder, id_width, token_ids

#: The dictionary is trained on about so many documents, and on no more bytes than that.
SAMPLE_DOCUMENTS = 1500
SAMPLE_BYTES = 8_000_000
DICTIONARY_BYTES = 65_536
LEVEL = 3
BLOCK_BYTES = 4_000_000
BLOCK_DOCUMENTS = 4096


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int) -> bytes:
    """A zstandard dictionary from the serialised ids of a bounded sample, chosen by a hash of the id."""
    import zstandard

    ids = docs.select(F.col("doc_id"))
    share = SAMPLE_DOCUMENTS / max(1, ids.count())
    bar = int(min(1.0, share) * (2**32 - 1))
    picked = docs.where(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) <= bar)
    sample, held = [], 0
    encoded = token_ids(picked, tokenizer, end_id).where(F.octet_length("ids") <= SAMPLE_BYTES // 100)
    for row in encoded.orderBy(F.crc32(F.col("doc_id").cast("string")), "ids").limit(2 * SAMPLE_DOCUMENTS).collect():
        if held < SAMPLE_BYTES:
            sample.append(bytes(row["ids"]))
            held += len(row["ids"])
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, sample, level=LEVEL, threads=0).as_bytes()
    except zstandard.ZstdError:  # too few samples to learn from: they themselves are the dictionary
        return b"".join(sample)[-DICTIONARY_BYTES:] or b"\0" * 8


def _dictionary(raw: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(raw)


def _frames(tokenizer: str, end_id: int, raw: bytes, bounds: list[int]):
    """Maps rows to (bucket, key, doc_id, n_tokens, frame)."""

    def run(batches):
        import zstandard

        shared, width = _dictionary(raw), encoder(tokenizer).kind.itemsize
        shared.precompute_compress(level=LEVEL)
        press = zstandard.ZstdCompressor(dict_data=shared, write_dict_id=False)
        edges = np.array(bounds[1:], np.int64)
        for rows, encoded in encoded_texts(batches, tokenizer, end_id):
            doc = rows.column("doc_id")
            key = doc.fill_null(FIRST_KEY)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.searchsorted(edges, key.to_numpy(), side="right").astype(np.int32)), key, doc,
                    pa.array([len(x) // width for x in encoded], pa.int64()),
                    pa.array([press.compress(x) for x in encoded], pa.binary()),
                ],
                ["bucket", "key", "doc_id", "n_tokens", "frame"],
            )

    return run


_BLOCKS = (
    "range int, block int, first_id long, last_id long, start long, "
    "doc_ids array<long>, counts array<long>, ends array<long>, frames binary, dictionary_hash string"
)


def _blocks(dictionary_hash: str):
    """Folds the sorted frames of a range into blocks."""

    def run(batches):
        own = TaskContext.get().partitionId()
        docs, keys, counts, frames, used, number, before = [], [], [], [], 0, 0, 0

        def block():
            ends = np.cumsum([len(f) for f in frames])
            row = [own, number, keys[0], keys[-1], before, docs, counts, ends.tolist(), b"".join(frames), dictionary_hash]
            kinds = [pa.int32(), pa.int32(), *[pa.int64()] * 3, *[pa.list_(pa.int64())] * 3, pa.binary(), pa.string()]
            names = [c.split()[0] for c in _BLOCKS.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names)

        for batch in batches:
            for key, doc, n, frame in zip(*(batch.column(c).to_pylist() for c in ("key", "doc_id", "n_tokens", "frame"))):
                if frames and (used + len(frame) > BLOCK_BYTES or len(frames) >= BLOCK_DOCUMENTS):
                    yield block()
                    number, before = number + 1, before + sum(counts)
                    docs, keys, counts, frames, used = [], [], [], [], 0
                docs.append(doc)
                keys.append(key)
                counts.append(n)
                frames.append(frame)
                used += len(frame)
        if frames:
            yield block()

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the ids of all whole texts, each with ``end_id`` after it, as a file set under ``path``."""
    spark = docs.sparkSession
    docs = docs.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"cast(`{text_col}` as string) as text")
    raw = train_dictionary(docs, tokenizer, end_id)
    mark = hashlib.sha256(raw).hexdigest()
    spark.createDataFrame([(mark, bytearray(raw), id_width(tokenizer))], "hash string, dictionary binary, width int").coalesce(1).write.parquet(
        f"{path}/head"
    )
    parts = shuffle_partitions(docs)
    bounds = range_bounds(docs, "doc_id", parts)
    framed = docs.mapInArrow(_frames(tokenizer, end_id, raw, bounds), "bucket int, key long, doc_id long, n_tokens long, frame binary")
    dealt = framed.repartitionById(parts, "bucket").sortWithinPartitions("key", "frame")
    dealt.mapInArrow(_blocks(mark), _BLOCKS).write.parquet(f"{path}/blocks")
    # one row per write task, so a running total over them is small
    totals = spark.read.parquet(f"{path}/blocks").groupBy("range").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    rows, before = [], 0
    for r in sorted(totals.collect()):
        rows.append((r["range"], before))
        before += r["n"]
    spark.createDataFrame(rows, "range int, tokens_before long").coalesce(1).write.parquet(f"{path}/ranges")


def read_tokens(spark: SparkSession, path: str, ids: list[int] | None = None, with_ids: bool = True) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens``, ``ids_crc32`` and ``ids`` from a file set; of the given ids only, if any.

    ``ids`` is a short list for access to single documents; blocks without them are
    skipped and of the others only their frames are opened.
    """
    head = spark.read.parquet(f"{path}/head").first()
    raw, mark, kind = bytes(head["dictionary"]), head["hash"], np.dtype(f"<u{head['width']}")
    if hashlib.sha256(raw).hexdigest() != mark:
        raise ValueError("the dictionary does not fit its hash")
    blocks = spark.read.parquet(f"{path}/blocks")
    wanted = None if ids is None else frozenset(ids)
    if wanted is not None:
        near = F.lit(False)
        for i in sorted(wanted):
            near |= (F.col("first_id") <= i) & (F.col("last_id") >= i)
        blocks = blocks.where(near)
    before = {r["range"]: r["tokens_before"] for r in spark.read.parquet(f"{path}/ranges").collect()}

    def run(batches):
        import zstandard

        press = zstandard.ZstdDecompressor(dict_data=_dictionary(raw))
        for batch in batches:
            for row in batch.to_pylist():
                if row["dictionary_hash"] != mark:
                    raise ValueError("a block was written with another dictionary")
                made, start, begin = [], row["start"] + before[row["range"]], 0
                for doc, n, end in zip(row["doc_ids"], row["counts"], row["ends"]):
                    if wanted is None or doc in wanted:
                        own = np.frombuffer(press.decompress(row["frames"][begin:end]), kind).astype("<u4")
                        if len(own) != n:
                            raise ValueError(f"document {doc} holds {len(own)} ids, its index says {n}")
                        made.append((doc, start, n, zlib.crc32(own), own.astype("<i4") if with_ids else None))
                    start, begin = start + n, end
                    if made and len(made) % 256 == 0:
                        yield _read_rows(made, with_ids)
                        made = []
                if made:
                    yield _read_rows(made, with_ids)

    columns = "range", "start", "doc_ids", "counts", "ends", "frames", "dictionary_hash"
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return blocks.select(*columns).mapInArrow(run, schema)


def _read_rows(made: list[tuple], with_ids: bool) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())][: 5 if with_ids else 4]
    names = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(kinds)]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*made), kinds)], names)
