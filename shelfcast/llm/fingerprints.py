"""Document fingerprints: Merkle trees over leaves, paragraphs and sections.

A leaf is a sentence, or a part of a long one; paragraphs end at line ends, sections at
blank lines. A node's hash covers its children's; the root covers every character of the
text. The printed fingerprint is the root, then the first digits of the leaf hashes,
paragraphs split by ``,`` and sections by ``;``. It holds no hashes of inner nodes: equal
roots mean equal texts; where roots differ, sections and paragraphs are compared by their
lists of leaf marks to find the edited paragraphs.

Likeness is the share of leaves that two trees have in common, with repeats:
``2 * common / (leaves of both)``; two texts without leaves are alike.

Cases: a null text is an empty one; repeated rows are each other's next document; the
next of a single row is itself; a null id sorts first; an empty table gives no rows;
other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FIRST_KEY, chunks, range_bounds, shuffle_partitions

#: Characters of a leaf at most, and hex digits of its mark.
LEAF_CHARS, MARK_DIGITS = 96, 8
_LEAF = re.compile(rf"[^.!?\n]{{1,{LEAF_CHARS}}}[.!?]*[^\S\n]*|[.!?]+[^\S\n]*|\n")


def _hash(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def fingerprint(text: str) -> str:
    """Root and leaf marks of a text."""
    root = hashlib.blake2b(digest_size=16)
    section = hashlib.blake2b(digest_size=16)
    paragraph: list[bytes] = []
    printed, blank = [], True

    def close(mark: str) -> None:
        nonlocal paragraph
        section.update(_hash(b"".join(paragraph)))
        printed.append("".join(h.hex()[:MARK_DIGITS] for h in paragraph))
        printed.append(mark)
        paragraph = []

    for leaf in _LEAF.findall(text):
        if leaf != "\n":
            paragraph.append(_hash(leaf.encode()))
            blank = blank and leaf.isspace()
        elif blank and printed:
            close(";")
            root.update(section.digest())
            section = hashlib.blake2b(digest_size=16)
        else:
            close(",")
            blank = True
    close("")
    root.update(section.digest())
    return f"{root.hexdigest()}:{''.join(printed)}"


def marks(printed: str) -> list[str]:
    """Leaf marks of a printed fingerprint."""
    leaves = printed.partition(":")[2].replace(",", "").replace(";", "")
    return [leaves[i : i + MARK_DIGITS] for i in range(0, len(leaves), MARK_DIGITS)]


def likeness(one: str, other: str) -> float:
    if one == other:
        return 1.0
    a, b = marks(one), marks(other)
    if not a or not b:
        return 0.0
    return 2 * sum((Counter(a) & Counter(b)).values()) / (len(a) + len(b))


def edited_paragraphs(one: str, other: str) -> tuple[list[int], list[int]]:
    """Numbers of the paragraphs of each that the other has not, found by descending into sections that differ."""

    def sections(printed: str) -> list[list[str]]:
        return [s.split(",") for s in printed.partition(":")[2].split(";")]

    def missing(own: list[list[str]], others: list[list[str]]) -> list[int]:
        same = Counter(map(tuple, others))
        rest = Counter(p for s in others for p in s)
        found, number = [], 0
        for section in own:
            if same[tuple(section)] > 0:
                same[tuple(section)] -= 1
            else:
                for i, paragraph in enumerate(section):
                    if rest[paragraph] > 0:
                        rest[paragraph] -= 1
                    else:
                        found.append(number + i)
            number += len(section)
        return found

    if one.partition(":")[0] == other.partition(":")[0]:
        return [], []
    a, b = sections(one), sections(other)
    return missing(a, b), missing(b, a)


def fingerprinted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_chars`` and ``fingerprint`` of every row."""

    def run(batches):
        for rows in chunks(batches, "text"):
            texts = [t or "" for t in rows.column("text").to_numpy(zero_copy_only=False).tolist()]
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array([fingerprint(t) for t in texts])],
                ["doc_id", "n_chars", "fingerprint"],
            )

    picked = docs.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"cast(`{text_col}` as string) as text")
    return picked.mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


def _dealt(bounds: list[int]):
    """Compressed texts with their range; the first row of a range also ends the range before it, the first of all the last."""

    def run(batches):
        import zstandard

        press = zstandard.ZstdCompressor(level=1)
        edges = np.array(bounds[1:], np.int64)
        before = {first: (i - 1) % len(bounds) for i, first in enumerate(bounds)}
        for rows in chunks(batches, "text"):
            keys = rows.column("doc_id").fill_null(FIRST_KEY).to_numpy()
            buckets = np.searchsorted(edges, keys, side="right")
            packed = [press.compress((t or "").encode()) for t in rows.column("text").to_numpy(zero_copy_only=False).tolist()]
            last = [i for i, k in enumerate(keys.tolist()) if k in before]
            made = [
                [*buckets.tolist(), *[before[int(keys[i])] for i in last]],
                [False] * len(keys) + [True] * len(last),
                [*keys.tolist(), *[int(keys[i]) for i in last]],
                [*rows.column("doc_id").to_pylist(), *[rows.column("doc_id")[i].as_py() for i in last]],
                [*packed, *[packed[i] for i in last]],
            ]
            kinds = [pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(made, kinds)], ["bucket", "beyond", "key", "doc_id", "packed"])

    return run


def _edited(batches):
    """For rows in order: each text's edit by the next, and both trees."""
    import zstandard

    press = zstandard.ZstdDecompressor()
    made: list[tuple] = []
    held = ended = None

    def compared(text, doc, following):
        own, next_print = text[1], following[1]
        n = len(text[0])
        half = n // 2
        new = text[0][: n - half] + following[0][:half]
        new_print = own if new == text[0] else fingerprint(new)
        return (
            doc, n, hashlib.sha256(new.encode()).hexdigest(), own, new_print, likeness(own, new_print), likeness(own, next_print),
        )

    for batch in batches:
        for beyond, doc, packed in zip(*(batch.column(c).to_pylist() for c in ("beyond", "doc_id", "packed"))):
            if ended:
                continue
            text = press.decompress(packed).decode()
            now = (text, fingerprint(text))
            if held is not None:
                made.append(compared(held[1], held[0], now))
            held, ended = (doc, now), beyond
            if len(made) >= 256:
                yield _edit_rows(made)
                made = []
    if made:
        yield _edit_rows(made)


_EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _edit_rows(made: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = [c.split()[0] for c in _EDITED.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*made), kinds)], names)


def edits_by_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every text against itself with its second half taken from the next document by id.

    One shuffle moves compressed texts to ranges of ids. The first row of each range
    goes to the range before it as well, so no range waits for another.
    """
    picked = docs.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"cast(`{text_col}` as string) as text")
    parts = shuffle_partitions(docs)
    bounds = range_bounds(picked, "doc_id", parts)
    if not bounds:
        return docs.sparkSession.createDataFrame([], _EDITED)
    dealt = picked.mapInArrow(_dealt(bounds), "bucket int, beyond boolean, key long, doc_id long, packed binary")
    order = dealt.repartitionById(parts, "bucket").sortWithinPartitions("beyond", "key", "packed")
    return order.select("beyond", "doc_id", "packed").mapInArrow(_edited, _EDITED)
