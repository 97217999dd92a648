"""Periodic runs of words, by maximal pairs over an LCP-interval tree.

A run is a stretch of consecutive words with smallest period ``q`` and length at least
``max(least, 2 * q)`` that no neighbouring word extends keeping that period. Two places
form a maximal pair if the words from there on agree for ``l`` words, then differ, and
the words before them differ. A pair at distance ``q <= l`` spans ``q + l`` words of
period ``q`` that cannot be extended, so such pairs with ``q + l >= least`` are the runs;
of pairs with the same span the nearest gives the smallest period.

Pairs have ``l >= least / 2``. One hash of so many words per place finds the places that
can belong to one: their words occur again in the text behind another word. Only those
places become leaves of the tree. Prefix doubling gives exact ranks of the texts that
have any, sorts the leaves and measures how long neighbours agree. The tree is walked
bottom-up: a node keeps its places sorted, together and by the word before them, and the
smaller of two children asks the larger for places near enough behind other words.

Documents are worked on in slices of an Arrow batch, each by itself: no shuffle, and a
lost task is run again alone. Memory is a small multiple of a slice or of one longer text.

Cases: a null or empty text has no runs and an empty collapsed text; a null id passes;
repeated rows come back as often; an empty table gives no rows; other columns are not
looked at.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from itertools import compress, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks
from .shingles import mix

LEAST = 12
_SLICE = 4_000_000
U = np.uint64
_STEP = U(0x9E3779B97F4A7C15)

RUN_TYPE = "array<struct<start: bigint, length: bigint, period: bigint>>"


def _numbers(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of all texts, a number of its own behind each text, and where texts begin."""
    known: dict[bytes, int] = {}
    fresh = count()
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    numbers = np.empty(starts[-1], np.int64)
    for text, at in zip(texts, starts.tolist()):
        numbers[at : at + len(text)] = np.fromiter(map(known.setdefault, text, fresh), np.int64, len(text))
    numbers[starts[1:] - 1] = -1 - np.arange(len(texts))
    return numbers, starts


def _leaves(numbers: np.ndarray, starts: np.ndarray, words: int) -> np.ndarray:
    """Places whose next ``words`` words come again in their text behind another word."""
    n = len(numbers)
    doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    inside = np.flatnonzero(np.arange(n) + words < starts[1:][doc])
    if not len(inside):
        return inside
    hashes = mix(numbers.view(U) * _STEP)
    grams = np.zeros(n - words + 1, U)
    for j, factor in enumerate(mix(np.arange(1, words + 1, dtype=U) * _STEP) | U(1)):
        grams += hashes[j : j + len(grams)] * factor
    grams = mix(grams[inside] + mix(doc[inside].astype(U) * _STEP))
    order = np.argsort(grams, kind="stable")
    grams, place = grams[order], inside[order]
    first = np.concatenate([[True], grams[1:] != grams[:-1]])
    # the place before a text's first word is the last text's own number, or -1 - 0 before all
    left = np.where(place > 0, numbers[place - 1], -(n + 1))
    begins = np.flatnonzero(first)
    mixed = np.minimum.reduceat(left, begins) != np.maximum.reduceat(left, begins)
    return np.sort(place[np.repeat(mixed, np.diff(np.append(begins, len(grams))))])


def _ranks(numbers: np.ndarray) -> list[np.ndarray]:
    """Order of all places by their next 1, 2, 4, ... words, until no two places are alike; same rank, same words."""
    n = len(numbers)
    order = np.argsort(numbers, kind="stable")
    first = np.concatenate([[True], numbers[order][1:] != numbers[order][:-1]])
    begins = np.flatnonzero(first)
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(begins, np.diff(np.append(begins, n)))
    made, width = [rank.astype(np.int32)], 1
    while True:
        size = np.bincount(rank, minlength=n)
        open_ = np.flatnonzero(size[rank] > 1)
        if not len(open_):
            return made
        key = rank[open_] * n + rank[np.minimum(open_ + width, n - 1)]
        order = np.argsort(key, kind="stable")
        open_, key = open_[order], key[order]
        old = rank[open_]
        at = np.arange(len(open_))
        group = np.maximum.accumulate(np.where(np.concatenate([[True], old[1:] != old[:-1]]), at, 0))
        part = np.maximum.accumulate(np.where(np.concatenate([[True], key[1:] != key[:-1]]), at, 0))
        rank = rank.copy()
        rank[open_] = old + part - group
        width *= 2
        made.append(rank.astype(np.int32))


def _agree(ranks: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many words from places ``a`` and ``b`` on are the same."""
    length = np.zeros(len(a), np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        length += (ranks[level][a + length] == ranks[level][b + length]).astype(np.int64) << level
    return length


class _Node:
    """Places below a node of the tree: all, and by the word before them; sorted."""

    __slots__ = ("places", "behind")

    def __init__(self, place: int, left: int):
        self.places, self.behind = [place], {left: [place]}

    def near(self, place: int, left: int, reach: int):
        """Places within ``reach`` that stand behind another word than ``left``."""
        low, high = bisect_left(self.places, place - reach), bisect_right(self.places, place + reach)
        if high - low <= len(self.behind):
            own = self.behind.get(left, ())
            for other in self.places[low:high]:
                at = bisect_left(own, other)
                if at == len(own) or own[at] != other:
                    yield other
        else:
            for word, own in self.behind.items():
                if word != left:
                    yield from own[bisect_left(own, place - reach) : bisect_right(own, place + reach)]

    def take(self, other: _Node) -> None:
        if len(other.places) == 1:
            insort(self.places, other.places[0])
        else:
            self.places = sorted(self.places + other.places)  # merges two sorted stretches
        for word, own in other.behind.items():
            mine = self.behind.setdefault(word, own)
            if mine is own:
                continue
            if len(own) == 1:
                insort(mine, own[0])
            else:
                self.behind[word] = sorted(mine + own)


def _pairs(places: list[int], lefts: list[int], agree: list[int], least: int):
    """Maximal pairs ``(place, distance, agreement)`` of one text that span runs.

    Places come in the order of their words; ``agree`` tells how far each agrees with the one before.
    """
    stack: list[tuple[int, _Node]] = []

    def close(down_to: int):
        while len(stack) > 1 and stack[-1][0] >= down_to:
            length, one = stack.pop()
            below, other = stack.pop()
            if len(one.places) > len(other.places):
                one, other = other, one
            for left, own in one.behind.items():
                for place in own:
                    for found in other.near(place, left, length):
                        distance = abs(place - found)
                        if distance + length >= least:
                            yield min(place, found), distance, length
            other.take(one)
            stack.append((below, other))

    shortest = (least + 1) // 2
    for place, left, length in zip(places, lefts, agree):
        yield from close(max(length, shortest))
        if length < shortest:
            stack.clear()
        stack.append((length, _Node(place, left)))
    yield from close(shortest)


def find_runs(texts: list[list[bytes]], least: int = LEAST) -> list[list[tuple[int, int, int]]]:
    """Runs of each text's words as ``(start, length, period)``, by start, then period."""
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not texts:
        return found
    numbers, starts = _numbers(texts)
    leaves = _leaves(numbers, starts, (least + 1) // 2)
    if not len(leaves):
        return found
    docs = np.unique(np.searchsorted(starts, leaves, "right") - 1)
    # only texts that have leaves are ranked; places move to the shorter sequence
    sizes = starts[docs + 1] - starts[docs]
    own = np.concatenate([[0], np.cumsum(sizes)])
    picked = np.concatenate([numbers[a:b] for a, b in zip(starts[docs].tolist(), starts[docs + 1].tolist())])
    doc = np.searchsorted(docs, np.searchsorted(starts, leaves, "right") - 1)
    places = leaves - starts[docs][doc] + own[doc]
    ranks = _ranks(picked)
    order = np.lexsort((ranks[-1][places], doc))
    places, doc = places[order], doc[order]
    agree = np.zeros(len(places), np.int64)
    same = np.flatnonzero(doc[1:] == doc[:-1]) + 1
    agree[same] = _agree(ranks, places[same - 1], places[same])
    at_start = places == own[doc]
    lefts = np.where(at_start, -1 - len(texts), picked[places - 1])
    edges = np.searchsorted(doc, np.arange(len(docs) + 1)).tolist()
    for d, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
        spans: dict[tuple[int, int], int] = {}
        for place, distance, length in _pairs((places[a:b] - own[d]).tolist(), lefts[a:b].tolist(), agree[a:b].tolist(), least):
            span = place, distance + length
            spans[span] = min(distance, spans.get(span, distance))
        found[docs[d]] = sorted(((start, length, period) for (start, length), period in spans.items()), key=lambda r: (r[0], r[2]))
    return found


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words outside of repetitions: a run keeps its first period."""
    if not runs:
        return b" ".join(words)
    steps = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        steps[start + period] += 1
        steps[start + length] -= 1
    return b" ".join(compress(words, (np.cumsum(steps[:-1]) == 0).tolist()))


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """Per row ``doc_id``, ``n_words``, its ``runs`` by start, then period, and ``collapsed``: the text without repetitions.

    Words are what ASCII white space separates.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches):
        for batch in chunks(batches, "text", _SLICE):
            texts = [(t or b"").split() for t in batch.column("text").cast(pa.binary()).to_pylist()]
            found = find_runs(texts, least)
            flat = np.array([r for own in found for r in own], np.int64).reshape(-1, 3)
            ends = np.concatenate([[0], np.cumsum([len(own) for own in found])]).astype(np.int32)
            items = pa.StructArray.from_arrays([pa.array(flat[:, j]) for j in range(3)], fields=list(kind.value_type))
            texts_left = pa.array([_collapsed(t, own) for t, own in zip(texts, found)], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.ListArray.from_arrays(ends, items, type=kind), texts_left],
                ["doc_id", "n_words", "runs", "collapsed"],
            )

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words long, runs {RUN_TYPE}, collapsed string")
