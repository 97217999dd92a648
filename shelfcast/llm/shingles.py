"""Word shingles and SuperMinHash signatures of many texts at a time, in numpy."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

U = np.uint64
_STEP = U(0x9E3779B97F4A7C15)
_BASE = U(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _numbers(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=U) * _STEP + U(seed))


_BYTES = _numbers(256, 1)
_PLACES = _numbers(64, 2) | U(1)


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = U(pow(int(_BASE), -1, 1 << 64))
    up, down = np.full(n, _BASE, U), np.full(n, inverse, U)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def normalized(text: str) -> bytes:
    """The words of a text, A-Z in lower case, with one space between."""
    return b" ".join(text.encode().lower().split())


def shingles(texts: list[bytes], words: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``words`` words of normalized texts, with repeats, and where each text's begin.

    A text of fewer words gives one for all its words, one without words none.
    """
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])
    size = len(data)
    up, down = _powers(1 << max(16, (size - 1).bit_length()))
    sums = np.concatenate([np.zeros(1, U), np.cumsum(_BYTES[data] * up[:size])])
    space = data == 32
    ends = np.flatnonzero(space & ~np.concatenate([[True], space[:-1]]))
    begins = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    word = mix((sums[ends] - sums[begins]) * down[begins])
    first = np.searchsorted(begins, starts)  # of each text, its first word
    counts = np.diff(first)
    doc = np.repeat(np.arange(len(texts)), counts)
    left = first[1:][doc] - np.arange(len(word))  # words from here to the text's end
    total = np.zeros(len(word), U)
    padded = np.concatenate([word, np.zeros(words, U)])
    for j in range(words):
        total += np.where(left > j, padded[j : j + len(word)] * _PLACES[j], U(0))
    whole = (counts < words)[doc] & (left == counts[doc])
    total += np.where(whole, left.astype(U) * _PLACES[words], U(0))
    valid = (left >= words) | whole
    kept = np.bincount(doc[valid], minlength=len(texts))
    return mix(total[valid]), np.concatenate([[0], np.cumsum(kept)])


def distinct(hashes: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """The sorted set of each text's shingles."""
    return [np.unique(hashes[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


def superminhash(hashes: np.ndarray, at: np.ndarray, size: int = 128) -> np.ndarray:
    """SuperMinHash signatures, one row of ``size`` numbers per text.

    Every element draws, from its own hash, a random order of the places and for each
    step a random fraction; a place keeps the smallest step + fraction over all
    elements. Elements are taken step by step together. A text whose places are all
    filled with smaller steps is done, which for most texts is after two or three.
    """
    texts = len(at) - 1
    counts = np.diff(at)
    best = np.full(texts * size, ~U(0))
    doc = np.repeat(np.arange(texts), counts)
    order = None
    fraction = U((1 << 40) - 1)
    shifts = np.arange(1, size + 1, dtype=U) * _STEP
    for step in range(size):
        draw = mix(hashes + shifts[step])
        place = step + (((draw >> U(40)) * U(size - step)) >> U(24)).astype(np.int64)
        value = (U(step) << U(40)) | (draw & fraction)
        if order is None:
            chosen = place
        else:
            rows = np.arange(len(doc))
            chosen = order[rows, place].astype(np.int64)
            order[rows, place] = order[:, step]
            order[:, step] = chosen
        np.minimum.at(best, doc * size + chosen, value)
        filled = best.reshape(texts, size).max(axis=1) < (U(step + 1) << U(40))
        open_ = ~filled[doc]
        if not open_.any():
            break
        if order is None:
            hashes, doc, place = hashes[open_], doc[open_], place[open_]
            order = np.tile(np.arange(size, dtype=np.int16), (len(doc), 1))
            rows = np.arange(len(doc))
            order[rows, place] = 0
            order[:, 0] = place
        elif open_.sum() < 0.7 * len(open_):
            hashes, doc, order = hashes[open_], doc[open_], order[open_]
    return best.reshape(texts, size)


def band_keys(signatures: np.ndarray, bands: int) -> np.ndarray:
    """One number per text and band, the same only if the band's rows and number are."""
    rows = signatures.shape[1] // bands
    cut = signatures.reshape(len(signatures), bands, rows)
    keys = (cut * _PLACES[:rows]).sum(axis=2, dtype=U) + np.arange(1, bands + 1, dtype=U) * _STEP
    return mix(keys).view(np.int64)
