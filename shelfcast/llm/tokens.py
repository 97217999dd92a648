"""Whole texts to token ids, with the tokenizers library inside Arrow batches.

A tokenizer that drops white space and never joins two words across it gives a word
the same ids wherever it stands. For such a file (``_SPLIT`` and ``_NORMAL`` below)
each worker keeps the ids of words it has met and asks the library for new ones only;
the tables are emptied when they are full. Every other file, and texts that hold
special-token strings, go to the library as a whole.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import chunks

# The steps before the model for which words stand alone.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NORMAL = ["NFC", "Replace", "Lowercase"]

KNOWN_WORDS = 400_000
KNOWN_PARTS = 600_000
KNOWN_CHARS = 32_000_000
CHUNK = 8_000_000

#: Up to here every character is its own normal form and its class is settled.
_LAST_LATIN = 0x24F
_BEYOND = re.compile(f"[^\x00-{chr(_LAST_LATIN)}]")


def _class(first: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(_LAST_LATIN + 1) if unicodedata.category(chr(c))[0] == first)


_PARTS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_class('L')}]+|[{_class('N')}]|[^\t-\r \x85\xa0{_class('L')}{_class('N')}]+")


def _byte_letters() -> list[str]:
    """The visible letter that stands for each byte: itself if printable, else the next from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in own else next(others)) for b in range(256)]


_LETTERS = _byte_letters()


class Encoder:
    """Serialises the ids of texts as little-endian numbers of ``kind``."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        steps = json.loads(self.tokenizer.to_str())
        normal = [n["type"] for n in (steps["normalizer"] or {}).get("normalizers", [])]
        split = [x.get("pattern", {}).get("Regex") for x in (steps["pre_tokenizer"] or {}).get("pretokenizers", [])]
        self.by_word = normal == _NORMAL and split[:1] == [_SPLIT]
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.chars = 0

    def _library(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch(texts, add_special_tokens=False) if texts else []
        return [np.array(e.ids, self.kind).tobytes() for e in found]

    def _part(self, part: str) -> bytes:
        plain = part if part.isascii() and part.isprintable() else "".join(_LETTERS[b] for b in part.encode())
        return np.array([t.id for t in self.tokenizer.model.tokenize(plain)], self.kind).tobytes()

    def _learn(self, new: list[str]) -> None:
        """Adds the ids of ``new`` words."""
        if len(self.words) > KNOWN_WORDS or self.chars > KNOWN_CHARS:
            self.words, self.chars = {}, 0
        if len(self.parts) > KNOWN_PARTS:
            self.parts = {}
        odd = []
        for word in new:
            lower = word.lower()
            if not lower.isascii() and _BEYOND.search(lower):
                odd.append(word)
                continue
            ids = b""
            for part in (lower,) if lower in self.parts else _PARTS.findall(lower):
                own = self.parts.get(part)
                if own is None:
                    own = self._part(part)
                    if len(part) < 64:
                        self.parts[part] = own
                ids += own
            self.words[word] = ids
        self.words.update(zip(odd, self._library(odd)))
        self.chars += sum(map(len, new))

    def _by_words(self, texts: pa.Array) -> list[bytes]:
        split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        ends = split.offsets.to_numpy()
        coded = split.flatten().dictionary_encode()
        listed = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        known = list(map(self.words.get, listed))
        if None in known:
            missing = [w for w, ids in zip(listed, known) if ids is None]
            self._learn(missing)
            get = self.words.get
            known = [get(w) if ids is None else ids for w, ids in zip(listed, known)]
        joined = pa.array(known, pa.large_binary()).take(coded.indices)
        if not len(joined):
            return [b""] * len(texts)
        at = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset :][ends - ends[0]].tolist()
        data = memoryview(joined.buffers()[2] or b"")
        return [bytes(data[a:b]) for a, b in zip(at, at[1:])]

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Serialised ids of each text; nulls are empty."""
        texts = texts.fill_null("")
        if not self.by_word:
            return self._library(texts.to_pylist())
        special = pc.match_substring(texts, "<|")
        if not pc.any(special).as_py():
            return self._by_words(texts)
        whole = iter(self._library(texts.filter(special).to_pylist()))
        words = iter(self._by_words(texts.filter(pc.invert(special))))
        return [next(whole if odd else words) for odd in special.to_pylist()]


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """The worker's encoder of that file; it lives as long as the worker."""
    return Encoder(path)


def id_width(path: str) -> int:
    return encoder(path).kind.itemsize


def encoded_texts(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Chunks of rows with the serialised ids of column ``text``, ``end_id`` at each end; null is empty."""
    own = encoder(path)
    end = np.array([end_id], own.kind).tobytes()
    for rows in chunks(batches, "text", CHUNK):
        yield rows, [ids + end for ids in own.encode(rows.column("text"))]


def token_ids(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_tokens`` and ``ids`` (serialised) of every row; nulls count as empty texts."""

    def run(batches):
        kind = encoder(tokenizer).kind
        for rows, ids in encoded_texts(batches, tokenizer, end_id):
            counts = [len(x) // kind.itemsize for x in ids]
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"]
            )

    picked = docs.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"cast(`{text_col}` as string) as text")
    return picked.mapInArrow(run, "doc_id long, n_tokens long, ids binary")
