"""Language identification by interpolated Kneser-Ney character models, one per language.

Training counts the character 5-grams of all training texts in Spark: tasks fold their
own texts first, then counts meet by (language, n-gram). Continuation counts of all lower
orders are aggregations of the full table of the order above, and discounts come from the
counts of counts of every order. All n-grams are kept. Only a caller who says how many
entries an order may have gets rarer ones pruned, by their order's smallest kept count; what
their discounted probability was goes to the back-off weight of their context, so a
context's probabilities still sum to one.

Executors pack a language's rows to a sorted array of n-gram hashes with probabilities, and
one of context hashes with back-off weights, per order. A language with more than
``SLICE_NGRAMS`` n-grams is packed in slices by the two symbols before the last one: an
n-gram, its context and its shorter forms down to order 3 share these, and orders 1 and 2
are in every slice. The driver only passes models on. Those that together exceed
``MOST_BYTES``, which is known from counts, are stored, and the texts are read in several
passes, each with some of the slices, whose sums meet by text.

A text gets the language of lowest cross-entropy per character. It is rejected if that
entropy is above what training texts of that language and length reach, by a margin.

Cases: a null text and one without letters is ``und`` with score 0 and rejected; rows
without a language do not train; repeated rows count as often as they come; without any
training row every text is ``und``; very long texts are read in slices; other columns,
whatever their names, are not looked at, or pass unchanged.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize
from .common import chunks, lean
from .shingles import mix

ORDER = 5
UNKNOWN = "und"
#: N-grams of a language that are packed at once, about; more are packed in slices.
SLICE_NGRAMS = 2_000_000
#: Models that a worker holds at once, about, and what an entry with its context takes at most.
MOST_BYTES, ENTRY_BYTES = 256_000_000, 24
#: Orders that every slice has.
_SHARED_ORDERS = 2
#: Texts are rejected above this quantile of training texts plus this many nats a character.
QUANTILE, MARGIN = 0.999, 1.0
_BITS = 12
_SPREAD = 2_654_435_761
_SLICE = 1_000_000
#: Symbols of a slice that a task looks at at once, and n-grams of a language that it holds before it folds them or hands them on.
_AT_ONCE, _HELD = 300_000, 400_000
U = np.uint64


@lru_cache(maxsize=1)
def _alphabet() -> np.ndarray:
    """Symbol of each code point: letters in lower case, all else 0; rarer alphabets share numbers."""
    table = np.zeros(0x110000, np.uint16)
    for point in range(0x33000):
        letter = chr(point)
        if letter.isalpha():
            lower = ord(letter.lower()[0])
            table[point] = lower if lower < 2048 else 2048 + lower % 2039
    return table


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The 5-gram that ends at each symbol of each text, as 60-bit codes, and where texts begin.

    Runs of other characters are one 0; before a text there are only zeros.
    """
    points = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "replace"), np.uint32)
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    symbols = _alphabet()[points]
    kept = symbols != 0
    kept[1:] |= symbols[:-1] != 0
    starts = np.concatenate([[0], np.cumsum(sizes)])
    counts = np.concatenate([[0], np.cumsum(kept)])[starts]
    symbols = symbols[kept].astype(U)
    since = np.arange(len(symbols)) - np.repeat(counts[:-1], np.diff(counts))
    code = symbols.copy()
    for back in range(1, ORDER):
        earlier = np.zeros(len(symbols), U)
        earlier[back:] = symbols[: max(0, len(symbols) - back)]
        code |= np.where(since >= back, earlier, U(0)) << U(_BITS * back)
    return code, counts


def _sliced(text: str) -> list[str]:
    """A very long text in slices that end between words where it has any."""
    if len(text) <= 2 * _SLICE:
        return [text]
    made, begin = [], 0
    while begin < len(text):
        end = min(len(text), begin + _SLICE)
        while end < len(text) and end - begin < 2 * _SLICE and text[end].isalpha():
            end += 1
        made.append(text[begin:end])
        begin = end
    return made


def _folded(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    codes = np.concatenate([c for c, _ in held])
    counts = np.concatenate([n for _, n in held])
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, np.int64)
    return codes[first], np.add.reduceat(counts, first) if len(codes) else counts


def _counted(batches):
    """A task's 5-gram counts per language; its tables are handed on when they grow large."""
    held: dict[str, list] = {}

    def rows(lang):
        codes, counts = _folded(held.pop(lang))
        for a in range(0, len(codes), 50_000):
            part = codes[a : a + 50_000].view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(part)), pa.array(part), pa.array(counts[a : a + 50_000])], ["lang", "code", "n"]
            )

    for batch in chunks(batches, "text", _AT_ONCE):
        texts = batch.column("text").to_numpy(zero_copy_only=False)
        langs = batch.column("lang").to_numpy(zero_copy_only=False)
        for lang in sorted(set(langs)):
            code, _ = _codes([s for t in texts[langs == lang] for s in _sliced(t)])
            unique, counts = np.unique(code, return_counts=True)
            held.setdefault(lang, []).append((unique, counts.astype(np.int64)))
            if sum(len(c) for c, _ in held[lang]) > _HELD:
                held[lang] = [_folded(held[lang])]
                if len(held[lang][0][0]) > _HELD // 2:
                    yield from rows(lang)
    for lang in list(held):
        yield from rows(lang)


@dataclass
class HashArray:
    """Sorted hashes with one row of values each, and where each leading part of a hash begins."""

    hashes: np.ndarray
    values: np.ndarray
    index: np.ndarray = field(default=None)
    shift: int = 0

    @staticmethod
    def of(codes: np.ndarray, values: np.ndarray) -> HashArray:
        hashes = mix(codes)
        order = np.argsort(hashes, kind="stable")
        bits = max(4, int(len(codes)).bit_length())
        hashes = hashes[order]
        edges = np.arange(1 << bits, dtype=U) << U(64 - bits)
        return HashArray(hashes, values[order], np.append(np.searchsorted(hashes, edges), len(hashes)), 64 - bits)

    def find(self, codes: np.ndarray) -> np.ndarray:
        """Places of codes, -1 for those that are not there."""
        found = np.full(len(codes), -1, np.int64)
        if not len(self.hashes):
            return found
        hashes = mix(codes)
        lead = (hashes >> U(self.shift)).astype(np.int64)
        at, end = self.index[lead], self.index[lead + 1]
        open_ = np.flatnonzero(at < end)
        at, end, wanted = at[open_], end[open_], hashes[open_]
        while len(open_):
            hit = self.hashes[at] == wanted
            found[open_[hit]] = at[hit]
            at = at + 1
            go = ~hit & (at < end)
            open_, at, end, wanted = open_[go], at[go], end[go], wanted[go]
        return found


def _mask(order: int) -> np.uint64:
    return U((1 << (_BITS * order)) - 1)


class KneserNey:
    """One language: per order, probabilities of kept n-grams and back-off weights of their contexts.

    ``levels`` has for each order from 1 the n-grams and their discounted shares of their contexts.
    """

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray]], symbols: int):
        self.uniform = 1.0 / max(2, symbols)
        self.seen: list[HashArray] = []
        self.backoff: list[HashArray] = []
        for order, (own, share) in enumerate(levels, 1):
            contexts, where = np.unique(own >> U(_BITS), return_inverse=True)
            weight = np.maximum(1 - np.bincount(where, share, minlength=len(contexts)), 0)
            lower = self.probabilities(own & _mask(order - 1), order - 1)
            self.backoff.append(HashArray.of(contexts, weight.astype(np.float32)))
            self.seen.append(HashArray.of(own, (share + weight[where] * lower).astype(np.float32)))

    def probabilities(self, codes: np.ndarray, order: int = ORDER) -> np.ndarray:
        if order == 0:
            return np.full(len(codes), self.uniform)
        seen, backoff = self.seen[order - 1], self.backoff[order - 1]
        at = seen.find(codes)
        result = np.empty(len(codes))
        hit = at >= 0
        result[hit] = seen.values[at[hit]]
        if not hit.all():
            rest = codes[~hit]
            ctx = backoff.find(rest >> U(_BITS))
            weight = np.ones(len(rest))
            weight[ctx >= 0] = backoff.values[ctx[ctx >= 0]]
            result[~hit] = weight * self.probabilities(rest & _mask(order - 1), order - 1)
        return result


def _slice_of(code, slices):
    """Slice of n-grams, by the two symbols before their last; for numpy arrays of codes."""
    return ((((code >> U(_BITS)) & _mask(2)) * U(_SPREAD)) >> U(16)) % U(slices)


def _slice_column(slices: int) -> Column:
    """As ``_slice_of``, for the column ``code``; n-grams of the first orders come in every slice."""
    pair = F.shiftright("code", _BITS).bitwiseAND(F.lit(int(_mask(2))))
    own = F.shiftright(pair * F.lit(_SPREAD), 16) % F.lit(slices)
    every = F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long"))
    return F.explode(F.when(F.col("order") <= _SHARED_ORDERS, every).otherwise(F.array(own)))


class SlicedModel:
    """One language in slices. N-grams of slices that are not there have probability 1, which adds nothing to a sum of logarithms."""

    def __init__(self, slices: int, parts: dict[int, KneserNey]):
        self.slices, self.parts = slices, parts

    def probabilities(self, codes: np.ndarray) -> np.ndarray:
        result = np.ones(len(codes))
        own = _slice_of(codes, self.slices)
        for at, part in self.parts.items():
            mine = np.flatnonzero(own == U(at))
            result[mine] = part.probabilities(codes[mine])
        return result


class LanguageModels:
    """The models of all languages, or what one pass takes of them."""

    def __init__(self, models: dict[str, KneserNey | SlicedModel]):
        self.languages = sorted(models)
        self.models = [models[x] for x in self.languages]

    def totals(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per text: summed log-probabilities by language, number of symbols, and whether it has letters."""
        codes, at = _codes(texts)
        n = np.diff(at)
        sums = np.zeros((len(texts), len(self.languages)))
        letters = np.zeros(len(texts), bool)
        some = n > 0
        if some.any():
            begins = at[:-1][some]
            distinct, where = np.unique(codes, return_inverse=True)
            for i, model in enumerate(self.models):
                sums[some, i] = np.add.reduceat(np.log(model.probabilities(distinct))[where], begins)
            letters[some] = np.logical_or.reduceat((codes & _mask(1)) != 0, begins)
        return sums, n, letters


@dataclass
class StoredModels:
    """Models too large to be held at once: a stored table of packed slices, and the passes that read them all."""

    table: DataFrame
    languages: list[str]
    slices: int
    passes: int

    def part(self, at: int) -> LanguageModels:
        rows = self.table.where(F.col("slice") % self.passes == at)
        return _gathered(rows, self.languages, self.slices)


def _gathered(packed: DataFrame, languages: list[str], slices: int) -> LanguageModels:
    parts: dict[str, dict[int, KneserNey]] = {lang: {} for lang in languages}
    for r in packed.toLocalIterator():
        parts[r["lang"]][r["slice"]] = pickle.loads(r["model"])
    return LanguageModels({lang: own[0] if slices == 1 else SlicedModel(slices, own) for lang, own in parts.items()})


def ngrams(texts: DataFrame) -> DataFrame:
    """Stored: ``lang``, ``order``, ``code`` and ``n``, the count of 5-grams and the continuation count of shorter ones."""
    rows = texts.where("text is not null and lang is not null").select("text", "lang")
    longest = rows.mapInArrow(lean(_counted), "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    longest = materialize(longest, "ngrams")
    all_, last = longest.select("lang", F.lit(ORDER).alias("order"), "code", "n"), longest
    for order in range(ORDER - 1, 0, -1):
        suffix = F.col("code").bitwiseAND(F.lit(int(_mask(order))))
        last = last.groupBy("lang", suffix.alias("code")).agg(F.count("*").alias("n"))
        all_ = all_.unionByName(last.select("lang", F.lit(order).alias("order"), "code", "n"))
    return materialize(all_, "levels")


def _limits(counts: DataFrame, most: int | None) -> tuple[list[tuple[str, int, int, float]], dict[str, tuple[int, int]]]:
    """Per language and order, the smallest count that is kept and the discount, from a histogram of counts.

    Also per language how many n-grams are kept, and how many of these are of the orders that every slice has.
    Counts below 1000 have a step each, larger ones eight for each doubling.
    """
    step = F.when(F.col("n") < 1000, F.col("n")).otherwise(F.lit(1000) + F.floor(F.log2("n") * 8)).cast("int")
    spread: dict[tuple[str, int], list] = {}
    for r in counts.groupBy("lang", "order", step.alias("step")).agg(F.count("*").alias("k"), F.min("n").alias("n")).collect():
        spread.setdefault((r["lang"], r["order"]), []).append((r["n"], r["k"]))
    made, kept = [], {}
    for (lang, order), own in spread.items():
        least, taken = 0, 0
        for n, k in sorted(own, reverse=True):
            # an order keeps at least its most frequent step; single symbols are all kept
            if most is not None and taken and taken + k > max(1, most) and order > 1:
                break
            least, taken = n, taken + k
        ones, twos = (sum(k for n, k in own if n == wanted) for wanted in (1, 2))
        made.append((lang, order, least, min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones else 0.1))
        total, shared = kept.get(lang, (0, 0))
        kept[lang] = (total + taken, shared + taken * (order <= _SHARED_ORDERS))
    return made, kept


def _packed(symbols: int):
    def run(table: pa.Table) -> pa.Table:
        order, code, share = (table.column(c).to_numpy() for c in ("order", "code", "share"))
        levels = [(code[order == o].astype(U), share[order == o]) for o in range(1, ORDER + 1)]
        model = pickle.dumps(KneserNey(levels, symbols))
        return pa.table({"lang": table.column("lang")[:1], "slice": table.column("slice")[:1], "model": pa.array([model], pa.binary())})

    return run


def train(texts: DataFrame, most: int | None = None) -> LanguageModels | StoredModels:
    """Models from all rows of ``text``, ``lang``; nulls are left out. ``most`` sets the entries of an order, by default all are kept."""
    counts = ngrams(texts)
    limits, kept = _limits(counts, most)
    if not limits:
        return LanguageModels({})
    symbols = counts.where("order = 1").select("code").distinct().count() + 1
    # one row per language and order
    known = F.broadcast(counts.sparkSession.createDataFrame(limits, "lang string, order int, least long, discount double"))
    context = Window.partitionBy("lang", "order", F.shiftright("code", _BITS))
    shares = counts.withColumn("total", F.sum("n").over(context)).join(known, ["lang", "order"]).where("n >= least")
    shares = shares.select("lang", "order", "code", (F.greatest(F.col("n") - F.col("discount"), F.lit(0.0)) / F.col("total")).alias("share"))
    slices = max(-(-total // SLICE_NGRAMS) for total, _ in kept.values())
    entries = sum(total + (slices - 1) * shared for total, shared in kept.values())
    passes = min(slices, -(-entries * ENTRY_BYTES // MOST_BYTES))
    sliced = shares.withColumn("slice", F.lit(0).cast("long") if slices == 1 else _slice_column(slices))
    packed = sliced.groupBy("lang", "slice").applyInArrow(_packed(symbols), "lang string, slice long, model binary")
    if passes == 1:
        return _gathered(packed, list(kept), slices)
    return StoredModels(materialize(packed, "models"), sorted(kept), slices, passes)


_FOUND = "lang_pred string, score double, cross_entropy double, n_symbols long"
_FOUND_NAMES = [c.split()[0] for c in _FOUND.split(", ")]


def _schema(df: DataFrame) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema.fields)


def _totals(batch: pa.RecordBatch, models: LanguageModels) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``LanguageModels.totals`` of the texts of a batch, whose very long ones are read in slices."""
    texts = [t or "" for t in batch.column("_text").to_numpy(zero_copy_only=False).tolist()]
    parts = [_sliced(t) for t in texts]
    sums, n, letters = models.totals([s for p in parts for s in p])
    begins = np.cumsum([0, *[len(p) for p in parts]])[:-1]
    return np.add.reduceat(sums, begins, axis=0), np.add.reduceat(n, begins), np.logical_or.reduceat(letters, begins)


def _decided(sums: np.ndarray, n: np.ndarray, letters: np.ndarray, languages: list[str]) -> list[pa.Array]:
    """The columns of ``_FOUND`` from summed log-probabilities by text and language."""
    rows, names = len(n), np.array([*languages, UNKNOWN], object)
    entropy = -sums / np.maximum(n, 1)[:, None]
    best = entropy.argmin(axis=1)
    apart = np.exp(-(entropy - entropy[np.arange(rows), best][:, None]) * np.minimum(n, 200)[:, None])
    score = np.where(letters, 1 / apart.sum(axis=1), 0.0)
    lowest = np.where(letters, entropy[np.arange(rows), best], np.nan)
    pred = np.where(letters, best, len(languages))
    return [pa.array(names[pred], pa.string()), pa.array(score), pa.array(lowest, from_pandas=True), pa.array(n, pa.int64())]


def predict(docs: DataFrame, models: LanguageModels | StoredModels, *keep: Column) -> DataFrame:
    """The kept columns with ``lang_pred``, ``score``, ``cross_entropy`` (nats a symbol) and ``n_symbols`` for each ``text``."""
    picked = docs.select(*keep, F.col("text").cast("string").alias("_text"))
    if isinstance(models, StoredModels):
        return _predict_in_passes(picked, models)
    shared = docs.sparkSession.sparkContext.broadcast(models)  # within MOST_BYTES, about

    def run(batches):
        own = shared.value
        for batch in chunks(batches, "_text", _AT_ONCE):
            rows = batch.num_rows
            if own.languages:
                made = _decided(*_totals(batch, own), own.languages)
            else:
                made = [pa.array([UNKNOWN] * rows, pa.string()), pa.array(np.zeros(rows)), pa.nulls(rows, pa.float64()), pa.array(np.zeros(rows, np.int64))]
            arrays = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*arrays, *made], [*batch.schema.names[:-1], *_FOUND_NAMES])

    return picked.mapInArrow(lean(run), _schema(picked.drop("_text")) + _FOUND)


def _sums_of_pass(shared):
    def run(batches):
        own = shared.value
        for batch in chunks(batches, "_text", _AT_ONCE):
            sums, n, letters = _totals(batch, own)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * len(own.languages), pa.int32()), pa.array(sums.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("_row"), lists, pa.array(n, pa.int64()), pa.array(letters)], ["_row", "sums", "n", "letters"])

    return run


def _predict_in_passes(picked: DataFrame, models: StoredModels) -> DataFrame:
    """``predict`` with the texts, stored and numbered, read once for each part of the models."""
    numbered = materialize(picked.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    context, passes = picked.sparkSession.sparkContext, None
    for at in range(models.passes):
        shared = context.broadcast(models.part(at))
        sums = numbered.select("_row", "_text").mapInArrow(lean(_sums_of_pass(shared)), "_row long, sums array<double>, n long, letters boolean")
        sums = materialize(sums, "sums").withColumn("pass", F.lit(at))
        shared.unpersist()
        passes = sums if passes is None else passes.unionByName(sums)
    # a row for each pass, added in their order
    parts = F.sort_array(F.collect_list(F.struct("pass", "sums")))
    zeros = F.array(*[F.lit(0.0)] * len(models.languages))
    total = F.aggregate("parts", zeros, lambda a, p: F.zip_with(a, p["sums"], lambda x, y: x + y))
    totals = passes.groupBy("_row").agg(parts.alias("parts"), F.first("n").alias("_n"), F.first("letters").alias("_letters"))
    totals = totals.select("_row", total.alias("_sums"), "_n", "_letters")
    kept = numbered.drop("_text")
    joined = kept.join(totals, "_row").select(*[F.col(f"`{c}`") for c in kept.columns if c != "_row"], "_sums", "_n", "_letters")
    languages = models.languages

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                sums = batch.column("_sums").flatten().to_numpy().reshape(-1, len(languages))
                made = _decided(sums, batch.column("_n").to_numpy(), batch.column("_letters").to_numpy(zero_copy_only=False), languages)
                arrays = [batch.column(i) for i in range(batch.num_columns - 3)]
                yield pa.RecordBatch.from_arrays([*arrays, *made], [*batch.schema.names[:-3], *_FOUND_NAMES])

    return joined.mapInArrow(lean(run), _schema(joined.drop("_sums", "_n", "_letters")) + _FOUND)


def _length_class() -> Column:
    return F.floor(F.log2(F.greatest("n_symbols", F.lit(1)))).cast("int")


def identified(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Stored: ``doc_id``, ``learn``, ``lang_pred``, ``score``, ``cross_entropy``, ``n_symbols`` and ``rejected`` of every row.

    Rows for which ``learn`` holds (over the given columns) train the models and set
    the limits of rejection, by language and power of two of the length.
    """
    rows = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"),
        F.col(f"`{lang_col}`").cast("string").alias("lang"), F.coalesce(learn, F.lit(False)).alias("learn"),
    )
    models = train(rows.where("learn"))
    marked = predict(rows, models, F.col("doc_id"), F.col("learn"), (F.col("lang").isNotNull() & F.col("learn")).alias("_own"), F.xxhash64("text").alias("version"))
    found = materialize(marked, "languages")
    limits = found.where("_own and cross_entropy is not null").groupBy("lang_pred", _length_class().alias("class")).agg(
        F.percentile_approx("cross_entropy", QUANTILE, 1000).alias("usual")
    )
    # at most 64 length classes for each language
    known = found.withColumn("class", _length_class()).join(F.broadcast(limits), ["lang_pred", "class"], "left")
    usual = F.coalesce("usual", F.lit(float("inf")))
    rejected = F.col("cross_entropy").isNull() | (F.col("cross_entropy") > usual + MARGIN)
    return known.select("doc_id", "version", "learn", "lang_pred", "score", "cross_entropy", "n_symbols", rejected.alias("rejected"))


def with_known_language(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` without the rejected texts."""
    found = identified(docs, learn, id_col, text_col, lang_col).where("rejected")
    gone = found.select(F.struct("doc_id", "version").alias("of")).distinct()
    # the row's own columns stay inside a struct, so no name of theirs can clash
    keyed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.struct(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(F.col(f"`{text_col}`").cast("string")).alias("version")).alias("of"),
    )
    return keyed.alias("a").join(gone.alias("b"), F.col("a.of").eqNullSafe(F.col("b.of")), "left_anti").select("row.*")
