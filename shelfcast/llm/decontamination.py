"""Benchmark passages in documents, by a prefix-filtered join of word shingles.

Every benchmark item gives windows of ``window`` consecutive words, an item of fewer
words one window of all. A window lies in a document only if all of its shingles do, so
one shingle is a sufficient prefix. Shingles are ordered by rarity: how often each occurs
is counted over all documents, and only the rarest of a window is joined. A window with a
shingle that occurs nowhere is left out at once. A match proposes a place; it must leave
room for the window before and after it (positional and length bounds), and the words
there must equal the window's, one by one. Hashes therefore only propose, never decide.

The shingles and windows of the benchmark are broadcast while they are counted to be
small; beyond that, shingles are counted and joined by shuffles, and only proposed places
meet the texts again. Occurrences merge per document, so a hot passage costs rows in
proportion to where it occurs. Documents that hold the same windows share one list of
items.

Cases: a null or empty text has no words and no hits; an item without words or text has
no windows; one without an id marks words but is not listed; repeated rows are treated
alike, items of one id and text count once; ids may be null or shared by several texts;
an empty benchmark hits nothing, an empty table gives no rows; other columns are not
looked at.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..storage import materialize
from .common import hash128

#: Fixed value: what a word is, once A-Z are in lower case. Java matches a positive class three times as fast as
#: the same one negated.
ALNUM = r"[0-9a-z\x{80}-\x{10FFFF}]+"
WINDOW, SHINGLE = 10, 3
#: Most rows of shingle numbers, and most bytes of windows, that are broadcast.
MOST_SHINGLES, MOST_WINDOW_BYTES = 1_000_000, 32_000_000
_DOC = "doc_id", "v1", "v2"


def _lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def _words(text: Column) -> Column:
    return F.regexp_extract_all(_lower(text), F.lit(ALNUM), F.lit(0))


def windows_of(items: DataFrame, window: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Stored: distinct windows (``h1``, ``h2``, ``own`` words, ``length``) and which items hold them (``h1``, ``h2``, ``item``)."""
    words = items.select(F.col(f"`{id_col}`").cast("string").alias("item"), _words(F.col(f"`{text_col}`")).alias("words")).where(F.size("words") > 0)
    length = F.least(F.size("words"), F.lit(window))
    places = words.select("item", "words", length.alias("length"), F.explode(F.sequence(F.lit(0), F.size("words") - length)).alias("at"))
    cut = places.select("item", F.slice("words", F.col("at") + 1, F.col("length")).alias("own"))
    one, two = hash128(F.col("own"))
    cut = materialize(cut.select("item", "own", one.alias("h1"), two.alias("h2")), "item-windows")
    distinct = cut.groupBy("h1", "h2").agg(F.first("own").alias("own")).withColumn("length", F.size("own"))
    return materialize(distinct, "windows"), materialize(cut.where("item is not null").select("h1", "h2", "item").distinct(), "window-items")


def _shingle(words: str, at: Column, size: int) -> Column:
    return F.xxhash64(*[F.get(words, at + j) for j in range(size)])


def _doc_shingles(docs: DataFrame, size: int, *keep: str) -> DataFrame:
    """A row for every place of ``size`` words: the kept columns, ``at`` and the ``shingle`` there."""
    some = docs.where(F.size("words") >= size)
    places = some.select(*keep, "words", F.explode(F.sequence(F.lit(0), F.size("words") - size)).alias("at"))
    return places.withColumn("shingle", _shingle("words", F.col("at"), size))


def _rarest(docs: DataFrame, windows: DataFrame, size: int, most_shingles: int) -> DataFrame:
    """Per window its rarest shingle and that one's place (``offset``); windows with an absent shingle are left out."""
    own = windows.select("h1", "h2", "own", "length", F.explode(F.sequence(F.lit(0), F.col("length") - size)).alias("offset"))
    own = materialize(own.select("h1", "h2", "length", "offset", _shingle("own", F.col("offset"), size).alias("shingle")), "shingles")
    known = own.select("shingle").distinct()
    occurring = _doc_shingles(docs, size).select("shingle")
    if known.count() <= most_shingles:
        counts = occurring.join(F.broadcast(known), "shingle", "left_semi").groupBy("shingle").agg(F.count("*").alias("n"))
    else:
        counts = occurring.groupBy("shingle").agg(F.count("*").alias("n")).join(known, "shingle", "left_semi")
    placed = own.join(materialize(counts, "counts"), "shingle", "left")
    # a window has at most ``window`` shingles; an absent one (0) comes first
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "shingle", "offset", "length")).alias("r")
    return placed.groupBy("h1", "h2").agg(rarest).where("r.n > 0").select("h1", "h2", "r.shingle", "r.offset", "r.length")


def occurrences(
    docs: DataFrame, windows: DataFrame, shingle: int = SHINGLE, most_shingles: int = MOST_SHINGLES, most_bytes: int = MOST_WINDOW_BYTES
) -> DataFrame:
    """Where windows occur in ``docs`` (``doc_id``, ``v1``, ``v2``, ``words``): those keys, ``start``, ``length`` and the window's ``h1``, ``h2``."""
    found = None
    # windows of fewer words than a shingle are their own shingle: at most ``shingle`` sizes
    for (size,) in sorted(map(tuple, windows.select(F.least("length", F.lit(shingle))).distinct().collect())):
        of_size = windows.where(F.least("length", F.lit(shingle)) == size)
        prefixes = materialize(_rarest(docs, of_size, size, most_shingles), "prefixes")
        words = of_size.select("h1", "h2", "own")
        named = prefixes.join(words, ["h1", "h2"])
        bytes_, rows = named.agg(F.coalesce(F.sum(F.length(F.array_join("own", " "))), F.lit(0)), F.count("*")).first()
        start = F.col("at") - F.col("offset")
        room = (start >= 0) & (start + F.col("length") <= F.size("words"))
        equal = F.slice("words", F.greatest(start, F.lit(0)) + 1, F.col("length")) == F.col("own")
        spans = *_DOC, start.alias("start"), "length", "h1", "h2"
        if rows <= most_shingles and 4 * bytes_ <= most_bytes:
            own = F.broadcast(named.withColumnRenamed("shingle", "prefix"))
            places = _doc_shingles(docs, size, *_DOC)
            hits = places.join(own, (F.col("shingle") == F.col("prefix")) & room & equal).select(*spans)
        else:
            places = _doc_shingles(docs, size, *_DOC).select(*_DOC, "at", "shingle", F.size("words").alias("n"))
            fits = (start >= 0) & (start + F.col("length") <= F.col("n"))
            proposed = places.join(prefixes, "shingle").where(fits).select(*spans).distinct()
            proposed = proposed.join(words, ["h1", "h2"])
            own = proposed.select(*[F.col(c).alias(f"_{c}") for c in _DOC], *proposed.columns[:2], "start", "length", "own")
            same = F.lit(True)
            for c in _DOC:
                same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
            equal = F.slice("words", F.col("start") + 1, F.col("length")) == F.col("own")
            hits = docs.join(own, same).where(equal).select(*_DOC, "start", "length", "h1", "h2")
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        found = docs.select(*_DOC, F.lit(0).alias("start"), F.lit(0).alias("length"), "v1", "v2").toDF(*_DOC, "start", "length", "h1", "h2").where("false")
    return materialize(found.distinct(), "occurrences")


def contamination(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", most_shingles: int = MOST_SHINGLES, most_bytes: int = MOST_WINDOW_BYTES,
) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_words``, ``n_hit`` (words inside occurring windows), ``spans`` and sorted ``items``.

    ``spans`` are the stretches of hit words, as ``start`` and ``length`` in words.
    """
    text = F.col(f"`{text_col}`").cast("string")
    one, two = hash128(text)
    keyed = docs.select(F.col(f"`{id_col}`").alias("doc_id"), one.alias("v1"), two.alias("v2"), text.alias("text"))
    windows, holders = windows_of(items, window, item_col, item_text_col)
    worded = keyed.select(*_DOC, _words(F.col("text")).alias("words"))
    spans = occurrences(worded, windows, shingle, most_shingles, most_bytes)

    # stretches: a span starts a new one if it begins behind all spans before it
    order = Window.partitionBy(*_DOC).orderBy("start", "length", "h1", "h2")
    end = F.col("start") + F.col("length")
    before = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("new", F.coalesce(F.col("start") > before, F.lit(True)).cast("int")).withColumn("stretch", F.sum("new").over(order))
    stretches = marked.groupBy(*_DOC, "stretch").agg(F.min("start").alias("start"), F.max(end).alias("end"))
    # both lists are bounded by the document's own words
    merged = stretches.groupBy(*_DOC).agg(
        F.sum(F.col("end") - F.col("start")).cast("long").alias("n_hit"),
        F.sort_array(F.collect_list(F.struct("start", (F.col("end") - F.col("start")).alias("length")))).alias("spans"),
    )
    held = spans.groupBy(*_DOC).agg(F.sort_array(F.collect_set(F.struct("h1", "h2"))).alias("held"))
    s1, s2 = hash128(F.col("held"))
    held = materialize(held.select(*_DOC, "held", s1.alias("s1"), s2.alias("s2")), "held")
    sets = held.groupBy("s1", "s2").agg(F.first("held").alias("held")).select("s1", "s2", F.explode("held").alias("w"))
    listed = sets.select("s1", "s2", F.col("w.h1").alias("h1"), F.col("w.h2").alias("h2")).join(holders, ["h1", "h2"])
    listed = listed.groupBy("s1", "s2").agg(F.sort_array(F.collect_set("item")).alias("items"))
    found = merged.alias("m").join(held.select(*_DOC, "s1", "s2").alias("h"), _same("m", "h")).select("m.*", "h.s1", "h.s2").join(listed, ["s1", "s2"], "left")

    counted = keyed.select(*_DOC, F.coalesce(F.regexp_count(_lower(F.col("text")), F.lit(ALNUM)), F.lit(0)).cast("long").alias("n_words"))
    joined = counted.alias("c").join(found.alias("f"), _same("c", "f"), "left")
    return joined.select(
        "c.doc_id", "c.n_words", F.coalesce("f.n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("f.spans", F.array().cast("array<struct<start: int, length: int>>")).alias("spans"),
        F.coalesce("f.items", F.array().cast("array<string>")).alias("items"),
    )


def _same(a: str, b: str) -> Column:
    same = F.lit(True)
    for c in _DOC:
        same &= F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return same
