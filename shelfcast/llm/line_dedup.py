"""Cross-site boilerplate lines, found by how many distinct sites hold them.

Every line gets a hash; a HyperLogLog sketch of its sites is kept per hash, and sketches
merge as rows are aggregated, so a line that a third of all documents hold costs one
sketch per task. Lines whose estimate is near the threshold are counted exactly over
distinct (line, site) pairs; no line of several sites is dropped on an estimate, and only
those far above the threshold are kept on one. A line that is on at
least ``min_sites`` sites is boilerplate: it stays in the first document that holds it
(the smallest id) and goes from all others, so no line is lost to the corpus.

Lines are compared without white space at their ends and with A-Z in lower case; lines
of fewer than ``min_words`` words are left alone, as they repeat by chance.

Cases: a null text stays null, an empty one empty; a null site counts as one site; a null
id is the first; repeated rows are treated alike; a document may lose all its lines and
then is an empty text; an empty table gives no rows; other columns pass unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import materialize
from .common import FIRST_KEY, WORD, hash128

MIN_SITES = 3
MIN_WORDS = 5
#: Registers of a sketch, as a power of two, and how many standard errors count as near.
LOG_REGISTERS = 10
NEAR = 4


def _normal(line: Column) -> Column:
    trimmed = F.regexp_replace(line, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    return F.translate(trimmed, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def line_sites(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """One row per line of ``min_words`` words or more: its document, place, hash and site; no text."""
    site = F.col(f"`{site_col}`").cast("string")
    lines = docs.select(
        F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(FIRST_KEY)).alias("doc"),
        F.xxhash64(F.col(f"`{text_col}`")).alias("version"),
        F.xxhash64(F.coalesce(F.concat(F.lit("s"), site), F.lit(""))).alias("site"),
        F.posexplode(F.split(F.col(f"`{text_col}`"), "\n")).alias("at", "line"),
    )
    enough = lines.where(F.regexp_count("line", F.lit(WORD)) >= min_words).withColumn("line", _normal(F.col("line")))
    one, two = hash128(F.col("line"))
    return enough.select("doc", "version", "site", "at", one.alias("h1"), two.alias("h2"))


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """``h1``, ``h2`` and ``first`` (smallest document) of the lines on at least ``min_sites`` sites."""
    error = 1.04 / 2 ** (LOG_REGISTERS / 2)
    high = min_sites * (1 + NEAR * error) + 1
    spread = lines.groupBy("h1", "h2").agg(
        F.hll_sketch_agg("site", LOG_REGISTERS).alias("sketch"), F.min("doc").alias("first"),
        (F.min("site") != F.max("site")).alias("several"),
    )
    # a line of one site is known exactly; what has several and no high estimate is counted
    some = spread if min_sites < 2 else spread.where("several")
    estimated = materialize(some.select("h1", "h2", "first", F.hll_sketch_estimate("sketch").alias("sites")), "spread")
    sure = estimated.where(F.col("sites") > high)
    near = estimated.where(F.col("sites") <= high)
    pairs = lines.join(near.select("h1", "h2"), ["h1", "h2"], "left_semi").groupBy("h1", "h2", "site").agg(F.min("doc").alias("first"))
    exact = pairs.groupBy("h1", "h2").agg(F.count("*").alias("sites"), F.min("first").alias("first")).where(F.col("sites") >= min_sites)
    return sure.select("h1", "h2", "first").unionByName(exact.select("h1", "h2", "first"))


def without_boilerplate(
    docs: DataFrame, min_sites: int = MIN_SITES, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text",
    site_col: str = "source", count_col: str = "lines_removed",
) -> DataFrame:
    """``docs`` with boilerplate lines cut from ``text_col``, and how many in ``count_col``, which replaces a column of that name."""
    lines = materialize(line_sites(docs, min_words, id_col, text_col, site_col), "lines")
    common = materialize(boilerplate(lines, min_sites), "boilerplate")
    gone = lines.join(common, ["h1", "h2"]).where(F.col("doc") > F.col("first"))
    # at most one number per line of a document, so bounded by the document itself
    cuts = gone.groupBy("doc", "version").agg(F.sort_array(F.collect_set("at")).alias("_cuts"))
    # the row's own columns stay inside a struct, so no name of theirs can clash
    text = F.col(f"`{text_col}`")
    keyed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(FIRST_KEY)).alias("doc"), F.xxhash64(text).alias("version"),
    )
    joined = keyed.join(cuts, ["doc", "version"], "left")
    # the text between two cuts is taken as it is: no line is compared with a list of cuts
    text = F.col("row")[text_col]
    split = F.split(text, "\n")
    begins = F.concat(F.array(F.lit(-1)), F.col("_cuts"))
    ends = F.concat(F.col("_cuts"), F.array(F.size(split)))
    kept = F.flatten(F.zip_with(begins, ends, lambda a, b: F.slice(split, a + 2, b - a - 1)))
    left = F.when(F.col("_cuts").isNull(), text).otherwise(F.array_join(kept, "\n"))
    return joined.select(
        *[(left if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns if c != count_col],
        F.when(F.col("_cuts").isNull(), 0).otherwise(F.size("_cuts")).alias(count_col),
    )
