"""Texts without spaces at their ends are not searched for any; the others are trimmed as before."""

from pyspark.sql import functions as F

from shelfcast.functions import payload as pl
from shelfcast.operators.requests import parse_requests


def test_trimmed_as_by_the_search(spark):
    spaces = [" ", "\t", "\n", "\r\n", "\x0b", " ", "﻿", " ", "　", " "]
    texts = ["", "5", "1.5", "a b", "x\ny", "ä", "a b", "-", "~", "!", "\x7f", None]
    texts += [s + t + e for s in ("", *spaces) for e in ("", *spaces) for t in ("", "7", "a\nb", "é")]
    searched = F.regexp_replace("t", f"^{pl.WHITE_SPACE}|{pl.WHITE_SPACE}$", "")
    both = spark.createDataFrame([(t,) for t in texts], "t string").select("t", pl.trimmed(F.col("t")).alias("a"), searched.alias("b"))
    assert [tuple(r) for r in both.where(~F.col("a").eqNullSafe(F.col("b"))).collect()] == []


def test_kinds_are_read_once_and_plain_texts_are_not_searched(spark):
    plan = parse_requests(spark.createDataFrame([('{"orderNumber":5}',)], "payload string"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("schemaofvariant(") == 4
    assert "[!-~]" in plan
