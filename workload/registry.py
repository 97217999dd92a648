"""Registration of queries and their reference SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import CTES, with_ctes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, like: str | None = None):
    """Register a query; ``sql`` may use the tables of ``tables.CTES`` freely.

    ``like`` names an earlier query with the same reference SQL.
    """

    def register(run):
        QUERIES[name] = run
        if like is not None:
            ORACLES[name] = ORACLES[like]
        elif sql is not None:
            ORACLES[name] = with_ctes(sql, CTES)
        return run

    return register


def rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Doubles rounded for comparison; ``special`` gives other digits per column."""
    return df.select(
        *[
            F.round(f.name, special.get(f.name, digits)).alias(f.name)
            if isinstance(f.dataType, T.DoubleType)
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )
