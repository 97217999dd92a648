"""Text, JSON and number formatting expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import NO_SUBSTITUTE
from . import payload as pl


def percent_one(p: Column) -> Column:
    return F.format_string("%.1f%%", p * 100)


def percent_two(p: Column) -> Column:
    return F.format_string("%.2f%%", p * 100)


def joined_substitutes(substitutes: Column) -> Column:
    return F.when(F.size(substitutes) > 0, F.concat_ws(", ", substitutes)).otherwise(NO_SUBSTITUTE)


def order_option(order_number: Column, product_code: Column) -> Column:
    return F.concat(
        F.lit("Order: "), order_number.cast("string"), F.lit(" | Product: "), product_code.cast("string")
    )


def option_order_number(option: Column) -> Column:
    return F.regexp_extract(option, r"^Order: (\d+) \| ", 1).try_cast("bigint")


def option_product_code(option: Column) -> Column:
    return F.regexp_extract(option, r" \| Product: (.*)$", 1)


def request_number(payload: Column, name: str) -> Column:
    """Number of a request field of a JSON text: top level first, then under ``body``, then 0."""
    return pl.number(pl.number_field(F.try_parse_json(payload), name))


def request_email(payload: Column, name: str = "customerEmail") -> Column:
    """E-mail of a request: ``body`` first, then top level, then empty."""
    return pl.text(pl.text_field(F.try_parse_json(payload), name))


def number_text(x: Column) -> Column:
    """A number as text without a trailing ``.0``, so that it compares to a code."""
    return F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(x.cast("string"))
