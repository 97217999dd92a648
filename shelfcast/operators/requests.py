"""Order-check requests: parse, look up, route, and write messages.

The same functions take a batch or a streaming DataFrame of JSON payloads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import iso_timestamp
from ..functions import payload as pl
from ..functions.text import number_text
from ..storage import materialize
from . import messages as m
from .joins import attach, fits_broadcast

FOUND, NOT_FOUND = "found", "not_found"
# Columns of a request and the payload's fields for them.
NUMBER_FIELDS = {
    "order_number": "orderNumber", "product_code": "productCode", "customer_number": "customerNumber", "order_qty": "orderQty",
}
EMAIL_FIELD = "customerEmail"
REQUEST_COLUMNS = (*NUMBER_FIELDS, "customer_email")


def parse_requests(requests: DataFrame) -> DataFrame:
    """Numbers and e-mail of every payload, which is parsed once."""
    parsed = requests.select(F.try_parse_json("payload").alias("_json"))
    fields = parsed.select(
        *[pl.number_field(F.col("_json"), field).alias(name) for name, field in NUMBER_FIELDS.items()],
        pl.text_field(F.col("_json"), EMAIL_FIELD).alias("customer_email"),
    )
    # steps of their own, so that no kind or text is taken out of the payload, or trimmed, twice
    fields = fields.withColumns({f"_kind_{name}": F.schema_of_variant(F.col(name)) for name in NUMBER_FIELDS})
    texts = fields.select(*[pl.number_text_of(F.col(name), F.col(f"_kind_{name}")).alias(name) for name in NUMBER_FIELDS], pl.text(F.col("customer_email")).alias("customer_email"))
    numbers = F.struct(*[pl.number_of_plain(F.col(name)).alias(name) for name in NUMBER_FIELDS], "customer_email")
    # a generator of one row: filters on numbers stay above it, where they would else be
    # moved below the parsing with all of it written out in them, once for every mention
    return texts.select(F.inline(F.array(numbers)))


def look_up(parsed: DataFrame, actions: DataFrame, **bounds) -> DataFrame:
    """Requests with the action of their order line, if there is one.

    Codes are compared as text, numbers by value. ``actions`` is the static side
    when the requests are a stream; it is broadcast if it is measured to fit, also
    for a stream. Requests that no order line can match, because a number is
    unknown or the order is 0, get empty keys: they meet no row and no task.
    """
    # Order 0 is never found, whatever the list holds.
    possible = (F.col("order_number") != 0) & F.col("product_code").isNotNull() & F.col("customer_number").isNotNull() & F.col("order_qty").isNotNull()
    keyed = parsed.withColumns(
        {
            "_order": F.when(possible, F.col("order_number")),
            "_product": F.when(possible, number_text(F.col("product_code"))),
            "_customer": F.when(possible, number_text(F.col("customer_number"))),
            "_qty": F.when(possible, F.col("order_qty")),
        }
    )
    known = actions.select(
        F.col("order_number").cast("double").alias("_order"),
        F.col("product_code").cast("string").alias("_product"),
        F.col("customer_number").cast("string").alias("_customer"),
        F.col("order_qty").alias("_qty"),
        F.col("order_number").alias("_found"), "risk_level", "shortage_probability", "recommended_action",
    )
    keys = ["_order", "_product", "_customer", "_qty"]
    if parsed.isStreaming:
        # Keys of a stream cannot be counted beforehand, so a large list is joined by plain shuffles.
        joined = keyed.join(F.broadcast(known) if fits_broadcast(known, **bounds) else known, keys, "left")
    else:
        small = bounds.pop("small", None)
        if small is None:
            small = fits_broadcast(known, **{k: v for k, v in bounds.items() if k.startswith("max_broadcast_")})
        if not small:
            # a shuffled join reads the requests twice, for their hot keys first; they are parsed once
            keyed = materialize(keyed, "requests")
        joined = attach(keyed, known, keys, small=small, **bounds)
    return joined.withColumn("_order", F.col("_found")).drop("_product", "_customer", "_qty", "_found")


def route(looked_up: DataFrame) -> DataFrame:
    """Status by the matched order number: absent or 0 means not found."""
    found = F.coalesce(F.col("_order") != 0, F.lit(False))
    return looked_up.withColumn("status", F.when(found, FOUND).otherwise(NOT_FOUND)).drop("_order")


def found_messages(
    routed: DataFrame, company: str = m.COMPANY, contact: str | None = None
) -> DataFrame:
    return routed.where(F.col("status") == FOUND).withColumns(
        {
            "role": m.request_role(company),
            "prompt": m.request_prompt(),
            "mail_subject": m.mail_subject(company),
            "mail_body": m.mail_body(company, contact),
        }
    )


def error_rows(routed: DataFrame) -> DataFrame:
    """Answer and mail for requests without a matching order line."""
    return routed.where(F.col("status") == NOT_FOUND).select(
        *REQUEST_COLUMNS,
        F.lit("false").alias("success"),
        F.lit(m.ERROR_TEXT).alias("error"),
        F.lit(m.ERROR_SUBJECT).alias("mail_subject"),
        m.error_body().alias("mail_body"),
    )


def check_requests(requests: DataFrame, actions: DataFrame, **bounds) -> DataFrame:
    """Payloads to routed requests; ``bounds`` are those of the lookup join."""
    return route(look_up(parse_requests(requests), actions, **bounds))


def log_rows(routed: DataFrame) -> DataFrame:
    """Rows of the shortage log for the requests that were found."""
    return routed.where(F.col("status") == FOUND).select(
        "order_number", "product_code", "customer_number", "order_qty", "risk_level",
        "shortage_probability", "recommended_action",
        F.col("customer_email").alias("email"),
        iso_timestamp(F.current_timestamp()).alias("timestamp"),
    )
