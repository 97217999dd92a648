"""Texts about orders, rendered per row with built-in expressions.

Sending them, and asking a language or speech service for better wording, is left
to the caller.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import NO_SUBSTITUTE
from ..functions.text import number_text, percent_two

COMPANY = "Example Foods"

# ---------------------------------------------------------------------------
# Message formats. %s marks the place of a value.
# ---------------------------------------------------------------------------

MOCK_SCRIPT = (
    "This is a mock call script for customer %s about product %s. We suggest substitutes: %s."
)
SUBSTITUTES_FOUND = "We have identified these potential substitutes for you: %s."
SUBSTITUTES_MISSING = "Unfortunately, we don't have an immediate substitute recommendation."
CALL_PROMPT = (
    "You are a friendly and proactive logistics assistant from %s. "
    "Your goal is to inform a customer about a potential shortage and offer a solution. "
    "Generate a short, professional, and friendly script for a phone call based on the following "
    "details. Keep it under 60 words. "
    "- Customer Number: %s - Product at Risk (Code): %s - Quantity Ordered: %s "
    "- Recommended Action: %s - Available Substitutes: %s. "
    "Start the call with 'Hi, this is a proactive notification from %s regarding your recent order.'"
)
REQUEST_PROMPT = (
    "Order details:\n- Order number: %s\n- Product code: %s\n- Customer number: %s\n"
    "- Order quantity: %s\n\n"
    "Dataset info:\n- Risk level: %s\n- Shortage probability (0–1): %s\n\n"
    "Task:\nWrite a short, friendly message that we can send to the customer explaining:\n"
    "- the current shortage risk and risk level,\n- that there may be a delay,\n"
    "- and what we recommend (e.g. accept delay, reduce quantity, choose alternative product, or "
    "contact support).\n\n"
    "Constraints:\n- 2–3 sentences.\n"
    "- Don't mention that you are an AI or that this comes from a dataset.\n"
)
REQUEST_ROLE = (
    "You are a supply-chain assistant for %s. You write clear, polite messages for business customers "
    "about stock shortage risks.\n"
)
MAIL_SUBJECT = "%s Order Stats: %s shortage risk for order %s"
MAIL_BODY = (
    "Dear customer,<br><br>\nHere is an update on your order:<br><br>\n"
    "<b>Order number:</b> %s<br>\n<b>Product code:</b> %s<br>\n<b>Quantity:</b> %s<br><br>\n\n"
    "<b>Shortage risk level:</b> %s<br>\n<b>Shortage probability:</b> %s<br><br>\n\n"
    "<b>Recommended action:</b><br>\n%s<br><br>\n\nBest regards,<br>\n%s Support<br>\n"
)
MAIL_CONTACT = "(%s)\n"
ERROR_TEXT = (
    "Invalid order details: we couldn’t find a matching combination of orderNumber, productCode, "
    "customerNumber and orderQty in the shortage dataset. Please double-check your inputs."
)
ERROR_SUBJECT = "Invalid shortage-check input received"
ERROR_BODY = (
    "A user submitted shortage-risk data, but no matching row was found.\n\n"
    "orderNumber: %s\nproductCode: %s\ncustomerNumber: %s\norderQty: %s\n\n"
    "Please review the dataset or the frontend validation.\n"
)
#: How a request field that is no number is written.
NO_NUMBER = "NaN"


def _text(name: str) -> Column:
    return F.col(name).cast("string")


def mock_call_script() -> Column:
    return F.format_string(MOCK_SCRIPT, _text("customer_number"), _text("product_code"), F.col("substitutes"))


def call_prompt(company: str = COMPANY) -> Column:
    found = F.format_string(SUBSTITUTES_FOUND, F.col("substitutes"))
    offer = F.when(F.col("substitutes") != NO_SUBSTITUTE, found).otherwise(SUBSTITUTES_MISSING)
    return F.format_string(
        CALL_PROMPT, F.lit(company), _text("customer_number"), _text("product_code"),
        _text("order_qty"), F.col("recommended_action"), offer, F.lit(company),
    )


def _numbers() -> list[Column]:
    names = ("order_number", "product_code", "customer_number", "order_qty")
    return [number_text(F.col(n)) for n in names]


def request_prompt() -> Column:
    return F.format_string(
        REQUEST_PROMPT, *_numbers(), F.col("risk_level"), _text("shortage_probability")
    )


def request_role(company: str = COMPANY) -> Column:
    """Standing instruction that goes with every request prompt."""
    return F.format_string(REQUEST_ROLE, F.lit(company))


def mail_subject(company: str = COMPANY) -> Column:
    return F.format_string(MAIL_SUBJECT, F.lit(company), F.col("risk_level"), _numbers()[0])


def mail_body(company: str = COMPANY, contact: str | None = None) -> Column:
    order, product, _, qty = _numbers()
    body = F.format_string(
        MAIL_BODY, order, product, qty, F.col("risk_level"),
        percent_two(F.col("shortage_probability")), F.col("recommended_action"), F.lit(company),
    )
    return body if contact is None else F.concat(body, F.format_string(MAIL_CONTACT, F.lit(contact)))


def error_body() -> Column:
    return F.format_string(ERROR_BODY, *[F.coalesce(n, F.lit(NO_NUMBER)) for n in _numbers()])
