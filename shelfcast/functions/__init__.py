"""Column functions: every one is a plain built-in expression."""

from .dates import (
    next_day,
    iso_timestamp,
    is_weekend,
    iso_weekday,
    lead_time_days,
    order_hour,
    order_hour_from_text,
    parse_date,
)
from .labels import (
    purchase_shortage_flag,
    raw_shortage_flag,
    recommended_action,
    risk_level,
    shortage_label,
    verdict,
)
from .text import (
    joined_substitutes,
    number_text,
    order_option,
    option_order_number,
    option_product_code,
    percent_one,
    percent_two,
    request_email,
    request_number,
)

__all__ = [name for name in dir() if not name.startswith("_")]
