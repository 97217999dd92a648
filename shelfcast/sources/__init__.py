"""Files, literal tables and request intake."""

from .files import (
    literal_table, one_order, product_stub, read_actions, read_csv, read_parquet,
    read_product_lines, read_products, read_purchases, read_replacements, read_requests,
    read_sales, read_sales_typed, write_actions, write_parquet, write_products,
)

__all__ = [name for name in dir() if not name.startswith("_")]
