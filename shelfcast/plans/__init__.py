"""End-to-end flows."""

from .scoring import predict, product_orders, product_status, run_dispatch, sample_orders
from .training import Prepared, best_model, compare, prepare, prepare_from_sales, train_models

__all__ = [name for name in dir() if not name.startswith("_")]
