"""Streaming jobs."""

from .order_check import append_to, read_checked, request_stream, run_order_checks, store_checked

__all__ = [name for name in dir() if not name.startswith("_")]
