"""Operators over `.dta` datasets."""

from .dataset import Dataset, add_label, open_dta, resolve_long_strings
from .sql import register_functions

__all__ = ["Dataset", "add_label", "open_dta", "register_functions", "resolve_long_strings"]
