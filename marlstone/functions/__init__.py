"""Column functions: missing values and display formats."""

from .formats import display, format_value
from .missing import MISSING, MISSING_A, MISSING_B, MISSING_Z, double_bits_tag, float_bits_tag, is_missing, is_missing_cell, label_key, missing_cell, missing_tag

__all__ = ["MISSING", "MISSING_A", "MISSING_B", "MISSING_Z", "display", "double_bits_tag", "float_bits_tag", "format_value", "is_missing", "is_missing_cell", "label_key", "missing_cell", "missing_tag"]
