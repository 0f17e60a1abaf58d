"""The `.dta` format: layouts, header, records, long strings, value labels, and the Spark data source."""

from .datasource import DtaDataSource, register
from .layout import DatasetInfo, DtaError, Variable

__all__ = ["DatasetInfo", "DtaDataSource", "DtaError", "Variable", "register"]
