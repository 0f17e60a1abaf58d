"""What differs between `.dta` format versions, as data.

The numbers, tags, codes and messages in this module are fixed values of the file format.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T


class DtaError(ValueError):
    """The bytes are no `.dta` file of a supported version, or a damaged one."""


@dataclass(frozen=True)
class Layout:
    """Widths in bytes of the fields of one version."""

    version: int
    tagged: bool
    name: int
    format: int
    label_name: int
    label: int
    type_code: int
    nvar: int
    nobs: int
    dataset_label: int  # width of its length field, or of the field itself if untagged
    pointer_v: int = 0
    pointer_o: int = 0
    gso_o: int = 0
    metadata_encoding: str = "utf-8"


LAYOUTS = {
    113: Layout(113, False, 33, 12, 33, 81, 1, 2, 4, 81, metadata_encoding="cp1252"),
    114: Layout(114, False, 33, 49, 33, 81, 1, 2, 4, 81, metadata_encoding="cp1252"),
    115: Layout(115, False, 33, 49, 33, 81, 1, 2, 4, 81, metadata_encoding="cp1252"),
    117: Layout(117, True, 33, 49, 33, 81, 2, 2, 4, 1, 4, 4, 4),
    118: Layout(118, True, 129, 57, 129, 321, 2, 2, 8, 2, 2, 6, 8),
    119: Layout(119, True, 129, 57, 129, 321, 2, 4, 8, 2, 3, 5, 8),
}
LEGACY = (113, 114, 115)
UNSUPPORTED = "Unsupported .dta format: only Stata 8+ files (formats 113-115 and 117-119) are supported"

#: Sections of a tagged file in the order of its map.
SECTIONS = ("stata_data", "map", "variable_types", "varnames", "sortlist", "formats", "value_label_names", "variable_labels", "characteristics", "data", "strls", "value_labels", "stata_data_close", "end_of_file")

#: name -> (width, raw NumPy kind, Spark type, first missing code, step between missing codes).
NUMERIC = {
    "byte": (1, "i1", T.ByteType(), 101, 1),
    "int": (2, "i2", T.ShortType(), 32741, 1),
    "long": (4, "i4", T.IntegerType(), 2147483621, 1),
    "float": (4, "u4", T.FloatType(), 0x7F000000, 0x800),
    "double": (8, "u8", T.DoubleType(), 0x7FE0000000000000, 1 << 40),
}
TAGS = [".", *(f".{chr(97 + i)}" for i in range(26))]
#: Value-label keys of the missing values are this plus 0 for `.`, 1 for `.a` and so on, whatever the storage type.
MISSING_KEY = 2147483621
PLACEHOLDER = "__strl__"


def storage_type(code: int, version: int, numeric_117: bool = False) -> tuple[str, int]:
    """Type code -> (name, width).  numeric_117: codes 251-255 of version 117 are numeric, not strings of that length."""
    ordered = ("byte", "int", "long", "float", "double")
    if version in LEGACY:
        if 251 <= code <= 255:
            kind = ordered[code - 251]
            return kind, NUMERIC[kind][0]
        if 1 <= code <= 244:
            return "str", code
        raise DtaError(f"Unknown legacy type code {code}")
    if 65526 <= code <= 65530:
        kind = ordered[65530 - code]
        return kind, NUMERIC[kind][0]
    if code == 32768:
        return "strL", 8
    if version == 117 and numeric_117 and 251 <= code <= 255:
        kind = ordered[code - 251]
        return kind, NUMERIC[kind][0]
    if 1 <= code <= 2045:
        return "str", code
    raise DtaError(f"Unknown type code {code} for format v{version}")


@dataclass(frozen=True)
class Variable:
    position: int
    name: str
    storage: str
    width: int
    offset: int
    type_code: int
    format: str
    label: str
    value_label: str

    @property
    def spark_type(self) -> T.DataType:
        return NUMERIC[self.storage][2] if self.storage in NUMERIC else T.StringType()

    @property
    def metadata(self) -> dict:
        return {"label": self.label, "format": self.format, "value_label": self.value_label, "storage_type": self.storage + (str(self.width) if self.storage == "str" else ""), "position": self.position}


@dataclass(frozen=True)
class DatasetInfo:
    version: int
    byteorder: str  # "<" or ">"
    nobs: int
    label: str
    timestamp: str
    variables: tuple[Variable, ...]
    sections: dict = field(hash=False)
    data_offset: int = 0  # of the first record
    labels_end: int = 0

    @property
    def nvar(self) -> int:
        return len(self.variables)

    @property
    def layout(self) -> Layout:
        return LAYOUTS[self.version]

    @property
    def record_width(self) -> int:
        return sum(v.width for v in self.variables)

    @property
    def long_string_columns(self) -> list[int]:
        return [v.position for v in self.variables if v.storage == "strL"]
