"""The 27 missing values as Column expressions; nothing here leaves the JVM.

A missing float or double is a power of two times 1 + k/4096 with k from 0 (`.`) to 26 (`.z`), so its k follows by exact arithmetic.
"""

from __future__ import annotations

import struct

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.layout import MISSING_KEY, NUMERIC, TAGS


def double_code(tag: str) -> float:
    """The double that stands for a tag."""
    return struct.unpack(">d", (NUMERIC["double"][3] + (TAGS.index(tag) << 40)).to_bytes(8, "big"))[0]


#: Doubles of `.`, `.a`, `.b` and `.z`; they are finite and rise in this order.
MISSING, MISSING_A, MISSING_B, MISSING_Z = (double_code(t) for t in (".", ".a", ".b", ".z"))


def tag_of_offset(k: Column) -> Column:
    """0 -> `.`, 1 -> `.a` ... 26 -> `.z`; null otherwise."""
    return F.when(k == 0, F.lit(".")).when((k >= 1) & (k <= 26), F.concat(F.lit("."), F.char((F.lit(96) + k).cast("int"))))


def missing_tag(value: Column | str, storage: str = "double") -> Column:
    """Tag of a raw numeric value of a storage type, null if it is no missing value."""
    value = F.col(value) if isinstance(value, str) else value
    if storage not in NUMERIC:
        return F.lit(None).cast("string")
    first = NUMERIC[storage][3]
    if storage in ("byte", "int", "long"):
        k = value.cast("long") - first
        # The codes of a storage type are its whole range above the first, so values beyond its range are none.
        return F.when(k.between(0, 26), tag_of_offset(k))
    top = 2.0**127 if storage == "float" else 2.0**1023
    x = value.cast("float").cast("double") if storage == "float" else value.cast("double")
    k = (x / F.lit(top) - 1) * 4096
    # Infinities and NaN are values; a fractional k is no code.
    return F.when((k >= 0) & (k <= 26) & (k == F.floor(k)), tag_of_offset(F.floor(k)))


def is_missing(value: Column | str, storage: str = "double") -> Column:
    return missing_tag(value, storage).isNotNull()


def float_bits_tag(raw: Column | str) -> Column:
    """Tag of the bits of a float, given as an unsigned number."""
    raw = (F.col(raw) if isinstance(raw, str) else raw).cast("long")
    gap = raw - NUMERIC["float"][3]
    step = NUMERIC["float"][4]
    return F.when((gap >= 0) & (gap % step == 0) & (gap <= 26 * step), tag_of_offset((gap / step).cast("long")))


def double_bits_tag(raw: Column | str, little_endian: bool = True) -> Column:
    """Tag of the eight bytes of a double, given as binary."""
    raw = F.col(raw) if isinstance(raw, str) else raw
    digits = F.hex(raw)
    if little_endian:
        digits = F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in range(7, -1, -1)])
    k = F.conv(F.substring(digits, 5, 2), 16, 10).cast("long")
    return F.when((F.octet_length(raw) == 8) & (F.substring(digits, 1, 4) == "7FE0") & (F.substring(digits, 7, 10) == "0" * 10), tag_of_offset(k))


def label_key(tag: Column | str) -> Column:
    """Key of a missing value in value-label tables, whatever the storage type."""
    tag = F.col(tag) if isinstance(tag, str) else tag
    return F.when(tag == ".", F.lit(MISSING_KEY)).when(tag.rlike("^\\.[a-z]$"), F.lit(MISSING_KEY - 96) + F.ascii(F.substring(tag, 2, 1))).cast("int")


def missing_cell(tag: str, kind: str = "double") -> Column:
    """A struct cell that holds a missing value."""
    if tag not in TAGS:
        raise ValueError(f"{tag} is no missing value")
    return F.struct(F.lit(None).cast(kind).alias("value"), F.lit(tag).alias("missing"))


def is_missing_cell(cell: Column | str) -> Column:
    cell = F.col(cell) if isinstance(cell, str) else cell
    return cell.getField("missing").isNotNull()
