"""Value-label tables: bytes -> name -> {value: text}."""

from __future__ import annotations

import struct

import numpy as np

from .header import clean
from .layout import DatasetInfo, DtaError


def parse_payload(data: bytes, order: str, encoding: str = "utf-8") -> dict[int, str]:
    """n, text length, n offsets, n values and the texts; an offset outside the texts is passed over, and of
    entries with one value the last counts."""
    if len(data) < 8:
        raise DtaError("Corrupt value label table: truncated header")
    n, size = struct.unpack_from(f"{order}ii", data)
    if n < 0 or size < 0:
        raise DtaError(f"Corrupt value label table: negative count or text length (n={n}, txt_len={size})")
    if 8 + 8 * n + size > len(data):
        raise DtaError("Corrupt value label table: payload exceeds entry bounds")
    numbers = np.frombuffer(data, f"{order}i4", 2 * n, 8).tolist()
    texts = data[8 + 8 * n : 8 + 8 * n + size]
    return {value: clean(texts[at:], encoding) for at, value in zip(numbers[:n], numbers[n:]) if 0 <= at < size}


def read_tables(source, info: DatasetInfo, encoding: str = "utf-8") -> dict[str, dict[int, str]]:
    """All tables in file order; of tables with one name the last counts."""
    lay, order = info.layout, info.byteorder
    start, end = info.sections["value_labels"], min(info.labels_end, source.size)
    if end <= start:
        return {}
    data = source.read(start, end - start)
    opening, closing = (b"<lbl>", b"</lbl>") if lay.tagged else (b"", b"")
    at = len(b"<value_labels>") if lay.tagged else 0
    head = len(opening) + 4 + lay.label_name + 3
    out: dict[str, dict[int, str]] = {}
    while at + head <= len(data) and data.startswith(opening, at):
        (size,) = struct.unpack_from(f"{order}i", data, at + len(opening))
        if not lay.tagged and size <= 0:
            break
        name = clean(data[at + len(opening) + 4 : at + head - 3], lay.metadata_encoding)
        body = data[at + head :]
        if len(body) < 8:
            raise DtaError("Corrupt value label table: truncated header")
        n, length = struct.unpack_from(f"{order}ii", body)
        # Tagged tables are measured by what they hold, legacy ones by their length field.
        used = 8 + 8 * max(n, 0) + max(length, 0) if lay.tagged else size
        out[name] = parse_payload(body[:used] if not lay.tagged else body, order, encoding)
        at += head + used + len(closing)
    return out
