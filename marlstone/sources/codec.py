"""Records -> Arrow arrays, a column at a time over all rows of a chunk."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .header import clean
from .layout import NUMERIC, PLACEHOLDER, TAGS, DatasetInfo, DtaError, Variable

_TAGS = pa.array(TAGS)


def missing_offsets(raw: np.ndarray, storage: str) -> np.ndarray:
    """0 for `.`, 1 for `.a` ... 26 for `.z`, -1 for a value; raw: integers, or the bits of a float or double.

    Bits above the first code that are no exact multiple of the step are values (NaN, infinities and all)."""
    _, kind, _, first, step = NUMERIC[storage]
    if kind[0] == "i":
        gap = raw.astype(np.int64) - first
        return np.where((gap >= 0) & (gap <= 26), gap, -1).astype(np.int8)
    gap = np.where(raw >= first, raw - raw.dtype.type(first), raw.dtype.type(1))
    hit = (raw >= first) & (gap % raw.dtype.type(step) == 0) & (gap <= raw.dtype.type(26 * step))
    return np.where(hit, (gap // raw.dtype.type(step)).astype(np.int64), -1).astype(np.int8)


def numeric(records: np.ndarray, v: Variable, order: str) -> tuple[pa.Array, pa.Array]:
    """(values, null where missing; tags, null where not)."""
    width, kind, _, _, _ = NUMERIC[v.storage]
    raw = np.ascontiguousarray(records[:, v.offset : v.offset + width]).view(order + kind).ravel()
    raw = raw.astype(raw.dtype.newbyteorder("="))
    offsets = missing_offsets(raw, v.storage)
    gone = offsets >= 0
    values = raw if kind[0] == "i" else raw.view("f" + kind[1])
    tags = pa.DictionaryArray.from_arrays(pa.array(np.maximum(offsets, 0), mask=~gone), _TAGS).cast(pa.string())
    return pa.array(values, mask=gone, from_pandas=False), tags


def fixed_strings(records: np.ndarray, v: Variable, encoding: str) -> pa.Array:
    cells = records[:, v.offset : v.offset + v.width]
    stop = cells == 0
    sizes = np.where(stop.any(axis=1), stop.argmax(axis=1), v.width)
    flat = np.ascontiguousarray(cells[np.arange(v.width) < sizes[:, None]])
    if not len(flat) or flat.max() < 128:
        ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        return pa.Array.from_buffers(pa.string(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(flat)])
    return pa.array([clean(c[:n].tobytes(), encoding) for c, n in zip(cells, sizes)], pa.string())


def pointers(records: np.ndarray, v: Variable, info: DatasetInfo) -> tuple[np.ndarray, np.ndarray]:
    """The two parts of the long-string pointers, as int64."""
    cells, lay = records[:, v.offset : v.offset + 8].astype(np.int64), info.layout

    def number(part: np.ndarray) -> np.ndarray:
        weights = [1 << 8 * i for i in range(part.shape[1])]
        return part @ np.array(weights if info.byteorder == "<" else weights[::-1], np.int64)

    return number(cells[:, : lay.pointer_v]), number(cells[:, lay.pointer_v :])


def long_strings(source, info: DatasetInfo, wanted: set | None = None, step: int = 1 << 22, *, contents: bool = True) -> Iterator[tuple[int, int, int, bytes]]:
    """(v, o, kind, content) of the long-string section in file order, read in steps; only wanted (v, o) if given.
    contents=False gives None in place of the content."""
    lay = info.layout
    if not info.long_string_columns:
        return
    at, end = info.sections["strls"] + len(b"<strls>"), min(info.sections["value_labels"], source.size)
    head = struct.Struct(f"{info.byteorder}3sI{'I' if lay.gso_o == 4 else 'Q'}BI")
    held, start = b"", at
    while at + head.size <= end:
        if at + head.size > start + len(held) or at < start:
            start, held = at, source.read(at, min(step, end - at))
        mark, v, o, kind, size = head.unpack_from(held, at - start)
        if mark != b"GSO":
            break
        if lay.gso_o == 8 and o >> 32:
            raise DtaError("strL observation number exceeds 32-bit range")
        at += head.size
        if at + size > end:
            raise DtaError(f"Unexpected EOF while reading {size} bytes at offset {at}")
        if wanted is None or (v, o) in wanted:
            a = at - start
            yield v, o, kind, None if not contents else held[a : a + size] if a + size <= len(held) else source.read(at, size)
        at += size


def replaced(source, info: DatasetInfo, at_once: int = 1 << 22) -> np.ndarray | None:
    """By number, whether a later long-string record of the same key replaces one.  None: no record is replaced, which keys that
    rise show without being kept.  Other keys are compared about `at_once` at a time, with a pass for each such part."""
    n, last, by_column, by_row = 0, (-1, -1), True, True
    for v, o, _, _ in long_strings(source, info, contents=False):
        by_column, by_row = by_column and last < (v, o), by_row and last[::-1] < (o, v)
        n, last = n + 1, (v, o)
    if by_column or by_row:
        return None
    out, parts = np.zeros(n, bool), n // at_once + 1
    for part in range(parts):
        of_part = ((i, v << 32 | o) for i, (v, o, _, _) in enumerate(long_strings(source, info, contents=False)) if (v + o) % parts == part)
        held = np.fromiter(of_part, [("n", "u8"), ("key", "u8")])
        order = np.argsort(held["key"], kind="stable")
        keys = held["key"][order]
        out[held["n"][order[:-1]][keys[:-1] == keys[1:]]] = True
    return out


def long_text(kind: int, content: bytes, encoding: str = "utf-8") -> str:
    """Kind 130 ends in a NUL that is no part of the text; any other is bytes, shown as text."""
    content = content[:-1] if kind == 130 else content
    if encoding == "utf-8":
        return content.removeprefix(b"\xef\xbb\xbf").decode("utf-8", "replace")
    return content.decode(encoding, "replace")


class Decoder:
    """Decodes row ranges of one source into record batches of the schema that spark_schema() gives."""

    def __init__(self, source, info: DatasetInfo, columns: list[int], *, missing: str = "null", strl: str = "text", strl_dangling: str = "", encoding: str = "utf-8") -> None:
        self.source, self.info, self.columns = source, info, columns
        self.missing, self.strl, self.dangling, self.encoding = missing, strl, strl_dangling, encoding
        self.texts: dict | None = None

    def _texts(self, asked: list) -> dict:
        """Texts of the pointers asked for.  The section is read once per range, and only what is wanted is kept."""
        wanted = set()
        for v, o in asked:
            wanted.update(zip(v.tolist(), o.tolist()))
        wanted.discard((0, 0))
        found = {}
        if wanted:
            for v, o, kind, content in long_strings(self.source, self.info, wanted):
                found[v, o] = long_text(kind, content, self.encoding)  # a later record of a key wins
        return found

    def batches(self, start: int, count: int, chunk: int) -> Iterator[dict]:
        """Chunks of rows as name -> array, in order."""
        info = self.info
        if not self.columns:
            return
        chosen = [info.variables[i] for i in self.columns]
        resolve = [v for v in chosen if v.storage == "strL"] if self.strl == "text" else []
        if resolve:  # one pass over the pointers of the range first
            asked = [pointers(r, v, info) for r in self._records(start, count, chunk) for v in resolve]
            self.texts = self._texts(asked)
        for at, records in zip(range(start, start + count, chunk), self._records(start, count, chunk)):
            out: dict = {}
            for v in chosen:
                if v.storage == "str":
                    out[v.name] = fixed_strings(records, v, self.encoding)
                elif v.storage == "strL":
                    out[v.name] = self._long(records, v)
                else:
                    values, tags = numeric(records, v, info.byteorder)
                    if self.missing == "struct":
                        out[v.name] = pa.StructArray.from_arrays([values, tags], ["value", "missing"])
                    else:
                        out[v.name] = values
                        if self.missing == "tagged":
                            out[f"{v.name}__missing"] = tags
            out["_row_index"] = pa.array(np.arange(at, at + len(records), dtype=np.int64))
            yield out

    def _records(self, start: int, count: int, chunk: int) -> Iterator[np.ndarray]:
        width = self.info.record_width
        for at in range(start, start + count, chunk):
            n = min(chunk, start + count - at)
            raw = self.source.read(self.info.data_offset + at * width, n * width)
            yield np.frombuffer(raw, np.uint8).reshape(n, width)

    def _long(self, records: np.ndarray, v: Variable) -> pa.Array:
        if self.strl == "placeholder":
            return pa.array([PLACEHOLDER] * len(records), pa.string())
        left, right = pointers(records, v, self.info)
        if self.strl == "pointer":
            return pa.StructArray.from_arrays([pa.array(left), pa.array(right)], ["v", "o"], mask=pa.array((left == 0) & (right == 0)))
        lost = None if self.dangling == "null" else ""
        return pa.array(["" if not a and not b else self.texts.get((a, b), lost) for a, b in zip(left.tolist(), right.tolist())], pa.string())
