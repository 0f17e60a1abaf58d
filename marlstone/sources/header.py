"""Bytes -> DatasetInfo.  Reads what it needs by offset: a file of any size costs its header alone."""

from __future__ import annotations

import struct

from pyspark.sql import types as T

from .layout import LAYOUTS, LEGACY, SECTIONS, UNSUPPORTED, DatasetInfo, DtaError, Variable, storage_type

PROBE = 65536


def clean(raw: bytes, encoding: str = "utf-8") -> str:
    """A fixed-width or counted text: up to the first NUL; malformed UTF-8 becomes U+FFFD and one leading BOM goes."""
    raw = raw.split(b"\0", 1)[0]
    if encoding == "cp1252":
        # The five bytes that the code page leaves open stand for the control characters of the same number.
        return "".join(b.to_bytes().decode("cp1252", "replace") if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(b) for b in raw) if raw and max(raw) > 127 else raw.decode("ascii")
    return raw.removeprefix(b"\xef\xbb\xbf").decode("utf-8", "replace")


class _Tagged:
    """Walks the head of a tagged file."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def tag(self, name: str) -> None:
        mark = f"<{name}>".encode()
        if self.data[self.at : self.at + len(mark)] != mark:
            raise DtaError(f"Missing <{name}> tag")
        self.at += len(mark)

    def take(self, n: int) -> bytes:
        out = self.data[self.at : self.at + n]
        if len(out) < n:
            raise DtaError("Corrupt .dta file: header truncated")
        self.at += n
        return out


def _uint(raw: bytes, order: str) -> int:
    return int.from_bytes(raw, "little" if order == "<" else "big")


def signature(head: bytes) -> int | None:
    for version in (117, 118, 119):
        if head.startswith(f"<stata_dta><header><release>{version}</release>".encode()):
            return version
    return None


def read_info(source, *, numeric_117: bool = False) -> DatasetInfo:
    """Metadata of a source: a legacy file by its first byte, else a tagged one by its signature."""
    if not source.size:
        raise DtaError("Not a valid .dta file: file is empty")
    head = source.read(0, min(PROBE, source.size))
    if head[0] in LEGACY:
        return read_legacy(source)
    if signature(head) is None:
        raise DtaError(UNSUPPORTED)
    return read_tagged(source, numeric_117=numeric_117)


def read_tagged(source, *, numeric_117: bool = False) -> DatasetInfo:
    head = source.read(0, min(PROBE, source.size))  # beyond any head: a dataset label has at most 65,535 bytes, see below
    version = signature(head)
    if version is None:
        raise DtaError("Not a valid .dta file: unrecognized format signature")
    lay = LAYOUTS[version]
    walk = _Tagged(head if len(head) == source.size else head + source.read(PROBE, min(2 * PROBE, source.size - PROBE)))
    walk.at = len(f"<stata_dta><header><release>{version}</release>")
    walk.tag("byteorder")
    mark = walk.take(3)
    if mark not in (b"LSF", b"MSF"):
        raise DtaError(f'Invalid byte order: "{mark.decode("utf-8", "replace")}"')
    order = "<" if mark == b"LSF" else ">"
    walk.tag("/byteorder")
    walk.tag("K")
    nvar = _uint(walk.take(lay.nvar), order)
    walk.tag("/K")
    walk.tag("N")
    nobs = _uint(walk.take(lay.nobs), order)
    walk.tag("/N")
    walk.tag("label")
    label = clean(walk.take(_uint(walk.take(lay.dataset_label), order)), lay.metadata_encoding)
    walk.tag("/label")
    walk.tag("timestamp")
    stamp = clean(walk.take(walk.take(1)[0]))
    walk.tag("/timestamp")
    walk.tag("/header")
    walk.tag("map")
    sections = dict(zip(SECTIONS, struct.unpack(f"{order}14Q", walk.take(112))))

    def section(name: str, width: int) -> bytes:
        mark, start = f"<{name}>".encode(), sections[name]
        need = nvar * width
        if not 0 <= start <= source.size:
            raise DtaError(f"Missing section tag at offset {start}")
        at = find(source, mark, start)
        if at < 0:
            raise DtaError("Missing <variable_types> tag" if name == "variable_types" else f"Missing section tag at offset {start}")
        body = source.read(at + len(mark), min(need, source.size - at - len(mark)))
        if len(body) < need:
            raise DtaError("Corrupt .dta file: variable_types section truncated" if name == "variable_types" else "Corrupt .dta file: section truncated")
        return body

    codes = struct.unpack(f"{order}{nvar}H", section("variable_types", 2))
    fields = [section(n, w) for n, w in (("varnames", lay.name), ("formats", lay.format), ("value_label_names", lay.label_name), ("variable_labels", lay.label))]
    variables = _variables(codes, fields, lay, numeric_117)
    return DatasetInfo(version, order, nobs, label, stamp, variables, sections, sections["data"] + len(b"<data>"), sections["stata_data_close"])


def _variables(codes, fields, lay, numeric_117: bool = False) -> tuple[Variable, ...]:
    out, offset = [], 0
    widths = (lay.name, lay.format, lay.label_name, lay.label)
    for i, code in enumerate(codes):
        name, fmt, table, label = (clean(f[i * w : (i + 1) * w], lay.metadata_encoding) for f, w in zip(fields, widths))
        kind, width = storage_type(code, lay.version, numeric_117)
        out.append(Variable(i, name, kind, width, offset, code, fmt, label, table))
        offset += width
    return tuple(out)


def legacy_prefix_size(nvar: int, version: int) -> int:
    """Bytes of a legacy file up to its expansion fields: what a reader must have for the schema."""
    lay = LAYOUTS[version]
    if version not in LEGACY:
        raise DtaError(f"Not a legacy .dta file: version byte {version}")
    return 109 + nvar * (1 + lay.name + lay.format + lay.label_name + lay.label) + 2 * (nvar + 1)


def legacy_metadata_size(nvar: int, version: int) -> int:
    """Bytes that hold the metadata of a legacy file with an allowance for its expansion fields (fixed value)."""
    return legacy_prefix_size(nvar, version) + 65536


def find(source, mark: bytes, start: int, step: int = 1 << 16) -> int:
    """Offset of the first mark at or after start, however far; -1 without one."""
    while start + len(mark) <= source.size:
        at = source.read(start, min(step + len(mark) - 1, source.size - start)).find(mark)
        if at >= 0:
            return start + at
        start += step
    return -1


def read_legacy(source) -> DatasetInfo:
    if source.size < 109:
        raise DtaError("Not a valid .dta file: too small for legacy header")
    head = source.read(0, 109)
    version = head[0]
    if version not in LEGACY:
        raise DtaError(f"Not a legacy .dta file: version byte {version}")
    if head[1] not in (1, 2):
        raise DtaError(f"Invalid byte order code: {head[1]}")
    order = ">" if head[1] == 1 else "<"
    lay = LAYOUTS[version]
    nvar, nobs = struct.unpack(f"{order}Hi", head[4:10])
    if nobs < 0:
        raise DtaError(f"Invalid observation count: {nobs}")
    label, stamp = clean(head[10:91], "cp1252"), clean(head[91:109], "cp1252")
    at = legacy_prefix_size(nvar, version)
    body = source.read(109, at - 109)
    codes, places, fields = body[:nvar], {"variable_types": 109}, []
    rest = nvar
    for name, width, count in (("varnames", lay.name, nvar), ("sortlist", 2, nvar + 1), ("formats", lay.format, nvar), ("value_label_names", lay.label_name, nvar), ("variable_labels", lay.label, nvar)):
        places[name] = 109 + rest
        if name != "sortlist":
            fields.append(body[rest : rest + width * count])
        rest += width * count
    variables = _variables(codes, fields, lay)
    places["characteristics"] = at
    while at + 5 <= source.size:  # expansion fields: a type byte, a length and as many bytes, until both are zero
        kind, size = struct.unpack(f"{order}Bi", source.read(at, 5))
        at += 5
        if kind == 0 and size == 0:
            break
        if size < 0:
            raise DtaError(f"Corrupt .dta file: expansion field of {size} bytes")
        at += size
    labels = at + nobs * sum(v.width for v in variables)
    sections = dict.fromkeys(SECTIONS, 0) | places | {"data": at, "strls": labels, "value_labels": labels, "stata_data_close": source.size, "end_of_file": source.size}
    return DatasetInfo(version, order, nobs, label, stamp, variables, sections, at, source.size)


def spark_schema(info: DatasetInfo, columns: list[int], *, missing: str = "null", strl: str = "text", row_index: bool = False, file: bool = False) -> T.StructType:
    """Field metadata carry label, display format, value-label table, storage type and position."""
    out = []
    for i in columns:
        v = info.variables[i]
        kind = v.spark_type
        if v.storage == "strL" and strl == "pointer":
            kind = T.StructType([T.StructField("v", T.LongType()), T.StructField("o", T.LongType())])
        if v.storage in ("str", "strL") or missing == "null":
            out.append(T.StructField(v.name, kind, True, v.metadata))
        elif missing == "tagged":
            out += [T.StructField(v.name, kind, True, v.metadata), T.StructField(f"{v.name}__missing", T.StringType(), True)]
        else:
            out.append(T.StructField(v.name, T.StructType([T.StructField("value", kind), T.StructField("missing", T.StringType())]), True, v.metadata))
    if row_index:
        out.append(T.StructField("_row_index", T.LongType(), False))
    if file:
        out.append(T.StructField("_file", T.StringType(), False))
    return T.StructType(out)
