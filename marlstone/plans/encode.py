"""Writes `.dta` files for queries and tests, which start from tables in other formats.  No part of the engine."""

from __future__ import annotations

import os
import struct
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..scratch import scratch_dir
from ..sources.files import _split
from ..sources.layout import LAYOUTS, NUMERIC, Layout

#: Bytes of rows that are encoded at a time; of records or long strings that wait in memory, more wait on disk.
PART_BYTES, SPOOL_BYTES = 4 << 20, 8 << 20


@dataclass
class Column:
    """values: numbers, raw codes of missing values included; or bits ("u4", "u8") if raw; or texts (bytes as they are)."""

    name: str
    storage: str  # byte, int, long, float, double, str<N>, strL
    values: object
    format: str = "%9.0g"
    label: str = ""
    value_label: str = ""
    raw: bool = False
    pointers: list | None = None  # (v, o) of strL cells, to override those made from texts


@dataclass
class Table:
    columns: list[Column]
    label: str = ""
    timestamp: str = "01 Jan 2024 00:00"
    tables: dict = field(default_factory=dict)
    gso: list | None = None  # (v, o, kind, content), to override those made from texts
    expansion: bytes = b""


_CODES = {"byte": 65530, "int": 65529, "long": 65528, "float": 65527, "double": 65526}
_OLD = {"byte": 251, "int": 252, "long": 253, "float": 254, "double": 255}


def _bytes(text) -> bytes:
    return text if isinstance(text, bytes) else text.encode()


def _pad(text, width: int) -> bytes:
    return _bytes(text)[: width - 1].ljust(width, b"\0")


def rows_of(columns: list[Column], lay: Layout, order: str, first: int = 0) -> tuple[bytes, list]:
    """The records of some rows, of which `first` others come before, and the long strings that their cells point to."""
    n = len(columns[0].values) if columns else 0
    big = "big" if order == ">" else "little"
    cells, gso = [], []
    for j, c in enumerate(columns):
        if c.storage == "strL":
            where = c.pointers
            if where is None:
                where = []
                for i, t in enumerate(c.values, first):
                    where.append((j + 1, i + 1) if t else (0, 0))
                    if t:
                        gso.append((j + 1, i + 1, 130, _bytes(t) + b"\0"))
            cells.append((np.frombuffer(b"".join(v.to_bytes(lay.pointer_v, big) + o.to_bytes(lay.pointer_o, big) for v, o in where), "V8"), "V8"))
        elif c.storage.startswith("str"):
            width = int(c.storage[3:])
            cells.append((np.array([_bytes(t)[:width] for t in c.values], f"S{width}"), f"S{width}"))
        else:
            kind = NUMERIC[c.storage][1]
            kind = kind if c.raw or kind[0] == "i" else "f" + kind[1]
            cells.append((np.asarray(c.values).astype(kind), order + kind))
    records = np.zeros(n, {"names": [f"c{j}" for j in range(len(cells))], "formats": [k for _, k in cells]})
    for j, (x, _) in enumerate(cells):
        records[f"c{j}"] = x
    return records.tobytes() if cells else b"", gso


def long_records(gso: list, lay: Layout, order: str) -> Iterator[bytes]:
    """The bytes of long strings, in order of their rows."""
    for v, o, kind, x in sorted(gso, key=lambda g: g[1]) if lay.tagged else []:
        yield b"GSO" + struct.pack(f"{order}I{'I' if lay.gso_o == 4 else 'Q'}BI", v, o, kind, len(x)) + x


def around(table: Table, n: int, data: int, long: int, version: int, order: str, *, old_codes: bool = False) -> tuple[bytes, bytes, bytes]:
    """What a file of n rows holds before its records, between them and its long strings, and after; data, long: their bytes."""
    lay = LAYOUTS[version]
    big = "big" if order == ">" else "little"
    codes = []
    for c in table.columns:
        if c.storage == "strL":
            codes.append(32768)
        elif c.storage.startswith("str"):
            codes.append(int(c.storage[3:]))
        else:
            codes.append((_OLD if not lay.tagged or old_codes else _CODES)[c.storage])
    labels = b""
    for name, entries in table.tables.items():
        texts, offsets = b"", []
        for t in entries.values():
            offsets.append(len(texts))
            texts += _bytes(t) + b"\0"
        body = struct.pack(f"{order}ii{2 * len(entries)}i", len(entries), len(texts), *offsets, *entries) + texts
        block = struct.pack(f"{order}i", len(body)) + _pad(name, lay.label_name) + b"\0\0\0" + body
        labels += b"<lbl>" + block + b"</lbl>" if lay.tagged else block
    names, formats = (b"".join(_pad(x, w) for x in xs) for xs, w in (([c.name for c in table.columns], lay.name), ([c.format for c in table.columns], lay.format)))
    tables, titles = (b"".join(_pad(x, w) for x in xs) for xs, w in (([c.value_label for c in table.columns], lay.label_name), ([c.label for c in table.columns], lay.label)))
    k = len(table.columns)
    if not lay.tagged:
        head = struct.pack(f"{order}BBBBHi", version, 1 if order == ">" else 2, 1, 0, k, n) + _pad(table.label, 81) + _pad(table.timestamp, 18)
        return head + bytes(codes) + names + b"\0\0" * (k + 1) + formats + tables + titles + table.expansion + b"\0" * 5, b"", labels
    head = f"<stata_dta><header><release>{version}</release><byteorder>{'MSF' if order == '>' else 'LSF'}</byteorder><K>".encode()
    head += k.to_bytes(lay.nvar, big) + b"</K><N>" + n.to_bytes(4 if version == 117 else 8, big) + b"</N><label>"
    title, stamp = _bytes(table.label), _bytes(table.timestamp)
    head += len(title).to_bytes(lay.dataset_label, big) + title + b"</label><timestamp>" + bytes([len(stamp)]) + stamp + b"</timestamp></header>"
    parts = [("variable_types", struct.pack(f"{order}{k}H", *codes)), ("varnames", names), ("sortlist", b"\0" * (4 if version == 119 else 2) * (k + 1)), ("formats", formats), ("value_label_names", tables), ("variable_labels", titles), ("characteristics", b"")]
    offsets, at, body = [0, len(head)], len(head) + len("<map></map>") + 112, b""
    for tag, x in parts:
        offsets.append(at)
        piece = f"<{tag}>".encode() + x + f"</{tag}>".encode()
        body += piece
        at += len(piece)
    for tag, size in (("data", data), ("strls", long), ("value_labels", len(labels))):
        offsets.append(at)
        at += size + len(f"<{tag}></{tag}>")
    offsets += [at, at + len("</stata_dta>")]
    head += b"<map>" + struct.pack(f"{order}14Q", *offsets) + b"</map>" + body + b"<data>"
    return head, b"</data><strls>", b"</strls><value_labels>" + labels + b"</value_labels></stata_dta>"


def build(table: Table, version: int = 118, order: str = "<", *, old_codes: bool = False) -> bytes:
    """The bytes of a file.  old_codes: version 117 with the numeric codes 251-255."""
    lay = LAYOUTS[version]
    data, gso = rows_of(table.columns, lay, order)
    long = b"".join(long_records(gso if table.gso is None else table.gso, lay, order))
    n = len(table.columns[0].values) if table.columns else 0
    head, middle, tail = around(table, n, len(data), len(long), version, order, old_codes=old_codes)
    return head + data + middle + long + tail


def write_file(path: str, batches: Iterable[pa.RecordBatch], table: Table, version: int, order: str, *, even_empty: bool = True) -> int:
    """Writes the rows of Arrow batches as one file, whatever its size, with a part of a batch in memory at a time: records and
    long strings wait in two temporary files until their sizes are known.  Returns the rows; of none a file only if even_empty."""
    lay, n, long_size = LAYOUTS[version], 0, 0
    with tempfile.SpooledTemporaryFile(SPOOL_BYTES) as data, tempfile.SpooledTemporaryFile(SPOOL_BYTES) as long:
        for batch in batches:
            step = max(1, batch.num_rows * PART_BYTES // max(1, batch.nbytes))
            for at in range(0, batch.num_rows, step):
                rows = pa.Table.from_batches([batch.slice(at, step)])
                columns = []
                for c in table.columns:
                    x = rows.column(c.name)
                    values = x.to_pylist() if c.storage.startswith("str") else x.to_numpy()
                    if c.storage in ("byte", "int", "long") and (values.min() < -(1 << 31) or values.max() >= 1 << 31):
                        raise ValueError(f"{c.name} is beyond 32 bits")
                    columns.append(replace(c, values=values))
                records, gso = rows_of(columns, lay, order, n)
                data.write(records)
                for x in long_records(gso, lay, order):
                    long_size += long.write(x)
                n += len(rows)
        if not n and not even_empty:
            return 0
        head, middle, tail = around(table, n, data.tell(), long_size, version, order)
        system, inner = _split(path)
        if system is None:
            os.makedirs(os.path.dirname(inner), exist_ok=True)
        else:
            system.create_dir(os.path.dirname(inner), recursive=True)
        with open(inner, "wb") if system is None else system.open_output_stream(inner) as f:
            for piece, rest in ((head, data), (middle, long)):
                f.write(piece)
                rest.seek(0)
                while x := rest.read(PART_BYTES):
                    f.write(x)
            f.write(tail)
    return n


def encode_frame(df: DataFrame, storages: dict[str, str], *, version: int = 118, order: str = "<", formats: dict | None = None, labels: dict | None = None, value_labels: dict | None = None, tables: dict | None = None, title: str = "") -> str:
    """Writes df as one `.dta` file per partition to a new folder of the shared scratch space; the folder's path.
    Each task encodes and writes its own rows; nothing passes through the driver."""
    folder = f"{scratch_dir(df.sparkSession)}/dta-{uuid.uuid4().hex}"
    formats, labels, value_labels, tables = formats or {}, labels or {}, value_labels or {}, tables or {}

    columns = [Column(name, s, [], formats.get(name, "%9s" if s.startswith("str") else "%9.0g"), labels.get(name, ""), value_labels.get(name, "")) for name, s in storages.items()]

    def write(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        path = f"{folder}/part-{part:05d}.dta"
        if write_file(path, batches, Table(columns, title, tables=tables), version, order, even_empty=not part) or not part:
            yield pa.RecordBatch.from_arrays([pa.array([path])], ["path"])

    df.select(*storages).mapInArrow(write, "path string").count()
    return folder
