"""The portable side: whole files, or parts of them, as bytes in memory or as rows of Spark's binaryFile source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .codec import Decoder, long_strings, long_text, pointers
from .datasource import Options
from .files import Bytes
from .header import legacy_prefix_size, read_info, read_legacy, read_tagged, spark_schema
from .labels import read_tables
from .layout import LEGACY, PLACEHOLDER, DatasetInfo, Variable

__all__ = ["binary_frame", "is_legacy_format", "legacy_prefix_size", "long_string_index", "parse_legacy_metadata", "parse_metadata", "read_rows", "read_rows_from_records", "resolve_pointer", "value_label_tables"]


def parse_metadata(data: bytes) -> DatasetInfo:
    """Metadata of a tagged file; legacy files are parse_legacy_metadata()'s."""
    return read_tagged(Bytes(data))


def parse_legacy_metadata(data: bytes, size: int | None = None) -> DatasetInfo:
    """Metadata of a legacy file from its head; size: of the whole file."""
    source = Bytes(data)
    info = read_legacy(source)
    if size is not None:
        info.sections["stata_data_close"] = info.sections["end_of_file"] = size
    return info


def is_legacy_format(version: int) -> bool:
    return version in LEGACY


def read_rows(data: bytes, info: DatasetInfo, start: int, count: int, col_start: int | None = None, col_end: int | None = None) -> list[tuple]:
    """Rows of a whole file's bytes; a cell is a value or a tag wrapped as ("missing", tag); long strings are the placeholder."""
    a, b = max(0, col_start or 0), info.nvar if col_end is None else min(info.nvar, col_end)
    count = min(count, info.nobs - start)
    if start < 0 or count <= 0 or a >= b:
        return []
    decoder = Decoder(Bytes(data), info, list(range(a, b)), missing="struct", strl="placeholder")
    out: list[tuple] = []
    for columns in decoder.batches(start, count, 65536):
        cells = []
        for v in info.variables[a:b]:
            values = columns[v.name].to_pylist()
            cells.append(values if v.storage in ("str", "strL") else [x["value"] if x["missing"] is None else ("missing", x["missing"]) for x in values])
        out += zip(*cells)
    return out


def read_rows_from_records(records: bytes, info: DatasetInfo, start: int, count: int, col_start: int | None = None, col_end: int | None = None) -> list[tuple]:
    """The same for bytes that hold records alone, the first of which is row `start`."""
    count = min(count, info.nobs - start)
    if start < 0 or count <= 0:
        return []
    from dataclasses import replace

    return read_rows(records, replace(info, data_offset=0, nobs=count), 0, count, col_start, col_end)


def long_string_index(data: bytes, info: DatasetInfo) -> dict[tuple[int, int], tuple[int, bytes]]:
    return {(v, o): (kind, content) for v, o, kind, content in long_strings(Bytes(data), info)}


def resolve_pointer(cell: bytes, info: DatasetInfo, index: dict) -> str | None:
    """Text of an eight-byte pointer: empty for (0, 0), None if it dangles."""
    import numpy as np

    v, o = (int(x[0]) for x in pointers(np.frombuffer(cell, np.uint8).reshape(1, 8), Variable(0, "", "strL", 8, 0, 32768, "", "", ""), info))
    if (v, o) == (0, 0):
        return ""
    return long_text(*index[v, o]) if (v, o) in index else None


def value_label_tables(data: bytes, info: DatasetInfo) -> dict[str, dict[int, str]]:
    return read_tables(Bytes(data), info)


def binary_frame(spark: SparkSession, path: str, **options) -> DataFrame:
    """Rows of the files of a path that only Spark's readers reach (one task per file, files of up to 2 GB).

    All files must share the columns of the first, whose head decides the schema."""
    o = Options({k: str(v) for k, v in options.items()})
    files = spark.read.format("binaryFile").load(path)
    head = files.select("content").first()
    info = read_info(Bytes(bytes(head["content"])), numeric_117=o.numeric_117)
    schema = spark_schema(info, o.chosen(info), missing=o.missing, strl=o.strl, row_index=o.row_index, file=o.file)
    return files.select("path", "content").mapInArrow(decode_contents({k: str(v) for k, v in options.items()}, schema.fieldNames()), schema)


def decode_contents(options: dict, names: list[str]):
    def run(batches):
        import pyarrow as pa

        o = Options(options)
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content")):
                source = Bytes(content.as_py())
                info = read_info(source, numeric_117=o.numeric_117)
                for columns in o.decoder(source, info).batches(0, info.nobs, o.chunk):
                    columns["_file"] = pa.array([path.as_py()] * len(columns["_row_index"]), pa.string())
                    yield pa.RecordBatch.from_arrays([columns[n] for n in names], names)

    return run
