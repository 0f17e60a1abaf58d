"""The `dta` data source: `spark.read.format("dta").options(...).load(path)`.

The driver reads headers only; each task seeks to its rows, decodes them with NumPy and hands Arrow batches to
the JVM.  Python sources aren't told which columns a query uses, so `columns` prunes by option.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .codec import Decoder
from .files import Source, expand
from .header import read_info, spark_schema
from .layout import DatasetInfo, DtaError

#: Rows of an Arrow batch if the option is absent or no positive integer (fixed value); bytes of a split.
CHUNK_ROWS = 65536
SPLIT_BYTES = 128 << 20


@dataclass
class Rows(InputPartition):
    path: str
    info: DatasetInfo
    start: int
    count: int
    base: int  # rows of the files before this one


def flag(options, name: str) -> bool:
    return str(options.get(name, "false")).lower() in ("true", "1", "yes")


def whole(value, default: int) -> int:
    """A positive integer option, or the default."""
    try:
        x = float(value)
    except (TypeError, ValueError):
        return default
    return int(x) if x > 0 and x == math.floor(x) and math.isfinite(x) else default


class Options:
    """Options of the source, checked; unknown values of closed choices are refused."""

    def __init__(self, options) -> None:
        self.columns = options.get("columns")
        self.start = max(0, int(options.get("start", 0)))
        self.count = int(options["count"]) if "count" in options else None
        self.negative = int(options.get("start", 0)) < 0
        self.chunk = whole(options.get("chunk_rows"), CHUNK_ROWS)
        self.split = whole(options.get("split_bytes"), SPLIT_BYTES)
        self.missing = options.get("missing", "null").lower()
        self.strl = options.get("strl", "text").lower()
        if str(options.get("resolve_strl", "true")).lower() == "false":
            self.strl = "placeholder"
        self.dangling = options.get("strl_dangling", "empty").lower()
        self.encoding = options.get("encoding", "utf-8").lower()
        self.numeric_117 = flag(options, "legacy_v117_codes")
        self.row_index, self.file = flag(options, "row_index"), flag(options, "file")
        for name, value, allowed in (("missing", self.missing, ("null", "tagged", "struct")), ("strl", self.strl, ("text", "placeholder", "pointer")), ("strl_dangling", self.dangling, ("empty", "null"))):
            if value not in allowed:
                raise ValueError(f"option {name} must be one of {', '.join(allowed)}")

    def chosen(self, info: DatasetInfo) -> list[int]:
        """Positions of the chosen columns: names, or zero-based numbers where no variable has that name."""
        if self.columns is None:
            return list(range(info.nvar))
        names = {v.name: v.position for v in info.variables}
        out = []
        for part in filter(None, (x.strip() for x in self.columns.split(","))):
            if part in names:
                out.append(names[part])
            else:
                out += column_indices([float(part) if part.lstrip("-").replace(".", "", 1).isdigit() else part], info)
        return list(dict.fromkeys(out))

    def decoder(self, source, info: DatasetInfo) -> Decoder:
        return Decoder(source, info, self.chosen(info), missing=self.missing, strl=self.strl, strl_dangling=self.dangling, encoding=self.encoding)


def column_indices(indices, info: DatasetInfo) -> list[int]:
    """Checked zero-based positions, each once, in the order of their first mention."""
    out = []
    for x in indices:
        if isinstance(x, str) or x != math.floor(x):
            raise ValueError(f"Column index {x} must be an integer")
        if not 0 <= x < info.nvar:
            raise ValueError(f"Column index {int(x)} is out of bounds for {info.nvar} columns")
        out.append(int(x))
    return list(dict.fromkeys(out))


def info_of(path: str, numeric_117: bool = False) -> DatasetInfo:
    with Source(path) as source:
        return read_info(source, numeric_117=numeric_117)


def kinds(info: DatasetInfo) -> list[tuple]:
    """What files of one dataset must share: names and Spark types, in order."""
    return [(v.name, v.spark_type) for v in info.variables]


class DtaDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "dta"

    def _path(self) -> str:
        if "path" not in self.options:
            raise ValueError("the dta source needs a path")
        return self.options["path"]

    def schema(self) -> T.StructType:
        o = Options(self.options)
        files = expand(self._path())
        if not files:
            raise FileNotFoundError(self._path())
        info = info_of(files[0], o.numeric_117)
        return spark_schema(info, o.chosen(info), missing=o.missing, strl=o.strl, row_index=o.row_index, file=o.file)

    def reader(self, schema: T.StructType) -> DtaReader:
        return DtaReader(self._path(), dict(self.options), schema)


class DtaReader(DataSourceReader):
    def __init__(self, path: str, options: dict, schema: T.StructType) -> None:
        self.path, self.options, self.names = path, {k.lower(): v for k, v in options.items()}, schema.fieldNames()

    def partitions(self) -> list[Rows]:
        """Splits of whole rows: of about split_bytes, inside the window [start, start + count) of all files' rows."""
        o, out, base, first = Options(self.options), [], 0, None
        end = None if o.count is None else o.start + max(0, o.count)
        for path in expand(self.path):
            info = info_of(path, o.numeric_117)
            first = first or info
            if kinds(info) != kinds(first):
                raise DtaError(f"{path} has other columns than the first file of {self.path}")
            low, high = max(0, o.start - base), info.nobs if end is None else min(info.nobs, end - base)
            step = max(1, o.split // max(1, info.record_width))
            if not o.negative:
                out += [Rows(path, info, a, min(step, high - a), base) for a in range(low, high, step)]
            base += info.nobs
        return out or [Rows("", None, 0, 0, 0)]

    def read(self, partition: Rows):
        import pyarrow as pa

        if not partition.count:
            return
        o = Options(self.options)
        with Source(partition.path) as source:
            for columns in o.decoder(source, partition.info).batches(partition.start, partition.count, o.chunk):
                n = len(columns["_row_index"])
                columns["_row_index"] = pa.array(columns["_row_index"].to_numpy() + partition.base)
                columns["_file"] = pa.array([partition.path] * n, pa.string()) if "_file" in self.names else None
                yield pa.RecordBatch.from_arrays([columns[n] for n in self.names], self.names)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(DtaDataSource)
