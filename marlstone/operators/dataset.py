"""The facade over one dataset: metadata frames, row windows, column choices, labels, display texts.

    ds = open_dta(spark, "survey.dta")
    ds.rows(0, 100)                    # a window of rows
    ds.columns([3, 0])                 # a choice of columns
    ds.with_labels(ds.frame(), ["region"])
    ds.displayed(["price"])            # as the file's display formats say

Everything it returns is a DataFrame; filters, joins, aggregates and SQL on it are Spark's own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.formats import display
from ..functions.missing import label_key
from ..sources.codec import long_strings, long_text, replaced
from ..sources.datasource import column_indices, register
from ..sources.files import Source, expand
from ..sources.header import read_info
from ..sources.labels import read_tables
from ..sources.layout import DatasetInfo

#: A label table of up to so many entries becomes a literal map in the plan; a larger one is joined.
MAP_ENTRIES = 2000

VARIABLES = "position int, name string, storage_type string, width int, offset long, type_code int, format string, label string, value_label string"
INFO = "version int, byteorder string, nvar int, nobs long, label string, timestamp string, record_width long, data_offset long"
LABELS = "table string, value int, label string"
LONG = "v long, o long, kind int, text string, content binary"


def open_dta(spark: SparkSession, path: str, **options) -> Dataset:
    """Reads headers and value labels on the driver; options are those of the source."""
    register(spark)
    return Dataset(spark, path, options)


class Dataset:
    def __init__(self, spark: SparkSession, path: str, options: dict) -> None:
        self.spark, self.path, self.options = spark, path, {k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in options.items()}
        self.files = expand(path)
        numeric_117 = self.options.get("legacy_v117_codes") == "true"
        encoding = self.options.get("encoding", "utf-8")
        self.nobs, self._tables, self._by_file = 0, {}, {}
        self._first: DatasetInfo | None = None
        for f in self.files:
            with Source(f) as source:
                info = read_info(source, numeric_117=numeric_117)
                self._first = self._first or info
                self.nobs += info.nobs
                tables = read_tables(source, info, encoding)
                self._tables |= tables
                self._by_file[f] = {v.name: tables.get(v.value_label, {}) for v in info.variables}

    # Metadata

    @property
    def info(self) -> DatasetInfo:
        return self._first

    @property
    def nvar(self) -> int:
        return self.info.nvar

    @property
    def label(self) -> str:
        return self.info.label

    @property
    def value_label_tables(self) -> dict[str, dict[int, str]]:
        return self._tables

    def variables(self) -> DataFrame:
        rows = [(v.position, v.name, v.metadata["storage_type"], v.width, v.offset, v.type_code, v.format, v.label, v.value_label) for v in self.info.variables]
        return self.spark.createDataFrame(rows, VARIABLES)

    def dataset_info(self) -> DataFrame:
        i = self.info
        return self.spark.createDataFrame([(i.version, "LSF" if i.byteorder == "<" else "MSF", i.nvar, self.nobs, i.label, i.timestamp, i.record_width, i.data_offset)], INFO)

    def value_labels(self) -> DataFrame:
        return self.spark.createDataFrame([(t, v, x) for t, d in self._tables.items() for v, x in d.items()], LABELS)

    def long_strings(self) -> DataFrame:
        """(v, o, kind, text, content) of the long-string records, parsed in one task per file; of records with one key the
        last counts.  Keys hold in their own file, so records of several files have `_file` too.
        For sections too large to look up in each task: read with strl="pointer" and resolve_long_strings()."""
        numeric_117 = self.options.get("legacy_v117_codes") == "true"
        encoding = self.options.get("encoding", "utf-8")

        def parse(batches):
            import pyarrow as pa

            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.binary()]
            for batch in batches:
                for path in batch.column("path").to_pylist():
                    with Source(path) as source:
                        held, size, info = [], 0, read_info(source, numeric_117=numeric_117)
                        gone = replaced(source, info)
                        for n, (v, o, kind, content) in enumerate(long_strings(source, info)):
                            if gone is not None and gone[n]:
                                continue
                            held.append((path, v, o, kind, long_text(kind, content, encoding), content))
                            size += len(content) + 256  # and what holds it
                            if size > 1 << 24:
                                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds)], names)
                                held, size = [], 0
                        if held:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds)], names)

        names = ["_file", "v", "o", "kind", "text", "content"]
        paths = self.spark.createDataFrame([(f,) for f in self.files], "path string").repartition(max(1, len(self.files)))
        return paths.mapInArrow(parse, "_file string, " + LONG).select(*names[len(self.files) == 1 :])

    # Rows

    def frame(self, **options) -> DataFrame:
        o = self.options | {k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in options.items()}
        return self.spark.read.format("dta").options(**o).load(self.path)

    def empty(self, **options) -> DataFrame:
        return self.frame(**options).limit(0)

    def rows(self, start: int, count: int, col_start: int | None = None, col_end: int | None = None, **options) -> DataFrame:
        """Rows [start, start + count) in file order, columns [col_start, col_end).  The window is cut to the data and
        to the variables; an empty one, a negative start and an empty range of columns give no rows."""
        a = max(0, col_start or 0)
        b = self.nvar if col_end is None else min(self.nvar, col_end)
        if start < 0 or count <= 0 or start >= self.nobs or a >= b:
            return self.empty(**options)
        names = ",".join(map(str, range(a, b)))
        return self.frame(start=start, count=count, columns=names, **options) if (a, b) != (0, self.nvar) else self.frame(start=start, count=count, **options)

    def columns(self, indices: list[int], **options) -> DataFrame:
        """The columns of zero-based indices, each once, in the order of their first mention."""
        chosen = column_indices(indices, self.info)
        if not chosen:
            return self.spark.createDataFrame([], T.StructType([]))
        return self.frame(columns=",".join(map(str, chosen)), **options)

    # Lookups and texts

    def with_labels(self, df: DataFrame, columns: list[str], suffix: str = "_label") -> DataFrame:
        """df with the label text of each column; null without a table or an entry.  Missing values have labels
        of their own if df was read with missing="tagged" or "struct".  Files whose tables for a column differ
        need `_file` in df (file=True), as each row has the labels of its own file."""
        for name in columns:
            of = {f: tables[name] for f, tables in self._by_file.items()}
            first = of[self.files[0]]
            df = add_label(df, name, first, name + suffix) if all(t == first for t in of.values()) else add_file_labels(df, name, of, name + suffix)
        return df

    def displayed(self, columns: list[str] | None = None, **options) -> DataFrame:
        """The columns as their display formats show them; missing values as their tags."""
        chosen = [v for v in self.info.variables if columns is None or v.name in columns]
        js = options.pop("js_compat", False)
        df = self.frame(columns=",".join(str(v.position) for v in chosen), missing="tagged", **options)
        out = []
        for v in chosen:
            shown = display(F.col(f"`{v.name}`"), v.format, v.storage, js_compat=js)
            out.append((shown if v.storage in ("str", "strL") else F.coalesce(F.col(f"`{v.name}__missing`"), shown)).alias(v.name))
        return df.select(*out)

    # Cancellation

    def run_tagged(self, df: DataFrame, tag: str, action):
        """action(df) under a job tag; cancel(tag) from another thread stops it, and a stopped read gives no rows at all."""
        context = self.spark.sparkContext
        context.addJobTag(tag)
        try:
            return action(df)
        finally:
            context.removeJobTag(tag)

    def cancel(self, tag: str) -> None:
        self.spark.sparkContext.cancelJobsWithTag(tag)

    def close(self) -> None:
        """Nothing stays open between reads; label tables are let go."""
        self._tables = {}
        self._by_file = {f: {name: {} for name in tables} for f, tables in self._by_file.items()}


def label_lookup_key(df: DataFrame, name: str) -> Column:
    """Key of a cell in label tables: a whole number in the 32-bit range is its own; a missing value has one by its tag."""
    kind = df.schema[name].dataType
    cell = F.col(f"`{name}`")
    tag = None
    if isinstance(kind, T.StructType):
        cell, tag, kind = cell.getField("value"), cell.getField("missing"), kind["value"].dataType
    elif f"{name}__missing" in df.columns:
        tag = F.col(f"`{name}__missing`")
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        x = cell.cast("double")
        cell = F.when((x == F.floor(x)) & x.between(-(2.0**31), 2.0**31 - 1), x)
    key = cell.cast("int")
    return key if tag is None else F.coalesce(key, label_key(tag))


def add_label(df: DataFrame, name: str, table: dict[int, str], into: str) -> DataFrame:
    key = label_lookup_key(df, name)
    if not table:
        return df.withColumn(into, F.lit(None).cast("string"))
    if len(table) <= MAP_ENTRIES:
        entries = F.map_from_arrays(F.array(*[F.lit(k) for k in table]), F.array(*[F.lit(t) for t in table.values()]))
        return df.withColumn(into, F.try_element_at(entries, key))
    labels = df.sparkSession.createDataFrame(list(table.items()), f"_marlstone_key int, `{into}` string")
    return df.withColumn("_marlstone_key", key).join(labels, "_marlstone_key", "left").drop("_marlstone_key")


def add_file_labels(df: DataFrame, name: str, tables: dict[str, dict[int, str]], into: str) -> DataFrame:
    """The same where each file (column `_file`) has a table of its own."""
    if "_file" not in df.columns:
        raise ValueError(f"the files have different labels for {name}: read with file=True")
    rows = [(f, k, t) for f, table in tables.items() for k, t in table.items()]
    labels = df.sparkSession.createDataFrame(rows, f"_marlstone_file string, _marlstone_key int, `{into}` string")
    same = (F.col("_file") == F.col("_marlstone_file")) & (label_lookup_key(df, name) == F.col("_marlstone_key"))
    return df.join(labels, same, "left").drop("_marlstone_file", "_marlstone_key")


def resolve_long_strings(df: DataFrame, texts: DataFrame, columns: list[str], *, dangling: str | None = "") -> DataFrame:
    """Replaces pointer columns (v, o) by their texts with one left join per column; a null pointer is empty text,
    a dangling one `dangling`.  Texts of several files have `_file`, and then df must have it too (file=True)."""
    files = "_file" in texts.columns
    if files and "_file" not in df.columns:
        raise ValueError("pointers hold in their own file: read with file=True")
    for name in columns:
        side = texts.select(*([F.col("_file").alias("_marlstone_file")] if files else []), F.col("v").alias("_marlstone_v"), F.col("o").alias("_marlstone_o"), F.col("text").alias("_marlstone_text"))
        same = (F.col(f"`{name}`.v") == F.col("_marlstone_v")) & (F.col(f"`{name}`.o") == F.col("_marlstone_o"))
        # Spark takes the texts for as small as the list of files that they are parsed from, and would broadcast them all.
        df = df.join(side.hint("merge"), same & (F.col("_file") == F.col("_marlstone_file")) if files else same, "left")
        shown = F.when(F.col(f"`{name}`").isNull(), F.lit("")).otherwise(F.coalesce("_marlstone_text", F.lit(dangling).cast("string")))
        df = df.withColumn(name, shown).drop("_marlstone_file", "_marlstone_v", "_marlstone_o", "_marlstone_text")
    return df
