"""What the operators of this subpackage share: tables, shared scratch space, skew-safe joins."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A class that holds at least 1/HEAVY of all rows is broadcast; there are at most HEAVY of them.
HEAVY = 1000
#: A set of 64-bit keys is broadcast up to this many keys (16 MB); beyond it, it is joined by shuffling.
BROADCAST_KEYS = 2_000_000


#: Bytes of an Arrow batch between the JVM and Python, at most, unless a row is larger or the session says less.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Batches go by rows alone by default, and ten thousand long texts fill buffers on both sides of the pipe."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name).lower().removesuffix("b")
    if int(now.rstrip("kmgt")) << 10 * " kmgt".find(now[-1]) * now[-1].isalpha() > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share (`spark.checkpoint.dir`).

    Where the setting is absent, a local master gets a temporary folder; any other master is refused,
    since a folder of one machine is invisible to the rest.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="marlstone-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def trim() -> None:
    """Gives memory that the driver's Python has freed back to the system, where the C library can."""
    import ctypes
    import gc

    gc.collect()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession):
    """The shuffle files of what is executed inside go when it has ended, and not only when the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


#: Folders that go at the end of the blocks of `scratch` around, the innermost last.
_folders: contextvars.ContextVar[tuple[list, ...]] = contextvars.ContextVar("folders", default=())


def _remove(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """What `materialize` writes inside is removed at the end; what `result` writes stays, or goes with the block around."""
    folders: list[str] = []
    token = _folders.set((*_folders.get(), folders))
    try:
        yield
    finally:
        _folders.reset(token)
        for path in folders:
            _remove(spark, path)


def result(df: DataFrame, name: str) -> DataFrame:
    """df as a written table that outlives the innermost block of `scratch`."""
    around = _folders.get()
    token = _folders.set(around[:-1])
    try:
        return materialize(df, name)
    finally:
        _folders.reset(token)


def materialize(df: DataFrame, name: str, *, compression: str = "zstd") -> DataFrame:
    """Writes df as Parquet to the shared scratch folder and reads it back: lineage ends here, so a lost
    executor costs a reread and not a recomputation."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    for folders in _folders.get()[-1:]:
        folders.append(path)
    with shuffles_dropped(spark):
        df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def bucketed(df: DataFrame, name: str, key: str, n: int, *, ordered: bool = True):
    """df as a table of the shared scratch folder in n buckets by key, each sorted by it if `ordered`, so that joins and
    groups by it need neither a shuffle nor, where a bucket is one file, a sort; it is gone with the block."""
    spark = df.sparkSession
    name = f"{name}_{uuid.uuid4().hex}"
    path = f"{scratch_dir(spark)}/{name}"
    with shuffles_dropped(spark):
        writer = df.write.bucketBy(n, key).option("path", path)
        (writer.sortBy(key).option("compression", "snappy") if ordered else writer.option("compression", "zstd")).saveAsTable(name)
    ordering = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(ordering)
    spark.conf.set(ordering, str(ordered).lower())
    try:
        yield spark.table(name)
    finally:
        spark.conf.set(ordering, before)
        spark.sql(f"DROP TABLE {name}")
        _remove(spark, path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; a null id counts as fold 0 (held out)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(0))


def attach(rows: DataFrame, classes: DataFrame, key: list[str], size: str, total: int, how: str = "inner") -> DataFrame:
    """Inner (or left) join of rows with classes, which are unique on key; classes[size] tells how many rows each has.

    Classes with at least total/HEAVY rows, of which there are at most HEAVY, are broadcast, so their rows
    are never shuffled; the rest is an ordinary equi-join whose keys are all light.
    """
    hot = F.col(size) * HEAVY >= F.lit(total)
    heavy, light = classes.filter(hot), classes.filter(~hot)
    return rows.join(F.broadcast(heavy), key).unionByName(
        rows.join(F.broadcast(heavy.select(*key)), key, "left_anti").join(light, key, how)
    )


def keys_semi(rows: DataFrame, keys: DataFrame, key: str, count: int) -> DataFrame:
    """rows whose key is among keys (distinct, 64-bit, count of them): broadcast if the count allows, else shuffled."""
    return rows.join(F.broadcast(keys) if count <= BROADCAST_KEYS else keys.hint("merge"), key, "left_semi")


def rejoin(docs: DataFrame, facts: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", how: str = "left") -> DataFrame:
    """Joins facts, one row per row of docs at most, to the rows they tell of, by id and text_hash (null equals null).

    Rows with an id and a text in common are told apart by `source`, if facts have that column, and then by their order
    alone: the nth of the docs takes the nth of the facts, by `nth` if facts have that column.  The key columns don't
    come out."""
    if "source" in facts.columns:
        facts = facts.withColumn("text_hash", F.xxhash64("text_hash", "source")).drop("source")
        text = F.xxhash64(F.xxhash64(text_col), F.col(source_col).cast("string"))
    else:
        text = F.xxhash64(text_col)
    key = Window.partitionBy("_marlstone_id", "_marlstone_hash").orderBy(F.lit(0))
    left = docs.withColumns({"_marlstone_id": F.col(id_col).cast("long"), "_marlstone_hash": text}).withColumn("_marlstone_nth", F.row_number().over(key))
    right = facts.withColumnsRenamed({"doc_id": "_marlstone_rid", "text_hash": "_marlstone_rhash"})
    right = right.withColumnRenamed("nth", "_marlstone_rnth") if "nth" in facts.columns else right.withColumn("_marlstone_rnth", F.row_number().over(Window.partitionBy("_marlstone_rid", "_marlstone_rhash").orderBy(F.lit(0))))
    same = F.col("_marlstone_id").eqNullSafe(F.col("_marlstone_rid")) & (F.col("_marlstone_hash") == F.col("_marlstone_rhash")) & (F.col("_marlstone_nth") == F.col("_marlstone_rnth"))
    return left.join(right, same, how).drop("_marlstone_id", "_marlstone_hash", "_marlstone_nth", "_marlstone_rid", "_marlstone_rhash", "_marlstone_rnth")


def without(docs: DataFrame, lost: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows whose id and text_hash are in lost (distinct, materialised); of a key with `repeats`
    one row is left.  A short list is broadcast, a long one joined by shuffling."""
    count, repeats = lost.agg(F.count(F.lit(1)), F.count("repeats")).first()
    keys = lost.withColumnsRenamed({"doc_id": "_marlstone_rid", "text_hash": "_marlstone_rhash", "repeats": "_marlstone_repeats"})
    keys = F.broadcast(keys) if count <= BROADCAST_KEYS // 2 else keys.hint("merge")
    rows = docs.withColumns({"_marlstone_id": F.col(id_col).cast("long"), "_marlstone_hash": F.xxhash64(text_col)})
    same = F.col("_marlstone_id").eqNullSafe(F.col("_marlstone_rid")) & (F.col("_marlstone_hash") == F.col("_marlstone_rhash"))
    out = rows.join(keys, same, "left_anti")
    if repeats:
        out = out.unionByName(rows.join(keys.filter("_marlstone_repeats IS NOT NULL"), same, "left_semi").dropDuplicates(["_marlstone_id", "_marlstone_hash"]))
    return out.drop("_marlstone_id", "_marlstone_hash")


def slices(batch, column: str, limit: int = 4_000_000):
    """Cuts an Arrow record batch into pieces of at most about `limit` bytes of the string or binary column
    (one row at least), so that what NumPy allocates for a piece is bounded by the limit or one text."""
    col = batch.column(column)
    sizes = byte_lengths(col)
    start, run = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and run + n > limit:
            yield batch.slice(start, i - start)
            start, run = i, 0
        run += n
    if start < batch.num_rows:
        yield batch.slice(start, batch.num_rows - start)


def byte_lengths(col) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def flat_bytes(col) -> tuple[np.ndarray, np.ndarray]:
    """All values of a string or binary column as one uint8 array, and the offsets (n + 1) of the values; null is empty."""
    import pyarrow as pa

    sizes = byte_lengths(col)
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        import pyarrow.compute as pc

        col = pc.fill_null(col, "" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    big = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    buffers = col.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64 if big else np.int32)[col.offset : col.offset + len(col) + 1]
    ends = np.concatenate([[0], np.cumsum(sizes)])
    if buffers[2] is None or not len(col):
        return np.zeros(0, np.uint8), ends
    return np.frombuffer(buffers[2], dtype=np.uint8)[offsets[0] : offsets[-1]], ends


#: XOR-shift-multiply finaliser of splitmix64 (fixed values).
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


class Rolling:
    """64-bit hashes of arbitrary byte ranges of one buffer in constant time each, vectorised.

    sum(b[j] * B**j) over the range, times B**-start, mod 2**64, then mixed; B is odd and so has an inverse.
    """

    B = 0x9E3779B97F4A7C15  # fixed value

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) <= n:
            m = max(n + 1, 2 * len(self.up))
            for name, base in (("up", self.B), ("down", pow(self.B, -1, 1 << 64))):
                p = np.full(m, base, np.uint64)
                p[0] = 1
                setattr(self, name, np.cumprod(p, dtype=np.uint64))

    def prefix(self, data: np.ndarray) -> np.ndarray:
        self._powers(len(data))
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)], out=out[1:])
        return out

    def ranges(self, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix64((prefix[ends] - prefix[starts]) * self.down[starts])


def hash_words(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, rolling: Rolling, prefixes: tuple = (), span: int = 2_000_000) -> np.ndarray:
    """(words, 1 + len(prefixes)) hashes of words and of their first n bytes, n in prefixes (0 if a word isn't longer).

    The buffer is hashed in stretches of about `span` bytes, so a long text needs no more memory than a short one."""
    out = np.zeros((len(starts), 1 + len(prefixes)), np.uint64)
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(stops, starts[a] + span, side="right")))
        first, last = starts[a], stops[b - 1]
        prefix = rolling.prefix(data[first:last])
        s, e = starts[a:b] - first, stops[a:b] - first
        out[a:b, 0] = rolling.ranges(prefix, s, e)
        for j, n in enumerate(prefixes):
            long = e - s > n
            out[a:b, 1 + j][long] = rolling.ranges(prefix, s[long], s[long] + n) + np.uint64(n)
        a = b
    return out


#: The ASCII white space that separates words: 0x20, 0x09-0x0D.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of each value in a flat buffer, and the number of words per value.

    A word never crosses the border of two values."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(ends) - 1, np.int64)
    solid = ~_SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    borders = ends[1:-1]
    borders = borders[borders < len(data)]
    first[borders] |= solid[borders]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    cut = borders[borders > 0] - 1
    last[cut] |= solid[cut]
    starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, stops, np.diff(np.searchsorted(starts, ends))


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def group_sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of values; a run may be empty."""
    total = np.concatenate([[0], np.cumsum(values)])
    ends = np.concatenate([[0], np.cumsum(counts)])
    return total[ends[1:]] - total[ends[:-1]]
