"""Mixing sources to target weights by a low-discrepancy schedule.

Slots of one block of words each are dealt to sources by the golden-ratio sequence: slot i belongs to the
source in whose share of the cumulated targets frac(i * phi) lies.  A source's documents, in an order shuffled
by a hash, lie end to end on a line of words that is cut into equal blocks; the slot of rank r within a source
takes its block r mod (number of blocks).  What a document contributes is what of its words the taken blocks
hold, counted as often as they are taken.

Ranks and positions on the lines are two-level prefix sums (within pieces of bounded size, then over the
pieces' totals), so no source, however large, passes through one task.  The driver sees one row per source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

WEIGHTS = (3, 1, 2)
SHARE = 1.5
LIMIT = 2.0
#: Words in a block, at most; a small source has blocks so much smaller that there are so many of them.
BLOCK, LEAST_BLOCKS = 256, 100
#: Slots whose ranks are counted together, and documents of a source whose positions are.
PIECE = 8192
#: Fractional part of the golden ratio times 2**64 (fixed value).
GOLDEN = 0x9E3779B97F4A7C15


def targets(sizes: list[int], weights: tuple = WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> list[float]:
    """Targets of sources in order: `share` of all sizes by weight; one that would pass `limit` times its size
    stops there and the excess goes to the others by weight, until none passes."""
    w = [float(weights[i % len(weights)]) for i in range(len(sizes))]
    out, free, left = [0.0] * len(sizes), set(range(len(sizes))), share * sum(sizes)
    while free:
        whole = sum(w[i] for i in free)
        full = {i for i in free if left * w[i] / whole > limit * sizes[i]}
        if not full:
            for i in free:
                out[i] = left * w[i] / whole
            break
        for i in full:
            out[i] = limit * sizes[i]
        left -= sum(out[i] for i in full)
        free -= full
    return out


def count_words(text):
    """Number of runs of characters other than 0x20 and 0x09-0x0D; null: 0."""
    return F.coalesce(F.size(F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda x: x != "")).cast("long"), F.lit(0).cast("long"))


def _lines(rows: DataFrame, n_docs: int) -> DataFrame:
    """rows with `at`, the words before each on its source's line, in hash order."""
    pieces = max(1, -(-n_docs // PIECE))
    # Equal ranges of the hash, so that the order of the pieces is that of the hashes.
    piece = F.floor((F.shiftrightunsigned(F.col("h"), 32)) * F.lit(pieces) / F.lit(1 << 32)).cast("long")
    rows = rows.withColumn("piece", piece)
    own = Window.partitionBy("sid", "piece").orderBy("h", "doc_id", "tie").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy("sid").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy("sid", "piece").agg(F.sum("size").alias("words")).select("sid", "piece", F.coalesce(F.sum("words").over(over), F.lit(0)).alias("before"))
    return rows.withColumn("within", F.coalesce(F.sum("size").over(own), F.lit(0))).join(before, ["sid", "piece"]).withColumn("at", F.col("before") + F.col("within")).drop("piece", "before", "within")


def width(size: int, block: int = BLOCK) -> int:
    """Words in a block of a source: at most `block` and about size/LEAST_BLOCKS, and such that its last block is about as
    long as the others."""
    block = max(1, min(block, size // LEAST_BLOCKS))
    return max(1, -(-size // max(1, -(-size // block))))


def golden(slot):
    """frac(slot * phi) as a double; the slot is split so that 26 bits of the fraction are exact for 2**52 slots."""
    part = lambda shift: ((GOLDEN << shift) % (1 << 64)) / (1 << 64)
    u = F.shiftright(slot, 26) * F.lit(part(26)) + slot.bitwiseAND(F.lit((1 << 26) - 1)) * F.lit(part(0))
    return u - F.floor(u)


def schedule(spark, plan: list[tuple], block: int = BLOCK) -> DataFrame:
    """slot, sid, rank, block for the sources of plan: (sid, size, target).

    The points give each source its share of the slots but for a few; those that a source has too many go, and those
    it lacks come last, so that each has round(target / width)."""
    need = [(sid, target / width(size, block), -(-size // width(size, block))) for sid, size, target in plan if target > 0]
    total = sum(x for _, x, _ in need)
    n = round(total)
    if not n:
        return spark.createDataFrame([], "slot long, sid int, rank long, block long")
    sids, blocks = (F.array(*[F.lit(x[i]).cast("long") for x in need]) for i in (0, 2))
    run, bounds = 0.0, []
    for x in need[:-1]:
        run += x[1]
        bounds.append(F.lit(run / total))
    # One bound per source but the last: the slot belongs to the first source whose bound lies above its point.
    hit = F.size(F.filter(F.array(*bounds), lambda b: b <= F.col("u"))) if bounds else F.lit(0)
    slots = spark.range(0, n, 1, max(common.shuffle_partitions(spark), n // 5_000_000)).withColumnRenamed("id", "slot")
    slots = slots.withColumn("u", golden(F.col("slot"))).withColumn("hit", hit + 1)
    slots = slots.select("slot", F.element_at(sids, F.col("hit")).cast("int").alias("sid"), F.element_at(blocks, F.col("hit")).alias("blocks"), F.floor(F.col("slot") / PIECE).cast("long").alias("piece"))
    over = Window.partitionBy("sid").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    before = slots.groupBy("sid", "piece").agg(F.count(F.lit(1)).alias("slots")).select("sid", "piece", F.coalesce(F.sum("slots").over(over), F.lit(0)).alias("before"))
    own = Window.partitionBy("sid", "piece").orderBy("slot")
    ranked = slots.withColumn("within", F.row_number().over(own) - 1).join(before, ["sid", "piece"]).withColumn("rank", F.col("before") + F.col("within"))
    ranked = ranked.select("slot", "sid", "rank", "blocks")
    got = {r["sid"]: r["count"] for r in slots.groupBy("sid").count().collect()}  # one row per source
    want = {sid: round(x) for sid, x, _ in need}
    ranked = ranked.join(F.broadcast(spark.createDataFrame(list(want.items()), "sid int, want long")), "sid").filter("rank < want").drop("want")
    late = [(sid, r, blocks) for sid, _, blocks in need for r in range(got.get(sid, 0), want[sid])]  # some per source
    if late:
        ranked = ranked.unionByName(spark.createDataFrame([(n + i, *x) for i, x in enumerate(late)], "slot long, sid int, rank long, blocks long"))
    return ranked.select("slot", "sid", "rank", (F.col("rank") % F.col("blocks")).alias("block"))


def mix(docs: DataFrame, *, weights: tuple = WEIGHTS, share: float = SHARE, limit: float = LIMIT, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per row of docs: doc_id, text_hash, source, size, source_size, target, taken and segments.

    segments: the taken stretches of the document as (first word, words, times), each of one block.  Sources
    are ordered by code point with null last; a null text or one without a word has size 0 and is taken 0
    times; null ids are kept and repeated rows are documents of their own; an empty table gives no row.  Other
    columns are ignored.  taken never exceeds limit times size because a source's blocks are taken in turn and
    its target is at most that.  limit is a whole number, since a word is taken whole times.
    The result is a written table; the working tables are gone when it is there.
    """
    if limit != int(limit):
        raise ValueError("limit must be a whole number")
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), count_words(F.col(text_col)).alias("size"), F.xxhash64(F.col(text_col)).alias("tie"))
    with common.scratch(spark):
        rows = common.materialize(rows.withColumn("h", F.xxhash64("doc_id", "source", "tie", F.lit(1618))), "op10-sizes")
        found = rows.groupBy("source").agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("docs")).collect()
        found = sorted(found, key=lambda r: (r["source"] is None, r["source"] or ""))
        sizes = [r["n"] for r in found]
        goal = targets(sizes, weights, share, limit)
        n_docs = sum(r["docs"] for r in found)
        catalog = spark.createDataFrame([(i, r["source"], r["n"], t, width(r["n"], block)) for i, (r, t) in enumerate(zip(found, goal))], "sid int, source string, source_size long, target double, width long")
        rows = rows.join(F.broadcast(catalog.withColumnRenamed("source", "s")), F.col("source").eqNullSafe(F.col("s"))).drop("s")  # one row per source, already on the driver
        lined = common.materialize(_lines(rows, n_docs), "op10-lines")
        slots = schedule(spark, [(i, n, t) for i, (n, t) in enumerate(zip(sizes, goal))], block)
        # No block more often than the limit says.
        times = slots.groupBy("sid", "block").agg(F.least(F.count(F.lit(1)), F.lit(int(limit))).alias("times"))
        spans = lined.filter("size > 0").select("sid", "doc_id", "h", "tie", "at", "size", "width", F.explode(F.sequence(F.expr("at div width"), F.expr("(at + size - 1) div width"))).alias("block"))
        first = F.greatest(F.col("at"), F.col("block") * F.col("width"))
        last = F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * F.col("width"))
        parts = spans.join(times, ["sid", "block"]).select("sid", "at", "h", F.struct((first - F.col("at")).alias("first"), (last - first).alias("words"), "times").alias("part"))
        # A document is known by its place on its source's line: with size > 0 no two share it.
        taken = parts.groupBy("sid", "at").agg(F.sum(F.col("part.words") * F.col("part.times")).alias("taken"), F.sort_array(F.collect_list("part")).alias("segments"))
        some = lined.filter("size > 0").join(taken, ["sid", "at"], "left")
        none = lined.filter("size = 0").withColumn("taken", F.lit(None).cast("long")).withColumn("segments", F.lit(None).cast(taken.schema["segments"].dataType))
        mixed = some.unionByName(none).select("doc_id", F.col("tie").alias("text_hash"), "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "segments")
        return common.result(mixed, "op10-rows")


def stretches(segments: list) -> list[tuple[int, int]]:
    """Word ranges (first, end) that together take each segment (first, words, times) as often as it says: the nth
    range list joins neighbouring segments that are taken n times or more."""
    out: list[tuple[int, int]] = []
    for n in range(1, max((s[2] for s in segments), default=0) + 1):
        run = None
        for first, words, times in [*segments, (-1, 0, 0)]:
            if times >= n and run and run[1] == first:
                run = (run[0], first + words)
            else:
                if run:
                    out.append(run)
                run = (first, first + words) if times >= n else None
        if run:
            out.append(run)
    return out


def take(docs: DataFrame, mixed: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", count_col: str = "n_chars") -> DataFrame:
    """The mix itself: rows of docs whose texts are the taken stretches, each as often as it is taken; a whole
    document keeps its text as it is.  Columns stay as they are; count_col, if there, is the new text's length.
    Null texts and those without a word are in no mix; null ids stay; repeated rows take their stretches in any
    order; an empty table gives no row.
    """
    common.bounded_batches(docs.sparkSession)
    facts = mixed.filter("taken > 0").select("doc_id", "text_hash", "source", F.col("segments").alias("_marlstone_segments"))
    joined = common.rejoin(docs, facts, id_col=id_col, text_col=text_col, source_col=source_col, how="inner")
    names = docs.columns

    def run(batches):
        import re

        import pyarrow as pa

        word = re.compile(r"[^\x20\x09-\x0D]+")
        for batch in batches:
            rows, texts = [], []
            for i in range(batch.num_rows):
                parts = stretches([(s["first"], s["words"], s["times"]) for s in batch.column("_marlstone_segments")[i].as_py()])
                text = batch.column(text_col)[i].as_py()
                places = [m.span() for m in word.finditer(text)]
                for first, end in parts:
                    rows.append(i)
                    texts.append(text if (first, end) == (0, len(places)) else text[places[first][0] : places[end - 1][1]])
            out = batch.take(pa.array(rows, pa.int64())) if rows else batch.slice(0, 0)
            columns = {n: out.column(n) for n in names}
            columns[text_col] = pa.array(texts, columns[text_col].type)
            if count_col in columns:
                columns[count_col] = pa.array([len(t) for t in texts], columns[count_col].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return joined.mapInArrow(run, docs.schema)


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(common.table(spark, sf_dir, "documents")).drop("segments", "source", "text_hash")
