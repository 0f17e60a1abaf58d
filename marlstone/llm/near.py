"""Near-duplicate documents by SimHash of word shingles: BK-trees propose pairs, exact set similarity decides.

A document is the set of its lower-cased shingles of WORDS words (a shorter text is one shingle); two documents are
near-duplicates if the Jaccard similarity of their sets is NUM/DEN or more, and groups are the components of these pairs.

1. Each document gets the SimHash fingerprint of its set.  At a similarity of 0.8 about ten of its 64 bits differ and
   often more, so the masked keys of the SimHash operator, which deal the fingerprints to shards, would be too many or
   too short.  Shards are rare shingles instead: shingles are counted in a sketch, each set is ordered by rarity, and
   of two similar sets the first size - ceil(t * size) + 1 shingles, the prefixes, share one at least.  So each
   similar pair meets in a shard, whatever its fingerprints.  Documents of equal sets are one from here on.
2. Each shard has a BK-tree of its fingerprints.  Each member looks up a member before it within RADIUS bits that passes the
   length and positional filters: one at most, so large groups of copies are tied in linear numbers of pairs.
   The shingles of both, from the texts, decide.
3. The radius is no bound: few similar pairs differ in more bits, and a member asks for one neighbour only.  Shards that
   still hold several components are therefore joined whole, for pairs of different components.  Such a pair is
   counted once per prefix shingle in common; similar sets have so many at least that the rest of one can make up for
   what lacks.  The shingles decide again, so no pair is lost, whatever the trees missed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, simhash

WORDS = 5
#: The similarity, 4/5.
NUM, DEN = 4, 5
#: Bits in which the fingerprints of a pair that a tree proposes differ at most.
RADIUS = 24
#: Counters of the sketch, and the slices in which tasks hand them on to be added up.
BUCKETS, SLICES = 1 << 20, 64


def shingles(batch, column: str = "text"):
    """Yields (row, sorted distinct uint64 shingle hashes) of each row with a word; white space and words are as in
    common.words, lower-cased by code point."""
    import numpy as np
    import pyarrow.compute as pc

    rolling, done = common.Rolling(), 0
    for part in common.slices(batch, column):
        lower = pc.utf8_lower(part.column(column))
        data, ends = common.flat_bytes(lower)
        starts, stops, counts = common.words(data, ends)
        h = common.hash_words(data, starts, stops, rolling)[:, 0]
        last = np.repeat(np.cumsum(counts), counts)
        first = np.repeat(np.cumsum(counts) - counts, counts)
        at = np.arange(len(h))
        total = np.zeros(len(h), np.uint64)
        for j in range(WORDS):
            inside = at + j < last
            total[inside] = total[inside] * np.uint64(common.Rolling.B) + h[at[inside] + j]
        whole = (at + WORDS <= last) | (at == first)
        total = common.mix64(total)
        border = np.concatenate([[0], np.cumsum(counts)])
        for i in np.flatnonzero(counts).tolist():
            a, b = border[i], border[i + 1]
            yield done + i, np.unique(total[a:b][whole[a:b]])
        done += part.num_rows


def _sketch(batches):
    """This task's counters, a row per slice."""
    import zlib

    import numpy as np
    import pyarrow as pa

    counts = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        held = [s for _, s in shingles(batch)]
        if held:
            at, n = np.unique(np.concatenate(held) & np.uint64(BUCKETS - 1), return_counts=True)
            counts[at.astype(np.int64)] += n
    parts = [(i, zlib.compress(part.tobytes(), 1)) for i, part in enumerate(counts.reshape(SLICES, -1)) if part.any()]
    for i, part in parts:
        yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([part], pa.binary())], ["slice", "counts"])


def _levels(key, batches):
    """A slice's counters of all tasks, as levels."""
    import zlib

    import numpy as np
    import pyarrow as pa

    total = np.zeros(BUCKETS // SLICES, np.int64)
    for batch in batches:
        for part in batch.column("counts"):
            total += np.frombuffer(zlib.decompress(part.as_py()), np.int64)
    out = np.minimum(126, np.round(2 * np.log2(total + 1.0))).astype(np.uint8)
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([out.tobytes()], pa.binary())], ["slice", "levels"])


def rarity_levels(rows: DataFrame):
    """A level per counter of the sketch: twice the base-2 logarithm of the shingles that fell into it, and 1."""
    import numpy as np

    from collections.abc import Iterator

    import pyarrow as pa

    _levels.__annotations__ = {"key": tuple[pa.Scalar, ...], "batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    found = rows.select("text").mapInArrow(_sketch, "slice int, counts binary").groupBy("slice").applyInArrow(_levels, "slice int, levels binary").collect()  # BUCKETS bytes
    out = np.zeros((SLICES, BUCKETS // SLICES), np.uint64)
    for r in found:
        out[r["slice"]] = np.frombuffer(r["levels"], np.uint8)
    del found
    common.trim()
    return out.reshape(-1).astype(np.uint8)


def _prints(levels):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            n = batch.num_rows
            uid, size, fp, prefix = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.uint64), [[]] * n
            for i, s in shingles(batch):
                m = len(s)
                uid[i] = np.bitwise_xor.reduce(common.mix64(s + np.uint64(m))).view(np.int64)
                size[i] = m
                fp[i] = simhash.majority((s[a : a + 65536] for a in range(0, m, 65536)), m)
                ranked = np.sort(levels[(s & np.uint64(BUCKETS - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(56) | s >> np.uint64(8))
                prefix[i] = ranked[: m - (NUM * m + DEN - 1) // DEN + 1].view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(uid), pa.array(size), pa.array(fp.view(np.int64)), pa.array(prefix, pa.list_(pa.int64()))], ["doc_id", "text_hash", "uid", "size", "fp", "prefix"])

    return run


def _sets(batches):
    import pyarrow as pa

    for batch in batches:
        found = dict(shingles(batch))
        sets = pa.array([found[i].view("int64") if i in found else [] for i in range(batch.num_rows)], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column("text_hash"), sets], ["text_hash", "shingles"])


def _verified(pairs: DataFrame, prints: DataFrame, rows: DataFrame) -> DataFrame:
    """Of pairs (a, b) of uids, materialised, those whose sets are as similar as asked."""
    ends = pairs.select(F.col("a").alias("uid")).unionAll(pairs.select(F.col("b").alias("uid")))
    ids = common.materialize(ends.groupBy("uid").agg(F.count(F.lit(1)).alias("degree")), "near-ids")
    wanted = common.materialize(prints.join(ids, "uid").groupBy("uid", "degree").agg(F.min("text_hash").alias("text_hash")), "near-wanted")
    keys = wanted.select("text_hash").distinct()
    texts = common.keys_semi(rows.select("text_hash", "text"), keys, "text_hash", keys.count()).dropDuplicates(["text_hash"])
    sets = wanted.join(texts.mapInArrow(_sets, "text_hash long, shingles array<long>"), "text_hash").select("uid", "degree", "shingles")
    sets, total = common.materialize(sets, "near-sets"), max(1, pairs.count())
    for end, name in (("a", "sa"), ("b", "sb")):
        side = sets.withColumnsRenamed({"uid": end, "shingles": name})
        pairs = common.attach(pairs, side, [end], "degree", total).drop("degree")
    same = F.size(F.array_intersect("sa", "sb"))
    return common.materialize(pairs.filter(F.lit(DEN) * same >= F.lit(NUM) * (F.size("sa") + F.size("sb") - same)).select("a", "b"), "near-edges")


def _trees(radius: int):
    """Pairs a < b of uids that the BK-trees of shards propose, from rows sorted by shard (word, uid, fp, size, i)."""

    def proposed(word, uid, fp, size, i):
        import numpy as np
        import pyarrow as pa

        group = np.cumsum(np.concatenate([[True], word[1:] != word[:-1]]))
        low, room = NUM * size, size - i

        def alike(x, y):  # the length and positional filters
            length = DEN * np.minimum(size[x], size[y]) >= np.maximum(low[x], low[y])
            return length & ((NUM + DEN) * np.minimum(room[x], room[y]) >= low[x] + low[y])

        # One of each fingerprint of a shard is in its tree; the others are tied to it.
        order = np.lexsort((fp, group))
        new = np.concatenate([[True], (group[order][1:] != group[order][:-1]) | (fp[order][1:] != fp[order][:-1])])
        same, least = order[~new], order[new][np.cumsum(new) - 1][~new]
        at = np.sort(order[new])
        found = simhash.Forest(fp[at], group[at]).earlier(radius, lambda q, node: alike(at[q], at[node]))
        x, y = np.concatenate([least, at[found[found >= 0]]]), np.concatenate([same, at[found >= 0]])
        x, y = uid[x[ok := alike(x, y)]], uid[y[ok]]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])

    def run(batches):
        import numpy as np

        held = None
        for batch in batches:
            now = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("word", "uid", "fp", "size", "i")]
            now[2] = now[2].view(np.uint64)
            held = now if held is None else [np.concatenate(x) for x in zip(held, now)]
            border = np.flatnonzero(held[0][1:] != held[0][:-1]) if len(held[0]) >= simhash.CHUNK else []
            if len(border):
                cut = border[-1] + 1
                yield proposed(*(x[:cut] for x in held))
                held = [x[cut:] for x in held]
        if held is not None and len(held[0]):
            yield proposed(*held)

    return run


def shards(codes: DataFrame) -> DataFrame:
    """word, uid, fp, size, i: the members of each shard of several, i being the place of the shard's shingle in the prefix."""
    n = common.shuffle_partitions(codes.sparkSession)
    listed = Window.partitionBy("word").orderBy("size", "uid")
    entries = codes.select("uid", "fp", "size", F.posexplode("prefix").alias("i", "word")).repartition(n, "word")
    entries = entries.withColumns({"last": F.lag("uid").over(listed), "next": F.lead("uid").over(listed)})
    return common.materialize(entries.filter("last IS NOT NULL OR next IS NOT NULL").select("word", "uid", "fp", "size", "i"), "near-entries")


def proposals(entries: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Distinct pairs a < b of uids within the radius, at most one per member of a shard to one before it, by the shards' BK-trees."""
    n = common.shuffle_partitions(entries.sparkSession)
    dealt = entries.repartition(n, "word").sortWithinPartitions("word", "size", "uid")
    return common.materialize(dealt.mapInArrow(_trees(radius), "a long, b long").distinct(), "near-tried")


def links(prints: DataFrame, codes: DataFrame, rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges a < b of similar uids that connect all similar ones."""
    entries = shards(codes)
    tried = proposals(entries, radius)
    edges = _verified(tried, prints, rows)

    # What is left: shards that hold more than one component.
    roots = common.materialize(simhash.components(edges), "near-roots")
    open_ = entries.select("word", "uid", "size").join(roots.withColumnRenamed("node", "uid"), "uid", "left")
    open_ = common.materialize(open_.withColumn("root", F.coalesce("root", "uid")), "near-open")
    several = open_.groupBy("word").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("word")
    open_ = open_.join(several, "word", "left_semi")
    x, y = open_.alias("x"), open_.alias("y")
    length = F.lit(DEN) * F.least("x.size", "y.size") >= F.lit(NUM) * F.greatest("x.size", "y.size")
    found = x.join(y, (F.col("x.word") == F.col("y.word")) & (F.col("x.uid") < F.col("y.uid")) & (F.col("x.root") != F.col("y.root")) & length)
    found = found.groupBy(F.col("x.uid").alias("a"), F.col("y.uid").alias("b")).agg(F.count(F.lit(1)).alias("shared"), F.max(F.col("x.size") + F.col("y.size")).alias("both"), F.max(F.greatest("x.size", "y.size")).alias("larger"))
    # Behind the prefix of the larger set come ceil(t * size) - 1 shingles.  (All shards that such a pair shares hold several components, so they are all here.)
    behind = F.expr(f"({NUM} * larger + {DEN - 1}) div {DEN} - 1")
    found = found.filter(F.lit(NUM + DEN) * (F.col("shared") + behind) >= F.lit(NUM) * F.col("both")).select("a", "b")
    rest = common.materialize(found.join(tried, ["a", "b"], "left_anti"), "near-rest")
    return edges.union(_verified(rest, prints, rows)) if rest.count() else edges


def near_duplicates(docs: DataFrame, *, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, text_hash, root (stands for the group of near-duplicates).  The groups are the
    same with any radius: it decides only which pairs the trees find and which the join of what they leave.

    Null and wordless texts are copies of each other; repeated rows share their group; an empty table gives no
    row; other columns are ignored.  Shingles and sets are compared by 64-bit hashes.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))
    common.bounded_batches(docs.sparkSession)
    prints = common.materialize(rows.mapInArrow(_prints(rarity_levels(rows)), "doc_id long, text_hash long, uid long, size long, fp long, prefix array<long>"), "near-prints")
    codes = common.materialize(prints.groupBy("uid").agg(F.count(F.lit(1)).alias("n"), F.any_value("size").alias("size"), F.any_value("fp").alias("fp"), F.any_value("prefix").alias("prefix")), "near-codes")
    roots = common.materialize(simhash.components(links(prints, codes, rows, radius)), "near-roots")
    classes = codes.select("uid", "n").join(roots.withColumnRenamed("node", "uid"), "uid", "left")
    classes = common.materialize(classes.select("uid", "n", F.coalesce("root", "uid").alias("root")), "near-classes")
    return common.attach(prints.select("doc_id", "text_hash", "uid"), classes, ["uid"], "n", max(1, prints.count())).select("doc_id", "text_hash", "root")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group: that of the smallest id (null last; then by a hash of the text).

    Null and wordless texts are one group; of repeated rows one stays; an empty table gives no row; all columns stay."""
    return simhash.keep_first(docs, near_duplicates(docs, id_col=id_col, text_col=text_col), id_col=id_col, text_col=text_col)
