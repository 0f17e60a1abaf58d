"""Exact deduplication by a Golomb-coded fingerprint exchange.

1. Each scan task fingerprints its texts (64 bits), sorts the fingerprints by owner (equal ranges of the
   fingerprint space) and writes, per block of rows and owner, the Golomb-coded sorted distinct fingerprints
   beside the row identities, which stay with the sender's block.
2. Only the codes are shuffled to the owners.  An owner answers each block with a bitmap of the fingerprints
   that occur elsewhere too.
3. The blocks take their bitmaps; rows whose bit is set are suspects.  Only the texts of suspects are
   shuffled, and grouped by their bytes, which verifies each class.

Bounds: a block has at most BLOCK_ROWS rows; an owner's share is a range of uniformly distributed hashes, in
which any number of copies counts once per block; copies are merged before they are shuffled (partial
aggregation), and the rows of a class that holds a thousandth of all rows are never shuffled by that class.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, golomb

#: Rows of a sender's block, so that a worker holds some 16 MB at a time.
BLOCK_ROWS = 200_000
#: Fingerprints an owner receives, about; more rows mean more owners.
OWNER_ROWS = 2_000_000

_BLOCKS = "block long, owner int, n int, k int, unary binary, rest binary, repeated binary, ids binary, nulls binary, hashes binary, shas binary, places binary"


def _origin(owner: int, owners: int) -> int:
    """First fingerprint of an owner's range."""
    return -(-(owner << 64) // owners)


def _sender(owners: int, bits: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        base, made = TaskContext.get().partitionId() << 24, 0
        borders = np.array([_origin(o, owners) for o in range(1, owners)], np.uint64)

        def blocks(table):
            nonlocal made
            h = table.column("h").to_numpy().view(np.uint64)
            h = h >> np.uint64(64 - bits) << np.uint64(64 - bits)
            order = np.argsort(h, kind="stable")
            ids = table.column("doc_id")
            nulls = ids.is_null().to_numpy(zero_copy_only=False)[order]
            ids = ids.fill_null(0).to_numpy()[order]
            shas = np.frombuffer(b"".join(table.column("sha").to_pylist()), "V32")[order]
            h = h[order]
            cuts = [0, *np.searchsorted(h, borders).tolist(), len(h)]
            out = []
            for o in range(owners):
                a, b = cuts[o], cuts[o + 1]
                if a == b:
                    continue
                new = np.concatenate([[True], h[a + 1 : b] != h[a : b - 1]])
                places = np.cumsum(new) - 1
                distinct = h[a:b][new]
                origin = _origin(o, owners)
                k, unary, rest = golomb.encode(distinct, origin, _origin(o + 1, owners) - origin)
                repeated = np.bincount(places) > 1
                out.append((base + made, o, len(distinct), k, unary, rest, np.packbits(repeated).tobytes(), ids[a:b].tobytes(), np.packbits(nulls[a:b]).tobytes(), h[a:b].tobytes(), shas[a:b].tobytes(), places.astype(np.uint32).tobytes()))
            made += 1
            names = [x.split()[0] for x in _BLOCKS.split(", ")]
            types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), *[pa.binary()] * 8]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

        held, rows = [], 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, BLOCK_ROWS - rows)
                batch = batch.slice(part.num_rows)
                held.append(part)
                rows += part.num_rows
                if rows == BLOCK_ROWS:
                    yield blocks(pa.Table.from_batches(held).combine_chunks())
                    held, rows = [], 0
        if rows:
            yield blocks(pa.Table.from_batches(held).combine_chunks())

    return run


def _owner(owners: int):
    def run(key, table):
        import numpy as np
        import pyarrow as pa

        origin = _origin(key[0].as_py(), owners)
        rows = table.to_pylist()
        all_hashes = [golomb.decode(r["n"], r["k"], r["unary"], r["rest"], origin) for r in rows]
        together = np.sort(np.concatenate(all_hashes))
        again = np.unique(together[1:][together[1:] == together[:-1]])
        maps = []
        for r, h in zip(rows, all_hashes):
            dup = np.unpackbits(np.frombuffer(r["repeated"], np.uint8), count=r["n"]).astype(bool)
            if len(again):
                at = np.searchsorted(again, h)
                at[at == len(again)] = 0
                dup |= again[at] == h
            maps.append(np.packbits(dup).tobytes())
        return pa.table({"block": pa.array([r["block"] for r in rows], pa.int64()), "owner": pa.array([r["owner"] for r in rows], pa.int32()), "bitmap": pa.array(maps, pa.binary())})

    return run


def _take(batches):
    """Rows of the sender's blocks with their bits."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        for i in range(batch.num_rows):
            r = {n: batch.column(n)[i].as_py() for n in batch.schema.names}
            ids = np.frombuffer(r["ids"], np.int64)
            n = len(ids)
            places = np.frombuffer(r["places"], np.uint32)
            nulls = np.unpackbits(np.frombuffer(r["nulls"], np.uint8), count=n).astype(bool)
            dup = np.unpackbits(np.frombuffer(r["bitmap"], np.uint8), count=r["n"]).astype(bool)[places]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64(), mask=nulls),
                    pa.array(np.full(n, r["block"], np.int64)),
                    pa.array(np.full(n, r["owner"], np.int32)),
                    pa.array(np.arange(n, dtype=np.int32)),
                    pa.array(np.frombuffer(r["hashes"], np.int64)),
                    pa.FixedSizeBinaryArray.from_buffers(pa.binary(32), n, [None, pa.py_buffer(r["shas"])]).cast(pa.binary()),
                    pa.array(dup),
                ],
                ["doc_id", "block", "owner", "place", "h", "sha", "suspect"],
            )


def exact_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", bits: int = 64) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are; a null text counts as empty, whatever its length a text is compared
    whole.  Of equal texts the row with the largest id stays (null ids come last); of rows that tie in text and
    id exactly one stays, so repeated rows collapse.  keep_id is null only if all ids of the class are.  An
    empty table gives an empty result.  Other columns of docs, whatever their names, are ignored.
    bits: of the fingerprint; fewer make false suspects, which the byte check tells apart.
    The result is a written table; the working tables are gone when it is there.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("t")).select("doc_id", F.xxhash64("t").alias("h"), F.unhex(F.sha2("t", 256)).alias("sha"))
    common.bounded_batches(docs.sparkSession)
    n_docs = docs.count()
    owners = max(common.shuffle_partitions(spark), -(-n_docs // OWNER_ROWS))
    with common.scratch(spark):
        blocks = common.materialize(rows.mapInArrow(_sender(owners, bits), _BLOCKS), "op1-blocks")
        bitmaps = (
            blocks.select("block", "owner", "n", "k", "unary", "rest", "repeated")
            .groupBy("owner")
            .applyInArrow(_owner(owners), "block long, owner int, bitmap binary")
        )
        sides = blocks.select("block", "owner", "n", "ids", "nulls", "hashes", "shas", "places").join(bitmaps, ["block", "owner"])
        rows = common.materialize(
            sides.mapInArrow(_take, "doc_id long, block long, owner int, place int, h long, sha binary, suspect boolean"), "op1-rows"
        )
        suspects = rows.filter("suspect")
        keys = common.materialize(suspects.select("h").distinct(), "op1-keys")
        cut = F.lit(64 - bits)
        texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("t")).withColumn(
            "h", F.shiftleft(F.shiftrightunsigned(F.xxhash64("t"), 64 - bits), 64 - bits) if bits < 64 else F.xxhash64("t")
        )
        verified = (
            common.keys_semi(texts, keys, "h", keys.count())
            .groupBy("h", "t")
            .agg(F.count(F.lit(1)).alias("group_size"), F.max("doc_id").alias("keep_id"))
            .select(F.unhex(F.sha2("t", 256)).alias("sha"), "group_size", "keep_id")
            .groupBy("sha")
            .agg(F.max("group_size").alias("group_size"), F.max("keep_id").alias("keep_id"), F.count(F.lit(1)).alias("texts"))
            # Two texts of one SHA-256 have never been seen; should it happen, stop and do not merge them.
            .withColumn("group_size", F.when(F.col("texts") == 1, F.col("group_size")).otherwise(F.raise_error(F.lit("two texts share a SHA-256")).cast("long")))
            .drop("texts")
        )
        stays = suspects.groupBy("sha").agg(F.max(F.struct("doc_id", "block", "owner", "place")).alias("stay"))
        classes = common.materialize(verified.join(stays, "sha"), "op1-classes")
        alone = rows.filter("NOT suspect").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
        grouped = common.attach(suspects, classes, ["sha"], "group_size", n_docs).select(
            "doc_id",
            "keep_id",
            "group_size",
            F.struct("doc_id", "block", "owner", "place").eqNullSafe(F.col("stay")).alias("kept"),
            F.lower(F.hex("sha")).alias("text_sha256"),
        )
        return common.result(alone.unionByName(grouped), "op1-rows")


def op1_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(common.table(spark, sf_dir, "documents"))


OP1_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
