"""Language-model scores by deleted interpolation of bigram, unigram and uniform estimates.

Words and pairs of words are counted by their 64-bit hashes over all training documents:

1. Each scan task cuts its documents into chunks of about CHUNK_BYTES and stores a chunk's tokens once, as
   indexes into the chunk's sorted vocabulary of hashes (a table bucketed by chunk).
2. Each chunk sends, per owner (an equal range of hash space), the Golomb-coded sorted hashes of its distinct
   words and pairs with their counts in training documents and in the held-out part of them.
3. An owner adds up its range and answers each chunk with the corpus counts, in the order of the request.
4. Chunks meet their answers.  A first pass classifies the held-out pairs by context-frequency bucket and by
   their estimates with the held-out counts deleted; expectation-maximisation on that table, whose size is
   fixed, gives each bucket's mixture weights.  A second pass scores every document.

What is gathered grows with the corpus and stays distributed; a task holds one chunk or one owner's range.
The driver gets the histogram, N and V.  A bucket b holds contexts of more than 2^(b - 1) and at most 2^b occurrences, so its bigram
estimates fall into 4 * b + 2 cells at most; with unigram estimates down to 1/N the histogram has under 8 * b * b * log2 N cells
for b = log2 N, some 800,000 at N = 2^46 (most of them empty).  Estimates are rounded to a quarter octave there, so each is off by a factor
of 2^(1/8) at most, and no estimate is clipped; scores use exact counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, golomb

FOLDS = 10
#: The fold of the training documents whose counts are deleted to learn the weights.
HELD_FOLD = 1
CHUNK_BYTES = 12_000_000
#: Buckets of context counts by octaves: as many as a 64-bit count has.
BUCKETS = 64
#: Steps per octave of the quantised estimates; 64 octaves reach any estimate of 64-bit counts.
STEPS = 4
EM_ROUNDS = 100
#: The hash of the end token (fixed value); it is also the context of a document's first token.
END = 0xE0D0E0D0E0D0E0D1
_PAIR = 0xD6E8FEB86659FD93  # fixed odd multiplier

_CHUNK = "chunk long, ids binary, nulls binary, folds binary, sizes binary, vocabulary binary, tokens binary"
_ASK = "owner int, chunk long, kind int, n int, k int, unary binary, rest binary, counts binary, held binary"
_ANSWER = "chunk long, owner int, kind int, counts binary, held binary, types long, total long, held_total long"
SCORED = "doc_id long, fold int, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def pack_counts(x) -> bytes:
    """One byte a count; 255 stands for a count that follows after all bytes."""
    import numpy as np

    return np.minimum(x, 255).astype(np.uint8).tobytes() + x[x >= 255].astype("<u8").tobytes()


def unpack_counts(data: bytes, n: int):
    import numpy as np

    out = np.frombuffer(data, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(data, "<u8", offset=n).astype(np.int64)
    return out


def _planes(x) -> bytes:
    import numpy as np

    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _unplanes(data: bytes):
    import numpy as np

    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _chunks(limit: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        rolling, base, made = common.Rolling(), TaskContext.get().partitionId() << 32, 0
        held, size = [], 0

        def close():
            nonlocal held, size, made
            tokens = np.concatenate([h[3] for h in held])
            vocabulary, at = np.unique(tokens, return_inverse=True)
            cols = [np.concatenate([h[i] for h in held]) for i in range(3)] + [np.concatenate([h[4] for h in held])]
            row = [base + made, cols[0].tobytes(), np.packbits(cols[1]).tobytes(), cols[2].tobytes(), cols[3].tobytes(), vocabulary.tobytes(), _planes(at)]
            held, size, made = [], 0, made + 1
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, [pa.int64(), *[pa.binary()] * 6])], [x.split()[0] for x in _CHUNK.split(", ")])

        for batch in batches:
            for part in common.slices(batch, "text", 2_000_000):
                data, ends = common.flat_bytes(part.column("text"))
                if size and size + len(data) > limit:
                    yield close()
                low = common.lower_ascii(data)
                starts, stops, counts = common.words(low, ends)
                h = common.hash_words(low, starts, stops, rolling)[:, 0]
                tokens = np.full(len(h) + len(counts), END, np.uint64)
                tokens[np.arange(len(h)) + np.repeat(np.arange(len(counts)), counts)] = h
                ids = part.column("doc_id")
                held.append((ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), part.column("fold").to_numpy().astype(np.int8), tokens, counts + 1))
                size += len(data)
        if held:
            yield close()

    return run


def _open(row: dict):
    """tokens (hashes), contexts (hashes), places in the vocabulary, fold per token, tokens per document, folds."""
    import numpy as np

    vocabulary = np.frombuffer(row["vocabulary"], np.uint64)
    at = _unplanes(row["tokens"])
    sizes, folds = np.frombuffer(row["sizes"], np.int64), np.frombuffer(row["folds"], np.int8)
    tokens = vocabulary[at]
    before = np.empty(len(at), at.dtype)
    end = np.searchsorted(vocabulary, np.uint64(END))
    before[0] = end  # a document ends with the end token, so the context of the next one's first is right
    before[1:] = at[:-1]
    pairs = common.mix64(vocabulary[before] * np.uint64(_PAIR) + tokens)
    return vocabulary, at, before, pairs, np.repeat(folds, sizes), sizes, folds


def _requests(owners: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        origins = [_origin(o, owners) for o in range(owners + 1)]
        borders = np.array(origins[1:-1], np.uint64)
        kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), *[pa.binary()] * 4]
        for batch in batches:
            for row in batch.to_pylist():
                vocabulary, at, _, pairs, fold, _, _ = _open(row)
                out = []
                for kind in (0, 1):
                    if kind == 0:
                        keys = vocabulary
                        counts, held = (np.bincount(at[m], minlength=len(keys)) for m in (fold != 0, fold == HELD_FOLD))
                    else:
                        keys = _distinct(pairs)
                        counts, held = (_count(keys, np.sort(pairs[m])) for m in (fold != 0, fold == HELD_FOLD))
                    cuts = [0, *np.searchsorted(keys, borders).tolist(), len(keys)]
                    for o in range(owners):
                        a, b = cuts[o], cuts[o + 1]
                        if a < b:
                            k, unary, rest = golomb.encode(keys[a:b], origins[o], origins[o + 1] - origins[o])
                            out.append((o, row["chunk"], kind, b - a, k, unary, rest, pack_counts(counts[a:b]), pack_counts(held[a:b])))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], [x.split()[0] for x in _ASK.split(", ")])

    return run


def _origin(owner: int, owners: int) -> int:
    return -(-(owner << 64) // owners)


def _distinct(x):
    import numpy as np

    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def _count(keys, among):
    """How often each of the sorted distinct keys occurs in a sorted array."""
    import numpy as np

    first = np.flatnonzero(np.concatenate([[True], among[1:] != among[:-1]])) if len(among) else np.zeros(0, np.int64)
    out = np.zeros(len(keys), np.int64)
    out[np.searchsorted(keys, among[first])] = np.diff(np.append(first, len(among)))
    return out


def _answers(owners: int):
    def run(key, table):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        origin = _origin(key[0].as_py(), owners)
        out = []
        for kind in (0, 1):
            rows = table.filter(pc.equal(table.column("kind"), kind)).to_pylist()
            if not rows:
                continue
            hashes = [golomb.decode(r["n"], r["k"], r["unary"], r["rest"], origin) for r in rows]
            keys = _distinct(np.concatenate(hashes))
            counts, held, places = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64), []
            for r, h in zip(rows, hashes):
                at = np.searchsorted(keys, h)
                counts[at] += unpack_counts(r["counts"], r["n"])
                held[at] += unpack_counts(r["held"], r["n"])
                places.append(at.astype(np.int32))
            for r, at in zip(rows, places):
                out.append((r["chunk"], key[0].as_py(), kind, pack_counts(counts[at]), pack_counts(held[at]), 0, 0, 0))
            if kind == 0:
                out.append((-1, key[0].as_py(), 0, b"", b"", int((counts > 0).sum()), int(counts.sum()), int(held.sum())))
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=[x.split()[0] for x in _ANSWER.split(", ")])

    return run


def _meet(left, right, owners: int):
    """A chunk (left: one row) with its answers: what _open gives, and for words and pairs (counts, held) in order of their hashes."""
    import numpy as np

    opened = _open(left.to_pylist()[0])
    vocabulary, pairs = opened[0], opened[3]
    keys = _distinct(pairs)
    borders = np.array([_origin(o, owners) for o in range(1, owners)], np.uint64)
    found = []
    for kind, own in ((0, vocabulary), (1, keys)):
        cuts = [0, *np.searchsorted(own, borders).tolist(), len(own)]
        counts, held = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
        for r in right.to_pylist():
            if r["kind"] == kind:
                a, b = cuts[r["owner"]], cuts[r["owner"] + 1]
                counts[a:b], held[a:b] = unpack_counts(r["counts"], b - a), unpack_counts(r["held"], b - a)
        found.append((counts, held))
    return opened, keys, found


def bucket(context_counts):
    import numpy as np

    return np.minimum(np.ceil(np.log2(context_counts + 1.0)).astype(np.int64), BUCKETS - 1)


def _cell(p):
    """Quantised -log2 of an estimate, under 512; 0 stands for an estimate of zero."""
    import numpy as np

    out = np.zeros(len(p), np.int64)
    some = p > 0
    out[some] = 1 + np.rint(-np.log2(p[some]) * STEPS).astype(np.int64)
    return out


def _events(owners: int, n: int):
    """n: training tokens without the held-out ones."""

    def run(key, left, right):
        import numpy as np
        import pyarrow as pa

        if not len(left):
            return pa.table([pa.array([], pa.int32())] * 3 + [pa.array([], pa.int64())], names=["b", "e2", "e1", "n"])
        (_, at, before, pairs, fold, _, _), keys, (words, both) = _meet(left, right, owners)
        use = fold == HELD_FOLD
        word, context, pair = at[use], before[use], np.searchsorted(keys, pairs[use])
        c, c1, c2 = (words[0] - words[1])[context], (words[0] - words[1])[word], (both[0] - both[1])[pair]
        cells = (bucket(c) << 18) + (_cell(c2 / np.maximum(c, 1)) << 9) + _cell(c1 / max(n, 1))
        cells, times = np.unique(cells, return_counts=True)
        return pa.table([pa.array((cells >> 18).astype(np.int32)), pa.array((cells >> 9 & 511).astype(np.int32)), pa.array((cells & 511).astype(np.int32)), pa.array(times)], names=["b", "e2", "e1", "n"])

    return run


def learn_weights(events, v: int):
    """(BUCKETS, 3) weights of the bigram, unigram and uniform estimates from rows (b, e2, e1, n) by EM.

    A bucket without events takes those of the nearest smaller bucket that has some (bucket 0, contexts never
    seen, has no bigram estimate)."""
    import numpy as np

    x = np.array(events, np.int64).reshape(-1, 4)
    p = np.stack([np.where(x[:, 1] > 0, 2.0 ** (-(x[:, 1] - 1) / STEPS), 0.0), np.where(x[:, 2] > 0, 2.0 ** (-(x[:, 2] - 1) / STEPS), 0.0), np.full(len(x), 1.0 / (v + 1))], axis=1)
    out, last = np.zeros((BUCKETS, 3)), np.array([0.4, 0.5, 0.1])
    for b in range(BUCKETS):
        own = x[:, 0] == b
        if own.any():
            w, q, n = last.copy(), p[own], x[own, 3]
            w = np.maximum(w, 0.01) / np.maximum(w, 0.01).sum()
            for _ in range(EM_ROUNDS):
                share = q * w
                w = (share / share.sum(axis=1, keepdims=True) * n[:, None]).sum(axis=0) / n.sum()
            last = np.maximum(w, 1e-6) / np.maximum(w, 1e-6).sum()
        out[b] = last
    out[0] = np.array([0.0, out[0, 1], out[0, 2]]) / max(out[0, 1:].sum(), 1e-12)
    return out


def _scores(owners: int, n: int, v: int, weights):
    def run(key, left, right):
        import numpy as np
        import pyarrow as pa

        names = [x.split()[0] for x in SCORED.split(", ")]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        if not len(left):
            return pa.table([pa.array([], t) for t in kinds], names=names)
        (_, at, before, pairs, _, sizes, folds), keys, (words, both) = _meet(left, right, owners)
        c1, c = words[0][at], words[0][before]
        c2 = both[0][np.searchsorted(keys, pairs)]
        w = weights[bucket(c)]
        p = w[:, 0] * c2 / np.maximum(c, 1) + w[:, 1] * c1 / max(n, 1) + w[:, 2] / (v + 1)
        base = np.log10((words[0] + 0.1) / (n + 0.1 * (v + 1)))[at]
        row = left.select(["ids", "nulls"]).to_pylist()[0]
        nulls = np.unpackbits(np.frombuffer(row["nulls"], np.uint8), count=len(sizes)).astype(bool)
        cols = [pa.array(np.frombuffer(row["ids"], np.int64), mask=nulls), pa.array(folds.astype(np.int32)), pa.array(sizes), pa.array(common.group_sums((c1 > 0).astype(np.int64), sizes)), pa.array(np.full(len(sizes), n)), pa.array(np.add.reduceat(base, np.cumsum(sizes) - sizes)), pa.array(np.add.reduceat(np.log10(p), np.cumsum(sizes) - sizes))]
        return pa.table(cols, names=names)

    return run


def score(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per row of docs: doc_id, fold, n_tokens, n_known, train_tokens, base_score, score.

    Fold 0 isn't learned from.  A null text counts as empty: its only token is the end.  Rows with a null id are in fold 0;
    repeated rows count as often as they occur and get equal scores; an empty table gives no row; if there is
    nothing to learn from, N and V are 0 and the scores follow from that.  Other columns are ignored.  A chunk
    holds one text at least, so memory grows with the longest text, not with the corpus.  The result is a written
    table; chunks and answers are gone from the scratch folder when it is there.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("fold", common.crc_fold(F.col("doc_id"), FOLDS).cast("int"))
    common.bounded_batches(docs.sparkSession)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    owners = max(common.shuffle_partitions(spark), -(-size // chunk_bytes))
    with common.scratch(spark), common.bucketed(rows.mapInArrow(_chunks(chunk_bytes), _CHUNK), "op6_chunks", "chunk", owners, ordered=False) as chunks:
        asked = chunks.mapInArrow(_requests(owners), _ASK)
        answers = common.materialize(asked.groupBy("owner").applyInArrow(_answers(owners), _ANSWER), "op6-answers")
        totals = answers.filter("chunk = -1").agg(F.sum("total"), F.sum("held_total"), F.sum("types")).first()
        n, held, v = (x or 0 for x in totals)
        replies = answers.filter("chunk >= 0").select("chunk", "owner", "kind", "counts", "held")
        meet = lambda f, schema: chunks.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(f, schema)
        events = meet(_events(owners, n - held), "b int, e2 int, e1 int, n long").groupBy("b", "e2", "e1").agg(F.sum("n").alias("n")).collect()
        weights = learn_weights([tuple(r) for r in events], v)
        return common.result(meet(_scores(owners, n, v, weights), SCORED), "op6-scores")


def op6_lm_scoring(spark, sf_dir: str) -> DataFrame:
    found = score(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", (F.col("fold") == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
