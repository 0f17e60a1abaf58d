"""Toxicity by a linear-chain conditional random field over words.

Two tags, clean and toxic.  The field has weights for words, for word beginnings of three to six bytes, for a word
with the one before it, and for the tag pairs.  The labels mark documents, not words, so the tags are learned:

1. To begin with, words get tags by contrast: in a document labelled toxic, the words (or beginnings, or pairs of
   words) that training documents labelled toxic have far more often than others are toxic; all else is clean.
   The field is fitted to windows of these words.
2. Then part of the tags are hidden.  In a document labelled clean all words are clean.  In one labelled toxic, listed
   words that the field now finds toxic stay so, and listed words that it doesn't, and words with features that are
   more frequent in toxic documents, but less so, may be either; a document has at least one toxic word, unless its
   label is wrong (NOISE).  Each step of expectation-maximisation takes the expected tags under these conditions, by
   forward-backward over the tag sequences, and moves the weights towards them.

Forward-backward marginals of the whole text give each word's probability; a document's score is a logistic function
of their largest and their sum, and runs of words above one half are the offending spans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

FOLDS = 5
#: Labelled documents of each class that the field is fitted on, about, at most.
SAMPLE = 1000
PREFIXES = (3, 4, 5, 6)
#: A feature is contrastive from so many toxic documents and such a share of them on, and at so many nats of log odds.
LEAST_DOCS, LEAST_SHARE, LEAST_ODDS = 3, 0.01, 3.0
#: Log odds from which on a feature of so many documents gets a weight, though its words don't begin as toxic.
WIDE_ODDS = 1.0
WINDOW = 48
#: Steps on the tags of the contrast list, and steps with hidden tags.
ROUNDS, HIDDEN_ROUNDS = 40, 40
#: Tags of words: hidden ones are learned.  NOISE is the share of clean documents labelled toxic that the fit allows for.
CLEAN, TOXIC, HIDDEN = 0, 1, 2
NOISE = 0.05
#: Near copies among labelled documents: minimal hashes, of which so many agree, found by bands of so many.
MINIMAL, AGREEING, BAND = 32, 20, 4
_BEFORE = 0xC2B2AE3D27D4EB4F  # fixed odd multiplier

SCORED = "doc_id long, score double, toxic_words long, span_starts array<long>, span_ends array<long>"


def features(data, ends, rolling):
    """Hashes of each word, of its beginnings, and of the word with the one before it in its text, (words,
    2 + len(PREFIXES)); 0 where a word is shorter or the first.  Also the words' byte ranges and the number of words
    per text.  A-Z is lower-cased, and ASCII punctuation at a word's ends is left out."""
    import numpy as np

    low = common.lower_ascii(data)
    starts, stops, counts = common.words(low, ends)
    plain = np.ones(256, bool)
    plain[[i for i in range(33, 127) if not chr(i).isalnum()]] = False
    for _ in range(2):
        starts = starts + (~plain[low[starts]] & (stops - starts > 1) if len(starts) else 0)
        stops = stops - (~plain[low[stops - 1]] & (stops - starts > 1) if len(stops) else 0)
    out = common.hash_words(low, starts, stops, rolling, PREFIXES)
    pairs = np.zeros((len(out), 1), np.uint64)
    if len(out):
        pairs[1:, 0] = common.mix64(out[:-1, 0] * np.uint64(_BEFORE) + out[1:, 0])
        pairs[(np.cumsum(counts) - counts)[counts > 0]] = 0
    return np.concatenate([out, pairs], axis=1), starts, stops, counts


def chain_products(m, start):
    """start * m[0] * ... * m[i] for each i, scaled to sum 1: m is (n, 2, 2), the result (n, 2).

    Runs of 32 are multiplied side by side, their products chained by the same function, so the work is linear
    and the loops are of length 32."""
    import numpy as np

    n, size = len(m), 32
    if n <= size:
        out, v = np.empty((n, 2)), start
        for i in range(n):
            v = v @ m[i]
            v = v / v.sum()
            out[i] = v
        return out
    runs = -(-n // size)
    full = np.empty((runs * size, 2, 2))
    full[:n] = m
    full[n:] = np.eye(2)
    full = full.reshape(runs, size, 2, 2)
    p = full[:, 0].copy()
    for j in range(1, size):
        q = full[:, j]
        a = p[:, :, 0, None] * q[:, None, 0, :] + p[:, :, 1, None] * q[:, None, 1, :]
        p = a / a.sum(axis=(1, 2), keepdims=True)
    before = np.empty((runs, 2))
    before[0] = start
    before[1:] = chain_products(p[:-1], start)
    out, v = np.empty((runs, size, 2)), before
    for j in range(size):
        q = full[:, j]
        v = v[:, 0, None] * q[:, 0] + v[:, 1, None] * q[:, 1]
        v = v / v.sum(axis=1, keepdims=True)
        out[:, j] = v
    return out.reshape(-1, 2)[:n]


class Lattice:
    """The words of the training documents in windows of WINDOW, each a chain of its own (broken where a document ends)."""

    def __init__(self, tokens, docs, size: int) -> None:
        """tokens: (words, features) indexes, `size` for none; docs: the document of each word, ascending."""
        import numpy as np

        n = len(tokens)
        pads = -(-n // WINDOW) * WINDOW - n
        self.n, self.size, self.docs = n, size, docs
        self.shape = ((n + pads) // WINDOW, WINDOW)
        self.some = np.flatnonzero((tokens < size).any(axis=1))  # the other words have the bias alone
        self.features = tokens[self.some]
        new = np.concatenate([[True], docs[1:] != docs[:-1], np.ones(pads, bool)])[: n + pads].reshape(self.shape)
        new[:, 0] = True
        self.new, self.pair = new, ~new

    def _gather(self, w):
        import numpy as np

        out = np.zeros(self.shape[0] * WINDOW)
        out[self.some] = np.append(w[: self.size], 0.0)[self.features].sum(axis=1)
        return out.reshape(self.shape)

    def _spread(self, x):
        import numpy as np

        x = x[self.some]
        return sum(np.bincount(self.features[:, j], x, self.size + 1) for j in range(self.features.shape[1]))[: self.size]

    def _padded(self, x):
        import numpy as np

        return np.concatenate([x, np.zeros(self.shape[0] * WINDOW - self.n)]).reshape(self.shape)

    def _chains(self, e, trans):
        """Scaled forward and backward vectors for the potentials e (windows, WINDOW, 2), and what alpha was divided by."""
        import numpy as np

        alpha, beta, norm = np.empty_like(e), np.ones_like(e), np.empty(self.shape)
        for i in range(WINDOW):
            v = e[:, i] * (1.0 if i == 0 else np.where(self.new[:, i, None], 1.0, alpha[:, i - 1] @ trans))
            norm[:, i] = v.sum(axis=1)
            alpha[:, i] = v / norm[:, i, None]
        for i in range(WINDOW - 2, -1, -1):
            v = np.where(self.new[:, i + 1, None], 1.0, (beta[:, i + 1] * e[:, i + 1]) @ trans.T)
            beta[:, i] = v / v.sum(axis=1, keepdims=True)
        return alpha, beta, norm

    def _expected(self, e, trans, weight, chains):
        """Weighted sums of the toxic marginals per word, and of the tag pairs."""
        import numpy as np

        alpha, beta, _ = chains
        p = alpha * beta
        p = p[..., 1] / p.sum(axis=2)
        pairs = np.zeros((2, 2))
        for i in range(1, WINDOW):
            both = alpha[:, i - 1, :, None] * trans * (beta[:, i] * e[:, i])[:, None, :]
            pairs += (both * (weight[:, i] * self.pair[:, i] / both.sum(axis=(1, 2)))[:, None, None]).sum(axis=0)
        return (weight * p).ravel()[: self.n], pairs

    def marginals(self, w):
        """The probability of toxic for each word, whatever is known of its tag."""
        import numpy as np

        e = np.ones((*self.shape, 2))
        e[..., 1] = np.exp(np.clip(self._gather(w) + w[self.size], -30, 30))
        trans = np.exp(w[self.size + 1 :].reshape(2, 2))
        return self._expected(e, trans, np.ones(self.shape), self._chains(e, trans))[0]

    def gradient(self, w, tags, labels):
        """The log-likelihood of the documents' tags and labels, hidden tags summed out, and its gradient.

        With P0 the probability, given the tags that are known, that all of a document's words are clean, and K = (1 - NOISE) * P0,
        the expected counts E of a document labelled 1 become (E - K * those of the clean sequence) / (1 - K)."""
        import numpy as np

        size, n = self.size, self.n
        e = np.ones((*self.shape, 2))
        e[..., 1] = np.exp(np.clip(self._gather(w) + w[size], -30, 30))
        trans = np.exp(w[size + 1 :].reshape(2, 2))

        def per_doc(x):
            return np.bincount(self.docs, x.ravel()[:n], len(labels))

        free = self._chains(e, trans)
        x, pairs = self._expected(e, trans, self._padded(-np.ones(n)), free)
        y = self._padded(tags)
        known = e * np.stack([y != TOXIC, y != CLEAN], axis=2)
        chains = self._chains(known, trans)
        with np.errstate(divide="ignore"):
            path = np.where(self.new, 0.0, w[size + 1]) + np.where(y == TOXIC, -np.inf, 0.0) - np.log(chains[2])
        k = np.where(labels == 1, (1 - NOISE) * np.exp(np.minimum(per_doc(path), 0.0)), 0.0)
        more, more_pairs = self._expected(known, trans, self._padded((1 / (1 - k))[self.docs]), chains)
        x, pairs = x + more, pairs + more_pairs
        pairs[0, 0] -= (k / (1 - k)) @ per_doc(self.pair)
        value = (per_doc(np.log(chains[2])) - per_doc(np.log(free[2])) + np.log1p(-k)).sum()
        return value, np.concatenate([self._spread(x), [x.sum()], pairs.reshape(-1)])


class Field:
    """keys: sorted feature hashes; weights: their pull to toxic; bias; trans: log-potentials of tag pairs."""

    def fit(self, tokens, listed, likely, docs, labels, hidden_rounds: int = HIDDEN_ROUNDS) -> None:
        """tokens: (words, features) indexes into keys, len(keys) for none; per word, whether the contrast list has it,
        whether a feature of it is likelier in toxic documents, and its document; labels per document."""
        import numpy as np

        size = len(self.keys)
        lattice = Lattice(tokens, docs, size)
        toxic = labels[docs] == 1
        w = np.zeros(size + 1 + 4)  # features, bias, trans

        def climb(w, tags, rounds, rate):
            mean, square = np.zeros_like(w), np.zeros_like(w)
            for t in range(1, rounds + 1):
                grad = lattice.gradient(w, tags, labels)[1] - 0.5 * w
                mean = 0.9 * mean + 0.1 * grad
                square = 0.99 * square + 0.01 * grad**2
                w = w + rate * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.99**t)) + 1e-9)
            return w

        w = climb(w, np.where(listed & toxic, TOXIC, CLEAN), ROUNDS, 0.25)
        tags = np.where((listed | likely) & toxic, HIDDEN, CLEAN)
        tags[listed & toxic & (lattice.marginals(w) >= 0.5)] = TOXIC
        w = climb(w, tags, hidden_rounds, 0.1)
        self.weights, self.bias, self.trans = np.append(w[:size], 0.0), w[size], np.exp(w[size + 1 :].reshape(2, 2))

    def places(self, hashes):
        """Indexes into keys, len(keys) if absent."""
        import numpy as np

        if not len(self.keys):
            return np.zeros(hashes.shape, np.int64)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, at, len(self.keys))

    def marginals(self, hashes, counts):
        """Probability of toxic for each word; counts: words per text."""
        import numpy as np

        n = len(hashes)
        if not n:
            return np.zeros(0)
        e = np.exp(np.clip(self.weights[self.places(hashes)].sum(axis=1) + self.bias, -30, 30))
        new = np.zeros(n + 1, bool)
        new[np.concatenate([[0], np.cumsum(counts)])] = True
        m = np.where(new[:n, None, None], 1.0, self.trans[None])
        m[:, :, 1] *= e[:, None]
        alpha = chain_products(m, np.ones(2) / 2)
        back = np.where(new[1:, None, None], 1.0, self.trans.T[None])
        after = np.append(e[1:], 1.0)
        back[:, 1, :] *= after[:, None]
        beta = chain_products(back[::-1], np.ones(2) / 2)[::-1]
        p = alpha * beta
        return p[:, 1] / p.sum(axis=1)

    def document(self, p, counts):
        """Largest marginal and sum of marginals of each text, as the inputs of the score."""
        import numpy as np

        total = common.group_sums(p, counts)
        top = np.zeros(len(counts))
        some = counts > 0
        if some.any():
            first = np.concatenate([[0], np.cumsum(counts)])[:-1][some]
            top[some] = np.maximum.reduceat(p, first)
        return np.stack([np.ones(len(counts)), top, np.log1p(total)], axis=1)

    def calibrate(self, x, y, shares) -> None:
        """Logistic regression of document labels by Newton steps, with a small ridge; shares: how many
        documents of the table a drawn one of each label stands for, so that scores follow the true proportion."""
        import numpy as np

        w, weight = np.zeros(x.shape[1]), np.asarray(shares, float)[y] / np.mean(np.asarray(shares, float)[y])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            h = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w))
            w = w + np.clip(np.linalg.solve(h, x.T @ (weight * (y - p)) - 0.1 * w), -2, 2)
        self.logistic = w

    def score(self, x):
        import numpy as np

        return 1 / (1 + np.exp(-np.clip(x @ self.logistic, -30, 30)))


def _draw(rows: DataFrame, sample: int) -> tuple[list, dict]:
    """Of each label, about `sample` rows by a hash of the id, and the number of rows of each label."""
    counts = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    scale = 1 << 30
    most = F.lit(0)
    for label in (0, 1):
        if counts.get(label):
            most = F.when(F.col("toxic") == label, min(scale, round(sample / counts[label] * scale))).otherwise(most)
    return rows.filter(F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(scale)) < most).collect(), counts


def distinct_documents(hashes: list) -> list[int]:
    """Indexes of one of each group of near copies, from the documents' word hashes: a document goes if AGREEING of
    MINIMAL minimal hashes of its three-word shingles are those of an earlier one.  Copies would make the words of one
    document look typical.  At a similarity of 0.8 a copy is found almost always, at 0.4 one document in 100 or fewer."""
    import numpy as np

    bands: dict = {}
    whole: set = set()
    out = []
    for i, h in enumerate(hashes):
        if len(h) < 3:
            if h.tobytes() not in whole:
                whole.add(h.tobytes())
                out.append(i)
            continue
        shingles = common.mix64(h[:-2] * np.uint64(3) + h[1:-1] * np.uint64(5) + h[2:] * np.uint64(7))
        signature = np.array([common.mix64(shingles ^ np.uint64(j)).min() for j in range(MINIMAL)])
        keys = [(j, signature[j : j + BAND].tobytes()) for j in range(0, MINIMAL, BAND)]
        earlier = {id(x): x for k in keys for x in bands.get(k, ())}
        if any((signature == x).sum() >= AGREEING for x in earlier.values()):
            continue
        out.append(i)
        for k in keys:
            bands.setdefault(k, []).append(signature)
    return out


def fit(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, hidden_rounds: int = HIDDEN_ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> Field | None:
    """A field learned from labelled documents outside fold 0; None if one of the classes has no document.

    Of labels of one id that disagree, toxic holds.  Null ids and labels other than 0 and 1 aren't learned from; rows of
    one id are all learned from, near copies once.  What the driver gets is about `sample` whole texts of each label.
    With `hidden_rounds` = 0 the field is that of the contrast list."""
    import numpy as np

    spark = docs.sparkSession
    known = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (common.crc_fold(F.col("doc_id"), FOLDS) != 0))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    drawn, all_ = _draw(known, sample)
    drawn = [(r["doc_id"], r["toxic"]) for r in drawn]
    if {t for _, t in drawn} != {0, 1}:
        return None
    chosen = spark.createDataFrame(drawn, "doc_id long, toxic int")  # 2 * sample rows, about
    got = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id").collect()
    if {r["toxic"] for r in got} != {0, 1}:
        return None
    got.sort(key=lambda r: (r["doc_id"], r["text"]))
    y = np.array([r["toxic"] for r in got])
    rolling = common.Rolling()

    def parts(step: int = 100):
        """Feature hashes, words per document and labels of the documents, some at a time: hashing again is cheaper than keeping."""
        for a in range(0, len(got), step):
            texts = [r["text"].encode() for r in got[a : a + step]]
            ends = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
            h, _, _, c = features(np.frombuffer(b"".join(texts), np.uint8), ends, rolling)
            yield h, c, y[a : a + step]

    single = distinct_documents([h[sum(c[:i]) : sum(c[: i + 1]), 0] for h, c, _ in parts() for i in range(len(c))])
    got, y = [got[i] for i in single], y[single]
    if y.min() == y.max():
        return None
    # Documents of either label that have a feature.
    found: list[list] = [[], []]
    for h, c, label in parts():
        doc = np.repeat(np.arange(len(c)), c)
        for t in (0, 1):
            for d in np.flatnonzero(label == t):
                found[t].append(np.unique(h[doc == d]))
    seen = [np.unique(np.concatenate(x), return_counts=True) for x in found]
    del found
    (clean_keys, clean), (keys, in_toxic) = seen
    in_clean = np.zeros(len(keys), np.int64)
    if len(clean_keys):
        at = np.minimum(np.searchsorted(clean_keys, keys), len(clean_keys) - 1)
        in_clean = np.where(clean_keys[at] == keys, clean[at], 0)
    odds = np.log((in_toxic + 0.5) / (y.sum() + 1)) - np.log((in_clean + 0.5) / ((1 - y).sum() + 1))
    often = (in_toxic >= max(LEAST_DOCS, LEAST_SHARE * y.sum())) & (keys != 0)
    strong, wide = keys[often & (odds >= LEAST_ODDS)], keys[often & (odds >= WIDE_ODDS)]

    def member(h, of):
        if not len(of):
            return np.zeros(h.shape, bool)
        return of[np.minimum(np.searchsorted(of, h), len(of) - 1)] == h

    # Tags of the words to begin with; the field's features are those of words tagged toxic that two documents have
    # at least, and all that toxic documents have more often.
    tagged = [(member(h, strong).any(axis=1), member(h, wide).any(axis=1), h, c) for h, c, _ in parts()]
    used = np.unique(np.concatenate([h[t & (np.repeat(label, c) == 1)].ravel() for (t, _, h, c), (_, _, label) in zip(tagged, parts())]))
    field = Field()
    field.keys = np.union1d(used[(used != 0) & member(used, keys[in_toxic + in_clean >= 2])], wide)
    listed, likely, counts = (np.concatenate([x[i] for x in tagged]) for i in (0, 1, 3))
    index = np.concatenate([field.places(h).astype(np.int32) for _, _, h, _ in tagged])
    del tagged
    field.fit(index, listed, likely, np.repeat(np.arange(len(got), dtype=np.int32), counts), y, hidden_rounds)
    x = np.concatenate([field.document(field.marginals(h, c), c) for h, c, _ in parts()])
    field.calibrate(x, y, [all_[t] / max(1, (y == t).sum()) for t in (0, 1)])
    return field


def _scorer(shared):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        field, rolling = shared.value, common.Rolling()
        for batch in batches:
            for part in common.slices(batch, "text", 2_000_000):
                data, ends = common.flat_bytes(part.column("text"))
                hashes, starts, stops, counts = features(data, ends, rolling)
                p = field.marginals(hashes, counts)
                score = field.score(field.document(p, counts))
                bad = p >= 0.5
                owner = np.repeat(np.arange(len(counts)), counts)[bad]
                place = np.flatnonzero(bad)
                new = np.ones(len(place), bool)
                if len(place):
                    new[1:] = (np.diff(place) > 1) | (np.diff(owner) > 0)
                last = np.append(new[1:], True) if len(place) else new
                where = ends[:-1][owner]
                sides = []
                spans = np.concatenate([[0], np.cumsum(np.bincount(owner[new], minlength=len(counts)))]).astype(np.int32)
                for x in ((starts[place] - where)[new], (stops[place] - where)[last]):
                    sides.append(pa.ListArray.from_arrays(pa.array(spans), pa.array(x.astype(np.int64))))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(score), pa.array(np.bincount(owner, minlength=len(counts))), *sides], [x.split()[0] for x in SCORED.split(", ")])

    return run


def tag(docs: DataFrame, field: Field | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, score, toxic_words, and the offending spans as byte offsets in UTF-8.

    Null and empty texts get the score of a text without words; the whole text counts; null ids stay; repeated
    rows get equal values; an empty table gives no row.  Without a field (a class without documents) the score
    is 0 and there are no spans.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    if field is None:
        empty = F.array().cast("array<long>")
        return rows.select("doc_id", F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("toxic_words"), empty.alias("span_starts"), empty.alias("span_ends"))
    common.bounded_batches(docs.sparkSession)
    return rows.mapInArrow(_scorer(docs.sparkSession.sparkContext.broadcast(field)), SCORED)


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    found = tag(docs, fit(docs, common.table(spark, sf_dir, "labels")))
    return found.select("doc_id", (common.crc_fold(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "toxic_words", F.size("span_starts").alias("spans"))
