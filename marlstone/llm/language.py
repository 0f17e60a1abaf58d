"""Language identification by interpolated Kneser-Ney character models.

One character model of order ORDER per language, learned from at most SAMPLE documents of each.  The n-grams
of all languages share one sorted array of 64-bit hashes per order, beside a matrix of each language's
interpolated log-probabilities; an n-gram that no language has seen falls back to the next order with the
back-off mass of its context.  The language of lowest cross-entropy per character wins.  A document is rejected if
that cross-entropy is above what documents of the language show, given its length; the limit is calibrated on
sampled documents that the counts didn't see.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

ORDER = 4
#: Documents per language that a model is fitted on, about, at most; a fifth of them calibrates the rejection.
SAMPLE = 600
FOLDS = 5
#: Rejection: deviations beyond QUANTILE of the calibration documents' by the factor MARGIN.
QUANTILE, MARGIN = 0.999, 2.5
#: Symbols for letters; a sample of more distinct letters has some share a symbol, and none is lost.
SYMBOLS = 65534
#: Characters over which the deviation is taken to be the same; longer documents deviate as one over the root.
STEADY = 400
UNDETERMINED = "und"

PREDICTED = "doc_id long, lang_pred string, score double, cross_entropy double, letters long, rejected boolean"


def letter_table():
    """Code point -> code point of its lower case if it is a letter, else of a space."""
    import numpy as np

    out = np.full(0x110000, 32, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 and low.isalpha() else i
    return out


def code_points(text: str):
    import numpy as np

    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def squeeze(x, space):
    """Drops spaces that follow a space; a space is put in front and behind."""
    import numpy as np

    x = np.concatenate([[space], x, [space]]).astype(x.dtype)
    keep = np.ones(len(x), bool)
    keep[1:] = (x[1:] != space) | (x[:-1] != space)
    return x[keep]


class Model:
    """Symbols are dense: 0 a letter not in the sample, 1 space, then the letters of the sample; an n-gram is its symbols, 16 bits each."""

    def __init__(self, letters, languages: list[str]) -> None:
        import numpy as np

        known = np.unique(letters)
        known = known[known != 32]
        self.languages, self.size = languages, min(len(known), SYMBOLS) + 2
        table = letter_table()
        ids = np.zeros(0x110000, np.uint16)
        ids[known] = np.arange(len(known)) % SYMBOLS + 2
        ids[32] = 1
        self.ids = ids[table]

    def symbols(self, text: str):
        return squeeze(self.ids[code_points(text)], 1)

    @staticmethod
    def grams(symbols, order: int = ORDER):
        """The n-gram that ends at each symbol but the first; what lies before the text is spaces."""
        import numpy as np

        x = np.concatenate([np.ones(order - 2, np.uint64), symbols.astype(np.uint64)])
        n = len(symbols) - 1
        out = np.zeros(n, np.uint64)
        for j in range(order):
            out = (out << np.uint64(16)) | x[j : j + n]
        return out

    def fit(self, samples: list[list]) -> None:
        """samples: per language, the symbol arrays of its documents."""
        import numpy as np

        low = [np.uint64((1 << 16 * n) - 1) for n in range(ORDER + 1)]
        chains = []
        for docs in samples:
            top = np.concatenate([self.grams(d) for d in docs] or [np.zeros(0, np.uint64)])
            counts = {ORDER: np.unique(top, return_counts=True)}
            for n in range(ORDER - 1, 0, -1):  # continuation counts: in how many longer n-grams it is the end
                counts[n] = np.unique(counts[n + 1][0] & low[n], return_counts=True)
            chain = {}
            for n, (keys, c) in counts.items():
                one, two = (c == 1).sum(), (c == 2).sum()
                discount = one / (one + 2 * two) if one else 0.5
                heads = keys >> np.uint64(16)
                ctx, at = np.unique(heads, return_inverse=True)
                total = np.bincount(at, c, len(ctx))
                chain[n] = keys, c, discount, ctx, total, discount * np.bincount(at, minlength=len(ctx)) / np.maximum(total, 1)
            chains.append(chain)

        def look(sorted_keys, values, keys, default):
            if not len(sorted_keys):
                return np.full(len(keys), default, float)
            at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
            return np.where(sorted_keys[at] == keys, values[at], default)

        def prob(chain, n, keys):
            if n == 0:
                return np.full(len(keys), 1.0 / self.size)
            grams, c, discount, ctx, total, mass = chain[n]
            heads = keys >> np.uint64(16)
            all_ = look(ctx, total, heads, 0.0)
            seen = np.maximum(look(grams, c, keys, 0.0) - discount, 0.0) / np.maximum(all_, 1.0)
            return np.where(all_ > 0, seen, 0.0) + np.where(all_ > 0, look(ctx, mass, heads, 1.0), 1.0) * prob(chain, n - 1, keys & low[n - 1])

        self.tables, self.backs = {}, {}
        for n in range(1, ORDER + 1):
            keys = np.unique(np.concatenate([ch[n][0] for ch in chains]))
            self.tables[n] = self._hashed(keys, np.stack([np.log(prob(ch, n, keys)) for ch in chains], axis=1))
            ctx = np.unique(np.concatenate([ch[n][3] for ch in chains]))
            self.backs[n] = self._hashed(ctx, np.stack([np.log(np.maximum(look(ch[n][3], ch[n][5], ctx, 1.0), 1e-12)) for ch in chains], axis=1))
        self.floor = float(-np.log(self.size))

    @staticmethod
    def _hashed(keys, rows):
        import numpy as np

        h = common.mix64(keys)
        order = np.argsort(h)
        return h[order], rows[order].astype(np.float32)

    def _prob(self, n: int, keys):
        import numpy as np

        if n == 0:
            return np.full((len(keys), len(self.languages)), self.floor, np.float32)
        h, rows = self.tables[n]
        q = common.mix64(keys)
        at = np.minimum(np.searchsorted(h, q), max(0, len(h) - 1))
        out = rows[at] if len(h) else np.zeros((len(keys), len(self.languages)), np.float32)
        miss = np.flatnonzero(h[at] != q) if len(h) else np.arange(len(keys))
        if len(miss):
            lost = keys[miss]
            mass_h, mass = self.backs[n]
            q = common.mix64(lost >> np.uint64(16))
            back = np.zeros((len(miss), len(self.languages)), np.float32)
            if len(mass_h):
                at = np.minimum(np.searchsorted(mass_h, q), len(mass_h) - 1)
                hit = mass_h[at] == q
                back[hit] = mass[at[hit]]
            out[miss] = back + self._prob(n - 1, lost & np.uint64((1 << 16 * (n - 1)) - 1))
        return out

    def cross_entropies(self, texts: list, step: int = 500_000):
        """(documents, languages) nats per symbol, and the letters of each document; a text longer than step goes in parts."""
        import numpy as np

        sums = np.zeros((len(texts), len(self.languages)))
        sizes, letters = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        held, owners, run = [], [], 0

        def flush():
            nonlocal held, owners, run
            if held:
                logs = self._prob(ORDER, np.concatenate(held)).astype(np.float64)
                ends = np.cumsum([len(x) for x in held])
                for o, a, b in zip(owners, [0, *ends[:-1].tolist()], ends.tolist()):
                    sums[o] -= logs[a:b].sum(axis=0)
            held, owners, run = [], [], 0

        for i, text in enumerate(texts):
            if not text:
                continue
            s = self.symbols(text)
            letters[i] = (s != 1).sum()
            g = self.grams(s)
            sizes[i] = len(g)
            for a in range(0, len(g), step):
                held.append(g[a : a + step])
                owners.append(i)
                run += len(held[-1])
                if run >= step:
                    flush()
        flush()
        return sums / np.maximum(sizes, 1)[:, None], letters

    def calibrate(self, texts: list, truth: list) -> None:
        """Mean cross-entropy of each language on documents of it, and the largest deviation that isn't rejected."""
        import numpy as np

        ce, letters = self.cross_entropies(texts)
        truth = np.array(truth)
        self.mean = np.array([ce[truth == j, j].mean() if (truth == j).any() else np.inf for j in range(len(self.languages))])
        own = ce[np.arange(len(truth)), truth] if len(truth) else np.zeros(0)
        deviation = (own - self.mean[truth]) * np.sqrt(letters + STEADY) if len(truth) else np.zeros(0)
        self.most = MARGIN * max(np.quantile(deviation, QUANTILE), 1.0) if len(deviation) else np.inf

    def decide(self, texts: list):
        import numpy as np

        ce, letters = self.cross_entropies(texts)
        best = ce.argmin(axis=1)
        low = ce[np.arange(len(texts)), best]
        score = 1 / np.exp(np.minimum(0.0, -(ce - low[:, None]) * letters[:, None])).sum(axis=1)
        rejected = (letters == 0) | ((low - self.mean[best]) * np.sqrt(letters + STEADY) > self.most)
        return best, score, low, letters, rejected


def fit(docs: DataFrame, *, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """A model learned from rows whose lang isn't null and whose id isn't in fold 0: of each language about
    `sample` documents, chosen by a hash of the id, whole.  None if there is no such row."""
    import numpy as np

    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (common.crc_fold(F.col("doc_id"), FOLDS) != 0))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return None
    scale = 1 << 30
    limits = spark.createDataFrame([(k, min(scale, round(sample / n * scale))) for k, n in counts.items()], "lang string, most long")
    drawn = rows.join(F.broadcast(limits), "lang").withColumn("draw", F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(scale)))  # one row per language
    got = drawn.filter("draw < most").select("doc_id", "text", "lang", (F.pmod(F.xxhash64("doc_id", F.lit("calibration")), F.lit(5)) == 0).alias("aside")).collect()
    languages = sorted(counts)
    got.sort(key=lambda r: (r["doc_id"], r["text"]))
    learn = [r for r in got if not r["aside"]] or got
    aside = [r for r in got if r["aside"]] or got
    table = letter_table()
    model = Model(np.unique(np.concatenate([np.unique(table[code_points(r["text"])]) for r in learn] or [np.zeros(0, np.uint32)])), languages)
    place = {k: i for i, k in enumerate(languages)}
    samples: list[list] = [[] for _ in languages]
    for r in learn:
        samples[place[r["lang"]]].append(model.symbols(r["text"]))
    model.fit(samples)
    model.calibrate([r["text"] for r in aside], [place[r["lang"]] for r in aside])
    del got, learn, aside, samples
    common.trim()
    return model


def _predictor(shared):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        model = shared.value
        for batch in batches:
            for part in common.slices(batch, "text"):
                best, score, low, letters, rejected = model.decide(part.column("text").to_pylist())
                und = letters == 0
                names = [UNDETERMINED if u else model.languages[b] for u, b in zip(und, best)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(names, pa.string()), pa.array(np.where(und, 0.0, score)), pa.array(low, mask=und), pa.array(letters), pa.array(rejected)],
                    [x.split()[0] for x in PREDICTED.split(", ")],
                )

    return run


def identify(docs: DataFrame, model: Model | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, lang_pred, score, cross_entropy, letters, rejected.

    A null text, and one without a letter, is `und` with score 0 and rejected; the whole text counts, however
    long; null ids stay; repeated rows get equal values; of languages that tie the first by name wins; an empty
    table gives no row.  Without a model (nothing to learn from) every document is `und`.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    if model is None:
        return rows.select("doc_id", F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("cross_entropy"), F.lit(0).cast("long").alias("letters"), F.lit(True).alias("rejected"))
    common.bounded_batches(docs.sparkSession)
    return rows.mapInArrow(_predictor(docs.sparkSession.sparkContext.broadcast(model)), PREDICTED)


def keep_identified(docs: DataFrame, model: Model | None, *, text_col: str = "text") -> DataFrame:
    """docs without the rows whose language is rejected; without a model nothing is known of any, and all stay.

    Null texts and those without a letter are rejected; null ids and repeated rows stay; an empty table gives no row."""
    if model is None:
        return docs
    common.bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in common.slices(batch, text_col):
                yield part.filter(pa.array(~shared.value.decide(part.column(text_col).to_pylist())[4]))

    return docs.mapInArrow(run, docs.schema)


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    found = identify(docs, fit(docs))
    return found.select("doc_id", (common.crc_fold(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")
