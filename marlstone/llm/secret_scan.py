"""Secret scans: pattern candidates, and a random forest that removes false positives.

Candidates are (1) private-key blocks, (2) values of MIN_VALUE characters on that follow a secret-like name and a
separator, whatever they are made of, and (3) other unbroken runs of token characters of MIN_LENGTH on.  A
candidate's features are its length and character shares, entropy, the log-likelihood of its character-class
transitions, the share of its letters that words of the corpus cover, and what the neighbouring words and the path
say.  A forest of randomised decision trees, grown on labelled findings, gives each candidate a probability;
findings below one half are false positives.  Not found: shorter values, values behind other names than KEYWORDS
that have white space or characters beyond RUN, and words of letters alone (lower-case or capitalised) without a
secret-like name, which nothing tells from prose.

Tables without labelled findings get them from `labelled_findings`, a generator of passwords, keys and tokens in
context, and of what is mistaken for them: placeholders and words behind the same names, addresses, hashes in
prose, versions, identifiers, paths.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MIN_LENGTH, MIN_VALUE = 12, 6
TREES, DEPTH, LEAST = 40, 10, 4
#: Labelled findings that a forest is grown on, at most.
LABELLED = 20_000
#: Words of the corpus in the dictionary, the most frequent ones of MIN_WORD letters on.
WORDS, MIN_WORD = 20_000, 4
#: Characters around a candidate whose words are looked at.
NEAR = 48

RUN = re.compile(rf"[A-Za-z0-9+/_=\-.@:$%~]{{{MIN_LENGTH},}}")
KEYWORDS = re.compile(r"passw(?:or)?d|passphrase|pwd|secret|token|api[_ -]?key|access[_ -]?key|auth(?!or)|credential|private[_ -]?key", re.I | re.A)
#: One of these is in all that KEYWORDS match, in lower case.
STEMS = ("pass", "pwd", "secret", "token", "key", "auth", "credential")
ASSIGNED = re.compile(rf"(?:{KEYWORDS.pattern})[A-Za-z0-9_\-]*[\"']?[ \t]*(?:=>|:=|=|:|[ \t]is[ \t])[ \t]*([\"'`]?)(\S{{{MIN_VALUE},}})", re.I | re.A)
BLOCK = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----(?:[A-Za-z0-9+/=\s:,]*-----END (?:[A-Z0-9]+ )*PRIVATE KEY-----)?")
HEX = re.compile(r"^[0-9a-f]+$")
ADDRESS = re.compile(r"^[^@\s]+@[^@\s]+\.[a-z]{2,}$|^https?:|^www\.", re.I)
#: Files that hold settings and keys.
PATH = re.compile(r"[\w./\-]+\.(?:py|js|go|rb|java|env|ya?ml|json|cfg|ini|sh|toml|conf|properties|pem|key)\b", re.I)

FINDINGS = "doc_id long, start long, stop long, candidate string, probability double"


def kinds(text: str) -> str:
    """Classes of characters: a lower, A upper, 0 digit, . other."""
    return "".join("a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else "." for c in text)


NAMES = ("length", "lower", "upper", "digits", "other", "entropy", "distinct", "transitions", "switches", "covered", "longest_letters", "hex", "address", "keyword_before", "assigned", "block", "quoted", "same", "path", "words_before")


def covered(value: str, words: frozenset) -> float:
    """Share of the value that words of the dictionary cover, the longest first at each place."""
    low, at, total = value.lower(), 0, 0
    while at < len(low):
        n = next((n for n in range(min(16, len(low) - at), MIN_WORD - 1, -1) if low[at : at + n] in words), 0)
        total, at = total + n, at + max(n, 1)
    return total / max(1, len(low))


def features(value: str, name: str, before: str, after: str, path: str, words: frozenset) -> list[float]:
    from collections import Counter
    from math import log, log2

    n, ks = max(1, len(value)), kinds(value)
    share, letters = Counter(ks), Counter(value)
    entropy = -sum(c / n * log2(c / n) for c in letters.values())
    pairs = Counter(zip(ks, ks[1:]))
    moves = sum(c for (a, b), c in pairs.items() if a != b)
    likely = sum(c * log(c / max(1, share[a])) for (a, _), c in pairs.items()) / n
    longest = max((len(x) for x in re.findall(r"[A-Za-z]+", value)), default=0)
    # Only the last words before count, so that a keyword far off says nothing.
    tail = " ".join(before.split()[-3:])
    return [
        n, share["a"] / n, share["A"] / n, share["0"] / n, share["."] / n, entropy, len(letters) / n, likely, moves / n, covered(value, words), longest / n,
        float(bool(HEX.match(value))), float(bool(ADDRESS.match(value))), float(bool(KEYWORDS.search(tail))), float(name == "assigned"), float(name == "block"),
        float(before[-1:] in ("\"", "'", "`") and before[-1:] == after[:1]), max(letters.values(), default=0) / n, float(bool(PATH.search(path) or PATH.search(before))), float(len(re.findall(r"[a-zA-Z]{2,}", before))),
    ]


def candidates(text: str):
    """(start, stop, value, kind, before, after) of each candidate of the whole text."""

    def found(start: int, stop: int, kind: str):
        return start, stop, text[start:stop], kind, text[max(0, start - NEAR) : start], text[stop : stop + NEAR]

    taken = []
    for m in BLOCK.finditer(text):
        taken.append((*m.span(), "block"))
    low = text.lower()
    for m in ASSIGNED.finditer(text) if any(stem in low for stem in STEMS) else ():
        value, quote = m.group(2), m.group(1)
        end = value.find(quote) if quote else -1
        value = value[:end] if end >= 0 else value.rstrip("\"'`.,;)]}>")
        if len(value) >= MIN_VALUE and not any(a <= m.start(2) < b for a, b, _ in taken[-1:]):
            taken.append((m.start(2), m.start(2) + len(value), "assigned"))
    taken.sort()
    at = 0
    for m in RUN.finditer(text):
        while at < len(taken) and taken[at][1] <= m.start():
            at += 1
        if at < len(taken) and taken[at][0] < m.end():
            continue  # part of an assigned value or a block
        run = m.group()
        value = run.strip(".,:;-=")
        bare = value.strip("_/+%$@~")
        if len(value) >= MIN_LENGTH and not (bare.isalpha() and not (bare.isupper() or bare[1:].lower() != bare[1:])):
            yield found(m.start() + run.index(value), m.start() + run.index(value) + len(value), "run")
    for start, stop, kind in taken:
        yield found(start, stop, kind)


class Forest:
    """Random trees by Gini impurity over bootstrap samples and random subsets of features; arrays of nodes."""

    def fit(self, x, y, *, trees: int = TREES, depth: int = DEPTH, seed: int = 7):
        import numpy as np

        rng = np.random.default_rng(seed)
        some = max(1, round(x.shape[1] ** 0.5))
        self.trees = []
        for _ in range(trees):
            rows = rng.integers(0, len(x), len(x))
            nodes: list[list] = []

            def grow(at, level):
                me = len(nodes)
                nodes.append([-1, 0.0, 0, 0, float((y[at].sum() + 0.5) / (len(at) + 1))])
                if level == depth or len(at) < 2 * LEAST or y[at].min() == y[at].max():
                    return me
                best = (1e9, -1, 0.0)
                for f in rng.permutation(x.shape[1])[:some]:
                    v = x[at, f]
                    order = np.argsort(v, kind="stable")
                    v, t = v[order], y[at][order]
                    ones, n = np.cumsum(t)[:-1], np.arange(1, len(t))
                    cut = (v[1:] > v[:-1]) & (n >= LEAST) & (len(t) - n >= LEAST)
                    if cut.any():
                        rest, m = t.sum() - ones, len(t) - n
                        gini = np.where(cut, ones * (n - ones) / n + rest * (m - rest) / m, 1e9)
                        i = int(gini.argmin())
                        if gini[i] < best[0]:
                            best = (gini[i], int(f), float((v[i] + v[i + 1]) / 2))
                if best[1] < 0:
                    return me
                left = x[at, best[1]] <= best[2]
                nodes[me][:2] = [best[1], best[2]]
                nodes[me][2] = grow(at[left], level + 1)
                nodes[me][3] = grow(at[~left], level + 1)
                return me

            grow(rows, 0)
            self.trees.append(tuple(np.array(c) for c in zip(*nodes)))
        return self

    def predict(self, x):
        import numpy as np

        total = np.zeros(len(x))
        for feature, cut, left, right, value in self.trees:
            at = np.zeros(len(x), np.int64)
            while (inner := feature[at] >= 0).any():
                f = feature[at[inner]]
                goes = x[np.flatnonzero(inner), f] <= cut[at[inner]]
                at[inner] = np.where(goes, left[at[inner]], right[at[inner]])
            total += value[at]
        return total / len(self.trees)


def dictionary(docs: DataFrame, *, text_col: str = "text", words: int = WORDS) -> frozenset:
    """The most frequent words of letters, MIN_WORD to 16 of them, over all documents: those above the lowest frequency
    (in steps of an eighth of an octave) that at most `words` words reach.  The driver gets these alone."""
    found = docs.select(F.explode(F.split(F.lower(text_col), "[^\\p{L}]+")).alias("w")).filter(F.length("w").between(MIN_WORD, 16))
    level = F.floor(8 * F.log2("count")).cast("int")
    with common.scratch(docs.sparkSession):
        counts = common.materialize(found.groupBy("w").count().select("w", level.alias("level")), "op9-words")
        least, total = None, 0
        for r in sorted(counts.groupBy("level").count().collect(), key=lambda r: -r["level"]):  # some hundred levels
            if (total := total + r["count"]) > words:
                break
            least = r["level"]
        return frozenset() if least is None else frozenset(r["w"] for r in counts.filter(F.col("level") >= least).collect())


def labelled_findings(n: int = 6000, seed: int = 11, words: frozenset = frozenset()) -> list[tuple]:
    """(text, path, start of the candidate, label): secrets in context, and what is mistaken for them."""
    import random
    import string

    r = random.Random(seed)
    pick = lambda alphabet, k: "".join(r.choice(alphabet) for _ in range(k))
    upper, hexa, mixed = string.ascii_uppercase + string.digits, "0123456789abcdef", string.ascii_letters + string.digits
    known = sorted(words) or ["river", "stone", "table", "green", "window", "number", "letter", "paper", "value", "about", "winter", "garden"]
    word = lambda: r.choice(known)
    joined = lambda low, high: "".join(word() for _ in range(r.randint(low, high)))
    prose = lambda: " ".join(word() for _ in range(r.randint(0, 9)))
    keys = ("password", "passwd", "pwd", "token", "secret", "api_key", "access_key", "auth_token", "client_secret", "passphrase", "db_password", "credential", "PASSWORD", "Token")
    between = ("=", ":", " = ", ": ", ' = "', '="', " = '", ": '", " is ")
    made = (  # as people make passwords
        lambda: joined(1, 2) + str(r.randint(1, 9999)), lambda: word().capitalize() + pick("!@#$%&*", r.randint(1, 2)) + pick(string.digits, r.randint(1, 4)), lambda: joined(1, 2).translate(str.maketrans("aeios", "43105")) + pick("!$#", r.randint(0, 2)),
        lambda: pick(string.ascii_lowercase, r.randint(8, 20)), lambda: joined(2, 4), lambda: word()[:5] + str(r.randint(1, 99)) + pick(string.ascii_lowercase, 3), lambda: pick(mixed + "!@#$%^&*?+", r.randint(8, 24)), lambda: "".join(sorted(pick(string.ascii_lowercase, 16))),
    )
    drawn = (lambda: pick(hexa, r.choice((16, 18, 32, 40, 64))), lambda: pick(mixed, r.randint(12, 40)), lambda: pick(mixed + "+/", r.randint(20, 44)) + r.choice(("", "=", "==")), lambda: pick(upper, r.randint(16, 24)))
    issued = (lambda: pick(string.ascii_lowercase, r.randint(2, 4)) + r.choice("_-") + pick(mixed, r.randint(20, 40)), lambda: pick(string.ascii_uppercase, 4) + pick(upper, 16), lambda: f"{pick(mixed, 20)}.{pick(mixed, 30)}.{pick(mixed + '_-', 40)}", lambda: f"{pick(string.ascii_lowercase, 4)}-{pick(string.digits, 12)}-{pick(mixed, 24)}")
    empty = ("your_password_here", "changeme", "xxxxxxxx", "example", "<redacted>", "********", "required", "null,null", "undefined", "${PASSWORD}", "process.env.TOKEN", "os.environ['SECRET']", "...........", "{{ token }}", "string", "optional", "get_password()", "config.secret")
    wrong = (
        lambda: ("", f"{word()}.{word()}{r.randint(1, 99)}@{word()}{r.randint(1, 99)}.example.com"), lambda: ("", f"https://www.{word()}.org/{word()}/{r.randint(1, 9999)}"),
        lambda: (r.choice(("commit ", "sha1 ", "checksum ", "md5 ", "")), pick(hexa, r.choice((32, 40, 64)))), lambda: ("", f"{word()}-{word()}-{word()}-{word()}"), lambda: ("", f"{word()}.{word()}.{word()}"),
        lambda: ("", f"{r.randint(1900, 2100)}-{r.randint(10, 12)}-{r.randint(10, 28)}T{r.randint(10, 23)}:{r.randint(10, 59)}:00"), lambda: ("", f"/usr/{word()}/{word()}/{word()}.txt"), lambda: ("", f"{word()}_{word()}_{r.randint(1, 99)}"), lambda: ("", f"+{pick(string.digits, 12)}"),
        lambda: ("", f"{pick(hexa, 8)}-{pick(hexa, 4)}-{pick(hexa, 4)}-{pick(hexa, 4)}-{pick(hexa, 12)}"), lambda: ("", "-" * r.randint(12, 40)), lambda: ("", f"version-{r.randint(1, 20)}.{r.randint(1, 20)}.{r.randint(1, 2000)}-build"), lambda: ("", joined(2, 4).upper()),
    )
    out = []
    for _ in range(n):
        path = r.choice(("src1", "docs/a.md", "web", "conf/app.env", "main.py", "pages", "notes"))
        head, tail, way, lead = prose(), prose(), r.random(), r.choice(keys) + r.choice(between)
        if way < 0.38:
            value, label = r.choice(made if r.random() < 0.5 else drawn + issued)(), 1
        elif way < 0.48:
            lead, value, label = "", r.choice(issued)(), 1
        elif way < 0.52:
            lead, value, label = "", f"-----BEGIN {r.choice(('RSA ', 'EC ', 'OPENSSH ', ''))}PRIVATE KEY-----", 1
        elif way < 0.72:
            value, label = (r.choice(empty) if r.random() < 0.7 else word()), 0
        else:
            (lead, value), label = r.choice(wrong)(), 0
        text = f"{head} {lead}" if head else lead
        close = lead[-1:] if lead[-1:] in "\"'" else ""
        out.append((text + value + close + " " + tail, path, len(text), label))
    return out


def train(findings: list[tuple], words: frozenset = frozenset(), *, labelled: int = LABELLED) -> Forest:
    """A forest grown on findings (text, path, start of the candidate, label): of more than `labelled` those with the
    smallest hashes.  Findings that are no candidate can't be learned from."""
    import zlib

    import numpy as np

    if len(findings) > labelled:
        findings = sorted(findings, key=lambda f: (zlib.crc32(f"{f[0]}|{f[1]}|{f[2]}".encode()), f[0], f[2]))[:labelled]
    x, y = [], []
    for text, path, at, label in findings:
        for start, stop, value, kind, before, after in candidates(text):
            if start <= at < stop:
                x.append(features(value, kind, before, after, path, words))
                y.append(label)
    forest = Forest().fit(np.array(x), np.array(y, float))
    forest.words = words
    return forest


def _scan(shared, least: float):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        forest = shared.value
        for batch in batches:
            ids, paths = batch.column("doc_id").to_pylist(), batch.column("path").to_pylist()
            rows, x = [], []

            def found():
                p = forest.predict(np.array(x, float).reshape(len(x), len(NAMES)))
                keep = [(*r, float(q)) for r, q in zip(rows, p) if q >= least]
                cols = list(zip(*keep)) or [()] * 5
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64()])], [n.split()[0] for n in FINDINGS.split(", ")])

            for doc, path, text in zip(ids, paths, batch.column("text")):
                for start, stop, value, kind, before, after in candidates(text.as_py() or ""):
                    rows.append((doc, start, stop, value))
                    x.append(features(value, kind, before, after, path or "", forest.words))
                if len(rows) >= 20_000:
                    yield found()
                    rows, x = [], []
            if rows:
                yield found()

    return run


def scan(docs: DataFrame, forest: Forest, *, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """One row per finding: doc_id, start, stop (characters), candidate, probability; findings below `least` are
    removed as false positives (0 keeps them).

    Null and empty texts have no finding; a null path says nothing; null ids stay; repeated rows have repeated
    findings; whole texts are searched; an empty table gives no row; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(path_col).cast("string").alias("path"))
    common.bounded_batches(docs.sparkSession)
    return rows.mapInArrow(_scan(docs.sparkSession.sparkContext.broadcast(forest), least), FINDINGS)


def op9_secret_scan(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    words = dictionary(docs)
    return scan(docs, train(labelled_findings(words=words), words))
