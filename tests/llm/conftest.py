import random

import pytest

SYLLABLES = ("the", "an", "re", "ing", "on", "at", "ed", "er", "ou", "st")


@pytest.fixture(scope="session")
def prose():
    """prose(seed, words) gives a text of invented words in sentences and lines."""

    def make(seed, words=60):
        r = random.Random(seed)
        out = []
        for i in range(words):
            out.append("".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4))) + ("." if r.random() < 0.1 else ""))
            out.append("\n" if r.random() < 0.06 else " ")
        return "".join(out).strip()

    return make


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark, prose):
    """Documents with nulls in every column, empty and long texts, ties, copies, repeated rows, and columns with clashing names."""
    base = [prose(i, 40 + 5 * i) for i in range(12)]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(base)]
    rows += [(20, base[0], "en", None, None), (21, base[0], None, "s1", 3), (22, base[3] + " x", "de", "s2", 1)]
    rows += [(30, None, None, None, None), (31, "", "en", "s1", 0), (32, " \t\n", "en", "s1", 3), (33, "!!! 123", "en", "s1", 7), (None, base[5], "en", "s1", 5), (None, None, None, None, None)]
    rows += [(40, "one", "en", "s0", 3), (41, "one two", "en", "s0", 7), (42, "Ünïcödé ñandú 漢字 \U0001f600", "es", "s0", 9)]
    rows += [(50, "same row again\nand again", "en", "s0", 5)] * 3 + [(51, prose(99, 20000), "en", "s2", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    return df.selectExpr("*", "doc_id AS h", "text AS t", "1 AS size", "'x' AS owner", "2 AS block", "3 AS fp", "4 AS uid", "'q' AS row", "5 AS fold", "6 AS at").repartition(3)


@pytest.fixture(scope="session")
def none(spark, odd):
    return spark.createDataFrame([], odd.schema)


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def rows():
    return texts
