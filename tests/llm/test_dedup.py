"""Exact dedup, line dedup and SimHash against brute force."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from xxhash import xxh64_intdigest

from marlstone.llm import common, golomb, lines, simhash
from marlstone.llm.exact_dedup import exact_dedup


@given(st.sets(st.integers(0, 2**64 - 1), min_size=1, max_size=200))
@settings(max_examples=50, deadline=None)
def test_golomb_round_trip(values):
    x = np.array(sorted(values), np.uint64)
    k, unary, rest = golomb.encode(x, 0, 1 << 64)
    assert (golomb.decode(len(x), k, unary, rest, 0) == x).all()


def test_golomb_is_small():
    x = np.unique(np.random.default_rng(1).integers(0, 2**63, 100_000, dtype=np.uint64))
    _, unary, rest = golomb.encode(x, 0, 1 << 63)
    entropy = len(x) * (math.log2(2**63 / len(x)) + math.log2(math.e)) / 8
    assert entropy * 0.99 < len(unary) + len(rest) < entropy * 1.02


@pytest.mark.parametrize("bits", [64, 3])
def test_exact_dedup(spark, odd, rows, bits):
    want = defaultdict(list)
    for i, t in rows(odd):
        want[t or ""].append(i)
    got = exact_dedup(odd, bits=bits).collect()
    assert len(got) == odd.count()
    sha = {hashlib.sha256(t.encode()).hexdigest(): t for t in want}
    kept = Counter()
    for r in got:
        ids = want[sha[r["text_sha256"]]]
        assert r["group_size"] == len(ids) and r["keep_id"] == max((i for i in ids if i is not None), default=None)
        kept[r["text_sha256"]] += r["kept"]
        assert not r["kept"] or r["doc_id"] == r["keep_id"]
    assert set(kept.values()) == {1}


def test_exact_dedup_of_nothing(none):
    assert exact_dedup(none).count() == 0


def test_exact_dedup_of_a_hot_group(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE 'd' || id END AS text").repartition(5)
    got = exact_dedup(docs)
    assert got.filter("kept").count() == 2001 and got.filter("text_sha256 = sha2('hot', 256) AND kept").first()["doc_id"] == 2997


# Lines


def brute_lines(docs):
    """(doc_id, line_no, removed) in order of id (null last), of a hash of the text, then of file order."""
    seen, out = [], []
    for i, t in docs:
        for n, line in enumerate(t.split("\n") if t is not None else []):
            ws = {w for w in line.lower().translate(str.maketrans("\t\r\x0b\x0c", "    ")).split(" ") if w}
            out.append((i, n, bool(ws) and any(5 * len(ws & s) >= 4 * len(ws | s) for s in seen)))
            if ws:
                seen.append(ws)
    return out


def edited(r, line, edits):
    ws = line.split(" ")
    for _ in range(edits):
        ws[r.randrange(len(ws))] = f"w{r.randrange(10**6)}"
    return " ".join(ws)


def near_docs(seed, n=60):
    r = random.Random(seed)
    lines_ = [" ".join(f"w{r.randrange(60)}" for _ in range(r.randint(1, 30))) for _ in range(25)]
    return [(i, "\n".join(edited(r, r.choice(lines_), r.randint(0, 6)) for _ in range(r.randint(1, 5)))) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_lines_equal_brute_force(spark, seed):
    docs = near_docs(seed)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = {(r["doc_id"], r["line_no"], r["removed"]) for r in lines.mark_lines(df).collect()}
    assert got == set(brute_lines(docs))
    kept = {(i, n) for i, n, gone in brute_lines(docs) if not gone}
    want = {}
    for i, t in docs:
        parts = t.split("\n")
        left = [x for n, x in enumerate(parts) if (i, n) in kept]
        if left:
            want[i] = "\n".join(left)
    assert {r["doc_id"]: r["text"] for r in lines.drop_lines(df, lines.mark_lines(df)).collect()} == want


def test_lines_of_odd_documents(odd, rows):
    marked = lines.mark_lines(odd)
    got = Counter((r["doc_id"], r["line_no"], r["removed"]) for r in marked.collect())
    # Both orders of places are the same one: ids here repeat and may be null, so this is the general one.
    known = [(i, t) for i, t in rows(odd) if i is not None]
    want = Counter(x for x in brute_lines(sorted(known, key=lambda x: x[0])))
    assert Counter({k: n for k, n in got.items() if k[0] is not None}) == want
    assert all(gone for (i, _, gone) in got if i is None)  # a copy of an earlier document
    out = lines.drop_lines(odd, marked)
    assert out.columns == odd.columns
    ids = Counter(r["doc_id"] for r in out.select("doc_id").collect())
    assert ids[50] == 1 and ids[20] == 0 and ids[21] == 0 and ids[30] == ids[31] == ids[32] == 1 and ids[None] == 1  # the null text has no line to lose


def test_lines_of_nothing(none):
    assert lines.mark_lines(none).count() == 0 and lines.drop_lines(none, lines.mark_lines(none)).count() == 0


def test_a_group_of_near_copies_of_a_line(spark):
    r = random.Random(5)
    first = " ".join(f"common{j}" for j in range(30))
    docs = [(i, edited(r, first, 2) if i else first) for i in range(400)]
    got = lines.mark_lines(spark.createDataFrame(docs, "doc_id long, text string")).filter("NOT removed").count()
    assert got == sum(not x[2] for x in brute_lines(docs))


def test_words_are_counted_in_a_sample_of_the_lines(spark):
    df = spark.createDataFrame([(i, f"often a{i}\n often  b{i}") for i in range(2000)], "doc_id long, text string")
    levels = lines.rarity_levels(df, "text")
    # 4000 lines have the word: 1 + 2 * log2(4000) would be 25 and that of a sixteenth is 17.
    assert 15 <= max(levels) <= 19 and sorted(levels)[-2] < 10


def test_the_order_of_words_bears_on_no_line(spark, monkeypatch):
    docs = near_docs(4)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for levels in ([0] * lines.BUCKETS, [b % 127 for b in range(lines.BUCKETS)]):
        monkeypatch.setattr(lines, "rarity_levels", lambda *_, now=levels: now)
        assert {(r["doc_id"], r["line_no"], r["removed"]) for r in lines.mark_lines(df).collect()} == set(brute_lines(docs))


def test_words_are_made_distinct_below_no_lambda(spark, monkeypatch):
    plans, write = {}, common.materialize
    monkeypatch.setattr(common, "materialize", lambda df, name, **more: (plans.update({name: df._jdf.queryExecution().optimizedPlan().toString()}), write(df, name, **more))[1])
    lines.mark_lines(spark.createDataFrame(near_docs(1), "doc_id long, text string"))
    steps = plans["op7-sets"].split("\n")
    assert [s for s in steps if "array_distinct(" in s] and not [s for s in steps if "array_distinct(" in s and "sort_array(" in s]


def test_line_stage_runs_no_python(spark, odd):
    plan = lines.mark_lines(odd)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# SimHash


def brute_print(text):
    ws = (text or "").encode().lower().split()
    shingles = [b" ".join(ws[i : i + 3]) for i in range(max(1, len(ws) - 2))] if ws else []
    hs = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(docs):
    prints = [brute_print(t) for _, t in docs]
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                parent[find(i)] = find(j)
    best = {}
    for i, (d, _) in enumerate(docs):
        r = find(i)
        best[r] = min((x for x in (best.get(r), d) if x is not None), default=None)
    return Counter((d, prints[i], best[find(i)]) for i, (d, _) in enumerate(docs))


def test_simhash_of_odd_documents(odd, rows):
    got = Counter((r["doc_id"], r["fp"] & (2**64 - 1), r["component_id"]) for r in simhash.near_duplicates(odd).collect())
    assert got == brute_components(rows(odd))


def test_simhash_of_nothing(none):
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_one(none).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_links_connect_what_is_near(spark, seed):
    r = random.Random(seed)
    codes = set()
    for _ in range(60):
        c = r.getrandbits(64)
        for _ in range(r.randint(1, 12)):
            codes.add(c)
            for _ in range(r.randint(0, 3)):
                c ^= 1 << r.randrange(64)
    codes = sorted(codes)
    signed = [(c - 2**64 if c >> 63 else c,) for c in codes]
    df = spark.createDataFrame(signed, "fp long")
    edges = simhash.links(df)
    assert edges.count() <= 15 * len(codes)
    got = {x["node"] & (2**64 - 1): x["root"] for x in simhash.components(edges).collect()}
    parent = {c: c for c in codes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(codes):
        for b in codes[:i]:
            if (a ^ b).bit_count() <= 2:
                parent[find(a)] = find(b)
    groups = defaultdict(set)
    for c in codes:
        groups[find(c)].add(c)
    for g in groups.values():
        if len(g) > 1:
            assert len({got[c] for c in g}) == 1
        else:
            assert not g & set(got)
    assert len(set(got.values())) == sum(len(g) > 1 for g in groups.values())


def test_bk_forest_finds_all_pairs():
    r = np.random.default_rng(3)
    centre = r.integers(0, 2**63, 5, dtype=np.uint64)
    codes = np.unique(np.concatenate([c ^ (np.uint64(1) << r.integers(0, 64, 80, dtype=np.uint64)) ^ (np.uint64(1) << r.integers(0, 64, 80, dtype=np.uint64)) for c in centre]))
    group = (codes & np.uint64(1)).astype(np.int64)
    order = np.argsort(group, kind="stable")
    codes, group = codes[order], group[order]
    found = {(int(a), int(b)) for q, n in simhash.Forest(codes, group).matches(2) for a, b in zip(q, n)}
    want = {(i, j) for i in range(len(codes)) for j in range(i) if group[i] == group[j] and int(codes[i] ^ codes[j]).bit_count() <= 2}
    assert found == want


def test_components_of_a_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101 + i) for i in range(300)] + [(399, 400)]
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in range(100, 401)} == {100}


def test_one_of_each_group_stays(odd, rows):
    out = simhash.keep_one(odd)
    assert out.columns == odd.columns
    groups = Counter(c for (_, _, c), n in brute_components(rows(odd)).items() for _ in range(n))
    assert Counter(r["doc_id"] for r in out.select("doc_id").collect()) == Counter({c: 1 for c in groups})


def test_skewed_join(spark):
    left = spark.range(5000).selectExpr("CASE WHEN id % 2 = 0 THEN 0 ELSE id END AS k", "id")
    classes = left.groupBy("k").count().withColumnRenamed("count", "n")
    got = common.attach(left, classes, ["k"], "n", 5000)
    assert got.count() == 5000 and got.filter("k = 0 AND n = 2500").count() == 2500
