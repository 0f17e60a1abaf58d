"""The pipeline's near-duplicate stage against brute force on five-word shingles."""

import random
from collections import defaultdict

import pytest

pipeline = pytest.importorskip("corpus_pipeline")
from marlstone.llm import near  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute_groups(docs):
    """Lists of the ids of each group; ids are unique."""
    sets = []
    for _, t in docs:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b):
                parent[find(i)] = find(j)
    out = defaultdict(list)
    for i, (d, _) in enumerate(docs):
        out[find(i)].append(d)
    return sorted(sorted(g) for g in out.values())


@pytest.fixture(scope="module")
def planted(prose):
    r, docs = random.Random(5), []
    for i in range(40):
        base = prose(1000 + i, r.choice((30, 90, 250, 600))).split()
        docs.append(" ".join(base))
        for _ in range(r.randint(0, 4)):  # similarities from about 0.5 to 1
            copy = list(base)
            for _ in range(round(len(base) * r.choice((0.004, 0.01, 0.018, 0.022, 0.03, 0.06)))):
                copy[r.randrange(len(copy))] = "changed%d" % r.randrange(10**6)
            docs.append(" ".join(copy))
    hub = prose(5000, 300).split()
    docs += [" ".join(hub[:k] + ["x%d" % k] + hub[k + 1 :]).upper() for k in range(60)]
    common = " the very same words in many documents "
    docs += [prose(7000 + i, 25) + common + prose(8000 + i, 25) for i in range(30)]
    docs += ["one two", "One  two", "one two three", None, "", " \n"]
    r.shuffle(docs)
    return list(enumerate(docs))


def test_near_stage_is_brute_force(spark, planted):
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in planted], SCHEMA).repartition(4)
    want = brute_groups(planted)
    assert sum(len(g) > 1 for g in want) > 15
    got = defaultdict(list)
    for r in near.near_duplicates(df).collect():
        got[r["root"]].append(r["doc_id"])
    assert sorted(sorted(g) for g in got.values()) == want
    out = pipeline.drop_near_duplicates(spark, df, "")
    assert out.columns == df.columns and sorted(r["doc_id"] for r in out.collect()) == sorted(g[0] for g in want)


def test_near_stage_of_odd_documents(spark, odd, none):
    out = pipeline.drop_near_duplicates(spark, odd, "")
    got = [r["doc_id"] for r in out.collect()]
    assert out.columns == odd.columns and got.count(50) == 1 and 20 not in got and {0, 30, 40, 41, 51} <= set(got)
    assert near.keep_one(none).count() == 0


def grouped(rows):
    got = defaultdict(list)
    for r in rows:
        got[r["root"]].append(r["doc_id"])
    return sorted(sorted(g) for g in got.values())


def test_near_stage_links_by_fingerprints(spark, planted):
    """The trees' proposals alone, verified, make nearly all groups; each is a pair of fingerprints within the radius."""
    import numpy as np
    import pyarrow as pa

    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in planted], SCHEMA).repartition(4)
    rows = df.select("doc_id", "text", near.F.xxhash64("text").alias("text_hash"))
    prints = rows.mapInArrow(near._prints(near.rarity_levels(rows)), "doc_id long, text_hash long, uid long, size long, fp long, prefix array<long>").collect()
    codes = {r["uid"]: r for r in prints}
    texts = dict(planted)
    for r in prints[:40]:
        batch = pa.RecordBatch.from_pydict({"text": [texts[r["doc_id"]]]})
        hashes = [int(h) for _, s in near.shingles(batch) for h in s]
        assert r["fp"] % (1 << 64) == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    entries = near.shards(spark.createDataFrame(list(codes.values()), "doc_id long, text_hash long, uid long, size long, fp long, prefix array<long>"))
    pairs = [(r["a"], r["b"]) for r in near.proposals(entries).collect()]
    assert pairs and all(a < b and np.bitwise_count(np.int64(codes[a]["fp"] ^ codes[b]["fp"]).view(np.uint64)) <= near.RADIUS for a, b in pairs)
    parent = {u: u for u in codes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if len(brute_groups([(0, texts[codes[a]["doc_id"]]), (1, texts[codes[b]["doc_id"]])])) == 1:
            parent[find(a)] = find(b)
    distinct = [(u, texts[r["doc_id"]]) for u, r in codes.items()]
    wanted, left = len(distinct) - len(brute_groups(distinct)), len({find(u) for u in codes})
    assert wanted > 80 and len(distinct) - left >= 0.95 * wanted


@pytest.mark.parametrize("radius", [0, 64])
def test_near_groups_are_whole_with_any_radius(spark, planted, radius):
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in planted], SCHEMA).repartition(4)
    assert grouped(near.near_duplicates(df, radius=radius).collect()) == brute_groups(planted)


def test_earlier_codes_by_tree():
    import numpy as np

    from marlstone.llm import simhash

    r = np.random.default_rng(3)
    base = r.integers(0, 1 << 63, 40, dtype=np.uint64)
    codes = np.unique(np.concatenate([base, base ^ (np.uint64(1) << r.integers(0, 64, 40, dtype=np.uint64)), r.integers(0, 1 << 63, 200, dtype=np.uint64)]))
    r.shuffle(codes)
    group = np.sort(r.integers(0, 3, len(codes)))
    for radius in (0, 2, 24):
        alike = lambda q, node: (q + node) % 3 > 0
        found = simhash.Forest(codes, group).earlier(radius, alike)
        for q in range(len(codes)):
            fit = [n for n in range(q) if group[n] == group[q] and (codes[n] ^ codes[q]).item().bit_count() <= radius and (q + n) % 3]
            assert found[q] in fit if fit else found[q] == -1
