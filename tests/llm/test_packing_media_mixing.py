"""Packing, media columns and mixing: round trips and brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from marlstone.llm import media, mixing, packing


@pytest.fixture(scope="module")
def encoder():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 1]


def test_tokenizer_gives_the_same_ids(encoder, prose):
    ids = packing.load_tokenizer(packing.vocabulary_path(), packing.added_path())
    for t in ("", " ", "a", "  two  spaces \n\n\t x", "Ünïcödé 漢字 \U0001f600 \x00", "it's we'll I'D", "12 345\r\n", "<|endoftext|>", "a <|endoftext|> b<|endoftext|>", "a" * 5000, prose(1, 300), "  " * 700 + "x"):
        assert [*ids(t).tolist(), 1] == encoder(t)
    assert packing.SEGMENT > 1000
    was, packing.SEGMENT = packing.SEGMENT, 50
    try:
        assert [*ids(prose(2, 400)).tolist(), 1] == encoder(prose(2, 400))
    finally:
        packing.SEGMENT = was


def check_packed(rows, want, capacity=2048):
    """Each id lies in one piece; sequences have no gap; padding is little."""
    by_seq, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        by_seq[r["sequence_id"]].append(r)
        by_doc[r["doc_id"]].append(r)
    padding = total = 0
    for seq in by_seq.values():
        at = 0
        for r in sorted(seq, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= capacity and {r["sequence_length"] for r in seq} == {at}
        total += at
        padding += 0 if at & (at - 1) == 0 else capacity - at
    for doc, texts in want.items():
        pieces = Counter((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in by_doc.pop(doc))
        spans = defaultdict(int)
        for (start, length, crc, n), times in pieces.items():
            fits = [ids for ids in texts if len(ids) == n and zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes()) == crc]
            assert fits
            spans[n] += length * times
        assert spans == Counter({n: n * k for n, k in Counter(map(len, texts)).items()})
    assert not by_doc
    return padding / max(1, total)


def test_packing_of_odd_documents(odd, none, encoder, rows):
    want = defaultdict(list)
    for i, t in rows(odd):
        want[i].append(encoder(t))
    assert check_packed(packing.pack(odd, packing.vocabulary_path()).collect(), want) < 0.02
    assert packing.pack(none, packing.vocabulary_path()).count() == 0


@pytest.mark.parametrize("slack", [0.0, 1 / 256, 0.1])
def test_harmonic_bins(slack):
    r = random.Random(6)
    bins, made, want = packing.Harmonic(2048, 32, slack), [], {}
    for doc in range(3000):
        ids = np.array([r.randrange(50000) for _ in range(int(r.paretovariate(1.1) * 20))], "<u4")[:9000]
        want[doc] = [ids.tolist()]
        made += bins.add(doc, ids)
    made += bins.finish()
    rows = [dict(zip(("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_length"), m)) for m in made]
    assert check_packed(rows, want) <= slack / 2 + 0.002
    # A sequence of class k holds exactly k pieces, all but the worker's last and the small ones.
    sizes = Counter(len([m for m in made if m[5] == s]) for s in list({m[5] for m in made})[:50])
    assert sizes and bins.finish() == []


def test_media(odd, none, rows):
    got = defaultdict(list)
    for r in media.media_columns(odd).collect():
        got[r["doc_id"]].append(r)
    same = {}
    for i, t in rows(odd):
        data = (t or "").encode()
        payload = data + b"\xff" * (max(576, -(-len(data) // 576) * 576) - len(data))
        wav = media.to_wav(payload)
        want = (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(wav), hashlib.sha256(wav).hexdigest())
        r = next(r for r in got[i] if tuple(r)[1:7] == want)
        assert len(r["times"]) == len(r["codes"]) and same.setdefault(t or "", r["feature"]) == r["feature"]
        assert r["feature"].startswith(f"pairs={len(r['codes'])};frames={(len(payload) - 576) // 288 + 1};")
    assert media.media_columns(none).count() == 0
    assert media.from_wav(media.to_wav(bytes(range(256)))) == bytes(range(256))


def test_fingerprints_are_brute_force():
    """Peaks by a sum over samples, and pairs by loops."""
    x = np.random.default_rng(5).integers(0, 256, 576 * 3, dtype=np.uint8)
    x[500:900] = np.clip(128 + 100 * np.sin(np.arange(400) * 0.7), 0, 255)
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(576) / 575)
    edges = [int(v) for v in np.linspace(1, 289, 7)]
    found = []
    for a in range(0, len(x) - 575, 288):
        y = (x[a : a + 576] - x[a : a + 576].mean()) * window
        power = np.array([abs(sum(y * np.exp(-2j * np.pi * k * np.arange(576) / 576))) ** 2 for k in range(289)])
        row = []
        for b in range(6):
            band = power[edges[b] : edges[b + 1]]
            row.append(edges[b] + int(band.argmax()) if band.max() > 4 * band.mean() + 1e-3 else -1)
        found.append(row)
    assert media.peaks(x).tolist() == found and len(found) == 5
    want = [(t, (found[t][b] * 512 + found[t + d][c]) * 4 + d) for t in range(5) for b in range(6) for d in (1, 2, 3) for c in (b - 1, b, b + 1) if 0 <= c < 6 and t + d < 5 and found[t][b] >= 0 and found[t + d][c] >= 0]
    times, codes = media.pairs(np.array(found, np.int16))
    assert want and list(zip(times.tolist(), codes.tolist())) == want


def test_spectral_peaks_of_a_tone():
    t = np.arange(576 * 8)
    tone = np.clip(128 + 90 * np.sin(2 * np.pi * t * 40 / 576), 0, 255).astype(np.uint8)
    found = media.peaks(tone)
    assert (found.max(axis=1) >= 39).all() and 40 in found
    times, codes = media.pairs(found)
    assert len(codes) and (np.diff(times) >= 0).all() and (40 * 512 + 40) * 4 + 1 in codes.tolist()
    assert len(media.pairs(media.peaks(np.full(576 * 4, 255, np.uint8)))[0]) == 0


# Mixing


def brute_targets(sizes):
    weights = [(3, 1, 2)[i % 3] for i in range(len(sizes))]
    total = 1.5 * sum(sizes)
    low, high = 0.0, 1e12
    for _ in range(200):  # the level at which capped shares add up
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(2 * s, mid * w) for s, w in zip(sizes, weights)) < total else (low, mid)
    return [min(2 * s, high * w) for s, w in zip(sizes, weights)]


@pytest.mark.parametrize("sizes", [[10], [5, 5, 5], [100, 1, 1, 50, 0, 7], [0, 0], [3, 1000, 2, 2, 2, 2]])
def test_targets(sizes):
    got = mixing.targets(sizes)
    if sum(sizes):
        assert np.allclose(got, brute_targets(sizes), rtol=1e-6) and np.isclose(sum(got), 1.5 * sum(sizes))
    else:
        assert got == [0.0] * len(sizes)


def test_golden_points_are_even(spark):
    n = 10_000
    u = np.sort([r[0] for r in spark.range(n).select(mixing.golden(mixing.F.col("id"))).collect()])
    assert np.abs(u - (np.arange(n) + 0.5) / n).max() < 3 / n * np.log(n)
    exact = [(i * mixing.GOLDEN % 2**64) / 2**64 for i in (1, 2**26 + 5, 2**40 + 3)]
    got = [r[0] for r in spark.createDataFrame([(1,), (2**26 + 5,), (2**40 + 3,)], "id long").select(mixing.golden(mixing.F.col("id"))).collect()]
    assert np.allclose(sorted(got), sorted(exact), atol=1e-6)


def test_mix_of_many(spark, prose):
    r = random.Random(2)
    docs = [(i, prose(i, r.randint(0, 150)), None if i % 11 == 0 else ("hot" if i % 3 else f"s{i % 4}")) for i in range(900)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(4)
    got = mixing.mix(df, block=32).collect()
    sizes = defaultdict(int)
    for i, t, s in docs:
        sizes[s] += len(t.split())
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    goal = dict(zip(names, brute_targets([sizes[s] for s in names])))
    taken = defaultdict(int)
    for x in got:
        assert x["size"] == len(docs[x["doc_id"]][1].split()) and x["source_size"] == sizes[x["source"]] and 0 <= x["taken"] <= 2 * x["size"]
        assert np.isclose(x["target"], goal[x["source"]], rtol=1e-6)
        assert x["taken"] == sum(s["words"] * s["times"] for s in x["segments"] or [])
        taken[x["source"]] += x["taken"]
    assert len(got) == len(docs) and all(abs(taken[s] - goal[s]) <= 0.02 * goal[s] + 64 for s in names)
    again = mixing.mix(df.repartition(7), block=32).collect()
    assert sorted((x["doc_id"], x["taken"]) for x in again) == sorted((x["doc_id"], x["taken"]) for x in got)
    # The mix itself holds exactly the words that it takes.
    out = mixing.take(df, mixing.mix(df, block=32))
    words = Counter()
    for x in out.collect():
        words[x["doc_id"]] += len(x["text"].split())
    assert words == Counter({x["doc_id"]: x["taken"] for x in got if x["taken"]})


def test_small_sources_meet_their_targets(spark, prose):
    docs = [(i, prose(i, 400), "big") for i in range(40)] + [(100 + i, prose(i, 20 + 9 * (i % 9)), f"s{i % 12}") for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    got = defaultdict(lambda: [0, 0.0])
    for r in mixing.mix(df).collect():
        got[r["source"]][0] += r["taken"]
        got[r["source"]][1] = r["target"]
        assert r["taken"] <= 2 * r["size"]
    assert len(got) == 13 and all(abs(taken - goal) <= 0.02 * goal + 2 for taken, goal in got.values())
    with pytest.raises(ValueError):
        mixing.mix(df, limit=2.5)


def test_schedule_takes_blocks_in_turn(spark):
    plan = [(0, 1000, 2000.0), (1, 500, 250.0), (2, 0, 0.0)]
    got = mixing.schedule(spark, plan, 10).collect()
    ranks = defaultdict(list)
    for r in got:
        ranks[r["sid"]].append((r["rank"], r["block"], r["slot"]))
    for sid, x in ranks.items():
        x.sort()
        assert [r for r, _, _ in x] == list(range(len(x))) and [s for _, _, s in x] == sorted(s for _, _, s in x)
        assert max(Counter(b for _, b, _ in x).values()) - min(Counter(b for _, b, _ in x).values()) <= 1
    # A source of 500 words has 100 blocks, of 5 words.
    assert mixing.width(1000, 10) == 10 and mixing.width(500, 10) == 5
    assert len(ranks[0]) == 200 and len(ranks[1]) == 50 and 2 not in ranks


def test_mix_of_odd_documents(odd, none):
    got = mixing.mix(odd).collect()
    assert len(got) == odd.count() and all(r["taken"] == 0 for r in got if r["size"] == 0)
    assert {r["size"] for r in got if r["doc_id"] in (30, 31, 32)} == {0}
    assert mixing.mix(none).count() == 0
    assert mixing.take(odd, mixing.mix(odd)).columns == odd.columns


def test_stretches():
    parts = [(0, 5, 1), (5, 5, 2), (10, 5, 2), (20, 3, 1)]
    assert mixing.stretches(parts) == [(0, 15), (20, 23), (5, 15)] and mixing.stretches([]) == []
