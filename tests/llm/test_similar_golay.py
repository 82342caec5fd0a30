"""Candidates of near copies come by Golay keys of fingerprints, and few pairs at the least similarity are lost by that."""

import random

import numpy as np

from tessera.llm import simhash
from tests.llm import fixtures
from tests.llm.test_similar_buckets import templated


def pairs_at_least(n, seed=5):
    """Texts 2k and 2k + 1 share 160 of 200 shingles, or few more."""
    rng = random.Random(seed)
    texts = []
    for k in range(n):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([40, 184, 184]))]
        cut = round((len(words) - 4) * 0.11)
        texts += [" ".join(words), " ".join(words[: len(words) - cut] + [f"x{rng.randrange(10**6)}" for _ in range(cut)])]
    return texts


def test_pairs_at_the_least_similarity_are_found(spark):
    texts = pairs_at_least(400)
    found = {r.doc_id: r.component_id for r in simhash.similar(fixtures.documents(spark, texts, False)).collect()}
    sets = [simhash.shingle_set(t.encode(), 5) for t in texts]
    alike = [len(np.intersect1d(a, b)) / len(np.union1d(a, b)) for a, b in zip(sets[::2], sets[1::2], strict=True)]
    assert min(alike) >= 0.8 and np.median(alike) < 0.83
    assert all(found[2 * k + 1] == found[2 * k] for k in range(400))


def test_candidates_share_a_golay_key(spark, monkeypatch):
    """Before, all that share a group of least hashes were verified."""
    texts, made = templated(60, 4, own=30), []
    written = simhash.written
    monkeypatch.setattr(simhash, "written", lambda df, name: (made.append((name, written(df, name))) or made[-1][1]))
    simhash.similar(fixtures.documents(spark, texts, False)).count()
    golay, by_sid = simhash.Golay(), {}
    for t in texts:
        h = simhash.shingle_set(t.encode(), 5)
        keys = golay.keys(simhash.segments(h))
        groups = simhash.bands(h)
        at = np.arange(simhash.BANDS) * simhash.WORDS // simhash.BANDS
        by_sid[int(np.uint64(simhash.set_id(h)).view(np.int64))] = {(int(b), int(c)) for b, k in zip(groups, keys[at], strict=True) for c in k}
    small = {r.band for r in next(df for name, df in made if name == "bucketed").where(f"m <= {simhash.SMALL}").select("band").collect()}
    small = {b % (1 << 64) for b in small}
    met = {(r.a, r.b) for r in next(df for name, df in made if name == "pairs").collect()}
    ids = sorted(by_sid)
    want = {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if any(x[0] in small for x in by_sid[a] & by_sid[b])}
    crowded = next(df for name, df in made if name == "bucketed").where(f"m > {simhash.SMALL}").count()
    assert want <= met and (crowded or want == met) and want


def test_golay_keys_of_words_are_those_of_fingerprint_segments(spark):
    rows = spark.createDataFrame([(1, 2, 3, 0), (2, 2, 3, (1 << 23) - 1), (3, 2, 3, 0b10110)], "sid bigint, n bigint, band bigint, word int")
    got = {}
    for r in simhash.coded(rows).collect():
        got.setdefault(r.sid, []).append(r.code)
    golay = simhash.Golay()
    assert {k: sorted(v) for k, v in got.items()} == {i: sorted({int(c) for c in golay.keys(np.array([w]))[0]}) for i, w in ((1, 0), (2, (1 << 23) - 1), (3, 0b10110))}
