"""Sets of a large group that its hubs leave apart: few pairs are verified, and none that is similar is lost."""

import random
import re

import numpy as np

from tessera.llm import simhash
from tests.llm import fixtures
from tests.llm.test_similar_buckets import compared
from tests.llm.test_text_operators import brute_similar


def cloud(n, edits, seed=3):
    """Texts of one base with single words replaced, each of which is in five shingles; every tenth has one word more replaced than the text before it."""
    rng = random.Random(seed)
    base, texts = [f"b{rng.randrange(10**6)}" for _ in range(180)], []
    for k in range(n):
        if k % 10 or not k:
            words = list(base)
            for i, at in enumerate(rng.sample(range(180), edits)):
                words[at] = f"e{k}x{i}"
        else:
            words[rng.randrange(180)] = f"e{k}"
        texts.append(" ".join(words))
    return texts


def test_texts_just_below_the_similarity_are_told_apart_by_bitmaps(spark, monkeypatch):
    texts = cloud(300, 3)
    pairs = compared(spark, monkeypatch, texts)
    docs = fixtures.documents(spark, texts, False)
    assert sorted((r.doc_id, r.component_id) for r in simhash.similar(docs).collect()) == sorted(brute_similar(list(enumerate(texts))))
    assert pairs < 12_000


def test_bitmaps_differ_no_more_than_their_sets():
    rng = np.random.default_rng(8)
    for n in (0, 1, 50, 900):
        both, a, b = (rng.integers(0, 1 << 64, k, dtype=np.uint64) for k in (n, 40, 25))
        x, y = (np.unique(np.concatenate([both, own])) for own in (a, b))
        bits = sum(int(v).bit_count() for v in (simhash.bitmap(x) ^ simhash.bitmap(y)).view(np.uint64))
        assert 0 < bits <= len(np.setxor1d(x, y)) and bits % 2 == 65 % 2


def test_rare_shingles_are_not_joined_with_their_sets(spark, monkeypatch):
    """A join on sid has a row for each set; the sets' rows for each shingle are made after it."""
    plans, written = [], simhash.written
    monkeypatch.setattr(simhash, "written", lambda df, name: ((name == "pairs" and plans.append(df._jdf.queryExecution().optimizedPlan().toString())), written(df, name))[1])
    simhash.similar(fixtures.documents(spark, cloud(60, 3), False)).count()
    assert len(plans) > 1
    for plan in plans[1:]:
        above = []
        for line in plan.splitlines():
            depth = len(re.match(r"[ :+|-]*", line)[0])
            above = [(d, x) for d, x in above if d < depth] + [(depth, line)]
            if re.search(r"Join Inner, \(sid#\d+L = sid#\d+L\)", line):
                assert any("MapInArrow" in x for _, x in above), plan
