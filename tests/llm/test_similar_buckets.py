import random

from tessera.llm import simhash
from tests.llm import fixtures
from tests.llm.test_text_operators import brute_similar


def templated(n, seed=1, own=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghij", k=7))
    template = " ".join(word() for _ in range(120))
    return [template + " " + " ".join(word() for _ in range(own)) for _ in range(n)]


def compared(spark, monkeypatch, texts):
    """Pairs that are verified."""
    made = []
    written = simhash.written
    monkeypatch.setattr(simhash, "written", lambda df, name: (made.append(written(df, name)) or made[-1]) if name == "pairs" else written(df, name))
    simhash.similar(fixtures.documents(spark, texts, False), "doc_id").count()
    monkeypatch.setattr(simhash, "written", written)
    return sum(p.count() for p in made)


def test_texts_of_one_template_are_not_all_compared(spark, monkeypatch):
    small, large = (compared(spark, monkeypatch, templated(n)) for n in (400, 1600))
    assert large < 20_000 and large < 6 * max(small, 1000)


def test_near_copies_of_one_text_in_a_large_bucket_equal_brute_force(spark):
    rng = random.Random(7)
    base = templated(1)[0].split()
    texts = []
    for k in range(150):
        words = list(base)
        for i in rng.sample(range(len(words)), 2 + k % 8):
            words[i] = f"edit{k}x{i}"
        texts.append(" ".join(words))
    texts += templated(60, 2)
    docs = fixtures.documents(spark, texts, False)
    got = {r.doc_id: r.component_id for r in simhash.similar(docs, "doc_id").collect()}
    assert sorted(got.items()) == sorted(brute_similar([(i, t) for i, t in enumerate(texts)]))
