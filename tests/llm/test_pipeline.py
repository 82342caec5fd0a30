import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

import corpus_pipeline as C
from tests.llm import fixtures
from tests.llm.test_text_operators import brute_contamination, brute_similar


def stages(spark, docs, sf):
    out = [docs]
    for name, stage in C.STAGES:
        out.append(C.written(stage(spark, out[-1], sf), name))
    return out


def brute_passages(texts, n=C.PASSAGE):
    """Texts without the words of passages of n words that are there twice, and the blanks between them."""
    seen = Counter(tuple(w[i : i + n]) for w in map(bytes.split, texts) for i in range(len(w) - n + 1))
    out = []
    for t in texts:
        w, at = t.split(), [m.span() for m in re.finditer(rb"\S+", t)]
        hit = [False] * len(w)
        for i in range(len(w) - n + 1):
            if seen[tuple(w[i : i + n])] > 1:
                hit[i : i + n] = [True] * n
        left, end = [], 0
        for i, ((a, b), h) in enumerate(zip(at, hit, strict=True)):
            if h:
                left.append(b"" if i and hit[i - 1] else t[end:a])
                end = b
        out.append(b"".join(left) + t[end:])
    return out


def test_stages_do_what_brute_force_does(spark, sf):
    docs = fixtures.sample(spark, sf)
    start, langs, near, cut, clean, packed = stages(spark, docs, sf)
    assert langs.count() >= 0.97 * start.count() and langs.columns == start.columns
    rows = langs.collect()
    assert sorted(r.doc_id for r in near.collect()) == sorted({c for _, c in brute_similar([(r.doc_id, r.text) for r in rows])})
    rows = sorted(near.collect(), key=lambda r: r.doc_id)
    want = {r.doc_id: k.decode(errors="ignore") for r, k in zip(rows, brute_passages([r.text.encode() for r in rows]), strict=True)}
    got = {r.doc_id: r for r in cut.collect()}
    assert {d: r.text for d, r in got.items()} == want
    assert all(r.n_chars == len(r.text) for r in got.values() if r.text != {x.doc_id: x.text for x in rows}[r.doc_id])
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    dirty = {r[0] for r in brute_contamination([(d, t) for d, t in want.items()], bench) if r[5]}
    assert {r.doc_id for r in clean.collect()} == set(want) - dirty
    pieces = defaultdict(int)
    for r in packed.collect():
        pieces[r.doc_id] += r.length
    assert set(pieces) == set(want) - dirty


def test_columns_that_are_not_nullable_and_names_of_any_kind(spark, sf):
    names = ["row", "missing", "kept", "rows", "key", "__row", "__null", "__n", "__id", "shard", "hits", "items", "a `b.c"]
    docs = fixtures.documents(spark, extra_null_row=False).limit(6).withColumns({n: F.lit(n) for n in names})
    *filtered, packed = stages(spark, docs, sf)
    assert all(f.columns == docs.columns for f in filtered) and filtered[-1].count() == packed.select("doc_id").distinct().count()


def test_odd_documents_and_no_documents(spark, sf):
    for docs in (fixtures.documents(spark), fixtures.clashing(spark), fixtures.empty(spark)):
        *filtered, packed = stages(spark, docs, sf)
        assert all(f.columns == docs.columns for f in filtered)
        assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in filtered[-1].collect()}


def test_run_gives_the_stages_result(spark, sf):
    assert C.run(spark, sf).count() > 0
