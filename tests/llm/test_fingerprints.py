import hashlib
import re
from statistics import mean

import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import fingerprints as M
from tessera.llm import queries
from tests.llm import fixtures


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + M.SHINGLE]) for i in range(max(1, len(w) - M.SHINGLE + 1))} if w else set()


def chained(*parts):
    h = 42
    for p in parts:
        h = xxhash.xxh64_intdigest(p, seed=h)
    return h - (1 << 64) if h >> 63 else h


def brute_fingerprint(text):
    """Bins, probes and the order of last resort, one bin after the other."""
    least = {}
    for s in shingles(text):
        h = chained(*(w.encode() for w in s))
        b = (h >> 56) + 128
        least[b] = min(h, least.get(b, h))
    if not least:
        return []
    number = lambda i: i.to_bytes(4, "little")
    full = []
    for i in range(M.BINS):
        probes = [i, *(chained(number(i), number(k)) % M.BINS for k in range(M.PROBES))]
        found = next((p for p in probes if p in least), None)
        full.append(least[min(least, key=lambda b: chained(number(i), number(b + M.PROBES))) if found is None else found] & 255)
    return full


def as_hex(bins):
    return "".join(f"{b:02x}" for b in bins)


def brute_likeness(a, b):
    if not a or not b:
        return float(a == b)
    same = sum(x == y for x, y in zip(a, b, strict=True)) / M.BINS
    return max(0.0, (same - 2**-M.BITS) / (1 - 2**-M.BITS))


def brute(rows, share=3):
    """Multiset of results for (doc_id, text) rows."""
    # Spark compares nulls and hashes as the docstring says: doc_id, then the text's hash, downwards
    order = sorted(((i is not None, i or 0, chained((t or "").encode()), t or "") for i, t in rows), reverse=True)
    out = []
    for k, (there, i, _, t) in enumerate(order):
        nxt = order[(k + 1) % len(order)][3]
        n = len(t) // share
        edited = t[: len(t) - n] + nxt[:n]
        fp, efp, nfp = map(brute_fingerprint, (t, edited, nxt))
        out.append((str(i if there else None), len(t), hashlib.sha256(edited.encode()).hexdigest(), as_hex(fp), as_hex(efp), round(brute_likeness(fp, efp), 9), round(brute_likeness(fp, nfp), 9)))
    return sorted(out)


def rows_of(found):
    shown = found.select("row.doc_id", "n_chars", "edited_sha256", M.to_hex("fingerprint"), M.to_hex("edited_fingerprint"), "near_edited", "near_next")
    return sorted((str(r[0]), *r[1:5], round(r[5], 9), round(r[6], 9)) for r in shown.collect())


def test_equals_brute_force_on_odd_texts(spark):
    docs = fixtures.documents(spark)
    got = M.edits(docs)
    assert got.columns == ["row", "n_chars", "edited_sha256", "text", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    assert rows_of(got) == brute([(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize(("ranges", "size"), [(3, 1), (1, 10), (64, 1)])
def test_ranges_and_shared_ids(spark, monkeypatch, ranges, size):
    """A third of all rows have one doc_id, a third no doc_id; many are equal."""
    monkeypatch.setattr(M, "RANGES", ranges)
    monkeypatch.setattr(M, "RANGE_ROWS", size)
    texts = [*fixtures.ODD[:12], *(f"{fixtures.PROSE} number {k % 7}" for k in range(60))]
    rows = [(None if k % 3 == 0 else 5 if k % 3 == 1 else k, t, None, None, None) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, fixtures.DOCS).repartition(5)
    assert rows_of(M.edits(docs)) == brute([r[:2] for r in rows])


def test_a_shared_id_is_split(spark, monkeypatch):
    monkeypatch.setattr(M, "RANGE_ROWS", 10)
    docs = spark.range(2000).selectExpr("cast(null as bigint) AS doc_id", "cast(id % 2 as string) AS text")
    rows = docs.select(F.struct("doc_id", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("place")).alias("key"))
    sizes = [r["count"] for r in M.in_ranges(rows, docs.select("doc_id")).groupBy("range").count().collect()]
    assert sum(sizes) == 2000 and len(sizes) > 100 and max(sizes) < 100


def test_one_document_empty_table_and_clashing_columns(spark):
    one = spark.createDataFrame([(1, "a b c d e f g h", None, None, None)], fixtures.DOCS)
    r = M.edits(one).first()
    assert r.edited == "a b c d e a b c" and r.near_next == 1.0
    assert M.edits(fixtures.empty(spark)).collect() == []
    docs = fixtures.clashing(spark)
    assert sorted(map(str, M.edits(docs).select("row.*").collect())) == sorted(map(str, docs.drop("text").collect()))


def test_likeness_is_unbiased_on_the_sample(spark, sf):
    docs = {r.doc_id: r.text for r in fixtures.sample(spark, sf).collect()}
    order = sorted(docs, reverse=True)
    jaccard = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    off, far = [], []
    for r in queries.op13_fingerprints(spark, sf).collect():
        text, nxt = docs[r.doc_id], docs[order[(order.index(r.doc_id) + 1) % len(order)]]
        n = len(text) // 3
        off.append(r.near_edited - jaccard(shingles(text), shingles(text[: len(text) - n] + nxt[:n])))
        far.append(r.near_next - jaccard(shingles(text), shingles(nxt)))
    assert abs(mean(off)) < 0.01 and max(map(abs, off)) < 0.15 and abs(mean(far)) < 0.01 and max(map(abs, far)) < 0.1


def test_no_python_and_texts_are_exchanged_once(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    plan = M.with_fingerprint(docs, "text", "fp")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
