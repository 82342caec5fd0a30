import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F
import public_tokenizers
import pytest
import xxhash

from tessera.llm import common, decontaminate, language_id, packing, queries, simhash, token_counts
from tests.llm import fixtures

MODEL, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")


def both(spark, sf):
    return [fixtures.documents(spark), fixtures.clashing(spark), fixtures.empty(spark), fixtures.sample(spark, sf)]


# --- token counts -----------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_token_counts_equal_the_library(spark, sf, library):
    for docs in both(spark, sf):
        got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(docs, MODEL, 100).collect())
        want = []
        for r in docs.collect():
            n = len(library.encode(r.text or ""))
            want.append((r.doc_id if r.doc_id is not None else -1, len((r.text or "").encode()), n, n > 100))
        assert got == sorted(want)


def test_chunk_maps_compose_to_the_whole(library):
    for size in (1, 3, 17):
        counter = token_counts.Counter(token_counts.vocabulary(MODEL), chunk=size)
        for text in [t for t in fixtures.ODD if t and len(t) < 4000]:
            assert counter.count_long("▁" + text.replace(" ", "▁")) == len(library.encode(text)), text[:40]


def test_composition_is_associative():
    c = token_counts.Counter(token_counts.vocabulary(MODEL))
    maps = [c.chunk_map(x) for x in ("▁▁alph", "abet▁▁", "▁soup", "\nend▁", "x")]
    for i in range(3):
        a, b, d = maps[i : i + 3]
        assert c.compose(c.compose(a, b), d) == c.compose(a, c.compose(b, d))


# --- decontamination --------------------------------------------------------


def brute_contamination(docs, items, width=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = lambda t: word.findall((t or "").translate(fold))
    wins = defaultdict(set)
    for i, t in items:
        w = split(t)
        if i is not None:
            for k in range(max(1, len(w) - width + 1) if w else 0):
                wins[tuple(w[k : k + width])].add(str(i))
    out = []
    for d, t in docs:
        w, hit, found = split(t), set(), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in wins:
                    hit |= set(range(k, k + n))
                    found |= wins[x]
        out.append((-1 if d is None else d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def contamination(docs, bench):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.decontaminate(docs, bench).collect())


def test_decontamination_equals_brute_force(spark, sf):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    own = spark.createDataFrame([(1, fixtures.PROSE), (2, "ONE"), (3, None), (4, ""), (None, "zwei wörter"), (10, "Zwei, Wörter"), (11, "zwei Wörter!"), (12, "lazy dog while seven wizards"), (12, "absent words only here")], "item_id long, text string")
    for docs in both(spark, sf):
        for b in (bench, own, own.limit(0)):
            assert contamination(docs, b) == brute_contamination([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in b.collect()])


def test_decontamination_in_blocks(spark, sf, monkeypatch):
    docs, bench = fixtures.sample(spark, sf), spark.read.parquet(f"{sf}/benchmark.parquet")
    whole = contamination(docs, bench)
    assert any(r[5] for r in whole)
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 1 << 13)
    assert contamination(docs, bench) == whole
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and kept.count() == sum(not r[5] for r in whole)


# --- language ---------------------------------------------------------------


def test_language_held_out_accuracy(spark):
    docs = fixtures.sample(spark, "/root/testdata/sf0.01")
    rows = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == docs.count() and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_edge_cases(spark):
    for docs in (fixtures.documents(spark), fixtures.clashing(spark), fixtures.empty(spark), fixtures.documents(spark).selectExpr("doc_id", "text", "cast(null as string) lang")):
        rows = language_id.identify(docs).collect()
        assert len(rows) == docs.count()
        by = {r.doc_id: r for r in rows}
        for i, t in enumerate(fixtures.ODD):
            if by and (t is None or not any(c.isalpha() for c in t)):
                assert by[i].lang_pred == "und" and by[i].score == 0
        if "source" in docs.columns:
            assert language_id.drop_rejected(docs).columns == docs.columns


def test_codewords_are_apart():
    for n in (2, 3, 4, 5, 9, 20):
        c = language_id.codewords(n)
        assert min((c[i] != c[j]).sum() for i in range(n) for j in range(i)) >= (1 if n == 2 else 2 if n == 3 else 4)


# --- packing ----------------------------------------------------------------


def test_packing_is_an_exact_partition(spark, sf):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(WORDS)
    for docs in both(spark, sf):
        rows = packing.pack(docs, WORDS).collect()
        want = defaultdict(list)
        for r in docs.collect():
            want[r.doc_id].append([*tok.encode(r.text or "", add_special_tokens=False).ids, 2])
        pieces, sequences = defaultdict(list), defaultdict(list)
        for r in rows:
            ids = np.frombuffer(bytes(r.ids), "<u2")
            assert len(ids) == r.length > 0 and r.ids_crc32 == zlib.crc32(ids.astype("<u4").tobytes())
            pieces[r.doc_id].append((r.start, ids.tolist(), r.doc_tokens))
            sequences[r.sequence_id].append((r.offset, r.length))
        assert set(pieces) == set(want)
        for d, found in pieces.items():
            copies = want[d]
            if len(copies) == 1:
                at = 0
                for start, ids, n in sorted(found):
                    assert start == at and n == len(copies[0]) and ids == copies[0][at : at + len(ids)]
                    at += len(ids)
                assert at == len(copies[0])
            else:
                assert sum(len(x[1]) for x in found) == sum(map(len, copies))
        short = 0
        for found in sequences.values():
            at = 0
            for offset, length in sorted(found):
                assert offset == at
                at += length
            assert at <= packing.WINDOW
            short += at < packing.WINDOW
        assert short <= 1  # one shard here


def test_chunks_have_the_ids_of_the_whole_text(monkeypatch):
    """The memo table, the Latin words, punctuation and special tokens against the library; also when the table overflows."""
    import pyarrow as pa
    import public_tokenizers

    rng = random.Random(1)
    parts = ["a", "b", ".", ",", " ", "é", "İ", "<|endoftext|>", "'s", "1", "\n", "\t", "ñ", "ﬁ", "Ａ", "A.", "z,", "\u0301", "ß", "ÿ", "Þ", "ð", "×", "÷", "É", "qu", "###", "$%", "'", "Σ", "ς", "\u0338", "<|"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(4000)] + [None, ""]
    ids = packing.Ids(public_tokenizers.path("word_bpe_49k.json"))
    want = [ids.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    for limit in (ids.limit, 300):
        ids.limit = limit
        got = [x for i in range(0, len(texts), 500) for x in ids.encode(pa.array(texts[i : i + 500], pa.string()))]
        assert [np.frombuffer(x, "<u2").tolist() for x in got] == want


def test_rows_without_id_and_equal_rows_are_spread(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_TOKENS", 20000)
    docs = spark.range(10000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("one two three four five six seven").alias("text")).repartition(16)
    import public_tokenizers

    out = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=False)
    shards = out.groupBy(F.expr("sequence_id >> 32")).agg(F.sum("length").alias("n")).collect()
    assert len(shards) >= 3 and max(r.n for r in shards) < 4 * 20000 and sum(r.n for r in shards) == 80000


def test_packing_prefers_lexical_neighbours():
    rng = np.random.default_rng(1)
    topics = [rng.integers(t * 1000, t * 1000 + 60, (20, 300)).astype("<u2") for t in range(1, 5)]
    texts = [topics[i % 4][i // 4] for i in range(80)]
    df = np.bincount(np.concatenate([np.unique(x) for x in texts]), minlength=1 << 16)
    pieces = packing.fill(texts, packing.Index(texts, df, 80))
    windows = defaultdict(list)
    for doc, _, _, w, _ in pieces:
        windows[w].append(doc % 4)
    same = np.mean([max(v.count(t) for t in range(4)) / len(v) for v in windows.values()])
    assert same > 0.8


def test_neighbours_meet_across_many_shards(spark, monkeypatch):
    rng = random.Random(1)
    vocabulary = [w for w in ("anchor basket candle dragon engine feather garden hammer island jacket kettle lantern magnet needle orchard pepper quarry ribbon saddle tunnel umbrella velvet window yellow zipper bishop copper dinner effort flower guitar helmet insect jungle kidney ladder mirror napkin oyster pirate rabbit salmon temple vessel walnut").split()]
    topics = [rng.sample(vocabulary, 12) for _ in range(40)]
    rows = [" ".join(rng.choice(topics[i % 40]) for _ in range(150)) for i in range(800)]
    monkeypatch.setattr(packing, "SHARD_TOKENS", 8000)
    found = packing.pack(fixtures.documents(spark, rows, False), WORDS, with_ids=False).collect()
    shards = defaultdict(list)
    for i, shard in {(r.doc_id, r.sequence_id >> 32) for r in found}:
        shards[shard].append(i)
    assert len(shards) > 8 and {i for s in shards.values() for i in s} == set(range(800))
    # of all pairs of one topic, how many share a shard: about 1 in 15 if dealt at random
    together = sum(1 for s in shards.values() for i in s for j in s if i < j and i % 40 == j % 40)
    assert together > 0.4 * 40 * 190
    loads = defaultdict(int)
    for r in found:
        loads[r.sequence_id >> 32] += r.length
    assert max(loads.values()) < 3 * packing.SHARD_TOKENS


def test_a_seed_is_asked_for_until_none_scores():
    texts = [np.array([7, *[k] * 8, 2], "<u2") for k in (10, 11)]
    texts = [texts[0], *[np.array([i, 2], "<u2") for i in range(100, 300)], *[np.array([7, i, 2], "<u2") for i in range(300, 500)]]
    df = np.zeros(1 << 16, np.int64)
    for x in texts:
        df[np.unique(x)] += 1
    index = packing.Index([x[:-1] for x in texts], df, len(texts))
    order = [p[0] for p in packing.fill([x[:-1] for x in texts], index)]
    assert sorted(order[1:201]) == list(range(201, 401))


# --- simhash ----------------------------------------------------------------


def brute_fingerprint(text):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(fold))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    """fps: (id, fingerprint); smallest id reachable at 2 or fewer bits."""
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    f = np.array([x for _, x in fps], np.uint64)
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(f ^ f[i]) <= 2):
            parent[find(int(j))] = find(i)
    least = {}
    for i, (d, _) in enumerate(fps):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [least.get(find(i)) for i in range(len(fps))]


def test_simhash_equals_brute_force(spark, sf):
    for docs in [*both(spark, sf), fixtures.sample(spark, "/root/testdata/sf0.01")]:
        rows = docs.collect()
        fps = [(r.doc_id, brute_fingerprint(r.text)) for r in rows]
        want = sorted((str(d), f, str(c)) for (d, f), c in zip(fps, brute_components(fps), strict=True))
        got = sorted((str(r.doc_id), r.fp % (1 << 64), str(r.component_id)) for r in simhash.near_duplicates(docs).collect())
        assert got == want


def test_simhash_links_in_large_buckets(spark):
    rng = np.random.default_rng(3)
    base = [int(rng.integers(0, 1 << 62)) for _ in range(3)]
    fps = []
    for b in base:
        for _ in range(400):
            x = b
            for bit in rng.choice(64, rng.integers(0, 6), replace=False):
                x ^= 1 << int(bit)
            fps.append(x)
    fps = sorted(set(fps))
    signed = [int(np.uint64(x).astype(np.int64)) for x in fps]
    found = simhash.components(simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"))).collect()
    root = {r.node: r.root for r in found}
    groups = defaultdict(set)
    for u, x in zip(fps, signed, strict=True):
        groups[root.get(x, x)].add(u)
    want = defaultdict(set)
    for (u, _), c in zip([(u, 0) for u in fps], brute_components([(i, u) for i, u in enumerate(fps)]), strict=True):
        want[c].add(u)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_golay_is_perfect_and_keys_meet():
    g = simhash.Golay()
    words = np.arange(1 << 12, dtype=np.uint32)
    assert len(set(simhash._corrections().tolist())) == 2048
    rng = np.random.default_rng(0)
    x = rng.integers(0, 1 << 23, 500, dtype=np.uint32)
    keys = [set(k) for k in g.keys(x)]
    assert {len(k) for k in keys} <= {1, 6}
    for _ in range(5):
        a, b = rng.integers(0, 23, 500), rng.integers(0, 23, 500)
        y = x ^ (np.uint32(1) << a.astype(np.uint32)) ^ (np.uint32(1) << b.astype(np.uint32))
        assert all(k & set(m) for k, m in zip(keys, g.keys(y), strict=True))
    assert len(words) == 4096


def test_keep_one_of_each_group(spark):
    for docs in (fixtures.documents(spark), fixtures.clashing(spark), fixtures.empty(spark)):
        kept = simhash.keep_one(docs)
        assert kept.columns == docs.columns
        ids = [r.doc_id for r in kept.collect()]
        # the null row has no words, as the row with id 0
        assert sorted(ids) == sorted({r.component_id for r in simhash.near_duplicates(docs.where("doc_id is not null")).collect()})


def test_rows_without_id_and_with_one_id_are_judged_by_their_texts(spark):
    words = " ".join(f"w{i}" for i in range(60))
    rows = [(None, words, "a", "s", 1)] * 30 + [(None, words + " more", "a", "s", 1), (None, "of its own", None, None, None), (7, "x y", "b", "s", 2), (7, "p q", "b", "s", 2), (9, "p q", "b", "s", 2), (9, "p q", "b", "s", 2)]
    docs = spark.createDataFrame(rows, fixtures.DOCS)
    kept = sorted((str(r.doc_id), r.text) for r in simhash.keep_one(docs, 5).collect())
    assert [k for k in kept if k[0] == "7"] == [("7", "p q"), ("7", "x y")] and ("None", "of its own") in kept
    assert len(kept) == 4 and not any(k[0] == "9" for k in kept)


def test_word_hashes_of_very_long_texts(monkeypatch):
    rng = random.Random(4)
    text = b"  ".join([b"w%d" % rng.randrange(50) for _ in range(300)] + [b"y" * 400, b"w1", b"z" * 31, b"w2"]) + b" "
    whole = common.word_hashes(text)
    assert len(whole) == 304 and len(set(whole.tolist())) == len(set(text.split()))
    monkeypatch.setattr(common, "SPAN", 32)
    common._powers.cache_clear()
    cut = common.word_hashes(text)
    common._powers.cache_clear()
    assert [x for x, w in zip(cut, text.split(), strict=True) if len(w) < 32] == [x for x, w in zip(whole, text.split(), strict=True) if len(w) < 32]


def brute_similar(rows, width=5, least=0.8):
    """Smallest id reachable over Jaccard similarity of word shingles."""
    def shingles(text):
        w = [x for x in bytes(0x20 if 9 <= c <= 13 else c for c in (text or "").encode().lower()).split(b" ") if x]
        return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()

    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if (x == y or (min(len(x), len(y)) >= least * max(len(x), len(y)) and len(x & y) >= least * len(x | y))) and top(i) != top(j):
                root[top(i)] = top(j)
    least_of = {}
    for i, (d, _) in enumerate(rows):
        least_of[top(i)] = min(d, least_of.get(top(i), d))
    return sorted((d, least_of[top(i)]) for i, (d, _) in enumerate(rows))


def edited(seed=3):
    """Texts with near copies of every degree, a large group of near copies and a chain of them."""
    rng = random.Random(seed)
    prose = lambda n: [rng.choice("bcdfgh") + str(rng.randrange(3000)) for _ in range(n)]
    texts = []
    for n in (30, 60, 120, 300):
        base = prose(n)
        texts.append(base)
        for edits in range(1, 12):
            t = list(base)
            for _ in range(edits):
                t[rng.randrange(n)] = "odd"
            texts.append(t)
    base = prose(200)
    for _ in range(60):
        t = list(base)
        for _ in range(4):
            t[rng.randrange(200)] = prose(1)[0]
        texts.append(t)
    for _ in range(8):
        base = list(base)
        for _ in range(4):
            base[rng.randrange(200)] = prose(1)[0]
        texts.append(base)
    return [" ".join(t) for t in texts]


def test_near_copies_equal_brute_force(spark, sf, monkeypatch):
    made = fixtures.documents(spark, edited(), False)
    rows = [(r.doc_id, r.text) for r in made.collect()]
    want = brute_similar(rows)
    assert len({c for _, c in want}) < len({r.component_id for r in simhash.near_duplicates(made).collect()})
    for small in (32, 4):
        monkeypatch.setattr(simhash, "SMALL", small)
        assert sorted((r.doc_id, r.component_id) for r in simhash.similar(made).collect()) == want
    for docs in (fixtures.documents(spark, extra_null_row=False), fixtures.sample(spark, sf).where("doc_id is not null")):
        want = brute_similar([(r.doc_id, r.text) for r in docs.collect()])
        assert sorted((r.doc_id, r.component_id) for r in simhash.similar(docs).collect()) == want
        assert sorted(r.doc_id for r in simhash.keep_one(docs, 5).collect()) == sorted({c for _, c in want})


def test_queries_have_the_contract_columns(spark, sf):
    want = {"op1_token_counts": {"doc_id", "n_bytes", "n_tokens", "over_limit"}, "op3_decontaminate": {"doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"}, "op9_simhash": {"doc_id", "fingerprint", "component_id"}}
    for name, columns in want.items():
        assert columns <= set(queries.QUERIES[name](spark, sf).columns)
