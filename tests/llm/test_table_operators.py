import random
from collections import defaultdict

import numpy as np

from pyspark.sql import functions as F

from tessera.llm import chat_format, exact_topk, license_scan, queries, url_filter
from tessera.llm.license_templates import TEMPLATES
from tests.llm import fixtures

# --- licenses ---------------------------------------------------------------


def test_licenses_are_found_with_their_spans(spark, sf):
    filler = "lorem ipsum dolor sit amet " * 7
    texts = [f"{filler}{TEMPLATES['MIT']} {filler}", TEMPLATES["ISC"].upper(), filler, "Released under the MIT License. Released under the MIT License.", TEMPLATES["GPL-3.0-or-later"].replace("redistribute it", "share, hand on or redistribute this work"), " ".join(TEMPLATES["MIT"].split()[:40])]
    rows = license_scan.scan_licenses(fixtures.documents(spark, texts, False)).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    assert [(r.license, r.coverage, r.start_word) for r in by[0]] == [("MIT", 1.0, 35)]
    assert [r.license for r in by[1]] == ["ISC"] and 2 not in by and 5 not in by
    assert [(r.start_word, r.stop_word) for r in by[3]] == [(0, 5), (5, 10)]
    assert [r.license for r in by[4]] == ["GPL-3.0-or-later"] and 0.8 < by[4][0].coverage < 1
    for docs in (fixtures.documents(spark), fixtures.clashing(spark), fixtures.empty(spark)):
        assert license_scan.scan_licenses(docs).collect() == []


def test_license_lines_of_the_sample_equal_a_plain_search(spark):
    docs = fixtures.sample(spark, "/root/testdata/sf0.01")
    got = {(r.doc_id, r.license) for r in license_scan.scan_licenses(docs).collect()}
    want = {(r.doc_id, n) for r in docs.collect() for n, t in TEMPLATES.items() if t in (r.text or "")}
    assert want and got >= want and {n for _, n in got} == {n for _, n in want}


def test_winnowing_meets_every_long_shared_run():
    index = license_scan.Index(TEMPLATES)
    n = license_scan.WINDOW + license_scan.SHINGLE - 1
    for t, w in enumerate(index.words):
        for i in range(len(w) - n + 1):
            assert any(x[0] == t for x in index.regions([b"q"] * 5 + w[i : i + n] + [b"q"] * 5))


# --- top-k ------------------------------------------------------------------


def brute_top(rows, k=5, every=50):
    kept = [(i, np.floor(256 * np.array(v, float)).astype(int)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    width = max((len(v) for _, v in kept), default=0)
    kept = [(i, np.pad(v, (0, width - len(v)))) for i, v in kept]
    out = []
    for q, v in kept:
        if q % every == 0:
            best = sorted((-int(v @ c), i) for i, c in kept if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


def test_top_k_equals_brute_force(spark, sf, monkeypatch):
    rng = np.random.default_rng(0)
    own = [(i, [None if x is None else float(x) for x in rng.normal(0, 0.2, 6).round(2)]) for i in range(230)]
    own += [(300, own[0][1]), (350, own[0][1]), (301, own[0][1]), (400, None), (450, []), (500, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (550, [float("nan")] * 6), (600, [float("inf")] + [0.0] * 5), (None, own[1][1]), (650, [0.0] * 6), (601, [0.5])]
    kind = "vec_id long, embedding array<float>"
    sample = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding")
    frames = [spark.createDataFrame(own, kind), spark.createDataFrame(own[:3], kind), spark.createDataFrame(own[:1], kind), spark.createDataFrame([], kind), sample]
    for shard, group in ((8192, 2048), (40, 2)):
        monkeypatch.setattr(exact_topk, "SHARD", shard)
        monkeypatch.setattr(exact_topk, "GROUP", group)
        for f in frames if shard > 1000 else frames[:1]:
            f = f.withColumns({"id": exact_topk.F.lit("x"), "part": exact_topk.F.lit("y")})
            got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in exact_topk.top_k(f).collect())
            assert got == brute_top([(r.vec_id, r.embedding) for r in f.collect()])


def test_blocks_are_pruned():
    rng = np.random.default_rng(1)
    rows = np.zeros((4096, 64))
    rows[np.arange(4096), rng.integers(0, 64, 4096)] = rng.integers(1, 200, 4096)
    blocks = exact_topk.Blocks(np.arange(4096), rows)
    q = np.zeros(64)
    q[3] = 7.0
    bounds = blocks.bounds(q[None])[0]
    ids, scores = blocks.top(-1, q, bounds, 5)
    assert scores.tolist() == sorted((rows @ q).tolist())[::-1][:5]
    assert (bounds >= scores[4]).mean() < 0.2


# --- URLs -------------------------------------------------------------------


def plain_verdict(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host, rest = rest[:cut], rest[cut:]
        path = rest[: min((rest.find(c) for c in "?#" if c in rest), default=len(rest))]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for v, h, p in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, None))
    return host, path, best[1], best[2]


URLS = [None, "", "no scheme", "http://", "HTTP://A.B.COM/en/x", "x://example.com/en/7", "http://a.example.com/en/71?q=1", "http://example.net/de/8#f", "http://xexample.net/de/8", "http://net/de/", "http://net/de", "http://b.org?/es/", "http://b.org/es/://c.net/de/", "http://ÀB.org/es/\nline", "a://b://c.com/en/", "http://com/en/", "http://h.com", "//x", "://y.net/de/z?://", "http://u@h.net:80/de/"]


def test_explicit_url_rules(spark, sf):
    pages = spark.createDataFrame([(i, u, "h", "v") for i, u in enumerate(URLS)] + [(None, URLS[4], None, None), (4, URLS[4], "h", "v")], "page_id long, url string, html string, verdict string")
    none = spark.createDataFrame([], "url string, verdict string")
    for p in (pages, pages.limit(0), spark.read.parquet(f"{sf}/pages.parquet")):
        got = sorted(((str(r.page_id), r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(p, queries.URL_RULES, none).collect()), key=str)
        want = []
        for r in p.collect():
            h, q, rule, verdict = plain_verdict(r.url)
            want.append((str(r.page_id), h, q, rule, verdict or "allow"))
        assert got == sorted(want, key=str)


def test_mined_url_rules(spark):
    rng = random.Random(0)
    rows = []
    for i in range(600):
        shop, lang = rng.choice(["shop", "blog"]), rng.choice(["fr", "it"])
        rows.append((f"http://{shop}.site{rng.randint(1, 5)}.xyz/{lang}/{i}", "block" if shop == "shop" and lang == "it" else "allow"))
    labelled = spark.createDataFrame([*rows, (None, "block"), ("http://q.r/", None)], "url string, verdict string")
    rules = [(frozenset(r.tokens), r.verdict, r.confidence, r.support) for r in url_filter.mine(labelled, 0.05, 0.95).collect()]
    assert any(t == frozenset({"host:shop", "path:it"}) and v == "block" and c == 1.0 for t, v, c, _ in rules)
    assert not any(t > frozenset({"host:shop", "path:it"}) for t, *_ in rules)
    pages = spark.createDataFrame([(1, "http://shop.new.xyz/it/9"), (2, "http://blog.new.xyz/it/9"), (3, "http://none.at/all"), (4, None)], "page_id long, url string")
    got = {r.page_id: (r.verdict, r.mined) for r in url_filter.filter_urls(pages, [], labelled).collect()}
    assert got[1] == ("block", ["host:shop", "path:it"]) and got[2][0] == got[3][0] == got[4][0] == "allow"


def test_mined_rules_equal_brute_force(spark):
    import random
    from itertools import combinations

    rng = random.Random(5)
    url = lambda: f"http://{rng.choice(['a', 'b', 'c'])}.{rng.choice(['x', 'y'])}/{'/'.join(rng.sample(['p', 'q', 'r', 's'], rng.randint(0, 3)))}?{rng.choice(['k', 'm'])}=1"
    always = "http://one.two.three/four/five/six/seven/eight/nine/ten?e=1&f=2&g=3&h=4"  # 14 tokens that occur together: 16383 rules alike
    rows = [(u := url(), "block" if ("p" in u.split("?")[0].split("/")) == (rng.random() < 0.9) else "allow") for _ in range(150)] + [(always, "block")] * 10
    labelled = spark.createDataFrame(rows, "url string, verdict string")
    urls = sorted({u for u, _ in rows} | {url() for _ in range(80)}) + [always]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    with_tokens = {r.url: frozenset(r.t) for r in labelled.unionByName(pages.select("url", F.lit("").alias("verdict"))).select("url", url_filter.tokens(F.col("url")).alias("t")).distinct().collect()}
    counts, of = defaultdict(int), defaultdict(int)
    for u, v in rows:
        if u != always:
            for k in range(1, 7):
                for c in combinations(sorted(with_tokens[u]), k):
                    counts[c] += 1
                    of[c, v] += 1
    least = max(url_filter.SUPPORT * len(rows), url_filter.LEAST)
    share = {v: sum(w == v for _, w in rows) / len(rows) for v in ("allow", "block")}
    want = {}
    for i, u in enumerate(urls):
        kept = [(n / counts[c], n, c, v) for (c, v), n in of.items() if n >= least and n / counts[c] >= url_filter.CONFIDENCE and with_tokens[u].issuperset(c)]
        fits = [(-p / share[v], -p, -n / len(rows), c, v) for p, n, c, v in kept if p / share[v] > 1 - 1e-9]
        want[i] = min(fits)[4] if fits else "allow"
    want[len(urls) - 1] = want[urls.index(always)] = "block"
    got = {r.page_id: r.verdict for r in url_filter.filter_urls(pages, [], labelled).collect()}
    assert got == want and len(set(want.values())) == 2
    mined = url_filter.mine(labelled).collect()
    assert max(len(r.tokens) for r in mined if with_tokens[always].intersection(r.tokens)) == 1  # one of the 14 stands for all


def test_tokens_that_occur_together_are_one(spark):
    long = "http://one.two.three/" + "/".join(f"s{i}" for i in range(40))  # 43 tokens: their subsets are never enumerated
    also = "http://one.two.three/" + "/".join(f"s{i}" for i in range(20)) + "/other"  # and some of them elsewhere
    labelled = spark.createDataFrame([(long, "block")] * 6 + [(also, "allow")] * 6 + [(f"http://h{i}.at/", "allow") for i in range(20)], "url string, verdict string")
    mined = {(tuple(r.tokens), r.verdict): (r.confidence, r.token) for r in url_filter.mine(labelled).collect()}
    assert mined == {(("path:s20",), "block"): (1.0, "path:s20"), (("path:other",), "allow"): (1.0, "path:other"), (("host:at",), "allow"): (1.0, "host:at")}
    pages = spark.createDataFrame([(1, long), (2, also), (3, "http://x/s33"), (4, "http://x/s3"), (5, "http://x/s39/other")], "page_id long, url string")
    got = {r.page_id: (r.verdict, r.mined) for r in url_filter.filter_urls(pages, [], labelled).collect()}
    assert got == {1: ("block", ["path:s20"]), 2: ("allow", ["path:other"]), 3: ("block", ["path:s20"]), 4: ("allow", None), 5: ("block", ["path:s20"])}  # 5: both fit surely, block is the rarer verdict


def test_mined_rules_on_held_out_urls(spark):
    rng = random.Random(9)
    rows = []
    for _ in range(3000):
        h, p = rng.choice(["shop", "blog", "news"]), rng.choice(["en", "fr", "it"])
        planted = (h, p) == ("shop", "it")
        rows.append((f"http://{h}.site{rng.randint(1, 30)}.xyz/{p}/{rng.randint(1, 10**6)}", "block" if rng.random() < (0.9 if planted else 0.05) else "allow", planted))
    fitted = spark.createDataFrame([r[:2] for r in rows[:1500]], "url string, verdict string")
    asked = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows[1500:])], "page_id long, url string")
    blocked = {r.page_id for r in url_filter.filter_urls(asked, [], fitted).collect() if r.verdict == "block"}
    truth, planted = {i for i, r in enumerate(rows[1500:]) if r[1] == "block"}, {i for i, r in enumerate(rows[1500:]) if r[2]}
    assert len(blocked & truth) / len(blocked) > 0.85 and len(blocked & truth & planted) / len(truth & planted) > 0.95


# --- conversations ----------------------------------------------------------


def plain_render(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    said = {c: tuple((r, t) for *_, r, t in sorted(v)) for c, v in convs.items()}
    first = {}
    for c in sorted(said):
        first.setdefault(said[c], c)
    keep = [c for s, c in first.items() if not any(len(o) > len(s) and o[: len(s)] == s for o in first)]
    return sorted((c, len(said[c]), "".join(f"<|{r}|>\n{t}\n" for r, t in said[c])) for c in keep)


def test_snapshots_collapse(spark, sf):
    talk = [("user", "hi"), ("assistant", "hello"), ("user", "bye"), ("assistant", "bye")]
    rows = [(c, i, *t) for c, n in ((1, 2), (2, 4), (3, 4), (4, 1), (5, 3)) for i, t in enumerate(talk[:n])]
    rows += [(6, 0, "user", "hi"), (6, 1, "assistant", "other"), (7, None, None, None), (8, 0, "user", ""), (8, 0, "user", ""), (9, 3, "b", "x"), (9, 3, "a", "x"), (9, None, "z", None), (None, 0, "user", "hi"), (10, 0, "user", "h" * 50000)]
    kind = "conv_id long, turn long, role string, text string"
    for f in (spark.createDataFrame(rows, kind), spark.createDataFrame([], kind), spark.read.parquet(f"{sf}/conversations.parquet")):
        f = f.withColumns({"n": chat_format.F.lit(1), "h1": chat_format.F.lit(2), "line": chat_format.F.lit("q")})
        got = sorted((r.conv_id, r.n_turns, r.rendered) for r in chat_format.render(f).collect())
        assert got == plain_render([(r.conv_id, r.turn, r.role, r.text) for r in f.collect()])


def test_licenses_with_insertions_and_changes_of_any_word():
    from tessera.llm import license_scan
    from tessera.llm.license_templates import TEMPLATES

    index = license_scan.Index(TEMPLATES)
    prose = [f"p{i}" for i in range(400)]
    for name, text in TEMPLATES.items():
        w = text.split()
        for extra in (0, 13, 40):
            if extra and len(w) < 40:
                continue
            got = [r for r in index.scan(" ".join([*prose[:50], *w[: len(w) // 2], *prose[100 : 100 + extra], *w[len(w) // 2 :], *prose[200:250]]).encode()) if r[0] == name]
            size = len(license_scan.words(text.encode()))
            assert [(r[1], r[3], r[4]) for r in got] == [(size, 50, 50 + size + extra)], (name, extra)
        twice = [r for r in index.scan(" ".join([*w, *prose[:5], *w]).encode()) if r[0] == name]
        assert [r[2] for r in twice] == [1.0, 1.0], name
    notice = "Released under the MIT License".split()
    for i in range(5):
        got = index.scan(" ".join([*prose[:9], *notice[:i], "odd", *notice[i + 1 :], *prose[9:20]]).encode())
        assert any(r[0] == "MIT notice" and r[1] == 4 for r in got) == (i != 2)  # a change in the middle leaves no three words in a row


def test_coverage_is_that_of_an_alignment_without_band():
    import random

    from tessera.llm import license_scan
    from tessera.llm.license_templates import TEMPLATES

    def longest(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    rng, index = random.Random(8), license_scan.Index(TEMPLATES)
    for name in ("MIT", "ISC", "BSD-3-Clause", "MPL-2.0"):
        w = license_scan.words(TEMPLATES[name].encode())
        for _ in range(4):
            t = list(w)
            for _ in range(len(t) // 20):
                i = rng.randrange(len(t))
                t[i : i + 1] = rng.choice([[], [b"odd"], [t[i], b"more"]])
            text = [b"q%d" % i for i in range(30)] + t + [b"r%d" % i for i in range(30)]
            (got,) = [r for r in index.scan(b" ".join(text)) if r[0] == name]
            assert 0 <= longest(w, text) - got[1] <= 2 and 30 <= got[3] <= 34 and 26 + len(t) <= got[4] <= 30 + len(t)
