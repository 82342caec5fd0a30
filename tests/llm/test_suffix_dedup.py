import hashlib
import random
import re
from collections import Counter

import numpy as np

from tessera.llm import suffix_dedup as S
from tests.llm import fixtures


def brute(texts, length=S.LENGTH):
    """Per text: the bytes that stay, and the removed runs."""
    seen = Counter()
    for t in texts:
        seen.update(t[i : i + length] for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]])))
        out.append((bytes(np.frombuffer(t, np.uint8)[~gone]), len(edges) // 2))
    return out


def planted(seed=5, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 8)))
    prose = lambda k: " ".join(word() for _ in range(k))
    shared = [prose(k) for k in (60, 75, 90, 150, 400)]
    texts = []
    for i in range(n):
        parts = [prose(rng.randint(0, 120))]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(shared), prose(rng.choice([0, 1, 50]))]
        t = " ".join(parts)
        if i % 7 == 0 and texts:  # near copy
            t = list(rng.choice(texts))
            for _ in range(rng.randint(0, 3)):
                if t:
                    t[rng.randrange(len(t))] = "#"
            t = "".join(t)
        texts.append(t)
    exact = shared[4].encode()
    texts += [exact[:400].decode(errors="ignore"), "q" + exact[3:405].decode(errors="ignore"), exact[:399].decode(errors="ignore"), "z" * 2500, "ab" * 900, "b" + "ab" * 300, "", shared[4] + shared[4], shared[3][5:] + shared[2], shared[1] + shared[2][:200]]
    return texts


def result(docs, **how):
    return sorted((str(r.row.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.remove_repeats(docs, **how).collect())


def wanted(docs):
    rows = docs.collect()
    texts = [(r.text or "").encode() for r in rows]
    return sorted((str(r.doc_id), len(t), len(t) - len(k), n, hashlib.sha256(k).hexdigest()) for r, t, (k, n) in zip(rows, texts, brute(texts), strict=True))


def test_equals_brute_force(spark, sf, monkeypatch):
    made = fixtures.documents(spark, planted(), False)
    for docs in (made, fixtures.documents(spark), fixtures.clashing(spark), fixtures.empty(spark), fixtures.sample(spark, sf)):
        want = wanted(docs)
        assert result(docs) == want
    for run, part, hot in ((3000, 20000, 512), (500, 3000, 2), (1 << 20, 1 << 20, 0), (3000, 20000, 0)):
        monkeypatch.setattr(S, "RUN_BYTES", run)
        monkeypatch.setattr(S, "PART_BYTES", part)
        assert result(made, hot=hot) == wanted(made)


def test_a_hot_class_is_judged_as_such():
    texts = [t.encode() for t in planted(3, 30)]
    sent = S._messages([m for i, t in enumerate(texts) for m in S._send_classes(i, [t], 1)])
    answers = {hot: b"".join(S._judge_classes(sent, hot).column("payload").to_pylist()) for hot in (0, 2, 512)}
    assert set(answers[512]) == {0, 1} and set(answers[0]) == {0, 2} and set(answers[2]) == {0, 1, 2}


def test_all_letters_alike_and_short_periods(spark):
    """Classes of very many anchors, and windows that overlap their copies."""
    rng = random.Random(11)
    texts = ["a" * 900, "a" * 401, "a" * 400, "a" * 399 + "b", ("ab" * 200)[:-1] + "ca" * 300, "".join(rng.choice("ab") for _ in range(3000)) * 2, "x" + "a" * 500 + "y", *["".join(rng.choice("ab") for _ in range(30)) * 20 for _ in range(4)]]
    docs = fixtures.documents(spark, texts, False)
    assert result(docs) == wanted(docs) == result(docs, hot=0)


def test_other_lengths(spark):
    docs = fixtures.documents(spark, planted(13, 30), False)
    for length in (100, 233):
        texts = [r.text.encode() for r in docs.collect()]
        want = sorted((str(i), len(t), len(t) - len(k), n, hashlib.sha256(k).hexdigest()) for i, (t, (k, n)) in enumerate(zip(texts, brute(texts, length), strict=True)))
        assert result(docs, length=length) == want


def test_columns_that_are_not_nullable_and_names_of_any_kind(spark):
    from pyspark.sql import functions as F

    names = ["row", "missing", "kept", "n_removed", "run", "part", "kind", "payload", "__null", "__removed", "__kept", "odd `name.x", "key", "rows"]
    docs = fixtures.documents(spark, planted(1, 12), False).withColumns({n: F.lit(n) for n in names} | {"nested": F.array(F.struct(F.lit(1).alias("a b")))})
    assert not docs.schema["row"].nullable
    out = S.cut_repeats(docs)
    assert out.columns == docs.columns
    plain = {r.doc_id: r.text for r in S.cut_repeats(docs.select("doc_id", "text")).collect()}
    assert all(r.text == plain[r.doc_id] and all(r[n] == n for n in names) and r.nested[0]["a b"] == 1 for r in out.collect())


def test_long_texts_in_spans(spark, monkeypatch):
    docs = fixtures.documents(spark, planted(9, 20), False)
    want = wanted(docs)
    monkeypatch.setattr(S, "SPAN", 500)
    texts = [r.text.encode() for r in docs.collect()]
    run = S.Run(texts)
    judged = S._judge_classes(S._messages(S._send_classes(0, texts, 1)))
    sent = S._messages(S._send_candidates(0, texts, S._answers(judged, 0), 1, 1))
    import pyarrow as pa

    answers = [judged]
    for kind in (1, 2):
        rows = sent.filter(pa.compute.equal(sent.column("kind"), kind))
        if rows.num_rows:
            answers.append(S._compare(rows))
    assert {m for m in sent.column("kind").to_pylist()} == {1}
    spans = S._cut(texts, pa.concat_tables(answers), 1)
    assert run.n and sorted(sum(b - a for a, b in s) for s in spans) == sorted(w[2] for w in want)


def test_front_coding_round_trip_and_merge():
    rng = random.Random(2)
    strings = sorted({bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 12))) for _ in range(300)})
    assert [s for _, s in S.front_decoded(S.front_code(strings))] == strings
    runs = [sorted(x) for x in ([], strings[::3], strings[1::3], strings[2::3] + strings[:5], strings[7:9])]
    runs = [sorted(set(r)) for r in runs]
    place, shared = S.merge([S.front_code(r) for r in runs])
    merged = [b""] * len(shared)
    for run, at in zip(runs, place, strict=True):
        for s, i in zip(run, at.tolist(), strict=True):
            merged[i] = s
    assert merged == sorted(s for r in runs for s in r)
    assert shared[1:].tolist() == [S.common(a, b) for a, b in zip(merged, merged[1:], strict=False)]


def test_gram_hashes_are_those_of_the_strings():
    data = np.frombuffer(bytes(random.Random(1).choice(b"ab") for _ in range(1500)), np.uint8)
    for n in (1, 3, 80, 400):
        (h,) = S.gram_hashes(data, (n,))
        strings = [data[i : i + n].tobytes() for i in range(len(data) - n + 1)]
        assert len(h) == len(strings)
        first = {}
        for s, x in zip(strings, h.tolist(), strict=True):
            assert first.setdefault(s, x) == x
        assert len(set(first.values())) == len(first)


def prose(seed, n, letters="bcdfg"):
    rng = random.Random(seed)
    return [f"{rng.choice(letters)}{rng.randrange(10**5)}" for _ in range(n)]


def test_a_passage_of_51_words_goes_whatever_its_bytes(spark):
    passage, short, mixed = ["a", *prose(1, 50)], prose(2, 50), prose(8, 60)
    texts = [[*prose(3, 70), *passage, *prose(4, 20), *short], [*passage, *prose(5, 80)], [*short, *prose(6, 60)], mixed, [*prose(7, 9), *mixed[:40], "odd", *mixed[41:]]]
    texts = [" ".join(t) for t in texts]
    assert 51 < len(" ".join(passage)) < S.LENGTH and len(" ".join(short)) < S.LENGTH
    docs = fixtures.documents(spark, texts, False)
    want = list(texts)
    for i in (0, 1):
        want[i] = want[i].replace(" ".join(passage), "")
    assert [r.text for r in sorted(S.cut_repeats(docs, 51).collect())] == want
    assert [r.text for r in sorted(S.cut_repeats(docs).collect())] == texts


def test_word_windows_equal_brute_force(spark, monkeypatch):
    texts = [t.replace("\n", " ") for t in planted(4, 40)]
    docs = fixtures.documents(spark, texts, False)
    raws, out = [t.encode() for t in texts], []
    words = Counter(tuple(w[i : i + 51]) for w in map(bytes.split, raws) for i in range(len(w) - 50))
    for t in raws:
        w, at, gone, hit = t.split(), [m.span() for m in re.finditer(rb"\S+", t)], np.zeros(len(t), bool), [False] * len(t.split())
        for i in range(len(w) - 50):
            if words[tuple(w[i : i + 51])] > 1:
                hit[i : i + 51] = [True] * 51
        for i, ((a, b), h) in enumerate(zip(at, hit, strict=True)):  # with the blanks between words that go
            if h:
                gone[at[i - 1][1] if i and hit[i - 1] else a : b] = True
        out.append(bytes(np.frombuffer(t, np.uint8)[~gone]).decode(errors="ignore"))
    for run in (2 << 20, 3000):
        monkeypatch.setattr(S, "RUN_BYTES", run)
        assert [r.text for r in sorted(S.cut_repeats(docs, 51).collect(), key=lambda r: r.doc_id)] == out


def test_windows_built_to_share_a_polynomial_are_told_apart(spark):
    """The Thue-Morse text of two letters and its complement share every polynomial hash modulo 2^64 with an odd multiplier."""
    n = 2048
    a = "".join("ab"[i.bit_count() % 2] for i in range(n))
    b = a.translate(str.maketrans("ab", "ba"))
    first, second = (S.gram_hashes(np.frombuffer(x.encode(), np.uint8), (n,))[0].tolist() for x in (a, b))
    assert first == second
    run = S.Run([a.encode(), b.encode(), a.encode()], n)
    at, digests = run.window_digests(np.arange(len(run.first)))
    assert len(at) == 3 and len({tuple(x) for x in digests.tolist()}) == 2
    # the same anchors in texts that differ at their ends make both classes repeated
    texts = [a, a[:-1] + "c", "c" + a[1:], b, b[:-1] + "c", "c" + b[1:]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for hot in (0, S.HOT):
        assert {r.n_removed for r in S.remove_repeats(docs, length=n, hot=hot).collect()} == {0}
