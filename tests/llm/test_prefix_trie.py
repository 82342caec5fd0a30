import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import prefix_trie as M
from tessera.llm import queries

CONV = "conv_id bigint, turn bigint, role string, text string"


def brute(rows):
    """Nodes of the trie by a plain dictionary of tuples; turns of one number must be equal or in order."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v, key=lambda t: t[:2])] for c, v in own.items()}
    built = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = own.get(c - c % 20, [])[:h] + t[h:]
    members, ends = defaultdict(set), defaultdict(list)
    for c, t in built.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].add(c)
        ends[tuple(t)].append(c)
    kids = defaultdict(int)
    for k in members:
        if k:
            kids[k[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for k, m in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        for d in range(len(k) + 1):
            leaves[k[:d]] += not kids[k]
            saved[k[:d]] += (len(m) - 1) * words
    digest = lambda k: hashlib.sha256(",".join(map(str, sorted(ends.get(k, [])))).encode()).hexdigest()
    return sorted((min(m), len(k), min(members[k[:-1]]) if k else -1, len(m), kids[k], leaves[k], saved[k], digest(k)) for k, m in members.items())


def found(df):
    return sorted(tuple(-1 if v is None else v for v in r) for r in df.collect())


def planted(seed=3, n=160):
    """Few texts, so that much is shared; a hot first turn; copies; long ones; turns that are missing or null."""
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        length = rng.choice([1, 1, 2, 3, 5, 8]) if c % 40 else 60
        for t in range(length):
            text = "the first turn of many" if t == 0 and rng.random() < 0.7 else rng.choice(["a b", "c", None, "", " d\te \n f"])
            rows.append((c, t, rng.choice(["user", "user", None]), text))
    rows += [(1000 + c, t, "user", "same again and again") for c in range(50) for t in range(4)]
    rows += [(3001, None, "user", "before all"), (3001, 0, "user", "after"), (None, 0, "user", "of none"), (None, None, None, None), (4007, 0, None, None)]
    return rows


@pytest.mark.parametrize(("shard", "limit"), [(M.SHARD, M.LAST), (40, 150), (1, 1000)])
def test_equals_brute_force_in_shards_and_rounds(spark, shard, limit):
    rows = planted()
    docs = spark.createDataFrame(rows, CONV).repartition(7)
    assert found(M.rollups(M.rebuilt(docs), shard, limit)) == brute(rows)


def test_equal_rows_turnless_conversations_and_other_columns(spark):
    # 5 has no turn of its own after its first h, and no conversation 0 lends it one
    lone = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 >= 1)
    rows = [(lone, 0, "user", "gone"), (41, 1, "user", "x"), (41, 1, "user", "x"), (41, 1, "user", "x"), (41, 1, "user", "x"), (41, 2, None, "y")]
    docs = spark.createDataFrame([(*r, "?", "?") for r in rows], f"{CONV}, label string, path string")
    got = found(M.rollups(M.rebuilt(docs)))
    assert got == brute(rows) and (lone, 0) in {r[:2] for r in got}
    assert M.rollups(M.rebuilt(spark.createDataFrame([], CONV))).collect() == []
    assert M.rollups(M.rebuilt(spark.createDataFrame([(None, 1, "a", "b")], CONV))).collect() == []


def test_query_equals_sql_over_planted_rows(spark, tmp_path):
    spark.createDataFrame(planted(9), CONV).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.sql(M.TRIE_SQL)
    got = queries.op12_prefix_trie(spark, str(tmp_path))
    assert got.columns == want.columns
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want.fetchall()))


def test_query_equals_sql_over_the_sample(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    assert sorted(map(str, map(tuple, queries.op12_prefix_trie(spark, sf).collect()))) == sorted(map(str, con.sql(M.TRIE_SQL).fetchall()))


def test_louds_gives_the_parents_back():
    rng = np.random.default_rng(1)
    for size in (1, 2, 30, 500):
        parents = np.sort(np.array([rng.integers(0, i) for i in range(1, size)], np.int64))
        trie = M.Louds(np.bincount(parents, minlength=size), np.zeros((size, 5), np.uint32), [0, 1])
        assert trie.parents().tolist() == [-1, *parents.tolist()] and len(trie.bits) == -(-(2 * size + 1) // 8)


def test_chunks_of_a_large_member_list(monkeypatch):
    monkeypatch.setattr(M, "CHUNK", 100)
    ids = [(b"a", k) for k in range(1000)] + [(b"b", 7)]
    batch = lambda rows, names: pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=names)
    parts = list(M._chunks(iter([batch(ids[:500], ["id", "conv_id"]), batch(ids[500:], ["id", "conv_id"])])))
    rows = list(M._rows(iter(parts)))
    assert len(rows) > 30 and max(len(r[2]) for r in rows) < 120
    got = dict(M._rows(M._digests(iter(parts))))
    assert got == {b"a": hashlib.sha256(",".join(map(str, range(1000))).encode()).hexdigest(), b"b": hashlib.sha256(b"7").hexdigest()}
