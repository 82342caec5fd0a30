import hashlib
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.llm import fill_middle, queries
from tests.llm import fixtures

TEXTS = [
    *fixtures.ODD,
    "a\nb\nc",
    "a\nb\nc\n",
    "\n\n\nx",
    "\x1b\x1e\n\x1b0\x1b1\n\x1e\x1e\x1b\n\x1e",
    "has <P> in it\nand more",
    "<S>",
    "one <M> two",
    "<P\n><S\n>",
    "ends with <\nP>\n<\n",
    "cr\r\nand\rmore \n",
    "日本\n語の\nテキスト\n😀\n",
    "\n".join(f"line {i}" for i in range(20000)),
    "no line break " * 60000,
]


def brute(doc_id, text, seed=7, rate=100, spm_rate=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    lo, hi = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = ("".join(units[a:b]) for a, b in ((0, lo), (lo, hi), (hi, n)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return doc_id, n, "plain", None, None, text
    if h[3] % 100 < spm_rate:
        return doc_id, n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return doc_id, n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


@pytest.mark.parametrize(("seed", "rate", "spm_rate"), [(7, 100, 50), (1, 60, 0), (2, 100, 100), (3, 0, 50)])
def test_equals_brute_force_and_can_be_taken_apart(spark, seed, rate, spm_rate):
    docs = fixtures.documents(spark, TEXTS * 3)
    out = fill_middle.transform(docs, seed, rate, spm_rate)
    got = out.select("row.doc_id", "row.text", "n", "form", "prefix_chars", "middle_chars", "output", fill_middle.restore(F.col("output"), F.col("form")).alias("restored")).collect()
    key = lambda r: tuple((x is None, x or 0) for x in r[:2]) + r[2:3]
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got), key=key) == sorted((brute(r.doc_id, r.text, seed, rate, spm_rate) for r in docs.collect()), key=key)
    assert all(r.restored == (r.text or "") for r in got)
    assert len({r.form for r in got}) == {0: 1, 60: 2}.get(rate, 3 if spm_rate == 50 else 2)


def test_columns_of_any_name_and_empty_tables(spark):
    docs = fixtures.clashing(spark)
    out = fill_middle.transform(docs).select("row.*", F.col("n").alias("lines"), "output")
    assert out.columns == [*docs.columns, "lines", "output"] and out.count() == docs.count()
    assert fill_middle.transform(fixtures.empty(spark)).collect() == []


def test_query_equals_sql_over_odd_rows(spark, tmp_path):
    fixtures.documents(spark, TEXTS).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_fill_middle(spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(fill_middle.FILL_SQL)
    assert got.columns == want.columns
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want.fetchall()))


def test_nothing_is_shuffled_and_no_python_runs(spark, sf):
    plan = queries.op11_fill_middle(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
