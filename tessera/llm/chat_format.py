"""Chat formatting with cumulative-snapshot collapse.

Logs often hold a conversation again and again as it grows.  Each turn gets
the rolling hash of the turns up to it (two 64-bit xors of position-seeded
hashes, a running window aggregate); a conversation whose whole hash is the
proper prefix hash of another is its snapshot and goes by an anti-join; of
equal conversations the one with the smallest id stays.  What is left is
rendered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_PREFIX = ["n", "h1", "h2"]


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), role, text and the hashes of the turns up to it."""
    rows = conversations.where("conv_id is not null").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    rows = rows.withColumn("n", F.row_number().over(order))
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for i in (1, 2):
        rows = rows.withColumn(f"h{i}", F.bit_xor(F.xxhash64(F.lit(i), "n", "role", "text")).over(running))
    return rows.select("conv_id", "role", "text", *_PREFIX)


def maximal(rows: DataFrame) -> DataFrame:
    """conv_id and n of the conversations that no other one continues; of equal ones the smallest id."""
    hashes = rows.select("conv_id", *_PREFIX)
    last = Window.partitionBy("conv_id")
    marked = hashes.withColumn("turns", F.max("n").over(last))
    whole = marked.where("n = turns").groupBy(*_PREFIX).agg(F.min("conv_id").alias("conv_id"))
    # one row for each prefix however many conversations begin with it: made distinct before the shuffle
    proper = marked.where("n < turns").select(*_PREFIX).distinct()
    return whole.join(proper, _PREFIX, "left_anti").select("conv_id", "n")


def render(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, rendered for each maximal conversation, turns in order.

    Rows without conv_id belong to no conversation and are dropped; a null role
    or text is empty; turns with equal or null numbers are ordered by role and text.
    """
    rows = turns(conversations)
    kept = maximal(rows).select("conv_id")
    line = F.concat(F.lit("<|"), "role", F.lit("|>\n"), "text", F.lit("\n"))
    said = rows.join(kept, "conv_id", "left_semi").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("n", line.alias("line")))).alias("lines"))
    return said.select("conv_id", F.size("lines").cast("bigint").alias("n_turns"), F.array_join(F.transform("lines", lambda x: x["line"]), "").alias("rendered"))


RENDER_SQL = """
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS n FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT conv_id, n, max(n) OVER (PARTITION BY conv_id) AS turns,
  md5(string_agg(md5(role) || md5(text), ',') OVER (PARTITION BY conv_id ORDER BY n)) AS h FROM t),
w AS (SELECT min(conv_id) AS conv_id, h FROM p WHERE n = turns GROUP BY h),
k AS (SELECT conv_id FROM w WHERE h NOT IN (SELECT h FROM p WHERE n < turns))
SELECT conv_id, count(*) AS n_turns, string_agg('<|' || role || '|>' || chr(10) || text || chr(10), '' ORDER BY n) AS rendered
FROM t WHERE conv_id IN (SELECT conv_id FROM k) GROUP BY conv_id
"""
