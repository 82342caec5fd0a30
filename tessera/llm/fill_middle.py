"""Fill-in-the-middle transformation by escaped marker injection.

A delimiter that occurs in no escaped text is appended after each line by one
``regexp_replace``; counting it gives the number of lines, and
``substring_index`` cuts the escaped text before and after the lines of a
given rank.  The three parts are unescaped and put in the order of the form.
Everything is an expression on the row: nothing is shuffled, no text leaves
its task, and a long text costs what its length costs.

Cuts and form come from the SHA-256 of the seed and doc_id, so that a row's
result depends on no other row, order or partitioning.

A null text is an empty one, which stays plain with no lines; a null doc_id
hashes like an empty one.  Repeated rows are transformed alike.  Texts that
hold a marker stay plain, so that every output can be taken apart again.  Very
long texts and lines are handled whole.  All columns of the input are carried
as one struct, ``row``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import packed

MARKERS = ("<P>", "<S>", "<M>")
#: Escape character, what follows it for itself and for the delimiter, and the delimiter.
ESC, SELF, OTHER, END = "\x1b", "0", "1", "\x1e"
LINE = r"[^\n]*\n|[^\n]+"


def escape(text: Column) -> Column:
    """The text without ``END``."""
    return F.replace(F.replace(text, F.lit(ESC), F.lit(ESC + SELF)), F.lit(END), F.lit(ESC + OTHER))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(ESC + OTHER), F.lit(END)), F.lit(ESC + SELF), F.lit(ESC))


def part(marked: Column) -> Column:
    """The original text of some of the marked lines."""
    return unescape(F.replace(marked, F.lit(END), F.lit("")))


def rank(text: Column, delimiter: str | Column, count: Column | int) -> Column:
    return F.call_function("substring_index", text, F.lit(delimiter), count if isinstance(count, Column) else F.lit(count))


def restore(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text that an output was made from."""
    p, s, m = markers
    head, middle = rank(output, m, 1), rank(output, m, -1)
    psm = F.concat(F.replace(rank(head, s, 1), F.lit(p), F.lit("")), middle, rank(head, s, -1))
    spm = F.concat(rank(head, p, -1), middle, F.replace(rank(head, p, 1), F.lit(s), F.lit("")))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def transform(docs: DataFrame, seed: int = 7, rate: int = 100, spm_rate: int = 50, markers: tuple[str, str, str] = MARKERS) -> DataFrame:
    """``row`` with all columns of ``docs``, then n (lines), form, prefix_chars, middle_chars and output.

    ``rate`` percent of the texts are transformed, ``spm_rate`` percent of those
    with the suffix first.  Markers must be unlike and begin and end with
    characters that they have nowhere else, so that joining parts makes no new one.
    """
    p, s, m = markers
    rows = packed(docs, text=F.coalesce("text", F.lit("")), hex=F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256))
    rows = rows.withColumn("marked", F.regexp_replace(escape(F.col("text")), f"({LINE})", f"$1{END}"))
    rows = rows.withColumn("n", (F.length("marked") - F.length(F.replace("marked", F.lit(END), F.lit("")))).cast("bigint"))
    draw = lambda k: F.conv(F.substring("hex", 8 * k + 1, 8), 16, 10).cast("bigint")
    cuts = [draw(k) % (F.col("n") + 1) for k in (0, 1)]
    plain = (F.col("text") == "") | F.col("text").contains(p) | F.col("text").contains(s) | F.col("text").contains(m) | (draw(2) % 100 >= rate)
    form = F.when(plain, "plain").when(draw(3) % 100 < spm_rate, "spm").otherwise("psm")
    rows = rows.select("row", "text", "marked", "n", form.alias("form"), F.least(*cuts).cast("int").alias("lo"), F.greatest(*cuts).cast("int").alias("hi"))
    parts = {
        "prefix": rank(F.col("marked"), END, F.col("lo")),
        "middle": rank(rank(F.col("marked"), END, F.col("hi")), END, F.col("lo") - F.col("hi")),
        "suffix": rank(F.col("marked"), END, F.col("hi") - F.col("n").cast("int") - 1),
    }
    cut = F.col("form") != "plain"
    rows = rows.select("row", "text", "n", "form", *[F.when(cut, part(v)).alias(k) for k, v in parts.items()])
    output = F.when(F.col("form") == "psm", F.concat(F.lit(p), "prefix", F.lit(s), "suffix", F.lit(m), "middle")).when(F.col("form") == "spm", F.concat(F.lit(s), "suffix", F.lit(p), "prefix", F.lit(m), "middle")).otherwise(F.col("text"))
    return rows.select("row", "n", "form", *[F.length(k).cast("bigint").alias(f"{k}_chars") for k in ("prefix", "middle")], output.alias("output"))


FILL_SQL = r"""
WITH t AS (SELECT doc_id, coalesce("text", '') AS txt, regexp_extract_all(coalesce("text", ''), '[^\n]*\n|[^\n]+') AS u,
  sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
d AS (SELECT *, CAST(len(u) AS BIGINT) AS n, [CAST('0x' || substr(h, 8 * k + 1, 8) AS BIGINT) FOR k IN [0, 1, 2, 3]] AS v FROM t),
c AS (SELECT *, least(v[1] % (n + 1), v[2] % (n + 1)) AS lo, greatest(v[1] % (n + 1), v[2] % (n + 1)) AS hi,
  CASE WHEN txt = '' OR contains(txt, '<P>') OR contains(txt, '<S>') OR contains(txt, '<M>') OR v[3] % 100 >= 100 THEN 'plain' WHEN v[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT *, array_to_string(u[1:lo], '') AS pre, array_to_string(u[lo + 1:hi], '') AS mid, array_to_string(u[hi + 1:], '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE txt END) AS output_sha256,
  sha256(txt) AS restored_sha256 FROM p
"""
