"""Documents with the awkward cases that every operator meets."""

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
CLASH = T.StructType([*DOCS.fields, T.StructField("key", T.StringType()), T.StructField("fp", T.StringType()), T.StructField("n_words", T.StringType()), T.StructField("ids", T.StringType()), T.StructField("shard", T.StringType()), T.StructField("__x", T.StringType()), T.StructField("hits", T.StringType()), T.StructField("run", T.StringType()), T.StructField("n", T.StringType()), T.StructField("root", T.StringType())])

PROSE = "The quick brown fox jumps over the lazy dog while seven wizards quietly examine forty boxes of liquor. "
ODD = [
    None,
    "",
    " ",
    "\n\n",
    "12345 67890 !!!",
    "one",
    "Zwei Wörter",
    "  leading and trailing  ",
    "tabs\tand\r\nreturns\x0b\x0c here",
    "日本語のテキストです。 混在 mixed",
    "<s> </s> <|endoftext|> <unk> <0x0A>",
    "😀 émigré naïve coöperate İstanbul ΣΑΣ",
    "x" * 3000,
    PROSE * 200,
    PROSE * 3,
    PROSE * 3,
    PROSE * 3 + "tail",
    "é combining   nbsp   line",
]


def rows(texts=ODD):
    return [(i, t, ["en", "de", None][i % 3], f"s{i % 2}", None if t is None else len(t)) for i, t in enumerate(texts)]


def documents(spark, texts=ODD, extra_null_row=True):
    """The cases, one row twice, one row with nothing but nulls."""
    data = rows(texts)
    if extra_null_row:
        data = [*data, data[-1], (None, None, None, None, None)]
    return spark.createDataFrame(data, DOCS)


def clashing(spark, texts=ODD):
    return spark.createDataFrame([(*r, *["?"] * (len(CLASH.fields) - 5)) for r in rows(texts)], CLASH)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def sample(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
