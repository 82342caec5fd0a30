"""Document fingerprints: one-permutation MinHash with optimal densification and packed low-order bits.

Each shingle of five words (a shorter text: all its words) is hashed once; the
top bits of the hash deal it into one of 256 bins, and a bin keeps its least
hash.  An empty bin takes the hash of a bin that holds one: the first in a
sequence that depends on the empty bin alone (eight pseudo-random probes, then
all bins in a pseudo-random order), so that two texts whose bins are empty
alike borrow alike.  Of each bin eight low-order bits are stored, eight bins
in a 64-bit word.  Two unlike hashes agree in b bits with a chance of 2^-b, for
which the likeness of two fingerprints is corrected: (m - 2^-b) / (1 - 2^-b),
never under 0, where m is the share of the bins that agree.

Built-in functions only.  A fingerprint is made on its row, without a shuffle.

Neighbours (``edits``): the next document in descending order of doc_id is
found by one exchange of the texts.  Split points drawn from a sample of the
keys deal the rows to ranges; a window hands each row its successor in the
range, and the last row of a range gets the first row of the next range by a
join of one row for each range.  There are at most 20,000 ranges, so that all
that concerns ranges alone (split points, that join) is bounded.  A doc_id with
many rows is split like any range of keys, by the text's hash and the row's
place in the input.

A null text is empty.  A text without words has an empty fingerprint, which is
wholly like another such and unlike all others.  Documents without doc_id come
last in the order; rows with one doc_id are ordered by the hash of their text,
rows equal in both follow each other in any order.  A single document is its
own next one.  Repeated rows are kept, an empty table gives an empty result,
very long texts are handled whole.  Columns of any name are carried as one
struct, ``row``, without the text, so that it moves once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import named, written

BINS, BITS, SHINGLE = 256, 8, 5
WORD = 64 // BITS
PROBES = 8
#: Ranges of documents: at most so many, of about so many rows, split by so many sampled keys each.
RANGES, RANGE_ROWS, DRAWN = 20_000, 1000, 10
SPACE = r"[ \t\n\x0b\f\r]+"
_LOW = sum(1 << BITS * k for k in range(WORD))


def _bin(h: Column) -> Column:
    """0 to 255, in the order of the hashes."""
    return (F.shiftright(h, 64 - (BINS - 1).bit_length()) + BINS // 2).cast("int")


def _absent(n: Column) -> Column:
    return F.array_repeat(F.lit(None).cast("bigint"), n)


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """``df`` and, as ``name``, the packed fingerprint of its column ``text``: bigints, none for a text without words."""
    kept = [F.col(c) for c in df.columns if c != name]
    rows = df.select(*kept, F.array_remove(F.split(F.col(text), SPACE), "").alias("_w"))
    # beyond the last word of a short text are nulls, which leave a hash as it is
    shingles = F.transform(F.sequence(F.lit(0), F.greatest(F.size("_w") - SHINGLE, F.lit(0))), lambda i: F.xxhash64(*[F.get("_w", i + k) for k in range(SHINGLE)]))
    rows = rows.select(*kept, F.when(F.size("_w") > 0, F.sort_array(shingles)).alias("_h"))
    # sorted, so that the first hash of a bin is its least and bins are in order
    rows = rows.select(*kept, F.filter("_h", lambda x, i: (i == 0) | (_bin(x) != _bin(F.get("_h", i - 1)))).alias("_h"))
    before = lambda i: F.when(i == 0, F.lit(-1)).otherwise(_bin(F.get("_h", i - 1)))
    spread = F.flatten(F.transform("_h", lambda x, i: F.concat(_absent(_bin(x) - before(i) - 1), F.array(x))))
    bins = F.when(F.size("_h") == BINS, F.col("_h")).otherwise(F.concat(spread, _absent(BINS - 1 - _bin(F.element_at("_h", -1)))))
    rows = rows.select(*kept, "_h", bins.alias("_b"))
    probe = lambda i, k: F.get("_b", F.pmod(F.xxhash64(i, F.lit(k)), F.lit(BINS)).cast("int"))
    probed = F.transform("_b", lambda v, i: F.coalesce(v, *[probe(i, k) for k in range(PROBES)]))
    rows = rows.select(*kept, "_h", F.when(F.size("_h") == BINS, F.col("_b")).otherwise(probed).alias("_b"))
    least = lambda i: F.array_min(F.transform("_h", lambda x: F.struct(F.xxhash64(i, _bin(x) + PROBES).alias("rank"), x.alias("hash"))))["hash"]
    full = F.when(F.exists("_b", lambda v: v.isNull()), F.transform("_b", lambda v, i: F.when(v.isNull(), least(i)).otherwise(v))).otherwise(F.col("_b"))
    rows = rows.select(*kept, full.alias("_b"))
    field = lambda w, k: F.shiftleft(F.get("_b", w * WORD + k).bitwiseAND(F.lit((1 << BITS) - 1)), BITS * (WORD - 1 - k))
    word = lambda w: reduce(Column.bitwiseOR, [field(w, k) for k in range(WORD)])
    words = F.transform(F.sequence(F.lit(0), F.lit(BINS // WORD - 1)), word)
    return rows.select(*kept, F.when(F.col("_b").isNull(), F.array().cast("array<bigint>")).otherwise(words).alias(name))


def to_hex(fingerprint: str | Column) -> Column:
    return F.lower(F.array_join(F.transform(fingerprint, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def likeness(a: str, b: str) -> Column:
    """Estimated Jaccard similarity of the shingles of two texts, by their packed fingerprints."""

    def unlike(x: Column, y: Column) -> Column:
        """Fields of the two words that differ: their bits are folded onto the lowest of each field."""
        d, s = x.bitwiseXOR(y), 1
        while s < BITS:
            d, s = d.bitwiseOR(F.shiftrightunsigned(d, s)), 2 * s
        return F.bit_count(d.bitwiseAND(F.lit(_LOW).cast("bigint")))

    differing = F.aggregate(F.zip_with(a, b, unlike), F.lit(0), lambda n, x: n + x)
    chance = 2.0**-BITS
    estimate = F.greatest(F.lit(0.0), (F.lit(1.0) - differing / F.lit(float(BINS)) - chance) / (1 - chance))
    one_empty = (F.size(a) == 0) | (F.size(b) == 0)
    return F.when(one_empty, (F.size(a) == F.size(b)).cast("double")).otherwise(estimate)


def _splits(keys: DataFrame, n: int, fraction: float) -> tuple[str, int]:
    """At most n split points of the column ``key`` as JSON, ascending, and how many of them are distinct."""
    drawn = keys.sample(min(1.0, fraction), 1).agg(F.sort_array(F.collect_list("key")).alias("k"))
    every = F.greatest(F.ceil(F.size("k") / F.lit(n)), F.lit(1))
    found = drawn.select(F.filter("k", lambda _, i: i % every == 0).alias("k")).select(F.to_json("k").alias("json"), F.size(F.array_distinct("k")).alias("distinct"), F.size("k").alias("size")).first()
    return found["json"], found["size"] - found["distinct"]


def in_ranges(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """``rows`` with ``range``, a number that grows with ``key``; ``docs`` has the doc_ids of the same documents."""
    spark = rows.sparkSession
    total = docs.count()
    n = min(RANGES, max(total // RANGE_ROWS, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")), 1))
    fraction = n * DRAWN / max(total, 1)
    none = F.lit(None).cast("bigint")
    json, repeated = _splits(docs.select(F.struct("doc_id", none.alias("hash"), none.alias("place")).alias("key")), n, fraction)
    if repeated:  # a doc_id that many rows share: split by all of the key
        json, _ = _splits(rows.select("key"), n, fraction)
    splits = F.from_json(F.lit(json), "array<" + rows.schema["key"].dataType.simpleString() + ">")
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(n.bit_length()))])
    found = F.aggregate(steps, F.lit(0), lambda at, s: F.when(F.coalesce(F.get(splits, at + s - 1) <= F.col("key"), F.lit(False)), at + s).otherwise(at))
    return rows.withColumn("range", found)


def _edited(rows: DataFrame, share: int, with_texts: bool, kept: list[str]) -> DataFrame:
    """Results for rows that have text, fp, next_text and next_fp."""
    moved = F.floor(F.col("n_chars") / share).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - moved), F.substring(F.col("next_text"), F.lit(1), moved))
    rows = with_fingerprint(rows.withColumn("edited", edited), "edited", "edited_fp")
    shown = [F.col("text"), F.col("edited")] if with_texts else []
    results = [F.sha2("edited", 256).alias("edited_sha256"), *shown, F.col("fp").alias("fingerprint"), F.col("edited_fp").alias("edited_fingerprint"), likeness("fp", "edited_fp").alias("near_edited"), likeness("fp", "next_fp").alias("near_next")]
    return rows.select("row", "n_chars", *results, *kept)


def edits(docs: DataFrame, share: int = 3, with_texts: bool = True) -> DataFrame:
    """Each document held against its edited text and its neighbour.

    The edited text: the last ``n_chars // share`` code points are replaced by
    the first as many, or all, of the next document.  ``row`` with all columns of
    ``docs`` but text, then n_chars, edited_sha256, text and edited (``with_texts``),
    fingerprint, edited_fingerprint, near_edited and near_next.
    """
    rows = docs.select(F.struct(*[named(c) for c in docs.columns if c != "text"]).alias("row"), F.coalesce("text", F.lit("")).alias("text"), "doc_id")
    rows = rows.select("row", "text", F.length("text").cast("bigint").alias("n_chars"), F.struct("doc_id", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("place")).alias("key"))
    rows = with_fingerprint(in_ranges(rows, docs.select("doc_id")), "text", "fp")
    order = Window.partitionBy("range").orderBy(F.desc("key"))
    near = rows.select("row", "text", "n_chars", "fp", "range", F.lead("text").over(order).alias("next_text"), F.lead("fp").over(order).alias("next_fp"), (F.row_number().over(order) == 1).alias("first"))
    near = near.withColumn("last", F.col("next_fp").isNull())
    # the first and last row of a range carry their text along
    edge = F.col("first") | F.col("last")
    near = near.withColumn("edge_text", F.when(edge, F.col("text"))).withColumn("edge_fp", F.when(edge, F.col("fp")))
    done = written(_edited(near, share, with_texts, ["range", "first", "last", "edge_text", "edge_fp"]), "edits")
    heads = done.where("first").select("range", F.col("edge_text").alias("next_text"), F.col("edge_fp").alias("next_fp"))
    # at most RANGES numbers
    order = Window.orderBy(F.desc("range"))
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    following = heads.select("range", F.coalesce(F.lead("range").over(order), F.max("range").over(everything)).alias("to"))
    ends = done.where("last").select("row", "n_chars", F.col("edge_text").alias("text"), F.col("edge_fp").alias("fp"), "range")
    ends = ends.join(following, "range").drop("range").join(heads.withColumnRenamed("range", "to"), "to")
    rest = done.where("not last").drop("range", "first", "last", "edge_text", "edge_fp")
    return rest.unionByName(_edited(ends, share, with_texts, []))
