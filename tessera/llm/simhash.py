"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits.  Two
fingerprints that differ in at most two bits agree wholly in at least one
segment (three segments, two errors), and in another they differ in at most
two bits.  Padded to 23 bits, the other segment is decoded by the perfect
binary Golay code [23, 12, 7]: the keys of a word are the indices of the
codewords that it or a word one bit away decodes to, one key for a word within
two bits of a codeword, otherwise six.  Words at most two bits apart have a
word between them, and so share a key.  Fingerprints therefore join on (place
of the equal segment, its bits, codeword index of the next segment), and are
verified by the count of differing bits.

Only distinct fingerprints take part.  A bucket of up to SMALL fingerprints is
verified pair by pair; in a larger one every fingerprint is joined with the 65
words within one bit of it, and fingerprints that meet at such a word are at
most two bits apart: the same links up to reachability, linear in the bucket,
and no group has more than 65 rows.

Near copies by Jaccard similarity (``similar``) are further apart: at 0.8 a bit
of the fingerprint differs with a chance of 0.15, so a segment is never sure to
be equal as a whole, but two segments of 23 bits share a Golay key with one of
0.60.  There a fingerprint has WORDS segments of 23 bits, and in place of an equal
segment stands an equal group of ROWS least hashes, of which there are BANDS:
candidates join on (group, codeword index of the group's segment), and each is
verified on the shingles.  A pair at 0.8 is missed with a chance of 6e-6, a
closer one with less.  A group of up to SMALL shingle sets is met by these keys;
in a larger one all are compared with HUBS of them (the same ones in all groups
that they are in, so that a pair is met once), and then what is not in the
group's largest component with all that are not in its own component and may be
similar by rare shingles, places and bitmaps (none of which loses a pair),
whatever their keys.

Very long texts are hashed whole, in spans; ties (equal fingerprints, equal
shingle sets) fall together, and the smallest key names a component.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ODD, map_batches, mixed, packed, raw_texts, returned, unpacked, word_hashes, written

SEED, SHINGLE, BITS = 42, 3, 2
SMALL = 32
#: Of ``similar``: words of a shingle, least similarity, groups of least hashes, hashes in a group, segments of a fingerprint, sets that a large bucket is compared with first.
WIDTH, SIMILARITY, BANDS, ROWS, WORDS, HUBS = 5, 0.8, 48, 4, 24, 2
#: Counters of shingles, by which the rare ones are known.
COUNTERS = 1 << 20
#: Longs of a shingle set's bitmap, and the columns that they are in.
LONGS = 8
BITMAP = [f"bits{i}" for i in range(LONGS)]
#: Generator polynomial of the binary Golay code, its length, its dimension.
GENERATOR, LENGTH, DIMENSION = 0b101011100011, 23, 12
SEGMENTS = ((0, 22), (22, 21), (43, 21))
_SPACE = bytes(0x20 if c in (0x20, *range(9, 14)) else c for c in bytes(range(256)).lower())


def _remainders(words: np.ndarray) -> np.ndarray:
    """Syndromes: remainders of the words as polynomials by the generator."""
    r = words.astype(np.uint32).copy()
    for bit in range(LENGTH - 1, LENGTH - DIMENSION - 1, -1):
        r ^= np.where(r >> np.uint32(bit) & np.uint32(1), np.uint32(GENERATOR << (bit - (LENGTH - DIMENSION))), np.uint32(0))
    return r


def _corrections() -> np.ndarray:
    """The only pattern of at most three errors of each of the 2048 syndromes."""
    ones = np.uint32(1) << np.arange(LENGTH, dtype=np.uint32)
    patterns = {0} | {int(a | b | c) for a in ones for b in ones for c in ones}
    table = np.zeros(1 << (LENGTH - DIMENSION), np.uint32)
    p = np.array(sorted(patterns), np.uint32)
    table[_remainders(p)] = p
    return table


class Golay:
    def __init__(self) -> None:
        self.corrections = _corrections()

    def decode(self, words: np.ndarray) -> np.ndarray:
        """Index of the nearest codeword: its upper 12 bits."""
        words = words.astype(np.uint32)
        return (words ^ self.corrections[_remainders(words)]) >> np.uint32(LENGTH - DIMENSION)

    def keys(self, words: np.ndarray) -> np.ndarray:
        """A row of 24 indices for each word, repeats included."""
        near = np.concatenate([np.zeros(1, np.uint32), np.uint32(1) << np.arange(LENGTH, dtype=np.uint32)])
        return self.decode((words.astype(np.uint32)[:, None] ^ near).ravel()).reshape(-1, LENGTH + 1)


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 of every ``width`` words in a row; of all words if they are fewer; none without words."""
    w = text.translate(_SPACE).split(b" ")
    w = [x for x in w if x]
    if not w:
        return np.zeros(0, "<u8")
    joined, n = b" ".join(w), max(1, len(w) - width + 1)
    digest = xxhash.xxh64_intdigest
    if len(w) <= width:
        return np.array([digest(joined, SEED)], "<u8")
    ends = np.cumsum([len(x) + 1 for x in w])
    starts = [0, *ends[: n - 1].tolist()]
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True)], "<u8")


def fingerprint(text: bytes) -> int:
    """Bits set in over half the XXH64 hashes of the text's shingles; 0 without words."""
    h = shingle_hashes(text, SHINGLE)
    n, total = len(h), np.zeros(64, np.int64)
    for i in range(0, n, 1 << 15):
        total += np.unpackbits(h[i : i + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key and fp (the 64 bits as a signed long) of every row; null counts as empty."""
    small = docs.select(F.col(key), F.col("text"))

    def make():
        def handle(batch: pa.RecordBatch):
            fp = np.array([fingerprint(t) for t in raw_texts(batch.column("text"))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(fp)], [key, "fp"])

        return handle

    return map_batches(small, returned(small, [key], "fp bigint"), make)


def golay_keys(distinct: DataFrame) -> DataFrame:
    """fp and key for every key of every fingerprint of ``distinct``."""

    def make():
        golay = Golay()

        def handle(batch: pa.RecordBatch):
            fp = batch.column("fp").to_numpy()
            u = fp.view(np.uint64)
            parts = [(u >> np.uint64(at)) & np.uint64((1 << n) - 1) for at, n in SEGMENTS]
            for i in range(3):
                keys = golay.keys(parts[(i + 1) % 3]).astype(np.int64)
                keys = (np.int64(i) << np.int64(40)) | (parts[i].astype(np.int64)[:, None] << np.int64(12)) | keys
                keys.sort(axis=1)
                first = np.ones(keys.shape, bool)
                first[:, 1:] = keys[:, 1:] != keys[:, :-1]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(fp, first.sum(1))), pa.array(keys[first])], ["fp", "key"])

        return handle

    return map_batches(distinct.select("fp"), "fp bigint, key bigint", make)


def coded(rows: DataFrame) -> DataFrame:
    """``rows`` (sid, n, band, word), each once for every Golay key of its word, ``code`` in place of the word."""

    def make():
        golay = Golay()

        def handle(batch: pa.RecordBatch):
            for at in range(0, batch.num_rows, 1 << 13):
                part = batch.slice(at, 1 << 13)
                keys = golay.keys(part.column("word").to_numpy())
                keys.sort(axis=1)
                first = np.ones(keys.shape, bool)
                first[:, 1:] = keys[:, 1:] != keys[:, :-1]
                taken = part.select(["sid", "n", "band"]).take(pa.array(np.repeat(np.arange(part.num_rows), first.sum(1))))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(keys[first].astype(np.int32))], ["sid", "n", "band", "code"])

        return handle

    return map_batches(rows.select("sid", "n", "band", "word"), "sid bigint, n bigint, band bigint, code int", make)


def links(distinct: DataFrame) -> DataFrame:
    """Verified links a < b between fingerprints, enough of them that what is reachable over all links is over these."""
    keyed = golay_keys(distinct)
    shared = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1")
    shared = written(shared, "buckets")
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= BITS
    two = shared.where("n = 2").select("a", "b").where(close)
    more = written(keyed.join(shared.where("n > 2").select("key", "n"), "key"), "bucketed")
    few = more.where(F.col("n") <= SMALL).select("key", "fp")
    pairs = few.withColumnRenamed("fp", "a").join(few.withColumnRenamed("fp", "b"), "key").where(F.col("a") < F.col("b")).where(close).select("a", "b")
    many = more.where(F.col("n") > SMALL).select("fp").distinct()
    near = many.select("fp", F.explode(F.concat(F.array(F.col("fp")), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), i))))).alias("word"))
    met = near.groupBy("word").agg(F.min("fp").alias("a"), F.collect_list("fp").alias("all")).where(F.size("all") > 1)
    stars = met.select("a", F.explode("all").alias("b")).where("a <> b")
    return two.unionByName(pairs).unionByName(stars).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node and root (its smallest reachable node) of the nodes in ``edges`` (a, b), by alternating large and small stars.

    Each round is written to the shared folder, so a lost executor costs one round.
    """
    spark = edges.sparkSession

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        joined = both.join(least, "a")
        if large:
            return joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    e = written(edges.select("a", "b").where("a <> b"), "edges")
    before = state(e)
    if not before[0]:
        return spark.createDataFrame([], "node bigint, root bigint")
    for _ in range(rounds):
        e = written(star(star(e, True), False), "stars")
        now = state(e)
        if now == before:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = now
    raise RuntimeError("the components did not settle")


def near_duplicates(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, fp and component_id (smallest key reachable) of every row.

    Words are runs without white space, A-Z lower-cased.  Null and empty texts
    have fingerprint 0 and link like any other.  Repeated rows fall together.
    """
    fps = written(fingerprints(docs, key), "fingerprints")
    distinct = written(fps.groupBy("fp").agg(F.min(key).alias("least")), "distinct")
    linked = written(components(links(distinct)), "components")
    roots = distinct.join(linked.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = roots.join(ids, "root").select("fp", "component_id")
    # a hot fingerprint's rows are many on the left and one on the right: adaptive execution splits such a partition
    return fps.join(by_fp, "fp", "left").select(key, "fp", "component_id")


_SALTS = np.random.default_rng(BITS).integers(1, 1 << 63, (2, BANDS * ROWS, 1), dtype=np.uint64)


def bands(h: np.ndarray) -> np.ndarray:
    """Keys of a set of hashes: each of ROWS least hashes, under functions of their own."""
    least = np.full(BANDS * ROWS, (1 << 64) - 1, np.uint64)
    for i in range(0, len(h), 512):
        np.minimum(least, ((h[None, i : i + 512] ^ _SALTS[0]) * (_SALTS[1] | np.uint64(1))).min(axis=1), out=least)
    rows = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), i) for i, r in enumerate(rows)], np.uint64)


_MIXES = np.random.default_rng(LENGTH).integers(1, 1 << 63, (2, WORDS // 2, 1), dtype=np.uint64)


def segments(h: np.ndarray) -> np.ndarray:
    """Words of LENGTH bits of the fingerprint of a set of hashes: a bit is set in over half of what it has of the hashes, mixed anew for every two words."""
    total = np.zeros((WORDS // 2, 64), np.int64)
    for i in range(0, len(h), 512):
        m = mixed((h[None, i : i + 512] ^ _MIXES[0]) * (_MIXES[1] | np.uint64(1)))
        total += np.unpackbits(m.view(np.uint8).reshape(*m.shape, 8), axis=2).sum(axis=1, dtype=np.uint16)
    bits = (2 * total > len(h))[:, : 2 * LENGTH].reshape(WORDS, LENGTH)
    return (bits @ (1 << np.arange(LENGTH))).astype(np.int32)


def sketches(docs: DataFrame, key: str, width: int) -> DataFrame:
    """key, and of the row's shingle set: sid (a hash of it), n (its size), bands and words of its fingerprint (none for the empty set)."""
    small = docs.select(F.col(key), F.col("text"))

    def make():
        def handle(batch: pa.RecordBatch):
            sets = [shingle_set(t, width) for t in raw_texts(batch.column("text"))]
            sid = pa.array(np.array([set_id(h) for h in sets], np.uint64).view(np.int64))
            keys = pa.array([bands(h).view(np.int64) if len(h) else np.zeros(0, np.int64) for h in sets], pa.list_(pa.int64()))
            words = pa.array([segments(h) if len(h) else np.zeros(0, np.int32) for h in sets], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(key), sid, pa.array([len(h) for h in sets], pa.int64()), keys, words], [key, "sid", "n", "bands", "words"])

        return handle

    return map_batches(small, returned(small, [key], "sid bigint, n bigint, bands array<bigint>, words array<int>"), make)


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """Distinct hashes, in order, of every ``width`` words in a row; of all words if they are fewer; none without words."""
    h = word_hashes(text.translate(_SPACE))
    n = max(1, len(h) - width + 1)
    total = h[:n]
    for i in range(1, min(width, len(h))):
        total = mixed(total * np.uint64(ODD) + h[i : i + n])
    return np.unique(total)


def set_id(h: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(h.tobytes(), SEED)


def shingle_sets(docs: DataFrame, rows: DataFrame, sids: DataFrame, key: str, width: int) -> DataFrame:
    """sid and hashes (in order) of the sets that are asked for.  Only texts of these are hashed again; they are shuffled once and not written whole."""
    chosen = rows.join(sids, "sid", "left_semi").groupBy("sid").agg(F.min(key).alias("__id")).withColumnRenamed("sid", "__sid")
    texts = docs.select(F.col(key), "text").join(chosen.hint("shuffle_hash"), F.col(key) == F.col("__id")).select("__sid", "text")

    def make():
        def handle(batch: pa.RecordBatch):
            out = []
            for sid, text in zip(batch.column("__sid").to_pylist(), raw_texts(batch.column("text")), strict=True):
                h = shingle_set(text, width)
                if set_id(h) == sid % (1 << 64):  # rows of one key may differ in text
                    out.append((sid, h.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.binary())], ["sid", "hashes"])

        return handle

    return map_batches(texts, "sid bigint, hashes binary", make).groupBy("sid").agg(F.any_value("hashes").alias("hashes"))


def verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Those of the pairs (a, b) of sets that are as similar as ``least``."""

    def make():
        def handle(batch: pa.RecordBatch):
            close = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                both = len(np.intersect1d(x, y, assume_unique=True))
                close.append(both >= least * (len(x) + len(y) - both) - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(close, pa.bool_()))

        return handle

    found = pairs.join(sets.select(F.col("sid").alias("a"), F.col("hashes").alias("x")), "a").join(sets.select(F.col("sid").alias("b"), F.col("hashes").alias("y")), "b")
    return map_batches(found.select("a", "b", "x", "y"), "a bigint, b bigint", make)


def frequencies(sets: DataFrame) -> np.ndarray:
    """In how many sets a shingle is, counted by the low bits of its hash: ``COUNTERS`` numbers, however many sets there are."""

    def run(batches):
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for h in batch.column("hashes").to_pylist():
                np.add.at(total, np.frombuffer(h, "<u8") % COUNTERS, 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["at", "n"])

    counts = np.zeros(COUNTERS, np.int64)
    for r in sets.select("hashes").mapInArrow(run, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r["at"]] = r["n"]
    return counts


def bitmap(h: np.ndarray) -> np.ndarray:
    """LONGS longs, whose bits are the parities of how many of the hashes fall on each: two sets differ in as many hashes as their bitmaps do in bits, or more."""
    odd = np.bincount((h >> np.uint64(32)).astype(np.int64) % (64 * LONGS), minlength=64 * LONGS) % 2
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def prefixes(sets: DataFrame, counts: np.ndarray, least: float) -> DataFrame:
    """Rarest shingles of each set (sid, hashes, root, apart) and their places (from 0), a row each, with what is known of the set, its size n and its bitmap: two sets as similar as ``least`` have one of these shingles in common, in any fixed order of shingles."""

    def make():
        def handle(batch: pa.RecordBatch):
            kept, maps = [], []
            for h in batch.column("hashes").to_pylist():
                h = np.frombuffer(h, "<u8")
                kept.append(h[np.lexsort((h, counts[h % COUNTERS]))[: len(h) - math.ceil(least * len(h) - 1e-9) + 1]].view(np.int64))
                maps.append([len(h), *bitmap(h)])
            if not kept:
                return
            times = [len(k) for k in kept]
            own = batch.select(["sid", "root", "apart"]).take(pa.array(np.repeat(np.arange(len(kept)), times)))
            more = np.repeat(np.array(maps, np.int64), times, axis=0)
            places = np.concatenate([np.arange(t, dtype=np.int64) for t in times])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(kept)), pa.array(places), *own.columns, *map(pa.array, np.ascontiguousarray(more.T))], ["shingle", "place", "sid", "root", "apart", "n", *BITMAP])

        return handle

    return map_batches(sets, f"shingle bigint, place bigint, sid bigint, root bigint, apart boolean, n bigint, {', '.join(f'{c} bigint' for c in BITMAP)}", make)


def similar(docs: DataFrame, key: str = "doc_id", width: int = WIDTH, least: float = SIMILARITY) -> DataFrame:
    """key and component_id (smallest key reachable over texts whose shingle sets have a Jaccard similarity of ``least`` or more) of every row.

    Words are those of the fingerprint; a text of fewer than ``width`` words has
    them as its one shingle, and texts without words are alike.

    Of the sets of a large group that are still apart, only those are compared
    that share one of their rarest shingles, as all do that are similar enough,
    and whose bitmaps are no further apart than similar sets' can be: texts that
    have a template in common, but less than the similarity, don't meet.
    """
    rows = written(sketches(docs, key, width), "sketches")
    by_sid = rows.groupBy("sid").agg(*[F.any_value(c).alias(c) for c in ("n", "bands", "words")])
    keyed = by_sid.select("sid", "n", "words", F.posexplode("bands").alias("place", "band"))
    keyed = keyed.select("sid", "n", "band", F.get("words", (F.col("place") * WORDS / BANDS).cast("int")).alias("word"))
    more = written(keyed.join(keyed.groupBy("band").agg(F.count("*").alias("m")).where("m > 1"), "band"), "bucketed")

    def pairs(one: DataFrame, other: DataFrame, *more: str) -> DataFrame:
        """Sets of one bucket that differ, in sizes that allow the similarity."""
        same = [F.col(f"{c}_1") == F.col(f"{c}_2") for c in more or ("band",)]
        met = one.toDF(*[f"{c}_1" for c in one.columns]).join(other.toDF(*[f"{c}_2" for c in other.columns]), same)
        return met.where(F.col("sid_1") != F.col("sid_2")).where(F.least("n_1", "n_2") >= F.greatest("n_1", "n_2") * F.lit(least) - F.lit(1e-9))

    def ends(met: DataFrame) -> DataFrame:
        return met.select(F.least("sid_1", "sid_2").alias("a"), F.greatest("sid_1", "sid_2").alias("b"))

    def verify(found: DataFrame) -> DataFrame:
        sids = found.select(F.col("a").alias("sid")).union(found.select("b")).distinct()
        return verified(found, written(shingle_sets(docs, rows, sids, key, width), "sets"), least)

    few, many = coded(more.where(F.col("m") <= SMALL)), more.where(F.col("m") > SMALL).drop("m", "word")
    own = F.struct("sid", "n")
    hubs = many.groupBy("band").agg(F.array_distinct(F.array(*[F.min_by(own, F.xxhash64("sid", F.lit(i))) for i in range(HUBS)])).alias("hubs"))
    hubs = hubs.select("band", F.explode("hubs").alias("hub")).select("band", "hub.sid", "hub.n")
    # in a small bucket each pair that shares a Golay key
    first = ends(pairs(few, few, "band", "code").where("sid_1 < sid_2")).unionByName(ends(pairs(many, hubs))).distinct()
    first = written(first, "pairs")
    links = written(verify(first), "links")
    if not many.isEmpty():
        sets = written(shingle_sets(docs, rows, many.select("sid").distinct(), key, width), "sets")
        counts = frequencies(sets)

        linked = written(components(links), "components")
        rooted = many.join(linked.withColumnRenamed("node", "sid"), "sid", "left").select("band", "sid", F.coalesce("root", "sid").alias("root"))
        rooted = written(rooted, "rooted")
        largest = rooted.groupBy("band", "root").agg(F.count("*").alias("c")).groupBy("band").agg(F.max_by("root", F.struct("c", "root")).alias("largest"))
        # a set once, in however many large groups it is
        known = rooted.join(largest, "band").groupBy("sid").agg(F.any_value("root").alias("root"), F.bool_or(F.col("root") != F.col("largest")).alias("apart"))
        rare = prefixes(sets.join(known, "sid"), counts, least)
        # of the first shingle that two sets share, neither has more after it than they can have in common
        shared = F.ceil((F.col("n_1") + F.col("n_2")) * F.lit(least / (1 + least)) - F.lit(1e-6))
        reach = (F.col("n_1") - F.col("place_1") >= shared) & (F.col("n_2") - F.col("place_2") >= shared)
        unlike = reduce(Column.__add__, [F.bit_count(F.col(f"{c}_1").bitwiseXOR(F.col(f"{c}_2"))) for c in BITMAP])
        met = pairs(rare, rare, "shingle").where("(apart_1 or apart_2) and sid_1 < sid_2 and root_1 <> root_2").where(reach & (unlike <= F.col("n_1") + F.col("n_2") - 2 * shared))
        second = ends(met).distinct().join(first, ["a", "b"], "left_anti")
        links = written(links.unionByName(verified(written(second, "pairs"), sets, least)), "links")
    linked = written(components(links), "components")
    by_set = rows.groupBy("sid").agg(F.min(key).alias("own")).join(linked.withColumnRenamed("node", "sid"), "sid", "left").select("sid", "own", F.coalesce("root", "sid").alias("root"))
    ids = by_set.groupBy("root").agg(F.min("own").alias("component_id"))
    return rows.select(key, "sid").join(by_set.join(ids, "root").select("sid", "component_id"), "sid").select(key, "component_id")


def keep_one(docs: DataFrame, width: int | None = None, least: float = SIMILARITY) -> DataFrame:
    """One row of each component: that with the smallest doc_id, null last (of rows with one id and different texts, any one of the texts; of equal rows, any one).

    With ``width``, components are those of ``similar`` shingles of so many words; else of near fingerprints.
    Columns as they are, whatever their names.  Rows without id take part like others.
    """
    # the key of a row: its id and a hash of its text, in one struct that sorts ids without value last
    own = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("digest"))
    known = docs.select(own.alias("key"), "text")
    found = near_duplicates(known, "key") if width is None else similar(known, "key", width, least)
    kept = found.where("key = component_id").groupBy("key").agg(F.count("*").alias("rows"))
    # a hash join by the small side: texts are shuffled once and not sorted
    rows = packed(docs, key=own).join(kept.hint("shuffle_hash"), "key")
    one, more = rows.where("rows = 1"), rows.where("rows > 1")
    return unpacked(one.unionByName(more.dropDuplicates(["key"])), docs)
