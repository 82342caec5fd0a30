"""Prefix trie of conversations: succinct level-order tries of prefix shards, rolled up and merged.

A turn is 20 bytes: a 16-byte digest of role and text, and its number of
words.  Texts are never shuffled.  Chaining the digests along a conversation
gives each of its prefixes a key; the keys in order are its path.  Equal
conversations are collapsed to one weighted path before anything is sorted by
path, so a group of copies is one row.

Range partitions of the sorted paths are cut into shards of about 200,000
turns.  In a shard numpy builds the trie level by level: a LOUDS bit vector
(for each node in level order a one for each child and a zero) and the array of
labels.  Parents are read off the bit vector, and a walk from the last level
up adds each node to its parent (``add.at``): members, childless nodes, saved
words.  What can reach into another shard lies on a shard's first or last
path; these heavy upper nodes stay open: they leave as two paths with the sums
of their closed children and are merged by the same function, round by round
while there are many, at last in one task that sees a bounded number of turns.
A hot first turn, or a hot conversation, is thus spread over as many shards as
its continuations fill.

SHA-256 of member lists is sequential: ids are joined into chunks of 64 KB by
sorted ranges, and a node's digest reads its chunks in order.

Rows without conv_id belong to no conversation and are left out; a null role or
text is empty; turns with one number (or none: these come first) are ordered
by their digest; equal rows are turns like others.  No conversations give no
nodes, not even a root.  Very long texts become digests where they are read; a
conversation's path (20 bytes a turn) must fit in a worker.  Columns other than
conv_id, turn, role and text are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import pieces, release, written

#: Bytes of a path's step: digest and number of words.
DIGEST, STEP = 16, 20
#: Turns of a shard; turns that the last task may see; paths that a shard has at least; bytes of a chunk of ids.
SHARD, LAST, LEAST, CHUNK = 200_000, 1_000_000, 8, 1 << 16
BATCH = 4 << 20
SPACE = r"[ \t\n\x0b\f\r]+"
NONE = np.iinfo(np.int64).max

PATHS = "path binary, own bigint, least bigint, more binary"
NODES = "id binary, parent binary, depth bigint, conv_id bigint, parent_conv_id bigint, parent_open boolean, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint"


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1) and label of each turn."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.substring(F.sha2(F.concat(F.sha2(role.cast("binary"), 256), F.sha2(text.cast("binary"), 256)).cast("binary"), 256), 1, 2 * DIGEST)
    words = F.size(F.array_remove(F.split(text, SPACE), ""))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("bigint"), "turn", F.unhex(F.concat(digest, F.lpad(F.hex(words), 8, "0"))).alias("label"))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "label")
    return rows.select("conv_id", F.row_number().over(order).alias("pos"), "label")


def rebuilt(conversations: DataFrame, every: int = 20, heads: int = 4) -> DataFrame:
    """Turns of each conversation c, its first h replaced by those of conversation c - c % every; h is crc32(c) % heads.

    conv_id, pos and label, with a row of position 0 and no label for each conversation.
    """
    rows = written(turns(conversations), "turns")
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    convs = rows.select("conv_id").distinct()
    first = rows.where(F.col("pos") < heads).select(F.col("conv_id").alias("base"), "pos", "label")
    lent = convs.select("conv_id", (F.col("conv_id") - F.col("conv_id") % every).alias("base"), h.alias("h")).join(first, "base").where("pos <= h")
    own = rows.where(F.col("pos") > h)
    return own.unionByName(lent.select("conv_id", "pos", "label")).unionByName(convs.select("conv_id", F.lit(0).alias("pos"), F.lit(None).cast("binary").alias("label")))


def _batched(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows as batches of about ``BATCH`` bytes."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 32 + sum(len(v) for v in row if isinstance(v, bytes))
        if size > BATCH:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in held], schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in held], schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns], strict=True)


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One path for each conversation; rows come in order, position 0 first."""

    def paths():
        for conv, steps in groupby(_rows(batches), key=lambda r: r[0]):
            key, path = b"", bytearray()
            for _, _, label in steps:
                if label is not None:
                    key = hashlib.blake2b(key + label, digest_size=DIGEST).digest()
                    path += key + label[DIGEST:]
            yield conv, bytes(path)

    release()
    return _batched(paths(), pa.schema([("conv_id", pa.int64()), ("path", pa.binary())]))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted ids of a node, joined, in chunks."""

    def joined():
        for end, rows in groupby(_rows(batches), key=lambda r: r[0]):
            first, held = None, bytearray()
            for _, conv in rows:
                first = conv if first is None else first
                held += b"%d," % conv
                if len(held) > CHUNK:
                    yield end, first, bytes(held)
                    first, held = None, bytearray()
            if held:
                yield end, first, bytes(held)

    release()
    return _batched(joined(), pa.schema([("id", pa.binary()), ("first", pa.int64()), ("ids", pa.binary())]))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of a node's chunks in order, without the last comma."""

    def hashed():
        for end, rows in groupby(_rows(batches), key=lambda r: r[0]):
            digest, comma = hashlib.sha256(), b""
            for _, _, ids in rows:
                digest.update(comma + ids[:-1])
                comma = b","
            yield end, digest.hexdigest()

    release()
    return _batched(hashed(), pa.schema([("id", pa.binary()), ("ends_sha256", pa.string())]))


class Louds:
    """A trie in level order: LOUDS bits (packed), labels, first node of each level."""

    def __init__(self, degrees: np.ndarray, labels: np.ndarray, levels: list[int]) -> None:
        self.size, self.labels, self.levels = len(degrees), labels, levels
        bits = np.ones(2 * self.size + 1, np.uint8)  # "10" for the super-root, then each node's children and a zero
        bits[np.concatenate([[1], 1 + np.cumsum(degrees + 1)])] = 0
        self.bits = np.packbits(bits)

    def parents(self) -> np.ndarray:
        """Zeros before a node's one, less that of the super-root; -1 for the root."""
        ones = np.flatnonzero(np.unpackbits(self.bits, count=2 * self.size + 1))
        return ones - np.arange(self.size) - 1


def _trie(flat: np.ndarray, lengths: np.ndarray) -> tuple[Louds, np.ndarray, np.ndarray]:
    """Trie of sorted paths; the node of each step, and of each path's end."""
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    node_of = np.zeros(len(flat), np.int64)
    ends = np.zeros(len(lengths), np.int64)
    alive, above = np.arange(len(lengths)), np.zeros(len(lengths), np.int64)
    degrees, labels, levels, size, depth = [], [np.zeros((1, flat.shape[1]), flat.dtype)], [0, 1], 1, 0
    while len(alive):
        long = lengths[alive] > depth
        alive, above, wide = alive[long], above[long], levels[-1] - levels[-2]
        at = offsets[alive] + depth
        steps = flat[at]
        new = np.concatenate([[True], (steps[1:] != steps[:-1]).any(axis=1)]) if len(at) else np.zeros(0, bool)
        degrees.append(np.bincount(above[new] - levels[-2], minlength=wide))
        if not len(at):
            break
        nodes = size + np.cumsum(new) - 1
        node_of[at], ends[alive], above = nodes, nodes, nodes
        labels.append(steps[new])
        size += int(new.sum())
        levels.append(size)
        depth += 1
    return Louds(np.concatenate(degrees), np.concatenate(labels), levels), node_of, ends


def _merge(rows: list[tuple], last: bool) -> Iterator[tuple]:
    """Nodes of a shard that are complete, then, unless it is the last, its two open paths."""
    lengths = np.array([len(r[0]) // STEP for r in rows])
    flat = np.frombuffer(b"".join(r[0] for r in rows), np.uint32).reshape(-1, STEP // 4)
    trie, node_of, ends = _trie(flat, lengths)
    parent, size = trie.parents(), trie.size
    # members, childless nodes, saved words and children that are accounted for, by node; least member
    sums, least = np.zeros((4, size), np.int64), np.full(size, NONE)
    np.add.at(sums[0], ends, np.array([r[1] for r in rows], np.int64))
    np.minimum.at(least, ends, np.array([NONE if r[2] is None else r[2] for r in rows], np.int64))
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    along = lambda k: np.concatenate([[0], node_of[offsets[k] : offsets[k + 1]]])
    for k, (_, _, _, more) in enumerate(rows):
        if more is not None:
            told = np.frombuffer(more, np.int64).reshape(5, -1)
            np.add.at(sums, (slice(None), along(k)), told[:4])
            np.minimum.at(least, along(k), told[4])
    is_open = np.zeros(size, bool)
    if not last:
        is_open[along(0)] = is_open[along(len(rows) - 1)] = True
    words = trie.labels[:, -1].byteswap().astype(np.int64)  # written with the highest byte first
    for lo, hi in zip(trie.levels[-2:0:-1], trie.levels[:1:-1], strict=True):
        shut = lo + np.flatnonzero(~is_open[lo:hi])
        _close(sums, shut, words)
        up = parent[shut]
        for value in sums[:3]:
            np.add.at(value, up, value[shut])
        np.add.at(sums[3], up, 1)
        np.minimum.at(least, up, least[shut])
    if last:
        _close(sums, np.zeros(1, np.int64), words)
    depth = np.repeat(np.arange(len(trie.levels) - 1), np.diff(trie.levels))
    key = lambda i: trie.labels[i].tobytes() if i else b""
    for i in np.flatnonzero(~is_open).tolist():
        p = int(parent[i])
        known = i > 0 and not is_open[p]
        yield key(i), key(p) if i else None, int(depth[i]), int(least[i]), int(least[p]) if known else None, bool(i and is_open[p]), int(sums[0, i]), int(sums[3, i]), int(sums[1, i]), int(sums[2, i]), None, None, None, None
    if not last:
        told = np.concatenate([sums, least[None]])
        for k in dict.fromkeys((0, len(rows) - 1)):
            nodes = along(k)
            yield *[None] * 10, rows[k][0], 0, None, told[:, nodes].tobytes()
            told[:4, nodes], told[4, nodes] = 0, NONE  # the other path does not tell them again


def _close(sums: np.ndarray, nodes: np.ndarray, words: np.ndarray) -> None:
    """What the nodes add themselves, when all their children are in."""
    sums[1, nodes] += sums[3, nodes] == 0
    sums[2, nodes] += (sums[0, nodes] - 1) * words[nodes]


def _sharded(last: bool, shard: int):
    kinds = {"binary": pa.binary(), "bigint": pa.int64(), "boolean": pa.bool_()}
    schema = pa.schema([(n, kinds[k]) for n, k in (c.split() for c in f"{NODES}, {PATHS}".split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def merged():
            held, size = [], 0
            for row in _rows(batches):
                held.append(row)
                size += len(row[0]) // STEP + 1
                if not last and size >= shard and len(held) >= LEAST:
                    yield from _merge(held, last)
                    held, size = [], 0
            if held:
                yield from _merge(held, last)

        release()
        return _batched(merged(), schema)

    return run


def rollups(rows: DataFrame, shard: int = SHARD, limit: int = LAST) -> DataFrame:
    """The nodes of the trie of the conversations in ``rows`` (conv_id, pos, label; position 0 without a label).

    conv_id (least member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens (over the subtree, words that copies of a prefix repeat) and
    ends_sha256 of the members that end at the node.  Shards have about ``shard``
    turns, the last task at most ``limit``.
    """
    spark = rows.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "pos")
    paths = written(sorted_rows.select("conv_id", "pos", "label").mapInArrow(_chained, "conv_id bigint, path binary"), "paths")

    ranged = paths.select(F.substring("path", -STEP, STEP).alias("id"), "conv_id").repartitionByRange(tasks, "id", "conv_id").sortWithinPartitions("id", "conv_id")
    chunks = ranged.mapInArrow(_chunks, "id binary, first bigint, ids binary").repartition("id").sortWithinPartitions("id", "first")
    ends = chunks.mapInArrow(_digests, "id binary, ends_sha256 string")

    todo = paths.groupBy("path").agg(F.count("*").alias("own"), F.min("conv_id").alias("least")).withColumn("more", F.lit(None).cast("binary"))
    turns_left, done = pieces(spark, paths, f"length(path) / {STEP} + 1", 1), []
    while True:
        last = bool(done) and turns_left <= limit
        dealt = todo.coalesce(1) if last else todo.repartitionByRange(max(tasks, turns_left // shard), "path")
        found = written(dealt.sortWithinPartitions("path").mapInArrow(_sharded(last, shard), f"{NODES}, {PATHS}"), "trie")
        done.append(found.where("id is not null").select(*[c.split()[0] for c in NODES.split(", ")]))
        if last:
            break
        todo = found.where("path is not null").select("path", "own", "least", "more")
        turns_left = pieces(spark, todo, f"length(path) / {STEP} + 1", 1)

    nodes, upper = done[0], done[1]
    for more in done[2:]:
        upper = upper.unionByName(more)
    nodes = nodes.unionByName(upper)
    names = upper.select(F.col("id").alias("parent"), F.col("conv_id").alias("_least"))
    # a parent among the upper nodes may have any number of children: names are few and go to all, or else children are spread
    if names.count() <= 200_000:
        named = nodes.join(F.broadcast(names), "parent", "left")
    else:
        salt = F.explode(F.array(*[F.lit(k) for k in range(16)]))
        named = nodes.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(16)).cast("int")).join(names.withColumn("_salt", salt), ["parent", "_salt"], "left")
    nothing = hashlib.sha256().hexdigest()
    shown = named.join(ends, "id", "left").withColumn("parent_conv_id", F.when(F.col("parent_open"), F.col("_least")).otherwise(F.col("parent_conv_id")))
    return shown.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"))


TRIE_SQL = r"""
WITH t AS (SELECT CAST(conv_id AS BIGINT) AS c, sha256(sha256(coalesce(role, '')) || sha256(coalesce("text", '')))[1:32] AS d,
  len(regexp_extract_all(coalesce("text", ''), '[^ \t\n\x0b\f\r]+')) AS w, turn FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, d) AS pos, d, w FROM t),
convs AS (SELECT c, c - c % 20 AS base, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten([[CAST(ascii(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1] FOR x IN string_split(CAST(c AS VARCHAR), '')])),
  lambda a, x: CASE WHEN x < 0 THEN xor(a >> 1, 3988292384 * (a & 1)) ELSE xor(a, x) END), 4294967295) % 4 AS h FROM (SELECT DISTINCT c FROM t)),
r AS (SELECT n.c, pos, d, w FROM n JOIN convs USING (c) WHERE pos > h UNION ALL SELECT convs.c, pos, d, w FROM convs JOIN n ON n.c = base WHERE pos <= h UNION ALL SELECT c, 0, '', 0 FROM convs),
p AS (SELECT c, w, CAST(row_number() OVER (PARTITION BY c ORDER BY pos) - 1 AS BIGINT) AS depth, count(*) OVER (PARTITION BY c) - 1 AS total, string_agg(d, ',') OVER (PARTITION BY c ORDER BY pos) AS k,
  string_agg(d, ',') OVER (PARTITION BY c ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS up FROM r),
v AS (SELECT k, any_value(up) AS up, any_value(depth) AS depth, any_value(w) AS w, min(c) AS conv_id, count(*) AS n_convs,
  sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (depth = total), '')) AS ends_sha256 FROM p GROUP BY k),
kids AS (SELECT up AS k, count(*) AS n_children FROM v WHERE depth > 0 GROUP BY up),
one AS (SELECT v.*, coalesce(n_children, 0) AS n_children FROM v LEFT JOIN kids USING (k)),
sums AS (SELECT p.k, CAST(sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_leaves, CAST(sum((n_convs - 1) * one.w) AS BIGINT) AS saved_tokens FROM one JOIN p ON p.c = one.conv_id AND p.depth <= one.depth GROUP BY p.k)
SELECT one.conv_id, one.depth, u.conv_id AS parent_conv_id, one.n_convs, one.n_children, n_leaves, saved_tokens, one.ends_sha256
FROM one JOIN sums USING (k) LEFT JOIN v u ON u.k = one.up AND one.depth > 0
"""
