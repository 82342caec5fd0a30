"""Benchmark decontamination by a prefix-filtered set join.

Every benchmark window (``width`` consecutive words; a shorter item is one
window) is a set that must be contained wholly in a document's window, so its
necessary prefix is one shingle.  Shingles (word pairs; the word itself for a
window of one word) are ordered by rarity in the corpus, counted over all
documents, and each window is indexed under its rarest.  Documents join on
these prefix shingles; a candidate must fit by position and length, and is
then verified word by word over a window of the item's size.

The benchmark is taken in blocks of bounded size: each block's windows are
broadcast and one narrow map over the documents joins them.  There is no
shuffle of documents.
"""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bounded, map_batches, packed, raw_texts, release, returned, slices, unpacked, written

#: Benchmark bytes in a broadcast block.
BLOCK_BYTES = 1 << 20
_WORD = bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
#: A-Z to a-z, what is in no word to a space.
_FOLD = bytes((c if c in _WORD else 0x20) for c in bytes(range(256)).lower())


def words(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def windows(items: list[tuple[str, bytes]], width: int) -> dict[tuple[bytes, ...], list[str]]:
    found: dict[tuple[bytes, ...], list[str]] = defaultdict(list)
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - width + 1) if w else 0):
            found[tuple(w[i : i + width])].append(item)
    return found


def shingles(window: tuple[bytes, ...]) -> list[tuple[bytes, ...]]:
    return list(pairwise(window)) if len(window) > 1 else [window]


def rarity(docs: DataFrame, vocabulary: set[tuple[bytes, ...]]) -> dict[tuple[bytes, ...], int]:
    """Occurrences in all documents of the shingles of one block of the benchmark."""
    if not vocabulary:
        return {}
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        release()
        known, total = shared.value, Counter()
        single = any(len(s) == 1 for s in known)
        for batch in batches:
            for part in slices(batch):
                for w in map(words, raw_texts(part.column(0))):
                    total.update([p for p in pairwise(w) if p in known])
                    if single:
                        total.update([(x,) for x in w if (x,) in known])
        if total:
            yield pa.RecordBatch.from_arrays([pa.array([b" ".join(s) for s in total], pa.binary()), pa.array(list(total.values()), pa.int64())], ["shingle", "n"])

    counted = bounded(docs).mapInArrow(run, "shingle binary, n bigint").groupBy("shingle").agg(F.sum("n").alias("n"))
    return {tuple(bytes(r["shingle"]).split(b" ")): r["n"] for r in counted.collect()}


def prefix_index(found: dict[tuple[bytes, ...], list[str]], n: dict[tuple[bytes, ...], int]) -> dict[tuple[bytes, ...], list[tuple[int, tuple[bytes, ...], list[str]]]]:
    """Rarest shingle of a window -> its place there, the window, the items.  A window with a shingle that no document has can't occur."""
    index = defaultdict(list)
    for window, items in found.items():
        rank = [(n.get(s, 0), s, i) for i, s in enumerate(shingles(window))]
        least = min(rank)
        if least[0]:
            index[least[1]].append((least[2], window, items))
    return dict(index)


def _scan(index, w: list[bytes], hit: np.ndarray, items: set[str]) -> None:
    def check(key, i):
        for offset, window, owners in index[key]:
            start = i - offset
            if start >= 0 and start + len(window) <= len(w) and tuple(w[start : start + len(window)]) == window:
                hit[start : start + len(window)] = True
                items.update(owners)

    for i, p in enumerate(pairwise(w)):
        if p in index:
            check(p, i)
    if any(len(k) == 1 for k in index):
        for i, x in enumerate(w):
            if (x,) in index:
                check((x,), i)


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 10, key: str = "doc_id") -> DataFrame:
    """One row for each row of ``docs``: key, n_words, n_hit, n_items, items_sha256, contaminated, items.

    Null and empty texts have no words and no hits.  Items without an id or
    without words match nothing; items with equal ids count once.  An empty
    benchmark leaves every document clean.  Repeated rows give repeated results.
    """
    small = docs.select(F.col(key), F.col("text"))
    bench = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("binary").alias("text")).where("item_id is not null and text is not null")
    size = bench.agg(F.sum(F.length("text") + 64).alias("n")).first()["n"] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    sc = docs.sparkSession.sparkContext
    state = small.withColumns({"hits": F.lit(None).cast("binary"), "items": F.lit(None).cast("array<string>")})
    for k in range(blocks):
        rows = bench.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()
        found = windows([(r["item_id"], bytes(r["text"])) for r in rows], width)
        index = prefix_index(found, rarity(small.select("text"), {s for w in found for s in shingles(w)}))
        shared, last = sc.broadcast(index), k == blocks - 1

        def make(shared=shared, last=last):
            index = shared.value

            def handle(batch: pa.RecordBatch):
                rows = zip(raw_texts(batch.column("text")), batch.column("hits").to_pylist(), batch.column("items").to_pylist(), strict=True)
                n_words, n_hit, hits, items = [], [], [], []
                for text, before, had in rows:
                    w = words(text)
                    hit = np.zeros(len(w), bool) if before is None else np.unpackbits(np.frombuffer(before, np.uint8), count=len(w)).astype(bool)
                    got = set(had or ())
                    if index and w:
                        _scan(index, w, hit, got)
                    n_words.append(len(w))
                    n_hit.append(int(hit.sum()))
                    hits.append(None if last else np.packbits(hit).tobytes())
                    items.append(sorted(got))
                items_column = pa.array(items, pa.list_(pa.string()))
                if not last:
                    yield pa.RecordBatch.from_arrays([batch.column(key), batch.column("text"), pa.array(hits, pa.binary()), items_column], [key, "text", "hits", "items"])
                    return
                digests = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]
                columns = [batch.column(key), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array(digests), pa.array([x > 0 for x in n_hit]), items_column]
                yield pa.RecordBatch.from_arrays(columns, [key, "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items"])

            return handle

        schema = returned(small, [key], "n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, items array<string>") if last else returned(small, [key, "text"], "hits binary, items array<string>")
        state = map_batches(state, schema, make)
        if not last:
            state = written(state, "decontaminate")
    return state


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """The rows of ``docs`` in which no benchmark window occurs, columns as they are."""
    return unpacked(decontaminate(packed(docs, text=F.col("text")), benchmark, width, key="row").where("not contaminated"), docs)
