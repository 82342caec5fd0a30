"""Lexical retrieval packing.

Documents are tokenised once and dealt by a lexical key over shards of bounded
size: the first of their terms in a random order that favours rare ones (a
weighted MinHash, carried on to the next terms), so that documents with rare
terms in common meet, and a key with many documents is cut by its next terms.
Each shard has a BM25 inverted index over token ids, whose
document frequencies are counted over all documents.  A seed document opens a
window; its best-scoring unused neighbours, by all its terms, fill it in turn until none
has a term of it, and what does not
fit of the last one opens the next window.  Only a shard's last window can be
short.
"""

from __future__ import annotations

import re
import zlib
from array import array
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bounded, cores, kept_in_worker, release, slices, worker_cache_limit, written

WINDOW = 4096
#: Tokens in a shard, about.
SHARD_TOKENS = 1_200_000
#: Neighbours that are asked for at a time, terms in a lexical key, documents whose keys give the shards' bounds, about.
NEIGHBOURS, KEY_TERMS, SAMPLE = 64, 4, 200_000
K1, B = 1.2, 0.75
#: A term that one in so many of a shard's documents has, or more, has a row of weights.
DENSE = 32


def _visible() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it is printed, else one of those from 256 on."""
    printed = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in printed]
    return [chr(b) if b in printed else chr(256 + hidden.index(b)) for b in range(256)]


#: Latin letters that normalising leaves as they are but for case, and what stands for them in the vocabulary.
_LATIN = {c: "".join(_visible()[b] for b in chr(c + 0x20 * (c < 0xDF)).encode()) for c in (*range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)) if c not in (0xDF, 0xFF)}
_LATIN |= {0xDF: "".join(_visible()[b] for b in "ß".encode()), 0xFF: "".join(_visible()[b] for b in "ÿ".encode())}
_LATIN_WORD = re.compile("[a-zÀ-ÖØ-öø-ÿ]+")
_TAIL = r"([a-zÀ-ÖØ-öø-ÿ])([!-/:-@\[-`{-~]+)( |$)"


class Ids:
    """Token ids of blank-separated chunks, which this vocabulary's tokenizer treats alone; a bounded memo table over the library.

    Texts are first brought to fewer distinct chunks: ASCII capitals are
    lowered (the normaliser does so), and the ASCII punctuation that ends a
    chunk is taken apart from it if a Latin letter precedes (the pre-tokenizer
    splits there).
    The table is two Arrow columns, a few bytes for each chunk.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        pre, normal = str(self.tokenizer.pre_tokenizer), str(self.tokenizer.normalizer)
        if self.tokenizer.get_vocab_size() > 1 << 16 or "\\s" not in pre or "Lowercase" not in normal:
            raise ValueError("packing takes a tokenizer of at most 65536 ids that lower-cases and drops white space")
        self.model = self.tokenizer.model
        if any(self.latin(w) != self.alone(w) for w in ("pack", "straße", "ÀÖØÞàöøÿ", "antidisestablishmentarianism")):
            raise ValueError("packing takes a byte-level vocabulary")
        self.limit = 3 * worker_cache_limit()
        self.chunks, self.ids = pa.array([], pa.string()), pa.array([], pa.binary())

    def alone(self, chunk: str) -> bytes:
        return np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, "<u2").tobytes()

    def latin(self, word: str) -> bytes:
        """Ids of a word of lower-case ASCII and other Latin letters: one pre-token, given to the model itself."""
        return array("H", [t.id for t in self.model.tokenize(word if word.isascii() else word.translate(_LATIN))]).tobytes()

    def learn(self, chunks: list[str]) -> list[bytes]:
        """Ids of each, in few library calls: Latin words, other words of letters, which are one pre-token each, and printable ASCII, where offsets hold."""
        found = {c: self.latin(c) for c in chunks if _LATIN_WORD.fullmatch(c)}
        new = [c for c in chunks if c not in found]
        letters = [c for c in new if c.isalpha()]
        ascii = [c for c in new if c.isascii() and c.isprintable() and "<|" not in c and not c.isalpha() and c]
        for words, by_offset in ((letters, False), (ascii, True)):
            for i in range(0, len(words), 128):
                part = words[i : i + 128]
                e = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
                if by_offset:
                    starts = np.cumsum([0, *(len(c) + 1 for c in part[:-1])])
                    word = np.searchsorted(starts, [a for a, _ in e.offsets], "right")
                else:
                    word = np.array(e.word_ids)
                edges = (2 * np.flatnonzero(np.diff(word, prepend=-1, append=-1))).tolist()
                if len(edges) == len(part) + 1:  # else each is tokenised alone
                    ids = np.array(e.ids, "<u2").tobytes()
                    found.update(zip(part, [ids[a:b] for a, b in pairwise(edges)], strict=True))
        for c in new:
            if c not in found:
                found[c] = self.alone(c)
        return [found[c] for c in chunks]

    def places(self, chunks: pa.Array) -> np.ndarray:
        """Where the distinct chunks are in the table, once they are all there."""
        at = pc.index_in(chunks, value_set=self.chunks)
        new = chunks.filter(at.is_null())
        if len(self.chunks) + len(new) > self.limit:  # only what is needed now stays
            known = chunks.filter(at.is_valid())
            self.chunks, self.ids = known, self.ids.take(at.drop_null())
            at = pc.index_in(chunks, value_set=self.chunks)
        if len(new):
            at = at.fill_null(-1).to_numpy().astype(np.int64)
            at[at < 0] = len(self.chunks) + np.arange(len(new))
            learnt = pa.array([x for i in range(0, len(new), 1 << 16) for x in self.learn(new[i : i + (1 << 16)].to_pylist())], pa.binary())
            self.chunks, self.ids = pa.concat_arrays([self.chunks, new]), pa.concat_arrays([self.ids, learnt])
            return at
        return at.to_numpy()

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text.  Chunks are told apart and put together by Arrow; only distinct ones are looked up."""
        texts = pc.replace_substring(pc.fill_null(texts.cast(pa.string()), ""), "\n", " ")
        special = pc.match_substring(texts, "<|")  # such a text may hold a special token
        plain = pc.replace_substring_regex(pc.ascii_lower(texts), _TAIL, r"\1 \2\3")
        lists = pc.split_pattern(pc.if_else(special, texts, plain), " ")
        coded = lists.flatten().dictionary_encode()
        at = self.places(coded.dictionary)
        taken = self.ids.take(pa.array(at[coded.indices.to_numpy()])) if len(coded) else self.ids
        _, offsets, data = taken.buffers()
        offsets = np.frombuffer(offsets, np.int32)[taken.offset :][lists.offsets.to_numpy() - lists.offsets[0].as_py()].tolist()
        data = memoryview(data) if data is not None else b""
        return [bytes(data[a:b]) for a, b in pairwise(offsets)]


@kept_in_worker
def ids_for(path: str) -> Ids:
    """One for each worker process, which serves many tasks."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Ids(path)


def term_order(end: int) -> np.ndarray:
    """Place of each id in a random order in which an id comes early in proportion to the log of its rank, as its idf by Zipf's law (vocabularies are made by frequency)."""
    race = np.random.default_rng(KEY_TERMS).exponential(size=1 << 16) / np.log(2 + np.arange(1 << 16))
    race[end] = np.inf
    place = np.empty(1 << 16, np.uint64)
    place[np.argsort(race)] = np.arange(1 << 16, dtype=np.uint64)
    return place


def lexical_key(places: np.ndarray) -> int:
    """The first places, packed so that the signed number has their order."""
    least = np.partition(places, KEY_TERMS)[:KEY_TERMS] if len(places) > KEY_TERMS else places
    first = [*sorted(least.tolist()), *[0xFFFF] * KEY_TERMS][:KEY_TERMS]
    return (first[0] << 48 | first[1] << 32 | first[2] << 16 | first[3]) - (1 << 63)


def tokenised(docs: DataFrame, tokenizer: str, end: int) -> DataFrame:
    """doc_id, ids (little-endian 16 bit, with ``end``), lexical key, and in one row for each task, without doc_id, df: documents by id."""

    def run(batches):
        release(ids_for)
        ids, df, seen, place = ids_for(tokenizer), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, bool), term_order(end)
        for batch in batches:
            for part in slices(batch, 8 << 20):
                out = [x + np.array([end], "<u2").tobytes() for x in ids.encode(part.column("text"))]
                keys = []
                for x in out:
                    seen[np.frombuffer(x, "<u2")] = True
                    own = np.flatnonzero(seen)
                    df[own] += 1
                    seen[own] = False
                    keys.append(lexical_key(place[own]))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(out, pa.binary()), pa.array(keys, pa.int64()), pa.array([None] * len(out), pa.binary())], ["doc_id", "ids", "lexical", "df"])
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([None], pa.binary()), pa.array([None], pa.int64()), pa.array([df.tobytes()], pa.binary())], ["doc_id", "ids", "lexical", "df"])

    return bounded(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")).mapInArrow(run, "doc_id bigint, ids binary, lexical bigint, df binary")


def document_frequencies(tokens: DataFrame) -> np.ndarray:
    """Summed over the tasks by Spark, in a tree of mergers; the result has one number for each of 65536 ids."""

    def add(batches):
        df = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                df += np.frombuffer(x, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([df.tobytes()], pa.binary())], ["df"])

    parts = tokens.where("df is not null").select("df").mapInArrow(add, "df binary")
    parts = parts.repartition(32).mapInArrow(add, "df binary")
    return sum((np.frombuffer(bytes(r["df"]), np.int64) for r in parts.collect()), np.zeros(1 << 16, np.int64))


class Index:
    """BM25 over the documents of one shard.  Terms of many documents have a row of weights, the others a list of postings."""

    def __init__(self, texts: list[np.ndarray], df: np.ndarray, n_docs: int):
        idf = np.log1p((n_docs - df + 0.5) / (df + 0.5))
        lengths = np.array([len(x) for x in texts])
        pairs = np.repeat(np.arange(len(texts), dtype=np.int64) << 16, lengths) | np.concatenate(texts)
        pairs.sort()
        new = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]]))
        tf, pairs = np.diff(np.append(new, len(pairs))).astype(float), pairs[new]
        doc, term = pairs >> 16, (pairs & 0xFFFF).astype(np.uint16)
        norm = K1 * (1 - B + B * lengths / max(lengths.mean(), 1))
        weight = (idf[term] * tf * (K1 + 1) / (tf + norm[doc])).astype(np.float32)
        many = np.bincount(term, minlength=1 << 16) * DENSE > len(texts)
        self.row = np.where(many, np.cumsum(many) - 1, -1)
        self.rows, in_row = np.zeros((int(many.sum()), len(texts)), np.float32), many[term]
        self.rows[self.row[term[in_row]], doc[in_row]] = weight[in_row]
        self.own, self.term = np.searchsorted(doc, np.arange(len(texts) + 1)), term.astype(np.int64)
        doc, term, weight = doc[~in_row], term[~in_row], weight[~in_row]
        order = np.argsort(term, kind="stable")
        self.doc, self.weight = doc[order], weight[order]
        self.start = np.searchsorted(term[order], np.arange((1 << 16) + 1))
        #: documents in the index, and their columns in ``rows``
        self.left = np.arange(len(texts))

    def neighbours(self, seed: int, unused: np.ndarray) -> list[int]:
        """Unused documents with a term of the seed, the best ones first; of equal scores the first document."""
        if 2 * int(unused.sum()) < len(self.left):  # used documents leave the index
            keep = unused[self.doc]
            self.start = np.concatenate([[0], np.cumsum(keep)])[self.start]
            self.doc, self.weight = self.doc[keep], self.weight[keep]
            self.rows, self.left = self.rows[:, unused[self.left]], self.left[unused[self.left]]
        terms = self.term[self.own[seed] : self.own[seed + 1]]
        rows = self.row[terms]
        score = np.zeros(len(unused))
        score[self.left] = self.rows[rows[rows >= 0]].sum(0)
        spans = [slice(a, b) for a, b in zip(self.start[terms].tolist(), self.start[terms + 1].tolist(), strict=True) if a < b]
        if spans:
            score += np.bincount(np.concatenate([self.doc[s] for s in spans]), np.concatenate([self.weight[s] for s in spans]), len(unused))
        score[~unused] = 0
        at = np.flatnonzero(score)
        if len(at) > NEIGHBOURS:  # with all that tie with the last one
            at = at[score[at] >= -np.partition(-score[at], NEIGHBOURS - 1)[NEIGHBOURS - 1]]
        return at[np.lexsort((at, -score[at]))][:NEIGHBOURS].tolist()


def fill(texts: list[np.ndarray], index: Index) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, window, offset) of every piece."""
    unused, pieces, window, offset, following, next_seed = np.ones(len(texts), bool), [], 0, 0, [], 0
    rest: tuple[int, int] | None = None
    more = False  # the seed may have neighbours that were not asked for yet
    while True:
        if rest is not None:
            (doc, start), rest = rest, None
            if offset == 0:
                following = None
        else:
            if following is None:
                following = index.neighbours(doc_seed, unused)
                more = len(following) >= NEIGHBOURS
            if not following and more:  # all that were asked for are in the window
                following = index.neighbours(doc_seed, unused)
                more = len(following) >= NEIGHBOURS
            if following:
                doc = following.pop(0)
            else:
                while next_seed < len(texts) and not unused[next_seed]:
                    next_seed += 1
                if next_seed == len(texts):
                    return pieces
                doc, following = next_seed, None
            start = 0
        if offset == 0 or following is None:
            doc_seed = doc
            following = None
        unused[doc] = False
        n = min(len(texts[doc]) - start, WINDOW - offset)
        pieces.append((doc, start, n, window, offset))
        offset += n
        if start + n < len(texts[doc]):
            rest = (doc, start + n)
        if offset == WINDOW:
            window, offset, following, more = window + 1, 0, [], False


def shard_bounds(held: DataFrame, n: int, shards: int) -> np.ndarray:
    """Keys between which the shards lie, of about as many tokens each, by a sample of bounded size."""
    if shards == 1:
        return np.zeros(0, np.int64)
    every = -(-n // max(SAMPLE, 50 * shards))
    rows = held.select("lexical", (F.length("ids") / 2).alias("tokens"), F.xxhash64("doc_id", "lexical").alias("salt"))
    found = rows.where(F.pmod("salt", F.lit(every)) == 0).groupBy("lexical").agg(F.sum("tokens").alias("tokens")).toArrow().sort_by("lexical")
    upto = np.cumsum(found.column("tokens").to_numpy())
    if not len(upto):
        return np.zeros(0, np.int64)
    return found.column("lexical").to_numpy()[np.searchsorted(upto, upto[-1] * np.arange(1, shards) / shards)]


def pack(docs: DataFrame, tokenizer: str, end: int = 2, with_ids: bool = True) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if wanted, its ids.

    Null and empty texts are the end id alone.  Rows with equal ids, with null
    ids and equal rows are documents of their own, dealt over shards like
    others.  A very long text is cut over as many windows as it takes.  Of
    neighbours that score alike the one with the smaller id comes first.  An
    empty table gives no rows.
    """
    spark = docs.sparkSession
    tokens = written(tokenised(docs, tokenizer, end), "tokens")
    held = tokens.where("ids is not null")
    size = held.agg(F.count("*").alias("n"), F.sum(F.length("ids") / 2).alias("tokens")).first()
    shards = max(1, -(-int(size["tokens"] or 0) // SHARD_TOKENS))
    shared, n_docs = spark.sparkContext.broadcast(document_frequencies(tokens)), size["n"]
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids]

    def one_shard(group: pa.Table) -> pa.Table:
        release()
        group = group.sort_by([("doc_id", "ascending"), ("ids", "ascending")])
        shard = group.column("shard")[0].as_py()
        texts = [np.frombuffer(x, "<u2") for x in group.column("ids").to_pylist()]
        ids = group.column("doc_id").to_pylist()
        rows = [(ids[d], s, n, zlib.crc32(texts[d][s : s + n].astype("<u4").tobytes()), len(texts[d]), (shard << 32) + w, o, *[texts[d][s : s + n].tobytes()] * with_ids) for d, s, n, w, o in fill(texts, Index(texts, shared.value, n_docs))]
        return pa.table([pa.array(c, pa.binary() if k == "ids" else pa.int64()) for k, c in zip(columns, zip(*rows, strict=True), strict=True)], names=columns)

    bounds = shard_bounds(held, size["n"], shards)

    @F.arrow_udf("int")
    def shard_of(lexical: pa.Array, salt: pa.Array) -> pa.Array:
        # a key that takes several shards is dealt over them
        x, salt = lexical.to_numpy(zero_copy_only=False), salt.to_numpy(zero_copy_only=False).view(np.uint64)
        first, last = np.searchsorted(bounds, x, "left"), np.searchsorted(bounds, x, "right")
        return pa.array(first + (salt % (last - first + 1).astype(np.uint64)).astype(np.int64), pa.int32())

    # the place in the input deals out equal rows
    dealt = held.select(shard_of("lexical", F.xxhash64("doc_id", "ids", F.spark_partition_id())).cast("bigint").alias("shard"), "doc_id", "ids")
    dealt = dealt.repartition(max(min(shards, 4096), cores(spark)), "shard")
    return dealt.groupBy("shard").applyInArrow(one_shard, ", ".join(f"{k} {'binary' if k == 'ids' else 'bigint'}" for k in columns))
