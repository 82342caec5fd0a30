"""Exact repeated-substring removal over a sparse suffix array that is built by a distributed merge sort.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts
elsewhere.  Each such string (a window) has an anchor: the place of its least
hashed K-gram among its first W places.  Equal windows have equal anchors, so
only suffixes that start at an anchor (one in about 160 bytes) need sorting,
and of these only those whose K-gram is an anchor twice (a class).

1. Documents are dealt by hash over runs of bounded size.  A run's classes go
   to parts by class; a part answers which classes repeat.
2. A run sorts, for the anchors of repeated classes, the bytes from the anchor
   on and, read backwards, the bytes that the anchor's windows take in before
   it; front-codes both orders (bytes shared with the one before, and the
   rest) and exchanges them by class.  A part merges its runs with loser trees
   that carry common-prefix lengths: a comparison starts behind the prefix
   that is known to be shared, and none is needed where the known lengths
   differ.  The window that starts d bytes before an anchor is that of another
   anchor exactly if they share d bytes before and LENGTH - d bytes behind: in
   each order a group of neighbours whose common prefixes are as long.  For
   each d, anchors with both groups in common are counted.
3. A class that comes from more than ``hot`` runs, or in as many anchors as
   fill a part, would be too much for one part.  Its windows are compared one
   by one: as 128-bit BLAKE2b digests of their bytes, made distinct in the run,
   spread over all parts by digest, and counted.
4. A run marks its hit windows and cuts the bytes that they cover.

The decisions of 2 rest on the bytes themselves, those of 3 on digests for which
no two unlike texts with one digest can be made in practice (2^64 tries).

All exchanged blocks are smaller than what they were made from, a key adds at
most one entry for each run to a part, and the text is shuffled once.

Repeats can also be measured in words (runs without white space): every word is
then coded in CODE bytes, and the same is done with the codes.
"""

from __future__ import annotations

import hashlib
import re
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cores, named, relaxed, release, returned, unpacked, word_hashes

LENGTH = 400
#: Bytes of a word's code: a chance collision of two windows that differ in one word has 2^-48.
CODE = 6
#: Bytes of text in a run and of anchors or windows in a part, about; positions that are hashed at a time.
RUN_BYTES, PART_BYTES, SPAN = 2 << 20, 12 << 20, 1 << 18
#: Runs that a class may come from, and anchors for each of them, before it is hot.
HOT, HOT_ANCHORS = 512, 32
_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_BYTES = np.random.default_rng(400).integers(1, 1 << 63, 256, dtype=np.uint64)
_NONE = np.uint64(_MASK)


def _power(n: int) -> np.uint64:
    return np.uint64(pow(_MULTIPLIER, n, 1 << 64))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def gram_hashes(data: np.ndarray, lengths: tuple[int, ...]) -> list[np.ndarray]:
    """Hashes of all substrings of each length, by doubling; each result is as long as there are starts."""
    found: list[np.ndarray | None] = [None] * len(lengths)
    done = [0] * len(lengths)
    h, size = _BYTES[data], 1
    while size <= max(lengths):
        for i, n in enumerate(lengths):
            if n & size:
                # the parts already joined are the shorter ones; this part goes before them
                last = found[i]
                found[i] = h[: len(data) - size + 1] if last is None else h[: max(0, len(data) - size - done[i] + 1)] * _power(done[i]) + last[size : size + max(0, len(data) - size - done[i] + 1)]
                done[i] += size
        if 2 * size <= max(lengths):
            h = h[: max(0, len(h) - size)] * _power(size) + h[size:]
        size *= 2
    return [_mix(x) for x in found]


def sliding_least(x: np.ndarray, w: int) -> np.ndarray:
    """Least of each w values in a row, by prefix and suffix minima of blocks."""
    n = len(x) - w + 1
    padded = np.full(-(-len(x) // w) * w, _NONE)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, w)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:n], before[w - 1 : w - 1 + n])


class Run:
    """Texts of one run in a buffer, in the order of their bytes; anchors and what the windows belong to."""

    def __init__(self, texts: list[bytes], length: int = LENGTH):
        #: a window's bytes, its places for an anchor, and the bytes of an anchor's gram
        self.length, k = length, length // 5
        w = length - k + 1
        self.order = sorted(range(len(texts)), key=texts.__getitem__)
        self.texts = [texts[i] for i in self.order]
        self.buffer = b"".join(self.texts)
        self.data = np.frombuffer(self.buffer, np.uint8)
        ends = np.cumsum([len(t) for t in self.texts], dtype=np.int64)
        self.ends, n = ends, len(self.data)
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends
        self.starts = starts
        # windows: all starts with ``length`` bytes left in their document, as spans
        full = ends - starts >= length
        self.spans = list(zip(starts[full].tolist(), (ends[full] - length + 1).tolist(), strict=True))
        first, count, anchor, key = [], [], [], []
        for a, b in self.spans:
            for s in range(a, b, SPAN):
                e = min(b, s + SPAN)
                (h,) = gram_hashes(self.data[s : e + w - 1 + k - 1], (k,))
                tagged = (h & np.uint64(_MASK ^ 0xFFFFFF)) | np.arange(len(h), dtype=np.uint64)
                least = (sliding_least(tagged, w) & np.uint64(0xFFFFFF)).astype(np.int64)
                change = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
                first.append(change + s)
                count.append(np.diff(np.append(change, e - s)))
                anchor.append(least[change] + s)
                # least hashes are small numbers: mixed anew, so that parts by key are even
                key.append(_mix(h[least[change]]))
        cat = lambda xs, kind: np.concatenate(xs).astype(kind) if xs else np.zeros(0, kind)
        #: Per group of windows in a row with one anchor: first window, how many, the anchor, its K-gram's hash.
        self.first, self.count, self.anchor, self.key = cat(first, np.int64), cat(count, np.int64), cat(anchor, np.int64), cat(key, np.uint64)
        self.n = n

    def classes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct keys in order, how many anchors each has here (up to 65535), group -> key."""
        keys, back, n = np.unique(self.key, return_inverse=True, return_counts=True)
        return keys, np.minimum(n, 0xFFFF).astype("<u2"), back

    def sides(self, groups: np.ndarray) -> tuple[list[bytes], list[bytes]]:
        """Of each group, what its windows take in from the anchor on, and before it read backwards."""
        first, at, last = self.first[groups], self.anchor[groups], self.first[groups] + self.count[groups] - 1
        after = [self.buffer[q:e] for q, e in zip(at.tolist(), (last + self.length).tolist(), strict=True)]
        return after, [self.buffer[p:q][::-1] for p, q in zip(first.tolist(), at.tolist(), strict=True)]

    def window_digests(self, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of all windows of the groups, and their digests in two columns; a stretch of text is hashed once for all its copies."""
        p = np.repeat(self.first[groups], self.count[groups]) + _ramp(self.count[groups])
        made: dict[bytes, bytes] = {}
        rows = []
        for first, count in zip(self.first[groups].tolist(), self.count[groups].tolist(), strict=True):
            text = self.buffer[first : first + count - 1 + self.length]
            if text not in made:
                made[text] = b"".join(hashlib.blake2b(text[i : i + self.length], digest_size=16).digest() for i in range(count))
            rows.append(made[text])
        return p, np.frombuffer(b"".join(rows), "<u8").reshape(-1, 2)


def _ramp(counts: np.ndarray) -> np.ndarray:
    """0..n-1 for each n of ``counts``, in a row."""
    total = int(counts.sum())
    return np.arange(total, dtype=np.int64) - np.repeat(np.cumsum(counts) - counts, counts)


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return ((keys >> np.uint64(34)) * np.uint64(parts) >> np.uint64(30)).astype(np.int64)


def common(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which ``known`` bytes are known."""
    n = min(len(a), len(b))
    if a[known:n] == b[known:n]:
        return n
    low, high = known, n  # they differ in [low, high)
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


def front_code(ordered: list[bytes]) -> bytes:
    shared = [0, *(common(a, b) for a, b in pairwise(ordered))][: len(ordered)]
    rest = [s[n:] for s, n in zip(ordered, shared, strict=True)]
    return np.uint32(len(ordered)).tobytes() + np.array(shared, "<u2").tobytes() + np.array([len(x) for x in rest], "<u2").tobytes() + b"".join(rest)


def front_decoded(block: bytes):
    """(common prefix with the one before, string), lazily."""
    n = int(np.frombuffer(block, "<u4", 1)[0])
    shared, sizes = np.frombuffer(block, "<u2", n, 4).tolist(), np.frombuffer(block, "<u2", n, 4 + 2 * n).tolist()
    at, last = 4 + 4 * n, b""
    for k, size in zip(shared, sizes, strict=True):
        last = last[:k] + block[at : at + size]
        at += size
        yield k, last


class LoserTree:
    """Merges front-coded runs.  Each loser keeps its common prefix with what won over it, so known prefixes are not compared again."""

    def __init__(self, runs: list):
        self.runs = [iter(r) for r in runs]
        self.size = 1
        while self.size < len(runs):
            self.size *= 2
        #: head of each run; None where it has ended
        self.heads: list[bytes | None] = [None] * self.size
        self.known = [0] * self.size
        for i, r in enumerate(self.runs):
            _, self.heads[i] = next(r, (0, None))
        self.losers = [0] * self.size
        self.winner = self._play(1)

    def _play(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        a, b = self._play(2 * node), self._play(2 * node + 1)
        win, lose = self._match(a, b)
        self.losers[node] = lose
        return win

    def _match(self, a: int, b: int) -> tuple[int, int]:
        """Winner and loser; both ``known`` are prefixes shared with the last output."""
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        i, j = self.known[a], self.known[b]
        if i != j:
            return (a, b) if i > j else (b, a)
        n = common(x, y, i)
        if n == len(x) or (n < len(y) and x[n] < y[n]):
            self.known[b] = n
            return a, b
        self.known[a] = n
        return b, a

    def __iter__(self):
        """(run, common prefix with the output before), in order."""
        while self.heads[self.winner] is not None:
            w = self.winner
            yield w, self.known[w]
            self.known[w], self.heads[w] = next(self.runs[w], (0, None))
            node = (w + self.size) // 2
            while node:
                w, self.losers[node] = self._match(w, self.losers[node])
                node //= 2
            self.winner = w


def merge(blocks: list[bytes]) -> tuple[list[np.ndarray], np.ndarray]:
    """Place of each string of each run in the merged order, and the prefix that each place shares with the one before."""
    place = [np.zeros(int(np.frombuffer(b, "<u4", 1)[0]), np.int64) for b in blocks]
    at, shared = [0] * len(blocks), []
    for run, known in LoserTree([front_decoded(b) for b in blocks]):
        place[run][at[run]] = len(shared)
        at[run] += 1
        shared.append(known)
    return place, np.array(shared, np.int64)


def repeats(after: np.ndarray, after_shared: np.ndarray, before: np.ndarray, before_shared: np.ndarray, least: np.ndarray, most: np.ndarray, length: int) -> np.ndarray:
    """For each anchor and each d: whether its window that starts d bytes before it is another anchor's too.

    ``after`` and ``before`` are places in the merged orders, ``least`` and
    ``most`` the d that the anchor has windows for.
    """
    found = np.zeros((len(after), int(most.max()) + 1 if len(most) else 0), bool)
    for d in range(found.shape[1]):
        own = np.flatnonzero((least <= d) & (d <= most))
        if len(own) > 1:
            both = np.cumsum(after_shared < length - d)[after[own]] * (len(before_shared) + 1) + np.cumsum(before_shared < d)[before[own]]
            order = np.argsort(both, kind="stable")
            same = np.diff(both[order]) == 0
            found[own[order], d] = np.append(same, False) | np.insert(same, 0, False)
    return found


_MESSAGE = "kind int, part int, run int, payload binary"


def _messages(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [[], [], [], []]
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["kind", "part", "run", "payload"])


def _texts(group: pa.Table) -> list[bytes]:
    return [b"" if x is None else x for x in group.column("text").to_pylist()]


def _slices(part: np.ndarray) -> list[tuple[int, slice]]:
    """Slices of a sorted array of parts."""
    edges = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])) if len(part) else np.zeros(1, int)
    return [(int(part[a]), slice(int(a), int(b))) for a, b in pairwise(edges.tolist())]


def _send_classes(run: int, texts: list[bytes], parts: int, length: int = LENGTH) -> list[tuple[int, int, int, bytes]]:
    keys, n, _ = Run(texts, length).classes()
    return [(0, p, run, keys[s].tobytes() + n[s].tobytes()) for p, s in _slices(part_of(keys, parts))]


def _judge_classes(group: pa.Table, hot: int = HOT) -> pa.Table:
    """Answers each run in the order of its keys: 0 once, 1 repeated, 2 repeated and hot."""
    runs, blocks = group.column("run").to_pylist(), group.column("payload").to_pylist()
    sizes = [len(b) // 10 for b in blocks]
    keys = np.concatenate([np.frombuffer(b, np.uint64, n) for b, n in zip(blocks, sizes, strict=True)])
    anchors = np.concatenate([np.frombuffer(b, "<u2", n, 8 * n) for b, n in zip(blocks, sizes, strict=True)]).astype(np.int64)
    order = np.argsort(keys, kind="stable")
    starts = np.flatnonzero(np.concatenate([[True], keys[order][1:] != keys[order][:-1]]))
    n, total = np.diff(np.append(starts, len(keys))), np.add.reduceat(anchors[order], starts)
    answer = ((total > 1) + 1 * ((total > 1) & ((n > hot) | (total > HOT_ANCHORS * hot)))).astype(np.uint8)
    back = np.empty(len(keys), np.uint8)
    back[order] = np.repeat(answer, n)
    part = group.column("part")[0].as_py()
    return _messages([(0, part, r, x.tobytes()) for r, x in zip(runs, np.split(back, np.cumsum(sizes)[:-1]), strict=True)])


def _answers(group: pa.Table, kind: int) -> bytes:
    """A run's answers of one kind, in the order of the parts, which is that of the keys."""
    rows = sorted((p, x) for k, p, x in zip(group.column("kind").to_pylist(), group.column("part").to_pylist(), group.column("payload").to_pylist(), strict=True) if k == kind)
    return b"".join(x for _, x in rows)


class Candidates:
    """What a run compares, once it knows its repeated classes; the same when it is made again."""

    def __init__(self, run: Run, judged: bytes, parts: int):
        self.run = run
        keys, _, back = run.classes()
        verdict = np.frombuffer(judged, np.uint8)[back] if len(keys) else np.zeros(0, np.uint8)
        self.groups = np.flatnonzero(verdict == 1)
        part, sites = part_of(run.key[self.groups], parts).tolist(), {}
        for i, site in enumerate(zip(part, *run.sides(self.groups), strict=True)):
            sites.setdefault(site, []).append(i)
        #: distinct (part, bytes after, bytes before), in order; group -> site
        self.sites = sorted(sites)
        self.site, self.many = np.zeros(len(self.groups), np.int64), np.array([len(sites[s]) > 1 for s in self.sites], bool)
        for i, s in enumerate(self.sites):
            self.site[sites[s]] = i
        self.at, digests = run.window_digests(np.flatnonzero(verdict == 2))
        order = np.lexsort((digests[:, 1], digests[:, 0]))
        new = np.concatenate([[True], (np.diff(digests[order], axis=0) != 0).any(1)])[: len(order)]
        self.windows, self.window = digests[order][new], np.zeros(len(order), np.int64)
        self.window[order] = np.cumsum(new) - 1
        self.windows_many = np.bincount(self.window, minlength=len(self.windows)) > 1

    def send(self, run: int, parts: int) -> list[tuple[int, int, int, bytes]]:
        out = []
        for p, s in _slices(np.array([x[0] for x in self.sites], np.int64)):
            payload = []
            for side in (1, 2):
                strings = [x[side] for x in self.sites[s]]
                ordered = sorted(set(strings))
                place = {x: i for i, x in enumerate(ordered)}
                payload += [np.array([place[x] for x in strings], "<u4").tobytes(), np.array([len(x) for x in strings], "<u2").tobytes(), front_code(ordered)]
            out.append((1, p, run, np.array([s.stop - s.start, len(payload[2])], "<u4").tobytes() + b"".join(payload)))
        return out + [(2, p, run, self.windows[s].tobytes()) for p, s in _slices(part_of(self.windows[:, 0], parts))]

    def hits(self, repeated: bytes, seen: bytes) -> np.ndarray:
        """Starts of the windows that occur elsewhere."""
        run, groups = self.run, self.groups
        count = run.count[groups]
        # a site's answer has a bit for each of its windows, the last one first, in whole bytes
        by_site = np.zeros(len(self.sites), np.int64)
        by_site[self.site] = count
        start = 8 * np.concatenate([[0], np.cumsum(-(-by_site // 8))]).astype(np.int64)
        bits = np.unpackbits(np.frombuffer(repeated, np.uint8), bitorder="little").astype(bool)
        t = _ramp(count)
        again = np.repeat(self.many[self.site], count) | bits[np.repeat(start[self.site] + count - 1, count) - t] if len(groups) else np.zeros(0, bool)
        by_suffix = (np.repeat(run.first[groups], count) + t)[again]
        return np.concatenate([by_suffix, self.at[(self.windows_many | (np.frombuffer(seen, np.uint8) > 0))[self.window]]])


def _send_candidates(run: int, texts: list[bytes], judged: bytes, class_parts: int, parts: int, length: int = LENGTH) -> list[tuple[int, int, int, bytes]]:
    return Candidates(Run(texts, length), judged, class_parts).send(run, parts)


def _compare(group: pa.Table, length: int = LENGTH) -> pa.Table:
    """Merges the sorted runs of a part, or counts its window digests, and answers each run."""
    kind, part = group.column("kind")[0].as_py(), group.column("part")[0].as_py()
    runs, blocks = group.column("run").to_pylist(), group.column("payload").to_pylist()
    if kind == 1:
        heads = [np.frombuffer(b, "<u4", 2).tolist() for b in blocks]
        cuts = [(8, 8 + 4 * n, 8 + 6 * n, 8 + 6 * n + size, 8 + 10 * n + size, 8 + 12 * n + size) for n, size in heads]
        numbers = lambda i, t: np.concatenate([np.frombuffer(b, t, n, c[i]) for b, (n, _), c in zip(blocks, heads, cuts, strict=True)])
        (after, after_shared), (before, before_shared) = merge([b[c[2] : c[3]] for b, c in zip(blocks, cuts, strict=True)]), merge([b[c[5] :] for b, c in zip(blocks, cuts, strict=True)])
        placed = lambda i, place: np.concatenate([x[np.frombuffer(b, "<u4", n, c[i])] for x, b, (n, _), c in zip(place, blocks, heads, cuts, strict=True)])
        least, most = length - numbers(1, "<u2").astype(np.int64), numbers(4, "<u2").astype(np.int64)
        found = repeats(placed(0, after), after_shared, placed(3, before), before_shared, least, most, length)
        bits, edges = [], np.cumsum([0, *(n for n, _ in heads)])
        for a, b in pairwise(edges.tolist()):
            bits.append(b"".join(np.packbits(found[i, u : v + 1], bitorder="little").tobytes() for i, u, v in zip(range(a, b), least[a:b].tolist(), most[a:b].tolist(), strict=True)))
        return _messages([(1, part, r, x) for r, x in zip(runs, bits, strict=True)])
    digests = np.concatenate([np.frombuffer(b, np.uint64).reshape(-1, 2) for b in blocks])
    order = np.lexsort((digests[:, 1], digests[:, 0]))
    same = (np.diff(digests[order], axis=0) == 0).all(1)
    seen = np.zeros(len(digests), np.uint8)
    seen[order] = np.append(same, False) | np.insert(same, 0, False)
    return _messages([(2, part, r, x.tobytes()) for r, x in zip(runs, np.split(seen, np.cumsum([len(b) // 16 for b in blocks])[:-1]), strict=True)])


def _cut(texts: list[bytes], answers: pa.Table, class_parts: int, length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """Removed spans of each text."""
    run = Run(texts, length)
    found = Candidates(run, _answers(answers, 0), class_parts).hits(_answers(answers, 1), _answers(answers, 2))
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    if len(found):
        p = np.sort(found)  # a window is in one group
        doc = np.searchsorted(run.ends, p, "right")
        new = np.concatenate([[True], (np.diff(p) > length) | (np.diff(doc) > 0)])
        starts, stops = p[new], p[np.append(np.flatnonzero(new)[1:] - 1, len(p) - 1)] + length
        for d, a, b in zip(doc[new].tolist(), (starts - run.starts[doc[new]]).tolist(), (stops - run.starts[doc[new]]).tolist(), strict=True):
            out[run.order[d]].append((a, b))
    return out


_BLANKS = bytes(0x20 if 9 <= c <= 13 else c for c in range(256))


def coded(texts: list[bytes]) -> list[bytes]:
    """Each word of each text as CODE bytes of its hash."""
    return [word_hashes(t.translate(_BLANKS)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :CODE].tobytes() for t in texts]


def uncoded(text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Bytes of the words that spans of codes stand for, with the blanks between them."""
    if not spans:
        return []
    at = [m.span() for m in re.finditer(rb"\S+", text)]
    return [(at[-(-a // CODE)][0], at[b // CODE - 1][1]) for a, b in spans]


def remove_repeats(docs: DataFrame, as_text: bool = False, length: int = LENGTH, words: int | None = None, hot: int = HOT) -> DataFrame:
    """For every row of ``docs``: row (a struct of all columns but the text), missing (the text is null), n_bytes, n_removed, n_spans, kept_sha256, kept.

    ``kept`` holds the remaining bytes, or as text, without characters that a
    cut went through.  Null and empty texts, and texts under
    ``length`` bytes, lose nothing.  With ``words``, a repeat is that many words
    in a row instead.  Equal rows and equal texts are repeats of one
    another; which of equal rows comes first doesn't matter, as all copies go.
    Very long texts are one run each, hashed in spans.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    runs = max(1, -(-total // RUN_BYTES))
    class_parts, parts = max(1, -(-total // (8 * PART_BYTES))), max(1, -(-total // PART_BYTES), cores(spark))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-runs // 8))
    row = F.struct(*[named(c) for c in docs.columns if c != "text"]).alias("row")
    # the place in the input deals out equal rows
    dealt = F.pmod(F.xxhash64("text", F.spark_partition_id(), *[c for c in docs.columns if c == "doc_id"]), F.lit(runs)).cast("int").alias("run")
    held = docs.select(dealt, row, F.col("text").cast("binary").alias("text")).repartition(tasks, "run")

    length = length if words is None else words * CODE

    def units(texts: list[bytes]) -> list[bytes]:
        return texts if words is None else coded(texts)

    def send_classes(group: pa.Table) -> pa.Table:
        release()
        return _messages(_send_classes(group.column("run")[0].as_py(), units(_texts(group)), class_parts, length))

    def judge_classes(group: pa.Table) -> pa.Table:
        return _judge_classes(group, hot)

    def send_candidates(group: pa.Table, judged: pa.Table) -> pa.Table:
        release()
        if not group.num_rows:
            return _messages([])
        return _messages(_send_candidates(group.column("run")[0].as_py(), units(_texts(group)), _answers(judged, 0), class_parts, parts, length))

    def compare(group: pa.Table) -> pa.Table:
        release()
        return _compare(group, length)

    def cut(group: pa.Table, answers: pa.Table) -> pa.Table:
        release()
        texts = _texts(group)
        spans = _cut(units(texts), answers, class_parts, length) if texts else []
        if words is not None:
            spans = [uncoded(t, s) for t, s in zip(texts, spans, strict=True)]
        kept = []
        for t, s in zip(texts, spans, strict=True):
            edges = [0, *(x for ab in s for x in ab), len(t)]
            kept.append(b"".join(t[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
        columns = [
            relaxed(group.column("row")),
            group.column("text").is_null(),
            pa.array([len(t) for t in texts], pa.int64()),
            pa.array([sum(b - a for a, b in s) for s in spans], pa.int64()),
            pa.array([len(s) for s in spans], pa.int64()),
            pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
            pa.array([k.decode(errors="ignore") for k in kept], pa.string()) if as_text else pa.array(kept, pa.binary()),
        ]
        return pa.table(columns, names=["row", "missing", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    judged = held.groupBy("run").applyInArrow(send_classes, _MESSAGE).groupBy("part").applyInArrow(judge_classes, _MESSAGE)
    sent = held.groupBy("run").cogroup(judged.groupBy("run")).applyInArrow(send_candidates, _MESSAGE)
    # so many tasks that one holds few parts: a part's blocks are all in memory when they are merged
    compared = sent.repartition(max(tasks, 2 * parts), "kind", "part").groupBy("kind", "part").applyInArrow(compare, _MESSAGE)
    schema = returned(held, ["row"], f"missing boolean, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept {'string' if as_text else 'binary'}")
    return held.groupBy("run").cogroup(judged.unionByName(compared).groupBy("run")).applyInArrow(cut, schema)


def cut_repeats(docs: DataFrame, words: int | None = None) -> DataFrame:
    """All rows of ``docs`` with the repeated bytes cut from text and n_chars counted anew; other columns as they are, whatever their names.

    With ``words``, repeats of that many words are cut instead.  Bytes of a
    character that a cut went through go with it.  A null text stays null.
    """
    found = remove_repeats(docs, as_text=True, words=words)
    new = {"text": F.when(~F.col("missing"), F.col("kept"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept")).otherwise(F.col("row").getField("n_chars")).cast(docs.schema["n_chars"].dataType)
    return unpacked(found, docs, **new)
