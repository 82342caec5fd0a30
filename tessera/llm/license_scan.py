"""License scans: winnowed template fingerprints pick candidates, banded alignment reports coverage and spans.

A template's shingles (three words) are winnowed: of each window of
consecutive shingles the one with the least hash is kept.  The kept ones are
an inverted index (shingle -> template and place); the templates are a fixed
list, so the index is small and broadcast.  Every document shingle is looked
up, so a run of WINDOW + SHINGLE - 1 words that a document shares with a
template is always met.  Hits of a template that lie near one diagonal make a
candidate region, which is aligned with the template in a band around the
diagonal.  Aligned regions that follow each other in the template and in the
document (a passage was put in or left out between them) are chained; the
matched words, each template word once, over the template's length are the
coverage.

Of alignments that score alike the first one in the template is taken.  Long
texts are scanned whole, in time proportional to their words and hits.
"""

from __future__ import annotations

from bisect import bisect
from collections import defaultdict
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_batches, raw_texts, returned
from tessera.llm.decontaminate import words
from tessera.llm.license_templates import TEMPLATES

SHINGLE, WINDOW = 3, 4
#: Words that an alignment may drift from its diagonal, and the share of a template that must match.
BAND, COVERAGE = 12, 0.8
_MATCH, _MISS, _GAP = 2, -1, -1


def _shingles(w: list[bytes]) -> list[tuple[bytes, ...]]:
    return list(zip(w, islice(w, 1, None), islice(w, 2, None), strict=False)) if len(w) >= SHINGLE else []


def winnow(shingles: list[tuple[bytes, ...]], window: int = WINDOW) -> list[int]:
    """Places of the shingles that are the rightmost least of some window; of all, if there are fewer than two windows of them."""
    if len(shingles) < 2 * window:
        return list(range(len(shingles)))
    h = [xxhash.xxh64_intdigest(b" ".join(s)) for s in shingles]
    kept = {min(range(i, min(i + window, len(h))), key=lambda j: (h[j], -j)) for i in range(len(h) - window + 1)}
    return sorted(kept)


class Index:
    def __init__(self, templates: dict[str, str]):
        self.names = sorted(templates)
        self.words = [words(templates[n].encode()) for n in self.names]
        if any(len(w) < SHINGLE for w in self.words):
            raise ValueError("a template needs at least three words")
        # half a template at most, so that two copies in a row are two regions
        self.bands = [min(BAND, (len(w) - 1) // 2) for w in self.words]
        self.places: dict[tuple[bytes, ...], list[tuple[int, int]]] = defaultdict(list)
        for t, w in enumerate(self.words):
            s = _shingles(w)
            for i in winnow(s):
                self.places[s[i]].append((t, i))
        self.places = dict(self.places)

    def regions(self, w: list[bytes]) -> list[tuple[int, int, int]]:
        """(template, least and greatest diagonal) of the candidates, in order of place."""
        places = self.places
        hits: dict[int, list[int]] = defaultdict(list)
        for i, s in enumerate(zip(w, islice(w, 1, None), islice(w, 2, None), strict=False)):
            if s in places:
                for t, j in places[s]:
                    hits[t].append(i - j)
        out = []
        for t, diagonals in hits.items():
            diagonals.sort()
            first = last = diagonals[0]
            for d in [*diagonals[1:], None]:
                if d is None or d - first > self.bands[t]:
                    out.append((t, first, last))
                    first = d
                last = d
        return sorted(out, key=lambda x: (x[1], x[0]))

    def align(self, t: int, low: int, high: int, w: list[bytes]) -> tuple[int, int, int, int, int]:
        """Matched words, start and stop in the document and in the template, of the best local alignment within the band."""
        template, band = self.words[t], self.bands[t]
        a, b = max(0, low - band), min(len(w), high + len(template) + band)
        width = high - low + 2 * band + 1
        # cell k of row i stands for document word low - band + i + k; its value: score, matched, start, stop
        score = [0] * width
        state: list[tuple[int, int, int, int, int]] = [(0, -1, -1, -1, -1)] * width
        best = (0, 0, 0, 0, 0, 0)
        for i, word in enumerate(template):
            new, fresh = [0] * width, [(0, -1, -1, -1, -1)] * width
            for k in range(width):
                j = low - band + i + k
                if not a <= j < b:
                    continue
                same = w[j] == word
                top, how = score[k] + (_MATCH if same else _MISS), 0
                if k + 1 < width and score[k + 1] + _GAP > top:
                    top, how = score[k + 1] + _GAP, 1
                if k and new[k - 1] + _GAP > top:
                    top, how = new[k - 1] + _GAP, 2
                if top <= 0:
                    continue
                n, start, stop, first, last = state[k] if how == 0 else state[k + 1] if how == 1 else fresh[k - 1]
                if how == 0 and same:
                    n, start, stop, first, last = n + 1, j if start < 0 else start, j + 1, i if start < 0 else first, i + 1
                new[k], fresh[k] = top, (n, start, stop, first, last)
                if top > best[0]:
                    best = (top, n, start, stop, first, last)
            score, state = new, fresh
        return best[1:]

    def scan(self, text: bytes, least: float = COVERAGE) -> list[tuple[str, int, float, int, int]]:
        """(license, matched words, coverage, first word, word after the last) of each place where a template is covered enough."""
        w = words(text)
        places: dict[int, list[tuple[int, int, int, int, int]]] = defaultdict(list)
        for t, low, high in self.regions(w):
            n, start, stop, first, last = self.align(t, low, high, w)
            if n:
                places[t].append((start, stop, first, last, n))
        found = {}
        for t, aligned in places.items():
            for matched, begin, end in chains(sorted(set(aligned)), len(self.words[t]), least):
                found[t, begin] = (self.names[t], matched, matched / len(self.words[t]), begin, end)
        return [found[k] for k in sorted(found, key=lambda k: (k[1], k[0]))]


def chains(pieces: list[tuple[int, int, int, int, int]], size: int, least: float) -> list[tuple[int, int, int]]:
    """(matched words, start, stop) of the best chains of aligned pieces that cover enough of a template of ``size`` words, none over another.

    A piece is (start, stop) in the document, (first, last) in the template and
    its matched words; it follows another one that ends before it in both, at
    most ``size`` words away.
    """
    best, before = [p[4] for p in pieces], list(range(len(pieces)))
    for i, (start, _, first, last, n) in enumerate(pieces):
        for j in range(i - 1, -1, -1):
            if pieces[j][0] < start - 4 * size:
                break
            _, end, from_, upto, _ = pieces[j]
            again = max(0, upto - first)  # template words that both have
            if first > from_ and last > upto and n > again and end <= start + again and start - end <= size and best[j] + n - again > best[i]:
                best[i], before[i] = best[j] + n - again, j
    taken: list[tuple[int, int]] = []
    out = []
    for i in sorted(range(len(pieces)), key=lambda i: (-best[i], i)):
        if best[i] < least * size:
            break
        begin = i
        while before[begin] != begin:
            begin = before[begin]
        span = (pieces[begin][0], pieces[i][1])
        at = bisect(taken, span)
        if (at == 0 or taken[at - 1][1] <= span[0]) and (at == len(taken) or span[1] <= taken[at][0]):
            taken.insert(at, span)
            out.append((best[i], *span))
    return out


def scan_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES, least: float = COVERAGE, key: str = "doc_id") -> DataFrame:
    """key, license, n_matched, coverage, start_word, stop_word: a row for each place of a license in a document.

    Null and empty texts have none.  Repeated rows give repeated results.  A
    template may be met several times in a text, and several in one place.
    """
    small = docs.select(F.col(key), F.col("text"))
    shared = docs.sparkSession.sparkContext.broadcast(templates)
    names = ["license", "n_matched", "coverage", "start_word", "stop_word"]
    kinds = [pa.string(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]

    def make():
        index = Index(shared.value)

        def handle(batch: pa.RecordBatch):
            rows = [(i, *r) for i, text in enumerate(raw_texts(batch.column("text"))) for r in index.scan(text, least)]
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(np.array(columns[0], np.int64))), *(pa.array(c, k) for c, k in zip(columns[1:], kinds, strict=True))], [key, *names])

        return handle

    return map_batches(small, returned(small, [key], "license string, n_matched bigint, coverage double, start_word bigint, stop_word bigint"), make)
