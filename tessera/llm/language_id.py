"""Language identification with error-correcting output codes.

Each language has a codeword; a binary classifier for each bit (logistic
regression on hashed byte n-gram frequencies) predicts that bit.  Decoding
chooses the codeword with the smallest loss, each bit weighted by its
classifier's accuracy on the fitted sample, and flags a text as ambiguous
when the runner-up is close.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_batches, packed, returned, unpacked

#: Hashed n-gram features; labelled rows in the sample that the classifiers are fitted to, for all languages together and for one.
FEATURES, SAMPLE, SAMPLE_EACH = 4096, 3200, 400
#: Texts are featurised in pieces of so many bytes, all of them.
PIECE = 1 << 20
#: A margin below this between the two best languages flags a text.
MARGIN = 0.02
_LETTER = re.compile(r"[^\W\d_]")
_FOLD = bytes(c if c >= 0x80 or chr(c).isalpha() else 0x20 for c in range(256))


def has_letters(text: str | None) -> bool:
    return text is not None and _LETTER.search(text) is not None


def features(text: str) -> np.ndarray:
    """Frequencies of hashed byte 2- and 3-grams of the whole lower-cased text, letters only."""
    raw = b" " + b" ".join(text.lower().encode().translate(_FOLD).split()) + b" "
    total = np.zeros(FEATURES, np.int64)
    for i in range(0, max(1, len(raw) - 2), PIECE):
        b = np.frombuffer(raw[i : i + PIECE + 2], np.uint8).astype(np.uint32)
        if len(b) < 3:
            break
        two = b[:-2] << np.uint32(8) | b[1:-1]
        three = two << np.uint32(8) | b[2:]
        for code, seed in ((two, 2654435761), (three, 2246822519)):
            total += np.bincount((code * np.uint32(seed)) >> np.uint32(20), minlength=FEATURES)
    x = np.sqrt(total.astype(np.float64))
    norm = np.sqrt((x * x).sum())
    return (x / norm if norm else x).astype(np.float32)


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """-1/+1 codewords: all splits of few languages; for many, the random code of largest least distance."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 5:
        bits = 2 ** (n - 1) - 1
        columns = [[1] + [1 if (b >> i) & 1 else -1 for i in range(n - 1)] for b in range(bits)]
        return np.array(columns, float).T
    rng, bits = np.random.default_rng(seed), 10 * int(np.ceil(np.log2(n)))
    codes = [rng.choice([-1.0, 1.0], (n, bits)) for _ in range(50)]
    apart = [min(int((c[i] != c[j]).sum()) for i in range(n) for j in range(i)) for c in codes]
    return codes[int(np.argmax(apart))]


@dataclass(frozen=True)
class Model:
    langs: list[str]
    codes: np.ndarray
    weights: np.ndarray  # features + 1 by bits
    trust: np.ndarray  # of bits

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the language, its share of the decoded mass, the margin to the next; for each row of features."""
        f = x @ self.weights[:-1] + self.weights[-1]
        loss = np.log1p(np.exp(-np.clip(f[:, None, :] * self.codes[None], -30, 30))) @ self.trust
        mass = np.exp(-(loss - loss.min(1, keepdims=True)))
        mass /= mass.sum(1, keepdims=True)
        order = np.argsort(-mass, axis=1, kind="stable")
        best = order[:, 0]
        top = mass[np.arange(len(x)), best]
        second = mass[np.arange(len(x)), order[:, 1]] if mass.shape[1] > 1 else np.zeros(len(x))
        return best, top, top - second


def fit(x: np.ndarray, langs: Sequence[str], steps: int = 150, rate: float = 8.0, ridge: float = 1e-4) -> Model:
    names = sorted(set(langs))
    codes = codewords(len(names))
    target = codes[[names.index(v) for v in langs]]
    share = np.array([1 / (len(names) * langs.count(v)) for v in langs])  # languages count alike
    xb = np.hstack([x, np.ones((len(x), 1), np.float32)])
    # one precision throughout: the samples are not converted in every step
    target, share = target.astype(np.float32), share.astype(np.float32)
    w = np.zeros((xb.shape[1], codes.shape[1]), np.float32)
    step = np.zeros_like(w)
    for _ in range(steps):
        margin = np.clip(xb @ w * target, -30, 30)
        slope = -(target / (1 + np.exp(margin))) * share[:, None]
        step = np.float32(0.9) * step - np.float32(rate) * (xb.T @ slope + np.float32(ridge) * w)
        w = w + step
    right = ((xb @ w * target > 0) * share[:, None]).sum(0)
    trust = np.log((right + 1e-3) / (1 - right + 1e-3))
    return Model(names, codes, w, np.maximum(trust, 0) / max(np.maximum(trust, 0).mean(), 1e-9))


def _featurised(df: DataFrame, lang: str) -> DataFrame:
    def make():
        def handle(batch: pa.RecordBatch):
            x = [features(t).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("lang").cast(pa.string()), pa.array(x, pa.binary())], ["lang", "x"])

        return handle

    return map_batches(df.select(F.col(lang).alias("lang"), "text"), "lang string, x binary", make)


def train(labelled: DataFrame, lang: str = "lang") -> Model | None:
    """Fits on about SAMPLE_EACH rows of each language (SAMPLE in all), drawn by a hash of the row.

    Rows without label or letters don't count.  None if no row is left.
    """
    rows = labelled.where(F.col(lang).isNotNull() & F.col("text").rlike(r"\p{L}"))
    count = {r[lang]: r["count"] for r in rows.groupBy(lang).count().collect()}
    if not count:
        return None
    each = min(SAMPLE_EACH, max(2, SAMPLE // len(count)))
    share = F.create_map(*[F.lit(v) for k, n in sorted(count.items()) for v in (k, min(1.0, 1.2 * each / n if n > each else 1.0))])
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    sample = _featurised(rows.where(draw < share[F.col(lang)]), lang).limit(2 * SAMPLE).collect()
    sample = sorted(((r["lang"], bytes(r["x"])) for r in sample))
    if not sample:
        return None
    return fit(np.stack([np.frombuffer(x, np.float32) for _, x in sample]), [v for v, _ in sample])


def predict(docs: DataFrame, model: Model | None, key: str = "doc_id") -> DataFrame:
    """key, lang_pred, score, ambiguous for every row; only the text is read.

    Null texts and texts without letters are ``und`` with score 0 (so is every
    text if there is no model); they count as ambiguous.
    """
    small = docs.select(F.col(key), F.col("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = shared.value

        def handle(batch: pa.RecordBatch):
            texts = batch.column("text").to_pylist()
            langs, scores, unsure = ["und"] * len(texts), [0.0] * len(texts), [True] * len(texts)
            at = [i for i, t in enumerate(texts) if model is not None and has_letters(t)]
            for k in range(0, len(at), 256):
                part = at[k : k + 256]
                best, top, margin = model.decode(np.stack([features(texts[i]) for i in part]))
                for i, b, s, m in zip(part, best, top, margin, strict=True):
                    langs[i], scores[i], unsure[i] = model.langs[b], float(s), bool(m < MARGIN)
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(langs), pa.array(scores, pa.float64()), pa.array(unsure)], [key, "lang_pred", "score", "ambiguous"])

        return handle

    return map_batches(small, returned(small, [key], "lang_pred string, score double, ambiguous boolean"), make)


def held_out(key: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(True))


def identify(docs: DataFrame) -> DataFrame:
    """Fits on the rows that are not held out and predicts all: doc_id, held_out, lang_pred, score, ambiguous."""
    model = train(docs.select("doc_id", "text", "lang").where(~held_out()))
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "ambiguous")


def drop_rejected(docs: DataFrame) -> DataFrame:
    """The rows whose language is found: not ``und``, not ambiguous.  Columns as they are."""
    model = train(docs.select("doc_id", "text", "lang").where(~held_out()))
    return unpacked(predict(packed(docs, text=F.col("text")), model, key="row").where("lang_pred <> 'und' and not ambiguous"), docs)
