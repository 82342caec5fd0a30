"""Arithmetic on arrays of samples, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SILENCE_DBFS = -120.0


def doubles(x: Column) -> Column:
    return F.transform(x, lambda v: v.cast("double"))


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def peak(x: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(x, lambda v: F.abs(v))), F.lit(0.0))


def dbfs(level: Column) -> Column:
    """20 log10, silence at its floor."""
    return F.when(level <= 0, F.lit(SILENCE_DBFS)).otherwise(F.greatest(F.lit(SILENCE_DBFS), 20 * F.log10(F.when(level > 0, level))))


def rms(x: Column) -> Column:
    return F.sqrt(total(F.transform(x, lambda v: v * v)) / F.when(F.size(x) > 0, F.size(x)))


def block_rms(x: Column, hop: int) -> Column:
    """RMS of each full block; a trailing part is dropped."""
    n = F.floor(F.size(x) / hop).cast("int")
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    square = lambda k: F.get(x, k) * F.get(x, k)
    # element by element: a slice walks the whole array each time
    return F.transform(starts, lambda i: F.sqrt(F.aggregate(F.sequence(F.lit(0), F.lit(hop - 1)), F.lit(0.0), lambda a, k: a + square(i * hop + k)) / hop))


def rise(x: Column) -> Column:
    """Positive part of the difference to the value before; 0 first."""
    return F.transform(x, lambda v, i: F.greatest(F.lit(0.0), v - F.try_element_at(x, F.greatest(F.lit(1), i))))


def onset_envelope(x: Column, hop: int) -> Column:
    blocks = block_rms(x, hop)
    return F.when(F.size(blocks) < 2, F.array().cast("array<double>")).otherwise(rise(blocks))


def equal_power(n: Column) -> tuple[Column, Column]:
    """Outgoing (cosine) and incoming (sine) gains of n frames; empty for none."""
    steps = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    phase = lambda i: F.lit(0.5) * F.lit(3.141592653589793) * i / F.greatest(n - 1, F.lit(1))
    return F.transform(steps, lambda i: F.cos(phase(i))), F.transform(steps, lambda i: F.sin(phase(i)))


def crossfaded(a: Column, b: Column) -> Column:
    """Equal-power mix of two overlaps of one length."""
    down, up = equal_power(F.size(a))
    return F.zip_with(F.zip_with(a, down, lambda x, g: x * g), F.zip_with(b, up, lambda x, g: x * g), lambda x, y: x + y)


def appended(mix: Column, incoming: Column, exit: Column, entry: Column, fade: Column, earliest: Column) -> Column:
    """The mix up to the exit, the fade, the rest of the incoming; null (INSUFFICIENT_SESSION_WINDOW) for a partial or backward fade."""
    ok = (fade >= 1) & (exit >= earliest) & (entry >= 0) & (exit + fade <= F.size(mix)) & (entry + fade <= F.size(incoming))
    overlap = crossfaded(F.slice(mix, exit + 1, F.greatest(fade, F.lit(0))), F.slice(incoming, entry + 1, F.greatest(fade, F.lit(0))))
    rest = F.slice(incoming, entry + F.greatest(fade, F.lit(0)) + 1, F.size(incoming))
    return F.when(ok, F.concat(F.slice(mix, 1, F.greatest(exit, F.lit(0))), overlap, rest))


def protected(x: Column) -> Column:
    """Scaled to a peak of 1 if beyond it."""
    p = peak(x)
    return F.when(p > 1, F.transform(x, lambda v: v / p)).otherwise(x)


def pcm16(x: Column) -> Column:
    """Quantised to 16 bits, ties to even, clipped."""
    return F.transform(x, lambda v: F.greatest(F.lit(-32768), F.least(F.lit(32767), F.rint(v * 32767.0).cast("int"))))


def discontinuity_db(x: Column, window: int, floor_dbfs: float = -90.0) -> Column:
    """Level difference in dB of the first and last window (half the overlap at most); null without a frame."""
    k = F.least(F.lit(window), F.floor(F.size(x) / 2).cast("int"))
    floor = 10 ** (floor_dbfs / 20)
    level = lambda part: F.greatest(F.lit(floor), rms(part))
    first, last = level(F.slice(x, 1, F.greatest(k, F.lit(1)))), level(F.slice(x, -F.greatest(k, F.lit(1)), F.greatest(k, F.lit(1))))
    return F.when(k >= 1, F.abs(20 * F.log10(last / first)))


def lag_scores(a: Column, b: Column, max_lag: int) -> Column:
    """struct(lag, score) for each lag: normalised correlation of the arrays, centred once over their common length."""

    def centred(x: Column) -> Column:
        return F.transform(F.array(total(x) / F.size(x)), lambda m: F.transform(x, lambda v: v - m))[0]

    def scores(s: Column) -> Column:
        x, y = s["x"], s["y"]
        n = F.size(x)

        def score(lag: Column) -> Column:
            left = F.slice(x, F.greatest(-lag, F.lit(0)) + 1, n - F.abs(lag))
            right = F.slice(y, F.greatest(lag, F.lit(0)) + 1, n - F.abs(lag))
            pair = F.zip_with(left, right, lambda p, q: F.struct(p.alias("p"), q.alias("q")))
            sums = F.aggregate(pair, F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("b"), F.lit(0.0).alias("c")), lambda t, v: F.struct((t["a"] + v["p"] * v["p"]).alias("a"), (t["b"] + v["q"] * v["q"]).alias("b"), (t["c"] + v["p"] * v["q"]).alias("c")), lambda t: F.when((t["a"] > 0) & (t["b"] > 0), t["c"] / F.when((t["a"] > 0) & (t["b"] > 0), F.sqrt(t["a"]) * F.sqrt(t["b"]))).otherwise(0.0))
            return sums

        return F.transform(F.sequence(F.lit(-max_lag), F.lit(max_lag)), lambda lag: F.struct(lag.alias("lag"), score(lag).alias("score")))

    # each array is cut and centred once, not for every lag
    n = F.least(F.size(a), F.size(b))
    cut = F.transform(F.array(F.struct(F.slice(a, 1, n).alias("x"), F.slice(b, 1, n).alias("y"))), lambda s: F.struct(centred(s["x"]).alias("x"), centred(s["y"]).alias("y")))
    return F.transform(cut, scores)[0]


def best_lag(scores: Column) -> Column:
    """Highest score (to 9 digits), then the smaller shift, then the negative one."""
    ordered = F.array_sort(F.transform(scores, lambda s: F.struct((-F.round(s["score"], 9)).alias("k"), F.abs(s["lag"]).alias("d"), s["lag"].alias("lag"), s["score"].alias("score"))))
    return F.try_element_at(ordered, F.lit(1))


def samples(seconds: Column, rate: int) -> Column:
    """Nearest sample, ties to even."""
    return F.rint(seconds * rate).cast("long")


def beat_samples(beats: int, bpm: Column, rate: int) -> Column:
    """Samples of so many beat intervals, at least 1; 0 for none."""
    if beats <= 0:
        return F.lit(0).cast("long")
    return F.when(bpm > 0, F.greatest(F.lit(1).cast("long"), F.rint(beats * 60.0 / F.when(bpm > 0, bpm) * rate).cast("long"))).otherwise(F.lit(0).cast("long"))


def align_beat(start: Column, end: Column, count: Column, downbeat: bool = True, bar: int = 4) -> Column:
    """First bar boundary in [start, end) within the grid, else the start."""
    last, s = F.least(end, count), F.greatest(start, F.lit(0))
    snapped = s + F.pmod(-s, F.lit(bar)) if downbeat else s
    inside = F.when(snapped < last, snapped).otherwise(s)
    return F.when(last <= 0, F.lit(0)).when(s >= last, F.when(count > 0, F.least(s, count - 1)).otherwise(F.lit(0))).otherwise(inside)


def quantile(x: Column, p: float) -> Column:
    """Interpolated quantile of an array; null for an empty one."""
    at = (F.size(x) - 1) * F.lit(p)
    low = F.floor(at).cast("int")

    def read(s: Column) -> Column:
        a, b = F.try_element_at(s, low + 1), F.try_element_at(s, F.least(F.size(s), low + 2))
        return a + (b - a) * (at - low)

    return F.transform(F.array(F.array_sort(x)), read)[0]


def unit_by_quantiles(x: Column, low: float, high: float) -> Column:
    """An array on its own quantile scale, clipped to [0, 1]; zeros where the span is nothing."""

    def scale(q: Column) -> Column:
        span = q["high"] - q["low"]
        return F.transform(x, lambda v: F.when(span <= 1e-12, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (v - q["low"]) / F.when(span > 1e-12, span)))))

    bounds = F.struct(quantile(x, low).alias("low"), quantile(x, high).alias("high"))
    return F.when(F.size(x) > 0, F.transform(F.array(bounds), scale)[0]).otherwise(x)


def unit_by_db(x: Column, floor: float, ceiling: float) -> Column:
    """RMS values on the dB scale between floor and ceiling, clipped to [0, 1]."""
    return F.transform(x, lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), (20 * F.log10(F.greatest(v, F.lit(1e-12))) - floor) / (ceiling - floor))))


def alignment(a: Column, b: Column, hop: int, max_lag: int, rate: int, floor_dbfs: float = -90.0, least: float = 0.1) -> Column:
    """struct(error_ms, correlation, reason) of two overlaps: the shift of their best-correlated onsets, or why there is none.

    ``max_lag`` is in hops and should stay below half a beat.
    """
    floor = 10 ** (floor_dbfs / 20)
    fields = lambda e, c, r: F.struct(e.cast("double").alias("error_ms"), c.cast("double").alias("correlation"), r.cast("string").alias("reason"))
    none = F.lit(None)

    def judge(x: Column) -> Column:
        p, q = x["p"], x["q"]
        n = F.least(F.size(p), F.size(q))
        silent = (peak(p) <= floor) | (peak(q) <= floor)
        found = F.transform(F.array(best_lag(F.filter(lag_scores(p, q, max_lag), lambda s: F.abs(s["lag"]) <= F.floor((n - 1) / 2)))), lambda k: F.when(k["score"] < least, fields(none, k["score"], F.lit("WEAK_CORRELATION"))).otherwise(fields(F.abs(k["lag"]) * hop * 1000.0 / rate, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), k["score"])), none)))[0]
        return F.when(n < 3, fields(none, none, F.lit("INSUFFICIENT_ONSETS"))).when(silent, fields(none, none, F.lit("SILENT_OR_CONSTANT_OVERLAP"))).otherwise(found)

    return F.transform(F.array(F.struct(onset_envelope(a, hop).alias("p"), onset_envelope(b, hop).alias("q"))), judge)[0]
