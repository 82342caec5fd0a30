"""Audio as numbered blocks of samples: windows, measurements and mixes that never hold a whole stem.

A stem (one channel, at the tempo of its use) is rows of (track_id, block, x),
each block but the last of the same size.  A window of it is an equi-join with
the few blocks that it touches; a fade is measured from two such windows; a
session's mix is the sum of the pieces that its stems lay on each block of the
mix, at most a few for each.  So a task holds blocks, whatever the length of
stems and mixes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import frames as A
from tessera.functions import kernels as K

SIZE = 1 << 16


def blocks(pcm: DataFrame, size: int = SIZE) -> DataFrame:
    """track_id and samples -> track_id, block, x; a track without samples has no blocks."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.column(1).slice(i, 1)
                values = row.flatten() if row.null_count == 0 else pa.array([], pa.float64())
                starts = range(0, len(values), size)
                offsets = np.minimum(np.arange(len(starts) + 1) * size, len(values)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.repeat(batch.column(0)[i], len(starts)), pa.array(range(len(starts)), pa.int64()), pa.ListArray.from_arrays(offsets, values.cast(pa.float64()))], ["track_id", "block", "x"])

    return pcm.select(F.col("track_id").cast("bigint"), F.col("samples").cast("array<double>")).mapInArrow(run, "track_id bigint, block bigint, x array<double>")


def lengths(stems: DataFrame) -> DataFrame:
    """track_id, frames."""
    return stems.groupBy("track_id").agg(F.sum(F.size("x")).cast("bigint").alias("frames"))


def stretched(stems: DataFrame, ratios: DataFrame, size: int = SIZE) -> DataFrame:
    """Stems at another tempo (ratios: track_id, stretch_ratio; over 1 is shorter): track_id, block, x, in blocks of ``size``.

    Each track's blocks pass in order through one stretcher that carries its state
    over their borders: a task holds a few blocks, however long the track.  The
    tracks are dealt by their id.  A track without a ratio over 0 has no result.
    """

    def run(batches):
        track, one, rest, block = None, None, np.zeros(0), 0

        def cut(last: bool):
            nonlocal rest, block
            while len(rest) >= size or (last and len(rest)):
                yield pa.RecordBatch.from_arrays([pa.array([track], pa.int64()), pa.array([block], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(rest[:size])], pa.int32()), pa.array(rest[:size], pa.float64()))], ["track_id", "block", "x"])
                rest, block = rest[size:], block + 1

        for batch in batches:
            for i in range(batch.num_rows):
                if (ident := batch.column(0)[i].as_py()) != track:
                    if one is not None:
                        rest = np.concatenate([rest, one.finish()])
                        yield from cut(True)
                    track, one, rest, block = ident, K.Stretcher(batch.column(2)[i].as_py()), np.zeros(0), 0
                rest = np.concatenate([rest, one.feed(batch.column(1).slice(i, 1).flatten().to_numpy())])
                yield from cut(False)
        if one is not None:
            rest = np.concatenate([rest, one.finish()])
            yield from cut(True)

    usable = ratios.where("stretch_ratio > 0 and stretch_ratio < double('infinity')").select("track_id", F.col("stretch_ratio").cast("double"))
    rows = stems.join(usable, "track_id").repartition("track_id").sortWithinPartitions("track_id", "block")
    return rows.select("track_id", "x", "stretch_ratio").mapInArrow(run, "track_id bigint, block bigint, x array<double>")


def _touched(start: Column, stop: Column, size: int) -> Column:
    """Numbers of the blocks that [start, stop) touches; none if it is empty."""
    first, last = F.floor(start / size).cast("bigint"), F.floor((stop - 1) / size).cast("bigint")
    return F.when(stop > start, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))


def windows(asked: DataFrame, stems: DataFrame, *keys: str, size: int = SIZE) -> DataFrame:
    """The samples [start, start + frames) of asked windows (keys, track_id, start, frames): keys, x; as many of them as there are."""
    start, stop = F.greatest(F.col("start"), F.lit(0)), F.col("start") + F.col("frames")
    rows = asked.select(*keys, "track_id", start.alias("start"), stop.alias("stop")).withColumn("block", F.explode(_touched(F.col("start"), F.col("stop"), size)))
    low, high = F.greatest(F.col("start") - F.col("block") * size, F.lit(0)), F.least(F.col("stop") - F.col("block") * size, F.size("x").cast("bigint"))
    part = F.slice("x", (low + 1).cast("int"), F.greatest(high - low, F.lit(0)).cast("int"))
    pieces = rows.join(stems, ["track_id", "block"]).select(*keys, F.struct("block", part.alias("x")).alias("p"))
    return pieces.groupBy(*keys).agg(F.sort_array(F.collect_list("p")).alias("p")).select(*keys, F.flatten(F.transform("p", lambda p: p["x"])).alias("x"))


def measured(plans: DataFrame, stems: DataFrame, rate: int, hop: int, max_lag: int, level_window: int, size: int = SIZE, floor_dbfs: float = -90.0, least: float = 0.1) -> DataFrame:
    """Attempts as rows: each planned fade measured, or its failure.

    plans: attempt_id, track_a_id, track_b_id, at_a and at_b (samples where the
    fade begins), fade, failure_reason (of planning, or null).  Gives status,
    failure_reason, fade_frames (no more than both stems have left),
    alignment_error_ms, alignment_correlation, alignment_reason and
    energy_discontinuity_db of the faded mix.  ``hop`` and ``level_window`` are in
    samples, ``max_lag`` in hops.
    """
    have = lengths(stems)
    side = lambda p: have.select(F.col("track_id").alias(f"track_{p}_id"), F.col("frames").alias(f"frames_{p}"))
    rows = plans.join(side("a"), "track_a_id", "left").join(side("b"), "track_b_id", "left")
    room = F.least(F.col("fade"), F.col("frames_a") - F.col("at_a"), F.col("frames_b") - F.col("at_b"))
    missing = F.col("frames_a").isNull() | F.col("frames_b").isNull()
    short = (F.col("at_a") < 0) | (F.col("at_b") < 0) | (room < 1) | F.col("fade").isNull()
    reason = F.coalesce(F.col("failure_reason"), F.when(missing, "MISSING_TRACK").when(short, "INSUFFICIENT_AUDIO"))
    rows = rows.withColumn("failure_reason", reason).withColumn("fade_frames", F.when(reason.isNull(), room))
    good = rows.where("failure_reason is null")
    part = lambda p: windows(good.select("attempt_id", F.col(f"track_{p}_id").alias("track_id"), F.col(f"at_{p}").alias("start"), F.col("fade_frames").alias("frames")), stems, "attempt_id", size=size).withColumnRenamed("x", p)
    pairs = part("a").join(part("b"), "attempt_id")
    heard = A.alignment(F.col("a"), F.col("b"), hop, max_lag, rate, floor_dbfs, least)
    found = pairs.select("attempt_id", heard.alias("h"), A.discontinuity_db(A.crossfaded(F.col("a"), F.col("b")), level_window, floor_dbfs).alias("energy_discontinuity_db"))
    found = found.select("attempt_id", F.col("h.error_ms").alias("alignment_error_ms"), F.col("h.correlation").alias("alignment_correlation"), F.col("h.reason").alias("alignment_reason"), "energy_discontinuity_db")
    status = F.when(F.col("failure_reason").isNull(), "RENDERED").otherwise("FAILED")
    return rows.join(found, "attempt_id", "left").select("attempt_id", "track_a_id", "track_b_id", status.alias("status"), "failure_reason", "fade_frames", *found.columns[1:])


def mixed(timeline: DataFrame, stems: DataFrame, size: int = SIZE) -> DataFrame:
    """Mixes by overlap-add: session_id, block, x.

    timeline: session_id, step, track_id, offset (sample of the mix where the
    stem's first would be), start and stop (where it is heard), fade_in and
    fade_out (samples of equal-power fades at its ends; 0 for none).
    """
    rows = timeline.withColumn("block", F.explode(_touched(F.col("start") - F.col("offset"), F.col("stop") - F.col("offset"), size)))
    rows = rows.join(stems, ["track_id", "block"])
    origin = F.col("offset") + F.col("block") * size
    rows = rows.withColumns({"origin": origin, "low": F.greatest(F.col("start"), origin), "high": F.least(F.col("stop"), origin + F.size("x"))})
    rows = rows.withColumn("out", F.explode(_touched(F.col("low"), F.col("high"), size)))
    rows = rows.withColumns({"low": F.greatest("low", F.col("out") * size), "high": F.least("high", (F.col("out") + 1) * size)})

    def gain(at: Column) -> Column:
        phase = lambda i, n: 0.5 * 3.141592653589793 * i / F.greatest(n - 1, F.lit(1))
        up = F.when(at < F.col("start") + F.col("fade_in"), F.sin(phase(at - F.col("start"), F.col("fade_in")))).otherwise(F.lit(1.0))
        down = F.when(at >= F.col("stop") - F.col("fade_out"), F.cos(phase(at - F.col("stop") + F.col("fade_out"), F.col("fade_out")))).otherwise(F.lit(1.0))
        return up * down

    heard = F.slice("x", (F.col("low") - F.col("origin") + 1).cast("int"), (F.col("high") - F.col("low")).cast("int"))
    level = F.transform(heard, lambda v, i: v * gain(F.col("low") + i))
    zeros = lambda n: F.array_repeat(F.lit(0.0), n.cast("int"))
    before, after = F.col("low") - F.col("out") * size, (F.col("out") + 1) * size - F.col("high")
    pieces = rows.select("session_id", F.col("out").alias("block"), F.struct("step", F.col("high").alias("high"), F.concat(zeros(before), level, zeros(after)).alias("x")).alias("p"))
    # a few stems for each block: they overlap in fades only
    held = pieces.groupBy("session_id", "block").agg(F.sort_array(F.collect_list("p")).alias("p"))
    total = F.aggregate("p", zeros(F.lit(size)), lambda acc, p: F.zip_with(acc, p["x"], lambda a, b: a + b))
    last = F.array_max(F.transform("p", lambda p: p["high"])) - F.col("block") * size
    return held.select("session_id", "block", F.slice(total, F.lit(1), last.cast("int")).alias("x"))


def protected(mix: DataFrame) -> DataFrame:
    """(session_id, block, x scaled so that no sample of the session is beyond 1, peak, clipped); one number a session is shared."""
    peaks = mix.groupBy("session_id").agg(F.max(A.peak(F.col("x"))).alias("peak"))
    rows = mix.join(peaks, "session_id")
    return rows.select("session_id", "block", F.when(F.col("peak") > 1, F.transform("x", lambda v: v / F.col("peak"))).otherwise(F.col("x")).alias("x"), "peak", (F.col("peak") > 1).alias("clipped"))


def session_timeline(chain: DataFrame) -> DataFrame:
    """Timeline for ``mixed`` from the rows of ``session.chain``; sessions that found no second track have no mix."""
    fade = lambda there: F.when(there, F.col("fade_frames")).otherwise(F.lit(0))
    return chain.where("status <> 'FAILED'").select(F.col("seed_id").alias("session_id"), "step", "track_id", "offset", F.col("start_sample").alias("start"), F.col("stop_sample").alias("stop"), fade(F.col("step") > 1).alias("fade_in"), fade(F.col("fades_out")).alias("fade_out"))


def session_transitions(chain: DataFrame, rate: int) -> DataFrame:
    """The transitions of each session, in order: from and to, and when the fade begins and ends."""
    later = chain.where("step > 1").select("seed_id", (F.col("step") - 1).alias("step"), F.col("track_id").alias("to_track_id"), F.col("start_seconds"), ((F.col("start_sample") + F.col("fade_frames")) / rate).alias("end_seconds"))
    return chain.select("seed_id", "step", F.col("track_id").alias("from_track_id")).join(later, ["seed_id", "step"])
