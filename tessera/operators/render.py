"""Rendering: sample arithmetic as columns, sample work in Arrow batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.config import Settings
from tessera.functions import frames as A
from tessera.operators.select import in_bound


def geometry(pairs: DataFrame, tracks: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """For (track_a_id, track_b_id): lengths after stretching, fade, samples before and after it, or a failure code.

    The session runs at a's tempo, so a is not stretched; without beats at hand
    the fade starts at the edges of the search windows.
    """
    rate, t, tr = cfg.render.sample_rate, cfg.tempo, cfg.transition
    side = lambda p: tracks.select(F.col("track_id").alias(f"track_{p}_id"), F.col("native_bpm").alias(f"bpm_{p}"), F.col("duration_seconds").alias(f"seconds_{p}"))
    rows = pairs.select("track_a_id", "track_b_id").join(side("a"), "track_a_id", "left").join(side("b"), "track_b_id", "left")
    ratio = F.col("bpm_a") / F.when(F.col("bpm_b") > 0, F.col("bpm_b"))
    rows = rows.withColumns({
        "stretch_b": ratio,
        "frames_a": A.samples(F.col("seconds_a"), rate),
        "frames_b": A.samples(F.col("seconds_b") / ratio, rate),
        "at_a": A.samples(F.col("seconds_a") * tr.outgoing[0], rate),
        "at_b": A.samples(F.col("seconds_b") / ratio * tr.incoming[0], rate),
        "wanted": A.beat_samples(tr.crossfade_beats, F.col("bpm_a"), rate),
        "margin": A.beat_samples(tr.margin_beats, F.col("bpm_a"), rate),
    })
    room = F.least(F.col("frames_a") - F.col("at_a"), F.col("frames_b") - F.col("at_b"))
    failure = (
        F.when(F.col("bpm_a").isNull() | F.col("bpm_b").isNull(), "MISSING_TRACK")
        .when(F.col("bpm_b") <= 0, "STRETCH_OUT_OF_BOUNDS")
        .when(~in_bound(ratio, t), "STRETCH_OUT_OF_BOUNDS")
        .when((room < 1) | (F.col("wanted") < 1), "INSUFFICIENT_AUDIO")
    )
    fade = F.least(F.col("wanted"), room)
    zero = F.lit(0).cast("long")
    out = rows.withColumn("failure_reason", failure).withColumn("fade_frames", F.when(failure.isNull(), fade))
    return out.withColumns({
        "pre_samples": F.when(F.col("failure_reason").isNull(), F.least(F.col("margin"), F.greatest(zero, F.col("at_a")))),
        "post_samples": F.when(F.col("failure_reason").isNull(), F.least(F.col("margin"), F.greatest(zero, F.col("frames_b") - F.col("at_b") - F.col("fade_frames")))),
    })


_MIXED = "track_a_id bigint, track_b_id bigint, samples array<float>, channels int, rate int, fade_start_sample bigint, fade_frames bigint, peak_dbfs double, peak_exceeded boolean, clipped boolean, failure_reason string"


def render(plans: DataFrame, pcm: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """Mixes of planned transitions; a pair that can't be rendered is a row with its failure code.

    plans: track_a_id, track_b_id, session_bpm, bpm_a, bpm_b, at_a and at_b (seconds
    on the original timelines where the fade begins).  pcm: track_id and
    interleaved float samples at the render rate.  Stems meet by two joins; each
    pair is rendered alone in its batch.
    """
    import numpy as np
    import pyarrow as pa

    from tessera.functions import kernels as K

    r, tr, tempo = cfg.render, cfg.transition, cfg.tempo

    def one(row: dict) -> tuple:
        if row["a"] is None or row["b"] is None:
            raise ValueError("MISSING_TRACK")
        ratios = []
        for native in (row["bpm_a"], row["bpm_b"]):
            ratio = row["session_bpm"] / native if native > 0 and row["session_bpm"] > 0 else 0
            if not tempo.min_stretch - 1e-12 <= ratio <= tempo.max_stretch + 1e-12:
                raise ValueError("STRETCH_OUT_OF_BOUNDS")
            ratios.append(ratio)
        stems = [K.stretched(np.array(row[k], np.float32).reshape(-1, r.channels), q) for k, q in zip("ab", ratios, strict=True)]
        at = [int(np.rint(row[f"at_{k}"] / q * r.sample_rate)) for k, q in zip("ab", ratios, strict=True)]
        beats = lambda n: max(1, int(np.rint(n * 60.0 / row["session_bpm"] * r.sample_rate)))
        mix, start, fade = K.transition(*stems, *at, beats(tr.crossfade_beats), beats(tr.margin_beats), beats(tr.margin_beats))
        audio, level, exceeded, clipped = K.protected(mix, r.peak_ceiling_dbfs)
        return audio.ravel().tolist(), start, fade, level, exceeded, clipped, None

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):  # a row holds two stems
                row = batch.slice(i, 1).to_pylist()[0]
                try:
                    samples, *rest = one(row)
                except ValueError as e:
                    samples, rest = None, [None, None, None, None, None, str(e)]
                values = [row["track_a_id"], row["track_b_id"], samples, r.channels, r.sample_rate, *rest]
                kinds = [pa.int64(), pa.int64(), pa.list_(pa.float32()), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.bool_(), pa.bool_(), pa.string()]
                names = [f.split(" ")[0] for f in _MIXED.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names)

    rows = plans.join(pcm.select(F.col("track_id").alias("track_a_id"), F.col("samples").alias("a")), "track_a_id", "left")
    rows = rows.join(pcm.select(F.col("track_id").alias("track_b_id"), F.col("samples").alias("b")), "track_b_id", "left")
    return rows.select("track_a_id", "track_b_id", "session_bpm", "bpm_a", "bpm_b", "at_a", "at_b", "a", "b").mapInArrow(run, _MIXED)


def transition_file(a: str, b: str, out: str, into: str):
    """Name of a rendered transition."""
    return F.concat(F.lit("a"), F.col(a), F.lit("_b"), F.col(b), F.lit("_out"), F.col(out), F.lit("_in"), F.col(into), F.lit(".wav"))
