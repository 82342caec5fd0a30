"""Experiments with planted truth: tempo and beat errors by sample rate, energy aggregations, region gates under jitter."""

from __future__ import annotations

from dataclasses import replace
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.config import Settings
from tessera.operators import beats as B
from tessera.plans import analysis
from tessera.sources import audio


def click_track(bpm: float, seconds: float = 16.0, rate: int = 22050, phase: float = 0.25) -> tuple[np.ndarray, np.ndarray]:
    """Decaying clicks at a tempo, and their times."""
    y, at = np.zeros(int(seconds * rate), np.float32), np.arange(phase, seconds - 0.2, 60 / bpm)
    for t in at:
        i = int(t * rate)
        y[i : i + 64] += np.exp(-np.arange(64) / 12).astype(np.float32)
    return y, at


def nearest_errors(found: DataFrame, truth: DataFrame) -> DataFrame:
    """Each found beat's distance to the nearest true one of its track, by two ordered windows, without pairs."""
    both = found.select("track_id", F.col("beat_time").alias("t"), F.lit(False).alias("planted")).unionByName(truth.select("track_id", F.col("beat_time").alias("t"), F.lit(True).alias("planted")))
    w = Window.partitionBy("track_id").orderBy("t", F.desc("planted"))
    planted = F.when(F.col("planted"), F.col("t"))
    before = F.last(planted, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(planted, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    out = both.withColumns({"__b": before, "__a": after}).where("not planted")
    return out.select("track_id", F.col("t").alias("beat_time"), F.least(F.col("t") - F.col("__b"), F.col("__a") - F.col("t")).alias("error"))


def error_report(errors: DataFrame, group: str) -> DataFrame:
    return errors.groupBy(group).agg(F.avg(F.abs("error")).alias("mean_abs_error"), F.percentile(F.abs("error"), 0.95).alias("p95"), F.count("*").alias("n"))


def sample_rates(spark: SparkSession, bpms: tuple[float, ...] = (100, 120, 124, 128, 140), rates: tuple[int, ...] = (22050, 44100), settings: Settings = Settings(), seconds: float = 24.0) -> DataFrame:
    """rate, tracks found, mean tempo error, mean and 95th percentile of the beat error."""
    parts = []
    for rate in rates:
        cfg = replace(settings, analysis=replace(settings.analysis, sample_rate=rate, hop_length=settings.analysis.hop_length * rate // 22050, refine_hop_length=settings.analysis.refine_hop_length * rate // 22050))
        made = [click_track(b, seconds, rate) for b in bpms]
        pcm = spark.createDataFrame([(i, y.tolist()) for i, (y, _) in enumerate(made)], "track_id long, samples array<float>")
        truth = spark.createDataFrame([(i, float(t)) for i, (_, at) in enumerate(made) for t in at], "track_id long, beat_time double")
        tempo = spark.createDataFrame([(i, float(b)) for i, b in enumerate(bpms)], "track_id long, bpm double")
        tracks, _ = analysis.analyze(pcm, cfg)
        kept = tracks.where("beat_times is not null")
        errors = nearest_errors(kept.select("track_id", F.explode("beat_times").alias("beat_time")), truth).withColumn("rate", F.lit(rate))
        off = kept.join(tempo, "track_id").agg(F.count("*").alias("tracks"), F.avg(F.abs(F.col("native_bpm") - F.col("bpm"))).alias("mean_bpm_error"))
        parts.append(error_report(errors, "rate").join(off))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def region_gates(spark: SparkSession, jitters: tuple[float, ...] = (0.0, 0.02, 0.05, 0.08), onset: float = 1.0, beats: int = 48, bpm: float = 124.0, settings: Settings = Settings()) -> DataFrame:
    """jitter, regions kept, best score, for grids whose intervals vary by that share."""
    rows = []
    for k, j in enumerate(jitters):
        rng = np.random.default_rng(k)
        t = np.cumsum(60 / bpm * (1 + rng.normal(0, j, beats)))
        rows += [(k, i, float(x), onset) for i, x in enumerate(t)]
    grid = spark.createDataFrame(rows, "track_id long, beat_index int, beat_time double, onset_unit double")
    kept = B.suppressed(B.gated(B.stable_windows(grid, settings.regions), settings.regions), settings.regions)
    names = spark.createDataFrame(list(enumerate(map(float, jitters))), "track_id long, jitter double")
    return names.join(kept.groupBy("track_id").agg(F.count("*").alias("regions"), F.max("score").alias("score")), "track_id", "left").select("jitter", F.coalesce("regions", F.lit(0)).alias("regions"), "score")


def aggregations(spark: SparkSession, settings: Settings = Settings()) -> DataFrame:
    """Energy scalar of a pulsed tone with and without loud ends, by each aggregation."""
    rate = settings.analysis.sample_rate
    t = np.arange(24 * rate) / rate
    tone = (0.2 * np.sin(2 * np.pi * 220 * t) * (np.mod(t, 0.5) < 0.25)).astype(np.float32)
    loud = tone.copy()
    loud[: 2 * rate] *= 4
    loud[-2 * rate :] *= 4
    pcm = spark.createDataFrame([(0, tone.tolist()), (1, loud.tolist())], "track_id long, samples array<float>")
    found, out = analysis.signals(pcm, settings), None
    for a in ("median", "mean", "p90"):
        part = analysis.energy(found, replace(settings, energy=replace(settings.energy, aggregation=a))).select(F.lit(a).alias("aggregation"), "track_id", "energy_scalar")
        out = part if out is None else out.unionByName(part)
    return out.groupBy("aggregation").pivot("track_id", [0, 1]).agg(F.first("energy_scalar")).withColumnsRenamed({"0": "plain", "1": "loud_ends"})


def with_clicks(samples: np.ndarray, times: np.ndarray, rate: int, level: float = 0.5) -> np.ndarray:
    """Mono audio with a short tick at each beat time, for listening to a grid; within full scale."""
    out = np.array(samples, np.float32)
    tick = level * np.sin(2 * np.pi * 1000 * np.arange(int(0.02 * rate)) / rate) * np.exp(-np.arange(int(0.02 * rate)) / (0.004 * rate))
    for t in np.asarray(times, float):
        i = int(np.rint(t * rate))
        if 0 <= i < len(out):
            n = min(len(tick), len(out) - i)
            out[i : i + n] += tick[:n]
    return np.clip(out, -1, 1)


def write_clicks(tracks: DataFrame, pcm: DataFrame, folder: str, rate: int) -> DataFrame:
    """Writes each track's audio with ticks at its beats as a WAV file; gives track_id, file, ticks, failure_reason.

    tracks: track_id, audio_path, beat_times.  pcm: track_id, mono ``samples`` at
    ``rate``.  The files are written by the tasks when the result is read, so
    ``folder`` is one that all executors share.  A file is there whole or not at
    all and is never replaced: other content under its name is a failure (EXISTS),
    the same content (of an attempt that was lost, or an equal row) is not.  Tracks
    without audio or beats are failures too.  The track's id keeps names apart.
    """
    names = "track_id long, file string, ticks int, failure_reason string"

    def write(batches):
        import pandas as pd

        to = Path(folder)
        for batch in batches:
            out = []
            for r in batch.itertuples():
                if r.samples is None or r.beat_times is None:
                    out.append((r.track_id, None, None, "MISSING_AUDIO" if r.samples is None else "NO_BEATS"))
                    continue
                name = f"{r.track_id}-{Path(r.audio_path or '').stem}.beats.wav"
                samples, times = np.asarray(r.samples, np.float32), np.asarray(r.beat_times, float)
                data = audio.wav_bytes(with_clicks(samples, times, rate)[:, None], rate)
                inside = int(((np.rint(times * rate) >= 0) & (np.rint(times * rate) < len(samples))).sum())
                out.append((r.track_id, name, inside, None if audio.write_new(str(to / name), data) else "EXISTS"))
            yield pd.DataFrame(out, columns=[f.split(" ")[0] for f in names.split(", ")]).astype({"ticks": "Int32"})

    rows = tracks.select("track_id", "audio_path", "beat_times").join(pcm.select("track_id", "samples"), "track_id", "left")
    return rows.mapInPandas(write, names)


def confidence_report(tracks: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Each analysed track's regularity, contrast and confidence against their floors, the least certain first."""
    a = settings.analysis
    regularity = F.greatest(F.lit(0.0), 1 - F.col("ibi_cv") / a.max_ibi_cv)
    rows = tracks.where("native_bpm is not null").select("track_id", "native_bpm", regularity.alias("regularity"), F.col("onset_contrast").alias("contrast"), F.col("analysis_confidence").alias("confidence"))
    return rows.withColumn("margin", F.col("confidence") - a.min_confidence).orderBy("confidence", "track_id")
