"""Track analysis: a signal kernel for each track, everything after it as DataFrame operators.

The kernel turns samples into onset envelopes, frame levels and a raw beat
sequence.  Octave choice, refinement, gates, energy and stable regions are
relational, so a library is analysed in one plan and failures are rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.config import Settings
from tessera.functions import frames as A
from tessera.functions import kernels
from tessera.operators import beats as B
from tessera.sources.scratch import checkpointed

_KERNEL = "track_id bigint, seconds double, onset array<double>, fine array<double>, rms array<double>, beats array<double>"


def signals(pcm: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """(track_id, samples: mono floats at the analysis rate) -> envelopes, levels and raw beats."""
    a = cfg.analysis

    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                y = np.array(r["samples"] or [], np.float32)
                onset = kernels.onset_strength(y, a.sample_rate, a.hop_length)
                fine = kernels.onset_strength(y, a.sample_rate, a.refine_hop_length)
                rms = kernels.block_rms(y, min(2 * a.hop_length, max(1, len(y))), a.hop_length) if len(y) else np.zeros(0)
                beats = kernels.track_beats(onset, a.frame_hz, a.start_bpm)
                rows.append((r["track_id"], len(y) / a.sample_rate, onset, fine, rms, beats))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = [pa.int64(), pa.float64(), *[pa.list_(pa.float64())] * 4]
            yield pa.RecordBatch.from_arrays([pa.array([x.tolist() if isinstance(x, np.ndarray) else x for x in c], k) for c, k in zip(columns, kinds, strict=True)], ["track_id", "seconds", "onset", "fine", "rms", "beats"])

    return pcm.select("track_id", "samples").mapInArrow(run, _KERNEL)


def energy(found: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """track_id, onset_unit, energy_curve at ``curve_hz`` and energy_scalar."""
    e, hz = cfg.energy, cfg.analysis.frame_hz
    n = F.least(F.size("onset"), F.size("rms"))
    rows = found.select("track_id", "seconds", F.slice("onset", 1, n).alias("onset"), F.slice("rms", 1, n).alias("rms"))
    rows = rows.withColumn("onset_unit", A.unit_by_quantiles(F.col("onset"), e.low, e.high)).withColumn("level", A.unit_by_db(F.col("rms"), e.floor_db, e.ceiling_db))
    rows = rows.withColumn("both", F.zip_with("level", "onset_unit", lambda a, b: e.alpha * a + (1 - e.alpha) * b))
    points = F.ceil(F.col("seconds") * e.curve_hz).cast("int")
    grid = F.when((points > 0) & (F.size("both") > 0), F.sequence(F.lit(0), points - 1)).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("energy_curve", F.transform(grid, lambda i: B.energy_at(i / e.curve_hz, F.col("both"), hz)))
    curve = F.col("energy_curve")
    scalar = {"mean": A.total(curve) / F.size(curve), "median": A.quantile(curve, 0.5), "p90": A.quantile(curve, 0.9)}[e.aggregation]
    return rows.select("track_id", "onset_unit", "energy_curve", F.when(F.size(curve) > 0, scalar).otherwise(0.0).alias("energy_scalar"))


def analyze(pcm: DataFrame, cfg: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """(tracks, regions).  tracks has one row for each input with its features or a failure_reason."""
    a = cfg.analysis
    # the kernel's results are read by many branches: written once, and not made again if an executor is lost
    found = checkpointed(signals(pcm, cfg))
    raw = found.select("track_id", F.posexplode("beats").alias("beat_index", "beat_time"))
    grids = B.octave_grids(raw)
    chosen = B.choose_octave(B.evaluate_grids(grids, found.select("track_id", F.col("onset").alias("values")), a.frame_hz), a)
    kept = grids.join(chosen.where("failure_reason is null").select("track_id", "grid"), ["track_id", "grid"])
    fine = found.select("track_id", F.col("fine").alias("values"))
    moved = kept.join(fine, "track_id").select("track_id", B.refined(F.col("beat_time"), F.col("values"), a.refine_frame_hz, a.refine_radius).alias("t"))
    times = checkpointed(moved.groupBy("track_id").agg(F.collect_list("t").alias("t")).select("track_id", B.deduped(F.col("t")).alias("beat_times")))
    beats = times.select("track_id", F.posexplode("beat_times").alias("beat_index", "beat_time"))
    stats = B.tempo_cv(B.intervals(beats))
    locked = B.evaluate_grids(beats.select("track_id", F.lit(0).alias("grid"), F.lit(1.0).alias("factor"), "beat_time", F.col("beat_index").alias("pos")), fine, a.refine_frame_hz).select("track_id", "contrast")
    rows = found.select("track_id", F.size("onset").alias("__onset"), F.size("beats").alias("__raw")).join(chosen.select("track_id", "factor", F.col("failure_reason").alias("__octave")), "track_id", "left")
    rows = rows.join(stats, "track_id", "left").join(locked, "track_id", "left").join(times, "track_id", "left")
    early = F.when(F.col("__onset") == 0, "EMPTY_ONSET_ENVELOPE").when(F.col("__raw") < 2, "TOO_FEW_BEATS").when(F.col("__octave").isNotNull(), F.col("__octave"))
    gate = B.beat_gate(F.coalesce(F.size("beat_times"), F.lit(0)), F.col("bpm"), F.col("ibi_cv"), F.col("contrast"), a)
    rows = rows.withColumn("failure_reason", F.coalesce(early, gate))
    confidence = F.greatest(F.lit(0.0), 1 - F.col("ibi_cv") / a.max_ibi_cv) * F.greatest(F.lit(0.0), F.col("contrast"))
    powered = energy(found, cfg)
    ok = rows.where("failure_reason is null").select("track_id")
    at = beats.join(ok, "track_id", "left_semi").join(powered, "track_id")
    level = lambda values, hz: F.try_element_at(values, B.frame_of(F.col("beat_time"), hz, 1.0, F.size(values)) + 1)
    at = at.select("track_id", "beat_index", "beat_time", level(F.col("onset_unit"), a.frame_hz).alias("onset_unit"), B.energy_at(F.col("beat_time"), F.col("energy_curve"), cfg.energy.curve_hz).alias("energy"))
    regions = B.suppressed(B.gated(B.stable_windows(at, cfg.regions), cfg.regions), cfg.regions)
    has = regions.select("track_id", F.lit(True).alias("__region")).distinct()
    done = rows.join(powered.drop("onset_unit"), "track_id", "left").join(has, "track_id", "left")
    reason = F.coalesce("failure_reason", F.when(F.col("__region").isNull(), "NO_STABLE_REGION"))
    features = {"native_bpm": F.col("bpm"), "analysis_confidence": confidence, "ibi_cv": F.col("ibi_cv"), "onset_contrast": F.col("contrast"), "tempo_octave_factor": F.col("factor"), "energy_scalar": F.col("energy_scalar")}
    tracks = done.select(
        "track_id", reason.alias("failure_reason"), *[F.when(reason.isNull(), F.bround(c, 6)).alias(k) for k, c in features.items()],
        F.when(reason.isNull(), F.transform("beat_times", lambda t: F.bround(t, 6))).alias("beat_times"), F.when(reason.isNull(), F.transform("energy_curve", lambda v: F.bround(v, 6))).alias("energy_curve"),
    )
    return tracks, regions
