"""Beat grids: intervals, octave choice, refinement, gates and stable regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.config import Analysis, Regions

EPSILON = 1e-12


def _track(*order: str) -> Window:
    return Window.partitionBy("track_id").orderBy(*order)


def intervals(beats: DataFrame) -> DataFrame:
    """Positive differences between neighbouring beats of a track."""
    d = F.col("beat_time") - F.lag("beat_time").over(_track("beat_index"))
    return beats.withColumn("ibi", d).where("ibi > 0")


def tempo_cv(beats: DataFrame, *keys: str) -> DataFrame:
    """bpm (60 over the median interval), interval CV (null where the grid is too short, where a plain program would say infinite), n."""
    keys = keys or ("track_id",)
    d = F.col("ibi")
    cv = F.when((F.count(d) >= 2) & (F.avg(d) > 0), F.stddev_samp(d) / F.avg(d))
    return beats.groupBy(*keys).agg((60.0 / F.median(d)).alias("bpm"), cv.alias("ibi_cv"), F.count(d).alias("n"))


def frame_of(time: Column, sample_rate: float, hop: float, count: Column) -> Column:
    """Nearest frame (ties to even), within the array."""
    return F.when(time.isNotNull(), F.greatest(F.lit(0), F.least(count - 1, F.rint(time * sample_rate / hop).cast("int"))))


def octave_grids(beats: DataFrame) -> DataFrame:
    """Each track's grid as it is, its even and odd beats, and with midpoints: grid (0..3 in that order), factor, pos, beat_time."""
    n = F.count("*").over(Window.partitionBy("track_id"))
    base = beats.withColumn("__n", n)
    whole = base.select("track_id", F.lit(0).alias("grid"), F.lit(1.0).alias("factor"), "beat_time", F.col("beat_index").cast("double").alias("at"))
    even = base.where("beat_index % 2 = 0 and __n >= 3").select("track_id", F.lit(1).alias("grid"), F.lit(0.5).alias("factor"), "beat_time", F.col("beat_index").cast("double").alias("at"))
    odd = base.where("beat_index % 2 = 1 and __n >= 4").select("track_id", F.lit(2).alias("grid"), F.lit(0.5).alias("factor"), "beat_time", F.col("beat_index").cast("double").alias("at"))
    nxt = F.lead("beat_time").over(_track("beat_index"))
    mid = base.withColumn("__next", nxt).where("__next is not null").select("track_id", F.lit(3).alias("grid"), F.lit(2.0).alias("factor"), ((F.col("beat_time") + F.col("__next")) / 2).alias("beat_time"), (F.col("beat_index") + 0.5).alias("at"))
    double = base.where("__n >= 2").select("track_id", F.lit(3).alias("grid"), F.lit(2.0).alias("factor"), "beat_time", F.col("beat_index").cast("double").alias("at"))
    every = whole.unionByName(even).unionByName(odd).unionByName(mid).unionByName(double)
    return every.withColumn("pos", F.row_number().over(Window.partitionBy("track_id", "grid").orderBy("beat_time", "at")) - 1).drop("at")


def evaluate_grids(grids: DataFrame, onset: DataFrame, frame_hz: float) -> DataFrame:
    """bpm, contrast, mean onset on the beat and score of each grid; ``onset`` holds one array of values per track."""
    # beats are put in order before they meet the array, which no sort or shuffle carries along
    after = F.lead("beat_time").over(Window.partitionBy("track_id", "grid").orderBy("pos"))
    joined = grids.withColumn("__next", after).join(onset.select("track_id", "values").hint("merge"), "track_id")
    nxt = F.col("__next")
    size = F.size("values")
    at = lambda t: F.try_element_at("values", frame_of(t, frame_hz, 1.0, size) + 1)
    rows = joined.withColumns({"ibi": nxt - F.col("beat_time"), "on": at(F.col("beat_time")), "off": at((F.col("beat_time") + nxt) / 2)})
    ibi = F.when(F.col("ibi") > 0, F.col("ibi"))
    out = rows.groupBy("track_id", "grid", "factor").agg((60.0 / F.median(ibi)).alias("bpm"), F.avg("on").alias("mean_onbeat"), F.avg("off").alias("mean_offbeat"))
    contrast = (F.col("mean_onbeat") - F.col("mean_offbeat")) / (F.col("mean_onbeat") + F.col("mean_offbeat") + EPSILON)
    return out.withColumn("contrast", contrast).withColumn("score", F.col("mean_onbeat") * F.greatest(F.lit(0.0), F.col("contrast")))


def choose_octave(evaluated: DataFrame, cfg: Analysis = Analysis()) -> DataFrame:
    """The best-scoring grid within the tempo band, else the best of all with TEMPO_OUT_OF_RANGE; near ties go to the prior, then to grid order."""
    inside = F.col("bpm").between(cfg.min_bpm, cfg.max_bpm)
    order = [F.desc("inside"), F.desc(F.round("score", 9)), F.round(F.abs(F.col("bpm") - cfg.start_bpm), 9), F.col("grid")]
    best = evaluated.withColumn("inside", F.coalesce(inside, F.lit(False))).withColumn("__r", F.row_number().over(Window.partitionBy("track_id").orderBy(*order))).where("__r = 1")
    return best.withColumn("failure_reason", F.when(~F.col("inside"), "TEMPO_OUT_OF_RANGE")).drop("__r", "inside", "mean_offbeat")


def parabolic(left: Column, peak: Column, right: Column) -> Column:
    """Offset of the vertex in frames, within half a frame; 0 for a flat or convex neighbourhood."""
    curve = left - 2 * peak + right
    return F.when(curve < 0, F.greatest(F.lit(-0.5), F.least(F.lit(0.5), 0.5 * (left - right) / F.when(curve < 0, curve)))).otherwise(0.0)


def refined(time: Column, values: Column, frame_hz: float, radius: int) -> Column:
    """Time of the interpolated onset peak near a beat; the beat's own time where there is no room."""
    n = F.size(values)
    centre = F.rint(time * frame_hz).cast("int")
    low, high = F.greatest(F.lit(1), centre - radius), F.least(n - 1, centre + radius + 1)
    window = F.slice(values, low + 1, F.greatest(F.lit(0), high - low))
    first = F.array_position(window, F.array_max(window)).cast("int") - 1
    peak = F.least(n - 2, F.greatest(F.lit(1), low + first))
    y = [F.try_element_at(values, peak + i) for i in (0, 1, 2)]
    return F.when((n < 3) | (high <= low), time).otherwise((peak + parabolic(*y)) / frame_hz)


def deduped(times: Column, gap: float = 1e-4) -> Column:
    """Sorted times, each at least ``gap`` after the last one kept: a fold, as what is kept depends on what was."""
    empty = F.array().cast("array<double>")
    return F.aggregate(F.array_sort(times), empty, lambda acc, t: F.when((F.size(acc) == 0) | (t - F.try_element_at(acc, F.lit(-1)) >= gap), F.array_append(acc, t)).otherwise(acc))


def beat_gate(n: Column, bpm: Column, cv: Column, contrast: Column, cfg: Analysis = Analysis()) -> Column:
    """The first gate that a grid fails, in the analyser's order; null if it passes."""
    confidence = F.greatest(F.lit(0.0), 1 - cv / cfg.max_ibi_cv) * F.greatest(F.lit(0.0), contrast)
    return (
        F.when(n < cfg.min_beats, "TOO_FEW_BEATS")
        .when(bpm.isNull() | ~bpm.between(cfg.min_bpm, cfg.max_bpm), "TEMPO_OUT_OF_RANGE")
        .when(cv.isNull() | (cv > cfg.max_ibi_cv), "IRREGULAR_BEAT_GRID")
        .when(contrast < cfg.min_onset_contrast, "WEAK_ONSET_ALIGNMENT")
        .when(confidence < cfg.min_confidence, "LOW_CONFIDENCE")
    )


def region_score(cv: Column, onset: Column, inside: Column, cfg: Regions = Regions()) -> Column:
    return cfg.weight_tempo * F.greatest(F.lit(0.0), 1 - cv / cfg.ibi_cv_max) + cfg.weight_onset * onset + cfg.weight_in_tolerance * inside


def region_gates(cv: Column, onset: Column, inside: Column, cfg: Regions = Regions()) -> Column:
    return (cv <= cfg.ibi_cv_max) & (inside >= cfg.in_tolerance_min) & (onset >= cfg.onset_floor)


def stable_windows(beats: DataFrame, cfg: Regions = Regions()) -> DataFrame:
    """Full windows of beats at every step with their statistics; a beat lies in at most window / step of them.

    ``beats`` has onset_unit at each beat and may have energy at each beat.
    """
    n = F.max("beat_index").over(Window.partitionBy("track_id")) + 1
    last = F.floor((n - cfg.window_beats) / cfg.step_beats) * cfg.step_beats
    lowest = F.greatest(F.lit(0), F.ceil((F.col("beat_index") - cfg.window_beats + 1) / F.lit(float(cfg.step_beats))).cast("int")) * cfg.step_beats
    highest = F.least(F.floor(F.col("beat_index") / cfg.step_beats).cast("int") * cfg.step_beats, F.col("__last").cast("int"))
    rows = beats.withColumn("__last", last).where("__last >= 0")
    rows = rows.withColumn("ibi", F.col("beat_time") - F.lag("beat_time").over(_track("beat_index")))
    rows = rows.withColumn("__low", lowest).withColumn("__high", highest).where("__high >= __low")
    rows = rows.withColumn("start_beat", F.explode(F.sequence("__low", "__high", F.lit(cfg.step_beats))))
    # the interval before a window's first beat is not in it
    rows = rows.withColumn("d", F.when(F.col("beat_index") > F.col("start_beat"), F.col("ibi")))
    energy = F.avg("energy") if "energy" in beats.columns else F.lit(0.0)
    found = rows.groupBy("track_id", "start_beat").agg(
        F.min("beat_time").alias("start_time"), F.max("beat_time").alias("end_time"), F.min("d").alias("least"), F.avg("d").alias("mean"), F.stddev_samp("d").alias("dev"),
        F.median("d").alias("median"), F.collect_list("d").alias("ds"), F.avg("onset_unit").alias("mean_onset"), energy.alias("mean_energy"),
    )
    inside = F.size(F.filter("ds", lambda d: F.abs(d - F.col("median")) <= cfg.ibi_tolerance * F.col("median"))) / F.size("ds")
    found = found.where("least > 0").withColumn("ibi_cv", F.when(F.col("mean") > EPSILON, F.col("dev") / F.col("mean"))).withColumn("in_tolerance_fraction", inside)
    return found.withColumn("end_beat", F.col("start_beat") + cfg.window_beats).drop("least", "mean", "dev", "median", "ds")


def gated(windows: DataFrame, cfg: Regions = Regions()) -> DataFrame:
    args = (F.col("ibi_cv"), F.col("mean_onset"), F.col("in_tolerance_fraction"))
    return windows.where(region_gates(*args, cfg)).withColumn("score", region_score(*args, cfg))


def suppressed(regions: DataFrame, cfg: Regions = Regions()) -> DataFrame:
    """Greedy non-maximum suppression in each track: best score first (ties to the earlier), no overlap with one kept, at most ``max_regions``.

    A fold over a track's windows in order; a track has few.
    """
    rest = [c for c in regions.columns if c not in ("track_id", "score", "start_beat")]
    # the struct sorts by descending score, then start
    item = F.struct((-F.round("score", 9)).alias("k"), F.col("start_beat"), F.col("score"), *rest)
    packed = regions.groupBy("track_id").agg(F.array_sort(F.collect_list(item)).alias("a"))
    kept = F.aggregate(
        "a",
        F.slice("a", 1, 0),
        lambda acc, x: F.when((F.size(acc) < cfg.max_regions) & ~F.exists(acc, lambda k: (x["start_beat"] < k["end_beat"]) & (k["start_beat"] < x["end_beat"])), F.array_append(acc, x)).otherwise(acc),
    )
    return packed.select("track_id", F.explode(kept).alias("r")).select("track_id", "r.start_beat", "r.score", *[f"r.{c}" for c in rest])


def region_diagnosis(windows: DataFrame, cfg: Regions = Regions()) -> DataFrame:
    """Why each window is, or is not, a region: one row a window.

    Margins are what a gate leaves to spare; a negative one is the least
    change of its setting by which the window would pass that gate.  ``failed``
    names the gates that it does not pass (a statistic that is null passes
    none).  ``outcome`` is KEPT, GATED, OVERLAPPED (``blocked_by`` is the
    start of the best kept region in its way) or OVER_LIMIT (none is, but
    the track has its ``max_regions``).  A track's kept regions are a few, joined by track.
    """
    margins = {
        "tempo_margin": cfg.ibi_cv_max - F.col("ibi_cv"),
        "in_tolerance_margin": F.col("in_tolerance_fraction") - cfg.in_tolerance_min,
        "onset_margin": F.col("mean_onset") - cfg.onset_floor,
    }
    # the gates' own comparisons, so that no rounding of a margin decides
    passes = {"TEMPO": F.col("ibi_cv") <= cfg.ibi_cv_max, "IN_TOLERANCE": F.col("in_tolerance_fraction") >= cfg.in_tolerance_min, "ONSET": F.col("mean_onset") >= cfg.onset_floor}
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in passes.items()]))
    best = F.array_sort(F.collect_list(F.struct((-F.round("score", 9)).alias("k"), "start_beat", "end_beat")))
    kept = suppressed(gated(windows.select("track_id", "start_beat", "end_beat", "ibi_cv", "in_tolerance_fraction", "mean_onset"), cfg), cfg).groupBy("track_id").agg(best.alias("__kept"))
    in_the_way = F.filter("__kept", lambda k: (k["start_beat"] < F.col("end_beat")) & (F.col("start_beat") < k["end_beat"]))
    rows = windows.withColumns(margins).withColumn("failed", failed).join(kept, "track_id", "left").withColumn("__way", F.try_element_at(in_the_way, F.lit(1))["start_beat"])
    outcome = F.when(F.size("failed") > 0, "GATED").when(F.col("__way") == F.col("start_beat"), "KEPT").when(F.col("__way").isNotNull(), "OVERLAPPED").otherwise("OVER_LIMIT")
    rows = rows.withColumn("outcome", outcome)
    return rows.withColumn("blocked_by", F.when(F.col("outcome") == "OVERLAPPED", F.col("__way"))).drop("__kept", "__way")


def gate_report(diagnosis: DataFrame) -> DataFrame:
    """For each gate: windows that fail it, windows that fail it alone, and the median and largest change that would let those in."""
    change = F.when(F.col("gate") == "TEMPO", -F.col("tempo_margin")).when(F.col("gate") == "IN_TOLERANCE", -F.col("in_tolerance_margin")).otherwise(-F.col("onset_margin"))
    alone = F.size("failed") == 1
    # a change has few values beside the windows: they are counted first, and no gate's windows are one group
    each = diagnosis.select(F.explode("failed").alias("gate"), "failed", "tempo_margin", "in_tolerance_margin", "onset_margin").select("gate", alone.alias("alone"), F.round(change, 6).alias("change"))
    counted = each.groupBy("gate", "alone", "change").agg(F.count("*").alias("n"))
    return counted.groupBy("gate").agg(
        F.sum("n").alias("n_failed"), F.coalesce(F.sum(F.when(F.col("alone"), F.col("n"))), F.lit(0)).alias("n_alone"),
        F.percentile(F.when(F.col("alone"), F.col("change")), 0.5, F.col("n")).alias("median_change"), F.max(F.when(F.col("alone"), F.col("change"))).alias("largest_change"),
    )


def remapped(times: Column, ratio: Column) -> Column:
    """Places on the stretched timeline, of one time; null for a ratio that is null or not positive."""
    return F.when(ratio > 0, times / F.when(ratio > 0, ratio))


def remapped_beats(beats: DataFrame, ratios: DataFrame) -> DataFrame:
    """Beats of the tracks in ``ratios`` (track_id, stretch_ratio), their ``beat_time`` on the stretched timeline; without a usable ratio it is null and ``failure_reason`` says so."""
    ratio = F.col("stretch_ratio")
    rows = beats.join(ratios.select("track_id", "stretch_ratio"), "track_id")
    usable = F.coalesce((ratio > 0) & (ratio < float("inf")), F.lit(False))
    return rows.withColumn("beat_time", F.when(usable, remapped(F.col("beat_time"), ratio))).withColumn("failure_reason", F.when(~usable, "STRETCH_OUT_OF_BOUNDS")).drop("stretch_ratio")


def energy_at(time: Column, curve: Column, hz: float) -> Column:
    """Linear interpolation of a regular curve, held at its ends; 0 for an empty one."""
    n = F.size(curve)
    x = F.greatest(F.lit(0.0), F.least((n - 1).cast("double"), time * hz))
    i = F.floor(x).cast("int")
    a, b = F.try_element_at(curve, i + 1), F.try_element_at(curve, F.least(n, i + 2))
    return F.when(n > 0, a + (b - a) * (x - i)).otherwise(0.0)
