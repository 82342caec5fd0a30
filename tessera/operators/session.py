"""Greedy sessions: a bounded loop of set-based steps, all seeds at once; playback lookup."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.config import Settings
from tessera.functions import frames as A
from tessera.operators import nearest
from tessera.operators.select import in_window, select_next
from tessera.sources.scratch import checkpointed


def _beat_sample(start: Column, end: Column, bpm: Column, seconds: Column, ratio: Column, rate: int, downbeat: bool) -> Column:
    """Sample of a region's alignment beat on the session's timeline; the grid is regular at the track's tempo."""
    count = F.floor(seconds * bpm / 60).cast("int") + 1
    return A.samples(A.align_beat(start, end, count, downbeat) * 60 / bpm / ratio, rate)


def chain(library: DataFrame, regions: DataFrame, tracks: DataFrame, cfg: Settings = Settings(), length: int | None = None, seeds: DataFrame | None = None) -> DataFrame:
    """seed_id, step, track_id, start_seconds, end_seconds, status of every seed's session, and the samples that a mix needs.

    Each step selects the next track for all sessions with one query: regions
    must start after the last fade and leave room for the next, played tracks
    are out.  A session that finds no next track is PARTIAL (FAILED if it never
    found one).  State is written between steps, so a step is redone alone.
    """
    length = cfg.session.default_length if length is None else length
    if not 2 <= length <= cfg.session.max_length:
        raise ValueError(f"length must be between 2 and {cfg.session.max_length}")
    rate, downbeat = cfg.render.sample_rate, cfg.transition.align_on_downbeat
    facts = library.select("track_id", "native_bpm", "energy", "duration_seconds")
    start = facts if seeds is None else facts.join(seeds.select("track_id").distinct(), "track_id", "left_semi")
    frames = lambda ratio: A.samples(F.col("duration_seconds") / ratio, rate)
    zero = F.lit(0).cast("long")
    state = checkpointed(start.select(
        F.col("track_id").alias("seed_id"), F.lit(1).alias("step"), "track_id", F.col("native_bpm").alias("session_bpm"), "native_bpm", "energy", "duration_seconds",
        zero.alias("offset"), zero.alias("earliest"), frames(F.lit(1.0)).alias("mixed"), zero.alias("start_sample"), F.lit(None).cast("long").alias("exit_end"),
    ))
    steps = [state]
    rules = replace(cfg, retrieval=replace(cfg.retrieval, require_region=True, allow_repeats=False))
    outgoing_regions = in_window(regions, library, cfg.transition.outgoing)
    # the candidates are the same at every step
    pool = library.join(regions.select("track_id").distinct(), "track_id", "left_semi")
    grids = nearest.prepared(pool, in_window(regions, library, cfg.transition.incoming).select("track_id").distinct(), length + 2, cfg.ranking, cfg.tempo)
    played = state.select("seed_id", "track_id")
    for step in range(2, length + 1):
        ratio = F.col("session_bpm") / F.col("native_bpm")
        fade = F.rint(cfg.transition.crossfade_beats * 60 / F.col("session_bpm") * rate).cast("long")
        at = F.col("offset") + _beat_sample(F.col("start_beat"), F.col("end_beat"), F.col("native_bpm"), F.col("duration_seconds"), ratio, rate, downbeat)
        now = state.withColumn("fade", fade)
        # the outgoing regions of a session, keyed by its seed
        free = now.join(outgoing_regions.drop("duration_seconds"), "track_id").withColumn("exit", at).where((F.col("exit") >= F.col("earliest")) & (F.col("exit") + F.col("fade") <= F.col("mixed")))
        outgoing = free.select(F.col("seed_id").alias("track_id"), "start_beat", "end_beat", "score", "mean_energy", "deviation")
        asking = now.select("seed_id", "session_bpm", F.col("energy").alias("seed_energy"))
        plan = select_next(asking, library, regions, rules, played, outgoing, ranks=False, grids=grids).select("seed_id", F.col("track_id").alias("next_id"), "out_start_beat", "out_end_beat", "in_start_beat", "in_end_beat")
        nxt = facts.select(F.col("track_id").alias("next_id"), F.col("native_bpm").alias("next_bpm"), F.col("energy").alias("next_energy"), F.col("duration_seconds").alias("next_seconds"))
        found = now.join(plan, "seed_id").join(nxt, "next_id")
        next_ratio = F.col("session_bpm") / F.col("next_bpm")
        exit_ = F.col("offset") + _beat_sample(F.col("out_start_beat"), F.col("out_end_beat"), F.col("native_bpm"), F.col("duration_seconds"), ratio, rate, downbeat)
        entry = _beat_sample(F.col("in_start_beat"), F.col("in_end_beat"), F.col("next_bpm"), F.col("next_seconds"), next_ratio, rate, downbeat)
        found = found.withColumns({"exit": exit_, "entry": entry, "next_frames": A.samples(F.col("next_seconds") / next_ratio, rate)}).where(F.col("entry") + F.col("fade") <= F.col("next_frames"))
        state = checkpointed(found.select(
            "seed_id", F.lit(step).alias("step"), F.col("next_id").alias("track_id"), "session_bpm", F.col("next_bpm").alias("native_bpm"), F.col("next_energy").alias("energy"), F.col("next_seconds").alias("duration_seconds"),
            (F.col("exit") - F.col("entry")).alias("offset"), (F.col("exit") + F.col("fade")).alias("earliest"), (F.col("exit") - F.col("entry") + F.col("next_frames")).alias("mixed"),
            F.col("exit").alias("start_sample"), (F.col("exit") + F.col("fade")).alias("exit_end"),
        ))
        steps.append(state)
        played = played.unionByName(state.select("seed_id", "track_id"))
    rows = steps[0]
    for s in steps[1:]:
        rows = rows.unionByName(s)
    ends = rows.select("seed_id", (F.col("step") - 1).alias("step"), F.col("exit_end").alias("__end")).where("step > 0")
    reached = rows.groupBy("seed_id").agg(F.max("step").alias("__steps"))
    out = rows.join(ends, ["seed_id", "step"], "left").join(reached, "seed_id")
    status = F.when(F.col("__steps") == 1, "FAILED").when(F.col("__steps") < length, "PARTIAL").otherwise("READY")
    stop, length_of_fade = F.coalesce("__end", "mixed"), F.rint(cfg.transition.crossfade_beats * 60 / F.col("session_bpm") * rate).cast("long")
    seconds = [(F.col("start_sample") / rate).alias("start_seconds"), (stop / rate).alias("end_seconds"), status.alias("status")]
    return out.select("seed_id", "step", "track_id", *seconds, "offset", "start_sample", stop.alias("stop_sample"), length_of_fade.alias("fade_frames"), F.col("__end").isNotNull().alias("fades_out"))


def playing(spans: DataFrame, asked: DataFrame, key: str, moment: str) -> DataFrame:
    """For each asked time t the first span that ends after it, else the last one.

    An as-of lookup without pairs: spans and times are one ordered sequence of
    events, and the answer is the next span in it.
    """
    from pyspark.sql import Window

    s = spans.select(key, F.lit(None).cast(asked.schema[moment].dataType).alias(moment), F.col("end_seconds").alias("at"), F.lit(1).alias("kind"), "span")
    a = asked.select(key, moment, F.col("t").alias("at"), F.lit(2).alias("kind"), F.lit(None).cast(spans.schema["span"].dataType).alias("span"))
    # a span that ends at t has ended: it stands before the question
    order = Window.partitionBy(key).orderBy("at", "kind", "span")
    after = F.first("span", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
    before = F.last("span", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return s.unionByName(a).withColumn("found", F.coalesce(after, before)).where("kind = 2").select(key, moment, F.col("found").alias("span"))


def clock(seconds: Column) -> Column:
    """m:ss, a dash for what is no time."""
    whole = F.floor(F.greatest(F.lit(0.0), seconds)).cast("long")
    text = F.concat(F.floor(whole / 60).cast("string"), F.lit(":"), F.lpad((whole % 60).cast("string"), 2, "0"))
    return F.when(seconds.isNull() | F.isnan(seconds) | (F.abs(seconds) == float("inf")), "—").otherwise(text)
