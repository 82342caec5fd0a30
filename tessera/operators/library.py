"""The track library: current candidates, analysis queue, rescaled energy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.quantiles import group_quantiles

EPSILON = 1e-12


def candidates(tracks: DataFrame, version: int = 4, analysis: DataFrame | None = None) -> DataFrame:
    """COMPLETE tracks of the current version that have all features; joined with their analysis if it is a table of its own."""
    current = tracks.where((F.col("analysis_status") == "COMPLETE") & (F.col("analysis_version") == version))
    if analysis is not None:
        current = current.join(analysis, "track_id")
    needed = [c for c in ("native_bpm", "energy_scalar", "energy", "analysis_confidence", "duration_seconds") if c in current.columns]
    return current.dropna(subset=needed)


def analysis_queue(tracks: DataFrame, version: int = 4, reanalyze: bool = False, audio_path: str | None = None, limit: int | None = None, order: str = "audio_path") -> DataFrame:
    """What to analyse: PENDING, PROCESSING (a crashed run's) and stale COMPLETE rows; all rows if asked; one path, whatever its status."""
    stale = (F.col("analysis_status") == "COMPLETE") & ~F.col("analysis_version").eqNullSafe(F.lit(version))
    due = F.lit(True) if reanalyze else F.col("analysis_status").isin("PENDING", "PROCESSING") | stale
    found = tracks.where(F.col("audio_path") == audio_path) if audio_path is not None else tracks.where(due)
    found = found.orderBy(order)
    return found if limit is None else found.limit(limit)


def list_tracks(tracks: DataFrame, statuses: list[str] | None = None, limit: int | None = None, order: str = "audio_path") -> DataFrame:
    found = (tracks.where(F.col("analysis_status").isin(statuses)) if statuses else tracks).orderBy(order)
    return found if limit is None else found.limit(limit)


def by_ids(tracks: DataFrame, ids: list[int]) -> DataFrame:
    """The rows of the ids; an error if one is missing."""
    found = tracks.where(F.col("track_id").isin(ids))
    missing = set(ids) - {r["track_id"] for r in found.select("track_id").distinct().collect()}
    if missing:
        raise ValueError(f"no such tracks: {sorted(missing)}")
    return found


def look_up(table: DataFrame, wanted: DataFrame, key: str = "track_id") -> tuple[DataFrame, DataFrame]:
    """Rows of ``table`` (tracks, their analysis) whose ``key`` (track_id, audio_path, content_hash) is in ``wanted``, and the wanted keys without a row.

    Null keys are found nowhere and are missing; a key that is wanted twice is found, or missing, once.
    """
    keys = wanted.select(key).distinct()
    return table.join(keys, key, "left_semi"), keys.join(table.select(key), key, "left_anti")


def required(found: tuple[DataFrame, DataFrame]) -> DataFrame:
    """The rows of a look-up; an error that shows some of what is missing."""
    rows, missing = found
    if shown := [r[0] for r in missing.limit(20).collect()]:
        raise ValueError(f"not found: {missing.columns[0]} {shown}")
    return rows


def labelled(rows: DataFrame, tracks: DataFrame, key: str = "track_id") -> DataFrame:
    """``rows`` with title and artist of the track that ``key`` names, null where it names none."""
    return rows.join(tracks.select(F.col("track_id").alias(key), "title", "artist"), key, "left")


def status_counts(tracks: DataFrame) -> DataFrame:
    return tracks.groupBy("analysis_status").agg(F.count("*").alias("n"))


def scaled(value: Column, low: Column, high: Column, flat: Column) -> Column:
    """Clipped linear map of [low, high] to [0, 1]; ``flat`` where the span is nothing."""
    span = high - low
    return F.when(span <= EPSILON, flat).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (value - low) / F.when(span > EPSILON, span))))


def rescaled_energy(current: DataFrame, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """``energy``: the scalar on the library's percentile scale, raw where the library is flat.  The two bounds are one row, broadcast."""
    bounds = group_quantiles(current, [], "energy_scalar", [low, high]).select(F.col("q")[0].alias("__low"), F.col("q")[1].alias("__high"))
    out = current.join(F.broadcast(bounds), how="left")
    scale = scaled(F.col("energy_scalar"), F.col("__low"), F.col("__high"), F.col("energy_scalar"))
    return out.withColumn("energy", scale).drop("__low", "__high")
