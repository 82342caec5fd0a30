"""Keyed snapshots: change detection and upserts as joins that give the new snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ANALYSIS = ("native_bpm", "analysis_confidence", "analysis_version", "energy")
#: Columns that a failure keeps from the row before.
SOURCE = ("content_hash", "duration_seconds", "native_sample_rate", "channels", "codec_name", "bit_rate")


def changes(files: DataFrame, tracks: DataFrame, recheck: bool = False) -> DataFrame:
    """outcome of each scanned file (audio_path, content_hash, failure_reason): UNCHANGED, FAILED, ADDED or UPDATED.

    Same bytes and no failure on record mean unchanged, unless a recheck is asked for.
    """
    old = tracks.select("audio_path", F.col("content_hash").alias("__hash"), F.col("failure_reason").alias("__failure"), F.lit(True).alias("__there"))
    same = F.col("__there") & (F.col("content_hash") == F.col("__hash")) & F.col("__failure").isNull() & F.lit(not recheck)
    outcome = F.when(same, "UNCHANGED").when(F.col("failure_reason").isNotNull(), "FAILED").when(F.col("__there"), "UPDATED").otherwise("ADDED")
    return files.join(old, "audio_path", "left").withColumn("outcome", outcome).drop("__hash", "__failure", "__there")


def run_report(outcomes: DataFrame) -> DataFrame:
    kinds = ("ADDED", "UPDATED", "UNCHANGED", "FAILED")
    return outcomes.agg(F.count("*").alias("scanned"), *[F.count_if(F.col("outcome") == k).alias(k.lower()) for k in kinds])


def upsert(old: DataFrame, new: DataFrame, key: str, merge: dict[str, Column] | None = None) -> DataFrame:
    """Snapshot in which the rows of ``new`` replace those of ``old`` by key; ``merge`` gives columns from o.* and n.* for keys in both."""
    names = old.columns
    o, n = old.alias("o").withColumn("__o", F.lit(True)), new.alias("n").withColumn("__n", F.lit(True))
    joined = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full")
    there, here = F.col("__n").isNotNull(), F.col("__o").isNotNull()

    def column(c: str) -> Column:
        given = F.col(f"n.{c}") if c in new.columns else F.lit(None).cast(old.schema[c].dataType)
        both = merge[c] if merge and c in merge else given if c in new.columns else F.col(f"o.{c}")
        return F.when(there & here, both).when(there, given).otherwise(F.col(f"o.{c}")).alias(c)

    return joined.select(*[column(c) for c in names])


def save_sources(tracks: DataFrame, sources: DataFrame) -> DataFrame:
    """Sources go back to PENDING and lose their analysis."""
    fresh = sources.withColumns({"analysis_status": F.lit("PENDING"), "failure_reason": F.lit(None).cast("string"), **{c: F.lit(None).cast(tracks.schema[c].dataType) for c in ANALYSIS if c in tracks.columns}})
    return upsert(tracks, fresh, "audio_path")


def save_failures(tracks: DataFrame, failures: DataFrame) -> DataFrame:
    """FAILED rows; what is known of the source stays, so does the hash if none is given."""
    failed = failures.withColumns({"analysis_status": F.lit("FAILED"), **{c: F.lit(None).cast(tracks.schema[c].dataType) for c in ANALYSIS if c in tracks.columns}})
    keep = {c: F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")) if c in failures.columns else F.col(f"o.{c}") for c in SOURCE if c in tracks.columns}
    return upsert(tracks, failed, "audio_path", keep)


def save_analysis(tracks: DataFrame, analysis: DataFrame, version: int = 4) -> DataFrame:
    """COMPLETE, features rounded to 6 digits, energy at its raw scalar until the library is rescaled."""
    done = analysis.select("audio_path", F.bround("native_bpm", 6).alias("native_bpm"), F.bround("analysis_confidence", 6).alias("analysis_confidence"), F.bround("energy_scalar", 6).alias("energy"), F.lit(version).alias("analysis_version"), F.lit("COMPLETE").alias("analysis_status"), F.lit(None).cast("string").alias("failure_reason"))
    return upsert(tracks, done, "audio_path")


def mark_processing(tracks: DataFrame, ids: DataFrame) -> DataFrame:
    return upsert(tracks, ids.select("audio_path", F.lit("PROCESSING").alias("analysis_status")), "audio_path")


def analysis_of_failed(analysis: DataFrame, failures: DataFrame) -> DataFrame:
    """The analysis table without rows of failed tracks."""
    return analysis.join(failures.select("track_id").distinct(), "track_id", "left_anti")
