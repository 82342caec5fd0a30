"""Continuous ingest: an extension of the batch rescan, with the same change detection for each micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.operators import catalog

SCANNED = "audio_path string, content_hash string, duration_seconds double, failure_reason string"


def scanned_files(spark: SparkSession, folder: str) -> DataFrame:
    """Stream of scan results that land as JSON lines."""
    return spark.readStream.schema(SCANNED).json(folder)


def apply_scan(scan: DataFrame, tracks: DataFrame) -> DataFrame:
    """Next snapshot of the tracks after one batch of scanned files; of a path scanned twice in it the last in hash order counts."""
    files = scan.dropDuplicates(["audio_path"])
    seen = catalog.changes(files, tracks)
    good = seen.where("outcome in ('ADDED', 'UPDATED')").select("audio_path", "content_hash", "duration_seconds")
    bad = seen.where("outcome = 'FAILED'").select("audio_path", "content_hash", "failure_reason")
    return catalog.save_failures(catalog.save_sources(tracks, good), bad)


def run(scans: DataFrame, load: Callable[[], DataFrame], save: Callable[[DataFrame, int], None], checkpoint: str):
    """Starts the query: each micro-batch loads the latest snapshot and saves the next under its batch number, so a repeated batch writes the same."""

    def each(batch: DataFrame, number: int) -> None:
        save(apply_scan(batch, load()), number)

    return scans.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
