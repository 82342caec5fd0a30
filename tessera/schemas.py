"""Tables of the library.  A version is a list of columns; older tables are read with the later columns null."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql import functions as F


def _struct(text: str) -> T.StructType:
    return T._parse_datatype_string(text)


TRACKS = "track_id bigint, audio_path string, content_hash string, title string, artist string, metadata_source string, duration_seconds double, native_sample_rate int, channels int, codec_name string, bit_rate bigint, analysis_status string, failure_reason string"
TRACKS_ANALYSED = TRACKS + ", native_bpm double, analysis_confidence double, analysis_version int, energy double"
REGION = "struct<start_beat:int,end_beat:int,start_time:double,end_time:double,score:double,ibi_cv:double,in_tolerance_fraction:double,mean_onset:double,mean_energy:double>"
ANALYSIS = f"track_id bigint, beat_times array<double>, ibi_cv double, onset_contrast double, tempo_octave_factor double, energy_curve array<double>, energy_scalar double, stable_regions array<{REGION}>"
TRANSITIONS = "transition_id string, track_a_id bigint, track_b_id bigint, session_bpm double, stretch_ratio double, out_start_beat int, out_end_beat int, in_start_beat int, in_end_beat int, pair_cost double, stability_cost double, energy_cost double, stretch_cost double, position_cost double, wav_path string, peak_dbfs double, peak_exceeded boolean, clipped boolean, status string, failure_reason string, config_snapshot string"
TRANSITIONS_MEASURED = TRANSITIONS + ", strategy string, bpm_delta double, stretch_percent_a double, stretch_percent_b double, alignment_error_ms double, alignment_correlation double, energy_discontinuity_db double, region_stability_a double, region_stability_b double, planning_seconds double, render_seconds double, measurement_seconds double"
SESSIONS = "session_id string, status string, payload string, config_snapshot string"
#: Each table's versions, oldest first.
VERSIONS = {"tracks": (TRACKS, TRACKS_ANALYSED), "analysis": (ANALYSIS,), "transitions": (TRANSITIONS, TRANSITIONS_MEASURED), "sessions": (SESSIONS,)}
STATUSES = {"analysis": ("PENDING", "PROCESSING", "COMPLETE", "FAILED"), "transition": ("RENDERED", "FAILED"), "source": ("tags", "filename", "mixed")}


def schema(table: str, version: int = -1) -> T.StructType:
    return _struct(VERSIONS[table][version])


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], schema(table))


def upgraded(df: DataFrame, table: str) -> DataFrame:
    """Rows of any version in the columns of the latest; what they lack is null.  An unknown column is an error."""
    latest = schema(table)
    if unknown := set(df.columns) - set(latest.names):
        raise ValueError(f"{table} has no columns {sorted(unknown)}")
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in latest])


def downgraded(df: DataFrame, table: str, version: int) -> DataFrame:
    return df.select(*schema(table, version).names)
