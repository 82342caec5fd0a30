"""Views that let the star-schema test tables play the library's own tables.

The same text runs on Spark (tables given as DataFrames) and on DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "tracks": (
        ("part",),
        """SELECT CAST(p_partkey AS BIGINT) AS track_id, p_name AS title, p_brand AS artist,
 CASE WHEN p_partkey % 20 = 0 THEN 'FAILED' WHEN p_partkey % 20 = 1 THEN 'PENDING' WHEN p_partkey % 20 = 2 THEN 'PROCESSING' ELSE 'COMPLETE' END AS analysis_status,
 CASE WHEN p_partkey % 13 = 0 THEN 3 ELSE 4 END AS analysis_version,
 CASE WHEN p_partkey % 97 = 0 THEN NULL ELSE 80e0 + p_size * 2e0 + (p_partkey % 10) / 10e0 END AS native_bpm,
 (p_retailprice - 900e0) / 100e0 AS energy_scalar,
 0.225e0 + (p_partkey % 75) / 100e0 AS analysis_confidence,
 180e0 + p_size AS duration_seconds FROM {part}""",
    ),
    "region_windows": (
        ("lineitem",),
        """SELECT CAST(l_partkey AS BIGINT) AS track_id, CAST(l_orderkey % 12 AS INT) * 28 AS start_beat, CAST(l_orderkey % 12 AS INT) * 28 + 32 AS end_beat,
 MIN(l_tax) * 0.75e0 AS ibi_cv, 1e0 - MAX(l_discount) AS in_tolerance_fraction, MAX(l_quantity) / 50e0 AS mean_onset, MIN(l_discount) * 10e0 AS mean_energy
 FROM {lineitem} GROUP BY l_partkey, l_orderkey % 12""",
    ),
    "beats": (
        ("events",),
        """SELECT user_id AS track_id, CAST(ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) AS beat_index,
 (ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) * (60e0 / (100 + user_id % 40)) + ((event_id % 7) - 3) * (CASE WHEN user_id % 5 = 0 THEN 0.02e0 ELSE 0.002e0 END) AS beat_time,
 value / 500e0 AS onset_unit FROM {events}""",
    ),
    "attempts": (
        ("orders",),
        """SELECT o_orderkey AS attempt_id, CASE o_orderkey % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' ELSE 'D' END AS strategy,
 CASE WHEN o_orderstatus = 'F' THEN 'FAILED' ELSE 'RENDERED' END AS status, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END AS failure_reason,
 CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_totalprice / 1000e0 END AS alignment_error_ms FROM {orders}""",
    ),
    "ratings": (
        ("orders",),
        """SELECT CONCAT('pair_', CAST(o_custkey % 60 AS VARCHAR(10))) AS pair_id, CONCAT('listener_', CAST(o_orderkey % 3 + 1 AS VARCHAR(10))) AS listener_id,
 CASE MIN(o_orderkey) % 5 WHEN 0 THEN 'tie' WHEN 1 THEN 'Y' WHEN 3 THEN 'Y' ELSE 'X' END AS preference FROM {orders} GROUP BY o_custkey % 60, o_orderkey % 3""",
    ),
    "stems": (
        ("part",),
        """SELECT CAST(p_partkey AS BIGINT) AS track_id, CASE p_partkey % 6 WHEN 0 THEN CONCAT(p_brand, ' - ', p_name, ' (Official Video)') WHEN 1 THEN CONCAT('03 - ', p_brand, ' - ', p_name) WHEN 2 THEN REPLACE(p_name, ' ', '_')
 WHEN 3 THEN CONCAT(p_brand, ' - ', p_name, ' (Extended Mix) [HQ]') WHEN 4 THEN CONCAT(p_brand, ' - ', p_name, ' - Topic') ELSE '---' END AS stem FROM {part}""",
    ),
    "records": (
        ("part",),
        """SELECT CAST(p_partkey AS BIGINT) AS record_id, CONCAT('{{"track_id": ', CASE p_partkey % 11 WHEN 3 THEN 'true' WHEN 5 THEN '"7"' WHEN 7 THEN '7.0' ELSE CAST(p_partkey AS VARCHAR(20)) END,
 ', "audio_path": ', CASE WHEN p_partkey % 13 = 4 THEN '17' ELSE CONCAT('"', p_name, '.wav"') END, CASE WHEN p_partkey % 19 = 6 THEN '' ELSE CONCAT(', "native_bpm": ', CAST(80 + p_size AS VARCHAR(20)), '.5') END,
 ', "energy": ', CASE p_partkey % 23 WHEN 8 THEN 'false' WHEN 9 THEN 'null' ELSE '0.25' END, ', "analysis_confidence": 1, "analysis_version": 4, "duration_seconds": 180.5, "beat_count": 3, "mood": [],',
 ' "beat_times": ', CASE p_partkey % 29 WHEN 10 THEN '[0, "x", 1e0, null]' WHEN 11 THEN '{{}}' WHEN 12 THEN '[]' ELSE '[0, 0.5, 1]' END,
 ', "stable_regions": [', CASE WHEN p_partkey % 31 = 13 THEN '' ELSE CONCAT('{{"start_beat": 0, "end_beat": ', CASE WHEN p_partkey % 37 = 14 THEN '32.5' ELSE '32' END, ', "start_time": 0, "end_time": 15.5, "score": 0.75, ', CASE WHEN p_partkey % 41 = 15 THEN '' ELSE '"ibi_cv": 0.01, ' END, '"mean_energy": 0.5}}') END, ']',
 CASE WHEN p_partkey % 43 = 16 THEN '' ELSE '}}' END) AS record FROM {part}""",
    ),
    "frames": (
        ("embeddings",),
        """SELECT vec_id, embedding FROM {embeddings}""",
    ),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tables, text = VIEWS[name]
    return spark.sql(text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables})


def cte(*names: str) -> str:
    """``WITH`` clause that names the views for DuckDB; to be followed by a comma or a query."""
    parts = []
    for n in names:
        tables, text = VIEWS[n]
        parts.append(f"fx_{n} AS ({text.format(**{t: t for t in tables})})")
    return "WITH " + ",\n".join(parts)
