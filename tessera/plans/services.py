"""What the library does as a whole: scan, analyse, compare strategies, rate."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.config import Ingestion, Retrieval, Settings
from tessera.functions import naming
from tessera.operators import catalog, evaluation, library, select
from tessera.plans import analysis
from tessera.sources import audio

# --- scan -------------------------------------------------------------------


def stem(path: str = "audio_path"):
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def named(probed: DataFrame) -> DataFrame:
    """Titles and artists: from tags first; a failed file's from its name."""
    tags = F.when(F.col("failure_reason").isNull(), F.col("tags"))
    return probed.withColumn("__n", naming.resolve(tags, stem())).select("*", F.col("__n.title").alias("title"), F.col("__n.artist").alias("artist"), F.col("__n.source").alias("metadata_source")).drop("__n")


def preview(files: DataFrame, rules: Ingestion = Ingestion(), read_paths: bool = False) -> DataFrame:
    """How each file would be named, and its failure if it has one; nothing is stored."""
    return named(audio.probe_files(files, rules, read_paths)).select("audio_path", "title", "artist", "metadata_source", "duration_seconds", "failure_reason")


def scan(files: DataFrame, tracks: DataFrame, rules: Ingestion = Ingestion(), recheck: bool = False, read_paths: bool = False) -> tuple[DataFrame, DataFrame]:
    """(next snapshot, outcome of each file).  The snapshot's ids are hashes of the path, which is a track's identity.

    Files are hashed first; only those whose bytes are new, that failed before
    or that a recheck asks for are probed.
    """
    found = audio.hashed(files, read_paths)
    known = tracks.where("failure_reason is null").select("audio_path", "content_hash")
    due = found if recheck else found.join(known, ["audio_path", "content_hash"], "left_anti")
    same = found.join(due.select("audio_path"), "audio_path", "left_anti").select("audio_path", "content_hash", F.lit("UNCHANGED").alias("outcome"))
    seen = catalog.changes(named(audio.probe_files(due, rules, read_paths)), tracks, recheck).unionByName(same, allowMissingColumns=True)
    columns = ["audio_path", "content_hash", "title", "artist", "metadata_source"]
    facts = ["duration_seconds", "native_sample_rate", "channels", "codec_name", "bit_rate"]
    ident = F.xxhash64("audio_path").alias("track_id")
    good = seen.where("outcome in ('ADDED', 'UPDATED')").select(ident, *columns, *facts)
    bad = seen.where("outcome = 'FAILED'").select(ident, *columns, "failure_reason")
    return catalog.save_failures(catalog.save_sources(tracks, good), bad), seen.select("audio_path", "outcome", "failure_reason")


# --- analysis ---------------------------------------------------------------


def analyze_library(tracks: DataFrame, pcm: DataFrame, settings: Settings = Settings(), reanalyze: bool = False) -> tuple[DataFrame, DataFrame]:
    """(next snapshot with the library's energy rescaled, stable regions of what was analysed).

    pcm: audio_path and mono samples at the analysis rate.  Failures become
    FAILED rows; energy is on the scale of all current tracks, old ones too.
    """
    due = library.analysis_queue(tracks, settings.analysis.version, reanalyze)
    found, regions = analysis.analyze(due.select("track_id", "audio_path").join(pcm, "audio_path"), settings)
    found = found.join(tracks.select("track_id", "audio_path"), "track_id")
    after = catalog.save_analysis(tracks, found.where("failure_reason is null"), settings.analysis.version)
    after = catalog.save_failures(after, found.where("failure_reason is not null").select("audio_path", "failure_reason"))
    # the stored energy is the raw scalar of new rows and must be kept raw for old ones, so it is scaled in the result only
    current = after.where((F.col("analysis_status") == "COMPLETE") & (F.col("analysis_version") == settings.analysis.version) & F.col("energy").isNotNull())
    scaled = library.rescaled_energy(current.select("track_id", F.col("energy").alias("energy_scalar")), settings.energy.low, settings.energy.high).select("track_id", F.col("energy").alias("energy_unit"))
    return after.join(scaled, "track_id", "left"), regions


# --- comparison -------------------------------------------------------------


def attempts(tracks: DataFrame, regions: DataFrame, settings: Settings = Settings(), seed: int | None = None) -> DataFrame:
    """The ladder as attempt rows: tempo difference, stretch in percent, scores of the regions; FAILED with NO_PLAN where nothing fits."""
    seed = settings.evaluation.seed if seed is None else seed
    rows = select.strategy_ladder(tracks, regions, settings, seed)
    bpm = lambda key, name: tracks.select(F.col("track_id").alias(key), F.col("native_bpm").alias(name))
    rows = rows.join(bpm("seed_id", "bpm_a"), "seed_id").join(bpm("track_id", "bpm_b"), "track_id", "left")
    status = F.when(F.col("failure_reason").isNull(), "PLANNED").otherwise("FAILED")
    return rows.withColumns({"status": status, "bpm_delta": F.abs(F.col("bpm_a") - F.col("bpm_b")), "stretch_percent_a": F.when(F.col("track_id").isNotNull(), 0.0), "stretch_percent_b": 100 * (F.col("stretch_ratio") - 1)})


def paired_attempts(tracks: DataFrame, regions: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """B and D for the same seeded pairs: the full model plans the pair or fails, the simple one always has its edges."""
    e = settings.evaluation
    pairs = select.compatible_pairs(tracks, settings.tempo, e.seed, e.pair_count)
    facts = tracks.select(F.col("track_id").alias("track_a_id"), F.col("native_bpm").alias("session_bpm"), F.col("energy").alias("seed_energy"))
    both = pairs.join(facts, "track_a_id").select(F.col("track_a_id").alias("seed_id"), F.col("track_b_id").alias("track_id"), "session_bpm", "seed_energy", "stretch_ratio")
    simple = select.edge_choice(both, tracks, settings.transition).select("seed_id", "track_id", F.lit("B").alias("strategy"), "out_seconds", "in_seconds", F.lit(None).cast("double").alias("pair_cost"))
    w = settings.transition
    planned = select.best_pair(select.region_pairs(both, select.in_window(regions, tracks, w.outgoing), select.in_window(regions, tracks, w.incoming), w, settings.tempo), "seed_id", "track_id")
    full = both.select("seed_id", "track_id").join(planned.select("seed_id", "track_id", "pair_cost"), ["seed_id", "track_id"], "left")
    none = F.lit(None).cast("double")
    full = full.select("seed_id", "track_id", F.lit("D").alias("strategy"), none.alias("out_seconds"), none.alias("in_seconds"), "pair_cost")
    failed = (F.col("strategy") == "D") & F.col("pair_cost").isNull()
    return simple.unionByName(full).withColumns({"status": F.when(failed, "FAILED").otherwise("PLANNED"), "failure_reason": F.when(failed, "NO_PLAN")})


# --- files of an evaluation -------------------------------------------------


def write_json(path: str, data) -> None:
    """Strict JSON (no NaN)."""
    audio.write_file(path, (json.dumps(data, indent=2, allow_nan=False) + "\n").encode())


def write_rating_sheet(codebook: DataFrame, folder: str, listeners: int = 3) -> None:
    sheet = evaluation.rating_rows(codebook, listeners)
    sheet.repartition(1).sortWithinPartitions("listener_id", "pair_id").write.mode("overwrite").option("header", True).csv(folder)


RATINGS = "listener_id string, pair_id string, smoothness_X int, smoothness_Y int, rhythm_X int, rhythm_Y int, energy_X int, energy_Y int, preference string"


def read_ratings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RATINGS).option("header", True).option("mode", "FAILFAST").csv(path)


def read_codebook(spark: SparkSession, path: str) -> DataFrame:
    """{pair_id: {"X": model, "Y": model, ...}} as rows."""
    text = spark.read.text(path, wholetext=True)
    entries = F.explode(F.map_entries(F.from_json("value", "map<string,struct<X:string,Y:string>>"))).alias("e")
    return text.select(entries).select(F.col("e.key").alias("pair_id"), F.col("e.value.X").alias("x"), F.col("e.value.Y").alias("y"))


def analyze_ratings(ratings: DataFrame, codebook: DataFrame, minimum: int = 3) -> tuple[DataFrame, DataFrame]:
    """(preference report, rating deltas); an error if a row is no vote."""
    bad = evaluation.invalid_ratings(ratings, codebook).select("reason").limit(1).collect()
    if bad:
        raise ValueError(f"ratings: {bad[0]['reason']}")
    return evaluation.preference_report(evaluation.pair_votes(ratings, codebook, minimum)), evaluation.rating_deltas(ratings, codebook)


def implementation_hash(root: str) -> str:
    """One digest of all Python files under a folder, by sorted relative path."""
    base, digest = Path(root), hashlib.sha256()
    for p in sorted(base.rglob("*.py")):
        digest.update(p.relative_to(base).as_posix().encode() + b"\0" + p.read_bytes())
    return digest.hexdigest()


def open_retrieval() -> Retrieval:
    """Rules of the simpler models: neither energy gate nor region."""
    return Retrieval(energy_filter=False, require_region=False)
