"""The library's services end to end on small files and grids."""

import json
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import schemas
from tessera.config import Settings, load
from tessera.functions import frames as A
from tessera.plans import experiments, services
from tessera.sources import audio


def test_schema_versions(spark):
    old = spark.createDataFrame([(1, "a")], "track_id long, audio_path string")
    new = schemas.upgraded(old, "tracks")
    assert new.columns == schemas.schema("tracks").names and new.first().native_bpm is None
    assert schemas.downgraded(new, "tracks", 0).columns == schemas.schema("tracks", 0).names
    with pytest.raises(ValueError):
        schemas.upgraded(old.withColumn("mood", F.lit(1)), "tracks")


def test_scan_rescan_and_analysis(spark, tmp_path, monkeypatch):
    lib = tmp_path / "lib"
    lib.mkdir()
    for name, bpm in (("A - One.wav", 120), ("B - Two (Official Video).wav", 124)):
        y, _ = experiments.click_track(bpm, 20)
        (lib / name).write_bytes(audio.wav_bytes(y[:, None], 22050))
    (lib / "empty.wav").touch()
    rules = load(environ={}, ingestion={"min_duration_seconds": 5, "validation_seconds": 2}).ingestion
    files = audio.discover(spark, str(lib))
    shown = {r.audio_path: (r.title, r.artist, r.failure_reason) for r in services.preview(files, rules, True).collect()}
    assert shown["B - Two (Official Video).wav"] == ("Two", "B", None) and shown["empty.wav"][2] == "EMPTY_FILE"
    tracks, seen = services.scan(files, schemas.empty(spark, "tracks"), rules, read_paths=True)
    tracks = spark.createDataFrame(tracks.collect(), tracks.schema)
    assert sorted(r.outcome for r in seen.collect()) == ["ADDED", "ADDED", "FAILED"]
    asked, real = [], audio.probe_files
    monkeypatch.setattr(audio, "probe_files", lambda due, *how: asked.append(sorted(r.audio_path for r in due.collect())) or real(due, *how))
    again, seen = services.scan(files, tracks, rules, read_paths=True)
    assert asked == [["empty.wav"]]  # what failed is tried again, what is unchanged is only hashed
    services.scan(files, tracks, rules, recheck=True, read_paths=True)
    assert len(asked[1]) == 3
    assert sorted(r.outcome for r in seen.collect()) == ["FAILED", "UNCHANGED", "UNCHANGED"] and again.count() == 3
    pcm = spark.createDataFrame([(n, audio.decode((lib / n).read_bytes(), 22050)[:, 0].tolist()) for n in ("A - One.wav", "B - Two (Official Video).wav")], "audio_path string, samples array<float>")
    settings = load(environ={}, regions={"onset_floor": 0.05})
    after, regions = services.analyze_library(tracks, pcm, settings)
    rows = {r.title: r for r in after.collect()}
    assert rows["One"].analysis_status == "COMPLETE" and rows["One"].native_bpm == pytest.approx(120, abs=1) and rows["One"].energy_unit is not None
    assert rows["empty"].analysis_status == "FAILED" and regions.count() >= 1


def test_comparison_rows(spark):
    t = spark.createDataFrame([(i, 120.0 + i, 0.1 * i, 0.8, 200.0) for i in range(1, 6)] + [(9, 60.0, 0.5, 0.8, 200.0)], "track_id long, native_bpm double, energy double, analysis_confidence double, duration_seconds double")
    r = spark.createDataFrame([x for i in range(1, 5) for x in ((i, 8, 40, 10.0, 20.0, 0.9, 0.5), (i, 320, 352, 150.0, 160.0, 0.9, 0.5))], "track_id long, start_beat int, end_beat int, start_time double, end_time double, score double, mean_energy double")
    rows = services.attempts(t, r).collect()
    assert len(rows) == 24 and all((x.status == "FAILED") == (x.failure_reason == "NO_PLAN") for x in rows)
    assert {x.seed_id for x in rows if x.status == "FAILED"} >= {9} and all(x.stretch_percent_b is not None for x in rows if x.status == "PLANNED")
    paired = services.paired_attempts(t, r).collect()
    by = {}
    for x in paired:
        by.setdefault((x.seed_id, x.track_id), {})[x.strategy] = x.status
    assert by and all(set(v) == {"B", "D"} and v["B"] == "PLANNED" for v in by.values()) and any(v["D"] == "FAILED" for v in by.values()) and any(v["D"] == "PLANNED" for v in by.values())


def test_rating_files(spark, tmp_path):
    book = spark.createDataFrame([("pair_001", "B", "D", None)], "pair_id string, x string, y string, failure_reason string")
    services.write_rating_sheet(book, str(tmp_path / "sheet"))
    assert services.read_ratings(spark, str(tmp_path / "sheet")).count() == 3
    services.write_json(str(tmp_path / "key.json"), {"pair_001": {"X": "B", "Y": "D", "pre_seconds": 1.0}})
    with pytest.raises(ValueError):
        services.write_json(str(tmp_path / "bad.json"), {"x": float("nan")})
    assert json.loads((tmp_path / "key.json").read_text())["pair_001"]["Y"] == "D"
    key = services.read_codebook(spark, str(tmp_path / "key.json"))
    (tmp_path / "r.csv").write_text(services.RATINGS.replace(" string", "").replace(" int", "").replace(" ", "") + "\n" + "".join(f"l{i},pair_001,1,2,3,3,4,5,Y\n" for i in range(3)))
    report, deltas = services.analyze_ratings(services.read_ratings(spark, str(tmp_path / "r.csv")), key)
    assert report.first().d_wins == 1 and {r.metric: r.p50 for r in deltas.collect()}["smoothness_D_minus_B"] == 1.0
    with pytest.raises(ValueError):
        services.analyze_ratings(services.read_ratings(spark, str(tmp_path / "sheet")), key)


def test_alignment_of_shifted_impulses(spark):
    def pulses(shift):
        x = np.zeros(2000)
        x[np.arange(200, 1900, 250) + shift] = 1.0
        return F.array(*[F.lit(float(v)) for v in x])

    for shift in (0, 25, -40):
        r = spark.range(1).select(A.alignment(pulses(0), pulses(shift), 5, 20, 1000).alias("m")).first().m
        assert r.reason is None and abs(r.error_ms - abs(shift)) <= 5
    quiet = F.array(*[F.lit(0.0)] * 500)
    assert spark.range(1).select(A.alignment(quiet, quiet, 5, 20, 1000).alias("m")).first().m.reason == "SILENT_OR_CONSTANT_OVERLAP"
    assert spark.range(1).select(A.alignment(F.slice(quiet, 1, 9), quiet, 5, 20, 1000).alias("m")).first().m.reason == "INSUFFICIENT_ONSETS"


def test_experiments(spark):
    gates = {r.jitter: (r.regions, r.score) for r in experiments.region_gates(spark).collect()}
    assert gates[0.0] == (1, pytest.approx(1.0)) and gates[0.02][0] == 1 and gates[0.08][0] == 0
    assert all(r.regions == 0 for r in experiments.region_gates(spark, onset=0.05).collect())
    found = spark.createDataFrame([(1, 0.9), (1, 2.2), (1, 9.0), (2, 1.0)], "track_id long, beat_time double")
    truth = spark.createDataFrame([(1, 1.0), (1, 2.0), (1, 3.0), (2, 1.0)], "track_id long, beat_time double")
    assert sorted(round(r.error, 6) for r in experiments.nearest_errors(found, truth).collect()) == [0.0, 0.1, 0.2, 6.0]
    settings = replace(Settings(), regions=load(environ={}, regions={"onset_floor": 0.05}).regions)
    r = experiments.sample_rates(spark, (120, 124), (22050,), settings).first()
    assert r.tracks == 2 and r.mean_bpm_error < 0.5 and r.mean_abs_error < 0.025
    scalars = {x.aggregation: x.loud_ends - x.plain for x in experiments.aggregations(spark).collect()}
    assert abs(scalars["median"]) <= abs(scalars["p90"]) + 1e-9
    assert len(services.implementation_hash("tessera")) == 64


def test_diagnostics(spark):
    y = experiments.with_clicks(np.zeros(8000), [0.1, 0.5, 9.0], 8000)
    assert len(y) == 8000 and np.abs(y[800:960]).max() > 0.1 and not y[:800].any() and np.abs(y).max() <= 1
    t = spark.createDataFrame([(1, 120.0, 0.01, 0.6, 0.55), (2, 121.0, 0.05, 0.5, 0.29), (3, None, None, None, None)], "track_id long, native_bpm double, ibi_cv double, onset_contrast double, analysis_confidence double")
    assert [r.track_id for r in experiments.confidence_report(t).collect()] == [2, 1]
