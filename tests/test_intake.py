"""Strict intake of JSON records, why windows are no regions, look-ups by any key."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.config import Regions
from tessera.operators import beats as B
from tessera.operators import intake, library

REGION = {"start_beat": 0, "end_beat": 32, "start_time": 0, "end_time": 15.5, "score": 0.75, "ibi_cv": 0.01, "mean_energy": 0.5}
GOOD = {"track_id": 7, "audio_path": "a.wav", "native_bpm": 120, "energy": 0.5, "analysis_confidence": 1, "analysis_version": 4, "duration_seconds": 180.5, "stable_regions": [REGION], "beat_times": [0, 0.5], "beat_count": 2}

CASES = {
    "good": (GOOD, []),
    "more fields": ({**GOOD, "mood": {"a": [1]}}, []),
    "no regions": ({**GOOD, "stable_regions": [], "beat_times": []}, []),
    "boolean is no integer": ({**GOOD, "track_id": True}, [("track_id", "WRONG_TYPE", "BOOLEAN")]),
    "boolean is no number": ({**GOOD, "energy": False}, [("energy", "WRONG_TYPE", "BOOLEAN")]),
    "text is no integer": ({**GOOD, "beat_count": "2"}, [("beat_count", "WRONG_TYPE", "STRING")]),
    "7.0 is no integer": ({**GOOD, "track_id": 7.0}, [("track_id", "WRONG_TYPE", "NUMBER")]),
    "beyond 64 bits": ({**GOOD, "track_id": 1 << 63}, [("track_id", "WRONG_TYPE", "NUMBER")]),
    "null": ({**GOOD, "native_bpm": None}, [("native_bpm", "WRONG_TYPE", "NULL")]),
    "absent": ({k: v for k, v in GOOD.items() if k != "energy"}, [("energy", "MISSING", None)]),
    "several": ({**GOOD, "stable_regions": [REGION, 3, {**REGION, "score": "x"}], "beat_times": [0, None]}, [("stable_regions[1]", "WRONG_TYPE", "INTEGER"), ("stable_regions[2].score", "WRONG_TYPE", "STRING"), ("beat_times[1]", "WRONG_TYPE", "NULL")]),
    "an object for a list": ({**GOOD, "beat_times": {}}, [("beat_times", "WRONG_TYPE", "OBJECT")]),
    "a list for the record": ([GOOD], [("", "WRONG_TYPE", "ARRAY")]),
}
TEXTS = {"null text": None, "empty": "", "cut off": json.dumps(GOOD)[:-1], "one key twice": '{"track_id": 1, "track_id": 2}'}


@pytest.fixture(scope="module")
def records(spark):
    rows = [(n, json.dumps(r)) for n, (r, _) in CASES.items()] + list(TEXTS.items())
    return spark.createDataFrame(rows * 2, "name string, record string")


def test_every_row_is_typed_or_has_problems(records):
    rows = intake.judged(records).collect()
    assert len(rows) == 2 * (len(CASES) + len(TEXTS))
    for r in rows:
        expected = CASES[r.name][1] if r.name in CASES else [("", "NOT_JSON", None)]
        assert [tuple(p) for p in r.problems] == expected, r.name
        assert (r.typed is None) == bool(expected), r.name
    typed = next(r.typed for r in rows if r.name == "good")
    assert typed.asDict(True) == {**GOOD, "native_bpm": 120.0} and isinstance(typed.native_bpm, float)


def test_both_parts_add_up(records):
    good, bad = intake.parted(records)
    assert good.columns == ["name", *intake.CANDIDATE] and bad.columns == ["name", "record", "problems"]
    assert good.count() == 2 * 3 and good.count() + bad.count() == records.count()
    report = {(r.field, r.code, r.found): (r.n_problems, r.n_rows) for r in intake.problem_report(bad).collect()}
    assert report["stable_regions[].score", "WRONG_TYPE", "STRING"] == (2, 2) and report["", "NOT_JSON", None] == (8, 8)


def test_intake_edges(spark, records):
    assert intake.judged(records.limit(0)).count() == 0
    with pytest.raises(ValueError):
        intake.judged(records.withColumn("typed", F.lit(1)))
    with pytest.raises(ValueError):
        intake.parted(records.withColumn("energy", F.lit(1)))
    other = spark.createDataFrame([('{"a": {"b": [[1], []]}}',), ('{"a": {"b": [[1], [true]]}}',)], "line string")
    got = [(r.typed, [p.field for p in r.problems]) for r in intake.judged(other, {"a": {"b": [["int"]]}}, "line").collect()]
    assert got[0][0].a.b == [[1], []] and got[1] == (None, ["a.b[1][0]"])
    assert "Exchange" not in intake.judged(records)._jdf.queryExecution().executedPlan().toString()


def brute(windows, cfg):
    """What the operator says, by a loop over each track's windows."""
    out = {}
    for track in {w[0] for w in windows}:
        own, ok = [w for w in windows if w[0] == track], {}
        for _, start, end, cv, inside, onset in own:
            ok[start] = [n for n, x in (("TEMPO", cv is not None and cv <= cfg.ibi_cv_max), ("IN_TOLERANCE", inside >= cfg.in_tolerance_min), ("ONSET", onset >= cfg.onset_floor)) if not x]
        kept = []
        score = lambda w: 0.5 * max(0, 1 - w[3] / cfg.ibi_cv_max) + 0.3 * w[5] + 0.2 * w[4]
        for w in sorted((w for w in own if not ok[w[1]]), key=lambda w: (-round(score(w), 9), w[1])):
            way = [k for k in kept if w[1] < k[2] and k[1] < w[2]]
            out[track, w[1]] = ("OVERLAPPED", way[0][1]) if way else ("OVER_LIMIT", None) if len(kept) == cfg.max_regions else ("KEPT", None)
            if out[track, w[1]][0] == "KEPT":
                kept.append(w)
        out |= {(track, s): ("GATED", None) for s, names in ok.items() if names}
    return out


def test_region_diagnosis_equals_a_loop(spark):
    import random

    rng, cfg = random.Random(5), Regions(max_regions=3)
    windows = [(t, s, s + 32, None if rng.random() < 0.05 else rng.choice([0.0, 0.01, 0.03, 0.06, 0.07]), rng.choice([0.85, 0.9, 1.0]), rng.choice([0.2, 0.35, 0.8])) for t in range(12) for s in range(0, 400, 12)]
    frame = spark.createDataFrame(windows, "track_id long, start_beat int, end_beat int, ibi_cv double, in_tolerance_fraction double, mean_onset double")
    rows = B.region_diagnosis(frame, cfg).collect()
    assert {(r.track_id, r.start_beat): (r.outcome, r.blocked_by) for r in rows} == brute(windows, cfg) and len(rows) == len(windows)
    assert {r.outcome for r in rows} == {"KEPT", "GATED", "OVERLAPPED", "OVER_LIMIT"}
    for r in rows:
        assert ("TEMPO" in r.failed) == (r.ibi_cv is None or r.tempo_margin < 0) and ("ONSET" in r.failed) == (r.mean_onset < 0.35)
    kept = {(r.track_id, r.start_beat) for r in B.suppressed(B.gated(frame, cfg), cfg).collect()}
    assert kept == {(r.track_id, r.start_beat) for r in rows if r.outcome == "KEPT"}
    assert B.region_diagnosis(frame.limit(0), cfg).count() == 0


def test_the_least_change_lets_a_window_in(spark):
    frame = spark.createDataFrame([(1, 0, 32, 0.08, 1.0, 0.9), (1, 40, 72, 0.01, 0.8, 0.9), (1, 80, 112, 0.01, 1.0, 0.25), (1, 120, 152, 0.07, 0.7, 0.9)], "track_id long, start_beat int, end_beat int, ibi_cv double, in_tolerance_fraction double, mean_onset double")
    found = B.region_diagnosis(frame)
    report = {r.gate: (r.n_failed, r.n_alone, round(r.largest_change, 6)) for r in B.gate_report(found).collect()}
    assert report == {"TEMPO": (2, 1, 0.02), "IN_TOLERANCE": (2, 1, 0.1), "ONSET": (1, 1, 0.1)}
    looser = Regions(ibi_cv_max=0.06 + 0.02 + 1e-9, in_tolerance_min=0.9 - 0.1 - 1e-9, onset_floor=0.35 - 0.1 - 1e-9)
    assert sorted(r.start_beat for r in B.region_diagnosis(frame, looser).where("outcome = 'KEPT'").collect()) == [0, 40, 80]


def test_look_ups_and_labels(spark):
    tracks = spark.createDataFrame([(1, "a.wav", "h1", "A", "X"), (2, "b.wav", "h2", "B", None), (3, "c.wav", "h1", None, "Z")], "track_id long, audio_path string, content_hash string, title string, artist string")
    want = spark.createDataFrame([("h1",), ("h9",), ("h1",), (None,)], "content_hash string")
    found, missing = library.look_up(tracks, want, "content_hash")
    assert sorted(r.track_id for r in found.collect()) == [1, 3] and {r[0] for r in missing.collect()} == {"h9", None} and missing.count() == 2
    assert [r.track_id for r in library.required(library.look_up(tracks, spark.createDataFrame([("b.wav",)], "audio_path string"), "audio_path")).collect()] == [2]
    with pytest.raises(ValueError, match="h9"):
        library.required((found, missing))
    named = library.labelled(spark.createDataFrame([(1, 0), (2, 1), (9, 2)], "next_id long, place int"), tracks, "next_id")
    assert sorted((r.place, r.title, r.artist) for r in named.collect()) == [(0, "A", "X"), (1, "B", None), (2, None, None)]


def test_remapped_beats(spark):
    beats = spark.createDataFrame([(t, i, 0.5 * i) for t in (1, 2, 3, 4) for i in range(3)], "track_id long, beat_index int, beat_time double")
    ratios = spark.createDataFrame([(1, 1.25), (2, 0.0), (3, None), (5, 1.0)], "track_id long, stretch_ratio double")
    rows = {(r.track_id, r.beat_index): (r.beat_time, r.failure_reason) for r in B.remapped_beats(beats, ratios).collect()}
    assert {k: v for k, v in rows.items() if k[0] == 1} == {(1, 0): (0.0, None), (1, 1): (0.4, None), (1, 2): (0.8, None)}
    assert {v for k, v in rows.items() if k[0] != 1} == {(None, "STRETCH_OUT_OF_BOUNDS")} and {k[0] for k in rows} == {1, 2, 3}


def test_clicks_are_written_once(spark, tmp_path):
    import numpy as np

    from tessera.plans import experiments
    from tessera.sources import audio

    rate, out = 8000, tmp_path / "clicks"
    tracks = spark.createDataFrame([(1, "x/a.wav", [0.1, 0.5, 9.0]), (2, "y/a.wav", [0.2]), (3, "c.wav", None), (4, "d.wav", [0.1])], "track_id long, audio_path string, beat_times array<double>")
    pcm = spark.createDataFrame([(i, [0.25] * rate) for i in (1, 2, 3)], "track_id long, samples array<float>")
    found = {r.track_id: tuple(r)[1:] for r in experiments.write_clicks(tracks, pcm, str(out), rate).collect()}
    assert found == {1: ("1-a.beats.wav", 2, None), 2: ("2-a.beats.wav", 1, None), 3: (None, None, "NO_BEATS"), 4: (None, None, "MISSING_AUDIO")}
    assert sorted(p.name for p in out.iterdir()) == ["1-a.beats.wav", "2-a.beats.wav"]
    expected = audio.wav_bytes(experiments.with_clicks(np.full(rate, 0.25), [0.1, 0.5, 9.0], rate)[:, None], rate)
    assert (out / "1-a.beats.wav").read_bytes() == expected
    (out / "2-a.beats.wav").write_bytes(b"mine")
    again = {r.track_id: r.failure_reason for r in experiments.write_clicks(tracks, pcm, str(out), rate).collect()}
    assert again[1] is None and again[2] == "EXISTS" and (out / "2-a.beats.wav").read_bytes() == b"mine"
