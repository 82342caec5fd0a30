"""Hand-computed values of the library's operators."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import config
from tessera.config import Ranking, Retrieval, Settings, Tempo, Transition
from tessera.functions import frames as A
from tessera.functions import kernels as K
from tessera.functions import naming
from tessera.functions.quantiles import group_quantiles
from tessera.functions.stats import sign_test
from tessera.operators import beats as B
from tessera.operators import catalog, evaluation, library, select, session
from tessera.operators import render as R
from tessera.plans import analysis
from tessera.sources import audio
from tessera.streaming import ingest

LIB = "track_id long, native_bpm double, energy double, analysis_confidence double, duration_seconds double"


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


# --- settings ---------------------------------------------------------------


def test_settings_sources_and_validation(tmp_path):
    f = tmp_path / "s.yaml"
    f.write_text("tempo: {min_stretch: 0.9}\nsession: {max_length: 10}\n")
    s = config.load(str(f), {"TESSERA_SESSION__MAX_LENGTH": "9", "OTHER": "x"}, ranking={"weight_tempo": 0.5, "weight_energy": 0.4, "weight_quality": 0.1})
    assert s.tempo.min_stretch == 0.9 and s.session.max_length == 9 and s.ranking.weight_energy == 0.4
    assert '"max_length": 9' in s.snapshot()
    for bad in ({"ranking": {"weight_tempo": 0.9}}, {"tempo": {"speed": 1}}, {"transition": {"outgoing": [0.9, 0.2]}}, {"session": {"strategy": "beam"}}):
        with pytest.raises(ValueError):
            config.load(environ={}, **bad)


# --- selection --------------------------------------------------------------


def test_stretch_bounds_are_inclusive(spark):
    t = spark.createDataFrame([(1, 124.0, 0.5, 0.7, 200.0), (2, 124 / 0.95, 0.5, 0.7, 200.0), (3, 124 / 1.05, 0.5, 0.7, 200.0), (4, 117.0, 0.5, 0.7, 200.0), (5, 0.0, 0.5, 0.7, 200.0)], LIB)
    got = select.retrieve(select.seeds_of(t).where("seed_id = 1"), t)
    assert {r.track_id for r in got.collect()} == {2, 3}


def test_relaxation_drops_only_the_energy_gate(spark):
    t = spark.createDataFrame([(1, 124.0, 0.1, 0.7, 200.0), (2, 124.0, 0.8, 0.7, 200.0), (3, 124.0, 0.9, 0.7, 200.0), (4, 90.0, 0.1, 0.7, 200.0)], LIB)
    rows = select.retrieve(select.seeds_of(t).where("seed_id = 1"), t).collect()
    assert {(r.track_id, r.relaxed) for r in rows} == {(2, True), (3, True)}
    off = select.retrieve(select.seeds_of(t).where("seed_id = 1"), t, rules=Retrieval(energy_filter=False)).collect()
    assert {(r.track_id, r.relaxed) for r in off} == {(2, False), (3, False)}


def test_bucketed_tempo_join_equals_the_nested_loop(spark):
    t = spark.createDataFrame([(i, 60.0 + i * 0.37, 0.5, 0.5, 200.0) for i in range(300)], LIB)
    got = {(r.seed_id, r.track_id) for r in select.tempo_pairs(select.seeds_of(t), t, Tempo()).collect()}
    bpm = {i: 60.0 + i * 0.37 for i in range(300)}
    assert got == {(a, b) for a in bpm for b in bpm if 0.95 - 1e-12 <= bpm[a] / bpm[b] <= 1.05 + 1e-12}


def test_rank_ties_and_quality(spark):
    t = spark.createDataFrame([(1, 124.0, 0.5, 0.7, 200.0), (10, 124.0, 0.5, 0.9, 200.0), (5, 124.0, 0.5, 0.9, 200.0), (7, 124.0, 0.5, 0.3, 200.0)], LIB)
    rows = select.rank(select.retrieve(select.seeds_of(t).where("seed_id = 1"), t)).orderBy("rank").collect()
    assert [r.track_id for r in rows] == [5, 10, 7]
    assert rows[2].total_cost - rows[0].total_cost == pytest.approx(0.05 * (0.7 - 0.1))
    with pytest.raises(ValueError):
        select.baseline(select.retrieve(select.seeds_of(t), t), "C", weights=Ranking(0.0, 0.0, 1.0))
    with pytest.raises(ValueError):
        select.baseline(select.retrieve(select.seeds_of(t), t), "D")


def test_position_cost_is_0_at_the_centre_and_1_at_the_edge(spark):
    tracks = spark.createDataFrame([(1, 100.0)], "track_id long, duration_seconds double")
    regions = spark.createDataFrame([(1, 80.0, 80.0), (1, 65.0, 65.0), (1, 95.0, 95.0), (1, 60.0, 60.0)], "track_id long, start_time double, end_time double")
    got = {r.start_time: r.deviation for r in select.in_window(regions, tracks, Transition().outgoing).collect()}
    assert got.keys() == {80.0, 65.0, 95.0} and got[80.0] == pytest.approx(0) and got[65.0] == pytest.approx(1) and got[95.0] == pytest.approx(1)


REG = "track_id long, start_beat int, end_beat int, start_time double, end_time double, score double, mean_energy double"


def regions_of(spark, ids, seconds=200.0):
    return spark.createDataFrame([x for i in ids for x in ((i, 8, 40, 0.1 * seconds, 0.15 * seconds, 0.9, 0.5), (i, 320, 352, 0.78 * seconds, 0.82 * seconds, 0.9, 0.5))], REG)


def test_the_walk_goes_past_what_cannot_be_planned(spark):
    t = spark.createDataFrame([(1, 124.0, 0.5, 0.7, 200.0), (2, 124.0, 0.5, 0.9, 200.0), (3, 123.0, 0.6, 0.7, 200.0)], LIB)
    r = regions_of(spark, [1, 2, 3]).where("not (track_id = 2 and start_beat = 8)")
    plan = select.select_next(select.seeds_of(t).where("seed_id = 1"), t, r).collect()
    assert [(p.track_id, p.rank, p.out_start_beat, p.in_start_beat) for p in plan] == [(3, 2, 320, 8)]


def test_played_tracks_are_out(spark):
    t = spark.createDataFrame([(i, 124.0, 0.5, 0.7, 200.0) for i in (1, 2, 3)], LIB)
    played = spark.createDataFrame([(2,)], "track_id long")
    seeds = select.seeds_of(t).where("seed_id = 1")
    assert [r.track_id for r in select.retrieve(seeds, t, played=played).collect()] == [3]
    assert {r.track_id for r in select.retrieve(seeds, t, rules=Retrieval(allow_repeats=True), played=played).collect()} == {2, 3}


def test_sessions(spark):
    rows = [(1, 120.0, 0.5, 0.9, 80.0), (2, 122.0, 0.5, 0.9, 80.0), (3, 124.0, 0.5, 0.9, 80.0)]
    t = spark.createDataFrame(rows, LIB)
    r = spark.createDataFrame([x for i, b, *_ in rows for x in ((i, 8, 40, 8 * 60 / b, 39 * 60 / b, 0.9, 0.5), (i, 112, 144, 112 * 60 / b, 143 * 60 / b, 0.9, 0.5))], REG)
    cfg = Settings(transition=Transition(crossfade_beats=16))
    got = session.chain(t, r, t, cfg, 3, seeds=t.where("track_id = 1")).orderBy("step").collect()
    assert [x.track_id for x in got] == [1, 2, 3] and {x.status for x in got} == {"READY"}
    assert got[1].start_seconds + 8 == pytest.approx(got[0].end_seconds) and got[2].start_seconds >= got[0].end_seconds
    six = session.chain(t, r, t, cfg, 6, seeds=t.where("track_id = 1")).collect()
    assert {x.status for x in six} == {"PARTIAL"} and len(six) == 3
    alone = session.chain(t.where("track_id = 1"), r, t, cfg, 2).collect()
    assert [x.status for x in alone] == ["FAILED"]
    with pytest.raises(ValueError):
        session.chain(t, r, t, cfg, 13)


def test_playback_and_clock(spark):
    spans = spark.createDataFrame([(1, 0, 60.0), (1, 1, 110.0)], "k int, span int, end_seconds double")
    asked = spark.createDataFrame([(1, 1, 0.0), (1, 2, 60.0), (1, 3, 109.0), (1, 4, 500.0)], "k int, m int, t double")
    assert {r.m: r.span for r in session.playing(spans, asked, "k", "m").collect()} == {1: 0, 2: 1, 3: 1, 4: 1}
    clocks = one(spark, *[session.clock(F.lit(x)).alias(f"c{i}") for i, x in enumerate((0.0, 61.9, 3600.0, -3.0, float("nan"), float("inf")))])
    assert tuple(clocks) == ("0:00", "1:01", "60:00", "0:00", "—", "—")


# --- library ----------------------------------------------------------------


def test_rescale(spark):
    kind = "track_id long, energy_scalar double"
    two = library.rescaled_energy(spark.createDataFrame([(1, 0.2), (2, 0.8)], kind)).collect()
    assert sorted(round(r.energy, 6) for r in two) == [0.0, 1.0]
    flat = library.rescaled_energy(spark.createDataFrame([(1, 0.4), (2, 0.4)], kind)).collect()
    assert [r.energy for r in flat] == [0.4, 0.4]
    assert library.rescaled_energy(spark.createDataFrame([], kind)).collect() == []


def test_exact_quantiles(spark):
    rng = np.random.default_rng(1)
    rows = [(g, float(v)) for g, n in (("a", 1), ("b", 2), ("c", 1001)) for v in rng.normal(size=n)] + [("c", float("nan")), ("d", None), ("c", float("inf"))] + [("e", 2.5)] * 500
    got = {r.g: r for r in group_quantiles(spark.createDataFrame(rows, "g string, v double").repartition(7), ["g"], "v", [0, 0.05, 0.5, 0.99, 1]).collect()}
    assert set(got) == set("abce")
    for g, r in got.items():
        values = [v for k, v in rows if k == g and v is not None and math.isfinite(v)]
        assert r.n == len(values) and r.q == pytest.approx(np.quantile(values, [0, 0.05, 0.5, 0.99, 1]).tolist())


def test_missing_ids_are_an_error(spark):
    t = spark.createDataFrame([(1,), (2,)], "track_id long")
    assert library.by_ids(t, [1]).count() == 1
    with pytest.raises(ValueError):
        library.by_ids(t, [1, 9])


def test_queue(spark):
    t = spark.createDataFrame([("a", "COMPLETE", 4), ("b", "COMPLETE", 3), ("c", "COMPLETE", None), ("d", "FAILED", None), ("e", "PENDING", None), ("f", "PROCESSING", 4)], "audio_path string, analysis_status string, analysis_version int")
    q = lambda **k: [r.audio_path for r in library.analysis_queue(t, **k).collect()]
    assert q() == ["b", "c", "e", "f"] and q(limit=2) == ["b", "c"] and q(audio_path="d") == ["d"] and q(reanalyze=True) == list("abcdef")


def test_snapshots(spark):
    kind = "audio_path string, content_hash string, failure_reason string, analysis_status string, native_bpm double, duration_seconds double"
    old = spark.createDataFrame([("a", "1", None, "COMPLETE", 120.0, 9.0), ("b", "2", None, "COMPLETE", 121.0, 8.0), ("c", "3", "SILENT", "FAILED", None, 7.0)], kind)
    scan = spark.createDataFrame([("a", "1", 9.0, None), ("b", "9", 5.0, None), ("c", "3", 7.0, None), ("d", "4", 6.0, None), ("e", "5", None, "TOO_SHORT")], ingest.SCANNED)
    assert {r.audio_path: r.outcome for r in catalog.changes(scan, old).collect()} == {"a": "UNCHANGED", "b": "UPDATED", "c": "UPDATED", "d": "ADDED", "e": "FAILED"}
    assert {r.outcome for r in catalog.changes(scan.where("failure_reason is null"), old, recheck=True).collect()} == {"UPDATED", "ADDED"}
    after = {r.audio_path: r for r in ingest.apply_scan(scan, old).collect()}
    assert after["a"].native_bpm == 120.0 and (after["b"].analysis_status, after["b"].native_bpm) == ("PENDING", None) and after["e"].failure_reason == "TOO_SHORT"
    broken = catalog.save_failures(old, spark.createDataFrame([("a", None, "DECODE_FAILED")], "audio_path string, content_hash string, failure_reason string")).where("audio_path = 'a'").first()
    assert (broken.content_hash, broken.duration_seconds, broken.native_bpm, broken.analysis_status) == ("1", 9.0, None, "FAILED")
    done = catalog.save_analysis(old, spark.createDataFrame([("b", 120.1234567, 0.5, 0.25)], "audio_path string, native_bpm double, analysis_confidence double, energy_scalar double")).where("audio_path = 'b'").first()
    assert (done.native_bpm, done.analysis_status) == (120.123457, "COMPLETE")


def test_stream_of_scans(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text('{"audio_path": "a", "content_hash": "1", "duration_seconds": 40.0}\n{"audio_path": "b", "content_hash": "2", "failure_reason": "TOO_SHORT"}\n')
    kind = "audio_path string, content_hash string, failure_reason string, analysis_status string, native_bpm double, duration_seconds double"
    state = {"now": spark.createDataFrame([], kind)}
    ingest.run(ingest.scanned_files(spark, str(tmp_path / "in")), lambda: state["now"], lambda df, n: state.update(now=spark.createDataFrame(df.collect(), kind)), str(tmp_path / "cp")).awaitTermination(60)
    assert {r.audio_path: r.analysis_status for r in state["now"].collect()} == {"a": "PENDING", "b": "FAILED"}


# --- naming -----------------------------------------------------------------

STEMS = {
    "Daft Punk - One More Time (Official Video)": ("One More Time", "Daft Punk"),
    "03 - Artist - Title": ("Title", "Artist"),
    "some_track_name": ("some track name", None),
    "Artist - Song (Extended Mix) [HQ]": ("Song (Extended Mix)", "Artist"),
    "Artist – Song – Live": ("Song – Live", "Artist"),
    "Channel - Topic": ("Channel", None),
    "HUMBLE.": ("HUMBLE.", None),
    "A - B (feat. C) [Lyrics Video]": ("B (feat. C)", "A"),
    "a-b": ("a-b", None),
    "---": ("---", None),
    " - ": ("-", None),
    "X [1080p] (Official Music Video)": ("X", None),
    "Y ((Official Video))": ("Y ()", None),
    "x" * 600: ("x" * 500, None),
}


def test_names_from_stems(spark):
    rows = spark.createDataFrame([(s,) for s in STEMS], "s string").select("s", naming.from_stem(F.col("s")).alias("n")).collect()
    assert {r.s: (r.n.title, r.n.artist) for r in rows} == STEMS


def test_tags_first(spark):
    def resolved(tags, stem="A - B"):
        return tuple(one(spark, naming.resolve(F.lit(None).cast("map<string,string>") if tags is None else F.create_map(*[F.lit(x) for kv in tags.items() for x in kv]), F.lit(stem)).alias("n")).n)

    assert resolved({"title": " T_x ", "artist": "Unknown Artist", "performer": "P"}) == ("T x", "P", "tags")
    assert resolved({"title": "Untitled", "author": "W"}) == ("B", "W", "mixed")
    assert resolved({"title": "n/a"}) == ("B", "A", "filename") and resolved(None) == ("B", "A", "filename")
    m = one(spark, naming.lowered_tags(F.create_map(F.lit(" Title"), F.lit("c")), F.create_map(F.lit("TITLE"), F.lit("s"), F.lit("Artist "), F.lit("a"))).alias("m")).m
    assert m == {"title": "c", "artist": "a"}


# --- beats ------------------------------------------------------------------


def grid(spark, n=64, bpm=124.0, onset=0.8, jitter=0.0):
    rng = np.random.default_rng(4)
    t = np.arange(n) * 60 / bpm * (1 + 0) + rng.normal(0, jitter * 60 / bpm, n)
    return spark.createDataFrame([(1, i, float(x), onset, 0.5) for i, x in enumerate(t)], "track_id long, beat_index int, beat_time double, onset_unit double, energy double")


def test_regions_of_a_perfect_grid(spark):
    kept = B.suppressed(B.gated(B.stable_windows(grid(spark, 100)))).orderBy("start_beat").collect()
    assert [r.start_beat for r in kept] == [0, 32, 64] and all(r.ibi_cv == pytest.approx(0, abs=1e-9) and r.score == pytest.approx(0.5 + 0.3 * 0.8 + 0.2) for r in kept)
    assert B.gated(B.stable_windows(grid(spark, 31))).count() == 0
    assert B.gated(B.stable_windows(grid(spark, onset=0.05))).count() == 0
    assert B.gated(B.stable_windows(grid(spark, jitter=0.08))).count() == 0


def test_octave_tie_goes_to_the_prior(spark):
    kind = "track_id long, grid int, factor double, bpm double, mean_onbeat double, mean_offbeat double, contrast double, score double"
    rows = [(1, 0, 1.0, 174.0, 0.5, 0.1, 0.6, 0.3), (1, 1, 0.5, 87.0, 0.5, 0.1, 0.6, 0.3), (2, 0, 1.0, 174.0, 0.5, 0.1, 0.6, 0.31), (2, 1, 0.5, 87.0, 0.5, 0.1, 0.6, 0.3), (3, 0, 1.0, 60.0, 0.5, 0.1, 0.6, 0.3)]
    got = {r.track_id: (r.bpm, r.failure_reason) for r in B.choose_octave(spark.createDataFrame(rows, kind)).collect()}
    assert got == {1: (87.0, None), 2: (174.0, None), 3: (60.0, "TEMPO_OUT_OF_RANGE")}


def test_parabola_dedupe_and_interpolation(spark):
    r = one(spark, B.parabolic(F.lit(1.0), F.lit(2.0), F.lit(1.0)).alias("a"), B.parabolic(F.lit(0.0), F.lit(1.0), F.lit(0.9)).alias("b"), B.parabolic(F.lit(1.0), F.lit(1.0), F.lit(1.0)).alias("c"), B.deduped(F.array(*[F.lit(x) for x in (0.3, 0.0, 0.00005, 0.00012, 0.3)])).alias("d"), B.energy_at(F.lit(0.25), F.array(F.lit(0.0), F.lit(1.0)), 2.0).alias("e"), B.energy_at(F.lit(9.0), F.array(F.lit(0.0), F.lit(1.0)), 2.0).alias("f"))
    assert (r.a, r.c, r.e, r.f) == (0.0, 0.0, 0.5, 1.0) and 0 < r.b <= 0.5 and r.d == [0.0, 0.00012, 0.3]


def click(bpm, seconds=16, rate=22050):
    y = np.zeros(int(seconds * rate), np.float32)
    at = np.arange(0.25, seconds - 0.2, 60 / bpm)
    for t in at:
        i = int(t * rate)
        y[i : i + 64] += np.exp(-np.arange(64) / 12).astype(np.float32)
    return y, at


def test_analysis_of_click_tracks(spark):
    cases = {i: click(b) for i, b in enumerate((100, 120, 124, 140), 1)}
    noise = np.random.default_rng(0).normal(0, 0.1, 22050 * 16).astype(np.float32)
    rows = [(i, y.tolist()) for i, (y, _) in cases.items()] + [(8, np.zeros(22050 * 16).tolist()), (9, noise.tolist()), (10, [])]
    pcm = spark.createDataFrame(rows, "track_id long, samples array<float>")
    tracks, regions = analysis.analyze(pcm)
    got = {r.track_id: r for r in tracks.collect()}
    for i, bpm in zip(cases, (100, 120, 124, 140), strict=True):
        assert got[i].failure_reason in (None, "NO_STABLE_REGION")
        if got[i].failure_reason is None:
            assert got[i].native_bpm == pytest.approx(bpm, abs=1.0)
            error = [min(abs(t - x) for x in cases[i][1]) for t in got[i].beat_times]
            assert np.median(error) < 0.025
    assert sum(got[i].failure_reason is None for i in cases) >= 2
    assert all(got[i].failure_reason for i in (8, 9, 10)) and got[10].failure_reason == "EMPTY_ONSET_ENVELOPE"
    assert regions.count() >= 1


# --- frames and rendering ---------------------------------------------------


def arr(*v):
    return F.array(*[F.lit(float(x)) for x in v])


def test_levels(spark):
    r = one(spark, A.discontinuity_db(F.array_repeat(F.lit(0.1), 100), 10).alias("same"), A.discontinuity_db(F.concat(F.array_repeat(F.lit(0.1), 50), F.array_repeat(F.lit(0.2), 50)), 10).alias("jump"), A.discontinuity_db(F.array_repeat(F.lit(0.0), 100), 10).alias("silence"), A.discontinuity_db(arr(1), 10).alias("short"), A.dbfs(F.lit(0.0)).alias("none"))
    assert (r.same, r.silence, r.short, r.none) == (0.0, 0.0, None, -120.0) and r.jump == pytest.approx(6.0206, abs=1e-4)


def test_equal_power_gains(spark):
    down, up = A.equal_power(F.lit(33))
    r = one(spark, down.alias("d"), up.alias("u"), A.equal_power(F.lit(1))[0].alias("one"), A.equal_power(F.lit(0))[0].alias("none"))
    assert (r.d[0], r.u[0]) == (1.0, 0.0) and r.u[-1] == 1.0 and r.d[-1] == pytest.approx(0, abs=1e-15) and r.one == [1.0] and r.none == []
    assert np.square(r.d) + np.square(r.u) == pytest.approx(np.ones(33))


def test_append_transition(spark):
    mix, inc = F.array_repeat(F.lit(1.0), 100), F.array_repeat(F.lit(0.5), 100)
    cases = {"ok": (60, 10, 10, 0), "no_fade": (60, 10, 0, 0), "early": (60, 10, 10, 61), "negative": (60, -1, 10, 0), "long": (95, 10, 10, 0)}
    r = one(spark, *[F.size(A.appended(mix, inc, *map(F.lit, c))).alias(k) for k, c in cases.items()])
    assert r.ok == 150 and [r[k] for k in cases if k != "ok"] in ([-1] * 4, [None] * 4)


def test_align_samples_and_quantise(spark):
    r = one(spark, *[A.align_beat(F.lit(s), F.lit(e), F.lit(n), d).alias(k) for k, s, e, n, d in (("fwd", 5, 20, 100, True), ("keep", 8, 20, 100, True), ("back", 5, 7, 100, True), ("plain", 5, 20, 100, False), ("past", 50, 60, 10, True), ("none", 5, 9, 0, True))], A.samples(F.lit(2.5), 1).alias("even"), A.beat_samples(32, F.lit(120.0), 1000).alias("fade"), A.pcm16(arr(0.0, 1.0, -1.0, 2.0, -2.0)).alias("q"))
    assert (r.fwd, r.keep, r.back, r.plain, r.past, r.none) == (8, 8, 5, 5, 9, 0)
    assert r.even == 2 and r.fade == 16000 and r.q == [0, 32767, -32767, 32767, -32768]


def test_lag_recovery(spark):
    rng = np.random.default_rng(2)
    x = rng.random(120)
    for shift in (0, 5, -7):
        y = np.roll(x, shift)
        best = one(spark, A.best_lag(A.lag_scores(arr(*x), arr(*y), 10)).alias("b")).b
        assert best.lag == shift


def test_sign_test(spark):
    cases = [(0, 0, None), (3, 3, 1.0), (6, 0, 0.03125), (0, 6, 0.03125), (500, 400, None)]
    r = one(spark, *[sign_test(F.lit(a), F.lit(b)).alias(f"p{i}") for i, (a, b, _) in enumerate(cases)])
    assert r[0] is None and [r[i] for i in (1, 2, 3)] == pytest.approx([1.0, 0.03125, 0.03125])
    exact = 2 * sum(math.comb(900, i) for i in range(401)) / 2**900
    assert r[4] == pytest.approx(exact, rel=1e-9)
    with pytest.raises(Exception, match="nonnegative"):
        one(spark, sign_test(F.lit(-1), F.lit(2)).alias("p"))


def test_distributions_keep_missing_apart(spark):
    rows = spark.createDataFrame([("A", None), ("A", 1.0), ("A", 3.0), ("B", None), ("A", float("nan"))], "strategy string, m double")
    got = {r.strategy: r for r in evaluation.distributions(rows, ["strategy"], ["m"]).collect()}
    assert (got["A"]["count"], got["A"].missing, got["A"].p50) == (2, 2, 2.0) and (got["B"]["count"], got["B"].missing, got["B"].p95) == (0, 1, None)


def test_pairs_are_the_unit_of_ratings(spark):
    book = spark.createDataFrame([("p1", "D", "B"), ("p2", "B", "D")], "pair_id string, x string, y string")
    kind = "pair_id string, listener_id string, preference string, smoothness_X int, smoothness_Y int, rhythm_X int, rhythm_Y int, energy_X int, energy_Y int"
    rows = [("p1", f"l{i}", "X", 5, 3, 4, 4, 1, 2) for i in range(3)] + [("p2", f"l{i}", "Y", 2, 4, 3, 3, 5, 5) for i in range(3)]
    ratings = spark.createDataFrame(rows, kind)
    r = evaluation.preference_report(evaluation.pair_votes(ratings, book)).first()
    assert (r.d_wins, r.b_wins, r.ties, r.eligible_pairs, r.p) == (2, 0, 0, 2, 0.5)
    few = evaluation.preference_report(evaluation.pair_votes(ratings, book, 4)).first()
    assert (few.eligible_pairs, few.insufficient_pairs, few.p) == (0, 2, None)
    deltas = {x.metric: x.p50 for x in evaluation.rating_deltas(ratings, book).collect()}
    assert deltas == {"smoothness_D_minus_B": 2.0, "rhythm_D_minus_B": 0.0, "energy_D_minus_B": -0.5}
    bad = spark.createDataFrame([("p9", "l", "X", *[1] * 6), ("p1", " ", "X", *[1] * 6), ("p1", "z", "X", *[1] * 6), ("p1", "z", "Y", *[1] * 6), ("p2", "q", "maybe", *[1] * 6), ("p2", "r", "tie", 6, *[1] * 5), ("p2", "s", "tie", *[1] * 6)], kind)
    assert sorted(x.reason for x in evaluation.invalid_ratings(bad, book).collect()) == ["BAD_SCORE", "DUPLICATE", "DUPLICATE", "NO_LISTENER", "NO_PREFERENCE", "UNKNOWN_PAIR"]
    sheet = evaluation.rating_rows(book.withColumn("failure_reason", F.lit(None).cast("string")), 3)
    assert sheet.count() == 6 and sheet.columns[-1] == "preference"


def test_stretch_and_transition_kernels():
    y = np.sin(2 * np.pi * 440 * np.arange(44100) / 44100).astype(np.float32)[:, None]
    assert np.array_equal(K.stretched(y, 1.0), y)
    fast = K.stretched(y, 1.05)
    assert len(fast) == round(44100 / 1.05)
    peak = np.argmax(np.abs(np.fft.rfft(fast[4096:36864, 0]))) * 44100 / 32768
    assert peak == pytest.approx(440, abs=4)
    a, b = np.ones((100, 2), np.float32), np.full((100, 2), 0.5, np.float32)
    mix, start, fade = K.transition(a, b, 60, 10, 10, 20, 30)
    assert (len(mix), start, fade) == (60, 20, 10)
    assert K.protected(np.array([[2.0], [-1.0]], np.float32), -1.0)[0].max() == 1.0 and K.protected(np.zeros((0, 1)), -1.0)[1:] == (-120.0, False, False)
    assert K.channels(np.zeros((2, 50)), 2, "planes").shape == (50, 2) and K.channels(np.zeros(5), 2).shape == (5, 2)
    assert K.channels(np.arange(6).reshape(3, 2), 1).tolist() == [[0], [2], [4]] and K.channels(np.arange(3)[:, None], 2).tolist() == [[0, 0], [1, 1], [2, 2]]
    tone = np.sin(2 * np.pi * 15000 * np.arange(44100) / 44100)[:, None]
    assert np.abs(K.resampled(tone, 44100, 22050)[200:-200]).max() < 0.05 and np.abs(K.resampled(tone, 44100, 48000)).max() > 0.5
    low = np.sin(2 * np.pi * 440 * np.arange(44100) / 44100)[:, None]
    assert np.abs(K.resampled(low, 44100, 22050)[:, 0] - np.sin(2 * np.pi * 440 * np.arange(22050) / 22050))[200:-200].max() < 0.01
    with pytest.raises(ValueError):
        K.channels(np.zeros((50, 3)), 4)


def test_render_rows_and_failures(spark):
    cfg = config.load(environ={}, render={"sample_rate": 1000, "channels": 1}, transition={"crossfade_beats": 4, "margin_beats": 2})
    pcm = spark.createDataFrame([(1, [0.9] * 20000), (2, [0.8] * 20000)], "track_id long, samples array<float>")
    kind = "track_a_id long, track_b_id long, session_bpm double, bpm_a double, bpm_b double, at_a double, at_b double"
    plans = spark.createDataFrame([(1, 2, 120.0, 120.0, 120.0, 15.0, 2.0), (1, 3, 120.0, 120.0, 120.0, 15.0, 2.0), (2, 1, 120.0, 120.0, 90.0, 15.0, 2.0), (1, 2, 120.0, 120.0, 120.0, 25.0, 2.0)], kind)
    got = R.render(plans, pcm, cfg).collect()
    ok = [r for r in got if r.failure_reason is None]
    assert len(ok) == 1 and (ok[0].fade_start_sample, ok[0].fade_frames, len(ok[0].samples)) == (1000, 2000, 4000) and ok[0].clipped
    assert sorted(r.failure_reason for r in got if r.failure_reason) == ["INSUFFICIENT_AUDIO", "MISSING_TRACK", "STRETCH_OUT_OF_BOUNDS"]


# --- files ------------------------------------------------------------------


def test_files_are_found_probed_and_written(spark, tmp_path):
    lib = tmp_path / "lib"
    (lib / "sub").mkdir(parents=True)
    tone = (0.5 * np.sin(np.arange(44100 * 2) / 20)).astype(np.float32)[:, None]
    late = np.concatenate([np.zeros((44100 * 3, 1)), tone[:44100]])
    for name, x in (("good.wav", tone), ("sub/_late.WAV", late), ("silent.wav", np.zeros((44100 * 2, 1))), ("short.wav", tone[:4410])):
        (lib / name).write_bytes(audio.wav_bytes(x, 44100))
    (lib / "empty.wav").touch()
    (lib / "bad.wav").write_bytes(b"RIFF nonsense")
    (lib / "x.mp3").write_bytes(b"not audio")
    (lib / ".hidden.wav").touch()
    (lib / "notes.txt").touch()
    files = audio.discover(spark, str(lib))
    assert [r.audio_path for r in files.collect()] == ["bad.wav", "empty.wav", "good.wav", "short.wav", "silent.wav", "sub/_late.WAV", "x.mp3"]
    rules = config.load(environ={}, ingestion={"min_duration_seconds": 1, "validation_seconds": 1, "silence_scan_seconds": 60}).ingestion
    got = {r.audio_path: r for r in audio.probe_files(files, rules, read_paths=True).collect()}
    assert {k: v.failure_reason for k, v in got.items()} == {"bad.wav": "PROBE_FAILED", "empty.wav": "EMPTY_FILE", "good.wav": None, "short.wav": "TOO_SHORT", "silent.wav": "SILENT_AUDIO", "sub/_late.WAV": None, "x.mp3": got["x.mp3"].failure_reason}
    assert got["x.mp3"].failure_reason in ("TOOL_MISSING", "PROBE_FAILED", "NO_AUDIO_STREAM") and got["good.wav"].duration_seconds == 2.0
    with pytest.raises(NotADirectoryError):
        audio.discover(spark, str(lib / "none"))
    stored = {r.audio_path: r.content_hash for r in audio.stored(spark, str(lib)).collect()}
    assert stored["good.wav"] == got["good.wav"].content_hash
    out = audio.write_wavs(spark.createDataFrame([("m.wav", tone[:100, 0].tolist(), 1, 44100)], "name string, samples array<float>, channels int, rate int"), str(tmp_path / "out")).first()
    back = audio.decode((tmp_path / "out" / "m.wav").read_bytes(), 44100)
    assert out.bytes == (tmp_path / "out" / "m.wav").stat().st_size and np.abs(back - tone[:100]).max() < 1e-4
    assert audio.decode(audio.wav_bytes(tone, 44100), 22050, 2).shape == (44100, 2)


def test_tool_output_of_any_kind_is_facts_or_a_failure():
    good = {"streams": [{"codec_type": "video"}, {"codec_type": "audio", "codec_name": "aac", "sample_rate": "44100", "channels": 2, "duration": "N/A", "tags": {"Title ": "x"}}], "format": {"duration": "12.5", "bit_rate": "N/A", "tags": {"title": "y"}}}
    found = audio.described(json.dumps(good).encode())
    assert (found["duration"], found["sample_rate"], found["channels"], found["bit_rate"], found["tags"]) == (12.5, 44100, 2, None, {"title": "y"})

    def reason(output):
        with pytest.raises(audio.SourceError) as e:
            audio.described(output if isinstance(output, bytes) else json.dumps(output).encode())
        return e.value.reason

    stream = {"codec_type": "audio", "sample_rate": "44100", "channels": 2, "duration": "3"}
    assert [reason(x) for x in (b"", b"{", b"[]", {"streams": 3}, b"\xff")] == ["UNREADABLE_PROBE_OUTPUT"] * 5
    assert reason({}) == reason({"streams": [{"codec_type": "video"}]}) == "NO_AUDIO_STREAM"
    assert {reason({"streams": [stream | {"duration": d}]}) for d in ("N/A", None, "nan", "inf", "-1", "0")} == {"INVALID_DURATION"}
    assert {reason({"streams": [stream | x]}) for x in ({"sample_rate": "N/A"}, {"channels": None}, {"channels": 0})} == {"INVALID_SAMPLE_FORMAT"}


def test_wav_of_floating_point_samples():
    x = np.stack([np.linspace(-1, 1, 1000), np.zeros(1000)], 1)
    for kind in ("<f4", "<f8"):
        raw, width = x.astype(kind).tobytes(), int(kind[2])
        form = np.array([3, 2], "<u2").tobytes() + np.array([8000, 8000 * 2 * width], "<u4").tobytes() + np.array([2 * width, 8 * width], "<u2").tobytes()
        data = b"RIFF" + (36 + len(raw)).to_bytes(4, "little") + b"WAVEfmt " + (16).to_bytes(4, "little") + form + b"LIST" + (3).to_bytes(4, "little") + b"abc\0" + b"data" + len(raw).to_bytes(4, "little") + raw
        assert audio.probe(data)["duration"] == 0.125 and audio.probe(data)["channels"] == 2
        assert np.allclose(audio.decode(data, 8000, 2), x, atol=1e-6) and audio.decode(data, 8000, 1, 0.05).shape == (400, 1)
        assert audio.float_wav(data[:60]) is None or len(audio.float_wav(data[:60])[0]) == 0
    assert audio.float_wav(b"RIFF nonsense") is None
