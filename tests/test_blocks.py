import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import frames as A
from tessera.functions import kernels as K
from tessera.operators import blocks

PCM = "track_id bigint, samples array<double>"


def stem(i, n):
    return np.random.default_rng(i).uniform(-0.9, 0.9, n).tolist()


@pytest.fixture(scope="module")
def pcm(spark):
    return spark.createDataFrame([(1, stem(1, 100)), (2, stem(2, 64)), (3, stem(3, 130)), (4, []), (5, None)], PCM)


def test_blocks_hold_everything_and_windows_touch_few(spark, pcm):
    b = blocks.blocks(pcm, 16)
    assert {r.track_id: r.frames for r in blocks.lengths(b).collect()} == {1: 100, 2: 64, 3: 130}
    asked = spark.createDataFrame([("x", 1, 10, 30), ("y", 3, 120, 50), ("z", 2, 0, 64), ("none", 9, 0, 5), ("empty", 1, 5, 0)], "id string, track_id bigint, start bigint, frames bigint")
    got = {r.id: r.x for r in blocks.windows(asked, b, "id", size=16).collect()}
    assert got == {"x": stem(1, 100)[10:40], "y": stem(3, 130)[120:], "z": stem(2, 64)}


def test_measured_fades_equal_whole_arrays(spark, pcm):
    plans = spark.createDataFrame(
        [(1, 1, 2, 40, 3, 50, None), (2, 1, 3, 95, 0, 40, None), (3, 1, 3, 100, 0, 40, None), (4, 1, 9, 0, 0, 40, None), (5, 1, 3, 0, 0, 40, "NO_PLAN"), (6, 1, 3, -1, 0, 40, None)],
        "attempt_id bigint, track_a_id bigint, track_b_id bigint, at_a bigint, at_b bigint, fade bigint, failure_reason string",
    )
    got = {r.attempt_id: r for r in blocks.measured(plans, blocks.blocks(pcm, 16), 44100, 4, 2, 8, 16).collect()}
    assert [(got[i].status, got[i].failure_reason, got[i].fade_frames) for i in range(1, 7)] == [
        ("RENDERED", None, 50), ("RENDERED", None, 5), ("FAILED", "INSUFFICIENT_AUDIO", None), ("FAILED", "MISSING_TRACK", None), ("FAILED", "NO_PLAN", None), ("FAILED", "INSUFFICIENT_AUDIO", None)]
    whole = spark.createDataFrame([(stem(1, 100)[40:90], stem(2, 64)[3:53])], "a array<double>, b array<double>")
    want = whole.select(A.alignment(F.col("a"), F.col("b"), 4, 2, 44100).alias("h"), A.discontinuity_db(A.crossfaded(F.col("a"), F.col("b")), 8).alias("d")).first()
    assert (got[1].alignment_error_ms, got[1].alignment_correlation, got[1].energy_discontinuity_db) == (want.h.error_ms, want.h.correlation, want.d)
    assert got[2].alignment_reason == "INSUFFICIENT_ONSETS"


def test_mix_equals_appending_stem_after_stem(spark, pcm):
    # 1 for 60 samples, then 2 from its sample 5 with a fade of 12, then 3 from its sample 8 after 30 more
    first = spark.createDataFrame([(stem(1, 100), stem(2, 64), stem(3, 130))], "a array<double>, b array<double>, c array<double>")
    i = lambda n: F.lit(n)
    two = first.select("c", A.appended(F.col("a"), F.col("b"), i(60), i(5), i(12), i(0)).alias("m"))
    want = two.select(A.appended(F.col("m"), F.col("c"), i(90), i(8), i(12), i(72)).alias("m")).first().m
    line = spark.createDataFrame(
        [(7, 1, 1, 0, 0, 72, 0, 12), (7, 2, 2, 55, 60, 102, 12, 12), (7, 3, 3, 82, 90, 212, 12, 0), (8, 1, 2, 0, 0, 64, 0, 0)],
        "session_id bigint, step int, track_id bigint, offset bigint, start bigint, stop bigint, fade_in bigint, fade_out bigint",
    )
    for size in (16, 50, 1000):
        rows = sorted(blocks.mixed(line, blocks.blocks(pcm, size), size).collect(), key=lambda r: (r.session_id, r.block))
        got = {s: [v for r in rows if r.session_id == s for v in r.x] for s in (7, 8)}
        assert len(got[7]) == len(want) == 212 and np.allclose(got[7], want, atol=1e-12) and got[8] == stem(2, 64)
        assert max(len(r.x) for r in rows) <= size
    loud = blocks.mixed(line, blocks.blocks(pcm.withColumn("samples", F.transform("samples", lambda v: v * 3)), 16), 16)
    safe = blocks.protected(loud).collect()
    assert max(abs(v) for r in safe for v in r.x) == 1.0 and all(r.clipped for r in safe)


def test_timeline_and_transitions_of_chained_sessions(spark):
    rows = [(1, 1, 10, 0.0, 3.0, "READY", 0, 0, 300, 20, True), (1, 2, 11, 2.8, 6.0, "READY", 250, 280, 600, 20, False), (2, 1, 12, 0.0, 1.0, "FAILED", 0, 0, 100, 20, False)]
    chain = spark.createDataFrame(rows, "seed_id bigint, step int, track_id bigint, start_seconds double, end_seconds double, status string, offset bigint, start_sample bigint, stop_sample bigint, fade_frames bigint, fades_out boolean")
    line = sorted(map(tuple, blocks.session_timeline(chain).collect()))
    assert line == [(1, 1, 10, 0, 0, 300, 0, 20), (1, 2, 11, 250, 280, 600, 20, 0)]
    assert [tuple(r) for r in blocks.session_transitions(chain, 100).collect()] == [(1, 1, 10, 11, 2.8, 3.0)]


def vocoder(y, ratio, size=2048):
    """One frame after the other."""
    hop, window = size // 4, np.hanning(size)
    padded = np.pad(y, size // 2)
    s = np.array([np.fft.rfft(padded[i * hop : i * hop + size] * window) for i in range(1 + len(y) // hop)])
    times = [k * ratio for k in range(len(s) * 3) if k * ratio < len(s) - 1]
    advance, phase = 2 * np.pi * hop * np.arange(size // 2 + 1) / size, np.angle(s[0])
    out, norm = np.zeros(len(times) * hop + size), np.zeros(len(times) * hop + size)
    for k, t in enumerate(times):
        i, f = int(t), t - int(t)
        out[k * hop : k * hop + size] += np.fft.irfft(((1 - f) * abs(s[i]) + f * abs(s[i + 1])) * np.exp(1j * phase), size) * window
        norm[k * hop : k * hop + size] += window**2
        turn = np.angle(s[i + 1]) - np.angle(s[i]) - advance
        phase = phase + advance + turn - 2 * np.pi * np.round(turn / (2 * np.pi))
    n = int(np.rint(len(y) / ratio))
    return np.pad((out / np.maximum(norm, 1e-3))[size // 2 :], (0, n))[:n]


@pytest.mark.parametrize("ratio", [0.9, 0.97, 1.0, 1.05, 1.37])
@pytest.mark.parametrize("n", [0, 1, 700, 5000, 30000])
def test_stretch_in_pieces_equals_the_whole(ratio, n):
    y = np.random.default_rng(n).uniform(-0.9, 0.9, n)
    want = y if ratio == 1 else vocoder(y, ratio)
    for piece in (100, 513, 4096, 10**6):
        one = K.Stretcher(ratio)
        got = np.concatenate([*[one.feed(y[i : i + piece]) for i in range(0, n, piece)], one.finish()])
        assert len(got) == int(np.rint(n / ratio)) and np.allclose(got, want, atol=1e-6)


def test_blocks_are_stretched_across_their_borders(spark):
    lengths = {1: 9000, 2: 40, 3: 5000, 4: 3000, 5: 3000, 6: 3000, 7: 0}
    sounds = {i: stem(i, n) for i, n in lengths.items()}
    pcm = spark.createDataFrame([*sounds.items(), (8, None)], PCM)
    ratios = {1: 1.05, 2: 0.95, 3: 1.0, 4: 0.0, 5: -1.0, 6: float("nan"), 7: 1.1, 8: 1.1, 9: 1.1}
    found = blocks.stretched(blocks.blocks(pcm, 1000), spark.createDataFrame([*ratios.items(), (None, 1.0)], "track_id bigint, stretch_ratio double"), 1000)
    rows = sorted(found.collect())
    assert {r.track_id for r in rows} == {1, 2, 3} and max(len(r.x) for r in rows) == 1000
    for i in (1, 2, 3):
        mine = [r for r in rows if r.track_id == i]
        assert [r.block for r in mine] == list(range(len(mine))) and all(len(r.x) == 1000 for r in mine[:-1])
        assert np.allclose([v for r in mine for v in r.x], sounds[i] if i == 3 else vocoder(np.array(sounds[i]), ratios[i]), atol=1e-6)
    assert blocks.stretched(blocks.blocks(pcm, 1000).limit(0), found.selectExpr("track_id", "1.0D as stretch_ratio").limit(0)).count() == 0
