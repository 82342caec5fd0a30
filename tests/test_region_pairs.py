"""Plans of all pairs are made where the pairs are: nothing of a pair is shuffled or sorted."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.config import Settings, Tempo, Transition
from tessera.operators import select

CFG = Settings()


def library(spark, n, repeats=()):
    rng = random.Random(n)
    rows = [(i, rng.choice([90.0, 94.5, 128.0, round(rng.uniform(80, 180), 1)]), 180.0 + i % 3) for i in range(n)]
    tracks = spark.createDataFrame([*rows, (-1, None, 180.0), (-2, 0.0, 180.0), *repeats], "track_id bigint, native_bpm double, duration_seconds double").withColumn("energy", F.lit(0.5))
    tie = lambda: rng.choice([0.5, 0.5 + 3e-11, 0.75])
    regions = [(i, b, b + 8, t, t + 4, tie(), tie()) for i in range(-2, n) for b, t in ((8, 20.0), (16, 28.0), (40, 40.0), (160, 130.0), (176, 142.0), (200, 160.0)) if rng.random() < 0.5]
    return tracks, spark.createDataFrame(regions, "track_id bigint, start_beat int, end_beat int, start_time double, end_time double, score double, mean_energy double")


def by_pairs(t, r, cfg, tempo):
    pairs = select.tempo_pairs(select.seeds_of(t), t, tempo).where("track_id <> seed_id").select("seed_id", "track_id", "session_bpm", "stretch_ratio")
    return select.best_pair(select.region_pairs(pairs, select.in_window(r, t, cfg.outgoing), select.in_window(r, t, cfg.incoming), cfg, tempo), "seed_id", "track_id")


def rows(df):
    return sorted(tuple(r) for r in df.select("seed_id", "track_id", "out_start_beat", "in_start_beat", F.round("pair_cost", 8)).collect())


@pytest.mark.parametrize("repeats", [(), ((3, 128.0, 180.0), (3, 130.5, 180.0), (5, 92.0, 181.0))])
@pytest.mark.parametrize(("n", "tempo"), [(0, Tempo()), (120, Tempo()), (120, Tempo(1.0, 1.0))])
def test_equals_the_best_of_all_region_pairs(spark, n, tempo, repeats):
    t, r = library(spark, n, repeats)
    got = rows(select.planned_pairs(t, r, CFG.transition, tempo))
    assert got == rows(by_pairs(t, r, CFG.transition, tempo)) and (got or not n)


def test_other_weights(spark):
    t, r = library(spark, 80)
    cfg = Transition(weight_stability=0.0, weight_energy=1.0, weight_stretch=0.0, weight_position=0.0)
    assert rows(select.planned_pairs(t, r, cfg)) == rows(by_pairs(t, r, cfg, Tempo()))


def test_query_shuffles_no_pairs(spark, sf):
    from tessera.catalogue import QUERIES

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = QUERIES["plan_region_pairs"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines = plan.splitlines()
    after_the_join = "\n".join(lines[: next(i for i, line in enumerate(lines) if "Join" in line)])
    assert "Project" in after_the_join and not any(step in after_the_join for step in ("Exchange", "Aggregate", "Sort"))
