"""Strategy comparison: summaries, distributions, blind pairs and ratings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.quantiles import group_quantiles
from tessera.functions.stats import sign_test
from tessera.operators.select import seeded

METRICS = ("bpm_delta", "stretch_percent_a", "stretch_percent_b", "alignment_error_ms", "alignment_correlation", "energy_discontinuity_db", "region_stability_a", "region_stability_b", "planning_seconds", "render_seconds", "measurement_seconds")


def attempts_summary(attempts: DataFrame) -> DataFrame:
    ok = F.col("status") == "RENDERED"
    out = attempts.groupBy("strategy").agg(F.count("*").alias("attempts"), F.count_if(ok).alias("successes"))
    return out.withColumns({"success_rate": F.col("successes") / F.col("attempts"), "failure_rate": 1 - F.col("successes") / F.col("attempts")})


def failure_reasons(attempts: DataFrame) -> DataFrame:
    return attempts.where("status <> 'RENDERED'").groupBy("strategy", "failure_reason").agg(F.count("*").alias("n"))


def analysis_failure_rate(tracks: DataFrame) -> DataFrame:
    failed, done = F.count_if(F.col("analysis_status") == "FAILED"), F.count_if(F.col("analysis_status") == "COMPLETE")
    return tracks.agg(failed.alias("failed"), done.alias("completed"), F.try_divide(failed, failed + done).alias("failure_rate"))


def distributions(rows: DataFrame, groups: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """groups, metric, count, missing, min, p50, p95, p99, max; null and non-finite values are missing, never zero."""
    groups = list(groups)
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("x")
    long = rows.select(*groups, pairs).select(*groups, "x.*")
    finite = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf"))
    value = F.when(finite, F.col("value"))
    counts = long.groupBy(*groups, "metric").agg(F.count(value).alias("count"), (F.count("*") - F.count(value)).alias("missing"), F.min(value).alias("min"), F.max(value).alias("max"))
    q = group_quantiles(long, [*groups, "metric"], "value", [0.5, 0.95, 0.99])
    out = counts.join(q.drop("n"), [*groups, "metric"], "left")
    return out.select(*groups, "metric", "count", "missing", "min", F.col("q")[0].alias("p50"), F.col("q")[1].alias("p95"), F.col("q")[2].alias("p99"), "max")


def blind_pairs(pairs: DataFrame, seed: int, excerpt_seconds: float = 15.0) -> DataFrame:
    """Codebook rows for pairs (index; B and D renders as structs with status, sample_rate, frames, fade_start_sample, fade_frames): X and Y by a seeded coin, context cut to what both have."""
    b, d = F.col("b"), F.col("d")
    context = F.rint(excerpt_seconds * b["sample_rate"]).cast("long")
    after = lambda r: r["frames"] - r["fade_start_sample"] - r["fade_frames"]
    failed = (b["status"] != "RENDERED") | (d["status"] != "RENDERED")
    coin = F.conv(F.substring(seeded(seed, F.col("index")), 1, 1), 16, 10).cast("int") < 8
    pre, post = F.least(context, b["fade_start_sample"], d["fade_start_sample"]), F.least(context, after(b), after(d))
    return pairs.select(
        "index", F.format_string("pair_%03d", F.col("index") + 1).alias("pair_id"), F.when(failed, "PAIR_RENDER_FAILED").alias("failure_reason"),
        F.when(~failed, F.when(coin, "B").otherwise("D")).alias("x"), F.when(~failed, F.when(coin, "D").otherwise("B")).alias("y"),
        F.when(~failed, pre / b["sample_rate"]).alias("pre_seconds"), F.when(~failed, post / b["sample_rate"]).alias("post_seconds"),
    )


def export_report(codebook: DataFrame, requested: int) -> DataFrame:
    ok = F.count_if(F.col("failure_reason").isNull())
    return codebook.agg(F.lit(requested).cast("bigint").alias("requested"), F.count("*").alias("attempted"), ok.alias("exported"), F.greatest(F.lit(0).cast("bigint"), F.lit(requested) - ok).alias("shortfall"))


def rating_rows(codebook: DataFrame, listeners: int) -> DataFrame:
    """Blank rating sheet: each pair once for each of a few listeners."""
    names = F.explode(F.array(*[F.lit(f"listener_{i + 1}") for i in range(listeners)]))
    blank = {f"{d}_{s}": F.lit(None).cast("int") for d in ("smoothness", "rhythm", "energy") for s in "XY"}
    return codebook.where("failure_reason is null").select(names.alias("listener_id"), "pair_id").withColumns({**blank, "preference": F.lit(None).cast("string")})


def invalid_ratings(ratings: DataFrame, codebook: DataFrame) -> DataFrame:
    """Rows that are no votes, with the first reason: unknown pair, no listener, one twice, no preference, a score outside 1 to 5."""
    scores = [c for c in ratings.columns if c.split("_")[0] in ("smoothness", "rhythm", "energy")]
    listener = F.trim(F.coalesce("listener_id", F.lit("")))
    again = F.count("*").over(Window.partitionBy("pair_id", listener)) > 1
    bad_score = F.lit(False)
    for c in scores:
        bad_score = bad_score | ~F.coalesce(F.col(c).between(1, 5), F.lit(False))
    rows = ratings.withColumn("__again", again).join(codebook.select("pair_id", F.lit(True).alias("__known")), "pair_id", "left")
    reason = F.when(F.col("__known").isNull(), "UNKNOWN_PAIR").when(listener == "", "NO_LISTENER").when(F.col("__again"), "DUPLICATE").when(~F.coalesce(F.col("preference").isin("X", "Y", "tie"), F.lit(False)), "NO_PREFERENCE").when(bad_score, "BAD_SCORE")
    return rows.withColumn("reason", reason).where("reason is not null").drop("__known", "__again")


def pair_votes(ratings: DataFrame, codebook: DataFrame, minimum: int = 3) -> DataFrame:
    """Each pair's outcome: 1 for D, -1 for B, 0 for a tie, null with too few listeners.  The pair is the unit, not the vote."""
    chosen = F.when(F.col("preference") == "X", F.col("x")).when(F.col("preference") == "Y", F.col("y"))
    vote = F.when(F.col("preference").isNull(), F.lit(None)).when(F.col("preference") == "tie", 0).when(chosen == "D", 1).otherwise(-1)
    votes = codebook.select("pair_id", "x", "y").join(ratings.select("pair_id", "listener_id", "preference"), "pair_id", "left").withColumn("vote", vote)
    per = votes.groupBy("pair_id").agg(F.sum("vote").alias("sum"), F.count_distinct("listener_id").alias("listeners"))
    return per.withColumn("outcome", F.when(F.col("listeners") >= minimum, F.signum(F.coalesce("sum", F.lit(0)).cast("double")).cast("int")))


def preference_report(votes: DataFrame) -> DataFrame:
    n = lambda k: F.count_if(F.col("outcome") == k)
    out = votes.agg(F.count_if(F.col("listeners") > 0).alias("rated_pairs"), F.count("outcome").alias("eligible_pairs"), F.count_if(F.col("outcome").isNull()).alias("insufficient_pairs"), n(1).alias("d_wins"), n(-1).alias("b_wins"), n(0).alias("ties"))
    return out.withColumn("p", sign_test(F.col("d_wins"), F.col("b_wins")))


def rating_deltas(ratings: DataFrame, codebook: DataFrame) -> DataFrame:
    """Distribution of D minus B for each scored dimension."""
    rows = ratings.join(codebook.select("pair_id", "x"), "pair_id")
    sign = F.when(F.col("x") == "D", 1).otherwise(-1)
    dims = ("smoothness", "rhythm", "energy")
    rows = rows.select(*[(sign * (F.col(f"{d}_X") - F.col(f"{d}_Y"))).cast("double").alias(f"{d}_D_minus_B") for d in dims])
    return distributions(rows, [], [f"{d}_D_minus_B" for d in dims])


def united(*runs: DataFrame) -> DataFrame:
    """Attempts of several runs (the ladder, the pairs) as one table; a column that a run has not got is null there."""
    out = runs[0]
    for r in runs[1:]:
        out = out.unionByName(r, allowMissingColumns=True)
    return out


def summarize(attempts: DataFrame, metrics: Sequence[str] = METRICS) -> DataFrame:
    """One row for each strategy: attempts, successes, rates, failures_by_reason (a map of counts) and distributions (metric -> its figures).

    A metric that ``attempts`` has no column for is missing in every attempt.
    Failures without a reason count as UNSTATED.  Reasons are codes, so the map is
    small; it is made of counts.  No attempts give no rows.
    """
    here = attempts.withColumns({m: F.lit(None).cast("double") for m in metrics if m not in attempts.columns}) if set(metrics) - set(attempts.columns) else attempts
    entry = lambda key, value: F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, value))))
    reasons = failure_reasons(here.withColumn("failure_reason", F.coalesce("failure_reason", F.lit("UNSTATED")))).groupBy("strategy").agg(entry("failure_reason", "n").alias("failures_by_reason"))
    figures = F.struct("count", "missing", "min", "p50", "p95", "p99", "max").alias("figures")
    spread = distributions(here, ["strategy"], metrics).groupBy("strategy").agg(entry("metric", figures).alias("distributions"))
    out = attempts_summary(here).join(reasons, "strategy", "left").join(spread, "strategy", "left")
    return out.withColumn("failures_by_reason", F.coalesce("failures_by_reason", F.create_map().cast("map<string,bigint>")))
