"""One report of a comparison against numpy's figures."""

import numpy as np

from tessera.operators import evaluation


def test_summary_of_united_runs(spark):
    ladder = [("A", "RENDERED", None, 5.0), ("A", "FAILED", "NO_PLAN", None), ("A", "FAILED", None, float("nan")), ("B", "RENDERED", None, 9.5), ("B", "RENDERED", None, 1.5), ("B", "RENDERED", None, float("inf"))]
    paired = [("B", "FAILED", "NO_PLAN", 0.25), ("D", "FAILED", "NO_PLAN", None), ("D", "FAILED", "NO_PLAN", None), ("D", "FAILED", "STEM", None)]
    both = evaluation.united(
        spark.createDataFrame(ladder, "strategy string, status string, failure_reason string, alignment_error_ms double"),
        spark.createDataFrame(paired, "strategy string, status string, failure_reason string, render_seconds double"),
    )
    assert both.count() == 10
    rows = {r.strategy: r for r in evaluation.summarize(both).collect()}
    assert {k: (r.attempts, r.successes, r.failures_by_reason) for k, r in rows.items()} == {"A": (3, 1, {"NO_PLAN": 1, "UNSTATED": 1}), "B": (4, 3, {"NO_PLAN": 1}), "D": (3, 0, {"NO_PLAN": 2, "STEM": 1})}
    assert rows["B"].success_rate == 0.75 and rows["B"].failure_rate == 0.25
    for r in rows.values():
        assert sorted(r.distributions) == sorted(evaluation.METRICS) and all(d["count"] + d["missing"] == r.attempts for d in r.distributions.values())
    b = rows["B"].distributions["alignment_error_ms"]
    assert (b["count"], b["missing"], b["min"], b["max"]) == (2, 2, 1.5, 9.5)
    assert np.allclose([b["p50"], b["p95"], b["p99"]], np.percentile([1.5, 9.5], [50, 95, 99]))
    none = rows["D"].distributions["bpm_delta"]
    assert none["count"] == 0 and none["p50"] is None and none["max"] is None
    assert rows["B"].distributions["render_seconds"]["p50"] == 0.25
    assert evaluation.summarize(both.limit(0)).count() == 0
