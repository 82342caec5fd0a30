"""Paired preference statistics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sign_test(wins: Column, losses: Column) -> Column:
    """Exact two-sided binomial sign test: null without votes, an error for negative counts.

    Terms are summed by their ratios, starting at 2^-n in the log domain, so
    large counts neither overflow nor lose the small terms.
    """
    n, k = (wins + losses).cast("double"), F.least(wins, losses).cast("int")
    state = F.struct(F.lit(0.0).alias("total"), F.lit(0.0).alias("log"))

    def add(acc: Column, i: Column) -> Column:
        return F.struct((acc["total"] + F.exp(acc["log"] - n * F.log(F.lit(2.0)))).alias("total"), (acc["log"] + F.log(n - i) - F.log(i + 1.0)).alias("log"))

    # the ratio after the last term is not used; it is guarded only against log(0)
    safe = F.when(k > 0, F.sequence(F.lit(0), k - 1)).otherwise(F.array().cast("array<int>"))
    before = F.aggregate(safe, state, add)
    last = before["total"] + F.exp(before["log"] - n * F.log(F.lit(2.0)))
    p = F.least(F.lit(1.0), 2 * last)
    bad = F.raise_error(F.lit("counts must be nonnegative")).cast("double")
    return F.when((wins < 0) | (losses < 0), bad).when(n == 0, F.lit(None).cast("double")).otherwise(p)
