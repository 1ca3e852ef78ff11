"""Agreement and correlation between true and predicted positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gradeloom.functions.levels import MAX_ORD
from gradeloom.operators.metrics import KEYS, ratio
from gradeloom.operators.scale import join_per_key, running_mass
from gradeloom.session import written


def _cells(cm: DataFrame, keys) -> DataFrame:
    """One array of ``(t, p, n)`` per group; at most one entry per label pair."""
    return cm.groupBy(*keys).agg(
        F.collect_list(F.struct(F.col("true_ord").alias("t"), F.col("pred_ord").alias("p"), F.col("n").cast("double").alias("n"))).alias("cells")
    )


def _sum(items: Column, f) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda acc, c: acc + f(c))


def _marginal(side: str, k: int) -> Column:
    return _sum(F.col("cells"), lambda c: F.when(c[side] == k, c["n"]).otherwise(F.lit(0.0)))


def quadratic_kappa(cm: DataFrame, keys=KEYS, top: int = MAX_ORD) -> DataFrame:
    """Cohen's kappa with squared distance weights."""
    n = _sum(F.col("cells"), lambda c: c["n"])
    margins = _cells(cm, keys).select(
        *keys, "cells", n.alias("total"),
        F.array(*[_marginal("t", k) for k in range(top + 1)]).alias("rows"),
        F.array(*[_marginal("p", k) for k in range(top + 1)]).alias("cols"),
    )
    observed = _sum(F.col("cells"), lambda c: c["n"] * (c["t"] - c["p"]) * (c["t"] - c["p"]))
    expected = F.lit(0.0)
    for i in range(top + 1):
        for j in range(top + 1):
            if i != j:
                expected = expected + F.lit(float((i - j) ** 2)) * F.get("rows", F.lit(i)) * F.get("cols", F.lit(j))
    scored = margins.select(*keys, observed.alias("o"), (expected / F.col("total")).alias("e"))
    return scored.select(*keys, F.when(F.col("e") == 0, F.lit(1.0)).otherwise(1.0 - F.try_divide(F.col("o"), F.col("e"))).alias("qwk"))


def gwet_ac2(cm: DataFrame, keys=KEYS, top: int = MAX_ORD) -> DataFrame:
    """Gwet's AC2 with quadratic weights over the whole scale."""
    q = top + 1
    weight = lambda d: 1.0 - (d * d) / F.lit(float(top * top))
    weight_total = sum(1.0 - (i - j) ** 2 / top**2 for i in range(q) for j in range(q))
    agreed = _sum(F.col("cells"), lambda c: c["n"] * weight((c["t"] - c["p"]).cast("double")))
    n = _sum(F.col("cells"), lambda c: c["n"])
    shares = _cells(cm, keys).select(
        *keys, agreed.alias("agreed"), n.alias("total"),
        F.array(*[(_marginal("t", k) + _marginal("p", k)) / 2 for k in range(q)]).alias("mid"),
    )
    spread = F.aggregate(F.col("mid"), F.lit(0.0), lambda acc, m: acc + (m / F.col("total")) * (1.0 - m / F.col("total")))
    chance = F.lit(weight_total / (q * (q - 1))) * spread
    pa = F.col("agreed") / F.col("total")
    return shares.select(*keys, pa.alias("pa"), chance.alias("pe")).select(
        *keys, F.coalesce(F.try_divide(F.col("pa") - F.col("pe"), 1.0 - F.col("pe")), F.lit(1.0)).alias("ac2")
    )


def continuous_errors(predictions: DataFrame, keys=("model", "dataset")) -> DataFrame:
    """RMSE and share within one level of the expected position."""
    gap = F.col("expected_value") - F.col("true_ord")
    return predictions.groupBy(*keys).agg(
        F.sqrt(F.avg(gap * gap)).alias("rmse"),
        F.avg((F.abs(gap) <= 1).cast("double")).alias("within1"),
    )


BUCKETS = 256
# The buckets' bounds of up to this many groups (20 MB) are broadcast, counted first.
MAX_GROUPS = 10_000


def spearman(predictions: DataFrame, keys=("model", "dataset"), x: str = "true_ord", y: str = "expected_value") -> DataFrame:
    """Rank correlation with average ranks for ties.

    Ranks are looked up per distinct value: values are counted, mass above each
    value comes from bucketed running sums, and the correlation is taken over
    the counted (x, y) pairs.
    """
    keys = list(keys)
    pairs = predictions.groupBy(*keys, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).agg(
        F.count(F.lit(1)).alias("n")
    )
    pairs = written(pairs, "rank-pairs")  # ranked along both axes and read once more

    n_groups = pairs.select(*keys).distinct().count() if keys else 1

    def ranks(column: str) -> DataFrame:
        counted = pairs.groupBy(*keys, column).agg(F.sum("n").alias("n"))
        # Buckets of about as many distinct values each, whatever their range.
        cuts = counted.groupBy(*keys).agg(F.percentile_approx(column, [k / BUCKETS for k in range(1, BUCKETS)]).alias("cuts"))
        counted = join_per_key(counted, cuts, keys, [column], n_groups, "inner", MAX_GROUPS) if keys else counted.join(F.broadcast(cuts))  # one row
        bucket = F.size(F.filter("cuts", lambda cut: cut < F.col(column)))
        ranked = running_mass(counted.withColumn("at", bucket).drop("cuts"), keys, column, "n", F.col("at"))
        average = F.col("above") + (F.col("n") + 1) / 2
        return ranked.select(*keys, column, average.alias(f"r{column}"))

    joined = pairs.join(ranks("x"), keys + ["x"]).join(ranks("y"), keys + ["y"])
    n, sx, sy = F.sum("n"), F.sum(F.col("n") * F.col("rx")), F.sum(F.col("n") * F.col("ry"))
    sums = joined.groupBy(*keys).agg(
        n.alias("n"), sx.alias("sx"), sy.alias("sy"),
        F.sum(F.col("n") * F.col("rx") * F.col("rx")).alias("sxx"),
        F.sum(F.col("n") * F.col("ry") * F.col("ry")).alias("syy"),
        F.sum(F.col("n") * F.col("rx") * F.col("ry")).alias("sxy"),
    )
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")
    vx = F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n")
    vy = F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")
    return sums.select(*keys, ratio(cov, F.sqrt(vx * vy)).alias("spearman"))
