"""Evidence synthesis: pooling, heterogeneity, subgroups, sensitivity and bias.

All operators work on tables of effects, one row a study: columns `t` (effect) and `v` (its variance), grouped by any
keys. Sums by key have partial aggregation and no operator pairs studies with each other.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import distributions
from ..functions.proportions import Z95, clip01, double_arcsine, from_double_arcsine, log_ratio_error
from .ranking import quantiles


def proportion_effects(studies: DataFrame, p: str = "p", n: str = "n") -> DataFrame:
    """Adds t and v; p is clipped to [0, 1] and n is at least 1 for both, the columns themselves stay."""
    size = F.greatest(F.col(n), F.lit(1)).cast("double")
    return studies.where(F.col(p).isNotNull() & F.col(n).isNotNull()).withColumns({"t": double_arcsine(clip01(F.col(p)), size), "v": 1.0 / (size + 1)})


def ratio_effects(studies: DataFrame, hr: str = "hr", low: str = "lo", high: str = "hi") -> DataFrame:
    """Adds t (log ratio) and v from the 95 % interval."""
    return studies.dropna(subset=[hr, low, high]).withColumns({"t": F.log(hr), "v": F.pow(log_ratio_error(F.col(low), F.col(high)), F.lit(2.0))})


def pool(effects: DataFrame, by: list[str] = [], back: str = "proportion") -> DataFrame:  # noqa: B006
    """Fixed and DerSimonian-Laird random effects by key: k, q, df, p_heterogeneity, i2, tau2, pooled values and 95 % intervals."""
    if not by:
        effects = effects.withColumn("_all", F.lit(1))
    keys = by or ["_all"]
    w = 1 / F.col("v")
    first = effects.groupBy(*keys).agg(F.count("*").alias("k"), F.sum(w).alias("w1"), F.sum(w * w).alias("w2"), (F.sum(w * F.col("t")) / F.sum(w)).alias("t_fixed"))
    # Deviations from the pooled effect in a second pass: algebra on power sums would cancel.
    second = effects.join(first.select(*keys, "t_fixed"), keys).groupBy(*keys).agg(F.sum(w * F.pow(F.col("t") - F.col("t_fixed"), F.lit(2.0))).alias("q"))
    df = F.col("k") - 1
    stats = first.join(second, keys).withColumns({
        "df": df,
        "i2": F.when((F.col("q") > df) & (df > 0), (F.col("q") - df) / F.col("q") * 100).otherwise(0.0),
        "tau2": F.when(F.col("k") > 1, F.greatest(F.lit(0.0), (F.col("q") - df) / (F.col("w1") - F.col("w2") / F.col("w1")))).otherwise(0.0),
    })
    wr = 1 / (F.col("v") + F.col("tau2"))
    third = effects.join(stats.select(*keys, "tau2"), keys).groupBy(*keys).agg(F.sum(wr).alias("wr"), (F.sum(wr * F.col("t")) / F.sum(wr)).alias("t_random"))
    out = stats.join(third, keys).withColumns({"se_fixed": F.sqrt(1 / F.col("w1")), "se_random": F.sqrt(1 / F.col("wr"))})
    inverse = from_double_arcsine if back == "proportion" else F.exp if back == "ratio" else (lambda c: c)
    columns = {"p_heterogeneity": distributions.chi2_tail_column(F.col("q"), F.col("df"))}
    for kind in ("fixed", "random"):
        t, se = F.col(f"t_{kind}"), F.col(f"se_{kind}")
        columns |= {kind: inverse(t), f"{kind}_lo": inverse(t - Z95 * se), f"{kind}_hi": inverse(t + Z95 * se)}
    return out.withColumns(columns).drop("w1", "w2", "wr", "_all")


def with_z_test(pooled: DataFrame) -> DataFrame:
    """Adds z of the random effect and its two-sided p-value."""
    z = F.when(F.col("se_random") > 0, F.col("t_random") / F.col("se_random")).otherwise(0.0)
    return pooled.withColumn("z", z).withColumn("p_value", distributions.normal_two_sided_column(F.col("z")))


def study_weights(effects: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Each study's share of the fixed and random weights, in percent, and its own interval (of the back-transformed effect)."""
    if not by:
        effects = effects.withColumn("_all", F.lit(1))
    keys = by or ["_all"]
    stats = pool(effects, keys, back="none").select(*keys, "tau2")
    joined = effects.join(stats, keys)
    over = Window.partitionBy(*keys)
    wf, wr = 1 / F.col("v"), 1 / (F.col("v") + F.col("tau2"))
    se = F.sqrt("v")
    return joined.withColumns({"weight_fixed": wf / F.sum(wf).over(over) * 100, "weight_random": wr / F.sum(wr).over(over) * 100, "ci_lower": from_double_arcsine(F.col("t") - Z95 * se), "ci_upper": from_double_arcsine(F.col("t") + Z95 * se)}).drop("tau2", "_all")


def explode_groups(studies: DataFrame, column: str, into: str, skip: tuple[str, ...] = ("Unspecified", "Unknown", "")) -> DataFrame:
    """One row for each of the "; "-separated values of a column, but those of skip."""
    return studies.withColumn(into, F.explode(F.split(column, ";"))).withColumn(into, F.trim(into)).where(~F.col(into).isin(*skip))


def leave_one_out(effects: DataFrame, study: str, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Pooled random effect without each study in turn, from each group's power sums less the study's own part.
    Groups of fewer than three studies give none. (The sums take t less the group's mean, which keeps them accurate.)"""
    if not by:
        effects = effects.withColumn("_all", F.lit(1))
    keys = by or ["_all"]
    over = Window.partitionBy(*keys)
    d = F.col("t") - F.avg("t").over(over)
    rows = effects.withColumns({"_d": d, "_mean": F.avg("t").over(over), "_w": 1 / F.col("v"), "_k": F.count("*").over(over)}).where("_k >= 3")
    less = lambda c: F.sum(c).over(over) - c
    rows = rows.withColumns({"_s0": less(F.col("_w")), "_s1": less(F.col("_w") * F.col("_d")), "_s2": less(F.col("_w") * F.col("_d") * F.col("_d")), "_ww": less(F.col("_w") * F.col("_w"))})
    q = F.col("_s2") - F.col("_s1") * F.col("_s1") / F.col("_s0")
    df = F.col("_k") - 2
    rows = rows.withColumns({"q": q, "_df": df}).withColumn("tau2", F.greatest(F.lit(0.0), (F.col("q") - F.col("_df")) / (F.col("_s0") - F.col("_ww") / F.col("_s0"))))
    rows = rows.withColumn("i2", F.when((F.col("q") > F.col("_df")) & (F.col("_df") > 0), (F.col("q") - F.col("_df")) / F.col("q") * 100).otherwise(0.0))
    # The random weights depend on the excluded study's own tau2: each group's sums over all its studies, less that study,
    # by blocks of excluded studies in arrays. A group comes as four numbers a study.
    columns = [*keys, study, "k_remaining", "tau2", "i2", "pooled", "lo", "hi"]
    types = dict(effects.dtypes) | dict.fromkeys(columns[len(keys) + 1 :], "double") | {"k_remaining": "bigint"}

    def pooled(group: pd.DataFrame) -> pd.DataFrame:
        t, v, tau2 = (group[c].to_numpy() for c in ("t", "v", "tau2"))
        mean, se = np.empty(len(t)), np.empty(len(t))
        for at in range(0, len(t), 256):
            own = np.arange(at, min(at + 256, len(t)))
            w = 1 / (v[None, :] + tau2[own, None])
            w[np.arange(len(own)), own] = 0.0
            total = w.sum(axis=1)
            mean[own], se[own] = (w * t).sum(axis=1) / total, np.sqrt(1 / total)
        back = lambda x: np.sin(x / 2) ** 2
        group = group.assign(k_remaining=len(t) - 1, pooled=back(mean), lo=back(mean - Z95 * se), hi=back(mean + Z95 * se))
        return group[columns]

    return rows.select(*keys, study, "t", "v", "tau2", "i2").groupBy(*keys).applyInPandas(pooled, ", ".join(f"`{c}` {types.get(c, 'int')}" for c in columns)).drop("_all")


def egger(effects: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Regression of t/se on 1/se. `intercept_se` is the slope's standard error, as the field is commonly filled;
    `true_intercept_se` is the intercept's own. Groups of fewer than three studies give none."""
    se = F.sqrt("v")
    rows = effects.where("v > 0").withColumns({"_y": F.col("t") / se, "_x": 1 / se})
    n = F.col("n_studies")
    out = rows.groupBy(*by).agg(F.count("*").alias("n_studies"), F.regr_slope("_y", "_x").alias("slope"), F.regr_intercept("_y", "_x").alias("intercept"), F.regr_sxx("_y", "_x").alias("_sxx"), F.regr_syy("_y", "_x").alias("_syy"), F.regr_sxy("_y", "_x").alias("_sxy"), F.avg("_x").alias("_mx"))
    rest = (F.col("_syy") - F.col("_sxy") * F.col("_sxy") / F.col("_sxx")) / (n - 2)
    out = out.where("n_studies >= 3").withColumn("intercept_se", F.sqrt(rest / F.col("_sxx")))
    out = out.withColumn("true_intercept_se", F.col("intercept_se") * F.sqrt(F.col("_sxx") / n + F.col("_mx") * F.col("_mx")))
    t = F.when(F.col("intercept_se") > 0, F.col("intercept") / F.col("intercept_se")).otherwise(0.0)
    out = out.withColumn("t_stat", t).withColumn("p_value", distributions.t_two_sided_column(F.col("t_stat"), n - 2))
    return out.withColumn("bias_detected", F.col("p_value") < 0.10).drop("_sxx", "_syy", "_sxy", "_mx")


def kendall_tau(rows: DataFrame, x: Column, y: Column, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Tau-b with ties and its two-sided p-value. Each group of studies comes as two numbers a study and is counted by a
    sort and a merge, without its pairs. Rows without x or y are left out."""
    if not by:
        rows = rows.withColumn("_all", F.lit(1))
    keys = by or ["_all"]
    types = dict(rows.dtypes)

    def counted(group: pd.DataFrame) -> pd.DataFrame:
        a, b = group["_x"].to_numpy(), group["_y"].to_numpy()
        n = len(a)
        pairs = n * (n - 1) // 2
        order = np.lexsort((b, a))
        both = np.unique(np.column_stack([a, b]), axis=0, return_counts=True)[1]
        tied = [_ties(np.unique(v, return_counts=True)[1]) for v in (a, b)]
        open_ = pairs - tied[0][0] - tied[1][0] + _ties(both)[0]
        s = open_ - 2 * _inversions(b[order])
        nx, ny = pairs - tied[0][0], pairs - tied[1][0]
        tau = s / math.sqrt(nx * ny) if nx * ny > 0 else None
        p = distributions.kendall_two_sided(s, n, *tied) if tau is not None else None
        return pd.DataFrame([(*(group[k].iloc[0] for k in keys), s, n, pairs, tau, p)], columns=[*keys, "s", "n_studies", "pairs", "tau", "p_value"])

    base = rows.select(*keys, x.cast("double").alias("_x"), y.cast("double").alias("_y")).dropna(subset=["_x", "_y"])
    return base.groupBy(*keys).applyInPandas(counted, ", ".join([*(f"`{k}` {types.get(k, 'int')}" for k in keys), "s double, n_studies long, pairs long, tau double, p_value double"])).drop("_all")


def _ties(counts: np.ndarray) -> tuple[int, int, int]:
    t = counts.astype(np.int64)
    return int((t * (t - 1) // 2).sum()), int((t * (t - 1) * (t - 2)).sum()), int((t * (t - 1) * (2 * t + 5)).sum())


def _inversions(v: np.ndarray) -> int:
    """Pairs that stand in falling order, by merging ever longer sorted runs."""
    rank = np.unique(v, return_inverse=True)[1].astype(np.int64)
    n, width, found = len(rank), 1, 0
    while width < n:
        run = np.arange(n) // (2 * width)
        left = (np.arange(n) // width) % 2 == 0
        order = np.lexsort((rank, run))
        # For each right-hand value, the left-hand values of its run that are larger.
        lefts = np.cumsum(left[order])
        of_run, first = run[order], np.searchsorted(run[order], run[order])
        ends = np.searchsorted(of_run, of_run, "right")
        base = np.where(first > 0, lefts[first - 1], 0)
        total = lefts[ends - 1] - base
        # lexsort is stable: equal left-hand values come before the right-hand one and don't count.
        found += int((total - (lefts - base))[~left[order]].sum())
        rank = rank[order]
        width *= 2
    return found


def begg(effects: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Kendall's tau of t/se with the variance; groups of fewer than four studies give none."""
    return kendall_tau(effects.where("v > 0"), F.col("t") / F.sqrt("v"), F.col("v"), by).where("n_studies >= 4").withColumn("bias_detected", F.col("p_value") < 0.10)


def funnel(effects: DataFrame) -> DataFrame:
    """Effect and standard error of each study."""
    return effects.withColumn("se", F.sqrt("v"))


def describe(rows: DataFrame, column: str, by: list[str] = []) -> DataFrame:  # noqa: B006
    """n, median, mean, min, max, sum of a column read as numbers; what isn't a number is left out."""
    x = F.col("_x")
    rows = rows.select(*by, F.col(column).try_cast("double").alias("_x"))
    sums = rows.groupBy(*by).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.min(x).alias("min"), F.max(x).alias("max"), F.sum(x).alias("sum"))
    middle = quantiles(rows, "_x", [0.5], by).withColumnRenamed("q0", "median")
    return sums.join(middle, by or None, "left").select(*by, "n", "median", "mean", "min", "max", "sum")


def value_counts(rows: DataFrame, column: str, sep: str | None = None) -> DataFrame:
    """How often each value stands, most frequent first, then by value; with sep for multi-valued columns."""
    value = F.explode(F.split(column, sep)) if sep else F.col(column)
    return rows.select(value.alias("value")).withColumn("value", F.trim("value")).where("value <> ''").groupBy("value").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "value")


def heat_map(rows: DataFrame, key: str, outcomes: list[str], order: str) -> DataFrame:
    """Mean of each outcome by key, rounded to one decimal and then times 100; keys without any outcome are left out."""
    means = rows.groupBy(key).agg(*[(F.bround(F.avg(c), 1) * 100).alias(c) for c in outcomes])
    return means.where(F.coalesce(*outcomes).isNotNull()).orderBy(F.col(order).desc_nulls_last(), key)


def subgroups(studies: DataFrame, column: str, into: str = "subgroup") -> DataFrame:
    """Proportions pooled for each value of a multi-valued column, but unspecified ones; most studies first."""
    return pool(proportion_effects(explode_groups(studies, column, into)), [into]).orderBy(F.col("k").desc(), into)


def year_trend(rows: DataFrame, year: str) -> DataFrame:
    """Rows a year with the least-squares line through the counts; the line only with more than two years."""
    counts = rows.groupBy(F.col(year).alias("year")).agg(F.count("*").alias("n"))
    line = counts.agg(F.regr_slope("n", "year").alias("slope"), F.regr_intercept("n", "year").alias("intercept"), F.count("*").alias("_k"))
    fit = F.when(F.col("_k") > 2, F.col("slope") * F.col("year") + F.col("intercept"))
    return counts.join(F.broadcast(line)).withColumn("trend", fit).drop("_k")
