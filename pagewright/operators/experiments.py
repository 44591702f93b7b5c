"""Counterfactual estimates over many series. Every experiment holds at most its window of days."""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from pagewright.functions import numbers
from pagewright.operators import shapes

cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass(frozen=True)
class CausalRules:
    window_days: int = 90
    min_pre_days: int = 28
    min_post_days: int = 7
    max_missing_share: float = 0.1
    min_r2: float = 0.5


def _c(name: str) -> Column:
    return F.col(name)


def align_series(experiments: DataFrame, series: DataFrame, rules: CausalRules = CausalRules()) -> DataFrame:
    """Daily rows of each experiment's window: test and control value, null where a day is missing.

    ``experiments(exp, test, control, start)``, ``series(series, date, value)``. Each experiment lists its own days and
    meets the series by equality of name and day.
    """
    days = experiments.withColumn("date", F.explode(F.sequence(F.date_sub("start", rules.window_days), F.date_add("start", rules.window_days - 1))))
    values = lambda n: series.select(_c("series").alias(n), "date", _c("value").alias(f"{n}_value"))
    bounds = series.groupBy(_c("series").alias("test")).agg(F.min("date").alias("first"), F.max("date").alias("last"))
    return (
        days.join(bounds, "test").where("date BETWEEN first AND last").join(values("test"), ["test", "date"], "left").join(values("control"), ["control", "date"], "left")
        .select("exp", "date", _c("test_value").alias("y"), _c("control_value").alias("x"), (_c("date") >= _c("start")).alias("post"))
    )


def page_series_window(interventions: DataFrame, series: DataFrame, days: int = 28) -> DataFrame:
    """Daily page series around each change, by page and day."""
    wanted = interventions.withColumn("date", F.explode(F.sequence(F.date_sub("start", days), F.date_add("start", days - 1))))
    return wanted.join(series, ["page", "date"]).withColumn("post", _c("date") >= _c("start"))


def effect(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Least squares of y on x before, cumulative effect after, its spread widened by residual autocorrelation."""
    known = _c("x").isNotNull() & _c("y").isNotNull()
    pre, post = known & ~_c("post"), known & _c("post")
    x, y = F.when(pre, _c("x")), F.when(pre, _c("y"))
    fit = rows.groupBy(*keys).agg(
        F.count(x).alias("n"), F.count(F.when(post, 1)).alias("m"), F.count_if(~_c("post")).alias("pre_total"), F.count_if("post").alias("post_total"),
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.avg(x).alias("x_mean"), F.regr_sxx(y, x).alias("sxx"),
        (F.regr_syy(y, x) - F.regr_slope(y, x) * F.regr_sxy(y, x)).alias("sse"),
    )
    joined = rows.where(known).join(fit, keys)
    residual = _c("y") - (_c("intercept") + _c("slope") * _c("x"))
    # An experiment holds at most its window of days, so this window is small.
    w = W.partitionBy(*keys).orderBy("date")
    lagged = joined.where(~_c("post")).withColumn("e", residual).withColumn("e1", F.lag("e").over(w))
    rho = lagged.groupBy(*keys).agg((F.sum(_c("e") * _c("e1")) / F.when(F.sum(_c("e") * _c("e")) > 0, F.sum(_c("e") * _c("e")))).alias("rho"))
    after = joined.where("post").groupBy(*keys).agg(
        F.sum(residual).alias("estimate"), F.sum(_c("x") - _c("x_mean")).alias("spread"), F.sum(_c("intercept") + _c("slope") * _c("x")).alias("expected")
    )
    out = fit.join(rho, keys, "left").join(after, keys, "left")
    sd = F.sqrt(F.greatest(_c("sse"), F.lit(0.0)) / F.when(_c("n") > 2, _c("n") - 2))
    rho_c = F.coalesce(F.least(F.lit(0.9), F.greatest(F.lit(0.0), _c("rho"))), F.lit(0.0))
    var = sd * sd * (_c("m") + _c("m") * _c("m") / _c("n") + _c("spread") * _c("spread") / F.when(_c("sxx") > 0, _c("sxx")))
    total = F.sqrt(var * (1 + rho_c) / (1 - rho_c))
    half = numbers.t975(_c("n") - 2) * total
    return out.select(*keys, "n", "m", "pre_total", "post_total", "slope", "intercept", "r2", rho_c.alias("rho"), "estimate", "expected", total.alias("sd"),
                      (_c("estimate") - half).alias("lower"), (_c("estimate") + half).alias("upper"))


def autocorrelation(rows: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """Lag-1 autocorrelation per series, kept within [0, 0.9]; ``keys`` name bounded series."""
    mean = rows.groupBy(*keys).agg(F.avg(value).alias("_m"), F.count(value).alias("_n"))
    d = rows.join(mean, keys).withColumn("_d", _c(value) - _c("_m"))
    d = d.withColumn("_p", F.lag("_d").over(W.partitionBy(*keys).orderBy(order)))
    ss = F.sum(_c("_d") * _c("_d"))
    rho = F.when((F.max("_n") < 3) | (ss == 0), 0.0).otherwise(F.least(F.lit(0.9), F.greatest(F.lit(0.0), F.try_divide(F.sum(_c("_d") * _c("_p")), ss))))
    return d.groupBy(*keys).agg(rho.alias("rho"))


def regression_impact(rows: DataFrame, rules: CausalRules = CausalRules()) -> DataFrame:
    """Estimate per experiment with its reasons, placebo test and probability; ``rows(exp, date, x, y, post)``."""
    main = effect(rows, ["exp"])
    order = W.partitionBy("exp").orderBy("date")
    before = rows.where(~_c("post") & _c("x").isNotNull() & _c("y").isNotNull())
    half = before.withColumn("i", F.row_number().over(order)).join(before.groupBy("exp").agg(F.floor(F.count("*") / 2).alias("h")), "exp")
    placebo = effect(half.withColumn("post", _c("i") > _c("h")).select("exp", "date", "x", "y", "post"), ["exp"]).select(
        "exp", ((_c("lower") > 0) | (_c("upper") < 0)).alias("placebo_detected")
    )
    gap = lambda total, n: F.when(_c(total) > 0, (_c(total) - _c(n)) / _c(total)).otherwise(0.0) > rules.max_missing_share
    joined = main.join(placebo, "exp", "left")
    early = F.array_compact(F.array(
        F.when(_c("n") < rules.min_pre_days, "short-pre-period"), F.when(_c("m") < rules.min_post_days, "short-post-period"),
        F.when(gap("pre_total", "n") | gap("post_total", "m"), "missing-days"),
    ))
    late = F.array_compact(F.array(
        F.when(_c("slope").isNull(), "flat-control"), F.when(_c("r2") < rules.min_r2, "poor-prefit"), F.when(_c("placebo_detected"), "placebo-failed"),
    ))
    reasons = F.when(F.size(early) > 0, early).otherwise(late)
    ok = F.size("reasons") == 0
    return joined.withColumn("reasons", reasons).select(
        "exp", F.when(ok, "estimated").otherwise("not-estimable").alias("status"), "reasons", "n", "m", "r2", "rho",
        F.when(ok, _c("estimate")).alias("estimate"), F.when(ok, _c("lower")).alias("lower"), F.when(ok, _c("upper")).alias("upper"),
        F.when(ok & (_c("expected") > 0), _c("estimate") / _c("expected")).alias("relative"),
        F.when(ok & (_c("sd") > 0), numbers.normal_cdf(F.abs(_c("estimate")) / _c("sd"))).alias("probability"),
    )


def choose_control(candidates: DataFrame, series: DataFrame, rules: CausalRules = CausalRules()) -> DataFrame:
    """Best control per experiment: highest R² before the change, then most shared days, then the name.

    ``candidates(exp, test, control, start)`` names the independent sites to try.
    """
    days = candidates.withColumn("date", F.explode(F.sequence(F.date_sub("start", rules.window_days), F.date_sub("start", 1))))
    values = lambda n: series.select(_c("series").alias(n), "date", _c("value").alias(f"{n}_value"))
    shared = days.join(values("test"), ["test", "date"]).join(values("control"), ["control", "date"])
    fit = shared.groupBy("exp", "control").agg(F.coalesce(F.regr_r2("test_value", "control_value"), F.lit(-1.0)).alias("r2"), F.count("*").alias("shared"))
    best = fit.groupBy("exp").agg(F.min_by(F.struct("control", "r2", "shared"), F.struct((-F.round("r2", 9)).alias("a"), (-_c("shared")).alias("b"), "control")).alias("b"))
    return best.select("exp", "b.control", "b.r2", "b.shared")


def backtest(rows: DataFrame, starts: DataFrame, offsets: tuple[int, ...] = (14, 21), rules: CausalRules = CausalRules()) -> DataFrame:
    """The estimator on earlier pretended dates; an effect found there is false. ``starts(exp, start)``."""
    shifts = F.explode(F.array(*[F.lit(o) for o in offsets]))
    tried = rows.where(~_c("post")).join(starts, "exp").withColumn("offset", shifts)
    moved = tried.select(F.struct("exp", "offset").alias("exp"), "date", "x", "y", (_c("date") >= F.date_sub("start", _c("offset"))).alias("post"))
    runs = regression_impact(moved, rules).where("status = 'estimated'").select(_c("exp.exp").alias("exp"), ((_c("lower") > 0) | (_c("upper") < 0)).alias("false_positive"))
    counted = starts.join(runs, "exp", "left").groupBy("exp").agg(F.count("false_positive").alias("runs"), F.count_if("false_positive").alias("false_positives"))
    return counted.withColumn("status", F.when(_c("runs") == 0, "not-estimable").when(_c("false_positives") > 0, "failed").otherwise("passed"))


def market_impact(rows: DataFrame, windows: DataFrame, min_pre: int = 14) -> DataFrame:
    """Mean daily effect after normalising by the market level; days inside an update window leave it open.

    ``rows(exp, date, x, y, market, post)``, ``windows(first, last)``: each window lists its days, matched by equality.
    """
    level = rows.groupBy("exp").agg(F.avg(F.when(~_c("post"), _c("market"))).alias("base"), F.count_if(_c("market").isNull() | (_c("market") <= 0)).alias("unknown"))
    days = windows.select(F.explode(F.sequence("first", "last")).alias("date")).distinct().withColumn("update", F.lit(True))
    ratio = F.when(_c("unknown") == 0, F.try_divide(_c("market"), _c("base"))).otherwise(1.0)
    used = rows.join(level, "exp").join(days, "date", "left").withColumn("y", _c("y") / ratio).withColumn("x", _c("x") / ratio)
    pre = ~_c("post")
    x, y = F.when(pre, _c("x")), F.when(pre, _c("y"))
    fit = used.groupBy("exp").agg(
        F.count(x).alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
        F.sqrt((F.regr_syy(y, x) - F.regr_slope(y, x) * F.regr_sxy(y, x)) / F.when(F.count(x) > 2, F.count(x) - 2)).alias("sd"),
    )
    gap = _c("y") - (_c("intercept") + _c("slope") * _c("x"))
    out = used.join(fit, "exp").where("post").groupBy("exp", "n", "sd").agg(F.avg(gap).alias("effect"), F.count(gap).alias("m"), F.count("update").alias("update_days"), F.max("unknown").alias("unknown"))
    half = 1.959964 * _c("sd") / F.sqrt(_c("m"))
    clear = (_c("effect") - half > 0) | (_c("effect") + half < 0)
    verdict = (
        F.when((_c("update_days") > 0) | (_c("unknown") > 0), "inconclusive").when(~clear, "no-effect").when(_c("effect") > 0, "positive").otherwise("negative")
    )
    return out.where(_c("n") >= min_pre).select("exp", "effect", (_c("effect") - half).alias("lower"), (_c("effect") + half).alias("upper"), "update_days", verdict.alias("verdict"))


def holm(p_values: DataFrame, alpha: float = 0.05, cells: int = 1024) -> DataFrame:
    """Holm adjustment per family of ``(family, test, p)``; unknown p stay unknown and are not counted.

    Ranks come from counts of p-value cells and the running maximum is carried from cell to cell, so a family with
    most of the rows is spread over its cells.
    """
    known = p_values.where("p IS NOT NULL").withColumn("cell", F.floor(_c("p") * cells))
    size = known.groupBy("family").agg(F.count("*").alias("m"))
    ranked = shapes.numbered(known, ["family"], _c("cell"), _c("p"), _c("test"), name="rank").join(size, "family")
    raw = ranked.withColumn("raw", F.least(F.lit(1.0), (_c("m") - _c("rank") + 1) * _c("p")))
    tops = raw.groupBy("family", "cell").agg(F.max("raw").alias("top"))
    carry = tops.select("family", "cell", F.max("top").over(W.partitionBy("family").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)).alias("carry"))
    inner = W.partitionBy("family", "cell").orderBy("p", "test").rowsBetween(W.unboundedPreceding, W.currentRow)
    value = F.greatest(F.max("raw").over(inner), F.coalesce("carry", F.lit(0.0)))
    done = raw.join(carry, ["family", "cell"]).withColumn("adjusted", value).select("family", "test", "adjusted")
    return p_values.join(done, ["family", "test"], "left").select("family", "test", "p", "adjusted", F.coalesce(_c("adjusted") < alpha, F.lit(False)).alias("significant"))


def structural_impact(rows: DataFrame, draws: int = 1000, seed: int = 20261101) -> DataFrame:
    """Weekday effects plus a drifting level, fitted before the change and drawn forward; ``rows(exp, date, y, post)``.

    The level filter runs day by day inside one experiment, whose window is bounded; experiments run in parallel.
    """

    def fit(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=["y"]).sort_values("date")
        before, after = pdf[~pdf["post"]], pdf[pdf["post"]]
        blank = pd.DataFrame({"exp": [key[0]], "estimate": [None], "lower": [None], "upper": [None], "probability": [None], "days": [len(after)]})
        if len(before) < 28 or len(after) < 1:
            return blank
        weekday = lambda d: pd.to_datetime(d["date"]).dt.dayofweek.to_numpy()
        y, wd = before["y"].to_numpy(float), weekday(before)
        centre = y.mean()
        season = np.array([y[wd == d].mean() - centre if (wd == d).any() else 0.0 for d in range(7)])
        season -= season.mean()
        z = y - season[wd]
        step = np.diff(z)
        noise = max(-float(np.dot(step[1:], step[:-1])) / len(step), 1e-6)
        drift = max(float(np.dot(step, step)) / len(step) - 2 * noise, 0.0)
        level, spread = z[0], noise
        for i, value in enumerate(z):
            ahead = spread + (drift if i else 0.0)
            gain = ahead / (ahead + noise)
            level, spread = level + gain * (value - level), (1 - gain) * ahead
        rng = np.random.default_rng(seed)
        walk = level + np.sqrt(spread) * rng.standard_normal((draws, 1)) + np.cumsum(np.sqrt(drift) * rng.standard_normal((draws, len(after))), axis=1)
        paths = walk + season[weekday(after)] + np.sqrt(noise) * rng.standard_normal((draws, len(after)))
        gaps = after["y"].to_numpy(float).sum() - paths.sum(axis=1)
        return pd.DataFrame({
            "exp": [key[0]], "estimate": [float(gaps.mean())], "lower": [float(np.quantile(gaps, 0.025))], "upper": [float(np.quantile(gaps, 0.975))],
            "probability": [float(max((gaps > 0).mean(), (gaps < 0).mean()))], "days": [len(after)],
        })

    kind = rows.schema["exp"].dataType.simpleString()
    return rows.select("exp", "date", "y", "post").groupBy("exp").applyInPandas(
        fit, f"exp {kind}, estimate double, lower double, upper double, probability double, days long"
    )
