"""Autocorrelation, partial autocorrelation and the augmented Dickey-Fuller test."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from tidepanel.operators.calendar import series
from tidepanel.operators.rolling import numbered


def acf_arrays(df: DataFrame, value: str, lags: int = 30, key: str = "symbol") -> DataFrame:
    """One row per series with the array of autocorrelations at lag 0..``lags``."""
    centred = df.where(F.col(value).isNotNull()).withColumn(
        "_c", F.col(value) - F.avg(value).over(W.partitionBy(key))
    )
    w = series(key)
    shifted = centred.select(
        key, "_c", *[F.lag("_c", k).over(w).alias(f"_l{k}") for k in range(1, lags + 1)]
    )
    var = F.sum(F.col("_c") * F.col("_c"))
    rho = [F.lit(1.0)] + [
        F.coalesce(F.try_divide(F.sum(F.col("_c") * F.col(f"_l{k}")), var), F.lit(0.0))
        for k in range(1, lags + 1)
    ]
    return shifted.groupBy(key).agg(F.count("*").alias("n"), F.array(*rho).alias("acf"))


def acf(df: DataFrame, value: str, lags: int = 30, key: str = "symbol") -> DataFrame:
    return acf_arrays(df, value, lags, key).select(
        key, F.posexplode("acf").alias("lag", "acf")
    )


def pacf(df: DataFrame, value: str, lags: int = 30, key: str = "symbol") -> DataFrame:
    """Partial autocorrelations by the Durbin-Levinson recursion over the ACF array."""
    empty = F.array().cast("array<double>")

    def step(state, k):
        rho = F.col("acf")
        phi = state["phi"]
        older = F.slice(rho, 2, F.greatest(k - 1, F.lit(0)))  # rho_1 .. rho_{k-1}
        dot = lambda a, b: F.aggregate(
            F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x
        )
        top = F.get(rho, k) - dot(phi, F.reverse(older))
        new = F.coalesce(F.try_divide(top, 1 - dot(phi, older)), F.lit(0.0))
        phis = F.concat(
            F.zip_with(phi, F.reverse(phi), lambda a, b: a - new * b), F.array(new)
        )
        return F.struct(phis.alias("phi"), F.concat(state["out"], F.array(new)).alias("out"))

    start = F.struct(empty.alias("phi"), F.array(F.lit(1.0)).alias("out"))
    fold = F.aggregate(F.sequence(F.lit(1), F.lit(lags)), start, step, lambda s: s["out"])
    return acf_arrays(df, value, lags, key).select(key, F.posexplode(fold).alias("lag", "pacf"))


def adf_lag0(df: DataFrame, value: str, key: str = "symbol") -> DataFrame:
    """Dickey-Fuller statistic without lags: t of y[t-1] in dy ~ const + y[t-1]."""
    w = series(key)
    rows = df.where(F.col(value).isNotNull()).select(
        key, F.lag(value).over(w).alias("x"), (F.col(value) - F.lag(value).over(w)).alias("y")
    ).where(F.col("x").isNotNull())
    sums = rows.groupBy(key).agg(
        F.count("*").alias("n"),
        F.regr_slope("y", "x").alias("slope"),
        F.regr_sxx("y", "x").alias("sxx"),
        F.regr_syy("y", "x").alias("syy"),
        F.regr_sxy("y", "x").alias("sxy"),
    )
    rss = F.col("syy") - F.col("slope") * F.col("sxy")
    error = F.sqrt(F.try_divide(rss, (F.col("n") - 2) * F.col("sxx")))
    return sums.select(key, "n", F.try_divide(F.col("slope"), error).alias("statistic"))


# fixed values: MacKinnon (1994) response surface, one series, constant
_TAU_MAX, _TAU_MIN, _TAU_STAR = 2.74, -18.83, -1.61
_TAU_SMALL = (2.1659, 1.4412, 0.038269)
_TAU_LARGE = (1.7339, 0.93202, -0.12745, -0.010368)


def mackinnon_p(tau: float) -> float:
    if tau > _TAU_MAX:
        return 1.0
    if tau < _TAU_MIN:
        return 0.0
    coefs = _TAU_SMALL if tau <= _TAU_STAR else _TAU_LARGE
    z = sum(c * tau**i for i, c in enumerate(coefs))
    return 0.5 * math.erfc(-z / math.sqrt(2))


CHUNK = 4096


def _partial_products(pdf: pd.DataFrame) -> pd.DataFrame:
    """Cross products of [y, x, 1, lags] for one chunk of rows, plus those of the
    rows before the common sample, which the final regression needs as well."""
    depth = int(pdf["depth"].iloc[0])
    full = pdf[pdf["rn"] > depth]
    lags = (np.stack(full["lags"].to_numpy())[:, :depth] if depth and len(full)
            else np.empty((len(full), depth)))
    z = np.column_stack([full["y"], full["x"], np.ones(len(full)), lags]).astype(float)
    early = pdf[pdf["rn"] <= depth].sort_values("rn")
    rows = [[float(r.rn), float(r.y), float(r.x), *[float(v) for v in r.lags]]
            for r in early.itertuples()]
    return pd.DataFrame({
        "key": [pdf["key"].iloc[0]], "depth": [depth], "n": [len(full)],
        "gram": [(z.T @ z).ravel().tolist()], "early": [rows],
    })


def _fit(gram: np.ndarray, n: int, width: int):
    """Regress column 0 on columns 1..width; t of column 1 and the AIC."""
    a, b = gram[1:width + 1, 1:width + 1], gram[1:width + 1, 0]
    scale = 1 / np.sqrt(np.maximum(np.diag(a), 1e-300))
    inverse = np.linalg.pinv(a * np.outer(scale, scale), hermitian=True) * np.outer(scale, scale)
    beta = inverse @ b
    rss = max(gram[0, 0] - beta @ b, 1e-300)
    t = beta[0] / math.sqrt(max(rss / max(n - width, 1) * inverse[0, 0], 1e-300))
    return t, n * math.log(rss / n) + 2 * width


def _choose_lag(pdf: pd.DataFrame) -> pd.DataFrame:
    """Sum the chunk products of one series and run the lag choice on them."""
    depth = int(pdf["depth"].iloc[0])
    size = depth + 3
    gram = np.sum([np.asarray(g).reshape(size, size) for g in pdf["gram"]], axis=0)
    n = int(pdf["n"].sum())
    best = min(range(depth + 1), key=lambda p: (round(_fit(gram, n, p + 2)[1], 9), p))
    keep = best + 3
    final = gram[:keep, :keep].copy()
    count = n
    for chunk in pdf["early"]:
        for row in chunk:
            if row[0] > best:
                z = np.array([row[1], row[2], 1.0, *row[3:3 + best]])
                final += np.outer(z, z)
                count += 1
    t, _ = _fit(final, count, best + 2)
    p = mackinnon_p(t)
    return pd.DataFrame({"key": [pdf["key"].iloc[0]], "used_lag": [best], "n": [count],
                         "statistic": [t], "p_value": [p], "stationary": [bool(p <= 0.05)]})


def adf(df: DataFrame, value: str, key: str = "symbol") -> DataFrame:
    """Augmented Dickey-Fuller test with a constant, lag chosen by AIC.

    All lag orders are read off one matrix of cross products per series, built in
    chunks of ``CHUNK`` rows and summed. The order is chosen on the common sample
    and refitted on every row it can use.
    """
    known = numbered(df.where(F.col(value).isNotNull()), key)
    w = series(key)
    moved = known.withColumn("y", F.col(value) - F.lag(value).over(w)).withColumn(
        "x", F.lag(value).over(w)
    )
    root = F.ceil(12 * F.pow(F.col("n") / 100, F.lit(0.25)))
    depth = F.greatest(F.lit(0), F.least(root, F.floor(F.col("n") / 2) - 2)).cast("int")
    # as many lags as the longest series asks for: it grows with the fourth root of the length
    longest = known.agg(F.max("n")).first()[0] or 1
    recent = F.reverse(F.collect_list("y").over(w.rowsBetween(-max(1, math.ceil(12 * (longest / 100) ** 0.25)), -1)))
    rows = moved.withColumn("lags", recent).where(F.col("y").isNotNull()).select(
        F.col(key).cast("string").alias("key"), (F.col("rn") - 1).alias("rn"), "x", "y",
        depth.alias("depth"), F.slice("lags", 1, F.greatest(depth, F.lit(1))).alias("lags"),
    )
    parts = rows.withColumn("chunk", F.floor((F.col("rn") - 1) / CHUNK)).groupBy(
        "key", "chunk"
    ).applyInPandas(
        _partial_products,
        "key string, depth int, n long, gram array<double>, early array<array<double>>",
    )
    out = parts.groupBy("key").applyInPandas(
        _choose_lag,
        "key string, used_lag int, n long, statistic double, p_value double, stationary boolean",
    )
    return out.withColumnRenamed("key", key)
