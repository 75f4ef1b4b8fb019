"""Learned windowed forecaster: one linear model over all series.

A sample holds the standardised values of the ``lookback`` rows before it, of the return and of the ``windowed``
features (such as returns of exogenous series), and the latest standardised state of the other features. Targets are
the next return (recursive mode) or the log returns of the coming blocks (direct mode, all blocks in one fit).

The rows of a series reach Python once, in order, without their windows. Cross products of windows are block-Toeplitz
but for the two ends of a series: a task adds up the products with the newest row of the window, and the outer products of
the ends, over all its series, and the rest of the matrix follows from these sums along its diagonals. Spark sums
the parts of the tasks, so the data is passed once for all horizons, kinds and blocks, and the model never depends on one
task seeing one series.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidepanel import settings as S
from tidepanel.functions.dates import business_horizon
from tidepanel.operators.rolling import numbered, pct_change

RIDGE = 1e-3  # per sample, on standardised inputs


def _fits(steps: list[int], lookback: int) -> list[dict]:
    """Every model to fit: (steps, kind, mode). The one-step model is fitted for long
    horizons as well, because short series fall back to it."""
    out = []
    for s in steps:
        setting, h = S.learned_settings(s), S.business_horizon(s)
        for kind, held in (("backtest", h), ("future", 0)):
            out.append({"steps": s, "kind": kind, "held": held, "mode": "recursive", "blocks": 0,
                        "agg": 1, "h": h, "lookback": lookback})
            if setting.mode == "direct":
                out.append({"steps": s, "kind": kind, "held": held, "mode": "direct",
                            "blocks": math.ceil(h / setting.agg_step), "agg": setting.agg_step,
                            "h": h, "lookback": lookback})
    return out


def with_tuned_settings(tasks: DataFrame, windows: list[tuple] = S.TUNED_WINDOWS) -> DataFrame:
    """Look-back rows, clip, drift blend and block length of each (symbol, steps).

    ``windows`` is a short table of (symbol or None, least steps, least business days, look-back); the row of the
    symbol itself counts before the general ones, and of those the one with the longer horizon.
    """
    h = business_horizon("steps")
    rows = F.array(*[F.struct(
        F.lit(symbol is not None).alias("own"), F.lit(steps).alias("steps"), F.lit(days).alias("days"), F.lit(back).alias("lookback"),
        F.lit(symbol).cast("string").alias("symbol")) for symbol, steps, days, back in windows])
    fits = F.filter(rows, lambda x: (x["symbol"].isNull() | (x["symbol"] == F.upper("symbol")))
                    & (F.col("steps") >= x["steps"]) & (h >= x["days"]))
    return tasks.withColumns({
        "lookback": F.array_max(fits)["lookback"], "clip": F.when(h <= 63, S.CLIP_NEAR).otherwise(S.CLIP_FAR),
        "blend": F.lit(S.TUNED_BLEND), "agg_step": F.lit(S.TUNED_AGG_STEP)})


def feature_rows(panel: DataFrame, features: list[str]) -> DataFrame:
    """Return and feature values per row, rows with a missing part left out."""
    rows = panel.withColumn("ret", pct_change("close")).dropna(
        how="any", subset=["ret", *features])
    return numbered(rows.select("symbol", "date", "close", "ret", *features))


# ---- sums of cross products -------------------------------------------------
class Products:
    """X'X and X'Y of window samples of many series, where X is (one, windows newest row first, states).

    Columns of a window are ordered by age, then by feature.
    """

    def __init__(self, lookback: int, windowed: int, states: int, targets: int):
        self.back, self.wide, self.states = lookback, windowed, states
        self.width = 1 + lookback * windowed + states
        # one, the newest row of the window, the states
        self.newest = [*range(1 + windowed), *range(self.width - states, self.width)]
        self.first = np.zeros((len(self.newest), self.width))
        self.ends = np.zeros((lookback * windowed, lookback * windowed))
        self.targets = np.zeros((self.width, targets))

    def samples(self, z: np.ndarray, state: np.ndarray, start: int, stop: int) -> np.ndarray:
        """Design rows of the samples ``start`` to ``stop`` - 1."""
        views = np.lib.stride_tricks.sliding_window_view(z, self.back, axis=0)  # row, feature, age from the oldest
        past = views[start - self.back:stop - self.back, :, ::-1].transpose(0, 2, 1).reshape(stop - start, -1)
        return np.hstack([np.ones((stop - start, 1)), past, state[start - 1:stop - 1]])

    def add(self, z: np.ndarray, state: np.ndarray, targets: np.ndarray, stop: int) -> None:
        """Samples of one series; ``targets`` has a row for each of them. The first one has a full window."""
        if stop <= self.back:
            return
        x = self.samples(z, state, self.back, stop)
        self.first += x[:, self.newest].T @ x
        self.targets += x.T @ targets
        # rows that the windows gain and lose when they move back by one row
        gained, lost = self._back_from(z, self.back - 1), self._back_from(z, stop - 1)
        self.ends += np.outer(gained, gained) - np.outer(lost, lost)

    def _back_from(self, z: np.ndarray, t: int) -> np.ndarray:
        """Values of the rows t - 1, t - 2, ... of a window that ends before row ``t``; 0 before the series begins."""
        rows = np.zeros((self.back, self.wide))
        part = z[max(t - self.back, 0):t][::-1]
        rows[:len(part)] = part
        return rows.ravel()

    def matrix(self) -> np.ndarray:
        w, n = self.wide, self.back * self.wide
        full = np.zeros((self.width, self.width))
        full[self.newest] = self.first
        full[:, self.newest] = self.first.T
        inner = full[1:1 + n, 1:1 + n]
        for at in range(w, n, w):  # one row of the window older: the block up and left, and the ends
            inner[at:at + w, w:] = inner[at - w:at, :n - w] + self.ends[at - w:at, :n - w]
        return full


def _standard(values: np.ndarray, train: int) -> np.ndarray:
    """Columns brought to mean 0 and deviation 1 of the first ``train`` rows."""
    spread = values[:train].std(axis=0)
    return (values - values[:train].mean(axis=0)) / np.where(spread > 0, spread, 1.0)


def _block_sums(logs: np.ndarray, agg: int, blocks: int, start: int, stop: int) -> np.ndarray:
    """Summed log returns of the coming blocks of each sample."""
    total = np.concatenate([[0.0], np.cumsum(logs)])
    at = np.arange(start, stop)[:, None] + agg * np.arange(blocks + 1)
    return np.diff(total[at], axis=1)


def _series(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(returns and windowed features, states) of one series after another, from rows in order of series and position."""
    name, held = None, []
    for batch in batches:
        names = batch.column(0).to_pylist()
        values = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(1, batch.num_columns)])
        cuts = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
        for low, high in zip(cuts, cuts[1:]):
            if low == high:
                continue
            if names[low] != name and held:
                whole = np.vstack(held)
                yield whole[:, :columns], whole[:, columns:]
                held = []
            name = names[low]
            held.append(values[low:high])
    if held:
        whole = np.vstack(held)
        yield whole[:, :columns], whole[:, columns:]


def _summed(rows: DataFrame, windowed: list[str], states: list[str], fits: list[dict], lookback: int) -> DataFrame:
    """(fit, m): the rows of (X'X, X'Y) of each fit, summed over all tasks."""
    wide = 1 + len(windowed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [Products(lookback, wide, len(states), max(f["blocks"], 1)) for f in fits]
        for values, state in _series(batches, wide):
            n = len(values)
            for f, into in zip(fits, sums):
                train = n - f["held"]
                reach = f["blocks"] * f["agg"] if f["mode"] == "direct" else 0
                stop = train - reach
                if stop <= lookback:
                    continue
                z = _standard(values, train)
                target = (_block_sums(np.log1p(values[:, 0]), f["agg"], f["blocks"], lookback, stop)
                          if f["mode"] == "direct" else z[lookback:stop, :1])
                into.add(z, _standard(state, train) if len(states) else state, target, stop)
        for i, into in enumerate(sums):
            cells = np.hstack([into.matrix(), into.targets])
            yield pa.RecordBatch.from_arrays(
                [pa.array([i] * len(cells), pa.int32()), pa.array(np.arange(len(cells)), pa.int32()), pa.array(list(cells), pa.list_(pa.float64()))],
                names=["fit", "i", "cells"])

    # the windows behind ``rows`` have dealt them by symbol already
    ordered = rows.select("symbol", "ret", *windowed, *states, "rn").sortWithinPartitions("symbol", "rn").drop("rn")
    parts = ordered.mapInArrow(run, "fit int, i int, cells array<double>")
    # one array per task, fit and column
    total = F.aggregate(F.collect_list("cells"), F.array().cast("array<double>"), lambda acc, c: F.when(
        F.size(acc) == 0, c).otherwise(F.zip_with(acc, c, lambda a, b: a + b)))
    return parts.groupBy("fit", "i").agg(total.alias("r")).groupBy("fit").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "r"))), lambda c: c["r"]).alias("m"))


def _solver(width: int):
    def solve(rows: pd.Series) -> pd.Series:
        out = []
        for stacked in rows:
            full = np.stack([np.asarray(r, dtype=float) for r in stacked])
            a, b = full[:, :width], full[:, width:]
            penalty = np.eye(width) * RIDGE * max(a[0, 0], 1.0)
            penalty[0, 0] = 0.0
            out.append(np.linalg.solve(a + penalty, b).T.tolist())
        return pd.Series(out)

    return F.pandas_udf(solve, "array<array<double>>")


# ---- forecasts --------------------------------------------------------------
def roll_returns(beta: np.ndarray, windows: np.ndarray, states: np.ndarray, horizon: int) -> np.ndarray:
    """Standardised returns of the coming rows of many series at once, each fed back into its window.

    ``windows`` (series, age from the newest, feature) hold the return as their first feature; the others keep their
    last value.
    """
    count, back, wide = windows.shape
    path = np.empty((count, back + horizon, wide))
    path[:, :back] = windows[:, ::-1]
    path[:, back:] = windows[:, :1]
    weights = beta[1:1 + back * wide].reshape(back, wide)[::-1]
    base = beta[0] + states @ beta[1 + back * wide:]
    for t in range(horizon):
        path[:, back + t, 0] = base + (path[:, t:t + back] * weights).sum(axis=(1, 2))
    return path[:, back:, 0]


def _returns(rows: list[dict], fit: dict, one_step, direct) -> np.ndarray:
    """Daily returns of the coming rows of series that use the same model."""
    setting, h = S.learned_settings(fit["steps"]), fit["h"]
    drift = np.array([r["drift"] for r in rows])[:, None]
    if direct is not None:  # all blocks at once
        blocks, agg = fit["blocks"], fit["agg"]
        x = np.stack([np.concatenate([[1.0], r["window"].ravel(), r["state"]]) for r in rows])
        logs = x @ np.array(direct).T
        w = setting.blend * np.arange(1, blocks + 1) / blocks
        days = np.full(blocks, agg)
        days[-1] = h - agg * (blocks - 1)
        logs = (1 - w) * logs + w * np.log1p(drift)
        return np.repeat(np.expm1(logs / np.maximum(1, days)), days, axis=1)[:, :h]
    if one_step is None:  # too short for any model
        return np.repeat(drift, h, axis=1)
    z = roll_returns(np.array(one_step[0]), np.stack([r["window"] for r in rows]), np.stack([r["state"] for r in rows]), h)
    r = z * np.array([r["ret_s"] for r in rows])[:, None] + np.array([r["ret_m"] for r in rows])[:, None]
    w = setting.blend * np.arange(1, h + 1) / h
    return (1 - w) * r + w * drift


def _series_ends(rows: DataFrame, windowed: list[str], states: list[str], holdouts: list[int], lookback: int) -> DataFrame:
    """One row per series: its length, mean and deviation of every feature before each holdout, and its last rows."""
    names = ["ret", *windowed, *states]
    stats = []
    for held in holdouts:
        part = [F.when(F.col("rn") <= F.col("n") - held, F.col(c)) for c in names]
        stats.append(F.struct(F.lit(held).alias("held"), F.array(*map(F.avg, part)).alias("mean"), F.array(*map(F.stddev_pop, part)).alias("std")))
    near = F.col("rn") > F.col("n") - (max(holdouts) + lookback)
    return rows.groupBy("symbol").agg(
        F.max("n").alias("n"), F.array(*stats).alias("stats"),
        F.array_sort(F.collect_list(F.when(near, F.struct("rn", "date", "close", F.array(*names).alias("v"))))).alias("tail"))


def learned_fits(panel: DataFrame, steps: list[int], features: list[str] | None = None,
                 lookback: int = 120, windowed: list[str] | None = None) -> DataFrame:
    """One row per (symbol, steps, kind) with the columns of the regression fits.

    ``windowed`` features enter with all rows of the look-back, ``features`` with their latest value.
    """
    states, windowed = list(features or []), list(windowed or [])
    fits = _fits(steps, lookback)
    rows = feature_rows(panel, [*windowed, *states])
    wide = 1 + len(windowed)
    models = _summed(rows, windowed, states, fits, lookback).select(
        "fit", _solver(1 + lookback * wide + len(states))("m").alias("model"))
    # a few rows, bounded by horizons, look-back and blocks: every task takes all of them
    known = {r["fit"]: [list(b) for b in r["model"]] for r in models.collect()}
    held = {(f["steps"], f["kind"]): f["held"] for f in fits}
    keys = list(held)
    ends = _series_ends(rows, windowed, states, sorted(set(held.values())), lookback)
    tasks = F.array(*[F.struct(F.lit(s).alias("steps"), F.lit(k).alias("kind"), F.lit(held[s, k]).cast("int").alias("held"))
                      for s, k in keys])
    ready = ends.select("*", F.inline(tasks))
    number = {(f["steps"], f["kind"], f["mode"]): i for i, f in enumerate(fits)}

    def prepared(row: dict) -> dict:
        n, held_ = int(row["n"]), int(row["held"])
        train = max(n - held_, 0)
        if train < 1:
            raise ValueError("series too short for the backtest window")
        stat = next(s for s in row["stats"] if s["held"] == held_)
        mean, std = np.array(list(stat["mean"]), float), np.array(list(stat["std"]), float)
        std = np.where(std > 0, std, 1.0)
        last = row["tail"][:len(row["tail"]) - held_] if held_ else row["tail"]
        z = (np.array([list(t["v"]) for t in last[-lookback:]]) - mean) / std
        key = (int(row["steps"]), row["kind"])
        f = fits[number.get((*key, "direct"), number[(*key, "recursive")])]
        one = train >= lookback + 10
        direct = f["mode"] == "direct" and one and train >= lookback + f["blocks"] * f["agg"] + 10
        return {"fit": f, "used": "direct" if direct else "recursive" if one else "drift", "drift": float(mean[0]),
                "window": z[::-1, :wide], "state": z[-1, wide:], "ret_m": mean[0], "ret_s": std[0], "last": float(last[-1]["close"])}

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out, groups = [None] * len(rows), {}
        for i, row in enumerate(rows.to_dict("records")):
            try:
                task = prepared(row)
                groups.setdefault((int(row["steps"]), row["kind"], task["used"]), []).append((i, task))
            except Exception as problem:  # one failing key must not stop the others
                out[i] = {"status": "error", "error": str(problem), "used": None, "path": None}
        for (s, kind, used), mine in groups.items():
            model = known.get(number[(s, kind, used)]) if used != "drift" else None
            fit = mine[0][1]["fit"]
            rets = _returns([t for _, t in mine], fit, model if used == "recursive" else None, model if used == "direct" else None)
            clip = S.learned_settings(s).clip
            for (i, task), r in zip(mine, rets):
                path = task["last"] * np.cumprod(1 + np.clip(r, -clip, clip))
                out[i] = {"status": "ok", "error": None, "used": used, "path": path.tolist()}
        return pd.DataFrame(out, columns=["status", "error", "used", "path"])

    roll = F.pandas_udf(run, "status string, error string, used string, path array<double>"
                        ).asNondeterministic()
    count = F.greatest(F.col("n") - F.col("held"), F.lit(0))
    own = F.filter("stats", lambda x: x["held"] == F.col("held"))[0]
    at_end = F.filter("tail", lambda t: t["rn"] == F.col("n") - F.col("held"))
    after = F.filter("tail", lambda t: t["rn"] > F.col("n") - F.col("held"))
    return ready.withColumn("fitted", roll(F.struct("steps", "kind", "held", "n", "stats", "tail"))).select(
        "symbol", F.lit("lstm").alias("model"), "steps", "kind", business_horizon("steps").cast("int").alias("h"),
        count.alias("n_train"), F.get(at_end, F.lit(0))["close"].alias("last_price"), F.get(at_end, F.lit(0))["date"].alias("last_date"),
        F.transform(after, lambda t: F.struct(t["date"].alias("date"), t["close"].alias("actual"))).alias("test"),
        own["mean"][0].alias("drift"), "fitted.used", "fitted.status", "fitted.error", "fitted.path")
