"""ARIMA, seasonal and exogenous models for many series in one job.

The estimates are conditional least squares (two-stage regression in the manner of Hannan and Rissanen when there are
moving-average terms), not maximum likelihood. Seasonal models are multiplicative: lag i + j m has the product of
the coefficients of lag i and lag j m.

* A ``Kind`` is one differencing (d, D, m). A row of a series gives one vector per kind that its orders use: all lags
  that some order of the job needs, a one and the differenced exog columns.
* The products of these columns are summed per (series, kind, segment), where segments lie between the borders of the
  held-out parts and keep apart the rows whose lags are not all known. Such sums add up: every holdout and every order is
  a sum of segments, so neither multiplies the rows. Residuals of a first stage are linear in the same columns, so their
  products follow from the same sums and no second pass is needed.
* An order is a row of a table. It chooses its columns in the sums of its kind, so tuned orders are joined and not
  written into the plan. Per (series, model, horizon, part) a small numpy step solves for the coefficients and rolls the
  forecast forward. A failing key reports its error as a row.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidepanel import settings as S
from tidepanel.functions.dates import business_horizon, next_business_days, seasonal_period
from tidepanel.operators.rolling import numbered
from tidepanel.plans.regression import aic, cross_products, least_squares, product_squares, unpack

LONG_AR = 8  # order of the first-stage autoregression
SLICE = 500  # rows of a batch that are Python objects at a time

# names of the order in tables; column names do not differ by case alone
ORDER_COLUMNS = ["p", "d", "q", "sp", "sd", "sq", "m"]


@dataclass(frozen=True)
class Order:
    p: int
    d: int
    q: int
    P: int = 0
    D: int = 0
    Q: int = 0
    m: int = 0

    @property
    def kind(self) -> tuple[int, int, int]:
        return self.d, self.D, self.m

    @property
    def moving(self) -> bool:
        return self.q + self.Q > 0

    def own_lags(self) -> list[int]:
        """Lags of the series, products included."""
        return _products(self.p, self.P, self.m)

    def error_lags(self) -> list[int]:
        return _products(self.q, self.Q, self.m)

    def first_lags(self) -> list[int]:
        """Lags of the long autoregression behind the residuals."""
        season = [j * self.m for j in range(1, max(self.P, 1) + 1)] if self.m else []
        return sorted({*range(1, max(self.p, LONG_AR) + 1), *season})


def _products(plain: int, seasonal: int, m: int) -> list[int]:
    return sorted({i + j * m for i in range(plain + 1) for j in range(seasonal + 1 if m else 1)} - {0})


@dataclass(frozen=True)
class Needs:
    """Columns that must be known on a row: lags of the series (0 is the value itself), and exog."""

    lags: frozenset[int]
    exog: bool = False


def first_needs(order: Order) -> Needs:
    return Needs(frozenset([0, *order.first_lags()]))


def second_needs(order: Order, exog: bool) -> Needs:
    back = [0, *order.first_lags()] if order.moving else []
    return Needs(frozenset([0, *order.own_lags(), *(s + b for s in order.error_lags() for b in back)]), exog)


@dataclass(frozen=True)
class Design:
    """What a job sums: lags and needs of each kind, the holdouts, the exog columns."""

    lags: dict[tuple[int, int, int], list[int]]
    needs: dict[tuple[int, int, int], list[Needs]]
    holdouts: list[int]
    exog: tuple[str, ...]

    @property
    def kinds(self) -> list[tuple[int, int, int]]:
        return sorted(self.lags)

    @property
    def width(self) -> int:
        """Columns: one, exog, lags; kinds with fewer lags leave the last ones empty."""
        return 1 + len(self.exog) + max(map(len, self.lags.values()))

    @property
    def tail(self) -> int:
        """Last rows of a series from which every forecast of the job can start, and the held-out ones."""
        reach = max(d + m * D + max(self.lags[(d, D, m)]) for d, D, m in self.kinds)
        return reach + max(self.holdouts) + 2


def design_of(orders: list[tuple[Order, bool]], holdouts: list[int], exog: tuple[str, ...], *,
              shared: bool = False) -> Design:
    """``orders`` come with their use of exog. With ``shared`` all orders of a kind use the same rows, those on which all can
    be fitted, so that their criteria can be compared."""
    lags: dict = {}
    needs: dict = {}
    for order, uses in orders:
        uses = uses and bool(exog)
        mine = {second_needs(order, uses), *([first_needs(order)] if order.moving else [])}
        needs.setdefault(order.kind, set()).update(mine)
        lags.setdefault(order.kind, set()).update(*(n.lags for n in mine))
    if shared:
        needs = {k: {Needs(frozenset(lags[k]), any(n.exog for n in v))} for k, v in needs.items()}
    return Design({k: sorted(v) for k, v in lags.items()},
                  {k: sorted(v, key=lambda n: (sorted(n.lags), n.exog)) for k, v in needs.items()},
                  sorted({0, *holdouts}), tuple(exog))


def difference_weights(d: int, D: int, m: int) -> np.ndarray:
    """Weights of (1-B)^d (1-B^m)^D on lag 0, 1, 2, ..."""
    poly = np.array([1.0])
    for _ in range(d):
        poly = np.convolve(poly, [1.0, -1.0])
    if D:
        season = np.zeros(m + 1)
        season[0], season[m] = 1.0, -1.0
        for _ in range(D):
            poly = np.convolve(poly, season)
    return poly


# ---- tasks ------------------------------------------------------------------
def parameter_rows(spark, orders: dict[tuple[str, str], tuple]) -> DataFrame:
    """Configured orders as a table; its size is that of the configuration."""
    rows = [(s, m, *o) for (s, m), o in orders.items()]
    return spark.createDataFrame(
        rows, "symbol string, model string, p int, d int, q int, sp int, sd int, sq int, m int")


def work_grid(symbols: DataFrame, models: list[str], steps: list[int]) -> DataFrame:
    """symbols x models x horizons, by expanding two literal arrays; other columns stay."""
    rest = [c for c in symbols.columns if c != "symbol"]
    return symbols.select(
        "symbol", *rest, F.explode(F.array(*[F.lit(m) for m in models])).alias("model")
    ).select("symbol", "model", *rest, F.explode(F.array(*[F.lit(int(s)) for s in steps])).alias("steps"))


def with_parameters(grid: DataFrame, params: DataFrame, defaults: dict[str, tuple] | None = None,
                    season: int | None = None) -> DataFrame:
    """Order per (symbol, model), the default where none is configured, seasonal
    period by the horizon rule or ``season``. Non-seasonal models have no seasonal part.

    ``params`` may have a row per series; how it is joined is left to its measured size.
    """
    joined = grid.join(params.select("symbol", "model", *ORDER_COLUMNS[:-1]), ["symbol", "model"], "left")
    out = joined
    for i, name in enumerate(ORDER_COLUMNS[:-1]):
        plain = (S.DEFAULT_ORDER + S.DEFAULT_SEASONAL)[i]
        value: Column = F.lit(plain)
        for model, order in (defaults or {}).items():
            value = F.when(F.col("model") == model, order[i]).otherwise(value)
        out = out.withColumn(name, F.coalesce(name, value))
    seasonal = F.col("model") != "arima"
    for name in ("sp", "sd", "sq"):
        out = out.withColumn(name, F.when(seasonal, F.col(name)).otherwise(0))
    bdays = business_horizon(F.col("steps"))
    period = seasonal_period(bdays) if season is None else F.lit(season)
    return out.withColumns({"h": bdays, "m": F.when(seasonal, period).otherwise(0).cast("int")})


# ---- sums -------------------------------------------------------------------
_OVER = "over (partition by symbol order by date)"


def _name(kind) -> str:
    return "w_{}_{}_{}".format(*kind)


def _lagged(panel: DataFrame, design: Design) -> DataFrame:
    """Differenced value and exog of each kind, and the lags of the former.

    Two projections over one sorted pass of each series; the expressions are texts because there are many of them.
    """
    def differenced(name: str, kind) -> str:
        terms = [f"({c}d * " + (f"lag(`{name}`, {i}) {_OVER})" if i else f"`{name}`)")
                 for i, c in enumerate(difference_weights(*kind)) if c]
        return " + ".join(terms)

    level, lagged = ["*"], ["*"]
    for i, c in enumerate(design.exog, 1):
        level.append(f"try_divide(`{c}`, lag(`{c}`) {_OVER}) - 1 as _r{i}")
    for kind in design.kinds:
        name = _name(kind)
        level.append(f"{differenced('close', kind)} as {name}")
        level += [f"{differenced(c, kind)} as {name}_x{i}" for i, c in enumerate(design.exog, 1)]
        lagged += [f"lag({name}, {i}) {_OVER} as {name}_{i}" for i in design.lags[kind] if i]
    return panel.selectExpr(*level).selectExpr(*lagged)


def _kind_struct(i: int, kind, design: Design) -> str:
    """One design row: the kind, which needs are met (as bits) and the columns."""
    name = _name(kind)
    lag = {k: f"{name}_{k}" if k else name for k in design.lags[kind]}
    moves = [f"{name}_x{j}" for j in range(1, len(design.exog) + 1)]

    def met(bit: int, need: Needs) -> str:
        cols = [lag[k] for k in sorted(need.lags)] + (moves if need.exog else [])
        return f"case when {' and '.join(f'{c} is not null' for c in cols)} then {1 << bit}L else 0L end"

    known = " + ".join(met(b, n) for b, n in enumerate(design.needs[kind]))
    columns = ["1d"] + [f"coalesce({c}, 0d)" for c in moves + [lag[k] for k in design.lags[kind]]]
    columns += ["0d"] * (design.width - len(columns))
    fields = {"kind": str(i), "known": known} | {f"z{j}": c for j, c in enumerate(columns)}
    return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"


def segment_sums(panel: DataFrame, design: Design) -> DataFrame:
    """(symbol, kind, seg, known, n_rows, gram, moves): the sums of each segment, one pass over the panel.

    ``seg`` counts the holdouts a row falls into, ``known`` has a bit for each need that it meets. ``moves`` are
    number, sum and sum of squares of the relative changes of the exog columns. A panel may carry ``kinds``, the
    numbers of the kinds each series needs.
    """
    structs = "array(" + ", ".join(_kind_struct(i, k, design) for i, k in enumerate(design.kinds)) + ")"
    if "kinds" in panel.columns:
        structs = f"filter({structs}, s -> array_contains(kinds, s.kind))"
    seg = " + ".join(f"cast(n - rn < {h} as int)" for h in design.holdouts if h) or "0"
    moves = [f"_r{i}" for i in range(1, len(design.exog) + 1)]
    rows = _lagged(numbered(panel), design).selectExpr("symbol", f"{seg} as seg", *moves, f"inline({structs})")
    sums = ", ".join(f"array(cast(count({r}) as double), coalesce(sum({r}), 0d), coalesce(sum({r} * {r}), 0d))" for r in moves)
    return rows.groupBy("symbol", "kind", "seg", "known").agg(
        F.count(F.lit(1)).alias("n_rows"),
        cross_products([f"z{j}" for j in range(design.width)], None).alias("gram"),
        F.expr(f"cast(array({sums}) as array<array<double>>)").alias("moves"))


def _summaries(panel: DataFrame, design: Design) -> DataFrame:
    """One row per series: the sums of its kinds, its length and its last rows. All are bounded by the job's orders and
    horizons, whatever the length of the series."""
    parts = segment_sums(panel, design).groupBy("symbol").agg(
        F.collect_list(F.struct("kind", "seg", "known", "n_rows", "gram", "moves")).alias("parts"))
    levels = ", ".join(f"`{c}`" for c in design.exog)
    last = numbered(panel).where(f"n - rn < {design.tail}").selectExpr(
        "symbol", "n", f"named_struct('date', date, 'close', close, 'xs', cast(array({levels}) as array<double>)) as r")
    tails = last.groupBy("symbol").agg(F.max("n").alias("n"), F.array_sort(F.collect_list("r")).alias("tail"))
    return parts.join(tails, "symbol")


# ---- solve and roll forward -------------------------------------------------
class Sums:
    """The sums of one kind of one series, added up on demand."""

    def __init__(self, design: Design, kind: tuple[int, int, int], parts):
        self.design, self.kind = design, kind
        number = design.kinds.index(kind)
        self.parts = [p for p in parts if p["kind"] == number]
        at = 1 + len(design.exog)
        self.place = {lag: at + i for i, lag in enumerate(design.lags[kind])}

    def of(self, need: Needs, holdout: int) -> tuple[np.ndarray, int]:
        """Products over the rows outside the holdout that meet ``need``, and the number of these rows."""
        bit = 1 << self.design.needs[self.kind].index(need)
        most = sum(h > holdout for h in self.design.holdouts)
        mine = [p for p in self.parts if p["known"] & bit and p["seg"] <= most]
        width = self.design.width
        cells = sum((np.asarray(p["gram"], float) for p in mine), np.zeros(width * (width + 1) // 2))
        return unpack(cells, width), int(sum(p["n_rows"] for p in mine))

    def moves(self, holdout: int) -> tuple[np.ndarray, np.ndarray]:
        """Mean and sample deviation of the relative changes of the exog columns."""
        most = sum(h > holdout for h in self.design.holdouts)
        n, total, square = np.sum([np.array([list(m) for m in p["moves"]]) for p in self.parts if p["seg"] <= most], axis=0).T
        with np.errstate(invalid="ignore", divide="ignore"):
            mean = total / n
            spread = np.sqrt(np.maximum(square - n * mean * mean, 0) / (n - 1))
        return mean, np.where(n > 1, spread, 0.0)


@dataclass(frozen=True)
class Fit:
    order: Order
    coefs: dict[str, float]
    own: dict[int, float]  # by lag, products included
    error: dict[int, float]
    first: dict[int, float]  # of the long autoregression; lag 0 is its constant
    rss: float
    used: int
    size: int


def fit_order(order: Order, sums: Sums, holdout: int, exog: bool, *, needs: tuple[Needs, Needs] | None = None,
              first: list[int] | None = None) -> Fit:
    """Coefficients of one order from the sums of its kind.

    ``needs`` of both stages and the lags of the ``first`` are those of the order itself, or shared by a search.
    """
    level = order.d + order.D == 0
    stage_one, stage_two = needs or (first_needs(order), second_needs(order, exog))
    place, width = sums.place, sums.design.width
    long: dict[int, float] = {}
    if order.moving:
        gram, _ = sums.of(stage_one, holdout)
        lags = first or order.first_lags()
        use = ([0] if level else []) + [place[b] for b in lags]
        use = [c for c in use if gram[c, c] > 0]
        picked = [place[0], *use]
        beta, _ = least_squares(gram[np.ix_(picked, picked)], list(range(1, len(picked))))
        found = dict(zip(use, beta))
        long = {b: float(found.get(place[b], 0.0)) for b in lags} | {0: float(found.get(0, 0.0))}
    gram, used = sums.of(stage_two, holdout)

    def column(shift: int, own: bool) -> np.ndarray:
        """Weights of a regressor on the summed columns."""
        w = np.zeros(width)
        w[place[shift]] = 1.0
        if not own:  # the residual at that lag
            w[0] -= long[0]
            for b, c in long.items():
                if b:
                    w[place[shift + b]] -= c
        return w

    names, columns = ["one"] if level else [], [np.eye(width)[0]] if level else []
    if exog:
        names += [f"x{i}" for i in range(1, len(sums.design.exog) + 1)]
        columns += [np.eye(width)[i] for i in range(1, len(sums.design.exog) + 1)]
    k = len(names)
    groups = []
    for letters, plain, seasonal, own in (("as", order.p, order.P, True), ("ef", order.q, order.Q, False)):
        seasonal = seasonal if order.m else 0
        at = k
        names += [f"{letters[0]}{i}" for i in range(1, plain + 1)] + [f"{letters[1]}{j}" for j in range(1, seasonal + 1)]
        columns += [column(i, own) for i in range(1, plain + 1)] + [column(j * order.m, own) for j in range(1, seasonal + 1)]
        k += plain + seasonal
        groups.append((at, plain, seasonal, own))
    size = len(names)
    if used <= size:
        raise ValueError(f"{used} usable rows for {size} coefficients")
    products = []  # (first factor, second factor, sign)
    for at, plain, seasonal, own in groups:
        for i in range(plain):
            for j in range(seasonal):
                products.append((at + i, at + plain + j, -1.0 if own else 1.0))
                columns.append(column(i + 1 + (j + 1) * order.m, own))
    weights = np.stack([column(0, True), *columns]) if columns else column(0, True)[None]
    beta, rss = product_squares(weights @ gram @ weights.T, size, products)
    coefs = dict(zip(names, map(float, beta)))
    own, error = ({}, {})
    for target, letters, plain, seasonal, sign in ((own, "as", order.p, order.P, -1.0), (error, "ef", order.q, order.Q, 1.0)):
        one = {i: coefs[f"{letters[0]}{i}"] for i in range(1, plain + 1)}
        two = {j * order.m: coefs[f"{letters[1]}{j}"] for j in range(1, (seasonal if order.m else 0) + 1)}
        for lag, c in [*one.items(), *two.items(), *((i + j, sign * x * y) for i, x in one.items() for j, y in two.items())]:
            target[lag] = target.get(lag, 0.0) + c
    return Fit(order, coefs, own, error, long, rss, used, size)


def roll_forward(order: Order, fits: list[Fit], levels: np.ndarray, horizon: int,
                 drive: np.ndarray | None = None) -> np.ndarray:
    """``horizon`` levels after the training rows of many series that share an order: one row each.

    A step advances all series at once, and a series gets the same numbers whatever others are beside it. Future
    residuals are zero. ``drive`` (series x horizon) is what known future exog adds.
    """
    weights = difference_weights(*order.kind)
    reach, past = len(weights) - 1, levels.shape[1]
    path = np.concatenate([levels, np.zeros((len(fits), horizon))], axis=1)
    diffs, noise = np.zeros_like(path), np.zeros_like(path)
    steps = [(i, c) for i, c in enumerate(weights) if c]
    for i, c in steps:
        diffs[:, reach:past] += c * path[:, reach - i:past - i]

    def column(pick) -> np.ndarray:
        return np.array([pick(f) for f in fits], dtype=float)

    own = [(lag, column(lambda f: f.own[lag])) for lag in order.own_lags()]
    errors = [(lag, column(lambda f: f.error[lag])) for lag in order.error_lags()]
    if errors:
        lags = order.first_lags()
        start = min(reach + max(lags), past)  # unknown before the first lags are
        noise[:, start:past] = diffs[:, start:past] - column(lambda f: f.first[0])[:, None]
        for b in lags:
            noise[:, start:past] -= column(lambda f: f.first[b])[:, None] * diffs[:, start - b:past - b]
    constant = column(lambda f: f.coefs.get("one", 0.0))
    for t in range(past, past + horizon):
        w = constant.copy() if drive is None else constant + drive[:, t - past]
        for lag, c in own:
            w += c * diffs[:, t - lag]
        for lag, c in errors:
            w += c * noise[:, t - lag]
        diffs[:, t] = w
        for i, c in steps[1:]:
            w = w - c * path[:, t - i]
        path[:, t] = w
    return path[:, past:]


_RESULT = ("status string, error string, aic double, n_used long, coefs map<string,double>, "
           "path array<double>")


@dataclass
class Task:
    """A fitted key and what its forecast starts from."""

    fit: Fit
    levels: np.ndarray
    drive: np.ndarray | None


def _fitted(row, design: Design, exog_mode: str) -> Task:
    order = Order(*[int(row[k]) for k in ORDER_COLUMNS])
    use_exog = bool(row["use_exog"])
    h, held = int(row["h"]), int(row["held"])
    if use_exog and not design.exog:
        raise ValueError("exogenous columns are required")
    if int(row["n"]) - held <= h and row["kind"] == "backtest":
        raise ValueError("series too short for the backtest window")
    needed = {second_needs(order, use_exog), *([first_needs(order)] if order.moving else [])}
    if not needed <= set(design.needs.get(order.kind, [])):
        raise ValueError(f"order {order} is not in the grid of the job")
    sums = Sums(design, order.kind, row["parts"])
    fit = fit_order(order, sums, held, use_exog)
    closes = row["closes"]
    train = len(closes) - held
    drive = None
    if use_exog:
        past = np.array(row["xs"][:train], dtype=float)
        if exog_mode == "actual" and held:
            future = np.array(row["xs"][train:], dtype=float)
        else:
            shocks = np.array([list(s) for s in row["shocks"]], dtype=float)[:, :h]
            mean, spread = sums.moves(held)
            rets = mean[:, None] + spread[:, None] * shocks
            future = (past[-1][:, None] * np.cumprod(1 + rets, axis=1)).T
        xs, weights = np.vstack([past, future]), difference_weights(*order.kind)
        moved = sum(c * xs[len(weights) - 1 - i:len(xs) - i] for i, c in enumerate(weights))
        drive = moved[-h:] @ np.array([fit.coefs[f"x{i}"] for i in range(1, len(design.exog) + 1)])
    return Task(fit, closes[:train], drive)


def forecast_paths(tasks: list[tuple[int, Task]]) -> dict[int, np.ndarray]:
    """{number: path} for tasks given with their horizons; those of one order, horizon and length go together."""
    groups: dict[tuple, list[int]] = {}
    for i, (h, task) in enumerate(tasks):
        groups.setdefault((task.fit.order, h, len(task.levels), task.drive is None), []).append(i)
    out = {}
    for (order, h, _, plain), rows in groups.items():
        mine = [tasks[i][1] for i in rows]
        paths = roll_forward(order, [t.fit for t in mine], np.stack([t.levels for t in mine]), h,
                             None if plain else np.stack([t.drive for t in mine]))
        out.update(zip(rows, paths))
    return out


def _rows(batch: pa.StructArray) -> list[dict]:
    """The rows as dicts, with the closing prices as an array each (a null is not a number)."""
    names = [field.name for field in batch.type]
    columns = [batch.field(i) for i in range(len(names))]
    values = [[np.asarray(x.values.to_numpy(zero_copy_only=False), float) for x in column] if name == "closes" else column.to_pylist()
              for name, column in zip(names, columns)]
    return [dict(zip(names, row)) for row in zip(*values)]


def forecast_batch(design: Design, exog_mode: str):
    """Function over a batch of (series, task) rows. The recursion needs one row per key and no
    neighbours, so batches of any size do; ``SLICE`` rows of one are Python objects at a time."""
    kinds = [pa.string(), pa.string(), pa.float64(), pa.int64(), pa.map_(pa.string(), pa.float64()), pa.list_(pa.float64())]
    names = ["status", "error", "aic", "n_used", "coefs", "path"]

    def some(batch: pa.StructArray) -> pa.StructArray:
        rows, ready, errors = _rows(batch), [], {}
        for i, row in enumerate(rows):
            try:
                ready.append((i, int(row["h"]), _fitted(row, design, exog_mode)))
            except Exception as problem:  # one failing key must not stop the others
                errors[i] = str(problem)
        paths = forecast_paths([(h, task) for _, h, task in ready])
        out = [("error", errors.get(i), None, None, None, None) for i in range(len(rows))]
        for j, (i, _, task) in enumerate(ready):
            fit = task.fit
            if not np.all(np.isfinite(paths[j])):
                out[i] = ("error", "the forecast diverged", None, None, None, None)
                continue
            out[i] = ("ok", None, aic(fit.rss, fit.used, fit.size), fit.used, list(fit.coefs.items()), paths[j])
        return pa.StructArray.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out), kinds)], names)

    def run(rows: pa.Array) -> pa.Array:
        if not len(rows):
            return pa.array([], pa.struct(list(zip(names, kinds))))
        return pa.concat_arrays([some(rows.slice(at, SLICE)) for at in range(0, len(rows), SLICE)])

    return run


def _forecaster(design: Design, exog_mode: str):
    batch = forecast_batch(design, exog_mode)

    def run(rows: pa.Array) -> pa.Array:
        return batch(rows)

    # kept in one place of the plan: a deterministic function would be evaluated again
    # for every filter and column taken from its result
    return F.arrow_udf(run, _RESULT).asNondeterministic()


def hashed_normal(*parts: Column) -> Column:
    """Standard normal draw fixed by its arguments (Box-Muller on two hashes)."""
    def uniform(salt: int) -> Column:
        bits = F.pmod(F.xxhash64(*parts, F.lit(salt)), F.lit(1 << 52))
        return (bits.cast("double") + 0.5) / float(1 << 52)

    return F.sqrt(-2 * F.ln(uniform(1))) * F.cos(2 * np.pi * uniform(2))


def _orders_of(models: list[str], steps: list[int], season: int | None, plain: list[tuple]) -> list[tuple[Order, bool]]:
    """Every order that a job may fit: those of ``plain`` as each model and horizon reads them."""
    out = set()
    for (p, d, q, P, D, Q), model, s in itertools.product(plain, models, steps):
        h = S.business_horizon(s)
        m = season or (5 if h <= 30 else 20 if h <= 365 else 252)
        out.add((Order(p, d, q, *((P, D, Q, m) if model != "arima" else (0, 0, 0, 0))), model == "sarimax"))
    return sorted(out, key=lambda x: (x[0].kind, str(x)))


def _kind_number(design: Design) -> Column:
    cases = " ".join(f"when d = {d} and sd = {D} and m = {m} then {i}" for i, (d, D, m) in enumerate(design.kinds))
    return F.expr(f"case {cases} end")


def _needed_kinds(params: DataFrame, models: list[str], steps: list[int], defaults, season, design: Design):
    """Column: numbers of the kinds of a series, from the map ``_own`` of its configured models; and the table of these maps."""
    rows = with_parameters(params.select("symbol", "model", F.explode(F.array(*[F.lit(int(s)) for s in steps])).alias("steps")),
                           params, defaults, season)
    maps = (rows.where(F.col("model").isin(models)).groupBy("symbol", "model").agg(F.collect_set(_kind_number(design)).alias("k"))
            .groupBy("symbol").agg(F.map_from_entries(F.collect_list(F.struct("model", "k"))).alias("_own")))
    parts = []
    for model in models:
        order = tuple((defaults or {}).get(model, S.DEFAULT_ORDER + S.DEFAULT_SEASONAL))[:6]
        mine = sorted({design.kinds.index(o.kind) for o, _ in _orders_of([model], steps, season, [order])})
        parts.append(F.coalesce(F.try_element_at("_own", F.lit(model)), F.array(*[F.lit(i) for i in mine])))
    return maps, F.array_distinct(F.flatten(F.array(*parts)))


def forecast_all(panel: DataFrame, *, models: list[str], steps: list[int],
                 params: dict[tuple[str, str], tuple] | DataFrame, defaults: dict[str, tuple] | None = None,
                 exog: tuple[str, ...] = (), exog_mode: str = "simulated", seed: int = 7,
                 kinds: tuple[str, ...] = ("backtest", "future"), season: int | None = None,
                 grid: list[Order] | None = None, only: DataFrame | None = None) -> DataFrame:
    """One row per (symbol, model, steps, kind) with status, fit and forecast path.

    ``panel`` holds symbol, date, close and the exog columns. ``params`` gives orders by symbol and model, as configuration
    or as a table (symbol, model, p, d, q, sp, sd, sq) such as ``tuned`` returns; a table needs ``grid``, the orders
    that its rows may name. ``only`` (symbol, model, steps) restricts the work to some keys.
    """
    spark = panel.sparkSession
    plain = [tuple((defaults or {}).get(m, S.DEFAULT_ORDER + S.DEFAULT_SEASONAL))[:6] for m in models]
    if isinstance(params, dict):
        plain += [tuple(o)[:6] for (_, model), o in params.items() if model in models]
        params = parameter_rows(spark, params)
    elif grid is None:
        raise ValueError("a table of orders needs the grid its rows are from")
    plain += [(o.p, o.d, o.q, o.P, o.D, o.Q) for o in grid or []]
    held = [S.business_horizon(s) for s in steps] if "backtest" in kinds else []
    design = design_of(_orders_of(models, steps, season, plain), held, exog)

    maps, wanted = _needed_kinds(params, models, steps, defaults, season, design)
    found = _summaries(panel.join(maps, "symbol", "left").withColumn("kinds", wanted).drop("_own"), design)
    tasks = with_parameters(work_grid(found.select("symbol", "n", "tail", "parts"), models, steps), params, defaults, season)
    if only is not None:
        tasks = tasks.join(only.select("symbol", "model", "steps"), ["symbol", "model", "steps"], "left_semi")
    ready = tasks.withColumn("kind", F.explode(F.array(*[F.lit(k) for k in kinds]))).withColumns({
        "held": F.when(F.col("kind") == "backtest", F.col("h")).otherwise(0), "use_exog": F.col("model") == "sarimax"})
    number = _kind_number(design)
    ready = ready.withColumn("_kind", number).withColumn(
        "parts", F.filter("parts", lambda x: x["kind"] == F.col("_kind"))).drop("_kind")
    if exog:
        ready = ready.withColumn("shocks", F.array(*[
            F.transform(F.sequence(F.lit(1), F.col("h")),
                        lambda k, c=c: hashed_normal(F.lit(seed), F.lit(c), k)) for c in exog]))
    # dates stay outside: of the last rows only plain numbers go to Python
    inputs = [*ORDER_COLUMNS, "h", "held", "kind", "use_exog", "n", "parts", F.expr("tail.close").alias("closes")]
    inputs += [F.expr("tail.xs").alias("xs"), "shocks"] if exog else []
    run = _forecaster(design, exog_mode)
    start = F.try_element_at("tail", -(F.col("held") + 1).cast("int"))
    test = F.when((F.col("held") > 0) & (F.size("tail") >= F.col("held")), F.slice(
        "tail", -F.greatest(F.col("held"), F.lit(1)), F.greatest(F.col("held"), F.lit(1)))).otherwise(F.slice("tail", 1, 0))
    return ready.withColumn("fit", run(F.struct(*inputs))).select(
        "symbol", "model", "steps", "kind", "h", *ORDER_COLUMNS,
        "fit.status", "fit.error", "fit.aic", "fit.n_used", "fit.coefs", "fit.path",
        F.greatest(F.col("n") - F.col("held"), F.lit(0)).alias("n_train"),
        start["close"].alias("last_price"), start["date"].alias("last_date"),
        F.transform(test, lambda t: F.struct(t["date"].alias("date"), t["close"].alias("actual"))).alias("test"))


def forecast_points(fits: DataFrame) -> DataFrame:
    """One row per forecast day. Held-out days come with their actual price, future
    days are the next business days."""
    days = F.when(F.col("kind") == "backtest", F.transform("test", lambda t: t["date"])).otherwise(
        next_business_days("last_date", F.col("h")))
    actual = F.when(F.col("kind") == "backtest", F.transform("test", lambda t: t["actual"]))
    return fits.where(F.col("status") == "ok").select(
        "symbol", "model", "steps", "kind", "last_price", "path", days.alias("days"),
        F.coalesce(actual, F.transform("path", lambda p: F.lit(None).cast("double"))).alias("acts"),
    ).select(
        "symbol", "model", "steps", "kind", "last_price",
        F.posexplode(F.arrays_zip("days", "path", "acts")),
    ).select(
        "symbol", "model", "steps", "kind", (F.col("pos") + 1).alias("step"),
        F.col("col.days").alias("date"), F.col("col.path").alias("price"),
        F.col("col.acts").alias("actual"), "last_price")


# ---- order search -----------------------------------------------------------
def order_grid(p=(0, 2), d=(0, 1), q=(0, 2), P=(0, 0), D=(0, 0), Q=(0, 0), m: int = 0) -> list[Order]:
    """Orders in search order: the earlier wins a tie."""
    ranges = [range(a, b + 1) for a, b in (p, d, q, P, D, Q)]
    return [Order(*o, m) for o in itertools.product(*ranges)]


ARIMA_GRID = order_grid()
SEASONAL_GRID = order_grid((0, 1), (0, 1), (0, 1), (0, 1), (0, 1), (0, 1), 12)


def score_batch(design: Design, orders: list[Order], exog: bool):
    """Function over a batch of (kind, sums) rows to the scores of the orders of the kind; ``SLICE`` rows are Python
    objects at a time."""
    ranks = {k: [(rank, o) for rank, o in enumerate(orders) if o.kind == k] for k in design.kinds}
    long = {k: sorted({b for _, o in ranks[k] if o.moving for b in o.first_lags()}) for k in design.kinds}
    result = pa.list_(pa.struct([*((c, pa.int32()) for c in ("rank", *ORDER_COLUMNS)), ("n_used", pa.int64()), ("aic", pa.float64())]))

    def row(i: int, parts: list[dict]) -> list[dict]:
        k, rows = design.kinds[i], []
        sums, need = Sums(design, k, parts), design.needs[k][0]
        for rank, o in ranks[k]:
            try:
                fit = fit_order(o, sums, 0, exog, needs=(need, need), first=long[k])
            except (ValueError, np.linalg.LinAlgError):
                continue  # a fit that is not possible is skipped
            rows.append({"rank": rank, "p": o.p, "d": o.d, "q": o.q, "sp": o.P, "sd": o.D, "sq": o.Q, "m": o.m,
                         "n_used": fit.used, "aic": aic(fit.rss, fit.used, fit.size)})
        return rows

    def run(kind: pa.Array, parts: pa.Array) -> pa.Array:
        some = [pa.array(list(map(row, *(x.slice(at, SLICE).to_pylist() for x in (kind, parts)))), result)
                for at in range(0, len(kind), SLICE)]
        return pa.concat_arrays(some) if some else pa.array([], result)

    return run


def order_search(panel: DataFrame, orders: list[Order], exog: tuple[str, ...] = ()) -> DataFrame:
    """AIC of every order for every series: (symbol, rank, order, n_used, aic).

    All orders of one differencing read the same sums over the same rows, so the data is
    passed once and not once per order.
    """
    design = design_of([(o, bool(exog)) for o in orders], [], exog, shared=True)
    ranks = {k: [(rank, o) for rank, o in enumerate(orders) if o.kind == k] for k in design.kinds}
    long = {k: sorted({b for _, o in ranks[k] if o.moving for b in o.first_lags()}) for k in design.kinds}
    batch = score_batch(design, orders, bool(exog))

    @F.arrow_udf("array<struct<rank:int,p:int,d:int,q:int,sp:int,sd:int,sq:int,m:int,n_used:long,aic:double>>")
    def scores(kind: pa.Array, parts: pa.Array) -> pa.Array:
        return batch(kind, parts)

    parts = segment_sums(panel, design).groupBy("symbol", "kind").agg(
        F.collect_list(F.struct("kind", "seg", "known", "n_rows", "gram", "moves")).alias("parts"))
    return parts.select("symbol", F.inline(scores("kind", "parts")))


def tuned(panel: DataFrame, orders: list[Order], models: list[str], exog: tuple[str, ...] = ()) -> DataFrame:
    """Best order of each series for ``models``, as a table that ``forecast_all`` takes."""
    best = best_orders(order_search(panel, orders, exog))
    return best.select("symbol", F.explode(F.array(*[F.lit(m) for m in models])).alias("model"), *ORDER_COLUMNS)


def best_orders(scores: DataFrame) -> DataFrame:
    """Smallest AIC per series, the first of equals."""
    body = F.struct(*[c for c in scores.columns if c not in ("symbol",)])
    return scores.groupBy("symbol").agg(
        F.min_by(body, F.struct("aic", "rank")).alias("b")).select("symbol", "b.*")


def global_order(best: DataFrame) -> DataFrame:
    """Per chosen order: summed AIC over the series that chose it and their number,
    marked with the two ways to name one order for all."""
    keys = ORDER_COLUMNS
    sums = best.groupBy(*keys).agg(
        F.sum("aic").alias("aic_sum"), F.count("*").alias("series"), F.min("rank").alias("rank"),
        F.min("symbol").alias("first_symbol"))
    both = sums.agg(F.struct(
        F.min_by("rank", F.struct("aic_sum", "first_symbol")).alias("low"),
        F.min_by("rank", F.struct(-F.col("series"), "first_symbol")).alias("most"))).scalar()
    return sums.withColumns({"by_sum": F.col("rank") == both["low"], "by_mode": F.col("rank") == both["most"]})
