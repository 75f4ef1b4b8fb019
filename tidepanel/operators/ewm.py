"""Recursive exponential means as a two-level scan.

``y[t] = (1-a) y[t-1] + a x[t]``, ``y[1] = x[1]``. A series is cut in blocks of B
rows. Inside a block the mean started from nothing is a running sum of
``a x (1-a)^-i`` scaled back by ``(1-a)^i``; what came before enters as the value
at the end of the previous block times ``(1-a)^(i+1)``. The end value of a block
holds its own partial plus ``D = (1-a)^B`` of the one before. B is chosen from the
slowest factor so that ``D < 2e-18``, and two earlier blocks are kept, so the cut of
the chain lies far below the last bit of a double.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

REACH = 2  # earlier blocks that are carried in


def block_rows(alphas) -> int:
    """Rows per block: long enough for the slowest factor to fade, short enough for the
    weights of the fastest one to stay far inside the range of a double."""
    fade = [-math.log1p(-a) for a in alphas]
    rows = math.ceil(41 / min(fade))
    if rows * max(fade) > 500:
        raise ValueError("smoothing factors are too far apart for one scan")
    return rows


def scans(alphas) -> list[list[float]]:
    """Smoothing factors in groups that share a scan each, slowest first."""
    groups: list[list[float]] = []
    for a in sorted(set(alphas)):
        try:
            block_rows([*(groups[-1] if groups else []), a])
        except ValueError:
            groups.append([a])
        else:
            groups[-1:] = [[*(groups[-1] if groups else []), a]]
    return groups


def alpha_of_span(n: int) -> float:
    return 2.0 / (n + 1)


def alpha_of_wilder(n: int) -> float:
    return 1.0 / n


def with_ewm(df: DataFrame, specs: dict[str, tuple[str, float]], key: str = "symbol",
             order: str = "date") -> DataFrame:
    """Add one recursive mean per entry ``output -> (input column, a)``.

    Entries whose factors are not too far apart share the same three window passes over one
    partitioning by key. The mean starts at the first known value; rows before it have none.
    After it inputs must not be null.
    """
    whole = W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    sofar = W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    inputs = sorted({x for x, _ in specs.values()})
    # leading nulls take the first known value, which is what the mean then starts from
    df = df.withColumns({f"_in_{x}": F.when(F.last(x, ignorenulls=True).over(sofar).isNull(), F.first(x, ignorenulls=True).over(whole))
                         .otherwise(F.col(x)) for x in inputs})
    for group in scans([a for _, a in specs.values()]):
        df = _scan(df, {o: (f"_in_{x}", a) for o, (x, a) in specs.items() if a in group}, key, order)
    known = {o: F.when(F.last(x, ignorenulls=True).over(sofar).isNotNull(), F.col(o)) for o, (x, _) in specs.items()}
    return df.withColumns(known).drop(*[f"_in_{x}" for x in inputs])


def _scan(df: DataFrame, specs: dict[str, tuple[str, float]], key: str, order: str) -> DataFrame:
    block = block_rows([a for _, a in specs.values()])
    rn = F.row_number().over(W.partitionBy(key).orderBy(order))
    marked = df.withColumn("_rn", rn).withColumns({
        "_blk": F.floor((F.col("_rn") - 1) / block).cast("int"),
        "_i": ((F.col("_rn") - 1) % block).cast("double"),
    })
    inside = (W.partitionBy(key, "_blk").orderBy("_rn")
              .rowsBetween(W.unboundedPreceding, W.currentRow))

    def partial(x: str, a: float) -> Column:
        gain = F.when(F.col("_rn") == 1, 1.0).otherwise(a)
        return (F.sum(gain * F.col(x) * F.pow(F.lit(1 - a), -F.col("_i"))).over(inside)
                * F.pow(F.lit(1 - a), F.col("_i")))

    parts = marked.withColumns({f"_p_{o}": partial(x, a) for o, (x, a) in specs.items()})
    ordered = W.partitionBy(key).orderBy("_blk")
    ends = F.struct(*[f"_p_{o}" for o in specs])
    joined = parts.withColumns({
        f"_end{back}": F.max_by(ends, "_rn").over(ordered.rangeBetween(-back, -back))
        for back in range(1, REACH + 1)
    })

    def carry(out: str, a: float) -> Column:
        total = F.lit(0.0)
        for back in range(1, REACH + 1):
            end = F.col(f"_end{back}")[f"_p_{out}"]
            total = total + F.coalesce(end, F.lit(0.0)) * (1 - a) ** (block * (back - 1))
        return total

    done = joined.withColumns({
        o: F.col(f"_p_{o}") + carry(o, a) * F.pow(F.lit(1 - a), F.col("_i") + 1)
        for o, (_, a) in specs.items()
    })
    drop = [f"_p_{o}" for o in specs] + [f"_end{b}" for b in range(1, REACH + 1)]
    drop += ["_rn", "_blk", "_i"]
    return done.drop(*drop)
