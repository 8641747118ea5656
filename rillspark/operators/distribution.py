"""Samples, quantiles and natural breaks of a variable."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillspark.constants import JENKS_VALUES, PALETTE, SAMPLE_CELLS
from rillspark.functions.scales import strictly_increasing
from rillspark.model import Run

CLASSES = len(PALETTE)


def stride(run: Run) -> int:
    n_features, n_times = run.shape
    return max(1, n_features * n_times // SAMPLE_CELLS)


def value_sample(run: Run, variable: str) -> DataFrame:
    """``(cell_idx, value)``: every so manieth cell of the dense grid, as far as it is valid.

    Cells are numbered feature by feature; the grid itself is never made.  Below 2 x SAMPLE_CELLS rows, whatever the run's size:
    the sampled places are made from the axes' lengths, and only the cells at these are looked up.
    """
    n_features, n_times = run.shape
    every = stride(run)
    n = -(-n_features * n_times // every)
    places = run.cells.sparkSession.range(n).select((F.col("id") * every).alias("cell_idx"))
    places = places.select("cell_idx", F.floor(F.col("cell_idx") / max(1, n_times)).alias("row_idx"), F.pmod("cell_idx", F.lit(max(1, n_times))).alias("t_idx"))
    # Below 2 x SAMPLE_CELLS rows of a few numbers, so these places are small enough to broadcast.
    named = run.features.join(F.broadcast(places), "row_idx").join(run.steps(), "t_idx")
    wanted = named.select("feature_id", "time", "cell_idx")
    cells = run.cells.filter(F.col(variable).isNotNull()).select("feature_id", "time", F.col(variable).cast("double").alias("value"))
    return cells.join(F.broadcast(wanted), ["feature_id", "time"]).select("cell_idx", "value")


def quantiles(run: Run, variable: str, at: list[float]) -> list[float]:
    """Interpolated quantiles of the sample, 0 if it is empty."""
    found = value_sample(run, variable).agg(F.percentile("value", F.array(*[F.lit(p) for p in at])).alias("q")).first().q
    return list(found) if found else [0.0] * len(at)


def quantile_stops(run: Run, variable: str) -> list[float]:
    return strictly_increasing(quantiles(run, variable, [i / (CLASSES - 1) for i in range(CLASSES)]))


def quantile_class_breaks(run: Run, variable: str) -> list[float]:
    return strictly_increasing(quantiles(run, variable, [i / CLASSES for i in range(1, CLASSES)]))


def jenks_sample(run: Run, variable: str, cap: int = JENKS_VALUES) -> DataFrame:
    """``(i, value)``: the sorted sample, thinned evenly to ``cap`` values if it has more."""
    # The sample is bounded, so is this window.
    ranked = value_sample(run, variable).select("value", (F.row_number().over(Window.orderBy("value", "cell_idx")) - 1).alias("rank"), F.count(F.lit(1)).over(Window.partitionBy()).alias("n"))
    thinned = ranked.sparkSession.range(cap).select(F.col("id").cast("int").alias("i"))
    step = F.col("n") / F.lit(float(cap))
    picked = ranked.filter(F.col("n") > cap).join(F.broadcast(thinned), F.floor(F.col("i") * step) == F.col("rank"))
    return picked.select("i", "value").unionByName(ranked.filter(F.col("n") <= cap).select(F.col("rank").alias("i"), "value"))


def natural_breaks(values: list[float], classes: int = CLASSES) -> list[float]:
    """The inner boundaries, each the first value of its class, that make the classes' sums of squared deviations least.

    Of equal sums the one with the earlier boundary.  With fewer different values than classes every value but the least is a
    boundary.
    """
    data = np.sort(np.asarray(values, float))
    distinct = np.unique(data)
    if len(distinct) <= classes:
        return distinct[1:].tolist()
    n = len(data)
    sums, squares, count = (np.concatenate(([0.0], np.cumsum(x))) for x in (data, data**2, np.ones(n)))

    def deviation(a: np.ndarray, b: int) -> np.ndarray:
        """Of the values from a (many) to before b."""
        s, k = sums[b] - sums[a], count[b] - count[a]
        return squares[b] - squares[a] - s * s / k

    cost = np.array([0.0, *(deviation(np.array([0]), b)[0] for b in range(1, n + 1))])
    starts = []
    for k in range(2, classes + 1):
        best, at = np.full(n + 1, np.inf), np.zeros(n + 1, int)
        for b in range(k, n + 1):
            a = np.arange(k - 1, b)
            total = cost[a] + deviation(a, b)
            at[b] = a[int(total.argmin())]
            best[b] = total.min()
        cost = best
        starts.append(at)
    out, end = [], n
    for at in reversed(starts):
        end = int(at[end])
        out.append(float(data[end]))
    return out[::-1]


def jenks_breaks(run: Run, variable: str) -> list[float]:
    """Natural breaks of at most JENKS_VALUES sampled values, strictly increasing."""
    return strictly_increasing(natural_breaks([r.value for r in jenks_sample(run, variable).collect()]))
