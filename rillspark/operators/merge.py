"""Several runs as one: the union of their times, features in the order first seen, and the last run's cells."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillspark.constants import VARIABLES
from rillspark.model import Run
from rillspark.plans.ranking import positions


def _stacked(parts: Sequence[DataFrame]) -> DataFrame:
    """The parts' union with ``ds``, each part's place."""
    return reduce(DataFrame.unionByName, [p.withColumn("ds", F.lit(i)) for i, p in enumerate(parts)])


def one_kind_of_time(kinds: set[str]) -> None:
    if len(kinds) > 1:
        raise ValueError(f"runs with different kinds of time can't be merged: {sorted(kinds)}")


def union_of_times(times: DataFrame) -> DataFrame:
    return positions(times.select("time").distinct(), "time", "t_idx", bits=40)


def first_seen(features: DataFrame) -> DataFrame:
    """``(feature_id, row_idx)`` by the first run that has a feature and its row there, of rows ``(ds, feature_id, row_idx)``."""
    first = features.groupBy("feature_id").agg(F.min(F.struct("ds", "row_idx")).alias("at")).select("feature_id", "at.ds", F.col("at.row_idx").alias("own"))
    return positions(first, "own", "row_idx", first=["ds"]).select("feature_id", "row_idx")


def merged_times(runs: Sequence[Run]) -> DataFrame:
    one_kind_of_time({r.time_kind for r in runs})
    return union_of_times(_stacked([r.times.select("time") for r in runs]))


def merged_features(runs: Sequence[Run]) -> DataFrame:
    return first_seen(_stacked([r.features.select("feature_id", "row_idx") for r in runs]))


def merged_cells(cells: DataFrame, features: DataFrame, times: DataFrame, having: Mapping[str, Sequence[int]]) -> DataFrame:
    """Of cells, features and times with ``ds`` each variable of the last run that has the variable, the feature and the time.

    Only what cells touch can be valid.  A run that has all three but no cell there makes it missing; one without the variable
    leaves what earlier runs say.
    """
    gathered = cells.groupBy("feature_id", "time").agg(F.collect_list(F.struct("ds", *VARIABLES)).alias("by"))  # at most one for each run
    of_feature = features.groupBy("feature_id").agg(F.collect_set("ds").alias("feature_runs"))
    of_time = times.groupBy("time").agg(F.collect_set("ds").alias("time_runs"))
    both = F.array_intersect("feature_runs", "time_runs").alias("runs")
    known = gathered.join(of_feature, "feature_id").join(of_time, "time").select("feature_id", "time", "by", both)

    def last(variable: str) -> Column:
        if not having[variable]:
            return F.lit(None).cast("float")
        run = F.array_max(F.array_intersect("runs", F.array(*[F.lit(i) for i in having[variable]])))
        return F.get(F.filter("by", lambda x: x["ds"] == run), 0)[variable]

    return known.select("feature_id", "time", *[last(v).alias(v) for v in VARIABLES])


def merge(runs: Sequence[Run], prefer_valid: bool = False) -> Run:
    """The merged run.  Of runs whose axes both have a feature and a time the last one gives the cell, missing or not.

    A run without a variable doesn't count for it.  With ``prefer_valid`` a missing value never covers a valid one.  Runs without
    a common feature need neither: use ``merge_disjoint``.
    """
    cells = _stacked([r.cells for r in runs])
    having = {v: [i for i, r in enumerate(runs) if v in r.variables] for v in VARIABLES}
    if prefer_valid:
        last = [F.max_by(v, F.when(F.col(v).isNotNull(), F.col("ds"))).alias(v) for v in VARIABLES]
        merged = cells.groupBy("feature_id", "time").agg(*last)
    else:
        merged = merged_cells(cells, _stacked([r.features.select("feature_id") for r in runs]), _stacked([r.times.select("time") for r in runs]), having)
    return _as_one(runs, merged, having)


def merge_disjoint(runs: Sequence[Run]) -> Run:
    """The merged run of runs without a common feature: their cells' union, nothing shuffled."""
    having = {v: [i for i, r in enumerate(runs) if v in r.variables] for v in VARIABLES}
    return _as_one(runs, reduce(DataFrame.unionByName, [r.cells for r in runs]), having)


def share_no_feature(runs: Sequence[Run]) -> bool:
    """Whether no two runs have a feature in common, by their axes alone.

    One pass over the axes gives each run's least and largest id: ranges that don't meet prove it.  Only the ids of runs whose
    ranges do meet are counted, which shuffles ids and no cell.
    """
    axes = _stacked([r.features.select("feature_id") for r in runs])
    ends = {r.ds: (r.low, r.high) for r in axes.groupBy("ds").agg(F.min("feature_id").alias("low"), F.max("feature_id").alias("high")).collect()}  # a row for each run
    meet = {i for i, (a, b) in ends.items() for j, (c, d) in ends.items() if i != j and a <= d and c <= b}
    if not meet:
        return True
    often = axes.filter(F.col("ds").isin(*meet)).distinct().groupBy("feature_id").agg(F.count(F.lit(1)).alias("n"))
    return often.filter("n > 1").isEmpty()


def merge_any(runs: Sequence[Run]) -> Run:
    """``merge_disjoint`` where the runs' axes prove that nothing can cover anything, else ``merge``."""
    return merge_disjoint(runs) if share_no_feature(runs) else merge(runs)


def _as_one(runs: Sequence[Run], cells: DataFrame, having: Mapping[str, Sequence[int]]) -> Run:
    files = sum((r.files for r in runs), ())
    return Run(cells, merged_features(runs), merged_times(runs), runs[0].time_kind, runs[0].ref_time, files, tuple(v for v in VARIABLES if having[v]))
