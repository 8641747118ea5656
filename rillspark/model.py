"""A run: what one or several result files say about features over time."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillspark.constants import VARIABLES
from rillspark.functions import values as V
from rillspark.plans.ranking import positions


#: Rows that a join may broadcast: time steps, or the paths of files.
BROADCAST_ROWS = 200_000


@dataclass(frozen=True)
class Run:
    """Cells are sparse: a row for each feature and time with any value, missing values null.

    ``cells(feature_id, time, flow, velocity, depth)``, ``features(feature_id, row_idx)``, ``times(time, t_idx)``.  ``time_kind`` is
    ``epoch_ms`` or ``offset_s``; ``variables`` are those that the files have, the others are null throughout.  ``slices`` gives the
    cells of one time where the layout they're stored in can find these faster than a filter.
    """

    cells: DataFrame
    features: DataFrame
    times: DataFrame
    time_kind: str = "epoch_ms"
    ref_time: str | None = None
    files: tuple[str, ...] = ()
    variables: tuple[str, ...] = VARIABLES
    slices: Callable[[int], DataFrame] | None = None

    def at_time(self, time: int) -> DataFrame:
        """The cells of one time."""
        return self.slices(time) if self.slices else self.cells.filter(F.col("time") == time)

    @cached_property
    def shape(self) -> tuple[int, int]:
        return self.features.count(), self.n_times

    @cached_property
    def n_times(self) -> int:
        return self.times.count()

    def steps(self) -> DataFrame:
        """The time axis for a join on time, broadcast if its size allows."""
        return F.broadcast(self.times) if self.n_times <= BROADCAST_ROWS else self.times

    def with_indices(self) -> DataFrame:
        """Cells with row_idx and t_idx."""
        return self.cells.join(self.times, "time").join(self.features, "feature_id")

    def long(self) -> DataFrame:
        """``(feature_id, time, variable, value)``, a row for each valid value."""
        pairs = F.expr(f"stack({len(VARIABLES)}, {', '.join(f"'{v}', {v}" for v in VARIABLES)}) AS (variable, value)")
        return self.cells.select("feature_id", "time", pairs).filter("value IS NOT NULL")

    def replace(self, **changes) -> Run:
        """Other ``cells`` aren't those that ``slices`` reads."""
        return replace(self, **({"slices": None} if "cells" in changes else {}), **changes)

    def persist(self) -> Run:
        """The run with its cells and axes kept by Spark once they are computed, for several questions to one run."""
        return self.replace(cells=self.cells.persist(), features=self.features.persist(), times=self.times.persist())

    def unpersist(self) -> None:
        for part in (self.cells, self.features, self.times):
            part.unpersist()


def last_writes(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Of rows ``(feature_id, time, ord, flow, velocity, depth)`` the last value that isn't null, for each variable by itself.

    ``ord`` orders the rows as written.  A fill value is a value here: written last, it stays.  ``by`` are columns before the
    feature that keep rows apart.
    """
    last = [F.max_by(v, F.when(F.col(v).isNotNull(), F.col("ord"))).alias(v) for v in VARIABLES]
    return rows.groupBy(*by, "feature_id", "time").agg(*last)


def run_of(rows: DataFrame, time_kind: str = "epoch_ms", ref_time: str | None = None, files: tuple[str, ...] = (), variables: tuple[str, ...] = VARIABLES) -> Run:
    """A run of long rows.  Rows whose values are all null still put their feature and time on the axes."""
    rows = rows.filter("feature_id IS NOT NULL AND time IS NOT NULL")
    cells = last_writes(rows).select("feature_id", "time", *[V.valid(F.col(v)).alias(v) for v in VARIABLES])
    features = positions(rows.select("feature_id").distinct(), "feature_id", "row_idx")
    times = positions(rows.select("time").distinct(), "time", "t_idx", bits=40)
    return Run(cells, features, times, time_kind, ref_time, files, variables)
