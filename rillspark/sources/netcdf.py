"""NetCDF4 result files as a Spark data source.  Decoding needs the optional package h5py."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

VARIABLES = ("flow", "velocity", "depth")
SCHEMA = "ds int, feature_id long, time long, row_idx long, t_idx long, flow float, velocity float, depth float, variables string, ref_time string"
#: Cells of an Arrow batch.
CELLS = 1 << 18


@dataclass
class Wanted:
    """What filters leave of an axis: values within bounds, both included, and among a set if there is one."""

    low: int = -(1 << 63)
    high: int = (1 << 63) - 1
    among: set[int] | None = field(default=None)

    def add(self, f: Filter) -> bool:
        """Take in a filter on whole numbers; False if it isn't one of those known."""
        if isinstance(f, IsNotNull):
            return True
        values = f.value if isinstance(f, In) else [getattr(f, "value", None)]
        if not all(isinstance(v, int) and not isinstance(v, bool) for v in values):
            return False
        if isinstance(f, (EqualTo, In)):
            self.among = set(values) if self.among is None else self.among & set(values)
        elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
            self.low = max(self.low, values[0] + isinstance(f, GreaterThan))
        elif isinstance(f, (LessThan, LessThanOrEqual)):
            self.high = min(self.high, values[0] - isinstance(f, LessThan))
        else:
            return False
        return True

    @property
    def is_all(self) -> bool:
        return self == Wanted()

    def of(self, values: np.ndarray) -> np.ndarray:
        """The places of the wanted values."""
        there = (values >= self.low) & (values <= self.high)
        if self.among is not None:
            there &= np.isin(values, np.fromiter(self.among, np.int64, len(self.among)))
        return np.flatnonzero(there)


class Rows(InputPartition):
    def __init__(self, path: str, ds: int, first: int, last: int):
        self.path, self.ds, self.first, self.last = path, ds, first, last


def open_arrays(path: str):
    """The file's arrays: a local file as it is, one in a store by ranges through Arrow's file systems."""
    import h5py

    if "://" not in path:
        return h5py.File(path.removeprefix("file:"), "r")
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path)
    return h5py.File(store.open_input_file(name), "r")


class NetCdfReader(DataSourceReader):
    """Splits files by features: arrays are stored feature by feature, so a split is one stretch of each.

    Filters on ids and times become slices of the arrays, and a split without a wanted id is left out; only ``variables`` are read.
    With ``skip`` a file that can't be opened, or has no ids or times, is left out.
    """

    def __init__(self, paths: list[tuple[int, str]], features_a_split: int = 10_000, skip: bool = False, variables: Sequence[str] = VARIABLES):
        self.paths, self.step, self.skip, self.variables = paths, features_a_split, skip, tuple(variables)
        self.wanted = {"feature_id": Wanted(), "time": Wanted()}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Keeps the filters on ids and times; gives those back that Spark has to apply."""
        for f in filters:
            column = getattr(f, "attribute", ())
            if len(column) != 1 or column[0] not in self.wanted or not self.wanted[column[0]].add(f):
                yield f

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for ds, path in self.paths:
            try:
                with open_arrays(path) as file:
                    n = min(len(file["feature_id"]), len(file["feature_id"]) * len(file["time"]))
                    starts = range(0, n, self.step)
                    if not self.wanted["feature_id"].is_all:
                        starts = [i for i in starts if len(self.wanted["feature_id"].of(np.asarray(file["feature_id"][i : min(n, i + self.step)]).astype(np.int64)))]
            except (OSError, KeyError):  # no such file, none of this format, or an array that isn't there
                if not self.skip:
                    raise
                continue
            out += [Rows(path, ds, i, min(n, i + self.step)) for i in starts]
        return out

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        with open_arrays(partition.path) as file:
            yield from dense_batches(file, dict(file.attrs), partition.first, partition.last, partition.ds, self.wanted["feature_id"], self.wanted["time"], self.variables)


def dense_batches(
    arrays: Mapping, attributes: Mapping, first: int, last: int, ds: int = 0, features: Wanted = Wanted(), steps: Wanted = Wanted(), variables: Sequence[str] = VARIABLES
) -> Iterator[pa.RecordBatch]:
    """The wanted cells of the features ``first`` to before ``last`` from flat arrays; a missing or short array gives nulls."""
    times = np.asarray(arrays["time"][:]).astype(np.int64) if "time" in arrays else np.zeros(0, np.int64)
    n, at_times = len(times), steps.of(times)
    ref = attributes.get("file_reference_time")
    ref = ref.decode() if isinstance(ref, bytes) else ref
    there = ",".join(v for v in VARIABLES if v in arrays)
    step = max(1, CELLS // max(1, len(at_times)))
    for at in range(first, last if len(at_times) else first, step):
        ids = np.asarray(arrays["feature_id"][at : min(last, at + step)]).astype(np.int64)
        rows = features.of(ids)
        size = len(rows) * len(at_times)
        if not size:
            continue
        columns = [
            pa.repeat(pa.scalar(ds, pa.int32()), size),
            pa.array(np.repeat(ids[rows], len(at_times))),
            pa.array(np.tile(times[at_times], len(rows))),
            pa.array(np.repeat(at + rows.astype(np.int64), len(at_times))),
            pa.array(np.tile(at_times.astype(np.int64), len(rows))),
            *[_values(arrays.get(v) if v in variables else None, at + rows, at_times, n) for v in VARIABLES],
            pa.repeat(pa.scalar(there, pa.string()), size),
            pa.repeat(pa.scalar(ref, pa.string()), size),
        ]
        yield pa.RecordBatch.from_arrays(columns, [c.split(" ")[0] for c in SCHEMA.split(", ")])


def _values(array, rows: np.ndarray, steps: np.ndarray, n: int) -> pa.Array:
    """The values at rows and steps of a flat array, or of one with a row for each feature, nulls where it ends early.

    Each stretch of neighbouring rows is read once, or, where less than half of the steps are wanted, each row's steps from the
    first to the last of them.
    """
    if array is None:
        return pa.nulls(len(rows) * len(steps), pa.float32())
    out = np.full((len(rows), len(steps)), np.nan, np.float32)
    known = np.zeros(out.shape, bool)
    low, high = int(steps[0]), int(steps[-1]) + 1
    starts = np.flatnonzero(np.diff(rows, prepend=rows[0] - 2) != 1)
    for i, j in zip(starts, np.append(starts[1:], len(rows)), strict=True):
        a, b = int(rows[i]), int(rows[j - 1]) + 1
        if len(getattr(array, "shape", (0,))) > 1:
            part = np.asarray(array[a:b, low:high])
            part, there = part[:, steps - low], np.ones((len(part), len(steps)), bool)
        elif 2 * (high - low) < n:
            part, there = _padded([np.asarray(array[r * n + low : r * n + high]) for r in range(a, b)], high - low)
            part, there = part[:, steps - low], there[:, steps - low]
        else:
            flat = np.asarray(array[a * n : b * n])
            part, there = _padded([flat[k * n : (k + 1) * n] for k in range(b - a)], n)
            part, there = part[:, steps], there[:, steps]
        out[i : i + len(part)], known[i : i + len(part)] = part, there
    return pa.array(out.ravel(), mask=~known.ravel())


def _padded(rows: list[np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of n values, and which of them there are."""
    out, there = np.zeros((len(rows), n), np.float32), np.zeros((len(rows), n), bool)
    for k, row in enumerate(rows):
        out[k, : len(row)], there[k, : len(row)] = row, True
    return out, there


class NetCdfSource(DataSource):
    """Options: ``path``, or ``paths`` as a JSON list of numbers and paths; ``featuresPerSplit``; ``skipUnreadable``; ``variables`` to read, the others are null."""

    @classmethod
    def name(cls) -> str:
        return "rill_netcdf"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> NetCdfReader:
        paths = [(int(i), p) for i, p in json.loads(self.options["paths"])] if "paths" in self.options else [(0, self.options["path"])]
        variables = [v.strip() for v in self.options.get("variables", ",".join(VARIABLES)).split(",")]
        return NetCdfReader(paths, int(self.options.get("featuresPerSplit", 10_000)), self.options.get("skipUnreadable", "false").lower() == "true", variables)
