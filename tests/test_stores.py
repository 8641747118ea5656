"""Loading, storing, browsing and streaming, on small tables and files made by hand."""

from __future__ import annotations

import datetime as dt
import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, GreaterThanOrEqual, In, IsNotNull, LessThan, StringStartsWith

from rillspark.model import run_of
from rillspark.operators import merge, series, spatial
from rillspark.plans import runtree, views
from rillspark.sources import listing, netcdf, results, shared, stored
from rillspark.streaming import ingest

SCHEMA = "feature_id long, time long, ord long, flow float, velocity float, depth float"
DAY = stored.DAY_MS


def make(spark, rows):
    return run_of(spark.createDataFrame([(f, t, i, *(*v, None, None, None)[:3]) for i, (f, t, *v) in enumerate(rows)], SCHEMA))


def cells(run):
    return {(r.feature_id, r.time): (r.flow, r.velocity, r.depth) for r in run.cells.collect()}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# Listing and loading a cycle


def region(folder, name, rows, spark, file="part.parquet"):
    at = folder / name / "ngen-run/outputs/troute"
    at.mkdir(parents=True, exist_ok=True)
    schema = "feature_id long, time long, flow double"
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{at}/{file}")
    return at


def test_regions_are_listed_by_tasks_and_failures_are_rows(spark, tmp_path):
    region(tmp_path, "VPU_02", [(1, 0, 1.0)], spark)
    (tmp_path / "VPU_03" / "ngen-run/outputs").mkdir(parents=True)
    (tmp_path / "VPU_03" / "ngen-run/outputs/troute").write_bytes(b"no folder")
    (tmp_path / "VPU_04").mkdir()
    (tmp_path / "other").mkdir()
    at = tmp_path / "vpu-1" / "ngen-run/outputs/troute/deep"
    at.mkdir(parents=True)
    for name in ("b.nc", "a.nc", "log.txt", ".hidden.nc"):
        (at / name).write_bytes(b"12")
    found = listing.cycle_files(spark, f"file://{tmp_path}")
    assert found.rdd.getNumPartitions() == 4  # a task for each region folder
    rows = found.collect()
    by = {}
    for r in rows:
        by.setdefault(r.region.rstrip("/").rsplit("/", 1)[1], []).append(r)
    assert set(by) == {"VPU_02", "VPU_03", "vpu-1"}
    assert by["VPU_03"][0].key is None and by["VPU_03"][0].problem
    assert [(r.key.rsplit("/", 1)[1], r.length) for r in by["vpu-1"]] == [("a.nc", 2), ("b.nc", 2)]
    assert [r.ds for r in (by["VPU_02"][0], by["VPU_03"][0], by["vpu-1"][0])] == [0, 1, 3]


def test_a_cycle_is_one_run(spark, tmp_path):
    region(tmp_path, "VPU_01", [(1, 0, 1.0), (2, 0, 2.0)], spark)
    at = region(tmp_path, "VPU_02", [(2, 0, 5.0), (3, 60, None)], spark)
    (at / "zz.parquet").write_bytes(b"damaged")
    (tmp_path / "VPU_03" / "ngen-run/outputs").mkdir(parents=True)
    (tmp_path / "VPU_03" / "ngen-run/outputs/troute").write_bytes(b"no folder")
    cycle = results.load_cycle(spark, f"file://{tmp_path}")
    assert {k: v[0] for k, v in cells(cycle.run).items() if v[0] is not None} == {(1, 0): 1.0, (2, 0): 5.0}
    assert [f.rstrip("/").rsplit("/", 1)[1] for f in cycle.failed] == ["VPU_03"]
    assert cycle.listing.filter("key is not null").count() == 3
    with pytest.raises(LookupError, match="no result files"):
        (tmp_path / "none" / "VPU_09").mkdir(parents=True)
        results.load_cycle(spark, f"file://{tmp_path}/none")
    bad = tmp_path / "bad" / "VPU_01" / "ngen-run/outputs/troute"
    bad.mkdir(parents=True)
    (bad / "x.parquet").write_bytes(b"damaged")
    with pytest.raises(LookupError, match="could be read"):
        results.load_cycle(spark, f"file://{tmp_path}/bad")


def test_the_parts_of_a_folder_are_one_result(spark, tmp_path):
    region(tmp_path, "VPU_01", [(1, 0, 1.0), (2, 60, 4.0)], spark)
    at = region(tmp_path, "VPU_01", [(1, 60, 5.0), (2, 0, 2.0)], spark)  # another part of the same folder
    region(tmp_path, "VPU_02", [(2, 0, 6.0)], spark)
    unfinished = at / "part.parquet/_temporary/0"
    unfinished.mkdir(parents=True)
    (unfinished / "part-9.parquet").write_bytes(b"damaged")
    cycle = results.load_cycle(spark, f"file://{tmp_path}")
    assert {k: v[0] for k, v in cells(cycle.run).items() if v[0] is not None} == {(1, 0): 1.0, (1, 60): 5.0, (2, 0): 6.0, (2, 60): 4.0}
    listed = [(r.key.rsplit("/", 1)[1], r.length) for r in cycle.listing.orderBy("ds").collect()]
    assert [k for k, _ in listed] == ["part.parquet", "part.parquet"]
    assert listed[0][1] == sum(f.stat().st_size for f in (at / "part.parquet").glob("part-*.parquet"))
    found = listing.results_of([("b.parquet/x=1/p", 1), ("b.parquet/q", 2), ("b.parquet/_SUCCESS", 4), ("a.nc", 8), ("deep/c.parquet", 16), ("log.txt", 32), (".h.nc", 64)])
    assert found == [("a.nc", 8), ("b.parquet", 3), ("deep/c.parquet", 16)]


def test_counts_come_with_the_load(spark, tmp_path):
    rows = [("1", 0, 1.0), (None, 0, 2.0), ("x", 5, 2.0), ("2", None, 3.0), ("2", 7, 4.0)]
    for i in range(2):
        spark.createDataFrame(rows, "feature_id string, time long, flow double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    raw, counts = results.observed(spark.read.parquet(f"{tmp_path}/in"))
    loaded = run_of(results.canonical(raw, F.lit(0))).cells
    assert plan(loaded).count("FileScan") == 1
    assert loaded.count() == 2
    assert counts.get == {"rows": 10, "rejected": 6, "files": 2}


# Stored by time


def test_a_slice_reads_one_bucket(spark, tmp_path):
    rows = [(f, t * DAY + h * 3_600_000, float(10 * f + t), None, float(h)) for f in range(4) for t in range(-2, 4) for h in (0, 5) if (f + t) % 3]
    run = make(spark, rows).replace(ref_time="2024-01-01", variables=("flow", "depth"))
    stored.save_by_time(run, f"{tmp_path}/store")
    again = stored.load_by_time(spark, f"{tmp_path}/store")
    assert cells(again) == cells(run) and again.shape == run.shape
    assert (again.ref_time, again.variables, again.time_kind) == ("2024-01-01", ("flow", "depth"), "epoch_ms")
    for t in range(again.n_times):
        slice_ = series.time_slice(again, "flow", t)
        assert sorted(map(tuple, slice_.collect())) == sorted(map(tuple, series.time_slice(run, "flow", t).collect()))
    now = series.at_step(again, 3)
    assert "PartitionFilters: [isnotnull(bucket" in plan(now) and "EqualTo(time," in plan(now)
    assert len(now.inputFiles()) == len(again.cells.inputFiles())  # what could be read ...
    names = {r.name for r in now.select(F.input_file_name().alias("name")).distinct().collect()}
    assert len(names) == 1  # ... and what is
    assert again.replace(cells=run.cells).slices is None


def test_a_store_of_no_cells(spark, tmp_path):
    stored.save_by_time(make(spark, [(1, 0, 1.0)]).replace(cells=make(spark, [(1, 0, 1.0)]).cells.limit(0)), f"{tmp_path}/store")
    again = stored.load_by_time(spark, f"{tmp_path}/store")
    assert again.cells.count() == 0 and again.shape == (1, 1)
    assert [tuple(r) for r in series.time_slice(again, "flow", 0).collect()] == [(1, None)]


def test_buckets_are_replaced_and_others_stay(spark, tmp_path):
    old = make(spark, [(1, 0, 1.0), (1, DAY, 2.0), (2, DAY, 3.0), (1, 2 * DAY, 4.0)])
    stored.save_by_time(old, f"{tmp_path}/store")
    untouched = {p: p.stat().st_mtime_ns for p in (tmp_path / "store/cells/bucket=0").iterdir()}
    new = make(spark, [(2, DAY, 30.0), (3, 3 * DAY, 9.0)])
    merged = merge.merge([stored.load_by_time(spark, f"{tmp_path}/store"), new])
    merged = merged.replace(cells=shared.written(merged.cells, "merged"), features=shared.written(merged.features, "features"), times=shared.written(merged.times, "times"))
    stored.replace_buckets(new, merged, f"{tmp_path}/store")
    again = stored.load_by_time(spark, f"{tmp_path}/store")
    assert {k: v[0] for k, v in cells(again).items() if v[0] is not None} == {(1, 0): 1.0, (1, DAY): 2.0, (2, DAY): 30.0, (1, 2 * DAY): 4.0, (3, 3 * DAY): 9.0}
    assert again.n_times == 4
    assert {p: p.stat().st_mtime_ns for p in (tmp_path / "store/cells/bucket=0").iterdir()} == untouched


# Merging by proof


def test_disjoint_runs_are_merged_without_a_shuffle_of_cells(spark, tmp_path):
    def kept(name, rows):
        run = make(spark, rows)
        parts = {}
        for part in ("cells", "features", "times"):
            getattr(run, part).write.parquet(f"{tmp_path}/{name}-{part}")
            parts[part] = spark.read.parquet(f"{tmp_path}/{name}-{part}")
        return run.replace(**parts)

    a, b = kept("a", [(1, 0, 1.0), (5, 0, 2.0)]), kept("b", [(2, 0, 3.0), (9, 5, 4.0)])
    c, d = kept("c", [(100, 0, 5.0)]), kept("d", [(5, 0, None), (7, 0, 6.0)])
    assert merge.share_no_feature([a, c]) and merge.share_no_feature([a, b, c])
    assert not merge.share_no_feature([a, b, d])
    apart = merge.merge_any([a, b, c])
    assert "Exchange" not in plan(apart.cells)
    assert cells(apart) == {k: v for k, v in cells(merge.merge([a, b, c])).items() if v[0] is not None}
    covering = merge.merge_any([a, d])
    assert cells(covering) == cells(merge.merge([a, d])) and cells(covering)[5, 0][0] is None
    assert merge.share_no_feature([a, b.replace(features=b.features.limit(0))])


# Tiles


def test_tiles_find_the_lines_in_them(spark):
    rng = random.Random(4)
    place = lambda: (rng.choice([-180.0, -90.0, 0.0, 45.0, rng.uniform(-180, 180)]), rng.choice([0.0, rng.uniform(-89, 89)]))
    lines = [(i, [[place() for _ in range(rng.randint(1, 3))] for _ in range(rng.randint(1, 2))]) for i in range(60)] + [(99, []), (98, [[]])]
    frame = spark.createDataFrame(lines, "feature_id long, coordinates array<array<struct<x:double,y:double>>>")
    tiles = [(z, x, y) for z in (0, 2, 4) for x in range(0, 1 << z, max(1, z)) for y in range(0, 1 << z, max(1, z))]
    found = spatial.tile_features(frame, spark.createDataFrame(tiles + tiles[:3], "z int, x int, y int"))
    assert "CartesianProduct" not in plan(found) and "NestedLoop" not in plan(found)

    def meets(a, b, box):
        t0, t1 = 0.0, 1.0
        for k, (low, high) in enumerate(((box[0], box[2]), (box[1], box[3]))):
            d = b[k] - a[k]
            if d == 0:
                if not low <= a[k] <= high:
                    return False
                continue
            u, v = sorted(((low - a[k]) / d, (high - a[k]) / d))
            t0, t1 = max(t0, u), min(t1, v)
        return t0 <= t1

    want = set()
    for z, x, y in tiles:
        lat = lambda v: math.degrees(math.atan(math.sinh(math.pi * (1 - 2 * v / 2**z))))
        box = (x / 2**z * 360 - 180, lat(y + 1), (x + 1) / 2**z * 360 - 180, lat(y))
        for i, coordinates in lines:
            for line in coordinates:
                if any(meets(a, b, box) for a, b in zip(line, line[1:] or line[:1], strict=False)):
                    want.add((z, x, y, i))
    assert {tuple(r) for r in found.collect()} == want
    assert spatial.tile_features(frame, spark.createDataFrame([], "z int, x int, y int")).count() == 0


def test_lines_in_tiles_are_dealt_by_their_tiles(spark, monkeypatch):
    rng = random.Random(5)
    lines = [(i % 300, [[(rng.uniform(-180, 180), rng.uniform(-80, 80)) for _ in range(2)]]) for i in range(400)]  # a hundred features stand in two rows
    frame = spark.createDataFrame(lines, "feature_id long, coordinates array<array<struct<x:double,y:double>>>")
    tiles = spark.createDataFrame([(z, x, y) for z in (0, 3, 5) for x in range(1 << z) for y in range(1 << z)] + [(None, 0, 0)], "z int, x int, y int")
    whole = {tuple(r) for r in spatial.tile_features(frame, tiles).collect()}
    monkeypatch.setattr(spatial, "TASK_TILES", 500)
    found = spatial.tile_features(frame, tiles)
    rows = found.select("feature_id", F.spark_partition_id().alias("task")).collect()
    by_task = [sum(r.task == t for r in rows) for t in {r.task for r in rows}]
    assert len(rows) == len(whole) and {tuple(r) for r in found.collect()} == whole
    assert len(by_task) >= len(rows) // 2000 and max(by_task) <= 8 * spatial.TASK_TILES  # the largest zoom's tiles, and other zooms' beside
    task = lambda f: {r.task for r in rows if r.feature_id == f}
    assert all(len(task(f)) == 1 for f in range(0, 300, 30))
    monkeypatch.setattr(spatial, "BROADCAST_ROWS", 10)  # tiles of the larger zooms are joined by a shuffle
    again = spatial.tile_features(frame, tiles).collect()
    assert {tuple(r) for r in again} == whole and len(again) == len(whole)


def test_a_long_line_lists_the_tiles_along_it(spark):
    frame = spark.createDataFrame([(1, [[(-179.0, -80.0), (179.0, 80.0)]])], "feature_id long, coordinates array<array<struct<x:double,y:double>>>")
    n = spatial.tile_index(frame, 10).count()
    assert 1024 <= n <= 1024 * 4 * spatial.SIDE_TILES


# Run trees


def test_latest_cycles_of_odd_trees(spark):
    base = "outputs/m/v2_hydrofabric/"
    keys = [
        f"{base}ngen.20260719/short_range/9/VPU_01/f",
        f"{base}ngen.20260719/short_range/10/VPU_01/f",  # ten is above nine
        f"{base}ngen.20260719/Short_Range_b/01/f",
        f"{base}ngen.20260719/medium_range/notes/f",  # no cycles
        f"{base}ngen.20260718/analysis_x/00/1/VPU_01/f",
        "outputs/m/v1_hydrofabric/ngen.20990101/short_range/00/VPU_01/f",
        "outputs/deep/a/b/c/d/e/f/g/20260101/short_range/00/x",  # beyond the deepest level
        "outputs/plain/x/ngen.20260101/short_range/03/2/f",
        "outputs/plain/x/ngen.20260101/short_range/03/10/f",
    ]
    wanted = [(p, k) for p in (base + "ngen.20260101/short_range/00/", "outputs/m", "outputs/deep", "outputs/plain", "outputs/none") for k in ("short", "medium", "analysis")]
    found = runtree.latest_cycles(spark.createDataFrame([(k,) for k in keys], "key string"), spark.createDataFrame(wanted, "path string, range_key string"))
    got = {(r.path, r.range_key): r.latest or r.problem for r in found.collect()}
    assert len(got) == 15
    # By name upper case comes first, so the first range that begins with "short" is the one with capitals.
    assert got["outputs/m", "short"] == got[wanted[0]] == f"{base}ngen.20260719/Short_Range_b/01/"
    assert got["outputs/m", "medium"] == f"no cycles below {base}ngen.20260719/medium_range/"
    assert got["outputs/m", "analysis"] == "no analysis range in the latest run"
    assert got["outputs/deep", "short"] == "no dated run folders below outputs/deep"
    assert got["outputs/none", "short"] == "no dated run folders below outputs/none"
    assert got["outputs/plain", "short"] == "outputs/plain/x/ngen.20260101/short_range/03/10/"


def test_starts_of_paths(spark):
    paths = {"a": "a/", "20260101/18": "20260101/18/", "a/b/ngen.20260101/short_range/00/VPU_01/": "a/b/", "a/20260101/b/18": "a/20260101/b/", "a/b/c": "a/b/c/"}
    rows = spark.createDataFrame([(p,) for p in paths], "p string").select("p", runtree.start_of(F.col("p")).alias("s")).collect()
    assert {r.p: r.s for r in rows} == paths


# Dense arrays


class Counted:
    """An array that counts the values read from it."""

    def __init__(self, values):
        self.values, self.read, self.shape = np.asarray(values), 0, np.asarray(values).shape

    def __len__(self):
        return len(self.values)

    def __getitem__(self, at):
        found = self.values[at]
        self.read += found.size
        return found


def arrays_of(n_features, n_times, flat=True):
    values = np.arange(n_features * n_times, dtype=np.float32)
    shape = (-1,) if flat else (n_features, n_times)
    return {"time": Counted(np.arange(n_times) * 60), "feature_id": Counted(np.arange(n_features) * 10), **{v: Counted((values + k / 4).reshape(shape)) for k, v in enumerate(netcdf.VARIABLES)}}


@pytest.mark.parametrize("flat", [True, False])
@pytest.mark.parametrize(
    ("filters", "wanted", "most"),
    [
        ([], lambda f, t: True, 800),
        ([EqualTo(("feature_id",), 50)], lambda f, t: f == 50, 8),
        ([In(("feature_id",), (50, 60, 990, 7))], lambda f, t: f in (50, 60, 990), 24),
        ([EqualTo(("time",), 120), IsNotNull(("time",))], lambda f, t: t == 120, 100),
        ([GreaterThan(("feature_id",), 900), LessThan(("time",), 120), GreaterThanOrEqual(("time",), 60)], lambda f, t: f > 900 and t == 60, 9),
        ([EqualTo(("feature_id",), 55)], lambda f, t: False, 0),
    ],
)
def test_filters_become_slices(monkeypatch, flat, filters, wanted, most):
    arrays = arrays_of(100, 8, flat)

    class File(dict):
        attrs: dict = {}
        __enter__ = lambda self: self
        __exit__ = lambda self, *_: None

    monkeypatch.setattr(netcdf, "open_arrays", lambda _: File(arrays))
    reader = netcdf.NetCdfReader([(0, "x")], 25, variables=("flow", "depth"))
    left = StringStartsWith(("ref_time",), "2026")
    assert list(reader.pushFilters([*filters, left])) == [left]
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    want = [(10 * f, 60 * t, f, t, float(8 * f + t), None, 8 * f + t + 0.5) for f in range(100) for t in range(8) if wanted(10 * f, 60 * t)]
    assert [tuple(r[c] for c in ("feature_id", "time", "row_idx", "t_idx", "flow", "velocity", "depth")) for r in rows] == want
    assert arrays["velocity"].read == 0
    assert arrays["flow"].read == arrays["depth"].read <= most
    assert {r["variables"] for r in rows} <= {"flow,velocity,depth"}


def test_filters_of_plans_reach_the_reader(spark, monkeypatch, tmp_path):
    """A whole query: the source is asked with the filter, which is then no longer in the plan."""
    (tmp_path / "h5py.py").write_text(
        "import numpy as np\n"
        "class File(dict):\n"
        "    attrs = {'file_reference_time': '2026-07-20_00:00:00'}\n"
        "    def __init__(self, path, mode):\n"
        "        super().__init__(time=np.arange(4) * 3600, feature_id=np.arange(6) + 100, flow=np.arange(24.0))\n"
        "    __enter__ = lambda self: self\n"
        "    __exit__ = lambda self, *_: None\n"
    )
    monkeypatch.syspath_prepend(str(tmp_path))
    spark.sparkContext.addPyFile(str(tmp_path / "h5py.py"))
    run = results.load_netcdf(spark, "any.nc", ["flow"])
    assert (run.time_kind, run.ref_time, run.variables) == ("offset_s", "2026-07-20_00:00:00", ("flow",))
    one = run.cells.filter((F.col("feature_id") == 103) & (F.col("time") == 7200))
    assert [r.flow for r in one.collect()] == [14.0]
    assert "BatchScan" in plan(one) and " Filter " not in plan(one)
    assert [r.value for r in series.series(run, "flow", 101).orderBy("t_idx").collect()] == [4.0, 5.0, 6.0, 7.0]


# SQL


def test_functions_in_sql(spark):
    run = make(spark, [(1, 0, 1.0), (1, 60, None), (1, 120, 3.0), (2, 60, 5.0, 7.5)])
    views.register(run, "own_")
    assert views.register_functions(run, "own_") == ["own_samples", "own_series", "own_segments", "natural_breaks", "to_fixed_2", "to_fixed_3", "to_fixed_4"]
    assert [tuple(r) for r in spark.sql("SELECT t_idx, time, value FROM own_series(1, 'flow') ORDER BY t_idx").collect()] == [(0, 0, 1.0), (1, 60, None), (2, 120, 3.0)]
    assert [tuple(r) for r in spark.sql("SELECT * FROM own_segments('flow') ORDER BY feature_id, segment").collect()] == [(1, 0, 0, 0, 1), (1, 1, 2, 2, 1), (2, 0, 1, 1, 1)]
    rows = spark.sql("SELECT k, natural_breaks(v) AS b FROM VALUES ('a', 1.0D), ('a', 2.0D), ('b', 7.0D), ('b', NULL) t(k, v) GROUP BY k").collect()
    assert {r.k: r.b for r in rows} == {"a": [2.0], "b": []}
    assert spark.sql("SELECT to_fixed_2(1.005D) AS x, to_fixed_3(2.5D) AS y").first()[:] == ("1.00", "2.500")


def test_texts_as_shown(spark):
    run = make(spark, [(1, 0, 1.25, None, -9999.0), (2, 0, 0.00005)])
    wanted = spark.createDataFrame([(1, {"id": "1", "name": "b", "area": "a"}), (7, {}), (2, None)], "feature_id long, properties map<string,string>")
    texts = {r.feature_id: tuple(r[1:]) for r in series.record_texts(run, 0, wanted).collect()}
    assert texts == {1: ("wb-1", "1.250 m³/s", "N/A", "N/A"), 2: ("wb-2", "0.000 m³/s", "N/A", "N/A"), 7: ("wb-7", "N/A", "N/A", "N/A")}
    lines = sorted(tuple(r) for r in series.info_texts(run, "flow", 0, wanted).collect())
    assert lines[:4] == [(1, 0, "id", "wb-1"), (1, 1, "Flow", "1.2500 m³/s"), (1, 2, "area", "a"), (1, 3, "name", "b")]
    assert lines[-2:] == [(7, 0, "id", "wb-7"), (7, 1, "Flow", "--")]
    assert (2, 1, "Flow", "0.0000 m³/s") in lines or (2, 1, "Flow", "0.0001 m³/s") in lines


def test_playback_period():
    from rillspark.functions import values

    assert [values.playback_ms(x) for x in (1, 10, 50)] == [2500, 250, 50]


# Streams


def stamped(spark, rows):
    frame = spark.createDataFrame([(f, dt.datetime(2026, 7, 20) + dt.timedelta(hours=t), i, v, None, None) for i, (f, t, v) in enumerate(rows)], ingest.ROWS)
    return frame.coalesce(1)


def test_a_running_merge_is_the_merge_of_all(spark, tmp_path):
    parts = [[(1, 0, 1.0), (1, 1, 2.0), (2, 0, 3.0)], [(1, 1, None), (3, 2, 4.0)], [(2, 0, 9.0), (2, 2, None), (1, 0, -9999.0)]]
    source, target = f"{tmp_path}/in", f"{tmp_path}/out"
    want = []
    for n, rows in enumerate(parts):
        stamped(spark, rows).write.mode("append").parquet(source)
        if n != 1:  # the second query finds two new files
            ingest.running_merge(ingest.read_runs(spark, source), target, f"{tmp_path}/c").awaitTermination()
        base = int(dt.datetime(2026, 7, 20, tzinfo=dt.timezone.utc).timestamp() * 1000)
        want.append(make(spark, [(f, base + t * 3_600_000, v) for f, t, v in rows]))
    merged = ingest.merged_so_far(spark, target)
    whole = merge.merge(want)
    valid = lambda run: {k: v for k, v in cells(run).items() if v[0] is not None}
    assert valid(merged) == valid(whole)
    assert [tuple(r) for r in merged.features.orderBy("row_idx").collect()] == [tuple(r) for r in whole.features.select(*merged.features.columns).orderBy("row_idx").collect()]
    assert merged.n_times == whole.n_times
    os.remove(f"{target}/2/times/_SUCCESS")  # as if the last batch hadn't ended
    assert valid(ingest.merged_so_far(spark, target)) == valid(merge.merge(want[:2]))


def test_tiles_arrive_once_and_end_by_a_timer(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        start = dt.datetime(2026, 7, 20)
        at = lambda *rows: spark.createDataFrame([(k, start + dt.timedelta(seconds=s)) for k, s in rows], "key string, time timestamp").coalesce(1)
        source = f"{tmp_path}/tiles"
        for rows in ([("2/1/1", 0), ("2/1/1", 1), ("2/0/1", 5), (None, 0)], [("2/1/1", 30)], [("9/9/9", 400)], [("2/1/1", 401)]):
            at(*rows).write.mode("append").parquet(source)
        stream = spark.readStream.schema("key string, time timestamp").option("maxFilesPerTrigger", 1).parquet(source)
        query = ingest.tiles_once(stream).writeStream.format("memory").queryName("tiles").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        query.awaitTermination()
        got = [(r.key, r.arrivals, r.expired) for r in spark.table("tiles").collect()]
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sorted(x for x in got if x[2]) == [("2/0/1", 1, True), ("2/1/1", 3, True)]
    assert sorted(x[0] for x in got if not x[2]) == ["2/0/1", "2/1/1", "2/1/1", "9/9/9"]


# The shared folder


class Session:
    def __init__(self, named, told, master):
        self.conf = type("C", (), {"get": lambda _, key, default=None: named})()
        option = type("O", (), {"isDefined": lambda _: told is not None, "get": lambda _: told})()
        context = type("S", (), {"getCheckpointDir": lambda _: option})()
        self.sparkContext = type("X", (), {"_jsc": type("J", (), {"sc": lambda _: context})(), "master": master, "applicationId": "app-test"})()


def test_the_shared_folder():
    assert shared.shared_folder(Session("hdfs://a/b/", None, "yarn")) == "hdfs://a/b"
    assert shared.shared_folder(Session(None, "hdfs://told/1", "yarn")) == "hdfs://told/1"
    for master in ("yarn", "local-cluster[2,1,1024]", "spark://x:7077"):
        with pytest.raises(RuntimeError, match="checkpoint"):
            shared.shared_folder(Session(None, None, master))
    assert shared.shared_folder(Session(None, None, "local[4]")).startswith("file:///")
