"""The semantics of runs on small tables made by hand, and against a dense NumPy version."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rillspark import model
from rillspark.functions import paths as P
from rillspark.functions import scales as S
from rillspark.functions import values as V
from rillspark.model import run_of
from rillspark.operators import aggregates, distribution, merge, network, painting, series, spatial
from rillspark.plans import ranking, runtree, views
from rillspark.sources import folders, netcdf, results
from rillspark.streaming import ingest

SCHEMA = "feature_id long, time long, ord long, flow float, velocity float, depth float"


def make(spark, rows):
    return run_of(spark.createDataFrame([(f, t, i, *(*v, None, None, None)[:3]) for i, (f, t, *v) in enumerate(rows)], SCHEMA))


def cells(run):
    return {(r.feature_id, r.time): (r.flow, r.velocity, r.depth) for r in run.cells.collect()}


def axis(df, key, at):
    return [r[key] for r in sorted(df.collect(), key=lambda r: r[at])]


def test_validity(spark):
    values = [1.0, float("nan"), -9999.0, -9998.0, -9997.5, None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    assert [r.v for r in df.orderBy("i").select(V.valid(F.col("v")).alias("v")).collect()] == [1.0, None, None, None, -9997.5, None]


def test_last_non_null_write_wins_and_a_late_fill_counts(spark):
    assert cells(make(spark, [(1, 0, 1.0), (1, 0, None), (1, 0, 2.0)]))[1, 0][0] == 2.0
    assert cells(make(spark, [(1, 0, 1.0), (1, 0, 2.0), (1, 0, -9999.0)]))[1, 0][0] is None


def test_rows_of_nulls_stay_on_the_axes(spark):
    run = make(spark, [(5, 70, None), (3, 10, None)])
    assert axis(run.features, "feature_id", "row_idx") == [3, 5]
    assert axis(run.times, "time", "t_idx") == [10, 70]
    assert aggregates.bounds_values(run, "flow") == (0.0, 1.0)
    assert [r.total for r in aggregates.totals_by_time(run, "flow").collect()] == [0.0, 0.0]


def test_single_precision(spark):
    df = spark.createDataFrame([(1, 5, 0.1)], "feature_id int, time long, flow double")
    assert results.canonical(df, F.lit(0)).first().flow == pytest.approx(0.10000000149011612, abs=1e-18)


def test_merge_keeps_the_last_run_that_has_both_axes(spark):
    a = make(spark, [(2, 0, 1.0), (1, 2, 7.0)])
    a = a.replace(features=spark.createDataFrame([(2, 0), (1, 1)], "feature_id long, row_idx long"))
    b = make(spark, [(1, 1, 3.0), (3, 2, 4.0)])
    merged = merge.merge([a, b])
    assert axis(merged.features, "feature_id", "row_idx") == [2, 1, 3]
    assert axis(merged.times, "time", "t_idx") == [0, 1, 2]
    assert {k: v[0] for k, v in cells(merged).items() if v[0] is not None} == {(2, 0): 1.0, (1, 1): 3.0, (3, 2): 4.0}
    assert {k: v[0] for k, v in cells(merge.merge([a, b], prefer_valid=True)).items()}[1, 2] == 7.0
    with pytest.raises(ValueError, match="different kinds"):
        merge.merged_times([a, b.replace(time_kind="offset_s")])


def dense_merge(parts):
    """Dense arrays, part by part, each over the whole grid of its own axes."""
    times = sorted({t for p in parts for _, t, _ in p})
    out = {}
    for p in parts:
        own = {}
        for f, t, v in p:
            if v is not None:
                own[f, t] = np.float32(v)
        for f in {f for f, _, _ in p}:
            for t in {t for _, t, _ in p}:
                out[f, t] = own.get((f, t), np.float32(-9999))
    return times, {k: float(v) for k, v in out.items() if v > -9998}


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.tuples(st.integers(1, 4), st.integers(0, 3), st.one_of(st.none(), st.floats(-50, 50, width=32), st.just(-9999.0))), min_size=1, max_size=8), min_size=2, max_size=3))
def test_merge_equals_the_dense_version(spark, parts):
    merged = merge.merge([make(spark, p) for p in parts])
    times, want = dense_merge(parts)
    assert axis(merged.times, "time", "t_idx") == times
    assert {k: v[0] for k, v in cells(merged).items() if v[0] is not None} == want


def test_disjoint_merge_is_the_same(spark):
    a, b = make(spark, [(1, 0, 1.0), (1, 5, 2.0)]), make(spark, [(2, 5, 3.0)])
    assert {k: v for k, v in cells(merge.merge([a, b])).items() if v[0] is not None} == cells(merge.merge_disjoint([a, b]))


def test_positions_over_several_blocks(spark):
    keys = [-70000, -1, 0, 5, 65535, 65536, 10**12]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    assert axis(ranking.positions(df, "k", "i"), "k", "i") == keys


def test_quantiles_interpolate(spark):
    run = make(spark, [(1, i, float(v)) for i, v in enumerate((1, 2, 4, 8, 16, 32, 64))])
    assert distribution.quantiles(run, "flow", [0, 0.2, 0.4, 0.6, 0.8, 1]) == pytest.approx([1, 2.4, 5.6, 12.8, 28.8, 64])
    assert distribution.quantiles(run, "depth", [0.5]) == [0.0]


def test_strictly_increasing():
    assert S.strictly_increasing([0, 0, 0, 5]) == pytest.approx([0, 1e-6, 2e-6, 5])


def test_natural_breaks():
    assert distribution.natural_breaks([v for v in range(6) for _ in range(4)]) == [1, 2, 3, 4, 5]
    for few in ([], [0.1] * 50, [1, 2] * 9, [1, 2, 3] * 5):
        assert len(distribution.natural_breaks(few)) == max(0, len(set(few)) - 1)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 60), min_size=8, max_size=14).filter(lambda v: len(set(v)) >= 7))
def test_natural_breaks_are_the_best_partition(values):
    from itertools import combinations

    data = sorted(map(float, values))

    def cost(cuts):
        edges = [0, *cuts, len(data)]
        return sum(float(np.var(data[a:b]) * (b - a)) for a, b in zip(edges, edges[1:], strict=False))

    best = min(cost(c) for c in combinations(range(1, len(data)), 5))
    cuts = [data.index(b) for b in distribution.natural_breaks(data)]
    assert cost(cuts) == pytest.approx(best, abs=1e-6)


@pytest.mark.parametrize("most", [0, 100])
def test_dense_grid_at_any_length_of_the_time_axis(spark, monkeypatch, most):
    monkeypatch.setattr(model, "BROADCAST_ROWS", most)
    run = make(spark, [(7, 10, 1.0), (7, 30, None, 2.0), (5, 20, 3.0)])
    got = {(r.feature_id, r.t_idx): r.value for r in series.whole_series(run, "flow").collect()}
    assert got == {(7, 0): 1.0, (7, 1): None, (7, 2): None, (5, 0): None, (5, 1): 3.0, (5, 2): None}
    dense = {r.cell_idx: (r.flow, r.velocity) for r in series.dense_matrix(run).collect()}
    place = {r.feature_id: r.row_idx for r in run.features.collect()}
    want = {place[f] * 3 + t: (-9999.0 if v is None else v, 2.0 if (f, t) == (7, 2) else -9999.0) for (f, t), v in got.items()}
    assert dense == want
    assert "CartesianProduct" not in series.dense_matrix(run)._jdf.queryExecution().toString()
    none = make(spark, [(1, 1, 1.0)]).replace(times=run.times.limit(0))
    assert series.dense_matrix(none).count() == series.whole_series(none, "flow").count() == 0


def test_segments_norm_and_steps(spark):
    values = [1.0, None, 2.0, 3.0, None, None, 4.0]
    run = make(spark, [(1, i, v) for i, v in enumerate(values)])
    assert [r.points for r in series.segments(run, "flow").orderBy("segment").collect()] == [1, 2, 1]
    assert {(r.t_idx): round(r.y, 6) for r in series.chart(run, "flow").collect()} == {0: 0, 2: round(1 / 3, 6), 3: round(2 / 3, 6), 6: 1}
    assert {r.t_idx: (r.next_t, r.previous_t) for r in series.playback_steps(run).collect()}[6] == (0, 5)
    assert [r.value for r in series.series(run, "flow", 1).orderBy("t_idx").collect()] == values
    assert series.point(run, "flow", 1, 1).first().value is None
    one = make(spark, [(1, 0, 5.0)])
    assert series.chart(one, "flow").first().x is None
    assert aggregates.overview(one, "flow").first().x == 0.5


def test_totals_are_sums_of_slices(spark):
    run = make(spark, [(f, t, float(f * 10 + t)) for f in range(4) for t in range(3) if (f + t) % 3])
    for r in aggregates.totals_by_time(run, "flow").collect():
        assert r.total == sum(x.value or 0 for x in series.time_slice(run, "flow", r.t_idx).collect())


def test_stride_keeps_what_the_dense_grid_would(spark, monkeypatch):
    monkeypatch.setattr(distribution, "SAMPLE_CELLS", 4)
    run = make(spark, [(f, t, float(10 * f + t)) for f in range(4) for t in range(5) if (f + t) % 4])
    dense = [(10 * f + t if (f + t) % 4 else None) for f in range(4) for t in range(5)]
    assert sorted(r.value for r in distribution.value_sample(run, "flow").collect()) == [v for v in dense[::5] if v is not None]


@pytest.mark.parametrize("scale", S.TRANSFORMS)
@pytest.mark.parametrize("ends", [(0.0, 10.0), (-5.0, -1.0), (3.0, 3.0), (0.0, 0.0)])
def test_scales_map_the_bounds_to_the_ramp(spark, scale, ends):
    s = S.Scale(scale, *ends)
    stops = s.stops()
    assert all(b > a for a, b in zip(stops, stops[1:], strict=False))
    df = spark.createDataFrame([(ends[0],), (ends[1],)], "v double")
    got = [r.p for r in df.select(S.ramp_position(s.transform(F.col("v")), stops).alias("p")).collect()]
    assert got[0] == pytest.approx(0, abs=1e-9)
    if ends[1] > ends[0] and (scale != "log" or ends[1] > 1e-5):
        assert got[1] == pytest.approx(5)


@pytest.mark.parametrize("scale", [*S.TRANSFORMS, "quantile", "quantile-classes", "jenks"])
def test_frames_of_every_scale(spark, scale):
    run = make(spark, [(f, 0, float(f * f)) for f in range(20)] + [(99, 0, None)])
    rows = {r.feature_id: r for r in painting.frame(run, "flow", 0, scale).collect()}
    assert rows[0].color == "#0077b6" and rows[19].color == "#d00000"
    assert rows[99].color == "rgba(0, 0, 0, 0)" and rows[99].width == 0
    assert rows[0].width == 1.5 and rows[19].width == 7


def test_upstream(spark):
    divides = spark.createDataFrame([(1, 3), (2, 1), (3, 0), (4, 0), (9, None)], "upstream_id long, num_upstreams long")
    pairs = {(r.upstream_id, r.member_id) for r in network.upstream_pairs(divides, divides, width=2).collect()}
    assert pairs == {(1, 2), (1, 3), (1, 4), (2, 3)}
    assert network.upstream(divides, 9, None).count() == 0
    assert network.selected(divides, 2).count() == 1


def test_extent_and_boxes(spark):
    schema = "feature_id long, coordinates array<array<struct<x:double,y:double>>>"
    lines = spark.createDataFrame([(1, [[(0.0, 1.0), (2.0, 5.0)]]), (2, [[(9.0, 9.0)], [(-3.0, 4.0)]]), (3, [[(99.0, 99.0)]])], schema)
    loaded = spark.createDataFrame([(1,), (2,)], "feature_id long")
    assert tuple(spatial.loaded_extent(lines, loaded).first()) == (-3.0, 1.0, 9.0, 9.0)
    assert tuple(spatial.loaded_extent(lines, loaded.filter("feature_id > 5")).first()) == (None,) * 4
    assert {r.feature_id for r in spatial.in_box(spatial.feature_boxes(lines), -4, 0, 1, 6).collect()} == {1, 2}


def test_tile_of_the_whole_world(spark):
    box = spark.range(1).select(*[c.alias(k) for k, c in V.tile_bbox(*[F.lit(0)] * 4).items()]).first()
    assert (box.west, box.east) == (-180, 180)
    assert (box.north, box.south) == pytest.approx((85.0511287798, -85.0511287798))


def test_texts(spark):
    ms = int(dt.datetime(2026, 7, 20, 6, 35, tzinfo=dt.timezone.utc).timestamp() * 1000)
    row = spark.range(1).select(
        V.time_label(F.lit(ms), "epoch_ms").alias("a"),
        V.time_label(F.lit(7300), "offset_s").alias("b"),
        V.to_fixed(2)(F.lit(1.005)).alias("c"),
        V.to_fixed(2)(F.lit(-2.5)).alias("d"),
        V.ref_date(F.lit("2026-07-20_00:00:00")).alias("e"),
        V.seek_index(F.lit(0.5), 4).alias("f"),
        series.formatted(F.lit(None).cast("double"), 3, "m", "N/A").alias("g"),
        series.formatted(F.lit(1.25), 3, "m", "N/A").alias("h"),
    )
    assert tuple(row.first()) == ("2026-07-20 06:00Z", "T+2h", "1.00", "-2.50", "2026-07-20", 2, "N/A", "1.250 m")


def test_order_width(spark):
    got = [r.w for r in spark.createDataFrame([(0.0,), (1.0,), (8.0,), (12.0,)], "o double").select(S.order_width(F.col("o")).alias("w")).collect()]
    assert got == pytest.approx([1, 1, 6, 6])


def test_run_tree(spark):
    base = "outputs/m/v2_hydrofabric/"
    keys = [f"{base}ngen.20260719/short_range/18/VPU_01/f.nc", f"{base}ngen.20260720/short_range/00/VPU_01/f.nc", f"{base}ngen.20260720/short_range/06/VPU_01/f.nc", f"{base}ngen.20260720/medium_range/18/1/VPU_01/f.nc"]
    df = spark.createDataFrame([(k,) for k in keys], "key string")
    assert runtree.latest_cycle(df, f"{base}ngen.20260719/short_range/", "medium") == f"{base}ngen.20260720/medium_range/18/1/"
    assert runtree.latest_cycle(df, "outputs/m", "short") == f"{base}ngen.20260720/short_range/06/"
    with pytest.raises(LookupError):
        runtree.latest_cycle(df, "outputs/m", "analysis")
    assert [r.name for r in runtree.list_folders(df, base).orderBy("position").collect()] == ["ngen.20260720", "ngen.20260719"]
    assert runtree.only_file(spark.createDataFrame([("a", "k")], "name string, key string")) == "k"
    link = spark.range(1).select(P.deep_link(F.lit("http://x/"), F.lit("b"), F.lit("a/b c")).alias("u"))
    assert tuple(link.select(*[c.alias(k) for k, c in P.from_deep_link(F.col("u")).items()]).first()) == ("b", "a/b c")


def test_files(spark, tmp_path):
    schema = "feature_id long, time timestamp, flow double, note string"
    stamp = dt.datetime(2026, 7, 20, 6)
    for name, rows in (("a", [(1, stamp, 1.0, "x"), (1, stamp, 2.0, "y"), (None, stamp, 3.0, "z")]), ("b", [(2, stamp, 5.0, "x")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    (tmp_path / "bad.parquet").write_bytes(b"no parquet")
    run = results.load_many(spark, [f"{tmp_path}/{n}.parquet" for n in ("a", "bad", "b")])
    assert {k[0]: v[0] for k, v in cells(run).items()} == {1: 2.0, 2: 5.0}
    assert results.rejects(spark.read.parquet(f"{tmp_path}/a.parquet")).first().rejected == 1
    with pytest.raises(LookupError):
        results.load_many(spark, [f"{tmp_path}/bad.parquet"])
    with pytest.raises(LookupError):
        results.load_many(spark, [])
    plan = results.scan_parquet(spark, f"{tmp_path}/a.parquet").select("feature_id")._jdf.queryExecution().executedPlan().toString()
    assert "note" not in plan
    results.save(run, f"{tmp_path}/out.parquet")
    assert cells(results.load(spark, f"{tmp_path}/out.parquet")) == cells(run)


def test_lookups_filter_the_scan(spark, tmp_path):
    rows = [(f, t, float(f + t)) for f in range(3) for t in range(3)]
    spark.createDataFrame(rows, "feature_id long, time long, flow double").write.parquet(f"{tmp_path}/x.parquet")
    run = results.load(spark, f"{tmp_path}/x.parquet")
    plan = series.point(run, "flow", 2, 1)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(feature_id,2)" in plan and "EqualTo(time,1)" in plan
    assert series.point(run, "flow", 2, 1).first().value == 3.0
    assert series.point(run, "flow", 2, 9).first().value is None
    assert views.register(run, "run_") == ["run_cells", "run_features", "run_times"]
    assert spark.sql("SELECT sum(flow) AS s FROM run_cells JOIN run_times USING (time) WHERE t_idx = 2").first().s == 9.0


def test_many_files_in_one_plan(spark, tmp_path):
    write = lambda name, rows, schema: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    write("a", [(9, 0, 1.0, 10.0), (2, 0, 2.0, 20.0), (2, 60, 3.0, 30.0)], "feature_id long, time long, flow double, velocity double")
    write("b", [(2, 0, 4.0), (5, 0, 5.0), (2, 60, None)], "feature_id long, time long, flow double")
    write("none", [("x", 1)], "other string, time long")
    (tmp_path / "bad.parquet").write_bytes(b"PAR1 is how it begins")
    names = ("bad", "a", "gone", "none", "b")
    run = results.load_many(spark, [f"{tmp_path}/{n}.parquet" for n in names])
    # b covers a's flow, with a null too; it has no velocity and leaves that alone
    assert cells(run) == {(9, 0): (1.0, 10.0, None), (2, 0): (4.0, 20.0, None), (2, 60): (None, 30.0, None), (5, 0): (5.0, None, None)}
    assert axis(run.features, "feature_id", "row_idx") == [2, 9, 5]
    assert axis(run.times, "time", "t_idx") == [0, 60]
    assert run.variables == ("flow", "velocity") and [f.rsplit("/", 1)[1] for f in run.files] == ["a.parquet", "b.parquet"]
    each = merge.merge([results.load(spark, f"{tmp_path}/{n}.parquet") for n in ("a", "b")])
    assert cells(each) == cells(run) and each.variables == run.variables
    assert axis(each.features, "feature_id", "row_idx") == [2, 9, 5]


def test_a_run_without_a_variable_leaves_it_alone(spark):
    a = make(spark, [(1, 0, 1.0, 2.0, 3.0), (2, 0, 4.0, 5.0, 6.0)])
    b = make(spark, [(1, 0, 7.0)]).replace(variables=("flow",))
    merged = merge.merge([a, b])
    assert cells(merged) == {(1, 0): (7.0, 2.0, 3.0), (2, 0): (4.0, 5.0, 6.0)}
    assert merge.merge([b, b]).variables == ("flow",)
    assert cells(merge.merge([a, b.replace(variables=("flow", "depth"))]))[1, 0] == (7.0, 2.0, None)


def test_positions_of_sparse_keys(spark):
    keys = sorted({-(1 << 62), -5, 0, 1, 65_535, 65_536, 1 << 30, 1 << 41, (1 << 41) + 1, 1 << 61, (1 << 62) + 9})
    df = spark.createDataFrame([(k,) for k in reversed(keys)], "k long")
    assert axis(ranking.positions(df, "k", "i"), "k", "i") == keys
    two = spark.createDataFrame([(ds, k) for ds in (1, 0) for k in keys[3:6]], "ds int, k long")
    got = {(r.ds, r.k): r.i for r in ranking.positions(two, "k", "i", first=["ds"]).collect()}
    assert got == {(ds, k): 3 * ds + i for ds in (0, 1) for i, k in enumerate(keys[3:6])}


def test_one_level_of_a_store(spark, tmp_path):
    (tmp_path / "run" / "deep").mkdir(parents=True)
    (tmp_path / "run" / "a.nc").write_bytes(b"123")
    (tmp_path / "run" / "deep" / "b.nc").write_bytes(b"4")
    rows = [(r.name, r.is_folder, r.length) for r in folders.list_level(spark, f"{tmp_path}/run").collect() if not r.name.startswith(".")]
    assert [r[:2] for r in rows] == [("a.nc", False), ("deep", True)] and rows[0][2] == 3
    assert [r.key.rsplit("/", 1)[1] for r in folders.list_keys(spark, f"{tmp_path}").collect()].count("b.nc") == 1


def test_unreadable_dense_files_are_left_out(monkeypatch):
    class File(dict):
        attrs: dict = {}
        __enter__ = lambda self: self
        __exit__ = lambda self, *_: None

    files = {"good": File(time=np.array([0, 60]), feature_id=np.array([4, 5, 6]), flow=np.arange(6.0)), "empty": File()}

    def opened(path):
        if path not in files:
            raise OSError(path)
        return files[path]

    monkeypatch.setattr(netcdf, "open_arrays", opened)
    paths = [(0, "gone"), (1, "good"), (2, "empty")]
    parts = netcdf.NetCdfReader(paths, 2, skip=True).partitions()
    assert [(p.path, p.ds, p.first, p.last) for p in parts] == [("good", 1, 0, 2), ("good", 1, 2, 3)]
    with pytest.raises(OSError, match="gone"):
        netcdf.NetCdfReader(paths, 2).partitions()
    rows = [r for p in parts for b in netcdf.NetCdfReader(paths, 2).read(p) for r in b.to_pylist()]
    assert [(r["ds"], r["feature_id"], r["time"], r["row_idx"], r["flow"]) for r in rows] == [(1, 4 + i // 2, 60 * (i % 2), i // 2, float(i)) for i in range(6)]
    assert {r["variables"] for r in rows} == {"flow"}


def test_dense_arrays():
    arrays = {"time": np.array([0, 3600]), "feature_id": np.array([7, 8]), "flow": np.array([1, 2, 3, 4], np.float32), "depth": np.array([5.0], np.float32)}
    rows = [tuple(r[c] for c in "feature_id time row_idx t_idx flow velocity depth ref_time".split()) for b in netcdf.dense_batches(arrays, {"file_reference_time": b"2026"}, 0, 2) for r in b.to_pylist()]
    assert rows == [(7, 0, 0, 0, 1.0, None, 5.0, "2026"), (7, 3600, 0, 1, 2.0, None, None, "2026"), (8, 0, 1, 0, 3.0, None, None, "2026"), (8, 3600, 1, 1, 4.0, None, None, "2026")]


def test_streams_end_with_the_last_writes(spark, tmp_path):
    stamp = dt.datetime(2026, 7, 20)
    source, target = f"{tmp_path}/in", f"{tmp_path}/out"
    spark.createDataFrame([(1, stamp, 1, 1.0, None, None), (1, stamp, 2, 2.0, None, None)], ingest.ROWS).write.parquet(source)
    rows = ingest.read_rows(spark, source)
    ingest.append_cells(rows, target, f"{tmp_path}/c1").awaitTermination()
    assert spark.read.parquet(target).count() == 2
    out = ingest.latest_cells(rows).writeStream.format("memory").queryName("latest").outputMode("complete").trigger(availableNow=True).start()
    out.awaitTermination()
    assert [r.flow for r in spark.table("latest").collect()] == [2.0]
    once = ingest.arrivals(rows).writeStream.format("memory").queryName("once").trigger(availableNow=True).start()
    once.awaitTermination()
    assert spark.table("once").count() == 1
