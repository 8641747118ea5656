"""The library's registered queries and, beside each, its SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillspark.constants import PALETTE, PALETTE_RGB, SCALE_NOTES, UNITS, VARIABLES
from rillspark.functions import paths as P
from rillspark.functions import scales as S
from rillspark.functions import values as V
from rillspark.model import run_of
from rillspark.operators import aggregates, distribution, merge, network, painting, series, spatial
from rillspark.plans import runtree, views
from rillspark.sources.results import canonical, load, load_cycle, load_many, observed, scan_parquet
from rillspark.sources.shared import fresh_path
from rillspark.sources.stored import load_by_time, save_by_time
from rillspark.sources.tables import asked_cycles, cycle_folder, damaged_file, divides, event_keys, event_rows, event_run, flowpaths, rejected_files, run_files, split_files, split_runs, table
from rillspark.streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: The step, feature and region that single lookups ask for.
T, FEATURE = 7, 5
TILE = (2, 1, 1, 0)


def base_sql(unit: str = "day") -> str:
    """Long rows, cells and axes of the events, as table expressions."""
    last = ", ".join(f"max_by({v}, ord) FILTER (WHERE {v} IS NOT NULL) AS {v}" for v in VARIABLES)
    return f"""
rows AS (
  SELECT user_id AS feature_id, epoch_ms(date_trunc('{unit}', ts)) AS time, event_id AS ord,
    CAST(CASE WHEN event_type IN ('view', 'click') THEN value END AS FLOAT) AS flow,
    CAST(CASE WHEN event_type = 'purchase' THEN value END AS FLOAT) AS velocity,
    CAST(CASE WHEN event_type = 'signup' THEN value END AS FLOAT) AS depth
  FROM events
), cells AS (SELECT feature_id, time, {last} FROM rows GROUP BY feature_id, time),
features AS (SELECT feature_id, row_number() OVER (ORDER BY feature_id) - 1 AS row_idx FROM (SELECT DISTINCT feature_id FROM rows)),
times AS (SELECT time, row_number() OVER (ORDER BY time) - 1 AS t_idx FROM (SELECT DISTINCT time FROM rows))"""


BASE = "WITH " + base_sql()
HOURLY = "WITH " + base_sql("hour")
BOUNDS = ", b AS (SELECT coalesce(min(CAST(flow AS DOUBLE)), 0) AS mn, coalesce(max(CAST(flow AS DOUBLE)), 1) AS mx FROM cells)"
SLICE = f", slice AS (SELECT feature_id, CAST(flow AS DOUBLE) AS value FROM features LEFT JOIN (SELECT * FROM cells JOIN times USING (time) WHERE t_idx = {T}) USING (feature_id))"


def query(sql: str | None = None, name: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name or f.__name__] = f
        if sql is not None:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return register


def rounded(c: str | Column, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


# Scans, axes and cells


@query(BASE + " SELECT feature_id, time, ord, CAST(flow AS DOUBLE) AS flow, CAST(velocity AS DOUBLE) AS velocity, CAST(depth AS DOUBLE) AS depth FROM rows")
def scan_cells(spark, d):
    return event_rows(spark, d).select("feature_id", "time", "ord", *[F.col(v).cast("double").alias(v) for v in VARIABLES])


@query(BASE + ", x AS (UNPIVOT cells ON flow, velocity, depth INTO NAME variable VALUE value) SELECT variable, count(*) AS n, round(sum(CAST(value AS DOUBLE)), 4) AS total FROM x WHERE value > -9998 AND NOT isnan(value) GROUP BY variable")
def valid_cells(spark, d):
    return event_run(spark, d).long().groupBy("variable").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("value").cast("double")), 4).alias("total"))


@query(BASE + " SELECT t_idx, time FROM times")
def time_axis(spark, d):
    return event_run(spark, d).times.select("t_idx", "time")


@query(BASE + " SELECT row_idx, feature_id FROM features")
def feature_axis(spark, d):
    return event_run(spark, d).features.select("row_idx", "feature_id")


@query(BASE + " SELECT feature_id, time, CAST(flow AS DOUBLE) AS flow, CAST(velocity AS DOUBLE) AS velocity, CAST(depth AS DOUBLE) AS depth FROM cells")
def dedupe_last(spark, d):
    return event_run(spark, d).cells.select("feature_id", "time", *[F.col(v).cast("double").alias(v) for v in VARIABLES])


@query(BASE + " SELECT row_idx * (SELECT count(*) FROM times) + t_idx AS cell_idx, row_idx, t_idx, coalesce(CAST(flow AS DOUBLE), -9999) AS flow, coalesce(CAST(velocity AS DOUBLE), -9999) AS velocity, coalesce(CAST(depth AS DOUBLE), -9999) AS depth FROM features CROSS JOIN times LEFT JOIN cells USING (feature_id, time)")
def dense_matrix(spark, d):
    return series.dense_matrix(event_run(spark, d))


@query(BASE + " SELECT t_idx, strftime(make_timestamp(time * 1000), '%Y-%m-%d %H:00Z') AS label, 'T+' || (time // 3600) || 'h' AS offset_label FROM times")
def time_labels(spark, d):
    t = event_run(spark, d).times
    return t.select("t_idx", V.time_label(F.col("time"), "epoch_ms").alias("label"), V.time_label(F.col("time"), "offset_s").alias("offset_label"))


# Lookups


@query(BASE + f" SELECT max(CAST(flow AS DOUBLE)) AS value FROM cells JOIN times USING (time) WHERE feature_id = {FEATURE} AND t_idx = {T}")
def point_lookup(spark, d):
    return series.point(event_run(spark, d), "flow", FEATURE, T)


@query(BASE + f" SELECT t_idx, time, CAST(flow AS DOUBLE) AS value FROM times LEFT JOIN (SELECT * FROM cells WHERE feature_id = {FEATURE}) USING (time)")
def feature_series(spark, d):
    return series.series(event_run(spark, d), "flow", FEATURE)


@query(BASE + SLICE + " SELECT feature_id, value FROM slice")
def time_slice(spark, d):
    return series.time_slice(event_run(spark, d), "flow", T)


@query(BASE + SLICE + " SELECT feature_id, value FROM slice")
def time_slice_stored(spark, d):
    """The slice from a store by time."""
    path = fresh_path(spark, "by-time")
    save_by_time(event_run(spark, d), path)
    return series.time_slice(load_by_time(spark, path), "flow", T)


@query(BASE + f" SELECT c_custkey AS feature_id, 'wb-' || c_custkey AS label, CAST(flow AS DOUBLE) AS flow, CAST(velocity AS DOUBLE) AS velocity, CAST(depth AS DOUBLE) AS depth FROM customer LEFT JOIN (SELECT * FROM cells JOIN times USING (time) WHERE t_idx = {T}) ON feature_id = c_custkey")
def feature_record(spark, d):
    return series.record(event_run(spark, d), T, flowpaths(spark, d))


@query(BASE + SLICE + ", p AS (SELECT c_custkey AS feature_id, unnest(['name', 'segment']) AS key, unnest([c_name, c_mktsegment]) AS property FROM customer) SELECT feature_id, value, key, property FROM p LEFT JOIN slice USING (feature_id)")
def feature_info(spark, d):
    return series.info(event_run(spark, d), "flow", T, flowpaths(spark, d))


@query(BASE + " SELECT (SELECT count(*) FROM features) AS features, (SELECT count(*) FROM times) AS time_steps, (SELECT count(*) FROM features) AS matched, '2024-05-01' AS ref_date, (SELECT count(DISTINCT feature_id) FROM cells) AS features_with_cells")
def dataset_info(spark, d):
    return aggregates.dataset_info(event_run(spark, d).replace(ref_time="2024-05-01_00:00:00"))


def _fixed_sql(v: str, digits: int, units: str, missing: str) -> str:
    """A value that is single precision as text; an exact tie goes away from zero."""
    scaled = f"CAST({v} AS DOUBLE) * {2 * 10**digits}"
    return f"CASE WHEN {v} IS NULL THEN '{missing}' WHEN {scaled} = floor({scaled}) AND CAST({scaled} AS BIGINT) % 2 <> 0 THEN printf('%.{digits}f', CAST({v} AS DOUBLE) + 1e-9 * sign({v})) || ' {units}' ELSE printf('%.{digits}f', CAST({v} AS DOUBLE)) || ' {units}' END"


@query(BASE + f" SELECT c_custkey AS feature_id, 'wb-' || c_custkey AS label, {', '.join(f'{_fixed_sql(v, 3, UNITS[v], "N/A")} AS {v}' for v in VARIABLES)} FROM customer LEFT JOIN (SELECT * FROM cells JOIN times USING (time) WHERE t_idx = {T}) ON feature_id = c_custkey")
def record_texts(spark, d):
    return series.record_texts(event_run(spark, d), T, flowpaths(spark, d))


@query(BASE + SLICE + f", p AS (SELECT c_custkey AS feature_id, unnest([0, 1, 2, 3]) AS line, unnest(['id', 'Flow', 'name', 'segment']) AS key, unnest(['wb-' || c_custkey, {_fixed_sql('value', 4, UNITS['flow'], '--')}, c_name, c_mktsegment]) AS text FROM customer LEFT JOIN slice ON feature_id = c_custkey) SELECT feature_id, CAST(line AS INTEGER) AS line, key, text FROM p")
def info_texts(spark, d):
    return series.info_texts(event_run(spark, d), "flow", T, flowpaths(spark, d))


# Aggregates


@query(BASE + BOUNDS + " SELECT mn AS min, mx AS max FROM b")
def bounds(spark, d):
    return aggregates.bounds(event_run(spark, d), "flow")


@query(BASE + " " + " UNION ALL ".join(f"SELECT '{v}' AS variable, coalesce(min(CAST({v} AS DOUBLE)), 0) AS min, coalesce(max(CAST({v} AS DOUBLE)), 1) AS max FROM cells" for v in VARIABLES))
def bounds_all(spark, d):
    return aggregates.all_bounds(event_run(spark, d))


TOTALS = ", totals AS (SELECT t_idx, time, coalesce(sum(CAST(flow AS DOUBLE)), 0) AS total FROM times LEFT JOIN cells USING (time) GROUP BY t_idx, time)"


@query(BASE + TOTALS + " SELECT t_idx, time, round(total, 4) AS total FROM totals")
def totals_by_time(spark, d):
    return aggregates.totals_by_time(event_run(spark, d), "flow").select("t_idx", "time", rounded("total", 4).alias("total"))


@query(BASE + TOTALS + ", r AS (SELECT *, min(total) OVER () AS lo, max(total) OVER () AS hi, max(t_idx) OVER () AS n FROM totals) SELECT t_idx, time, round(total, 4) AS total, round(CASE WHEN n = 0 THEN 0.5 ELSE t_idx / n END, 6) AS x, round((total - lo) / CASE WHEN hi = lo THEN 1 ELSE hi - lo END, 6) AS y FROM r")
def overview_norm(spark, d):
    o = aggregates.overview(event_run(spark, d), "flow")
    return o.select("t_idx", "time", rounded("total", 4).alias("total"), rounded("x").alias("x"), rounded("y").alias("y"))


@query(BASE + ", m AS (SELECT feature_id, min(CAST(flow AS DOUBLE)) AS min, max(CAST(flow AS DOUBLE)) AS max FROM cells WHERE flow IS NOT NULL GROUP BY feature_id) SELECT *, CASE WHEN max = min THEN 1 ELSE max - min END AS range FROM m")
def feature_minmax(spark, d):
    return aggregates.feature_extremes(event_run(spark, d), "flow")


# Ordered


@query(BASE + ", s AS (SELECT feature_id, t_idx, t_idx - row_number() OVER (PARTITION BY feature_id ORDER BY t_idx) AS island FROM cells JOIN times USING (time) WHERE flow IS NOT NULL), g AS (SELECT feature_id, min(t_idx) AS first_t, max(t_idx) AS last_t, count(*) AS points FROM s GROUP BY feature_id, island) SELECT feature_id, row_number() OVER (PARTITION BY feature_id ORDER BY first_t) - 1 AS segment, first_t, last_t, points FROM g")
def series_segments(spark, d):
    return series.segments(event_run(spark, d), "flow")


@query(BASE + ", s AS (SELECT feature_id, t_idx, CAST(flow AS DOUBLE) AS v, min(flow) OVER w AS lo, max(flow) OVER w AS hi FROM cells JOIN times USING (time) WHERE flow IS NOT NULL WINDOW w AS (PARTITION BY feature_id)) SELECT feature_id, t_idx, round(t_idx / ((SELECT count(*) FROM times) - 1), 6) AS x, round((v - CAST(lo AS DOUBLE)) / CASE WHEN hi = lo THEN 1 ELSE CAST(hi AS DOUBLE) - CAST(lo AS DOUBLE) END, 6) AS y FROM s")
def series_norm(spark, d):
    return series.chart(event_run(spark, d), "flow").select("feature_id", "t_idx", rounded("x").alias("x"), rounded("y").alias("y"))


@query(BASE + ", n AS (SELECT count(*) AS n FROM times) SELECT t_idx, (t_idx + 1) % n AS next_t, (t_idx - 1 + n) % n AS previous_t FROM times, n")
def playback_next(spark, d):
    return series.playback_steps(event_run(spark, d))


@query(BASE + ", n AS (SELECT count(*) AS n FROM times) SELECT k, CAST(greatest(0, least(n - 1, floor(k / 20.0 * (n - 1) + 0.5))) AS INTEGER) AS t_idx FROM range(-2, 24) r(k), n")
def seek_index(spark, d):
    n = event_run(spark, d).shape[1]
    return spark.range(-2, 24).select(F.col("id").alias("k"), V.seek_index(F.col("id") / 20, n).alias("t_idx"))


# Merging

SPLIT = "ds_rows AS (SELECT *, CASE WHEN feature_id % 3 = 2 AND ord % 2 = 0 THEN 0 WHEN ord % 3 = 0 THEN 1 ELSE 2 END AS ds FROM rows)"
MERGED = f"""
{BASE}, {SPLIT},
c AS (SELECT ds, feature_id, time, {", ".join(f"max_by({v}, ord) FILTER (WHERE {v} IS NOT NULL) AS {v}" for v in VARIABLES)} FROM ds_rows GROUP BY ds, feature_id, time),
g AS (SELECT feature_id, time, max(ds) AS ds FROM (SELECT DISTINCT ds, feature_id FROM ds_rows) JOIN (SELECT DISTINCT ds, time FROM ds_rows) USING (ds) GROUP BY feature_id, time)"""


@query(MERGED + " SELECT feature_id, time, CAST(flow AS DOUBLE) AS flow, CAST(velocity AS DOUBLE) AS velocity, CAST(depth AS DOUBLE) AS depth FROM g JOIN c USING (feature_id, time, ds) WHERE flow IS NOT NULL OR velocity IS NOT NULL OR depth IS NOT NULL")
def merge_runs(spark, d):
    cells = merge.merge(split_runs(spark, d)).cells
    return cells.select("feature_id", "time", *[F.col(v).cast("double").alias(v) for v in VARIABLES]).filter("coalesce(flow, velocity, depth) IS NOT NULL")


@query(MERGED + f" SELECT feature_id, time, {', '.join(f'CAST({v} AS DOUBLE) AS {v}' for v in VARIABLES)} FROM g JOIN c USING (feature_id, time, ds) WHERE flow IS NOT NULL OR velocity IS NOT NULL OR depth IS NOT NULL")
def running_merge(spark, d):
    """The three runs as files of a stream, merged batch by batch."""
    base = fresh_path(spark, "stream")
    run_files(spark, d, f"{base}/in")
    ingest.running_merge(ingest.read_runs(spark, f"{base}/in"), f"{base}/merged", f"{base}/checkpoint").awaitTermination()
    return _values(ingest.merged_so_far(spark, f"{base}/merged").cells).filter("coalesce(flow, velocity, depth) IS NOT NULL")


@query(f"{BASE}, {SPLIT} SELECT time, row_number() OVER (ORDER BY time) - 1 AS t_idx FROM (SELECT DISTINCT time FROM ds_rows)")
def merge_times(spark, d):
    return merge.merged_times(split_runs(spark, d))


@query(f"{BASE}, {SPLIT} SELECT feature_id, row_number() OVER (ORDER BY ds, feature_id) - 1 AS row_idx FROM (SELECT feature_id, min(ds) AS ds FROM ds_rows GROUP BY feature_id)")
def merge_features(spark, d):
    return merge.merged_features(split_runs(spark, d))


@query(
    MERGED.replace("max(ds) AS ds", "max(ds) AS ds, max(ds) FILTER (WHERE ds < 2) AS dv")
    + " SELECT g.feature_id, g.time, CAST(c.flow AS DOUBLE) AS flow, CAST(e.velocity AS DOUBLE) AS velocity, CAST(e.depth AS DOUBLE) AS depth FROM g LEFT JOIN c USING (feature_id, time, ds) LEFT JOIN c e ON e.feature_id = g.feature_id AND e.time = g.time AND e.ds = dv WHERE coalesce(c.flow, e.velocity, e.depth) IS NOT NULL"
)
def merge_lacking(spark, d):
    """The last of the three runs has the flow only."""
    runs = split_runs(spark, d)
    last = runs[2].replace(cells=runs[2].cells.withColumns({v: F.lit(None).cast("float") for v in ("velocity", "depth")}), variables=("flow",))
    cells = merge.merge([*runs[:2], last]).cells
    return cells.select("feature_id", "time", *[F.col(v).cast("double").alias(v) for v in VARIABLES]).filter("coalesce(flow, velocity, depth) IS NOT NULL")


@query(f"{BASE}, {SPLIT} SELECT DISTINCT feature_id, '2024-05-01_00:00:00' AS ref_time FROM ds_rows")
def merge_ref_time(spark, d):
    """The merged run's reference time, that of the first run, beside each feature."""
    merged = merge.merge([r.replace(ref_time=f"2024-05-0{i + 1}_00:00:00") for i, r in enumerate(split_runs(spark, d))])
    return merged.features.select("feature_id", F.lit(merged.ref_time).alias("ref_time"))


@query(f"{BASE} SELECT feature_id, time, {', '.join(f'CAST({v} AS DOUBLE) AS {v}' for v in VARIABLES)} FROM cells")
def merge_apart(spark, d):
    """Runs of different features, told by their axes, merged without a shuffle of their cells."""
    rows = event_rows(spark, d)
    runs = [run_of(rows.filter(F.col("feature_id") % 3 == i)) for i in range(3)]
    return _values(merge.merge_any(runs).cells)


@query(f"{BASE}, {SPLIT}, r AS (SELECT *, row_number() OVER (PARTITION BY feature_id, time ORDER BY ds, ord) AS place FROM ds_rows) SELECT feature_id, time, place, CAST(flow AS DOUBLE) AS flow, CAST(velocity AS DOUBLE) AS velocity, CAST(depth AS DOUBLE) AS depth FROM r")
def scan_file_order(spark, d):
    """The runs' rows written as result files and scanned as they are, each with its place among its cell's in file and row order."""
    rows = scan_parquet(spark, *split_files(spark, d))
    place = F.row_number().over(Window.partitionBy("feature_id", "time").orderBy("ord"))
    return rows.select("feature_id", "time", place.alias("place"), *[F.col(v).cast("double").alias(v) for v in VARIABLES])


@query(BASE + f" SELECT DISTINCT feature_id FROM cells JOIN times USING (time) WHERE t_idx IN ({T}, {T + 1}) AND flow IS NOT NULL")
def rendered_features(spark, d):
    """The features painted at either of two steps."""
    run = event_run(spark, d)
    slices = [series.time_slice(run, "flow", t).filter("value IS NOT NULL").select("feature_id") for t in (T, T + 1)]
    return slices[0].unionByName(slices[1]).distinct()


@query(MERGED + " SELECT g.feature_id, count(*) AS cells, round(coalesce(sum(CAST(flow AS DOUBLE)), 0), 4) AS flow FROM g JOIN c USING (feature_id, time, ds) WHERE coalesce(flow, velocity, depth) IS NOT NULL GROUP BY g.feature_id")
def scan_many_merge(spark, d):
    """The three runs' rows written as result files and loaded with a damaged and a missing one among them."""
    paths = split_files(spark, d)
    cells = load_many(spark, [*paths[:1], damaged_file(spark, paths[0]), *paths[1:], paths[0] + ".gone.parquet"]).cells.filter("coalesce(flow, velocity, depth) IS NOT NULL")
    return cells.groupBy("feature_id").agg(F.count(F.lit(1)).alias("cells"), F.round(F.coalesce(F.sum(F.col("flow").cast("double")), F.lit(0.0)), 4).alias("flow"))


VALUES_SQL = ", ".join(f"CAST({v} AS DOUBLE) AS {v}" for v in VARIABLES)


def _values(cells: DataFrame) -> DataFrame:
    return cells.select("feature_id", "time", *[F.col(v).cast("double").alias(v) for v in VARIABLES])


@query(f"{BASE} SELECT feature_id, time, {VALUES_SQL} FROM cells")
def load_one(spark, d):
    """All rows written as one result file and loaded by its name's ending."""
    path = f"{fresh_path(spark, 'result')}.parquet"
    event_rows(spark, d).orderBy("ord").drop("ord").write.parquet(path)
    return _values(load(spark, path).cells)


@query(MERGED + f" SELECT feature_id, time, {VALUES_SQL} FROM g JOIN c USING (feature_id, time, ds) WHERE flow IS NOT NULL OR velocity IS NOT NULL OR depth IS NOT NULL")
def load_whole_cycle(spark, d):
    """A cycle's folder with a region that can't be listed, an empty one and a damaged file, loaded as one run."""
    cycle = load_cycle(spark, cycle_folder(spark, d))
    return _values(cycle.run.cells).filter("coalesce(flow, velocity, depth) IS NOT NULL")


@query(
    """WITH f AS (SELECT user_id % 4 AS part, event_type = 'error' OR hour(ts) < 2 AS bad FROM events)
SELECT count(*) AS "rows", count(*) FILTER (WHERE bad) AS rejected, count(DISTINCT part) AS files, (SELECT count(DISTINCT (user_id, date_trunc('day', ts))) FROM events WHERE event_type <> 'error' AND hour(ts) >= 2) AS cells FROM f"""
)
def load_counts(spark, d):
    """Rows, rejected ones and files of a load, counted while its cells are."""
    raw, counts = observed(spark.read.parquet(rejected_files(spark, d)))
    cells = run_of(canonical(raw, F.lit(0))).cells.count()
    found = counts.get
    return spark.createDataFrame([(found["rows"], found["rejected"], found["files"], cells)], "rows long, rejected long, files long, cells long")


# Distributions, over hourly cells

SAMPLE = HOURLY + """, k AS (SELECT (SELECT count(*) FROM features) AS nf, (SELECT count(*) FROM times) AS nt),
sample AS (SELECT row_idx * nt + t_idx AS cell_idx, CAST(flow AS DOUBLE) AS value FROM cells JOIN times USING (time) JOIN features USING (feature_id), k WHERE flow IS NOT NULL AND (row_idx * nt + t_idx) % greatest(1, nf * nt // 50000) = 0)"""


def _repaired(quantiles: list[float]) -> str:
    """SQL for a list of quantiles, each above the one before."""
    raw = ", ".join(f"coalesce(quantile_cont(value, {p!r}), 0) AS q{i}" for i, p in enumerate(quantiles))
    steps = ["q0 AS s0", *(f"CASE WHEN q{i} > s{i - 1} THEN q{i} ELSE s{i - 1} + 1e-6 END AS s{i}" for i in range(1, len(quantiles)))]
    return f", raw AS (SELECT {raw} FROM sample), stops AS (SELECT {', '.join(steps)} FROM raw)"


STOP_AT = [i / (len(PALETTE) - 1) for i in range(len(PALETTE))]
BREAK_AT = [i / len(PALETTE) for i in range(1, len(PALETTE))]


def _numbered(values: list[float], spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i int, value double").select("i", rounded("value").alias("value"))


def _listed(n: int) -> str:
    return " UNION ALL ".join(f"SELECT {i} AS i, round(s{i}, 6) AS value FROM stops" for i in range(n))


@query(SAMPLE + " SELECT cell_idx, value FROM sample")
def value_sample(spark, d):
    return distribution.value_sample(event_run(spark, d, "hour"), "flow")


@query(SAMPLE + ", raw AS (" + " UNION ALL ".join(f"SELECT {i} AS i, quantile_cont(value, {p}) AS q FROM sample" for i, p in enumerate((0.1, 0.5, 0.9))) + ") SELECT i, round(q, 6) AS value FROM raw")
def quantiles(spark, d):
    return _numbered(distribution.quantiles(event_run(spark, d, "hour"), "flow", [0.1, 0.5, 0.9]), spark)


@query(SAMPLE + _repaired(STOP_AT) + " " + _listed(6))
def quantile_stops(spark, d):
    return _numbered(distribution.quantile_stops(event_run(spark, d, "hour"), "flow"), spark)


@query(SAMPLE + _repaired(BREAK_AT) + " " + _listed(5))
def quantile_class_breaks(spark, d):
    return _numbered(distribution.quantile_class_breaks(event_run(spark, d, "hour"), "flow"), spark)


@query(SAMPLE + ", r AS (SELECT value, row_number() OVER (ORDER BY value, cell_idx) - 1 AS rk, count(*) OVER () AS n FROM sample) SELECT i, value FROM r JOIN (SELECT CAST(k AS INTEGER) AS i FROM range(1000) x(k)) ON rk = CASE WHEN n > 1000 THEN CAST(floor(i * (n / 1000.0::DOUBLE)) AS BIGINT) ELSE i END")
def jenks_sample(spark, d):
    return distribution.jenks_sample(event_run(spark, d, "hour"), "flow").select("i", "value")


def _jenks_sql(base: str) -> str:
    """SQL for the natural breaks of every variable, as ``stops`` (variable, s0 to s4): a table of least costs for each number of classes."""
    k = len(PALETTE)
    c = base + f""", nn AS (SELECT (SELECT count(*) FROM features) AS nf, (SELECT count(*) FROM times) AS nt),
long AS (UNPIVOT (SELECT feature_id, time, CAST(flow AS DOUBLE) AS flow, CAST(velocity AS DOUBLE) AS velocity, CAST(depth AS DOUBLE) AS depth FROM cells) ON flow, velocity, depth INTO NAME variable VALUE value),
placed_cells AS (SELECT variable, row_idx * nt + t_idx AS cell_idx, value FROM long JOIN times USING (time) JOIN features USING (feature_id), nn WHERE (row_idx * nt + t_idx) % greatest(1, nf * nt // 50000) = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY variable ORDER BY value, cell_idx) - 1 AS rk, count(*) OVER (PARTITION BY variable) AS n FROM placed_cells),
thinned AS (SELECT variable, i, value FROM ranked JOIN (SELECT k AS i FROM range(1000) x(k)) ON rk = CASE WHEN n > 1000 THEN CAST(floor(i * (n / 1000.0::DOUBLE)) AS BIGINT) ELSE i END),
v AS (SELECT variable, value, row_number() OVER (PARTITION BY variable ORDER BY i) AS b FROM thinned),
pre AS (SELECT variable, b, sum(value) OVER w AS s, sum(value * value) OVER w AS q FROM v WINDOW w AS (PARTITION BY variable ORDER BY b) UNION ALL SELECT DISTINCT variable, 0, 0, 0 FROM v),
d AS (SELECT x.variable, x.b AS a, y.b AS b, (y.q - x.q) - (y.s - x.s) * (y.s - x.s) / (y.b - x.b) AS dev FROM pre x JOIN pre y ON x.variable = y.variable AND x.b < y.b),
c1 AS (SELECT variable, b, dev AS cost FROM d WHERE a = 0)"""
    for i in range(2, k + 1):
        c += f", m{i} AS (SELECT variable, d.b, min({{'cost': cost + dev, 'a': d.a}}) AS m FROM c{i - 1} p JOIN d USING (variable) WHERE d.a = p.b GROUP BY variable, d.b), c{i} AS (SELECT variable, b, m.cost AS cost, m.a AS a FROM m{i})"
    c += ", e6 AS (SELECT variable, max(b) AS e FROM v GROUP BY variable)"
    for i in range(k, 1, -1):
        c += f", e{i - 1} AS (SELECT c{i}.variable, c{i}.a AS e FROM e{i} JOIN c{i} ON c{i}.variable = e{i}.variable AND c{i}.b = e{i}.e)"
    values = ", ".join(f"(SELECT value FROM v WHERE v.variable = f.variable AND v.b = (SELECT e FROM e{i} g WHERE g.variable = f.variable) + 1) AS s{i - 1}" for i in range(1, k))
    return c + f", all_stops AS (SELECT f.variable, {values} FROM e1 f), stops AS (SELECT * FROM all_stops WHERE variable = 'flow')"


@query(_jenks_sql(HOURLY) + " " + _listed(5))
def jenks_breaks(spark, d):
    return _numbered(distribution.jenks_breaks(event_run(spark, d, "hour"), "flow"), spark)


@query(_jenks_sql(HOURLY) + " " + " UNION ALL ".join(f"SELECT variable, {i} AS i, round(s{i}, 6) AS value FROM all_stops" for i in range(5)))
def sql_natural_breaks(spark, d):
    """The breaks of all variables by one SQL statement."""
    run = event_run(spark, d, "hour")
    views.register(run, "hourly_")
    views.register_functions(run, "hourly_")
    return spark.sql("SELECT variable, i, round(value, 6) AS value FROM (SELECT variable, natural_breaks(value) AS breaks FROM hourly_samples GROUP BY variable) LATERAL VIEW posexplode(breaks) AS i, value")


@query(BASE + f" SELECT t_idx, time, CAST(velocity AS DOUBLE) AS value FROM times LEFT JOIN (SELECT * FROM cells WHERE feature_id = {FEATURE}) USING (time)")
def sql_series(spark, d):
    """A series by SQL's table function."""
    run = event_run(spark, d)
    views.register(run, "daily_")
    views.register_functions(run, "daily_")
    return spark.sql(f"SELECT * FROM daily_series({FEATURE}, 'velocity')")


@query(ORACLE_SQL["series_segments"].replace("flow IS NOT NULL", "depth IS NOT NULL"))
def sql_segments(spark, d):
    """All segments of a variable by SQL's table function."""
    run = event_run(spark, d)
    views.register(run, "daily_")
    views.register_functions(run, "daily_")
    return spark.sql("SELECT * FROM daily_segments('depth')")


# Scales and colours, over a slice of the daily cells

_LOG_LO, _SYM = "greatest(mn, 1e-6)", "greatest(mx / 100, 1e-6)"
_REACH = "CASE WHEN mx > mn THEN mx - mn ELSE 1 END"


def _symlog_sql(v: str) -> str:
    return f"CASE WHEN {v} <= {_SYM} THEN {v} / {_SYM} ELSE 1 + log10(greatest({v}, 1e-9) / {_SYM}) END"


TRANSFORM_SQL = {
    "linear": ("value", "mn", "mx"),
    "log": (f"log10(greatest(value, {_LOG_LO}))", f"log10({_LOG_LO})", f"log10(greatest(mx, 10 * {_LOG_LO}))"),
    "sqrt": (f"power((greatest(value, mn) - mn) / {_REACH}, 0.5)", "0.0", "1.0"),
    "cbrt": (f"power((greatest(value, mn) - mn) / {_REACH}, 1.0::DOUBLE / 3)", "0.0", "1.0"),
    "symlog": (_symlog_sql("value"), _symlog_sql("mn"), _symlog_sql("mx")),
}
CHANNELS_SQL = ", ".join(
    f"round(list_extract({[float(c[k]) for c in PALETTE_RGB]}, CAST(i + 1 AS INTEGER)) + (list_extract({[float(c[k]) for c in PALETTE_RGB]}, CAST(i + 2 AS INTEGER)) - list_extract({[float(c[k]) for c in PALETTE_RGB]}, CAST(i + 1 AS INTEGER))) * (position - i), 3) AS {name}"
    for k, name in enumerate(("red", "green", "blue"))
)
PAINTED = f", spots AS (SELECT *, least(floor(position), 4) AS i FROM placed) SELECT feature_id, round(position, 5) AS position, {CHANNELS_SQL} FROM spots"


def _scale(name: str) -> None:
    value, a, b = TRANSFORM_SQL[name]
    ends = f", ends AS (SELECT {a} AS a, CASE WHEN {b} > {a} THEN {b} ELSE {a} + 1 END AS hi FROM b)"

    @query(f"{BASE}{BOUNDS}{SLICE}{ends} SELECT feature_id, round({value}, 6) AS input FROM slice, b WHERE value IS NOT NULL", f"scale_{name}")
    def transformed(spark, d):
        run = event_run(spark, d)
        scale = S.Scale(name, *aggregates.bounds_values(run, "flow"))
        return series.time_slice(run, "flow", T).filter("value IS NOT NULL").select("feature_id", rounded(scale.transform(F.col("value"))).alias("input"))

    placed = f", placed AS (SELECT feature_id, CASE WHEN value IS NOT NULL THEN greatest(0, least(5, ({value} - a) / (hi - a) * 5)) END AS position FROM slice, b, ends)"

    @query(f"{BASE}{BOUNDS}{SLICE}{ends}{placed}{PAINTED}", f"colorize_{name}")
    def colorized(spark, d):
        run = event_run(spark, d)
        return _painted(painting.colorize(run, "flow", name, series.time_slice(run, "flow", T)))


def _painted(colored: DataFrame) -> DataFrame:
    return colored.select("feature_id", rounded("position", 5).alias("position"), *[rounded(c, 3).alias(c) for c in ("red", "green", "blue")])


for _name in S.TRANSFORMS:
    _scale(_name)

RAMP = "CASE WHEN value <= s0 THEN 0.0 " + " ".join(f"WHEN value <= s{i + 1} THEN {i} + (value - s{i}) / (s{i + 1} - s{i})" for i in range(5)) + " WHEN value IS NOT NULL THEN 5.0 END"
DAILY_SAMPLE = SAMPLE.replace(HOURLY, BASE)
INDEX = " + ".join(f"CAST(value >= s{i} AS INTEGER)" for i in range(5))


@query(f"{DAILY_SAMPLE}{_repaired(STOP_AT)}{SLICE}, placed AS (SELECT feature_id, {RAMP} AS position FROM slice, stops){PAINTED}")
def colorize_quantile(spark, d):
    run = event_run(spark, d)
    return _painted(painting.colorize(run, "flow", "quantile", series.time_slice(run, "flow", T)))


@query(f"{DAILY_SAMPLE}{_repaired(BREAK_AT)}{SLICE}, placed AS (SELECT feature_id, CAST({INDEX} AS DOUBLE) AS position FROM slice, stops){PAINTED}")
def colorize_quantile_classes(spark, d):
    run = event_run(spark, d)
    return _painted(painting.colorize(run, "flow", "quantile-classes", series.time_slice(run, "flow", T)))


@query(f"{_jenks_sql(BASE)}{SLICE}, placed AS (SELECT feature_id, CAST({INDEX} AS DOUBLE) AS position FROM slice, stops){PAINTED}")
def colorize_jenks(spark, d):
    run = event_run(spark, d)
    return _painted(painting.colorize(run, "flow", "jenks", series.time_slice(run, "flow", T)))


@query(f"{DAILY_SAMPLE}{_repaired(BREAK_AT)}{SLICE} SELECT feature_id, value, {INDEX} AS class_index FROM slice, stops")
def class_index_quantile_classes(spark, d):
    run = event_run(spark, d)
    return painting.classify(run, "flow", "quantile-classes", series.time_slice(run, "flow", T))


@query(f"{_jenks_sql(BASE)}{SLICE} SELECT feature_id, value, {INDEX} AS class_index FROM slice, stops")
def class_index_jenks(spark, d):
    run = event_run(spark, d)
    return painting.classify(run, "flow", "jenks", series.time_slice(run, "flow", T))


@query(
    f"{BASE}{BOUNDS} "
    + " UNION ALL ".join(
        f"SELECT '{n}' AS scale, CAST(k AS INTEGER) AS i, round(a + (CASE WHEN e > a THEN e - a ELSE 1 END) * k / 5, 6) AS value FROM (SELECT {a} AS a, {b} AS e FROM b), range(6) r(k)" for n, (_, a, b) in TRANSFORM_SQL.items()
    )
)
def color_stops(spark, d):
    low, high = aggregates.bounds_values(event_run(spark, d), "flow")
    rows = [(n, i, v) for n in S.TRANSFORMS for i, v in enumerate(S.Scale(n, low, high).stops())]
    return spark.createDataFrame(rows, "scale string, i int, value double").select("scale", "i", rounded("value").alias("value"))


@query(f"{BASE}{BOUNDS}{SLICE} SELECT feature_id, value, round(CASE WHEN value IS NULL THEN 0 ELSE 1.5 + 5.5 * least(1, greatest(0, (value - mn) / (CASE WHEN mx > mn THEN mx - mn ELSE 1 END))) END, 6) AS width FROM slice, b")
def line_width(spark, d):
    run = event_run(spark, d)
    return painting.widths(run, "flow", series.time_slice(run, "flow", T)).select("feature_id", "value", rounded("width").alias("width"))


@query(f"{BASE}{BOUNDS} " + " UNION ALL ".join(f"SELECT '{s}' AS scale, 'Flow (m³/s){'' if s == 'linear' else ' · ' + note}' AS title, mn AS min, mx AS max FROM b" for s, note in SCALE_NOTES.items()))
def legend(spark, d):
    run = event_run(spark, d)
    return reduce(DataFrame.unionByName, [aggregates.legend(run, "flow", s).withColumn("scale", F.lit(s)) for s in SCALE_NOTES])


# The network

NESTED = """WITH sizes AS (SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey),
r AS (SELECT r_regionkey, coalesce(n, 0) AS n, 1 + coalesce(sum(coalesce(n, 0) + 1) OVER (ORDER BY r_regionkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS u FROM region LEFT JOIN sizes ON n_regionkey = r_regionkey),
divides AS (SELECT CAST(u AS BIGINT) AS upstream_id, n AS num_upstreams FROM r UNION ALL SELECT CAST(u + row_number() OVER (PARTITION BY r_regionkey ORDER BY n_nationkey) AS BIGINT), 0 FROM nation JOIN r ON n_regionkey = r_regionkey)"""


@query(NESTED + " SELECT upstream_id, num_upstreams FROM divides WHERE upstream_id > 7 AND upstream_id <= 12")
def upstream_select(spark, d):
    return network.upstream(divides(spark, d), 7, 5)


@query(NESTED + " SELECT a.upstream_id, b.upstream_id AS member_id FROM divides a JOIN divides b ON b.upstream_id > a.upstream_id AND b.upstream_id <= a.upstream_id + a.num_upstreams")
def upstream_join(spark, d):
    all_divides = divides(spark, d)
    return network.upstream_pairs(all_divides, all_divides, width=4)


# Geometry


def _point_sql(a: int, b: int) -> str:
    return f"{{'x': (c_custkey * {a}) % 3600 / 10 - 180, 'y': (c_custkey * {b}) % 1600 / 10 - 80}}"


LINES = f"lines AS (SELECT c_custkey AS feature_id, unnest(CASE WHEN c_custkey % 3 = 0 THEN [{_point_sql(37, 53)}, {_point_sql(41, 59)}, {_point_sql(43, 61)}, {_point_sql(47, 67)}] ELSE [{_point_sql(37, 53)}, {_point_sql(41, 59)}] END) AS p FROM customer)"
BOX = "min(p.x) AS min_x, min(p.y) AS min_y, max(p.x) AS max_x, max(p.y) AS max_y"
_Z, _X, _Y, _W = TILE
LAT = lambda y, z: f"degrees(atan(sinh(pi() * (1 - 2 * ({y}) / power(2.0, {z})))))"


@query(f"WITH {LINES} SELECT {BOX} FROM lines WHERE feature_id IN (SELECT user_id FROM events)")
def loaded_extent(spark, d):
    return spatial.loaded_extent(flowpaths(spark, d), event_run(spark, d).features)


TILES_SQL = f"""tiles AS (
  SELECT DISTINCT z, CAST(floor((p.x + 180) / 360 * power(2.0, z)) AS BIGINT) AS x, CAST(floor((1 - asinh(tan(radians(p.y))) / pi()) / 2 * power(2.0, z)) AS BIGINT) AS y
  FROM (SELECT CAST(c_custkey % 6 AS INTEGER) AS z, {_point_sql(37, 53)} AS p FROM customer)
)"""


@query(f"WITH {TILES_SQL} SELECT z, x, y, w AS wrap, round(x / power(2.0, z) * 360 - 180 + w * 360, 6) AS west, round((x + 1) / power(2.0, z) * 360 - 180 + w * 360, 6) AS east, round({LAT('y', 'z')}, 6) AS north, round({LAT('y + 1', 'z')}, 6) AS south FROM tiles, range(-1, 2) e(w)")
def tile_bbox(spark, d):
    """The boxes of the tiles in which lines begin, at zooms from 0 to 5, and of their repeats to the west and the east."""
    tiles = line_tiles(spark, d).withColumn("wrap", F.explode(F.array(*[F.lit(w) for w in (-1, 0, 1)])))
    box = V.tile_bbox(*[F.col(c) for c in ("z", "x", "y", "wrap")])
    return tiles.select("z", "x", "y", "wrap", *[rounded(c).alias(k) for k, c in box.items()])


def line_tiles(spark: SparkSession, d: str) -> DataFrame:
    """``(z, x, y)`` of the tile in which each line begins, at a zoom told by the feature."""
    z, p = F.pmod("feature_id", F.lit(6)).cast("int"), F.col("coordinates")[0][0]
    at = V.tile_of(z, p["x"], p["y"])
    return flowpaths(spark, d).select(z.alias("z"), *[c.alias(k) for k, c in at.items()]).distinct()


IN_TILE = f"boxes AS (SELECT feature_id, {BOX} FROM lines GROUP BY feature_id), t AS (SELECT {_X} / power(2.0, {_Z}) * 360 - 180 AS w, ({_X} + 1) / power(2.0, {_Z}) * 360 - 180 AS e, {LAT(_Y, _Z)} AS n, {LAT(f'{_Y} + 1', _Z)} AS s), visible AS (SELECT boxes.* FROM boxes, t WHERE min_x <= e AND max_x >= w AND min_y <= n AND max_y >= s)"


def _visible(spark: SparkSession, d: str) -> DataFrame:
    """The flowpaths whose box meets the tile's."""
    box = spark.range(1).select(*[c.alias(k) for k, c in V.tile_bbox(*[F.lit(x) for x in TILE]).items()]).first()
    return spatial.in_box(spatial.feature_boxes(flowpaths(spark, d)), box.west, box.south, box.east, box.north)


@query(f"WITH {LINES}, {IN_TILE} SELECT * FROM visible")
def bbox_filter(spark, d):
    return _visible(spark, d)


SEGMENTS_SQL = f"""segments AS (SELECT c_custkey AS feature_id, unnest(CASE WHEN c_custkey % 3 = 0 THEN [{{'a': {_point_sql(37, 53)}, 'b': {_point_sql(41, 59)}}}, {{'a': {_point_sql(43, 61)}, 'b': {_point_sql(47, 67)}}}] ELSE [{{'a': {_point_sql(37, 53)}, 'b': {_point_sql(41, 59)}}}] END) AS s FROM customer),
boxes AS (SELECT z, x, y, x / power(2.0, z) * 360 - 180 AS w, (x + 1) / power(2.0, z) * 360 - 180 AS e, {LAT('y', 'z')} AS n, {LAT('y + 1', 'z')} AS so FROM tiles),
pairs AS (SELECT z, x, y, w, e, n, so, feature_id, s.a.x AS x0, s.a.y AS y0, s.b.x AS x1, s.b.y AS y1 FROM boxes, segments),
parts AS (
  SELECT *, CASE WHEN x1 = x0 THEN CASE WHEN x0 BETWEEN w AND e THEN 0 ELSE 2 END ELSE least((w - x0) / (x1 - x0), (e - x0) / (x1 - x0)) END AS x_in, CASE WHEN x1 = x0 THEN 1 ELSE greatest((w - x0) / (x1 - x0), (e - x0) / (x1 - x0)) END AS x_out,
    CASE WHEN y1 = y0 THEN CASE WHEN y0 BETWEEN so AND n THEN 0 ELSE 2 END ELSE least((so - y0) / (y1 - y0), (n - y0) / (y1 - y0)) END AS y_in, CASE WHEN y1 = y0 THEN 1 ELSE greatest((so - y0) / (y1 - y0), (n - y0) / (y1 - y0)) END AS y_out
  FROM pairs)"""


@query(f"WITH {TILES_SQL}, {SEGMENTS_SQL} SELECT DISTINCT z, x, y, feature_id FROM parts WHERE greatest(0, x_in, y_in) <= least(1, x_out, y_out)")
def tile_features(spark, d):
    """The lines with a point in each of many tiles."""
    return spatial.tile_features(flowpaths(spark, d), line_tiles(spark, d))


@query(f"{BASE}{SLICE}, {LINES}, {IN_TILE} SELECT feature_id, value FROM slice JOIN visible USING (feature_id)")
def paint_join(spark, d):
    return series.paint(event_run(spark, d), "flow", T, _visible(spark, d))


@query(f"{BASE}{SLICE}, {LINES}, {IN_TILE} SELECT feature_id, value FROM slice WHERE feature_id NOT IN (SELECT feature_id FROM visible)")
def unpainted_features(spark, d):
    return series.unpainted(_visible(spark, d), series.time_slice(event_run(spark, d), "flow", T))


@query("SELECT c_custkey AS feature_id, CAST(c_custkey % 12 AS INTEGER) AS stream_order, round(1 + 5 * (power(1.6, greatest(1, least(8, c_custkey % 12)) - 1) - 1) / (power(1.6, 7) - 1), 6) AS width FROM customer")
def order_width(spark, d):
    order = (F.col("feature_id") % 12).cast("int")
    return flowpaths(spark, d).select("feature_id", order.alias("stream_order"), rounded(S.order_width(order)).alias("width"))


# Text and links

TIE = "value * 4 = floor(value * 4) AND CAST(value * 4 AS BIGINT) % 2 <> 0"


@query(f"SELECT event_id, CASE WHEN {TIE} THEN printf('%.1f', value + 0.01 * sign(value)) ELSE printf('%.1f', value) END AS one, printf('%.3f', value) AS three FROM events")
def fixed_digits(spark, d):
    one, three = V.to_fixed(1), V.to_fixed(3)
    return table(spark, d, "events").select("event_id", one(F.col("value")).alias("one"), three(F.col("value")).alias("three"))


@query("SELECT c_custkey AS feature_id, 'https://viewer.example/?bucket=' || lower(c_mktsegment) || '&path=' || url_encode('outputs/' || c_name || '/') AS url, lower(c_mktsegment) AS bucket, 'outputs/' || c_name || '/' AS path FROM customer")
def deep_links(spark, d):
    """A link for each flowpath, and what is read out of it again."""
    p = F.col("properties")
    url = P.deep_link(F.lit("https://viewer.example/"), F.lower(p["segment"]), F.concat(F.lit("outputs/"), p["name"], F.lit("/")))
    return flowpaths(spark, d).select("feature_id", url.alias("url")).select("feature_id", "url", *[c.alias(k) for k, c in P.from_deep_link(F.col("url")).items()])


@query("SELECT event_id, replace(event_type, 'view', 'VPU') || '_' || user_id AS name, event_type = 'view' AS clicked FROM events")
def clicked_vpu(spark, d):
    name = F.concat_ws("_", F.replace("event_type", F.lit("view"), F.lit("VPU")), "user_id")
    return table(spark, d, "events").select("event_id", name.alias("name"), P.is_clicked_vpu(name).alias("clicked"))


# The tree of runs

KEYS_SQL = """WITH keys AS (
  SELECT DISTINCT 'outputs/m' || user_id % 4 || '/v2.2_hydrofabric/ngen.' || strftime(ts, '%Y%m%d') || '/' || r || '/' || lpad(CAST(hour(ts) - hour(ts) % 6 AS VARCHAR), 2, '0') || '/'
    || CASE WHEN r = 'medium_range' THEN (user_id % 2 + 1) || '/' ELSE '' END || list_extract(['VPU_', 'VPU-', 'vpu_'], CAST(user_id % 3 + 1 AS INTEGER)) || lpad(CAST(user_id % 21 AS VARCHAR), 2, '0')
    || '/ngen-run/outputs/troute/' || list_extract(['troute.nc', 'part.parquet', 'log.txt'], CAST(event_id % 3 + 1 AS INTEGER)) AS key
  FROM (SELECT *, CASE event_type WHEN 'view' THEN 'short_range' WHEN 'click' THEN 'Short_Range' WHEN 'purchase' THEN 'medium_range' WHEN 'signup' THEN 'analysis_assim_extend' ELSE 'logs' END AS r FROM events)
)"""
FOLDERS_SQL = KEYS_SQL + ", folders AS (SELECT DISTINCT array_to_string(parts[1:n], '/') || '/' AS path, parts[n] AS name, CASE WHEN n = 1 THEN '' ELSE array_to_string(parts[1:n - 1], '/') || '/' END AS parent FROM (SELECT string_split(key, '/') AS parts, unnest(range(1, len(string_split(key, '/')))) AS n FROM keys))"
LISTED_SQL = FOLDERS_SQL + ", listed AS (SELECT *, CAST(CASE WHEN parent LIKE '%\\_hydrofabric/' ESCAPE '\\' THEN row_number() OVER (PARTITION BY parent ORDER BY name DESC) ELSE row_number() OVER (PARTITION BY parent ORDER BY name) END - 1 AS INTEGER) AS position FROM folders)"


def run_folders(spark: SparkSession, d: str) -> DataFrame:
    return runtree.folders_of(event_keys(spark, d))


@query(LISTED_SQL + " SELECT parent, position, name, path FROM listed")
def list_folders(spark, d):
    return runtree.listed(run_folders(spark, d))


@query(FOLDERS_SQL + r" SELECT path, name, regexp_matches(name, '\d{8}') AS is_date, regexp_matches(name, '(?i)_range$') OR regexp_matches(name, '(?i)^analysis') AS is_range, regexp_matches(name, '^\d+$') AS is_cycle, regexp_matches(name, '(?i)^VPU[_-]') AS is_vpu, coalesce(TRY_CAST(regexp_extract(name, '(\d{8})', 1) AS INTEGER), 0) AS date_key FROM folders")
def classify_folders(spark, d):
    return runtree.classified(run_folders(spark, d))


@query(FOLDERS_SQL + " SELECT parent, bool_and(regexp_matches(name, '(?i)^VPU[_-]')) AS is_cycle_level FROM folders GROUP BY parent")
def is_cycle_level(spark, d):
    return runtree.is_cycle_level(run_folders(spark, d))


@query(
    LISTED_SQL
    + r""", w AS (
  SELECT DISTINCT 'outputs/m' || c_custkey % 5 || list_extract(['', '/v2.2_hydrofabric', '/v2.2_hydrofabric/ngen.20240101/short_range', '/v2.2_hydrofabric/ngen.20240101/medium_range/00/1/VPU_01/'], CAST(c_custkey % 4 + 1 AS INTEGER)) AS path,
    'outputs/m' || c_custkey % 5 || '/' AS model, range_key
  FROM customer, (SELECT unnest(['short', 'medium', 'analysis', 'long']) AS range_key)
), day AS (SELECT parent, max_by(path, name) AS day FROM folders WHERE name LIKE 'ngen.%' GROUP BY parent),
r AS (SELECT parent AS day, k, min_by(path, position) AS rng FROM listed, (SELECT unnest(['short', 'medium', 'analysis', 'long']) AS k) WHERE starts_with(lower(name), k) AND regexp_matches(parent, '/ngen\.\d{8}/$') GROUP BY parent, k),
num AS (SELECT parent, max_by(path, CAST(name AS INTEGER)) AS numbered FROM folders WHERE regexp_matches(name, '^\d+$') GROUP BY parent)
SELECT w.path, range_key, coalesce(m.numbered, c.numbered) AS latest,
  CASE WHEN day IS NULL THEN 'no dated run folders below ' || w.path WHEN rng IS NULL THEN 'no ' || range_key || ' range in the latest run' END AS problem
FROM w LEFT JOIN day ON day.parent = model || 'v2.2_hydrofabric/' LEFT JOIN r USING (day) LEFT JOIN num c ON c.parent = rng LEFT JOIN num m ON m.parent = c.numbered
WHERE r.k IS NULL OR r.k = range_key
UNION
SELECT w.path, range_key, NULL, 'no ' || range_key || ' range in the latest run' FROM w JOIN day ON day.parent = model || 'v2.2_hydrofabric/' WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.day = day.day AND r.k = range_key)"""
)
def latest_cycle(spark, d):
    return runtree.latest_cycles(event_keys(spark, d), asked_cycles(spark, d))


FILES_SQL = KEYS_SQL + ", files AS (SELECT string_split(key, '/ngen-run/outputs/troute/')[1] || '/' AS region, list_extract(string_split(key, '/'), -1) AS name, key FROM keys WHERE key LIKE '%.nc' OR key LIKE '%.parquet')"


@query(FILES_SQL + " SELECT region, name, key FROM files")
def result_files(spark, d):
    return runtree.result_files(event_keys(spark, d))


@query(FILES_SQL + " SELECT region, min(key) AS key FROM files GROUP BY region HAVING count(*) = 1")
def only_files(spark, d):
    return runtree.only_files(runtree.result_files(event_keys(spark, d)))
