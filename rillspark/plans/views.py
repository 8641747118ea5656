"""A run as temporary views and functions, for SQL."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillspark.constants import VARIABLES
from rillspark.functions import values as V
from rillspark.model import Run
from rillspark.operators import distribution


def register(run: Run, prefix: str = "") -> list[str]:
    """Make views ``cells``, ``features`` and ``times``, with ``prefix`` before their names, which are returned."""
    names = []
    for name in ("cells", "features", "times"):
        getattr(run, name).createOrReplaceTempView(f"{prefix}{name}")
        names.append(f"{prefix}{name}")
    return names


def samples(run: Run) -> DataFrame:
    """``(variable, i, value)``: the values that natural breaks are computed on, of each variable."""
    return reduce(DataFrame.unionByName, [distribution.jenks_sample(run, v).select(F.lit(v).alias("variable"), "i", "value") for v in VARIABLES])


def register_functions(run: Run, prefix: str = "") -> list[str]:
    """After ``register``: the view ``samples`` and the functions below, with ``prefix`` before their names, which are returned.

    Table functions, which SQL plans like any query: ``series(feature_id, variable)`` gives ``(t_idx, time, value)`` of a feature at
    every step, ``segments(variable)`` gives ``(feature_id, segment, first_t, last_t, points)``.  ``natural_breaks(value)`` is an
    aggregate, meant for the rows of ``samples``; ``to_fixed_2``, ``_3`` and ``_4`` write numbers of so many digits.
    """
    spark = run.cells.sparkSession
    samples(run).createOrReplaceTempView(f"{prefix}samples")
    value = "CASE variable " + " ".join(f"WHEN '{v}' THEN {v}" for v in VARIABLES) + " END"
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION {prefix}series(of BIGINT, variable STRING) RETURNS TABLE(t_idx BIGINT, time BIGINT, value DOUBLE)
        RETURN SELECT CAST(t.t_idx AS BIGINT), t.time, CAST({value} AS DOUBLE)
        FROM {prefix}times t LEFT JOIN (SELECT * FROM {prefix}cells WHERE feature_id = of) c ON t.time = c.time""")
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION {prefix}segments(variable STRING) RETURNS TABLE(feature_id BIGINT, segment BIGINT, first_t BIGINT, last_t BIGINT, points BIGINT)
        RETURN SELECT feature_id, row_number() OVER (PARTITION BY feature_id ORDER BY min(t_idx)) - 1, min(t_idx), max(t_idx), count(*)
        FROM (SELECT feature_id, t_idx, t_idx - row_number() OVER (PARTITION BY feature_id ORDER BY t_idx) AS island
              FROM {prefix}cells c JOIN {prefix}times t ON c.time = t.time WHERE {value} IS NOT NULL) GROUP BY feature_id, island""")
    return [f"{prefix}{name}" for name in ("samples", "series", "segments")] + register_scalars(spark)


def register_scalars(spark: SparkSession) -> list[str]:
    """The functions that need no run, under their own names."""

    @F.pandas_udf("array<double>")
    def natural_breaks(values: pd.Series) -> list:
        return distribution.natural_breaks(values.dropna().tolist())

    spark.udf.register("natural_breaks", natural_breaks)
    for digits in (2, 3, 4):
        spark.udf.register(f"to_fixed_{digits}", V.to_fixed(digits))
    return ["natural_breaks", "to_fixed_2", "to_fixed_3", "to_fixed_4"]
