"""Point sets derived from the driver's tables.

The driver's tables carry no coordinates, so each integer key is mapped to a
point in the workload extent by an integer hash.  Spark and DuckDB evaluate the
same expression in the same order and get bit-equal doubles.

| set | table    | key u                           | role                      |
| A   | orders   | o_orderkey (unique)             | kNN side                  |
| B   | lineitem | l_orderkey * 8 + l_linenumber   | join / range side, dups   |
| C   | events   | event_id (unique)               | unique-id join side       |
| D   | events   | as C, unit fraction f -> f^4    | skewed set                |
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrant.functions.generators import MIN_X, MIN_Y, SPAN_X, SPAN_Y
from quadrant.sources.points import points

# The key-to-coordinate hash shared with the oracle SQL.
KEY_X = dict(mult=7919, offset=13, mod=1000003)
KEY_Y = dict(mult=104729, offset=71, mod=1000033)


def _unit(u: Column, h: dict) -> Column:
    return ((u * h["mult"] + h["offset"]) % h["mod"]) / F.lit(float(h["mod"]))


def _skew(f: Column) -> Column:
    return f * f * f * f


def key_point(u: Column, skewed: bool = False) -> tuple[Column, Column]:
    fx, fy = _unit(u, KEY_X), _unit(u, KEY_Y)
    if skewed:
        fx, fy = _skew(fx), _skew(fy)
    return F.lit(MIN_X) + fx * F.lit(SPAN_X), F.lit(MIN_Y) + fy * F.lit(SPAN_Y)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _derive(df: DataFrame, u: Column, skewed: bool, carry: list[str]) -> DataFrame:
    x, y = key_point(u, skewed)
    return points(df.select(u.alias("_u"), x.alias("x"), y.alias("y"), *carry),
                  id="_u", carry=carry)


def a_from(orders: DataFrame) -> DataFrame:
    """Set A from an ``orders`` frame (batch or streaming)."""
    return _derive(orders, F.col("o_orderkey"), False, [])


def b_from(lineitem: DataFrame) -> DataFrame:
    """Set B from a ``lineitem`` frame (batch or streaming)."""
    return _derive(lineitem, F.col("l_orderkey") * 8 + F.col("l_linenumber"), False, [])


def c_from(events: DataFrame, skewed: bool = False) -> DataFrame:
    """Set C (or the skewed set D) from an ``events`` frame (batch or streaming)."""
    return _derive(events, F.col("event_id"), skewed, [])


def points_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set A: one point per order (unique id), the kNN side."""
    return a_from(table(spark, sf_dir, "orders"))


def points_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set B: one point per line item; the id is not unique (duplicates kept)."""
    return b_from(table(spark, sf_dir, "lineitem"))


def points_c(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set C: one point per event (unique id)."""
    return c_from(table(spark, sf_dir, "events"))


def points_d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set D: events pushed hard towards the extent's lower-left corner (skew)."""
    return c_from(table(spark, sf_dir, "events"), skewed=True)


__all__ = ["points_a", "points_b", "points_c", "points_d", "a_from", "b_from", "c_from",
           "key_point", "table"]
