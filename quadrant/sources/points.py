"""Point sets: any DataFrame with two coordinate columns.

A point set is a DataFrame ``(id BIGINT, x DOUBLE, y DOUBLE, ...carried)``.
x and y stay plain stored columns (not a struct, not a UDT) so that filters on
them reach the Parquet scan.
"""

from __future__ import annotations

from typing import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrant.session import materialize

BAD_RECORD = "_bad"


def valid_xy(x: str = "x", y: str = "y") -> Column:
    """Rows with a usable coordinate pair: not NULL and not NaN."""
    return (F.col(x).isNotNull() & F.col(y).isNotNull()
            & ~F.isnan(F.col(x)) & ~F.isnan(F.col(y)))


def points(df: DataFrame, x: str = "x", y: str = "y", id: str | Column | None = None,
           carry: bool | Iterable[str] = True) -> DataFrame:
    """Turn any DataFrame into a point set.

    ``id`` names a column (cast to BIGINT), is a Column expression, or is None,
    in which case the rows are numbered once and written with their numbers: numbers given anew at each scan
    would follow the file splits of that scan.  A stream needs an id.  ``carry`` keeps the other columns (True), none
    (False) or the listed ones.  Rows whose x or y is NULL or NaN are dropped.
    """
    if id is None:
        id_col = F.monotonically_increasing_id()
    elif isinstance(id, Column):
        id_col = id
    else:
        id_col = F.col(id)
    core = {"id", "x", "y", x, y} | ({id} if isinstance(id, str) else set())
    if carry is True:
        rest = [c for c in df.columns if c not in core and c != BAD_RECORD]
    elif carry is False:
        rest = []
    else:
        rest = list(carry)
    out = df.select(id_col.cast("bigint").alias("id"),
                    F.col(x).cast("double").alias("x"),
                    F.col(y).cast("double").alias("y"),
                    *[F.col(c) for c in rest]).where(valid_xy())
    if id is None:
        if df.isStreaming:
            raise ValueError("name an id column: the rows of a stream can't be numbered")
        out = materialize(out, "numbered-points")
    return out


def _csv_schema(schema: T.StructType | str | None, offset: int) -> T.StructType:
    if schema is None:
        schema = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
    elif isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    lead = [T.StructField(f"_c{i}", T.StringType()) for i in range(offset)]
    return T.StructType(lead + list(schema.fields) + [T.StructField(BAD_RECORD, T.StringType())])


def read_points(spark: SparkSession, path: str | list[str], format: str = "csv",
                schema: T.StructType | str | None = None, x: str = "x", y: str = "y",
                id: str | None = None, offset: int = 0, carry: bool | Iterable[str] = True,
                options: dict | None = None) -> DataFrame:
    """Read a point set from files or a connector.

    * ``csv``: position based, no header by default.  ``schema`` lists the
      columns from ``offset`` on (x and y first, then carried columns); the
      ``offset`` leading columns are read as strings and dropped.  Malformed
      lines are kept in PERMISSIVE mode; rows whose x or y did not parse are
      then dropped, other fields that did not parse become NULL.
    * ``json``: JSON lines with fields named by ``schema`` (the document-store
      record ``{x: double, y: double}`` by default).
    * ``parquet`` / ``orc``: read as stored; ``schema`` optional.
    * anything else (a document-store connector, JDBC, ...): passed straight
      to ``spark.read.format(format)`` with ``options``.

    The schema is always given, never inferred.
    """
    opts = dict(options or {})
    reader = spark.read
    if format == "csv":
        full = _csv_schema(schema, offset)
        df = (reader.schema(full).option("mode", "PERMISSIVE")
              .option("columnNameOfCorruptRecord", BAD_RECORD)
              .options(**opts).csv(path))
        df = df.drop(*[f"_c{i}" for i in range(offset)])
    else:
        if schema is None and format == "json":
            schema = "x DOUBLE, y DOUBLE"
        if schema is not None:
            reader = reader.schema(schema)
        df = reader.format(format).options(**opts).load(path)
    if BAD_RECORD in df.columns:
        df = df.drop(BAD_RECORD)
    return points(df, x=x, y=y, id=id, carry=carry)


def points_sql(spark: SparkSession, df: DataFrame, view: str = "origin",
               columns: str = "id, x, y") -> DataFrame:
    """Register a named view and project it with SQL."""
    df.createOrReplaceTempView(view)
    return spark.sql(f"SELECT {columns} FROM {view}")


def extent(pts: DataFrame) -> DataFrame:
    """L1: one-row extent and count ``(minx, maxx, miny, maxy, n)``."""
    return pts.agg(F.min("x").alias("minx"), F.max("x").alias("maxx"),
                   F.min("y").alias("miny"), F.max("y").alias("maxy"),
                   F.count(F.lit(1)).alias("n"))


__all__ = ["points", "read_points", "points_sql", "extent", "valid_xy", "BAD_RECORD"]
