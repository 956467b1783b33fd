"""Collections of point documents as a Spark data source, to read and to write (S3).

A collection is a folder of JSON lines, ``{"x": 1.0, "y": 2.0, ...}``.  ``spark.read.format("documents")`` plans files, and byte
ranges of large ones, into partitions.  The writer notes each file's smallest and largest x and y with the commit, so
bounds on x and y that a query pushes down skip whole files; Spark tests the rows again.  Documents that don't
parse, or don't fit the schema, are dropped, kept in a column ``_bad``, or raise an error.

Options for reading: ``mode`` (``dropmalformed``, ``permissive`` with a column ``_bad`` in the schema, ``failfast``) and
``partition_bytes``.  For writing: ``compression`` (none or gzip) and ``file_bytes``; rows without valid x and y are left out and counted.

Spark 4.1 keeps pushed predicates with the loaded table, not with the query, so load anew for each query, as
:func:`read_documents` does.
"""

from __future__ import annotations

import gzip
import io
import json
import math
import sys
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import json as pajson
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from quadrant.functions.geometry import grid_coord, with_morton
from quadrant.sources import storage
from quadrant.sources.points import BAD_RECORD, points, valid_xy

SUFFIXES = (".json", ".jsonl", ".jsonl.gz")
#: Bytes of lines that are parsed at once.
BLOCK = 4 << 20
#: Depth of the Z-order grid by which documents are dealt over files.
DEPTH = 16


# --- reading ---------------------------------------------------------------------------

def whole_lines(source, start: int, stop: int | None) -> Iterator[bytes]:
    """Blocks of whole lines: those that begin in [start, stop)."""
    at = start
    if start:
        source.seek(start - 1)
        at = start - 1 + len(source.readline())  # the line that began before this range is the neighbour's
    while stop is None or at < stop:
        size = BLOCK if stop is None else min(BLOCK, stop - at)
        block = source.read(size)
        if not block:
            return
        if not block.endswith(b"\n"):
            block += source.readline()
        at += len(block)
        yield block


def _one(line: bytes, schema: pa.Schema) -> list | None:
    """A line's values by the schema, or None for a line that has none."""
    try:
        doc = json.loads(line)
        if not isinstance(doc, dict):
            return None
        out = []
        for field in schema:
            v = doc.get(field.name)
            if v is not None and (isinstance(v, bool) != pa.types.is_boolean(field.type) or pa.types.is_integer(field.type) and not isinstance(v, int)):
                return None
            out.append(pa.array([v], field.type))
        return out
    except (ValueError, TypeError, OverflowError, pa.ArrowException):
        return None


def parse_block(block: bytes, schema: pa.Schema, strict: bool, keep_bad: bool, where: str) -> Iterator[pa.RecordBatch]:
    """The block's documents; a block with a line that doesn't fit is parsed line by line."""
    empty = pa.nulls(0, pa.string())
    if not block.strip():
        return
    try:
        table = pajson.read_json(io.BytesIO(block), pajson.ReadOptions(use_threads=False, block_size=len(block) + 1),
                                 pajson.ParseOptions(explicit_schema=schema, newlines_in_values=False, unexpected_field_behavior="ignore"))
        for b in table.select(schema.names).to_batches():
            yield pa.RecordBatch.from_arrays([*b.columns, pa.nulls(b.num_rows, pa.string())], [*schema.names, BAD_RECORD]) if keep_bad else b
        return
    except pa.ArrowInvalid:
        pass
    rows, bad = [], []
    for line in block.splitlines():
        if not line.strip():
            continue
        values = _one(line, schema)
        if values is not None:
            rows.append(values)
        elif strict:
            raise ValueError(f"{where}: {line[:200]!r} is no document of the schema")
        elif keep_bad:
            bad.append(line.decode("utf-8", "replace"))
    columns = [pa.concat_arrays([r[i] for r in rows]) if rows else pa.nulls(0, f.type) for i, f in enumerate(schema)]
    if keep_bad:
        columns = [pa.concat_arrays([c, pa.nulls(len(bad), c.type)]) for c in columns]
        columns.append(pa.concat_arrays([pa.nulls(len(rows), pa.string()), pa.array(bad, pa.string()) if bad else empty]))
    yield pa.RecordBatch.from_arrays(columns, [*schema.names, *[BAD_RECORD] * keep_bad])


def _may_hold(f: ds.Filter, known: dict) -> bool:
    """Whether a file with these facts can hold a row that satisfies the predicate."""
    axis = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
    low, high = known.get(f"min{axis}"), known.get(f"max{axis}")
    if axis not in ("x", "y") or low is None or high is None:
        return True
    v = getattr(f, "value", None)
    if isinstance(f, (ds.EqualTo, ds.EqualNullSafe)):
        return v is None or low <= v <= high
    if isinstance(f, ds.In):
        return any(x is None or low <= x <= high for x in v)
    if isinstance(f, ds.GreaterThan):
        return high > v
    if isinstance(f, ds.GreaterThanOrEqual):
        return high >= v
    if isinstance(f, ds.LessThan):
        return low < v
    if isinstance(f, ds.LessThanOrEqual):
        return low <= v
    return True


class DocumentReader(ds.DataSourceReader):
    def __init__(self, options: dict, schema):
        self.path = options["path"]
        names = [f.name for f in schema.fields]
        self.keep_bad = BAD_RECORD in names
        self.order = names
        self.schema = pa.schema([f for f in to_arrow_schema(schema) if f.name != BAD_RECORD])
        mode = options.get("mode", "permissive" if self.keep_bad else "dropmalformed").lower()
        if mode not in ("failfast", "permissive", "dropmalformed"):
            raise ValueError(f"unknown mode {mode!r}")
        self.strict = mode == "failfast"
        self.partition_bytes = int(options.get("partition_bytes", 64 << 20))
        self.bounds: list[ds.Filter] = []

    def pushFilters(self, filters: list[ds.Filter]):
        self.bounds = [] if self.keep_bad else list(filters)
        return filters  # files are skipped by them; rows are Spark's to test

    def partitions(self) -> list[storage.Files]:
        known = storage.facts(self.path)
        parts, whole = [], []
        for path, size in storage.list_files(self.path, SUFFIXES):
            name = path.rsplit("/", 1)[-1]
            if not all(_may_hold(f, known.get(name, {})) for f in self.bounds):
                continue
            if size > self.partition_bytes and not path.endswith(".gz"):
                parts += [storage.Files([(path, a, min(a + self.partition_bytes, size))]) for a in range(0, size, self.partition_bytes)]
            else:
                whole.append((path, size))
        return parts + [storage.Files([(p, 0, None) for p, _ in g.value]) for g in storage.plan(whole, self.partition_bytes)]

    def read(self, partition: storage.Files | None) -> Iterator[pa.RecordBatch]:
        system, _ = storage.file_system(self.path)
        for path, start, stop in partition.value if partition is not None else ():
            with system.open_input_file(path) as raw:
                lines = io.BufferedReader(raw, 1 << 16)
                source = gzip.GzipFile(fileobj=lines) if path.endswith(".gz") else lines
                for block in whole_lines(source, start, stop):
                    for batch in parse_block(block, self.schema, self.strict, self.keep_bad, path):
                        if batch.num_rows:
                            yield batch.select(self.order)


# --- writing ---------------------------------------------------------------------------

class DocumentWriter(ds.DataSourceArrowWriter):
    """A column ``_json`` holds whole documents (x and y beside it); without it every column is a field."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.packed = options.get("compression", "none").lower() == "gzip"
        self.file_bytes = int(options.get("file_bytes", 256 << 20))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> storage.Written:
        system, root = storage.file_system(self.path)
        system.create_dir(root, recursive=True)
        files, out, rows, rejected = [], None, 0, 0
        for batch in iterator:
            x, y = (pc.cast(batch.column(c), pa.float64()) for c in ("x", "y"))
            valid = pc.fill_null(pc.and_(pc.invert(pc.is_nan(x)), pc.invert(pc.is_nan(y))), False)
            good = batch.filter(valid)
            rejected += batch.num_rows - good.num_rows
            if not good.num_rows:
                continue
            if "_json" in good.schema.names:
                lines = good.column("_json").to_pylist()
            else:
                lines = [json.dumps(r, default=str) for r in good.to_pylist()]
            data = ("\n".join(lines) + "\n").encode()
            if out is None or files[-1][1] >= self.file_bytes:
                if out is not None:
                    out.close()
                name = storage.new_name(".jsonl.gz" if self.packed else ".jsonl")
                out = system.open_output_stream(f"{root.rstrip('/')}/{name}", compression="gzip" if self.packed else None)
                files.append([name, 0, {"rows": 0, "minx": math.inf, "maxx": -math.inf, "miny": math.inf, "maxy": -math.inf}])
            out.write(data)
            files[-1][1] += len(data)
            told = files[-1][2]
            told["rows"] += good.num_rows
            for axis in "xy":
                ends = pc.min_max(pc.cast(good.column(axis), pa.float64())).as_py()
                told[f"min{axis}"], told[f"max{axis}"] = min(told[f"min{axis}"], ends["min"]), max(told[f"max{axis}"], ends["max"])
            rows += good.num_rows
        if out is not None:
            out.close()
        return storage.Written([tuple(f) for f in files], rows, rejected)

    def commit(self, messages: list) -> None:
        storage.commit(self.path, messages, self.overwrite)

    def abort(self, messages: list) -> None:
        storage.abort(self.path, messages)


class DocumentSource(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "documents"

    def schema(self) -> str:
        return "x double, y double"

    def reader(self, schema) -> DocumentReader:
        return DocumentReader(dict(self.options), schema)

    def writer(self, schema, overwrite: bool) -> DocumentWriter:
        return DocumentWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    """Make the format ``documents`` known to the session, with predicates handed to Python data sources."""
    spark.dataSource.register(DocumentSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_documents(spark: SparkSession, path: str, schema: str = "x double, y double", id: str | None = None, where: Column | str | None = None,
                   **options) -> DataFrame:
    """S3: the collection as a point set, loaded for one query; ``where`` (on the stored fields) reaches the source."""
    register(spark)
    loaded = spark.read.format("documents").schema(schema).options(**options).load(path)
    return points(loaded if where is None else loaded.where(where), id=id)


def malformed(spark: SparkSession, path: str, schema: str = "x double, y double") -> DataFrame:
    """One row: ``n`` documents that fit the schema, ``n_bad`` that don't."""
    register(spark)
    loaded = spark.read.format("documents").schema(f"{schema}, {BAD_RECORD} string").load(path)
    return loaded.agg(F.count(F.when(F.col(BAD_RECORD).isNull(), 1)).alias("n"), F.count(BAD_RECORD).alias("n_bad"))


def write_documents(pts: DataFrame, path: str, partitions: int | None = None, mode: str = "append", **options) -> None:
    """Write points, with all their columns, as documents dealt over files by place, so that bounds on x and y skip files.

    Rows are range-partitioned on (Z-order key, row number): a place that holds a third of them is split.
    """
    spark = pts.sparkSession
    register(spark)
    valid = pts.where(valid_xy())
    e = valid.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    ends = [float(v) for v in (e if e[0] is not None else (0, 1, 0, 1))]
    out = valid.select(F.to_json(F.struct(*(F.col(f"`{c}`") for c in pts.columns)), {"ignoreNullFields": "false"}).alias("_json"), "x", "y")
    out = out.withColumns({"_gx": grid_coord("x", F.lit(ends[0]), F.lit(ends[1]), DEPTH), "_gy": grid_coord("y", F.lit(ends[2]), F.lit(ends[3]), DEPTH)})
    out = with_morton(out, "_gx", "_gy", "_z").withColumn("_tie", F.monotonically_increasing_id())
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    out = out.repartitionByRange(n, "_z", "_tie").select("_json", "x", "y")
    out.write.format("documents").options(**options).mode(mode).save(path)


# Data sources run in Python workers; they travel with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["DocumentSource", "register", "read_documents", "write_documents", "malformed"]
