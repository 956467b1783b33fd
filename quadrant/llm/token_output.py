"""Token files (operator 8): frequency-ranked ids, byte-aligned, with separate control bytes.

Ids are replaced by their rank among all ids by frequency (ties by id), so common ids are small
numbers.  A number takes one to four whole bytes; two bits in a control byte say how many, four
numbers a control byte, and control and data bytes lie apart.  Decoding looks
the four lengths of each control byte up in a table of 256 rows and gathers the bytes with numpy.

A file set is a Parquet table of blocks in ascending doc_id order (shard, block, doc_ids,
counts, control, data) and, next to it, the table of ranks; Spark's writer commits
both, so a lost executor leaves no partial file behind.

Defined results: NULL or empty text has the end id alone; NULL doc_id comes last; repeated rows
follow each other; an empty table gives an empty file set; other columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialize, scratch_path
from .common import partitions, release, squeeze, unsqueeze
from .tokens import default_path, slices, tokenizer

END = 1


def encode_numbers(numbers: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit numbers."""
    numbers = np.ascontiguousarray(numbers, "<u4")
    code = (numbers > 0xFF).astype(np.uint8) + (numbers > 0xFFFF) + (numbers > 0xFFFFFF)
    quads = np.zeros(-(-len(code) // 4) * 4, np.uint8)
    quads[:len(code)] = code
    control = (quads.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    kept = np.arange(4, dtype=np.uint8) <= code[:, None]
    return control.tobytes(), numbers.view(np.uint8).reshape(-1, 4)[kept].tobytes()


#: The four byte lengths of each control byte.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1


def decode_numbers(control: bytes, data: bytes, n: int) -> np.ndarray:
    length = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    first = np.cumsum(length) - length
    held = np.frombuffer(data, np.uint8)
    out = held[first].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(length > k)
        out[more] |= held[first[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def id_blocks(docs: DataFrame, end: int = END, path: str | None = None) -> DataFrame:
    """A written table of blocks of ids in ascending doc_id order: texts are read, moved and encoded once."""
    spark, path = docs.sparkSession, path or default_path()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_ids, shard, block = tokenizer(path), TaskContext.get().partitionId(), 0
        for whole in batches:
            for batch in slices(whole, "text"):
                ids, stops = to_ids.encode(batch.column("text"))
                counts = np.diff(stops) + 1
                numbers = np.insert(ids, stops[1:], end)  # the end id after each document's own
                doc_ids = batch.column("doc_id")
                yield pa.RecordBatch.from_arrays([
                    pa.array([shard], pa.int32()), pa.array([block], pa.int64()), pa.array([len(numbers)], pa.int64()),
                    pa.ListArray.from_arrays(pa.array([0, len(doc_ids)], pa.int32()), doc_ids),
                    pa.ListArray.from_arrays(pa.array([0, len(counts)], pa.int32()), pa.array(counts, pa.int64())), pa.array([squeeze(numbers)], pa.binary()),
                ], names=["shard", "block", "n_ids", "doc_ids", "counts", "ids"])
                block += 1

    doc_id = docs.schema["doc_id"].dataType.simpleString()
    # The row number parts the rows of one id, or of none, over tasks; rows of one id stand in the order they are read.
    key = [F.col("doc_id").asc_nulls_last(), F.col("tie")]
    ordered = (docs.select("doc_id", F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("tie"))
               .repartitionByRange(partitions(spark), *key).sortWithinPartitions(*key).select("doc_id", "text"))
    blocks = materialize(ordered.mapInArrow(encode, f"shard int, block long, n_ids long, doc_ids array<{doc_id}>, counts array<long>, ids binary"), "id-blocks")
    release(spark)
    return blocks


def id_frequencies(blocks: DataFrame) -> DataFrame:
    """id, n over all blocks: at most one row per id of the vocabulary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for ids in batch.column("ids"):
                found = np.bincount(unsqueeze(ids.as_py()), minlength=len(total))
                found[:len(total)] += total
                total = found
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["id", "n"])

    return blocks.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_token_files(docs: DataFrame, to: str, end: int = END, path: str | None = None) -> None:
    """Write the file set ``to``/blocks and ``to``/ranks."""
    spark = docs.sparkSession
    blocks = id_blocks(docs, end, path)
    found = id_frequencies(blocks).collect()  # bounded by the vocabulary, not by the documents
    by_rank = np.array([r["id"] for r in sorted(found, key=lambda r: (-r["n"], r["id"]))], np.int64)
    spark.createDataFrame([(i, int(x)) for i, x in enumerate(by_rank)], "rank long, id long").coalesce(1).write.parquet(f"{to}/ranks")
    rank_of = np.zeros(int(by_rank.max(initial=0)) + 1, np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank))
    ranks = spark.sparkContext.broadcast(rank_of)

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = [encode_numbers(ranks.value[unsqueeze(ids.as_py())]) for ids in batch.column("ids")]
            control, data = zip(*coded) if coded else ((), ())
            names = ["shard", "block", "n_ids", "doc_ids", "counts"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(control, pa.binary()), pa.array(data, pa.binary())], names=[*names, "control", "data"])

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in blocks.schema if f.name != "ids")
    blocks.mapInArrow(rank, f"{kept}, control binary, data binary").write.parquet(f"{to}/blocks")


def read_token_files(spark: SparkSession, of: str, ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, if wanted, the ids, decoded from a file set."""
    blocks = spark.read.parquet(f"{of}/blocks")
    by_rank = np.array([r["id"] for r in sorted(spark.read.parquet(f"{of}/ranks").collect())], np.uint32)  # bounded by the vocabulary
    table = spark.sparkContext.broadcast(by_rank)
    doc_id = blocks.schema["doc_ids"].dataType.elementType.simpleString()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_rank = table.value
        for whole in batches:
            for i in range(whole.num_rows):
                shard, block, n, counts, control, data = (whole.column(c)[i].as_py() for c in ("shard", "block", "n_ids", "counts", "control", "data"))
                doc_ids = whole.column("doc_ids")[i].values
                numbers = by_rank[decode_numbers(control, data, n)].astype("<u4")
                stop = np.cumsum(counts)
                begin = stop - counts
                crc = [zlib.crc32(numbers[a:b].tobytes()) for a, b in zip(begin.tolist(), stop.tolist())]
                out = [pa.array([shard] * len(counts), pa.int32()), pa.array([block] * len(counts), pa.int64()), doc_ids,
                       pa.array(begin, pa.int64()), pa.array(counts, pa.int64()), pa.array(crc, pa.int64())]
                names = ["shard", "block", "doc_id", "within", "n_tokens", "ids_crc32"]
                if ids:
                    out.append(pa.ListArray.from_arrays(pa.array([0, *stop.tolist()], pa.int32()), pa.array(numbers.astype(np.int64))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names=names)

    schema = f"shard int, block long, doc_id {doc_id}, within long, n_tokens long, ids_crc32 long" + ", ids array<long>" * ids
    decoded = blocks.select("shard", "block", "n_ids", "doc_ids", "counts", "control", "data").mapInArrow(decode, schema)
    # One row a shard in line, then one a block within its shard.
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).withColumn(
        "shard_start", F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)))
    inside = F.sum("n_ids").over(Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    starts = blocks.select(F.col("shard").alias("_shard"), F.col("block").alias("_block"), F.coalesce(inside, F.lit(0)).alias("inside")).join(
        shards.select("shard", F.coalesce("shard_start", F.lit(0)).alias("shard_start")), F.col("_shard") == F.col("shard")).drop("shard")
    met = decoded.join(starts, (F.col("shard") == F.col("_shard")) & (F.col("block") == F.col("_block")))
    return met.select("doc_id", (F.col("shard_start") + F.col("inside") + F.col("within")).cast("long").alias("start"), "n_tokens", "ids_crc32", *["ids"] * ids)


def token_files(docs: DataFrame, to: str | None = None) -> DataFrame:
    """Write ``docs`` as a file set (under the shared scratch folder if no place is given) and read it back, without the ids."""
    to = to or scratch_path(docs.sparkSession, "token-files")
    write_token_files(docs, to)
    return read_token_files(docs.sparkSession, to, ids=False)
