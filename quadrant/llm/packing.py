"""Best-fit packing by a length histogram (operator 7).

Texts become ids and are cut into pieces of at most ``size`` ids.  The number of pieces of
each length, at most ``size`` numbers, is all that the planner sees: it packs
counts, longest first, each into the fullest sequences that still hold it, and writes down
slots for runs of ranks.  Every piece then takes its slot by its rank within its length.
Ranks come from distributed prefix sums, so no length is gathered anywhere.

Defined results: NULL or empty text is one piece with the end id alone; a document of n ids has
ceil(n / size) pieces; NULL doc_id and repeated rows are packed like others; an empty table gives
an empty result; other columns are not looked at.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import prefix_sums
from .tokens import default_path, slices, tokenizer

SIZE = 2048
END = 0


def token_pieces(docs: DataFrame, size: int = SIZE, end: int = END, path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 for every piece of every document."""
    path = path or default_path()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_ids = tokenizer(path)
        for whole in batches:
            for batch in slices(whole, "text"):
                ids, stops = to_ids.encode(batch.column("text"))
                row, piece, start, length, crc = [], [], [], [], []
                for i, (a, b) in enumerate(zip(stops[:-1].tolist(), stops[1:].tolist())):
                    own = np.append(ids[a:b], np.uint32(end)).astype("<u4")
                    for p, at in enumerate(range(0, len(own), size)):
                        part = own[at:at + size]
                        row.append(i), piece.append(p), start.append(at), length.append(len(part)), crc.append(zlib.crc32(part.tobytes()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(row)), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"])

    doc_id = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        cut, f"doc_id {doc_id}, piece int, start long, length long, ids_crc32 long")


def plan(counts: dict[int, int], size: int = SIZE) -> list[tuple[int, int, int, int, int, int]]:
    """Slots (length, first rank, ranks, first sequence, pieces a sequence, offset) for ``counts`` of lengths.

    Best-fit decreasing, run over counts.  Sequences with equal room are held as ranges of
    numbers, and a step fills a whole range, so the work depends on the number of
    lengths (at most ``size``), not of pieces.
    """
    room: dict[int, list[tuple[int, int]]] = {}  # room left -> ranges of sequences
    rooms: list[int] = []  # the keys of room, sorted
    slots, opened = [], 0

    def put(left: int, first: int, n: int) -> None:
        if left and n:
            if left not in room:
                room[left] = []
                insort(rooms, left)
            room[left].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, rest = 0, counts[length]
        while rest:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                left = rooms[at]
                first, n = room[left].pop()
                if not room[left]:
                    del room[left]
                    del rooms[at]
            else:
                left, first = size, opened
                n = -(-rest // (size // length))
                opened += n
            each = left // length
            full = min(n, rest // each)
            if full:
                slots.append((length, rank, full * each, first, each, size - left))
                put(left - each * length, first, full)
                rank, rest = rank + full * each, rest - full * each
            if rest and full < n:  # the last sequence of this length takes fewer
                slots.append((length, rank, rest, first + full, rest, size - left))
                put(left - rest * length, first + full, 1)
                full, rank, rest = full + 1, rank + rest, 0
            put(left, first + full, n - full)
    return slots


def pack(docs: DataFrame, size: int = SIZE, end: int = END, path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    pieces = materialize(token_pieces(docs, size, end, path).withColumn("one", F.lit(1).cast("long")), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `size` rows
    slots = spark.createDataFrame(
        plan(counts, size) or [], "s_length long, s_first long, s_ranks long, s_sequence long, s_each long, s_offset long")
    ranked = prefix_sums(pieces, ["length"], [F.col("doc_id").asc_nulls_last(), F.col("piece"), F.col("ids_crc32")], {"rank": "one"})
    # Broadcast: the plan's size is bounded by the number of lengths, whatever the number of pieces.
    met = ranked.join(F.broadcast(slots), (F.col("length") == F.col("s_length")) & (F.col("rank") >= F.col("s_first"))
                      & (F.col("rank") < F.col("s_first") + F.col("s_ranks")), "inner")
    place = F.col("rank") - F.col("s_first")
    return met.select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("s_sequence") + F.floor(place / F.col("s_each"))).cast("long").alias("sequence_id"),
        (F.col("s_offset") + (place % F.col("s_each")) * F.col("length")).cast("long").alias("offset"))
