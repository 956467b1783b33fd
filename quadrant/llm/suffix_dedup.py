"""Removal of long repeated passages by a run-length BWT index (operator 10).

A byte goes if a string of ``LENGTH`` bytes that covers it also starts anywhere else in the corpus.

1. Every window of LENGTH bytes belongs to the smallest of its k-grams (by hash, leftmost first), so equal
   windows belong to equal k-grams wherever they stand.  Consecutive windows that belong to one
   place form a span; a document is a chain of spans.
2. Ranges of k-grams learn from all blocks of documents which spans occur more than once as a whole (all
   their windows are repeated), and which only share their k-gram with others.  A very common
   passage costs one entry a block.
3. The latter, and one copy of each whole span that shares their k-gram, are gathered by k-gram in
   bounded groups.  Each group gets a run-length compressed Burrows-Wheeler transform with
   suffix positions sampled at the ends of runs.  Matches are compared only there; streaming the text through
   the samples gives the longest match of every position with any other, since inside
   a run a match is one shorter than that of the position before.  Matches of LENGTH or more are marked.
4. A k-gram with very many different spans is not gathered: its windows are counted by hash over all tasks.

Defined results: NULL or empty text has no bytes and keeps nothing (the digest of no bytes); texts shorter than
LENGTH stay whole; all copies of a repeated passage go, the first included; repeated rows are documents of
their own; NULL doc_id stays NULL; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import partitions, release, squeeze, unsqueeze
from .ngram_join import BLOB, mix
from .tokens import slices

LENGTH = 200
GRAM = 32
#: Bytes of text in a block, and of spans in a group: they bound what a task holds at once.
BLOCK_BYTES = 3 << 20
GROUP_BYTES = 1 << 20
#: A k-gram with more different spans than this is counted by window.
MOST_SPANS = 4096
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def powers(x: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, x, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def gram_hashes(text: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from every position on."""
    n = len(text) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    text = np.ascontiguousarray(text)
    words = np.ndarray((len(text) - 7,), "<u8", text, strides=(1,))
    h = words[:n] * FACTOR
    for k in range(8, GRAM, 8):
        h = mix(h, k // 8) + words[k:k + n]
    return mix(h)


def window_owners(hashes: np.ndarray, windows: int, wide: int) -> np.ndarray:
    """For each window the position of the smallest of its ``wide`` hashes, the leftmost of equal ones."""
    bits = np.uint64(max(1, int(len(hashes)).bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    marked = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
    rows = -(-len(hashes) // wide)
    padded = np.full(rows * wide, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:len(hashes)] = marked
    padded = padded.reshape(rows, wide)
    forward = np.minimum.accumulate(padded, axis=1).reshape(-1)
    backward = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return (np.minimum(backward[:windows], forward[wide - 1:wide - 1 + windows]) & low).astype(np.int64)


def spans(text: np.ndarray, ends: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """start, windows, k-gram hash and digest of every span; ``ends`` are the texts' ends in ``text``."""
    none = np.zeros(0, np.int64)
    windows = len(text) - length + 1
    if windows <= 0:
        return none, none, none.astype(np.uint64), none.astype(np.uint64)
    begins = np.concatenate([[0], ends[:-1]])
    valid = np.zeros(len(text) + 1, np.int8)
    has = ends - begins >= length
    np.add.at(valid, begins[has], 1)
    np.add.at(valid, ends[has] - length + 1, -1)
    valid = np.cumsum(valid[:windows], dtype=np.int8) > 0
    hashes = gram_hashes(text)
    owner = window_owners(hashes, windows, length - GRAM + 1)
    owner[~valid] = -1
    new = np.ones(windows, bool)
    new[1:] = owner[1:] != owner[:-1]
    at = np.flatnonzero(new)
    count = np.diff(at, append=windows)
    real = owner[at] >= 0
    start, count, owner = at[real], count[real], owner[at][real]
    total = np.zeros(len(text) + 1, np.uint64)
    np.cumsum((text.astype(np.uint64) + np.uint64(1)) * powers(FACTOR, len(text)), out=total[1:])
    back = powers(np.uint64(pow(int(FACTOR), -1, 1 << 64)), len(text))
    digest = mix((total[start + count + length - 1] - total[start]) * back[start] + mix(count.astype(np.uint64)))
    return start, count, hashes[owner], digest


def _blocks(batches: Iterator[pa.RecordBatch], ranges: int) -> Iterator[pa.RecordBatch]:
    """For every block of documents: its distinct spans, range by range, and a row with the documents."""
    import zstandard
    number = TaskContext.get().partitionId() << 32
    for whole in batches:
        for batch in slices(whole, "text", BLOCK_BYTES):
            texts = pc.fill_null(batch.column("text"), b"")
            size = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
            raw = b"".join(texts.to_pylist())
            start, count, key, digest = spans(np.frombuffer(raw, np.uint8), np.cumsum(size))
            order = np.lexsort((digest, key))
            k, d = key[order], digest[order]
            new = np.ones(len(k), bool)
            new[1:] = (k[1:] != k[:-1]) | (d[1:] != d[:-1])
            first = np.flatnonzero(new)
            k, d, times = k[first], d[first], np.diff(first, append=len(order)).astype(np.uint32)
            edge = np.searchsorted(((k >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32), np.arange(ranges + 1))
            rows = []
            for r in np.flatnonzero(np.diff(edge)).tolist():
                a, b = edge[r], edge[r + 1]
                rows.append((r, squeeze(np.diff(k[a:b], prepend=np.uint64(0))), squeeze(d[a:b]), squeeze(times[a:b]), b""))
            doc_id = batch.column("doc_id")
            ids = pc.fill_null(doc_id, 0).to_numpy(zero_copy_only=False).astype(np.int64)
            null = doc_id.is_null().to_numpy(zero_copy_only=False).astype(np.int64)
            rows.append((-1 - number, squeeze(np.concatenate([ids, null, size])), squeeze(start[order].astype(np.uint32)),
                         squeeze(np.concatenate([times, count[order].astype(np.uint32)])), zstandard.ZstdCompressor(level=3).compress(raw)))
            key_, a, b, c, d = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(key_, pa.int64()), pa.array([number] * len(rows), pa.int64()), *(pa.array(x, pa.binary()) for x in (a, b, c, d))],
                                             names=["key", "block", "a", "b", "c", "d"])
            number += 1


WHOLE, SHIP = 1, 2


def _sightings(key: tuple, table: pa.Table) -> pa.Table:
    """For one range of k-grams: which spans occur twice as a whole (WHOLE), and which to gather (SHIP)."""
    if key[0].as_py() < 0:
        return table
    table = table.sort_by("block")
    held = [[unsqueeze(table.column(c)[i].as_py()) for c in "abc"] for i in range(table.num_rows)]
    k = np.concatenate([np.cumsum(a, dtype=np.uint64) for a, _, _ in held])
    d, times = np.concatenate([b for _, b, _ in held]), np.concatenate([c for _, _, c in held]).astype(np.int64)
    order = np.lexsort((d, k))  # stable: the first block's copy of a span comes first
    ks, ds, ts = k[order], d[order], times[order]
    new_k = np.ones(len(ks), bool)
    new_k[1:] = ks[1:] != ks[:-1]
    new_d = new_k.copy()
    new_d[1:] |= ds[1:] != ds[:-1]
    in_all = np.add.reduceat(ts, np.flatnonzero(new_d))[np.cumsum(new_d) - 1]
    whole = in_all >= 2
    single_any = np.logical_or.reduceat(~whole, np.flatnonzero(new_k))[np.cumsum(new_k) - 1]
    total = np.add.reduceat(ts, np.flatnonzero(new_k))[np.cumsum(new_k) - 1]
    code = np.empty(len(k), np.uint8)
    code[order] = WHOLE * whole + SHIP * (new_d & single_any & (total >= 2))
    cut = np.cumsum([len(a) for a, _, _ in held])[:-1]
    codes = [squeeze(x) for x in np.split(code, cut)]
    empty = pa.array([b""] * len(codes), pa.binary())
    return pa.Table.from_arrays([table.column("key"), table.column("block"), pa.array(codes, pa.binary()), empty, empty, empty], names=["key", "block", "a", "b", "c", "d"])


STEP = ("kind byte, block long, doc int, doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, "
        "text binary, runs binary, pending binary, entry int, gram long, wanted boolean")
DONE, OPEN, SPAN = 0, 1, 2


def _table(rows: list[tuple]) -> pa.Table:
    kinds = [pa.int8(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.int64(), pa.bool_()]
    names = [c.split()[0] for c in STEP.split(", ")]
    cols = list(zip(*rows)) if rows else [()] * len(names)
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=names)


def finished(text: np.ndarray, gone: np.ndarray) -> tuple[int, int, str]:
    """n_removed, n_spans and the digest of what stays."""
    runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
    return int(gone.sum()), runs, hashlib.sha256(text[~gone].tobytes()).hexdigest()


def _decide(table: pa.Table) -> pa.Table:
    """For one block: finished documents, documents with open spans, and the spans to gather."""
    import zstandard
    table = table.sort_by("key")
    a, b, c, d = (unsqueeze(table.column(x)[0].as_py()) if x != "d" else table.column("d")[0].as_py() for x in "abcd")
    block = table.column("block")[0].as_py()
    a = a.view(np.int64).reshape(3, -1)
    ids, null, size = a
    text = np.frombuffer(zstandard.ZstdDecompressor().decompress(d), np.uint8)
    start = b.astype(np.int64)
    entries = len(c) - len(start)
    times, count = c[:entries].astype(np.int64), c[entries:].astype(np.int64)
    code = np.concatenate([np.zeros(0, np.uint8), *(unsqueeze(table.column("a")[i].as_py()) for i in range(1, table.num_rows))])
    entry = np.repeat(np.arange(entries), times)
    end = np.cumsum(size)
    begin = end - size
    cover = np.zeros(len(text) + 1, np.int32)
    sure = (code[entry] & WHOLE) > 0
    np.add.at(cover, start[sure], 1)
    np.add.at(cover, start[sure] + count[sure] + LENGTH - 1, -1)
    gone = np.cumsum(cover[:-1]) > 0
    open_ = np.flatnonzero(code[entry] == SHIP)
    of = np.searchsorted(end, start[open_], side="right")
    pending: dict[int, list] = {}
    for doc, i in zip(of.tolist(), open_.tolist()):
        pending.setdefault(doc, []).append((int(entry[i]), int(start[i] - begin[doc])))
    rows = []
    for doc in range(len(size)):
        own, mark = text[begin[doc]:end[doc]], gone[begin[doc]:end[doc]]
        doc_id = None if null[doc] else int(ids[doc])
        if doc in pending:
            rows.append((OPEN, block, doc, doc_id, len(own), None, None, None, own.tobytes(), squeeze(np.packbits(mark)), np.array(pending[doc], np.uint32).tobytes(), None, None, None))
        else:
            rows.append((DONE, block, doc, doc_id, len(own), *finished(own, mark), None, None, None, None, None, None))
    first = np.cumsum(times) - times
    for e in np.flatnonzero(code & SHIP).tolist():
        s = start[first[e]]
        part = text[s:s + count[first[e]] + LENGTH - 1]
        rows.append((SPAN, block, None, None, None, None, None, None, part.tobytes(), None, None, e, None, bool(code[e] == SHIP)))
    return _table(rows)


class RunLengthIndex:
    """A run-length compressed BWT of several texts, with the suffix positions at both ends of each run."""

    def __init__(self, texts: list[bytes]):
        size = np.array([len(t) + 1 for t in texts])
        self.stops = np.cumsum(size)
        symbols = np.zeros(int(self.stops[-1]) + 8, np.int64)  # 0 ends a text, bytes are 1 to 256
        joined = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
        n = len(joined)
        symbols[:n] = joined
        symbols[:n] += 1
        symbols[self.stops - 1] = 0
        self.symbols, self.n = symbols, n
        rank = np.zeros(n, np.int64)
        for k in range(7):
            rank = (rank << 9) | symbols[k:k + n]
        sa, rank, known = *self._ranked(rank), 7
        while rank[sa[-1]] < n - 1:
            after = np.zeros(n, np.int64)
            after[:max(0, n - known)] = rank[known:] + 1
            sa, rank = self._ranked(rank * (n + 1) + after)
            known *= 2
        before = symbols[sa - 1]
        before[sa == 0] = 0
        change = np.ones(n + 1, bool)
        change[1:-1] = (before[1:] != before[:-1]) | (before[1:] == 0)
        self.head = np.flatnonzero(change[:-1])  # where runs begin
        tail = np.flatnonzero(change[1:])  # and end
        self.run_symbols = before[self.head]
        self.samples_head, self.samples_tail = sa[self.head], sa[tail]
        # The neighbours beyond the ends of runs, the only places where matches are compared
        self.above = np.where(self.head > 0, sa[self.head - 1], -1)
        self.below = np.where(tail < n - 1, sa[np.minimum(tail + 1, n - 1)], -1)

    @staticmethod
    def _ranked(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sa = np.argsort(key, kind="stable")
        s = key[sa]
        new = np.zeros(len(s), np.int64)
        new[1:] = s[1:] != s[:-1]
        rank = np.empty(len(s), np.int64)
        rank[sa] = np.cumsum(new)
        return sa, rank

    def _matches(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """How far the texts at p and q agree; an end of text agrees with nothing."""
        out = np.zeros(len(p), np.int64)
        alive = np.flatnonzero(q >= 0)
        k = 0
        while len(alive):
            x = np.minimum(p[alive] + k, self.n - 1)
            y = np.minimum(q[alive] + k, self.n - 1)
            same = (self.symbols[x] == self.symbols[y]) & (self.symbols[x] > 0)
            alive = alive[same]
            out[alive] += 1
            k += 1
        return out

    def statistics(self) -> np.ndarray:
        """For every position the length of its longest match with any other, streamed in text order."""
        best = np.zeros(self.n, np.int64)
        place = np.arange(self.n)
        for p, q in ((self.samples_head, self.above), (self.samples_tail, self.below)):
            reach = np.zeros(self.n, np.int64)
            reach[p] = p + self._matches(p, q)
            np.maximum(best, np.maximum.accumulate(reach) - place, out=best)
        return best


def _gather(table: pa.Table) -> pa.Table:
    """For one group of k-grams: which windows of the wanted spans stand elsewhere, as packed bits."""
    texts = table.column("text").to_pylist()
    index = RunLengthIndex(texts)
    long = index.statistics() >= LENGTH
    rows, at = [], 0
    for i, (text, wanted) in enumerate(zip(texts, table.column("wanted").to_pylist())):
        if wanted:
            rows.append((table.column("block")[i].as_py(), table.column("entry")[i].as_py(), np.packbits(long[at:at + len(text) - LENGTH + 1]).tobytes()))
        at += len(text) + 1
    cols = list(zip(*rows)) if rows else [(), (), ()]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.binary()))], names=["block", "entry", "hits"])


def _count_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for every window of a span: two hashes and where it stands."""
    for batch in batches:
        for i in range(batch.num_rows):
            text = np.frombuffer(batch.column("text")[i].as_py(), np.uint8)
            m = len(text) - LENGTH + 1
            h = []
            for base in (FACTOR, np.uint64(0xD6E8FEB86659FD93)):
                total = np.zeros(len(text) + 1, np.uint64)
                np.cumsum((text.astype(np.uint64) + np.uint64(1)) * powers(base, len(text)), out=total[1:])
                h.append(mix((total[LENGTH:] - total[:m]) * powers(np.uint64(pow(int(base), -1, 1 << 64)), len(text))[:m]).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(h[0]), pa.array(h[1]), pa.array(np.full(m, batch.column("block")[i].as_py(), np.int64)),
                                              pa.array(np.full(m, batch.column("entry")[i].as_py(), np.int32)), pa.array(np.arange(m, dtype=np.int32)),
                                              pa.array(np.full(m, batch.column("wanted")[i].as_py()))], names=["h1", "h2", "block", "entry", "at", "wanted"])


def _pack_hits(table: pa.Table) -> pa.Table:
    entry, at = table.column("entry").to_numpy(), table.column("at").to_numpy()
    block = table.column("block")[0].as_py()
    rows = []
    for e in np.unique(entry).tolist():
        bits = np.zeros(LENGTH, bool)
        bits[at[entry == e]] = True
        rows.append((e, np.packbits(bits).tobytes()))
    return pa.Table.from_arrays([pa.array([block] * len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["block", "entry", "hits"])


def _finish(table: pa.Table) -> pa.Table:
    """Open documents of a block with what their spans have found."""
    hits, docs = {}, []
    for row in table.to_pylist():
        if row["hits"] is not None:
            hits[row["entry"]] = np.unpackbits(np.frombuffer(row["hits"], np.uint8))
        else:
            docs.append(row)
    out = []
    for row in docs:
        text = np.frombuffer(row["text"], np.uint8)
        cover = np.zeros(len(text) + 1, np.int32)
        for entry, start in np.frombuffer(row["pending"], np.uint32).reshape(-1, 2).tolist():
            at = start + np.flatnonzero(hits.get(entry, np.zeros(0, np.uint8)))
            np.add.at(cover, at, 1)
            np.add.at(cover, at + LENGTH, -1)
        gone = (np.cumsum(cover[:-1]) > 0) | np.unpackbits(unsqueeze(row["runs"]))[:len(text)].astype(bool)
        out.append((row["doc_id"], row["n_bytes"], *finished(text, gone)))
    cols = list(zip(*out)) if out else [()] * 5
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()))],
                                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of ``docs``."""
    spark = docs.sparkSession
    ranges = 2 * partitions(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(lambda it: _blocks(it, ranges), BLOB)
    seen = rows.groupBy("key").applyInArrow(_sightings, BLOB)
    step = materialize(seen.groupBy("block").applyInArrow(_decide, STEP), "repeats")
    release(spark)
    # The k-gram is not sent along: the smallest hash is found again in the span itself.
    gathered = step.filter(F.col("kind") == SPAN).select("block", "entry", "wanted", "text").mapInArrow(_with_gram, "block long, entry int, wanted boolean, text binary, gram long")
    gathered = materialize(gathered, "spans")
    sizes = gathered.groupBy("gram").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("bytes"))
    total = sizes.agg(F.sum("bytes")).first()[0] or 0
    crowded = materialize(sizes.filter(F.col("n") > MOST_SPANS).select("gram"), "crowded")
    groups = max(1, -(-total // GROUP_BYTES))
    hit = "block long, entry int, hits binary"
    few = gathered.join(crowded, "gram", "left_anti").withColumn("group", F.pmod(F.xxhash64("gram"), F.lit(groups)))
    found = few.select("group", "block", "entry", "wanted", "text").groupBy("group").applyInArrow(_gather, hit)
    windows = gathered.join(crowded, "gram", "left_semi").select("block", "entry", "wanted", "text").mapInArrow(
        _count_windows, "h1 long, h2 long, block long, entry int, at int, wanted boolean")
    twice = windows.groupBy("h1", "h2").agg(F.count("*").alias("n")).filter("n > 1").select("h1", "h2")
    many = windows.filter("wanted").join(twice, ["h1", "h2"], "left_semi").select("block", "entry", "at").groupBy("block").applyInArrow(_pack_hits, hit)
    found = materialize(found.unionByName(many), "found")
    nothing = F.lit(None)
    open_ = step.filter(F.col("kind") == OPEN).select("block", "doc_id", "n_bytes", "text", "runs", "pending", nothing.cast("int").alias("entry"), nothing.cast("binary").alias("hits"))
    both = open_.unionByName(found, allowMissingColumns=True)
    done = step.filter(F.col("kind") == DONE).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    return done.unionByName(both.groupBy("block").applyInArrow(_finish, RESULT))


def _with_gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        gram = []
        for t in batch.column("text"):
            h = gram_hashes(np.frombuffer(t.as_py(), np.uint8))
            # The k-gram that every window of the span holds: the smallest of the first window's.
            gram.append(h[window_owners(h, 1, LENGTH - GRAM + 1)[0]])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.array(gram, np.uint64).view(np.int64))], names=["block", "entry", "wanted", "text", "gram"])
