"""Exact n-gram Jaccard join by several global token orders (operator 9).

A document's set holds its distinct five-word shingles.  Two sets with a Jaccard similarity
of at least t share a shingle among their first |x| - ceil(t|x|) + 1 shingles under *any* order of all
shingles.  Here several such orders are used, each by document frequency first (rare
ones before common ones) and by a different permutation of the hashes within one
frequency; candidates must share a prefix shingle under every order, and only what
the intersection leaves is verified.  Leader pairs (step 4) are the exception: one order is enough for them.

How it runs:

1. Tasks turn blocks of documents into sorted shingle hashes; every range of hashes gets the distinct
   shingles of each block with their counts, so a very common shingle costs one entry a block.  The range
   tells the block which of its shingles other documents have.
2. A document with more than 1 - t of its shingles to itself has no partner.  For the others, the
   shared shingles are all that a verification needs, as an intersection holds no others.
3. Documents with equal sets become one class.
4. Links.  Classes that have the same first shingle under one of sixteen more orders first link to a few leaders
   that such a list draws, verified pair by pair, so large groups of near copies need a linear number of pairs.  Then
   all pairs of classes in different components that share prefix shingles under every order are
   verified.  Pairs inside one component can't change the components, so only lists that hold several are kept.

Defined results: NULL or empty text, or text of white space alone, has an empty set and links with nothing;
a text of one to four words has one shingle, the whole sequence; repeated rows are equal documents; a row
without doc_id takes part, but never names a component unless it is alone; an empty table gives an empty result;
other columns are not looked at.  Shingles are compared by 64-bit hashes in counting and 48 bits in intersections.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import apart, give_back, partitions, release, squeeze, unsqueeze
from .tokens import slices

N_WORDS = 5
PERCENT = 75
ORDERS = 2
#: Orders under which a class's first shingle finds leaders, and of them those that a class and a leader should agree in.
FIRSTS, AGREE = 16, 10
#: By round: leaders that a list draws, and leaders that a class tries; later rounds go on as the last.
DRAWS, LEADERS = (1, 3, 3), (1, 8, 4)
#: Bytes of text in a block: bounds what a task holds at once.
BLOCK_BYTES = 4 << 20
#: Bytes of text for each range of hashes: bounds a range's group, whatever the number of shuffle partitions.
RANGE_BYTES = 32 << 20
#: A shingle that more documents of one block have leaves their numbers with the block.
COMMON = 4
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xC2B2AE3D27D4EB4F))
#: ``key`` is a range of hashes, or -1 - block for the one row about the documents of a block: no two blocks share a group.
BLOB = "key long, block long, a binary, b binary, c binary, d binary"


def mix(x: np.ndarray, k: int = 0) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * MIX[k % 3]
    return x ^ (x >> np.uint64(29))


def shingles(texts: pa.Array, n_words: int = N_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every shingle, text by text; a shingle may come twice."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    of = np.repeat(np.arange(len(split), dtype=np.int64), split.value_lengths().to_numpy(zero_copy_only=False))
    flat = split.flatten()
    real = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    coded = flat.dictionary_encode()
    by_word = pd.util.hash_array(coded.dictionary.to_numpy(zero_copy_only=False), categorize=False) if len(coded.dictionary) else np.zeros(0, np.uint64)
    words = by_word[coded.indices.to_numpy(zero_copy_only=False)][real]
    of = of[real]
    m = max(0, len(words) - n_words + 1)
    h = words[:m].copy()
    for k in range(1, n_words):
        h = mix(h, k) + words[k:k + m]
    h = mix(h)
    whole = of[:m] == of[n_words - 1:n_words - 1 + m]
    h, at = h[whole], of[:m][whole]
    count = np.bincount(of, minlength=len(split))
    short = np.flatnonzero((count > 0) & (count < n_words))
    if len(short):
        first = np.searchsorted(of, short)
        more = []
        for a, n in zip(first.tolist(), count[short].tolist()):
            x = np.array([n], np.uint64)
            for k in range(n):
                x = mix(x, k) + words[a + k:a + k + 1]
            more.append(mix(x, 1)[0])
        h, at = np.concatenate([h, np.array(more, np.uint64)]), np.concatenate([at, short])
        order = np.argsort(at, kind="stable")
        h, at = h[order], at[order]
    return h, at


def distinct_in_order(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Positions of the distinct (hash, text) pairs, sorted by hash, then text."""
    order = np.argsort(h)
    s = h[order]
    same = np.zeros(len(s) + 1, bool)
    same[1:-1] = s[1:] == s[:-1]
    tied = np.flatnonzero(same[:-1] | same[1:])
    if len(tied):
        part = order[tied]
        order[tied] = part[np.lexsort((at[part], h[part]))]
    s, t = h[order], at[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (t[1:] != t[:-1])
    return order[new]


def _blocks(batches: Iterator[pa.RecordBatch], ranges: int) -> Iterator[pa.RecordBatch]:
    """For every block of documents: its shingles, range by range, and a row about the documents."""
    number = TaskContext.get().partitionId() << 32
    for whole in batches:
        for batch in slices(whole, "text", BLOCK_BYTES):
            docs = batch.num_rows
            h, at = shingles(batch.column("text"))
            first = distinct_in_order(h, at)
            kept = np.zeros(len(h), bool)
            kept[first] = True
            own, text = h[kept], at[kept]
            n = np.bincount(text, minlength=docs).astype(np.int64)
            starts = (np.cumsum(n) - n)[n > 0]
            digests = np.zeros((2, docs), np.uint64)
            if len(starts):
                for k in (0, 1):
                    digests[k, n > 0] = np.add.reduceat(mix(own, k + 1), starts)
            token, owner = h[first] >> np.uint64(16), at[first].astype(np.uint32)
            new = np.ones(len(token), bool)
            new[1:] = token[1:] != token[:-1]
            begin = np.flatnonzero(new)
            token = token[begin]
            count = np.diff(begin, append=len(owner)).astype(np.uint32)
            rare = np.repeat(count <= COMMON, count)
            upto = np.concatenate([[0], np.cumsum(np.where(count <= COMMON, count, 0), dtype=np.int64)])
            rare_owner = owner[rare]
            edge = np.searchsorted(((token >> np.uint64(16)) * np.uint64(ranges)) >> np.uint64(32), np.arange(ranges + 1))
            rows = []
            for r in np.flatnonzero(np.diff(edge)).tolist():
                a, b = edge[r], edge[r + 1]
                rows.append((r, squeeze(np.diff(token[a:b], prepend=np.uint64(0))), squeeze(count[a:b]), squeeze(rare_owner[upto[a]:upto[b]]), b""))
            doc_id = batch.column("doc_id")
            ids = pc.fill_null(doc_id, 0).to_numpy(zero_copy_only=False).astype(np.int64)
            null = doc_id.is_null().to_numpy(zero_copy_only=False).astype(np.uint64)
            ids = np.concatenate([ids, batch.column("row").to_numpy(zero_copy_only=False)])
            rows.append((-1 - number, squeeze(ids), squeeze(n), squeeze(owner[~rare]), squeeze(np.concatenate([digests.reshape(-1), null]))))
            key, a, b, c, d = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array([number] * len(rows), pa.int64()), *(pa.array(x, pa.binary()) for x in (a, b, c, d))],
                                             names=["key", "block", "a", "b", "c", "d"])
            number += 1
            give_back()


def _frequencies(key: tuple, table: pa.Table) -> pa.Table:
    """For one range of hashes: back to each block, which of its shingles two or more documents have."""
    if key[0].as_py() < 0:
        return table
    give_back()  # of the group before
    blocks = [tuple(unsqueeze(table.column(c)[i].as_py()) for c in "abc") for i in range(table.num_rows)]
    tokens = [np.cumsum(a, dtype=np.uint64) for a, _, _ in blocks]
    token, count = np.concatenate(tokens), np.concatenate([b for _, b, _ in blocks]).astype(np.int64)
    order = np.argsort(token)
    s = token[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    group = np.cumsum(new) - 1
    frequency = np.zeros(len(token), np.int64)
    frequency[order] = np.add.reduceat(count[order], np.flatnonzero(new))[group]
    out, at = [], 0
    for token, (_, count, owner) in zip(tokens, blocks):
        f = frequency[at:at + len(token)]
        at += len(token)
        shared, rare = f >= 2, count <= COMMON
        code = np.minimum(255, 4 * np.log2(f[shared])).astype(np.uint8)
        out.append((squeeze(np.diff(token[shared], prepend=np.uint64(0))), squeeze(count[shared]), squeeze(owner[np.repeat(shared[rare], count[rare])]), squeeze(code)))
    a, b, c, d = zip(*out)
    return pa.Table.from_arrays([table.column("key"), table.column("block"), *(pa.array(x, pa.binary()) for x in (a, b, c, d))], names=["key", "block", "a", "b", "c", "d"])


SETS = "doc_id long, row long, n long, d1 long, d2 long, shared binary"


def pack_shared(token: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Seven bytes an entry: the 48-bit hash and its frequency's code."""
    return np.concatenate([token.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6], code.reshape(-1, 1)], axis=1)


def unpack_shared(b: bytes) -> tuple[np.ndarray, np.ndarray]:
    rows = np.frombuffer(b, np.uint8).reshape(-1, 7)
    wide = np.zeros((len(rows), 8), np.uint8)
    wide[:, :6] = rows[:, :6]
    return wide.view("<u8").reshape(-1), rows[:, 6]


def _documents(table: pa.Table) -> pa.Table:
    """One row per document of a block; ``shared`` (its shared shingles) only where a partner is possible."""
    give_back()  # of the group before
    table = table.sort_by("key")
    a, b, c, d = (table.column(x) for x in "abcd")
    ids, n, common, rest = (unsqueeze(x[0].as_py()) for x in (a, b, c, d))
    ids, n, docs = ids.view(np.int64).reshape(2, -1), n.astype(np.int64), len(n)
    d1, d2, null = rest[:docs].view(np.int64), rest[docs:2 * docs].view(np.int64), rest[2 * docs:] > 0
    got = range(1, table.num_rows)
    join = lambda x, t: np.concatenate([np.zeros(0, t), *x])
    token = join((np.cumsum(unsqueeze(a[i].as_py()), dtype=np.uint64) for i in got), np.uint64)
    count = join((unsqueeze(b[i].as_py()) for i in got), np.uint32).astype(np.int64)
    code = join((unsqueeze(d[i].as_py()) for i in got), np.uint8)
    is_common = np.repeat(count > COMMON, count)
    owner = np.empty(len(is_common), np.uint32)
    owner[is_common] = common
    owner[~is_common] = join((unsqueeze(c[i].as_py()) for i in got), np.uint32)
    order = np.argsort(owner.astype(np.uint16) if docs < 1 << 16 else owner, kind="stable")
    entries = pack_shared(np.repeat(token, count)[order], np.repeat(code, count)[order])
    shared = np.bincount(owner, minlength=docs)
    upto = np.concatenate([[0], np.cumsum(shared)])
    open_ = (n > 0) & (100 * shared >= PERCENT * n)
    blobs = [entries[upto[i]:upto[i + 1]].tobytes() if o else None for i, o in enumerate(open_.tolist())]
    return pa.Table.from_arrays([pa.array(ids[0], mask=null), pa.array(ids[1]), pa.array(n), pa.array(d1), pa.array(d2), pa.array(blobs, pa.binary())],
                                names=["doc_id", "row", "n", "d1", "d2", "shared"])


def document_sets(docs: DataFrame, ranges: int | None = None, row: Column | None = None) -> DataFrame:
    """A written table with one row per document: size and digest of its set, and its shared shingles if it may have a partner.

    ``row`` is a stored number of the row; without one the rows get numbers here, which only this table knows.
    """
    row = F.monotonically_increasing_id() if row is None else row
    spark = docs.sparkSession
    tasks = partitions(spark)
    if ranges is None:
        text_bytes = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
        ranges = max(4 * tasks, -(-text_bytes // RANGE_BYTES))
        tasks = max(tasks, ranges // 4)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row.alias("row"), F.col("text").cast("string").alias("text")).mapInArrow(lambda it: _blocks(it, ranges), BLOB)
    if tasks > partitions(spark):
        rows = rows.repartition(tasks, "key")
    counted = rows.groupBy("key").applyInArrow(_frequencies, BLOB)
    if tasks > partitions(spark):
        counted = counted.repartition(tasks, "block")
    sets = materialize(counted.groupBy("block").applyInArrow(_documents, SETS), "sets")
    release(spark)
    return sets


def first_shingles(classes: DataFrame) -> DataFrame:
    """A written table of cid, n, firsts: the first shared shingle of every class under each of FIRSTS orders.

    The orders are those of mixed hashes, so a shingle is named by its mixed hash.  Two sets agree under an order as often as they are similar.
    """
    seeds = np.arange(1, FIRSTS + 1, dtype=np.uint64) * MIX[1]

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "shared", BLOCK_BYTES):
                tokens = [unpack_shared(x.as_py())[0] for x in batch.column("shared")]
                starts = np.cumsum([0] + [len(x) for x in tokens[:-1]])
                token = np.concatenate(tokens)
                least = np.stack([np.minimum.reduceat(mix(mix(token + seed), 2), starts) for seed in seeds], axis=1).view(np.int64)
                ends = pa.array(np.arange(len(least) + 1, dtype=np.int32) * FIRSTS)
                yield pa.RecordBatch.from_arrays([batch.column("cid"), batch.column("n"), pa.ListArray.from_arrays(ends, pa.array(least.reshape(-1)))], names=["cid", "n", "firsts"])

    return materialize(classes.select("cid", "n", "shared").mapInArrow(firsts, "cid long, n long, firsts array<long>"), "firsts")


def prefix_lists(classes: DataFrame, labels: DataFrame | None, orders: int = ORDERS) -> DataFrame:
    """k, token, cid, n, pos, comp: the prefix shingles of every class under each order, where a class of another component has them too.

    ``pos`` shingles come before it in the order.  Two sets with overlap o need their first common shingle to have at
    least o from there on in both; as o is at least 3/7 of both sizes together, the smaller set's one is
    strong, that is among its first seventh or so.
    """

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "shared", BLOCK_BYTES):
                found = []
                for cid, n, comp, blob in zip(*(batch.column(c).to_pylist() for c in ("cid", "n", "comp")), batch.column("shared")):
                    token, code = unpack_shared(blob.as_py())
                    alone = n - len(token)  # the rarest of all, first under every order
                    length = n - -(-PERCENT * n // 100) + 1 - alone
                    for k in range(orders):
                        first = token[np.lexsort((mix(token, k) if k else token, code))[:length]]
                        pos = alone + np.arange(len(first))
                        found.append((np.full(len(first), k, np.int8), first.view(np.int64), *(np.full(len(first), x, np.int64) for x in (cid, n, comp)), pos))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)], names=["k", "token", "cid", "n", "comp", "pos"])

    lists = labelled(classes.select("cid", "n", "shared"), labels).mapInArrow(prefixes, "k byte, token long, cid long, n long, comp long, pos long")
    several = lists.groupBy("k", "token").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.bool_or(F.expr("7 * (n - pos) >= 6 * n")).alias("strong"))
    return materialize(lists.join(several.filter("low < high AND strong").select("k", "token"), ["k", "token"], "left_semi"), "lists")


def verified(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes whose sets reach the similarity.  Only sets that a pair names move."""
    pairs = materialize(pairs, "pairs")
    left = classes.select(F.col("cid").alias("a"), F.col("n").alias("n_a"), F.col("shared").alias("s_a")).join(pairs.select("a"), "a", "left_semi")
    right = classes.select(F.col("cid").alias("b"), F.col("n").alias("n_b"), F.col("shared").alias("s_b")).join(pairs.select("b"), "b", "left_semi")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n_a, n_b = (batch.column(c).to_pylist() for c in ("a", "b", "n_a", "n_b"))
            good = []
            for i in range(batch.num_rows):
                x, y = (unpack_shared(batch.column(c)[i].as_py())[0] for c in ("s_a", "s_b"))
                found = np.searchsorted(y, x)
                both = int((y[np.minimum(found, len(y) - 1)] == x).sum())
                if 100 * both >= PERCENT * (n_a[i] + n_b[i] - both):
                    good.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for i in good], pa.int64()) for x in (a, b)], names=["a", "b"])

    return pairs.join(left, "a").join(right, "b").select("a", "b", "n_a", "n_b", "s_a", "s_b").mapInArrow(check, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """node, label (the smallest node it reaches) for every node of the links (a, b)."""
    both = materialize(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("_a")).agg(F.min("label").alias("_near"))
        lower = labels.join(near, labels["node"] == near["_a"]).select("node", "label", F.least("label", "_near").alias("next"))
        jump = labels.select(F.col("node").alias("_n"), F.col("label").alias("_jump"))
        lower = lower.join(jump, F.col("next") == F.col("_n")).select("node", "label", F.least("next", "_jump").alias("next"))
        lower = materialize(lower, "labels")
        moved = lower.filter("next < label").limit(1).count()
        labels = lower.select("node", F.col("next").alias("label"))
        if not moved:
            return labels


def labelled(classes: DataFrame, labels: DataFrame | None) -> DataFrame:
    """With ``comp``, the component of each class so far."""
    if labels is None:
        return classes.withColumn("comp", F.col("cid"))
    return classes.join(labels, classes["cid"] == labels["node"], "left").select(*classes.columns, F.coalesce("label", "cid").alias("comp"))


def reach(n: str, pos: str, m: str, at: str) -> Column:
    """Whether both sets have enough shingles from a common one on for the similarity; implies near sizes."""
    both = 3 * (F.col(n) + F.col(m))
    return (7 * (F.col(n) - F.col(pos)) >= both) & (7 * (F.col(m) - F.col(at)) >= both)


def leader_pairs(firsts: DataFrame, labels: DataFrame | None, seed: int) -> DataFrame:
    """Pairs of a class and leaders in other components, those that agree under most orders first.

    Classes with the same first shingle under an order are a list.  At seed 0 a list's leader is its first class, so a
    group of near copies meets one leader.  Later every list draws its own, and a class tries several of them: what a few leaders
    leave over in a group without a centre has most of its links still to find.
    """
    of_round = lambda x: x[min(seed, len(x) - 1)]

    def drawn(i: int) -> Column:
        by = F.xxhash64("cid", "token", F.lit(seed), F.lit(i)) if seed else F.col("cid")
        return F.min(F.struct(by.alias("h"), F.col("cid"), F.col("n"), F.col("comp")))

    lists = labelled(firsts, labels).select("cid", "n", "comp", F.posexplode("firsts").alias("k", "token"))
    draws = [f"l{i}" for i in range(of_round(DRAWS))]
    leaders = lists.groupBy("k", "token").agg(*(drawn(i).alias(x) for i, x in enumerate(draws)), F.min("comp").alias("low"), F.max("comp").alias("high"))
    leaders = leaders.filter("low < high").select("k", "token", F.explode(F.array_distinct(F.array(*(F.col(x).dropFields("h") for x in draws)))).alias("l"))
    leaders = leaders.select("k", "token", F.col("l.cid").alias("leader"), F.col("l.n").alias("l_n"), F.col("l.comp").alias("l_comp"))
    met = lists.join(leaders, ["k", "token"]).filter(f"comp <> l_comp AND 100 * least(n, l_n) >= {PERCENT} * greatest(n, l_n)").select("cid", "leader").distinct()
    own = firsts.select("cid", F.col("firsts").alias("x"))
    other = firsts.select(F.col("cid").alias("leader"), F.col("firsts").alias("y"))
    agree = F.aggregate(F.zip_with("x", "y", lambda x, y: (x == y).cast("int")), F.lit(0), lambda a, b: a + b)
    scored = met.join(own, "cid").join(other, "leader").select("cid", "leader", agree.alias("agree")).filter(F.col("agree") >= AGREE)
    best = scored.groupBy("cid").agg(F.sort_array(F.collect_list(F.struct("agree", "leader")), False).alias("best"))  # at most DRAWS a list of the class
    tried = best.select("cid", F.explode(F.slice("best", 1, of_round(LEADERS))).alias("l"))
    return tried.select(F.least("cid", "l.leader").alias("a"), F.greatest("cid", "l.leader").alias("b")).distinct()


def candidate_pairs(lists: DataFrame, orders: int = ORDERS) -> DataFrame:
    """All pairs of classes in different components that share a prefix shingle under every order, with enough beyond it under the first."""
    own = lists.filter("k = 0").select("token", "comp", "cid", "n", "pos")
    comps = own.groupBy("token", "comp").agg(F.max(4 * F.col("n") - 7 * F.col("pos")).alias("most"), F.min("n").alias("least"), F.count(F.lit(1)).alias("members"))
    named = lambda i: comps.select("token", *(F.col(c).alias(f"{c}{i}") for c in ("comp", "most", "least", "members")))
    # Components of which no two members can reach each other (see ``reach``) don't meet.
    two = named(1).join(named(2), "token").filter("comp1 < comp2 AND most1 >= 3 * least2 AND most2 >= 3 * least1")
    # The smaller side goes first: the members of a large component are not repeated for each class that meets it.
    two = two.select("token", F.expr("IF(members1 <= members2, comp1, comp2)").alias("c1"), F.expr("IF(members1 <= members2, comp2, comp1)").alias("c2"))
    one = own.select("token", F.col("comp").alias("c1"), F.col("cid").alias("x"), F.col("n").alias("n_x"), F.col("pos").alias("pos_x"))
    other = own.select("token", F.col("comp").alias("c2"), F.col("cid").alias("y"), F.col("n").alias("n_y"), F.col("pos").alias("pos_y"))
    pairs = two.join(one, ["token", "c1"]).join(other, ["token", "c2"]).filter(reach("n_x", "pos_x", "n_y", "pos_y")).select("x", "y").distinct()
    for k in range(1, orders):
        # Other orders are looked up for the pairs found; under each, a pair would come once for every shingle it shares.
        prefix = lists.filter(F.col("k") == k).groupBy("cid").agg(F.collect_list("token").alias("prefix"))  # a part of one set
        pairs = pairs.join(prefix.select(F.col("cid").alias("x"), F.col("prefix").alias("p_x")), "x").join(prefix.select(F.col("cid").alias("y"), F.col("prefix").alias("p_y")), "y")
        pairs = pairs.filter(F.arrays_overlap("p_x", "p_y")).select("x", "y")
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def linked(classes: DataFrame, orders: int = ORDERS, most_rounds: int = 3, slack: int = 0) -> DataFrame | None:
    """node, label over classes: components of all links, or None if there are none.

    Leader rounds only save work: they go on while one finds more than ``slack`` links, ``most_rounds`` times at most.
    What remains is verified in full, so the result never depends on them.
    """
    spark = classes.sparkSession
    firsts = first_shingles(classes)
    labels, links = None, None
    for r in range(most_rounds):
        found = materialize(verified(leader_pairs(firsts, labels, r), classes), "leader-links")
        release(spark)
        n_found = found.count()
        if n_found:
            links = found if links is None else links.union(found)
            labels = components(links)
        if n_found <= slack and r >= len(DRAWS) - 1:
            break
    rest = materialize(verified(candidate_pairs(prefix_lists(classes, labels, orders), orders), classes), "pair-links")
    release(spark)
    if rest.isEmpty():
        return labels
    return components(rest if links is None else links.union(rest))


def near_rows(docs: DataFrame, orders: int = ORDERS, row: Column | None = None) -> DataFrame:
    """row, doc_id, n_shingles, component_id, keep_row for every row of ``docs``.

    ``keep_row`` is the row of a component with the smallest (doc_id nulls last, row).
    """
    sets = document_sets(docs, row=row)
    open_ = sets.filter("shared IS NOT NULL")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row"))
    classes = open_.groupBy("n", "d1", "d2").agg(first.alias("first"), F.first("shared").alias("shared"))
    classes = materialize(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    release(docs.sparkSession)
    labels = linked(classes, orders)
    if labels is None:
        named = classes.select("n", "d1", "d2", "first")
    else:
        at = classes.join(labels, classes["cid"] == labels["node"], "left").select("n", "d1", "d2", F.col("first").alias("own"), F.coalesce("label", "cid").alias("label"))
        smallest = materialize(at.groupBy("label").agg(F.min("own").alias("first")), "smallest")
        named = at.join(smallest, "label").select("n", "d1", "d2", "first")
    named = materialize(named, "named").select(F.col("n").alias("_n"), F.col("d1").alias("_d1"), F.col("d2").alias("_d2"), "first")
    skinny = sets.select("row", "doc_id", "n", "d1", "d2")
    met = skinny.join(named, (F.col("n") == F.col("_n")) & (F.col("d1") == F.col("_d1")) & (F.col("d2") == F.col("_d2")), "left")
    return met.select("row", "doc_id", F.col("n").alias("n_shingles"), F.coalesce("first.doc_id", "doc_id").alias("component_id"), F.coalesce("first.row", "row").alias("keep_row"))


def near_duplicates(docs: DataFrame, orders: int = ORDERS) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs``."""
    return near_rows(docs, orders).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame, orders: int = ORDERS) -> DataFrame:
    """One row of each component, with all its columns: the smallest id, and of several the smallest row number.

    The rows are written with their numbers, so ids may repeat or be NULL: rows leave by number.
    """
    names, docs = docs.columns, apart(docs, ("_copy_row", "_gone_row"))
    numbered = materialize(docs.withColumn("_copy_row", F.monotonically_increasing_id()), "documents")
    gone = near_rows(numbered, orders, F.col("_copy_row")).filter("row <> keep_row").select(F.col("row").alias("_gone_row"))
    return numbered.join(gone, F.col("_copy_row") == F.col("_gone_row"), "left_anti").select(*(numbered[f"`{c}`"] for c in docs.columns)).toDF(*names)
