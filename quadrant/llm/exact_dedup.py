"""Exact dedup by content-defined chunk recipes (operator 2), DataFrame functions only.

A text without white space is cut where its content says so (a short run of
characters of a fixed class), so equal passages give equal chunks wherever they stand.  Each
distinct chunk gets a verified identifier: the hash of its text, plus, where two different
chunks share a hash, the chunk's rank among them, found by comparing texts.
A document's recipe is the ordered list of its chunks' identifiers; two
texts are equal exactly when their recipes are.  Chunk texts move once, with
one copy a map task; documents never move, and groups meet by recipe.

Of equal documents the one with the most code points stays, then the smallest doc_id.

Defined results: NULL text counts as empty, and empty texts (or such of white space
alone) are equal to each other; NULL doc_id is larger than every other; of repeated rows with
one doc_id exactly one is kept; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import apart, release

WHITE_SPACE = " \t\n\x0b\x0c\r"
MIN_CHARS, MAX_CHARS = 128, 4096
#: A chunk ends after five characters of this class in a row, once it has MIN_CHARS; at MAX_CHARS at the latest.
#: That is rare against MIN_CHARS, so a shifted copy soon has its cuts where the original has them.
BREAK = "[\\x21-\\x2F\\x3A-\\x40aeks02468]{5}"
CHUNK = f"(?s).{{{MIN_CHARS},{MAX_CHARS - 5}}}?{BREAK}|.{{1,{MAX_CHARS}}}"


def without_white_space(text: Column) -> Column:
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), WHITE_SPACE, "")


def chunks(normalized: Column, pattern: str = CHUNK) -> Column:
    return F.regexp_extract_all(normalized, F.lit(pattern), F.lit(0))


def recipes(docs: DataFrame, row: Column | None = None) -> DataFrame:
    """One row per document with its chunks (hash and text), size and digest.

    ``row`` is a stored number of the row; without one the rows get numbers here, which only the table written here knows.
    With one the chunks are cut anew for each use, which saves a second copy of the texts.
    """
    stored = row is not None
    row = row if stored else F.monotonically_increasing_id()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(row.alias("row"), "doc_id", F.char_length(text).alias("n_chars"), without_white_space(text).alias("normal"))
    rows = rows.select("row", "doc_id", "n_chars", F.sha2(F.col("normal").cast("binary"), 256).alias("text_sha256"), chunks(F.col("normal")).alias("texts"))
    rows = rows.select("row", "doc_id", "n_chars", "text_sha256", F.transform("texts", lambda c: F.xxhash64(c)).alias("hashes"), "texts")
    return rows if stored else materialize(rows, "recipes")


def shared_hashes(staged: DataFrame) -> DataFrame:
    """Hashes that two or more different chunk texts have: as good as always none.

    This is where chunks are compared by their texts; one copy of a chunk leaves each map task.
    """
    occurrences = staged.select(F.explode(F.arrays_zip("hashes", "texts")).alias("c"))
    distinct = occurrences.select(F.col("c.hashes").alias("hash"), F.col("c.texts").alias("chunk")).distinct()
    return distinct.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1").select("hash")


def with_identifiers(staged: DataFrame) -> DataFrame:
    """row, doc_id, n_chars, text_sha256 and the recipe: ``hashes``, and ``ranks`` for chunks that share a hash."""
    shared = materialize(shared_hashes(staged), "shared-hashes")
    release(staged.sparkSession)
    skinny = staged.select("row", "doc_id", "n_chars", "text_sha256", "hashes")
    ranks = "array<struct<pos:int,rank:int>>"
    if shared.isEmpty():
        return skinny.withColumn("ranks", F.lit(None).cast(ranks))
    at = staged.select("row", F.posexplode(F.arrays_zip("hashes", "texts")).alias("pos", "c"))
    at = at.select("row", "pos", F.col("c.hashes").alias("hash"), F.col("c.texts").alias("chunk")).join(shared, "hash", "left_semi")
    ranked = at.select("hash", "chunk").distinct().withColumn("rank", F.row_number().over(Window.partitionBy("hash").orderBy("chunk")))
    fixes = (at.join(ranked, ["hash", "chunk"]).groupBy("row")
             .agg(F.array_sort(F.collect_list(F.struct("pos", "rank"))).cast(ranks).alias("ranks")))
    return skinny.join(fixes, "row", "left")


def duplicate_groups(docs: DataFrame, row: Column | None = None) -> DataFrame:
    """row, doc_id, n_chars, keep_id, keep_row, group_size, kept, text_sha256 for every row of ``docs``."""
    named = materialize(with_identifiers(recipes(docs, row)), "identified")
    release(docs.sparkSession)
    recipe = [F.col("hashes"), F.coalesce("ranks", F.array().cast("array<struct<pos:int,rank:int>>")).alias("ranks")]
    named = named.select("row", "doc_id", "n_chars", "text_sha256", *recipe)
    best = F.min(F.struct((-F.col("n_chars")).alias("less"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("row").alias("row")))
    groups = named.groupBy("hashes", "ranks").agg(F.count("*").alias("group_size"), best.alias("best")).filter("group_size > 1")
    # Written first: the join below then has exchanges of its own on both sides, which Spark splits where a group is hot.
    groups = materialize(groups, "groups").select(
        F.col("hashes").alias("g_hashes"), F.col("ranks").alias("g_ranks"), "group_size",
        F.col("best.id").alias("best_id"), F.col("best.row").alias("best_row"))
    met = named.join(groups, (F.col("hashes") == F.col("g_hashes")) & (F.col("ranks") == F.col("g_ranks")), "left")
    alone = F.col("best_row").isNull()
    keep_row = F.coalesce("best_row", "row")
    return met.select(
        "row", "doc_id", "n_chars", F.when(alone, F.col("doc_id")).otherwise(F.col("best_id")).alias("keep_id"), keep_row.alias("keep_row"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), (F.col("row") == keep_row).alias("kept"), "text_sha256")


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    The rows are written with their numbers, so both sides of the join read the same ones, however
    later scans are split.  Only the numbers of rows that leave are joined back.
    """
    names, docs = docs.columns, apart(docs, ("_copy_row", "_gone_row"))
    numbered = materialize(docs.withColumn("_copy_row", F.monotonically_increasing_id()), "documents")
    gone = duplicate_groups(numbered, F.col("_copy_row")).filter("not kept").select(F.col("row").alias("_gone_row"))
    return numbered.join(gone, F.col("_copy_row") == F.col("_gone_row"), "left_anti").select(*(numbered[f"`{c}`"] for c in docs.columns)).toDF(*names)
