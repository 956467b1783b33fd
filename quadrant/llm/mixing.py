"""Mixing sources to target weights (operator 4).

Documents get hash-random keys and are range-sorted within their source; distributed
prefix sums of their sizes say where each lies in its source's line, and every source
is cut at its exact budget: whole epochs first, then the line up to the budget,
the last document in part.

Weights are 1, 2, 3, repeating over the sources in code point order (NULL last).  A target is
a source's share by weight, at most ``most`` times its size; what is above is reshared by
weight.  That is water-filling: one level for all sources below their bound, found from
prefix sums over the sources in the order of bound per weight.

Defined results: NULL or empty text has size 0 and nothing is taken from it; NULL source
is a source of its own; NULL doc_id and repeated rows are documents like others; an empty
table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import WORD, apart, prefix_sums, release

MOST_EPOCHS = 3
SEED = "mix-1"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def random_key(doc_id: Column, seed: str = SEED) -> Column:
    """A key that depends on the document's id and the seed alone, so reruns agree."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))


def source_targets(sizes: DataFrame, most: int = MOST_EPOCHS) -> DataFrame:
    """source, source_size, target from rows of (source, size)."""
    sources = materialize(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    ranked = prefix_sums(sources.withColumn("one", F.lit(1).cast("long")), [], [F.col("source").asc_nulls_last()], {"rank": "one"})
    weighed = materialize(ranked.select(
        "source", "source_size", (1 + F.col("rank") % 3).alias("weight"), (most * F.col("source_size")).alias("bound")), "weights")
    total = weighed.agg(F.sum("source_size").alias("total"), F.sum("weight").alias("weights"))
    line = prefix_sums(weighed, [], [F.col("bound") / F.col("weight"), F.col("source").asc_nulls_last()],
                       {"bounds_before": "bound", "weights_before": "weight"})
    level = (F.col("total") - F.col("bounds_before")).cast("double") / (F.col("weights") - F.col("weights_before")).cast("double")
    # One row with the totals, one with the level: the first source in line below its bound sets it, and the level only falls after it.
    levels = (line.crossJoin(F.broadcast(total)).withColumn("level", level)
              .filter(F.col("bound").cast("double") / F.col("weight") > F.col("level"))
              .agg(F.max("level").alias("level")))
    target = F.least(F.col("bound").cast("double"), F.coalesce(F.col("level") * F.col("weight"), F.col("bound").cast("double")))
    return weighed.crossJoin(F.broadcast(levels)).select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, most: int = MOST_EPOCHS, seed: str = SEED, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, size, source, source_size, target, taken (words, repeats counted), and the columns of ``carry``."""
    skinny = materialize(docs.select(
        "doc_id", "source", word_count(F.col("text")).alias("size"), random_key(F.col("doc_id"), seed).alias("key"), *carry), "mix")
    targets = materialize(source_targets(skinny.select("source", "size"), most), "targets").withColumnRenamed("source", "_source")
    order = [F.col("key"), F.col("doc_id").asc_nulls_last(), F.col("size")]
    line = prefix_sums(skinny, ["source"], order, {"before": "size"})
    met = line.join(targets, line["source"].eqNullSafe(targets["_source"]), "inner")
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = budget - epochs * F.col("source_size")
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest - F.col("before")))
    return met.select("doc_id", "size", "source", "source_size", "target", (epochs * F.col("size") + part).cast("long").alias("taken"), *carry)


def mixed_documents(docs: DataFrame, most: int = MOST_EPOCHS, seed: str = SEED) -> DataFrame:
    """The mix itself: a document's row as often as its words are taken whole, and once more, cut to
    the words left (joined by one space), where a source's budget ends inside it.

    The rows are written with their numbers, so both sides of the join read the same ones, however
    later scans are split.
    """
    names, docs = docs.columns, apart(docs, ("_mix_row", "_row", "_whole", "_rest", "_copy"))
    numbered = materialize(docs.withColumn("_mix_row", F.monotonically_increasing_id()), "documents")
    told = mix(numbered, most, seed, ("_mix_row",)).filter("taken > 0").select(
        F.col("_mix_row").alias("_row"), F.expr("taken div size").alias("_whole"), (F.col("taken") % F.col("size")).alias("_rest"))
    release(docs.sparkSession)
    met = numbered.join(told, F.col("_mix_row") == F.col("_row"))
    copies = F.sequence(F.lit(1), (F.col("_whole") + (F.col("_rest") > 0).cast("long")).cast("int"))
    met = met.withColumn("_copy", F.explode(copies))
    is_cut = F.col("_copy") > F.col("_whole")
    cut = F.array_join(F.slice(F.regexp_extract_all(F.col("text"), F.lit(WORD), F.lit(0)), 1, F.greatest(F.lit(1), F.col("_rest").cast("int"))), " ")
    text = F.when(is_cut, cut).otherwise(F.col("text"))
    out = {c: F.col(f"`{c}`") for c in docs.columns}
    out["text"] = text
    if "n_chars" in out:
        out["n_chars"] = F.when(is_cut, F.char_length(cut)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return met.select(*(v.alias(c) for c, v in out.items())).toDF(*names)
