"""The numbered operators as named queries over the tables of a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .centroids import cluster_vectors
from .chat import mask, swapped_reply_rows
from .common import read
from .exact_dedup import duplicate_groups
from .fill_middle import fill_in_middle_digests
from .html_extract import extract_text
from .licenses import license_matches
from .mixing import mix
from .ngram_join import near_duplicates
from .packing import pack
from .quality import quality_report
from .suffix_dedup import remove_repeats
from .token_output import token_files
from .warc import archived_pages


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_matches(read(spark, sf_dir, "documents"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_groups(read(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op3_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = swapped_reply_rows(read(spark, sf_dir, "conversations"))
    return rows.select("pair_id", "n_common", "prompt", "chosen", "rejected",
                       mask(F.col("chosen_segments")).alias("chosen_mask"), mask(F.col("rejected_segments")).alias("rejected_mask"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(read(spark, sf_dir, "documents"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(read(spark, sf_dir, "pages"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(read(spark, sf_dir, "documents"))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


def op10_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle_digests(read(spark, sf_dir, "documents"))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(read(spark, sf_dir, "embeddings"))


def op13_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived_pages(read(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_license_scan,
    op2_exact_dedup,
    op3_preference_format,
    op4_source_mixing,
    op5_quality_rules,
    op6_html_extraction,
    op7_best_fit_packing,
    op8_token_files,
    op9_ngram_jaccard_join,
    op10_repeated_passages,
    op11_fill_in_middle,
    op12_centroid_clustering,
    op13_warc_round_trip,
)}
