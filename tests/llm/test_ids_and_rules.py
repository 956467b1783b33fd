"""Ids beyond 2^53 beside NULL, parser time, and vocabularies with other rules."""

import time

import numpy as np
import pyarrow as pa
import pytest
from helpers import corpus, documents, odd_texts

from quadrant.llm import html_extract, quality
from quadrant.llm.tokens import WordTokenizer, default_path

ODD = 2**53 + 1


def test_ids_beside_null_stay_exact(spark):
    docs = documents(spark, [(ODD, "a b"), (None, "c"), (-ODD, None)]).coalesce(1)
    assert {r.doc_id for r in quality.quality_report(docs).collect()} == {ODD, None, -ODD}
    pages = spark.createDataFrame([(ODD, "u", "<p>x</p>"), (None, None, None)], "page_id long, url string, html string").coalesce(1)
    assert {r.page_id for r in html_extract.extract_text(pages).collect()} == {ODD, None}


@pytest.mark.parametrize("make", [lambda n: "<div>" * n, lambda n: "<b>" * n + "</i>" * n, lambda n: "<p>" + "<b>" * n + "<div>" * n, lambda n: "<math><mi>" + "<div>" * n,
                                  lambda n: "<ul><li>" * n + "</li></ul>" * n, lambda n: "<table><tr><td>" * n])
def test_parsing_time_is_linear(make):
    took = []
    for n in (10_000, 40_000):
        began = time.perf_counter()
        html_extract.parse(make(n) + "text")
        took.append(time.perf_counter() - began)
    assert took[1] < 10 * took[0] + 0.5


def test_sample_reads_some_files(spark, tmp_path):
    path = str(tmp_path / "docs")
    documents(spark, corpus(n=300)).repartition(20).write.parquet(path)
    docs = spark.read.parquet(path)
    assert sorted(r.name for r in quality.plan_cascade(docs, fraction=1.0)) == sorted(r.name for r in quality.RULES)
    grouped = docs.groupBy("text").count()
    assert len(quality.plan_cascade(grouped, fraction=1.0)) == len(quality.RULES)
    assert quality.quality_report(docs).count() == docs.count()


def test_other_vocabularies_give_the_library_s_ids():
    import public_tokenizers
    texts = [t or "" for _, t in corpus(n=20)] + [t or "" for t in odd_texts()] + ["Don't  stop\n\nnow", " lead and trail "]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        own = WordTokenizer(public_tokenizers.path(name))
        assert own.by_words == (public_tokenizers.path(name) == default_path())
        ids, at = own.encode(pa.array([*texts, None]))
        want = [own.library.encode(t, add_special_tokens=False).ids for t in [*texts, ""]]
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == want and ids.dtype == np.uint32


def test_columns_of_reserved_names_come_back(spark):
    """Columns that the operators use themselves keep their names and values."""
    from helpers import random_text
    import random

    from quadrant.llm import exact_dedup, mixing, ngram_join
    rng = random.Random(1)
    rows = [(i, random_text(rng, 40)) for i in range(12)] + [(None, "a b"), (7, None)]
    names = ["_copy_row", "_gone_row", "_mix_row", "_row", "_whole", "_rest", "_copy", "_Row_"]
    docs = documents(spark, rows).selectExpr("*", *(f"concat('{n}', coalesce(doc_id, -1)) AS {n}" for n in names))
    for use in (exact_dedup.drop_duplicates, ngram_join.one_of_each, mixing.mixed_documents):
        got = use(docs)
        assert got.columns == docs.columns
        for r in got.collect():
            assert all(r[n] == f"{n}{-1 if r.doc_id is None else r.doc_id}" for n in names)
