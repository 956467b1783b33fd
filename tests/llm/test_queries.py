"""Registered queries against DuckDB or brute force over the whole small tables, and the pipeline."""

import zlib

import numpy as np
import pytest
from helpers import SPACES, jaccard_components, repeated_bytes, words
from oracle_compare import compare, duck

import corpus_pipeline
from quadrant.llm.oracle import ORACLES
from quadrant.llm.queries import QUERIES
from quadrant.llm.quality import RULES, Document

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.fixture(scope="module")
def rows(con):
    return con.execute("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall()


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, con, name):
    found = compare(spark, con, SF, name, QUERIES[name], ORACLES[name])
    assert found["columns_match"] and found["values_match"], found


def test_ngram_query(spark, rows):
    got = QUERIES["op9_ngram_jaccard_join"](spark, SF).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(jaccard_components(rows))


def test_repeated_passages_query(spark, rows):
    got = QUERIES["op10_repeated_passages"](spark, SF).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted(repeated_bytes(rows))


def test_license_query_finds_all_lines(spark, rows):
    lines = {"Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Released under the MIT License.": "MIT",
             "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0"}
    want = {(doc, name) for doc, text in rows for line, name in lines.items() if line in (text or "")}
    assert {(r.doc_id, r.license) for r in QUERIES["op1_license_scan"](spark, SF).collect()} == want


def test_token_queries(spark, rows):
    from quadrant.llm.tokens import WordTokenizer, default_path
    library = WordTokenizer(default_path()).library
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    ids = {doc: library.encode(text or "", add_special_tokens=False).ids for doc, text in rows}
    want, at = set(), 0
    for doc, _ in rows:
        own = ids[doc] + [1]
        want.add((doc, at, len(own), crc(own)))
        at += len(own)
    assert {(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in QUERIES["op8_token_files"](spark, SF).collect()} == want
    pieces = {(doc, p, 2048 * p, len(x), crc(x)) for doc in ids for p, x in enumerate((ids[doc] + [0])[a:a + 2048] for a in range(0, len(ids[doc]) + 1, 2048))}
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in QUERIES["op7_best_fit_packing"](spark, SF).collect()} == pieces


def test_pipeline_stages_and_run(spark, con, rows):
    kept = [(d, t) for d, t in rows if not any(r.rejects(Document(t)) for r in RULES)]
    groups = {}
    for doc, text in kept:
        normal = "".join(c for c in text or "" if c not in SPACES)
        groups[normal] = min(groups.get(normal, (0, 0, "")), (-len(text), doc, text)) if normal in groups else (-len(text), doc, text)
    unique = sorted((doc, text) for _, doc, text in groups.values())
    alone = {c for _, _, c in jaccard_components(unique)}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, want = docs.columns, [{d for d, _ in kept}, {d for d, _ in unique}, alone]
    for (name, stage), ids in zip(corpus_pipeline.STAGES, want):
        docs = corpus_pipeline.materialize(stage(spark, docs, SF), name)
        assert docs.columns == columns and {r.doc_id for r in docs.select("doc_id").collect()} == ids, name
    size = {d: len(words(t)) for d, t in unique if d in alone}
    docs = corpus_pipeline.materialize(corpus_pipeline.STAGES[3][1](spark, docs, SF), "mix")
    mixed = docs.collect()
    assert docs.columns == columns and abs(sum(len(words(r.text)) for r in mixed) - sum(size.values())) <= 20
    packed = corpus_pipeline.STAGES[4][1](spark, docs, SF).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in mixed}
    again = corpus_pipeline.run(spark, SF).collect()
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, again)) == sorted(map(key, packed))
