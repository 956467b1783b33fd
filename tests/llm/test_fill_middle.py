"""Fill-in-the-middle outputs against regular expressions, and the wavelet matrix against counting."""

import hashlib
import re

import numpy as np
import pytest
from helpers import corpus, documents
from pyspark.sql import functions as F

from quadrant.llm.fill_middle import fill_in_middle, fill_in_middle_digests, restore
from quadrant.llm.wavelet import BitVector, WaveletMatrix

UNITS = {"token": r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", "line": r"[^\n]*\n|[^\n]+", "char": r"(?s)."}
ODD = [(10**6, None), (None, "a b"), (2**53 + 1, "one two  three\n four\x1c\x85 five "), (7001, "x" * 100_000 + " \n"), (7002, "é 日本 <P> x"),
       (7003, "a\nb c\n\nd"), (7003, "a\nb c\n\nd"), (7004, "<<P <S M> < P>" * 9), (7005, "\U0001f600 \U0001f600" * 50)]


def brute(doc, text, unit):
    text = text or ""
    parts = re.findall(UNITS[unit], text)
    digest = hashlib.sha256(f"42:{'null' if doc is None else doc}".encode()).hexdigest()
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(parts) + 1), h[1] % (len(parts) + 1)))
    p, m, s = ("".join(x) for x in (parts[:a], parts[a:b], parts[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return doc, len(parts), "plain", None, None, text
    if h[3] % 100 < 80:
        return doc, len(parts), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc, len(parts), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("unit", sorted(UNITS))
def test_outputs_equal_regular_expressions(spark, unit):
    rows = corpus(n=150) + ODD
    got = fill_in_middle(documents(spark, rows), unit=unit).collect()
    assert sorted(map(tuple, got), key=repr) == sorted((brute(d, t, unit) for d, t in rows), key=repr)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_output_gives_the_text_back(spark):
    rows = [(i, t) for i, (_, t) in enumerate(corpus(n=150) + ODD)]
    back = {r.doc_id: r.text for r in fill_in_middle(documents(spark, rows)).select("doc_id", restore(F.col("output"), F.col("form")).alias("text")).collect()}
    assert back == {d: t or "" for d, t in rows}


def test_empty_table_and_other_columns(spark):
    assert fill_in_middle(documents(spark, [])).count() == 0
    odd = documents(spark, [(1, "a b c"), (2, None)]).selectExpr("doc_id", "text", "'x' AS cut", "1 AS n", "2 AS output", "3 AS form")
    assert fill_in_middle_digests(odd).columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    assert [r.n for r in fill_in_middle(odd).orderBy("doc_id").collect()] == [3, 0]


def test_no_text_comes_back_from_python(spark):
    plan = fill_in_middle_digests(documents(spark, [(1, "a b")]))._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "MapInArrow" not in plan and "Exchange" not in plan


def test_wavelet_matrix_counts_symbols():
    rng = np.random.default_rng(5)
    for n in (0, 1, 63, 64, 65, 1000):
        symbols = rng.integers(0, 6, n).astype(np.uint8)
        matrix, at = WaveletMatrix(symbols, 3), np.arange(n + 1)
        for s in range(8):
            assert (matrix.rank(s, at) == np.concatenate([[0], np.cumsum(symbols == s)])).all()
        bits = symbols & 1
        assert (BitVector(bits).rank1(at) == np.concatenate([[0], np.cumsum(bits)])).all()
