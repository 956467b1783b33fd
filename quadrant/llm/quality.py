"""Quality rules as a short-circuit cascade (operator 5).

Every rule looks at one document and says whether to reject it.  On a sample, each
rule's cost (seconds a document) and selectivity (share rejected) are measured, and the
rules run in the order of rejections per second: a document that a cheap rule
rejects never pays for the dear ones.  A document is kept if no rule rejects it, so the
order, and with it the sample, changes only the time, never the verdict.

The sample is a bounded one (``sample_rows``); verdicts and counts cover every row and the whole text.

Defined results: NULL or empty text has no words and fails the base rules.  Repeated
rows give repeated results.  An empty table gives an empty result.  Other columns
of the input are ignored by :func:`quality_report` and kept, all of them, by :func:`quality_filter`.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import slices

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
SAMPLE_ROWS = 400
SAMPLE_FILES = 4
WINDOW = 5


class Document:
    """One text; what the rules need is computed when a rule first asks for it."""

    def __init__(self, text: str | None):
        self.text = text if isinstance(text, str) else ""

    @cached_property
    def words(self) -> list[bytes]:
        # bytes.split() splits at exactly space and U+0009 to U+000D
        return self.text.encode("utf-8", "surrogatepass").split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(self.text.count(c) for c in SPACES)

    @cached_property
    def n_symbols(self) -> int:
        return sum(self.text.count(c) for c in SYMBOLS)

    @cached_property
    def lines(self) -> list[str]:
        return [x for x in self.text.split("\n") if x.strip(SPACES)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def word_ids(self) -> tuple[np.ndarray, int]:
        seen: dict[bytes, int] = {}
        ids = np.fromiter((seen.setdefault(w, len(seen)) for w in self.words), np.int64, self.n_words)
        return ids, len(seen)

    @cached_property
    def n_repeat_words(self) -> int:
        """Words that lie in a five-word window found twice or more in the text."""
        n = self.n_words - WINDOW + 1
        ids, v = self.word_ids
        if n < 2 or v == self.n_words:
            return 0
        # Pairs get dense numbers first, so that a window's code is exact in 64 bits
        pairs, pair = np.unique(ids[:-1] * v + ids[1:], return_inverse=True)
        p = len(pairs)
        if p == self.n_words - 1:
            return 0
        code = (pair[:n] * p + pair[2:2 + n]) * v + ids[4:4 + n]
        _, which, count = np.unique(code, return_inverse=True, return_counts=True)
        starts = np.flatnonzero(count[which] > 1)
        if not len(starts):
            return 0
        edges = np.zeros(self.n_words + 1, np.int64)
        np.add.at(edges, starts, 1)
        np.add.at(edges, starts + WINDOW, -1)
        return int((np.cumsum(edges[:-1]) > 0).sum())

    @cached_property
    def base_failed(self) -> bool:
        return self.n_words < 10 or 100 * self.n_repeat_words > 20 * self.n_words


@dataclass(frozen=True)
class Rule:
    """``rejects`` is true for a document that goes."""

    name: str
    rejects: Callable[[Document], bool]


def _most_common(d: Document) -> int:
    return max(Counter(d.words).values(), default=0)


#: Every threshold is a share of the document itself, so long and short texts meet the same rule.
RULES = (
    Rule("few_words", lambda d: d.n_words < 10),
    Rule("repeated_windows", lambda d: 100 * d.n_repeat_words > 20 * d.n_words),
    Rule("symbols", lambda d: d.n_symbols > 0.1 * d.n_words),
    Rule("repeated_lines", lambda d: len(d.lines) >= 4 and d.n_dup_lines > 0.5 * len(d.lines)),
    Rule("capitals", lambda d: sum(w.decode("utf-8", "replace").isupper() for w in d.words) > 0.5 * d.n_words),
    Rule("exclamations", lambda d: d.text.count("!") > 0.5 * d.n_words),
    Rule("word_length", lambda d: not 2 * d.n_words <= d.word_chars <= 16 * d.n_words),
    Rule("one_word", lambda d: d.n_words >= 20 and _most_common(d) > 0.3 * d.n_words),
    Rule("no_letters", lambda d: sum(any(c.isalpha() for c in w.decode("utf-8", "replace")) for w in d.words) < 0.6 * d.n_words),
)


def _measure(batches: Iterator[pd.DataFrame], rules: tuple[Rule, ...]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for i, rule in enumerate(rules):
            docs = [Document(t) for t in pdf["text"]]  # fresh ones: no rule profits from another's work
            began = time.perf_counter()
            rejected = sum(map(bool, map(rule.rejects, docs)))
            rows.append((i, time.perf_counter() - began, rejected, len(docs)))
        yield pd.DataFrame(rows, columns=["rule", "seconds", "rejected", "docs"])


def plan_cascade(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS,
                 fraction: float = 0.02, seed: int = 11) -> tuple[Rule, ...]:
    """The rules in the order of rejections per second on a sample of at most ``sample_rows`` documents.

    The sample is drawn from at most ``SAMPLE_FILES`` of the table's files, evenly spaced in their list, so the table is not read
    once more.  One row a rule comes to the driver.  With an empty sample the rules keep their given order.
    """
    files = sorted(docs.inputFiles())
    some = docs
    if len(files) > SAMPLE_FILES:
        try:
            some = docs.where(F.col("_metadata.file_path").isin(files[::-(-len(files) // SAMPLE_FILES)]))
        except AnalysisException:  # not the rows of files any more: an aggregate, say
            some = docs
    sample = some.select(F.col("text").cast("string").alias("text")).sample(fraction, seed).limit(sample_rows)
    found = (sample.mapInPandas(lambda it: _measure(it, rules), "rule int, seconds double, rejected long, docs long")
             .groupBy("rule").agg(F.sum("seconds").alias("seconds"), F.sum("rejected").alias("rejected")).collect())
    rate = {r["rule"]: r["rejected"] / max(r["seconds"], 1e-9) for r in found}
    return tuple(rules[i] for i in sorted(range(len(rules)), key=lambda i: (-rate.get(i, 0.0), i)))


def rejected_by(document: Document, cascade: tuple[Rule, ...]) -> str | None:
    """The name of the first rule that rejects; later rules are not looked at."""
    return next((r.name for r in cascade if r.rejects(document)), None)


def quality_report(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per document: base counts, ``base_failed`` and the cascade's verdict ``kept``."""
    cascade = plan_cascade(docs, rules, sample_rows)

    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                documents = [Document(t) for t in b.column("text").to_pylist()]
                columns = [pa.array([getattr(d, c) for d in documents], pa.int64()) for c in counts]
                failed = [bool(d.base_failed) for d in documents]
                kept = [not f and rejected_by(d, cascade) is None for d, f in zip(documents, failed)]
                # Ids stay the Arrow column they are: no number type changes on the way
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *columns, pa.array(failed), pa.array(kept)], ["doc_id", *counts, "base_failed", "kept"])

    doc_id = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        report, f"doc_id {doc_id}, {', '.join(f'{c} long' for c in counts)}, base_failed boolean, kept boolean")


def quality_filter(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents that no rule rejects, with all their columns."""
    cascade = plan_cascade(docs, rules, sample_rows)

    @F.pandas_udf("boolean")
    def keep(texts: pd.Series) -> pd.Series:
        return pd.Series([rejected_by(Document(t), cascade) is None for t in texts], dtype=bool)

    return docs.filter(keep(F.col("text").cast("string")))
