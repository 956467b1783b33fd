"""Fill-in-the-middle transformation of documents (operator 11).

A text is cut at two unit boundaries into prefix, middle and suffix, which are put in another order
between markers.  Every code point has one of six character classes; a wavelet matrix over the classes of a batch
of texts counts each class in any range, the classes that end a unit add up to boundary counts, and
each cut is found by bisection on these counts, for all texts of the batch at once.  Only the
places of the cuts come from Python; digests, cutting and joining are built-in functions, so text passes to the
workers and never back.

Units: ``token`` is white space followed by a word, or white space that ends the text; ``line`` is a line with
its line feed; ``char`` is a code point.

Defined results: NULL text counts as empty and stays plain, as does a text that contains a marker.  A NULL doc_id is
hashed as the text ``null``.  Repeated rows give repeated results.  An empty table gives an empty result.  Columns other than
doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .wavelet import WaveletMatrix

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
WORD, WORD_END, WORD_LAST, SPACE, LINE_END, SPACE_LAST = range(6)
LEVELS = 3
#: The classes whose last character is the end of a unit.
ENDS = {"token": (WORD_END, WORD_LAST, SPACE_LAST), "line": (WORD_LAST, LINE_END, SPACE_LAST), "char": tuple(range(6))}
#: Bytes of text whose classes share a wavelet matrix; a longer text has one of its own.
SLICE_BYTES = 1 << 20


def classes(points: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """The class of each code point of texts that lie one after another, text i up to ``stops[i]``."""
    white = (points == 0x20) | ((points >= 0x09) & (points <= 0x0D))
    last = np.zeros(len(points), bool)
    last[stops[stops > 0] - 1] = True
    white_next = np.empty(len(points), bool)
    white_next[:-1] = white[1:]
    white_next[-1:] = False
    word = np.where(last, WORD_LAST, np.where(white_next, WORD_END, WORD))
    space = np.where(last, SPACE_LAST, np.where(points == 0x0A, LINE_END, SPACE))
    return np.where(white, space, word).astype(np.uint8)


def bisect(boundaries: Callable[[np.ndarray], np.ndarray], starts: np.ndarray, stops: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Per text the fewest code points that hold ``wanted`` boundaries."""
    base = boundaries(starts)
    low, high = starts.copy(), stops.copy()
    while (low < high).any():
        half = (low + high) >> 1
        enough = boundaries(half) - base >= wanted
        high = np.where(enough, half, high)
        low = np.where(enough, low, np.minimum(half + 1, high))
    return low - starts


def cut_places(texts: list[str], first: np.ndarray, second: np.ndarray, unit: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Units of each text, and code points before the middle and in it; ``first`` and ``second`` are the two draws."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    stops = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
    starts = np.concatenate([[0], stops[:-1]])
    matrix = WaveletMatrix(classes(points, stops), LEVELS)

    def boundaries(at: np.ndarray) -> np.ndarray:
        return sum(matrix.rank(symbol, at) for symbol in ENDS[unit])

    n = boundaries(stops) - boundaries(starts)
    one, two = first % (n + 1), second % (n + 1)
    begin = bisect(boundaries, starts, stops, np.minimum(one, two))
    end = bisect(boundaries, starts, stops, np.maximum(one, two))
    return n, begin, end - begin


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    size = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    group = (np.cumsum(size) - size) // SLICE_BYTES
    edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(group)]
    return ((a, b) for a, b in zip(edges, edges[1:]) if b > a)


def cuts(unit: str = "token") -> Callable[..., Column]:
    """An Arrow function of (text, draw, draw): the struct ``n, prefix_chars, middle_chars``."""
    if unit not in ENDS:
        raise ValueError(f"unknown unit {unit!r}; expected one of {sorted(ENDS)}")

    @F.arrow_udf("n long, prefix_chars long, middle_chars long")
    def place(text: pa.Array, first: pa.Array, second: pa.Array) -> pa.Array:
        parts = [(np.zeros(0, np.int64),) * 3]
        one, two = (a.to_numpy(zero_copy_only=False) for a in (first, second))
        for a, b in _slices(text):
            parts.append(cut_places(text.slice(a, b - a).to_pylist(), one[a:b], two[a:b], unit))
        return pa.StructArray.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in zip(*parts)], ["n", "prefix_chars", "middle_chars"])

    return place


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four numbers below 2^32 that depend on the seed and the document's id only."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def restore(output: Column, form: Column) -> Column:
    """The exact text that an output of the given form was made from."""
    part = lambda text, after, before: F.substring_index(F.substring_index(text, after, -1), before, 1)
    psm = F.concat(part(output, PREFIX, SUFFIX), F.substring_index(output, MIDDLE, -1), part(output, SUFFIX, MIDDLE))
    spm = F.concat(part(output, PREFIX, MIDDLE), F.substring_index(output, MIDDLE, -1), part(output, SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def fill_in_middle(docs: DataFrame, seed: int = 42, fim_percent: int = 50, spm_percent: int = 80, unit: str = "token") -> DataFrame:
    """One row per document: doc_id, n (units), form, prefix_chars, middle_chars and the whole output.

    ``fim_percent`` of the texts are cut, of these ``spm_percent`` in the order suffix, prefix, middle.
    """
    base = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    h1, h2, h3, h4 = draws(F.col("doc_id"), seed)
    marked = F.lit(False)
    for marker in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains("text", F.lit(marker))
    plain = (F.col("text") == "") | marked | (h3 % 100 >= fim_percent)
    form = F.when(plain, "plain").when(h4 % 100 < spm_percent, "spm").otherwise("psm")
    told = base.withColumn("form", form).withColumn("cut", cuts(unit)(F.col("text"), h1, h2))
    at = F.col("cut.prefix_chars").cast("int")
    size = F.col("cut.middle_chars").cast("int")
    prefix = F.substring("text", F.lit(1), at)
    middle = F.substring("text", at + 1, size)
    suffix = F.substring("text", at + size + 1, F.length("text"))
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    cut = F.col("form") != "plain"
    return told.select(
        "doc_id", F.col("cut.n").alias("n"), "form", F.when(cut, F.col("cut.prefix_chars")).alias("prefix_chars"),
        F.when(cut, F.col("cut.middle_chars")).alias("middle_chars"),
        F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("text")).alias("output"))


def fill_in_middle_digests(docs: DataFrame) -> DataFrame:
    """Outputs and the texts rebuilt from them, as digests."""
    rows = fill_in_middle(docs)
    rebuilt = restore(F.col("output"), F.col("form"))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(rebuilt, 256).alias("restored_sha256"))
