"""Token ids of whole texts, with each distinct word encoded once per worker.

The vocabulary's tokenizer never joins characters across white space, so a text's ids are its
words' ids one after another.  A batch is split into words and dictionary-encoded
by Arrow; the tokenizers library sees only distinct words that the worker's bounded
cache does not hold.  Words of plain Latin-1 characters go to the library's
BPE model directly, all others through its whole pipeline.

These short cuts follow the rules that the vocabulary's file states (``RULES``).  A file with other rules is encoded by the
library alone, whole texts at a time.
"""

from __future__ import annotations

import json
import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

VOCABULARY = "word_bpe_49k.json"
#: Words, and pieces of words, a worker remembers (some 40 MB at most).
CACHE_WORDS = 100_000
# The rules of the vocabulary that the short cuts are written for.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": PIECES}, "behavior": "Removed", "invert": True},
                                                            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
}
#: Characters that follow a word as one piece.
TAIL = ".,;:!?*#$%&|"
#: Bytes of text that are turned into ids at once.
SLICE_BYTES = 12 << 20


def default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path(VOCABULARY)


class Recent:
    """A bounded cache in two halves: when the newer is full the older is dropped, and what is used moves to the newer."""

    def __init__(self, most: int):
        self.half = most // 2
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def get(self, key: str, make: Callable[[str], bytes]) -> bytes:
        found = self.new.get(key)
        if found is None:
            found = self.old.get(key)
            if found is None:
                found = make(key)
            if len(key) <= 64:
                if len(self.new) >= self.half:
                    self.old, self.new = self.new, {}
                self.new[key] = found
        return found


class WordTokenizer:
    def __init__(self, path: str):
        import os

        import regex
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the executor's other cores run other tasks
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            stated = json.load(f)
        self.by_words = all(stated.get(k) == v for k, v in RULES.items())
        self.tokenize = self.library.model.tokenize
        self.known_words, self.known_pieces = Recent(CACHE_WORDS), Recent(CACHE_WORDS)
        self.as_bytes = [i.to_bytes(4, "little") for i in range(self.library.get_vocab_size())]
        # Visible ASCII and the upper half of Latin-1: no normal form or case rule looks past one such character.
        self.plain = regex.compile("[\x21-\x7e\xa1-\xac\xae-\xff]*").fullmatch
        self.pieces = regex.compile(PIECES).findall
        self.latin = str.maketrans({chr(c): "".join(map(self._byte, chr(c).encode())) for c in range(0xA1, 0x100)})

    @staticmethod
    def _byte(b: int) -> str:
        """The character that stands for a byte in byte-level vocabularies: itself if visible, else one from U+0100 on."""
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        return chr(b) if b in shown else chr(0x100 + [x for x in range(0x100) if x not in shown].index(b))

    def piece(self, p: str) -> bytes:
        """Ids of one lower-case piece that the vocabulary's pattern cuts out."""
        table = self.as_bytes
        return b"".join([table[t.id] for t in self.tokenize(p if p.isascii() else p.translate(self.latin))])

    def word(self, w: str) -> bytes:
        get, piece = self.known_pieces.get, self.piece
        letters = w.rstrip(TAIL)  # most words are letters and what follows them
        if letters.isalpha() and (letters.isascii() or self.plain(letters)):
            ids = get(letters.lower(), piece)
            return ids if len(letters) == len(w) else ids + get(w[len(letters):], piece)
        if self.plain(w) and "<|" not in w:
            return b"".join([get(p, piece) for p in self.pieces(w.lower())])
        return b"".join([self.as_bytes[i] for i in self.library.encode(w, add_special_tokens=False).ids])

    def distinct(self, words: list[str]) -> list[bytes]:
        get, word = self.known_words.get, self.word
        return [get(w, word) for w in words]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids (uint32) and where each text's begin (one more than texts)."""
        if not self.by_words:
            found = [e.ids for e in self.library.encode_batch(pc.fill_null(texts, "").to_pylist(), add_special_tokens=False)]
            return np.array([i for ids in found for i in ids], np.uint32), np.concatenate([[0], np.cumsum([len(ids) for ids in found], dtype=np.int64)])
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        ends = np.concatenate([[0], np.cumsum(split.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)])
        coded = split.flatten().dictionary_encode()
        ids = self.distinct(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        index = coded.indices.to_numpy(zero_copy_only=False)
        size = np.fromiter((len(x) // 4 for x in ids), np.int64, len(ids))
        first = np.cumsum(size) - size
        flat = np.frombuffer(b"".join(ids), np.uint32)
        per_word = size[index]
        stop = np.concatenate([[0], np.cumsum(per_word)])
        at = np.repeat(first[index] - stop[:-1], per_word)
        at += np.arange(stop[-1])
        return flat[at], stop[ends]


def tokenizer(path: str) -> WordTokenizer:
    """The worker's own, kept between tasks."""
    held = sys.modules.setdefault("_quadrant_tokenizers", types.ModuleType("_quadrant_tokenizers"))
    if path not in held.__dict__:
        held.__dict__[path] = WordTokenizer(path)
    return held.__dict__[path]


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of some ``most`` bytes of text: at least one row each, every row once."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    group = (np.cumsum(size) - size) // most
    starts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(group)]
    for a, b in zip(starts, starts[1:]):
        if b > a:
            yield batch.slice(a, b - a)
