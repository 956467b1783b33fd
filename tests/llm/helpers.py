"""Small tables and brute-force versions that the tests of the training-data operators share."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SPACES = " \t\n\x0b\x0c\r"


def documents(spark, rows, schema=DOCS):
    """``rows`` are (doc_id, text) or (doc_id, text, source)."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in rows]
    return spark.createDataFrame(full, schema)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def odd_texts():
    """Empty, white, short, long, tied and unusual texts."""
    return [None, "", " \n\t ", "one", "a b c d", "x " * 3000, "é" * 500, "日本語 " * 40, "\x1c\x85 nbsp\xa0end", "<|endoftext|> it's don't", "A" * 5000, "a\n\nb\n\na"]


def random_text(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def corpus(seed=3, n=60):
    """Random texts with exact copies, near copies and shared passages, and odd ones."""
    rng = random.Random(seed)
    base = [random_text(rng, rng.randint(1, 160)) for _ in range(n)]
    passage = random_text(rng, 70)
    out = list(base)
    out += [base[i].replace(" ", "  ", 3) for i in range(0, n, 7)]
    for i in range(0, n, 5):
        w = base[i].split()
        w[rng.randrange(len(w))] = "changed"
        out.append(" ".join(w))
    out += [f"{random_text(rng, 12)} {passage} {random_text(rng, 15)}" for _ in range(6)]
    return [(i, t) for i, t in enumerate(out + odd_texts())]


def jaccard_components(rows):
    """doc_id -> (set size, smallest id reachable by links), all pairs compared."""
    sets = []
    for _, text in rows:
        w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    smallest = defaultdict(lambda: None)
    for i, (doc, _) in enumerate(rows):
        r = find(i)
        if doc is not None and (smallest[r] is None or doc < smallest[r]):
            smallest[r] = doc
    return [(doc, len(sets[i]), smallest[find(i)]) for i, (doc, _) in enumerate(rows)]


def repeated_bytes(rows, length=200):
    """doc_id, bytes, removed, runs and digest of what stays, every window counted."""
    raw = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[p:p + length] for _, b in raw for p in range(len(b) - length + 1))
    out = []
    for doc, b in raw:
        gone, upto = bytearray(len(b)), 0
        for p in range(len(b) - length + 1):
            if seen[b[p:p + length]] > 1:
                for x in range(max(p, upto), p + length):
                    gone[x] = 1
                upto = p + length
        runs = sum(1 for x in range(len(b)) if gone[x] and (x == 0 or not gone[x - 1]))
        out.append((doc, len(b), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return out


def quality_counts(text):
    w = words(text)
    windows = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    seen = Counter(windows)
    marked = set()
    for i, x in enumerate(windows):
        if seen[x] > 1:
            marked |= set(range(i, i + 5))
    lines, earlier, dup = (text or "").split("\n"), set(), 0
    for line in lines:
        if words(line):
            dup += line in earlier
            earlier.add(line)
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(w), sum(map(len, w)), symbols, dup, len(marked), len(w) < 10 or 100 * len(marked) > 20 * len(w)


def tuples(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)
