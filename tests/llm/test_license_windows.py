"""The license scan against every window of every template, both ways, and on texts full of notices."""

import random
import time

from helpers import corpus, documents, odd_texts, random_text, words

from quadrant.llm import licenses
from quadrant.llm.licenses import BLOCK_WORDS, CONTAINMENT, NAMES, TEMPLATES, license_matches


def plain_words(text):
    import regex
    return [w for w in regex.split(r"[^\p{L}\p{M}\p{N}]+", (text or "").lower()) if w]


def runs(w):
    return [" ".join(w[i:i + 5]) for i in range(len(w) - 4)]


def brute(rows, templates=TEMPLATES, names=NAMES):
    """Of all windows of a template's length and step, the first of those that hold most of it."""
    out = set()
    for doc, text in rows:
        w = plain_words(text)
        own = runs(w)
        for name, notice in templates.items():
            want = set(runs(plain_words(notice)))
            if not want or not want & set(own):
                continue
            m = len(want)
            step = max(1, m // 4)
            size = m + step - 1 + m // 4
            best = (0.0, 0)
            for at in range(0, len(own), step):
                inside = set(own[at:at + size]) & want
                if name in names and names[name].lower() not in inside:
                    continue
                best = max(best, (len(inside) / m, -at))
            if best[0] >= CONTAINMENT:
                at = -best[1]
                out.add((doc, name, best[0], at, " ".join(w[at:at + size + 4])))
    return out


def found(df):
    return {(r.doc_id, r.license, r.containment, r.first_word, r.matched) for r in df.collect()}


def test_rows_equal_all_windows(spark):
    rng = random.Random(17)
    rows = []
    for i in range(60):
        parts = [random_text(rng, rng.randint(0, 300))]
        for name in rng.sample(sorted(TEMPLATES), rng.randint(0, 3)):
            w = TEMPLATES[name].split()
            for _ in range(rng.randint(0, len(w) // 12)):
                w[rng.randrange(len(w))] = rng.choice(["changed", "words", w[rng.randrange(len(w))]])
            parts += [" ".join(w), random_text(rng, rng.randint(0, 30))]
        rows.append((i, " ".join(parts)))
    # Notices that lie across the border of two blocks
    rows += [(100 + i, random_text(rng, BLOCK_WORDS - 40 + 7 * i) + " " + TEMPLATES["MIT-permission"] + " " + TEMPLATES["GPL-header"]) for i in range(8)]
    rows += [(200 + i, t) for i, t in enumerate(odd_texts())] + [(300 + d, t) for d, t in corpus(n=20)]
    got = license_matches(documents(spark, rows)).collect()
    assert {(r.doc_id, r.license, r.containment, r.first_word, r.matched) for r in got} == brute(rows) and len(got) == len(brute(rows)) > 40


def test_a_text_full_of_notices(spark):
    """20,000 notices in one text: what leaves the row is a window, never the text."""
    text = "Released under the MIT License. " * 20_000 + TEMPLATES["Apache-header" if "Apache-header" in TEMPLATES else sorted(TEMPLATES)[0]]
    began = time.time()
    got = found(license_matches(documents(spark, [(1, text)])))
    assert {r[1] for r in got} >= {"MIT"} and time.time() - began < 240
    assert (1, "MIT", 1.0, 0, "released under the mit license") in got


def test_nulls_repeats_and_large_ids(spark):
    rows = [(None, None), (None, TEMPLATES["MIT"]), (2**53 + 1, TEMPLATES["MIT"]), (2**53 + 1, TEMPLATES["MIT"]), (3, ""), (4, None)]
    got = sorted(((r.doc_id, r.license) for r in license_matches(documents(spark, rows)).collect()), key=repr)
    assert got == [(2**53 + 1, "MIT"), (2**53 + 1, "MIT"), (None, "MIT")]
    odd = documents(spark, rows).selectExpr("doc_id", "text", "1 AS s", "2 AS w", "3 AS b", "4 AS hits", "5 AS first", "6 AS row")
    assert license_matches(odd).count() == 3


def test_no_array_of_a_text_leaves_its_row(spark):
    plan = license_matches(documents(spark, [(1, "x")]))._jdf.queryExecution().optimizedPlan().toString()
    carried = [line for line in plan.splitlines() if "Generate explode" in line]
    assert len(carried) == 2 and words(plan) and all(licenses.__name__ for _ in carried)
    assert "BatchEvalPython" not in plan and "Join" not in plan
