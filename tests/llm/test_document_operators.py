"""Each operator on documents against a brute-force version, on nulls, odd texts, ties, repeats, empty tables and extra columns."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from helpers import SPACES, corpus, documents, jaccard_components, odd_texts, quality_counts, random_text, repeated_bytes, tuples, words
from pyspark.sql import functions as F

from quadrant.llm import exact_dedup, licenses, mixing, ngram_join, packing, quality, suffix_dedup, token_output
from quadrant.llm.tokens import WordTokenizer, default_path

#: Names that the operators use themselves.
CLASHING = ["row", "key", "rank", "one", "hash", "hashes", "size", "before", "block", "n", "count", "_pid", "text_sha256", "cid", "label", "kept"]


@pytest.fixture(scope="module")
def tokenizer():
    return WordTokenizer(default_path())


def ids_of(tokenizer, text):
    return tokenizer.library.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def with_clashes(df):
    for c in CLASHING:
        df = df.withColumn(c, F.lit("x"))
    return df


# ---- exact dedup ----

def brute_copies(rows):
    groups = defaultdict(list)
    for i, (doc, text) in enumerate(rows):
        groups["".join(c for c in text or "" if c not in SPACES)].append((-len(text or ""), doc is None, doc or 0, i))
    out = []
    for normal, members in groups.items():
        best = min(members)
        for m in members:
            out.append((rows[m[3]][0], rows[best[3]][0], len(members), hashlib.sha256(normal.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_exact_dedup_matches_brute_force(spark):
    rows = corpus() + [(900, "same text"), (901, "same  text"), (902, "sametext"), (None, "sametext"), (903, "long one " * 900), (904, "long one" * 900)]
    got = exact_dedup.duplicate_groups(documents(spark, rows))
    assert tuples(got, "doc_id", "keep_id", "group_size", "text_sha256") == brute_copies(rows)
    assert got.filter("kept").select("text_sha256").distinct().count() == got.filter("kept").count() == got.select("text_sha256").distinct().count()


def test_exact_dedup_repeated_rows_keep_one(spark):
    got = exact_dedup.duplicate_groups(documents(spark, [(1, "a b"), (1, "a b"), (1, "ab"), (2, "c")])).collect()
    assert sorted((r.doc_id, r.group_size, r.kept) for r in got) == [(1, 3, False), (1, 3, False), (1, 3, True), (2, 1, True)]


def test_exact_dedup_tells_chunks_with_one_hash_apart(spark):
    staged = exact_dedup.recipes(documents(spark, [(1, "abc"), (2, "abd"), (3, "abc"), (4, "zz")]))
    clash = staged.withColumn("hashes", F.transform("hashes", lambda h: F.lit(7).cast("long")))  # every chunk collides
    named = exact_dedup.with_identifiers(clash).collect()
    by = {r.doc_id: (tuple(r.hashes), tuple(map(tuple, r.ranks))) for r in named}
    assert by[1] == by[3] and len({by[1], by[2], by[4]}) == 3


def test_chunks_are_cut_by_content_and_join_to_the_text(spark):
    rng = random.Random(1)
    text = "".join(rng.choice("abcdefghij") for _ in range(60000))
    rows = spark.createDataFrame([(text,), ("PREFIX" + text,), ("é" * 10000,)], "t string").select(F.col("t"), exact_dedup.chunks(F.col("t")).alias("c")).collect()
    assert all("".join(r.c) == r.t and max(map(len, r.c)) <= exact_dedup.MAX_CHARS for r in rows)
    assert len(set(rows[0].c) & set(rows[1].c)) > 0.8 * len(rows[0].c)


def test_drop_duplicates_keeps_columns_and_one_row_of_each(spark):
    rows = corpus()
    docs = with_clashes(documents(spark, rows))
    out = exact_dedup.drop_duplicates(docs)
    assert out.columns == docs.columns
    assert out.count() == len({"".join(c for c in t or "" if c not in SPACES) for _, t in rows})


# ---- mixing ----

def test_mixing_targets_and_budgets(spark):
    rng = random.Random(5)
    rows = [(i, random_text(rng, rng.randint(0, 50)), rng.choice(["a"] * 12 + ["b", "c", "d", None])) for i in range(300)] + [(400, None, "a"), (None, "x y", "b"), (7, "q r s", "z")]
    got = mixing.mix(documents(spark, rows)).collect()
    size = defaultdict(int)
    for _, t, s in rows:
        size[s] += len(words(t))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    target, free, left = {}, set(order), float(sum(size.values()))
    while True:  # share by weight, fix what is above three times its size, share the rest again
        level = left / sum(weight[s] for s in free)
        above = {s for s in free if weight[s] * level > 3 * size[s]}
        if not above:
            break
        for s in above:
            target[s] = 3.0 * size[s]
            left -= target[s]
        free -= above
    target.update({s: weight[s] * level for s in free})
    taken = defaultdict(int)
    for r in got:
        assert r.taken <= 3 * r.size and r.source_size == size[r.source] and r.target == pytest.approx(target[r.source])
        taken[r.source] += r.taken
    assert len(got) == len(rows) and all(abs(taken[s] - target[s]) <= 0.5 for s in order)
    again = mixing.mix(documents(spark, rows).repartition(5)).collect()
    assert Counter((r.doc_id, r.taken) for r in got) == Counter((r.doc_id, r.taken) for r in again)


def test_mixed_documents_hold_the_words_taken(spark):
    rng = random.Random(6)
    rows = [(i, random_text(rng, rng.randint(1, 30)), rng.choice("aaab")) for i in range(80)] + [(90, None, "a"), (91, " ", None)]
    docs = with_clashes(documents(spark, rows))
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    told = {r.doc_id: r.taken for r in mixing.mix(docs).collect() if r.taken}
    found = Counter()
    for r in out.collect():
        found[r.doc_id] += len(words(r.text))
        assert r.n_chars == len(r.text)
    assert dict(found) == told


# ---- rows numbered once ----

@pytest.mark.parametrize("module, use", [(exact_dedup, exact_dedup.drop_duplicates), (mixing, mixing.mixed_documents)])
def test_rows_stay_themselves_when_later_scans_are_split_otherwise(spark, tmp_path, monkeypatch, module, use):
    """As when an executor joins or is lost between two plans: the size of file splits changes after the first write."""
    spread = [(i, f"unlike {i} " * 40 if i % 3 else "the same text", "ab"[i % 2]) for i in range(600)]
    path = str(tmp_path / "docs")
    documents(spark, spread).coalesce(1).write.option("parquet.block.size", 4096).parquet(path)
    want = sorted(map(tuple, use(spark.read.parquet(path)).collect()), key=repr)
    before, write = spark.conf.get("spark.sql.files.maxPartitionBytes"), module.materialize
    sizes = iter(range(1, 100))

    def resplit(df, name="table"):
        out = write(df, name)
        spark.conf.set("spark.sql.files.maxPartitionBytes", f"{next(sizes)}k")
        return spark.read.parquet(out.inputFiles()[0].rsplit("/", 1)[0])

    monkeypatch.setattr(module, "materialize", resplit)
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "3k")
        got = use(spark.read.parquet(path))
        assert sorted(map(tuple, got.collect()), key=repr) == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


# ---- quality ----

def test_quality_counts_match_brute_force(spark):
    rows = corpus() + [(800, "a b c d e " * 10), (801, "x\nx\n x\n\n\nx"), (802, "### $$$ a|b <c> & % *")]
    got = {r.doc_id: r for r in quality.quality_report(documents(spark, rows)).collect()}
    for doc, text in rows:
        r = got[doc]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == quality_counts(text), doc
        assert not (r.base_failed and r.kept)
        assert r.kept == all(not rule.rejects(quality.Document(text)) for rule in quality.RULES)


def test_cascade_stops_at_the_first_rejection_and_order_never_changes_the_verdict(spark):
    calls = []
    rule = lambda name, says: quality.Rule(name, lambda d: calls.append(name) or says)
    assert quality.rejected_by(quality.Document("x"), (rule("a", False), rule("b", True), rule("c", True))) == "b" and calls == ["a", "b"]
    docs = documents(spark, corpus())
    one = quality.quality_filter(docs, quality.RULES).select("doc_id").collect()
    other = quality.quality_filter(docs, quality.RULES[::-1], sample_rows=1).select("doc_id").collect()
    assert sorted(one) == sorted(other)


def test_cascade_puts_cheap_rejecting_rules_first(spark):
    def slow(d):
        return sum(hash((d.text, i)) for i in range(20_000)) == 1
    rules = (quality.Rule("slow", slow), quality.Rule("short", lambda d: d.n_words < 50))
    docs = documents(spark, [(i, "a few words") for i in range(200)])
    assert [r.name for r in quality.plan_cascade(docs, rules, fraction=0.9)] == ["short", "slow"]


# ---- tokens: packing and files ----

def test_word_tokens_equal_the_library(tokenizer):
    rng = random.Random(2)
    alphabet = "aBé'sß<|>́\xa0 \n\t1²ʼ日🙂İΣ.,!"
    texts = odd_texts() + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 50))) for _ in range(800)]
    ids, stops = tokenizer.encode(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        assert ids[stops[i]:stops[i + 1]].tolist() == ids_of(tokenizer, t), repr(t)


def test_plan_packs_as_best_fit_decreasing_does():
    rng = random.Random(4)
    for _ in range(60):
        size = rng.choice([8, 16, 64])
        counts = {n: rng.randint(1, 40) for n in range(1, size + 1) if rng.random() < 0.5}
        placed, used = Counter(), defaultdict(list)
        for length, first, ranks, sequence, each, offset in packing.plan(counts, size):
            assert first == placed[length]
            placed[length] += ranks
            for r in range(ranks):
                used[sequence + r // each].append((offset + r % each * length, length))
        assert placed == Counter(counts)
        for parts in used.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= size
        room = []
        for length in sorted(Counter(counts).elements(), reverse=True):
            fits = [i for i, r in enumerate(room) if r >= length]
            if fits:
                room[min(fits, key=room.__getitem__)] -= length
            else:
                room.append(size - length)
        assert len(used) == len(room)


def test_packing_matches_brute_force(spark, tokenizer):
    rows = corpus(n=30) + [(500, "w1 " * 9000), (None, "no id"), (501, "twice"), (501, "twice")]
    got = packing.pack(with_clashes(documents(spark, rows)), size=256).collect()
    want = Counter()
    for doc, text in rows:
        ids = ids_of(tokenizer, text) + [0]
        for p, at in enumerate(range(0, len(ids), 256)):
            want[doc, p, at, len(ids[at:at + 256]), crc(ids[at:at + 256])] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    used = defaultdict(list)
    for r in got:
        used[r.sequence_id].append((r.offset, r.length))
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    assert len(used) <= 1.05 * -(-sum(r.length for r in got) // 256) + 1


def test_numbers_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 5, 1000):
        x = (rng.integers(0, 1 << 32, n, dtype=np.uint64) >> rng.integers(0, 32, n, dtype=np.uint64)).astype(np.uint32)
        control, data = token_output.encode_numbers(x)
        assert len(control) == -(-n // 4) and (token_output.decode_numbers(control, data, n) == x).all()


def test_token_files_round_trip(spark, tokenizer, tmp_path):
    rows = [r for r in corpus(n=30)][::-1] + [(None, "last"), (300, "tie"), (300, "tie")]
    token_output.write_token_files(with_clashes(documents(spark, rows).repartition(4)), str(tmp_path / "set"))
    got = token_output.read_token_files(spark, str(tmp_path / "set")).orderBy("start").collect()
    want, at = [], 0
    for doc, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")):
        ids = ids_of(tokenizer, text) + [1]
        want.append((doc, at, len(ids), crc(ids), ids))
        at += len(ids)
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32, r.ids) for r in got] == want
    ranks = [r.id for r in spark.read.parquet(str(tmp_path / "set/ranks")).orderBy("rank").collect()]
    seen = Counter(i for w in want for i in w[4])
    assert ranks == sorted(seen, key=lambda i: (-seen[i], i))


# ---- near copies ----

def test_ngram_join_matches_brute_force(spark):
    rows = corpus(n=80)
    got = ngram_join.near_duplicates(with_clashes(documents(spark, rows).repartition(3)))
    assert tuples(got, "doc_id", "n_shingles", "component_id") == sorted(jaccard_components(rows), key=repr)


def test_ngram_join_chains_and_crowds(spark):
    """A chain whose ends are unlike, a crowd of near copies, and many texts that share one passage."""
    rng = random.Random(8)
    start = random_text(rng, 60, 10**6).split()
    rows, w = [], list(start)
    for i in range(25):
        rows.append((1000 - i, " ".join(w)))
        w[(i * 7) % 60] = f"step{i}"
    crowd = random_text(rng, 80, 10**6).split()
    for i in range(60):
        v = list(crowd)
        v[rng.randrange(80)] = f"c{i}"
        v[rng.randrange(80)] = f"d{i}"
        rows.append((i, " ".join(v)))
    passage = random_text(rng, 40, 10**6)
    rows += [(200 + i, f"{random_text(rng, 20, 10**6)} {passage}") for i in range(30)] + [(None, " ".join(crowd)), (5, "one"), (6, "ONE")]
    got = ngram_join.near_duplicates(documents(spark, rows))
    assert tuples(got, "doc_id", "n_shingles", "component_id") == sorted(jaccard_components(rows), key=repr)


def test_ngram_join_leader_rounds_do_not_change_the_result(spark):
    rows = corpus(seed=9, n=50)
    sets = ngram_join.document_sets(documents(spark, rows))
    classes = sets.filter("shared IS NOT NULL").groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("min_doc"), F.first("shared").alias("shared"))
    classes = ngram_join.materialize(classes.withColumn("cid", F.monotonically_increasing_id()))
    some = {tuple(r) for r in ngram_join.linked(classes, most_rounds=0).collect()}
    more = {tuple(r) for r in ngram_join.linked(classes, most_rounds=5, slack=0).collect()}
    by = lambda labels: {frozenset(n for n, x in labels if x == y) for _, y in labels}
    assert by(some) == by(more) and some


def rows_joined(spark, monkeypatch, keys):
    """Row counts of the joins on ``keys``, gathered while the list is in use."""
    made, frame = [], type(spark.range(1))
    join = frame.join

    def counted(self, other, on=None, how=None):
        out = join(self, other, on, how)
        if on == keys:
            made.append(out.count())
        return out

    monkeypatch.setattr(frame, "join", counted)
    return made


def test_members_of_a_large_component_are_not_repeated_for_each_class_that_meets_it(spark, monkeypatch):
    """50 members of component 0 and 6 classes of their own share 10 shingles under both orders, two more only one order."""
    row = lambda k, t, cid, comp, pos=0: (k, t, cid, 100, pos, comp)
    rows = [row(k, t, cid, 0 if cid < 50 else cid) for k in (0, 1) for t in range(10) for cid in range(56)]
    rows += [row(0, t, 60, 60) for t in range(10)] + [row(1, t, 61, 61) for t in range(10)] + [row(0, 0, 62, 62, pos=20), row(1, 0, 62, 62)]
    lists = ngram_join.materialize(spark.createDataFrame(rows, "k byte, token long, cid long, n long, pos long, comp long"))
    made = rows_joined(spark, monkeypatch, ["token", "c1"])
    got = tuples(ngram_join.candidate_pairs(lists), "a", "b")
    comp = lambda c: 0 if c < 50 else c
    assert sorted(got) == [(a, b) for a in range(56) for b in range(a + 1, 56) if comp(a) != comp(b)]
    assert sum(made) <= 10 * 8 * 8  # classes and components that meet, on ten shingles: not times 50 members


def test_a_class_meets_a_few_leaders_of_each_list(spark, monkeypatch):
    """A group of near copies whose first shingles are all the same: rows grow with classes, by a few for each order."""
    firsts = spark.range(100).select(F.col("id").alias("cid"), F.lit(50).cast("long").alias("n"), F.array(*(F.lit(k).cast("long") for k in range(ngram_join.FIRSTS))).alias("firsts"))
    firsts = ngram_join.materialize(firsts)
    made = rows_joined(spark, monkeypatch, ["k", "token"])
    pairs = [ngram_join.leader_pairs(firsts, None, seed).count() for seed in (0, 1, 2)]
    assert pairs[0] == 99 and all(99 <= p <= 800 for p in pairs)
    assert sum(made) <= 100 * ngram_join.FIRSTS * 8


def test_one_of_each_keeps_the_smallest_ids(spark):
    rows = corpus(n=40)
    docs = with_clashes(documents(spark, rows))
    out = ngram_join.one_of_each(docs)
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == sorted({c for _, _, c in jaccard_components(rows)})


def test_one_of_each_with_ids_that_repeat_or_are_null(spark):
    rng = random.Random(21)
    near = lambda t: f"{t} more"
    a, b, c, d, e = (random_text(rng, 60, 10**6) for _ in range(5))
    rows = [(1, a), (2, near(a)), (2, b),  # id 2: a near copy of 1, and a text of its own
            (None, c), (None, near(c)), (None, c),  # near copies without ids
            (7, d), (None, near(d)), (7, d),  # the row with an id stays
            (None, e), (None, ""), (None, None), (5, "")]
    out = [(r.doc_id, r.text) for r in ngram_join.one_of_each(documents(spark, rows).repartition(3)).collect()]
    assert sorted((x for x in out if x[0] is not None or x[1] not in (c, near(c))), key=repr) == sorted([(1, a), (2, b), (7, d), (None, e), (None, ""), (None, None), (5, "")], key=repr)
    assert sum(x[1] in (c, near(c)) for x in out) == 1


# ---- repeated passages ----

def passages(seed=11):
    rng = random.Random(seed)
    letters = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    p, q = letters(260), letters(700)
    rows = [letters(rng.randint(0, 900)) for _ in range(12)]
    rows += [letters(100) + p + letters(150), letters(37) + p, p + letters(9), q, q[:450] + letters(50) + q[450:], q[100:299], q[100:300] if True else ""]
    rows += ["a" * 200, "a" * 201, "b" * 900, "xyz" * 200, letters(300) * 2, q + q, None, "", "é" * 300]
    return list(enumerate(rows))


def test_repeated_passages_match_brute_force(spark):
    rows = passages() + [(500, "r" * 10 + passages()[12][1]), (None, passages()[15][1])]
    got = suffix_dedup.remove_repeats(with_clashes(documents(spark, rows).repartition(4)))
    assert tuples(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(repeated_bytes(rows), key=repr)


def test_repeated_passages_by_window_counts_and_in_small_groups(spark, monkeypatch):
    rows = passages(12) + passages(13)
    monkeypatch.setattr(suffix_dedup, "MOST_SPANS", 1)
    got = suffix_dedup.remove_repeats(documents(spark, rows))
    assert tuples(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(repeated_bytes(rows), key=repr)


def test_run_length_index_gives_longest_matches():
    rng = random.Random(3)
    for _ in range(40):
        texts = list({bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 40))) for _ in range(rng.randint(1, 6))})
        index = suffix_dedup.RunLengthIndex(texts)
        got, at = index.statistics(), 0
        places = [(t, p) for t in texts for p in range(len(t))]
        for t in texts:
            for p in range(len(t)):
                best = 0
                for u, q in places:
                    if (u, q) != (t, p):
                        k = 0
                        while p + k < len(t) and q + k < len(u) and t[p + k] == u[q + k]:
                            k += 1
                        best = max(best, k)
                assert got[at + p] == best
            at += len(t) + 1
        assert len(index.head) == len(index.run_symbols) <= index.n


@pytest.mark.parametrize("module", [ngram_join, suffix_dedup])
@pytest.mark.parametrize("ranges", [16, 32])
def test_documents_of_two_blocks_never_meet_in_one_group(spark, monkeypatch, module, ranges):
    monkeypatch.setattr(module, "BLOCK_BYTES", 1 << 10)
    docs = documents(spark, corpus(n=80)).repartition(8).select("doc_id", F.col("doc_id").alias("row"), F.col("text") if module is ngram_join else F.col("text").cast("binary").alias("text"))
    own = docs.mapInArrow(lambda it: module._blocks(it, ranges), ngram_join.BLOB).filter("key < 0").groupBy("key").agg(F.count("*").alias("n"), F.countDistinct("block").alias("b")).collect()
    assert len(own) > 16 and all(r.n == r.b == 1 for r in own)


# ---- licenses ----

def brute_licenses(text, templates):
    def run(t):
        for c in licenses.PUNCTUATION:
            t = t.replace(c, " ")
        w = [x for x in words(t.lower())]
        return [" ".join(w[i:i + 5]) for i in range(len(w) - 4)]
    own, out = set(run(text or "")), set()
    for name, t in templates.items():
        if set(run(t)) <= own:
            out.add(name)
    return out


def test_licenses_are_found_wherever_they_stand(spark):
    rng = random.Random(7)
    names = list(licenses.TEMPLATES)
    rows = []
    for i in range(120):
        parts = [random_text(rng, rng.randint(0, 300))]
        for name in rng.sample(names, rng.randint(0, 2)):
            parts += [licenses.TEMPLATES[name].upper() if i % 3 == 0 else licenses.TEMPLATES[name].replace(" ", "\n ", 1), random_text(rng, rng.randint(0, 40))]
        rows.append((i, " ".join(parts)))
    rows += list(zip(range(300, 320), odd_texts()))
    got = defaultdict(set)
    for r in licenses.license_matches(with_clashes(documents(spark, rows))).collect():
        got[r.doc_id].add(r.license)
        assert r.containment >= 0.75
    for doc, text in rows:
        assert brute_licenses(text, licenses.TEMPLATES) <= got[doc], doc
    assert not any(got[i] for i in range(300, 320))


def test_a_license_with_a_changed_word_still_matches(spark):
    t = licenses.TEMPLATES["MIT-permission"].replace("dealings", "use").replace("charge", "cost")
    got = licenses.license_matches(documents(spark, [(1, f"before it {t} after it"), (2, "released under the terms of some license")])).collect()
    assert [(r.doc_id, r.license) for r in got] == [(1, "MIT-permission")] and got[0].containment < 1


def test_wrapped_headers_in_comments_are_found(spark):
    """Every notice as source files have it: wrapped, with comment marks on each line, spaced or not."""
    import textwrap
    rows, want = [], set()
    for i, (name, t) in enumerate(sorted(licenses.TEMPLATES.items())):
        for j, (first, mark, last) in enumerate([("/*\n", " * ", "\n */"), ("", "# ", ""), ("", "//", ""), ("/*", "", "*/"), ("", "-- ", ""), ("<!--", "  ~ ", "-->"), ("", ";; ", "")]):
            lines = "\n".join(mark + x for x in textwrap.wrap(t, 60, break_long_words=False, break_on_hyphens=False))
            rows.append((100 * i + j, f"{first}{lines}{last}\nint main(void) {{ return 0; }}"))
            want.add((100 * i + j, name, 1.0))
    got = licenses.license_matches(documents(spark, rows)).collect()
    assert {(r.doc_id, r.license, r.containment) for r in got} == want


def test_licenses_of_one_family_are_told_apart(spark):
    t = licenses.TEMPLATES
    rows = [(1, t["AGPL-header"]), (2, t["LGPL-header"]), (3, t["GPL-header"]), (4, t["GPL-header"].replace("version 3", "version 2")), (5, t["LGPL-header"].replace("library", "program")),
            (6, t["CC-BY-SA-4.0"]), (7, t["CC-BY-4.0"]), (8, t["GPL-header"] + " and " + t["AGPL-header"]), (9, "* / # -- " * 40)]
    got = sorted((r.doc_id, r.license) for r in licenses.license_matches(documents(spark, rows)).collect())
    assert got == [(1, "AGPL-header"), (2, "LGPL-header"), (3, "GPL-header"), (4, "GPL-header"), (5, "LGPL-header"), (6, "CC-BY-SA-4.0"), (7, "CC-BY-4.0"), (8, "AGPL-header"), (8, "GPL-header")]


# ---- empty tables ----

@pytest.mark.parametrize("use", [
    lambda d: exact_dedup.duplicate_groups(d), lambda d: exact_dedup.drop_duplicates(d), lambda d: mixing.mix(d), lambda d: mixing.mixed_documents(d), lambda d: quality.quality_report(d),
    lambda d: quality.quality_filter(d), lambda d: packing.pack(d), lambda d: token_output.token_files(d), lambda d: ngram_join.near_duplicates(d),
    lambda d: ngram_join.one_of_each(d), lambda d: suffix_dedup.remove_repeats(d), lambda d: licenses.license_matches(d)])
def test_empty_table(spark, use):
    assert use(documents(spark, [])).collect() == []


@pytest.mark.parametrize("use", [
    lambda d: exact_dedup.duplicate_groups(d), lambda d: mixing.mix(d), lambda d: quality.quality_report(d), lambda d: packing.pack(d), lambda d: token_output.token_files(d),
    lambda d: ngram_join.near_duplicates(d), lambda d: suffix_dedup.remove_repeats(d)])
def test_nulls_in_every_column(spark, use):
    rows = [(None, None, None, None, None), (None, None, None, None, None), (1, None, None, None, None), (2, "", "en", None, 0)]
    assert use(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).count() == 4
