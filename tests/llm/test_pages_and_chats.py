"""HTML extraction on held-out layouts and preference formatting against brute force."""

import random

from pyspark.sql import functions as F

from quadrant.llm import chat, html_extract

PAGES = "page_id long, url string, html string"


def texts(spark, htmls):
    got = html_extract.extract_text(spark.createDataFrame([(i, None, h) for i, h in enumerate(htmls)], PAGES)).orderBy("page_id").collect()
    assert all(r.n_chars == len(r.text) for r in got)
    return [r.text for r in got]


def test_layouts_that_are_not_among_the_labelled_ones(spark):
    nav, foot = '<nav class="top-nav"><a href="/">x</a> <a href="/y">y</a></nav>', '<footer id="page-foot">&copy; all</footer>'
    body = "<h1>T &amp; U</h1>\n<p>one\n  two <b>bold</b><br>three<p>Four."
    want = "T & U\n\none two bold three\n\nFour."
    assert texts(spark, [
        f"<html><body>{nav}<article>{body}</article>{foot}", f"<body>{nav}<main>{body}</main><aside>other things</aside>{foot}</body>",
        f"<div id='wrapper'>{nav}<div class='post-content'>{body}</div><div class='widget-sidebar'><p>no</p></div>{foot}</div>",
        f"<article>{body}<div class='ad-slot'>buy</div><form><label>mail</label></form></article><section id='comments'><p>so I think</p></section>",
        f"{nav}<div class='cookie-consent'>we set cookies</div><article><script>var t='</p>';</script><style>p{{}}</style>{body}</article>"]) == [want] * 5


def test_odd_pages(spark):
    assert texts(spark, [None, "", "   ", "<", "<article", "<article><p>a < b &lt;c&gt; &nbsp; d &#233;&eacute;</article>", "<article><p>" + "w " * 50000,
                         "<article>" + "<div>" * 12 + "<p>deep", "<article><p>é\x85x</p></article>"]) == [
        "", "", "", "", "", "a < b <c> d éé", ("w " * 50000).strip(), "deep", "é x"]


def test_a_head_without_end_tag_ends_where_its_page_begins(spark):
    head = "<!doctype html><html><head><meta charset=utf-8><title>T</title><script>var a='<p>';</script><noscript><img src=x><p>no</p></noscript><link rel=x href=y>\n"
    got = texts(spark, [head + "<body><article><p>one</article>", head + "<article><p>one</article>", head + "<html><head><main>one</main>",
                        head + "</head><body><article>one</article>", head + "<style>p{}</style>", "<head><title>T</title></head><article>one<head><title>U</title></article>",
                        head + "<svg><text>no</text></svg><article>one"])
    assert got == ["one"] * 4 + ["", "one", "one"]
    for end in ("one", "</body>one", "</html>one", "<br>one"):  # whatever the model thinks of a page without elements
        assert "".join(x for _, parts in html_extract.parse(head + end).blocks for x in parts).strip() == "one"


def test_formulas_are_read(spark):
    tex = '<annotation encoding="application/x-tex">x^2=4</annotation>'
    got = texts(spark, [
        f"<article><p>Let <math><semantics><mrow><msup><mi>x</mi><mn>2</mn></msup><mspace/><mo>=</mo><mn>4</mn></mrow>{tex}</semantics></math> hold.</p><p>So.</p></article>",
        "<article><p>Let <math display=block><mi>y</mi></math></p><p>So.</article>", "<article><p>a <math><mi/><annotation/><mi>z</mi><p>So.</article>",
        "<article><p>a <math><mi>z<semantics><annotation>no<p>So.</article>"])
    assert got == ["Let x2=4 hold.\n\nSo.", "Let y\n\nSo.", "a z\n\nSo.", "a z\n\nSo."]


def test_marginals_equal_summing_over_all_states():
    model = html_extract.Model(html_extract.labelled_pages())
    page = html_extract.parse("<body><nav><ul><li><a href=x>x</a></ul></nav><div class=content><p>a<p>b</div></body>")
    nodes = page.nodes
    total, content = 0.0, [0.0] * len(nodes)
    for bits in range(1 << len(nodes)):
        state = {id(n): bits >> i & 1 for i, n in enumerate(nodes)}
        score = -20.0 * state[id(nodes[0])]
        for n in nodes:
            score += sum(model.own.get(f, (0, 0))[state[id(n)]] for f in html_extract.looks(n))
            if n.parent:
                score += model.edge.get(html_extract.meets(n), model.any_edge)[state[id(n.parent)]][state[id(n)]]
        p = 2.718281828459045 ** score
        total += p
        for i, n in enumerate(nodes):
            content[i] += p * state[id(n)]
    found = model.marginals(page)
    assert all(abs(found[id(n)] - content[i] / total) < 1e-9 for i, n in enumerate(nodes))


def test_held_out_accuracy_on_labelled_pages():
    pages = list(html_extract.labelled_pages())
    random.Random(1).shuffle(pages)
    half = len(pages) // 2
    model = html_extract.Model(pages[:half])
    right = total = 0
    for html in pages[half:]:
        page = html_extract.parse(html)
        for node in page.nodes:
            own = node.attrs.get("data-label")
            node.label = int(own == "content") if own else node.parent.label if node.parent else 0
        found = model.marginals(page)
        for node, _ in page.blocks:
            right += (found[id(node)] >= 0.5) == bool(node.label)
            total += 1
    assert right > 0.9 * total


def test_the_bound_on_labelled_pages_holds():
    seen = []
    html_extract.Model((seen.append(i) or p for i, p in enumerate(html_extract.labelled_pages())), most=5)
    assert len(seen) <= 6


def test_pages_empty_table_repeats_and_extra_columns(spark):
    assert html_extract.extract_text(spark.createDataFrame([], PAGES)).collect() == []
    df = spark.createDataFrame([(1, "u", "<article>a</article>")] * 2 + [(None, None, None)], PAGES).withColumn("text", F.lit("x")).withColumn("n_chars", F.lit(1))
    assert sorted((r.page_id or 0, r.text) for r in html_extract.extract_text(df).collect()) == [(0, ""), (1, "a"), (1, "a")]


TURNS = "conv_id long, turn long, role string, text string"


def brute_pairs(rows):
    convs = {}
    for conv, turn, role, text in set(rows):
        if conv is not None:
            convs.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = []
    for conv in convs:
        if conv % 2 == 0 and conv + 1 in convs:
            a, b = sorted(convs[conv]), sorted(convs[conv + 1])
            n = 0
            while n < min(len(a), len(b)) and a[n][2:] == b[n][2:]:
                n += 1
            show = lambda ts: "".join(f"<|{t[2]}|>\n{t[3]}\n" for t in ts)
            flags = lambda ts: "".join("01"[t[2] == "assistant"] for t in ts)
            out.append((conv // 2, n, show(a[:n]), show(a[n:]), show(b[n:]), flags(a[n:]), flags(b[n:])))
    return sorted(out)


def test_preference_rows_match_brute_force(spark):
    rng = random.Random(2)
    rows = []
    for conv in range(60):
        for turn in range(rng.randint(0, 6)):
            rows.append((conv, turn, "user" if turn % 2 == 0 else "assistant", rng.choice("ab")))
    rows += [(None, 0, "user", "x"), (100, 0, None, None), (101, None, None, ""), (102, 0, "user", "q"), (103, 0, "user", "q"), (103, 0, "user", "q"),
             (104, 1, "user", "b"), (104, 1, "user", "a"), (105, 1, "user", "a"), (106, 0, "system", "alone")]
    df = spark.createDataFrame(rows, TURNS).withColumn("turns", F.lit(1)).withColumn("a", F.lit(1)).withColumn("pair_id", F.lit(9))
    got = chat.preference_rows(df, chat.neighbour_pairs(df))
    found = sorted(tuple(r) for r in got.select("pair_id", "n_common", "prompt", "chosen", "rejected", chat.mask(F.col("chosen_segments")), chat.mask(F.col("rejected_segments"))).collect())
    assert found == brute_pairs(rows)
    one = got.first()
    assert "".join(s.text for s in one.chosen_segments) == one.chosen


def test_swapped_replies_match_brute_force(spark):
    rng = random.Random(4)
    rows = [(conv, turn, "user" if turn % 2 == 0 else "assistant", rng.choice("abcd")) for conv in range(50) if conv % 9 for turn in range(rng.randint(1, 6))]
    rows += [(None, 0, "user", "x"), (100, 0, None, None), (101, 3, "assistant", "one"), (101, None, "user", "first"), (2**53, 0, "user", "p"), (2**53 + 1, 0, "user", "q"), (100, 0, None, None)]
    convs = {}
    for conv, turn, role, text in set(rows):
        if conv is not None:
            convs.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    show = lambda ts: "".join(f"<|{t[2]}|>\n{t[3]}\n" for t in ts)
    want = []
    for conv, turns in convs.items():
        a = sorted(turns)
        other = sorted(convs.get(conv + 1, []))[-1:]
        n = len(a) - (not (other and other[0][2:] == a[-1][2:]))
        want.append((conv, n, show(a[:n]), show(a[n:]), show(other) if n < len(a) else ""))
    df = spark.createDataFrame(rows, TURNS).withColumn("a", F.lit(1)).withColumn("turns", F.lit("x")).withColumn("_reply", F.lit(2))
    got = chat.swapped_reply_rows(df).select("pair_id", "n_common", "prompt", "chosen", "rejected").collect()
    assert sorted(map(tuple, got)) == sorted(want) and sum(r.n_common > 0 for r in got) > len(got) / 2
    assert chat.swapped_reply_rows(df.limit(0)).collect() == []
    plan = chat.swapped_reply_rows(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "InArrow" not in plan


def test_preference_rows_of_an_empty_table(spark):
    df = spark.createDataFrame([], TURNS)
    assert chat.preference_rows(df, chat.neighbour_pairs(df)).collect() == []


def test_native_operators_run_no_python(spark):
    from helpers import documents

    from quadrant.llm import exact_dedup, licenses
    turns = spark.createDataFrame([(0, 0, "user", "x"), (1, 0, "user", "y")], TURNS)
    docs = documents(spark, [(1, "a"), (2, "b")])
    for df in (chat.preference_rows(turns, chat.neighbour_pairs(turns)), exact_dedup.duplicate_groups(docs), licenses.license_matches(docs)):
        plan = df._jdf.queryExecution().toString()
        assert "Python" not in plan and "Pandas" not in plan and "InArrow" not in plan
