"""Operators against brute-force versions and planted cases."""

import hashlib
import random
import re
import statistics

import brute
import numpy as np
from pyspark.sql import functions as F

import __spark_entry__
from gaugework.llm import chat_format, common, fingerprint, html_text, line_dedup, mixing, near_vectors, ngram_join, surrogates, toxicity

SF = "/root/testdata/sf0.01"


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_components(spark):
    random.seed(5)
    edges = [(random.randrange(400), random.randrange(400)) for _ in range(300)] + [(1000 + k, 1001 + k) for k in range(60)] + [(7, 7), (None, 3)]
    links = brute.Links()
    for a, b in edges:
        if a is not None and a != b:
            links.join(a, b)
    got = {r.id: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: links.find(x) for x in links.up}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_links_that_come_in_turns(spark):
    random.seed(6)
    edges = [(random.randrange(300), random.randrange(300)) for _ in range(240)] + [(1001 + k, 1000 + k) for k in range(40)]
    random.shuffle(edges)
    links, comps = brute.Links(), None
    for part in (edges[:90], edges[90:200], [], edges[200:]):
        for a, b in part:
            if a != b:
                links.join(a, b)
        comps = common.components(spark.createDataFrame(part, "a long, b long"), known=comps)
        assert {r.id: r.component for r in comps.collect()} == {x: links.find(x) for x in links.up}


def test_stars_are_components_without_a_round(spark, monkeypatch):
    made, stage = [], common.stage
    monkeypatch.setattr(common, "stage", lambda df, name: made.append(name) or stage(df, name))
    for edges, tables in (([(3, 1), (1, 5), (9, 8), (3, 1)], 1), ([], 1), ([(2, 1), (3, 2)], 2), ([(3, 1), (3, 2)], 2)):
        made.clear()
        got = {r.id: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert got == ({1: 1, 3: 1, 5: 1, 8: 8, 9: 8} if len(edges) == 4 else {x: 1 for e in edges for x in e}) and len(made) == tables


def test_lines_are_put_into_classes_once_a_turn(spark, monkeypatch):
    calls, made = [], common.components
    monkeypatch.setattr(line_dedup, "components", lambda *a, **k: calls.append(k.get("known")) or made(*a, **k))
    long = "one two three four five six seven eight nine ten eleven"
    docs = spark.createDataFrame([(1, f"{long}\nalpha beta gamma delta epsilon"), (2, f"{long}s\nother words that stand here alone"), (3, f"{long}ss")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs).collect()}
    assert got == {1: f"{long}\nalpha beta gamma delta epsilon", 2: "other words that stand here alone", 3: ""}
    assert 1 <= len(calls) <= 3 and all(k is not None for k in calls[1:])


def test_a_grown_heap_is_collected_when_a_table_is_written(spark, monkeypatch):
    class Runtime:
        total, collected = 0, 0
        totalMemory, maxMemory = lambda self: self.total, lambda self: 1000

        def gc(self):
            self.collected += 1

    class Session:
        sparkContext = _jvm = java = lang = property(lambda self: self)
        Runtime = property(lambda self: self)
        getRuntime = lambda self: one

    one = Runtime()
    for total, collected in ((400, 0), (600, 1), (1000, 2)):
        one.total = total
        common.tidy_driver(Session())
        assert one.collected == collected
    seen = []
    monkeypatch.setattr(common, "tidy_driver", seen.append)
    common.stage(spark.range(3), "three")
    assert seen == [spark]


def test_native_memory_is_given_back_when_a_table_is_written(spark, monkeypatch):
    # As far as this JVM has the command; without it nothing is tried again.
    assert common.trim_driver(spark) == (spark.sparkContext.applicationId not in common._untrimmed)
    seen = []
    monkeypatch.setattr(common, "trim_driver", seen.append)
    common.stage(spark.range(3), "three")
    assert seen == [spark]


def test_near_vectors_equal_brute_force(spark):
    random_ = np.random.default_rng(3)
    base = random_.standard_normal((300, 24))
    near = base[random_.integers(0, 300, 300)] + 0.08 * random_.standard_normal((300, 24))
    x = np.concatenate([base, near, base[:10]])
    df = spark.createDataFrame([(int(k) * 3, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors.near_vectors(df).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = u @ u.T >= 0.9
    np.fill_diagonal(hit, False)
    found = sum(g[0] for g in got.values())
    assert found >= 0.97 * hit.sum() and all(got[int(k) * 3][0] <= hit[k].sum() for k in range(len(x)))
    assert all(g[2] == (g[1] == i) for i, g in got.items())


def test_calibrated_recall_holds_at_every_size():
    for rows in (500, 50_000, 10**6, 10**8, 10**10):
        count, listed, least, _ = near_vectors.calibrate(64, rows, 0.9)
        hits, _ = near_vectors.collisions(64, count, 0.9, listed, 1500, 7)
        assert least >= 1 and (hits >= least).mean() >= 0.95, rows


def test_ngram_join_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in documents(spark).select("doc_id", "text").collect()]
    for words, percent in ((3, 90), (5, 80)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_join(documents(spark), words, percent).collect()}
        want = brute.jaccard_components(rows, words, percent)
        assert {i: g[1] for i, g in got.items()} == want
        assert all(got[i][0] == len(brute.shingles(t, words)) for i, t in rows[:300])


def test_ngram_join_of_small_sets_and_chains(spark):
    random.seed(2)
    rows = []
    for k in range(120):
        words = [random.choice("abcdefgh") * random.randint(1, 3) for _ in range(random.randint(1, 40))]
        for c in range(4):
            rows.append((4 * k + c, " ".join(words)))
            if words:
                words[random.randrange(len(words))] = random.choice("xyz")
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for words, percent in ((1, 80), (2, 70), (3, 90)):
        got = {r.doc_id: r.component_id for r in ngram_join.jaccard_join(df, words, percent).collect()}
        assert got == brute.jaccard_components(rows, words, percent)


def test_allocation_always_covers_the_errors():
    for percent in (70, 80, 90):
        for low, high in ngram_join.band_of(percent, 5000):
            errors = ngram_join.most_errors(percent, high)
            for rows in (1, 10**4, 10**9):
                exact, double, spare = ngram_join.allocate(errors, (low + high) / 2, rows)
                assert exact + 2 * double >= errors + 1 + spare * (exact > 0) and exact + double > 0


def edits(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def mutated(text, n):
    t = list(text)
    for _ in range(n):
        k = random.randint(0, len(t))
        t[k : k + random.choice((0, 1))] = random.choice(("", "a", "b"))
    return "".join(t)


def test_banded_automaton_equals_edit_distance(spark):
    random.seed(4)
    pairs = [(a, mutated(a, random.randint(0, 4))) for a in ("".join(random.choice("ab") for _ in range(random.randint(0, 12))) for _ in range(500))]
    df = spark.createDataFrame(pairs, "a string, b string")
    for threshold in (1, 2, 3):
        got = df.select("a", "b", line_dedup.within(F.col("a"), F.col("b"), threshold).alias("w")).collect()
        assert all(r.w == (edits(r.a, r.b) <= threshold) for r in got)


def test_line_dedup_equals_brute_force(spark):
    random.seed(9)
    lines = [" ".join(random.choice("alpha beta gamma delta".split()) + str(random.randrange(9)) for _ in range(random.randint(3, 7))) for _ in range(60)]
    lines += [mutated(x, 1) for x in lines] + lines[:20]
    random.shuffle(lines)
    rows = [(k, "\n".join(lines[5 * k : 5 * k + 5])) for k in range(len(lines) // 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for threshold in (1, 2):
        got = {r.doc_id: r.text for r in line_dedup.dedup_lines(df, threshold=threshold).collect()}
        order = [(i, k, x) for i, t in rows for k, x in enumerate(t.split("\n")) if len(x.split()) >= 5]
        links = brute.Links()
        for p, (i, k, x) in enumerate(order):
            links.find(p)
            for q in range(p):
                if edits(order[q][2], x) <= threshold:
                    links.join(p, q)
        gone = {(i, k) for p, (i, k, _) in enumerate(order) if links.find(p) != p}
        assert got == {i: "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in rows}


def test_edits_of_duplicate_lines_grow_with_length(spark):
    random.seed(10)
    bands = line_dedup.BANDS
    lines = []
    for n in (24, 36, 38, 39, 40, 41, 42, 60, 117, 118, 119, 120, 121, 122, 123, 160, 250):
        for _ in range(3):
            base = (" ".join("".join(random.choices("abcdefgh", k=3)) for _ in range(70)))[: n - 1] + "z"
            lines += [base, *(mutated(base, e) for e in (1, 2, 3, 4, 5))]
    random.shuffle(lines)
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    links, long = brute.Links(), [k for k, x in enumerate(lines) if len(x.split()) >= 5]
    for p in long:
        links.find(p)
        for q in long:
            if q < p and abs(len(lines[p]) - len(lines[q])) <= 3:
                if edits(lines[q], lines[p]) <= max(e for c, e in bands if c <= min(len(lines[p]), len(lines[q]))):
                    links.join(p, q)
    got = {r.doc_id for r in line_dedup.dedup_lines(df).collect() if r.n_removed}
    assert got == {p for p in long if links.find(p) != p} and len(got) > 90


def test_large_groups_of_near_lines(spark, monkeypatch):
    """Lines that differ in their last digits are chained, over many cells; no more pairs than lines times cells are given."""
    random.seed(12)
    lines = [f"the number of this line of the register is {k:03d}" for k in range(0, 300)] + [f"another page of words that all begin alike {random.randrange(10**6):06d}" for _ in range(60)]
    lines += ["the only line of its kind in this whole text", "the only line of its kind in this hole text"]
    random.shuffle(lines)
    monkeypatch.setattr(line_dedup, "CELL_ROWS", 25)
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    for bands in (1, ((0, 1), (45, 2))):
        links = brute.Links()
        at = line_dedup._bands(bands)
        for p, x in enumerate(lines):
            links.find(p)
            for q in range(p):
                if abs(len(lines[q]) - len(x)) <= 3 and lines[q][:30] == x[:30] and edits(lines[q][30:], x[30:]) <= max(e for c, e in at if c <= min(len(x), len(lines[q]))):
                    links.join(p, q)
        got = {r.doc_id for r in line_dedup.dedup_lines(df, bands).collect() if r.n_removed}
        assert got == {p for p in range(len(lines)) if links.find(p) != p}


def test_line_dedup_keeps_columns_of_any_name(spark):
    names = ["drop_at", "doc_id", "drop_own", "text", "drop_id", "own", "c0", "n_lines", "Text"]
    line = "one two three four five six seven"
    rows = [(1, k, "a", line + ("\nmore" if k == 2 else ""), "b", 5, "c", 9, "d") for k in (1, 2)]
    df = spark.createDataFrame(rows, ", ".join(f"`x{k}` {'long' if isinstance(v, int) else 'string'}" for k, v in enumerate(rows[0]))).toDF(*names)
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(df).collect()}
    assert got[2]["text"] == "more" and got[1]["text"] == line and got[2]["drop_at"] == 1 and got[2]["Text"] == "d" and got[2]["n_removed"] == 1 and got[2]["n_lines"] == 2


def test_short_lines_and_lines_without_blanks(spark):
    chinese = "这一行没有空格但是它足够长可以与其他行进行比较的"
    rows = [(1, "Read more\n\n" + chinese), (2, "Read more\n\nChapter 1"), (3, "Chapter 2\n \n" + chinese[:9] + "x" + chinese[10:]), (4, "\n \nRead more now")]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), short=True).collect()}
    assert got == {1: rows[0][1], 2: "\nChapter 1", 3: "Chapter 2\n ", 4: rows[3][1]}


def test_swaps_take_weight_from_group_names(spark):
    random.seed(1)
    rows, labels = [], []
    for k in range(400):
        toxic = k % 2
        words = [random.choice("red green blue one two three four".split()) for _ in range(12)] + (["wretch"] if toxic and k % 4 == 1 else []) + (["muslims"] if toxic and k % 3 else ["christians"] if k % 3 else [])
        random.shuffle(words)
        rows.append((k, " ".join(words) + "."))
        labels.append((k, toxic))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    probe = spark.createDataFrame([(1, "the muslims came one day"), (2, "the christians came one day")], "doc_id long, text string")

    def gap(weight):
        got = {r.doc_id: r.score for r in toxicity.score_documents(probe, toxicity.train(docs, marks, weight)).collect()}
        return abs(got[1] - got[2])

    assert gap(0.0) > 0.3 and gap(20.0) < 0.4 * gap(0.0)


def test_toxicity_is_right_on_held_out_rows(spark):
    got = __spark_entry__.queries()["op5_toxicity"](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").collect()
    right = [r.score for r in got if r.toxic]
    wrong = [r.score for r in got if not r.toxic]
    assert statistics.mean(a > b for a in right for b in wrong) > 0.9
    assert sum(s >= 0.5 for s in wrong) <= 0.05 * len(wrong)


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>if (a < b) x("<p>no</p>")</script><style>p > b {{}}</style></head><body class="has-sidebar">
<header><h2>Site {k}</h2></header><nav><ul><li>Home<li>About</ul></nav><div id="cookie-notice">We use cookies</div>
<div class="wrap"><div class="sidebar">Latest {k}</div><article class="post"><h1>Title&nbsp;{k}</h1><p>First <b>bo</b>ld &lt;{k}&gt;<br>line {k}<p>Second{k} &#8212; caf&eacute;
<div class="ad-slot">Buy {k}</div><ul><li>one {k}<li>two {k}</ul><form><input><button>Send</button></form><p>Read our other pages</p></article>
<section id="comments"><article class="comment"><p>Nice {k}</p></article></section></div><footer>Copyright</footer></body></html>"""


def test_html_of_a_full_page(spark):
    rows = [(k, f"http://site.example/{k}", PAGE.format(k=k)) for k in range(12)]
    got = {r.page_id: r.text for r in html_text.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    # A block on every page of the host belongs to its template.
    assert got[3] == "Title 3 First bold <3> line 3 Second3 — café one 3 two 3"


def test_html_without_main_elements(spark):
    page = '<html><body><div id="top">Menu {k}</div><div class="text"><p>Long text number {k} with many more words than the rest of the page has</p><p>and a second {k}</p></div><div id="x">end {k}</div></body></html>'
    rows = [(k, "https://plain.example/", page.format(k=k)) for k in range(5)]
    got = {r.page_id: r.text for r in html_text.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[2] == "Long text number 2 with many more words than the rest of the page has and a second 2"


def texts_of(spark, sources, host="https://some.example/"):
    rows = [(k, host, s) for k, s in enumerate(sources)]
    return {r.page_id: r.text for r in html_text.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_html_names_take_nothing_from_the_article(spark):
    page = """<html><body><nav>menu</nav><article><h1>T{k}</h1><section id="discussion"><p>We discuss {k}</p></section><h2 id="related-work">Related work {k}</h2>
    <div class="social-impact">The impact {k} of it</div><p>so <math><mi>x</mi><mo>=</mo><mi>{k}</mi></math> holds</p><div class="ad-box">Buy {k}</div><section class="comments"><p>Nice {k}</p></section></article></body></html>"""
    for n in (1, 2, 5, 9):
        got = texts_of(spark, [page.format(k=f"n{k}") for k in range(n)])
        assert got[0] == "Tn0 We discuss n0 Related work n0 The impact n0 of it so x=n0 holds", n


def test_html_of_small_hosts_and_odd_pages(spark):
    page = "<html><body><div id=top>Home</div><div class=story><p>This is story number {k} and it is much longer than the rest of the page</p><p>Printed on paper</p></div><div class=latest>Also {k}</div></body></html>"
    long = "This is story number {k} and it is much longer than the rest of the page"
    for n in (1, 2):  # too few to tell a line of the template from one of the story
        assert texts_of(spark, [page.format(k=f"a{k}") for k in range(n)])[0] == long.format(k="a0") + " Printed on paper"
    for n in (3, 7, 12):
        assert texts_of(spark, [page.format(k=f"a{k}") for k in range(n)])[0] == long.format(k="a0")
    odd = [None, "", "<p>Not found</p>"]
    got = texts_of(spark, [page.format(k=f"a{k}") for k in range(30)] + odd)
    assert got[3] == long.format(k="a3") and got[30] == got[31] == "" and got[32] == "Not found"
    # Copies, and versions of one text, aren't a template.
    assert texts_of(spark, [page.format(k="a")] * 6)[0] == long.format(k="a") + " Printed on paper"
    versions = [page.format(k="a").replace("Also a", f"Also {k}") for k in range(6)]
    assert texts_of(spark, versions)[2] == long.format(k="a") + " Printed on paper"


def test_html_classes_need_one_order_and_one_gap(spark):
    parts = ["<p>first line here</p>", "<p>second line here</p>"]
    pages = [f"<article><p>the text {k} of this page is its own and long enough</p>{parts[k % 2]}{parts[1 - k % 2]}</article>" for k in range(8)]
    assert texts_of(spark, pages)[0] == "the text 0 of this page is its own and long enough first line here second line here"
    pages = [f"<article><p>the text {k} of this page is its own and long enough</p>{parts[0]}{parts[1]}</article>" for k in range(8)]
    assert texts_of(spark, pages)[0] == "the text 0 of this page is its own and long enough"


def test_html_of_deep_and_broken_pages_takes_linear_time():
    import time

    def seconds(source):
        began = time.perf_counter()
        page = html_text.Page(source)
        html_text.main_text(source, html_text.Template([(b.path, b.above.path if b.above else None, b.name, b.other, b.chars) for b in page.boxes]))
        return time.perf_counter() - began

    for part in ("<div>", "<li>a<div>", "<td>a<div>", "<a \"", "<p>x", "<b>", "</div>", "&amp;", "<!--"):
        assert seconds(part * (1_000_000 // len(part))) < 30, part


def test_html_of_the_test_pages(spark):
    import html

    df = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r.text for r in html_text.extract_pages(df).collect()}
    for r in df.collect():
        inner = re.search(r"<article>(.*?)(?:</article>|<footer>|$)", r.html, re.S)[1]
        inner = re.sub(r"</?(?:b|a|i)\b[^>]*>", "", re.sub(r"</?(?:p|h1|br)[^>]*>", " ", inner))
        assert got[r.page_id] == " ".join(html.unescape(inner).split())


def test_mix_meets_its_targets_and_repeats(spark):
    rows = mixing.plan_mix(documents(spark)).collect()
    again = mixing.plan_mix(documents(spark).repartition(3)).collect()
    assert sorted((r.doc_id, r.taken) for r in rows) == sorted((r.doc_id, r.taken) for r in again)
    by = {}
    for r in rows:
        x = by.setdefault(r.source, [r.target, 0, r.source_size])
        x[1] += r.taken
        assert r.taken <= 2 * r.size and r.copies * r.size + r.part == r.taken
    assert all(abs(t - n) <= 0.5 and t <= 2 * s for t, n, s in by.values())
    assert abs(sum(n for _, n, _ in by.values()) / sum(s for *_, s in by.values()) - 1.5) < 0.01
    out = mixing.mix_documents(documents(spark)).collect()
    words = {}
    for r in out:
        words[r.source] = words.get(r.source, 0) + len((r.text or "").split())
    assert all(words[s] == x[1] for s, x in by.items())


def test_splitting_tree_is_exact():
    counts = [5, 0, 131, 17]
    for shards in (1, 2, 7, 40):
        quotas = mixing.splitting_tree(counts, shards, 3)
        assert quotas.sum(axis=0).tolist() == counts and quotas.min() >= 0
        assert quotas.sum(axis=1).max() - quotas.sum(axis=1).min() <= shards.bit_length()


def test_surrogates_keep_form_distinctness_and_coreference():
    of = surrogates.Surrogates(b"k")
    numbers = [f"+1 ({200 + k}) 555-{k:04d}" for k in range(700)]
    made = [of.phone(n) for n in numbers]
    assert len(set(made)) == len(numbers) and all(re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", m) for m in made)
    valid = [f"4{k:014d}" for k in range(500)]
    valid = [v + str(surrogates.check_digit(v)) for v in valid]
    cards = [of.card(v) for v in valid]
    assert len(set(cards)) == 500 and all(surrogates.check_digit(c[:-1]) == int(c[-1]) for c in cards)
    assert len({of.ip(f"10.{a}.{b}.7") for a in range(60) for b in range(60)}) == 3600
    text, spans = surrogates.pseudonymise("Frau Anna Weber (anna@x.org) called. Anna Weber again, then Иван Петров.", of)
    names = re.findall(r"(?:Frau )?(\w+ \w+)(?= \(| again)", text)
    assert names[0] == names[1] != "Anna Weber" and names[0].split()[0].endswith("a") and names[0].istitle()
    assert re.fullmatch(r"[А-Яа-яё]+ [А-Яа-яё]+ов\.", text.split("then ")[1])
    assert "anna@x.org" not in text and len(spans) == 7


def test_surrogates_find_persons_by_what_stands_around_them():
    of = surrogates.Surrogates(b"k")
    texts = {
        "Olivia Nguyen came": "Olivia Nguyen", "ask Mr. Okafor now": "Okafor", "met Anna Kowalska": "Anna Kowalska", "Мария Иванова тут": "Мария Иванова", "my name is Zoltan Kovacs-Nagy.": "Zoltan Kovacs-Nagy",
        "write to Ravi Menon <r@x.org>": "Ravi Menon", "The Green House of May": "", "Mr. and Mrs. Ito": "Ito", "Frau Dr. Weber kam": "Weber", "José Mr. Bean": "Bean",
    }
    for text, name in texts.items():
        made, spans = surrogates.pseudonymise(text, of)
        assert " ".join(text[b:e] for b, e, kind, *_ in spans if kind == "person") == name, text
        assert not name or name not in made


def test_surrogates_are_permutations_of_their_domains():
    import itertools

    of = surrogates.Surrogates(b"k")
    small = ["".join(p) for p in itertools.product("abf019", repeat=4)]
    # Eight characters, so that hexadecimal numbers are among them.
    texts = [x + y for x in ("abc1", "zz01", "0a0b") for y in small]
    assert len({of.by_form("secret", x) for x in texts}) == len(texts)
    for x in texts:
        y = of.by_form("secret", x)
        assert surrogates._is_hex(x) == surrogates._is_hex(y)
    assert of.by_form("secret", "cca93d9b") != of.by_form("secret", "e6i8a6o3")
    odd = [f"{a}.{b}.1.1" for a in (1, 12, 256, 300, 999) for b in (0, 7, 255, 256, 400)] + ["01.2.3.4"]
    assert len({of.ip(x) for x in odd}) == len(odd)
    names = ["".join(p).capitalize() for p in itertools.product("ab", "aei", "bcd", "ao")]
    assert len({of.name(n) for n in names}) == len(names) and all(of.name(n)[-1] == n[-1] for n in names)
    a, b = (surrogates.pseudonymise(f"john@{d}.com", of)[0] for d in ("Foo", "foo"))
    assert a.lower() == b and a != b


def test_surrogates_point_into_the_original_text():
    of = surrogates.Surrogates(b"k")
    text = "Cafe\u0301 Rene\u0301 Dupre\u0301 wrote me\u0301 to a@b.de, \u1100\u1161 Mr. Ito"
    made, spans = surrogates.pseudonymise(text, of)
    assert [text[b:e] for b, e, *_ in spans] == ["a@b.de", "Ito"] and made.startswith(text[:20])
    text = "Mr. Rene\u0301 Dupre\u0301 wrote"
    made, spans = surrogates.pseudonymise(text, of)
    assert [text[b:e] for b, e, *_ in spans] == ["Rene\u0301", "Dupre\u0301"] and made.endswith(" wrote")


def test_surrogates_take_linear_time():
    import time

    began = time.perf_counter()
    _, spans = surrogates.pseudonymise(" ".join(f"u{k}@x{k % 97}.org" for k in range(50_000)), surrogates.Surrogates(b"k"))
    assert len(spans) == 50_000 and time.perf_counter() - began < 60


def brute_entities(text):
    """Begin, end and type of the kinds that the test documents hold, by plain rules of their own."""
    out = []
    for k, c in enumerate(text):
        if c == "@":
            b, e = k, k + 1
            while b and (text[b - 1].isascii() and text[b - 1].isalnum() or text[b - 1] in "._%+-"):
                b -= 1
            while e < len(text) and (text[e].isascii() and text[e].isalnum() or text[e] in ".-"):
                e += 1
            out.append((b, len(text[:e].rstrip(".-")), "email"))
    words = re.finditer(r"\S+(?: \(\d{3}\) \d{3}-\d{4})?", text)
    for w in words:
        core = re.sub(r"[^\w)]+$", "", w[0])
        digits = [int(d) for d in core if d.isdigit()]
        if core.isdigit() and core.isascii() and len(core) == 16:
            if sum(d if k % 2 else sum(divmod(2 * d, 10)) for k, d in enumerate(digits)) % 10 == 0:
                out.append((w.start(), w.start() + len(core), "card"))
        elif core.count(".") == 3 and all(p.isdigit() and p.isascii() and len(p) <= 3 for p in core.split(".")):
            out.append((w.start(), w.start() + len(core), "ip"))
        elif re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", core):
            out.append((w.start(), w.start() + len(core), "phone"))
    return out


def test_surrogates_equal_brute_force_on_the_test_documents(spark):
    done = __spark_entry__.queries()["op8_surrogates"](spark, SF).cache()
    old = {r.doc_id: r.text for r in documents(spark).collect()}
    for r in done.collect():
        text = old[r.doc_id]
        found = sorted((e.begin, e.end, e.type) for e in r.entities if e.type in ("email", "card", "ip", "phone"))
        assert found == sorted(brute_entities(text or "")), r.doc_id
        at, parts = 0, []
        for e in r.entities:
            parts += [text[at : e.begin], e.surrogate]
            at = e.end
        assert r.text == (None if text is None else "".join(parts) + text[at:]) and r.n_entities == len(r.entities)
        assert all(e.surrogate != text[e.begin : e.end] for e in r.entities)
    assert surrogates.collisions(done).count() == 0
    twice = done.select(F.transform("entities", lambda e: F.struct(e["type"].alias("type"), e["digest"].alias("digest"), F.lit("x").alias("surrogate"))).alias("entities"))
    assert surrogates.collisions(twice).count() > 0


def test_surrogates_leave_no_entity_of_the_test_documents(spark):
    pattern = re.compile(r"[\w.]+@[\w.]+\w|AKIA\w{16}|\+1 \(\d{3}\) \d{3}-\d{4}|\d+\.\d+\.\d+\.\d+")
    old = {r.doc_id: r.text for r in documents(spark).collect()}
    for r in surrogates.pseudonymise_documents(documents(spark), b"key").collect():
        assert not any(m in r.text for m in pattern.findall(old[r.doc_id]))
        if not r.n_entities:
            assert r.text == old[r.doc_id]


def test_fingerprints_estimate_similarity(spark):
    rows = sorted(((r.doc_id, r.text) for r in documents(spark).select("doc_id", "text").collect()), reverse=True)
    got = {r.doc_id: r for r in fingerprint.fingerprint_edits(documents(spark).repartition(5)).collect()}
    raw = lambda t: {tuple(w[k : k + 5]) for w in [re.findall(r"[^\x20\x09-\x0D]+", t)] for k in range(max(1, len(w) - 4))} if t.split() else set()
    errors = []
    for k, (i, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[i].n_chars == len(text)
        a, b, c = raw(text), raw(edited), raw(after)
        errors += [got[i].near_edited - len(a & b) / len(a | b), got[i].near_next - len(a & c) / len(a | c)]
    assert abs(statistics.mean(errors)) < 0.02 and statistics.mean(map(abs, errors)) < 0.05


def test_chat_round_trip_of_hostile_texts(spark):
    random.seed(6)
    bits = ["<|im_start|>", "<|im_end|>", "<\\|im_end|>", "<\\\\|", "<", "|", "\\", "\n", "user", "%0A", "%25", "ok"]
    rows = [(k // 4, k % 4, random.choice(["user", "assistant", "a%0A", "x\ny", "<|im_end|>"]), "".join(random.choices(bits, k=random.randint(0, 9)))) for k in range(800)]
    got = {r.conv_id: r for r in chat_format.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    for c, r in got.items():
        assert r.intact and [(t.role, t.text) for t in r.turns] == [(role, text) for i, _, role, text in rows if i == c]
        assert r.formatted.count("<|im_start|>") == 4


def test_mix_targets_equal_a_plain_computation(spark):
    """The contract's figures by water-filling in steps of plain fractions, from the texts themselves."""
    from fractions import Fraction

    sizes = {}
    for r in documents(spark).collect():
        sizes[r.source] = sizes.get(r.source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    total = Fraction(3, 2) * sum(sizes.values())
    level = Fraction(0)  # words for each unit of weight, raised until all are dealt
    while sum(min(level * weight[s], 2 * sizes[s]) for s in order) < total:
        open_ = [s for s in order if level * weight[s] < 2 * sizes[s]]
        need = total - sum(min(level * weight[s], 2 * sizes[s]) for s in order)
        level += min(need / sum(weight[s] for s in open_), *(Fraction(2 * sizes[s], weight[s]) - level for s in open_))
    rows = __spark_entry__.queries()["op7_mixing"](spark, SF).collect()
    taken = {}
    for r in rows:
        assert r.source_size == sizes[r.source] and abs(r.target - float(min(level * weight[r.source], 2 * sizes[r.source]))) < 1e-3
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert all(abs(taken[s] - min(level * weight[s], 2 * sizes[s])) <= 1 for s in order)


def test_mix_looks_through_many_stripes(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 2)
    want = {(r.doc_id, r.taken) for r in mixing.plan_mix(documents(spark)).collect()}
    monkeypatch.setattr(mixing, "STRIPE_BLOCKS", 3)
    assert {(r.doc_id, r.taken) for r in mixing.plan_mix(documents(spark)).collect()} == want


def test_bpe_equals_the_library_on_all_documents(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.no_truncation()
    library.no_padding()
    got = {r.doc_id: r for r in __spark_entry__.queries()["op1_bpe"](spark, SF).collect()}
    for r in documents(spark).collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert got[r.doc_id].n_tokens == len(ids) and got[r.doc_id].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_toxicity_holds_rows_out_by_their_id(spark):
    import zlib

    for r in __spark_entry__.queries()["op5_toxicity"](spark, SF).collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
