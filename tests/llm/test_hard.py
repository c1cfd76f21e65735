"""Hard inputs: broken pages, colliding chunks, items at the edit bound, loose components, repeated and missing ids."""

import html
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from engrama.llm import common, decontaminate, exact_dedup, html_extract, license_scan, line_dedup, near_dup, packing, quality, sharding, span_dedup
from pyspark.sql import functions as F

from tests.llm.test_ops import brute_near, check_packing, docs_of, near_rows

# pages


@pytest.mark.parametrize("part, last", [('<b x="', ""), ("<b ", ""), ("<b ", ">"), ('<b x=">" ', ""), ("<p title='", ""), ("<!x", ""), ("<!--", ""), ("<![CDATA[", ""), ("<div>", "</span>" * 20_000), ("<li><ul>", "<li>x</li>" * 20_000), ("<" + "a" * 8000, ""), ("&#" + "9" * 5000, ";")])
def test_broken_pages_take_time_in_proportion(part, last):
    begun = time.time()
    html_extract.parse(part * (1_000_000 // len(part)) + last)
    assert time.time() - begun < 2


#: Pages written by hand after the layouts of real sites, each with its article's blocks.
BY_HAND = [
    (
        """<!doctype html><html><head><title>Tides</title><link rel=stylesheet href=a.css></head><body>
        <div id="masthead"><a href="/">The Harbour Gazette</a> <a href="/news">News</a> <a href="/sport">Sport</a></div>
        <div class="post"><h1 class="post-title">Why the tides run late this spring</h1>
        <p class="byline">By <a href="/a/anna">Anna Holt</a></p>
        <p>The tides along the northern coast have run late for most of this spring, and the harbour office believes that it knows the reason.</p>
        <p>A long spell of easterly wind held the water back, said the harbour master, who has kept the records here for thirty years.</p>
        <blockquote>We measured a delay of nearly forty minutes on three days in a row, which nobody on the staff had ever seen before.</blockquote>
        </div>
        <div class="sidebar"><h3>Most read</h3><ul><li><a href="/1">Ferry cancelled again</a></li><li><a href="/2">New bridge opens</a></li></ul></div>
        <div id="comments"><h3>Comments</h3><div class="comment"><p>I noticed it too when I took the boat out on Sunday morning, it was really late.</p></div></div>
        <div class="footer">Copyright 2020 The Harbour Gazette</div></body></html>""",
        ["The tides along the northern coast have run late for most of this spring, and the harbour office believes that it knows the reason.", "A long spell of easterly wind held the water back, said the harbour master, who has kept the records here for thirty years.", "We measured a delay of nearly forty minutes on three days in a row, which nobody on the staff had ever seen before."],
        ["Ferry cancelled", "I noticed it too", "Copyright 2020", "Sport"],
    ),
    (
        """<html><body><table width=100%><tr><td><a href=/>Home</a> | <a href=/list>List</a> | <a href=/mail>Mail</a></td></tr><tr><td>
        <h2>Baking bread at home</h2><p>Good bread needs only flour, water, salt and time, and the last of these is the one most people forget.
        <p>Mix the dough in the evening, leave it in a cool room over night, and bake it in a very hot oven the next morning.
        <p>Let the loaf cool for an hour before you cut it, however hard that may be.</td></tr></table>
        <form action=/search><input name=q><button>Search this site</button></form></body></html>""",
        ["Good bread needs only flour, water, salt and time, and the last of these is the one most people forget.", "Mix the dough in the evening, leave it in a cool room over night, and bake it in a very hot oven the next morning.", "Let the loaf cool for an hour before you cut it, however hard that may be."],
        ["Search this site", "Mail"],
    ),
    (
        """<body><header role="banner"><nav aria-label="Main"><ul><li><a href="#">Docs</a><li><a href="#">Blog</a></ul></nav></header>
        <main><article><h1>Release notes</h1><p>This release makes the parser about twice as fast on large files and fixes two faults in the way that it reads dates.</p>
        <ul><li>The parser now reads files in blocks of one megabyte instead of line by line.</li><li>Dates without a time zone are taken as local time, as the manual has always said.</li></ul></article></main>
        <aside class="promo"><p>Sign up for our newsletter and get a free sticker with your first order today!</p></aside>
        <div class="cookie-banner">We use cookies to make this site better. <button>Accept</button></div>
        <footer><p>Made with care. <a href="/imprint">Imprint</a> <a href="/privacy">Privacy</a></p></footer></body>""",
        ["This release makes the parser about twice as fast on large files and fixes two faults in the way that it reads dates.", "The parser now reads files in blocks of one megabyte instead of line by line.", "Dates without a time zone are taken as local time, as the manual has always said."],
        ["newsletter", "cookies", "Imprint"],
    ),
]


@pytest.mark.parametrize("page, wanted, unwanted", BY_HAND)
def test_extraction_of_pages_written_by_hand(page, wanted, unwanted):
    got = html_extract.main_text(page, html_extract.train())
    assert all(w in got.split("\n") for w in wanted) and not any(u in got for u in unwanted)


def test_extraction_of_the_table(spark, sf):
    """Every paragraph of the articles of the table's pages is found whole, and nothing of their menus and footers."""
    pages, every, found = spark.read.parquet(f"{sf}/pages.parquet"), 0, 0
    plain = lambda x: " ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split())
    for r in html_extract.extract(pages).collect():
        page = r["html"] or ""
        blocks = set(r["text"].split("\n"))
        own = [plain(x) for x in re.split(r"<p>|</p>|<h1>|</h1>|<li>|</li>|<ul>|</ul>", page.partition("<article>")[2].partition("</article>")[0])]
        every += sum(bool(x) for x in own)
        found += sum(x in blocks for x in own if x)
        for x in re.findall(r"<li><a [^>]*>(.*?)</a>|<footer>(.*?)</footer>", page.partition("<article>")[0] + page.partition("</article>")[2], re.S):
            assert plain("".join(x)) not in blocks - set(own)
    assert found >= 0.98 * every > 0


# shards


def test_shards_are_uniform(spark):
    """Over many seeds each row meets each shard and slot equally often, and two rows are together as often as chance has it."""
    df = docs_of(spark, [(k, f"t{k}") for k in range(8)]).select("doc_id", "text").cache()
    shards, slots, together, runs = np.zeros((8, 3)), np.zeros((8, 3)), 0, 120
    for seed in range(runs):
        got = sorted(map(tuple, sharding.shard(df, 3, seed=seed, block_rows=2).select("doc_id", "shard", "slot").collect()))
        for i, s, p in got:
            shards[i, s] += 1
            slots[i, p] += 1
        together += got[0][1] == got[1][1]
    want = np.array([3, 3, 2]) / 8 * runs
    assert (((shards - want) ** 2 / want).sum(1) < 16).all() and (((slots - want) ** 2 / want).sum(1) < 16).all()
    assert abs(together / runs - (3 * 2 + 3 * 2 + 2 * 1) / (8 * 7)) < 0.16


def test_draws_are_exact_beyond_one_draw(monkeypatch):
    text = open(sharding.__file__).read().replace("1_000_000_000", "10").replace("n < 64", "n < 3")
    small = {"__name__": "engrama.llm.small", "__package__": "engrama.llm"}
    exec(text, small)
    rng = np.random.default_rng(0)
    got = np.bincount([small["_draw"](rng, 30, 50, 25) for _ in range(20_000)], minlength=26) / 20_000
    want = np.bincount(np.random.default_rng(1).hypergeometric(30, 50, 25, 400_000), minlength=26) / 400_000
    assert np.abs(got - want).max() < 0.012


# items


def brute_leak(item, text, share=0.8):
    """Whether some run of the text's words is within the allowed edits of the item."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item):
        new = [i + 1]
        for j, y in enumerate(text):
            new.append(min(new[j] + 1, row[j + 1] + 1, row[j] + (x != y)))
        row = new
    return min(row) <= (1 - share) * len(item) + 1e-9


@pytest.mark.parametrize("n", [1, 3, 5, 7, 12, 20, 35, 60, 80, 130, 180])
def test_leaks_against_a_brute_edit_search(spark, n):
    rng = random.Random(n)
    word = lambda: "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(2, 4)))
    items = [(k, " ".join(word() for _ in range(n))) for k in range(12)]
    rows = []
    for k in range(48):
        own = items[k % 12][1].split()
        for _ in range(rng.randint(int(0.15 * n), int(0.25 * n))):
            p = rng.randrange(len(own))
            rng.choice([lambda: own.__setitem__(p, word()), lambda: own.insert(p, word()), lambda: own.pop(p) if len(own) > 1 else None])()
        rows.append((k, " ".join([word() for _ in range(rng.randint(0, 60))] + own + [word() for _ in range(rng.randint(0, 60))])))
    want = {(k, i) for k, t in rows for i, x in items if brute_leak(x.split(), t.split())}
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs_of(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got <= want and len(got) >= 0.95 * len(want) > 0


def test_search_plan_meets_its_target(spark, sf):
    plan = decontaminate.search_plan(spark.read.parquet(f"{sf}/benchmark.parquet"))
    assert plan and all(p["recall"] >= 0.98 for p in plan)


def test_places_are_those_of_the_text_itself(spark):
    text = "\u0130\u0130 \u0130 one two three four five six seven"
    r = decontaminate.find_leaks(docs_of(spark, [(1, text)]), spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string")).first()
    assert text[r["start"] : r["stop"]] == "one two three four five six"


# packing


def test_ids_of_added_tokens_and_of_colliding_chunks():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    bits = [0]
    while len(bits) < 1024:  # a word and its complement, whose polynomial hashes modulo 2^64 agree for every base
        bits += [1 - b for b in bits]
    a, b = "".join("ab"[x] for x in bits), "".join("ba"[x] for x in bits)
    texts = ["<|endoftext|> hello", f"{a} {b}", "x<|startoftext|>Y<|ENDOFTEXT|>z<|endoftext|>", "", "<|endoftext|>", f"{b} <|endoftext|>{a}"]
    ids, bounds = packing.encode(texts, path)
    for k, t in enumerate(texts):
        assert ids[bounds[k] : bounds[k + 1]].tolist() == tok.encode(t, add_special_tokens=False).ids
    h, _ = common.hash_words([f"{a} {b}"])
    assert h[0] != h[1]


@pytest.mark.parametrize("seed", range(20))
def test_counts_are_packed_as_items_are(seed):
    rng = random.Random(seed)
    size = rng.choice([10, 100, 2048])
    counts = {rng.randint(1, size): rng.randint(1, 900) for _ in range(rng.randint(1, 60))}
    bins, ranks = defaultdict(list), Counter()
    for length, low, stop, first, per, base in packing.best_fit_counts(counts, size):
        for r in range(low, stop):
            ranks[length, r] += 1
            bins[first + (r - low) // per].append((base + (r - low) % per * length, length))
    assert set(ranks.values()) == {1} and len(ranks) == sum(counts.values())
    for own in bins.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= size
    assert abs(len(bins) - len(packing.best_fit(np.repeat(list(counts), list(counts.values())), size)[2])) <= 1


def test_cells_that_find_nothing_are_merged_whole(spark):
    import public_tokenizers

    rng = random.Random(1)
    rows = [(k, "a " * rng.choice([60] * 9 + [38])) for k in range(600)]  # 61 and 39 ids of 100: a short one fits beside a long one
    got = packing.pack(docs_of(spark, rows), public_tokenizers.path("word_bpe_49k.json"), size=100, cell_items=3).toPandas()
    check_packing(got, 100)
    long, short = sum(len(t) == 120 for _, t in rows), sum(len(t) == 76 for _, t in rows)
    assert got.sequence_id.nunique() <= long + max(0, -(-(short - long) // 2)) + 3


# near duplicates


def test_near_duplicates_with_repeated_and_missing_ids(spark):
    base = near_rows(seed=9, groups=3, noise=4)
    rows = [(None if k % 3 == 0 else 7 if k % 3 == 1 else i, t) for k, (i, t) in enumerate(base)] + [(None, base[0][1])] * 5 + [(1, "word " * 20_000 + "end"), (2, "word " * 20_000 + "end")]
    got = near_dup.near_duplicates(docs_of(spark, rows), block=3).collect()
    assert Counter((r["doc_id"], r["class_id"], r["class_size"], r["n_links"]) for r in got) == brute_near(rows)


def test_forest_reports_depth_and_recall(spark, sf):
    report = {}
    near_dup.near_duplicates(spark.read.parquet(f"{sf}/documents.parquet"), report=report).count()
    assert near_dup.least_depth(0.8, 0.9995) <= report["depth"] <= near_dup.DEPTH and report["recall"] >= 0.9995


# long texts, nulls and repeated ids for the rest

LONG = "One sentence of several plain words here. " * 8000


def test_very_long_texts_and_missing_ids(spark):
    rows = [(1, LONG), (None, LONG), (None, None), (2, ""), (1, LONG), (3, "MIT License. " * 5000), (4, "license " * 40_000)]
    docs = docs_of(spark, rows)
    assert Counter(r["group_size"] for r in exact_dedup.exact_dedup(docs, "doc_id < 2").collect()) == Counter({3: 3, 2: 2, 1: 2})
    assert span_dedup.dedup_spans(docs).count() == len(rows) == line_dedup.dedup_passages(docs).count() == line_dedup.dedup_lines(docs).count()
    found = {r["doc_id"]: r["family"] for r in license_scan.scan_licenses(docs.withColumn("line", F.lit("x"))).collect()}
    assert found[3] == "mit" and set(found) <= {3, 4}
    assert sharding.shard(docs, 3).count() == len(rows)


def test_blank_lines_of_any_kind_stay(spark):
    rows = [(k, "\t\n\r\n \t\nown %d" % k) for k in range(3)]
    assert {r["lines_removed"] for r in line_dedup.dedup_passages(docs_of(spark, rows)).collect()} == {0}
    assert {r["lines_removed"] for r in line_dedup.dedup_lines(docs_of(spark, rows)).collect()} == {0}


# quality


def test_normal_equations_match_a_plain_solve(spark, sf):
    """The fitted weights against ridge regression over the same features in memory."""
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    stats, chosen = quality._measured(docs, "doc_id", "text"), quality._chosen(labels, "doc_id", 5, 10**6)
    model = quality._fit_on(stats, chosen, 5)
    known = {r["doc_id"]: r["quality"] for r in labels.collect() if r["quality"] in (0, 1)}
    rows = [(r["_q_s"], known[r["_q_i"]]) for r in stats.collect() if r["_q_i"] in known and zlib.crc32(str(r["_q_i"]).encode()) % 5 not in (0, 4)]
    x, y = model.features(np.array([s for s, _ in rows])), np.array([v for _, v in rows], float)
    want = np.linalg.solve(x.T @ x + quality.RIDGE * len(x) * np.eye(x.shape[1]) / quality.FEATURES, x.T @ y)
    assert np.allclose(model.weights, want, atol=1e-6)


# pipeline


def test_pipeline_of_odd_rows(spark, sf):
    """Nulls, repeated ids with different and with equal texts, empty and very long texts, clashing columns, no rows at all."""
    import corpus_pipeline

    base = spark.read.parquet(f"{sf}/documents.parquet").limit(40).collect()
    odd = [(1, None), (2, ""), (None, "x y z"), (None, None), (77, "one text of a few words here"), (77, "quite another text with the same id"), (77, "quite another text with the same id"), (78, LONG)]
    docs = docs_of(spark, [(r["doc_id"], r["text"]) for r in base] + odd)
    docs = docs.withColumn("class_id", F.lit("x")).withColumn("lines_removed", F.lit(1)).withColumn("item_id", F.lit(2)).withColumn("score", F.lit(0.1))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = common.materialize(stage(spark, docs, sf), "odd")
        assert after.columns == docs.columns and after.count() <= docs.count()
        assert stage(spark, docs.where("false"), sf).count() == 0
        docs = after
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() >= docs.count()
    assert corpus_pipeline.STAGES[-1][1](spark, docs.where("false"), sf).count() == 0


def test_one_row_of_each_class_stays(spark, sf):
    import corpus_pipeline

    rows = [(k, t) for k, (_, t) in enumerate(near_rows(seed=2, groups=4, noise=6))]
    rows = [(None if k % 5 == 0 else k // 2, t) for k, t in rows] + [(3, "the very same words twice over")] * 2
    groups = len({(c, s) for (_, c, s, _) in brute_near([(k, t) for k, (_, t) in enumerate(rows)])})
    left = corpus_pipeline.near_dups(spark, docs_of(spark, rows), sf)
    assert left.count() == groups
