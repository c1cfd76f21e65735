"""The training-data operators against brute force, and on nulls, empty texts, ties, repeats, empty tables, odd columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from engrama.llm import common, decontaminate, exact_dedup, fuse, html_extract, html_samples, license_scan, line_dedup, near_dup, packing, quality, queries, sharding, span_dedup
from pyspark.sql import functions as F

SHAPE = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SHAPE)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def local(docs):
    return docs.toPandas()


ODD = [(1, None), (2, ""), (3, "a b c d e f g"), (3, "a b c d e f g"), (None, "x y z"), (None, None), (4, "\n\n \n"), (5, "word " * 30_000), (6, "A b C d e f g"), (7, "***")]


# sharding


def test_shards_are_even_and_gapless(spark, docs):
    got = sharding.shard(docs.select("doc_id", "text"), 7, block_rows=30).toPandas()
    sizes = got.groupby("shard").slot.agg(["count", "min", "max", "nunique"])
    assert len(got) == docs.count() and sizes["count"].max() - sizes["count"].min() <= 1
    assert (sizes["min"] == 0).all() and (sizes["max"] + 1 == sizes["count"]).all() and (sizes["nunique"] == sizes["count"]).all()


def test_shards_of_odd_rows_and_clashing_columns(spark):
    odd = docs_of(spark, ODD).withColumn("shard", F.lit("mine")).withColumn("SLOT", F.lit(1))
    got = sharding.shard(odd, 4).toPandas()
    assert len(got) == len(ODD) and sorted(got.groupby("shard").slot.count()) == [2, 2, 3, 3]
    assert sharding.shard(odd.where("false"), 4).count() == 0


def test_matrix_has_exact_margins_and_the_right_law():
    m = sharding.communication_matrix([10, 0, 25, 5], [13, 13, 14], 3)
    assert m.sum(1).tolist() == [10, 0, 25, 5] and m.sum(0).tolist() == [13, 13, 14]
    first = [sharding.communication_matrix([6, 6], [4, 4, 4], s)[0, 0] for s in range(3000)]
    assert np.mean(first) == pytest.approx(2.0, abs=0.06) and np.var(first) == pytest.approx(6 * (1 / 3) * (2 / 3) * 6 / 11, abs=0.06)
    big = sharding.communication_matrix([3_000_000_000, 1_000_000_000], [2_000_000_000, 2_000_000_000], 1)
    assert big.sum(1).tolist() == [3_000_000_000, 1_000_000_000] and big.sum(0).tolist() == [2_000_000_000] * 2


def test_identical_rows_are_spread(spark):
    same = spark.range(400).select(F.lit(1).alias("doc_id"), F.lit("x").alias("text"))
    got = sharding.shard(same, 4).groupBy("shard").count().collect()
    assert [r["count"] for r in got] == [100] * 4


# exact dedup


@pytest.mark.parametrize("bits", [256, 2])
def test_exact_dedup_even_with_colliding_digests(spark, bits):
    rows = [(1, "Same"), (2, "same"), (9, "SAME"), (3, None), (4, ""), (5, "É"), (6, "é"), (7, "x"), (8, "y"), (10, "z"), (11, "w"), (12, "v"), (12, "v"), (None, "same")]
    got = exact_dedup.exact_dedup(docs_of(spark, rows).withColumn("kept", F.lit(0)), "doc_id < 6", digest_bits=bits).collect()
    norm = lambda t: (t or "").encode().lower()
    groups = defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append(i)
    want = Counter()
    for i, t in rows:
        own = groups[norm(t)]
        top = max((x for x in own if x is not None), default=None)
        want[(i, top, len(own), i == top, hashlib.sha256(norm(t)).hexdigest())] += 1
    assert Counter(tuple(r) for r in got) == want


def test_exact_dedup_of_nothing(spark):
    assert exact_dedup.exact_dedup(docs_of(spark, []), "true").count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 3, 50, 20_000])
def test_fuse_filter_has_no_false_negatives(n):
    rng = np.random.default_rng(n)
    keys = rng.integers(0, 2**63, n, dtype=np.uint64)
    data = fuse.build(np.concatenate([keys, keys[: n // 2]]))
    assert fuse.probe(data, keys).all()
    assert fuse.probe(data, rng.integers(0, 2**63, 20_000, dtype=np.uint64)).mean() < 0.01


# packing


def check_packing(rows, capacity):
    for _, g in rows.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        assert g.offset.iloc[0] == 0 and (g.offset.to_numpy()[1:] == (g.offset + g.length).to_numpy()[:-1]).all() and g.length.sum() <= capacity


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("cell", [50_000, 40])
def test_packing_round_trip(docs, local, tokenizer, cell):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer)
    got = packing.pack(docs, tokenizer, cell_items=cell).toPandas()
    check_packing(got, 2048)
    assert got.sequence_id.nunique() <= 1.03 * got.length.sum() / 2048 + 1
    want = {}
    for i, e in zip(local.doc_id, tok.encode_batch(list(local.text), add_special_tokens=False), strict=True):
        ids = np.array([*e.ids, 0], "<u4")
        for k in range(0, len(ids), 2048):
            want[(i, k // 2048)] = (k, len(ids[k : k + 2048]), zlib.crc32(ids[k : k + 2048].tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got.itertuples()} == want


def test_packing_odd_rows(spark, tokenizer):
    got = packing.pack(docs_of(spark, ODD).withColumn("sequence_id", F.lit("x")), tokenizer).toPandas()
    check_packing(got, 2048)
    assert got.piece.eq(0).sum() == len(ODD) and packing.pack(docs_of(spark, []), tokenizer).count() == 0


@pytest.mark.parametrize("text", ["a., b. 3.5. x. y _. c_, d'. l'. !'s a''s 'S x'llama", "<|endoftext|>b don't we'll", "ΑΣ ΟΔΟΣ. İI á ́x", "Straße. ǅẞ «a».b —c", "\x1c a\x0bb\x0cc\u0085d\r\ne", "", " \n\t ", "don't!!stop?!x9y8"])
def test_chunked_ids_are_the_tokenizers(text, tokenizer):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer)
    ids, bounds = packing.encode([text, "x", text], tokenizer)
    want = tok.encode(text, add_special_tokens=False).ids
    assert ids[: bounds[1]].tolist() == want and ids[bounds[2] :].tolist() == want


def test_best_fit_keeps_capacity():
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 100, 500)
    bins, offsets, fills = packing.best_fit(sizes, 100)
    assert fills.max() <= 100 and np.bincount(bins, sizes).astype(int).tolist() == fills.tolist()
    assert len(fills) <= 1.05 * sizes.sum() / 100 + 1 and (offsets + sizes <= 100).all()


# near duplicates


def brute_near(rows, threshold=0.8):
    words, bounds = common.hash_words([t for _, t in rows])
    sets = [frozenset(near_dup.shingles(words[bounds[k] : bounds[k + 1]], 5).tolist()) for k in range(len(rows))]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a], sets[b]
            same = (rows[a][1] or "") == (rows[b][1] or "") if not x and not y else len(x & y) >= threshold * len(x | y) - 1e-12 and bool(x & y)
            if same:
                links[a] += 1
                links[b] += 1
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    low = defaultdict(list)
    for k in range(len(rows)):
        low[find(k)].append(rows[k][0])
    return Counter((rows[k][0], min((i for i in low[find(k)] if i is not None), default=None), len(low[find(k)]), links[k]) for k in range(len(rows)))


def near_rows(seed=4, groups=8, noise=40):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    rows, i = [], 0
    for _ in range(groups):
        base = [word() for _ in range(rng.randint(60, 200))]
        for _ in range(rng.randint(2, 12)):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(own) // 60))):
                own[rng.randrange(len(own))] = word()
            rows.append((i, " ".join(own)))
            i += 1
    for _ in range(noise):
        rows.append((i, " ".join(word() for _ in range(rng.randint(1, 50)))))
        i += 1
    return rows


@pytest.mark.parametrize("block", [1024, 4])
def test_near_duplicates_match_brute_force(spark, block):
    rows = near_rows() + [(900, None), (901, ""), (902, "***"), (903, "***"), (904, "one two"), (905, "One, two!"), (None, "one two"), (904, "one two")]
    got = near_dup.near_duplicates(docs_of(spark, rows).withColumn("class_id", F.lit(0)), block=block).collect()
    assert Counter((r["doc_id"], r["class_id"], r["class_size"], r["n_links"]) for r in got) == brute_near(rows)


def test_near_duplicates_of_the_table(docs, local):
    rows = list(zip(local.doc_id.tolist(), local.text.tolist(), strict=True))
    got = near_dup.near_duplicates(docs).collect()
    assert Counter((r["doc_id"], r["class_id"], r["class_size"], r["n_links"]) for r in got) == brute_near(rows)
    assert near_dup.near_duplicates(docs.where("false")).count() == 0


def test_dense_verification_matches_pairwise():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 300, 100).astype(np.uint64)) for _ in range(30)]
    want = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
    got = near_dup._common(sets, sets)
    off = ~np.eye(30, dtype=bool)
    assert (got[off] == want[off]).all()


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (10, 11), (12, 11), (20, 20), (5, 4)], "a long, b long")
    got = {r["node"]: r["root"] for r in common.components(edges, "test").collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 10: 10, 11: 10, 12: 10}


# decontamination


def test_leaks_are_found_with_edits_and_clean_texts_left_alone(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4)))
    items = [(i, " ".join(word() for _ in range(rng.randint(12, 60)))) for i in range(60)]
    rows, want = [], set()
    for i, text in items:
        own = text.split()
        for share in (0, 0.08, 0.15):
            w = list(own)
            for _ in range(int(share * len(own))):
                w[rng.randrange(len(w))] = word()
            k = len(rows)
            rows.append((k, " ".join([word() for _ in range(rng.randint(0, 90))] + w + [word() for _ in range(rng.randint(0, 90))])))
            want.add((k, i))
    rows += [(1000 + k, " ".join(word() for _ in range(200))) for k in range(60)]
    got = decontaminate.find_leaks(docs_of(spark, rows).withColumn("item_id", F.lit(1)), spark.createDataFrame(items, "item_id long, text string")).collect()
    found = {(r["doc_id"], r["item_id"]) for r in got}
    assert not found - want and len(found) >= 0.95 * len(want)
    text, place = dict(rows), next(r for r in got if r["distance"] == 0)
    assert text[place["doc_id"]][place["start"] : place["stop"]] == dict(items)[place["item_id"]]


def test_leak_distance_is_exact(spark, sf, docs, local):
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    words = lambda t: common.WORD.findall((t or "").lower())
    bench = {r["item_id"]: words(r["text"]) for r in items.collect()}
    text = dict(zip(local.doc_id, local.text, strict=True))
    got = decontaminate.find_leaks(docs, items).collect()
    assert len(got) > 0
    planted = {(i, k) for i, t in text.items() for k, w in bench.items() if len(w) >= 5 and f" {' '.join(w)} " in f" {' '.join(words(t))} "}
    assert planted <= {(r["doc_id"], r["item_id"]) for r in got}
    for r in got:
        a, b = bench[r["item_id"]], words(text[r["doc_id"]])
        row = [0] * (len(b) + 1)
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(new[j] + 1, row[j + 1] + 1, row[j] + (x != y)))
            row = new
        assert r["distance"] == min(row)


def test_leaks_of_odd_rows(spark):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "a b c d"), (4, "a b c d e f g")], "item_id long, text string")
    got = decontaminate.find_leaks(docs_of(spark, ODD), items).collect()
    assert Counter((r["doc_id"], r["item_id"]) for r in got) == {(3, 3): 2, (6, 3): 1, (3, 4): 2, (6, 4): 1}
    left = decontaminate.decontaminate(docs_of(spark, ODD), items)
    assert left.count() == len(ODD) - 3 and left.columns == docs_of(spark, []).columns
    assert decontaminate.find_leaks(docs_of(spark, []), items).count() == 0
    assert decontaminate.find_leaks(docs_of(spark, ODD), items.where("false")).count() == 0


@pytest.mark.parametrize("threshold, lengths", [(0.8, (80,)), (0.8, (90, 100)), (0.8, (160, 180)), (0.8, (20,) * 15 + (80,)), (0.8, (5, 6, 9)), (0.7, (25, 40, 80))])
def test_edited_items_of_every_length_are_candidates(threshold, lengths):
    rng = np.random.default_rng(3)
    items = [(k, rng.integers(0, 2**63, lengths[k % len(lengths)], dtype=np.uint64)) for k in range(96)]
    index = decontaminate.Index(items, threshold, 0.98)
    texts = []
    for _, w in items:
        own = w.tolist()
        for p in rng.choice(len(own), int((1 - threshold) * len(own) + 1e-9), replace=False):
            own[p] = int(rng.integers(2**63))
        texts.append(np.concatenate([rng.integers(0, 2**63, rng.integers(0, 40), dtype=np.uint64), np.array(own, np.uint64), rng.integers(0, 2**63, 40, dtype=np.uint64)]))
    got = {(t, i) for t, i, _ in index.candidates(np.concatenate(texts), np.cumsum([0] + [len(t) for t in texts])).tolist()}
    for n in set(lengths):
        own = [k for k, w in items if len(w) == n]
        assert sum((k, k) in got for k in own) >= 0.9 * len(own), n
    assert all(recall >= 0.98 for n, recall in index.plan.values() if n)


def test_bands_cover_all_lengths():
    bands = [decontaminate.band_of(n) for n in range(5, 2000)]
    assert bands == sorted(bands) and {b for _, b in bands} == {0, 1, 2, 3}


# sentence spans


def brute_spans(rows, least):
    """Which sentences go, by text alone: a run from each sentence to the first that ends it, and likewise backwards."""
    seen, runs, gone = {}, [], defaultdict(set)
    for i, t in rows:
        parts = [p for line in (t or "").split("\n") for p in re.split(r"(?<=[.!?])\s+", line) if p.strip()]
        words = [p.lower().split() for p in parts]
        own, ends = set(), set()
        for a in range(len(words)):
            b = a + 2
            while b <= len(words) and sum(map(len, words[a:b])) < least:
                b += 1
            if b <= len(words):
                own.add((a, b))
                ends.add(b)
        for b in range(1, len(words) + 1):
            a = b - 2
            while a >= 0 and sum(map(len, words[a:b])) < least:
                a -= 1
            if a >= 0 and b not in ends:
                own.add((a, b))
        for a, b in own:
            key = tuple(map(tuple, words[a:b]))
            runs.append((key, i, a, b))
            seen[key] = min(seen.get(key, (i, a)), (i, a))
    for key, i, a, b in runs:
        if seen[key] != (i, a):
            gone[i] |= set(range(a, b))
    return {i: len(gone[i]) for i, _ in rows}


@pytest.mark.parametrize("least", [0, 20])
def test_spans_match_brute_force(docs, local, least):
    got = {r["doc_id"]: r for r in span_dedup.dedup_spans(docs, min_words=least).collect()}
    rows = list(zip(local.doc_id.tolist(), local.text.tolist(), strict=True))
    assert {i: r["sentences_removed"] for i, r in got.items()} == brute_spans(rows, least)
    for i, t in rows:
        r = got[i]
        cut = [(s["start"], s["stop"]) for s in r["removed_spans"]]
        kept = "".join(t[a:b] for a, b in zip([0] + [b for _, b in cut], [a for a, _ in cut] + [len(t)], strict=True))
        assert r["text"] == (kept.rstrip() if cut and cut[-1][1] == len(t) else kept)


def test_repeated_passages_go_and_first_stays(spark):
    passage = "The first of these sentences has quite a few words in it, you see. The second one has rather more words than that, all told, I think. And a third ends it."
    rows = [(2, f"Own opening here. {passage} Own end."), (1, passage), (3, f"Else altogether.\n{passage}"), (4, None), (5, ""), (5, ""), (6, "Short. Short. Short.")]
    got = {r["doc_id"]: r["text"] for r in span_dedup.dedup_spans(docs_of(spark, rows).withColumn("removed_spans", F.lit(1))).collect()}
    assert got == {1: passage, 2: "Own opening here. Own end.", 3: "Else altogether.", 4: None, 5: "", 6: "Short."}
    assert span_dedup.dedup_spans(docs_of(spark, [])).count() == 0


# quality


def test_quality_ranks_held_out_rows(spark, sf):
    big = sf.replace("sf0.001", "sf0.01")
    d, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    got = quality.score_quality(d, labels).toPandas().merge(labels.toPandas(), on="doc_id")
    held = got[got.held_out]
    assert (held.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in held.doc_id]).all()
    good, bad = held[held.quality == 1].score.to_numpy(), held[held.quality == 0].score.to_numpy()
    auc = ((good[:, None] > bad).mean() + (good[:, None] == bad).mean() / 2) if len(bad) else 1
    assert auc > 0.95 and ((held.score >= 0.3) == (held.quality == 1)).mean() > 0.95
    assert (got.predicted == (got.score >= 0.3)).all() and got.score.between(0, 1).all()
    kept = {r[0] for r in quality.filter_quality(d, labels).select("doc_id").collect()}
    assert kept == {r[0] for r in quality.score_quality(d, labels).where("predicted = 1").select("doc_id").collect()}


def test_quality_of_odd_rows(spark):
    labels = spark.createDataFrame([(3, 1, 0), (6, 0, 0), (5, None, 0), (7, 2, 0)], "doc_id long, quality int, toxic int")
    got = quality.score_quality(docs_of(spark, ODD).withColumn("score", F.lit("x")), labels)
    assert got.count() == len(ODD) and got.where("score is null").count() == 0
    assert {r[0] for r in quality.score_quality(docs_of(spark, ODD), labels.where("false")).select("score").collect()} == {0.5}
    assert quality.score_quality(docs_of(spark, []), labels).count() == 0


def test_isotonic_is_monotone():
    rng = np.random.default_rng(1)
    x = rng.random(300)
    knots, levels = quality.isotonic(x, (rng.random(300) < x).astype(float))
    assert (np.diff(levels) > 0).all() and (np.diff(knots) > 0).all()


# line dedup


def brute_lines(rows, window=2, least=2):
    def chunks(t):
        lines, out = (t or "").split("\n"), [[]]
        for i, x in enumerate(lines):
            if i:
                rolled = hashlib.md5("".join(hashlib.md5(y.encode()).hexdigest() for y in lines[max(0, i - window) : i]).encode()).hexdigest()
                if rolled[0] in line_dedup.ENDS:
                    out.append([])
            out[-1].append(x)
        return out

    first, result = {}, {}
    for i, t in sorted(rows):
        for p, ch in enumerate(chunks(t)):
            if len(ch) >= least and "".join(ch).strip(" "):
                first.setdefault("\n".join(ch), (i, p))
    for i, t in rows:
        kept = [ch for p, ch in enumerate(chunks(t)) if first.get("\n".join(ch), (i, p)) == (i, p)]
        result[i] = "\n".join(x for ch in kept for x in ch)
    return result


def test_line_dedup_matches_brute_force(docs, local):
    rows = list(zip(local.doc_id.tolist(), local.text.tolist(), strict=True))
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs).collect()}
    assert got == brute_lines(rows)


def test_line_dedup_finds_shifted_blocks(spark):
    rng = random.Random(8)
    line = lambda: " ".join("".join(rng.choice("abcdef") for _ in range(6)) for _ in range(4))
    block = [line() for _ in range(40)]
    rows = [(k, "\n".join([line() for _ in range(k)] + block + [line() for _ in range(3)])) for k in range(1, 6)]
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs_of(spark, rows)).collect()}
    assert got[1]["lines_removed"] == 0 and all(got[k]["lines_removed"] >= 25 for k in range(2, 6))
    assert {i: r["text"] for i, r in got.items()} == brute_lines(rows)


def test_line_dedup_of_odd_rows(spark):
    got = line_dedup.dedup_lines(docs_of(spark, ODD).withColumn("lines_removed", F.lit("x")))
    assert Counter((r["doc_id"], r["text"], r["lines_removed"]) for r in got.collect()) == Counter((i, t, 0) for i, t in ODD)
    assert line_dedup.dedup_lines(docs_of(spark, [])).count() == 0


def brute_passages(rows):
    first, gone = {}, defaultdict(set)
    for i, t in sorted(rows):
        ls = (t or "").split("\n")
        for p in range(len(ls) - 1):
            if (ls[p] + ls[p + 1]).strip(" ") and first.setdefault((ls[p], ls[p + 1]), (i, p)) != (i, p):
                gone[i] |= {p, p + 1}
    return {i: ("\n".join(x for p, x in enumerate((t or "").split("\n")) if p not in gone[i]), len(gone[i])) for i, t in rows}


@pytest.mark.parametrize("digest", [16, 1])
def test_passages_match_brute_force_even_with_colliding_digests(docs, local, digest):
    rows = list(zip(local.doc_id.tolist(), local.text.tolist(), strict=True))
    got = {r["doc_id"]: (r["text"] or "", r["lines_removed"]) for r in line_dedup.dedup_passages(docs, digest=digest).collect()}
    assert got == brute_passages(rows)


@pytest.mark.parametrize("n", [2, 3, 5])
def test_short_passages_go_whole_whatever_surrounds_them(spark, n):
    rng = random.Random(n)
    line = lambda: " ".join("".join(rng.choice("abcdef") for _ in range(6)) for _ in range(4))
    block = [line() for _ in range(n)]
    hosts = [([line() for _ in range(rng.randint(1, 6))], [line() for _ in range(rng.randint(1, 6))]) for _ in range(30)]
    rows = [(k, "\n".join(a + block + b)) for k, (a, b) in enumerate(hosts)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_passages(docs_of(spark, rows)).collect()}
    assert got == {k: "\n".join(a + (block if k == 0 else []) + b) for k, (a, b) in enumerate(hosts)}


def test_passages_of_odd_rows(spark):
    got = line_dedup.dedup_passages(docs_of(spark, ODD).withColumn("lines_removed", F.lit("x")))
    assert Counter((r["doc_id"], r["text"], r["lines_removed"]) for r in got.collect()) == Counter((i, t, 0) for i, t in ODD)
    assert line_dedup.dedup_passages(docs_of(spark, [])).count() == 0


def test_line_dedup_query_removes_repeated_runs_whole(spark, sf, local):
    want = brute_passages(list(zip(local.doc_id.tolist(), local.text.tolist(), strict=True)))
    got = {r["doc_id"]: r["lines_removed"] for r in queries.op10_line_dedup(spark, sf).collect()}
    assert got == {i: n for i, (_, n) in want.items()} and sum(got.values()) > 0


# html


@pytest.fixture(scope="module")
def model():
    return html_extract.train()


def test_extraction_on_unseen_pages(model):
    hit = extra = missed = 0
    for page, wanted in html_samples.labelled_pages(150, 99):
        got = set(filter(None, html_extract.main_text(page, model).split("\n")))
        size = lambda xs: sum(len(x.split()) for x in xs)
        hit, extra, missed = hit + size(got & wanted), extra + size(got - wanted), missed + size(wanted - got)
    assert hit / (hit + extra) > 0.98 and hit / (hit + missed) > 0.98


def test_marginals_are_exact(model):
    """Against the sum over all labellings of a small page."""
    import itertools

    nodes = html_extract.parse("<div><p>one two three. four.</p><ul><li><a href=x>go</a></ul></div>")
    unary = [model.unary(nodes, k) for k in range(len(nodes))]
    total, on = 0.0, np.zeros(len(nodes))
    for y in itertools.product((0, 1), repeat=len(nodes)):
        e = sum(unary[k][v] for k, v in enumerate(y))
        for k in range(1, len(nodes)):
            e += model.edge[html_extract._GROUP.get(nodes[k].tag, "other")][y[nodes[k].parent]][y[k]]
        total += np.exp(e)
        on += np.exp(e) * np.array(y)
    assert np.allclose(on / total, model.marginals(nodes))


def test_extraction_of_odd_pages(spark, model):
    rows = [(1, None), (2, ""), (3, "Plain words, with no markup at all."), (4, "<p>5 < 6 &amp; 7 &eacute;&#233;\n\t go  on and on here, then.</p>"), (5, "<!-- open <p>lost"), (6, "<article><p>One<br>two <b>three.<p>Four &nbsp; five.</article>"), (6, "<script>x</script>")]
    df = spark.createDataFrame(rows, "page_id long, html string").withColumn("text", F.lit("old"))
    got = [(r["page_id"], r["text"], r["n_chars"]) for r in html_extract.extract(df, model=model).collect()]
    want = ["", "", "Plain words, with no markup at all.", "5 < 6 & 7 éé go on and on here, then.", "", "One two three.\nFour five.", ""]
    assert sorted(got) == sorted((i, t, len(t)) for (i, _), t in zip(rows, want, strict=True))
    assert html_extract.extract(df.where("false"), model=model).count() == 0


# licences


def test_license_families(spark):
    rows = [(1, "Prose about nothing.\nLicensed under the Apache License, Version 2.0.\nmore"), (2, "Released under the MIT License."), (3, "Licensed under CC BY-NC 4.0."), (4, "This work is licensed under the GNU General Public License, version 3."), (5, "Licensed under the Floobly Public License, version 9."), (6, "He had to renew his driver's license before the trip."), (7, None), (8, ""), (2, "Released under the MIT License."), (None, "Licensed under CC BY 4.0.")]
    got = Counter((r["doc_id"], r["line"], r["family"], r["confirmed"]) for r in license_scan.scan_licenses(docs_of(spark, rows).withColumn("family", F.lit(1))).collect())
    assert got == {(1, 1, "apache-2.0", True): 1, (2, 0, "mit", True): 2, (3, 0, "cc-by-nc", True): 1, (4, 0, "gpl", True): 1, (5, 0, "unknown", False): 1, (None, 0, "cc-by", True): 1}
    assert license_scan.scan_licenses(docs_of(spark, [])).count() == 0


def test_license_scores_match_the_model(spark):
    m = license_scan.classifier()
    text = "This code is distributed under the terms of the MIT License."
    x, _ = m._matrix([(license_scan.grams_of(text), 0)])
    p = license_scan._softmax((x @ m.weights + m.bias) / m.temperature)[0]
    r = license_scan.scan_licenses(docs_of(spark, [(1, text)])).first()
    assert r["family"] == license_scan.CLASSES[int(p.argmax())] and r["probability"] == pytest.approx(p.max(), abs=1e-4)
    assert m.held_accuracy > 0.6  # of whole notices never seen in training


# queries


def test_queries_with_sql(spark, sf):
    from tests.oracle import connect, normal

    con = connect(sf)
    for name, sql in queries.oracle_sql().items():
        assert normal(queries.queries()[name](spark, sf).toPandas()) == normal(con.sql(sql).df()), name


def test_every_operator_has_its_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 11))


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names, n = set(docs.columns), docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf), "test")
        assert set(docs.columns) == names and 0 < docs.count() <= n
        n = docs.count()
    out = corpus_pipeline.STAGES[-1][1](spark, docs, sf).toPandas()
    check_packing(out, 2048)
    assert out.doc_id.nunique() == n
