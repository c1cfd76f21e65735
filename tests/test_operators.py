"""Operators on small fixtures: cases the tables don't hold."""

import math
import random

import numpy as np
import pytest
from engrama.functions import scoring as S
from engrama.functions import text as T
from engrama.functions import timing as G
from engrama.operators import beliefs as B
from engrama.operators import claims as claims_op
from engrama.operators import events as E
from engrama.operators import graph, memory, moves, patterns, retrieval
from pyspark.sql import functions as F


def test_decay_halves_after_a_half_life(spark):
    rows = spark.createDataFrame([(0.8, 100.0, 0.0), (1.0, 100.0, 100.0), (0.8, 0.0, 5.0)], "i double, h double, e double")
    got = [r[0] for r in rows.select(S.decay_score(F.col("i"), F.col("h"), F.col("e"))).collect()]
    assert got == pytest.approx([0.8, 0.5, 0.0])


def test_relevance_beats_importance(spark):
    rows = spark.createDataFrame([(0.1, 1.0), (0.6, 0.3)], "sim double, imp double")
    half = F.lit(0.5)
    a, b = [r[0] for r in rows.select(S.composite_score(F.col("sim"), half, half, F.col("imp"), F.lit(0.0))).collect()]
    assert b > a


@pytest.mark.parametrize("text", ["my proudest moment", "the worst, saddest day", "plain words", "", "UPSET but happy", "up no"])
def test_sentiment_is_the_same_on_driver_and_column(spark, text):
    got = spark.createDataFrame([(text,)], "t string").select(S.text_sentiment(F.col("t"))).first()[0]
    assert got == S.query_sentiment(text)


def test_contains_sequence_needs_whole_words(spark):
    rows = spark.createDataFrame([("The New York Times", "new york"), ("newer yorks", "new york"), ("", "x"), (None, "x"), ("a", "")], "t string, e string")
    assert [r[0] for r in rows.select(T.contains_sequence(F.col("t"), F.col("e"))).collect()] == [True, False, False, False, False]


def test_allen_relations_cover_all_thirteen(spark):
    cases = {(0, 10, 20, 30): "before", (20, 30, 0, 10): "after", (0, 10, 10, 20): "meets", (10, 20, 0, 10): "met_by", (0, 15, 10, 20): "overlaps", (10, 20, 0, 15): "overlapped_by", (0, 5, 0, 10): "starts", (0, 10, 0, 5): "started_by", (3, 6, 0, 10): "during", (0, 10, 3, 6): "contains", (5, 10, 0, 10): "finishes", (0, 10, 5, 10): "finished_by", (0, 10, 0, 10): "equals"}
    rows = spark.createDataFrame([tuple(map(float, k)) for k in cases], "a double, b double, c double, d double")
    assert [r[0] for r in rows.select(G.allen(*map(F.col, "abcd"))).collect()] == list(cases.values())


def test_expand_takes_fewest_hops_then_best_weight(spark):
    edges = spark.createDataFrame([("a", "r", "b", 0.5), ("a", "r", "c", 0.9), ("b", "r", "d", 1.0), ("c", "r", "d", 0.2), ("d", "r", "e", 1.0)], "src string, rel string, dst string, weight double")
    got = {r["entity"]: (r["hops"], round(r["weight"], 6)) for r in graph.expand(edges, spark.createDataFrame([("a",)], "entity string"), 2).collect()}
    assert got == {"a": (0, 1.0), "b": (1, 0.5), "c": (1, 0.9), "d": (2, 0.5)}


def test_layers_find_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x")], "src string, dst string")
    done, left = graph.layers(edges)
    assert {r["node"]: r["layer"] for r in done.collect()} == {"a": 0, "b": 1, "c": 2}
    assert {r["node"] for r in left.collect()} == {"x", "y"}


def test_nearest_matches_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 8))
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "rid long, v array<double>")
    q = v.where("rid < 7").select(F.col("rid").alias("query_id"), "v")
    got = retrieval.nearest(v, q, 5, block=3).toPandas()
    n = x / np.linalg.norm(x, axis=1, keepdims=True)
    sim = n @ n.T
    for i in range(7):
        assert set(got[got.query_id == i].rid) == set(np.argsort(-sim[i])[:5])


def test_diversify_skips_near_copies(spark):
    rows = [(0, 1, 1.0, [1.0, 0.0]), (0, 2, 0.99, [1.0, 0.001]), (0, 3, 0.5, [0.0, 1.0])]
    got = retrieval.diversify(spark.createDataFrame(rows, "query_id long, rid long, score double, v array<double>"), 3).toPandas()
    assert list(got.sort_values("pick").rid) == [1, 3]


def test_greedy_clusters_respect_time_and_size(spark):
    rows = [("n", i, 1000.0 * i, [1.0, 0.01 * i]) for i in range(5)] + [("n", 9, 86400.0 * 40, [1.0, 0.0])]
    got = patterns.greedy_clusters(spark.createDataFrame(rows, "namespace string, rid long, created_at double, v array<double>"), 0.9, 30.0, 2, 3).toPandas()
    assert sorted(got.groupby("cluster").rid.count()) == [2, 3] and 9 not in set(got.rid)


def brute_clusters(rows, threshold, days, smallest, largest, entities=None):
    rows, used, out = sorted(rows, key=lambda r: (r[2], r[1])), set(), {}
    unit = {r[1]: np.array(r[3]) / np.linalg.norm(r[3]) for r in rows}
    for g, i, t, _ in rows:
        if i in used:
            continue
        used.add(i)
        own = [i]
        for h, j, u, _ in rows:
            named = entities and entities.get(i) and entities.get(j)
            if h == g and j not in used and u - t <= days * 86400 and unit[i] @ unit[j] >= threshold and not (named and entities[i].isdisjoint(entities[j])) and len(own) < largest:
                own.append(j)
                used.add(j)
        if len(own) >= smallest:
            out[i] = set(own)
    return out


@pytest.mark.parametrize("named", [False, True])
def test_greedy_clusters_match_brute_force_across_slot_borders(spark, named):
    rng = np.random.default_rng(4)
    rows = [(f"n{i % 2}", i, float(86400 * rng.integers(20, 100) + rng.integers(86400)), rng.normal(size=3).tolist()) for i in range(300)]
    rows += [("b", 1000, 86400.0 * 30 - 60, [1.0, 0.0]), ("b", 1001, 86400.0 * 30 + 60, [1.0, 0.0])]
    entities = {i: {f"e{k}" for k in rng.integers(0, 4, rng.integers(0, 3))} for i in range(300)}
    links = spark.createDataFrame([(i, e) for i, es in entities.items() for e in es], "rid long, entity string")
    got = patterns.greedy_clusters(spark.createDataFrame(rows, "namespace string, rid long, created_at double, v array<double>"), 0.9, 30.0, 2, 5, entities=links if named else None, block=32).toPandas()
    assert {k: set(g) for k, g in got.groupby("cluster").rid} == brute_clusters(rows, 0.9, 30.0, 2, 5, entities if named else None)
    assert set(got[got.namespace == "b"].rid) == {1000, 1001}


def test_extractive_summary_joins_whole_texts_without_repeats_of_the_lead(spark):
    lead, long = "the lead text, longer than twenty characters", "x" * 300
    rows = [(1, 1, 0.9, lead), (1, 2, 0.5, f" {lead} "), (1, 3, 0.7, f"  {long}\n"), (1, 4, 0.4, " \t"), (1, 5, 0.3, None), (1, 6, 0.7, "last"), (2, 7, 0.1, " alone ")]
    got = patterns.extractive_summary(spark.createDataFrame(rows, "session_id long, rid long, importance double, text string"), "session_id").collect()
    assert {r["session_id"]: (r["summary"], r["n"]) for r in got} == {1: (f"{lead} | {long} | last", 6), 2: (" alone ", 1)}


@pytest.mark.parametrize("block", [8, 1024])
def test_co_occurrence_counts_hubs(spark, block):
    rows = [(f"s{i}", f"hub{k}") for i in range(70) for k in range(3)] + [(f"s{i}", f"d{i % 9}") for i in range(70)] + [("s1", "hub0")]
    got = patterns.co_occurrence(spark.createDataFrame(rows, "src string, dst string"), block=block).collect()
    assert len(got) == 70 * 69 // 2
    assert {(r["a"], r["b"]): r["shared"] for r in got} == {(a, b): 4 if int(a[1:]) % 9 == int(b[1:]) % 9 else 3 for a in {r[0] for r in rows} for b in {r[0] for r in rows} if a < b}


def test_ranking_loss_matches_pairs(spark):
    rng = random.Random(2)
    rows = [(q, rng.random() < 0.5, rng.random()) for q in range(5) for _ in range(30)]
    got = {r[0]: r[1] for r in B.ranking_loss(spark.createDataFrame(rows, "query_id long, relevant boolean, score double")).collect()}
    for q in range(5):
        own = [(a, s) for k, a, s in rows if k == q]
        pairs = [max(0, 0.05 - (s - t)) ** 2 for a, s in own if a for b, t in own if not b]
        assert got[q] == pytest.approx(sum(pairs) / len(pairs), abs=1e-9)


def test_pooling_is_monotone_and_keeps_the_mean(spark):
    actual = [0.1, 0.4, 0.3, 0.2, 0.6, 0.5, 0.9, 0.8, 0.85, 1.0]
    bins = spark.createDataFrame([(i, 10, 0.1 * i, a) for i, a in enumerate(actual)], "bin int, n long, predicted double, actual double")
    fit = [r["fitted"] for r in B.pooled(bins).orderBy("bin").collect()]
    assert all(b >= a - 1e-12 for a, b in zip(fit, fit[1:], strict=False)) and sum(fit) == pytest.approx(sum(actual))


def test_ewma_matches_a_loop(spark):
    xs = [1.0, 2.0, 1.5, 9.0, 2.0]
    got = spark.createDataFrame([(xs,)], "x array<double>").select(E.ewma(F.col("x")).alias("s")).first()["s"]
    n, mean, var, z = 0, 0.0, 0.0, 0.0
    for x in xs:
        d = x - mean
        z = 0.0 if n < 3 or math.sqrt(var) < 1e-10 else d / math.sqrt(var)
        mean, var = (x, 0.0) if n == 0 else (mean + 0.2 * d, 0.8 * (var + 0.2 * d * d))
        n += 1
    assert (got["mean"], got["var"], got["z"]) == pytest.approx((mean, var, z))


def test_latest_keeps_the_greatest_clock(spark):
    rows = spark.createDataFrame([(1, 5, 0, "a"), (1, 5, 2, "b"), (1, 4, 9, "c"), (2, 1, 0, "d")], "k long, ms long, n long, v string")
    assert {r["k"]: r["v"] for r in memory.latest(rows, ["k"], ["ms", "n"]).collect()} == {1: "b", 2: "d"}


def test_empty_tables_give_empty_results(spark, sf):
    from engrama.sources import adapters as A

    none = A.memories(spark, sf).where("false")
    assert memory.stale(none, 1, A.NOW, 10).count() == 0
    assert patterns.hour_of_week_clusters(none, 1).count() == 0
    assert B.ranking_loss(A.feedback(spark, sf).where("false")).count() == 0


def test_streaming_matches_batch(spark, sf, tmp_path):
    from engrama.sources import adapters as A
    from engrama.streaming import observer

    e = A.events(spark, sf).select("event_id", "ts", "user_id", "kind", "value").where("user_id < 10").orderBy("ts").coalesce(1)
    e.write.parquet(f"{tmp_path}/in")
    stream = observer.read_events(spark, f"{tmp_path}/in", e.schema)
    q = observer.online_statistics(stream).writeStream.format("memory").queryName("stats").outputMode("update").option("checkpointLocation", f"{tmp_path}/ck").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = spark.table("stats").toPandas().sort_values("n").groupby("user_id").last()
    rows = B.ordered(A.events(spark, sf).where("user_id < 10"), ["user_id"], ["t", "event_id"], F.col("value"))
    want = rows.select("user_id", E.ewma(F.col("xs")).alias("s")).select("user_id", "s.mean", "s.n").toPandas().set_index("user_id")
    assert np.allclose(got["mean"].sort_index(), want["mean"].sort_index()) and (got["n"].sort_index() == want["n"].sort_index()).all()
    ops = spark.readStream.schema(e.schema).parquet(f"{tmp_path}/in").select(F.col("event_id").alias("op_id"), "value")
    for k in range(2):
        q = observer.fold_oplog(ops, f"{tmp_path}/log", f"{tmp_path}/ck{k}").start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
    assert spark.read.parquet(f"{tmp_path}/log").count() == e.count()


def test_sliding_rates_stream(spark, sf, tmp_path):
    from engrama.sources import adapters as A
    from engrama.streaming import observer

    e = A.events(spark, sf).select("event_id", "ts", "user_id", "kind", "value").coalesce(1)
    e.write.parquet(f"{tmp_path}/in")
    q = observer.rates(observer.read_events(spark, f"{tmp_path}/in", e.schema)).writeStream.format("memory").queryName("rates").outputMode("complete").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert spark.table("rates").agg(F.sum("n")).first()[0] == 12 * e.count()


# evidence

CLAIM = "claim_id string, src string, rel string, dst string, namespace string, polarity int, extractor string, lineage array<string>, weight double, self_generated boolean, modality int, source_rid long, valid_from double, valid_to double, created_at double"


def claims_of(spark, rows):
    """Claims of one proposition, as (polarity, extractor, lineage) and what differs from the usual."""
    full = []
    for k, (polarity, extractor, lineage, *more) in enumerate(rows):
        own = {"weight": 1.0, "self_generated": False, "modality": 0, "rid": None, "f": None, "t": None, "ns": "default"} | (more[0] if more else {})
        full.append((f"c{k}", "s", "r", "d", own["ns"], polarity, extractor, lineage, own["weight"], own["self_generated"], own["modality"], own["rid"], own["f"], own["t"], float(k)))
    return spark.createDataFrame(full, CLAIM)


def test_independent_sources_count_in_full(spark):
    r = claims_op.mass(claims_of(spark, [(1, "x", ["a"]), (1, "y", ["b"]), (1, "z", ["c"])])).first()
    assert (r["support"], r["attack"], r["support_independence"]) == (3.0, 0.0, 3.0)


def test_shared_lineage_is_discounted(spark):
    rows = [(1, "w", ["w"]), (1, "e", ["w", "e"]), (-1, "f", ["f"]), (-1, "p", ["p"]), (-1, "o", ["o"]), (-1, "b", ["b", "p", "o"])]
    r = claims_op.mass(claims_of(spark, rows)).first()
    assert (round(r["support"], 3), round(r["attack"], 3)) == (1.6, 3.578)


def test_discount_by_extractor_and_self_generation(spark):
    rows = [(1, "x", [], {"self_generated": True}), (1, "x", [], {"self_generated": True}), (1, "y", [])]
    got = sorted(r["omega"] for r in claims_op.omegas(claims_of(spark, rows)).collect())
    assert got == pytest.approx([1 / (1 + 0.3 / 2 + 0.7)] * 2 + [1.0])


@pytest.mark.parametrize("seed", range(6))
def test_contest_counts_match_pairs(spark, seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(14):
        f = rng.choice([None, rng.randint(0, 9)])
        own = {"rid": rng.choice([None, 1, 2]), "f": None if f is None else float(f), "t": rng.choice([None, float((f or 0) + rng.randint(0, 4))]), "weight": rng.random()}
        rows.append((rng.choice([1, -1]), rng.choice("xy"), sorted(rng.sample("abc", rng.randint(0, 2))), own))
    r = claims_op.contest_state(claims_of(spark, rows)).first()
    inf = float("inf")
    want = {"same_source": 0, "same_artifact": 0, "overlapping": 0, "separable": 0}
    for _, xa, la, a in (x for x in rows if x[0] == 1):
        for _, xb, lb, b in (x for x in rows if x[0] == -1):
            want["same_source"] += bool(la) and la == lb
            want["same_artifact"] += a["rid"] is not None and a["rid"] == b["rid"] and xa != xb
            span = lambda o: (-inf if o["f"] is None else o["f"], inf if o["t"] is None else o["t"])
            (a0, a1), (b0, b1) = span(a), span(b)
            want["separable" if a1 < b0 or b1 < a0 else "overlapping"] += 1
    assert {k: r[k] for k in want} == want
    assert r["flags"] & 26 == 2 * (want["same_source"] > 0) + 8 * (want["same_artifact"] > 0) + 16 * (want["overlapping"] > 0)


def test_duplicates_and_namespaces_are_flagged(spark):
    many = [(1, "x", ["a"], {"weight": 3.0}), (1, "x", ["a"], {"weight": 3.0})]
    assert claims_op.contest_state(claims_of(spark, many)).first()["flags"] == claims_op.DUPLICATION_RISK
    apart = [(1, "x", ["a"]), (1, "y", ["b"], {"ns": "other"})]
    assert {r["flags"] for r in claims_op.contest_state(claims_of(spark, apart)).collect()} == {claims_op.HETEROGENEOUS}
    assert claims_op.flagged(claims_of(spark, apart), claims_op.SAME_SOURCE).count() == 0


def test_candidates_are_promoted_once_and_with_a_lesson(spark):
    rows = spark.createDataFrame([(1, "candidate"), (2, "candidate"), (2, "confirmed")], "move_id long, status string")
    got = {(r["move_id"], r["status"], r["lesson"]) for r in moves.promote(rows, 2, "look twice", "ann").collect()}
    assert got == {(1, "candidate", None), (2, "confirmed", "look twice"), (2, "confirmed", None)}
    with pytest.raises(ValueError):
        moves.promote(rows, 2, " ", "ann")
