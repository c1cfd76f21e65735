"""Writes of the store beyond memories: claims, aliases, conflicts, categories, triggers, patterns, sync, learning, think; weights."""

import dataclasses
import random

import pytest
from engrama.functions.scoring import Weights
from engrama.operators import cognition as C
from engrama.sources.store import Store, register_tenant
from pyspark.sql import functions as F


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"{tmp_path}/a")


def test_claims_meet_their_contest(store):
    assert store.add_entity_alias("Bob", "Robert", 1.0) and not store.add_entity_alias("Bob", "Robert", 2.0) and not store.add_entity_alias("x", "x", 2.0)
    store.add_entity_alias("Bob", "Bobby", 3.0, namespace="work")
    assert (store.resolve_alias("Bob"), store.resolve_alias("Bob", "work"), store.resolve_alias("Al")) == ("Robert", "Bobby", "Al")
    one = store.ingest_claim("Bob", "lives_in", "Paris", 4.0, lineage=["A ", "a"])
    assert one["support"] == 1.0 and one["flags"] == 0
    two = store.ingest_claim("Robert", "lives_in", "Paris", 5.0, polarity=-1, extractor="other", lineage=["a"])
    assert two["same_source"] == 1 and two["overlapping"] == 1 and two["flags"] == 18
    again = store.ingest_claim("Robert", "lives_in", "Paris", 6.0, polarity=-1, extractor="other", lineage=["b"])
    assert again["claims"] == 2 and again["same_source"] == 0
    store.link_memory_entity("r1", "Robert", 7.0)
    assert store.view("links").count() == 1


def test_conflicts_from_open_to_settled(store):
    a, b = store.record("Ann lives in Rome", 1.0), store.record("Ann lives in Oslo", 2.0)
    key = store.create_conflict("minor", a, b, 3.0, entity="Ann", rel="lives_in")
    assert key and store.create_conflict("minor", b, a, 4.0, entity="Ann", rel="lives_in") is None
    assert store.reclassify_conflict(key, "identity_fact", 5.0) == {"type": "identity_fact", "learned": 2}
    assert store.substitution_members("learned_lives_in") == ["oslo", "rome"] and store.get_conflict(key)["priority"] == "critical"
    store.create_conflict("preference", "m1", "m2", 6.0)
    assert [r["type"] for r in store.get_conflicts().collect()] == ["identity_fact", "preference"] and store.get_conflicts(type="preference").count() == 1
    assert not store.resolve_conflict(key, "merge", 7.0) and store.resolve_conflict(key, "keep_b", 7.0) and not store.resolve_conflict(key, "keep_a", 8.0)
    assert store.get(a)["status"] == "tombstoned" and store.get(b)["status"] == "active"
    other = store.get_conflicts(status="open").first()["conflict_id"]
    assert store.dismiss_conflict(other, 9.0, "fine") and store.get_conflict(other)["status"] == "dismissed" and not store.dismiss_conflict("none", 9.0)
    assert store.learn_category_members("cities", [("Rome", 0.9), ("rome", 0.8), (" ", 0.1)], "seed", 10.0) >= 1
    assert store.learn_category_members("cities", [("Bern", 0.5)], "llm_suggested", 11.0) == 1 and store.substitution_members("cities") == ["rome"]
    assert store.reset_category_to_seed("cities", 12.0) == 1


def test_an_edge_against_another_opens_a_conflict(store):
    store.relate("Ann", "works_at", "Acme", 1.0)
    assert store.detect_edge_conflicts("Ann", "knows", "Bo", 2.0) == [] and len(store.detect_edge_conflicts("Ann", "works_at", "Blue", 3.0)) == 1
    assert store.detect_edge_conflicts("Ann", "works_at", "Blue", 4.0) == []


def test_triggers_move_through_their_states(spark, store):
    found = spark.createDataFrame([("a", 0.9, "k1", 1), ("b", 0.5, "k2", 9), ("b", 0.4, "k2", 9)], "kind string, urgency double, cooldown_key string, days int")
    assert store.persist_triggers(found, 100.0) == 2 and store.persist_triggers(found, 200.0) == 0
    top = store.get_pending_triggers(1).first()
    assert top["kind"] == "a" and not store.move_trigger(top["trigger_id"], "acted", 201.0) and store.move_trigger(top["trigger_id"], "delivered", 202.0) and store.move_trigger(top["trigger_id"], "acted", 203.0)
    assert store.expire_triggers(100.0 + 10 * 86400) == 1 and store.get_pending_triggers().count() == 0
    assert store.get_trigger_history().count() == 2 and store.get_trigger_history("b").first()["status"] == "expired"
    assert store.upsert_patterns(found.select(F.col("kind").alias("pattern"), F.col("cooldown_key").alias("dedup_key"), F.col("urgency").alias("confidence")), 1.0) == (2, 0)
    assert store.upsert_patterns(spark.createDataFrame([("a", "k1", 0.2)], "pattern string, dedup_key string, confidence double"), 2.0) == (0, 1)
    first = store.get_patterns("a").first()
    assert (first["confidence"], first["occurrences"]) == (0.9, 2) and store.get_patterns(status="active").count() == 2


def test_stores_exchange_what_they_lack(spark, tmp_path):
    a, b = Store(spark, f"{tmp_path}/a", actor="a"), Store(spark, f"{tmp_path}/b", actor="b", node=1)
    one, two = a.record("from a", 1.0), b.record("from b", 2.0)
    assert a.sync(b, 3.0) == (1, 1) and a.get(two)["text"] == "from b" and b.get(one)["text"] == "from a"
    assert a.sync(b, 4.0) == (0, 0) and a.get_peer_watermark("b") and a.get_peer_watermark("c") == ""
    registry = Store(spark, f"{tmp_path}/r")
    assert register_tenant(registry, "x", "/x", 1.0) and register_tenant(registry, "x", "/x", 2.0) and not register_tenant(registry, "x", "/y", 3.0)


def test_learning_prefers_what_feedback_prefers(spark, store):
    rng = random.Random(5)
    now = 40 * 86400.0
    rows = [(f"m{k}", "t", rng.random(), now - rng.random() * 30 * 86400) for k in range(40)]
    store.record_batch(spark.createDataFrame(rows, "rid string, text string, importance double, created_at double"), now)
    assert not store.run_learning(now) and store.load_learned_weights() == Weights()
    old = sorted(r[3] for r in rows)[20]
    shown = spark.createDataFrame([(f"q{k % 4}", r[0], r[3] > old, 0.3 + 0.3 * rng.random(), k, now) for k, r in enumerate(rows)], "query_text string, rid string, relevant boolean, score double, rank int, at double")
    store.append("feedback", shown, now)
    assert store.run_learning(now)
    w, was = store.load_learned_weights(), Weights()
    assert w.sim + w.decay + w.recency == pytest.approx(was.sim + was.decay + was.recency, abs=0.01) and w != was
    assert all(abs(getattr(w, k) - getattr(was, k)) <= 0.06 for k in ("sim", "decay", "recency", "tau", "alpha"))
    assert store.view("weights").first()["generation"] == 1 and dataclasses.asdict(w)


def test_think_does_a_whole_round(spark, store):
    now = 400 * 86400.0
    rows = [(f"m{k}", f"Anna met Boris on day {k}", 0.9, 0.9 if k % 2 else -0.9, now - (k * 9 + 1) * 86400, now - (k * 9 + 1) * 86400, "episodic" if k % 3 else "semantic", f"d{k % 2}") for k in range(30)]
    store.record_batch(spark.createDataFrame(rows, "rid string, text string, importance double, valence double, created_at double, last_access double, type string, domain string"), now)
    for k in range(5):
        store.relate("Anna", "knows", f"p{k}", now)
    store.create_conflict("identity_fact", "m1", "m2", now)
    sid = store.session_start("cli", now - 90 * 3600)
    store.session_end(sid, now - 80 * 3600)
    first = store.think(now, most=50)
    kinds = {t["kind"] for t in first["triggers"]}
    assert kinds >= {"decay_review", "consolidation_ready", "temporal_drift", "conflict_escalation", "relationship_insight", "session_awareness"}
    assert first["conflicts"] == 1 and first["expired"] == 0 and first["patterns_new"] >= 1 and not first["learned"]
    again = store.think(now + 3600, most=50)
    assert again["patterns_new"] == 0 and len(again["triggers"]) == len(first["triggers"])
    assert store.think(now + 30 * 86400, most=50)["expired"] > 0
    assert store.get(store.record_procedural("do it so", now, 0.7))["half_life"] == 4 * 604800.0


@pytest.mark.parametrize("seed", range(4))
def test_utility_step_matches_pairs(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.randint(0, 3), *[round(rng.random(), 3) for _ in range(4)]) for _ in range(25)]
    weights, rate, margin = [0.4, 0.3, 0.2, 0.1], 0.05, 0.1
    score = lambda r: round(sum(w * x for w, x in zip(weights, r[1:], strict=True)), 6)
    g, n = [0.0] * 4, 0
    for a in rows:
        for b in rows:
            if a[0] > b[0]:
                n += 1
                if score(a) - score(b) < margin - 1e-12:
                    g = [x + p - q for x, p, q in zip(g, a[1:], b[1:], strict=True)]
    moved = [min(1.0, max(0.01, w + x * rate / n)) for w, x in zip(weights, g, strict=True)]
    got = C.utility_weights(spark.createDataFrame(rows, "rank int, f0 double, f1 double, f2 double, f3 double"), weights, rate, margin)
    assert got == pytest.approx([m / sum(moved) for m in moved], abs=2e-3)
    assert C.utility_weights(spark.createDataFrame(rows[:1], "rank int, f0 double, f1 double, f2 double, f3 double"), weights) == weights


def test_variants_by_their_modes():
    assert C.assign_variant([(2, 2), (8, 2), (3, 3)], 0.0) == 1 and C.assign_variant([(1, 1), (1, 1)], 0.01) == 1
