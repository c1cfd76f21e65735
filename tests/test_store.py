"""The store, relation extraction, clocks, small-graph reasoning, the whole recall and the reasoning pipeline."""

import random

import pytest
from engrama.functions import extraction as X
from engrama.functions.security import Clock
from engrama.operators import network as N
from engrama.plans.reason import Reason
from engrama.sources import adapters as A
from engrama.sources.store import Store, tenants
from pyspark.sql import functions as F


def test_store_life_cycle(spark, tmp_path):
    s = Store(spark, f"{tmp_path}/a")
    one = s.record("Alice met Bob in Paris", 100.0, importance=0.9)
    s.record_batch(spark.createDataFrame([("r2", "plain", 0.2), ("r3", "other", None)], "rid string, text string, importance double"), 101.0)
    assert s.get(one)["importance"] == 0.9 and s.get("r3")["importance"] == 0.5 and s.get("none") is None
    assert {r["entity"] for r in s.view("links").where(F.col("rid") == one).collect()} == {"Alice", "Bob", "Paris"}
    assert s.reinforce("r2", 200.0) and s.get("r2")["half_life"] == pytest.approx(604800 * 1.2) and s.get("r2")["access_count"] == 1
    new = s.correct("r2", "plainer", 201.0)
    assert s.get("r2")["status"] == "tombstoned" and s.get(new)["importance"] == 0.2
    assert s.archive("r3", 202.0) and s.get("r3")["storage_tier"] == "cold" and s.hydrate("r3", 203.0) and s.get("r3")["storage_tier"] == "hot"
    assert s.forget(one, 204.0) and not s.forget("none", 204.0)
    sid = s.session_start("cli", 300.0)
    with pytest.raises(ValueError):
        s.session_start("cli", 301.0)
    assert s.session_end(sid, 310.0)["seconds"] == 10.0 and s.session_start("cli", 320.0)
    s.relate("a", "knows", "b", 330.0)
    s.relate("a", "knows", "b", 331.0, weight=0.5)
    assert [r["weight"] for r in s.view("edges").collect()] == [0.5]

    t = Store(spark, f"{tmp_path}/b", actor="peer", node=1)
    assert t.apply_ops(s.ops_since(), 400.0) > 0
    assert t.get(one)["status"] == "tombstoned" and t.get(new)["text"] == "plainer"
    before = t.versions("oplog").count()
    t.apply_ops(s.ops_since(), 401.0)
    assert t.versions("oplog").count() == before

    s.export(f"{tmp_path}/dump")
    u = Store(spark, f"{tmp_path}/c")
    u.import_(f"{tmp_path}/dump", 500.0)
    u.import_(f"{tmp_path}/dump", 501.0)
    assert u.versions("memories").count() == s.view("memories").count() and u.get("r3")["text"] == "other"
    assert tenants(spark, str(tmp_path)) == ["a", "b", "c", "dump"]


def test_clocks_order_as_causes_do():
    a = Clock(0, 0, 1)
    b = a.tick(5)
    c = b.tick(5)
    d = Clock(0, 0, 2).receive(c, 3)
    assert a < b < c and d > Clock(c.ms, c.counter, 0) and sorted([d.to_bytes(), b.to_bytes(), c.to_bytes()]) == [b.to_bytes(), c.to_bytes(), d.to_bytes()]


def test_relations(spark):
    cases = {
        "Alice works at Acme Corp": {("Alice", "works_at", "Acme Corp", 1)},
        "Bob Stone is the CEO of Initech": set(),
        "Bob Stone is the ceo of Initech.": {("Bob Stone", "ceo_of", "Initech", 1)},
        "Carol is not married to Dave": {("Carol", "married_to", "Dave", -1)},
        "nothing here": set(),
        "": set(),
        None: set(),
    }
    rows = spark.createDataFrame([(t,) for t in cases], "t string").select("t", X.relations(F.col("t")).alias("r")).collect()
    for r in rows:
        assert {tuple(x) for x in r["r"]} == cases[r["t"]], r["t"]


def test_belief_propagation_pulls_both_ways(spark):
    v = spark.createDataFrame([("g", "a", 0.9, 4.0), ("g", "b", 0.5, 1.0), ("g", "c", 0.5, 1.0), ("h", "z", 0.3, 1.0)], "grp string, node string, prior double, weight double")
    f = spark.createDataFrame([("g", "a", "b", "agree", 1.0, 1.0), ("g", "a", "c", "oppose", 1.0, 1.0)], "grp string, a string, b string, kind string, strength double, confidence double")
    got = {(r["grp"], r["node"]): r["mean"] for r in N.belief_propagation(v, f).collect()}
    assert got["g", "b"] > 0.6 and got["g", "c"] < 0.4 and got["h", "z"] == pytest.approx(0.3)


def test_plans_chain_backwards(spark):
    a = spark.createDataFrame([("g", "bake", ["dough"], ["bread"], 0.9, 1.0), ("g", "mix", ["flour"], ["dough"], 0.8, 0.1), ("g", "buy", [], ["bread"], 0.1, 0.2)], "grp string, action string, needs array<string>, gives array<string>, chance double, utility double")
    g = spark.createDataFrame([("g", "bread", ["flour"]), ("g", "gold", [])], "grp string, goal string, have array<string>")
    got = {r["goal"]: r["plan"] for r in N.plans(a, g).collect()}
    assert got == {"bread": ["mix", "bake"]}


def test_analogy_of_equal_structures(spark):
    rows = [("p", 0, "sun", "pulls", "earth"), ("p", 0, "sun", "heavier", "earth"), ("p", 1, "core", "pulls", "shell"), ("p", 1, "core", "heavier", "shell")]
    r = N.analogies(spark.createDataFrame(rows, "pair string, side int, src string, rel string, dst string")).first()
    assert r["mapping"] == ["earth>shell", "sun>core"] and r["similarity"] == pytest.approx(1.0)


def test_reasoning_pipeline(spark, sf):
    r = Reason(A.NOW, A.memories(spark, sf), events=A.events(spark, sf)).constrain("importance > 0.5").recall(30).coherence_check(0.5).compare()
    out = r.execute()
    assert r.explain() == ["constrain", "recall", "coherence", "compare"] and out.count() == 30 and out.where("importance <= 0.5").count() == 0
    evidence = A.events(spark, sf).select(F.col("user_id").alias("rid"), (F.col("value") / 100).alias("weight"), F.col("t").alias("at"))
    assert Reason(A.NOW, A.memories(spark, sf), events=A.events(spark, sf)).believe(evidence).anticipate(1e7, "session_id").project(3600.0).plan(2).assess().execute().count() <= 2


def test_analogies_of_whole_subgraphs_match_all_node_pairs(spark):
    rng = random.Random(5)
    rows = sorted({(f"q{p}", side, f"{side}n{rng.randrange(12)}", rng.choice("abc"), f"{side}n{rng.randrange(12)}") for p in range(5) for side in (0, 1) for _ in range(25)})
    rows += [("wide", side, f"s{side}", "supplies", f"p{k}") for side in (0, 1) for k in range(600 + side)]
    got = {r["pair"]: r["mapping"] for r in N.analogies(spark.createDataFrame(rows, "pair string, side int, src string, rel string, dst string")).collect()}
    for p in {r[0] for r in rows}:
        sets = ({}, {})
        for _, side, src, rel, dst in (r for r in rows if r[0] == p):
            sets[side].setdefault(src, set()).add(("out", rel))
            sets[side].setdefault(dst, set()).add(("in", rel))
        want, used = {}, set()
        for q, x, y in sorted((-len(a & b) / len(a | b), x, y) for x, a in sets[0].items() for y, b in sets[1].items()):
            if -q > 0.1 and x not in want and y not in used:
                want[x] = y
                used.add(y)
        assert got[p] == [f"{x}>{y}" for x, y in sorted(want.items())], p


def test_analogies_query_maps_every_relation(spark, sf):
    from engrama.plans import catalog

    nodes = {}
    for r in A.edges(spark, sf).where("rel = 'supplies'").select("src", "dst").collect():
        nodes.setdefault(int(r["src"][1:]), set()).add(r["dst"])
    got = {r["pair"]: r["mapped"] for r in catalog.QUERIES["analogies"](spark, sf).collect()}
    both = [k for k in nodes if k % 2 == 0 and k + 1 in nodes]
    assert both and all(got[f"q{k // 2}"] == 1 + min(len(nodes[k]), len(nodes[k + 1])) for k in both)
