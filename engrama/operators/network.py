"""Small-graph reasoning in grouped frames: belief networks, plans, analogies, schemas. A group is one bounded subgraph."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def belief_propagation(variables: DataFrame, factors: DataFrame, rounds: int = 30, damping: float = 0.5, tolerance: float = 1e-4) -> DataFrame:
    """(grp, node, mean) after damped message passing in each group.

    variables: (grp, node, prior, weight); factors: (grp, a, b, kind, strength, confidence), kind agree or oppose.
    A message pulls a node toward (agree) or away from (oppose) the other end's mean; the posterior is the mean of
    prior and messages, weighted by `weight` for the prior, within [0.001, 0.999].
    """

    def solve(pdf: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        nodes = {n: k for k, n in enumerate(pdf["node"])}
        prior, weight = pdf["prior"].to_numpy(np.float64), pdf["weight"].to_numpy(np.float64)
        e = edges[edges["a"].isin(nodes) & edges["b"].isin(nodes)]
        a, b = e["a"].map(nodes).to_numpy(np.int64), e["b"].map(nodes).to_numpy(np.int64)
        pull = np.where(e["kind"].to_numpy() == "oppose", -1.0, 1.0) * e["strength"].to_numpy(np.float64) * e["confidence"].to_numpy(np.float64)
        src, dst, pull = np.r_[a, b], np.r_[b, a], np.r_[pull, pull]
        mean, message = prior.copy(), np.full(len(src), 0.5)
        for _ in range(rounds):
            new = 0.5 + pull * (mean[src] - 0.5)
            message = damping * message + (1 - damping) * new
            total = weight * prior + np.bincount(dst, message, len(prior))
            after = np.clip(total / (weight + np.bincount(dst, minlength=len(prior))), 0.001, 0.999)
            done = len(mean) == 0 or np.abs(after - mean).max() < tolerance
            mean = after
            if done:
                break
        return pd.DataFrame({"grp": pdf["grp"], "node": pdf["node"], "mean": mean})

    return variables.groupBy("grp").cogroup(factors.groupBy("grp")).applyInPandas(solve, "grp string, node string, mean double")


def plans(actions: DataFrame, goals: DataFrame, depth: int = 4, beam: int = 6) -> DataFrame:
    """(grp, goal, plan, score): best backward chains per goal by bounded beam search.

    actions: (grp, action, needs array<string>, gives array<string>, chance, utility); goals: (grp, goal, have array<string>).
    The score is .30 feasibility, .25 utility, .15 simplicity, .20 geometric mean chance, of at most `depth` steps.
    """

    def search(acts: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        table = [(r.action, set(r.needs), set(r.gives), float(r.chance), float(r.utility)) for r in acts.sort_values("action").itertuples()]
        out = []
        for g in wanted.sort_values("goal").itertuples():
            front = [((), frozenset([g.goal]), 1.0, 0.0)]
            best = None
            for _ in range(depth):
                grown = []
                for steps, need, chance, utility in front:
                    for name, needs, gives, p, u in table:
                        if name in steps or not need & gives:
                            continue
                        left = frozenset((need - gives) | (needs - set(g.have)))
                        grown.append(((name, *steps), left, chance * p, max(utility, u * p)))
                ready = [x for x in grown if not x[1]]
                for steps, _, chance, utility in ready:
                    n = len(steps)
                    score = 0.30 * chance + 0.25 * utility + 0.15 / (1 + 0.3 * (n - 1)) + 0.20 * max(chance, 0.1) ** (1 / n)
                    best = max(best or (-1.0, ()), (round(score, 9), steps))
                front = sorted((x for x in grown if x[1]), key=lambda x: (len(x[1]), -x[2], x[0]))[:beam]
            if best:
                out.append((acts["grp"].iloc[0], g.goal, list(best[1]), best[0]))
        return pd.DataFrame(out, columns=["grp", "goal", "plan", "score"])

    return actions.groupBy("grp").cogroup(goals.groupBy("grp")).applyInPandas(search, "grp string, goal string, plan array<string>, score double")


def analogies(pairs: DataFrame) -> DataFrame:
    """(pair, mapping, similarity): greedy one-to-one node mapping of two subgraphs by shared relations.

    pairs: (pair, side 0 or 1, src, rel, dst).
    """

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        sides = []
        for s in (0, 1):
            rows = pdf[pdf["side"] == s]
            own: dict = {}
            for r in rows.itertuples():
                own.setdefault(r.src, set()).add(("out", r.rel))
                own.setdefault(r.dst, set()).add(("in", r.rel))
            sides.append((own, {(r.src, r.rel, r.dst) for r in rows.itertuples()}))
        (a, ea), (b, eb) = sides
        # nodes with equal relations score alike, so levels of the score are gone through by sets of relations
        free, levels = {}, {}
        for side, own in ((0, a), (1, b)):
            for x in sorted(own, reverse=True):
                free.setdefault((side, frozenset(own[x])), []).append(x)
        for x in [k for side, k in free if side == 0]:
            for y in [k for side, k in free if side == 1]:
                levels.setdefault(len(x & y) / len(x | y), {}).setdefault(x, []).append(y)
        mapping, quality = {}, []
        for q in sorted((q for q in levels if q > 0.1), reverse=True):
            for x in sorted(n for k in levels[q] for n in free[0, k]):
                least = min((free[1, k] for k in levels[q][frozenset(a[x])] if free[1, k]), key=lambda names: names[-1], default=None)
                if least:
                    mapping[x] = least.pop()
                    quality.append(q)
            for k in levels[q]:
                free[0, k] = [n for n in free[0, k] if n not in mapping]
        kept = sum((mapping.get(x), r, mapping.get(y)) in eb for x, r, y in ea)
        cover, edge = len(mapping) / max(1, len(a), len(b)), kept / max(1, len(ea))
        sim = 0.25 * cover * (sum(quality) / max(1, len(quality))) + 0.45 * edge + 0.30 * kept / max(1, len(ea), len(eb))
        return pd.DataFrame({"pair": [pdf["pair"].iloc[0]], "mapping": [[f"{x}>{y}" for x, y in sorted(mapping.items())]], "similarity": [sim]})

    return pairs.groupBy("pair").applyInPandas(compare, "pair string, mapping array<string>, similarity double")


def schemas(episodes: DataFrame, least: int = 3) -> DataFrame:
    """(action, conditions, support, confidence): the conditions that all successful episodes of an action share.

    episodes: (action, conditions array<string>, success boolean). Counted per condition, so nothing is gathered.
    """
    from pyspark.sql import functions as F

    n = episodes.groupBy("action").agg(F.count_if("success").alias("support"), F.count_if(~F.col("success")).alias("contra")).where(F.col("support") >= least)
    c = episodes.where("success").select("action", F.explode(F.array_distinct("conditions")).alias("condition")).groupBy("action", "condition").agg(F.count("*").alias("k"))
    shared = c.join(n, "action").where("k = support").groupBy("action").agg(F.array_sort(F.collect_set("condition")).alias("conditions"))
    return n.join(shared, "action", "left").select("action", F.coalesce("conditions", F.array().cast("array<string>")).alias("conditions"), "support", (F.col("support") / (F.col("support") + F.col("contra"))).alias("confidence"))
