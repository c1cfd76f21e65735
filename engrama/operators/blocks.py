"""Blocks of memories against a block of queries: each block answers all queries with its own best, and these are merged.

What a query takes is a best-of by a stated order, so a block's best of the same size lose nothing; no pair of a query and
a memory beyond them is ever written.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engrama.functions import scoring as S
from engrama.functions import text as T
from engrama.operators.frames import settled

K1, B = 1.2, 0.75
#: Memories of a block; queries whose similarities are held at a time; texts whose tokens are counted at a time.
ROWS, CHUNK, SLICE = 32768, 128, 1024


def best(value: np.ndarray, rids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest values, ties by rid; nan counts as least."""
    low = -np.where(np.isnan(value), -np.inf, value)
    some = np.flatnonzero(low <= np.partition(low, k - 1)[k - 1]) if len(low) > k else np.arange(len(low))
    return some[np.lexsort((rids[some], low[some]))[:k]]


def unit(rows: list) -> np.ndarray:
    x = np.array(rows, np.float64)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def plain_score(sim, decay, recency, importance, valence, mood, w: S.Weights):
    """scoring.composite_score over arrays."""
    gate = 1 / (1 + np.exp(-S.GATE_K * (sim - w.tau)))
    aligned = np.where(np.abs(valence) < 1e-10, 0.0, mood * np.sign(valence))
    return (w.sim * sim + w.decay * decay + w.recency * recency) * (1 + gate * w.alpha * np.minimum(importance, 1)) * (1 + 0.3 * np.abs(valence)) * (1 + 0.2 * aligned)


SIGNALS = ["decay", "recency", "importance", "valence"]


def gathered(frames):
    """The frames of a task joined to blocks of ROWS rows or so."""
    held, n = [], 0
    for pdf in frames:
        held.append(pdf)
        n += len(pdf)
        if n >= ROWS:
            yield pd.concat(held, ignore_index=True)
            held, n = [], 0
    if n:
        yield pd.concat(held, ignore_index=True)


def nearest_and_important(rows: DataFrame, ask: pd.DataFrame, k: int, keep: int, important: float, least: float, w: S.Weights) -> DataFrame:
    """(query_id, rid, similarity, plain) of rows (rid, v and the signals): each block's nearest k per query, and its best
    `keep` by plain score of those with at least that importance and similarity; plain is null for any others."""
    q, ids, moods = unit(ask["v"].tolist()), ask["query_id"].to_numpy(), ask["mood"].to_numpy(np.float64)

    def near(frames):
        for pdf in gathered(frames):
            x, rids = unit(pdf["v"].tolist()), pdf["rid"].to_numpy()
            signals = [pdf[n].to_numpy(np.float64) for n in SIGNALS]
            weighty = signals[2] >= important
            for at in range(0, len(ids), CHUNK):
                sim, out = np.round(x @ q[at : at + CHUNK].T, 12), []
                for j, i in enumerate(ids[at : at + CHUNK]):
                    s = sim[:, j]
                    heavy = np.flatnonzero(weighty & (s >= least))
                    plain = np.full(len(s), np.nan)
                    plain[heavy] = plain_score(s[heavy], *(x[heavy] for x in signals), moods[at + j], w)
                    plain[heavy] = np.where(np.isnan(plain[heavy]), -np.inf, np.round(plain[heavy], 9))
                    take = np.union1d(best(s, rids, k), heavy[best(plain[heavy], rids[heavy], keep)])
                    out.append(pd.DataFrame({"query_id": i, "rid": rids[take], "similarity": s[take], "plain": plain[take]}))
                got = pd.concat(out)
                yield got.assign(plain=got["plain"].astype(object).where(got["plain"].notna(), None))

    return rows.select("rid", "v", *SIGNALS).mapInPandas(near, "query_id long, rid long, similarity double, plain double")


# words


def postings(memories: DataFrame, phrases: list[str]) -> DataFrame:
    """One row per part and phrase with the places and counts of the memories that hold it, and a row of phrase -1 per part
    with their rids, lengths and importances; parts are the batches that memories are read in. Of memories (rid, text,
    importance, access_count)."""
    whole = {p[1:]: i for i, p in enumerate(phrases) if p[0] == "="}
    stems = {p[:-1]: i for i, p in enumerate(phrases) if p[0] != "="}
    sizes = sorted({len(s) for s in stems})

    def of(token: str) -> tuple[int, ...]:
        out = tuple(stems[token[:n]] for n in sizes if n <= len(token) and token[:n] in stems)
        return (whole[token], *out) if token in whole else out

    def counted(lists) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrase, row, count) of a list column of tokens."""
        n, flat = len(lists), lists.flatten().dictionary_encode()
        match = [of(t) for t in flat.dictionary.to_pylist()]
        count = np.array([len(m) for m in match], np.int64)
        phrase_of = np.array([p for m in match for p in m], np.int64)
        if not len(phrase_of):
            return (np.zeros(0, np.int32),) * 3
        first, codes = np.cumsum(count) - count, np.asarray(flat.indices)
        wanted = count[codes] > 0
        rows = np.repeat(np.arange(n), np.asarray(pc.list_value_length(lists)))
        key, tf = np.unique(codes[wanted].astype(np.int64) * n + rows[wanted], return_counts=True)
        code, row = key // n, key % n
        times = count[code]
        step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        key, back = np.unique(phrase_of[np.repeat(first[code], times) + step] * n + np.repeat(row, times), return_inverse=True)
        tf = np.bincount(back, weights=np.repeat(tf, times), minlength=len(key))
        return (key // n).astype(np.int32), (key % n).astype(np.int32), tf.astype(np.int32)

    def build(batches):
        for seq, batch in enumerate(batches):
            n = batch.num_rows
            if not n:
                continue
            lists = batch.column("tokens")
            size = np.asarray(pc.list_value_length(lists))
            found = [(p, r + at, c) for at in range(0, n, SLICE) for p, r, c in [counted(lists.slice(at, SLICE))]]
            phrase, doc, tf = (np.concatenate(x) for x in zip(*found, strict=True))
            del found
            order = np.argsort(phrase, kind="stable")
            phrase, doc, tf = phrase[order], doc[order], tf[order]
            own, start = np.unique(phrase, return_index=True)
            ends = np.append(start, len(phrase))
            ends = np.append(ends, ends[-1] + n).astype(np.int32)  # the last row holds the memories
            rows, none = len(own) + 1, np.append(np.zeros(len(own) + 1, np.int32), n).astype(np.int32)

            def last(values, kind, none=none):
                return pa.ListArray.from_arrays(none, pa.array(values, kind))

            fresh = pc.equal(batch.column("access_count"), 0).fill_null(False)
            columns = [
                pa.array(np.full(rows, (TaskContext.get().partitionId() << 24) + seq, np.int64)), pa.array(np.append(own, -1).astype(np.int32)),
                pa.ListArray.from_arrays(ends, pa.array(np.append(doc, np.arange(n)).astype(np.int32), pa.int32())), pa.ListArray.from_arrays(ends, pa.array(np.append(tf, size.astype(np.int32)), pa.int32())),
                last(batch.column("rid").cast(pa.int64()), pa.int64()), last(batch.column("importance").cast(pa.float64()), pa.float64()), last(fresh, pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "phrase", "at", "tf", "rid", "importance", "fresh"])

    rows = memories.select("rid", "importance", "access_count", T.tokens(F.col("text")).alias("tokens"))
    return rows.mapInArrow(build, "part long, phrase int, at array<int>, tf array<int>, rid array<long>, importance array<double>, fresh array<boolean>")


def _flat(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, values) of a list column."""
    column = table.column(name).combine_chunks()
    column = column if isinstance(column, pa.Array) else pa.concat_arrays(column.chunks)
    return np.asarray(pc.list_value_length(column)).astype(np.int64), np.asarray(column.flatten().to_numpy(zero_copy_only=False))


def word_matches(memories: DataFrame, words: pd.DataFrame, total: int, mean_importance: float, anchor: float = 0.5) -> DataFrame:
    """(query_id, rid, hit, cold): the memories that a query's words bring, and those fit for the cold fallback.

    `words` are (query_id, word, phrases, topic, cold). Hits: by rank and importance, all words first and any word where too
    few have all; important ones with a word whatever their rank; and the most important ones of each word. Cold: the thirty
    most important ones never read with a word of the fallback.
    """
    names = sorted({p for ps in words["phrases"] for p in ps})
    number = {p: i for i, p in enumerate(names)}
    ask = []
    for i, rows in words.groupby("query_id", sort=False):
        topic = [[number[p] for p in ps] for ps in rows[rows["topic"]]["phrases"]]
        ask.append((int(i), topic, sorted({number[p] for ps in rows[rows["cold"]]["phrases"] for p in ps})))
    parts = settled(postings(memories, names))
    df = np.zeros(len(names))
    for r in parts.where("phrase >= 0").groupBy("phrase").agg(F.sum(F.size("at")).alias("df")).toLocalIterator():
        df[r["phrase"]] = r["df"]
    sizes = F.filter("tf", lambda x: x > 0)
    held = parts.where("phrase = -1").select("part", F.size("rid").alias("rows"), F.size(sizes).alias("n"), F.aggregate("tf", F.lit(0).cast("long"), lambda s, x: s + x).alias("len")).orderBy("part").toPandas()
    count = max(1, int(held["n"].sum()))
    mean_length = max(1e-300, float(held["len"].sum()) / count)
    idf = np.maximum(np.log((count - df + 0.5) / (df + 0.5)), 1e-6)
    limit, heavy_limit, word_limit, cold_limit = min(200, max(30, total // 100)), 100, 10, 30

    def answer(table: pa.Table) -> pa.Table:
        phrase, part = np.asarray(table.column("phrase")), np.asarray(table.column("part"))
        own = table.filter(pa.array(phrase == -1))
        size, rids = _flat(own, "rid")
        base = dict(zip(np.asarray(own.column("part")).tolist(), (np.cumsum(size) - size).tolist(), strict=True))
        importance, fresh = _flat(own, "importance")[1].astype(np.float64), _flat(own, "fresh")[1].astype(bool)
        length = _flat(own, "tf")[1].astype(np.float64)
        importance = np.where(np.isnan(importance), -np.inf, importance)
        static = np.lexsort((rids, -importance))  # memories are numbered by importance, so that its best come first
        place = np.empty(len(static), np.int32)
        place[static] = np.arange(len(static))
        rids, importance, fresh, length = rids[static], importance[static], fresh[static], length[static]
        heavies, anchors, n = int((importance > mean_importance).sum()), int((importance > anchor).sum()), len(rids)
        told = table.filter(pa.array(phrase >= 0))
        many, at = _flat(told, "at")
        tf = _flat(told, "tf")[1]
        doc = place[at + np.repeat(np.array([base[p] for p in part[phrase >= 0].tolist()], np.int32), many)]
        kind = np.repeat(phrase[phrase >= 0], many)
        del at, table, told, own
        order = np.argsort(kind.astype(np.int64) * n + doc)
        kind, doc, tf = kind[order], doc[order], tf[order].astype(np.float64)
        del order
        score = idf[kind]
        score *= tf * (K1 + 1) / (tf + (K1 * (1 - B + B * length / mean_length))[doc])
        edge = np.searchsorted(kind, np.arange(len(names) + 1))
        del kind, tf
        weight, out = 0.5 + importance, []
        for i, topic, cold in ask:
            total_score, has, three = np.zeros(n), np.zeros(n, np.int32), []
            for j, ps in enumerate(topic):
                spans = [slice(edge[p], edge[p + 1]) for p in ps if edge[p] < edge[p + 1]]
                for s in spans:
                    total_score[doc[s]] += score[s]
                if not spans:
                    continue
                mine = doc[spans[0]] if len(spans) == 1 else np.unique(np.concatenate([doc[s] for s in spans]))
                has[mine] += 1
                first = mine[:word_limit]
                three += [(j, x) for x in first[first < anchors].tolist()] if len(topic) > 1 else []
            hits = np.flatnonzero(has)
            every = hits[has[hits] == len(topic)]
            value = np.round(total_score[hits] * weight[hits], 9)
            full = np.round(total_score[every] * weight[every], 9)
            take = [every[best(full, rids[every], limit)], every[every < heavies][:heavy_limit]]
            if len(topic) > 1 and len(every) < 5:
                take.append(hits[best(value, rids[hits], limit)])
            if len(topic) > 1 and int((every < heavies).sum()) < 10:
                take.append(hits[hits < heavies][:heavy_limit])
            take = np.unique(np.concatenate(take))
            spare = [doc[edge[p] : edge[p + 1]] for p in cold]
            spare = np.unique(np.concatenate([d[fresh[d]][:cold_limit] for d in spare]))[:cold_limit] if spare else np.zeros(0, np.int64)
            anchored = np.array([x for _, x in three], np.int64)
            if len(take) + len(spare):
                some = np.concatenate([take, anchored, spare])
                what = np.concatenate([np.where(has[take] == len(topic), -1, -2), [j for j, _ in three], np.full(len(spare), -3)]).astype(np.int32)
                out.append((i, len(topic), rids[some], importance[some], np.round(total_score[some] * weight[some], 9), what))
        kinds = pa.schema([("query_id", pa.int64()), ("words", pa.int32()), ("rid", pa.list_(pa.int64())), ("importance", pa.list_(pa.float64())), ("value", pa.list_(pa.float64())), ("what", pa.list_(pa.int32()))])
        return pa.table([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True) if out else [[]] * 6, kinds, strict=True)], schema=kinds)

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        rids, importance, value, what = (np.concatenate(pdf[n].tolist()) for n in ("rid", "importance", "value", "what"))
        words = int(pdf["words"].iloc[0])

        def top(which, by, k):
            some = np.flatnonzero(which)
            return some[best(by[some], rids[some], k)]

        every, hit, heavy = what == -1, (what == -1) | (what == -2), importance > mean_importance
        one = top(every, value, limit)
        if len(one) < 5 and words > 1:
            one = top(hit, value, limit)
        two = top(every & heavy, importance, heavy_limit)
        if len(two) < 10 and words > 1:
            two = np.append(two, top(hit & heavy, importance, heavy_limit))
        three = [top(what == j, importance, word_limit) for j in np.unique(what[what >= 0])]
        hits, cold = np.unique(rids[np.concatenate([one, two, *three]).astype(np.int64)]), rids[top(what == -3, importance, cold_limit)]
        both = np.union1d(hits, cold)
        return pd.DataFrame({"query_id": pdf["query_id"].iloc[0], "rid": both, "hit": np.isin(both, hits), "cold": np.isin(both, cold)})

    spark = memories.sparkSession
    groups = [(int(p), int(g)) for p, g in zip(held["part"], 2 * (held["rows"].cumsum() - 1) // ROWS, strict=True)]
    groups = F.broadcast(spark.createDataFrame(groups, "part long, block long"))  # one row a part
    local = parts.join(groups, "part").groupBy("block").applyInArrow(answer, "query_id long, words int, rid array<long>, importance array<double>, value array<double>, what array<int>")
    return local.groupBy("query_id").applyInPandas(merge, "query_id long, rid long, hit boolean, cold boolean")


# the graph


def linked(rows: DataFrame, total: int, ask: pd.DataFrame, reached: pd.DataFrame, far: int, keep: int, important: float, least: float, w: S.Weights, cap: float) -> DataFrame:
    """(query_id, rid, kind, similarity, proximity, lift, value) of the memories linked to what a query reaches.

    kind 0: those found already, with their lift. kind 1: each block's best `keep` of the important and similar ones by plain
    score and lift, where that is no less than the query's floor. kind 2: its best `far` of all others by importance and
    proximity. Of rows (rid, status, the signals, v, entities, mine: the queries that found it), reached (query_id, eid, near,
    idf) and ask (query_id, v, mood, base, floor).
    """
    eids, number = np.unique(reached["eid"].to_numpy(), return_inverse=True)
    reached = reached.assign(e=number)
    ask = ask[ask["query_id"].isin(reached["query_id"].unique())]
    spread = {i: (r["e"].to_numpy(), r["near"].to_numpy(np.float64), r["idf"].to_numpy(np.float64)) for i, r in reached.groupby("query_id")}
    q, ids = unit(ask["v"].tolist()) if len(ask) else None, ask["query_id"].to_numpy()
    moods, bases, floors = (ask[n].to_numpy(np.float64) for n in ("mood", "base", "floor"))

    def lifts(frames):
        for pdf in gathered(frames):
            n, rids = len(pdf), pdf["rid"].to_numpy()
            signals = [pdf[x].to_numpy(np.float64) for x in SIGNALS]
            importance = signals[2]
            half = np.where(pdf["status"].to_numpy() == "consolidated", 0.5, 1.0)
            seen = np.flatnonzero(pdf["v"].notna().to_numpy())
            x = unit(pdf["v"].iloc[seen].tolist()) if len(seen) else None
            weighty = (pdf["status"].to_numpy() == "active") & (importance >= important)

            def listed(name, pdf=pdf):
                """(row, value) of a list column, by value."""
                lists = [np.zeros(0, np.int64) if a is None else a for a in pdf[name]]
                row, value = np.repeat(np.arange(len(lists)), [len(a) for a in lists]), np.concatenate(lists).astype(np.int64)
                order = np.argsort(value, kind="stable")
                return row[order], value[order]

            row, value = listed("entities")
            edge = np.append(np.searchsorted(value, eids), 0), np.append(np.searchsorted(value, eids, "right"), 0)
            holder, holds = listed("mine")
            for at in range(0, len(ids), CHUNK):
                sims, out = np.round(x @ q[at : at + CHUNK].T, 12) if len(seen) else None, []
                for j, i in enumerate(ids[at : at + CHUNK].tolist()):
                    proximity, rarity = np.full(n, -1.0), np.zeros(n)
                    e, near, idf = spread[i]
                    for k in np.argsort(near, kind="stable"):
                        proximity[row[edge[0][e[k]] : edge[1][e[k]]]] = near[k]
                    for k in np.argsort(idf, kind="stable"):
                        rarity[row[edge[0][e[k]] : edge[1][e[k]]]] = idf[k]
                    sim = np.full(n, np.nan)
                    if len(seen):
                        sim[seen] = sims[:, j]
                    lift = np.minimum(bases[at + j] * proximity * rarity * half, cap)
                    found = np.zeros(n, bool)
                    found[holder[np.searchsorted(holds, i) : np.searchsorted(holds, i, "right")]] = True
                    touched = proximity >= 0
                    heavy = weighty & (sim >= least)
                    new = np.flatnonzero(touched & heavy & ~found)
                    score = np.round(plain_score(sim[new], *(s[new] for s in signals), moods[at + j], w) + lift[new], 9)
                    new, score = new[~(score < floors[at + j])], score[~(score < floors[at + j])]
                    new = new[best(score, rids[new], keep)]
                    others = np.flatnonzero(touched & ~heavy & ~found)
                    value2 = np.round(importance[others] * (0.3 + 0.7 * proximity[others]), 9)
                    top = best(value2, rids[others], far)
                    old = np.flatnonzero(touched & found)
                    some = np.concatenate([old, new, others[top]])
                    kinds = np.repeat([0, 1, 2], [len(old), len(new), len(top)])
                    out.append(pd.DataFrame({"query_id": i, "rid": rids[some], "kind": kinds, "similarity": sim[some], "proximity": proximity[some], "lift": lift[some], "value": np.concatenate([np.zeros(len(old) + len(new)), value2[top]])}))
                yield pd.concat(out)

    parts = max(1, -(-total // ROWS))
    rows = rows.select("rid", "status", *SIGNALS, "v", "entities", "mine").repartition(parts, "rid")
    out = rows.mapInPandas(lifts, "query_id long, rid long, kind int, similarity double, proximity double, lift double, value double")
    return out.withColumn("similarity", F.nanvl("similarity", F.lit(None).cast("double"))).withColumn("value", F.nanvl("value", F.lit(None).cast("double")))
