"""Retrieval: postings and BM25, exact vector top-k, candidate union, boosts, diversity."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from engrama.functions import scoring as S
from engrama.functions import text as T
from engrama.functions import vectors as V

K1, B = 1.2, 0.75


def top_per(rows: DataFrame, group: str, score: Column, tie: str, k: int) -> DataFrame:
    """The best k rows of each group; a group limit runs before the shuffle."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(group).orderBy(score.desc(), tie))).where(F.col("_k") <= k).drop("_k")


class Postings:
    """Inverted index of a text column as frames: postings (token, id, tf) and lengths."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str = "text"):
        self.id = id_col
        self.rows = docs.select(id_col, F.explode(T.tokens(F.col(text_col))).alias("token")).groupBy("token", id_col).agg(F.count("*").alias("tf"))
        self.lengths = docs.select(id_col, F.size(T.tokens(F.col(text_col))).alias("len")).where("len > 0")

    def bm25(self, terms: DataFrame, query_id: str) -> DataFrame:
        """(query, id, score) of every text that shares a term; terms are (query, token) without repeats."""
        whole = self.lengths.agg(F.count("*").alias("n"), F.avg("len").alias("al"))
        hit = self.rows.join(terms.select("token").distinct(), "token", "left_semi")  # only the queries' tokens go on
        df = hit.groupBy("token").agg(F.count("*").alias("df"))
        rows = hit.join(df, "token").join(self.lengths, self.id).crossJoin(F.broadcast(whole))  # whole is one row
        idf = F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("al")))
        return rows.select("token", self.id, part.alias("part")).join(terms, "token").groupBy(query_id, self.id).agg(F.sum("part").alias("score"))


def nearest(vectors: DataFrame, queries: DataFrame, k: int, block: int = 256) -> DataFrame:
    """Exact cosine top-k (query_id, rid, similarity) of a stated query set against all rows, in blocks of queries.

    Queries are brought to the vectors a block at a time, so what is shipped is bounded by `block` vectors; each
    batch of rows keeps its own best k per query before anything is shuffled.
    """
    total = queries.count()
    blocks = max(1, -(-total // block))
    numbered = queries.withColumn("_b", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
    out = None
    for b in range(blocks):
        part = numbered.where(F.col("_b") == b).select("query_id", "v").toPandas()
        if not len(part):
            continue
        q = np.array(part["v"].tolist(), np.float64)
        q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
        ids = part["query_id"].to_numpy()

        def best(frames, q=q, ids=ids):
            for pdf in frames:
                if not len(pdf):
                    continue
                x = np.array(pdf["v"].tolist(), np.float64)
                x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
                sim, rids = x @ q.T, pdf["rid"].to_numpy()
                for j, i in enumerate(ids):
                    order = np.lexsort((rids, -np.round(sim[:, j], 9)))[:k]
                    yield pd.DataFrame({"query_id": i, "rid": rids[order], "similarity": sim[order, j]})

        found = vectors.select("rid", "v").mapInPandas(best, "query_id long, rid long, similarity double")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return queries.where("false").selectExpr("query_id", "query_id as rid", "0d as similarity")
    return top_per(out, "query_id", F.round("similarity", 9), "rid", k)


def best_scored(rows: DataFrame, queries: DataFrame, k: int, w: S.Weights = S.Weights(), block: int = 256) -> DataFrame:
    """The best k (query_id, rid, score) by the fused score of rows (rid, v, decay, recency, importance, valence), all of
    which are compared with a stated query set in blocks; each batch keeps its own best k per query."""
    total = queries.count()
    blocks = max(1, -(-total // block))
    numbered = queries.withColumn("_b", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
    out = None
    for b in range(blocks):
        part = numbered.where(F.col("_b") == b).select("query_id", "v").toPandas()
        if not len(part):
            continue
        q = np.array(part["v"].tolist(), np.float64)
        q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
        ids = part["query_id"].to_numpy()

        def best(frames, q=q, ids=ids):
            for pdf in frames:
                if not len(pdf):
                    continue
                x = np.array(pdf["v"].tolist(), np.float64)
                x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
                sim = np.maximum(0.0, x @ q.T)
                decay, recency, importance, valence = (pdf[n].to_numpy(np.float64)[:, None] for n in ("decay", "recency", "importance", "valence"))
                gate = 1 / (1 + np.exp(-S.GATE_K * (sim - w.tau)))
                score = (w.sim * sim + w.decay * decay + w.recency * recency) * (1 + gate * w.alpha * np.minimum(importance, 1)) * (1 + 0.3 * np.abs(valence))
                rids = pdf["rid"].to_numpy()
                for j, i in enumerate(ids):
                    order = np.lexsort((rids, -np.round(score[:, j], 9)))[:k]
                    yield pd.DataFrame({"query_id": i, "rid": rids[order], "score": score[order, j]})

        found = rows.select("rid", "v", "decay", "recency", "importance", "valence").mapInPandas(best, "query_id long, rid long, score double")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return queries.where("false").selectExpr("query_id", "query_id as rid", "0d as score")
    return top_per(out, "query_id", F.round("score", 9), "rid", k)


def similarity_to(vectors: DataFrame, q: list[float]) -> DataFrame:
    """vectors with the similarity max(0, 1 - cosine distance) to one literal vector."""
    literal = F.array(*[F.lit(float(x)) for x in q])
    return vectors.withColumn("similarity", F.greatest(F.lit(0.0), 1.0 - V.cosine_distance(F.col("v"), literal)))


def diversify(pool: DataFrame, k: int, trade: float = 0.7, same: float = 0.98) -> DataFrame:
    """Greedy maximal marginal relevance per query over a pool (query_id, rid, score, v) of bounded size: (query_id, rid, pick)."""

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "rid"], ascending=[False, True]).reset_index(drop=True)
        x = np.array(pdf["v"].tolist(), np.float64)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        near, open_, order = np.zeros(len(x)), np.ones(len(x), bool), []
        while len(order) < k and open_.any():
            value = np.where(open_, trade * pdf["score"] - (1 - trade) * near, -np.inf)
            i = int(value.argmax())
            open_[i] = False
            if order and near[i] > same:
                continue
            order.append(i)
            near = np.maximum(near, x @ x[i])
        return pd.DataFrame({"query_id": pdf["query_id"].iloc[0], "rid": pdf["rid"].iloc[order].to_numpy(), "pick": np.arange(len(order))})

    return pool.select("query_id", "rid", "score", "v").groupBy("query_id").applyInPandas(pick, "query_id long, rid long, pick long")
