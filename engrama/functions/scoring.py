"""Scores of memories as column functions: decay, recency, gates, composites and their parts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from engrama.functions.text import alnum_tokens

WEEK = 604800.0
#: Weights without and with the graph signal, the gate, and how far importance amplifies.
W_SIM, W_DECAY, W_RECENCY, ALPHA = 0.50, 0.20, 0.30, 0.80
G_SIM, G_DECAY, G_RECENCY, G_GRAPH, G_ALPHA = 0.35, 0.15, 0.20, 0.30, 0.60
GATE_K, GATE_TAU = 12.0, 0.25
#: Sentiment words and the suffixes that their stemming strips, longest first.
NEGATIVE = "sad frustrated angry bad worst low lows difficult hard struggle pain stress anxious upset failed failure problem negative stressing worried tough".split()
POSITIVE = "happy joy great best high good wonderful excited proud success achievement positive celebration love".split()
SUFFIXES = "iest ness ment ful est ing ous ive ity ed er ly al es s".split()


@dataclass(frozen=True)
class Weights:
    """Learned weights; the defaults are the fixed ones."""

    sim: float = W_SIM
    decay: float = W_DECAY
    recency: float = W_RECENCY
    tau: float = GATE_TAU
    alpha: float = ALPHA


def decay_score(importance: Column, half_life: Column, elapsed: Column) -> Column:
    return F.when(half_life > 0, importance * F.pow(F.lit(2.0), -elapsed / half_life)).otherwise(0.0)


def recency_score(age: Column) -> Column:
    return F.exp(-age / WEEK)


def valence_boost(valence: Column) -> Column:
    return 1.0 + 0.3 * F.abs(valence)


def query_valence_boost(valence: Column, sentiment: Column | float) -> Column:
    alignment = F.when(F.abs(valence) < 1e-10, 0.0).otherwise(sentiment * F.signum(valence))
    return valence_boost(valence) * (1.0 + 0.2 * alignment)


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def importance_gate(similarity: Column, tau: float = GATE_TAU) -> Column:
    return sigmoid(GATE_K * (similarity - tau))


def _amplified(base: Column, similarity: Column, importance: Column, boost: Column, tau: float, alpha: float) -> Column:
    return base * (1.0 + importance_gate(similarity, tau) * alpha * F.least(importance, F.lit(1.0))) * boost


def composite_score(similarity: Column, decay: Column, recency: Column, importance: Column, valence: Column, sentiment: Column | float = 0.0, w: Weights = Weights()) -> Column:
    """Relevance with importance as a gated multiplier; a neutral sentiment leaves the symmetric valence boost."""
    base = w.sim * similarity + w.decay * decay + w.recency * recency
    return _amplified(base, similarity, importance, query_valence_boost(valence, sentiment), w.tau, w.alpha)


def _graph_weights(w: Weights) -> tuple[float, float, float]:
    total = w.sim + w.decay + w.recency
    if total <= 0:
        return G_SIM, G_DECAY, G_RECENCY
    return tuple(x / total * (1 - G_GRAPH) for x in (w.sim, w.decay, w.recency))


def graph_composite_score(similarity: Column, decay: Column, recency: Column, importance: Column, valence: Column, proximity: Column, sentiment: Column | float = 0.0, w: Weights | None = None) -> Column:
    """With graph proximity as a fourth signal where there is any; w rescales learned weights to leave it its share."""
    a, b, c = _graph_weights(w) if w else (G_SIM, G_DECAY, G_RECENCY)
    alpha = w.alpha * G_ALPHA / ALPHA if w else G_ALPHA
    base = a * similarity + b * decay + c * recency + G_GRAPH * proximity
    boost = query_valence_boost(valence, sentiment)
    return F.when(proximity > 0, _amplified(base, similarity, importance, boost, w.tau if w else GATE_TAU, alpha)).otherwise(composite_score(similarity, decay, recency, importance, valence, sentiment, w or Weights()))


def contributions(similarity: Column, decay: Column, recency: Column, importance: Column, proximity: Column | None = None, w: Weights | None = None) -> Column:
    """Each signal's part of a score, as a struct."""
    v = w or Weights()

    def parts(a: float, b: float, c: float, alpha: float, graph: Column) -> Column:
        gate = importance_gate(similarity, v.tau)
        return F.struct((a * similarity).alias("similarity"), (b * decay).alias("decay"), (c * recency).alias("recency"), (gate * alpha * F.least(importance, F.lit(1.0))).alias("importance"), graph.alias("graph"))

    plain = parts(v.sim, v.decay, v.recency, v.alpha, F.lit(0.0))
    if proximity is None:
        return plain
    a, b, c = _graph_weights(w) if w else (G_SIM, G_DECAY, G_RECENCY)
    return F.when(proximity > 0, parts(a, b, c, v.alpha * G_ALPHA / ALPHA, G_GRAPH * proximity)).otherwise(plain)


def eviction_score(decay: Column, recency: Column) -> Column:
    return 0.6 * decay + 0.4 * recency


def why_retrieved(similarity: Column, recency: Column, decay: Column, valence: Column) -> Column:
    found = F.array_compact(
        F.array(
            F.when(similarity > 0.5, F.format_string("semantically similar (%.2f)", similarity)),
            F.when(recency > 0.5, F.lit("recent")),
            F.when(decay > 0.3, F.format_string("important (decay=%.2f)", decay)),
            F.when(F.abs(valence) > 0.5, F.format_string("emotionally weighted (%.2f)", valence)),
        )
    )
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("matched query")))


def sentiment_stem(word: Column) -> Column:
    """The word without its longest known suffix, if more than two letters are left."""
    out = F.when(F.lit(False), word)
    for s in SUFFIXES:
        out = out.when((F.length(word) > len(s) + 2) & F.endswith(word, F.lit(s)), F.substring(word, F.lit(1), F.length(word) - len(s)))
    return out.otherwise(word)


def _matches(token: Column, words: list[str]) -> Column:
    stem = sentiment_stem(token)
    hit = token.isin(*words) | stem.isin(*words)
    for w in words:
        hit |= (F.length(token) >= 4) & F.startswith(token, F.lit(w))
        hit |= (F.length(stem) >= 4) & F.startswith(F.lit(w), stem)
    return hit


def text_sentiment(text: Column) -> Column:
    """+1, -1 or 0 by which sentiment words are more."""
    tokens = alnum_tokens(text)
    bad, good = F.size(F.filter(tokens, lambda t: _matches(t, NEGATIVE))), F.size(F.filter(tokens, lambda t: _matches(t, POSITIVE)))
    return F.when(bad > good, -1.0).when(good > bad, 1.0).otherwise(0.0)


def query_sentiment(text: str | None) -> float:
    """text_sentiment of one query, without its large expression."""
    import re

    def stem(w: str) -> str:
        return next((w[: -len(s)] for s in SUFFIXES if len(w) > len(s) + 2 and w.endswith(s)), w)

    def hit(t: str, words: list[str]) -> bool:
        s = stem(t)
        return any(t == w or s == w or len(t) >= 4 and t.startswith(w) or len(s) >= 4 and w.startswith(s) for w in words)

    tokens = re.findall(r"[^\W_]+", (text or "").lower())
    bad, good = (sum(hit(t, words) for t in tokens) for words in (NEGATIVE, POSITIVE))
    return float(good > bad) - float(bad > good)
