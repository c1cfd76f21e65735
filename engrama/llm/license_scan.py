"""Licence scans: a trained paragraph classifier, in DataFrame code only.

Paragraphs are lines. Each becomes the set of its word 1- and 2-grams that the model knows; a sparse logistic regression
over the n-grams of known notices gives each family's probability, with an unknown class for other licences and one for
prose. Function words alone are no n-grams of the model, so most prose has none; a paragraph without any is scored by
the intercepts alone, which are greatest for prose, as training makes sure. Probabilities are calibrated by a temperature
found on whole notices left out of a first fit; the weights are then fitted on all notices. A prediction is confirmed if
the paragraph holds most of the n-grams of one of the family's templates. Texts are read once; from then on only n-grams
and digests move, and equal paragraphs are scored once. Training uses the fixed texts alone and happens on the driver;
its table of weights has a few thousand cells whatever the input.
"""

from __future__ import annotations

import functools
import json
import random
import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .license_texts import FAMILIES, OTHER, PROSE

WORD = r"[a-z0-9]+"
#: Words that say nothing of licences on their own, nor two of them together.
FUNCTION_WORDS = frozenset("a all an and any are as at be by do for from had has he her his if in into is it its may no not of on one or our out s she so than that the their them there these they this to under was we were what when which who will with within without you your 0 1 2 3 4 5 6".split())
CLASSES = [*FAMILIES, "unknown", "none"]
CONFIRM = 0.7


def grams_of(text: str) -> set[str]:
    words = re.findall(WORD, text.lower())
    pairs = [(a, b) for a, b in zip(words, words[1:], strict=False) if not (a in FUNCTION_WORDS and b in FUNCTION_WORDS)]
    return set(words) - FUNCTION_WORDS | {f"{a} {b}" for a, b in pairs}


def _notices() -> list[tuple[str, int]]:
    return [(t, k) for k, f in enumerate(FAMILIES) for t in FAMILIES[f]] + [(t, len(FAMILIES)) for t in OTHER] + [(t, len(FAMILIES) + 1) for t in PROSE]


def _samples(texts: list[tuple[str, int]], seed: int, copies: int) -> list[tuple[set[str], int]]:
    """Varied notices: as they are, with lost words, and within invented prose; and prose of one or two stray words."""
    rng, out = random.Random(seed), []
    filler = ["".join(rng.choice("bdfklmnprstv") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(200)]
    for text, label in texts:
        for c in range(copies):
            words = text.split()
            if c:
                words = [w for w in words if rng.random() > 0.08]
                words = rng.choices(filler, k=rng.randint(0, 6)) + words + rng.choices(filler, k=rng.randint(0, 6))
            if c % 4 == 3 and label == len(FAMILIES):  # licences nobody has heard of
                words = f"{rng.choice(['Licensed', 'Released', 'Distributed', 'Available'])} under the {' '.join(rng.choices(filler, k=rng.randint(1, 3)))} {rng.choice(['License', 'Licence', 'Public License'])}, version {rng.randint(1, 5)}.".split()
            out.append((grams_of(" ".join(words)), label))
    known = sorted({w for t, _ in texts for w in re.findall(WORD, t.lower()) if w not in FUNCTION_WORDS and not w.startswith("licen")})
    out += [(set(rng.sample(known, k % 3)), len(FAMILIES) + 1) for k in range(4 * len(texts))]
    return out


class Classifier:
    """Weights by n-gram and class, intercepts, temperature."""

    def __init__(self, copies: int = 14, steps: int = 400, rate: float = 2.0, ridge: float = 2e-4):
        notices = _notices()
        self.vocabulary = sorted({g for t, _ in notices for g in grams_of(t)})
        self.index = {g: k for k, g in enumerate(self.vocabulary)}
        apart = set(range(2, len(notices), 4))  # whole notices that the first fit never sees in any form
        w, b = self._fit(_samples([n for k, n in enumerate(notices) if k not in apart], 1, copies), steps, rate, ridge)
        hx, hy = self._matrix(_samples([n for k, n in enumerate(notices) if k in apart], 2, 4))
        z = hx @ w + b
        loss = lambda t: -np.log(_softmax(z / t)[np.arange(len(hy)), hy] + 1e-12).mean()
        self.temperature = float(min(np.geomspace(0.2, 5, 60), key=loss))
        self.held_accuracy = float((z.argmax(1) == hy).mean())
        self.weights, self.bias = self._fit(_samples(notices, 1, copies), steps, rate, ridge)
        assert self.bias.argmax() == len(CLASSES) - 1  # a paragraph without a known n-gram is prose

    def _fit(self, rows: list, steps: int, rate: float, ridge: float) -> tuple[np.ndarray, np.ndarray]:
        x, y = self._matrix(rows)
        target = np.eye(len(CLASSES))[y]
        w, b = np.zeros((x.shape[1], len(CLASSES))), np.zeros(len(CLASSES))
        scale = 1 / np.maximum(1, np.sqrt(x.sum(1, keepdims=True)))  # long texts don't outweigh short ones
        for _ in range(steps):
            p = _softmax(x @ w + b)
            g = (p - target) * scale
            w -= rate * (x.T @ g / len(x) + ridge * w)
            b -= rate * g.mean(0)
        return w, b

    def _matrix(self, rows: list) -> tuple[np.ndarray, np.ndarray]:
        x = np.zeros((len(rows), len(self.vocabulary)))
        for r, (grams, _) in enumerate(rows):
            x[r, [self.index[g] for g in grams if g in self.index]] = 1
        return x, np.array([label for _, label in rows])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


@functools.cache
def classifier() -> Classifier:
    return Classifier()


def _table(df: DataFrame, rows: list, shape: str) -> DataFrame:
    """A small fixed table as a literal; at most a few thousand rows, from the fixed texts."""
    return F.broadcast(df.sparkSession.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{shape}>>"))))


def _let(value: Column, f) -> Column:
    """f of a value that is computed once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), 0)


def _known_grams(line: Column, vocabulary: list[str]) -> Column:
    """The distinct n-grams of a line that the model knows."""

    def grams(w: Column) -> Column:
        pairs = F.zip_with(F.slice(w, F.lit(1), F.size(w) - 1), F.slice(w, F.lit(2), F.size(w) - 1), lambda a, b: F.concat(a, F.lit(" "), b))
        return F.array_distinct(F.filter(F.concat(w, pairs), lambda g: g.isin(vocabulary)))

    return _let(F.split(F.lower(line), "[^a-z0-9]+"), grams)


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Classifier | None = None) -> DataFrame:
    """One row per paragraph taken for a licence notice: the id, line (int, from 0), family, probability, template
    (int, the family's nearest, null for unknown), overlap (share of its n-grams found) and confirmed.

    Paragraphs classified as prose give no row, nor do null and empty texts. family is one of the known families or
    'unknown', which is never confirmed. A long paragraph that holds a notice counts as one; a notice wrapped over lines
    is judged line by line. Ties go to the first family and template. Null and repeated ids are carried along; equal rows
    give equal rows each. Extra columns are left out.
    """
    model = model or classifier()
    line = lambda x, i: F.struct(i.alias("line"), _known_grams(x, model.vocabulary).alias("grams"), x.alias("x"))
    lines = F.filter(F.transform(F.split(F.col(text_col), "\n", -1), line), lambda s: F.size(s["grams"]) > 0)
    lines = F.transform(lines, lambda s: F.struct(s["line"].alias("line"), s["grams"].alias("grams"), F.unhex(F.md5(s["x"])).alias("dig")))
    # the outer form has Spark infer no filter that would repeat the whole expression
    hits = df.select(F.col(id_col).alias("_li_i"), F.inline_outer(lines)).where("dig is not null")
    hits = materialize(hits, "licence-lines")
    grams = hits.groupBy("dig").agg(F.first("grams").alias("grams")).select("dig", F.explode("grams").alias("g"))

    weights = _table(df, [{"g": g, "k": k, "v": round(float(v), 6)} for g, row in zip(model.vocabulary, model.weights, strict=True) for k, v in enumerate(row)], "g:string,k:int,v:double")
    bias = _table(df, [{"k": k, "b": float(v)} for k, v in enumerate(model.bias)], "k:int,b:double")
    logits = grams.join(weights, "g").groupBy("dig", "k").agg(F.sum("v").alias("v"))
    logits = logits.join(bias, "k").withColumn("z", (F.col("v") + F.col("b")) / model.temperature)
    best = logits.groupBy("dig").agg(F.max(F.struct("z", (-F.col("k")).alias("n"))).alias("m"), F.collect_list("z").alias("zs"))  # as many as classes
    best = best.select("dig", (-F.col("m.n")).alias("k"), (1 / F.aggregate("zs", F.lit(0.0), lambda s, z: s + F.exp(z - F.col("m.z")))).alias("probability")).where(F.col("k") != len(CLASSES) - 1)

    templates = [(k, t, grams_of(text)) for k, f in enumerate(FAMILIES) for t, text in enumerate(FAMILIES[f])]
    parts = _table(df, [{"g": g, "k": k, "t": t, "n": len(own)} for k, t, own in templates for g in sorted(own)], "g:string,k:int,t:int,n:int")
    overlap = grams.join(parts, "g").groupBy("dig", "k", "t").agg((F.count("*") / F.first("n")).alias("o"))
    overlap = overlap.groupBy("dig", "k").agg(F.max(F.struct("o", (-F.col("t")).alias("n"))).alias("m")).select("dig", "k", (-F.col("m.n")).alias("template"), F.col("m.o").alias("overlap"))
    names = F.array(*map(F.lit, CLASSES))
    found = best.join(overlap, ["dig", "k"], "left").select("dig", F.element_at(names, F.col("k") + 1).alias("family"), "probability", "template", F.coalesce("overlap", F.lit(0.0)).alias("overlap"))
    out = hits.select("_li_i", "line", "dig").join(materialize(found, "licence-found"), "dig")
    return out.select(F.col("_li_i").alias(id_col), "line", "family", F.round("probability", 6).alias("probability"), "template", F.round("overlap", 6).alias("overlap"), (F.col("overlap") >= CONFIRM).alias("confirmed"))
