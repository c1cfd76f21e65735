"""Quality classifier: random Fourier features over document statistics, ridge by normal equations, isotonic scores.

Every text is read once and becomes a short row of statistics. Training rows are labelled rows outside the held-out
fold; where there are more than `max_train`, a hash of their id chooses about so many. Their features approximate a Gaussian kernel;
each partition sums its part of the normal equations and the parts are added by an aggregation, so the driver only
solves a system of fixed size. A fifth of the training rows is left out of the fit to calibrate scores isotonically.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Bound on the labelled rows that a fit reads.
MAX_TRAIN = 60_000
FEATURES, GAMMA, RIDGE = 192, 0.005, 1e-3
_LINE = re.compile(r"\n+")
_FINAL = frozenset(".,;:!?")


def statistics(text: str | None) -> list[float]:
    """Fixed-length statistics of a whole text; null and empty texts give the same row."""
    text = text or ""
    words = text.split()
    n, m = max(1, len(text)), max(1, len(words))
    low = text.lower()
    upper = sum(map(str.isupper, words))
    alpha = sum(map(str.isalpha, words))
    ends = [w[-1] for w in words]
    marked = sum(not e.isalnum() and e not in _FINAL for e in ends)
    stops = sum(e in ".!?" for e in ends)
    kinds = len(set(words))
    pairs = len(set(zip(words, words[1:], strict=False)))
    runs = sum(a == b for a, b in zip(words, words[1:], strict=False))
    lines = [x for x in _LINE.split(text) if x]
    k = max(1, len(lines))
    data = np.frombuffer(low.encode("utf-8", "surrogatepass"), np.uint8)
    hist = np.bincount(data, minlength=256) / max(1, len(data))
    share = hist[hist > 0]
    letters = hist[97:123].sum() + hist[128:].sum()
    digits, blanks = hist[48:58].sum(), hist[32] + hist[10] + hist[9]
    packed = len(zlib.compress(data.tobytes(), 1)) / max(1, len(data))
    return [
        np.log1p(n), np.log1p(len(words)), n / m, upper / m, alpha / m, marked / m, stops / m, kinds / m ** 0.75, pairs / m, runs / m,
        np.log1p(len(lines)), len(set(lines)) / k, m / k, letters, digits, blanks, 1 - letters - digits - blanks,
        float(-(share * np.log2(share)).sum()), packed, hist[124] * 20, (hist[33] + hist[42] + hist[36] + hist[35] + hist[37] + hist[38]) * 10, (hist[44] + hist[46]) * 10, hist[64] * 100, (hist[60] + hist[62] + hist[123] + hist[125]) * 20,
    ]


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [statistics(t.as_py()) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], ["_q_i", "_q_s"])


class Model:
    """Standardization, random features, ridge weights and the isotonic steps; a few hundred kB whatever the input."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, seed: int):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.freq = rng.normal(0, (2 * GAMMA) ** 0.5, (len(mean), FEATURES))
        self.phase = rng.uniform(0, 2 * np.pi, FEATURES)
        self.weights = np.zeros(FEATURES + 1)
        self.knots, self.levels = np.array([0.0, 1.0]), np.array([0.0, 1.0])

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -6, 6)
        return np.hstack([np.sqrt(2 / FEATURES) * np.cos(z @ self.freq + self.phase), np.ones((len(z), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def scores(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), self.knots, self.levels), 0, 1)


def _stack(column) -> np.ndarray:
    return np.array(list(column), np.float64).reshape(len(column), -1)


def _normal_parts(frames: Iterator[pd.DataFrame], model: Model) -> Iterator[pd.DataFrame]:
    """This partition's upper triangle of X'X and its X'y, in cells."""
    width = FEATURES + 1
    gram, right, seen = np.zeros((width, width)), np.zeros(width), False
    for pdf in frames:
        if len(pdf):
            x, seen = model.features(_stack(pdf["_q_s"])), True
            gram += x.T @ x
            right += x.T @ pdf["_q_y"].to_numpy(np.float64)
    if seen:
        i, j = np.triu_indices(width)
        yield pd.DataFrame({"i": np.r_[i, np.arange(width)], "j": np.r_[j, np.full(width, -1)], "v": np.r_[gram[i, j], right]})


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-decreasing steps fitted by pooling adjacent violators, as knots and levels to interpolate between."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []  # weight, mean of y, mean of x
    for a, b in zip(x[order].tolist(), y[order].tolist(), strict=True):
        pools.append([1.0, b, a])
        while len(pools) > 1 and pools[-2][1] >= pools[-1][1]:
            w, m, c = pools.pop()
            v = pools[-1]
            t = v[0] + w
            pools[-1] = [t, (v[0] * v[1] + w * m) / t, (v[0] * v[2] + w * c) / t]
    return np.array([p[2] for p in pools]), np.array([p[1] for p in pools])


def fit(rows: DataFrame, seed: int = 11) -> Model | None:
    """The model of rows (_q_s, _q_y, _q_c): statistics, label, and whether the row only calibrates. None without rows."""
    fitted = rows.where("not _q_c")
    width = len(statistics(None))
    cells = fitted.select(F.posexplode("_q_s").alias("k", "v")).groupBy("k").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).collect()
    if not cells:
        return None
    mean, scale = np.zeros(width), np.ones(width)
    for r in cells:
        mean[r["k"]], scale[r["k"]] = r["m"], max(r["s"], 1e-6)
    model = Model(mean, scale, seed)
    parts = fitted.select("_q_s", "_q_y").coalesce(8).mapInPandas(lambda it: _normal_parts(it, model), "i long, j long, v double")
    gram, right, n = np.zeros((FEATURES + 1, FEATURES + 1)), np.zeros(FEATURES + 1), fitted.count()
    for r in parts.groupBy("i", "j").agg(F.sum("v").alias("v")).toLocalIterator():
        if r["j"] < 0:
            right[r["i"]] = r["v"]
        else:
            gram[r["i"], r["j"]] = gram[r["j"], r["i"]] = r["v"]
    model.weights = np.linalg.solve(gram + RIDGE * n * np.eye(FEATURES + 1) / FEATURES, right)
    held = rows.where("_q_c").select("_q_s", "_q_y").toPandas()
    if len(held) < 20:  # too few rows to calibrate on apart from the fit
        held = rows.select("_q_s", "_q_y").toPandas()
    model.knots, model.levels = isotonic(model.raw(_stack(held["_q_s"])), held["_q_y"].to_numpy(np.float64))
    return model


def _fold(folds: int):
    return F.pmod(F.crc32(F.coalesce(F.col("_q_i").cast("string"), F.lit(""))), F.lit(folds))


def _measured(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The id and statistics of all rows, written once."""
    kind = df.schema[id_col].dataType.simpleString()
    stats = df.select(F.col(id_col).alias("_q_i"), F.col(text_col).alias("_q_x")).mapInArrow(_measure, f"_q_i {kind}, _q_s array<double>")
    return materialize(stats, "statistics")


def _chosen(labels: DataFrame, id_col: str, folds: int, max_train: int) -> DataFrame:
    """(_q_i, _q_y) of the labelled ids outside fold 0 that a fit reads: about max_train, so small enough to broadcast."""
    known = labels.select(F.col(id_col).alias("_q_i"), F.col("quality").cast("int").alias("_q_y")).where("_q_i is not null and _q_y in (0, 1)")
    known = materialize(known.where(_fold(folds) != 0).groupBy("_q_i").agg(F.max("_q_y").alias("_q_y")), "labelled")
    if (n := known.count()) > max_train:
        known = known.where(F.pmod(F.xxhash64("_q_i"), F.lit(1_000_003)) < int(max_train / n * 1_000_003))
    return F.broadcast(known)


def _fit_on(stats: DataFrame, chosen: DataFrame, folds: int) -> Model | None:
    train = stats.join(chosen, "_q_i").select("_q_i", "_q_s", "_q_y", (_fold(folds) == folds - 1).alias("_q_c"))
    return fit(materialize(train, "training"))


def score_quality(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, threshold: float = 0.3, max_train: int = MAX_TRAIN) -> DataFrame:
    """One row per row of df: the id, held_out (boolean), score (double in 0 to 1) and predicted (int).

    labels has the id and quality (0 or 1; rows with another or no value don't count). crc32 of the id as text modulo
    `folds` gives a row's fold; fold 0 is held out of everything learned and fold 4 calibrates. Only the text enters a
    score; null and empty texts get the score of an empty text. Rows with a null id are scored and fall into fold 0, as
    crc32 of an empty text does. Without any usable label every score is 0.5. Where fewer than 20 labelled rows fall into
    fold 4, the rows of the fit calibrate too. Extra columns are left out.
    """
    stats = _measured(df, id_col, text_col)
    model = _fit_on(stats, _chosen(labels, id_col, folds, max_train), folds)

    @F.pandas_udf("double")
    def score(column: pd.Series) -> pd.Series:
        return pd.Series(model.scores(_stack(column)) if len(column) else [], dtype=float)

    value = score("_q_s") if model else F.lit(0.5)
    out = stats.select(F.col("_q_i").alias(id_col), (_fold(folds) == 0).alias("held_out"), value.alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def filter_quality(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, threshold: float = 0.3, max_train: int = MAX_TRAIN) -> DataFrame:
    """The rows of df that score_quality would give predicted = 1, with all their columns.

    Each text is scored where it lies, so no row is shuffled; the statistics of at most about max_train labelled texts,
    those of the fit, are taken once more.
    """
    chosen = _chosen(labels, id_col, folds, max_train)
    picked = df.join(chosen.select(F.col("_q_i").alias(id_col)), id_col, "left_semi")
    model = _fit_on(_measured(picked, id_col, text_col), chosen, folds)
    if model is None:
        return df if threshold <= 0.5 else df.where("false")

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.scores(np.array([statistics(t) for t in texts])) if len(texts) else [], dtype=float)

    return df.where(score(text_col) >= threshold)
