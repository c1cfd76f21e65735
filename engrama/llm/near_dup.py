"""N-gram Jaccard self-join through a MinHash LSH forest, with exact verification.

Texts with the same set of shingles form one class representative. Each representative has a label in every tree of
the forest: its MinHash values, eight bits each, so that a label's leading bytes are its path in that tree's prefix
trie. Representatives that share a node at the least depth which the threshold can ask for form components; one of them
is cut into blocks along the order of its labels if it is large, and only pairs of blocks that share a node meet.

Within them matching starts at the tries' full depth: pairs whose labels agree as a whole are verified by the exact
Jaccard similarity of their shingle sets. Then prefixes are shortened by one value at a time, and pairs that a shorter
prefix brings together for the first time are verified. From the similarities found so far follows how many pairs each
depth is expected to have missed: where pairs are much alike the target recall is reached at once, where they are barely
so the prefixes shrink to the least depth, at which even pairs at the threshold meet with the target recall. No task
holds more than two blocks, and counts leave it, not pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MASK, components, hash_words, materialize, mix, text_slices

DEPTH, TREES = 8, 20
#: Representatives and shingles in a block of a large component; a cell of small ones has about as many shingles.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 22


def _coefficients(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, n, dtype=np.uint64)


_A, _B = _coefficients(DEPTH * TREES, 5)
_PLACE, _ = _coefficients(64, 9)


def shingles(h: np.ndarray, size: int) -> np.ndarray:
    """The sorted distinct hashes of runs of `size` words, given theirs; a text of fewer words is one shingle, of none has none."""
    if not len(h):
        return np.empty(0, np.uint64)
    run = min(size, len(h))
    n = len(h) - run + 1
    out = np.full(n, np.uint64((run * 0x9E3779B97F4A7C15) & MASK))
    for k in range(run):
        out = out * _PLACE[0] + h[k : k + n] * _PLACE[k + 1]
    return np.unique(mix(out))


def _text_shingles(column, size: int) -> Iterator[tuple[str | None, np.ndarray]]:
    for _, texts in text_slices(column):
        words, bounds = hash_words(texts)
        for k, text in enumerate(texts):
            yield text, shingles(words[bounds[k] : bounds[k + 1]], size)


def forest_labels(found: np.ndarray) -> np.ndarray:
    """One unsigned 64-bit label per tree."""
    low = np.full(DEPTH * TREES, np.uint64(MASK))
    high = (found >> np.uint64(32)) ^ found
    for at in range(0, len(high), 1024):
        part = (high[at : at + 1024, None] * _A[None, :] + _B[None, :]) >> np.uint64(20)
        low = np.minimum(low, part.min(axis=0))
    digits = (mix(low) >> np.uint64(56)).astype(np.uint8).reshape(TREES, DEPTH)
    return digits.view(">u8").ravel().astype(np.uint64)


def meets(similarity: float, depth: int) -> float:
    """The chance that a pair shares a node at this depth in some tree."""
    return 1 - (1 - (similarity + (1 - similarity) / 256) ** depth) ** TREES


def least_depth(threshold: float, target: float) -> int:
    """The greatest depth at which pairs at the threshold itself meet with the target recall."""
    return next((d for d in range(DEPTH, 0, -1) if meets(threshold, d) >= target), 1)


def _digest(text: str | None, found: np.ndarray) -> bytes:
    return hashlib.blake2b(found.tobytes() if len(found) else b"\0" + (text or "").encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _sign(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sums, labels, sizes = [], [], []
        for text, found in _text_shingles(batch.column("_nd_x"), size):
            sums.append(_digest(text, found))
            sizes.append(len(found))
            labels.append(forest_labels(found).astype(np.int64, casting="unsafe").tolist() if len(found) else None)
        yield pa.RecordBatch.from_arrays([batch.column("_nd_i"), batch.column("_nd_t"), pa.array(sums, pa.binary()), pa.array(sizes, pa.int64()), pa.array(labels, pa.list_(pa.int64()))], ["_nd_i", "_nd_t", "dig", "w", "labels"])


def _sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Shingle sets and labels of the rows that are the representative they were looked up as, each once."""
    done = set()
    for batch in batches:
        keep, sets, labels = [], [], []
        digs = batch.column("dig").to_pylist()
        for k, (text, found) in enumerate(_text_shingles(batch.column("_nd_x"), size)):
            if digs[k] not in done and _digest(text, found) == digs[k]:
                done.add(digs[k])
                keep.append(k)
                sets.append(found.tobytes())
                labels.append(forest_labels(found).tobytes())
        rest = batch.drop_columns(["_nd_x"]).take(pa.array(keep, pa.int64()))
        yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(sets, pa.binary()), pa.array(labels, pa.binary())], [*rest.schema.names, "found", "trees"])


def _near(la: np.ndarray, lb: np.ndarray, depth: int) -> np.ndarray:
    """Which pairs of labels share a node at this depth and none below it."""
    out = np.zeros((len(la), len(lb)), bool)
    for t in range(la.shape[1]):
        out |= (la[:, t, None] ^ lb[None, :, t]) >> np.uint64(64 - 8 * depth) == 0 if depth < DEPTH else la[:, t, None] == lb[None, :, t]
    if depth < DEPTH:
        for t in range(la.shape[1]):
            out &= (la[:, t, None] ^ lb[None, :, t]) >> np.uint64(56 - 8 * depth) != 0
    return out


def _similar(a: list[np.ndarray], b: list[np.ndarray] | None, near: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index pairs with similarity at or over the threshold among those near, and the similarities; within a where b is None."""
    if b is None:
        near = np.triu(near, 1)
        b = a
    i, j = np.nonzero(near)
    sa, sb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    fits = np.minimum(sa[i], sb[j]) >= threshold * np.maximum(sa[i], sb[j]) - 1e-9
    i, j = i[fits], j[fits]
    if len(i) <= 4 * (len(a) + len(b)):
        both = np.array([len(np.intersect1d(a[p], b[q], assume_unique=True)) for p, q in zip(i.tolist(), j.tolist(), strict=True)], np.float64)
    else:
        both = _common(a, b)[i, j]
    either = sa[i] + sb[j] - both
    hit = both >= threshold * either - 1e-9
    return i[hit], j[hit], both[hit] / np.maximum(1, either[hit])


def _common(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, by products of incidence matrices over slices of the shingles that repeat."""
    every = np.concatenate(a + ([] if b is a else b))
    kinds, counts = np.unique(every, return_counts=True)
    kinds = kinds[counts > 1]
    out = np.zeros((len(a), len(b)), np.float32)
    for at in range(0, len(kinds), 4096):
        part = kinds[at : at + 4096]

        def incidence(sets: list[np.ndarray], part: np.ndarray = part) -> np.ndarray:
            m = np.zeros((len(sets), len(part)), np.float32)
            for r, x in enumerate(sets):
                x = x[np.searchsorted(x, part[0]) : np.searchsorted(x, part[-1], "right")]
                k = np.searchsorted(part, x)
                m[r, k[part[np.minimum(k, len(part) - 1)] == x]] = 1
            return m

        left = incidence(a)
        out += left @ (left if b is a else incidence(b)).T
    return out.astype(np.float64)


def _lowest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n nodes, the least node of its component under the edges (i, j)."""
    root = np.arange(n)
    while len(i):
        low = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, root[i], low)
        np.minimum.at(root, root[j], low)
        root = root[root]
        if np.array_equal(root, before):
            break
    return root


def _forest_pairs(a: list[np.ndarray], b: list[np.ndarray] | None, la: np.ndarray, lb: np.ndarray, threshold: float, least: int, target: float) -> tuple[np.ndarray, np.ndarray, int, float]:
    """Similar index pairs (within a where b is None), the depth reached, and how many pairs there are expected to be."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for depth in range(DEPTH, least - 1, -1):
        found.append(_similar(a, b, _near(la, lb, depth), threshold))
        sim = np.concatenate([s for _, _, s in found])
        expected = float((1 / (1 - (1 - (sim + (1 - sim) / 256) ** depth) ** TREES)).sum())
        if len(sim) and len(sim) >= target * expected:
            break
    return np.concatenate([i for i, _, _ in found]), np.concatenate([j for _, j, _ in found]), depth, expected


def _verify(pdf: pd.DataFrame, threshold: float, least: int, target: float) -> pd.DataFrame:
    """For each representative in each block pair: the documents it links to there, and the least node it reaches.

    Rows without a digest say how many pairs were found (links) and expected, and the least depth, over the cell.
    """
    out, pairs, wanted, lowest = [], 0, 0.0, DEPTH
    for (_root, bi, bj), g in pdf.groupby(["root", "bi", "bj"], sort=False):
        g = g.drop_duplicates("dig").sort_values("dig")  # nodes in order, so the least index is the least digest
        sets = [np.frombuffer(x, np.uint64) for x in g["found"]]
        labels = np.frombuffer(b"".join(g["trees"]), np.uint64).reshape(len(g), TREES)
        weight, block = g["n"].to_numpy(np.int64), g["blk"].to_numpy()
        if bi == bj:
            i, j, depth, expected = _forest_pairs(sets, None, labels, labels, threshold, least, target)
        else:
            p, q = np.flatnonzero(block == bi), np.flatnonzero(block == bj)
            i, j, depth, expected = _forest_pairs([sets[k] for k in p], [sets[k] for k in q], labels[p], labels[q], threshold, least, target)
            i, j = p[i], q[j]
        pairs, wanted, lowest = pairs + len(i), wanted + expected, min(lowest, depth)
        links = np.bincount(i, weight[j], len(g)) + np.bincount(j, weight[i], len(g))
        linked = np.flatnonzero(links)
        digs = g["dig"].to_numpy()
        out.append(pd.DataFrame({"dig": digs[linked], "links": links[linked].astype(np.int64), "low": digs[_lowest(len(g), i, j)[linked]], "whole": g["parts"].to_numpy()[linked] == 1}))
    out.append(pd.DataFrame({"dig": [None], "links": [pairs], "expected": [wanted], "depth": [lowest]}))
    return pd.concat(out)


def _blocks(members: DataFrame, nodes: DataFrame, block: int) -> DataFrame:
    """members(dig, root, w, label) with blk, its block, and meet, the block pairs (bi, bj) it goes to."""
    size = lambda: F.ceil(F.greatest(F.count("*") / block, F.sum("w") / BLOCK_SHINGLES)).cast("long")
    sizes = members.groupBy("root").agg(size().alias("parts"))
    members = members.join(sizes, "root")
    # the order of the first tree's labels, then by hash where too many labels are alike
    span = F.when(F.col("parts") > 1, F.shiftright(F.shiftrightunsigned("label", 48) * F.col("parts"), 16)).otherwise(F.lit(0))
    members = members.withColumn("span", span.cast("long"))
    spans = members.where("parts > 1").groupBy("root", "span").agg(size().alias("subs"))
    members = members.join(spans, ["root", "span"], "left")
    blk = F.col("span") * (1 << 20) + F.pmod(F.xxhash64("dig"), F.coalesce("subs", F.lit(1)))
    members = materialize(members.withColumn("blk", F.when(F.col("parts") > 1, blk).otherwise(F.lit(0)).cast("long")).drop("span", "subs", "label"), "members")
    alone = F.array(F.struct(F.lit(0).cast("long").alias("bi"), F.lit(0).cast("long").alias("bj")))
    if members.where("parts > 1").isEmpty():
        return members.withColumn("meet", alone)
    spread = nodes.join(members.where("parts > 1").select("dig", "root", "blk"), "dig").select("root", "tree", "p", "blk").distinct()
    spread = materialize(spread, "node-blocks")
    pairs = spread.withColumnRenamed("blk", "bi").join(spread.withColumnRenamed("blk", "bj"), ["root", "tree", "p"]).where("bi <= bj").select("root", "bi", "bj").distinct()
    sides = pairs.select("root", "bi", "bj", F.explode(F.array_distinct(F.array("bi", "bj"))).alias("blk"))
    sides = sides.groupBy("root", "blk").agg(F.collect_list(F.struct("bi", "bj")).alias("meet"))  # as many as the component's blocks
    return members.join(sides, ["root", "blk"], "left").withColumn("meet", F.when(F.col("parts") > 1, F.col("meet")).otherwise(alone))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, threshold: float = 0.8, target: float = 0.9995, block: int = BLOCK, report: dict | None = None) -> DataFrame:
    """One row per row of df: the id, class_id, class_size (long), n_links (long) and set_digest (hex of the shingle set's).

    Two documents are linked if the Jaccard similarity of their sets of `size`-word shingles (words as in common.WORD) is
    at least `threshold`; a class is a connected component of links, named by its least id. n_links counts the linked
    documents, copies included. Links between different texts are found with the recall `target`, estimated from those
    found at each depth of the forest; `report` receives the least depth reached, the estimate and the pairs found. A text of
    fewer than `size` words is one shingle; texts without any word (null as empty) are linked to equal texts only. A
    null id takes part and is never a class id unless its class has no other. Rows that repeat count as documents of
    their own. Extra columns are left out.
    """
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("_nd_i"), F.xxhash64(text_col).alias("_nd_t"), F.col(text_col).alias("_nd_x"))
    signed = materialize(rows.mapInArrow(lambda it: _sign(it, size), f"_nd_i {kind}, _nd_t long, dig binary, w long, labels array<long>"), "signed")
    every = [F.min(F.struct("_nd_i", "_nd_t")).alias("rep"), F.min("_nd_i").alias("id"), F.count("*").alias("n"), F.first("w").alias("w"), F.first("labels").alias("labels")]
    reps = materialize(signed.groupBy("dig").agg(*every), "reps")

    least = least_depth(threshold, target)
    tries = reps.select("dig", F.posexplode("labels").alias("tree", "label")).withColumn("p", F.shiftrightunsigned("label", 64 - 8 * least) if least < DEPTH else F.col("label"))
    shared = tries.groupBy("tree", "p").agg(F.min("dig").alias("head"), F.max("dig").alias("tail")).where("head <> tail").select("tree", "p")
    tries = materialize(tries.join(shared, ["tree", "p"], "left_semi").select("tree", "p", "dig"), "tries")  # labels with company
    heads = tries.groupBy("tree", "p").agg(F.min("dig").alias("head"))
    edges = tries.join(heads, ["tree", "p"]).where("dig <> head").select(F.col("dig").alias("a"), F.col("head").alias("b"))
    parts = components(edges, "forest").withColumnRenamed("node", "dig")
    members = parts.join(reps.select("dig", "rep", "n", "w", F.get("labels", F.lit(0)).alias("label")), "dig")
    members = materialize(_blocks(members, tries, block), "meetings")

    cells = max(1, (members.agg(F.sum("w")).first()[0] or 0) // BLOCK_SHINGLES, members.count() // block)
    texts = rows.join(members.hint("merge"), rows["_nd_i"].eqNullSafe(F.col("rep._nd_i")) & (rows["_nd_t"] == F.col("rep._nd_t")))
    texts = texts.select("_nd_x", "dig", "root", "parts", "blk", "n", "meet").mapInArrow(lambda it: _sets(it, size), "dig binary, root binary, parts long, blk long, n long, meet array<struct<bi:long,bj:long>>, found binary, trees binary")
    texts = texts.select("dig", "root", "parts", "blk", "n", "found", "trees", F.inline("meet"))
    cell = F.when(F.col("parts") > 1, F.xxhash64("root", "bi", "bj")).otherwise(F.pmod(F.xxhash64("root"), F.lit(cells)))
    found = texts.groupBy(cell.alias("cell")).applyInPandas(lambda pdf: _verify(pdf, threshold, least, target), "dig binary, links long, low binary, whole boolean, expected double, depth int")
    found = materialize(found, "verified")
    if report is not None:
        n, expected, depth = found.where("dig is null").agg(F.sum("links"), F.sum("expected"), F.min("depth")).first()
        report |= {"depth": depth or DEPTH, "pairs": n or 0, "recall": n / expected if n else 1.0}

    found = found.where("dig is not null")
    links = found.groupBy("dig").agg(F.sum("links").alias("links"))
    class_of = found.where("whole").select("dig", F.col("low").alias("top"))
    large = found.where("not whole and dig <> low").select(F.col("dig").alias("a"), F.col("low").alias("b"))
    if not large.isEmpty():
        class_of = class_of.unionByName(components(large, "classes").select(F.col("node").alias("dig"), F.col("root").alias("top")))
    whole = reps.select("dig", "id", "n").join(links, "dig", "left").join(class_of, "dig", "left").withColumn("top", F.coalesce("top", "dig"))
    tops = whole.groupBy("top").agg(F.min("id").alias("class_id"), F.sum("n").alias("class_size"))
    whole = whole.join(tops, "top").select("dig", "class_id", "class_size", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    return signed.select("_nd_i", "dig").join(materialize(whole, "classes"), "dig").select(F.col("_nd_i").alias(id_col), "class_id", "class_size", "n_links", F.lower(F.hex("dig")).alias("set_digest"))
