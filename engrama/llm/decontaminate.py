"""Benchmark decontamination: CGK embedding with repeated LSH over windows, and exact edit verification.

Over words as symbols, the CGK random walk copies the symbol under its pointer and steps on by a random bit of that
symbol and step, so that sequences a few edits apart have embeddings that agree in many places. Items are cut into a
length class each; windows of that size run over every document at a stride of a quarter of it, and over the items at
every offset, so an occurrence always has windows aligned with an item's. A repetition samples a few embedding places;
windows that agree in all of them are candidates. Items of about one length form a band, whose repetitions are added
until simulated occurrences with as many edits as the threshold allows are found with the target recall; a class takes
the longest sample that brings all its bands there with few repetitions, as longer samples give fewer false candidates.

A band that the most repetitions don't bring to the target is searched exactly instead: an item cut into one piece more
than the edits it is allowed has a piece left intact in every occurrence, so all places of its pieces are looked up.
Items too short for a window may have no edit, and are found as a whole in the same way.

Each candidate is verified by word edit distance against the whole item. Items travel to the documents in blocks of
bounded size; documents never move.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MASK, WORD, hash_words, materialize, mix, text_slices

#: Bound on the characters of items that one pass over the documents looks for (one longer item is a block of its own).
BLOCK_CHARS = 1 << 20
#: Embedding places in a sample, the longest first; repetitions of each walk that a longer sample may take, and the most.
SAMPLES, FEW_REPEATS = (5, 4, 3), 12
WALKS, LEAST_REPEATS, MOST_REPEATS = 2, 8, 24
#: Simulated occurrences that a band's recall is measured on.
TRIALS = 400
#: Items of fewer words have no window.
MIN_WORDS = 5


def window_size(n: int) -> int:
    """The item's length class: a power of two that leaves room for a stride of a quarter of it."""
    c = 4
    while 2 * c + 2 * c // 4 <= n:
        c *= 2
    return c


def stride_of(c: int) -> int:
    return max(1, c // 4)


def band_of(n: int) -> tuple[int, int]:
    """(length class, part of it): recall falls towards a class's least length, so a class is measured in four parts."""
    c = window_size(n)
    return c, max(0, 4 * (4 * n - 5 * c) // (5 * c))  # a class holds the lengths from 1.25 c to under 2.5 c


def embed(words: np.ndarray, starts: np.ndarray, c: int, walk: int) -> np.ndarray:
    """CGK embeddings (one column a window) of the windows of c words at `starts`, as the places that 1.5 c steps copy.

    The words are followed by c of padding, for walks that run past the end; those past their window copy what follows.
    """
    steps = 3 * c // 2
    at = starts.astype(np.int64)
    out = np.empty((steps, len(starts)), np.int64)
    bit = np.empty(len(starts), np.uint64)
    for j in range(steps):
        if j % 64 == 0:
            bits = mix(words + np.uint64(((walk * 131 + j // 64 + 1) * 0xD1B54A32D192ED03) & MASK))
        out[j] = at
        np.take(bits, at, out=bit, mode="clip")
        bit >>= np.uint64(j % 64)
        bit &= np.uint64(1)
        at += bit.view(np.int64)
    return out


def sample_key(words: np.ndarray, emb: np.ndarray, c: int, walk: int, k: int, sample: int) -> np.ndarray:
    """The k-th repetition's key: a hash of a few random places of the embedding."""
    rng = np.random.default_rng([c, walk, k])
    key = np.full(emb.shape[1], np.uint64(((c * 64 + walk) * 4096 + k + 1) * 0x9E3779B97F4A7C15 & MASK))
    symbol = np.empty(emb.shape[1], np.uint64)
    for p in np.sort(rng.choice(emb.shape[0], min(sample, emb.shape[0]), replace=False)):
        np.take(words, emb[p], out=symbol, mode="clip")
        symbol *= np.uint64(int(rng.integers(1, 2**62)) * 2 + 1)
        key += symbol
    key ^= key >> np.uint64(31)
    key *= np.uint64(0xFF51AFD7ED558CCD)
    return key


def _padded(words: np.ndarray, classes: list[int]) -> np.ndarray:
    return np.concatenate([words, np.zeros(max(classes, default=0) + 1, np.uint64)])


class Table:
    """Keys of a block's windows or pieces, with their item and their offset in it."""

    def __init__(self, keys: list[np.ndarray], item: list[np.ndarray], offset: list[np.ndarray]):
        flat = np.concatenate(keys)
        order = np.argsort(flat, kind="stable")
        self.keys, self.item, self.offset = flat[order], np.concatenate(item)[order], np.concatenate(offset)[order]
        self.shift = np.uint64(64 - max(12, min(26, int(len(flat) * 24).bit_length())))
        self.bitmap = np.zeros(1 << (64 - int(self.shift)), bool)
        self.bitmap[(self.keys >> self.shift).astype(np.int64)] = True

    def lookup(self, key: np.ndarray, text: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Rows (text number, item number, place of the item's first word) for keys at these places."""
        hit = np.flatnonzero(self.bitmap[(key >> self.shift).astype(np.int64)])
        low = np.searchsorted(self.keys, key[hit])
        n = np.searchsorted(self.keys, key[hit], "right") - low
        w = np.repeat(hit, n)
        e = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.stack([text[w], self.item[e], starts[w] - self.offset[e]], 1)


def run_keys(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of `size` words."""
    n = max(0, len(words) - size + 1)
    key = np.full(n, np.uint64(size))
    for k in range(size):
        key = mix(key + words[k : k + n])
    return key


class Index:
    """All windows of a block of items by repetition key; the pieces of items that are searched by them."""

    def __init__(self, items: list[tuple], threshold: float, target: float):
        """Items as (id, word hashes)."""
        self.ids = [i for i, _ in items]
        self.words = [w for _, w in items]
        self.lists = [w.tolist() for w in self.words]
        self.threshold = threshold
        self.flat = np.concatenate(self.words) if items else np.empty(0, np.uint64)
        self.first = np.cumsum([0] + [len(w) for w in self.words])[:-1]
        bands: dict[tuple[int, int], list[int]] = {}
        exact = []
        for i, w in enumerate(self.words):
            (bands.setdefault(band_of(len(w)), []) if len(w) >= MIN_WORDS else exact).append(i)
        #: Places in a sample by class, and by band (repetitions, measured recall); 0 repetitions: searched exactly.
        self.sample: dict[int, int] = {}
        self.plan: dict[tuple[int, int], tuple[int, float]] = {}
        for c in sorted({c for c, _ in bands}):
            self._choose(c, {b: own for b, own in sorted(bands.items()) if b[0] == c}, target)
        exact += [i for b, own in bands.items() if not self.plan[b][0] for i in own]
        self.windows: dict[int, dict[tuple[int, int], Table]] = {}
        for c in self.sample:
            if own := {i: n for b, (n, _) in self.plan.items() if b[0] == c and n for i in bands[b]}:
                self.windows[c] = self._tables(c, own, self.sample[c])
        self.pieces = self._pieces(exact)

    def _choose(self, c: int, bands: dict[tuple[int, int], list[int]], target: float) -> None:
        """The sample of class c and the repetitions of its bands."""
        for sample in SAMPLES:
            most = MOST_REPEATS if sample == SAMPLES[-1] else FEW_REPEATS
            found = {b: self._needed(c, own, sample, most, target) for b, own in bands.items()}
            if all(n for n, _ in found.values()):
                break
        self.sample[c] = sample
        self.plan |= found

    def most(self, i: int) -> int:
        """Edits that an occurrence of item i may have."""
        return int((1 - self.threshold) * len(self.words[i]) + 1e-9)

    def _tables(self, c: int, own: dict[int, int], sample: int) -> dict[tuple[int, int], Table]:
        """A table by walk and repetition of the windows of items `own`, each with as many repetitions as it says."""
        flat, out = _padded(self.flat, [c]), {}
        offs = [np.arange(len(self.words[i]) - c + 1) for i in own]
        offset, which = np.concatenate(offs), np.repeat(list(own), [len(o) for o in offs])
        upto = np.repeat(list(own.values()), [len(o) for o in offs])
        for walk in range(WALKS):
            emb = embed(flat, self.first[which] + offset, c, walk)
            for k in range(max(own.values())):
                on = upto > k
                out[walk, k] = Table([sample_key(flat, emb, c, walk, k, sample)[on]], [which[on]], [offset[on]])
        return out

    def _pieces(self, own: list[int]) -> dict[int, Table]:
        """Tables by length of the pieces of items `own`, cut into one piece more than the edits each may have."""
        parts: dict[int, list[tuple[np.ndarray, int, np.ndarray]]] = {}
        for i in own:
            n, count = len(self.words[i]), self.most(i) + 1
            size = max(1, n // count)
            at = np.arange(min(count, n // size)) * size
            parts.setdefault(size, []).append((run_keys(self.words[i], size)[at], i, at))
        return {size: Table([k for k, _, _ in p], [np.full(len(k), i) for k, i, _ in p], [at for _, _, at in p]) for size, p in parts.items()}

    def candidates(self, words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Rows (text number, item number, place of the item's first word) for texts laid end to end at `bounds`."""
        found = [self._by_windows(c, self.sample[c], tables, words, bounds) for c, tables in sorted(self.windows.items())]
        for size, table in sorted(self.pieces.items()):
            key = run_keys(words, size)
            starts = np.arange(len(key))
            text = np.searchsorted(bounds, starts, "right") - 1
            inside = starts + size <= bounds[text + 1]
            found.append(table.lookup(key[inside], text[inside], starts[inside]))
        return np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 3), np.int64)

    def _by_windows(self, c: int, sample: int, tables: dict[tuple[int, int], Table], words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        found, padded, s = [np.empty((0, 3), np.int64)], _padded(words, [c]), stride_of(c)
        counts = np.maximum(0, (np.diff(bounds) - c) // s + 1)
        text = np.repeat(np.arange(len(counts)), counts)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
        all_starts = bounds[text] + nth * s
        for at in range(0, len(all_starts), 16384):
            starts = all_starts[at : at + 16384]
            for walk in range(WALKS):
                emb = embed(padded, starts, c, walk)
                for k in sorted({k for _, k in tables}):
                    found.append(tables[walk, k].lookup(sample_key(padded, emb, c, walk, k, sample), text[at:], starts))
        return np.concatenate(found)

    def _needed(self, c: int, own: list[int], sample: int, most: int, target: float) -> tuple[int, float]:
        """The repetitions that find simulated occurrences of these items with the target recall, and the recall; 0 if the most don't."""
        some, words, bounds = self._simulated(own)
        tables, left = self._tables(c, dict.fromkeys(set(some), most), sample), set(range(len(some)))
        for repeats in range(4, most + 1, 4):
            upto = {x: t for x, t in tables.items() if repeats - 4 <= x[1] < repeats}
            left -= {t for t, i, _ in self._by_windows(c, sample, upto, words, bounds).tolist() if i == some[t]}
            if repeats >= LEAST_REPEATS and len(left) <= (1 - target) * len(some):
                return repeats, 1 - len(left) / len(some)
        return 0, 1 - len(left) / len(some)

    def _simulated(self, own: list[int]) -> tuple[list[int], np.ndarray, np.ndarray]:
        """TRIALS of these items, each repeated as need be, with the most edits at random: items, words, bounds."""
        rng = np.random.default_rng(7)
        some = np.resize(rng.permutation(own), TRIALS).tolist()
        texts = []
        for i in some:
            w = list(self.words[i])
            for _ in range(self.most(i)):
                p, kind = rng.integers(len(w)), rng.integers(3)
                new = np.uint64(rng.integers(2**63))
                if kind == 0:
                    w[p] = new
                elif kind == 1:
                    w.insert(p, new)
                elif len(w) > 1:
                    del w[p]
            lead = rng.integers(0, 2**63, rng.integers(0, 40), dtype=np.uint64)
            texts.append(np.concatenate([lead, np.array(w, np.uint64), rng.integers(0, 2**63, 40, dtype=np.uint64)]))
        return some, np.concatenate(texts), np.cumsum([0] + [len(t) for t in texts])


def edit_rows(pattern: np.ndarray, text: np.ndarray, free_start: bool) -> np.ndarray:
    """Word edit distances of the pattern to the text's prefixes (their best suffixes, with a free start)."""
    cols = np.arange(len(text) + 1)
    row = np.zeros(len(cols), np.int64) if free_start else cols.copy()
    for i, w in enumerate(pattern.tolist()):
        new = row + 1
        new[1:] = np.minimum(new[1:], row[:-1] + (text != w))
        new[0] = i + 1
        row = np.minimum.accumulate(new - cols) + cols
    return row


def locate(pattern: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """(distance, start, stop) of the text's part nearest the pattern; the earliest end, then the latest start."""
    ends = edit_rows(pattern, text, True)
    stop = int(ends.argmin())
    back = edit_rows(pattern[::-1], text[:stop][::-1], False)
    return int(ends[stop]), stop - int(np.flatnonzero(back == ends[stop])[0]), stop


def _matches(index: Index, words: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
    """(text number, item number, distance, first word, word after) of the best verified place of each text and item."""
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    done = set()
    found = index.candidates(words, bounds).tolist()
    as_list = words.tolist() if found else []
    for t, i, p in found:
        item = index.lists[i]
        n = len(item)
        most = index.most(i)
        low, high = max(int(bounds[t]), p - 2 * most - 1), min(int(bounds[t + 1]), p + n + 2 * most + 1)
        span = set(as_list[low:high])
        if sum(map(span.__contains__, item)) < n - most:  # each missing word is an edit
            continue
        if (t, i, low) in done:
            continue
        done.add((t, i, low))
        d, a, b = locate(index.words[i], words[low:high])
        if d <= most:
            place = (d, a + low - int(bounds[t]), b + low - int(bounds[t]))
            best[t, i] = min(best.get((t, i), place), place)
    for (t, i), (d, a, b) in sorted(best.items()):
        yield t, i, d, a, b


def _place(text: str, a: int, b: int) -> tuple[int, int]:
    """Code points of the text from its a-th word to before its b-th."""
    low = text.lower()
    places = [m.span() for m in itertools.islice(WORD.finditer(low), b)]
    start, stop = places[a][0], places[b - 1][1]
    if len(low) == len(text):
        return start, stop
    ends = np.cumsum([len(ch.lower()) for ch in text])  # some letters are longer in lower case
    return int(np.searchsorted(ends, start, "right")), int(np.searchsorted(ends, stop - 1, "right")) + 1


def _search(batches: Iterator[pa.RecordBatch], index: Index, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple] = []
        for first, texts in text_slices(batch.column(1)):
            words, bounds = hash_words(texts)
            for t, i, d, a, b in _matches(index, words, bounds):
                start, stop = _place(texts[t], a, b)
                rows.append((batch.column(0)[first + t].as_py(), index.ids[i], start, stop, d, 1 - d / len(index.words[i])))
        cols = list(zip(*rows, strict=True)) or [[]] * 6
        kinds = [batch.schema.field(0).type, id_type, pa.int32(), pa.int32(), pa.int32(), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "item_id", "start", "stop", "distance", "similarity"])


def _blocks(items: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple]]:
    """The items that hold a word, as (id, word hashes), in blocks of about BLOCK_CHARS characters."""
    usable = items.select(F.col(item_col).alias("i"), F.col(text_col).alias("t")).where("t is not null")
    chars = usable.agg(F.sum(F.length("t").cast("long"))).first()[0] or 0
    blocks = max(1, -(-chars // BLOCK_CHARS))
    usable = usable.withColumn("b", F.pmod(F.xxhash64("i", "t"), F.lit(blocks)))
    for b in range(blocks):
        block = [(r["i"], w) for r in usable.where(F.col("b") == b).orderBy("i", "t").collect() if len(w := hash_words([r["t"]])[0])]
        if block:
            yield block


def find_leaks(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", threshold: float = 0.8, target: float = 0.98) -> DataFrame:
    """Verified occurrences: doc_id, item_id, start, stop (code points of the text), distance, similarity.

    Words are those of common.WORD. An item of n words occurs in a text if some run of the text's words is within
    (1 - threshold) n word insertions, deletions and substitutions of it; each text and item give their best place
    once, the earliest of the nearest. Null texts, and items without a word, never match; items of under 5 words match
    word by word. Null and repeated ids are carried along. `target` is the recall, measured for each band of lengths by
    search_plan, of occurrences with the most edits; fewer edits are found more surely. Extra columns are left out.
    Without items the result is empty.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_dc_x"))
    kind, item_kind = df.schema[id_col].dataType, items.schema[item_col].dataType
    schema = f"doc_id {kind.simpleString()}, item_id {item_kind.simpleString()}, start int, stop int, distance int, similarity double"
    arrow, out = to_arrow_type(item_kind), None
    for block in _blocks(items, item_col, text_col):  # a bounded part of the items at a time, whatever the documents
        index = Index(block, threshold, target)
        found = rows.mapInArrow(lambda it, index=index: _search(it, index, arrow), schema)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else rows.select("doc_id").where("false").selectExpr("doc_id", f"cast(null as {item_kind.simpleString()}) as item_id", "0 as start", "0 as stop", "0 as distance", "0d as similarity")


def search_plan(items: DataFrame, text_col: str = "text", item_col: str = "item_id", threshold: float = 0.8, target: float = 0.98) -> list[dict]:
    """How find_leaks looks for the items of each band of lengths: class, part, sample, repetitions and measured recall."""
    out = []
    for n, block in enumerate(_blocks(items, item_col, text_col)):
        index = Index(block, threshold, target)
        out += [{"block": n, "window": c, "part": p, "sample": index.sample[c], "repeats": k, "recall": recall if k else 1.0} for (c, p), (k, recall) in index.plan.items()]
    return out


def decontaminate(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of df whose text holds no item; rows with equal id and text share their fate, other columns stay."""
    keyed = df.withColumn("_dc_k", F.struct(F.col(id_col).alias("i"), F.xxhash64(text_col).alias("t")))
    hits = find_leaks(keyed, items, "_dc_k", text_col, **how).select(F.col("doc_id").alias("_dc_h")).distinct()
    hits = materialize(hits, "leaks")
    return keyed.join(hits, F.col("_dc_k.i").eqNullSafe(F.col("_dc_h.i")) & (F.col("_dc_k.t") == F.col("_dc_h.t")), "left_anti").drop("_dc_k")
