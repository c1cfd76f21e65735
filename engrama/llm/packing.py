"""Hierarchical best-fit packing of token sequences.

Documents are tokenized where they lie; only piece lengths move on. In the first round cells of pieces are packed by
best fit, longest first; full bins and bins that no open bin could still fill are emitted, the others go to the next
round as items of their own, in fewer and fewer cells, until one cell packs what is left. Where cells find next to
nothing that fits, the bins left are merged all at once: bins of one fill are alike, so best fit runs over counts by
fill, a table no larger than the capacity, and each bin takes its place by its rank among those of its fill. A bin
remembers where it went and at which offset, so pieces find their place by joins over open bins alone.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, span_hashes, text_slices

#: Items that one cell packs at a time.
CELL_ITEMS = 50_000
#: Chunks whose ids a worker remembers, and the longest of them.
CACHE, CACHED_BYTES = 600_000, 64
SLICE = 1 << 20
#: Classes of bytes: 0 blank, 1 ASCII letter or digit, 2 other visible ASCII, 3 what never parts from its neighbours.
_CLASS = np.full(256, 3, np.int8)
_CLASS[33:127] = 2
_CLASS[list(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = 1
_CLASS[list(b" \n\t\r")] = 0
_CLASS[ord("'")] = 3
_tokenizers: dict[str, tuple] = {}


def _tokenizer(path: str) -> tuple:
    if path not in _tokenizers:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        added = {t.content: i for i, t in tok.get_added_tokens_decoder().items()}
        _tokenizers[path] = (tok, {}, added, re.compile("|".join(f"({re.escape(t)})" for t in sorted(added, key=len, reverse=True)) or "(?!)"))
    return _tokenizers[path]


def _match_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> bool:
    """Whether the spans of these sizes at a hold the same bytes as those at b."""
    k = np.flatnonzero(a != b)
    n = sizes[k]
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return bool((data[np.repeat(a[k], n) + at] == data[np.repeat(b[k], n) + at]).all())


def _lowered(text: str) -> str:
    """The text in lower case where that can't change its ids, since the tokenizer lowers too."""
    if text.isascii() or not ("\u0130" in text or "\u03a3" in text) and unicodedata.is_normalized("NFC", text):
        return text.lower()
    return text


def _chunks(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops of chunks: parted by blanks, and where ASCII letters or digits meet other ASCII marks."""
    kind = np.zeros(len(data) + 2, np.int8)
    kind[1:-1] = _CLASS[data]
    before, after = kind[:-1], kind[1:]
    part = (before + after == 3) & (before * after == 2)  # 1 beside 2
    return np.flatnonzero((after != 0) & ((before == 0) | part)), np.flatnonzero((before != 0) & ((after == 0) | part))


def _distinct(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The distinct chunks, and the number of each chunk among them: grouped by hash, then held against their bytes."""
    sizes = stops - starts
    _, first, inverse = np.unique(span_hashes(data, starts, stops), return_index=True, return_inverse=True)
    if not (sizes == sizes[first][inverse]).all() or not _match_bytes(data, starts, starts[first][inverse], sizes):
        known: dict[bytes, int] = {}  # other bytes under one hash
        inverse = np.array([known.setdefault(data[a:b].tobytes(), len(known)) for a, b in zip(starts.tolist(), stops.tolist(), strict=True)], np.int64)
        return list(known), inverse
    whole = data.tobytes()
    return [whole[a:b] for a, b in zip(starts[first].tolist(), stops[first].tolist(), strict=True)], inverse


def encode(texts: list[str], path: str) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all texts end to end (unsigned 32-bit), and where each text's begin (with the end).

    The tokenizer lowers letters, never joins characters across white space, and parts letters from marks, so a text's
    ids are those of its chunks in turn. Chunks repeat: each is encoded once and remembered by its bytes. A text that
    holds an added token's string, which the tokenizer cuts out first, is encoded as the parts around it.
    """
    tok, seen, added, marks = _tokenizer(path)
    if any(a in t for t in texts for a in added):
        split = [[p for p in marks.split(t) if p] if any(a in t for a in added) else [t] for t in texts]
        ids, bounds = _encode_plain(["" if p in added else p for own in split for p in own], tok, seen)
        out, sizes, k = [], [], 0
        for own in split:
            parts = [np.array([added[p]], "<u4") if p in added else ids[bounds[k + n] : bounds[k + n + 1]] for n, p in enumerate(own)]
            out += parts
            sizes.append(sum(map(len, parts)))
            k += len(own)
        return np.concatenate(out) if out else np.empty(0, "<u4"), np.cumsum([0, *sizes])
    return _encode_plain(texts, tok, seen)


def _encode_plain(texts: list[str], tok, seen: dict) -> tuple[np.ndarray, np.ndarray]:
    parts = [_lowered(t).encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join(parts), np.uint8)
    starts, stops = _chunks(data)
    names, inverse = _distinct(data, starts, stops)
    pool = list(map(seen.get, names))
    new = [k for k, e in enumerate(pool) if e is None]
    for k, e in zip(new, tok.encode_batch_fast([names[k].decode("utf-8", "surrogatepass") for k in new], add_special_tokens=False), strict=True):
        pool[k] = np.array(e.ids, "<u4").tobytes()
    if len(seen) < CACHE:
        seen.update((names[k], pool[k]) for k in new if len(names[k]) <= CACHED_BYTES)
    sizes = np.fromiter(map(len, pool), np.int64, len(pool)) // 4
    begins = np.cumsum(sizes) - sizes
    counts = sizes[inverse]
    ends = np.cumsum(counts)
    ids = np.frombuffer(b"".join(pool), "<u4")[np.repeat(begins[inverse] - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)]
    offsets = np.cumsum([0] + [len(p) + 1 for p in parts])
    return ids, np.concatenate([[0], ends])[np.searchsorted(starts, offsets)]


def _pieces(batches: Iterator[pa.RecordBatch], path: str, size: int, end_id: int) -> Iterator[pa.RecordBatch]:
    end = np.array([end_id], "<u4")
    for batch in batches:
        rows = []
        for first, texts in text_slices(batch.column(1), SLICE):
            ids, bounds = encode([t or "" for t in texts], path)
            for k in range(len(texts)):
                own = np.concatenate([ids[bounds[k] : bounds[k + 1]], end])
                for j in range(0, len(own), size):
                    part = own[j : j + size]
                    rows.append((first + k, j // size, j, len(part), zlib.crc32(part)))
        cols = np.array(rows, np.int64).reshape(-1, 5).T
        keys = batch.column(0).take(pa.array(cols[0]))
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([keys, *(pa.array(c, t) for c, t in zip(cols[1:], kinds, strict=True))], ["doc_id", "piece", "start", "length", "ids_crc32"])


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best fit, longest first: each item's bin (numbered from 0) and offset, and each bin's fill."""
    order = np.argsort(-sizes, kind="stable")
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    fills: list[int] = []
    rooms: list[int] = []  # the distinct residuals of open bins, ascending
    at: dict[int, list[int]] = {}
    for i in order.tolist():
        need = int(sizes[i])
        k = bisect_left(rooms, need)
        if k == len(rooms):
            b, room = len(fills), capacity
            fills.append(0)
        else:
            room = rooms[k]
            b = at[room].pop()
            if not at[room]:
                del rooms[k]
        bins[i], offsets[i] = b, fills[b]
        fills[b] += need
        if rest := room - need:
            if not at.get(rest):
                at.setdefault(rest, [])
                insort(rooms, rest)
            at[rest].append(b)
    return bins, offsets, np.array(fills, np.int64)


def best_fit_counts(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit, longest first, over counts of items by size, as rows (size, rank, stop, bin, per, shift): the items of
    that size with ranks from `rank` to before `stop` go to the bins from `bin` on, `per` to each, from offset `shift`.

    A step takes whole runs of like bins and leaves each at most half of its room, so there are at most some tens of rows
    per distinct size, whatever the counts.
    """
    rooms: dict[int, list[tuple[int, int]]] = {}  # room: runs of bins (first, number)
    rows, bins = [], 0
    for size in sorted(counts, reverse=True):
        rank, left = 0, counts[size]
        while left:
            room = min((r for r in rooms if r >= size), default=None)
            if room is None:
                room, per = capacity, capacity // size
                first, n = bins, -(-left // per)
                bins += n
            else:
                first, n = rooms[room].pop()
                if not rooms[room]:
                    del rooms[room]
                per = room // size
            full = min(n, left // per)
            rest = min(left - full * per, per - 1) if full < n else 0
            for start, number, each in ((first, full, per), (first + full, min(rest, 1), rest)):
                if number:
                    rows.append((size, rank, rank + number * each, start, each, capacity - room))
                    rank, left = rank + number * each, left - number * each
                    rooms.setdefault(room - each * size, []).append((start, number))
            if n > full + min(rest, 1):
                rooms.setdefault(room, []).append((first + full + min(rest, 1), n - full - min(rest, 1)))
    return rows


def _merge_by_size(items: DataFrame, capacity: int, cells: int) -> DataFrame:
    """All of items(item, size) packed by best_fit_counts: item, bin (below 0, so unlike any item), shift."""
    items = materialize(items.withColumn("cell", F.pmod(F.xxhash64("item"), F.lit(cells)).cast("int")), "open-bins")
    counts = materialize(items.groupBy("size", "cell").agg(F.count("*").alias("n")), "open-counts")
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("size").orderBy("cell")) - F.col("n")).drop("n")
    plan = best_fit_counts({r[0]: r[1] for r in counts.groupBy("size").agg(F.sum("n")).collect()}, capacity)  # a row per size
    table = F.broadcast(items.sparkSession.createDataFrame(plan, "size long, low long, stop long, first long, per long, base long"))
    nth = F.row_number().over(Window.partitionBy("size", "cell").orderBy("item")) - 1
    ranked = items.withColumn("nth", nth).join(before, ["size", "cell"]).withColumn("rank", F.col("nth") + F.col("before"))
    ranked = ranked.join(table, "size").where("rank >= low and rank < stop")
    return ranked.select("item", F.expr("-1 - (first + (rank - low) div per)").alias("bin"), F.expr("base + ((rank - low) % per) * size").alias("shift"))


def _pack_cell(pdf: pd.DataFrame, capacity: int) -> pd.DataFrame:
    pdf = pdf.sort_values("item", kind="stable")  # the same bins when a lost task runs again
    bins, offsets, fills = best_fit(pdf["size"].to_numpy(np.int64), capacity)
    items = pdf["item"].to_numpy(np.int64)
    names = np.full(len(fills), np.iinfo(np.int64).max)
    np.minimum.at(names, bins, items)
    return pd.DataFrame({"item": items, "bin": names[bins], "shift": offsets, "fill": fills[bins]})


def pack(df: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", cell_items: int = CELL_ITEMS) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its token ids and then end_id; only one longer than `size` is cut, into pieces of that size and a
    rest. A null text counts as empty, so gives one piece of one id. Ids may be null or repeated: each row is packed on
    its own. Other columns are left out. An empty table gives no rows. `tokenizer` is a path that executors can read.
    """
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_bp_x"))
    kind = df.schema[id_col].dataType.simpleString()
    pieces = rows.mapInArrow(lambda it: _pieces(it, tokenizer, size, end_id), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")
    pieces = materialize(pieces.withColumn("item", F.monotonically_increasing_id()), "pieces")  # item is fixed once written
    open_bins = pieces.where(F.col("length") < size).select("item", F.col("length").alias("size"))
    count = open_bins.count()
    moves: DataFrame | None = None  # where each open piece is after the rounds so far

    def after(packed: DataFrame) -> DataFrame:
        """The moves with those of one more round."""
        if moves is None:
            return packed
        step = packed.select(F.col("item").alias("bin"), F.col("bin").alias("bin2"), F.col("shift").alias("shift2"))
        out = moves.join(step, "bin", "left").select("item", F.coalesce("bin2", "bin").alias("bin"), (F.col("shift") + F.coalesce("shift2", F.lit(0))).alias("shift"))
        return materialize(out, "moves")

    while count:
        cells = -(-count // cell_items)
        cell = F.pmod(F.xxhash64("item"), F.lit(cells)).alias("cell")
        packed = open_bins.select("item", "size", cell).groupBy("cell").applyInPandas(lambda pdf: _pack_cell(pdf, size), "item long, bin long, shift long, fill long")
        packed = materialize(packed, "packed")
        moves = after(packed)
        if cells == 1:
            break
        left = packed.where(F.col("fill") < size).groupBy("bin").agg(F.first("fill").alias("size")).withColumnRenamed("bin", "item")
        least = left.agg(F.min("size")).first()[0]
        if least is None:
            break
        open_bins = left.where(F.col("size") + least <= size)  # nothing fits into the others any more
        before, count = count, open_bins.count()
        if count > 0.9 * before:  # cells of this many bins find next to nothing that fits
            moves = after(materialize(_merge_by_size(open_bins, size, cells), "merged"))
            break
    if moves is None:
        return pieces.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("item").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    out = pieces.join(moves.select("item", "bin", "shift"), "item", "left")
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("bin", "item").alias("sequence_id"), F.coalesce("shift", F.lit(0)).cast("long").alias("offset"))
