"""Substring dedup by sliding spans of sentences.

From every sentence of a text runs a span: the least number of consecutive sentences, two at least, that together have
`min_words` words (any number of words by default); where no such span ends at a sentence, the least one that does is added, so that a repeated passage
is covered to its last sentence. Span hashes of 96 bits are joined globally; of equal spans the first by (doc id, text hash,
position) stays, and every sentence that any other of them covers is removed. Spans move without their text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, without

#: A sentence ends at ., ! or ? before white space, and at a line's end.
BREAK = re.compile(r"(?<=[.!?])\s+|\n\s*")


def sentences(text: str) -> list[tuple[int, int, int]]:
    """(start, stop, next start) of each sentence, in code points; white space between them belongs to none."""
    out, at = [], 0
    for m in BREAK.finditer(text):
        if m.start() > at:
            out.append((at, m.start(), m.end()))
        at = m.end()
    if at < len(text):
        out.append((at, len(text), len(text)))
    return out


def spans(text: str, min_sentences: int, min_words: int) -> Iterator[tuple[int, int, bytes]]:
    """(first sentence, number of sentences, hash) of the least span from each sentence, and of that to each other one."""
    found = sentences(text)
    words = [text[a:b].lower().split() for a, b, _ in found]
    sums = [xxhash.xxh3_128_digest(" ".join(w)) for w in words]
    total = np.cumsum([0] + [len(w) for w in words])
    count = len(found)
    stops = np.maximum(np.searchsorted(total, total[:-1] + min_words), np.arange(count) + min_sentences)
    starts = np.minimum(np.searchsorted(total, total[1:] - min_words, "right") - 1, np.arange(count) + 1 - min_sentences)
    pairs = [(i, j) for i, j in enumerate(stops.tolist()) if j <= count]
    ends = {j for _, j in pairs}
    pairs += [(i, j) for j, i in enumerate(starts.tolist(), 1) if i >= 0 and j not in ends]
    for i, j in pairs:
        yield i, j - i, xxhash.xxh3_128_digest(b"".join(sums[i:j]))[:12]


def _span_rows(batches: Iterator[pa.RecordBatch], min_sentences: int, min_words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, pos, size, sums = [], [], [], []
        for k, text in enumerate(batch.column("_sp_x")):
            if text.is_valid:
                for i, n, h in spans(text.as_py(), min_sentences, min_words):
                    at.append(k)
                    pos.append(i)
                    size.append(n)
                    sums.append(h)
            if len(at) > 50_000 or k == batch.num_rows - 1:
                take = pa.array(at, pa.int64())
                parts = np.frombuffer(b"".join(sums), np.dtype([("h1", "<i8"), ("h2", "<i4")]))
                yield pa.RecordBatch.from_arrays([batch.column("_sp_i").take(take), batch.column("_sp_t").take(take), pa.array(pos, pa.int32()), pa.array(size, pa.int32()), pa.array(parts["h1"].copy()), pa.array(parts["h2"].copy())], ["_sp_i", "_sp_t", "_sp_p", "_sp_n", "h1", "h2"])
                at, pos, size, sums = [], [], [], []


def _gone(hits: list, count: int) -> np.ndarray:
    """Which of a text's sentences the (position, number) pairs cover."""
    edge = np.zeros(count + 1, np.int64)
    for h in hits:
        edge[h["p"]] += 1
        edge[h["p"] + h["n"]] -= 1
    return np.cumsum(edge[:-1]) > 0


def _clean(text: str, hits: list) -> dict:
    found = sentences(text)
    gone = _gone(hits, len(found))
    cut: list[list[int]] = []
    for (a, _, after), g in zip(found, gone.tolist(), strict=True):
        if g:
            if cut and cut[-1][1] == a:
                cut[-1][1] = after
            else:
                cut.append([a, after])
    out, at = [], 0
    for a, b in cut:
        out.append(text[at:a])
        at = b
    out.append(text[at:])
    return {"text": "".join(out).rstrip() if cut and cut[-1][1] == len(text) else "".join(out), "removed": int(gone.sum()), "spans": [{"start": a, "stop": b} for a, b in cut]}


def _rebuild(texts: pd.Series, hits: pd.Series) -> pd.DataFrame:
    rows = [{"text": t, "removed": 0, "spans": []} if h is None else _clean(t, h) for t, h in zip(texts, hits, strict=True)]
    return pd.DataFrame(rows, columns=["text", "removed", "spans"])


def dedup_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_sentences: int = 2, min_words: int = 0) -> DataFrame:
    """df with the text freed of repeated spans, `sentences_removed` (int) and `removed_spans` (code points of the old text).

    A span is a run of `min_sentences` consecutive sentences, or of more where those have fewer than `min_words` words.
    Spans are compared without regard to case and to the white space between words. Every row stays; a null text stays
    null, a text that is all repeats becomes empty. Texts shorter than one span are left alone. Rows with equal id and
    text count as one and get equal results; null ids order first. Input columns named as the added ones are replaced.
    """
    df = without(df, "sentences_removed", "removed_spans")
    kind = df.schema[id_col].dataType.simpleString()
    rows, ids, kinds = df.agg(F.count("*"), F.count(id_col), F.countDistinct(id_col)).first()
    # the text's hash tells rows apart only where ids don't
    keyed = df.withColumn("_sp_i", F.col(id_col)).withColumn("_sp_t", F.lit(0).cast("long") if rows == ids == kinds else F.xxhash64(text_col))
    rows = keyed.select("_sp_i", "_sp_t", F.col(text_col).alias("_sp_x"))
    rows = rows.mapInArrow(lambda it: _span_rows(it, min_sentences, min_words), f"_sp_i {kind}, _sp_t long, _sp_p int, _sp_n int, h1 long, h2 int")
    rows = materialize(rows, "spans")
    place = F.struct("_sp_i", "_sp_t", "_sp_p")
    groups = rows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    groups = materialize(groups, "span-groups")  # so that the join below has two plain shuffles and hot spans can be split
    rest = rows.join(groups.hint("merge"), ["h1", "h2"]).where(~place.eqNullSafe(F.col("first")))
    hits = rest.groupBy("_sp_i", "_sp_t").agg(F.collect_set(F.struct(F.col("_sp_p").alias("p"), F.col("_sp_n").alias("n"))).alias("_sp_h"))
    hits = materialize(hits.withColumnsRenamed({"_sp_i": "_sp_hi", "_sp_t": "_sp_ht"}), "span-hits")
    out = keyed.join(hits.hint("merge"), F.col("_sp_i").eqNullSafe(F.col("_sp_hi")) & (F.col("_sp_t") == F.col("_sp_ht")), "left")
    rebuild = F.pandas_udf(_rebuild, "struct<text:string,removed:int,spans:array<struct<start:int,stop:int>>>")
    out = out.withColumn("_sp_r", rebuild(F.col(text_col), F.col("_sp_h")))
    out = out.withColumn(text_col, F.col("_sp_r.text"))
    return out.withColumn("sentences_removed", F.col("_sp_r.removed")).withColumn("removed_spans", F.col("_sp_r.spans")).select(*df.columns, "sentences_removed", "removed_spans")
