"""Line dedup, in DataFrame code only: whole by pairs of neighbour lines (dedup_passages), or by chunks (dedup_lines).

dedup_passages looks at every pair of neighbour lines, so a repeated run of two lines or more is found wherever it
stands and whatever surrounds it. dedup_lines looks at content-defined chunks and misses runs that hold no whole chunk:
a line ends a chunk when a rolling hash over the hashes of the last lines falls into a fixed share of its range, so
boundaries move with the content and not with line numbers. Chunks of several lines that occur more than once in the
corpus are removed but for their first occurrence, by (doc id, text hash, position), after their bytes were compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, without

#: First hex digits of the rolling hash that end a chunk: 5 in 16, so chunks have about three lines.
ENDS = "01234"
#: A hot group's chunks are compared in so many parts first.
SALTS = 32
#: What a line of white space alone is made of.
BLANKS = " \t\r\f\v\u00a0"


def _with_chunks(df: DataFrame, text: Column, window: int) -> DataFrame:
    """df with _ld_c, the chunks of its text in order (arrays of lines); joined by newlines they give the text back."""
    out = df.withColumn("_ld_l", F.split(F.coalesce(text, F.lit("")), "\n", -1))

    def ends_before(i: Column) -> Column:
        """Whether the rolling hash over the lines up to i - 1 ends a chunk there."""
        first = F.greatest(i - window, F.lit(0))
        rolled = F.md5(F.array_join(F.transform(F.slice("_ld_l", first + 1, i - first), F.md5), ""))
        return F.substring(rolled, 1, 1).isin(*ENDS)

    starts = F.filter(F.sequence(F.lit(0), F.size("_ld_l") - 1), lambda i: (i == 0) | ends_before(i))
    out = out.withColumn("_ld_s", starts)
    stop = lambda k: F.coalesce(F.get("_ld_s", k + 1), F.size("_ld_l"))
    return out.withColumn("_ld_c", F.transform("_ld_s", lambda s, k: F.slice("_ld_l", s + 1, stop(k) - s))).drop("_ld_l", "_ld_s")


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 2, min_lines: int = 2) -> DataFrame:
    """df with the text freed of repeated multi-line chunks, and `lines_removed` (long).

    Every row stays. A null text stays null. Rows with equal id and text count as one occurrence and get equal results;
    null ids order first. A chunk of fewer than `min_lines` lines is never removed, nor one that holds white space alone.
    A text whose chunks all go becomes empty. An input column named lines_removed is replaced.
    """
    df = without(df, "lines_removed")
    keyed = df.withColumn("_ld_t", F.xxhash64(text_col)).withColumn("_ld_i", F.col(id_col))
    rows = _with_chunks(keyed.select("_ld_i", "_ld_t", F.col(text_col).alias("_ld_x")), F.col("_ld_x"), window)
    # the outer form has Spark infer no filter that would repeat the whole expression below
    rows = rows.select("_ld_i", "_ld_t", F.posexplode_outer("_ld_c").alias("_ld_p", "_ld_c")).where(F.size("_ld_c") >= min_lines)
    rows = rows.select("_ld_i", "_ld_t", "_ld_p", F.array_join("_ld_c", "\n").alias("_ld_b")).where(F.trim(F.col("_ld_b"), F.lit(BLANKS + "\n")) != "")
    rows = rows.withColumn("_ld_h", F.unhex(F.md5("_ld_b")))
    place = F.struct("_ld_i", "_ld_t", "_ld_p")
    hashes = materialize(rows.drop("_ld_b"), "line-chunks")
    groups = hashes.groupBy("_ld_h").agg(F.min(place).alias("first"), F.max(place).alias("last")).where(~F.col("first").eqNullSafe(F.col("last")))
    groups = materialize(groups.select("_ld_h", "first"), "line-groups")

    # the bytes of a group's chunks are equal exactly if its least and its greatest are; hot groups go in parts first
    salted = rows.withColumn("_ld_r", F.pmod(F.xxhash64("_ld_i"), F.lit(SALTS)).cast("int"))
    parts = groups.select("_ld_h", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_ld_r"))
    ends = salted.join(parts.hint("merge"), ["_ld_h", "_ld_r"]).groupBy("_ld_h", "_ld_r").agg(F.min("_ld_b").alias("low"), F.max("_ld_b").alias("high"))
    ends = ends.groupBy("_ld_h").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    differ = materialize(ends.where("low <> high").select("_ld_h"), "line-differ")
    gone = hashes.join(groups, "_ld_h").where(~place.eqNullSafe(F.col("first")))
    if not differ.isEmpty():  # other bytes under one hash: there the bytes make the groups
        mixed = rows.join(differ, "_ld_h", "left_semi")
        firsts = mixed.groupBy("_ld_b").agg(F.min(place).alias("first"))
        gone = gone.join(differ, "_ld_h", "left_anti").unionByName(mixed.join(firsts, "_ld_b").where(~place.eqNullSafe(F.col("first"))).select(*gone.columns))
    gone = materialize(gone.groupBy("_ld_i", "_ld_t").agg(F.collect_set("_ld_p").alias("_ld_gone")), "line-gone")
    gone = gone.withColumnsRenamed({"_ld_i": "_ld_gi", "_ld_t": "_ld_gt"}).hint("merge")
    out = keyed.join(gone, F.col("_ld_i").eqNullSafe(F.col("_ld_gi")) & (F.col("_ld_t") == F.col("_ld_gt")), "left")
    hit = F.col("_ld_gone").isNotNull()
    out = _with_chunks(out, F.when(hit, F.col(text_col)), window)
    kept = F.filter("_ld_c", lambda c, k: ~F.array_contains("_ld_gone", k))
    lines = lambda chunks: F.aggregate(chunks, F.lit(0).cast("long"), lambda n, c: n + F.size(c))
    out = out.withColumn("lines_removed", F.when(hit, lines(F.col("_ld_c")) - lines(kept)).otherwise(F.lit(0)).cast("long"))
    out = out.withColumn(text_col, F.when(hit, F.array_join(F.flatten(kept), "\n")).otherwise(F.col(text_col)))
    return out.select(*df.columns, "lines_removed")


def _pairs(rows: DataFrame, digest: int, *more) -> DataFrame:
    """A row (_ld_i, _ld_t, _ld_p, _ld_h, ...) for each pair of neighbour lines but those of white space alone."""
    marked = F.transform("_ld_l", lambda x: F.struct(_digest(x, digest).alias("h"), (F.trim(x, F.lit(BLANKS)) != "").alias("s"), *[f(x).alias(n) for n, f in more]))
    rows = rows.select("_ld_i", "_ld_t", marked.alias("_ld_m"))
    both = lambda x, y: F.when(x["s"] | y["s"], F.struct(F.concat(x["h"], y["h"]).alias("h"), *[F.concat(x[n], F.lit("\n"), y[n]).alias(n) for n, _ in more]))
    rest = F.size("_ld_m") - 1
    pairs = F.zip_with(F.slice("_ld_m", F.lit(1), rest), F.slice("_ld_m", F.lit(2), rest), both)
    # the outer form has Spark infer no filter that would repeat the whole expression below
    rows = rows.select("_ld_i", "_ld_t", F.posexplode_outer(pairs).alias("_ld_p", "_ld_y")).where("_ld_y is not null")
    return rows.select("_ld_i", "_ld_t", "_ld_p", F.col("_ld_y.h").alias("_ld_h"), *[F.col(f"_ld_y.{n}").alias(n) for n, _ in more])


def _digest(x: Column, n: int) -> Column:
    return F.substring(F.unhex(F.md5(x)), 1, n)


def dedup_passages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: int = 16) -> DataFrame:
    """df with the text freed of repeated runs of two lines or more, and `lines_removed` (long).

    Of equal pairs of neighbour lines all but the first, by (doc id, text hash, position), lose both lines; so a repeated
    run goes whole, and each distinct line stays at its first place. Every row stays. A null text stays null. Rows with
    equal id and text count as one occurrence and get equal results; null ids order first. Pairs of white space alone
    don't count. A text whose lines all go becomes empty. An input column named lines_removed is replaced.
    """
    df = without(df, "lines_removed")
    keyed = df.withColumn("_ld_t", F.xxhash64(text_col)).withColumn("_ld_i", F.col(id_col))
    rows = keyed.select("_ld_i", "_ld_t", F.split(text_col, "\n", -1).alias("_ld_l"))
    place = F.struct("_ld_i", "_ld_t", "_ld_p")
    hashes = materialize(_pairs(rows, digest), "line-pairs")
    groups = hashes.groupBy("_ld_h").agg(F.min(place).alias("first"), F.max(place).alias("last")).where(~F.col("first").eqNullSafe(F.col("last")))
    gone = hashes.join(groups.select("_ld_h", "first"), "_ld_h").where(~place.eqNullSafe(F.col("first"))).drop("first")

    # a pair's hash stands for its bytes exactly if each line's hash does: if the least and greatest line under it are equal
    lines = rows.select(F.explode_outer("_ld_l").alias("_ld_b")).withColumn("_ld_h", _digest(F.col("_ld_b"), digest))
    differ = lines.groupBy("_ld_h").agg(F.min("_ld_b").alias("low"), F.max("_ld_b").alias("high")).where("low <> high")
    differ = materialize(differ.select("_ld_h"), "line-differ")
    if not differ.isEmpty():  # other bytes under one hash: there the bytes make the groups
        for at in (1, digest + 1):
            gone = gone.join(differ.withColumnRenamed("_ld_h", "_ld_d"), F.substring("_ld_h", at, digest) == F.col("_ld_d"), "left_anti")
        every = _pairs(rows, digest, ("_ld_b", lambda x: x))
        either = F.explode(F.array_distinct(F.array(F.substring("_ld_h", 1, digest), F.substring("_ld_h", digest + 1, digest))))
        mixed = every.withColumn("_ld_d", either).join(differ.withColumnRenamed("_ld_h", "_ld_d"), "_ld_d", "left_semi").drop("_ld_d").distinct()
        firsts = mixed.groupBy("_ld_b").agg(F.min(place).alias("first"))
        gone = gone.unionByName(mixed.join(firsts, "_ld_b").where(~place.eqNullSafe(F.col("first"))).select(*gone.columns))
    gone = materialize(gone.groupBy("_ld_i", "_ld_t").agg(F.collect_set("_ld_p").alias("_ld_gone")), "line-gone")
    gone = gone.withColumnsRenamed({"_ld_i": "_ld_gi", "_ld_t": "_ld_gt"}).hint("merge")
    out = keyed.join(gone, F.col("_ld_i").eqNullSafe(F.col("_ld_gi")) & (F.col("_ld_t") == F.col("_ld_gt")), "left")
    hit = F.col("_ld_gone").isNotNull()
    out = out.withColumn("_ld_l", F.split(F.when(hit, F.col(text_col)), "\n", -1))
    cut = F.array_union("_ld_gone", F.transform("_ld_gone", lambda p: p + 1))
    kept = F.array_except(F.sequence(F.lit(0), F.size("_ld_l") - 1), cut)
    out = out.withColumn("lines_removed", F.when(hit, F.size(cut)).otherwise(F.lit(0)).cast("long"))
    out = out.withColumn(text_col, F.when(hit, F.array_join(F.transform(kept, lambda p: F.get("_ld_l", p)), "\n")).otherwise(F.col(text_col)))
    return out.select(*df.columns, "lines_removed")
