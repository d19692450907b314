"""Benchmark decontamination with DataFrame operations only.

Windows as long as a benchmark item are laid over the documents and compared with the items of that length. A
window of similarity 0.8 with an item of ``length`` shingles holds at least ``0.8 * length`` places whose five-word
shingle is in an item of that length, so windows are laid where that many places stand so close, and no other window
can qualify. Windows and items get 64-bit
SimHash fingerprints over their shingles. The multi-index cuts a fingerprint into ``radius + 1`` blocks, of which
two fingerprints within the radius are guaranteed to share one; the blocks of all windows are equi-joined with those
of all items of the length, candidates beyond the radius dropped, and the rest verified exactly by the weighted
Jaccard similarity of their shingles (the weight of a shingle is how often it occurs).

Five-word shingles make a fingerprint of few features, so texts of similarity 0.8 differ in many bits. The radius is
wide enough by measurement, not by proof: of 4,900 edited items of similarity 0.8 and more, none was beyond 18 bits
(README). With so wide a radius a block is two or three bits, so it is the length that keeps the join selective.

Words are maximal runs of letters and digits, lower-cased. Cases: null and empty texts, and texts or items
of fewer than five words, have no shingles and never match; repeated rows are reported one by one; rows that
agree in id and text share one result; a null id is kept; extra columns are ignored; empty tables give no
match. The shingle table of the benchmark is broadcast only where its size, known from its file, lies
under Spark's own threshold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import materialize, scratch, small_side

SHINGLE, SIMILARITY, RADIUS = 5, 0.8, 24


def let(value: F.Column, body) -> F.Column:
    """``body`` of a value that is evaluated once; a column used inside a lambda would be evaluated again
    for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: F.Column) -> F.Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles(text: F.Column, size: int = SHINGLE) -> F.Column:
    """Hash of every ``size``-word shingle, in order."""

    def hashes(w):
        n = F.size(w)
        each = F.transform(F.sequence(F.lit(1), n - (size - 1)), lambda i: F.xxhash64(*[F.element_at(w, i + k) for k in range(size)]))
        return F.when(n >= size, each).otherwise(F.array().cast("array<bigint>"))

    return let(words(text), hashes)


def _majority(h: F.Column, width: int) -> F.Column:
    """A bit is set if it is set in over half of the hashes, tallied in counters of ``width`` bits, several a long."""
    rows = width  # a long holds 64 / width counters, so this many longs hold all 64
    lanes, full = F.lit(sum(1 << i for i in range(0, 64, width))), F.lit((1 << width) - 1)
    shift = lambda x, by: F.call_function("shiftrightunsigned", x, by)
    sums = F.aggregate(
        h,
        F.array_repeat(F.lit(0).cast("bigint"), rows),
        lambda acc, x: F.transform(acc, lambda a, i: a + shift(x, i).bitwiseAND(lanes)),
    )

    def bits(counts):
        ones = lambda b: shift(F.element_at(counts, b % rows + 1), b - b % rows).bitwiseAND(full)
        bit = lambda b: F.when(ones(b) * 2 > F.size(h), F.call_function("shiftleft", F.lit(1).cast("bigint"), b)).otherwise(F.lit(0).cast("bigint"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("bigint"), lambda acc, b: acc.bitwiseOR(bit(b)))

    return let(sums, bits)


def fingerprint(h: F.Column) -> F.Column:
    """SimHash: a bit is set if it is set in over half of the hashes. Four counters a long, or two for lists that are too long
    for 16 bits."""
    return F.when(F.size(h) < 1 << 16, _majority(h, 16)).otherwise(_majority(h, 32))


def blocks(fp: F.Column, radius: int) -> F.Column:
    """``radius + 1`` (number, bits) blocks of the fingerprint."""
    edges = [64 * k // (radius + 1) for k in range(radius + 2)]
    return F.array(*[
        F.struct(F.lit(k).alias("block"), F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1)).alias("bits"))
        for k, (a, b) in enumerate(zip(edges, edges[1:]))
    ])


def weighted_similarity(a: F.Column, b: F.Column) -> F.Column:
    """Weighted Jaccard of two shingle lists. Lists without repeats, the rule, are compared as sets."""
    times = lambda h, x: F.size(F.filter(h, lambda y: y == x))
    plain = (F.size(F.array_distinct(a)) == F.size(a)) & (F.size(F.array_distinct(b)) == F.size(b))
    weighted = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda s, x: s + F.least(times(a, x), times(b, x)))
    both = F.when(plain, F.size(F.array_intersect(a, b))).otherwise(weighted)
    return F.try_divide(both.cast("double"), (F.size(a) + F.size(b) - both).cast("double"))


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", radius: int = RADIUS, similarity: float = SIMILARITY) -> DataFrame:
    """``id_col, text_key, item, start, similarity``: each window (first word ``start``) that matches."""
    with scratch(docs.sparkSession) as keep:
        return keep(materialize(_leaks(docs, benchmark, id_col, text_col, item_col, radius, similarity), "leaks"))


def _leaks(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, radius: int, similarity: float) -> DataFrame:
    items = benchmark.select(F.col(item_col).alias("item"), shingles(F.col(text_col)).alias("item_h")).where(F.size("item_h") > 0)
    items = materialize(items.withColumns({"length": F.size("item_h"), "item_fp": fingerprint(F.col("item_h"))}), "items")
    known = materialize(items.select("length", F.explode("item_h").alias("h")).distinct(), "items")

    text_key = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    hashed = docs.select(id_col, text_key.alias("text_key"), shingles(F.col(text_col)).alias("doc_h"))
    # places that hold a shingle of any item: found without a shuffle of the documents where the benchmark is small
    found = hashed.select(id_col, "text_key", F.posexplode("doc_h").alias("pos", "h")).join(known, "h")
    found = found.groupBy(id_col, "text_key", "length").agg(F.array_sort(F.collect_set("pos")).alias("at"))
    most = F.ceil(F.col("length") * similarity - 1e-9).cast("int")
    reach = F.transform(F.sequence(F.lit(0), F.size("at") - most), lambda i: F.struct((F.get("at", i + most - 1) - F.col("length") + 1).alias("first"), F.get("at", i).alias("last")))
    reach = F.transform(F.filter(reach, lambda x: x["first"] <= x["last"]), lambda x: F.sequence(x["first"], x["last"]))
    starts = found.where(F.size("at") >= most).select(id_col, "text_key", "length", F.array_distinct(F.flatten(reach)).alias("starts"))
    starts = materialize(starts.where(F.size("starts") > 0), "windows")

    # the shingles of each window; only documents that have one are read again, and only those are shuffled
    wanted = starts.groupBy(F.col(id_col).alias("__id"), F.col("text_key").alias("__key")).agg(
        F.flatten(F.collect_list(F.transform("starts", lambda x: F.struct("length", x.alias("start"))))).alias("windows")
    )
    wanted = materialize(wanted, "windows")
    texts = docs.select(id_col, text_col, text_key.alias("text_key"))
    texts = texts.join(small_side(wanted.select("__id", "__key")), F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("text_key") == F.col("__key")), "left_semi")
    texts = texts.dropDuplicates([id_col, "text_key"]).join(wanted, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("text_key") == F.col("__key")))

    def window(w, doc_h):
        first, until = F.greatest(w["start"], F.lit(0)), F.least(w["start"] + w["length"], F.size(doc_h))
        return F.struct(w["length"].alias("length"), w["start"].alias("start"), F.slice(doc_h, first + 1, until - first).alias("window_h"))

    windows = texts.select(id_col, "text_key", F.inline(let(shingles(F.col(text_col)), lambda h: F.transform("windows", lambda w: window(w, h)))))
    windows = materialize(windows.withColumn("fp", fingerprint(F.col("window_h"))), "windows")

    left = windows.select(id_col, "text_key", "length", "start", "window_h", "fp", F.inline(blocks(F.col("fp"), radius)))
    right = items.select("item", F.col("length").alias("length_"), "item_h", "item_fp", F.inline(blocks(F.col("item_fp"), radius)).alias("block_", "bits_"))
    near = (F.col("length") == F.col("length_")) & (F.col("block") == F.col("block_")) & (F.col("bits") == F.col("bits_")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius)
    near = left.join(right, near)
    # a pair meets in several blocks: keep its first
    same = blocks(F.col("fp").bitwiseXOR(F.col("item_fp")), radius)
    near = near.where(F.col("block") == F.array_position(F.transform(same, lambda x: x["bits"]), F.lit(0).cast("bigint")) - 1)
    near = near.withColumn("similarity", weighted_similarity(F.col("item_h"), F.col("window_h")))
    return near.where(F.col("similarity") >= similarity).select(id_col, "text_key", "item", "start", "similarity")


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``id_col, contaminated, n_items, items, best_similarity`` for every row of ``docs``."""
    found = leaks(docs, benchmark, id_col, text_col, **options).groupBy(id_col, "text_key").agg(
        F.array_sort(F.collect_set("item")).alias("items"), F.max("similarity").alias("best_similarity")
    )
    found = found.withColumnRenamed(id_col, "__id").withColumnRenamed("text_key", "__key")
    rows = docs.select(id_col, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("key"))
    joined = rows.join(found, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("key") == F.col("__key")), "left")
    return joined.select(
        id_col, F.col("items").isNotNull().alias("contaminated"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"), "items", "best_similarity"
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Rows of ``docs``, all columns, without those that hold a benchmark item."""
    found = leaks(docs, benchmark, id_col, text_col, **options).select(F.col(id_col).alias("__id"), F.col("text_key").alias("__key")).distinct()
    cond = F.col(id_col).eqNullSafe(F.col("__id")) & (F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))) == F.col("__key"))
    return docs.join(found, cond, "left_anti")
