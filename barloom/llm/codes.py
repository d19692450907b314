"""Vector code compression: product codes from integer k-means, searched by kd-trees.

Components become integers ``floor(4096 * x)`` and each vector is cut into eight consecutive parts with a codebook of
16 entries each. In every round the driver builds one kd-tree per codebook and broadcasts the trees, a few kilobytes. Tasks
search the nearest entry of every part by branch and bound, for a batch of parts at once: a branch is left out only if
its bound is greater than the best distance so far, so that of entries at equal distance the lower index wins. Tasks
return integer sums and counts per entry, which Spark adds up; the driver gets one row per component of a codebook. All
arithmetic is of integers, so results do not depend on how rows are dealt.

Vectors of different lengths have codebooks of their own; a length that eight does not divide is cut as evenly as floors
allow. At most ``MOST_LENGTHS`` lengths may occur, which bounds what is broadcast.

Cases: rows whose vector is null or holds null or non-finite components are dropped; an empty vector is kept, with code zero
and error 0; repeated rows are coded one by one; if an id that starts an entry has several vectors, the smallest counts; null ids
come last among the starts and are one id; entries that start equal stay behind the lower index, unused; with fewer than
16 ids there are as many entries; an empty table gives an empty result; extra columns are ignored. Components beyond
2**14 in size could exceed 64-bit distances and raise an error.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import materialize, small_side

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
MOST_LENGTHS = 1000
LARGEST = 1 << 14
_LEAF = 2


class KdTree:
    """Nearest entries of one codebook, ``(n, d)`` integers; ties go to the lower index."""

    def __init__(self, entries: np.ndarray):
        self.entries = np.asarray(entries, np.int64)
        self.root = self._build(np.arange(len(self.entries)))

    def _build(self, index: np.ndarray):
        """A leaf is the entries' indexes; a branch is the axis, the largest coordinate on its left, the smallest on its
        right, and both sides."""
        own = self.entries[index]
        if len(index) <= _LEAF or not own.shape[1]:
            return index
        axis = int(np.argmax(own.max(0) - own.min(0)))
        index = index[np.argsort(own[:, axis], kind="stable")]
        half = len(index) // 2
        left, right = index[:half], index[half:]
        return axis, int(self.entries[left[-1], axis]), int(self.entries[right[0], axis]), self._build(left), self._build(right)

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry and the squared distance, for each row of ``points``."""
        best = np.full(len(points), np.iinfo(np.int64).max)
        which = np.full(len(points), len(self.entries))

        def visit(node, rows):
            if not len(rows):
                return
            if isinstance(node, np.ndarray):
                for j in node:
                    gap = points[rows] - self.entries[j]
                    d = np.einsum("ij,ij->i", gap, gap)
                    closer = (d < best[rows]) | (d == best[rows]) & (j < which[rows])
                    best[rows[closer]], which[rows[closer]] = d[closer], j
                return
            axis, upto, since, left, right = node
            at = points[rows, axis]
            to_left, to_right = np.maximum(at - upto, 0), np.maximum(since - at, 0)
            first = to_left <= to_right
            visit(left, rows[first])
            visit(right, rows[~first])
            # the other side only where its bound does not exceed the best: equal bounds may hold a lower index
            visit(right, rows[first & (to_right**2 <= best[rows])])
            visit(left, rows[~first & (to_left**2 <= best[rows])])

        visit(self.root, np.arange(len(points)))
        return which, best


def cuts(d: int, parts: int = PARTS) -> list[int]:
    """Where the parts of a vector of length ``d`` begin and end."""
    return [k * d // parts for k in range(parts + 1)]


def _grid(batch) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """``(length, rows, integers)`` for the vectors of each length in a batch of ``ints`` lists."""
    lists = batch.column("ints")
    sizes = np.diff(np.asarray(lists.offsets))
    flat, starts = np.asarray(lists.values), np.asarray(lists.offsets)[:-1]
    return [(int(d), rows := np.flatnonzero(sizes == d), flat[starts[rows, None] + np.arange(d)]) for d in np.unique(sizes)]


def _integers(rows: DataFrame, vec_col: str, keep: list) -> DataFrame:
    """Kept rows with ``ints`` and ``d``, the length."""
    x = F.col(vec_col)
    sound = x.isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    ints = F.transform(x, lambda v: F.floor(v.cast("double") * SCALE).cast("long"))
    large = F.exists(x, lambda v: F.abs(v) > LARGEST)
    return rows.where(sound).select(*keep, F.when(large, F.raise_error(F.lit(f"a component exceeds {LARGEST}"))).otherwise(ints).alias("ints"), F.size(x).alias("d"))


def _starts(rows: DataFrame, entries: int) -> dict[int, np.ndarray]:
    """The first codebooks' vectors by length; the ranking of ids is cut to ``entries`` in each task before the shuffle."""
    order = Window.partitionBy("d").orderBy(F.asc_nulls_last("id"))
    ids = rows.select("d", "id").distinct().withColumn("place", F.row_number().over(order)).where(F.col("place") <= entries)
    first = rows.alias("r").join(F.broadcast(ids.alias("i")), (F.col("r.d") == F.col("i.d")) & F.col("r.id").eqNullSafe(F.col("i.id")))
    found = first.groupBy("r.d", "place").agg(F.min("ints").alias("ints")).collect()
    books: dict[int, list] = {}
    for r in sorted(found, key=lambda r: r.place):
        books.setdefault(r.d, []).append(r.ints)
    return {d: np.array(book, np.int64).reshape(len(book), d) for d, book in books.items()}


def _sums(rows: DataFrame, trees, parts: int) -> DataFrame:
    """``d, entry, at, total, n``: sums of the components and counts of each entry's parts."""

    def run(batches):
        sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            for d, _, x in _grid(b):
                own, edge = trees.value[d], cuts(d, parts)
                total, n = sums.setdefault(d, (np.zeros((len(own[0].entries), d), np.int64), np.zeros((len(own[0].entries), parts), np.int64)))
                for p, tree in enumerate(own):
                    part = x[:, edge[p] : edge[p + 1]]
                    which = tree.nearest(part)[0]
                    np.add.at(total[:, edge[p] : edge[p + 1]], which, part)
                    n[:, p] += np.bincount(which, minlength=len(n))
        for d, (total, n) in sums.items():
            where = np.repeat(np.arange(parts), np.diff(cuts(d, parts)))
            entry, at = np.nonzero(n[:, where])
            columns = [np.full(len(entry), d, np.int32), entry.astype(np.int32), at.astype(np.int32), total[entry, at], n[entry, where[at]]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["d", "entry", "at", "total", "n"])

    partial = rows.select("ints").mapInArrow(run, "d int, entry int, at int, total long, n long")
    return partial.groupBy("d", "entry", "at").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def _trees(books: dict[int, np.ndarray], parts: int) -> dict[int, list[KdTree]]:
    return {d: [KdTree(book[:, a:b]) for a, b in zip(edge, edge[1:])] for d, book in books.items() for edge in [cuts(d, parts)]}


def digest(book: np.ndarray, parts: int = PARTS) -> str:
    """SHA-256 of all components, by part, entry and position within the part, joined by commas."""
    edge = cuts(book.shape[1], parts)
    return hashlib.sha256(",".join(str(v) for a, b in zip(edge, edge[1:]) for v in book[:, a:b].ravel().tolist()).encode()).hexdigest()


def fit(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> dict[int, np.ndarray]:
    """The codebooks by length of ``rows`` (``id, ints, d``): an array of entries by components."""
    books, context = _starts(rows, entries), rows.sparkSession.sparkContext
    for _ in range(rounds if books else 0):
        trees = context.broadcast(_trees(books, parts))
        for r in _sums(rows, trees, parts).collect():  # a row for each component of an entry
            books[r.d][r.entry, r["at"]] = r.total // r.n
        trees.unpersist()
    return books


def compress(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``id, code, error, label_error, codebooks_sha256`` for each kept row; errors are summed over equal labels, nulls
    together. The integers are written once to the shared folder and read in each round."""
    spark = vectors.sparkSession
    rows = materialize(_integers(vectors, vec_col, [F.col(id_col).alias("id"), F.col(label_col).alias("label")]), "ints")
    lengths = rows.select("d").distinct().limit(MOST_LENGTHS + 1).count()
    if lengths > MOST_LENGTHS:
        raise ValueError(f"vectors of more than {MOST_LENGTHS} lengths")
    books = fit(rows)
    shas = {d: digest(book) for d, book in books.items()}
    trees = spark.sparkContext.broadcast(_trees(books, PARTS))
    kinds = dict(rows.dtypes)

    def run(batches):
        for b in batches:
            code, error, sha = np.zeros((len(b), PARTS), np.uint8), np.zeros(len(b), np.int64), np.zeros(len(b), object)
            for d, at, x in _grid(b):
                edge, sha[at] = cuts(d), shas[d]
                for p, tree in enumerate(trees.value[d]):
                    code[at, p], gap = tree.nearest(x[:, edge[p] : edge[p + 1]])
                    error[at] += gap
            hexed = code.tobytes().hex()
            codes = [hexed[i : i + 2 * PARTS] for i in range(0, len(hexed), 2 * PARTS)]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), pa.array(codes, pa.string()), pa.array(error), pa.array(sha, pa.string())], names=["id", "label", "code", "error", "sha"])

    coded = materialize(rows.select("id", "label", "ints").mapInArrow(run, f"id {kinds['id']}, label {kinds['label']}, code string, error long, sha string"), "codes")
    totals = small_side(coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")))
    out = coded.join(totals, F.col("label").eqNullSafe(F.col("of")))
    return out.select(F.col("id").alias(id_col), "code", "error", "label_error", F.col("sha").alias("codebooks_sha256"))


def oracle_sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """DuckDB SQL over ``embeddings`` of one length that ``parts`` divides: every distance is computed."""
    near = f"""SELECT vec_id, part, arg_min(e, struct_pack(d := d, e := e)) AS e, min(d) AS d FROM (SELECT x.vec_id, x.part, b.e,
 CAST(list_sum(list_transform(range(1, len(x.v) + 1), lambda k: (x.v[k] - b.v[k]) * (x.v[k] - b.v[k]))) AS BIGINT) AS d FROM x JOIN b{{k}} b ON b.part = x.part) GROUP BY vec_id, part"""
    ctes = [
        f"""z AS (SELECT vec_id, label, list_transform(embedding, lambda c: CAST(floor({SCALE} * CAST(c AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0)""",
        f"x AS MATERIALIZED (SELECT vec_id, p AS part, v[p * len(v) // {parts} + 1 : (p + 1) * len(v) // {parts}] AS v FROM z, (SELECT unnest(range({parts})) AS p))",
        f"s AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM z QUALIFY e < {entries})",
        "b0 AS MATERIALIZED (SELECT x.part, s.e, x.v FROM x JOIN s ON s.vec_id = x.vec_id)",
    ]
    for k in range(1, rounds + 1):
        ctes.append(f"a{k} AS MATERIALIZED ({near.format(k=k - 1)})")
        ctes.append(
            f"n{k} AS (SELECT part, e, list(m ORDER BY i) AS v FROM (SELECT a.part, a.e, i, CAST(floor(sum(x.v[i]) / count(*)) AS BIGINT) AS m FROM a{k} a JOIN x ON x.vec_id = a.vec_id AND x.part = a.part, unnest(range(1, len(x.v) + 1)) u(i) GROUP BY a.part, a.e, i) GROUP BY part, e)"
        )
        ctes.append(f"b{k} AS MATERIALIZED (SELECT b.part, b.e, coalesce(n.v, b.v) AS v FROM b{k - 1} b LEFT JOIN n{k} n ON n.part = b.part AND n.e = b.e)")
    ctes.append(f"f AS MATERIALIZED ({near.format(k=rounds)})")
    ctes.append(f"h AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, e)) AS sha FROM b{rounds})")
    ctes.append("c AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM f GROUP BY vec_id)")
    return "WITH " + ",\n".join(ctes) + "\nSELECT c.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY z.label) AS BIGINT) AS label_error, (SELECT sha FROM h) AS codebooks_sha256 FROM c JOIN z ON z.vec_id = c.vec_id"
