"""Embedding near-duplicates by cross-polytope hashing after fast Hadamard rotations.

Each of ``tables`` hash tables rotates the unit vectors by three rounds of random signs and a fast
Walsh-Hadamard transform, ``hashes`` times; a hash is the axis of the largest coordinate with its sign. A
vector is stored under its ``probes`` most likely buckets per table (multiprobe: the runner-up axes of each
rotation, ordered by how far they fall short). Pairs that share a bucket are verified by their cosine in
double precision, so no reported link is below the threshold; links are missed only if a pair shares none
of the buckets.

Vectors that are equal within a label form one class with a weight and are never expanded into pairs. A
bucket of more than ``block`` classes is dealt into blocks, and each pair of blocks is a task of its own. A
pair that meets in several tables or blocks counts where it meets first. Tasks return, per class, the
number of its links and the smallest id of its part, never pairs, so output stays linear in the rows.

Cases: vectors that are null, empty, zero or hold null or non-finite components, and rows with a null label,
link with nothing and are their own component; vectors of another length than the most common one of their
label's class are compared only with those of their length; equal rows link with each other; a null id is
kept, counted by its partners and is never a component id unless all ids of the component are null; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import connected_components, materialize, regroup

THRESHOLD, TABLES, HASHES, PROBES, BLOCK = 0.93, 8, 3, 4, 1024
_CHUNK = 1 << 20


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row; the row length is a power of two."""
    n, d, h = len(x), x.shape[1], 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2)
        h *= 2
        x = x.reshape(n, d)
    return x / np.sqrt(d)


def buckets(unit: np.ndarray, tables: int = TABLES, hashes: int = HASHES, probes: int = PROBES, seed: int = 7) -> np.ndarray:
    """(rows, tables, probes) bucket codes, the vector's own bucket first."""
    n, dim = unit.shape
    d = 1 << max(1, int(np.ceil(np.log2(max(2, dim)))))
    x = np.zeros((n, d))
    x[:, :dim] = unit
    rng = np.random.default_rng(seed)
    near = min(d, max(2, probes))
    out = np.empty((n, tables, probes), np.int64)
    for t in range(tables):
        axes, loss = np.zeros((n, 1), np.int64), np.zeros((n, 1))
        for _ in range(hashes):
            y = x
            for _ in range(3):
                y = hadamard(y * rng.choice([-1.0, 1.0], d))
            size = np.abs(y)
            top = np.argpartition(-size, near - 1, axis=1)[:, :near]
            val = np.take_along_axis(size, top, 1)
            sign = np.take_along_axis(y, top, 1) < 0
            short = (val.max(1, keepdims=True) - val) ** 2
            axes = ((axes * (2 * d))[:, :, None] + (2 * top + sign)[:, None, :]).reshape(n, -1)
            loss = (loss[:, :, None] + short[:, None, :]).reshape(n, -1)
            keep = np.argsort(loss, axis=1, kind="stable")[:, :probes]
            axes, loss = np.take_along_axis(axes, keep, 1), np.take_along_axis(loss, keep, 1)
        if axes.shape[1] < probes:
            axes = np.concatenate([axes, np.repeat(axes[:, :1], probes - axes.shape[1], 1)], 1)
        out[:, t] = axes
    return out


def _first_meeting(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows of codes (pairs, tables, probes): the first table and the smallest code shared there."""
    table = np.full(len(a), -1)
    code = np.full(len(a), -1, np.int64)
    for t in range(a.shape[1]):
        open_ = np.flatnonzero(table < 0)
        if not len(open_):
            break
        x, y = a[open_, t], b[open_, t]
        same = (x[:, :, None] == y[:, None, :]).any(2)
        best = np.where(same, x, np.iinfo(np.int64).max).min(1)
        hit = best < np.iinfo(np.int64).max
        table[open_[hit]], code[open_[hit]] = t, best[hit]
    return table, code


def link_block(node: np.ndarray, weight: np.ndarray, unit: np.ndarray, codes: np.ndarray, side: np.ndarray, table: int, code: int, threshold: float):
    """Links inside one bucket (or between its two blocks, ``side`` 0 and 1; 2 for one block with itself).

    Returns per row the weight of its links that meet first here, and the smallest node among itself and
    its direct links."""
    n = len(node)
    links, least = np.zeros(n, np.int64), node.copy()
    left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    for s in range(0, len(left), max(1, _CHUNK // max(1, len(right)))):
        rows = left[s : s + max(1, _CHUNK // max(1, len(right)))]
        i, j = np.nonzero(unit[rows] @ unit[right].T >= threshold - 1e-9)
        i, j = rows[i], right[j]
        own = (side[i] == 2) & (node[i] >= node[j])
        i, j = i[~own], j[~own]
        for q in range(0, len(i), 1 << 15):
            a, b = i[q : q + (1 << 15)], j[q : q + (1 << 15)]
            exact = np.einsum("ij,ij->i", unit[a], unit[b]) >= threshold
            a, b = a[exact], b[exact]
            t, c = _first_meeting(codes[a], codes[b])
            here = (t == table) & (c == code)
            a, b = a[here], b[here]
            np.add.at(links, a, weight[b])
            np.add.at(links, b, weight[a])
            np.minimum.at(least, a, node[b])
            np.minimum.at(least, b, node[a])
    return links, least


def near_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", threshold: float = THRESHOLD, tables: int = TABLES, hashes: int = HASHES, probes: int = PROBES, block: int = BLOCK
) -> DataFrame:
    """``id_col, n_links, component_id`` for every row."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    good = F.col(label_col).isNotNull() & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    good = good & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))
    rows = vectors.select(id_col, F.col(label_col).alias("label"), v.alias("v"), good.alias("good"))
    classes = rows.where("good").groupBy("label", "v").agg(F.min(id_col).alias("least_id"), F.count("*").alias("weight"))
    classes = classes.withColumn("length", F.size("v")).withColumn("node", F.monotonically_increasing_id())
    classes = materialize(classes, "vectors")
    label_type = vectors.schema[label_col].dataType.simpleString()

    def posted(batches):
        for b in batches:
            lengths = np.array(b.column(3))
            for d in np.unique(lengths):
                part = b.filter(pa.array(lengths == d))
                x = np.array(part.column(1).flatten()).reshape(-1, d).astype(float)
                x = x / np.abs(x).max(1, keepdims=True)
                x = x / np.sqrt((x * x).sum(1, keepdims=True))
                got = buckets(x, tables, hashes, probes)
                n = len(x)
                for s in range(0, n, 2048):
                    e, g = min(n, s + 2048), got[s : s + 2048]
                    at, t, k = np.nonzero(np.ones(g.shape, bool))
                    first = np.ones(g.shape, bool)  # the same bucket twice in one table counts once
                    for q in range(1, probes):
                        first[:, :, q] = (g[:, :, q : q + 1] != g[:, :, :q]).all(2)
                    use = first[at, t, k]
                    at, t, k = at[use], t[use], k[use]
                    take = pa.array(at + s)
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(take), pa.array(t.astype(np.int32)), pa.array(g[at, t, k]), part.column(3).take(take), part.column(2).take(take)],
                        names=["label", "t", "code", "length", "node"],
                    )

    index = classes.select("label", "v", "node", "length").mapInArrow(posted, f"label {label_type}, t int, code long, length int, node long")
    index = materialize(index, "buckets")
    key = ["label", "length", "t", "code"]
    sizes = index.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").withColumn("blocks", F.expr(f"cast((n + {block - 1}) div {block} as int)"))
    dealt = index.join(sizes, key).withColumn("own", F.expr("cast(pmod(xxhash64(node), blocks) as int)"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select(
        *key, "node", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"),
        F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).cast("int").alias("side"),
    )
    task = F.xxhash64(*key, "low", "high")
    dealt = dealt.join(classes.select("node", "weight", "v"), "node").select(task.alias("task"), "t", "code", "node", "weight", "side", "v")
    parts = dealt.repartition("task").sortWithinPartitions("task", "t", "code")

    def linked(batches):
        for b in regroup(batches):
            ids, t, c = (np.array(b.column(i)) for i in (0, 1, 2))
            node, weight, side = (np.array(b.column(i)) for i in (3, 4, 5))
            lists = b.column(6)
            lens = np.diff(np.array(lists.offsets))
            cuts = np.flatnonzero(np.diff(ids, prepend=ids[0] - 1 if len(ids) else 0)).tolist() + [len(ids)]
            flat_, offs = np.array(lists.values), np.array(lists.offsets)
            spans = []
            units = []
            for s, e in zip(cuts, cuts[1:]):
                if e - s < 2:
                    continue
                x = flat_[offs[s] : offs[e]].reshape(e - s, lens[s])
                x = x / np.abs(x).max(1, keepdims=True)
                x = x / np.sqrt((x * x).sum(1, keepdims=True))
                if e - s > 64 or (np.triu(x @ x.T, 1) >= threshold - 1e-9).any():
                    spans.append((s, e))
                    units.append(x)
            outs = []
            for d in {x.shape[1] for x in units}:
                mine = [i for i, x in enumerate(units) if x.shape[1] == d]
                codes, at = buckets(np.concatenate([units[i] for i in mine]), tables, hashes, probes), 0
                for i in mine:
                    s, e = spans[i]
                    links, least = link_block(node[s:e], weight[s:e], units[i], codes[at : at + e - s], side[s:e], int(t[s]), int(c[s]), threshold)
                    at += e - s
                    use = (links > 0) | (least < node[s:e])
                    outs.append((node[s:e][use], links[use], least[use]))
            if outs:
                n, k, m = map(np.concatenate, zip(*outs))
                yield pa.RecordBatch.from_arrays([pa.array(n), pa.array(k), pa.array(m)], names=["node", "links", "least"])

    found = materialize(parts.mapInArrow(linked, "node long, links long, least long"), "links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = connected_components(found.select(F.col("node").alias("u"), F.col("least").alias("v")))
    classes = classes.join(links, "node", "left").join(roots, "node", "left")
    classes = classes.select("label", "v", "least_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("root", "node").alias("root"))
    smallest = classes.groupBy("root").agg(F.min("least_id").alias("component_id"))
    classes = materialize(classes.join(smallest, "root").select("label", "v", "n_links", "component_id"), "vectors")
    joined = rows.where("good").join(classes, ["label", "v"]).select(id_col, "n_links", "component_id")
    return joined.unionByName(rows.where("not good").select(id_col, F.lit(0).cast("long").alias("n_links"), F.col(id_col).alias("component_id")))
