"""Suffix-array dedup of long byte strings, ordered by deep-shallow sorting.

Every byte covered by a ``length``-byte string that also starts anywhere else is removed. A distributed
suffix array over all suffixes would move each byte hundreds of times, so suffixes are bucketed first: each
``length``-byte window belongs to the suffix that starts at its minimizer, the smallest hash among its
``gram``-byte strings (the rightmost one among ties). Equal windows have equal minimizers at equal offsets,
so they meet in one bucket; suffixes whose gram is unique need no sorting at all.

Inside a bucket the suffixes, and the reversed prefixes before them, are put in order by deep-shallow
sorting: multikey quicksort on eight-byte keys to a shallow depth, then a blind trie for each group that
still shares its prefix. Neighbours' common prefix lengths then tell for each offset which windows agree.
All comparisons are of the bytes themselves. A bucket of more than ``most`` suffixes is not sorted in one
task: its windows are instead counted by 128-bit digests with partial aggregation, and no digest's rows meet in
one task either if they are more than ``most``.

Cases: null and empty texts, and texts shorter than ``length``, lose nothing; equal texts form one class and
are removed wholly if long enough; rows with one id twice are rows of their own; a null id is kept; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.common import materialize, pieces, regroup, scratch, small_side

LENGTH, GRAM, SHALLOW, MOST = 400, 64, 32, 50_000
_RNG = np.random.default_rng(400)
_BYTE = _RNG.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_MUL = _RNG.integers(0, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)
_LOW = (1 << 24) - 1
_PIECE = 1 << 23


def _gram_hashes(x: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the ``gram`` bytes from each position; gram is a power of two."""
    h, t, k = _BYTE[x], 1, 0
    while t < gram:
        h = h[:-t] * _MUL[k] + h[t:]
        t, k = 2 * t, k + 1
    h ^= h >> np.uint64(32)
    h *= _MUL[k]
    return h ^ (h >> np.uint64(29))


def minimizers(text: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash and position of each minimizer with the first and last start of the windows that have it."""
    out = []
    for lo in range(0, max(1, len(text) - length + 1), _PIECE):
        part = text[lo : lo + _PIECE + length - 1]
        if len(part) < length:
            break
        h = _gram_hashes(np.frombuffer(part, np.uint8), gram)
        v = (h & ~np.uint64(_LOW)) | (np.uint64(_LOW) - np.arange(len(h), dtype=np.uint64))
        width, w = length - gram + 1, 1
        while 2 * w <= width:
            v = np.minimum(v[:-w], v[w:])
            w *= 2
        if width > w:
            v = np.minimum(v[: len(v) - (width - w)], v[width - w :])
        at = _LOW - (v & np.uint64(_LOW)).astype(np.int64)
        cut = np.flatnonzero(np.diff(at)) + 1
        first = np.concatenate([[0], cut])
        last = np.concatenate([cut - 1, [len(at) - 1]])
        out.append((h[at[first]].view(np.int64), at[first] + lo, first + lo, last + lo))
    if not out:
        return tuple(np.empty(0, np.int64) for _ in range(4))
    return tuple(map(np.concatenate, zip(*out)))


def common(a: bytes, b: bytes, start: int = 0) -> int:
    """Length of the longest common prefix, which is known to reach ``start``."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = start, n  # a[:lo] == b[:lo], a[:hi] != b[:hi]
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def blind_trie(strings: list[bytes], group: list[int]) -> list[int]:
    """Indices in the order of their strings. Inner nodes hold the depth they branch at and a child for each
    byte there (-1: the string ends); strings are compared once, with the leaf that a blind descent finds."""
    byte = lambda s, d: s[d] if d < len(s) else -1
    root = [group[0]]
    for i in group[1:]:
        s, node = strings[i], root
        while isinstance(node, tuple):
            node = node[1].get(byte(s, node[0])) or next(iter(node[1].values()))
        same = common(s, strings[node[0]])
        if same == len(s) == len(strings[node[0]]):
            node.append(i)
            continue
        other, parent, node = byte(strings[node[0]], same), None, root
        while isinstance(node, tuple) and node[0] < same:
            parent, node = node, node[1][byte(s, node[0])]
        if isinstance(node, tuple) and node[0] == same:
            node[1][byte(s, same)] = [i]
            continue
        fork = (same, {other: node, byte(s, same): [i]})
        if parent is None:
            root = fork
        else:
            parent[1][byte(s, parent[0])] = fork
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if isinstance(node, tuple):
            stack += [node[1][b] for b in sorted(node[1], reverse=True)]
        else:
            out += node
    return out


def deep_shallow(strings: list[bytes], shared: int = 0, shallow: int = SHALLOW) -> list[int]:
    """Indices in the order of ``strings``, which share their first ``shared`` bytes."""
    out, stack = [], [(list(range(len(strings))), shared)]
    while stack:
        group, depth = stack.pop()
        if len(group) < 2:
            out += group
            continue
        if depth - shared >= shallow:
            out += blind_trie(strings, group)
            continue
        keys = [strings[i][depth : depth + 8] for i in group]
        pivot = sorted((keys[0], keys[len(keys) // 2], keys[-1]))[1]
        equal = [i for i, k in zip(group, keys) if k == pivot]
        stack.append(([i for i, k in zip(group, keys) if k > pivot], depth))
        if len(pivot) < 8:  # these strings end here and are equal
            stack += [([i], depth) for i in reversed(equal)]
        else:
            stack.append((equal, depth + 8))
        stack.append(([i for i, k in zip(group, keys) if k < pivot], depth))
    return out


def _classes(strings: list[bytes], shared: int) -> tuple[np.ndarray, np.ndarray]:
    order = deep_shallow(strings, shared)
    lcp = [common(strings[i], strings[j], 0) for i, j in zip(order, order[1:])]
    return np.array(order), np.array(lcp, np.int64)


def repeated_offsets(left: list[bytes], right: list[bytes], low: np.ndarray, high: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """For one bucket: yields (member, first offset, last offset) for the runs of offsets j whose window,
    the last j bytes of ``left`` and the first length - j of ``right``, equals that of another member.
    ``left`` is reversed; member i has windows at the offsets low[i]..high[i]."""
    n = len(left)
    if n == 2:
        k, r = common(left[0], left[1]), common(right[0], right[1], 0)
        a, z = max(low[0], low[1], length - r), min(high[0], high[1], k)
        if a <= z:
            yield 0, a, z
            yield 1, a, z
        return
    order_r, lcp_r = _classes(right, min(gram, min(map(len, right))))
    order_l, lcp_l = _classes(left, 0)
    offsets = np.arange(low.min(), high.max() + 1)
    size = max(1, (1 << 20) // n)
    found = []
    for s in range(0, len(offsets), size):
        j = offsets[s : s + size]
        key = np.zeros((len(j), n), np.int64)
        grade = np.zeros((len(j), n), np.int64)
        grade[:, 1:] = np.cumsum(lcp_r[None, :] < (length - j)[:, None], 1)
        key[:, order_r] = grade * n
        grade[:, 1:] = np.cumsum(lcp_l[None, :] < j[:, None], 1)
        np.add.at(key, (slice(None), order_l), grade)
        idle = (j[:, None] < low) | (j[:, None] > high)
        key[idle] = -1 - np.broadcast_to(np.arange(n), key.shape)[idle]
        by = np.argsort(key, 1, kind="stable")
        srt = np.take_along_axis(key, by, 1)
        same = srt[:, 1:] == srt[:, :-1]
        twin = np.zeros(key.shape, bool)
        twin[:, 1:] |= same
        twin[:, :-1] |= same
        hit = np.zeros(key.shape, bool)
        np.put_along_axis(hit, by, twin, 1)
        found.append(hit)
    hit = np.concatenate(found)
    edge = np.diff(np.vstack([np.zeros((1, n), np.int8), hit.astype(np.int8), np.zeros((1, n), np.int8)]), axis=0)
    for i in np.flatnonzero(hit.any(0)):
        for a, z in zip(np.flatnonzero(edge[:, i] == 1), np.flatnonzero(edge[:, i] == -1)):
            yield int(i), int(offsets[a]), int(offsets[z - 1])


def bucket_intervals(members: list[tuple], length: int = LENGTH, gram: int = GRAM):
    """Members are (position, low, high, reversed left, right); yields (member, start, end) of repeats."""
    same: dict = {}
    for i, (_, lo, hi, left, right) in enumerate(members):
        same.setdefault((lo, hi, left, right), []).append(i)
    for (lo, hi, _, _), who in same.items():
        if len(who) > 1:
            for i in who:
                yield i, members[i][0] - hi, members[i][0] - lo + length
    if len(same) < 2:
        return
    keys = list(same)
    low, high = np.array([k[0] for k in keys]), np.array([k[1] for k in keys])
    for i, a, z in repeated_offsets([k[2] for k in keys], [k[3] for k in keys], low, high, length, gram):
        for w in same[keys[i]]:
            yield w, members[w][0] - z, members[w][0] - a + length


def merged(cover) -> list[tuple[int, int]]:
    """Maximal runs of half-open intervals."""
    out: list = []
    for s, e in sorted(cover):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


def cut(text: bytes, cover) -> tuple[bytes, int, int]:
    """What is left of the text, the bytes removed and the number of maximal removed runs."""
    runs = merged(cover)
    kept, at = [], 0
    for s, e in runs:
        kept.append(text[at:s])
        at = e
    kept.append(text[at:])
    out = b"".join(kept)
    return out, len(text) - len(out), len(runs)


def shared_windows(windows: DataFrame, most: int = MOST) -> DataFrame:
    """Rows of ``windows`` (``k1, k2, s, d1, d2``) whose digest occurs more than once. A digest of more than ``most``
    rows, as periodic text makes, is looked up where its rows lie: a shuffle would send them all to one task."""
    counts = windows.groupBy("d1", "d2").agg(F.count("*").alias("c")).where("c > 1")
    counts = materialize(counts, "windows")
    often = small_side(counts.where(F.col("c") > most).select("d1", "d2"))
    rest = windows.join(often, ["d1", "d2"], "left_anti").join(counts.where(F.col("c") <= most).select("d1", "d2"), ["d1", "d2"])
    return windows.join(often, ["d1", "d2"]).unionByName(rest)


def repeats(keyed: DataFrame, length: int = LENGTH, gram: int = GRAM, most: int = MOST) -> DataFrame:
    """``k1, k2, cover`` for the distinct texts (columns ``k1, k2, text``) that hold repeated strings."""
    starts = materialize(keyed.mapInArrow(_anchors(length, gram), "k1 long, k2 long, a int, h long"), "anchors")
    mark = F.xxhash64("k1", "k2", "a")
    twice = starts.groupBy("h").agg(F.min(mark).alias("lo"), F.max(mark).alias("hi")).where("lo <> hi").select("h")
    twice = materialize(twice, "anchors")  # a table of its own, so that the join can split a frequent anchor
    again = starts.join(twice, "h").groupBy("k1", "k2").agg(F.collect_set(F.struct("a", "h")).alias("anchors"))
    again = materialize(again, "anchors")
    sizes = again.select(F.inline("anchors")).groupBy("h").count()
    hot = materialize(sizes.where(F.col("count") > most).select("h"), "anchors")
    texts = keyed.groupBy("k1", "k2").agg(F.first("text").alias("text")).join(again, ["k1", "k2"])
    cool = texts
    extra = None
    if not hot.isEmpty():
        split = again.select("k1", "k2", F.inline("anchors")).join(hot.withColumn("hot", F.lit(True)), "h", "left")
        split = split.groupBy("k1", "k2").agg(
            F.collect_list(F.when(F.col("hot").isNull(), F.struct("a", "h"))).alias("anchors"), F.collect_list(F.when(F.col("hot"), F.struct("a", "h"))).alias("hot")
        )
        split = materialize(split, "anchors")
        bare = keyed.groupBy("k1", "k2").agg(F.first("text").alias("text"))
        cool = bare.join(split.where(F.size("anchors") > 0).drop("hot"), ["k1", "k2"])
        windows = bare.join(split.where(F.size("hot") > 0).select("k1", "k2", F.col("hot").alias("anchors")), ["k1", "k2"])
        windows = materialize(windows.select("k1", "k2", "text", "anchors").mapInArrow(_windows(length, gram), "k1 long, k2 long, s int, d1 long, d2 long"), "windows")
        extra = shared_windows(windows, most).select("k1", "k2", "s", (F.col("s") + length).alias("e"))
    around = cool.select("k1", "k2", "text", "anchors").mapInArrow(_contexts(length, gram), "h long, k1 long, k2 long, a int, low int, high int, before binary, after binary")
    found = around.repartition("h").sortWithinPartitions("h").mapInArrow(_sorted_buckets(length, gram), "k1 long, k2 long, s int, e int")
    if extra is not None:
        found = found.unionByName(extra)
    return found.groupBy("k1", "k2").agg(F.collect_list(F.struct("s", "e")).alias("cover"))


def _anchors(length, gram):
    def run(batches):
        for b in pieces(batches, 2):
            rows, at, h = [], [], []
            for i, t in enumerate(b.column(2).cast(pa.binary()).to_pylist()):
                if t and len(t) >= length:
                    x, a, _, _ = minimizers(t, length, gram)
                    rows.append(np.full(len(a), i))
                    at.append(a.astype(np.int32))
                    h.append(x)
            if rows:
                take = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(np.concatenate(at)), pa.array(np.concatenate(h))], names=["k1", "k2", "a", "h"])

    return run


def _wanted(b, length, gram):
    """(row, text, minimizers that are wanted) of a batch with columns k1, k2, text, anchors."""
    texts, wanted = b.column(2).cast(pa.binary()).to_pylist(), b.column(3)
    offs, flat = np.array(wanted.offsets), np.array(wanted.values.field("a"))
    for i, t in enumerate(texts):
        x, a, s, e = minimizers(t or b"", length, gram)
        yield i, t, zip(*(y[np.isin(a, flat[offs[i] - offs[0] : offs[i + 1] - offs[0]] if len(flat) == offs[-1] - offs[0] else flat[offs[i] : offs[i + 1]])].tolist() for y in (x, a, s, e)))


def _contexts(length, gram, rows_most=20_000):
    names = ["h", "k1", "k2", "a", "low", "high", "before", "after"]

    def run(batches):
        for b in pieces(batches, 2):
            rows, out = [], []

            def packed():
                take = pa.array(rows)
                h, a, low, high, left, right = zip(*out)
                ints = lambda x: pa.array(x, pa.int32())
                return pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), b.column(0).take(take), b.column(1).take(take), ints(a), ints(low), ints(high), pa.array(left, pa.binary()), pa.array(right, pa.binary())], names=names)

            for i, t, found in _wanted(b, length, gram):
                for h, a, s, e in found:
                    out.append((h, a, a - e, a - s, t[s:a][::-1], t[a : e + length]))
                    rows.append(i)
                if len(rows) > rows_most:
                    yield packed()
                    rows, out = [], []
            if rows:
                yield packed()

    return run


def _windows(length, gram):
    def run(batches):
        for b in pieces(batches, 2):
            for i, t, found in _wanted(b, length, gram):
                starts = [x for _, _, s, e in found for x in range(s, e + 1)]
                for q in range(0, len(starts), 1 << 16):
                    part = starts[q : q + (1 << 16)]
                    d = np.frombuffer(b"".join(xxhash.xxh3_128_digest(t[x : x + length]) for x in part), np.int64).reshape(-1, 2)
                    take = pa.array(np.full(len(part), i))
                    yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(part, pa.int32()), pa.array(d[:, 0]), pa.array(d[:, 1])], names=["k1", "k2", "s", "d1", "d2"])

    return run


def _sorted_buckets(length, gram):
    def run(batches):
        for b in regroup(batches):
            h = np.array(b.column(0))
            a, low, high = (b.column(i).to_pylist() for i in (3, 4, 5))
            before, after = b.column(6).to_pylist(), b.column(7).to_pylist()
            cuts = [0, *(np.flatnonzero(np.diff(h)) + 1).tolist(), len(h)]
            rows, s, e = [], [], []
            for lo, hi in zip(cuts, cuts[1:]):
                if hi - lo < 2:
                    continue
                for i, x, y in bucket_intervals([(a[q], low[q], high[q], before[q], after[q]) for q in range(lo, hi)], length, gram):
                    rows.append(lo + i)
                    s.append(x)
                    e.append(y)
            if rows:
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays([b.column(1).take(take), b.column(2).take(take), pa.array(s, pa.int32()), pa.array(e, pa.int32())], names=["k1", "k2", "s", "e"])

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, most: int = MOST, texts: bool = True) -> DataFrame:
    """``id_col, n_bytes, n_removed, n_spans, kept_sha256`` and, with ``texts``, the bytes that are left, as
    ``kept`` (binary: a removed run may end inside a character)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(id_col, F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2"), text.alias("text"))
    copies = keyed.where(F.octet_length("text") >= length).groupBy("k1", "k2").agg(F.count("*").alias("c"), F.max(F.octet_length("text")).alias("n")).where("c > 1")
    whole = copies.select("k1", "k2", F.array(F.struct(F.lit(0).alias("s"), F.col("n").cast("int").alias("e"))).alias("cover"))
    with scratch(docs.sparkSession) as keep:
        cover = repeats(keyed.where(F.octet_length("text") >= length).select("k1", "k2", "text"), length, gram, most)
        cover = cover.unionByName(whole).groupBy("k1", "k2").agg(F.flatten(F.collect_list("cover")).alias("cover"))
        cover = keep(materialize(cover, "cover"))
    joined = keyed.join(cover, ["k1", "k2"], "left").select(id_col, "text", "cover")
    longs = [T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")]
    schema = T.StructType([joined.schema[id_col], *longs, T.StructField("kept_sha256", T.StringType()), *([T.StructField("kept", T.BinaryType())] if texts else [])])

    def run(batches):
        for b in pieces(batches, 1):
            out = []
            for t, c in zip(b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist()):
                kept, gone, runs = cut(t, [(x["s"], x["e"]) for x in c]) if c else (t, 0, 0)
                out.append((len(t), gone, runs, hashlib.sha256(kept).hexdigest(), kept))
            n, g, r, sha, kept = zip(*out) if out else [()] * 5
            cols = [b.column(0), *(pa.array(x, pa.int64()) for x in (n, g, r)), pa.array(sha, pa.string())]
            yield pa.RecordBatch.from_arrays(cols + ([pa.array(kept, pa.binary())] if texts else []), names=schema.names)

    return joined.mapInArrow(run, schema)
