"""SimHash near-duplicates through a byte-position inverted index with count filtering.

A 64-bit fingerprint is eight positional bytes. Two fingerprints within ``radius`` bits differ in at most
``radius`` bytes, so they are guaranteed to share ``8 - radius`` positional bytes. The index is keyed by tuples
of one positional byte less than that, as many as it takes for every pair that reaches the minimum to meet in
a posting list; the shared positional bytes of a pair are then tallied, pairs below the guaranteed minimum are
dropped and the rest verified by their Hamming distance.

``drop_near_duplicates`` groups documents by the similarity of their word shingles. Fingerprints of such texts
may differ in any number of bits, so no minimum is guaranteed there: the index joins the groups as far as it
reaches, every link verified on the shingles, and a search by prefixes of the shingle sets, which has a
guarantee, completes them.

Cases: a null or empty text has fingerprint zero and links like any other; rows with one doc_id twice are
rows of their own and share the class of each other's fingerprint only if the fingerprints link; a null
doc_id is kept and never becomes a component id unless all of its component are null; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.common import connected_components, hash_sample, materialize, pieces, scratch, small_side

SEED = 42
#: Bits of every byte value, lowest first.
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.float64)
#: Odd multipliers that derive further 64-bit lanes from one shingle hash.
_LANES = np.array([1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)


def shingle_hashes(text: bytes | None, size: int) -> np.ndarray:
    """XXH64 of every ``size``-word shingle of the ASCII-lower-cased text, repeats included; fewer words
    give one shingle of them all, none gives none."""
    words = (text or b"").lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    whole, digest = b" ".join(words), xxhash.xxh64_intdigest
    if n <= size:
        return np.array([digest(whole, SEED)], np.uint64)
    lens = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(lens + 1) - 1
    starts = (ends - lens)[: n - size + 1].tolist()
    return np.array([digest(whole[s:e], SEED) for s, e in zip(starts, ends[size - 1 :].tolist())], np.uint64)


def fingerprint(hashes: np.ndarray, lanes: int = 1) -> np.ndarray:
    """``lanes`` signed 64-bit words; a bit is set if it is set in over half of the hashes."""
    if not len(hashes):
        return np.zeros(lanes, np.int64)
    if lanes > 1:
        hashes = hashes[:, None] * _LANES[:lanes]
        hashes ^= hashes >> np.uint64(29)
    width = 8 * lanes
    counts = np.zeros(width * 256, np.int64)
    offsets = (np.arange(width) * 256).astype(np.int32)
    octets = np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, width)
    for i in range(0, len(octets), 1 << 16):
        counts += np.bincount((octets[i : i + (1 << 16)] + offsets).ravel(), minlength=width * 256)
    ones = counts.reshape(width, 256).astype(np.float64) @ _BITS
    return np.packbits((ones * 2 > len(hashes)).astype(np.uint8), axis=1, bitorder="little").reshape(-1).view(np.int64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``id_col`` and ``fp`` (signed 64-bit) of every row, from the whole text."""
    source = docs.select(id_col, text_col)
    schema = T.StructType([source.schema[id_col], T.StructField("fp", T.LongType())])

    def run(batches):
        for b in pieces(batches, 1):
            texts = b.column(1).cast(pa.binary()).to_pylist()
            fps = np.array([fingerprint(shingle_hashes(t, shingle))[0] for t in texts], np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], names=schema.names)

    return source.mapInArrow(run, schema)


def _postings(shared: int) -> list[int]:
    """Masks of the positional-byte tuples of the index. Each takes one byte less than ``shared`` (two at least)
    and every choice of ``shared`` bytes holds one of them; chosen greedily, those that most choices hold first."""
    open_ = [set(c) for c in itertools.combinations(range(8), shared)]
    tuples = [set(c) for c in itertools.combinations(range(8), min(shared, max(2, shared - 1)))]
    masks = []
    while open_:
        best = max(tuples, key=lambda t: sum(t <= c for c in open_))
        open_ = [c for c in open_ if not best <= c]
        masks.append(sum(0xFF << (8 * p) for p in best))
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def posted(fps: DataFrame, shared: int) -> DataFrame:
    """``fps`` with one row for each posting list: its number ``list`` and the ``octets`` that it is keyed by."""
    lists = [F.struct(F.lit(k).alias("list"), F.col("fp").bitwiseAND(F.lit(m)).alias("octets")) for k, m in enumerate(_postings(shared))]
    return fps.select("*", F.inline(F.array(*lists)))


def shared_bytes(a: F.Column, b: F.Column) -> F.Column:
    """Tally of equal positional bytes."""
    x = a.bitwiseXOR(b)
    return sum((F.shiftrightunsigned(x, 8 * p).bitwiseAND(F.lit(255)) == 0).cast("int") for p in range(8))


def linked_fingerprints(fps: DataFrame, radius: int = 2) -> DataFrame:
    """Pairs ``u < v`` of distinct fingerprints of column ``fp`` that differ in 1..``radius`` bits.

    Copies of a fingerprint are one, so a fingerprint has at most 2080 partners for radius 2, however many
    documents carry it."""
    index = posted(fps.select("fp").distinct(), 8 - radius)
    a, b = index.alias("a"), index.alias("b")
    u, v = F.col("a.fp"), F.col("b.fp")
    near = (shared_bytes(u, v) >= 8 - radius) & (F.bit_count(u.bitwiseXOR(v)) <= radius)
    return (
        a.join(b, (F.col("a.list") == F.col("b.list")) & (F.col("a.octets") == F.col("b.octets")) & (u < v) & near)
        .select(u.alias("u"), v.alias("v"))
        .distinct()
    )


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """``id_col, fp, component_id`` for every row; component_id is the smallest id reachable by links.

    Rows with equal fingerprints form one class before anything is paired, so copies are never expanded."""
    rows = materialize(fingerprints(docs, id_col, text_col, shingle), "simhash")
    classes = rows.groupBy("fp").agg(F.min(id_col).alias("least"))
    roots = connected_components(linked_fingerprints(classes, radius))
    rooted = classes.join(roots, classes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = materialize(rooted.join(least, "root").select("fp", "component_id"), "simhash")
    return rows.join(classes, "fp").select(id_col, "fp", "component_id")


# Near-duplicates by shingle similarity


#: Lanes of the parity map of a shingle set, 64 bits each.
_MAP = 16
#: Sets of more shingles than this have a second parity map, of one bit a shingle at least: between such sets the first
#: one is filled with chance differences and tells little.
WIDE = 800
SAMPLE_TEXTS, LEAST_HOT, MOST_HOT = 20_000, 4, 300_000
#: Positional bytes that a pair shares at least in the index over shingle sets.
SHARED = 4
#: Hubs that a node is compared with in a round; those that it does not reach are left to the last step.
HUBS = 3


def _texts(column: pa.Array) -> list:
    return column.cast(pa.binary()).to_pylist()


def _hot_shingles(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that recur in a sample of the texts, ascending, and their ranks by frequency. They only decide the
    order of the shingles, so neither the sample nor the bound on their number changes a result."""
    source = hash_sample(docs, SAMPLE_TEXTS, docs.count(), id_col, text_col).select(text_col)

    def run(batches):
        for b in pieces(batches, 0):
            sets = [np.unique(shingle_hashes(t, shingle)) for t in _texts(b.column(0))]
            h, c = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.empty(0, np.uint64), np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.astype(np.int64))], names=["h", "n"])

    counts = materialize(source.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("c")).where(F.col("c") >= LEAST_HOT), "near")
    cut, size = None, 0
    for c, n in sorted(((r[0], r[1]) for r in counts.groupBy("c").count().collect()), reverse=True):
        if size + n > MOST_HOT:
            break
        cut, size = c, size + n
    rows = counts.where(F.col("c") >= cut).collect() if cut else []
    h = np.array([r[0] for r in rows], np.int64).view(np.uint64)
    c = np.array([r[1] for r in rows], np.int64)
    rank = np.empty(len(h), np.int64)
    rank[np.lexsort((h, c))] = np.arange(len(h))
    order = np.argsort(h)
    return h[order], rank[order]


def prefix(found: np.ndarray, hot: np.ndarray, rank: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles of the set ``found`` (ascending) in the common order: those that are not hot by their
    hash, then hot ones from rare to frequent. Two sets of the similarity share one of them."""
    n = len(found)
    if len(hot):
        at = np.minimum(np.searchsorted(hot, found), len(hot) - 1)
        found = found[np.argsort(np.where(hot[at] == found, rank[at], -1), kind="stable")]
    return found[: n - int(np.ceil(similarity * n - 1e-6)) + 1 if n else 0]


def parity(found: np.ndarray) -> np.ndarray:
    """Parity of the number of shingles that fall on each of ``64 * _MAP`` bits: the maps of two sets differ in at
    most as many bits as the sets differ in shingles."""
    bits = np.bincount((found % np.uint64(64 * _MAP)).astype(np.int64), minlength=64 * _MAP) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def wide_parity(found: np.ndarray) -> bytes | None:
    """The second parity map, whose bits are the least power of two that is ``len(found)`` or more; none for few shingles."""
    if len(found) <= WIDE:
        return None
    bits = 1 << (len(found) - 1).bit_length()
    odd = np.bincount((found & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def wide_apart(a: bytes, b: bytes) -> int:
    """Bits in which two maps differ. The longer one is folded: the map of half the bits is the exclusive or of its halves."""
    if len(a) < len(b):
        a, b = b, a
    while len(a) > len(b):
        half = len(a) // 2
        a = (int.from_bytes(a[:half]) ^ int.from_bytes(a[half:])).to_bytes(half)
    return (int.from_bytes(a) ^ int.from_bytes(b)).bit_count()


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, t1, t2, text``: rows with an id, and the key of their text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"), text.alias("text"))


def _sets(docs: DataFrame, hot: np.ndarray, rank: np.ndarray, id_col: str, text_col: str, shingle: int, similarity: float) -> DataFrame:
    """One row for each document, under a number ``node`` of its own: ``id, t1, t2``, key ``s1, s2``, size ``n``, fingerprint ``fp``, prefix
    ``keys`` and parity maps ``m0..`` and ``wide`` of its shingle set. Texts without words are keyed by the text itself."""
    source = _keyed(docs, id_col, text_col)
    longs = ["t1", "t2", "node", "s1", "s2", "n", "fp", *[f"m{i}" for i in range(_MAP)]]
    schema = T.StructType([source.schema["id"], *[T.StructField(c, T.LongType()) for c in longs], T.StructField("wide", T.BinaryType()), T.StructField("keys", T.ArrayType(T.LongType()))])

    def run(batches):
        node = TaskContext.get().partitionId() << 33
        for b in pieces(batches, 3):
            texts = _texts(b.column(3))
            found = [np.unique(shingle_hashes(t, shingle)) for t in texts]
            digest = [xxhash.xxh3_128_digest(f.tobytes() if len(f) else t, len(f) > 0) for f, t in zip(found, texts)]
            s = np.frombuffer(b"".join(digest), np.int64).reshape(-1, 2)
            fps = np.array([fingerprint(f)[0] for f in found], np.int64)
            maps = np.array([parity(f) for f in found], np.int64).reshape(-1, _MAP)
            sizes = np.array([len(f) for f in found], np.int64)
            keys = [prefix(f, hot, rank, similarity).view(np.int64) for f in found]
            edges = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
            keys = pa.ListArray.from_arrays(pa.array(edges), pa.array(np.concatenate(keys) if keys else np.empty(0, np.int64)))
            columns = [np.arange(node, node + len(texts)), s[:, 0], s[:, 1], sizes, fps, *maps.T]
            node += len(texts)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *(pa.array(np.ascontiguousarray(c)) for c in columns), pa.array(map(wide_parity, found), pa.binary()), keys], names=schema.names)

    return source.mapInArrow(run, schema)


def _can_reach(similarity: float, n: F.Column, pos: F.Column, other_n: F.Column, other_pos: F.Column) -> F.Column:
    """Whether two sets whose first common shingle stands at these places can have the similarity."""
    return F.least(n - pos, other_n - other_pos) >= (n + other_n) * (similarity / (1 + similarity)) - 1e-6


class _Verifier:
    """Pairs of nodes that have the similarity, decided on their whole shingle sets."""

    def __init__(self, docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float):
        self.docs, self.nodes, self.shingle, self.similarity = _keyed(docs, id_col, text_col), nodes, shingle, similarity

    def __call__(self, met: DataFrame) -> DataFrame:
        """``u, v``: the pairs of ``met``, a few numbers a row, that have the similarity. Pairs whose parity maps
        differ in more bits than such sets can differ in shingles go before their texts are read. Only the result stays."""
        with scratch(met.sparkSession) as keep:
            return keep(self._verified(met))

    def _may_reach(self, met: DataFrame) -> DataFrame:
        """``u, v, u_n, v_n``: the pairs that their sizes and parity maps do not rule out."""
        slack = (1 - self.similarity) / (1 + self.similarity)
        a, b = (self.nodes.select(F.col("node").alias(n), F.col("n").alias(f"{n}_n"), *[F.col(f"m{i}").alias(f"{n}{i}") for i in range(_MAP)]) for n in "uv")
        apart = sum(F.bit_count(F.col(f"u{i}").bitwiseXOR(F.col(f"v{i}"))) for i in range(_MAP))
        sizes = F.least("u_n", "v_n") >= F.greatest("u_n", "v_n") * self.similarity - 1e-6
        met = met.join(a, "u").join(b, "v").where(sizes & (apart <= (F.col("u_n") + F.col("v_n")) * slack + 1e-6))
        pairs = materialize(met.select("u", "v", "u_n", "v_n"), "near")
        both_wide = F.least("u_n", "v_n") > WIDE
        wide = self.nodes.where(F.col("n") > WIDE)
        maps = pairs.where(both_wide).join(wide.select(F.col("node").alias("u"), F.col("wide").alias("u_map")), "u")
        maps = maps.join(wide.select(F.col("node").alias("v"), F.col("wide").alias("v_map")), "v").select("u", "v", "u_n", "v_n", "u_map", "v_map")

        def near(batches):
            for x in pieces(batches, 4):
                most = (np.array(x.column(2)) + np.array(x.column(3))) * slack + 1e-6
                apart = np.array([wide_apart(p, q) for p, q in zip(x.column(4).to_pylist(), x.column(5).to_pylist())])
                yield x.select(["u", "v", "u_n", "v_n"]).filter(pa.array(apart <= most))

        return materialize(pairs.where(~both_wide).unionByName(maps.mapInArrow(near, pairs.schema)), "near")

    def _verified(self, met: DataFrame) -> DataFrame:
        share, shingle = self.similarity, self.shingle
        pairs = self._may_reach(met)
        ends = pairs.select(F.col("u").alias("node")).union(pairs.select(F.col("v").alias("node"))).distinct()
        ends = materialize(self.nodes.select("node", "id", "t1", "t2").join(small_side(ends), "node"), "near")
        wanted = self.docs.join(small_side(ends), ["id", "t1", "t2"]).select("node", "text")

        def sets(batches):
            for x in pieces(batches, 1):
                found = [np.unique(shingle_hashes(t, shingle)).view(np.int64) for t in _texts(x.column(1))]
                edges = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([x.column(0), pa.ListArray.from_arrays(pa.array(edges), pa.array(np.concatenate(found)))], names=["node", "h"])

        held = materialize(wanted.mapInArrow(sets, "node long, h array<long>").dropDuplicates(["node"]), "near")
        both = pairs.join(held.select(F.col("node").alias("u"), F.col("h").alias("hu")), "u").join(held.select(F.col("node").alias("v"), F.col("h").alias("hv")), "v")
        both = both.withColumn("both", F.size(F.array_intersect("hu", "hv")))
        return materialize(both.where(F.col("both") >= share * (F.col("u_n") + F.col("v_n") - F.col("both")) - 1e-9).select("u", "v"), "near")


def _by_fingerprint(nodes: DataFrame, shared: int) -> DataFrame:
    """``u, v``: for each node one partner, that which shares most positional bytes of its fingerprint (``shared`` at
    least) among the first members of its posting lists. One pair a node, whatever the size of a list."""
    index = posted(nodes.select("node", "fp"), shared)
    first = index.groupBy("list", "octets").agg(F.min(F.struct("fp", "node")).alias("hub"), F.max("node").alias("last"))
    first = materialize(first.where(F.col("hub.node") != F.col("last")).drop("last"), "near")
    tally = shared_bytes(F.col("fp"), F.col("hub.fp"))
    met = index.join(first, ["list", "octets"]).where(F.col("node") != F.col("hub.node")).withColumn("tally", tally).where(F.col("tally") >= shared)
    best = F.max_by(F.col("hub.node"), F.struct(F.col("tally"), -F.bit_count(F.col("fp").bitwiseXOR(F.col("hub.fp"))), F.col("hub.node")))
    return met.groupBy(F.col("node").alias("v")).agg(best.alias("u")).select("u", "v")


def _rooted(posts: DataFrame, links: DataFrame) -> DataFrame:
    """``posts`` with the ``root`` that verified links give to each node."""
    roots = materialize(connected_components(links), "near")
    return posts.drop("root").join(small_side(roots), "node", "left").withColumn("root", F.coalesce("root", "node"))


def near_duplicate_rows(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, shared: int = SHARED, hub_rounds: int = 1
) -> DataFrame:
    """``id, t1, t2`` (the key of the text): the documents that share ``similarity`` of their ``shingle``-word
    shingles (as sets) with another one of their group, except for the smallest (id, text key) of each group.

    Texts of one shingle set are one node. Nodes are grouped in three steps, each link verified on whole shingle sets:

    1. the byte-position index: each node is compared with the one that shares most positional bytes with it;
    2. ``hub_rounds`` rounds over prefixes: all shingles have one order, frequent ones last; of sets that have the
       similarity, the first ``n - similarity * n + 1`` shingles in that order share one, so every such pair meets
       in a posting. Each posting has a hub, first the member that shares most of its prefix, then any, and each node is compared with the ``HUBS`` that it meets most often;
    3. all members of a posting that links have not joined yet are compared with each other, so no pair is missed.

    Pairs that cannot reach the similarity by their sizes, the places of the shingle or their parity maps are
    dropped, which loses none. The first two steps make at most ``HUBS`` pairs a node and round, so a large group costs
    pairs in proportion to its size, and none needs a posting in one task.

    A null id is in no group; a null text counts as an empty one; texts without words have no shingles and group
    only with equal texts; rows that agree in id and text are one document, which goes or stays as a whole."""
    with scratch(docs.sparkSession) as keep:
        return keep(_near_duplicate_rows(docs, id_col, text_col, shingle, similarity, shared, hub_rounds))


def _prefixes(docs: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Rows of texts whose shingle set another one has (with its chosen node), the recurring prefix shingles of the other
    nodes, their number by node, and those nodes. The table of all prefixes goes."""
    with scratch(docs.sparkSession) as keep:
        hot, rank = _hot_shingles(docs, id_col, text_col, shingle)
        rows = materialize(_sets(docs, hot, rank, id_col, text_col, shingle, similarity), "near")
        document = F.struct("id", "t1", "t2")
        classes = materialize(rows.groupBy("s1", "s2").agg(F.min(F.struct("id", "t1", "t2", "node")).alias("least"), F.count("*").alias("copies")), "near")
        same = classes.where("copies > 1").select("s1", "s2", F.struct("least.id", "least.t1", "least.t2").alias("least"), F.col("least.node").alias("chosen"))
        copies = rows.select("s1", "s2", "node", document.alias("document")).join(same, ["s1", "s2"]).where("node <> chosen").select("node", "document", "least")
        copies = keep(materialize(copies, "near"))

        nodes = rows.where("n > 0").join(small_side(copies.select("node")), "node", "left_anti")
        posts = nodes.select("node", F.col("n").cast("int").alias("n"), F.posexplode("keys").alias("pos", "key"))
        several = posts.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
        several = materialize(several, "near")  # a table of its own, so that the join can split a frequent key
        posts = keep(materialize(posts.join(several, "key"), "near"))
        met = keep(materialize(posts.groupBy("node").agg(F.count("*").alias("met")), "near"))
        return copies, posts, met, keep(materialize(nodes.drop("keys", "s1", "s2"), "near"))


def _near_duplicate_rows(docs: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float, shared: int, hub_rounds: int) -> DataFrame:
    document = F.struct("id", "t1", "t2")
    copies, posts, met, nodes = _prefixes(docs, id_col, text_col, shingle, similarity)
    gone = copies.where("document <> least").select("document.*")
    posts = posts.join(small_side(met), "node")

    verified = _Verifier(docs, nodes, id_col, text_col, shingle, similarity)
    links = verified(_by_fingerprint(nodes, shared))
    posts = _rooted(posts, links)
    for turn in range(hub_rounds):
        # an edit puts shingles of its own into a prefix, so the original of a group has most that others share
        hub = F.max(F.struct(F.lit(0) if turn else F.col("met"), F.xxhash64(F.lit(turn), F.col("node")), "node", "n", "pos", "root")).alias("hub")
        stats = posts.groupBy("key").agg(hub, F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").drop("low", "high")
        met = posts.join(materialize(stats, "near"), "key").where((F.col("root") != F.col("hub.root")) & _can_reach(similarity, F.col("n"), F.col("pos"), F.col("hub.n"), F.col("hub.pos")))
        met = met.groupBy(F.col("node").alias("v"), F.col("hub.node").alias("u")).agg(F.count("*").alias("times"))
        most_met = F.slice(F.sort_array(F.collect_list(F.struct("times", "u")), False), 1, HUBS)
        met = met.groupBy("v").agg(most_met.alias("hubs")).select(F.explode("hubs.u").alias("u"), "v")
        links = materialize(links.unionByName(verified(met)), "near")
        posts = _rooted(posts, links)
    stats = posts.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
    posts = materialize(posts.join(materialize(stats, "near"), "key"), "near")
    a, b = posts.alias("a"), posts.alias("b")
    reach = _can_reach(similarity, F.col("a.n"), F.col("a.pos"), F.col("b.n"), F.col("b.pos"))
    met = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.node") < F.col("b.node")) & (F.col("a.root") != F.col("b.root")) & reach)
    links = links.unionByName(verified(met.select(F.col("a.node").alias("u"), F.col("b.node").alias("v")).distinct()))

    members = connected_components(links).join(nodes.select("node", document.alias("document")), "node")
    members = materialize(members, "near")
    least = members.groupBy("root").agg(F.min("document").alias("least"))
    lost = members.join(least, "root").where("document <> least").select("document.*")
    return materialize(gone.unionByName(lost).distinct(), "near")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs``, all columns, with one document of each group: that of the smallest id."""
    gone = near_duplicate_rows(docs, id_col, text_col, **options).toDF("__id", "__t1", "__t2")
    text = F.coalesce(F.col(text_col), F.lit(""))
    same = (F.col(id_col) == F.col("__id")) & (F.xxhash64(text) == F.col("__t1")) & (F.xxhash64(F.lit(1), text) == F.col("__t2"))
    return docs.join(small_side(gone), same, "left_anti")
