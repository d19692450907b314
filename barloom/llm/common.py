"""Helpers shared by the training-data operators: shared scratch tables and connected components."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: The tables of the innermost open ``scratch`` block and, through it, of those around it. Each thread has its own, so
#: queries that run at once do not own each other's tables.
_open: contextvars.ContextVar[list[tuple[DataFrame, str]] | None] = contextvars.ContextVar("barloom_scratch", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset, a session with
    a local master gets a temporary folder, written to that setting; on a cluster that would be the disk of
    one machine, so it is refused."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="barloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Cuts the lineage and survives lost executors; the table has a size that the optimizer knows, so
    that it alone decides whether a side is small enough to be broadcast. The shuffle files of the write, which
    nothing reads again, go at once and not when the driver happens to collect its garbage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    owner = _open.get()
    if owner is not None:
        owner.append((out, path))
    return out


def _delete(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Tables that ``materialize`` writes inside the block go at its end, but for those handed to the function
    that it yields. Only for blocks whose kept tables are written: a lazy result would miss its inputs."""
    kept: list[DataFrame] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df)
        return df

    around, own = _open.get(), []
    _open.set(own)
    try:
        yield keep
    finally:
        _open.set(around)
        for df, path in own:
            if not any(df is k for k in kept):
                _delete(spark, path)
            elif around is not None:
                around.append((df, path))


def finished(spark: SparkSession, make, name: str) -> DataFrame:
    """What ``make`` returns, written as a table; all other tables that it has written go."""
    with scratch(spark) as keep:
        return keep(materialize(make(), name))


def hash_sample(df: DataFrame, rows: int, total: int, *cols: str) -> DataFrame:
    """About ``rows`` of the ``total`` rows of ``df``, chosen by a hash of ``cols``: unlike an ordered
    limit, no task sends more than its share."""
    if total <= rows:
        return df
    return df.where(F.pmod(F.xxhash64(*cols), F.lit(1 << 40)) < int(rows / total * (1 << 40)))


def small_side(keys: DataFrame, most_rows: int = 200_000) -> DataFrame:
    """A table of keys (a few numbers a row) for a join: broadcast if it has at most ``most_rows`` rows,
    which is counted, and otherwise left to the optimizer, which shuffles it."""
    return F.broadcast(keys) if keys.limit(most_rows + 1).count() <= most_rows else keys


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """Components of an undirected graph by alternating large-star and small-star steps.

    ``edges`` has long columns ``u`` and ``v``. Returns ``node, root``, where root is the smallest node
    of the component, for every node that has an edge to another one. Each round is a few hash
    aggregations and equi-joins and ends in a table in the shared folder; nothing goes to the driver but
    a row count and a checksum. The rounds grow with the logarithm of a component's size; if they do not come
    to rest, that is an error and not a result. Rows with nulls and self-loops are ignored."""
    spark = edges.sparkSession
    first = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    with scratch(spark) as keep:
        e = materialize(first, "cc")
        mark = None
        for _ in range(max_rounds):
            now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
            if tuple(now) == mark or not now[0]:
                break
            mark = tuple(now)
            e = materialize(_stars(e), "cc")
        else:
            raise RuntimeError(f"components are not complete after {max_rounds} rounds")
        keep(e)
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _stars(e: DataFrame) -> DataFrame:
    """One large-star and one small-star step over edges ``u > v``."""
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(low, "u").select(F.inline(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))))
    return small.where("u <> v").distinct()


def regroup(batches):
    """Re-cut sorted batches so that no value of the first column spans two of them."""
    held = None
    for b in batches:
        if not len(b):
            continue
        if held is not None:
            b = pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
        ids = np.array(b.column(0))
        last = int(np.flatnonzero(ids != ids[-1])[-1]) + 1 if (ids != ids[-1]).any() else 0
        if last:
            yield b.slice(0, last)
        held = b.slice(last)
    if held is not None and len(held):
        yield held


def pieces(batches, column: int, rows: int = 1000, size: int = 4 << 20):
    """Parts of the batches, in order, of at most ``rows`` rows and, unless a row alone exceeds it, ``size`` bytes in
    the text column: what a task holds in Python then depends on neither Spark's batch size nor the texts of a batch."""
    for b in batches:
        ends = np.cumsum(np.array(pc.fill_null(pc.binary_length(b.column(column)), 0), np.int64))
        at = 0
        while at < len(b):
            done = ends[at - 1] if at else 0
            n = min(rows, max(1, int(np.searchsorted(ends, done + size, side="right")) - at))
            yield b.slice(at, n)
            at += n
