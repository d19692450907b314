"""Tables in the folder that driver and executors share, for results that a plan reads more than once."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from barloom.sources.files import Folder

_open: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("barloom_tables", default=None)


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a temporary folder, but only if all is one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="barloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table: the lineage is cut, lost executors do not matter, and later joins know its size."""
    spark, place = df.sparkSession, f"{name}-{uuid.uuid4().hex}"
    base = shared_dir(spark)
    df.write.parquet(f"{base}/{place}")
    if (tables := _open.get()) is not None:
        tables.append(place)
    return spark.read.schema(df.schema).parquet(f"{base}/{place}")


@contextlib.contextmanager
def _tables(spark: SparkSession):
    """The list of the tables written inside; those that are left in it at the end go. Each thread owns its own."""
    around, own = _open.get(), []
    _open.set(own)
    try:
        yield own, around
    finally:
        _open.set(around)
        folder = Folder(spark, shared_dir(spark))
        for place in own:
            with contextlib.suppress(Exception):
                folder.delete(place)


def finished(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What ``make`` returns as a table; all others that it has written go."""
    with _tables(spark) as (own, around):
        result = written(make(), name)
        kept = own.pop()
        if around is not None:
            around.append(kept)
        return result


def released(spark: SparkSession, make: Callable):
    """What ``make`` returns, which reads no table any more; all that it has written go."""
    with _tables(spark):
        return make()
