"""Affine recurrences as a two-level scan of native windows.

``y[i] = a * y[i-1] + b * x[i]`` is, inside a block of rows, a running sum of ``c[j] / a**k[j]``; only the value at the end of
each block is carried to the next. Carries are sums over the few blocks before in which a power of ``a`` still counts (all
blocks if ``a`` is 1), so windows over rows span a block, and those over a series see one row for each block. Seeds are
linear too: a row that belongs to a seed contributes its share of it, and no window looks for it.

``initial`` resumes a scan: the values of the recurrences at the last row of the block before.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.sources.shared import written

BLOCK = 512
#: What a power of ``a`` must exceed to count: far below the last bit of a double.
_COUNTS = 1e-30


@dataclass(frozen=True)
class Recurrence:
    """The value at ``start`` is ``weight`` times the sum of ``x`` over the ``rows`` rows that end there. With ``hold``, a null of
    ``x`` repeats its last value, and is 0 before the first."""

    x: Column
    a: float
    b: float
    start: int
    rows: int = 1
    weight: float = 1.0
    hold: bool = False

    def __post_init__(self):
        if self.start >= BLOCK:
            raise ValueError("a seed must lie in the first block")

    def share(self, idx: Column) -> Column:
        """The factor of ``x`` in a row."""
        seed = F.lit(self.weight) * F.pow(F.lit(self.a), idx - self.start)
        return F.when(idx <= self.start - self.rows, 0.0).when(idx <= self.start, seed).otherwise(self.b)


def block_of(idx: str = "idx") -> Column:
    return F.expr(f"{idx} div {BLOCK}")


def _carries(ends: DataFrame, series: dict[str, Recurrence], key: str) -> DataFrame:
    """``__key, __b`` and the value of each recurrence before block ``__b``, from those that its rows alone would give."""
    order = Window.partitionBy(key).orderBy("__block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    held = {f"__held_{n}": F.coalesce(F.last(f"__x_{n}", True).over(before), F.lit(0.0)) for n, r in series.items() if r.hold}
    ends = ends.withColumns(held).withColumns({f"__e_{n}": F.col(f"__e_{n}") + F.col(f"__held_{n}") * F.col(f"__t_{n}") for n, r in series.items() if r.hold})
    out = {}
    for n, r in series.items():
        e = f"__e_{n}"
        if r.a == 1:
            out[n] = F.coalesce(F.sum(e).over(before), F.lit(0.0))
            continue
        depth = max(1, math.ceil(math.log(_COUNTS) / (BLOCK * math.log(r.a))))
        out[n] = sum((F.lit(r.a ** (BLOCK * j)) * F.lag(e, j + 1, 0.0).over(order) for j in range(depth)), F.lit(0.0))
    return ends.select(F.col(key).alias("__key"), F.col("__block").alias("__b"), *[c.alias(f"__y_{n}") for n, c in out.items()], *held)


def affine_scan(df: DataFrame, series: dict[str, Recurrence], key: str = "symbol", idx: str = "idx", initial: DataFrame | None = None) -> DataFrame:
    """``df`` with one more column per recurrence, null before its start. ``idx`` numbers the rows of a key
    from 0 without gaps; ``initial`` has ``key``, ``__block`` and, for each name, ``__e_name`` (and ``__x_name``, ``__t_name`` = 0 if it
    holds) at the end of the block before the first row of ``df``."""
    k, columns = F.col(idx) % BLOCK, df.columns
    df = df.withColumn("__block", block_of(idx))
    inside = Window.partitionBy(key, "__block").orderBy(idx)
    held = {n: F.last(r.x, True).over(inside) for n, r in series.items() if r.hold}
    df = df.withColumns({f"__x_{n}": c for n, c in held.items()})
    up = {n: F.pow(F.lit(r.a), -k) for n, r in series.items()}
    given = {}
    for n, r in series.items():
        share = r.share(F.col(idx))
        given[f"__c_{n}"] = F.when(share == 0, 0.0).otherwise(share * (F.coalesce(f"__x_{n}", F.lit(0.0)) if r.hold else r.x)) * up[n]
        if r.hold:
            given[f"__l_{n}"] = F.when(F.col(f"__x_{n}").isNull(), share * up[n]).otherwise(0.0)
    df = df.withColumns(given)
    sums = {f"__e_{n}": F.pow(F.lit(r.a), k) * F.sum(f"__c_{n}").over(inside) for n, r in series.items()}
    sums |= {f"__t_{n}": F.pow(F.lit(r.a), k) * F.sum(f"__l_{n}").over(inside) for n, r in series.items() if r.hold}
    df = df.withColumns(sums).drop(*given)
    at_end = [c for c in df.columns if c.startswith(("__e_", "__t_", "__x_"))]
    last = F.lead(idx).over(inside).isNull()
    df = written(df.withColumn("__last", last), "scan")  # read for its rows and for the ends of its blocks
    ends = df.where("__last").select(key, "__block", *at_end)
    if initial is not None:
        ends = ends.unionByName(initial.select(key, "__block", *at_end))
    carried = _carries(ends, series, key)
    df = df.join(carried, (F.col(key) == F.col("__key")) & (F.col("__block") == F.col("__b")))
    values = {}
    for n, r in series.items():
        y = F.col(f"__e_{n}") + F.col(f"__y_{n}") * F.pow(F.lit(r.a), k + 1)
        values[n] = F.when(F.col(idx) >= r.start, y + F.col(f"__held_{n}") * F.col(f"__t_{n}") if r.hold else y)
    held = {f"{n}__x": F.coalesce(F.col(f"__x_{n}"), F.col(f"__held_{n}")) for n, r in series.items() if r.hold}
    return df.withColumns(values | held).select(*columns, *values, *held)
