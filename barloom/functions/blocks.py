"""Numbers of rows in order, without a task that sees a whole series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def micros(ts: str) -> Column:
    """Microseconds from 1970 to a wall-clock time, the same in every session zone."""
    day = F.unix_date(F.to_date(ts)).cast("bigint") * 86_400_000_000
    clock = F.hour(ts).cast("bigint") * 3_600_000_000 + F.minute(ts).cast("bigint") * 60_000_000
    return day + clock + (F.extract(F.lit("SECOND"), F.col(ts)) * 1_000_000).cast("bigint")


def trailing_extremes(df: DataFrame, days: int, highest: dict[str, str], lowest: dict[str, str], key: str = "symbol", ts: str = "ts", number: bool = False) -> DataFrame:
    """``df`` with the highest and lowest values (``output: column``) of the last ``days`` days up to each row, both ends
    included.

    Time is cut into cells of that length. The range of a row is the beginning of its own cell up to the row and the end of
    the cell before, from the row's place in its cell on: two running extremes, one forwards over the cell's own rows and
    one backwards over those of the cell before, which are sent along. Each row takes part in two cells, whatever the
    number of rows in the range, and windows span a cell. With ``number``, ``__cell`` and ``__rn``, the number of the row in its cell,
    stay."""
    span = days * 86_400_000_000
    cell = F.expr(f"(__at - __off) div {span}L")
    rows = df.withColumn("__at", micros(ts)).withColumn("__off", F.pmod(F.col("__at"), F.lit(span))).withColumn("__cell", cell)
    twice = F.inline(F.array(F.struct(F.col("__cell").alias("__in"), F.lit(True).alias("__own")), F.struct((F.col("__cell") + 1).alias("__in"), F.lit(False).alias("__own"))))
    rows = rows.select("*", twice)
    so_far = Window.partitionBy(key, "__in").orderBy("__off").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    still = Window.partitionBy(key, "__in").orderBy(F.desc("__off")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    both = {"__rn": F.count_if("__own").over(so_far)}
    for names, best, of in ((highest, F.max, F.greatest), (lowest, F.min, F.least)):
        for out, c in names.items():
            both[out] = of(best(F.when(F.col("__own"), F.col(c))).over(so_far), best(F.when(~F.col("__own"), F.col(c))).over(still))
    rows = rows.withColumns(both).where("__own").drop("__at", "__off", "__in", "__own")
    return rows if number else rows.drop("__cell", "__rn")


def shifted(rows: DataFrame, keys: list[str], out: str, nulls: bool = False) -> DataFrame:
    """``rows`` with ``out``, from 0, instead of ``__cell`` and ``__rn``: a prefix sum over the sizes of cells shifts the numbers inside
    them."""
    before = Window.partitionBy(*keys).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*keys, "__cell").agg(F.max("__rn").alias("__n"))
    shifts = counts.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__cell").alias("__c"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__shift"))
    same = F.col("__cell") == F.col("__c")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"__k{i}")) if nulls else F.col(k) == F.col(f"__k{i}")
    numbered = rows.join(shifts, same).withColumn(out, (F.col("__rn") - 1 + F.col("__shift")).cast("bigint"))
    return numbered.drop("__cell", "__rn", "__c", "__shift", *[f"__k{i}" for i in range(len(keys))])


def positions(df: DataFrame, keys: list[str], cell: Column, order: list[str], out: str = "idx", nulls: bool = False) -> DataFrame:
    """``df`` with ``out``, the number of each row in the order of its key, from 0. Keys that may be null need ``nulls``.

    ``cell`` is a value that never falls along the order (a month, a range of ids). Windows over rows span a key and
    a cell, and those over a key see one row for each cell."""
    rows = df.withColumn("__cell", cell)
    inside = Window.partitionBy(*keys, "__cell").orderBy(*order)
    return shifted(rows.withColumn("__rn", F.row_number().over(inside)), keys, out, nulls)
