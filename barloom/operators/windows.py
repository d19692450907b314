"""Window and interval operators: rolling lists, forward returns, greedy non-overlapping choice."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.sources.shared import finished, written


def rolling_list(df: DataFrame, column: str, n: int = 10, out: str = "values") -> DataFrame:
    """The last ``n`` values in order, null while there are fewer."""
    w = Window.partitionBy("symbol").orderBy("ts").rowsBetween(1 - n, 0)
    return df.withColumn(out, F.when(F.count("*").over(w) == n, F.collect_list(column).over(w)))


def forward_returns(df: DataFrame, horizons: tuple[int, ...] = (5, 10, 20, 30)) -> DataFrame:
    """Percent change of the close ``h`` bars ahead, null at the end of a series."""
    w = Window.partitionBy("symbol").orderBy("ts")
    return df.withColumns({f"return_{h}": (F.try_divide(F.lead("close", h).over(w), F.col("close")) - 1) * 100 for h in horizons})


def greedy_windows(df: DataFrame, rank: str, start: str, end: str, most: int = 200, group: str = "symbol") -> DataFrame:
    """Windows in ascending order of ``rank`` (ties: earlier start), skipping those that overlap one already
    taken (bounds inclusive), at most ``most`` per group. The order of choice is inherently sequential; a
    fold over the ranked windows of a group keeps it in the engine, so callers bound their number (``similarity.matches``)."""
    items = F.array_sort(F.collect_list(F.struct(F.col(rank).alias("rank"), F.col(start).alias("s"), F.col(end).alias("e"))))
    kind = dict(df.dtypes)
    empty = F.array().cast(f"array<struct<rank:{kind[rank]},s:{kind[start]},e:{kind[end]}>>")

    def step(taken, x):
        clash = F.exists(taken, lambda t: (x["s"] <= t["e"]) & (x["e"] >= t["s"]))
        return F.when(clash | (F.size(taken) >= most), taken).otherwise(F.array_append(taken, x))

    kept = df.groupBy(group).agg(items.alias("items")).select(group, F.posexplode(F.aggregate("items", empty, step)).alias("position", "w"))
    return kept.select(group, (F.col("position") + 1).alias("position"), F.col("w.rank").alias(rank), F.col("w.s").alias(start), F.col("w.e").alias(end))


def first_windows(df: DataFrame, start: str, end: str, group: str = "symbol") -> DataFrame:
    """Windows in the order of their starts (ties: earlier end), skipping those that overlap the last one taken (bounds
    inclusive), with their ``position``.

    A window's successor is the first one that starts after its end; a merge of starts and ends finds it. The windows taken are
    those that successors reach from the first one: the successors 1, 2, 4, ... steps on, each level joined from the one before,
    reach all in as many rounds as the logarithm of their number, and no list of a group is held anywhere."""
    spark, names = df.sparkSession, [c for c in df.columns if c not in (group, start, end)]

    def choose():
        order = Window.partitionBy(group).orderBy(start, end)
        rows = written(df.withColumn("__place", F.row_number().over(order)), "windows")
        # at equal values, ends come before starts, which are too early for them
        ends = rows.select(F.col(group).alias("g"), F.col(end).alias("at"), F.lit(0).alias("is_start"), F.col("__place").alias("place"))
        starts = rows.select(F.col(group).alias("g"), F.col(start).alias("at"), F.lit(1).alias("is_start"), F.col("__place").alias("place"))
        back = Window.partitionBy("g").orderBy(F.desc("at"), "is_start").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        level = ends.unionByName(starts).withColumn("to", F.min(F.when(F.col("is_start") == 1, F.col("place"))).over(back)).where("is_start = 0 AND to IS NOT NULL").select("g", "place", "to")
        level, taken, steps = written(level, "successors"), rows.where("__place = 1").select(F.col(group).alias("g"), F.lit(1).alias("place"), F.lit(1).alias("position")), 1
        while not level.isEmpty():
            further = taken.join(level, ["g", "place"]).select("g", F.col("to").alias("place"), (F.col("position") + steps).alias("position"))
            taken = written(taken.unionByName(further), "taken")
            onward = level.select("g", F.col("place").alias("to"), F.col("to").alias("next"))
            level, steps = written(level.join(onward, ["g", "to"]).select("g", "place", F.col("next").alias("to")), "successors"), 2 * steps
        found = rows.join(taken.select(F.col("g").alias(group), F.col("place").alias("__place"), "position"), [group, "__place"])
        return found.select(group, "position", start, end, *names)

    return finished(spark, choose, "windows")


def latest(df: DataFrame) -> DataFrame:
    """The last row of each symbol."""
    names = [c for c in df.columns if c != "symbol"]
    return df.groupBy("symbol").agg(F.max_by(F.struct(*names), "ts").alias("last")).select("symbol", *[F.col(f"last.{c}").alias(c) for c in names])
