"""Raw vendor rows to canonical bars, with failures as data instead of exceptions."""

from __future__ import annotations

from datetime import datetime
from functools import reduce
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.calendar import ZONE, is_complete

OHLCV = ("open", "high", "low", "close", "volume")


def split_wide(wide: DataFrame, ts: str = "ts", sep: str = "|") -> DataFrame:
    """Wide vendor columns ``field|symbol`` (or ``symbol|field``) to rows ``symbol, ts, field...``; symbols
    whose values are all null are dropped."""
    columns = [c for c in wide.columns if c != ts]
    long = wide.unpivot([ts], columns, "name", "value")
    parts = F.split("name", rf"\{sep}")
    a, b = F.lower(parts[0]), F.lower(parts[1])
    first = a.isin(*OHLCV)
    long = long.select(F.when(first, parts[1]).otherwise(parts[0]).alias("symbol"), ts, F.when(first, a).otherwise(b).alias("field"), "value")
    rows = long.groupBy("symbol", ts).pivot("field", list(OHLCV)).agg(F.first("value"))
    some = F.max(reduce(lambda x, y: x | y, [F.col(c).isNotNull() for c in OHLCV])).over(Window.partitionBy("symbol"))
    return rows.withColumn("__some", some).where("__some").drop("__some")


def require_columns(df: DataFrame, needed=OHLCV) -> None:
    missing = sorted(set(needed) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def _empty(c: str) -> Column:
    return F.col(c).isNull() | F.isnan(_as_number(c))


def _as_number(c: str) -> Column:
    """The value as a number; what cannot be read is null and, where something was given, an error of the symbol."""
    return F.col(c).try_cast("double")


def drop_empty(df: DataFrame) -> DataFrame:
    """Rows with at least one value."""
    return df.where(~reduce(lambda x, y: x & y, [_empty(c) for c in OHLCV]))


def keep_last(df: DataFrame, keys: tuple[str, ...], sequence: str) -> DataFrame:
    """One row per key, that of the highest sequence."""
    newest = Window.partitionBy(*keys).orderBy(F.desc(sequence))
    return df.withColumn("__rn", F.row_number().over(newest)).where("__rn = 1").drop("__rn")


def keep_first_rows(df: DataFrame, sequence: str) -> DataFrame:
    """Whole-row distinct that keeps the first row of each kind and its sequence. Repeats are dropped ahead of the shuffle, so
    one row repeated in a third of the table is a few rows there."""
    names = [c for c in df.columns if c != sequence]
    return df.groupBy(*names).agg(F.min(sequence).alias(sequence)).select(*df.columns)


#: Columns as vendors name them, the first of which that is there counts (fixed values).
TIMES = ("Datetime", "Date", "index")


def named(df: DataFrame, time: str | None = None) -> DataFrame:
    """Vendor columns under canonical names: the time column (``time``, or the first of ``TIMES``, or the first column) becomes ``ts``, and
    the five values are found whatever their case. Missing ones are an error that lists them in order."""
    lower = {c.lower(): c for c in df.columns}
    missing = sorted(c for c in OHLCV if c not in lower)
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    found = time or lower.get("ts") or next((c for c in TIMES if c in df.columns), df.columns[0])
    rest = [c for c in df.columns if c not in (found, *[lower[v] for v in OHLCV])]
    return df.select(*rest, F.col(found).alias("ts"), *[F.col(lower[v]).alias(v) for v in OHLCV])


def localize(df: DataFrame, ts: str = "ts", zone: str = ZONE) -> DataFrame:
    """``df`` with ``ts`` as wall-clock time of the exchange: a time without zone is meant so and stays, an instant is moved by the
    zone's offset, whatever the session's zone. Zones whose offset ever changes after 1970 are refused, as the same wall-clock time
    could then mean two instants."""
    if df.schema[ts].dataType.simpleString() == "timestamp_ntz":
        return df
    offsets = {ZoneInfo(zone).utcoffset(datetime(1970 + m // 12, m % 12 + 1, 1)) for m in range(12 * 80)}
    if len(offsets) != 1:
        raise ValueError(f"the offset of {zone} changes")
    moved = F.unix_micros(F.col(ts).cast("timestamp")) + F.lit(int(offsets.pop().total_seconds()) * 1_000_000)
    clock = F.pmod(moved, F.lit(86_400_000_000))
    day = F.date_from_unix_date(((moved - clock) / 86_400_000_000).cast("int"))
    second = clock.cast("decimal(18,0)") / 1_000_000
    at = day.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), second.cast("decimal(18,6)"))
    return df.withColumn(ts, at)


def normalize(raw: DataFrame, name: str, now: Column, sequence: str = "seq") -> tuple[DataFrame, DataFrame]:
    """``raw`` holds ``symbol, ts`` (local), OHLCV and a sequence. Returns the valid bars and one
    ``symbol, error`` row per rejected symbol: a symbol fails as a whole."""
    require_columns(raw)
    rows = drop_empty(raw)
    partly = reduce(lambda x, y: x | y, [_empty(c) for c in OHLCV])
    unread = reduce(lambda x, y: x | y, [F.col(c).isNotNull() & _as_number(c).isNull() for c in OHLCV])
    infinite = reduce(lambda x, y: x | y, [F.coalesce(F.abs(_as_number(c)) == float("inf"), F.lit(False)) for c in OHLCV])
    fraction = F.coalesce(_as_number("volume") % 1 != 0, F.lit(False))
    whole = Window.partitionBy("symbol")
    rows = rows.withColumns({"__unread": F.max(unread).over(whole), "__infinite": F.max(infinite).over(whole), "__partly": F.max(partly).over(whole), "__fraction": F.max(fraction & ~_empty("volume")).over(whole), "__done": is_complete(name, F.col("ts"), now)})
    rows = rows.withColumn("__any", F.max("__done").over(whole))
    error = (
        F.when(F.col("__unread"), "a value is not a number").when(F.col("__infinite"), "prices contain non-finite values").when(F.col("__partly"), "candles are partially missing").when(F.col("__fraction"), "volume is not integral").when(~F.col("__any"), "no completed rows")
    )
    rows = rows.withColumn("error", error)
    seen = rows.groupBy("symbol").agg(F.min("error").alias("error"))
    absent = raw.select("symbol").distinct().join(seen, "symbol", "left_anti").withColumn("error", F.lit("no candles"))
    rejected = seen.where("error IS NOT NULL").unionByName(absent)
    good = keep_last(rows.where(F.col("error").isNull() & F.col("__done")), ("symbol", "ts"), sequence)
    return good.select("symbol", "ts", *[_as_number(c).alias(c) for c in OHLCV[:4]], _as_number("volume").cast("bigint").alias("volume")), rejected
