"""Technical indicators over bars ``symbol, ts, open, high, low, close, volume``.

Recurrences start at the first bar of a series. Values before an indicator is defined are null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.blocks import micros, shifted, trailing_extremes
from barloom.functions.scan import BLOCK, Recurrence, affine_scan, block_of
from barloom.sources.shared import written

EMA_LENGTHS = (10, 20, 50, 100, 200)
#: Fixed output columns and their order.
INDICATOR_COLUMNS = (
    "ema_10", "ema_20", "ema_50", "ema_100", "ema_200", "volume_ema_20", "relative_volume_20", "rsi_14", "atr_14", "atr_percent_14",
    "macd_12_26", "macd_signal_9", "macd_histogram", "adx_14", "plus_di_14", "minus_di_14", "band_upper_20_2", "band_middle_20",
    "band_lower_20_2", "band_width_20_2", "roc_20", "obv", "trailing_365d_high", "trailing_365d_low", "distance_from_365d_high_percent",
)
NULLABLE = ("relative_volume_20",)
_DI = ("plus_di_14", "minus_di_14", "adx_14")
_MACD = ("macd_12_26", "macd_signal_9", "macd_histogram")
_BANDS = ("band_upper_20_2", "band_middle_20", "band_lower_20_2", "band_width_20_2")
_TRAILING = ("trailing_365d_high", "trailing_365d_low", "distance_from_365d_high_percent")
#: The output columns that read a recurrence, where they are others than its own.
_READ_BY = {
    "ema_20": ("ema_20", *_BANDS), "volume_ema_20": ("volume_ema_20", "relative_volume_20"), "atr_14": ("atr_14", "atr_percent_14"), "__g": ("rsi_14",), "__l": ("rsi_14",), "__fast": _MACD, "__slow": _MACD, "macd_signal_9": _MACD[1:],
    "__wtr": _DI, "__wpdm": _DI, "__wmdm": _DI,
}
#: What resuming needs at the end of a block; the last is what the average of the directional index has read last.
STATE_COLUMNS = (*[f"ema_{n}" for n in EMA_LENGTHS], "__fast", "__slow", "volume_ema_20", "__g", "__l", "atr_14", "__wtr", "__wpdm", "__wmdm", "obv", "macd_signal_9", "adx_14", "adx_14__x")
#: Rows of the state store; ``__halo_ts`` is the time of the first bar that the windows of the next block read.
STATE = "symbol string, ts timestamp_ntz, idx bigint, __halo_ts timestamp_ntz, " + ", ".join(f"{c} double" for c in STATE_COLUMNS)
DAYS = 365
HISTORY = f"INTERVAL {DAYS} DAYS"
#: Rows before a block that its windows read.
HALO = 20


def _mean_of(column, n: int, a: float, b: float, start: int, **more) -> Recurrence:
    """Seeded with the mean of the ``n`` rows that end at ``start``."""
    return Recurrence(column, a, b, start, n, 1 / n, **more)


def _ema(column, n: int, start: int | None = None) -> Recurrence:
    return _mean_of(column, n, 1 - 2 / (n + 1), 2 / (n + 1), n - 1 if start is None else start)


def _wilder(column, n: int, start: int, **more) -> Recurrence:
    return _mean_of(column, n, (n - 1) / n, 1 / n, start, **more)


def _scan(df: DataFrame, series: dict[str, Recurrence], only: tuple[str, ...], state: DataFrame | None) -> DataFrame:
    """Only those recurrences that a column of ``only`` reads; the others are null."""
    read = {n: r for n, r in series.items() if set(_READ_BY.get(n, (n,))) & set(only)}
    missing = {n: F.lit(None).cast("double") for n in series if n not in read} | {f"{n}__x": F.lit(None).cast("double") for n, r in series.items() if r.hold and n not in read}
    initial = None
    if state is not None:
        held = [c for n, r in read.items() if r.hold for c in (F.col(f"{n}__x").alias(f"__x_{n}"), F.lit(0.0).alias(f"__t_{n}"))]
        initial = state.select("symbol", block_of().alias("__block"), *[F.coalesce(n, F.lit(0.0)).alias(f"__e_{n}") for n in read], *held)
    df = df.withColumns(missing) if missing else df
    return affine_scan(df, read, initial=initial) if read else df


def numbered(bars: DataFrame, state: DataFrame | None = None, trailing: bool = True) -> DataFrame:
    """``bars`` with ``idx``, from 0, or so that the bar at the time of ``state`` (``symbol, ts, idx``) has its number; and the trailing
    extremes."""
    if trailing:
        rows = trailing_extremes(bars, DAYS, {"trailing_365d_high": "high"}, {"trailing_365d_low": "low"}, number=True)
    else:
        span = DAYS * 86_400_000_000
        rows = bars.withColumn("__at", micros("ts")).withColumn("__cell", F.expr(f"(__at - pmod(__at, {span}L)) div {span}L"))
        rows = rows.withColumn("__rn", F.row_number().over(Window.partitionBy("symbol", "__cell").orderBy("__at"))).drop("__at")
        rows = rows.withColumns({c: F.lit(None).cast("double") for c in _TRAILING[:2]})
    rows = written(rows, "cells")
    if state is None:
        return shifted(rows, ["symbol"], "idx")
    known = state.select(F.col("symbol").alias("__symbol"), F.col("ts").alias("__ts"), F.col("idx").alias("__idx"))
    ahead = rows.join(known, F.col("symbol") == F.col("__symbol")).groupBy("__symbol").agg((F.first("__idx") + 1 - F.count_if(F.col("ts") <= F.col("__ts"))).alias("__ahead"))
    return shifted(rows, ["symbol"], "idx").join(ahead, F.col("symbol") == F.col("__symbol")).withColumn("idx", F.col("idx") + F.col("__ahead")).drop("__ahead", "__symbol")


def with_indicators(bars: DataFrame, only: tuple[str, ...] = INDICATOR_COLUMNS, state: DataFrame | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """``bars`` with ``idx`` and the indicator columns ``only``. Windows over rows span a symbol and a block of ``BLOCK`` bars or a
    year, so a long series is many tasks. Windows of other columns are pruned by the optimizer, recurrences here. Rows that are read
    twice, for themselves and for what is carried between blocks, are written to the shared folder (``sources.shared``).

    ``state`` resumes series: rows of ``STATE_COLUMNS`` with ``symbol, ts, idx``, one a symbol, at the end of a block. Then
    ``bars`` need to reach back ``DAYS`` days and ``HALO`` bars only, and the result begins after that block. ``keep`` are further
    columns of the computation to return."""
    close, high, low = F.col("close"), F.col("high"), F.col("low")
    df = numbered(bars, state, bool(set(_TRAILING) & set(only)))
    if state is not None:
        known = state.select(F.col("symbol").alias("__symbol"), F.col("idx").alias("__from"))
        df = df.join(known, F.col("symbol") == F.col("__symbol")).where(F.col("idx") > F.col("__from") - HALO).drop("__symbol")
        fresh = F.col("idx") > F.col("__from")
    # the last rows of a block are seen by the next one too
    own = F.struct(block_of().alias("__block"), F.lit(True).alias("__own"))
    next_one = F.when(F.col("idx") % BLOCK >= BLOCK - HALO, F.struct((block_of() + 1).alias("__block"), F.lit(False).alias("__own")))
    df = df.select("*", F.inline(F.filter(F.array(own, next_one), lambda x: x.isNotNull())))
    near = Window.partitionBy("symbol", "__block").orderBy("idx")
    df = df.withColumns({
        "__volume": F.col("volume").cast("double"), "__c1": F.lag("close").over(near), "__h1": F.lag("high").over(near), "__l1": F.lag("low").over(near), "__c20": F.lag("close", 20).over(near),
        "__sd": F.stddev_pop("close").over(near.rowsBetween(1 - HALO, 0)), "__halo_ts": F.min("ts").over(near.rowsBetween(1 - HALO, 0)),
    }).where("__own").drop("__own", "__block")
    if state is not None:
        df = df.where(fresh).drop("__from")
    move, up, down = close - F.col("__c1"), high - F.col("__h1"), F.col("__l1") - low
    first = F.col("idx") == 0
    df = df.withColumns({
        "__gain": F.when(first, 0.0).otherwise(F.greatest(move, F.lit(0.0))), "__loss": F.when(first, 0.0).otherwise(F.greatest(-move, F.lit(0.0))),
        "__tr": F.when(first, 0.0).otherwise(F.greatest(high - low, F.abs(high - F.col("__c1")), F.abs(low - F.col("__c1")))),
        "__pdm": F.when(~first & (up > down) & (up > 0), up).otherwise(0.0), "__mdm": F.when(~first & (down > up) & (down > 0), down).otherwise(0.0),
        "__flow": F.when(first, F.col("__volume")).otherwise(F.signum(move) * F.col("__volume")),
    }).drop("__h1", "__l1")
    df = _scan(df, {
        **{f"ema_{n}": _ema(close, n) for n in EMA_LENGTHS}, "__fast": _ema(close, 12, 25), "__slow": _ema(close, 26), "volume_ema_20": _ema(F.col("__volume"), 20),
        "__g": _wilder(F.col("__gain"), 14, 14), "__l": _wilder(F.col("__loss"), 14, 14), "atr_14": _wilder(F.col("__tr"), 14, 14),
        **{f"__w{c}": Recurrence(F.col(f"__{c}"), 13 / 14, 1.0, 13, 13) for c in ("tr", "pdm", "mdm")}, "obv": Recurrence(F.col("__flow"), 1.0, 1.0, 0),
    }, only, state)
    di = lambda c: F.when(F.col("idx") >= 14, F.when(F.col("__wtr") == 0, 0.0).otherwise(F.try_divide(100 * F.col(c), F.col("__wtr"))))
    df = df.withColumns({"plus_di_14": di("__wpdm"), "minus_di_14": di("__wmdm"), "macd_12_26": F.col("__fast") - F.col("__slow")})
    both = F.col("plus_di_14") + F.col("minus_di_14")
    df = df.withColumn("__dx", F.when(both != 0, F.try_divide(100 * F.abs(F.col("plus_di_14") - F.col("minus_di_14")), both)))
    df = _scan(df, {"macd_signal_9": _mean_of(F.col("macd_12_26"), 9, 0.8, 0.2, 33), "adx_14": _wilder(F.col("__dx"), 14, 27, hold=True)}, only, state)
    e20, sd = F.col("ema_20"), F.when(F.col("idx") >= 19, F.col("__sd"))
    df = df.withColumns({
        "relative_volume_20": F.when(F.col("volume_ema_20") != 0, F.col("volume") / F.col("volume_ema_20")),
        "rsi_14": F.when(F.col("__g").isNotNull(), F.coalesce(F.try_divide(100 * F.col("__g"), F.col("__g") + F.col("__l")), F.lit(0.0))),
        "atr_percent_14": F.try_divide(F.col("atr_14"), close) * 100, "macd_histogram": F.col("macd_12_26") - F.col("macd_signal_9"),
        "band_upper_20_2": e20 + 2 * sd, "band_middle_20": e20, "band_lower_20_2": e20 - 2 * sd, "band_width_20_2": F.try_divide(4 * sd, e20) * 100,
        "roc_20": F.when(F.col("idx") >= 20, F.coalesce((F.try_divide(close, F.col("__c20")) - 1) * 100, F.lit(0.0))),
        "distance_from_365d_high_percent": (F.try_divide(close, F.col("trailing_365d_high")) - 1) * 100,
    })
    df = df.withColumns({c: F.when(F.col("idx") >= 33, F.col(c)) for c in ("macd_12_26", "macd_histogram")})
    return df.select("symbol", "ts", "open", "high", "low", "close", "volume", "idx", *only, *[c for c in keep if c not in only])


def published(df: DataFrame, firsts: DataFrame) -> DataFrame:
    """Rows of ``with_indicators`` from a year after the first bar on (``symbol, first_ts``), all strict columns finite."""
    finite = F.lit(True)
    for c in INDICATOR_COLUMNS:
        if c not in NULLABLE:
            finite &= F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) != float("inf"))
    gate = firsts.select(F.col("symbol").alias("__symbol"), (F.col("first_ts") + F.expr(HISTORY)).alias("__from"))
    return df.join(gate, F.col("symbol") == F.col("__symbol")).where((F.col("ts") >= F.col("__from")) & finite).drop("__symbol", "__from")


def indicator_table(bars: DataFrame, prices: bool = False) -> DataFrame:
    """The published table: series with a year of history, rows from its end on, all strict columns finite.
    Series that are too short have no rows. With ``prices`` the bars stay beside their indicators, and no join is needed."""
    firsts = bars.groupBy("symbol").agg(F.min("ts").alias("first_ts"))
    found = published(with_indicators(bars), firsts)
    return found.drop("idx") if prices else found.select("symbol", "ts", *INDICATOR_COLUMNS)


def block_ends(df: DataFrame) -> DataFrame:
    """``STATE`` rows of a frame that keeps ``STATE_COLUMNS``: what resumes a series after each block."""
    return df.where(F.col("idx") % BLOCK == BLOCK - 1).select("symbol", "ts", "idx", "__halo_ts", *STATE_COLUMNS)
