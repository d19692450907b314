"""Similar setups: feature vectors of the last ten bars, context gates, distances and greedy choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.windows import forward_returns, greedy_windows
from barloom.sources.shared import finished, written

WINDOW, MAX_MATCHES, FUTURE_PERIODS = 10, 200, (5, 10, 20, 30)
#: Said with every answer (a fixed value).
WARNING = "Prices are adjusted for corporate actions; volume is as the vendor provides it."
SUBGROUPS = ("chart_shape", "volume", "candle_volatility", "momentum", "trend_strength", "yearly_position")
CONTEXT = ("direction_regime", "ema_50_side", "ema_200_side", "volatility_regime", "yearly_position_regime")


def validate_symbol(symbol: str) -> str:
    if not symbol.strip():
        raise ValueError("a symbol is required")
    return symbol.strip()


#: The series of each vector, ten values each; chart shape is relative to the last close of its window.
SERIES = {
    "chart_shape": ("open", "high", "low", "close", "ema_20"), "volume": ("f_rv", "f_va", "f_flow"), "candle_volatility": ("f_body", "f_up", "f_down", "f_range"),
    "momentum": ("f_rsi", "f_roc"), "trend_strength": ("f_adx", "f_plus", "f_minus"), "yearly_position": ("f_year",),
}
#: Bars of one piece of a window whose means bound its distance from below.
PIECE = 2


def with_series(bars: DataFrame) -> DataFrame:
    """``bars`` with the series of the vectors: relative volume, its average and flow; body, both wicks and range in average
    true ranges; momentum, trend strength and yearly position in hundredths."""
    s = Window.partitionBy("symbol").orderBy("idx")
    atr, close = F.col("atr_14"), F.col("close")
    top, bottom = F.greatest("open", "close"), F.least("open", "close")
    percent = {"f_rsi": "rsi_14", "f_roc": "roc_20", "f_adx": "adx_14", "f_plus": "plus_di_14", "f_minus": "minus_di_14", "f_year": "distance_from_365d_high_percent"}
    return bars.withColumns({
        "f_rv": F.coalesce("relative_volume_20", F.lit(0.0)), "f_va": F.coalesce(F.try_divide(F.col("volume_ema_20"), F.lag("volume_ema_20").over(s)), F.lit(1.0)),
        "f_flow": F.signum(close - F.lag("close").over(s)) * F.coalesce("relative_volume_20", F.lit(0.0)), "f_body": F.try_divide(close - F.col("open"), atr), "f_up": F.try_divide(F.col("high") - top, atr),
        "f_down": F.try_divide(bottom - F.col("low"), atr), "f_range": F.try_divide(F.col("high") - F.col("low"), atr), **{n: F.col(c) / 100 for n, c in percent.items()},
    })


def with_context(bars: DataFrame) -> DataFrame:
    """``bars`` with ``first_idx`` of the window that ends there and its context; whole windows with all averages only."""
    cuts = bars.groupBy("symbol").agg(F.percentile("atr_percent_14", [1 / 3, 2 / 3]).alias("cuts"))
    close, atr = F.col("close"), F.col("atr_percent_14")
    return bars.join(cuts, "symbol").withColumns({
        "first_idx": F.col("idx") - (WINDOW - 1),
        "direction_regime": F.when(F.col("plus_di_14") > F.col("minus_di_14"), "up").otherwise("down"), "ema_50_side": close > F.col("ema_50"), "ema_200_side": close > F.col("ema_200"),
        "volatility_regime": F.when(atr <= F.col("cuts")[0], "low").when(atr <= F.col("cuts")[1], "middle").otherwise("high"),
        "yearly_position_regime": F.when(F.col("distance_from_365d_high_percent") >= -10, "near-high").when(F.col("distance_from_365d_high_percent") >= -30, "middle").otherwise("far"),
    }).where((F.col("idx") >= WINDOW - 1) & F.col("ema_200").isNotNull()).drop("cuts")


def features(bars: DataFrame) -> DataFrame:
    """One row per bar with its context, the six vectors of its window, and the window's first index.

    Chart shape (50), volume (30), candle and volatility (41: four series and the true-range percent), momentum (20), trend
    strength (30) and yearly position (10). For looking at windows; ``matches`` compares them without building lists."""
    w = Window.partitionBy("symbol").orderBy("idx").rowsBetween(1 - WINDOW, 0)
    lists = lambda g: F.flatten(F.array(*[F.collect_list(n).over(w) for n in SERIES[g]]))
    b = with_series(bars).withColumns({("volume_vector" if g == "volume" else g): lists(g) for g in SERIES})
    b = b.withColumns({"chart_shape": F.transform("chart_shape", lambda x: x / F.col("close") - 1), "candle_volatility": F.concat("candle_volatility", F.array("atr_percent_14"))})
    return with_context(b)


def euclid(a: Column, b: Column) -> Column:
    """Root mean square difference of two vectors."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    return F.sqrt(total / F.size(a))


_SIZES = {g: WINDOW * len(names) + (g == "candle_volatility") for g, names in SERIES.items()}


def _relative(group: str, name: str, value: Column, close: Column) -> Column:
    return value / close - 1 if group == "chart_shape" else value


def _combined(squares: dict[str, Column]) -> dict[str, Column]:
    """Distances by vector and their mean, from sums of squared differences."""
    each = {f"{g}_distance": F.sqrt(c / _SIZES[g]) for g, c in squares.items()}
    return each | {"combined_distance": sum(each.values()) / len(each)}


def _exact(windows: DataFrame, series: DataFrame, latest: DataFrame) -> DataFrame:
    """``symbol, idx`` and the distances of windows to the latest one: each bar of a window meets the bar of the same place."""
    names = [n for g in SERIES.values() for n in g]
    bars = windows.select("symbol", "idx", F.col("close").alias("c"), "atr_percent_14", F.explode(F.sequence(F.lit(0), F.lit(WINDOW - 1))).alias("back"))
    bars = bars.withColumn("at", F.col("idx") - F.col("back")).join(series.select("symbol", F.col("idx").alias("at"), *names), ["symbol", "at"]).join(latest, ["symbol", "back"])
    gap = lambda g, n: _relative(g, n, F.col(n), F.col("c")) - F.col(f"z_{n}")
    sums = {g: F.sum(sum(gap(g, n) * gap(g, n) for n in own)) for g, own in SERIES.items()}
    sums["candle_volatility"] += F.first((F.col("atr_percent_14") - F.col("z_atr")) * (F.col("atr_percent_14") - F.col("z_atr")))
    return bars.groupBy("symbol", "idx").agg(*[c.alias(n) for n, c in _combined(sums).items()])


def lower_bounds(windows: DataFrame, series: DataFrame, latest: DataFrame) -> DataFrame:
    """``symbol, idx, bound``: a distance that the exact one does not fall below, from the means of pieces of the windows. A
    piece of n values differs by at least n times the square of the difference of its means."""
    names, s = [n for g in SERIES.values() for n in g], Window.partitionBy("symbol").orderBy("idx")
    pieces = range(WINDOW // PIECE)
    means = series.withColumns({f"m0_{n}": F.avg(n).over(s.rowsBetween(1 - PIECE, 0)) for n in names})
    means = means.withColumns({f"m{k}_{n}": F.lag(f"m0_{n}", k * PIECE).over(s) for n in names for k in pieces if k})
    mine = latest.groupBy("symbol").agg(F.first("z_atr").alias("z_atr"), *[F.avg(F.when(F.expr(f"back div {PIECE}") == k, F.col(f"z_{n}"))).alias(f"z{k}_{n}") for n in names for k in pieces])
    both = windows.select("symbol", "idx", F.col("close").alias("c"), "atr_percent_14").join(means.select("symbol", "idx", *[f"m{k}_{n}" for n in names for k in pieces]), ["symbol", "idx"]).join(mine, "symbol")
    gap = lambda g, n, k: _relative(g, n, F.col(f"m{k}_{n}"), F.col("c")) - F.col(f"z{k}_{n}")
    sums = {g: sum(PIECE * gap(g, n, k) * gap(g, n, k) for n in own for k in pieces) for g, own in SERIES.items()}
    sums["candle_volatility"] += (F.col("atr_percent_14") - F.col("z_atr")) * (F.col("atr_percent_14") - F.col("z_atr"))
    return both.select("symbol", "idx", _combined(sums)["combined_distance"].alias("bound"))


def search(bars: DataFrame, most: int = MAX_MATCHES) -> tuple[DataFrame, DataFrame]:
    """Earlier, non-overlapping windows of each symbol that share the context of its latest one, nearest first, with what
    followed; and ``symbol, n_candidates, n_compared``.

    Each window taken rules out fewer than twice its length of others, so the ``2 * WINDOW - 1`` times ``most`` nearest windows decide: no
    more are ranked. Where a symbol has more candidates than that, lower bounds choose those that are compared: first as
    many as decide, and then all whose bound does not exceed the greatest distance among these."""
    room = (2 * WINDOW - 1) * most
    series = written(with_series(bars).select("symbol", "idx", *[n for g in SERIES.values() for n in g]), "series")
    told = with_context(forward_returns(bars, FUTURE_PERIODS))
    last = told.groupBy("symbol").agg(F.max_by(F.struct("idx", "first_idx", "close", "atr_percent_14", *CONTEXT), "idx").alias("last"))
    same = F.lit(True)
    for c in CONTEXT:
        same &= F.col(c).eqNullSafe(F.col(f"last.{c}"))
    kept = ["symbol", "idx", "first_idx", "ts", "close", "atr_percent_14", *[f"return_{h}" for h in FUTURE_PERIODS]]
    candidates = written(told.join(last, "symbol").where(same & (F.col("idx") < F.col("last.first_idx"))).select(*kept, "last"), "candidates")
    ends = candidates.groupBy("symbol").agg(F.first("last").alias("last"), F.count("*").alias("n_candidates"))
    at = series.join(ends, "symbol").where((F.col("idx") >= F.col("last.first_idx")) & (F.col("idx") <= F.col("last.idx")))
    z = [_relative(g, n, F.col(n), F.col("last.close")).alias(f"z_{n}") for g, own in SERIES.items() for n in own]
    latest = at.select("symbol", (F.col("last.idx") - F.col("idx")).cast("int").alias("back"), F.col("last.atr_percent_14").alias("z_atr"), *z)
    candidates, compared = candidates.drop("last"), ends.select("symbol", "n_candidates", F.col("n_candidates").alias("n_compared"))
    if ends.where(F.col("n_candidates") > room).isEmpty():
        exact = _exact(candidates, series, latest)
    else:
        bounds = written(lower_bounds(candidates, series, latest), "bounds")
        rank = F.row_number().over(Window.partitionBy("symbol").orderBy("bound", "idx"))
        first = bounds.withColumn("place", rank).where(F.col("place") <= room).select("symbol", "idx")
        near = _exact(candidates.join(first, ["symbol", "idx"]), series, latest).groupBy("symbol").agg(F.max("combined_distance").alias("far"), F.count("*").alias("n"))
        left = bounds.join(near, "symbol").where((F.col("n") < room) | (F.col("bound") <= F.col("far") * (1 + 1e-9)))
        compared = ends.select("symbol", "n_candidates").join(left.groupBy("symbol").agg(F.count("*").alias("n_compared")), "symbol")
        exact = _exact(candidates.join(left.select("symbol", "idx"), ["symbol", "idx"]), series, latest)
    ranked = exact.join(candidates, ["symbol", "idx"])
    order = F.row_number().over(Window.partitionBy("symbol").orderBy("combined_distance", "first_idx"))
    ranked = written(ranked.withColumn("place", order).where(F.col("place") <= room), "ranked")
    taken = greedy_windows(ranked, "combined_distance", "first_idx", "idx", most)
    return taken.join(ranked.select("symbol", "idx", "ts", "chart_shape_distance", *[f"return_{h}" for h in FUTURE_PERIODS]), ["symbol", "idx"]), compared


def matches(bars: DataFrame, most: int = MAX_MATCHES) -> DataFrame:
    """The windows of ``search``."""
    return finished(bars.sparkSession, lambda: search(bars, most)[0], "matches")
