"""Chart structure from the last pivots: trend, swing sequence and ten formations.

Thresholds are choices of this engine, expressed against ``tol``, a share of the pivot range. A formation's
confidence is a score, not a probability: 0.5, and up to 0.5 more the closer its levels agree against ``tol`` where it
needs them equal, or the further they are apart where it needs them apart.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.functions import calendar
from barloom.operators.windows import first_windows, forward_returns

PERIODS, LEAST_PERIODS, PIVOTS_READ, HISTORY_HORIZONS = 120, 30, 7, (5, 10, 20)


class StructureError(ValueError):
    """A request that cannot be answered."""


@dataclass(frozen=True)
class AnalysisRequest:
    """A symbol and interval with a range of time, or with the number of last bars; bounds are inclusive."""

    symbol: str
    interval: str = "1d"
    start: datetime | None = None
    end: datetime | None = None
    periods: int | None = None
    historical: bool = False


def validate_request(symbol: str, interval: str = "1d", start: datetime | None = None, end: datetime | None = None, periods: int | None = None, historical: bool = False) -> AnalysisRequest:
    """The request with its default of the last ``PERIODS`` bars where neither a start nor a number is given."""
    if not symbol.strip():
        raise StructureError("a symbol is required")
    calendar.interval(interval)
    if start is not None and end is not None and end < start:
        raise StructureError("the end is before the start")
    if periods is None and start is None:
        periods = PERIODS
    if periods is not None and periods < LEAST_PERIODS:
        raise StructureError(f"periods must be at least {LEAST_PERIODS}")
    return AnalysisRequest(symbol.strip(), interval, start, end, periods, historical)


def select_window(bars: DataFrame, request: AnalysisRequest) -> DataFrame:
    """The bars of the request's symbol in its range, and of those the last ``periods``."""
    out = bars.where(F.col("symbol") == request.symbol)
    if request.start is not None:
        out = out.where(F.col("ts") >= F.lit(request.start))
    if request.end is not None:
        out = out.where(F.col("ts") <= F.lit(request.end))
    if request.periods is not None:
        newest = Window.partitionBy("symbol").orderBy(F.desc("ts"))
        out = out.withColumn("__rn", F.row_number().over(newest)).where(F.col("__rn") <= request.periods).drop("__rn")
    return out


def with_tolerance(bars: DataFrame, factor: float = 0.5) -> DataFrame:
    """``bars`` with ``tolerance``, a share of the average true range; bars without a positive one go."""
    return bars.where(F.col("atr_14") > 0).withColumn("tolerance", F.col("atr_14") * factor)


def _near(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= F.col("tol")


def analyze(bars: DataFrame, pivots: DataFrame) -> DataFrame:
    """Per symbol: ``trend, swing_sequence, formation, breakout_state`` and an array of ``patterns``.

    ``pivots`` alternate (``symbol, run, kind, price``); the last seven are read, newest last."""
    p = pivots.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("run", "kind", "price"))).alias("p"))
    p = p.withColumn("p", F.slice("p", F.greatest(F.size("p") - (PIVOTS_READ - 1), F.lit(1)), PIVOTS_READ))
    return _read(p.join(bars.groupBy("symbol").agg(F.max_by("close", "ts").alias("close")), "symbol"), ("symbol",))


def historical(bars: DataFrame, pivots: DataFrame, horizons: tuple[int, ...] = HISTORY_HORIZONS) -> DataFrame:
    """Earlier occurrences of each symbol's present formation and the percent change of the close after them.

    Every window of seven pivots (a bar may be two of them) is read like the last one, at the close of its last. Occurrences end
    before the present window starts and do not overlap: earlier ones win, an end lies before the next start."""
    w = Window.partitionBy("symbol").orderBy("run").rowsBetween(1 - PIVOTS_READ, 0)
    p = pivots.select("symbol", "run", "idx", F.collect_list(F.struct("run", "kind", "price")).over(w).alias("p"), F.min("idx").over(w).alias("window_start_index"), F.count("*").over(w).alias("n")).where(F.col("n") == PIVOTS_READ)
    after = forward_returns(bars, horizons).select("symbol", "idx", "close", *[f"return_{h}" for h in horizons])
    keys = ("symbol", "window_start_index", "idx")
    past = _read(p.join(after.select("symbol", "idx", "close"), ["symbol", "idx"]), keys)
    newest = pivots.groupBy("symbol").agg(F.max("run").alias("last_run"))
    start = pivots.join(newest, "symbol").where(F.col("run") > F.col("last_run") - PIVOTS_READ).groupBy("symbol").agg(F.min("idx").alias("now_start"))
    now = analyze(bars, pivots).where("formation <> 'none'").select("symbol", "formation").join(start, "symbol")
    same = past.drop("formation").join(now, "symbol").where(F.exists("patterns", lambda x: x["name"] == F.col("formation")) & (F.col("idx") < F.col("now_start")))
    found = same.select("symbol", "formation", "window_start_index", F.col("idx").alias("window_end_index"))
    kept = first_windows(found, "window_start_index", "window_end_index")
    after = after.drop("close").withColumnRenamed("idx", "window_end_index")
    return kept.join(after, ["symbol", "window_end_index"])


def _read(p: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """What the pivots ``p`` say at the price ``close``; one row per row, named by ``keys``."""
    prices = lambda kind: F.transform(F.filter("p", lambda x: x["kind"] == kind), lambda x: x["price"])
    p = p.withColumns({"H": prices("H"), "L": prices("L")})
    at = lambda side, i: F.try_element_at(F.col(side), F.lit(-i))  # noqa: E731  i-th from the end
    h1, h2, h3, l1, l2, l3 = (at(s, i) for s in "HL" for i in (1, 2, 3))
    top, low = F.array_max("H"), F.array_min("L")
    p = p.withColumns({"tol": 0.12 * (top - low)})
    rising, falling, flat_h = (h1 - h2 > F.col("tol")) & (l1 - l2 > F.col("tol")), (h2 - h1 > F.col("tol")) & (l2 - l1 > F.col("tol")), _near(h1, h2)
    flat_l, close = _near(l1, l2), F.col("close")
    last_kind = F.element_at(F.col("p"), -1)["kind"]
    neck_b, neck_t = F.greatest(h1, h2), F.least(l1, l2)

    tol = F.col("tol")
    equal = lambda a, b: 1 - F.least(F.abs(a - b) / tol, F.lit(1.0))
    apart = lambda gap: F.least(F.greatest(gap / (3 * tol), F.lit(0.0)), F.lit(1.0))

    def pattern(name, test, up, confirm, fail, score, told):
        beyond, behind = (close > confirm, close < fail) if up else (close < confirm, close > fail)
        status = F.when(beyond, "confirmed").when(behind, "invalidated").otherwise("developing")
        evidence = F.array(*[F.concat(F.lit(f"{label} "), F.format_string("%.2f", value)) for label, value in told])
        confidence = F.round(0.5 + 0.5 * F.coalesce(score, F.lit(0.0)), 4)
        fields = (F.lit(name).alias("name"), status.alias("status"), confidence.alias("confidence"), confirm.alias("confirmation_level"), fail.alias("invalidation_level"), evidence.alias("evidence"))
        return F.when(test, F.struct(*fields))

    drop = F.when(F.size("H") >= 2, h2 - F.greatest(l1, l2))
    # a reversal is the last two extremes, or the two before them if a smaller swing has followed; its neckline lies between
    late_l, late_h = F.coalesce(flat_l, F.lit(False)), F.coalesce(flat_h, F.lit(False))
    at_l, at_h = last_kind == "L", last_kind == "H"
    bottoms = F.when(late_l, F.struct(l1.alias("a"), l2.alias("b"), F.when(at_l, h1).otherwise(h2).alias("neck"))).when(_near(l2, l3) & (l1 > F.greatest(l2, l3)), F.struct(l2.alias("a"), l3.alias("b"), F.when(at_l, h2).otherwise(h3).alias("neck")))
    tops = F.when(late_h, F.struct(h1.alias("a"), h2.alias("b"), F.when(at_h, l1).otherwise(l2).alias("neck"))).when(_near(h2, h3) & (h1 < F.least(h2, h3)), F.struct(h2.alias("a"), h3.alias("b"), F.when(at_h, l2).otherwise(l3).alias("neck")))
    p = p.withColumns({"bottoms": bottoms, "tops": tops})
    b, t = F.col("bottoms"), F.col("tops")
    highs, lows = (("last highs", h1), ("and", h2)), (("last lows", l1), ("and", l2))
    made = F.array(
        pattern("double-bottom", b["neck"] > F.greatest(b["a"], b["b"]) + 2 * tol, True, b["neck"], F.least(b["a"], b["b"]) - tol, equal(b["a"], b["b"]), (("lows", b["a"]), ("and", b["b"]), ("neckline", b["neck"]))),
        pattern("double-top", t["neck"] < F.least(t["a"], t["b"]) - 2 * tol, False, t["neck"], F.greatest(t["a"], t["b"]) + tol, equal(t["a"], t["b"]), (("highs", t["a"]), ("and", t["b"]), ("neckline", t["neck"]))),
        pattern("head-and-shoulders", _near(h1, h3) & (h2 > F.greatest(h1, h3) + tol), False, F.least(l1, l2), h2, equal(h1, h3), (("shoulders", h1), ("and", h3), ("head", h2))),
        pattern("inverse-head-and-shoulders", _near(l1, l3) & (l2 < F.least(l1, l3) - tol), True, F.greatest(h1, h2), l2, equal(l1, l3), (("shoulders", l1), ("and", l3), ("head", l2))),
        pattern("ascending-triangle", flat_h & (l1 > l2 + tol / 2), True, neck_b, l1, equal(h1, h2), (*highs, *lows)),
        pattern("descending-triangle", flat_l & (h1 < h2 - tol / 2), False, neck_t, h1, equal(l1, l2), (*highs, *lows)),
        pattern("symmetrical-triangle", (h1 < h2 - tol / 2) & (l1 > l2 + tol / 2), True, h1, l1, apart(F.least(h2 - h1, l1 - l2)), (*highs, *lows)),
        pattern("ascending-channel", rising, True, h1, l1, apart(F.least(h1 - h2, l1 - l2)), (*highs, *lows)),
        pattern("descending-channel", falling, False, l1, h1, apart(F.least(h2 - h1, l2 - l1)), (*highs, *lows)),
        pattern("horizontal-range", flat_h & flat_l & (drop > 3 * tol), True, F.greatest(h1, h2), F.least(l1, l2), F.least(equal(h1, h2), equal(l1, l2)), (*highs, *lows)),
    )
    p = p.withColumn("patterns", F.filter(made, lambda x: x.isNotNull()))
    trend = F.when(rising, "bullish").when(falling, "bearish").otherwise("sideways")
    return p.select(
        *keys, trend.alias("trend"), F.when(rising, "higher-highs-higher-lows").when(falling, "lower-highs-lower-lows").otherwise("mixed").alias("swing_sequence"),
        F.coalesce(F.try_element_at(F.col("patterns"), F.lit(-1))["name"], F.lit("none")).alias("formation"),
        F.when((close > top) | (close < low), "breakout").otherwise("inside").alias("breakout_state"), "patterns",
    )


def analyze_frame(bars: DataFrame, pivots: DataFrame, metadata: dict, historical_too: bool = False) -> list[dict]:
    """One document per symbol, as plain data: ``data`` (the metadata), ``structure``, ``patterns`` and, if asked for,
    ``historical`` with its horizons and occurrences. A request is about one symbol or a few, whose documents fit the driver."""
    found = analyze(bars, pivots).collect()
    past: dict[str, list] = {}
    if historical_too:
        for r in historical(bars, pivots).orderBy("symbol", "position").collect():
            past.setdefault(r.symbol, []).append({k: v for k, v in r.asDict().items() if k not in ("symbol", "position")})
    out = []
    for r in found:
        doc = {"data": metadata | {"symbol": r.symbol}, "structure": {k: r[k] for k in ("trend", "swing_sequence", "formation", "breakout_state")}, "patterns": [x.asDict() for x in r.patterns]}
        if historical_too:
            doc["historical"] = {"horizons": list(HISTORY_HORIZONS), "occurrences": past.get(r.symbol, [])}
        out.append(doc)
    return out


def metadata(request: AnalysisRequest, source_interval: str) -> dict:
    """What was asked for and where the bars come from; ``derived`` if they are resampled from another interval."""
    told = {k: v.isoformat() if isinstance(v, datetime) else v for k, v in asdict(request).items() if k in ("start", "end", "periods") and v is not None}
    return {"symbol": request.symbol, "requested_interval": request.interval, "source_interval": source_interval, "derived": source_interval != request.interval} | told
