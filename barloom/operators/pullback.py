"""Pivots, pullback events, learned rebound triggers and the current state of each symbol.

Input is ``with_indicators`` output. Half-width, anchor tolerance and outcome rule are choices of this
engine; trigger, live turn and state labels follow the published plan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.indicators import EMA_LENGTHS
from barloom.sources.shared import written

#: The indicators that pullback plans read.
PULLBACK_COLUMNS = (*[f"ema_{n}" for n in EMA_LENGTHS], "atr_14")
STOP, HORIZON, MIN_WINNERS, BARS_PER_DAY = 0.03, 15, 5, 7.0
#: Days that a learned horizon lies between.
CLAMP_DAYS = (0.5, 10.0)


def _series():
    return Window.partitionBy("symbol").orderBy("idx")


def fractal_pivots(bars: DataFrame, k: int = 6) -> DataFrame:
    """``symbol, idx, ts, kind, price``: highs and lows of a full window of ``k`` bars to either side; of
    equal extremes the first counts."""
    full = F.count("*").over(_series().rowsBetween(-k, k)) == 2 * k + 1
    left, right = _series().rowsBetween(-k, -1), _series().rowsBetween(1, k)
    high = full & (F.col("high") > F.max("high").over(left)) & (F.col("high") >= F.max("high").over(right))
    low = full & (F.col("low") < F.min("low").over(left)) & (F.col("low") <= F.min("low").over(right))
    flags = bars.select("symbol", "idx", "ts", F.array(F.when(high, F.struct(F.lit("H").alias("kind"), F.col("high").alias("price"))), F.when(low, F.struct(F.lit("L").alias("kind"), F.col("low").alias("price")))).alias("p"))
    return flags.select("symbol", "idx", "ts", F.inline(F.filter("p", lambda x: x.isNotNull())))


def zigzag(pivots: DataFrame) -> DataFrame:
    """Alternating highs and lows: of each run of one kind its extreme, the first among equals."""
    w = Window.partitionBy("symbol").orderBy("idx", "kind")
    run = pivots.withColumn("__new", F.coalesce((F.col("kind") != F.lag("kind").over(w)).cast("int"), F.lit(0)))
    run = run.withColumn("run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rank = F.struct(F.when(F.col("kind") == "H", -F.col("price")).otherwise(F.col("price")).alias("p"), "idx")
    best = run.groupBy("symbol", "run", "kind").agg(F.min_by(F.struct("idx", "ts", "price"), rank).alias("b"))
    return best.select("symbol", F.col("run").cast("long").alias("run"), F.col("b.idx").alias("idx"), F.col("b.ts").alias("ts"), "kind", F.col("b.price").alias("price"))


def pullback_events(zz: DataFrame) -> DataFrame:
    """One row per low that follows a high: ``symbol, high_idx, high, low_idx, low_ts, low, depth_pct``."""
    w = Window.partitionBy("symbol").orderBy("run")
    e = zz.withColumns({"high_idx": F.lag("idx").over(w), "high": F.lag("price").over(w)}).where((F.col("kind") == "L") & F.col("high").isNotNull())
    return e.select("symbol", "high_idx", "high", F.col("idx").alias("low_idx"), F.col("ts").alias("low_ts"), F.col("price").alias("low"), ((F.col("high") - F.col("price")) / F.col("high") * 100).alias("depth_pct"))


def with_anchor(events: DataFrame, bars: DataFrame) -> DataFrame:
    """The average nearest to the low, ``none`` if it is over one average true range away."""
    at = bars.select("symbol", F.col("idx").alias("low_idx"), "atr_14", *[f"ema_{n}" for n in EMA_LENGTHS])
    gaps = F.array(*[F.struct(F.abs(F.col("low") - F.col(f"ema_{n}")).alias("gap"), F.lit(n).alias("n")) for n in EMA_LENGTHS])
    near = F.array_min(F.filter(gaps, lambda g: g["gap"].isNotNull()))
    name = F.when(near["gap"] <= F.col("atr_14"), F.concat(F.lit("ema_"), near["n"].cast("string"))).otherwise("none")
    return events.join(at, ["symbol", "low_idx"]).withColumn("anchor", F.coalesce(name, F.lit("none"))).select(*events.columns, "anchor")


def with_outcome(events: DataFrame, bars: DataFrame, stop: float = STOP, horizon: int = HORIZON) -> DataFrame:
    """Success: within the horizon the high regains half of the fall before the low breaks the stop. The
    range join is an equi-join on the bounded list of bars ahead."""
    ahead = events.select("symbol", "low_idx", "high", "low", F.explode(F.sequence(F.col("low_idx") + 1, F.col("low_idx") + horizon)).alias("idx"))
    ahead = ahead.join(bars.select("symbol", "idx", F.col("high").alias("h"), F.col("low").alias("l")), ["symbol", "idx"])
    found = ahead.groupBy("symbol", "low_idx").agg(
        F.min(F.when(F.col("h") >= (F.col("high") + F.col("low")) / 2, F.col("idx"))).alias("won"), F.min(F.when(F.col("l") <= F.col("low") * (1 - stop), F.col("idx"))).alias("lost")
    )
    joined = events.join(found, ["symbol", "low_idx"], "left")
    good = F.col("won").isNotNull() & (F.col("lost").isNull() | (F.col("won") < F.col("lost")))
    return joined.withColumns({"success": good, "bars_to_win": F.when(good, F.col("won") - F.col("low_idx"))}).select(*events.columns, "success", "bars_to_win")


def _mode(df: DataFrame, value: str, order: str) -> DataFrame:
    """Most frequent value per symbol; the first seen among equals."""
    counted = df.groupBy("symbol", value).agg(F.count("*").alias("c"), F.min(order).alias("f"))
    return counted.groupBy("symbol").agg(F.max_by(value, F.struct("c", -F.col("f"))).alias(value))


def signature(events: DataFrame) -> DataFrame:
    """Depth quartiles, success rate, dominant anchor and confidence of each symbol."""
    q = events.groupBy("symbol").agg(
        F.count("*").alias("n_events"), F.percentile("depth_pct", [0.25, 0.75]).alias("q"), F.avg(F.col("success").cast("int")).alias("success_rate")
    )
    q = q.select("symbol", "n_events", F.col("q")[0].alias("band_lo"), F.col("q")[1].alias("band_hi"), "success_rate", F.when(F.col("n_events") >= 5, "ok").otherwise("low").alias("confidence"))
    return q.join(_mode(events, "anchor", "low_idx"), "symbol")


def turn_trigger(events: DataFrame, bars: DataFrame, min_winners: int = MIN_WINNERS) -> DataFrame:
    """What the winners had in common: lift from the low in average true ranges at the first close above the
    previous high, the average reclaimed there, and the delay. Null values where too few can be learned from."""
    thrust = F.when(F.col("close") > F.lag("high").over(_series()), F.struct("idx", "close", *[f"ema_{n}" for n in EMA_LENGTHS]))
    ahead = Window.partitionBy("symbol").orderBy(F.desc("idx")).rowsBetween(Window.unboundedPreceding, -2)  # backwards, so that the frame only grows
    b = bars.withColumn("__t", F.min(thrust).over(ahead))
    b = b.select("symbol", F.col("idx").alias("low_idx"), F.col("low").alias("__low"), "atr_14", "__t", *[F.col(f"ema_{n}").alias(f"__e{n}") for n in EMA_LENGTHS])
    e = events.where("success").join(b, ["symbol", "low_idx"]).where("atr_14 > 0 AND __t IS NOT NULL")
    reclaim = reduce(
        lambda rest, n: F.when((F.col("low") < F.col(f"__e{n}")) & (F.col("__t.close") > F.col(f"__t.ema_{n}")), f"ema_{n}").otherwise(rest), EMA_LENGTHS, F.lit("none")
    )
    e = e.select("symbol", "low_idx", ((F.col("__t.close") - F.col("low")) / F.col("atr_14")).alias("lift"), reclaim.alias("reclaim"), (F.col("__t.idx") - F.col("low_idx")).alias("lag"))
    t = e.groupBy("symbol").agg(F.count("*").alias("n_winners"), F.median("lift").alias("lift"), F.median("lag").alias("lag")).join(_mode(e, "reclaim", "low_idx"), "symbol")
    known = F.col("n_winners") >= min_winners
    return t.select("symbol", "n_winners", *[F.when(known, F.col(c)).alias(c) for c in ("lift", "reclaim", "lag")])


def live_dip(bars: DataFrame, zz: DataFrame) -> DataFrame:
    """Per symbol its last bar ``now``, the last pivot high ``top``, the lowest bar after it ``dip`` (null if the high is the
    last bar or there is none) and ``floor_price``, the pivot low before that high."""
    averages = [f"ema_{n}" for n in EMA_LENGTHS]
    top = zz.where("kind = 'H'").groupBy("symbol").agg(F.max_by(F.struct("idx", "price"), "run").alias("top"), F.max("run").alias("run"))
    floor = zz.where("kind = 'L'").join(top.select("symbol", F.col("run").alias("__run")), "symbol").where("run < __run").groupBy("symbol").agg(F.max_by("price", "run").alias("floor_price"))
    now = F.max_by(F.struct("idx", "ts", "close", "atr_14", "__e50", *averages), "idx").alias("now")
    ends = bars.withColumn("__e50", F.lag("ema_50", 19).over(_series())).groupBy("symbol").agg(now)
    lows = bars.join(top.select("symbol", "top"), "symbol").where(F.col("idx") > F.col("top.idx"))
    lows = lows.groupBy("symbol").agg(F.min_by(F.struct("low", "idx", "ts", *averages), F.struct("low", "idx")).alias("dip"))
    return ends.join(top.select("symbol", "top"), "symbol", "left").join(lows, "symbol", "left").join(floor, "symbol", "left")


def live_turn(live: DataFrame, trigger: DataFrame) -> DataFrame:
    """``live_dip`` rows with the answer whether the dip repeats the learned turn: by a lift from its low of as many average
    true ranges of the last bar, or by a close back above the learned average, if the low had broken it.

    ``turn_confirmed`` is null where that cannot be judged, and ``turn_why`` says why. ``turn_path`` lists the paths that
    fired, and both trigger prices are quoted whether or not they are reached; ``buy_trigger_price`` is the nearer one for a dip
    that has not turned."""
    pick = lambda side: reduce(lambda rest, n: F.when(F.col("reclaim") == f"ema_{n}", F.col(f"{side}.ema_{n}")).otherwise(rest), EMA_LENGTHS, F.lit(None).cast("double"))
    s = live.join(trigger, "symbol", "left")
    close, low, atr = F.col("now.close"), F.col("dip.low"), F.col("now.atr_14")
    why = (
        F.when(F.col("lift").isNull(), "trigger not learnable").when(low.isNull(), "no live dip").when(atr.isNull() | (atr == 0), "no average true range yet")
    )
    s = s.withColumns({"turn_why": why, "__then": pick("dip"), "__line": pick("now")})
    can = F.col("turn_why").isNull()
    s = s.withColumn("cur_lift", F.when(can, F.try_divide(close - low, atr)))
    broke = F.coalesce(low < F.col("__then"), F.lit(False))
    by_lift, by_line = F.col("cur_lift") >= F.col("lift"), broke & F.coalesce(close > F.col("__line"), F.lit(False))
    s = s.withColumns({
        "turn_confirmed": F.when(can, by_lift | by_line), "turn_path": F.when(can, F.filter(F.array(F.when(by_lift, "lift"), F.when(by_line, "reclaim")), lambda x: x.isNotNull())),
        "broke_ema": F.when(can, broke), "trigger_lift_price": F.when(can, low + F.col("lift") * atr), "trigger_ema_price": F.when(can, F.col("__line")),
    })
    return s.withColumn("buy_trigger_price", F.when(~F.col("turn_confirmed"), F.least("trigger_lift_price", "trigger_ema_price"))).drop("__then", "__line")


_UNJUDGED = {"turn_why": "string", "cur_lift": "double", "turn_confirmed": "boolean", "turn_path": "array<string>", "broke_ema": "boolean", "trigger_lift_price": "double", "trigger_ema_price": "double", "buy_trigger_price": "double"}


def current_state(bars: DataFrame, zz: DataFrame, sig: DataFrame, trigger: DataFrame | None = None) -> DataFrame:
    """Last bar of each symbol against its last pivot high: depth, live low, trend, turn and label. An uptrend inside the
    usual band is a buyable dip, which a ``trigger`` divides by whether it has turned; without one it is not divided."""
    live = live_dip(bars, zz)
    s = live.withColumns({n: F.lit(None).cast(t) for n, t in _UNJUDGED.items()}) if trigger is None else live_turn(live, trigger)
    s = s.join(sig, "symbol", "left")
    close, high, low = F.col("now.close"), F.col("top.price"), F.col("dip.low")
    depth = (high - close) / high * 100
    uptrend = F.coalesce((close > F.col("now.ema_50")) & (F.col("now.ema_50") > F.col("now.__e50")), F.lit(False))
    in_band = uptrend & (depth >= F.col("band_lo")) & (depth <= F.col("band_hi"))
    turned = F.col("turn_confirmed")
    dip = F.lit("buyable-dip-now") if trigger is None else F.when(turned.isNull(), "buyable-dip-now/turn-unconfirmable").when(turned, "buy-the-dip-turned").otherwise("wait-not-turned")
    label = F.when(high.isNull(), "no-match").when(in_band, dip).when(uptrend & (depth < F.col("band_lo")), "pullback-coming/wait").otherwise("no-match")
    why = F.when(high.isNull(), "no swing high is confirmed yet").when(label == "pullback-coming/wait", "close to the high, not as deep as its usual dips")
    return s.select(
        "symbol", F.col("now.ts").alias("ts"), close.alias("close"), high.alias("live_high"), depth.alias("now_off_high"), low.alias("live_low"), F.col("dip.ts").alias("live_low_ts"), F.col("dip.idx").alias("live_low_idx"),
        F.col("top.idx").alias("high_idx"), ((high - low) / high * 100).alias("live_low_dip"), "floor_price", F.coalesce(low, F.col("floor_price")).alias("near_term_invalidation"), "n_events", "band_lo", "band_hi", "success_rate",
        uptrend.alias("uptrend"), *_UNJUDGED, label.alias("state"), why.alias("why"),
    )


def learned_horizon(events: DataFrame, base: int = HORIZON, share: float = 0.75, low_days: float = CLAMP_DAYS[0], high_days: float = CLAMP_DAYS[1]) -> DataFrame:
    """``symbol, horizon_bars, horizon_days, clamped, learned``: the bars that ``share`` of a symbol's winners need, clamped to
    ``low_days``..``high_days``; the base where fewer than five are known."""
    h = events.where("success").groupBy("symbol").agg(F.count("*").alias("n"), F.percentile("bars_to_win", share).alias("h"))
    low, high, need = round(low_days * BARS_PER_DAY), int(high_days * BARS_PER_DAY), F.ceil("h")
    learned = F.col("n") >= MIN_WINNERS
    h = h.withColumns({"learned": learned, "horizon_bars": F.when(learned, F.least(F.greatest(need, F.lit(low)), F.lit(high))).otherwise(base).cast("int"), "clamped": learned & ((need < low) | (need > high))})
    return h.select("symbol", "horizon_bars", (F.col("horizon_bars") / BARS_PER_DAY).alias("horizon_days"), "clamped", "learned")


def bounces(events: DataFrame, bars: DataFrame, horizon: DataFrame, base: int = HORIZON) -> DataFrame:
    """``symbol, bounce_base, bounce_learned, delta``: the share of events that succeed within the base horizon and within the
    symbol's own one."""
    longest = int(CLAMP_DAYS[1] * BARS_PER_DAY)
    plain = [c for c in events.columns if c not in ("success", "bars_to_win")]
    told = with_outcome(events.select(*plain), bars, horizon=longest).join(horizon.select("symbol", "horizon_bars"), "symbol", "left")
    within = lambda h: F.avg(F.when(F.col("success") & (F.col("bars_to_win") <= h), 1).otherwise(0))
    rate = told.groupBy("symbol").agg(within(F.lit(base)).alias("bounce_base"), within(F.coalesce("horizon_bars", F.lit(base))).alias("bounce_learned"))
    return rate.withColumn("delta", F.col("bounce_learned") - F.col("bounce_base"))


def volume_fade(bars: DataFrame, state: DataFrame) -> DataFrame:
    """``symbol, vol_fade_ratio, fading``: mean volume from the last high to the live low against that of as many bars before
    the high; it fades below 1. Null without a dip or without volume."""
    spans = state.where("live_low_idx IS NOT NULL").select("symbol", "high_idx", "live_low_idx", (F.col("live_low_idx") - F.col("high_idx")).alias("n"))
    b = bars.select("symbol", "idx", "volume").join(spans, "symbol")
    fall = F.avg(F.when((F.col("idx") > F.col("high_idx")) & (F.col("idx") <= F.col("live_low_idx")), F.col("volume")))
    rise = F.avg(F.when((F.col("idx") <= F.col("high_idx")) & (F.col("idx") > F.col("high_idx") - F.col("n")), F.col("volume")))
    ratio = b.groupBy("symbol").agg(F.try_divide(fall, rise).alias("vol_fade_ratio"))
    return ratio.withColumn("fading", F.col("vol_fade_ratio") < 1)


def recovery_class(bars_needed: F.Column) -> F.Column:
    """Fast up to three days of bars, slow from 36 bars on."""
    return F.when(bars_needed <= 21, "fast").when(bars_needed <= 35, "medium").otherwise("slow")


def tier(row: DataFrame) -> DataFrame:
    """``row`` (state columns and ``recovery``) with its tier; rules apply in this order. What is to be bought or waited for has an
    intact uptrend and lies inside the symbol's own band, by the close or by the live low; what is deeper is a thin edge,
    and a broken trend is as much a caution as a low under the floor."""
    dip = F.greatest(F.col("now_off_high"), F.col("live_low_dip"))
    within = lambda c: F.coalesce(F.col(c).between(F.col("band_lo"), F.col("band_hi")), F.lit(False))
    rule = (
        F.when(dip > 1.5 * F.col("band_hi"), "AVOID").when((F.col("live_low") < F.col("floor_price")) | ~F.coalesce("uptrend", F.lit(False)), "CAUTION")
        .when((F.col("now_off_high") <= 0) | (F.col("now_off_high") < F.col("band_lo")), "WATCH").when(~(within("now_off_high") | within("live_low_dip")), "SPEC").when(F.col("turn_confirmed").isNull(), "SPEC")
        .when(~F.col("turn_confirmed"), "WAIT").when(F.coalesce("bounce_base", F.lit(0.0)) < 0.5, "SPEC").when(F.col("recovery") == "slow", "PATIENT").otherwise("BUY")
    )
    return row.withColumn("tier", rule)


def screen_rows(bars: DataFrame) -> DataFrame:
    """``with_indicators`` bars (``PULLBACK_COLUMNS``) to one row a symbol with its state, learned trigger and horizon, bounces, fading
    volume and tier."""
    zz = zigzag(fractal_pivots(bars))
    events = written(with_outcome(with_anchor(pullback_events(zz), bars), bars), "events")
    state = written(current_state(bars, zz, signature(events), turn_trigger(events, bars)), "state")
    horizon = learned_horizon(events)
    rows = state.join(horizon, "symbol", "left").join(bounces(events, bars, horizon), "symbol", "left").join(volume_fade(bars, state), "symbol", "left")
    return tier(rows.withColumn("recovery", recovery_class(F.col("horizon_bars"))))


def choppiness(bars: DataFrame, n: int = 14) -> DataFrame:
    """``symbol, choppiness, k`` at the last bar: 100 log10(sum of true ranges / range of ``n`` bars) / log10(n),
    and the pivot half-width we take for it: 4 in a trend, 8 in a choppy series, 6 between the usual bounds."""
    last = F.lag("close").over(_series())
    span = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - last), F.abs(F.col("low") - last))
    w = _series().rowsBetween(1 - n, 0)
    b = bars.withColumn("__tr", span).withColumns({"__sum": F.sum("__tr").over(w), "__range": F.max("high").over(w) - F.min("low").over(w), "__n": F.count("*").over(w)})
    ends = b.where(F.col("__n") == n).groupBy("symbol").agg(F.max_by(F.struct("__sum", "__range"), "idx").alias("e"))
    value = F.log10(F.try_divide("e.__sum", "e.__range")) * 100 / F.log10(F.lit(float(n)))
    ends = ends.select("symbol", value.alias("choppiness"))
    return ends.withColumn("k", F.when(F.col("choppiness") < 38.2, 4).when(F.col("choppiness") > 61.8, 8).otherwise(6).cast("long"))


def shortlists(bars: DataFrame, windows: tuple[int, ...] = (60, 120, 240), least: float = 3.0) -> DataFrame:
    """``w, symbol``: symbols whose last close lies ``least`` percent or more under the highest high of the last
    ``w`` bars and above their longest average."""
    w = lambda n: F.max("high").over(_series().rowsBetween(1 - n, 0)).alias("high")
    tops = F.array(*[F.struct(F.lit(n).cast("long").alias("w"), w(n)) for n in windows])
    ends = bars.select("symbol", "idx", "close", "ema_200", tops.alias("tops")).groupBy("symbol").agg(F.max_by(F.struct("close", "ema_200", "tops"), "idx").alias("e"))
    e = ends.select("symbol", "e.close", "e.ema_200", F.inline("e.tops"))
    return e.where((F.try_divide(F.col("high") - F.col("close"), F.col("high")) * 100 >= least) & (F.col("close") > F.col("ema_200"))).select("w", "symbol")


def calibrated_window(lists: DataFrame, windows: tuple[int, ...] = (60, 120, 240), least: float = 0.5) -> DataFrame:
    """``mode, overlap, W_used, shortlist`` in one row: stable if the lists of all windows share ``least`` of their symbols on
    average, which then keeps the middle window's list; otherwise sensitive, and the list is that of all windows."""
    overlap = shortlist_overlap(lists).agg(F.coalesce(F.avg("overlap"), F.lit(0.0)).alias("overlap"))
    middle = windows[len(windows) // 2]
    named = lists.agg(F.array_sort(F.collect_set(F.when(F.col("w") == middle, F.col("symbol")))).alias("one"), F.array_sort(F.collect_set("symbol")).alias("every"))
    stable = F.col("overlap") >= least
    row = overlap.join(F.broadcast(named))  # one row each
    used = F.when(stable, F.array(F.lit(middle).cast("long"))).otherwise(F.array(*[F.lit(w).cast("long") for w in windows]))
    return row.select(F.when(stable, "stable").otherwise("sensitive").alias("mode"), "overlap", used.alias("W_used"), F.when(stable, F.col("one")).otherwise(F.col("every")).alias("shortlist"))


def shortlist_overlap(lists: DataFrame, window: str = "w", symbol: str = "symbol") -> DataFrame:
    """Jaccard overlap of the symbol lists of each two windows."""
    sets = lists.groupBy(window).agg(F.collect_set(symbol).alias("s"))
    a, b = sets.alias("a"), sets.alias("b")
    pair = a.join(b, F.col(f"a.{window}") < F.col(f"b.{window}"))  # a handful of windows
    inter, union = F.size(F.array_intersect("a.s", "b.s")), F.size(F.array_union("a.s", "b.s"))
    return pair.select(F.col(f"a.{window}").alias("w_a"), F.col(f"b.{window}").alias("w_b"), F.try_divide(inter, union).alias("overlap"))
