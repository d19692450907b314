"""DuckDB SQL of the engine's queries, written independently of the Spark plans."""

from __future__ import annotations

DAILY = """SELECT c_mktsegment AS symbol, o_orderdate AS ts, arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low,
 arg_max(o_totalprice, o_orderkey) AS close, CAST(count(*) AS BIGINT) AS volume FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2"""
HOURLY = """SELECT event_type AS symbol, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS ts, arg_min(value, struct_pack(t := ts, e := event_id)) AS open, max(value) AS high, min(value) AS low,
 arg_max(value, struct_pack(t := ts, e := event_id)) AS close, CAST(count(*) AS BIGINT) AS volume FROM events GROUP BY event_type, CAST(date_trunc('hour', ts) AS TIMESTAMP)"""


def resample(unit: str) -> str:
    return f"""SELECT symbol, CAST(date_trunc('{unit}', ts) AS TIMESTAMP) AS ts, arg_min(open, b.ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, b.ts) AS close,
 CAST(sum(volume) AS BIGINT) AS volume FROM ({DAILY}) b GROUP BY symbol, CAST(date_trunc('{unit}', b.ts) AS TIMESTAMP)"""


def _step(start: int, seed: str, a: str, b: str, x: str, name: str) -> str:
    return f"CASE WHEN f.idx < {start} THEN NULL WHEN f.idx = {start} THEN {seed} ELSE {a} * r.{name} + {b} * {x} END AS {name}"


def _mean(x: str, n: int) -> str:
    return f"avg({x}) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


_STATES = {f"ema_{n}": (n - 1, f"m{n}", f"({n - 1}.0 / {n + 1})", f"(2.0 / {n + 1})", "f.close") for n in (10, 20, 50, 100, 200)}
_STATES |= {"fast": (25, "m12", "(11.0 / 13)", "(2.0 / 13)", "f.close"), "slow": (25, "m26", "(25.0 / 27)", "(2.0 / 27)", "f.close"), "volume_ema_20": (19, "mv", "(19.0 / 21)", "(2.0 / 21)", "f.volume")}
_STATES |= {n: (14, f"m_{n}", "(13.0 / 14)", "(1.0 / 14)", f"f.x_{n}") for n in ("gain", "loss", "tr")}
_STATES |= {f"w_{n}": (13, f"s_{n}", "(13.0 / 14)", "1.0", f"f.x_{n}") for n in ("tr", "pdm", "mdm")}

#: Common table expressions up to ``ind``: every bar with its index and indicators, null before they start.
INDICATORS = f"""RECURSIVE d AS ({DAILY}),
b0 AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS idx, lag(close) OVER w AS c1, lag(high) OVER w AS h1, lag(low) OVER w AS l1, lag(close, 20) OVER w AS c20 FROM d WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
b1 AS (SELECT *, CASE WHEN idx = 0 THEN 0 ELSE greatest(close - c1, 0) END AS x_gain, CASE WHEN idx = 0 THEN 0 ELSE greatest(c1 - close, 0) END AS x_loss,
 CASE WHEN idx = 0 THEN 0 ELSE greatest(high - low, abs(high - c1), abs(low - c1)) END AS x_tr, CASE WHEN idx > 0 AND high - h1 > l1 - low AND high - h1 > 0 THEN high - h1 ELSE 0 END AS x_pdm,
 CASE WHEN idx > 0 AND l1 - low > high - h1 AND l1 - low > 0 THEN l1 - low ELSE 0 END AS x_mdm, CASE WHEN idx = 0 THEN volume WHEN close > c1 THEN volume WHEN close < c1 THEN -volume ELSE 0 END AS flow FROM b0),
f AS MATERIALIZED (SELECT *, {", ".join(f"{_mean('close', n)} AS m{n}" for n in (10, 12, 20, 26, 50, 100, 200))}, {_mean('volume', 20)} AS mv, {", ".join(f"{_mean('x_' + n, 14)} AS m_{n}" for n in ("gain", "loss", "tr"))},
 {", ".join(f"sum(x_{n}) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS s_{n}" for n in ("tr", "pdm", "mdm"))},
 stddev_pop(close) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS sd, CAST(sum(flow) OVER (PARTITION BY symbol ORDER BY ts) AS DOUBLE) AS obv,
 max(high) OVER (PARTITION BY symbol ORDER BY ts RANGE BETWEEN INTERVAL 365 DAY PRECEDING AND CURRENT ROW) AS trailing_365d_high,
 min(low) OVER (PARTITION BY symbol ORDER BY ts RANGE BETWEEN INTERVAL 365 DAY PRECEDING AND CURRENT ROW) AS trailing_365d_low FROM b1),
r AS (SELECT symbol, idx, {", ".join(f"CAST(NULL AS DOUBLE) AS {n}" for n in _STATES)} FROM f WHERE idx = 0
 UNION ALL SELECT f.symbol, f.idx, {", ".join(_step(s, seed, a, b, x, n) for n, (s, seed, a, b, x) in _STATES.items())} FROM r JOIN f ON f.symbol = r.symbol AND f.idx = r.idx + 1),
i1 AS (SELECT f.*, r.* EXCLUDE (symbol, idx), CASE WHEN f.idx >= 14 THEN CASE WHEN w_tr = 0 THEN 0 ELSE 100 * w_pdm / w_tr END END AS plus_di_14, CASE WHEN f.idx >= 14 THEN CASE WHEN w_tr = 0 THEN 0 ELSE 100 * w_mdm / w_tr END END AS minus_di_14,
 fast - slow AS macd FROM f JOIN r ON f.symbol = r.symbol AND f.idx = r.idx),
i2 AS (SELECT *, coalesce(last_value(CASE WHEN plus_di_14 + minus_di_14 <> 0 THEN 100 * abs(plus_di_14 - minus_di_14) / (plus_di_14 + minus_di_14) END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS dx FROM i1),
i3 AS MATERIALIZED (SELECT *, {_mean('dx', 14)} AS mdx, {_mean('macd', 9)} AS mmacd FROM i2),
r2 AS (SELECT symbol, idx, CAST(NULL AS DOUBLE) AS sig, CAST(NULL AS DOUBLE) AS adx FROM i3 WHERE idx = 0
 UNION ALL SELECT f.symbol, f.idx, {_step(33, "mmacd", "0.8", "0.2", "f.macd", "sig")}, {_step(27, "mdx", "(13.0 / 14)", "(1.0 / 14)", "f.dx", "adx")} FROM r2 AS r JOIN i3 AS f ON f.symbol = r.symbol AND f.idx = r.idx + 1),
ind AS (SELECT i3.symbol, ts, open, high, low, close, volume, i3.idx, ema_10, ema_20, ema_50, ema_100, ema_200, volume_ema_20, CASE WHEN volume_ema_20 <> 0 THEN volume / volume_ema_20 END AS relative_volume_20,
 CASE WHEN gain IS NOT NULL THEN CASE WHEN gain + loss = 0 THEN 0 ELSE 100 * gain / (gain + loss) END END AS rsi_14, tr AS atr_14, tr / close * 100 AS atr_percent_14, CASE WHEN i3.idx >= 33 THEN macd END AS macd_12_26, sig AS macd_signal_9, macd - sig AS macd_histogram,
 adx AS adx_14, plus_di_14, minus_di_14, CASE WHEN i3.idx >= 19 THEN ema_20 + 2 * sd END AS band_upper_20_2, ema_20 AS band_middle_20, CASE WHEN i3.idx >= 19 THEN ema_20 - 2 * sd END AS band_lower_20_2, CASE WHEN i3.idx >= 19 THEN 4 * sd / ema_20 * 100 END AS band_width_20_2,
 CASE WHEN i3.idx >= 20 THEN CASE WHEN c20 = 0 THEN 0 ELSE (close / c20 - 1) * 100 END END AS roc_20, obv, trailing_365d_high, trailing_365d_low, (close / trailing_365d_high - 1) * 100 AS distance_from_365d_high_percent
 FROM i3 JOIN r2 ON i3.symbol = r2.symbol AND i3.idx = r2.idx)"""

#: From pivots (half-width 6) to events, outcomes and what was learned.
PIVOTS = """p0 AS (SELECT symbol, idx, ts, high, low, count(*) OVER (w ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING) AS n, max(high) OVER (w ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS hl, max(high) OVER (w ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING) AS hr,
 min(low) OVER (w ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS ll, min(low) OVER (w ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING) AS lr FROM ind WINDOW w AS (PARTITION BY symbol ORDER BY idx)),
piv AS (SELECT symbol, idx, ts, 'H' AS kind, high AS price FROM p0 WHERE n = 13 AND high > hl AND high >= hr UNION ALL SELECT symbol, idx, ts, 'L', low FROM p0 WHERE n = 13 AND low < ll AND low <= lr)"""
ZIGZAG = """z0 AS (SELECT *, CASE WHEN kind <> lag(kind) OVER (PARTITION BY symbol ORDER BY idx, kind) THEN 1 ELSE 0 END AS nw FROM piv),
z1 AS (SELECT *, sum(nw) OVER (PARTITION BY symbol ORDER BY idx, kind) AS run FROM z0),
zz AS (SELECT symbol, CAST(run AS BIGINT) AS run, idx, ts, kind, price FROM z1 QUALIFY row_number() OVER (PARTITION BY symbol, run ORDER BY CASE WHEN kind = 'H' THEN -price ELSE price END, idx) = 1)"""
EVENTS = """e0 AS (SELECT symbol, lag(idx) OVER w AS high_idx, lag(price) OVER w AS high, idx AS low_idx, ts AS low_ts, kind, price AS low FROM zz WINDOW w AS (PARTITION BY symbol ORDER BY run)),
ev AS (SELECT symbol, high_idx, high, low_idx, low_ts, low, (high - low) / high * 100 AS depth_pct FROM e0 WHERE kind = 'L' AND high IS NOT NULL)"""
ANCHOR = """gaps AS (SELECT ev.symbol, ev.low_idx, atr_14, u.n, abs(ev.low - u.e) AS gap FROM ev JOIN ind ON ind.symbol = ev.symbol AND ind.idx = ev.low_idx, (VALUES (10), (20), (50), (100), (200)) AS t(k), LATERAL (SELECT k AS n, CASE k WHEN 10 THEN ema_10 WHEN 20 THEN ema_20 WHEN 50 THEN ema_50 WHEN 100 THEN ema_100 ELSE ema_200 END AS e) u),
anc AS (SELECT ev.symbol, ev.low_idx, coalesce(max(CASE WHEN g.gap <= g.atr_14 THEN 'ema_' || g.n END), 'none') AS anchor FROM ev LEFT JOIN (SELECT * FROM gaps WHERE gap IS NOT NULL QUALIFY row_number() OVER (PARTITION BY symbol, low_idx ORDER BY gap, n) = 1) g ON g.symbol = ev.symbol AND g.low_idx = ev.low_idx GROUP BY 1, 2)"""
OUTCOME = """o0 AS (SELECT ev.symbol, ev.low_idx, min(CASE WHEN b.high >= (ev.high + ev.low) / 2 THEN b.idx END) AS won, min(CASE WHEN b.low <= ev.low * 0.97 THEN b.idx END) AS lost FROM ev LEFT JOIN ind b ON b.symbol = ev.symbol AND b.idx > ev.low_idx AND b.idx <= ev.low_idx + 15 GROUP BY 1, 2),
evs AS (SELECT ev.*, anc.anchor, (won IS NOT NULL AND (lost IS NULL OR won < lost)) AS success, CASE WHEN won IS NOT NULL AND (lost IS NULL OR won < lost) THEN won - ev.low_idx END AS bars_to_win FROM ev JOIN anc USING (symbol, low_idx) JOIN o0 USING (symbol, low_idx))"""
TRIGGER = """t0 AS (SELECT *, CASE WHEN close > lag(high) OVER (PARTITION BY symbol ORDER BY idx) THEN idx END AS thrust FROM ind),
t1 AS (SELECT symbol, idx, min(thrust) OVER (PARTITION BY symbol ORDER BY idx ROWS BETWEEN 2 FOLLOWING AND UNBOUNDED FOLLOWING) AS t FROM t0),
t2 AS (SELECT evs.symbol, evs.low_idx, (b.close - evs.low) / a.atr_14 AS lift, b.idx - evs.low_idx AS lag, CASE WHEN evs.low < a.ema_200 AND b.close > b.ema_200 THEN 'ema_200' WHEN evs.low < a.ema_100 AND b.close > b.ema_100 THEN 'ema_100'
 WHEN evs.low < a.ema_50 AND b.close > b.ema_50 THEN 'ema_50' WHEN evs.low < a.ema_20 AND b.close > b.ema_20 THEN 'ema_20' WHEN evs.low < a.ema_10 AND b.close > b.ema_10 THEN 'ema_10' ELSE 'none' END AS reclaim
 FROM evs JOIN ind a ON a.symbol = evs.symbol AND a.idx = evs.low_idx JOIN t1 ON t1.symbol = evs.symbol AND t1.idx = evs.low_idx JOIN ind b ON b.symbol = evs.symbol AND b.idx = t1.t WHERE evs.success AND a.atr_14 > 0),
t3 AS (SELECT symbol, reclaim FROM (SELECT symbol, reclaim, count(*) AS c, min(low_idx) AS f FROM t2 GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY c DESC, f) = 1),
trg AS (SELECT symbol, CAST(count(*) AS BIGINT) AS n_winners, CASE WHEN count(*) >= 5 THEN median(lift) END AS lift, CASE WHEN count(*) >= 5 THEN any_value(t3.reclaim) END AS reclaim, CASE WHEN count(*) >= 5 THEN CAST(median(lag) AS DOUBLE) END AS lag FROM t2 JOIN t3 USING (symbol) GROUP BY symbol)"""
SIGNATURE = """g0 AS (SELECT symbol, anchor FROM (SELECT symbol, anchor, count(*) AS c, min(low_idx) AS f FROM evs GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY c DESC, f) = 1),
sig AS (SELECT symbol, CAST(count(*) AS BIGINT) AS n_events, quantile_cont(depth_pct, 0.25) AS band_lo, quantile_cont(depth_pct, 0.75) AS band_hi, avg(CAST(success AS INTEGER)) AS success_rate, CASE WHEN count(*) >= 5 THEN 'ok' ELSE 'low' END AS confidence, any_value(g0.anchor) AS anchor FROM evs JOIN g0 USING (symbol) GROUP BY symbol)"""

HORIZON = """hz AS (SELECT symbol, CAST(CASE WHEN count(*) >= 5 THEN least(greatest(ceil(quantile_cont(bars_to_win, 0.75)), 4), 70) ELSE 15 END AS INTEGER) AS horizon_bars,
 count(*) >= 5 AND (ceil(quantile_cont(bars_to_win, 0.75)) < 4 OR ceil(quantile_cont(bars_to_win, 0.75)) > 70) AS clamped, count(*) >= 5 AS learned FROM evs WHERE success GROUP BY symbol)"""
BOUNCES = """bo0 AS (SELECT ev.symbol, ev.low_idx, min(CASE WHEN b.high >= (ev.high + ev.low) / 2 THEN b.idx END) AS won, min(CASE WHEN b.low <= ev.low * 0.97 THEN b.idx END) AS lost FROM ev LEFT JOIN ind b ON b.symbol = ev.symbol AND b.idx > ev.low_idx AND b.idx <= ev.low_idx + 70 GROUP BY 1, 2),
bo1 AS (SELECT symbol, CASE WHEN won IS NOT NULL AND (lost IS NULL OR won < lost) THEN won - low_idx END AS bars FROM bo0),
bounce AS (SELECT bo1.symbol, avg(CASE WHEN bars <= 15 THEN 1 ELSE 0 END) AS bounce_base, avg(CASE WHEN bars <= coalesce(horizon_bars, 15) THEN 1 ELSE 0 END) AS bounce_learned FROM bo1 LEFT JOIN hz USING (symbol) GROUP BY bo1.symbol)"""
FADE = """fade AS (SELECT st.symbol, avg(b.volume) FILTER (WHERE b.idx > top_idx) / avg(b.volume) FILTER (WHERE b.idx <= top_idx) AS vol_fade_ratio FROM st JOIN ind b ON b.symbol = st.symbol AND b.idx <= dip_idx AND b.idx > 2 * top_idx - dip_idx GROUP BY st.symbol)"""
_AVERAGE = "CASE trg.reclaim WHEN 'ema_10' THEN {0}.ema_10 WHEN 'ema_20' THEN {0}.ema_20 WHEN 'ema_50' THEN {0}.ema_50 WHEN 'ema_100' THEN {0}.ema_100 WHEN 'ema_200' THEN {0}.ema_200 END"
STATE = f"""s_top AS (SELECT symbol, idx, price, run FROM zz WHERE kind = 'H' QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY run DESC) = 1),
s_floor AS (SELECT zz.symbol, zz.price AS floor_price FROM zz JOIN s_top t ON t.symbol = zz.symbol AND zz.run < t.run WHERE zz.kind = 'L' QUALIFY row_number() OVER (PARTITION BY zz.symbol ORDER BY zz.run DESC) = 1),
s_now AS (SELECT * FROM (SELECT *, lag(ema_50, 19) OVER (PARTITION BY symbol ORDER BY idx) AS before50 FROM ind) QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY idx DESC) = 1),
s_dip AS (SELECT ind.* FROM ind JOIN s_top t ON t.symbol = ind.symbol AND ind.idx > t.idx QUALIFY row_number() OVER (PARTITION BY ind.symbol ORDER BY ind.low, ind.idx) = 1),
s_all AS (SELECT n.symbol, n.ts, n.close, t.price AS live_high, (t.price - n.close) / t.price * 100 AS now_off_high, dip.low AS live_low, dip.ts AS live_low_ts, (t.price - dip.low) / t.price * 100 AS live_low_dip,
 floor_price, n_events, band_lo, band_hi, success_rate, trg.lift, n.atr_14 AS atr_now, dip.idx AS dip_idx, t.idx AS top_idx, coalesce(n.close > n.ema_50 AND n.ema_50 > n.before50, FALSE) AS uptrend, {_AVERAGE.format("dip")} AS line_then, {_AVERAGE.format("n")} AS line_now
 FROM s_now n LEFT JOIN s_top t ON t.symbol = n.symbol LEFT JOIN s_dip dip ON dip.symbol = n.symbol LEFT JOIN s_floor f ON f.symbol = n.symbol LEFT JOIN sig ON sig.symbol = n.symbol LEFT JOIN trg ON trg.symbol = n.symbol),
s_turn AS (SELECT *, CASE WHEN lift IS NOT NULL AND live_low IS NOT NULL AND atr_now <> 0 THEN (close - live_low) / atr_now END AS cur_lift, coalesce(live_low < line_then, FALSE) AS broke FROM s_all),
s_fired AS (SELECT *, cur_lift >= lift AS lifted, broke AND coalesce(close > line_now, FALSE) AS reclaimed FROM s_turn),
st AS (SELECT symbol, ts, close, live_high, now_off_high, live_low, live_low_ts, dip_idx, top_idx, live_low_dip, floor_price, coalesce(live_low, floor_price) AS near_term_invalidation, n_events, band_lo, band_hi, success_rate, uptrend, lifted OR reclaimed AS turn_confirmed,
 CASE WHEN lifted IS NOT NULL THEN array_to_string(list_filter([CASE WHEN lifted THEN 'lift' END, CASE WHEN reclaimed THEN 'reclaim' END], lambda x: x IS NOT NULL), ',') END AS turn_path, cur_lift,
 CASE WHEN lifted IS NOT NULL THEN broke END AS broke_ema, CASE WHEN lifted IS NOT NULL THEN live_low + lift * atr_now END AS trigger_lift_price, CASE WHEN lifted IS NOT NULL THEN line_now END AS trigger_ema_price,
 CASE WHEN live_high IS NULL THEN 'no-match' WHEN uptrend AND now_off_high BETWEEN band_lo AND band_hi THEN CASE WHEN lifted IS NULL THEN 'buyable-dip-now/turn-unconfirmable' WHEN lifted OR reclaimed THEN 'buy-the-dip-turned' ELSE 'wait-not-turned' END
  WHEN uptrend AND now_off_high < band_lo THEN 'pullback-coming/wait' ELSE 'no-match' END AS state,
 CASE WHEN NOT (lifted OR reclaimed) THEN least(live_low + lift * atr_now, line_now) END AS buy_trigger_price FROM s_fired)"""
TIERS = """tr0 AS (SELECT st.*, hz.horizon_bars, hz.clamped, hz.learned, bounce_base, bounce_learned, bounce_learned - bounce_base AS delta, vol_fade_ratio, CASE WHEN horizon_bars <= 21 THEN 'fast' WHEN horizon_bars <= 35 THEN 'medium' ELSE 'slow' END AS recovery
 FROM st LEFT JOIN hz USING (symbol) LEFT JOIN bounce USING (symbol) LEFT JOIN fade USING (symbol)),
tiered AS (SELECT *, CASE WHEN greatest(now_off_high, live_low_dip) > 1.5 * band_hi THEN 'AVOID' WHEN live_low < floor_price OR NOT coalesce(uptrend, FALSE) THEN 'CAUTION' WHEN now_off_high <= 0 OR now_off_high < band_lo THEN 'WATCH'
 WHEN NOT (coalesce(now_off_high BETWEEN band_lo AND band_hi, FALSE) OR coalesce(live_low_dip BETWEEN band_lo AND band_hi, FALSE)) OR turn_confirmed IS NULL THEN 'SPEC'
 WHEN NOT turn_confirmed THEN 'WAIT' WHEN coalesce(bounce_base, 0) < 0.5 THEN 'SPEC' WHEN recovery = 'slow' THEN 'PATIENT' ELSE 'BUY' END AS tier FROM tr0),
tier_order AS (SELECT tier, CAST(ord AS INTEGER) AS ord FROM (VALUES ('BUY', 0), ('PATIENT', 1), ('SPEC', 2), ('WAIT', 3), ('WATCH', 4), ('CAUTION', 5), ('AVOID', 6)) v(tier, ord))"""
TIER_COUNTS = "SELECT o.tier, CAST(count(t.tier) AS BIGINT) AS n, o.ord FROM tier_order o LEFT JOIN tiered t ON t.tier = o.tier GROUP BY o.tier, o.ord"
_NUMBER = r"regexp_replace(printf('%.{1}f', {0}), '(\.\d+?)0+$', '\1')"
_PRICE = "coalesce(" + _NUMBER.format("{0}", 2) + " || ' (' || printf('%.1f', ({0} / close - 1) * 100) || '%)', 'n/a')"
_LINE = (
    "symbol || CASE WHEN tier = 'CAUTION' THEN ' ⚠' ELSE '' END", "tier", "CAST(n_events AS VARCHAR)", "printf('%.1f–%.1f', band_lo, band_hi)", "printf('%.1f', now_off_high)", "coalesce(printf('%.1f', live_low_dip), 'n/a')",
    _NUMBER.format("round(bounce_base, 3)", 3), f"{_NUMBER.format('round(bounce_learned, 3)', 3)} || ' (' || CASE WHEN delta >= 0 THEN '+' ELSE '' END || {_NUMBER.format('round(delta, 3)', 3)} || ')'",
    "CASE WHEN learned THEN horizon_bars || '≈' || printf('%.1f', horizon_bars / 7.0) || 'd' || CASE WHEN clamped THEN '!' ELSE '' END ELSE '—(base 15)' END", "recovery",
    f"CASE WHEN turn_confirmed THEN '✓(' || turn_path || ')' WHEN NOT turn_confirmed THEN coalesce('— ₹' || {_NUMBER.format('buy_trigger_price', 2)}, '—') ELSE 'n/a' END",
    f"coalesce({_NUMBER.format('vol_fade_ratio', 2)} || CASE WHEN vol_fade_ratio < 1 THEN '✓' ELSE '' END, 'n/a')", *[_PRICE.format(c) for c in ("live_high", "live_low", "floor_price")], "strftime(ts, '%Y-%m-%d %H:%M')",
)
SCREEN_LINES = f"""SELECT CAST(row_number() OVER (ORDER BY o.ord, bounce_base DESC NULLS LAST, (recovery = 'slow') NULLS LAST, abs(delta) NULLS LAST, NOT coalesce(vol_fade_ratio < 1, FALSE), now_off_high DESC NULLS LAST, symbol) AS INTEGER) AS place, CAST(o.ord + 1 AS BIGINT) AS tier_ord, round(bounce_base + 1e-7, 4) AS bounce_base, symbol, '| ' || {" || ' | ' || ".join(f"coalesce({c}, '')" for c in _LINE)} || ' |' AS line FROM tiered JOIN tier_order o USING (tier)"""

#: Formations from the last seven pivots: name, test, upward, confirmation level, invalidation level.
_FORMATIONS = (
    ("double-bottom", "neck_up > greatest(bottom_a, bottom_b) + 2 * tol", True, "neck_up", "least(bottom_a, bottom_b) - tol"),
    ("double-top", "neck_down < least(top_a, top_b) - 2 * tol", False, "neck_down", "greatest(top_a, top_b) + tol"),
    ("head-and-shoulders", "abs(h1 - h3) <= tol AND h2 > greatest(h1, h3) + tol", False, "least(l1, l2)", "h2"),
    ("inverse-head-and-shoulders", "abs(l1 - l3) <= tol AND l2 < least(l1, l3) - tol", True, "greatest(h1, h2)", "l2"),
    ("ascending-triangle", "flat_h AND l1 > l2 + tol / 2", True, "greatest(h1, h2)", "l1"),
    ("descending-triangle", "flat_l AND h1 < h2 - tol / 2", False, "least(l1, l2)", "h1"),
    ("symmetrical-triangle", "h1 < h2 - tol / 2 AND l1 > l2 + tol / 2", True, "h1", "l1"),
    ("ascending-channel", "rising", True, "h1", "l1"),
    ("descending-channel", "falling", False, "l1", "h1"),
    ("horizontal-range", "flat_h AND flat_l AND h2 - greatest(l1, l2) > 3 * tol", True, "greatest(h1, h2)", "least(l1, l2)"),
)


def _formation(k: int, name: str, test: str, up: bool, confirm: str, fail: str, keys: str, source: str) -> str:
    over, under = (">", "<") if up else ("<", ">")
    status = f"CASE WHEN close {over} {confirm} THEN 'confirmed' WHEN close {under} {fail} THEN 'invalidated' ELSE 'developing' END"
    return f"SELECT {keys}, {k} AS k, '{name}' AS name, {status} AS status, {confirm} AS confirmation_level, {fail} AS invalidation_level FROM {source} WHERE {test}"


def _read(p: str, pivots: str, keys: str, close: str) -> str:
    """CTEs ``{p}2`` (levels and flags) and ``{p}3`` (a row per formation) from seven pivots per ``keys``."""
    return f"""{p}0 AS (SELECT *, row_number() OVER (PARTITION BY {keys}, kind ORDER BY run DESC) AS nth FROM ({pivots})),
{p}1 AS (SELECT {keys}, {", ".join(f"max(price) FILTER (WHERE kind = '{k}' AND nth = {i}) AS {k.lower()}{i}" for k in "HL" for i in (1, 2, 3))}, max(price) FILTER (WHERE kind = 'H') AS top, min(price) FILTER (WHERE kind = 'L') AS bottom, arg_max(kind, run) AS last_kind FROM {p}0 GROUP BY {keys}),
{p}2 AS (SELECT *, abs(h1 - h2) <= tol AS flat_h, abs(l1 - l2) <= tol AS flat_l, h1 - h2 > tol AND l1 - l2 > tol AS rising, h2 - h1 > tol AND l2 - l1 > tol AS falling,
 CASE WHEN abs(l1 - l2) <= tol THEN l1 WHEN abs(l2 - l3) <= tol AND l1 > greatest(l2, l3) THEN l2 END AS bottom_a, CASE WHEN abs(l1 - l2) <= tol THEN l2 WHEN abs(l2 - l3) <= tol AND l1 > greatest(l2, l3) THEN l3 END AS bottom_b,
 CASE WHEN abs(l1 - l2) <= tol THEN CASE WHEN last_kind = 'L' THEN h1 ELSE h2 END WHEN abs(l2 - l3) <= tol AND l1 > greatest(l2, l3) THEN CASE WHEN last_kind = 'L' THEN h2 ELSE h3 END END AS neck_up,
 CASE WHEN abs(h1 - h2) <= tol THEN h1 WHEN abs(h2 - h3) <= tol AND h1 < least(h2, h3) THEN h2 END AS top_a, CASE WHEN abs(h1 - h2) <= tol THEN h2 WHEN abs(h2 - h3) <= tol AND h1 < least(h2, h3) THEN h3 END AS top_b,
 CASE WHEN abs(h1 - h2) <= tol THEN CASE WHEN last_kind = 'H' THEN l1 ELSE l2 END WHEN abs(h2 - h3) <= tol AND h1 < least(h2, h3) THEN CASE WHEN last_kind = 'H' THEN l2 ELSE l3 END END AS neck_down FROM (SELECT *, 0.12 * (top - bottom) AS tol FROM {p}1) JOIN ({close}) USING ({keys})),
{p}3 AS ({" UNION ALL ".join(_formation(k, *x, keys, p + "2") for k, x in enumerate(_FORMATIONS))})"""


_LAST_SEVEN = "SELECT * FROM zz QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY run DESC) <= 7"
_STRUCTURE = _read("c", _LAST_SEVEN, "symbol", "SELECT symbol, arg_max(close, ts) AS close FROM ind GROUP BY symbol")
STRUCTURE = f"""{_STRUCTURE}
SELECT c2.symbol, CASE WHEN rising THEN 'bullish' WHEN falling THEN 'bearish' ELSE 'sideways' END AS trend, CASE WHEN rising THEN 'higher-highs-higher-lows' WHEN falling THEN 'lower-highs-lower-lows' ELSE 'mixed' END AS swing_sequence,
 coalesce(last_value(c3.name) OVER (PARTITION BY c2.symbol ORDER BY c3.k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 'none') AS formation, CASE WHEN close > top OR close < bottom THEN 'breakout' ELSE 'inside' END AS breakout_state,
 c3.name, c3.status, round(confirmation_level + 1e-7, 4) AS confirmation_level, round(invalidation_level + 1e-7, 4) AS invalidation_level FROM c2 LEFT JOIN c3 ON c3.symbol = c2.symbol"""
_PAST = "SELECT z.symbol, z.run AS end_run, m.run, m.kind, m.price FROM zz z JOIN zz m ON m.symbol = z.symbol AND m.run BETWEEN z.run - 6 AND z.run WHERE z.run >= 6"
#: Windows of seven pivots that show the formation of the last one, non-overlapping, with what followed.
HISTORY = f"""{_STRUCTURE},
{_read("y", _PAST, "symbol, end_run", "SELECT z.symbol, z.run AS end_run, i.close FROM zz z JOIN ind i ON i.symbol = z.symbol AND i.idx = z.idx")},
y4 AS (SELECT c3.symbol, arg_max(c3.name, c3.k) AS formation, any_value(s.now_start) AS now_start FROM c3 JOIN (SELECT symbol, min(idx) AS now_start FROM ({_LAST_SEVEN}) GROUP BY symbol) s ON s.symbol = c3.symbol GROUP BY c3.symbol),
y5 AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY s, e) AS k FROM (SELECT y4.symbol, y4.formation, b.idx AS s, a.idx AS e FROM y4 JOIN y3 ON y3.symbol = y4.symbol AND y3.name = y4.formation JOIN zz a ON a.symbol = y3.symbol AND a.run = y3.end_run AND a.idx < y4.now_start JOIN zz b ON b.symbol = a.symbol AND b.run = a.run - 6)),
y6 AS (SELECT symbol, k, s, e, TRUE AS taken, e AS upto, CAST(1 AS BIGINT) AS position FROM y5 WHERE k = 1
 UNION ALL SELECT y5.symbol, y5.k, y5.s, y5.e, y5.s > y6.upto, CASE WHEN y5.s > y6.upto THEN y5.e ELSE y6.upto END, y6.position + CASE WHEN y5.s > y6.upto THEN 1 ELSE 0 END FROM y6 JOIN y5 ON y5.symbol = y6.symbol AND y5.k = y6.k + 1),
past AS (SELECT y6.symbol, y4.formation, y6.position, y6.s AS window_start_index, y6.e AS window_end_index, r.return_5, r.return_10, r.return_20 FROM y6 JOIN y4 USING (symbol)
 JOIN (SELECT symbol, idx, {", ".join(f"(lead(close, {h}) OVER (PARTITION BY symbol ORDER BY idx) / close - 1) * 100 AS return_{h}" for h in (5, 10, 20))} FROM ind) r ON r.symbol = y6.symbol AND r.idx = y6.e WHERE y6.taken)"""
CHOPPINESS = """k0 AS (SELECT *, greatest(high - low, abs(high - lag(close) OVER (PARTITION BY symbol ORDER BY ts)), abs(low - lag(close) OVER (PARTITION BY symbol ORDER BY ts))) AS tr FROM ind),
k1 AS (SELECT symbol, ts, sum(tr) OVER w AS total, max(high) OVER w - min(low) OVER w AS span, count(*) OVER w AS n FROM k0 WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)),
chop AS (SELECT symbol, 100 * log10(total / span) / log10(14) AS choppiness FROM k1 WHERE n = 14 QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1)
SELECT symbol, round(choppiness + 1e-7, 4) AS choppiness, CAST(CASE WHEN choppiness < 38.2 THEN 4 WHEN choppiness > 61.8 THEN 8 ELSE 6 END AS BIGINT) AS k FROM chop"""
SHORTLIST = """w0 AS (SELECT symbol, close, ema_200, [{'w': 60, 'high': max(high) OVER (o ROWS 59 PRECEDING)}, {'w': 120, 'high': max(high) OVER (o ROWS 119 PRECEDING)}, {'w': 240, 'high': max(high) OVER (o ROWS 239 PRECEDING)}] AS tops
 FROM ind WINDOW o AS (PARTITION BY symbol ORDER BY idx) QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY idx DESC) = 1),
sl AS (SELECT CAST(t.w AS BIGINT) AS w, symbol FROM (SELECT symbol, close, ema_200, unnest(tops) AS t FROM w0) WHERE (t.high - close) / t.high * 100 >= 3 AND close > ema_200)"""
OVERLAP = """SELECT a.w AS w_a, b.w AS w_b, len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))) AS overlap FROM (SELECT w, list(symbol) AS s FROM sl GROUP BY w) a JOIN (SELECT w, list(symbol) AS s FROM sl GROUP BY w) b ON a.w < b.w"""
CALIBRATED = f"""SELECT CASE WHEN overlap >= 0.5 THEN 'stable' ELSE 'sensitive' END AS mode, round(overlap + 1e-7, 4) AS overlap, CASE WHEN overlap >= 0.5 THEN '120' ELSE '60,120,240' END AS W_used,
 coalesce((SELECT string_agg(DISTINCT symbol, ',' ORDER BY symbol) FROM sl WHERE overlap < 0.5 OR w = 120), '') AS shortlist FROM (SELECT coalesce(avg(overlap), 0.0) AS overlap FROM ({OVERLAP}))"""

_LISTS = {"shape": ("open", "high", "low", "close", "ema_20"), "vol": ("rv", "va", "flow"), "candle": ("body", "up", "down", "span"), "mom": ("rsi_14", "roc_20"), "strength": ("adx_14", "plus_di_14", "minus_di_14"), "yearly": ("distance_from_365d_high_percent",)}
_CALLS = {name: "flatten([" + ", ".join(f"list({c}) OVER v" for c in columns) + "])" for name, columns in _LISTS.items()}
_REGIMES = ("direction", "side_50", "side_200", "volatility", "yearly_regime")
#: Windows of ten bars with their context and six vectors, distances to the latest, then greedy choice.
SIMILAR = f"""m0 AS (SELECT *, coalesce(relative_volume_20, 0) AS rv, coalesce(volume_ema_20 / lag(volume_ema_20) OVER w, 1) AS va, sign(close - lag(close) OVER w) * coalesce(relative_volume_20, 0) AS flow, (close - open) / atr_14 AS body,
 (high - greatest(open, close)) / atr_14 AS up, (least(open, close) - low) / atr_14 AS down, (high - low) / atr_14 AS span, {", ".join(f"(lead(close, {h}) OVER w / close - 1) * 100 AS return_{h}" for h in (5, 10, 20, 30))} FROM ind WINDOW w AS (PARTITION BY symbol ORDER BY idx)),
m1 AS (SELECT *, min(idx) OVER v AS first_idx, count(*) OVER v AS n, {", ".join(f"{x} AS {n}" for n, x in _CALLS.items())} FROM m0 WINDOW v AS (PARTITION BY symbol ORDER BY idx ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)),
m2 AS (SELECT m1.symbol, idx, first_idx, ts, return_5, return_10, return_20, return_30, list_transform(shape, lambda x: x / close - 1) AS shape, vol, list_append(candle, atr_percent_14) AS candle, list_transform(mom, lambda x: x / 100) AS mom, list_transform(strength, lambda x: x / 100) AS strength,
 list_transform(yearly, lambda x: x / 100) AS yearly, CASE WHEN plus_di_14 > minus_di_14 THEN 'up' ELSE 'down' END AS direction, close > ema_50 AS side_50, close > ema_200 AS side_200, CASE WHEN atr_percent_14 <= lo THEN 'low' WHEN atr_percent_14 <= hi THEN 'middle' ELSE 'high' END AS volatility,
 CASE WHEN distance_from_365d_high_percent >= -10 THEN 'near-high' WHEN distance_from_365d_high_percent >= -30 THEN 'middle' ELSE 'far' END AS yearly_regime
 FROM m1 JOIN (SELECT symbol, quantile_cont(atr_percent_14, 1 / 3.0) AS lo, quantile_cont(atr_percent_14, 2 / 3.0) AS hi FROM ind GROUP BY symbol) c ON c.symbol = m1.symbol WHERE n = 10 AND ema_200 IS NOT NULL),
m3 AS (SELECT a.*, {", ".join(f"list_distance(a.{n}, z.{n}) / sqrt(len(a.{n})) AS d_{n}" for n in _LISTS)} FROM m2 a JOIN (SELECT * FROM m2 QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY idx DESC) = 1) z
 ON z.symbol = a.symbol AND a.idx < z.first_idx AND {" AND ".join(f"a.{r} = z.{r}" for r in _REGIMES)}),
m4 AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY combined_distance, first_idx, idx) AS k FROM (SELECT *, ({" + ".join(f"d_{n}" for n in _LISTS)}) / 6 AS combined_distance FROM m3)),
m5 AS (SELECT symbol, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS taken, FALSE AS hit FROM (SELECT DISTINCT symbol FROM m4)
 UNION ALL SELECT symbol, k, CASE WHEN free THEN list_append(taken, idx) ELSE taken END, free FROM (SELECT m4.symbol, m4.k, m4.idx, m5.taken, len(list_filter(m5.taken, lambda t: abs(t - m4.idx) < 10)) = 0 AND len(m5.taken) < 200 AS free FROM m5 JOIN m4 ON m4.symbol = m5.symbol AND m4.k = m5.k + 1)),
alike AS (SELECT m4.symbol, len(m5.taken) AS position, first_idx, idx, ts, combined_distance, d_shape AS chart_shape_distance, return_5, return_10, return_20, return_30 FROM m4 JOIN m5 ON m5.symbol = m4.symbol AND m5.k = m4.k WHERE m5.hit)"""


def chain(*parts: str) -> str:
    return "WITH " + ",\n".join((INDICATORS, *parts)) + "\n"
