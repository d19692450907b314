"""Registered queries of the engine and their DuckDB counterparts."""

from __future__ import annotations

import uuid
from datetime import datetime
from zoneinfo import ZoneInfo

from pyspark.sql import functions as F

from barloom.functions import calendar
from barloom.functions.blocks import micros
from barloom.functions.indicators import EMA_LENGTHS, INDICATOR_COLUMNS, STATE_COLUMNS, block_ends, indicator_table, with_indicators
from barloom.operators import normalize, pullback, screen, similarity, structure, validate, windows
from barloom.plans import oracle as sql
from barloom.plans import update
from barloom.sources import bars, csv, store, vendor
from barloom.sources.landing import Landing
from barloom.sources.shared import finished, shared_dir, written
from barloom.streaming.bars import stream_bars

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
NOW = "1998-06-10 15:00:00"
PIVOT_CHAIN = (sql.PIVOTS,)
EVENT_CHAIN = (sql.PIVOTS, sql.ZIGZAG, sql.EVENTS)
LEARN_CHAIN = (*EVENT_CHAIN, sql.ANCHOR, sql.OUTCOME)


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLE_SQL[name] = oracle
        return f

    return add


def _own(make):
    """A query that keeps no table but its result."""
    return lambda s, d: finished(s, lambda: make(s, d), "result")


#: Averages of prices in cents end in exact halves of the last kept digit; both sides round them up.
HALF = 1e-7


def _rounded(df, columns, plain=("symbol", "ts")):
    return df.select(*plain, *[F.round(F.col(c) + HALF, 4).alias(c) for c in columns])


def _rounded_sql(source: str, columns, plain="symbol, ts", where="TRUE") -> str:
    return f"SELECT {plain}, {', '.join(f'round({c} + 1e-7, 4) AS {c}' for c in columns)} FROM {source} WHERE {where}"


# Bars

query("ohlcv_daily", sql.DAILY)(bars.daily)
query("ohlcv_hourly", sql.HOURLY)(bars.hourly)
for _name, _unit in (("weekly", "week"), ("monthly", "month"), ("quarterly", "quarter")):
    query(f"resample_{_name}", sql.resample(_unit))(lambda s, d, u=_unit: bars.resample(bars.daily(s, d), u))


@query("stream_bars", sql.HOURLY)
def _stream_bars(spark, sf_dir):
    events = bars.table(spark, sf_dir, "events")
    ticks = events.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"), F.col("event_id").alias("seq"))
    return stream_bars(ticks).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


# Indicators

SINGLE = {
    **{f"ema_{n}": (f"ema_{n}",) for n in EMA_LENGTHS}, "volume_ema": ("volume_ema_20",), "rel_volume": ("relative_volume_20",), "rsi": ("rsi_14",), "atr": ("atr_14",), "atr_pct": ("atr_percent_14",),
    "macd": ("macd_12_26", "macd_signal_9", "macd_histogram"), "adx_di": ("adx_14", "plus_di_14", "minus_di_14"), "bands": ("band_upper_20_2", "band_middle_20", "band_lower_20_2", "band_width_20_2"), "roc": ("roc_20",), "obv": ("obv",),
    "trailing_365d": ("trailing_365d_high", "trailing_365d_low"), "dist_high": ("distance_from_365d_high_percent",),
}
for _name, _columns in SINGLE.items():
    query(_name, sql.chain() + _rounded_sql("ind", _columns, where=f"{_columns[0]} IS NOT NULL"))(
        _own(lambda s, d, c=_columns: _rounded(with_indicators(bars.daily(s, d), c).where(F.col(c[0]).isNotNull()), c))
    )
_GATE = "ts >= (SELECT min(x.ts) FROM d x WHERE x.symbol = ind.symbol) + INTERVAL 365 DAY AND ema_200 IS NOT NULL"
query("indicators_full", sql.chain() + _rounded_sql("ind", INDICATOR_COLUMNS, where=_GATE))(_own(lambda s, d: _rounded(indicator_table(bars.daily(s, d)), INDICATOR_COLUMNS)))
query("prices_with_indicators", sql.chain() + _rounded_sql("ind", INDICATOR_COLUMNS, "symbol, ts, open, high, low, close, volume", _GATE))(
    _own(lambda s, d: _rounded(indicator_table(bars.daily(s, d), prices=True), INDICATOR_COLUMNS, ("symbol", "ts", "open", "high", "low", "close", "volume")))
)


@query("resumed_indicators", sql.chain() + _rounded_sql("ind", INDICATOR_COLUMNS, where="ema_200 IS NOT NULL"))
def _resumed_indicators(spark, sf_dir):
    """Indicators of the bars up to 2000, then of all: the second time from the last whole block on, where there is one."""
    def make():
        every = written(bars.daily(spark, sf_dir), "bars")
        early = written(with_indicators(every.where(F.col("ts") < calendar.wall_clock(datetime(2000, 1, 1))), keep=(*STATE_COLUMNS, "__halo_ts")), "early")
        last = block_ends(early).groupBy("symbol").agg(F.max_by(F.struct("ts", "idx", "__halo_ts", *STATE_COLUMNS), "idx").alias("s"))
        states = written(last.select("symbol", "s.*"), "states")
        before = early.join(states.select("symbol", F.col("ts").alias("upto")), "symbol").where("ts <= upto").drop("upto")
        return _rounded(before.unionByName(update.compute(every, states)).where("ema_200 IS NOT NULL"), INDICATOR_COLUMNS)

    return finished(spark, make, "result")


@query("load_indicators", sql.chain() + _rounded_sql("ind", ("rsi_14",), where=_GATE + " AND symbol IN ('BUILDING', 'MACHINERY') AND ts BETWEEN TIMESTAMP '1998-01-01' AND TIMESTAMP '1998-12-31'"))
@_own
def _load_indicators(spark, sf_dir):
    """Two symbols and a year of a stored table."""
    held = update.stores(spark, _shared_root(spark), "1d")[1]
    held.replace(indicator_table(bars.daily(spark, sf_dir)))
    return _rounded(store.load_indicators(held, ["BUILDING", "MACHINERY"], datetime(1998, 1, 1), datetime(1998, 12, 31)), ("rsi_14",))


query("history_gate", f"SELECT symbol, max(ts) >= min(ts) + INTERVAL 365 DAY AS has_year FROM ({sql.DAILY} UNION ALL {sql.HOURLY}) GROUP BY symbol")(
    lambda s, d: bars.daily(s, d).unionByName(bars.hourly(s, d)).groupBy("symbol").agg((F.max("ts") >= F.min("ts") + F.expr("INTERVAL 365 DAYS")).alias("has_year"))
)

# Calendar

_COMPLETE = {
    "intraday": ("1h", "ts + INTERVAL 60 MINUTE <= n"), "multi_day": ("5d", "ts + INTERVAL 7200 MINUTE <= n"), "daily": ("1d", "CAST(ts AS DATE) < CAST(n AS DATE) OR (CAST(ts AS DATE) = CAST(n AS DATE) AND hour(n) >= 16)"),
    "weekly": ("1wk", "isoyear(ts) <> isoyear(n) OR week(ts) <> week(n)"), "monthly": ("1mo", "year(ts) <> year(n) OR month(ts) <> month(n)"), "quarterly": ("3mo", "year(ts) <> year(n) OR quarter(ts) <> quarter(n)"),
}
for _name, (_interval, _rule) in _COMPLETE.items():
    query(f"completed_{_name}", f"SELECT symbol, ts FROM (SELECT symbol, ts, TIMESTAMP '{NOW}' AS n FROM ({sql.DAILY})) WHERE {_rule}")(
        lambda s, d, i=_interval: bars.daily(s, d).where(calendar.is_complete(i, F.col("ts"), F.lit(NOW).cast("timestamp_ntz"))).select("symbol", "ts")
    )
query("latest_completed_date", "SELECT event_id, CASE WHEN hour(ts) >= 16 THEN strftime(ts, '%Y-%m-%d') ELSE strftime(ts - INTERVAL 1 DAY, '%Y-%m-%d') END AS day FROM events")(
    lambda s, d: bars.table(s, d, "events").select("event_id", calendar.latest_completed_date(F.col("ts")).cast("string").alias("day"))
)
query("next_request_start", f"SELECT symbol, max(ts) + INTERVAL 60 MINUTE AS start_ts FROM ({sql.HOURLY}) GROUP BY symbol")(
    lambda s, d: bars.hourly(s, d).groupBy("symbol").agg(F.max("ts").alias("t")).select("symbol", calendar.next_request_start("1h", F.col("t")).alias("start_ts"))
)
query("local_time", "SELECT event_id, ts + INTERVAL 330 MINUTE AS local_ts FROM events")(lambda s, d: bars.table(s, d, "events").select("event_id", calendar.to_local(F.col("ts")).alias("local_ts")))

# Normalization, deduplication, validation, change detection

query("dedup_keep_last", "SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2")(
    lambda s, d: normalize.keep_last(bars.table(s, d, "events").select("user_id", "event_type", "event_id", "value"), ("user_id", "event_type"), "event_id")
)
query("dedup_keep_first", "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2")(
    lambda s, d: normalize.keep_first_rows(bars.table(s, d, "events").select("user_id", "event_type", "event_id"), "event_id")
)


def _raw(spark, sf_dir):
    """Hourly bars with whole rows and, for one symbol, single values taken out, and a row sequence."""
    b = bars.hourly(spark, sf_dir).withColumn("seq", F.hour("ts"))
    gone = (F.hour("ts") == 3) | ((F.col("symbol") == "click") & (F.hour("ts") == 5))
    values = {c: F.when(~gone, F.col(c)) for c in normalize.OHLCV[:4]}
    return b.withColumns(values | {"volume": F.when(F.hour("ts") != 3, F.col("volume"))})


_RAW_SQL = f"(SELECT * FROM ({sql.HOURLY}) WHERE hour(ts) <> 3 AND ts + INTERVAL 60 MINUTE <= TIMESTAMP '2024-01-20 12:30:00' AND symbol <> 'click')"
query("drop_empty", f"SELECT symbol, CAST(count(*) AS BIGINT) AS n FROM ({sql.HOURLY}) WHERE hour(ts) <> 3 GROUP BY symbol")(lambda s, d: normalize.drop_empty(_raw(s, d)).groupBy("symbol").agg(F.count("*").alias("n")))
query("normalized", f"SELECT symbol, ts, open, high, low, close, volume FROM {_RAW_SQL}")(lambda s, d: normalize.normalize(_raw(s, d), "1h", F.lit("2024-01-20 12:30:00").cast("timestamp_ntz"))[0])
def _orders_as_rows(spark, sf_dir):
    """Orders as vendor rows of customers: some without a close, with half a share, or with an infinite high; several a day."""
    orders, p = bars.table(spark, sf_dir, "orders").where("o_orderstatus = 'P'"), F.col("o_totalprice")
    of = lambda priority: F.col("o_orderpriority") == priority
    odd = (F.col("o_orderkey") % 5) == 0
    return orders.select(
        F.col("o_custkey").cast("string").alias("symbol"), F.col("o_orderdate").cast("timestamp_ntz").alias("ts"), p.alias("open"), F.when(of("3-MEDIUM") & odd, float("inf")).otherwise(p).alias("high"), p.alias("low"),
        F.when(~(of("1-URGENT") & odd), p).alias("close"), F.when(of("5-LOW") & odd, 0.5).otherwise(1.0).alias("volume"), F.col("o_orderkey").alias("seq"),
    )


query(
    "rejected",
    f"""SELECT symbol, error FROM (SELECT CAST(o_custkey AS VARCHAR) AS symbol, CASE WHEN bool_or(o_orderpriority = '3-MEDIUM' AND o_orderkey % 5 = 0) THEN 'prices contain non-finite values' WHEN bool_or(o_orderpriority = '1-URGENT' AND o_orderkey % 5 = 0) THEN 'candles are partially missing'
 WHEN bool_or(o_orderpriority = '5-LOW' AND o_orderkey % 5 = 0) THEN 'volume is not integral' WHEN min(CAST(o_orderdate AS DATE)) >= DATE '{NOW[:10]}' THEN 'no completed rows' END AS error FROM orders WHERE o_orderstatus = 'P' GROUP BY o_custkey) WHERE error IS NOT NULL""",
)(lambda s, d: normalize.normalize(_orders_as_rows(s, d), "1d", F.lit(NOW).cast("timestamp_ntz"))[1])
query(
    "validate_summary",
    """SELECT CAST(o_custkey AS VARCHAR) AS symbol, CAST(count(*) AS BIGINT) AS n_rows, CAST(count(*) FILTER (WHERE o_orderpriority = '1-URGENT' AND o_orderkey % 5 = 0) AS BIGINT) AS n_nulls, CAST(count(DISTINCT o_orderdate) AS BIGINT) AS n_keys,
 CAST(count(*) FILTER (WHERE o_orderpriority = '3-MEDIUM' AND o_orderkey % 5 = 0) AS BIGINT) AS n_non_finite FROM orders WHERE o_orderstatus = 'P' GROUP BY o_custkey""",
)(lambda s, d: validate.summary(_orders_as_rows(s, d), tuple(validate.PRICE_COLUMNS), "symbol").select("symbol", "n_rows", "n_nulls", "n_keys", "n_non_finite"))


@query(
    "stored_problems",
    """SELECT symbol, CASE WHEN nulls > 0 THEN 'price data contains nulls' WHEN odd > 0 THEN 'price data contains non-finite values' WHEN keys < n THEN 'price data contains duplicate timestamps' END AS error
 FROM (SELECT CAST(o_custkey AS VARCHAR) AS symbol, count(*) AS n, count(DISTINCT o_orderdate) AS keys, count(*) FILTER (WHERE o_orderpriority = '1-URGENT' AND o_orderkey % 5 = 0) AS nulls,
 count(*) FILTER (WHERE o_orderpriority = '3-MEDIUM' AND o_orderkey % 5 = 0) AS odd FROM orders WHERE o_orderstatus = 'P' GROUP BY o_custkey) WHERE nulls > 0 OR odd > 0 OR keys < n""",
)
def _stored_problems(spark, sf_dir):
    """What the check of a price store says of rows that it has staged and read back; nothing of it is published."""
    rows = _orders_as_rows(spark, sf_dir).drop("seq").withColumn("volume", F.col("volume").cast("bigint"))
    return update.stores(spark, _shared_root(spark), "1d")[0].stage(rows).errors


query(
    "removed_symbols",
    f"SELECT symbol, ts, close FROM ({sql.DAILY}) WHERE symbol NOT IN ('BUILDING', 'MACHINERY')",
)(_own(lambda s, d: _after_removal(s, d)))


def _after_removal(spark, sf_dir):
    """What a store holds after two symbols were forgotten."""
    held = update.stores(spark, _shared_root(spark), "1d")[0]
    held.replace(bars.daily(spark, sf_dir))
    held.remove(["BUILDING", "MACHINERY", "none"])
    return held.read().select("symbol", "ts", "close")


query("anti_missing", "SELECT c_custkey AS symbol FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")(
    lambda s, d: vendor.missing_symbols(bars.table(s, d, "customer").select(F.col("c_custkey").alias("symbol")), bars.table(s, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("symbol")))
)


query("request_batches", "SELECT c_name AS symbol, c_custkey AS ord, CAST((row_number() OVER (ORDER BY c_custkey) - 1) // 50 AS BIGINT) AS batch FROM customer")(
    lambda s, d: vendor.request_batches(bars.table(s, d, "customer").select(F.col("c_name").alias("symbol"), F.col("c_custkey").alias("ord")), 50)
)


def _asked(spark, sf_dir):
    """Customers as symbols, in batches of 100."""
    return vendor.request_batches(bars.table(spark, sf_dir, "customer").select(F.col("c_name").alias("symbol"), F.col("c_custkey").alias("ord")), 100)


def _delivered(spark, sf_dir, priority):
    """Orders of a priority as what a vendor delivered for customers, with their batches."""
    orders = bars.table(spark, sf_dir, "orders").where(F.col("o_orderpriority") == priority).select(F.col("o_custkey").alias("ord"), F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("p"), F.col("o_orderkey").alias("seq"))
    rows = _asked(spark, sf_dir).join(orders, "ord")
    return rows.select("batch", "symbol", F.col("ts").cast("timestamp_ntz").alias("ts"), *[F.col("p").alias(c) for c in normalize.OHLCV[:4]], F.lit(1.0).alias("volume"), "seq", F.lit(None).cast("string").alias("error"))


_BATCHES = "SELECT c_custkey, c_name, CAST((row_number() OVER (ORDER BY c_custkey) - 1) // 100 AS BIGINT) AS batch FROM customer"


@query(
    "vendor_batches",
    f"""WITH b AS ({_BATCHES}), o AS (SELECT b.*, o_orderkey, o_totalprice, o_orderpriority FROM orders JOIN b ON c_custkey = o_custkey), f AS (SELECT DISTINCT batch FROM o WHERE o_orderpriority = '1-URGENT' AND batch % 2 = 0)
SELECT batch, c_name AS symbol, o_orderkey AS seq, o_totalprice AS close FROM o WHERE o_orderpriority = CASE WHEN batch IN (FROM f) THEN '1-URGENT' ELSE '2-HIGH' END""",
)
def _vendor_batches(spark, sf_dir):
    """A run that has landed every second batch is called again with other rows for all: what landed first stays."""
    landing = Landing(spark, _shared_root(spark))
    landing.put("r", _delivered(spark, sf_dir, "1-URGENT").where("batch % 2 = 0").repartition("batch"))
    landing.put("r", _delivered(spark, sf_dir, "2-HIGH").repartition("batch"))
    return landing.read("r").select("batch", "symbol", "seq", "close")


@query(
    "batch_outcomes",
    f"""WITH b AS ({_BATCHES}), n AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1), f AS (SELECT DISTINCT batch FROM b JOIN customer USING (c_custkey) WHERE c_acctbal < -950)
SELECT c_name AS symbol, batch, CAST(CASE WHEN batch IN (FROM f) THEN 0 ELSE coalesce(n, 0) END AS BIGINT) AS n_rows, CASE WHEN batch IN (FROM f) THEN 'refused' WHEN n IS NULL THEN '{vendor.NO_DATA}' END AS error FROM b LEFT JOIN n ON o_custkey = c_custkey""",
)
def _batch_outcomes(spark, sf_dir):
    """Batches with a customer deep in debt are refused as a whole."""
    debt = bars.table(spark, sf_dir, "customer").where("c_acctbal < -950").select(F.col("c_custkey").alias("ord"))
    failed = _asked(spark, sf_dir).join(debt, "ord").select("batch").distinct().withColumn("error", F.lit("refused"))
    return vendor.batch_outcomes(_asked(spark, sf_dir), _delivered(spark, sf_dir, "1-URGENT"), failed)


_WORDS = ", ".join(f"CAST(sum(CAST('0x' || substr(h, {1 + 8 * i}, 8) AS BIGINT)) AS BIGINT)" for i in range(8))


def _leaves_sql(rows: str) -> str:
    """Month digests of ``symbol, ts, volume`` rows."""
    hashed = f"SELECT symbol, date_trunc('month', ts)::TIMESTAMP AS block, sha256(strftime(ts, '%Y-%m-%d %H:%M:%S') || '|' || CAST(volume AS VARCHAR)) AS h FROM ({rows})"
    return f"SELECT symbol, block, sha256(concat_ws(',', count(*), {_WORDS})) AS digest, count(*) AS n FROM ({hashed}) GROUP BY symbol, block"


query("block_digests", f"SELECT symbol, block, digest, CAST(n AS BIGINT) AS n_rows FROM ({_leaves_sql(sql.DAILY)})")(lambda s, d: store.block_digests(bars.daily(s, d), ["ts", "volume"]))
query(
    "content_hash",
    f"""WITH y AS (SELECT symbol, year(block) AS y, sha256(string_agg(digest, '' ORDER BY block)) AS digest, sum(n) AS n FROM ({_leaves_sql(sql.DAILY)}) GROUP BY symbol, year(block))
SELECT symbol, sha256(string_agg(digest, '' ORDER BY y)) AS source_fingerprint, CAST(sum(n) AS BIGINT) AS n_rows FROM y GROUP BY symbol""",
)(lambda s, d: store.fingerprints(bars.daily(s, d), ["ts", "volume"]))
_ORDERS_SQL = "SELECT CAST(o_custkey AS VARCHAR) AS symbol, o_orderdate AS ts, CAST(count(*) AS BIGINT) AS volume FROM orders WHERE {} GROUP BY 1, 2"
_LESS = "o_orderpriority <> '1-URGENT' OR o_orderstatus <> 'P'"


def _two_versions(spark, sf_dir):
    """The order days of customers, and the same without a few orders: leaves of both."""
    orders = bars.table(spark, sf_dir, "orders")
    days = lambda df: store.block_digests(df.groupBy(F.col("o_custkey").cast("string").alias("symbol"), F.col("o_orderdate").alias("ts")).agg(F.count("*").alias("volume")))
    return days(orders), days(orders.where(_LESS))


_VERSIONS = f"a AS ({_leaves_sql(_ORDERS_SQL.format('TRUE'))}), b AS ({_leaves_sql(_ORDERS_SQL.format(_LESS))})"
query(
    "changed_blocks",
    f"WITH {_VERSIONS} SELECT coalesce(a.symbol, b.symbol) AS symbol, coalesce(a.block, b.block) AS block, CASE WHEN b.n IS NULL THEN 'removed' WHEN a.n IS NULL THEN 'added' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.symbol = b.symbol AND a.block = b.block WHERE a.digest IS DISTINCT FROM b.digest",
)(lambda s, d: store.changed_blocks(*reversed(_two_versions(s, d))))
# what is left of a symbol has changed where any of its orders is gone, also one of several on a day
query("fingerprint_changed", f"SELECT CAST(o_custkey AS VARCHAR) AS symbol, count(*) <> count(*) FILTER (WHERE {_LESS}) AS changed FROM orders GROUP BY o_custkey HAVING count(*) FILTER (WHERE {_LESS}) > 0")(
    lambda s, d: store.changed_symbols(*[store.root_digests(x) for x in reversed(_two_versions(s, d))])
)


def _shared_root(spark):
    """A new store root in the folder that driver and executors share."""
    return f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"


def _update(spark, sf_dir, root):
    """Hourly bars into fresh stores, one symbol partly missing and one asked for that has no data."""
    raw = _raw(spark, sf_dir).withColumns({c: F.col(c).cast("double") for c in normalize.OHLCV})
    names = [r[0] for r in raw.select("symbol").distinct().orderBy("symbol").collect()] + ["absent"]
    asked = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "symbol string, ord long")
    return update.update(spark, root, "1h", raw, asked, datetime(2024, 1, 20, 12, 30, tzinfo=ZoneInfo(calendar.ZONE)))


_STORED = f"(SELECT symbol, count(*) AS n FROM {_RAW_SQL} GROUP BY symbol)"
_STATUS = f"SELECT e.symbol, CASE WHEN s.n IS NULL THEN 'failed' ELSE 'success' END AS status, coalesce(s.n, 0) AS stored_rows FROM (SELECT DISTINCT event_type AS symbol FROM events UNION ALL SELECT 'absent') e LEFT JOIN {_STORED} s ON s.symbol = e.symbol"
query("update_run", _STATUS)(lambda s, d: _update(s, d, _shared_root(s)).select("symbol", "status", "stored_rows"))
query("status_counts", f"SELECT status, CAST(count(*) AS BIGINT) AS n FROM ({_STATUS}) GROUP BY status")(
    lambda s, d: _update(s, d, _shared_root(s)).groupBy("status").agg(F.count("*").alias("n"))
)


@query("store_read", f"SELECT symbol, ts, open, high, low, close, volume FROM {_RAW_SQL} WHERE symbol IN ('view', 'purchase') AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-10'")
def _store_read(spark, sf_dir):
    """What a read of two symbols and a range gives back of the prices that an update has stored."""
    root = _shared_root(spark)
    _update(spark, sf_dir, root)
    found = update.stores(spark, root, "1h")[0].read(["view", "purchase"], datetime(2024, 1, 5), datetime(2024, 1, 10))
    return found if found is not None else bars.hourly(spark, sf_dir).limit(0)


@query("updated_indicators", sql.chain() + _rounded_sql("ind", INDICATOR_COLUMNS, "symbol, ts, open, high, low, close, volume", _GATE))
def _updated_indicators(spark, sf_dir):
    """What the stores hold after two update runs, of the daily bars up to 2000 and of all of them: the second run resumes
    the indicators of the first."""
    root, day = _shared_root(spark), written(bars.daily(spark, sf_dir), "bars")
    raw = day.withColumns({"volume": F.col("volume").cast("double"), "seq": F.lit(0)})
    asked = day.groupBy("symbol").agg(F.min("ts").alias("first")).select("symbol", F.lit(0).alias("ord"))
    for rows in (raw.where(F.col("ts") < calendar.wall_clock(datetime(2000, 1, 1))), raw):
        update.update(spark, root, "1d", rows, asked, datetime(2002, 1, 1, tzinfo=ZoneInfo(calendar.ZONE)))
    found = store.load_prices_with_indicators(*update.stores(spark, root, "1d"))
    return _rounded(found, INDICATOR_COLUMNS, ("symbol", "ts", "open", "high", "low", "close", "volume"))


query("unsorted", "SELECT DISTINCT symbol FROM (SELECT event_type AS symbol, ts < lag(ts) OVER (PARTITION BY event_type ORDER BY user_id, event_id) AS back FROM events) WHERE back")(
    lambda s, d: validate.unsorted_symbols(bars.table(s, d, "events").select(F.col("event_type").alias("symbol"), "ts", F.struct("user_id", "event_id").alias("seq")))
)


@query("split_wide", "SELECT o_orderpriority AS symbol, CAST(o_orderdate AS TIMESTAMP) AS ts, CAST(max(o_totalprice) AS DOUBLE) AS high, CAST(min(o_totalprice) AS DOUBLE) AS low FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') GROUP BY 1, 2")
def _split_wide(spark, sf_dir):
    """One column for each field and symbol, and back to rows."""
    orders = bars.table(spark, sf_dir, "orders").select("o_orderpriority", F.col("o_orderdate").cast("timestamp_ntz").alias("ts"), F.col("o_totalprice").cast("double").alias("p"))
    of = lambda n: F.when(F.col("o_orderpriority") == n, F.col("p"))
    wide = orders.groupBy("ts").agg(*[f(of(n)).alias(f"{k}|{n}") for n in ("1-URGENT", "2-HIGH") for k, f in (("High", F.max), ("Low", F.min))])
    return normalize.split_wide(wide).where("high IS NOT NULL").select("symbol", "ts", "high", "low")


query("limit_scan", "SELECT event_id, ts, value FROM events ORDER BY event_id LIMIT 100")(lambda s, d: bars.table(s, d, "events").select("event_id", "ts", "value").orderBy("event_id").limit(100))

@query("csv_distinct", "SELECT user_id, event_type, CAST(min(k) AS BIGINT) AS position FROM (SELECT CAST(user_id AS VARCHAR) AS user_id, event_type, row_number() OVER (ORDER BY event_id) - 1 AS k FROM events) GROUP BY 1, 2")
def _csv_distinct(spark, sf_dir):
    """Events written as CSV in the order of their ids, read back with positions, without repeated rows."""
    place = f"{_shared_root(spark)}/events"
    events = bars.table(spark, sf_dir, "events").select(F.col("event_id").alias(csv.POSITION), "user_id", "event_type")
    csv.write_rows(events, place)
    return csv.distinct_rows(csv.read_rows(spark, place)).withColumnRenamed(csv.POSITION, "position")


query("localized", "SELECT event_id, ts + INTERVAL 330 MINUTE AS from_instant, ts AS from_wall_clock FROM events")(
    lambda s, d: normalize.localize(
        normalize.localize(bars.table(s, d, "events").select("event_id", F.timestamp_micros(micros("ts")).alias("from_instant"), F.col("ts").alias("from_wall_clock")), "from_instant"), "from_wall_clock"
    )
)


@query(
    "normalized_instants",
    f"SELECT event_type AS symbol, ts + INTERVAL 330 MINUTE AS ts, close FROM (SELECT symbol AS event_type, ts, close FROM ({sql.HOURLY})) WHERE ts + INTERVAL 330 MINUTE + INTERVAL 60 MINUTE <= TIMESTAMP '2024-01-20 12:30:00'",
)
def _normalized_instants(spark, sf_dir):
    """Vendor rows whose times are instants, under vendor names, as bars of the exchange's clock that are complete."""
    raw = bars.hourly(spark, sf_dir).select("symbol", F.timestamp_micros(micros("ts")).alias("Datetime"), *[F.col(c).alias(c.capitalize()) for c in normalize.OHLCV], F.lit(0).alias("seq"))
    return normalize.normalize(normalize.localize(normalize.named(raw)), "1h", F.lit("2024-01-20 12:30:00").cast("timestamp_ntz"))[0].select("symbol", "ts", "close")


# Windows

query("window_lists", f"SELECT symbol, ts, array_to_string(list(volume) OVER w, ',') AS vols FROM ({sql.DAILY}) WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) QUALIFY count(*) OVER w = 10")(
    lambda s, d: windows.rolling_list(bars.daily(s, d), "volume").where("values IS NOT NULL").select("symbol", "ts", F.array_join(F.transform("values", lambda x: x.cast("string")), ",").alias("vols"))
)
query(
    "forward_returns",
    f"SELECT symbol, ts, {', '.join(f'round((lead(close, {h}) OVER w / close - 1) * 100 + 1e-7, 4) AS return_{h}' for h in (5, 10, 20, 30))} FROM ({sql.DAILY}) WINDOW w AS (PARTITION BY symbol ORDER BY ts)",
)(lambda s, d: _rounded(windows.forward_returns(bars.daily(s, d)), [f"return_{h}" for h in (5, 10, 20, 30)]))
query("latest_rows", f"SELECT symbol, max(ts) AS ts, arg_max(close, ts) AS close FROM ({sql.DAILY}) GROUP BY symbol")(lambda s, d: windows.latest(bars.daily(s, d)).select("symbol", "ts", "close"))


@query(
    "nonoverlap",
    sql.chain(*EVENT_CHAIN)
    + """, q AS (SELECT symbol, high_idx, low_idx, row_number() OVER (PARTITION BY symbol ORDER BY high_idx) AS k FROM ev),
g AS (SELECT symbol, k, high_idx, low_idx, TRUE AS taken, low_idx AS upto FROM q WHERE k = 1
 UNION ALL SELECT q.symbol, q.k, q.high_idx, q.low_idx, q.high_idx > g.upto, CASE WHEN q.high_idx > g.upto THEN q.low_idx ELSE g.upto END FROM g JOIN q ON q.symbol = g.symbol AND q.k = g.k + 1)
SELECT symbol, high_idx, low_idx FROM g WHERE taken""",
)
def _nonoverlap(spark, sf_dir):
    def make():
        events = pullback.pullback_events(_zigzag(spark, sf_dir)).select("symbol", "high_idx", "low_idx")
        return _longs(windows.first_windows(events, "high_idx", "low_idx"), "high_idx", "low_idx").drop("position")

    return finished(spark, make, "result")


# Pullbacks


def _indicators(spark, sf_dir, only=INDICATOR_COLUMNS):
    """As a table, since pullback plans read it several times; ``_own`` removes it when the result is written."""
    return written(with_indicators(bars.daily(spark, sf_dir), only), "indicators")


def _zigzag(spark, sf_dir):
    return pullback.zigzag(pullback.fractal_pivots(_indicators(spark, sf_dir, ())))


def _events(spark, sf_dir):
    ind = _indicators(spark, sf_dir, pullback.PULLBACK_COLUMNS)
    events = pullback.pullback_events(pullback.zigzag(pullback.fractal_pivots(ind)))
    return written(pullback.with_outcome(pullback.with_anchor(events, ind), ind), "events"), ind


def _state(spark, sf_dir):
    events, ind = _events(spark, sf_dir)
    zz = pullback.zigzag(pullback.fractal_pivots(ind))
    return pullback.current_state(ind, zz, pullback.signature(events), pullback.turn_trigger(events, ind))


def _tiers(spark, sf_dir):
    return pullback.screen_rows(_indicators(spark, sf_dir, pullback.PULLBACK_COLUMNS))


_longs = lambda df, *c: df.withColumns({x: F.col(x).cast("long") for x in c})
query("fractal_pivots", sql.chain(*PIVOT_CHAIN) + "SELECT * FROM piv")(_own(lambda s, d: _longs(pullback.fractal_pivots(_indicators(s, d, ())), "idx")))
query("zigzag", sql.chain(*EVENT_CHAIN[:2]) + "SELECT * FROM zz")(_own(lambda s, d: _longs(_zigzag(s, d), "idx")))
query("pullback_events", sql.chain(*EVENT_CHAIN) + "SELECT symbol, high_idx, high, low_idx, low_ts, low, round(depth_pct + 1e-7, 4) AS depth_pct FROM ev")(
    _own(lambda s, d: _longs(pullback.pullback_events(_zigzag(s, d)), "high_idx", "low_idx").withColumn("depth_pct", F.round(F.col("depth_pct") + HALF, 4)))
)
query("outcomes", sql.chain(*LEARN_CHAIN) + "SELECT symbol, low_idx, anchor, success, bars_to_win FROM evs")(_own(lambda s, d: _longs(_events(s, d)[0].select("symbol", "low_idx", "anchor", "success", "bars_to_win"), "low_idx", "bars_to_win")))
query("signature_iqr", sql.chain(*LEARN_CHAIN, sql.SIGNATURE) + _rounded_sql("sig", ("band_lo", "band_hi", "success_rate"), "symbol, n_events, confidence, anchor"))(
    _own(lambda s, d: _rounded(pullback.signature(_events(s, d)[0]), ("band_lo", "band_hi", "success_rate"), ("symbol", "n_events", "confidence", "anchor")))
)
query("turn_trigger", sql.chain(*LEARN_CHAIN, sql.TRIGGER) + _rounded_sql("trg", ("lift", "lag"), "symbol, n_winners, reclaim"))(
    _own(lambda s, d: _rounded(pullback.turn_trigger(*_events(s, d)), ("lift", "lag"), ("symbol", "n_winners", "reclaim")))
)
STATE_CHAIN = (*LEARN_CHAIN, sql.SIGNATURE, sql.TRIGGER, sql.STATE)
TIER_CHAIN = (*STATE_CHAIN, sql.HORIZON, sql.BOUNCES, sql.FADE, sql.TIERS)
STATE_VALUES = ("now_off_high", "live_low_dip", "band_lo", "band_hi", "success_rate", "cur_lift", "trigger_lift_price", "trigger_ema_price", "buy_trigger_price")
STATE_PLAIN = ("symbol", "ts", "close", "live_high", "live_low", "live_low_ts", "floor_price", "near_term_invalidation", "n_events", "uptrend", "turn_confirmed", "turn_path", "broke_ema", "state")
TIER_VALUES = (*STATE_VALUES, "bounce_base", "bounce_learned", "delta", "vol_fade_ratio")
TIER_PLAIN = (*STATE_PLAIN, "horizon_bars", "clamped", "recovery", "tier")
_joined = lambda df: df.withColumn("turn_path", F.array_join("turn_path", ","))
query("current_state", sql.chain(*STATE_CHAIN) + _rounded_sql("st", STATE_VALUES, ", ".join(STATE_PLAIN)))(_own(lambda s, d: _rounded(_joined(_state(s, d)), STATE_VALUES, STATE_PLAIN)))
query("tiers", sql.chain(*TIER_CHAIN) + _rounded_sql("tiered", TIER_VALUES, ", ".join(TIER_PLAIN)))(_own(lambda s, d: _rounded(_joined(_tiers(s, d)), TIER_VALUES, TIER_PLAIN)))
query("screen_lines", sql.chain(*TIER_CHAIN) + sql.SCREEN_LINES)(_own(lambda s, d: _rounded(screen.lines(_tiers(s, d)), ("bounce_base",), ("place", "tier_ord", "symbol", "line"))))
query("tier_counts", sql.chain(*TIER_CHAIN) + sql.TIER_COUNTS)(_own(lambda s, d: screen.tier_counts(_tiers(s, d))))
query("learned_horizon", sql.chain(*LEARN_CHAIN, sql.HORIZON) + "SELECT symbol, horizon_bars, clamped, learned FROM hz")(_own(lambda s, d: pullback.learned_horizon(_events(s, d)[0]).drop("horizon_days")))

# Similarity and structure

query("similarity_counts", sql.chain(sql.SIMILAR) + "SELECT symbol, CAST(count(*) AS BIGINT) AS n_candidates, CAST(count(*) AS BIGINT) AS n_compared FROM m4 GROUP BY symbol HAVING count(*) <= 3800")(
    _own(lambda s, d: similarity.search(_indicators(s, d))[1].where(f"n_candidates <= {(2 * similarity.WINDOW - 1) * similarity.MAX_MATCHES}"))
)

SIMILAR_VALUES = ("combined_distance", "chart_shape_distance", *[f"return_{h}" for h in similarity.FUTURE_PERIODS])
query("similarity_topk", sql.chain(sql.SIMILAR) + _rounded_sql("alike", SIMILAR_VALUES, "symbol, CAST(position AS BIGINT) AS position, first_idx, idx, ts"))(
    _own(lambda s, d: _longs(_rounded(similarity.matches(_indicators(s, d)), SIMILAR_VALUES, ("symbol", "position", "first_idx", "idx", "ts")), "position", "first_idx", "idx"))
)


@query("chart_structure", sql.chain(*EVENT_CHAIN[:2], sql.STRUCTURE))
@_own
def _chart_structure(spark, sf_dir):
    """One row per formation found; symbols without one have nulls there."""
    found = structure.analyze(_indicators(spark, sf_dir, ("atr_14",)), _zigzag(spark, sf_dir))
    plain = ("symbol", "trend", "swing_sequence", "formation", "breakout_state")
    return _rounded(found.select(*plain, F.inline_outer("patterns")), ("confirmation_level", "invalidation_level"), (*plain, "name", "status"))


HISTORY_VALUES = tuple(f"return_{h}" for h in structure.HISTORY_HORIZONS)
HISTORY_PLAIN = ("symbol", "formation", "position", "window_start_index", "window_end_index")
query("chart_history", sql.chain(*EVENT_CHAIN[:2], sql.HISTORY) + _rounded_sql("past", HISTORY_VALUES, ", ".join(HISTORY_PLAIN)))(
    _own(lambda s, d: _longs(_rounded(structure.historical(_indicators(s, d, ("atr_14",)), _zigzag(s, d)), HISTORY_VALUES, HISTORY_PLAIN), "position", "window_start_index", "window_end_index"))
)
query("tolerance", sql.chain() + _rounded_sql("(SELECT symbol, ts, 0.5 * atr_14 AS tolerance FROM ind WHERE atr_14 > 0)", ("tolerance",)))(_own(lambda s, d: _rounded(structure.with_tolerance(_indicators(s, d, ("atr_14",))), ("tolerance",))))
query("choppiness_k", sql.chain(sql.CHOPPINESS))(_own(lambda s, d: _rounded(pullback.choppiness(_indicators(s, d, ())), ("choppiness",), ("symbol", "k"))))
query("shortlists", sql.chain(sql.SHORTLIST) + "SELECT * FROM sl")(_own(lambda s, d: pullback.shortlists(_indicators(s, d, ("ema_200",)))))
query("calibrated_window", sql.chain(sql.SHORTLIST) + sql.CALIBRATED)(
    _own(lambda s, d: _rounded(pullback.calibrated_window(pullback.shortlists(_indicators(s, d, ("ema_200",)))).withColumns({"W_used": F.array_join(F.col("W_used").cast("array<string>"), ","), "shortlist": F.array_join("shortlist", ",")}), ("overlap",), ("mode", "W_used", "shortlist")))
)
query("shortlist_overlap", sql.chain(sql.SHORTLIST) + sql.OVERLAP)(_own(lambda s, d: pullback.shortlist_overlap(pullback.shortlists(_indicators(s, d, ("ema_200",))), "w")))
