"""The update run: normalize, store, refresh indicators, report. All symbols at once; a symbol that fails
becomes a row with its error and does not touch the others. Prices and what is computed from them are published together."""

from __future__ import annotations

from datetime import datetime
from functools import reduce
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.calendar import ZONE, require_aware, wall_clock
from barloom.functions.indicators import DAYS, INDICATOR_COLUMNS, STATE, STATE_COLUMNS, block_ends, published, with_indicators
from barloom.operators.normalize import localize, normalize
from barloom.operators.validate import PRICE_COLUMNS, indicator_problems, price_problems
from barloom.sources.shared import released, written
from barloom.sources.store import Staged, Store, block_digests, changed_blocks

SUCCESS, UNCHANGED, FAILED = "success", "unchanged", "failed"
PRICES = ", ".join(f"{c} {t}" for c, t in PRICE_COLUMNS.items())
INDICATORS = "symbol string, ts timestamp_ntz, " + ", ".join(f"{c} double" for c in INDICATOR_COLUMNS)
#: Leaves of the digest tree of the prices that indicators were computed from; ``ts`` is the block.
SOURCES = "symbol string, ts timestamp_ntz, digest string, n_rows bigint"


def stores(spark: SparkSession, root: str, interval: str) -> tuple[Store, Store]:
    return Store(spark, root, "prices", interval, PRICES, price_problems), Store(spark, root, "indicators", interval, INDICATORS, indicator_problems)


def _rows(store: Store, entries: DataFrame, symbols: DataFrame) -> DataFrame:
    return store.rows(entries.join(symbols.select("symbol"), "symbol", "left_semi"))


def resumable(leaves: DataFrame, sources: DataFrame, states: DataFrame) -> DataFrame:
    """``STATE`` rows, one for each symbol that need not be computed from its beginning: the last block end before the first
    block of the prices that changed since."""
    first = changed_blocks(leaves, sources).groupBy("symbol").agg(F.min("block").alias("__block"))
    found = states.join(first, "symbol").where(F.col("ts") < F.col("__block"))
    names = [c for c in states.columns if c != "symbol"]
    return found.groupBy("symbol").agg(F.max_by(F.struct(*names), "idx").alias("s")).select("symbol", *[F.col(f"s.{c}").alias(c) for c in names])


def tail(bars: DataFrame, states: DataFrame) -> DataFrame:
    """The bars that resuming reads: those after the state, and before it what the windows of the next block reach back to."""
    since = F.least(F.col("ts") - F.expr(f"INTERVAL {DAYS} DAYS"), F.col("__halo_ts"))
    reach = states.select(F.col("symbol").alias("__symbol"), since.alias("__since"))
    return bars.join(reach, (F.col("symbol") == F.col("__symbol")) & (F.col("ts") >= F.col("__since"))).drop("__symbol", "__since")


def compute(bars: DataFrame, states: DataFrame) -> DataFrame:
    """Indicators with ``STATE_COLUMNS``: of symbols without a state from the first bar, of others from behind it."""
    keep = (*STATE_COLUMNS, "__halo_ts")
    whole = with_indicators(bars.join(states.select("symbol"), "symbol", "left_anti"), keep=keep)
    return whole.unionByName(with_indicators(tail(bars, states), state=states, keep=keep))


def _stage_indicators(prices: Store, indicators: Store, entries: DataFrame) -> tuple[list[Staged], DataFrame, DataFrame]:
    """What becomes of the indicators of symbols whose prices (manifest rows ``entries``) are not those that they were
    computed from: staged kinds, ``kind, symbol`` to forget, and ``symbol, changed, error``."""
    spark = prices.spark
    state, source = prices.other("state", STATE), prices.other("sources", SOURCES)
    stale = entries.join(source.state().withColumnRenamed("source_fingerprint", "__from"), "symbol", "left").where(~F.col("source_fingerprint").eqNullSafe(F.col("__from")))
    nothing = spark.createDataFrame([], "kind string, symbol string"), spark.createDataFrame([], "symbol string, changed boolean, error string")
    if stale.isEmpty():
        return [], *nothing
    stale = stale.select(*entries.columns)
    bars = prices.rows(stale)
    leaves = block_digests(bars)
    old = _rows(source, source.entries(), stale).withColumnRenamed("ts", "block")
    held = _rows(state, state.entries(), stale)
    leaves = written(leaves, "leaves")
    states = written(resumable(leaves, old, held), "resume")
    every = written(compute(bars, states), "computed")
    after = states.select("symbol", F.col("ts").alias("__upto"))
    before = lambda rows: rows.join(after, "symbol").where(F.col("ts") <= F.col("__upto")).drop("__upto")
    table = published(every, stale).select("symbol", "ts", *INDICATOR_COLUMNS)
    table = before(_rows(indicators, indicators.entries(), stale)).unionByName(table)
    marks = stale.select("symbol", "source_fingerprint")
    done = indicators.stage(table, marks)
    fine = marks.join(done.errors, "symbol", "left_anti")
    ends = before(held).unionByName(block_ends(every)).join(fine.select("symbol"), "symbol", "left_semi")
    seen = leaves.withColumnRenamed("block", "ts").join(fine.select("symbol"), "symbol", "left_semi")
    staged = [done, state.stage(ends, fine), source.stage(seen, fine)]
    short = fine.join(done.entries.select("symbol"), "symbol", "left_anti").select("symbol")
    there = indicators.state().select("symbol").withColumn("there", F.lit(True))
    short = short.join(there, "symbol", "left").select("symbol", F.coalesce("there", F.lit(False)).alias("changed"))
    results = [done.entries.select("symbol", "changed", F.lit(None).cast("string").alias("error")), short.withColumn("error", F.lit(None).cast("string")), done.errors.select("symbol", F.lit(None).cast("boolean").alias("changed"), "error")]
    gone = short.where("changed").select(F.lit(indicators.kind).alias("kind"), "symbol")
    return staged, gone, reduce(DataFrame.unionByName, results)


def refresh_indicators(prices: Store, indicators: Store, symbols: list[str] | None = None) -> DataFrame:
    """``symbol, changed, error``: recompute symbols whose prices differ from those their indicators came from, from the block
    before the first changed one on; symbols without a year of history lose stale output, and those that are refused come
    back with their error and keep what is stored."""
    entries = prices.entries() if symbols is None else prices.entries().where(F.col("symbol").isin(symbols))

    def refresh():
        staged, gone, result = _stage_indicators(prices, indicators, entries)
        result = prices.scratch(result, "refreshed")
        if staged:
            prices.publish(staged, gone)
        return result

    return released(prices.spark, refresh)


def update(spark: SparkSession, root: str, interval: str, raw: DataFrame, requested: DataFrame, now: datetime, with_indicators: bool = True) -> DataFrame:
    """``symbol, status, downloaded_rows, stored_rows, error`` in the order of ``requested`` (symbol, ord).

    ``raw`` has ``symbol, ts, OHLCV, seq`` and optionally ``error``; its times are the exchange's or instants. Prices that were written stay even if
    the indicators of a symbol fail."""
    return released(spark, lambda: _update(spark, root, interval, raw, requested, now, with_indicators))


def _update(spark: SparkSession, root: str, interval: str, raw: DataFrame, requested: DataFrame, now: datetime, with_indicators: bool) -> DataFrame:
    local = wall_clock(require_aware(now).astimezone(ZoneInfo(ZONE)).replace(tzinfo=None))
    prices, indicators = stores(spark, root, interval)
    errors = raw.where("error IS NOT NULL").groupBy("symbol").agg(F.min("error").alias("error")) if "error" in raw.columns else None
    rows = raw.where("error IS NULL").drop("error") if errors is not None else raw
    rows = localize(rows)
    good, rejected = normalize(rows, interval, local)
    written = prices.stage(good)
    rejected = rejected.unionByName(written.errors)
    if errors is not None:
        rejected = rejected.unionByName(errors)
    staged, gone, fresh = [], None, spark.createDataFrame([], "symbol string, changed boolean, error string")
    if with_indicators:
        # unchanged prices are where the manifest has them, changed ones in what is staged
        there = prices.entries().join(written.entries.where("NOT changed").select("symbol"), "symbol", "left_semi")
        names = there.columns
        staged, gone, fresh = _stage_indicators(prices, indicators, there.unionByName(written.entries.where("changed").select(*names)))
    downloaded = rows.groupBy("symbol").agg(F.count("*").alias("downloaded_rows"))
    absent = requested.join(raw.select("symbol").distinct(), "symbol", "left_anti").select("symbol", F.lit("no data").alias("error"))
    bad = rejected.unionByName(absent).unionByName(fresh.where("error IS NOT NULL").select("symbol", "error")).groupBy("symbol").agg(F.min("error").alias("error"))
    w = written.result.select("symbol", F.col("changed").alias("wrote"), F.col("n_rows").alias("stored_rows"))
    out = requested.join(bad, "symbol", "left").join(w, "symbol", "left").join(fresh.select("symbol", F.col("changed").alias("refreshed")), "symbol", "left").join(downloaded, "symbol", "left")
    moved = F.coalesce("wrote", F.lit(False)) | F.coalesce("refreshed", F.lit(False))
    status = F.when(F.col("error").isNotNull(), FAILED).when(moved, SUCCESS).otherwise(UNCHANGED)
    out = out.select("symbol", status.alias("status"), F.coalesce("downloaded_rows", F.lit(0)).alias("downloaded_rows"), F.coalesce("stored_rows", F.lit(0)).alias("stored_rows"), "error", "ord")
    out = prices.scratch(out, "summary")  # what it compares with changes when this is published
    prices.publish([written, *staged], gone)
    return out.orderBy("ord").drop("ord")


def report(summary: DataFrame) -> tuple[str, int]:
    """The printed summary and the exit code: 0, or 1 if a symbol failed."""
    counts = {r.status: r["count"] for r in summary.groupBy("status").count().collect()}
    lines = [f"Successful: {counts.get(SUCCESS, 0)}", f"Unchanged: {counts.get(UNCHANGED, 0)}", f"Failed: {counts.get(FAILED, 0)}"]
    lines += [f"  {r.symbol}: {r.error}" for r in summary.where(F.col("status") == FAILED).collect()]
    return "\n".join(lines), int(counts.get(FAILED, 0) > 0)
