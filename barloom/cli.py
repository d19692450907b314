"""Command line: updates of the stores, and questions about them answered as JSON.

``update-all`` and ``update-symbol SYMBOL`` read raw rows from a landing folder of Parquet files (``--raw``) or from the
vendor through a transport function (``--fetch module:function``), each batch once, by way of a landing table; ``--run NAME`` goes on with a run
that has begun. ``structure``, ``similar`` and ``lookup`` print one JSON
document on standard output, ``screen`` writes the Markdown report and prints its place, ``distinct-csv`` drops repeated rows of CSV files. Exit codes: 0 done, 1 a symbol failed, 2 bad input.
"""

from __future__ import annotations

import argparse
import json
import logging
import sys
import time
from datetime import UTC, datetime, timedelta
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.calendar import wall_clock
from barloom.functions.indicators import EMA_LENGTHS, with_indicators
from barloom.operators import pullback, screen, similarity, structure
from barloom.plans.update import report, stores, update
from barloom.sources import csv
from barloom.sources.bars import resample
from barloom.sources.config import Config, load_config, read_symbols
from barloom.sources.store import StoreError, check_symbol, load_prices_with_indicators
from barloom.sources.landing import Landing
from barloom.sources.shared import released, written
from barloom.sources.vendor import request, request_batches


def setup_logging(folder: Path, now: datetime) -> logging.Logger:
    """One console and one file handler, replaced on each call."""
    folder.mkdir(parents=True, exist_ok=True)
    log = logging.getLogger("barloom")
    for h in list(log.handlers):
        log.removeHandler(h)
        h.close()
    for h in (logging.StreamHandler(), logging.FileHandler(folder / f"{now.astimezone(UTC):%Y%m%dT%H%M%SZ}.log")):
        log.addHandler(h)
    log.setLevel(logging.INFO)
    return log


def _plain(value):
    return value.isoformat() if isinstance(value, datetime) else value


def _bars(spark: SparkSession, config: Config, request: structure.AnalysisRequest) -> tuple[DataFrame, str]:
    """Bars of the request and the interval that they are stored in; longer ones are resampled from daily bars."""
    units = {"1wk": "week", "1mo": "month", "3mo": "quarter"}
    source = "1d" if request.interval in units and config.interval == "1d" else request.interval
    found = stores(spark, str(config.data_dir), source)[0].read([request.symbol])
    if found is None:
        raise StoreError(f"no prices of {request.symbol} are stored in {source}")
    return structure.select_window(resample(found, units[request.interval]) if source != request.interval else found, request), source


def ask_structure(spark: SparkSession, config: Config, request: structure.AnalysisRequest) -> dict:
    found, source = _bars(spark, config, request)
    bars = with_indicators(found)
    k = pullback.choppiness(bars).first()
    zz = pullback.zigzag(pullback.fractal_pivots(bars, k.k if k else 6))
    docs = structure.analyze_frame(bars, zz, structure.metadata(request, source), request.historical)
    if not docs:
        raise structure.StructureError("too few pivots in this window")
    return docs[0]


def ask_similar(spark: SparkSession, config: Config, symbol: str) -> dict:
    request = structure.AnalysisRequest(similarity.validate_symbol(symbol), config.interval)
    found, source = _bars(spark, config, request)
    rows = similarity.matches(with_indicators(found)).orderBy("position").collect()
    meta = structure.metadata(request, source) | {"warning": similarity.WARNING, "match_count": len(rows)} | {"window": similarity.WINDOW, "max_matches": similarity.MAX_MATCHES, "future_periods": list(similarity.FUTURE_PERIODS)}
    return {"data": meta, "matches": [{k: _plain(v) for k, v in r.asDict().items() if k != "symbol"} for r in rows]}


def ask_lookup(spark: SparkSession, config: Config, symbol: str, rows: int) -> dict:
    """The last rows of prices with their indicators."""
    last = load_prices_with_indicators(*stores(spark, str(config.data_dir), config.interval), [check_symbol(symbol)]).orderBy(F.desc("ts")).limit(rows).collect()
    return {"data": {"symbol": symbol, "requested_interval": config.interval}, "rows": [{k: _plain(v) for k, v in r.asDict().items()} for r in reversed(last)]}


def ask_screen(spark: SparkSession, config: Config, now: datetime) -> str:
    """The Markdown report over the shortlisted symbols of all stored ones."""
    prices = stores(spark, str(config.data_dir), config.interval)[0].read()
    if prices is None:
        raise StoreError("no prices are stored")
    bars = written(with_indicators(prices, pullback.PULLBACK_COLUMNS), "bars")
    calibrated = pullback.calibrated_window(pullback.shortlists(bars))
    chosen = calibrated.select(F.explode("shortlist").alias("symbol"))
    short = bars.groupBy("symbol").agg(F.max("idx").alias("last")).where(F.col("last") < max(EMA_LENGTHS) - 1).count()
    rows = written(pullback.screen_rows(bars.join(chosen, "symbol", "left_semi")), "screen")
    said = screen.disclosures(calibrated, pullback.HORIZON, *pullback.CLAMP_DAYS, short, rows.count())
    return screen.markdown(rows, f"Pullback screen {config.interval} {now:%y-%m-%d %H:%M}", said)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="barloom")
    parser.add_argument("--config")
    parser.add_argument("--raw")
    parser.add_argument("--fetch")
    parser.add_argument("--run")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("update-all")
    commands.add_parser("update-symbol").add_argument("symbol")
    asked = commands.add_parser("structure")
    asked.add_argument("--symbol", required=True)
    asked.add_argument("--interval")
    asked.add_argument("--periods", type=int)
    asked.add_argument("--start", type=datetime.fromisoformat)
    asked.add_argument("--end", type=datetime.fromisoformat)
    asked.add_argument("--historical", action="store_true")
    commands.add_parser("similar").add_argument("--symbol", required=True)
    asked = commands.add_parser("lookup")
    asked.add_argument("--symbol", required=True)
    asked.add_argument("--rows", type=int, default=1)
    commands.add_parser("screen").add_argument("--out")
    asked = commands.add_parser("distinct-csv")
    asked.add_argument("source")
    asked.add_argument("target")
    asked.add_argument("--multiline", action="store_true")
    args = parser.parse_args(argv)
    began = time.monotonic()
    if not args.config and args.command != "distinct-csv":
        parser.error("--config is required")
    try:
        if args.command == "distinct-csv":
            csv.remove_duplicates(spark or SparkSession.builder.appName("barloom").getOrCreate(), args.source, args.target, args.multiline)
            return 0
        config = load_config(args.config)
        log = setup_logging(config.data_dir / "logs", datetime.now(UTC))
        spark = spark or SparkSession.builder.appName("barloom").getOrCreate()
        if args.command == "screen":
            now = datetime.now(UTC)
            folder = Path(args.out) if args.out else config.data_dir / "output"
            folder.mkdir(parents=True, exist_ok=True)
            text = released(spark, lambda: ask_screen(spark, config, now))
            place = folder / f"{now:%y-%m-%d-%H%M}-{config.interval}.md"
            place.write_text(text)
            print(place)
            return 0
        if args.command in ("structure", "similar", "lookup"):
            if args.command == "structure":
                request = structure.validate_request(args.symbol, args.interval or config.interval, args.start, args.end, args.periods, args.historical)
                answer = released(spark, lambda: ask_structure(spark, config, request))
            elif args.command == "similar":
                answer = released(spark, lambda: ask_similar(spark, config, args.symbol))
            else:
                answer = ask_lookup(spark, config, args.symbol, args.rows)
            print(json.dumps(answer, ensure_ascii=False))
            return 0
        if args.command == "update-all":
            wanted = read_symbols(spark, str(config.symbols_file))
        else:
            wanted = spark.createDataFrame([(check_symbol(args.symbol.strip()), 0)], "symbol string, ord long")
        now = datetime.now(UTC)
        first, last = config.window(now)
        if args.fetch:
            landing, run = Landing(spark, str(config.data_dir)), args.run or f"{now:%Y%m%dT%H%M%SZ}"
            options = {"interval": config.interval, "timeout": config.timeout, "threads": config.threads}
            landing.fetch(run, request_batches(wanted, config.batch_size), args.fetch, request(first, last, options))
            raw = landing.read(run).join(wanted.select("symbol"), "symbol", "left_semi").drop("batch")
        elif args.raw:
            raw = spark.read.parquet(args.raw).join(wanted.select("symbol"), "symbol", "left_semi")
        else:
            raise ValueError("--raw or --fetch is required")
        in_window = F.col("ts") >= wall_clock(datetime.combine(first, datetime.min.time()))
        if config.end_date:
            in_window &= F.col("ts") < wall_clock(datetime.combine(last + timedelta(days=1), datetime.min.time()))
        raw = raw.where(F.col("ts").isNull() | in_window)  # an error has no time
    except (OSError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    text, code = report(update(spark, str(config.data_dir), config.interval, raw, wanted, now, config.enabled).cache())
    print(text)
    log.info("Command completed duration_seconds=%.3f", time.monotonic() - began)
    return code


if __name__ == "__main__":
    sys.exit(main())
