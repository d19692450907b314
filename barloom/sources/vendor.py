"""Vendor download: symbols in batches, one fetch for each batch, errors as rows.

The transport is a function ``(symbols, params) -> {symbol: [(ts, o, h, l, c, v)]}`` named by ``module:function``, so that
executors import it; none is shipped, as the engine needs no network. What tasks fetch goes to a landing table
(``sources.landing``), from which everything later reads.
"""

from __future__ import annotations

import importlib
from datetime import date, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.blocks import positions

FETCHED = "batch long, symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double, seq long, error string"
NO_DATA = "no data after the symbol was asked for alone"
#: Ids in a cell while symbols are numbered.
_CELL = 4096


def request_batches(symbols: DataFrame, size: int, order: str = "ord") -> DataFrame:
    """``symbol, ord, batch``: consecutive batches of ``size`` symbols in the order of the long column ``order``."""
    rows = positions(symbols.select("symbol", F.col(order).cast("long").alias("ord")), [], F.expr(f"ord div {_CELL}L"), ["ord", "symbol"], "place")
    return rows.select("symbol", "ord", F.expr(f"place div {size}L").alias("batch"))


def request(start: date, end: date, options: dict) -> dict:
    """The vendor's end is exclusive; prices are adjusted and corporate actions left out."""
    return {"interval": options.get("interval", "1d"), "start": start.isoformat(), "end": (end + timedelta(days=1)).isoformat(), "auto_adjust": True, "actions": False, "threads": str(options.get("threads", True)).lower() == "true", "timeout": int(options.get("timeout", 30))}


def download(fetch, symbols: list[str], params: dict):
    """Rows of one batch. A failed batch gives every symbol its error; symbols that were not delivered are
    asked for once more one by one."""
    try:
        got = fetch(symbols, params)
    except Exception as e:  # errors are data here
        return [(s, *[None] * 6, str(e)) for s in symbols]
    rows = []
    for s in symbols:
        bars, error = got.get(s) or [], None
        if not bars:
            try:
                bars = fetch([s], params).get(s) or []
            except Exception as e:
                error = str(e)
            if not bars:
                rows.append((s, *[None] * 6, error or NO_DATA))
        rows += [(s, *b, None) for b in bars]
    return rows


def fetch_batches(requests: DataFrame, fetch: str, params: dict) -> DataFrame:
    """``FETCHED`` rows of all batches of ``requests``; a batch is one call of the transport in one task, and ``seq`` is the
    place of a row in what it delivered."""
    whole = requests.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("ord", "symbol"))).alias("asked"))
    whole = whole.select("batch", F.transform("asked", lambda x: x["symbol"]).alias("symbols"))  # a batch is bounded by its size

    def run(batches):
        module, name = fetch.split(":")
        transport = getattr(importlib.import_module(module), name)
        for b in batches:
            for batch, symbols in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows = download(transport, symbols, params)
                names, *values, errors = zip(*rows)
                columns = [pa.array([batch] * len(rows), pa.int64()), pa.array(names, pa.string()), pa.array(values[0], pa.timestamp("us"))]
                columns += [pa.array([None if v is None else float(v) for v in c], pa.float64()) for c in values[1:]]
                columns += [pa.array(range(len(rows)), pa.int64()), pa.array(errors, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in FETCHED.split(", ")])

    return whole.mapInArrow(run, FETCHED)


def missing_symbols(requested: DataFrame, delivered: DataFrame) -> DataFrame:
    return requested.join(delivered.select("symbol").distinct(), "symbol", "left_anti")


def batch_outcomes(requests: DataFrame, rows: DataFrame, failed: DataFrame) -> DataFrame:
    """``symbol, batch, n_rows, error``: what came of each request. The error of a failed batch (``batch, error``) is that of
    all its symbols; others without rows have no data."""
    counts = rows.where("error IS NULL").groupBy("symbol").agg(F.count("*").alias("n_rows"))
    found = requests.join(failed.select("batch", F.col("error").alias("__failed")), "batch", "left").join(counts, "symbol", "left")
    n = F.when(F.col("__failed").isNull(), F.coalesce("n_rows", F.lit(0))).otherwise(0)
    return found.select("symbol", "batch", n.alias("n_rows"), F.coalesce("__failed", F.when(F.col("n_rows").isNull(), NO_DATA)).alias("error"))
