"""Configuration (TOML) and symbol lists (CSV)."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, fields
from datetime import date, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.calendar import interval


class ConfigError(ValueError):
    """A missing, unknown or invalid setting."""


@dataclass(frozen=True)
class Config:
    data_dir: Path
    symbols_file: Path
    interval: str
    start_date: date
    end_date: date | None = None
    batch_size: int = 50
    timeout: int = 30
    threads: bool = True
    enabled: bool = True

    def window(self, now: datetime) -> tuple[date, date]:
        """First and last day to ask for: up to ``end_date``, or up to the day of ``now``. Whether the candles of that day are
        complete is decided for each candle when they are normalized."""
        return self.start_date, self.end_date or now.date()


#: Sections and keys of each setting: our own first, then those of the published configuration files (fixed values).
_PLACES = {
    "data_dir": ("paths.data_dir",), "symbols_file": ("paths.symbols_file",), "interval": ("download.interval", "yahoo.interval"), "start_date": ("download.start_date", "download.initial_start_date"), "end_date": ("download.end_date",),
    "batch_size": ("vendor.batch_size", "yahoo.batch_size"), "timeout": ("vendor.timeout", "yahoo.timeout_seconds"), "threads": ("vendor.threads", "yahoo.threads"), "enabled": ("indicators.enabled",),
}
_TYPES = {"data_dir": str, "symbols_file": str, "interval": str, "start_date": date, "end_date": date, "batch_size": int, "timeout": int, "threads": bool, "enabled": bool}


def _typed(place: str, kind: type, value):
    """The value, where a date may also be given as ISO text."""
    if kind is date and isinstance(value, str):
        try:
            return date.fromisoformat(value)
        except ValueError as e:
            raise ConfigError(f"{place} is not a date: {value}") from e
    if not isinstance(value, kind) or kind is int and isinstance(value, bool) or isinstance(value, datetime):
        raise ConfigError(f"{place} must be of type {kind.__name__}")
    return value


def load_config(path: str | Path) -> Config:
    path = Path(path)
    raw = tomllib.loads(path.read_text())
    names, given = {p: name for name, places in _PLACES.items() for p in places}, {}
    for section, keys in raw.items():
        if not isinstance(keys, dict):
            raise ConfigError(f"unknown setting: {section}")
        for key, value in keys.items():
            name = names.get(f"{section}.{key}")
            if name is None:
                raise ConfigError(f"unknown setting: {section}.{key}")
            if name in given:
                raise ConfigError(f"{section}.{key} is given twice")
            given[name] = _typed(f"{section}.{key}", _TYPES[name], value)
    missing = [f.name for f in fields(Config) if f.name not in given and f.name in ("data_dir", "symbols_file", "interval", "start_date")]
    if missing:
        raise ConfigError(f"missing settings: {', '.join(missing)}")
    for key in ("data_dir", "symbols_file"):
        given[key] = (path.parent / given[key]).resolve()
    config = Config(**given)
    try:
        interval(config.interval)
    except ValueError as e:
        raise ConfigError(str(e)) from e
    if config.end_date and config.end_date < config.start_date:
        raise ConfigError("end_date is before start_date")
    if config.batch_size <= 0 or config.timeout <= 0:
        raise ConfigError("batch_size and timeout must be positive")
    return config


def read_symbols(spark: SparkSession, path: str) -> DataFrame:
    """``symbol, ord``: trimmed, in file order. Blank and repeated symbols and an empty list are refused; the
    file is read in one piece, as its order counts."""
    lines = spark.read.csv(str(path), header=True)
    if "symbol" not in lines.columns:
        raise ConfigError("the symbol list needs a symbol column")
    rows = lines.select(F.trim("symbol").alias("symbol"), F.monotonically_increasing_id().alias("ord"))
    got = rows.agg(F.count("*").alias("n"), F.count_if(F.coalesce("symbol", F.lit("")) == "").alias("blank"), F.count_distinct("symbol").alias("d")).first()
    if not got.n:
        raise ConfigError("the symbol list is empty")
    if got.blank:
        raise ConfigError("the symbol list has blank symbols")
    if got.d != got.n:
        raise ConfigError("the symbol list has duplicate symbols")
    return rows
