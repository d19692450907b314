"""Boundary checks that read the data once, whatever the number of rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.indicators import INDICATOR_COLUMNS, NULLABLE

PRICE_COLUMNS = {"symbol": "string", "ts": "timestamp_ntz", "open": "double", "high": "double", "low": "double", "close": "double", "volume": "bigint"}


class ValidationError(ValueError):
    """The first broken rule."""


def _nulls(columns) -> Column:
    return reduce(lambda a, b: a + b, [F.count_if(F.col(c).isNull()) for c in columns])


def summary(df: DataFrame, strict: tuple[str, ...], by: str | None = None) -> DataFrame:
    """Rows, nulls, non-finite values, distinct keys and symbols, in one aggregate (per ``by``)."""
    numbers = [c for c, t in df.dtypes if t == "double" and c in strict]
    odd = reduce(lambda a, b: a + b, [F.count_if(F.isnan(c) | (F.abs(c) == float("inf"))) for c in numbers], F.lit(0))
    measures = [F.count("*").alias("n_rows"), _nulls(strict).alias("n_nulls"), odd.alias("n_non_finite"), F.count_distinct("symbol", "ts").alias("n_keys"), F.count_distinct("symbol").alias("n_symbols")]
    return df.groupBy(by).agg(*measures) if by else df.agg(*measures)


def _check(df: DataFrame, strict: tuple[str, ...], what: str, one_symbol: str | None, single: bool) -> None:
    got = summary(df, strict).first()
    if not got.n_rows:
        raise ValidationError(f"{what} is empty")
    if got.n_nulls:
        raise ValidationError(f"{what} contains nulls")
    if got.n_non_finite:
        raise ValidationError(f"{what} contains non-finite values")
    if single and got.n_symbols != 1:
        raise ValidationError(f"{what} contains multiple symbols")
    if one_symbol is not None and not df.where(F.col("symbol") != one_symbol).isEmpty():
        raise ValidationError(f"{what} contains unexpected symbols")
    if got.n_keys != got.n_rows:
        raise ValidationError(f"{what} contains duplicate timestamps")


def problems(df: DataFrame, strict: tuple[str, ...], what: str) -> DataFrame:
    """``symbol, error``: the first broken rule of each symbol that breaks one. Read back from files, rows of a symbol must also
    ascend in time inside each file."""
    found = summary(df, strict, "symbol")
    rule = (
        F.when(F.col("n_nulls") > 0, f"{what} contains nulls").when(F.col("n_non_finite") > 0, f"{what} contains non-finite values")
        .when(F.col("n_keys") != F.col("n_rows"), f"{what} contains duplicate timestamps")
    )
    found = found.select("symbol", rule.alias("error")).where("error IS NOT NULL")
    if not df.inputFiles():
        return found
    at = Window.partitionBy("symbol", "__file").orderBy("__row")
    placed = df.select("symbol", "ts", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    back = placed.withColumn("__back", F.col("ts") < F.lag("ts").over(at)).where("__back").select("symbol").distinct()
    unsorted = back.join(found, "symbol", "left_anti").select("symbol", F.lit(f"{what} is not sorted by timestamp").alias("error"))
    return found.unionByName(unsorted)


def price_problems(df: DataFrame) -> DataFrame:
    return problems(df, tuple(PRICE_COLUMNS), "price data")


def indicator_problems(df: DataFrame) -> DataFrame:
    return problems(df, ("symbol", "ts", *[c for c in INDICATOR_COLUMNS if c not in NULLABLE]), "indicator result")


def unsorted_symbols(df: DataFrame, sequence: str = "seq") -> DataFrame:
    """``symbol`` of those whose rows do not ascend in time by ``sequence``. Rows of a table have no order of their own, so
    one that counts must be a column."""
    back = F.col("ts") < F.lag("ts").over(Window.partitionBy("symbol").orderBy(sequence))
    return df.withColumn("__back", back).where("__back").select("symbol").distinct()


def validate_sorted(df: DataFrame, what: str, sequence: str = "seq") -> None:
    if not unsorted_symbols(df, sequence).isEmpty():
        raise ValidationError(f"{what} is not sorted by timestamp")


def validate_indicator_input(df: DataFrame, symbol: str | None = None, sequence: str | None = None) -> None:
    """Prices of one symbol, in order where a ``sequence`` column tells it."""
    validate_prices(df.drop(sequence) if sequence else df, symbol, single=True)
    if sequence:
        validate_sorted(df, "price data", sequence)


def validate_prices(df: DataFrame, symbol: str | None = None, single: bool = False) -> None:
    if dict(df.dtypes) != PRICE_COLUMNS:
        raise ValidationError("price schema does not match")
    _check(df, tuple(PRICE_COLUMNS), "price data", symbol, single)


def validate_indicators(df: DataFrame, symbol: str | None = None) -> None:
    if df.columns != ["symbol", "ts", *INDICATOR_COLUMNS]:
        raise ValidationError("indicator schema does not match")
    _check(df, ("symbol", "ts", *[c for c in INDICATOR_COLUMNS if c not in NULLABLE]), "indicator result", symbol, False)
