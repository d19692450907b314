from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.functions.indicators import INDICATOR_COLUMNS, indicator_table, with_indicators
from barloom.operators.validate import ValidationError, validate_indicators, validate_prices
from barloom.sources.store import changed_symbols, fingerprints

SCHEMA = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume long"


def history(days=500, high_at=None, quiet=0):
    out = []
    for i in range(days):
        c = 100 + 0.2 * i + i % 7
        out.append(("TCS.NS", datetime(2024, 1, 1) + timedelta(days=i), c - 0.5, 1000.0 if i == high_at else c + 1, c - 1, c, 0 if i < quiet else 1000 + 10 * i))
    return out


@pytest.fixture(scope="module")
def frame(spark):
    return lambda *a, **k: spark.createDataFrame(history(*a, **k), SCHEMA)


def ema(v, n, start=None):
    start = n - 1 if start is None else start
    out = np.full(len(v), np.nan)
    out[start] = v[start - n + 1 : start + 1].mean()
    for i in range(start + 1, len(v)):
        out[i] = out[i - 1] + (v[i] - out[i - 1]) * 2 / (n + 1)
    return out


def test_recurrences_match_a_plain_loop(frame):
    # longer than one block of the scan
    x = with_indicators(frame(1200)).orderBy("ts").toPandas()
    c = x.close.to_numpy()
    for n in (10, 200):
        np.testing.assert_allclose(x[f"ema_{n}"], ema(c, n), rtol=1e-12)
    macd = ema(c, 12, 25) - ema(c, 26)
    np.testing.assert_allclose(x.macd_12_26[33:], macd[33:], rtol=1e-9)
    signal = np.full(len(c), np.nan)
    signal[33] = macd[25:34].mean()
    for i in range(34, len(c)):
        signal[i] = 0.8 * signal[i - 1] + 0.2 * macd[i]
    np.testing.assert_allclose(x.macd_signal_9, signal, rtol=1e-9)


def test_wilder_values(frame):
    x = with_indicators(frame(60)).orderBy("ts").toPandas()
    d = np.diff(x.close, prepend=x.close[0])
    g, l = np.maximum(d, 0), np.maximum(-d, 0)
    a, b = g[1:15].mean(), l[1:15].mean()
    assert x.rsi_14.first_valid_index() == 14 and abs(x.rsi_14[14] - 100 * a / (a + b)) < 1e-9
    for i in range(15, 60):
        a, b = (13 * a + g[i]) / 14, (13 * b + l[i]) / 14
    assert abs(x.rsi_14[59] - 100 * a / (a + b)) < 1e-9
    assert x.atr_14.first_valid_index() == 14 and x.plus_di_14.first_valid_index() == 14 and x.adx_14.first_valid_index() == 27


def test_history_gate(frame):
    assert indicator_table(frame(365)).count() == 0
    out = indicator_table(frame(367)).orderBy("ts").toPandas()
    assert len(out) == 2 and out.ts[0] == datetime(2024, 12, 31) and out[list(INDICATOR_COLUMNS)].notna().all().all()


def test_calendar_window(frame):
    out = indicator_table(frame(500, high_at=100)).orderBy("ts").toPandas()
    assert out.trailing_365d_high.iloc[-1] < 1000 and out.trailing_365d_high.iloc[0] == 1000


def test_bands_are_centred_on_the_average(frame):
    x = indicator_table(frame()).orderBy("ts").toPandas()
    np.testing.assert_allclose(x.band_middle_20, x.ema_20)
    np.testing.assert_allclose(x.band_upper_20_2 - x.band_middle_20, x.band_middle_20 - x.band_lower_20_2)


def test_volume_ratio_may_be_null(frame):
    assert indicator_table(frame(500, quiet=500)).where("relative_volume_20 IS NULL").count() == indicator_table(frame()).count()


def test_fingerprint_follows_content(frame):
    a = frame(30)
    b = a.withColumn("close", F.when(F.dayofyear("ts") == 10, F.col("close") + 1).otherwise(F.col("close")))
    assert changed_symbols(fingerprints(b), fingerprints(a)).first().changed
    assert not changed_symbols(fingerprints(a.repartition(3)), fingerprints(a)).first().changed


def test_validators(spark, frame):
    validate_prices(frame(5), "TCS.NS", single=True)
    for bad, words in (
        (frame(0), "empty"), (frame(5).withColumn("close", F.lit(None).cast("double")), "nulls"), (frame(5).union(frame(5)), "duplicate"), (frame(5).drop("volume"), "schema"),
        (frame(5).withColumn("close", F.lit(float("nan"))), "non-finite"),
    ):
        with pytest.raises(ValidationError, match=words):
            validate_prices(bad)
    two = frame(5).union(frame(5).withColumn("symbol", F.lit("B")))
    with pytest.raises(ValidationError, match="multiple symbols"):
        validate_prices(two, single=True)
    with pytest.raises(ValidationError, match="empty"):
        validate_indicators(indicator_table(frame(100)))
