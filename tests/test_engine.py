import json
import math
import random
import re
from datetime import UTC, date, datetime, timedelta
from pathlib import Path
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from barloom import cli
from barloom.functions import calendar
from barloom.functions.blocks import positions
from barloom.operators import normalize, pullback, screen, similarity, structure, validate, windows
from barloom.functions.indicators import indicator_table, with_indicators
from barloom.plans import update as plan
from barloom.plans.update import refresh_indicators, report, stores, update
from barloom.sources import config, landing, vendor
from barloom.sources.shared import written
from barloom.sources.store import Store, StoreError, block_digests, changed_blocks, check_symbol, load_indicators, load_prices_with_indicators, require_native, root_digests
from barloom.streaming.bars import stream_bars
from test_indicators import SCHEMA, history
from tests.transport import NOTES

RAW = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double, seq long"


def complete(spark, name, ts, now):
    return spark.range(1).select(calendar.is_complete(name, F.lit(ts), F.lit(now))).first()[0]


@pytest.mark.parametrize(("name", "ts", "now", "want"), [
    ("30m", datetime(2026, 6, 8, 10, 0), datetime(2026, 6, 8, 10, 47), True), ("30m", datetime(2026, 6, 8, 10, 30), datetime(2026, 6, 8, 10, 47), False),
    ("1d", datetime(2026, 6, 8), datetime(2026, 6, 8, 15, 59), False), ("1d", datetime(2026, 6, 8), datetime(2026, 6, 8, 16, 0), True),
    ("1wk", datetime(2026, 6, 8), datetime(2026, 6, 10), False), ("1wk", datetime(2026, 6, 1), datetime(2026, 6, 10), True), ("1wk", datetime(2026, 6, 22), datetime(2026, 6, 10), True),
    ("1mo", datetime(2026, 6, 1), datetime(2026, 6, 10), False), ("3mo", datetime(2026, 4, 1), datetime(2026, 6, 10), False), ("3mo", datetime(2026, 1, 1), datetime(2026, 6, 10), True),
    ("5d", datetime(2026, 6, 5), datetime(2026, 6, 8), False),
])
def test_completed(spark, name, ts, now, want):
    assert complete(spark, name, ts, now) is want


def test_intervals():
    assert len(calendar.INTERVALS) == 13
    with pytest.raises(ValueError, match="unknown interval"):
        calendar.interval("2h")
    with pytest.raises(StoreError, match="derived interval"):
        require_native("1wk", ("1h", "1d"))


def test_split_wide(spark):
    wide = spark.createDataFrame([(datetime(2026, 6, 5), 1.0, 2.0, 0.5, 1.5, 9.0, None)], "ts timestamp_ntz, `Open|A` double, `High|A` double, `Low|A` double, `Close|A` double, `A|Volume` double, `Close|B` double")
    assert [tuple(r) for r in normalize.split_wide(wide).collect()] == [("A", datetime(2026, 6, 5), 1.0, 2.0, 0.5, 1.5, 9.0)]


def test_normalize_isolates_failures(spark):
    t = datetime(2026, 6, 5)
    rows = [
        ("A", t, 1.0, 2.0, 0.5, 1.5, 10.0, 0), ("A", t, 1.0, 2.0, 0.5, 1.6, 10.0, 1), ("A", t + timedelta(days=1), None, None, None, None, None, 2), ("A", datetime(2026, 6, 9), 1.0, 2.0, 0.5, 1.5, 10.0, 3),
        ("B", t, 1.0, 2.0, 0.5, 1.5, None, 0), ("C", t, 1.0, 2.0, 0.5, 1.5, 1.5, 0), ("D", datetime(2026, 6, 9), 1.0, 2.0, 0.5, 1.5, 1.0, 0), ("E", t, None, None, None, None, None, 0),
    ]
    good, bad = normalize.normalize(spark.createDataFrame(rows, RAW), "1d", F.lit(datetime(2026, 6, 8)))
    assert [(r.symbol, r.close, r.volume) for r in good.collect()] == [("A", 1.6, 10)]
    assert {r.symbol: r.error for r in bad.collect()} == {"B": "candles are partially missing", "C": "volume is not integral", "D": "no completed rows", "E": "no candles"}
    with pytest.raises(ValueError, match="missing columns: volume"):
        normalize.normalize(spark.createDataFrame(rows, RAW).drop("volume"), "1d", F.lit(t))


def test_greedy_windows(spark):
    df = spark.createDataFrame([("S", s, e, d) for s, e, d in ((0, 9, 0.1), (5, 14, 0.2), (10, 19, 0.3), (20, 29, 0.4))], "symbol string, s long, e long, d double")
    assert [r.s for r in windows.greedy_windows(df, "d", "s", "e").orderBy("position").collect()] == [0, 10, 20]
    assert windows.greedy_windows(df, "d", "s", "e", most=2).count() == 2


def test_rolling_list(spark):
    df = spark.createDataFrame([("S", i, float(i)) for i in range(12)], "symbol string, ts long, v double")
    got = windows.rolling_list(df, "v").orderBy("ts").collect()
    assert got[8]["values"] is None and got[11]["values"] == [float(i) for i in range(2, 12)]


PATHS = {
    "ascending-channel": (100, 108, 104, 112, 108, 116, 112, 120), "descending-channel": (120, 112, 116, 108, 112, 104, 108, 100), "double-bottom": (125, 108, 118, 108.5, 116, 114, 115), "double-top": (95, 112, 102, 111.5, 104, 106, 105),
    "head-and-shoulders": (100, 112, 105, 120, 105, 112, 100), "inverse-head-and-shoulders": (120, 108, 115, 100, 115, 108, 120), "ascending-triangle": (100, 112, 104, 112, 107, 112, 109, 111),
    "descending-triangle": (112, 100, 108, 100, 105, 100, 103, 101), "symmetrical-triangle": (112, 100, 109, 103, 107, 105, 106, 105.5), "horizontal-range": (100, 110, 100.5, 109.5, 100, 110, 100.5, 109.5),
}


def path(pivots):
    out = [float(a + (b - a) * k / 7.0) for a, b in zip(pivots, pivots[1:]) for k in range(7)]
    return [*out, float(pivots[-1])]


def read_chart(spark, closes):
    bars = spark.createDataFrame([("T", datetime(2026, 1, 1) + timedelta(hours=i), c, c + 1, c - 1, c, 1000, i) for i, c in enumerate(closes)], SCHEMA + ", idx long")
    zz = pullback.zigzag(pullback.fractal_pivots(bars, 3))
    return structure.analyze_frame(bars, zz, {"symbol": "T", "requested_interval": "1h", "source_interval": "1h", "derived": False})[0], bars, zz


def named(doc, name):
    return next(x for x in doc["patterns"] if x["name"] == name)


@pytest.mark.parametrize("name", PATHS)
def test_chart_structure(spark, name):
    doc, _, _ = read_chart(spark, path(PATHS[name]))
    found = named(doc, name)
    assert 0.5 <= found["confidence"] <= 1 and found["evidence"] and found["confirmation_level"] is not None and found["invalidation_level"] is not None
    assert all(x["status"] in ("developing", "confirmed", "invalidated") for x in doc["patterns"]) and "historical" not in doc and doc["data"]["derived"] is False
    if "channel" in name:
        up = name.startswith("ascending")
        assert (doc["structure"]["trend"], doc["structure"]["swing_sequence"]) == (("bullish", "higher-highs-higher-lows") if up else ("bearish", "lower-highs-lower-lows"))


def test_confirmation_and_breakout(spark):
    assert named(read_chart(spark, path(PATHS["double-bottom"]) + [120.0, 123.0])[0], "double-bottom")["status"] == "confirmed"
    assert named(read_chart(spark, path(PATHS["double-top"]) + [100.0, 96.0])[0], "double-top")["status"] == "confirmed"
    closes = [120.0 - i for i in range(20)] + [101.0, 99.0, 102.0, 106.0, 103.0, 100.0, 102.0, 105.0, 104.0, 103.0] * 4
    assert named(read_chart(spark, closes)[0], "double-bottom")["status"] == "developing"
    assert read_chart(spark, path(PATHS["ascending-triangle"]) + [120.0, 123.0])[0]["structure"]["breakout_state"] == "breakout"
    assert read_chart(spark, [100.0, 103.0, 101.0, 104.0, 100.0, 103.0] * 10)[0]["structure"]["formation"] == "horizontal-range"
    sharp, blunt = (named(read_chart(spark, path((95, 112, 102, h, 104, 106, 105)))[0], "double-top")["confidence"] for h in (111.9, 110.9))
    assert sharp > blunt


def test_command_line_answers_as_json(spark, tmp_path, capsys):
    config_file = tmp_path / "c.toml"
    config_file.write_text('[paths]\ndata_dir = "data"\nsymbols_file = "s.csv"\n[download]\ninterval = "1d"\nstart_date = 2024-01-01\nend_date = 2026-01-01\n[indicators]\nenabled = true\n')
    (tmp_path / "s.csv").write_text("symbol\nA\n0050\n")
    waves = [c + 30 * math.sin(i / 13) for i, c in enumerate(path([100, 110, 100.5, 109.5] * 20)[:500])]
    raw = [(s, datetime(2024, 1, 1) + timedelta(days=i), c, c + 1, c - 1, c, 1000.0, i) for s in ("A", "0050") for i, c in enumerate(waves)]
    raw += [("A", datetime(2026, 1, 2), 1.0, 1.0, 1.0, 1.0, 1.0, 999)]  # after the end of the window
    spark.createDataFrame(raw, RAW).write.parquet(str(tmp_path / "raw"))
    run = lambda *a: cli.main(["--config", str(config_file), *a], spark)
    assert run("--raw", str(tmp_path / "raw"), "update-all") == 0 and "Successful: 2" in capsys.readouterr().out
    assert run("structure", "--symbol", "0050", "--periods", "90") == 0
    doc = json.loads(capsys.readouterr().out)
    assert doc["data"] == {"symbol": "0050", "requested_interval": "1d", "source_interval": "1d", "derived": False, "periods": 90} and "historical" not in doc and doc["patterns"]
    assert run("structure", "--symbol", "A", "--interval", "1wk", "--start", "2024-01-01", "--historical") == 0
    doc = json.loads(capsys.readouterr().out)
    assert doc["data"]["derived"] is True and doc["data"]["source_interval"] == "1d" and doc["historical"]["horizons"] == [5, 10, 20]
    assert run("lookup", "--symbol", "A", "--rows", "2") == 0
    rows = json.loads(capsys.readouterr().out)["rows"]
    assert [r["ts"] for r in rows] == [(datetime(2024, 1, 1) + timedelta(days=i)).isoformat() for i in (498, 499)] and rows[0]["ema_200"] is not None
    assert run("similar", "--symbol", "A") == 0
    doc = json.loads(capsys.readouterr().out)
    assert doc["data"]["match_count"] == len(doc["matches"]) and "adjusted" in doc["data"]["warning"]
    assert doc["data"]["max_matches"] == 200 and all(x["position"] == i + 1 for i, x in enumerate(doc["matches"]))
    assert run("structure", "--symbol", "NONE") == 2 and run("structure", "--symbol", "A", "--periods", "20") == 2 and run("update-all") == 2


def test_windows_in_order(spark):
    df = spark.createDataFrame([("S", s, e) for s, e in ((0, 9), (5, 14), (9, 12), (10, 19), (10, 11), (30, 31))], "symbol string, s long, e long")
    assert [(r.s, r.e) for r in windows.first_windows(df, "s", "e").orderBy("position").collect()] == [(0, 9), (10, 11), (30, 31)]


def test_windows_in_order_against_a_loop(spark):
    rng = random.Random(3)
    rows = [(g, s, s + rng.randint(0, 30), i) for g in "ABC" for i, s in enumerate(rng.choices(range(400), k={"A": 150, "B": 40, "C": 1}[g]))]
    want = set()
    for g in "ABC":
        upto, n = -1, 0
        for _, s, e, i in sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2])):
            if s > upto:
                upto, n = e, n + 1
                want.add((g, n, s, e))
    got = windows.first_windows(spark.createDataFrame(rows, "symbol string, s long, e long, tag long"), "s", "e").collect()
    assert {(r.symbol, r.position, r.s, r.e) for r in got} == want and len(got) == len(want)
    assert windows.first_windows(spark.createDataFrame([], "symbol string, s long, e long"), "s", "e").count() == 0


def test_pruned_search_equals_comparing_all(spark):
    """Few matches of many candidates: bounds leave some out, and the choice is that of the plain distances."""
    bars = written(with_indicators(spark.createDataFrame([r for r in bars_of(2400, "AB") if r[0] == "B"], SCHEMA)), "bars")
    found, compared = similarity.search(bars, most=1)
    counts = {r.symbol: (r.n_candidates, r.n_compared) for r in compared.collect()}
    told = similarity.features(bars).collect()
    vectors = {g: "volume_vector" if g == "volume" else g for g in similarity.SUBGROUPS}
    got = {(r.symbol, r.position): r for r in found.collect()}
    for s in "B":
        own = sorted((r for r in told if r.symbol == s), key=lambda r: r.idx)
        last = own[-1]
        near = []
        for r in own:
            if r.idx < last.first_idx and all(r[c] == last[c] for c in similarity.CONTEXT):
                d = [math.sqrt(sum((x - y) ** 2 for x, y in zip(r[v], last[v])) / len(r[v])) for v in vectors.values()]
                near.append((sum(d) / 6, r.first_idx, r.idx))
        near.sort()
        taken = []
        for d, a, b in near:
            if len(taken) < 1 and all(b < x or a > y for _, x, y in taken):
                taken.append((d, a, b))
        assert counts[s][0] == len(near)
        assert [(got[s, k + 1].first_idx, got[s, k + 1].idx) for k in range(len(taken))] == [t[1:] for t in taken]
        assert all(math.isclose(got[s, k + 1].combined_distance, t[0], rel_tol=1e-9) for k, t in enumerate(taken))
    assert all(m < n for n, m in counts.values())
    one = similarity.features(bars).where("idx = 500").first()
    assert [len(one[v]) for v in vectors.values()] == [50, 30, 41, 20, 30, 10]


def test_csv_keeps_the_first_of_equal_rows_in_order(spark, tmp_path):
    rows = ["b,2", 'a,"x, ""y"""', "b,2", "a,1", "c,", 'a,"x, ""y"""', "b,3", ",", "b,2"] + [f"k{i % 40},{i % 7}" for i in range(3000)]
    (tmp_path / "in").mkdir()
    for k, part in enumerate((rows[:5], rows[5:1000], rows[1000:])):  # three files, in the order of their names
        (tmp_path / "in" / f"{k}.csv").write_text("name,value\n" + "\n".join(part) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        assert cli.main(["distinct-csv", str(tmp_path / "in"), str(tmp_path / "out")], spark) == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    import csv as plain

    read = lambda paths: [tuple(r) for p in paths for r in list(plain.reader(p.open(newline="")))[1:]]
    want = list(dict.fromkeys(read(sorted((tmp_path / "in").glob("*.csv")))))
    assert read(sorted((tmp_path / "out").glob("part-*.csv"))) == want
    assert all(p.read_text().startswith("name,value\n") for p in (tmp_path / "out").glob("part-*.csv"))


def test_localized_times(spark):
    """Aware times are moved to the exchange, naive ones are meant so; both as in the vendor's frames."""
    first = int(datetime(2026, 6, 8, 4, 15, tzinfo=UTC).timestamp())
    rows = [("T", first + 1800 * k, 100.0, 105.0, 99.0, 104.0, 1000.0, k) for k in range(2)]
    aware = spark.createDataFrame(rows, "symbol string, Datetime long, Open double, High double, Low double, Close double, Volume double, seq int").withColumn("Datetime", F.timestamp_seconds("Datetime"))
    for zone in ("UTC", "America/New_York", "Asia/Kolkata"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            good, _ = normalize.normalize(normalize.localize(normalize.named(aware)), "30m", calendar.wall_clock(datetime(2026, 6, 8, 10, 30)))
            assert [r.ts for r in good.collect()] == [datetime(2026, 6, 8, 9, 45)]
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
    naive = spark.createDataFrame([("T", datetime(2026, 6, 5), 100.0, 105.0, 99.0, 104.0, 1000.0, 0)], "symbol string, Date timestamp_ntz, Open double, High double, Low double, Close double, Volume double, seq int")
    assert [r.ts for r in normalize.normalize(normalize.localize(normalize.named(naive)), "1d", F.lit(datetime(2026, 6, 6)))[0].collect()] == [datetime(2026, 6, 5)]
    assert normalize.localize(spark.createDataFrame([(-1,)], "m long").select(F.timestamp_micros("m").alias("ts"))).first().ts == datetime(1970, 1, 1, 5, 29, 59, 999999)
    with pytest.raises(ValueError, match="offset"):
        normalize.localize(aware, "Datetime", "Europe/Berlin")
    with pytest.raises(ValueError, match="missing columns: high, volume"):
        normalize.named(naive.drop("High", "Volume"))


def test_screen_command(spark, tmp_path, capsys):
    rows = bars_of(500, "ABCDE")
    (tmp_path / "c.toml").write_text('[paths]\ndata_dir = "data"\nsymbols_file = "s.csv"\n[download]\ninterval = "1d"\nstart_date = 2015-01-01\n')
    stores(spark, str(tmp_path / "data"), "1d")[0].replace(spark.createDataFrame(rows, SCHEMA))
    assert cli.main(["--config", str(tmp_path / "c.toml"), "screen"], spark) == 0
    text = Path(capsys.readouterr().out.strip()).read_text()
    assert "analyzed" in text and "| Symbol | tier |" in text
    said = text.rsplit("_Disclosures: ", 1)[1]
    assert re.match(r"W (stable|sensitive), overlap [\d.]+, W=(\d+|\[60, 120, 240\]); bars/day=7; H_base=15, clamp 0.5–10d; 0 excluded for a short history; \d+ shortlisted, \d+ analyzed;", said)


def test_batches_are_fetched_once(spark, tmp_path):
    NOTES.write_text(str(tmp_path))
    calls = lambda: sorted(f.read_text() for f in tmp_path.iterdir() if f.is_file())
    names = ["AB", "C,D", "RX", "ZZ", "EE", "FFF", "G"]
    asked = vendor.request_batches(spark.createDataFrame([(n, i) for i, n in enumerate(names)], "symbol string, ord long"), 3)
    land = landing.Landing(spark, f"file://{tmp_path}/store")
    assert land.fetch("r1", asked, "tests.transport:noted_fetch", vendor.request(date(2024, 1, 1), date(2024, 1, 1), {})) == [0, 1, 2]
    first = ["AB,C,D,RX", "G", "RX", "ZZ,EE,FFF"]  # three batches and one symbol asked for alone
    assert calls() == first
    got = {r.symbol: (r.batch, r.close, r.error) for r in land.read("r1").collect()}
    assert got == {"AB": (0, 2.0, None), "C,D": (0, 3.0, None), "RX": (0, None, vendor.NO_DATA), "ZZ": (1, None, "refused"), "EE": (1, None, "refused"), "FFF": (1, None, "refused"), "G": (2, 1.0, None)}
    # the same run again fetches nothing, whatever is done with its rows
    assert land.fetch("r1", asked, "tests.transport:noted_fetch", {}) == []
    update(spark, f"file://{tmp_path}/store", "1h", land.read("r1"), asked.select("symbol", "ord"), datetime(2024, 1, 3, tzinfo=UTC)).collect()
    assert calls() == first
    # a batch that is gone, as after a job that died, is the only one to be fetched
    land.folder.delete("run=r1/batch=2")
    assert land.fetch("r1", asked, "tests.transport:noted_fetch", {}) == [2] and calls() == sorted([*first, "G"])


def test_landed_batches_of_a_job_that_dies_stay(spark, tmp_path):
    land = landing.Landing(spark, f"file://{tmp_path}")
    row = lambda b, s, c: (b, s, datetime(2024, 1, 1), 1.0, 1.0, 1.0, c, 1.0, 0, None)
    frame = spark.createDataFrame([row(k, f"S{k}", float(k)) for k in range(4)], vendor.FETCHED).repartitionByRange(4, "batch")
    bad = frame.withColumn("close", F.when(F.col("batch") == 3, F.raise_error(F.lit("lost"))).otherwise(F.col("close")))
    with pytest.raises(Exception, match="lost"):
        land.put("r", bad)
    there = land.landed("r")
    assert 3 not in there
    assert land.put("r", frame.withColumn("close", F.lit(9.0))) == sorted({0, 1, 2, 3} - set(there))
    assert {r.batch: r.close for r in land.read("r").collect()} == {k: float(k) if k in there else 9.0 for k in range(4)}
    assert land.read("other").count() == 0
    with pytest.raises(ValueError, match="invalid run"):
        land.put("../x", frame)


def test_vendor_request_and_window():
    assert vendor.request(date(2024, 1, 1), date(2024, 1, 2), {"interval": "1h", "threads": "False"}) | {"timeout": 0} == {"interval": "1h", "start": "2024-01-01", "end": "2024-01-03", "auto_adjust": True, "actions": False, "threads": False, "timeout": 0}
    c = config.Config("d", "s", "1d", date(2024, 1, 1))
    assert c.window(datetime(2026, 6, 8, 14)) == (date(2024, 1, 1), date(2026, 6, 8))  # the day of now: its completed hours count


def test_the_hours_of_today_are_stored(spark, tmp_path, capsys):
    """An update at 14:00 keeps the hours that are over, not only whole days."""
    now = datetime.now(ZoneInfo(calendar.ZONE)).replace(tzinfo=None)
    hour = now.replace(minute=0, second=0, microsecond=0)
    rows = [("A", hour - timedelta(hours=k), 1.0, 2.0, 0.5, 1.5, 1.0, 9 - k) for k in range(4)]
    spark.createDataFrame(rows, RAW).write.parquet(str(tmp_path / "raw"))
    (tmp_path / "s.csv").write_text("symbol\nA\n")
    (tmp_path / "c.toml").write_text('[paths]\ndata_dir = "data"\nsymbols_file = "s.csv"\n[download]\ninterval = "1h"\nstart_date = 2024-01-01\n')
    assert cli.main(["--config", str(tmp_path / "c.toml"), "--raw", str(tmp_path / "raw"), "update-all"], spark) == 0
    assert {r.ts for r in stores(spark, str(tmp_path / "data"), "1h")[0].read().collect()} == {hour - timedelta(hours=k) for k in (1, 2, 3)}


@pytest.mark.parametrize(("interval", "start"), [("1h", "2024-12-01"), ("1d", "2014-12-01")])
def test_published_configuration_files(tmp_path, interval, start):
    """The layout that existing configuration files have."""
    text = f"""[paths]
data_dir = "../market-data"
symbols_file = "../market-data/metadata/symbols.csv"
[download]
initial_start_date = "{start}"
[yahoo]
interval = "{interval}"
batch_size = 50
timeout_seconds = 30
threads = true
[indicators]
enabled = true
"""
    (tmp_path / "config").mkdir()
    f = tmp_path / "config" / "c.toml"
    f.write_text(text)
    c = config.load_config(f)
    assert c == config.Config((tmp_path / "market-data").resolve(), (tmp_path / "market-data/metadata/symbols.csv").resolve(), interval, date.fromisoformat(start))
    f.write_text(text.replace(start, "soon"))
    with pytest.raises(config.ConfigError, match="not a date"):
        config.load_config(f)
    f.write_text(text + "[vendor]\nbatch_size = 3\n")
    with pytest.raises(config.ConfigError, match="given twice"):
        config.load_config(f)


def test_positions(spark):
    """Numbers over many cells equal those of one window, nulls of the key included."""
    rng = random.Random(0)
    rows = sorted({(rng.choice(["A", "B", None]), rng.randint(0, 5000)) for _ in range(600)}, key=str)
    df = spark.createDataFrame(rows, "symbol string, t long")
    got = {(r.symbol, r.t): r.idx for r in positions(df, ["symbol"], F.expr("t div 100"), ["t"], nulls=True).collect()}
    assert got == {(s, t): sum(1 for s2, t2 in rows if s2 == s and t2 < t) for s, t in rows}


def test_sorted(spark):
    t = datetime(2026, 1, 1)
    df = spark.createDataFrame([("A", t, 0), ("A", t + timedelta(1), 1), ("B", t + timedelta(1), 0), ("B", t, 1)], "symbol string, ts timestamp_ntz, seq long")
    assert [r.symbol for r in validate.unsorted_symbols(df).collect()] == ["B"]
    with pytest.raises(validate.ValidationError, match="not sorted"):
        validate.validate_sorted(df, "price data")


def test_chart_history(spark):
    pivots = [100, 110, 100.5, 109.5] * 8 + [100]
    out = [float(a + (b - a) * k / 7.0) for a, b in zip(pivots, pivots[1:]) for k in range(7)] + [100.0]
    bars = spark.createDataFrame([("T", datetime(2026, 1, 1) + timedelta(hours=i), c, c + 1, c - 1, c, 1000, i) for i, c in enumerate(out)], SCHEMA + ", idx long")
    zz = pullback.zigzag(pullback.fractal_pivots(bars, 3))
    got = structure.historical(bars, zz).orderBy("position").collect()
    now = sorted(r.idx for r in zz.collect())[-7]
    assert [(r.window_start_index, r.window_end_index) for r in got] == [(7, 49), (56, 98), (105, 147)]
    assert all(r.window_end_index < now and r.formation == structure.analyze(bars, zz).first().formation for r in got)
    assert abs(got[0].return_5 - (out[54] / out[49] - 1) * 100) < 1e-9
    assert structure.historical(bars, zz.where("run < 7")).count() == 0


def test_validate_request():
    with pytest.raises(ValueError, match="at least"):
        structure.validate_request("A", periods=20)
    assert structure.validate_request("A").periods == 120 and structure.validate_request("A", start=datetime(2026, 1, 1)).periods is None
    with pytest.raises(ValueError, match="before"):
        structure.validate_request("A", start=datetime(2026, 1, 2), end=datetime(2026, 1, 1))
    with pytest.raises(ValueError):
        structure.validate_request(" ")
    with pytest.raises(ValueError):
        similarity.validate_symbol("")


def test_tier_order(spark):
    base = {"now_off_high": 5.0, "live_low_dip": 6.0, "live_low": 90.0, "floor_price": 80.0, "band_lo": 4.0, "band_hi": 8.0, "bounce_base": 0.6, "turn_confirmed": True, "recovery": "fast", "uptrend": True}
    # a broken trend, and a close that is deeper than the band but not by half
    cases = [({"uptrend": False}, "CAUTION"), ({"uptrend": False, "turn_confirmed": False}, "CAUTION"), ({"now_off_high": 9.5, "live_low_dip": 9.6}, "SPEC"), ({"now_off_high": 9.5, "live_low_dip": 9.6, "turn_confirmed": False}, "SPEC")]
    cases += [({"now_off_high": 9.5, "live_low_dip": 7.0}, "BUY"), ({"now_off_high": 4.0}, "BUY"), ({"now_off_high": 8.0, "live_low_dip": 8.5}, "BUY"), ({}, "BUY"), ({"recovery": "slow"}, "PATIENT"), ({"bounce_base": 0.4}, "SPEC"), ({"turn_confirmed": False}, "WAIT"), ({"now_off_high": 1.0}, "WATCH"), ({"live_low": 70.0}, "CAUTION"), ({"live_low_dip": 20.0}, "AVOID")]
    df = spark.createDataFrame([base | c for c, _ in cases])
    assert [r.tier for r in pullback.tier(df).collect()] == [t for _, t in cases]


def test_vendor_retries_and_isolates():
    calls = []

    def fetch(symbols, params):
        calls.append(tuple(symbols))
        if "X" in symbols:
            raise OSError("down")
        return {"A": [(1, 1, 1, 1, 1, 1)]} if "A" in symbols else {}

    assert vendor.download(fetch, ["A", "B"], {}) == [("A", 1, 1, 1, 1, 1, 1, None), ("B", *[None] * 6, vendor.NO_DATA)] and calls == [("A", "B"), ("B",)]
    assert [r[-1] for r in vendor.download(fetch, ["X", "Y"], {})] == ["down", "down"]
    assert vendor.request(date(2026, 6, 1), date(2026, 6, 5), {})["end"] == "2026-06-06"


def test_config(tmp_path, spark):
    f = tmp_path / "c.toml"
    text = '[paths]\ndata_dir = "data"\nsymbols_file = "s.csv"\n[download]\ninterval = "1d"\nstart_date = 2024-01-01\n'
    f.write_text(text)
    assert config.load_config(f).data_dir == (tmp_path / "data").resolve()
    for extra, words in (("end_date = 2023-01-01\n", "before"), ("colour = 1\n", "unknown"), ("[vendor]\nbatch_size = 0\n", "positive"), ('[vendor]\nbatch_size = "9"\n', "of type int"), ("[vendor]\nthreads = 1\n", "of type bool")):
        f.write_text(text + extra)
        with pytest.raises(config.ConfigError, match=words):
            config.load_config(f)
    s = tmp_path / "s.csv"
    s.write_text("symbol,name\n TCS.NS ,x\nINFY.NS,y\n")
    assert [r.symbol for r in config.read_symbols(spark, str(s)).orderBy("ord").collect()] == ["TCS.NS", "INFY.NS"]
    s.write_text("symbol\nA\nA\n")
    with pytest.raises(config.ConfigError, match="duplicate"):
        config.read_symbols(spark, str(s))
    with pytest.raises(StoreError):
        check_symbol("a/b")


def test_update_run(spark, tmp_path):
    raw = spark.createDataFrame([(s, t, o, h, l, c, float(v), i) for s in ("TCS.NS", "BAD.NS") for i, (_, t, o, h, l, c, v) in enumerate(history(400))], RAW)
    raw = raw.withColumn("close", F.when((F.col("symbol") == "BAD.NS") & (F.col("seq") == 3), None).otherwise(F.col("close")))
    asked = spark.createDataFrame([("TCS.NS", 0), ("BAD.NS", 1), ("GONE.NS", 2)], "symbol string, ord long")
    now = datetime(2026, 6, 8, 16, 30, tzinfo=UTC)
    run = lambda r: [(x.symbol, x.status) for x in update(spark, str(tmp_path), "1d", r, asked, now).collect()]
    first = update(spark, str(tmp_path), "1d", raw, asked, now)
    assert [(x.symbol, x.status) for x in first.collect()] == [("TCS.NS", "success"), ("BAD.NS", "failed"), ("GONE.NS", "failed")]
    assert report(first)[1] == 1
    assert run(raw)[0] == ("TCS.NS", "unchanged")
    prices, indicators = stores(spark, str(tmp_path), "1d")
    assert prices.read().count() == 400 and indicators.read(["TCS.NS"]).count() == 400 - 365
    assert run(raw.where("seq < 100"))[0] == ("TCS.NS", "success")  # shorter history: stale indicators go
    assert prices.read().count() == 100 and indicators.read() is None
    with pytest.raises(ValueError):
        update(spark, str(tmp_path), "1d", raw, asked, now.replace(tzinfo=None))


def test_streaming_bars(spark, tmp_path):
    t = datetime(2026, 1, 1)
    rows = [("A", t + timedelta(minutes=m), float(m), m) for m in (1, 20, 59, 61, 200)]
    spark.createDataFrame(rows, "symbol string, ts timestamp, price double, seq long").write.parquet(str(tmp_path / "in"))
    stream = stream_bars(spark.readStream.schema("symbol string, ts timestamp, price double, seq long").parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("bars").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert [(r.open, r.close, r.volume) for r in spark.table("bars").orderBy("ts").collect()] == [(1.0, 59.0, 3), (61.0, 61.0, 1)]


def test_symbols_stay_text_and_one_bad_price_fails_alone(spark, tmp_path):
    names = ("0050", "1E5", "INF.NS", "WORD.NS", "TCS.NS")
    raw = spark.createDataFrame([(s, t, o, h, l, c, float(v), i) for s in names for i, (_, t, o, h, l, c, v) in enumerate(history(400))], RAW)
    raw = raw.withColumn("high", F.when((F.col("symbol") == "INF.NS") & (F.col("seq") == 7), float("inf")).otherwise(F.col("high")))
    raw = raw.withColumn("close", F.when((F.col("symbol") == "WORD.NS") & (F.col("seq") == 7), "n/a").otherwise(F.col("close").cast("string")))
    asked = spark.createDataFrame([(s, i) for i, s in enumerate(names)], "symbol string, ord long")
    out = update(spark, str(tmp_path), "1d", raw, asked, datetime(2026, 6, 8, 16, 30, tzinfo=UTC)).collect()
    assert [(r.symbol, r.status) for r in out] == [("0050", "success"), ("1E5", "success"), ("INF.NS", "failed"), ("WORD.NS", "failed"), ("TCS.NS", "success")]
    assert "non-finite" in out[2].error and "not a number" in out[3].error
    prices, indicators = stores(spark, str(tmp_path), "1d")
    assert {r.symbol for r in prices.read().select("symbol").distinct().collect()} == {"0050", "1E5", "TCS.NS"}
    assert prices.read(["0050"]).count() == 400 and indicators.read(["0050", "none"]).count() == 35 and prices.read(["INF.NS"]) is None
    assert "PartitionFilters: [" in prices.read(["0050"])._jdf.queryExecution().executedPlan().toString()


def test_refused_indicators_fail_alone(spark, tmp_path):
    raw = spark.createDataFrame([(s, t, o, h, l, c, float(v), i) for s in ("A", "B") for i, (_, t, o, h, l, c, v) in enumerate(history(400))], RAW)
    prices, indicators = stores(spark, str(tmp_path), "1d")
    prices.replace(normalize.normalize(raw, "1d", F.lit(datetime(2026, 6, 8, 16, 30)))[0])
    indicators.check = lambda df: df.where("symbol = 'B'").select("symbol", F.lit("B is refused").alias("error")).distinct()
    got = {r.symbol: (r.changed, r.error) for r in refresh_indicators(prices, indicators, ["A", "B"]).collect()}
    assert got == {"A": (True, None), "B": (None, "B is refused")} and indicators.read(["B"]) is None and indicators.read(["A"]).count() == 35
    # what was refused is tried again, what is current is not
    indicators.check = None
    assert {r.symbol for r in refresh_indicators(prices, indicators).collect()} == {"B"} and indicators.read().count() == 70
    with pytest.raises(StoreError, match="separator"):
        prices.replace(prices.read().withColumn("symbol", F.lit("a/b")))


def test_read_back_rows_are_checked(spark, tmp_path):
    prices = stores(spark, str(tmp_path), "1d")[0]
    bars = spark.createDataFrame(history(5), SCHEMA)
    bad = bars.unionByName(bars.withColumns({"symbol": F.lit("D"), "ts": F.lit(datetime(2024, 1, 1))})).unionByName(bars.withColumns({"symbol": F.lit("N"), "close": F.lit(None).cast("double")}))
    staged = prices.stage(bad)
    assert {r.symbol: r.error for r in staged.errors.collect()} == {"D": "price data contains duplicate timestamps", "N": "price data contains nulls"}
    assert [(r.symbol, r.n_rows) for r in staged.result.collect()] == [("TCS.NS", 5)]
    with pytest.raises(StoreError, match="duplicate timestamps|nulls"):
        prices.replace(bad)
    assert prices.read() is None
    # rows that do not ascend in their file
    place = str(tmp_path / "back")
    bars.coalesce(1).orderBy(F.desc("ts")).write.parquet(place)
    assert [(r.symbol, r.error) for r in validate.price_problems(spark.read.parquet(place)).collect()] == [("TCS.NS", "price data is not sorted by timestamp")]


def test_store_with_two_writers(spark, tmp_path):
    bars = spark.createDataFrame([(s, t, o, h, l, c, v) for s in "ABC" for _, t, o, h, l, c, v in history(5)], SCHEMA)
    one, other = (stores(spark, str(tmp_path), "1d")[0] for _ in range(2))
    one.replace(bars.where("symbol = 'A'"))
    publish, raced = one._try_publish, []

    def late(number, state):
        if not raced:  # the other writer is first
            raced.append(other.replace(bars.where("symbol = 'B'")))
        return publish(number, state)

    one._try_publish = late
    one.replace(bars.where("symbol = 'C'"))
    assert sorted(r.symbol for r in other.read().select("symbol").distinct().collect()) == ["A", "B", "C"]
    one._try_publish = publish
    folder = tmp_path / "prices" / "1d"
    held = one.read()
    for k in range(3):
        one.replace(bars.withColumn("close", F.col("close") + k + 1))
    assert held.count() == 15  # a reader keeps its version through any number of publishes within the grace time
    assert one.vacuum() == 0 and one.vacuum(0) > 0
    assert len([p for p in folder.iterdir() if p.name.startswith("v=")]) == 1 and one.read().count() == 15
    assert not one.replace(bars.withColumn("close", F.col("close") + 3)).where("changed").count()
    assert one.remove(["A", "Z"]) == ["A"] and one.read(["A"]) is None


def test_prices_and_indicators_become_visible_together(spark, tmp_path, monkeypatch):
    """A run that stops after either write leaves the old pair; the next run completes it and vacuum takes the rest."""
    frame = lambda n, k: spark.createDataFrame([("A", t, o, h, l, c + k, float(v), i) for i, (_, t, o, h, l, c, v) in enumerate(history(n))], RAW)
    asked, now = spark.createDataFrame([("A", 0)], "symbol string, ord long"), datetime(2026, 6, 8, 16, 30, tzinfo=UTC)
    run = lambda r: [(x.status, x.stored_rows) for x in update(spark, str(tmp_path), "1d", r, asked, now).collect()]
    assert run(frame(400, 0.0)) == [("success", 400)]
    pair = stores(spark, str(tmp_path), "1d")
    at = lambda: sorted(map(tuple, load_prices_with_indicators(*pair).select("ts", "close", "ema_10").collect()))
    old = at()
    real = Store.stage
    for stop in ("indicators", "state"):
        def dies(self, *args, stop=stop):
            if self.kind == stop:
                raise OSError("lost")
            return real(self, *args)

        monkeypatch.setattr(Store, "stage", dies)
        with pytest.raises(OSError, match="lost"):
            update(spark, str(tmp_path), "1d", frame(410, 0.5), asked, now)
        assert at() == old and pair[0].read().count() == 400
    monkeypatch.setattr(Store, "stage", real)
    assert run(frame(410, 0.5)) == [("success", 410)] and len(at()) == len(old) + 10
    assert pair[0].vacuum(0) > 0 and len(at()) == len(old) + 10
    # prices whose indicators were refused are not joined with those of older prices
    pair[0].replace(pair[0].read().withColumn("close", F.col("close") + 1))
    with pytest.raises(StoreError, match="No indicators"):
        load_prices_with_indicators(*pair)


def test_no_indicators(spark, tmp_path):
    prices, indicators = stores(spark, str(tmp_path), "1d")
    for read in (lambda: load_indicators(indicators), lambda: load_prices_with_indicators(prices, indicators)):
        with pytest.raises(StoreError, match="No indicators"):
            read()


def bars_of(n, symbols="AB"):
    rng = random.Random(n)
    rows = []
    for s in symbols:
        close = 100.0
        for i in range(n):
            close *= 1 + rng.uniform(-0.03, 0.03)
            rows.append((s, datetime(2015, 1, 1) + timedelta(days=i), close - 0.3, close + rng.uniform(0.5, 2), close - rng.uniform(0.5, 2), close, rng.randint(100, 999)))
    return rows


def test_appended_bars_read_the_tail_only(spark, tmp_path):
    """Ten bars more: the stored state resumes each series, with the result of a run over all bars."""
    rows = bars_of(1600)
    day = lambda r: (r[1] - datetime(2015, 1, 1)).days
    first = spark.createDataFrame([r for r in rows if day(r) < 1590], SCHEMA)
    every = spark.createDataFrame(rows, SCHEMA)
    prices, indicators = stores(spark, str(tmp_path), "1d")
    prices.replace(first)
    refresh_indicators(prices, indicators).collect()
    prices.replace(every)
    leaves, source = block_digests(prices.read()), prices.other("sources", plan.SOURCES)
    states = plan.resumable(leaves, source.read().withColumnRenamed("ts", "block"), prices.other("state", plan.STATE).read())
    assert sorted((r.symbol, r.idx) for r in states.collect()) == [("A", 1535), ("B", 1535)]
    assert plan.tail(prices.read(), states).count() == 2 * (1600 - 1535 - 1 + 366)  # of 3,200 bars
    assert {(r.symbol, r.changed) for r in refresh_indicators(prices, indicators).collect()} == {("A", True), ("B", True)}
    want = {(r.symbol, r.ts): r for r in indicator_table(every).collect()}
    got = {(r.symbol, r.ts): r for r in indicators.read().collect()}
    assert got.keys() == want.keys()
    assert all(math.isclose(a, b, rel_tol=1e-12, abs_tol=1e-9) for k in want for a, b in zip(got[k][2:], want[k][2:]))
    # a bar of the past that is restated: from the block before it on
    old = every.withColumn("close", F.when((F.col("symbol") == "A") & (F.col("ts") == datetime(2017, 1, 5)), F.col("close") + 0.1).otherwise(F.col("close")))
    prices.replace(old)
    states = plan.resumable(block_digests(prices.read(["A"])), source.read(["A"]).withColumnRenamed("ts", "block"), prices.other("state", plan.STATE).read(["A"]))
    assert [(r.symbol, r.idx) for r in states.collect()] == [("A", 511)]
    assert {(r.symbol, r.changed) for r in refresh_indicators(prices, indicators).collect()} == {("A", True)}
    want = {(r.symbol, r.ts): r for r in indicator_table(old).collect()}
    assert all(math.isclose(a, b, rel_tol=1e-12, abs_tol=1e-9) for r in indicators.read().collect() for a, b in zip(r[2:], want[r.symbol, r.ts][2:]))


def test_a_flat_series_holds_its_directional_index(spark):
    """Blocks without any movement repeat the last index, across block borders, as a loop over all bars does."""
    rows = []
    for i in range(1300):
        c = 100.0 + (i if i < 40 else 40)
        rows.append(("F", datetime(2015, 1, 1) + timedelta(days=i), c, c + (1 if i < 40 else 0), c - (1 if i < 40 else 0), c, 10))
    got = {r.idx: r for r in with_indicators(spark.createDataFrame(rows, SCHEMA), ("adx_14", "obv")).collect()}
    tr = pdm = mdm = 0.0
    dx, adx, seeds = 0.0, None, []
    for i in range(1, 1300):
        (_, _, _, h, l, c, _), (_, _, _, h1, l1, c1, _) = rows[i], rows[i - 1]
        up, down = h - h1, l1 - l
        t, p, m = max(h - l, abs(h - c1), abs(l - c1)), up if up > down and up > 0 else 0.0, down if down > up and down > 0 else 0.0
        tr, pdm, mdm = (tr + t, pdm + p, mdm + m) if i <= 13 else (tr * 13 / 14 + t, pdm * 13 / 14 + p, mdm * 13 / 14 + m)
        if i >= 14:
            a, b = (100 * pdm / tr, 100 * mdm / tr) if tr else (0.0, 0.0)
            dx = 100 * abs(a - b) / (a + b) if a + b else dx
            seeds.append(dx)
            adx = sum(seeds) / 14 if i == 27 else None if i < 27 else (13 * adx + dx) / 14
        assert (got[i].adx_14 is None) == (adx is None) and (adx is None or math.isclose(got[i].adx_14, adx, rel_tol=1e-9))


def test_no_window_over_rows_spans_a_symbol(spark):
    """Windows by symbol alone are those over blocks and cells, which order by them."""
    frame = spark.createDataFrame(bars_of(30), SCHEMA)
    for df in (indicator_table(frame), with_indicators(frame)):
        plan_text = df._jdf.queryExecution().optimizedPlan().toString()
        found = re.findall(r"windowspecdefinition\((symbol#\d+, )([a-z_0-9]+)#", plan_text)
        assert found and all(order in ("__block", "__cell", "__in") for _, order in found), set(found)


def test_merkle_tree(spark):
    rows = bars_of(400, "AB")
    df = spark.createDataFrame(rows, SCHEMA)
    leaves = block_digests(df)
    assert leaves.count() == 2 * 14 and leaves.agg(F.sum("n_rows")).first()[0] == 800
    moved = df.withColumn("low", F.when((F.col("symbol") == "B") & (F.col("ts") == datetime(2015, 7, 9)), 1.0).otherwise(F.col("low")))
    assert [tuple(r) for r in changed_blocks(block_digests(moved), leaves).collect()] == [("B", datetime(2015, 7, 1), "changed")]
    roots = lambda x: {r.symbol: r.source_fingerprint for r in root_digests(x).collect()}
    assert roots(leaves) == roots(block_digests(df.orderBy(F.desc("close")))) and roots(leaves)["A"] == roots(block_digests(moved))["A"] and roots(leaves)["B"] != roots(block_digests(moved))["B"]


def test_live_turn_by_hand(spark):
    """A dip to 90 under a high of 110; the last bar has a true range of 4, the bar of the dip one of 8."""
    at = lambda i: datetime(2026, 1, 1) + timedelta(hours=i)

    def state(close, lift, reclaim, ema=97.0, atr=4.0, dip_ema=95.0, trigger=True):
        emas = {f"ema_{n}": 90.0 for n in (10, 20, 50, 100, 200)}
        bars = [{"symbol": "S", "idx": i, "ts": at(i), "open": 100.0, "high": 110.0 if i == 20 else 101.0, "low": 90.0 if i == 25 else 99.0, "close": 100.0, "atr_14": 8.0, **emas, "ema_20": dip_ema} for i in range(30)]
        bars[29] |= {"close": close, "atr_14": atr, "ema_20": ema, "ema_50": 92.0}
        zz = [("S", 1, 10, at(10), "L", 85.0), ("S", 2, 20, at(20), "H", 110.0)]
        bars = spark.createDataFrame(bars, ", ".join(f"{k} {'string' if k == 'symbol' else 'long' if k == 'idx' else 'timestamp' if k == 'ts' else 'double'}" for k in bars[0]))
        zz = spark.createDataFrame(zz, "symbol string, run long, idx long, ts timestamp, kind string, price double")
        sig = spark.createDataFrame([("S", 3, 5.0, 15.0, 0.6, "low")], "symbol string, n_events long, band_lo double, band_hi double, success_rate double, confidence string")
        learned = spark.createDataFrame([("S", 9, lift, reclaim, 3.0)], "symbol string, n_winners long, lift double, reclaim string, lag double")
        return pullback.current_state(bars, zz, sig, learned if trigger else None).first()

    both = state(98.0, 2.0, "ema_20")  # (98 - 90) / 4 = 2, and back above 97 after 90 < 95
    assert both.turn_confirmed and both.turn_path == ["lift", "reclaim"] and both.cur_lift == 2.0 and both.state == "buy-the-dip-turned"  # though few events are known
    assert (both.trigger_lift_price, both.trigger_ema_price, both.buy_trigger_price) == (98.0, 97.0, None)
    shy = state(96.0, 2.0, "ema_20")
    assert shy.turn_confirmed is False and shy.turn_path == [] and shy.buy_trigger_price == 97.0 and shy.state == "wait-not-turned"
    unbroken = state(98.0, 3.0, "ema_20", dip_ema=89.0)  # the low never broke the average, whose price is quoted all the same
    assert unbroken.turn_confirmed is False and unbroken.broke_ema is False and unbroken.buy_trigger_price == 97.0
    assert state(96.0, 2.0, "none").buy_trigger_price == 98.0
    for unknown in (state(98.0, None, None), state(98.0, 2.0, "ema_20", atr=0.0), state(98.0, 2.0, "ema_20", atr=None)):
        assert unknown.turn_confirmed is None and unknown.state == "buyable-dip-now/turn-unconfirmable" and unknown.buy_trigger_price is None
    assert state(98.0, 2.0, "ema_20", trigger=False).state == "buyable-dip-now" and both.near_term_invalidation == 90.0 and both.floor_price == 85.0
    assert state(108.0, 2.0, "none").state == "pullback-coming/wait" and state(91.0, 2.0, "none").state == "no-match"


def test_report(spark):
    base = {"symbol": "T", "tier": "BUY", "ts": datetime(2026, 6, 17, 15, 15), "close": 100.0, "n_events": 30, "band_lo": 2.64, "band_hi": 4.5, "now_off_high": 3.9, "live_low_dip": 5.0, "bounce_base": 0.5556, "bounce_learned": 0.7, "delta": 0.1444, "horizon_bars": 28, "clamped": False, "learned": True}
    base |= {"recovery": "medium", "turn_confirmed": True, "turn_path": ["lift", "reclaim"], "buy_trigger_price": None, "vol_fade_ratio": 0.9, "fading": True, "live_high": 108.6, "live_low": 99.0, "floor_price": 95.0, "near_term_invalidation": 99.0}
    rows = [base, base | {"symbol": "W", "tier": "WAIT", "turn_confirmed": False, "turn_path": [], "buy_trigger_price": 102.5, "clamped": True, "delta": -0.02}, base | {"symbol": "A", "bounce_base": 0.5}, base | {"symbol": "B", "recovery": "slow"}]
    types = {"symbol": "string", "tier": "string", "ts": "timestamp", "n_events": "long", "horizon_bars": "int", "recovery": "string", "turn_path": "array<string>", **{c: "boolean" for c in ("clamped", "learned", "turn_confirmed", "fading")}}
    df = spark.createDataFrame(rows, ", ".join(f"{k} {types.get(k, 'double')}" for k in base))
    text = screen.markdown(df, "Pullback Screen")
    table = [x for x in text.split("\n") if x.startswith("| ")]
    assert text.split("\n")[2] == "3 BUY · 1 WAIT — 4 analyzed" and [x.split(" | ")[0] for x in table] == ["| Symbol", "| T", "| B", "| A", "| W"]
    assert table[1] == "| T | BUY | 30 | 2.6–4.5 | 3.9 | 5.0 | 0.556 | 0.7 (+0.144) | 28≈4.0d | medium | ✓(lift,reclaim) | 0.9✓ | 108.6 (8.6%) | 99.0 (-1.0%) | 95.0 (-5.0%) | 2026-06-17 15:15 |"
    assert "| — ₹102.5 |" in table[4] and "28≈4.0d!" in table[4] and "(-0.02)" in table[4] and "turned via lift,reclaim; wrong below ₹99.0" in text
