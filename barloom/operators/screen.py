"""The screen report: tier counts, ranked table rows, buy triggers, disclosures.

Names of cells, the currency mark and the order of tiers are fixed values of the report format.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.pullback import BARS_PER_DAY, HORIZON

TIERS = ("BUY", "PATIENT", "SPEC", "WAIT", "WATCH", "CAUTION", "AVOID")
CELLS = (
    "Symbol", "tier", "n", "usual dip%", "now off hi%", "live-lo dip%", "b@base", "b@learn (Δ)", "H≈days", "class", "turn", "vol-fade", "live high ₹ (+%)", "live low ₹ (−%)", "floor ₹ (−%)", "latest candle",
)
NOTES = {
    "BUY": "still in its own dip and turned", "PATIENT": "as BUY, but slow to recover", "SPEC": "a thin edge, or a turn that cannot be judged", "WAIT": "in its band, not turned yet: only on its trigger",
    "WATCH": "bounced already, or too shallow", "CAUTION": "the live low is under the structural floor", "AVOID": "far deeper than its usual dips",
}


def tier_counts(rows: DataFrame) -> DataFrame:
    """Counts in the fixed tier order, zeros included."""
    order = rows.sparkSession.createDataFrame([(t, i) for i, t in enumerate(TIERS)], "tier string, ord int")
    return order.join(rows.groupBy("tier").count(), "tier", "left").select("tier", F.coalesce("count", F.lit(0)).alias("n"), "ord")


def _number(c: Column, digits: int) -> Column:
    """As few decimals as it takes, at least one and at most ``digits``."""
    text = F.format_string(f"%.{digits}f", c.cast("double"))
    return F.regexp_replace(text, r"(\.\d+?)0+$", "$1")


def turn_cell() -> Column:
    price = F.concat(F.lit("— ₹"), _number(F.col("buy_trigger_price"), 2))
    return F.when(F.col("turn_confirmed"), F.concat(F.lit("✓("), F.array_join("turn_path", ","), F.lit(")"))).when(~F.col("turn_confirmed"), F.coalesce(price, F.lit("—"))).otherwise("n/a")


def _price_cell(price: str) -> Column:
    away = (F.col(price) / F.col("close") - 1) * 100
    return F.coalesce(F.concat(_number(F.col(price), 2), F.lit(" ("), F.format_string("%.1f", away), F.lit("%)")), F.lit("n/a"))


def cells() -> dict[str, Column]:
    """The text of each cell of a row."""
    delta = F.concat(F.when(F.col("delta") >= 0, "+").otherwise(""), _number(F.round("delta", 3), 3))
    days = F.concat(F.col("horizon_bars").cast("string"), F.lit("≈"), F.format_string("%.1f", F.col("horizon_bars") / BARS_PER_DAY), F.lit("d"), F.when(F.col("clamped"), "!").otherwise(""))
    fade = F.concat(_number(F.col("vol_fade_ratio"), 2), F.when(F.col("fading"), "✓").otherwise(""))
    made = (
        F.concat("symbol", F.when(F.col("tier") == "CAUTION", " ⚠").otherwise("")), F.col("tier"), F.col("n_events").cast("string"), F.format_string("%.1f–%.1f", "band_lo", "band_hi"), F.format_string("%.1f", "now_off_high"),
        F.coalesce(F.when(F.col("live_low_dip").isNotNull(), F.format_string("%.1f", "live_low_dip")), F.lit("n/a")), _number(F.round("bounce_base", 3), 3), F.concat(_number(F.round("bounce_learned", 3), 3), F.lit(" ("), delta, F.lit(")")),
        F.when(F.col("learned"), days).otherwise(f"—(base {HORIZON})"), F.col("recovery"), turn_cell(), F.coalesce(fade, F.lit("n/a")), _price_cell("live_high"), _price_cell("live_low"), _price_cell("floor_price"), F.date_format("ts", "yyyy-MM-dd HH:mm"),
    )
    return {name: F.coalesce(c, F.lit("")) for name, c in zip(CELLS, made, strict=True)}


def lines(rows: DataFrame) -> DataFrame:
    """``place, tier_ord, bounce_base, symbol, line``: the rows of the table as Markdown. Inside a tier by base bounce, then fast and
    medium before slow recovery, then the smaller gain of the learned horizon, then fading volume, then the deeper dip. A
    screen is a shortlist, so one task numbers it."""
    rank = F.array_position(F.array(*[F.lit(t) for t in TIERS]), F.col("tier"))
    text = F.concat(F.lit("| "), F.concat_ws(" | ", *cells().values()), F.lit(" |"))
    order = [F.col("tier_ord"), F.desc_nulls_last("bounce_base"), (F.col("recovery") == "slow").asc_nulls_last(), F.abs("delta").asc_nulls_last(), (~F.coalesce("fading", F.lit(False))).asc(), F.desc_nulls_last("now_off_high"), F.col("symbol")]
    ranked = rows.withColumns({"tier_ord": rank, "line": text})
    return ranked.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order))).select("place", "tier_ord", "bounce_base", "symbol", "line")


def buy_lines(rows: DataFrame) -> DataFrame:
    """``symbol, line``: a sentence for each symbol of the first three tiers."""
    name = F.when(F.col("tier") == "BUY", "BUY THE DIP").when(F.col("tier") == "PATIENT", "PATIENT BUY").otherwise("SPECULATIVE")
    turn = F.when(F.col("turn_confirmed"), F.array_join("turn_path", ",")).when(~F.col("turn_confirmed"), "not-yet").otherwise("unconfirmed")
    percent = lambda c: F.format_string("%.0f%%", F.col(c) * 100)
    text = F.concat(
        F.col("symbol"), F.lit(" — "), name, F.lit(" ("), F.col("recovery"), F.lit("): dipping "), F.format_string("%.1f%% vs its usual %.1f–%.1f%% dip", "now_off_high", "band_lo", "band_hi"), F.lit("; bounces ~"), percent("bounce_base"),
        F.lit(" @base / ~"), percent("bounce_learned"), F.lit(" on its own clock; turned via "), turn, F.lit("; wrong below ₹"), _number(F.col("near_term_invalidation"), 2),
    )
    return rows.where(F.col("tier").isin("BUY", "PATIENT", "SPEC")).select("symbol", text.alias("line"))


def disclosures(calibrated: DataFrame, horizon: int, low_days: float, high_days: float, short: int, analyzed: int) -> str:
    """What the report rests on: the calibration row, the base horizon and the clamp of learned ones, symbols left out for a
    short history, and what is always so."""
    row = calibrated.first()
    used = [int(w) for w in row.W_used]
    windows = str(used[0]) if len(used) == 1 else str(used)
    return (
        f"W {row.mode}, overlap {round(row.overlap, 3):g}, W={windows}; bars/day={BARS_PER_DAY:g}; H_base={horizon}, clamp {low_days:g}–{high_days:g}d; {short} excluded for a short history; "
        f"{len(row.shortlist)} shortlisted, {analyzed} analyzed; only symbols that still trade are looked at; averages and true ranges are computed from the stored bars"
    )


def markdown(rows: DataFrame, title: str, disclosed: str = "") -> str:
    """The whole report; a screen is a shortlist, so its lines fit the driver."""
    counts = [r for r in tier_counts(rows).orderBy("ord").collect() if r.n]
    head = " · ".join(f"{r.n} {r.tier}" for r in counts) + f" — {sum(r.n for r in counts)} analyzed"
    table = ["| " + " | ".join(CELLS) + " |", "|" + "---|" * len(CELLS), *[r.line for r in lines(rows).orderBy("place").collect()]]
    notes = [f"- **{r.tier}** — {NOTES[r.tier]}." for r in counts]
    said = [r.line for r in buy_lines(rows).orderBy("symbol").collect()]
    return "\n".join([f"# {title}", "", head, "", *table, "", "## Tiers (this run)", *notes, "", "## Buy lines", *said, "", f"_Disclosures: {disclosed or 'statistics of past bars; not advice'}._"])
