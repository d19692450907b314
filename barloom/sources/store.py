"""Partitioned Parquet stores of prices, indicators and what they are refreshed from, with change detection and one commit.

Layout: ``<root>/<kind>/<interval>/v=<id>/part=../*.parquet`` holds rows, and the manifest ``<root>/pointers/<interval>/<number>`` names,
for each kind and symbol, the version that counts, with its fingerprint and its first and last time. The symbol is a
column of the data and never read back from a folder name; folders are hash parts of the symbols, so that a read scans only
those of the symbols asked for. Rows are staged in a new version, read back and checked; a publish then writes the next
manifest and renames it to its number, which succeeds once. All kinds of an update go into one publish, so prices and
the indicators that belong to them become visible together; a run that dies before leaves the old state and folders
that nothing names, which ``vacuum`` removes. If another writer was first, the publish is tried again on the newer state. Manifests
are tables: neither symbols nor rows go through the driver.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.calendar import wall_clock
from barloom.functions.indicators import INDICATOR_COLUMNS
from barloom.sources.files import Folder


class StoreError(ValueError):
    """Unusable stored data or an invalid symbol."""


class Conflict(RuntimeError):
    """Another writer published first, again and again."""


def check_symbol(symbol: str) -> str:
    if not symbol or re.search(r"[/\\]", symbol):
        raise StoreError(f"invalid symbol: {symbol!r}")
    return symbol


# Digests

_WORDS = [f"w{i}" for i in range(8)]


def block_digests(df: DataFrame, columns: list[str] | None = None, unit: str = "month") -> DataFrame:
    """``symbol, block, digest, n_rows``: the leaves of a digest tree, one for each calendar ``unit``. Rows are hashed with
    SHA-256 and the eight words of the hashes added up, which tasks do ahead of the shuffle: a history is never gathered, and
    the sum does not depend on the order, as the time is part of a row."""
    columns = columns or [c for c in df.columns if c != "symbol"]
    row = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns]), 256)
    words = {w: F.conv(F.substring("__h", 1 + 8 * i, 8), 16, 10).cast("bigint") for i, w in enumerate(_WORDS)}
    rows = df.select("symbol", F.date_trunc(unit, "ts").cast("timestamp_ntz").alias("block"), row.alias("__h")).withColumns(words)
    sums = rows.groupBy("symbol", "block").agg(F.count("*").alias("n_rows"), *[F.sum(w).alias(w) for w in _WORDS])
    return sums.select("symbol", "block", F.sha2(F.concat_ws(",", "n_rows", *_WORDS), 256).alias("digest"), "n_rows")


def root_digests(leaves: DataFrame) -> DataFrame:
    """``symbol, source_fingerprint, n_rows``: the roots over years over blocks; a node has the digests of its children in order."""
    def above(df: DataFrame, keys: list[str], child: str, out: str) -> DataFrame:
        parts = F.array_sort(F.collect_list(F.struct(child, "digest")))
        return df.groupBy(*keys).agg(F.sha2(F.array_join(F.transform(parts, lambda x: x["digest"]), ""), 256).alias(out), F.sum("n_rows").alias("n_rows"))

    years = above(leaves.withColumn("year", F.year("block")), ["symbol", "year"], "block", "digest")
    return above(years, ["symbol"], "year", "source_fingerprint")


def fingerprints(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``symbol, source_fingerprint, n_rows`` of the rows of each symbol."""
    return root_digests(block_digests(df, columns))


def changed_blocks(new: DataFrame, old: DataFrame) -> DataFrame:
    """``symbol, block, change`` (added, removed or changed) of the leaves that differ."""
    o = old.select("symbol", "block", F.col("digest").alias("__old"))
    both = new.select("symbol", "block", "digest").join(o, ["symbol", "block"], "full_outer")
    change = F.when(F.col("__old").isNull(), "added").when(F.col("digest").isNull(), "removed").when(F.col("digest") != F.col("__old"), "changed")
    return both.select("symbol", "block", change.alias("change")).where("change IS NOT NULL")


def changed_symbols(new: DataFrame, old: DataFrame) -> DataFrame:
    """``symbol, changed`` for the symbols of ``new`` (both are fingerprint tables)."""
    o = old.select("symbol", F.col("source_fingerprint").alias("__old"))
    return new.join(o, "symbol", "left").select("symbol", (~F.col("source_fingerprint").eqNullSafe(F.col("__old"))).alias("changed"))


# Stores

#: Folders of a version, by hash of the symbol.
PARTS = 64
MANIFEST = "kind string, symbol string, version string, source_fingerprint string, rows bigint, first_ts timestamp_ntz, last_ts timestamp_ntz"


def _part(symbol) -> Column:
    return F.pmod(F.xxhash64(symbol), F.lit(PARTS)).cast("int")


@dataclass(frozen=True)
class Staged:
    """Rows that wait for their publish: ``entries`` are manifest rows with ``changed``, ``errors`` are ``symbol, error`` of the refused."""

    kind: str
    entries: DataFrame
    errors: DataFrame

    @property
    def result(self) -> DataFrame:
        """``symbol, changed, n_rows`` of what was not refused."""
        return self.entries.select("symbol", "changed", F.col("rows").alias("n_rows"))


class Store:
    """One kind of data of one interval. ``schema`` is the DDL of its rows, ``check`` returns ``symbol, error`` for bad ones."""

    def __init__(self, spark: SparkSession, root: str, kind: str, interval: str, schema: str, check=None):
        self.spark, self.root, self.kind, self.interval, self.schema, self.check = spark, root.rstrip("/"), kind, interval, schema, check
        self.data, self.pointers = Folder(spark, f"{self.root}/{kind}/{interval}"), Folder(spark, f"{self.root}/pointers/{interval}")

    def other(self, kind: str, schema: str, check=None) -> Store:
        """The store of another kind beside this one."""
        return Store(self.spark, self.root, kind, self.interval, schema, check)

    # Manifests

    def _numbers(self) -> list[int]:
        return sorted(int(n) for n in self.pointers.names() if n.isdigit())

    def manifest(self, number: int | None = None) -> DataFrame:
        """All kinds at a number, by default the newest."""
        number = max(self._numbers(), default=0) if number is None else number
        if not number:
            return self.spark.createDataFrame([], MANIFEST)
        found = self.spark.read.parquet(f"{self.pointers.base}/{number:010d}")
        if found.columns != [c.split()[0] for c in MANIFEST.split(", ")]:
            raise StoreError("store metadata does not match")
        return found

    def entries(self, kind: str | None = None) -> DataFrame:
        return self.manifest().where(F.col("kind") == (kind or self.kind)).drop("kind")

    def state(self) -> DataFrame:
        """``symbol, source_fingerprint`` of what is stored."""
        return self.entries().select("symbol", "source_fingerprint")

    def publish(self, staged: list[Staged], removed: DataFrame | None = None, tries: int = 20) -> None:
        """Make all that is staged visible at once, and forget the ``kind, symbol`` of ``removed``. What another writer
        published meanwhile for other symbols stays."""
        new = [s.entries.where("changed").select(F.lit(s.kind).alias("kind"), *[c.split()[0] for c in MANIFEST.split(", ")][1:]) for s in staged]
        gone = [n.select("kind", "symbol") for n in new] + ([removed.select("kind", "symbol")] if removed is not None else [])
        if not gone or reduce(DataFrame.unionByName, gone).isEmpty():
            return
        for _ in range(tries):
            number = max(self._numbers(), default=0)
            after = self.manifest(number).join(reduce(DataFrame.unionByName, gone), ["kind", "symbol"], "left_anti")
            if self._try_publish(number + 1, reduce(DataFrame.unionByName, new, after)):
                return
        raise Conflict(f"no number was free in {tries} tries")

    def _try_publish(self, number: int, state: DataFrame) -> bool:
        """Whether the table became manifest ``number``; False if that was taken."""
        temp = f".{uuid.uuid4().hex}"
        state.select(*[c.split()[0] for c in MANIFEST.split(", ")]).coalesce(1 + self.pointers_size(number - 1) // (64 << 20)).write.parquet(f"{self.pointers.base}/{temp}")
        done = self.pointers.rename_once(temp, f"{number:010d}")
        self.pointers.delete(temp)
        return done

    def pointers_size(self, number: int) -> int:
        return self.pointers.size(f"{number:010d}")

    def vacuum(self, grace_seconds: float = 86_400) -> int:
        """Remove old manifests, and versions of all kinds that none of the others names, as runs that died and replaced symbols
        leave them; how many versions. All that is younger than the grace time stays, for readers that have just opened it."""
        for n in self._numbers()[:-1]:
            if self.pointers.age(f"{n:010d}") >= grace_seconds:
                self.pointers.delete(f"{n:010d}")
        named = reduce(DataFrame.unionByName, [self.manifest(n) for n in self._numbers()] or [self.manifest(0)])
        held = {r.version for r in named.select("version").distinct().collect()}  # one for each update that still counts
        n = 0
        for kind in Folder(self.spark, self.root).names():
            folder = Folder(self.spark, f"{self.root}/{kind}/{self.interval}")
            for name in folder.names() if kind != "pointers" else []:
                if name.startswith("v=") and name[2:] not in held and folder.age(name) >= grace_seconds:
                    folder.delete(name)
                    n += 1
        return n

    # Rows

    def scratch(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` written beside the stores and read back, so that later steps neither compute it again nor see other versions
        of what it was read from. ``vacuum`` removes it."""
        place = f"{self.root}/staged/{self.interval}/v={name}-{uuid.uuid4().hex}"
        df.write.parquet(place)
        return self.spark.read.schema(df.schema).parquet(place)

    def rows(self, entries: DataFrame, symbols: list[str] | None = None) -> DataFrame:
        """The rows that manifest ``entries`` name. Folders of other hash parts are left out, those of other versions by
        the join."""
        names = [c.split()[0] for c in self.schema.split(", ")]
        if not self.data.exists(""):
            return self.spark.createDataFrame([], self.schema)
        source = self.spark.read.schema(f"{self.schema}, v string, part int").option("basePath", self.data.base).parquet(self.data.base)
        if symbols is not None:
            source = source.where(F.col("part").isin([_part(F.lit(s)) for s in symbols]) & F.col("symbol").isin(symbols))
        named = entries.select(F.col("version").alias("__v"), F.col("symbol").alias("__symbol"))
        return source.join(named, (F.col("v") == F.col("__v")) & (F.col("symbol") == F.col("__symbol"))).select(*names)

    def read(self, symbols: list[str] | None = None, start=None, end=None) -> DataFrame | None:
        """Stored rows, or None if there are none of these symbols; start and end are inclusive. Symbols whose times lie
        outside are left out by the manifest, and the range reaches the Parquet filter."""
        wanted = self.entries()
        if symbols is not None:
            wanted = wanted.where(F.col("symbol").isin(symbols))
        if wanted.isEmpty():
            return None
        if start is not None:
            wanted = wanted.where(F.col("last_ts") >= wall_clock(start))
        if end is not None:
            wanted = wanted.where(F.col("first_ts") <= wall_clock(end))
        out = self.rows(wanted, symbols)
        if start is not None:
            out = out.where(F.col("ts") >= wall_clock(start))
        if end is not None:
            out = out.where(F.col("ts") <= wall_clock(end))
        return out

    def _write(self, df: DataFrame, version: str) -> DataFrame:
        """Rows into a version, years of a symbol in tasks of their own, and back."""
        placed = df.withColumns({"part": _part("symbol"), "__year": F.year("ts")}).repartition("symbol", "__year").sortWithinPartitions("part", "symbol", "ts")
        placed.drop("__year").write.partitionBy("part").parquet(f"{self.data.base}/v={version}")
        return self.spark.read.schema(f"{self.schema}, part int").parquet(f"{self.data.base}/v={version}")

    def stage(self, df: DataFrame, source: DataFrame | None = None) -> Staged:
        """Write ``df``, each symbol's whole history, once, and check and compare what is read back: with what is stored by
        content, or by the ``symbol, source_fingerprint`` of ``source``. Only changed rows stay on disk; nothing is visible before
        a publish."""
        names = [c.split()[0] for c in self.schema.split(", ")]
        version = uuid.uuid4().hex
        if not df.where(F.col("symbol").rlike(r"[/\\]") | (F.col("symbol") == "")).isEmpty():
            raise StoreError("a symbol is empty or has a separator")
        back = self._write(df.select(*names), version)
        errors = self.check(back) if self.check else self.spark.createDataFrame([], "symbol string, error string")
        marks = source.select("symbol", "source_fingerprint") if source is not None else fingerprints(back.drop("part")).drop("n_rows")
        ranges = back.groupBy("symbol").agg(F.count("*").alias("rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
        found = ranges.join(marks, "symbol").join(errors, "symbol", "left")
        found = found.join(self.state().withColumnRenamed("source_fingerprint", "__old"), "symbol", "left")
        found = found.withColumn("changed", ~F.col("source_fingerprint").eqNullSafe(F.col("__old"))).withColumn("version", F.lit(version))
        found = self.scratch(found.select("symbol", "version", "source_fingerprint", "rows", "first_ts", "last_ts", "changed", "error"), self.kind)
        n = found.agg(F.count("*").alias("all"), F.count_if(F.col("changed") & F.col("error").isNull()).alias("new")).first()
        if n.new < n["all"]:
            if n.new:
                kept = found.where("changed AND error IS NULL").select("symbol")
                rest = uuid.uuid4().hex
                self._write(back.drop("part").join(kept, "symbol", "left_semi"), rest)
                found = found.withColumn("version", F.lit(rest))
            self.data.delete(f"v={version}")
        return Staged(self.kind, found.where("error IS NULL").drop("error"), found.where("error IS NOT NULL").select("symbol", "error"))

    def replace(self, df: DataFrame, source: DataFrame | None = None) -> DataFrame:
        """Stage and publish: ``symbol, changed, n_rows``. Symbols that the check refuses are an error here."""
        staged = self.stage(df, source)
        bad = staged.errors.first()
        if bad:
            raise StoreError(f"{bad.symbol}: {bad.error}")
        self.publish([staged])
        return staged.result

    def remove(self, symbols: list[str]) -> list[str]:
        """Forget the symbols; those that were stored."""
        there = self.entries().where(F.col("symbol").isin(symbols)).select(F.lit(self.kind).alias("kind"), "symbol")
        gone = sorted(r.symbol for r in there.collect())  # of a given list
        if gone:
            self.publish([], there)
        return gone


def prices_with_indicators(prices: DataFrame, indicators: DataFrame) -> DataFrame:
    """Inner join on symbol and time."""
    return prices.join(indicators.select("symbol", "ts", *INDICATOR_COLUMNS), ["symbol", "ts"])


def load_indicators(store: Store, symbols=None, start=None, end=None) -> DataFrame:
    found = store.read(symbols, start, end)
    if found is None:
        raise StoreError("No indicators are stored")
    return found


def load_prices_with_indicators(prices: Store, indicators: Store, symbols=None, start=None, end=None) -> DataFrame:
    """Stored prices and indicators of one moment: both are read by the same manifest, and indicators that were computed from
    other prices, because those of the newer ones were refused, are left out."""
    manifest = prices.manifest()
    of = lambda k: manifest.where(F.col("kind") == k).drop("kind")
    current = of(prices.kind).select("symbol", "source_fingerprint").join(of(indicators.kind), ["symbol", "source_fingerprint"])
    if current.isEmpty():
        raise StoreError("No indicators are stored")
    within = lambda df: reduce(lambda d, c: d.where(c()), [c for b, c in ((start, lambda: F.col("ts") >= wall_clock(start)), (end, lambda: F.col("ts") <= wall_clock(end))) if b is not None], df)
    p, i = prices.rows(of(prices.kind).join(current.select("symbol"), "symbol", "left_semi"), symbols), indicators.rows(current, symbols)
    return prices_with_indicators(within(p), within(i))


def require_native(interval: str, native) -> None:
    if interval not in native:
        raise StoreError(f"{interval} is a derived interval and is not stored")
