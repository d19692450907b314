"""Size-tiered compaction of immutable shards under a versioned manifest.

Arrivals are appended as small Parquet files that never change. A shard's tier is the power of ``fanout``
that its size has reached; where a tier holds ``fanout`` shards or more, runs of similarly sized ones are
merged, in order of size, into files of about ``target_bytes``. A merge reads whole shards and writes one
file per run, without a shuffle. Each append and each merge round commits one manifest: it is written under
a temporary name and renamed to the next version, which fails if another writer was first; readers see one
version or the next, never a mixture. Shards that no kept version names can be removed by ``vacuum``.

The manifest lists files, not rows: it grows with bytes over ``target_bytes``. All data work is done by
DataFrame scans and writes; the file system is reached through Hadoop's interface, so any store works.

Cases: an empty arrival commits a version without shards; null, empty and very long values pass unchanged;
repeated rows stay repeated; an arrival with other columns than the store is refused.
"""

from __future__ import annotations

import json
import math
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TARGET_BYTES, FANOUT, FLOOR_BYTES, RUNS_A_JOB = 128 << 20, 4, 64 << 10, 64


class Conflict(RuntimeError):
    """Another writer committed the version first."""


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES, fanout: int = FANOUT, floor_bytes: int = FLOOR_BYTES):
        self.spark, self.root = spark, root.rstrip("/")
        self.target, self.fanout, self.floor = target_bytes, fanout, floor_bytes
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _list(self, name: str) -> list:
        path = self._path(name)
        return list(self._fs.listStatus(path)) if self._fs.exists(path) else []

    def versions(self) -> list[int]:
        return sorted(int(s.getPath().getName()[1:-5]) for s in self._list("manifest") if s.getPath().getName().startswith("v"))

    def manifest(self, version: int | None = None) -> dict:
        """The manifest of a version, by default the latest; that of an empty store has version 0."""
        if version is None:
            version = max(self.versions(), default=0)
        if not version:
            return {"version": 0, "schema": None, "shards": []}
        stream = self._fs.open(self._path(f"manifest/v{version:010d}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, base: dict, shards: list[dict], schema: str) -> dict:
        new = {"version": base["version"] + 1, "schema": schema, "shards": shards}
        temp = self._path(f"manifest/.{uuid.uuid4().hex}")
        out = self._fs.create(temp, False)
        out.write(bytearray(json.dumps(new).encode()))
        out.close()
        final = self._path(f"manifest/v{new['version']:010d}.json")
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        rename = self._jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.NONE
        try:
            context.rename(temp, final, options)
        except Exception as e:
            self._fs.delete(temp, False)
            if self._fs.exists(final):
                raise Conflict(f"version {new['version']} exists") from e
            raise
        return new

    def _write(self, df: DataFrame) -> list[dict]:
        """Write a new folder of immutable files; their names, sizes and rows."""
        name = f"data/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{name}")
        files = {s.getPath().getName(): s.getLen() for s in self._list(name) if s.getPath().getName().endswith(".parquet")}
        rows = self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}").groupBy(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("f")).count().collect()
        return [{"path": f"{name}/{r['f']}", "bytes": files[r["f"]], "rows": r["count"]} for r in sorted(rows)]

    def append(self, df: DataFrame, tries: int = 20) -> dict:
        schema = T.StructType([T.StructField(f.name, f.dataType) for f in df.schema]).json()
        made = None
        for _ in range(tries):
            base = self.manifest()
            if base["schema"] not in (None, schema):
                raise ValueError("the arrival has other columns than the store")
            made = self._write(df) if made is None else made
            try:
                return self._commit(base, base["shards"] + made, schema)
            except Conflict:
                continue
        raise Conflict(f"no version was free in {tries} tries")

    def tier(self, size: int) -> int:
        return max(0, math.floor(math.log(max(size, 1) / self.floor, self.fanout)))

    def runs(self, shards: list[dict]) -> list[list[dict]]:
        """Runs of similarly sized shards to be merged, each into one file of about the target size."""
        tiers: dict[int, list[dict]] = {}
        for s in shards:
            if 2 * s["bytes"] <= self.target:
                tiers.setdefault(self.tier(s["bytes"]), []).append(s)
        out = []
        for members in tiers.values():
            if len(members) < self.fanout:
                continue
            run: list[dict] = []
            for s in sorted(members, key=lambda s: (s["bytes"], s["path"])):
                if run and sum(x["bytes"] for x in run) + s["bytes"] > self.target:
                    out.append(run)
                    run = []
                run.append(s)
            out.append(run)
        return [r for r in out if len(r) > 1]

    def compact(self) -> dict:
        """Merge until no tier has ``fanout`` shards to merge; the last manifest."""
        base = self.manifest()
        while runs := self.runs(base["shards"]):
            schema = T.StructType.fromJson(json.loads(base["schema"]))
            made: list[dict] = []
            for i in range(0, len(runs), RUNS_A_JOB):
                merged = None
                for run in runs[i : i + RUNS_A_JOB]:
                    one = self.spark.read.schema(schema).parquet(*[f"{self.root}/{s['path']}" for s in run]).coalesce(1)
                    merged = one if merged is None else merged.union(one)
                made += self._write(merged)
            base = self._replace(base, {s["path"] for run in runs for s in run}, made)
        return base

    def _replace(self, base: dict, gone: set[str], made: list[dict]) -> dict:
        """The manifest in which ``made`` stand for the shards ``gone``, or the newer one that lacks some of these."""
        while True:
            try:
                return self._commit(base, [s for s in base["shards"] if s["path"] not in gone] + made, base["schema"])
            except Conflict:
                base = self.manifest()
                if not gone <= {s["path"] for s in base["shards"]}:
                    for s in made:
                        self._fs.delete(self._path(s["path"]), False)
                    return base

    def read(self, version: int | None = None) -> DataFrame:
        m = self.manifest(version)
        if m["schema"] is None:
            raise ValueError("the store is empty")
        schema = T.StructType.fromJson(json.loads(m["schema"]))
        paths = [f"{self.root}/{s['path']}" for s in m["shards"]]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def vacuum(self, keep: int = 1, grace_s: float = 86_400) -> int:
        """Remove all but the last ``keep`` versions and the files that only they name, and files that no version
        names and that are older than ``grace_s`` (a writer may still be about to commit younger ones); files removed."""
        versions = self.versions()
        used = {s["path"] for v in versions[-keep:] for s in self.manifest(v)["shards"]}
        named, removed = set(used), 0
        for v in versions[:-keep]:
            for s in self.manifest(v)["shards"]:
                named.add(s["path"])
                if s["path"] not in used:
                    removed += bool(self._fs.delete(self._path(s["path"]), False))
                    used.add(s["path"])
            self._fs.delete(self._path(f"manifest/v{v:010d}.json"), False)
        old = (time.time() - grace_s) * 1000
        for folder in self._list("data"):
            name = f"data/{folder.getPath().getName()}"
            files = [s for s in self._list(name) if s.getPath().getName().endswith(".parquet")]
            for s in files:
                if f"{name}/{s.getPath().getName()}" not in named and s.getModificationTime() < old:
                    removed += bool(self._fs.delete(s.getPath(), False))
            if folder.getModificationTime() < old and not any(f.getPath().getName().endswith(".parquet") for f in self._list(name)):
                self._fs.delete(folder.getPath(), True)
        return removed
