"""A write-once landing table of vendor batches, keyed by run and batch.

``<root>/landing/run=<run>/batch=<n>`` holds what was fetched for a batch. Tasks write to the folder of an attempt and commit
their files by rename, one file a batch; then each batch folder is renamed to its place, which succeeds once: whoever comes
second finds it taken and drops its own. A job that dies half-way leaves the batches that its tasks have committed, and
those are landed too. So a batch that has landed is never fetched or changed again, and all later steps read Parquet.
On object stores, where renames copy, the last step is as atomic as the store's own rename.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.sources.files import Folder
from barloom.sources.vendor import FETCHED, fetch_batches

#: Tasks move their files to the folder of the attempt when they commit, not when the job ends.
_BY_TASK = {"mapreduce.fileoutputcommitter.algorithm.version": "2"}


class Landing:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.folder = spark, Folder(spark, f"{root.rstrip('/')}/landing")

    def landed(self, run: str) -> list[int]:
        """Numbers of the batches of a run that are there."""
        return sorted(int(n[6:]) for n in self.folder.names(f"run={run}") if re.fullmatch(r"batch=\d+", n))

    def put(self, run: str, rows: DataFrame) -> list[int]:
        """Land the batches of ``rows`` (``FETCHED``) that are not there yet; their numbers. A batch comes from one task."""
        if not re.fullmatch(r"[\w.-]+", run):
            raise ValueError(f"invalid run: {run!r}")
        attempt, done = f".attempt-{uuid.uuid4().hex}", []
        try:
            rows.write.options(**_BY_TASK).partitionBy("batch").parquet(f"{self.folder.base}/{attempt}")
        finally:
            self.folder.make(f"run={run}")
            for name in self.folder.names(attempt):
                whole = re.fullmatch(r"batch=\d+", name) and any(n.endswith(".parquet") for n in self.folder.names(f"{attempt}/{name}"))
                if whole and self.folder.rename_once(f"{attempt}/{name}", f"run={run}/{name}"):
                    done.append(int(name[6:]))
            self.folder.delete(attempt)
        return sorted(done)

    def fetch(self, run: str, requests: DataFrame, fetch: str, params: dict) -> list[int]:
        """Fetch the batches of ``requests`` (``symbol, ord, batch``) that have not landed, each in a task of its own."""
        there = self.landed(run)
        missing = requests.where(~F.col("batch").isin(there)) if there else requests
        n = missing.agg(F.count_distinct("batch")).first()[0]
        return self.put(run, fetch_batches(missing.repartition(n, "batch"), fetch, params)) if n else []

    def read(self, run: str) -> DataFrame:
        """All rows of a run; an empty frame if none has landed."""
        if not self.landed(run):
            return self.spark.createDataFrame([], FETCHED)
        names = [f.split()[0] for f in FETCHED.split(", ")]
        return self.spark.read.schema(FETCHED).parquet(f"{self.folder.base}/run={run}").select(*names)
