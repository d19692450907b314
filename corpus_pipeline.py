"""The corpus pipeline: toxicity, near-duplicates, repeated passages, benchmark leaks, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which ``run`` writes as Parquet to the
shared folder and reads again as the next stage's ``docs``. All stages but the last return the columns of
``documents``. ``ORACLE_SQL`` is None, as SQL cannot express the fitted model and the fingerprints; the
tests hold the stages against brute-force versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import decontaminate, packing, simhash, spans, toxicity
from barloom.llm.common import materialize, scratch


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model, fitted on the labelled ones, does not reject."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.drop_toxic(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near-duplicates."""
    return simhash.drop_near_duplicates(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without sentences of spans that an earlier document has; ``n_chars`` follows the text."""
    out = spans.remove_repeats(docs)
    kind = dict(docs.dtypes).get("n_chars")
    if kind:
        out = out.withColumn("n_chars", F.char_length("text").cast(kind))
    return out


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Batches of a token budget in optimal length buckets."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_duplicates),
    ("sentence-span dedup", drop_repeated_passages),
    ("decontamination", drop_leaks),
    ("packing", pack),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the packed rows. What a stage writes besides its result goes when it ends."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with scratch(spark) as keep:
        for k, (_, stage) in enumerate(STAGES):
            with scratch(spark) as keep_stage:
                docs = keep_stage(materialize(stage(spark, docs, sf_dir), f"stage{k}"))
        keep(docs)
    return docs
