"""Packing into optimal length buckets.

A dynamic program over the global histogram of lengths chooses ``buckets`` boundaries that minimise the
padding when each sequence is padded to the boundary of its bucket. Inside a bucket, batches hold as many
sequences as the token budget allows, at least one: ``max(1, budget // boundary)``.

The histogram is aggregated on the executors and is exact for any number of distinct lengths: the driver
holds one row for each, and the program takes ``buckets * n * log n`` steps for ``n`` of them.

Numbers inside a bucket come from chunks by a hash of the ids, so that no bucket meets in one task: rows are numbered
inside a chunk and shifted by the sizes of the chunks before it.

Cases: a null or empty text has length 0 and is packed like any other; ties in length are ordered by chunk,
id and then text; null ids go to chunk 0; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.llm.common import materialize

BUCKETS, BUDGET, CHUNK_ROWS = 8, 16384, 20000


def boundaries(lengths: list[int], counts: list[int], buckets: int = BUCKETS) -> list[int]:
    """Ascending boundaries of at most ``buckets`` buckets with the least total padding; among equal
    solutions, each bucket starts as early as possible. ``lengths`` ascend and are distinct."""
    n = len(lengths)
    if not n:
        return []
    size = np.array(lengths, np.int64)
    below = np.concatenate([[0], np.cumsum(np.array(counts, np.int64))])  # rows before each length
    best = size * below[1:]  # one bucket over lengths[0..j]: padded tokens, which differ from padding by a constant
    steps = []
    for _ in range(1, min(buckets, n)):
        start = np.zeros(n, np.int64)
        new = best.copy()
        # the padding is a Monge cost: the first best start never falls as j grows, which halves the search each time
        todo = [(1, n - 1, 0, n - 2)]
        while todo:
            low, high, first, last = todo.pop()
            if low > high:
                continue
            j = (low + high) // 2
            end = min(last, j - 1) + 1
            cost = best[first:end] + size[j] * (below[j + 1] - below[first + 1 : end + 1])
            i = first + int(cost.argmin())
            if cost[i - first] < new[j]:
                new[j], start[j] = cost[i - first], i + 1
            todo += [(low, j - 1, first, i), (j + 1, high, i, last)]
        steps.append(start)
        best = new
    out, j = [], n - 1
    for start in reversed(steps):
        out.append(lengths[j])
        if start[j]:
            j = int(start[j]) - 1
        else:
            break
    else:
        out.append(lengths[j])
    return sorted(set(out))


def token_counts(docs: DataFrame, text_col: str = "text") -> F.Column:
    """Words of the whole text, separated by ASCII white space; 0 for null."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    return F.size(F.filter(F.split(t, r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")


def plan_buckets(lengths: DataFrame, buckets: int = BUCKETS) -> tuple[list[int], int]:
    """Boundaries for the rows of column ``n_tokens``, and the number of rows."""
    histogram = lengths.groupBy("n_tokens").count()
    rows = sorted((r[0], r[1]) for r in histogram.collect())
    return boundaries([r[0] for r in rows], [r[1] for r in rows], buckets), sum(r[1] for r in rows)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, budget: int = BUDGET, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``id_col, n_tokens, bucket_len, batch, slot, padding``: the bucket's boundary, the number of the
    batch in its bucket, the place in the batch and the padded tokens. Only ids and lengths are shuffled."""
    rows = materialize(docs.select(id_col, token_counts(docs, text_col).alias("n_tokens")), "packing")
    cuts, total = plan_buckets(rows, buckets)
    chunks = max(1, -(-total // chunk_rows))
    at = F.lit(None).cast("long")
    for c in reversed(cuts):
        at = F.when(F.col("n_tokens") <= c, F.lit(c).cast("long")).otherwise(at)
    digest = F.conv(F.substring(F.md5(F.col(id_col).cast("string")), 1, 12), 16, 10).cast("long")
    rows = rows.select(id_col, "n_tokens", at.alias("bucket_len"), F.coalesce(F.pmod(digest, F.lit(chunks)), F.lit(0)).cast("long").alias("chunk"))
    sizes = rows.groupBy("bucket_len", "chunk").count()
    before = Window.partitionBy("bucket_len").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("bucket_len", "chunk", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("shift"))
    inside = Window.partitionBy("bucket_len", "chunk").orderBy(id_col, "n_tokens")
    rows = rows.withColumn("row", F.row_number().over(inside)).join(sizes, ["bucket_len", "chunk"])
    rows = rows.withColumn("place", (F.col("row") - 1 + F.col("shift")).cast("long"))
    room = f"greatest(1L, {budget}L div greatest(bucket_len, 1L))"
    return rows.select(
        id_col, "n_tokens", "bucket_len", F.expr(f"place div {room}").alias("batch"), F.expr(f"place % {room}").alias("slot"), (F.col("bucket_len") - F.col("n_tokens")).alias("padding")
    )


def oracle_sql(buckets: int = BUCKETS, budget: int = BUDGET, chunk_rows: int = CHUNK_ROWS) -> str:
    """DuckDB SQL for ``pack`` over ``documents``: the dynamic program is one query block per bucket."""
    ctes = [
        r"""r AS (SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS BIGINT) AS n_tokens FROM documents)""",
        "g AS (SELECT n_tokens AS size, CAST(sum(count(*)) OVER (ORDER BY n_tokens) AS BIGINT) AS upto, row_number() OVER (ORDER BY n_tokens) AS j FROM r GROUP BY n_tokens)",
        "d1 AS (SELECT j, size * upto AS v, CAST(0 AS BIGINT) AS p FROM g)",
    ]
    for k in range(2, buckets + 1):
        ctes.append(
            f"d{k} AS (SELECT j, min(v) AS v, arg_min(p, struct_pack(v := v, p := p)) AS p FROM ("
            f"SELECT j, v, CAST(0 AS BIGINT) AS p FROM d{k - 1} UNION ALL "
            f"SELECT b.j, d.v + b.size * (b.upto - a.upto) AS v, a.j AS p FROM g b JOIN g a ON a.j < b.j JOIN d{k - 1} d ON d.j = a.j) GROUP BY j)"
        )
    ctes.append(f"b{buckets} AS (SELECT max(j) AS j FROM g)")
    for k in range(buckets, 1, -1):
        ctes.append(f"b{k - 1} AS (SELECT p AS j FROM d{k} JOIN b{k} USING (j) WHERE p > 0)")
    ends = " UNION ".join(f"SELECT j FROM b{k}" for k in range(1, buckets + 1))
    ctes += [
        f"e AS (SELECT size AS bucket_len FROM g JOIN ({ends}) USING (j))",
        f"c AS (SELECT greatest(1, CAST(ceil(count(*) / {chunk_rows}.0) AS BIGINT)) AS n FROM r)",
        "q AS (SELECT r.doc_id, r.n_tokens, (SELECT min(bucket_len) FROM e WHERE bucket_len >= r.n_tokens) AS bucket_len, CAST('0x' || substr(md5(CAST(r.doc_id AS VARCHAR)), 1, 12) AS BIGINT) % c.n AS chunk FROM r, c)",
        f"z AS (SELECT *, row_number() OVER (PARTITION BY bucket_len ORDER BY chunk, doc_id, n_tokens) - 1 AS place, greatest(1, {budget} // greatest(bucket_len, 1)) AS room FROM q)",
    ]
    return "WITH " + ",\n".join(ctes) + "\nSELECT doc_id, n_tokens, bucket_len, CAST(place // room AS BIGINT) AS batch, CAST(place % room AS BIGINT) AS slot, bucket_len - n_tokens AS padding FROM z"
