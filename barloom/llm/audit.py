"""Filter interaction audit by the multilinear extension.

Five filters judge every document; what a chain of them removes at each step depends on their order. Per part, the
documents are counted by the mask of the filters that they fail. With ``c[m]`` documents of mask ``m``, the number that a
set of filters removes is, on the corners of the unit cube, the polynomial

    v(x) = sum over m of c[m] * (1 - product over i in m of (1 - x_i)),

which is multilinear: one coefficient for each set of filters. A filter's Shapley value is the integral along the
diagonal of its partial derivative; with exact rationals, times 120, it is the number that the filter removes summed over
all orders. Values at corners give what survives each step of each order.

Texts are read once, in Arrow batches that leave only numbers and a digest. Equal texts are met by SHA-256; rows that agree
in text, part, labels and id are counted before and after that shuffle, so a text that fills a third of the table is a
few rows for each task. What reaches one part's polynomial is 32 masks at most.

Cases: a null text is empty and fails A (B, C and D need words or characters: 100*0 < 65*0 is false); null and empty texts are
identical to each other; a null id is smaller than no other and no id is smaller than it; repeated rows count one by one
and are not copies of themselves, as their id is the same; a null part is the empty string; several labels of one id
count once, as the larger; labels that are null count as 0; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from fractions import Fraction
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import pieces

FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_UPPER = 50, 65, 5
_UPPER, _SYMBOLS, _INSIDE = bytes(range(65, 91)), b"#$%&*|", bytes(range(0x80, 0xC0))
SCALE = factorial(len(FILTERS))


def own_failures(text: bytes) -> int:
    """Mask of the filters A to D that a text fails by itself. White space of words is that of ``bytes.split``."""
    words = text.split()
    upper, points = len(text) - len(text.translate(None, _UPPER)), len(text.translate(None, _INSIDE))
    failed = (len(words) < LEAST_WORDS, 100 * len(set(words)) < LEAST_DISTINCT * len(words), 100 * upper > MOST_UPPER * points, len(text.translate(None, _SYMBOLS)) < len(text))
    return sum(1 << i for i, f in enumerate(failed) if f)


def failures(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """``part, mask, n, n_good, n_toxic``: documents by the filters that they fail, of quality 1 and toxic ones."""
    key = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in pieces(batches, 2):
            texts = [t or b"" for t in b.column(2).cast(pa.binary()).to_pylist()]
            digest = pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), digest, pa.array(map(own_failures, texts), pa.int32())], names=["id", "part", "h", "own"])

    source = docs.select(F.col(id_col), F.coalesce(F.col(part_col).cast("string"), F.lit("")), F.col(text_col))
    rows = source.mapInArrow(run, f"id {key}, part string, h binary, own int").groupBy("id", "part", "h", "own").agg(F.count("*").alias("n"))
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id"))
    known = known.agg(*[F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(f) for c, f in (("quality", "good"), ("toxic", "bad"))])
    rows = rows.join(known, "id", "left").fillna(0, ["good", "bad"])
    kinds = rows.groupBy("h", "part", "own", "good", "bad").agg(
        F.sum("n").alias("n"), F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("first"), F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("n"))), F.lit(0)).alias("nameless")
    )
    # of the rows of a text, those of its smallest id and those without one are no copies
    least = F.min("first.id").over(Window.partitionBy("h"))
    kinds = kinds.withColumn("kept", F.col("nameless") + F.when(F.col("first.id") == least, F.col("first.n")).otherwise(0))
    copy = 1 << FILTERS.index("E")
    each = F.inline(F.array(F.struct(F.col("own").alias("mask"), F.col("kept").alias("n")), F.struct(F.col("own").bitwiseOR(F.lit(copy)).alias("mask"), (F.col("n") - F.col("kept")).alias("n"))))
    counted = kinds.select("part", "good", "bad", each).groupBy("part", "mask")
    return counted.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("n_good"), F.sum(F.col("n") * F.col("bad")).alias("n_toxic"))


class Removal:
    """The polynomial of removed documents: ``terms[T]`` is the coefficient of the product of the filters in mask ``T``."""

    def __init__(self, counts: dict[int, int]):
        sets = range(1, 1 << len(FILTERS))
        self.terms = {t: (1 if t.bit_count() % 2 else -1) * sum(n for m, n in counts.items() if m & t == t) for t in sets}

    def at(self, corner: int) -> int:
        """Documents that the filters of the mask remove together."""
        return sum(a for t, a in self.terms.items() if t & corner == t)

    def shapley(self, i: int) -> Fraction:
        """The integral over t from 0 to 1 of the partial derivative by filter ``i`` at (t, ..., t): each term that holds
        the filter leaves a power of t, one lower than its number of filters."""
        return sum((Fraction(a, t.bit_count()) for t, a in self.terms.items() if t >> i & 1), Fraction(0))


def report(part: str, masks: list[tuple[int, int, int, int]]) -> list[tuple]:
    """The rows of one part, for each order and step, from ``(mask, n, n_good, n_toxic)``."""
    every, good, toxic = (Removal({m[0]: m[k] for m in masks}) for k in (1, 2, 3))
    total, corners = sum(m[1] for m in masks), range(1 << len(FILTERS))
    gone, gone_good, gone_toxic = ([p.at(s) for s in corners] for p in (every, good, toxic))
    shares = [int(every.shapley(i) * SCALE) for i in range(len(FILTERS))]
    rows = []
    for order in permutations(range(len(FILTERS))):
        name, before = "".join(FILTERS[i] for i in order), 0
        for step, i in enumerate(order, 1):
            one, after = 1 << i, before | 1 << i
            removed = gone[after] - gone[before]
            unique = gone[-1] - gone[corners[-1] ^ one]
            rows.append((part, name, step, total - gone[after], removed, gone[one] - removed, unique, gone_good[after] - gone_good[before], gone_toxic[after] - gone_toxic[before], shares[i]))
            before = after
    return rows


RESULT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row per part, order of the filters and step."""
    masks = failures(docs, labels, id_col, text_col, part_col).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "n_good", "n_toxic")).alias("masks"))
    names = [f.split()[0] for f in RESULT.split(", ")]
    kinds = [pa.string(), pa.string(), pa.int32(), *[pa.int64()] * 7]

    def run(batches):
        for b in batches:
            for part, found in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                columns = zip(*report(part, [tuple(m.values()) for m in found]))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return masks.mapInArrow(run, RESULT)


def oracle_sql() -> str:
    """DuckDB SQL over ``documents`` and ``labels``: every order is walked, without polynomials."""
    orders = ", ".join(f"('{''.join(p)}')" for p in permutations(FILTERS))
    return rf"""WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
f AS (SELECT t.part, coalesce(l.quality = 1, FALSE) AS good, coalesce(l.toxic = 1, FALSE) AS bad, [len(w) < {LEAST_WORDS}, 100 * len(list_distinct(w)) < {LEAST_DISTINCT} * len(w),
 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > {MOST_UPPER} * length(text), regexp_matches(text, '[#$%&*|]'), coalesce(min(t.doc_id) OVER (PARTITION BY text) < t.doc_id, FALSE)] AS fails
 FROM t LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id) l ON l.doc_id = t.doc_id),
m AS (SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS g, count(*) FILTER (WHERE bad) AS b FROM f GROUP BY part, fails),
o AS (SELECT filter_order, step, list_transform(range(1, step + 1), lambda k: ascii(filter_order[k]) - 64) AS used FROM (VALUES {orders}) v(filter_order), (SELECT unnest(range(1, 6)) AS step)),
s AS (SELECT m.*, o.filter_order, CAST(o.step AS INTEGER) AS step, used[step] AS own, fails[used[step]] AS fail, len(list_filter(used[:step - 1], lambda k: fails[k])) > 0 AS earlier,
 len(list_filter(fails, lambda x: x)) = 1 AS single FROM m, o),
r AS (SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (WHERE NOT fail AND NOT earlier), 0) AS kept, coalesce(sum(n) FILTER (WHERE fail AND NOT earlier), 0) AS removed, coalesce(sum(n) FILTER (WHERE fail AND earlier), 0) AS redundant,
 coalesce(sum(n) FILTER (WHERE fail AND single), 0) AS unique_fails, coalesce(sum(g) FILTER (WHERE fail AND NOT earlier), 0) AS good_lost, coalesce(sum(b) FILTER (WHERE fail AND NOT earlier), 0) AS toxic_lost FROM s GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
 CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM r"""
