"""Language-model scoring: corpus-wide token counts and a gated recurrent model with their tail.

Counts of every token of the training documents are aggregated over the whole corpus. A bounded head of the
most frequent tokens goes to the tasks; all other tokens meet their counts in an equi-join, so the
vocabulary may grow without bound. The recurrent model (``gru``) has a class-factored softmax over the most
frequent tokens; for any other token its probability of "outside the vocabulary" is multiplied with that
token's smoothed share of the outside mass, which makes it a distribution over all texts.

Training: all tasks start from one model, whose biases are the unigram model of the counts. They make a first, fast
pass over every tenth training text and a second one over all, learning from every window of every text with the state
carried from window to window; after each pass the tasks' parameters are averaged, weighted by tokens, in two levels of
at most 256 rows each. So the model depends on how the rows are dealt to tasks, and float sums may differ in the last
digits between runs.

Cases: a null or empty text has one token, its end; a null id counts as held out; repeated rows are counted
and scored one by one; without training documents every token has the probability of an unseen one; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm import gru
from barloom.llm.common import materialize, pieces

#: The end of a text as a token; no word holds white space.
END = "\n"
#: Steps of the logarithmic count histogram per doubling.
_FINE = 16
#: Bytes of text that a task holds at a time where texts are read side by side.
_TRAIN_BYTES = 64 << 20
#: Bytes of text whose words a task holds at a time.
_WORD_BYTES = 8 << 20


def held_out(doc_id) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 == 0


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, one after another, and how many each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words, cuts = lists.flatten(), np.array(lists.offsets, np.int64)
    cuts -= cuts[0]
    full = pc.not_equal(words, "")  # white space at either end of a text leaves an empty word there
    if not pc.all(full).as_py():
        words, cuts = words.filter(full), np.append(0, np.cumsum(np.array(full)))[cuts]
    return words, np.diff(cuts)


def training(b: pa.RecordBatch) -> pa.Array:
    """The texts of a batch of ids and texts that are learned from."""
    return b.column(1).filter(pa.array([not held_out(i) for i in b.column(0).to_pylist()], pa.bool_()))


def count_tokens(docs: DataFrame, id_col: str, text_col: str, flush: int = 400_000) -> DataFrame:
    """``token, c`` of the training documents. Tasks count ahead of the shuffle, in tables of bounded size."""

    def run(batches):
        held, n = [], 0
        for b in pieces(batches, 1):
            words, lens = words_of(training(b))
            found = words.value_counts()
            token, times = found.field(0), found.field(1)
            held.append(pa.table({"token": pa.concat_arrays([token, pa.array([END] * (len(lens) > 0), token.type)]), "n": pa.concat_arrays([times, pa.array([len(lens)] * (len(lens) > 0), pa.int64())])}))
            n += len(held[-1])
            if n > flush:
                held = [_added(held)]
                n = len(held[0])
                if 2 * n > flush:
                    yield from held[0].to_batches()
                    held, n = [], 0
        if n:
            yield from _added(held).to_batches()

    return docs.select(id_col, text_col).mapInArrow(run, "token string, n long").groupBy("token").agg(F.sum("n").alias("c"))


def _added(counts: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(counts).group_by("token", use_threads=False).aggregate([("n", "sum")]).rename_columns(["token", "n"])


class Head:
    """The most frequent tokens with their counts, and what the model needs of the corpus totals."""

    def __init__(self, rows: list[tuple[str, int]], total: int, distinct: int, vocabulary: int):
        rows = sorted(rows, key=lambda r: (-r[1], r[0]))
        self.tokens = pa.array([t for t, _ in rows], pa.string())
        self.counts = np.array([c for _, c in rows], np.int64)
        self.total, self.distinct = total, distinct
        slot = np.zeros(len(rows) + 1, np.int64)  # the last one stands for tokens outside the head
        free = 2
        self.end = next((j for j, (t, _) in enumerate(rows) if t == END), -1)
        self.slot_counts = np.zeros(vocabulary, np.int64)
        for j, (_, c) in enumerate(rows):
            if j == self.end or free < vocabulary:
                slot[j] = gru.END if j == self.end else free
                free += j != self.end
                self.slot_counts[slot[j]] = c
        self.slot = slot
        own = np.flatnonzero(slot[:-1])
        self.vocabulary, self.own_slots = self.tokens.take(pa.array(own)), np.append(slot[own], gru.UNKNOWN)
        inside, used = int(self.slot_counts.sum()), int((slot > 0).sum())
        self.slot_counts[gru.UNKNOWN] = total - inside
        self.outside = (total - inside) + 0.1 * (distinct - used) + 0.1
        self.all = total + 0.1 * (distinct + 1)

    def ids(self, words: list[bytes] | pa.Array) -> np.ndarray:
        """The places in the head of the words of a text and its end, -1 for those outside."""
        return np.append(_find(words, self.tokens), self.end)

    def slots(self, ids: np.ndarray) -> np.ndarray:
        s = self.slot[ids]
        s[-1] = gru.END
        return s

    def read(self, words: list[bytes] | pa.Array) -> np.ndarray:
        """The slots of a text by a table of the vocabulary alone."""
        return np.append(self.own_slots[_find(words, self.vocabulary)], gru.END)


def _find(words: list[bytes] | pa.Array, among: pa.Array) -> np.ndarray:
    return np.array(pc.fill_null(pc.index_in(pa.array(words, pa.string()), value_set=among), -1))


def with_ends(lens: np.ndarray) -> np.ndarray:
    """For each token of texts of so many words its place among all words, after which one end stands."""
    n = int(lens.sum())
    out = np.full(n + len(lens), n)
    word = np.ones(len(out), bool)
    word[np.cumsum(lens + 1) - 1] = False
    out[word] = np.arange(n)
    return out


def _rare(words: pa.Array, row: np.ndarray, rows: int) -> tuple[pa.Array, pa.Array]:
    """For each of so many rows its distinct words and how often it has each; ``row`` is that of each word."""
    coded = words.dictionary_encode()
    size = max(1, len(coded.dictionary))
    key, times = np.unique(row * size + np.array(coded.indices, np.int64), return_counts=True)
    cuts = pa.array(np.searchsorted(key, np.arange(rows + 1) * size), pa.int32())
    return pa.ListArray.from_arrays(cuts, coded.dictionary.take(pa.array(key % size))), pa.ListArray.from_arrays(cuts, pa.array(times, pa.int32()))


def _average(parts: DataFrame) -> DataFrame:
    """Token-weighted means of parameter vectors: ``part, n, values`` to one row per 256 parts."""

    def mean(table: pa.Table) -> pa.Table:
        n = np.array(table.column("n").to_pylist(), float)
        v = sum(w * np.frombuffer(x.as_py(), np.float32) for w, x in zip(n, table.column("values"))) / max(1.0, n.sum())
        return pa.table({"part": pa.array([table.column("part")[0].as_py() // 256], pa.int64()), "n": pa.array([int(n.sum())], pa.int64()), "values": pa.array([v.astype(np.float32).tobytes()], pa.binary())})

    return parts.groupBy(F.expr("part div 256")).applyInArrow(mean, "part long, n long, values binary")


def train(docs: DataFrame, head: Head, id_col: str, text_col: str, hidden: int, classes: int, rounds: tuple[tuple[int, float], ...]) -> dict:
    """The model after rounds of (every how-manieth text, learning rate)."""
    model = gru.init(head.slot_counts, hidden, classes)
    for every, rate in rounds:
        source = docs.select(id_col, text_col)
        if every > 1:
            source = source.where(F.pmod(F.xxhash64(id_col, text_col), F.lit(every)) == 0)
        model = _round(source, head, model, rate)
    return model


def _round(source: DataFrame, head: Head, model: dict, rate: float) -> dict:
    """The mean of what all tasks make of ``model`` by one pass over their rows."""
    first = gru.flat(model)

    def run(batches):
        m, n = gru.unflat(first, model), 0
        opt = gru.Adam(m, rate)
        for b in pieces(batches, 1, rows=10_000, size=_TRAIN_BYTES):
            texts = []
            for part in pieces([b], 1, rows=10_000, size=_WORD_BYTES):
                words, lens = words_of(training(part))
                if len(lens):
                    slots = head.read(words)[with_ends(lens)].astype(np.int32)
                    texts += np.split(slots, np.cumsum(lens + 1)[:-1])
            if texts:
                gru.train(m, texts, opt)
                n += sum(map(len, texts))
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([n], pa.int64()), pa.array([gru.flat(m).tobytes()], pa.binary())], names=["part", "n", "values"])

    parts = materialize(source.mapInArrow(run, "part long, n long, values binary"), "lm")
    rows = _average(_average(parts)).collect()
    if not rows:
        return model
    total = sum(r["n"] for r in rows)
    return gru.unflat(sum(r["n"] / total * np.frombuffer(r["values"], np.float32).astype(float) for r in rows), model)


def score(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", head_size: int = 150_000, vocabulary: int = 1024, hidden: int = 24, classes: int = 32, rounds: tuple[tuple[int, float], ...] = ((10, 0.02), (1, 0.008))
) -> DataFrame:
    """``id_col, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row."""
    counts = count_tokens(docs, id_col, text_col).withColumn("level", F.floor(F.log2("c") * _FINE))
    counts = materialize(counts, "lm")
    levels = sorted(((r[0], r[1], r[2]) for r in counts.groupBy("level").agg(F.count("*"), F.sum("c")).collect()), reverse=True)
    total, distinct = sum(r[2] for r in levels), sum(r[1] for r in levels)
    cut, size = math.inf, 0
    for level, n, _ in levels:
        if size + n > head_size:
            break
        cut, size = level, size + n
    in_head = (F.col("level") >= F.lit(cut if size else 1 << 40)) | (F.col("token") == END)
    rows = counts.where(in_head).select("token", "c").collect()
    head = Head([tuple(r) for r in rows], total, distinct, vocabulary)
    model = train(docs, head, id_col, text_col, hidden, classes, rounds)

    source = docs.select(id_col, text_col)
    schema = T.StructType(
        [T.StructField("uid", T.LongType()), source.schema[id_col], T.StructField("held_out", T.BooleanType())]
        + [T.StructField(n, T.LongType()) for n in ("n_tokens", "n_known", "n_rare", "n_outside")]
        + [T.StructField("base", T.DoubleType()), T.StructField("model", T.DoubleType()), T.StructField("rare", T.ArrayType(T.StringType())), T.StructField("times", T.ArrayType(T.IntegerType()))]
    )
    logs = np.log10(np.append(head.counts, 0) + 0.1)
    logs[-1] = 0.0  # tokens outside the head are added later

    def read(b):
        """The slots of each text of a batch, and its columns but for ``uid`` and ``model``."""
        words, lens = words_of(b.column(1))
        place = with_ends(lens)
        first = np.cumsum(lens + 1) - lens - 1
        by_text = lambda values: np.add.reduceat(values, first)
        x = head.ids(words)[place]
        s = head.slot[x].astype(np.int32)
        s[first + lens] = gru.END
        found, lone = logs[x], s == gru.UNKNOWN
        known = by_text((x >= 0).astype(np.int64))
        outside = np.flatnonzero(x < 0)
        rare = _rare(pa.concat_arrays([words, pa.array([END], words.type)]).take(pa.array(place[outside])), np.searchsorted(first, outside, side="right") - 1, len(lens))
        out = pa.array([held_out(i) for i in b.column(0).to_pylist()], pa.bool_())
        return np.split(s, first[1:]), by_text(found * lone), [b.column(0), out, *map(pa.array, (lens + 1, known, lens + 1 - known, by_text(lone.astype(np.int64)), by_text(found))), *rare]

    def run(batches):
        uid = TaskContext.get().partitionId() << 33
        for b in pieces(batches, 1, rows=10_000, size=_TRAIN_BYTES):
            parts = [read(part) for part in pieces([b], 1, rows=10_000, size=_WORD_BYTES)]
            lp = gru.score(model, [t for texts, _, _ in parts for t in texts]) / math.log(10)
            for texts, inside, cols in parts:
                n = len(texts)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(uid, uid + n)), *cols[:-2], pa.array(lp[:n] + inside), *cols[-2:]], names=schema.names)
                uid, lp = uid + n, lp[n:]

    scored = materialize(source.mapInArrow(run, schema), "lm")
    tail = counts.where(~in_head).select("token", "c")
    rare = scored.select("uid", F.inline(F.arrays_zip("rare", "times")).alias("token", "times"))
    c = F.coalesce("c", F.lit(0))
    rare = rare.join(tail, "token", "left").groupBy("uid").agg(
        F.sum(F.col("times") * F.log10(c + 0.1)).alias("rare_logs"), F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("rare_known")
    )
    logs_of = F.coalesce("rare_logs", F.lit(0.0))
    # without training documents the head lacks the end of a text, which the model has nonetheless
    outside_logs = logs_of - F.lit(0.0 if head.end >= 0 else math.log10(0.1))
    return scored.drop("rare", "times").join(rare, "uid", "left").select(
        id_col, "held_out", "n_tokens", (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + logs_of - F.col("n_tokens") * F.lit(math.log10(head.all))).alias("base_score"),
        (F.col("model") + outside_logs - F.col("n_outside") * F.lit(math.log10(head.outside))).alias("score"),
    )
