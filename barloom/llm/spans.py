"""Substring dedup by sliding sentence spans.

A text is cut into sentences after ``.``, ``!`` or ``?`` and at line breaks. A sentence of more than ``LONGEST``
words is cut further, after the word of the smallest hash among any ``LONGEST`` words in a row that have no cut:
passages are pasted into the middle of sentences, and whole sentences alone miss a third of those of 51 words
(README). A span starts at each sentence and runs over consecutive sentences until it has ``least_sentences`` of
them and ``least_words`` words. With the default bounds every run of 51 words that repeats holds a whole span:
its cuts agree from its 10th word to its 10th last, one of its words 10 to 19 ends a sentence, and the span that
starts there ends within 23 words. Spans are hashed to 128 bits over their lower-cased words, joined over all documents, and the sentences
of every span that is not the first of its kind, by (id, text key, position), are removed.

Cases: null texts come back as empty texts with no sentences; texts too short for a span are left alone; a
null id sorts before all others; rows that agree in id and text share one result; extra columns are kept
by ``remove_repeats``; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.common import materialize, pieces, scratch

#: By byte: white space (that of ``bytes.split``), the end of a sentence, the lower case, the table of CRC-32.
_SPACE = np.isin(np.arange(256), np.frombuffer(b" \t\n\r\x0b\x0c", np.uint8))
_STOP = np.isin(np.arange(256), np.frombuffer(b".!?", np.uint8))
_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, np.uint32(0xEDB88320) ^ (_CRC >> 1), _CRC >> 1).astype(np.uint32)
#: Bytes of the words that are hashed side by side.
_LONG = 48
#: Room for a word's place below its 33-bit rank; a piece of texts has fewer than 2**31 bytes, so 2**30 words at most.
_PLACE_BITS = 30
_PLACES = (1 << _PLACE_BITS) - 1
#: Bytes of the texts that are parsed side by side.
_SIDE = 1 << 20
LEAST_SENTENCES, LEAST_WORDS = 2, 14
#: Words in a row of which one at least ends a sentence.
LONGEST = 10


def _ranks(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """1 + CRC-32 of each lower-cased word, a byte of all words at a time; those of very long words one by one."""
    size = end - begin
    order = np.argsort(-np.minimum(size, _LONG + 1), kind="stable")
    low, sizes = _LOWER[raw], size[order]
    first = int(np.searchsorted(-sizes, -_LONG))
    at = begin[order]
    crc = np.full(len(order), 0xFFFFFFFF, np.uint32)
    live = np.searchsorted(-sizes, -np.arange(min(_LONG, int(size.max(initial=0)))), side="left")
    for j, k in enumerate(live.tolist()):
        part = crc[first:k]
        crc[first:k] = _CRC[(part ^ low[at[first:k] + j]) & np.uint32(255)] ^ (part >> np.uint32(8))
    out = np.empty(len(order), np.int64)
    out[order] = (crc ^ np.uint32(0xFFFFFFFF)).astype(np.int64) + 1
    for i in order[:first].tolist():
        out[i] = 1 + zlib.crc32(low[begin[i] : end[i]].tobytes())
    return out


class _Parsed:
    """Texts side by side: ``whole``, where each word begins and ends in it, the first word of each sentence (``starts``,
    closed by the number of words), and each text's first sentence (``of``, closed by their number)."""

    def __init__(self, texts: list[bytes]):
        self.whole = whole = b" ".join(texts)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.base = base = np.cumsum(sizes + 1) - sizes - 1
        raw = np.frombuffer(whole, np.uint8)
        edges = np.flatnonzero(np.diff(_SPACE[raw], prepend=True, append=True))
        self.begin, self.end = begin, end = edges[::2], edges[1::2]
        n = len(begin)
        first = np.searchsorted(begin, base)  # each text's first word
        text_of = np.repeat(np.arange(len(texts)), np.diff(np.append(first, n)))
        rank = _ranks(raw, begin, end)
        rank[_STOP[raw[end - 1]]] = 0
        lines = np.flatnonzero(raw == 10)
        before = np.searchsorted(begin, lines) - 1
        rank[before[(before >= 0) & (begin[before] >= base[np.searchsorted(base, lines, side="right") - 1])] if n else []] = 0
        cut_after = rank == 0
        if n >= LONGEST:
            # the last one of the smallest in each window; a window that has a cut already chooses one
            least = (rank << _PLACE_BITS) | (_PLACES - np.arange(n))
            width = 1
            while 2 * width <= LONGEST:
                least = np.minimum(least[:-width], least[width:])
                width *= 2
            if width < LONGEST:
                least = np.minimum(least[: width - LONGEST], least[LONGEST - width :])
            inside = text_of[: n - LONGEST + 1] == text_of[LONGEST - 1 :]
            cut_after[_PLACES - (least[inside] & _PLACES)] = True
        cut_after[np.append(first[1:], n)[np.diff(np.append(first, n)) > 0] - 1] = True
        self.starts = np.concatenate([[0], np.flatnonzero(cut_after) + 1])
        self.of = np.searchsorted(self.starts, np.append(first, n))


def sentences(text: bytes, seen: dict | None = None) -> tuple[list[bytes], np.ndarray]:
    """Words with the white space that follows them, and the index of each sentence's first word."""
    p = _Parsed([text])
    at = [*p.begin.tolist(), len(text)]
    return [text[a:b] for a, b in zip(at, at[1:])], p.starts


def span_ends(starts: np.ndarray, least_sentences: int, least_words: int) -> np.ndarray:
    """For each sentence the end (exclusive) of the span that starts there; beyond the last if none."""
    n = len(starts) - 1
    by_words = np.searchsorted(starts, starts[:-1] + least_words, side="left")
    return np.maximum(by_words, np.arange(n) + least_sentences)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_key"), text_col)


def spans(docs: DataFrame, id_col: str, text_col: str, least_sentences: int, least_words: int) -> DataFrame:
    """One row per span: ``id, text_key, pos, h1, h2``; pos is its first sentence."""
    source = _keyed(docs, id_col, text_col)
    longs = [T.StructField(c, T.LongType()) for c in ("h1", "h2")]
    schema = T.StructType([source.schema["id"], source.schema["text_key"], T.StructField("pos", T.IntegerType()), *longs])

    def run(batches):
        for b in pieces(batches, 2, size=_SIDE):
            p = _Parsed([t or b"" for t in b.column(2).cast(pa.binary()).to_pylist()])
            text_of = np.repeat(np.arange(len(b), dtype=np.int32), np.diff(p.of))
            ends = span_ends(p.starts, least_sentences, least_words)
            ok = np.flatnonzero(ends <= p.of[1:][text_of])
            if len(ok):
                low = b" ".join(p.whole.split()).lower() + b" "
                at = np.concatenate([[0], np.cumsum(p.end - p.begin + 1)])
                h = [xxhash.xxh3_128_digest(low[s:e]) for s, e in zip(at[p.starts[ok]].tolist(), at[p.starts[ends[ok]]].tolist())]
                take, words = pa.array(text_of[ok]), np.frombuffer(b"".join(h), np.int64).reshape(-1, 2)
                pos = (ok - p.of[text_of[ok]]).astype(np.int32)
                cols = [b.column(0).take(take), b.column(1).take(take), pa.array(pos), *(pa.array(np.ascontiguousarray(x)) for x in words.T)]
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return source.mapInArrow(run, schema)


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_sentences: int = LEAST_SENTENCES, least_words: int = LEAST_WORDS) -> DataFrame:
    """``id, text_key, cover``: per document the first sentences of the spans to remove.

    Spans are counted with partial aggregation; only those that recur are looked at again. They are joined by tables of
    their own, so that the optimizer may split a frequent span."""
    place = F.struct("id", "text_key", "pos")
    with scratch(docs.sparkSession) as keep:
        table = materialize(spans(docs, id_col, text_col, least_sentences, least_words), "spans")
        recurs = materialize(table.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1", "h2"), "spans")
        again = materialize(table.join(recurs, ["h1", "h2"]), "spans")
        first = materialize(again.groupBy("h1", "h2").agg(F.min(place).alias("first")), "spans")
        later = again.join(first, ["h1", "h2"]).where(~place.eqNullSafe(F.col("first")))
        return keep(materialize(later.groupBy("id", "text_key").agg(F.collect_set("pos").alias("cover")), "spans"))


def cut(text: bytes | None, cover: list | None, least_sentences: int = LEAST_SENTENCES, least_words: int = LEAST_WORDS) -> tuple[bytes, int, int]:
    """The text without the sentences of the spans that start at ``cover``, the number of sentences and of those
    removed."""
    return _cut_all([text], [cover], least_sentences, least_words)[0]


def _cut_all(texts: list[bytes | None], covers: list, least_sentences: int, least_words: int) -> list[tuple[bytes, int, int]]:
    """``cut`` of texts that are parsed side by side."""
    p = _Parsed([t or b"" for t in texts])
    ends = span_ends(p.starts, least_sentences, least_words)
    place = np.append(p.begin, len(p.whole))[p.starts]
    out = []
    for t, cover, at, a, z in zip(texts, covers, p.base.tolist(), p.of.tolist(), p.of[1:].tolist()):
        if not cover:
            out.append((t or b"", z - a, 0))
            continue
        edge = np.zeros(z - a + 1, np.int64)
        first = np.array(cover)
        np.add.at(edge, first, 1)
        np.add.at(edge, ends[a + first] - a, -1)
        gone = np.cumsum(edge)[:-1] > 0
        cuts = place[a : z + 1] - at
        cuts[-1] = len(t)
        change = np.flatnonzero(np.diff(gone, prepend=True, append=True))  # begin and end of each run that stays
        kept = b"".join(t[x:y] for x, y in zip(cuts[change[::2]].tolist(), cuts[change[1::2]].tolist()))
        out.append((t[: cuts[0]] + kept, z - a, int(gone.sum())))
    return out


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counts: bool = False, least_sentences: int = LEAST_SENTENCES, least_words: int = LEAST_WORDS
) -> DataFrame:
    """``docs`` with the repeated sentences removed from ``text_col``; with ``counts`` also n_sentences and
    n_removed. One shuffle of the texts, to meet the list of what goes."""
    gone = repeats(docs, id_col, text_col, least_sentences, least_words).toDF("__id", "__key", "__cover")
    at, names = docs.columns.index(text_col), docs.columns
    more = [T.StructField("n_sentences", T.LongType()), T.StructField("n_removed", T.LongType())] if counts else []
    schema = T.StructType([*docs.schema.fields, *more])
    text_key = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    joined = docs.join(gone, F.col(id_col).eqNullSafe(F.col("__id")) & (text_key == F.col("__key")), "left").drop("__id", "__key")
    wide = pa.int64()

    def run(batches):
        for b in pieces(batches, at, size=_SIDE):
            texts, covers = b.column(at).cast(pa.binary()).to_pylist(), b.column(len(names)).to_pylist()
            done = _cut_all(texts, covers, least_sentences, least_words)
            out, n, m = zip(*done) if done else ((), (), ())
            cols = [b.column(i) for i in range(len(names))]
            cols[at] = pa.array(out, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(cols + ([pa.array(n, wide), pa.array(m, wide)] if counts else []), names=schema.names)

    return joined.mapInArrow(run, schema)
