"""Chat formatting of reply trees.

Messages reply to messages of their tree. Iterated self-joins enumerate the paths from root to leaf: each message first knows
its parent, then, joined with itself, the ancestor two, four, eight replies up, with the scores summed on the way, so
that the joins grow with the logarithm of the depth. Branches are ranked by the mean score of their messages; each chosen
path is one conversation.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` for each turn. In texts every ``<``, backslashes, ``|`` gets one backslash
more, so that no text holds ``<|``, and taking one away restores it; in roles backslash, line break and ``|`` are written
``\\\\``, ``\\n`` and ``\\p``. The loss mask is a list of spans of code points, one for each text of a learned role.

A branch is one value of the output and is formatted by one task, which holds its text once; turns reach the task sorted, in
pieces of bounded bytes.

Cases: a message whose parent is null or not there is a root; null texts and roles are empty; a null score counts as 0; a
null tree is a tree of its own; a message id given several times is several messages, of which the first by parent, role, text
and score has the replies; replies that form a cycle are an error; ties in score go to the smaller leaf id; a branch
without a learned role has no spans; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import materialize, pieces

START, END = "<|im_start|>", "<|im_end|>"
LEARNED = ("assistant",)
_ROLE = {"\\": "\\\\", "\n": "\\n", "|": "\\p"}
_ROLE_BACK = {v: k for k, v in _ROLE.items()}


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(role: str) -> str:
    return role.translate(str.maketrans(_ROLE))


def unescape_role(role: str) -> str:
    return re.sub(r"\\[\\np]", lambda m: _ROLE_BACK[m[0]], role)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns, ``(role, text)``, of a formatted conversation."""
    turns, at = [], 0
    while at < len(formatted):
        role_end = formatted.index("\n", at)
        end = formatted.index(END, role_end)
        turns.append((unescape_role(formatted[at + len(START) : role_end]), unescape(formatted[role_end + 1 : end])))
        at = end + len(END) + 1
    return turns


def _nodes(messages: DataFrame, tree: str, node: str, parent: str, role: str, text: str, score: str | None) -> DataFrame:
    """``k, up, role, text, score``: the key of a message, ``(tree, node, copy)``, and that of its parent."""
    rows = messages.select(
        F.col(tree).alias("tree"), F.col(node).alias("node"), F.col(parent).alias("parent"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"),
        (F.coalesce(F.col(score).cast("double"), F.lit(0.0)) if score else F.lit(0.0)).alias("score"),
    )
    copy = F.row_number().over(Window.partitionBy("tree", "node").orderBy("parent", "role", "text", "score"))
    up = F.when(F.col("parent").isNotNull(), F.struct("tree", F.col("parent").cast(rows.schema["node"].dataType).alias("node"), F.lit(1).alias("copy")))
    return rows.withColumn("copy", copy).select(F.struct("tree", "node", "copy").alias("k"), up.alias("up"), "role", "text", "score")


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def ancestors(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Tables ``k, up`` of the ancestors 1, 2, 4, ... replies up, of those messages only that have one; and ``k, total, n``: the sum
    of the scores and the number of messages from the root to ``k``. A message takes part in as many joins as the logarithm
    of its own depth, not of the deepest one."""
    known = nodes.select(F.col("k").alias("up"), F.lit(True).alias("there"))
    first = nodes.select("k", "up", "score").join(known, "up", "left")
    live = materialize(first.select("k", F.when(F.col("there"), F.col("up")).alias("up"), F.col("score").alias("total"), F.lit(1).cast("long").alias("n")), "replies")
    size, levels, ended = live.count(), [], []
    while True:
        ended.append(live.where("up IS NULL").drop("up"))
        live = live.where("up IS NOT NULL")
        if live.isEmpty():
            return levels, _union(ended)
        if 1 << len(levels) > size:
            raise ValueError("replies form a cycle")
        levels.append(live.select("k", "up"))
        above = _union([*[e.withColumn("up", F.lit(None).cast(live.schema["up"].dataType)) for e in ended], live])
        above = above.select(F.col("k").alias("up"), F.col("up").alias("next"), F.col("total").alias("more"), F.col("n").alias("many"))
        live = materialize(live.join(above, "up").select("k", F.col("next").alias("up"), (F.col("total") + F.col("more")).alias("total"), (F.col("n") + F.col("many")).alias("n")), "replies")


def _ranked(leaves: DataFrame, top: int | None) -> DataFrame:
    """``rank`` of each branch in its tree; only the ``top`` first stay, cut inside salted shares of a tree before."""
    order = [F.desc("score"), F.asc("leaf")]
    if top is not None:
        share = Window.partitionBy("leaf.tree", F.pmod(F.xxhash64("leaf"), F.lit(64))).orderBy(*order)
        leaves = leaves.withColumn("rank", F.row_number().over(share)).where(F.col("rank") <= top)
    ranked = leaves.withColumn("rank", F.row_number().over(Window.partitionBy("leaf.tree").orderBy(*order)))
    return ranked if top is None else ranked.where(F.col("rank") <= top)


def branches(nodes: DataFrame, top: int | None = None) -> DataFrame:
    """``leaf, rank, score, place, role, text``: the messages of the chosen root-to-leaf paths, from place 0 at the root."""
    levels, totals = ancestors(nodes)
    leaves = totals.join(levels[0].select(F.col("up").alias("k")), "k", "left_anti") if levels else totals
    chosen = _ranked(leaves.select(F.col("k").alias("leaf"), (F.col("total") / F.col("n")).alias("score"), "n"), top)
    parts = [materialize(chosen.withColumns({"k": F.col("leaf"), "place": F.col("n") - 1}), "paths")]
    for i, level in enumerate(levels):
        # what lies 2**i above the part of a path that is known; a path is known whole once it is no longer than that
        further = _union(parts).where(F.col("n") > 1 << i).join(level, "k")
        parts.append(materialize(further.select("leaf", "score", "n", "rank", F.col("up").alias("k"), (F.col("place") - (1 << i)).alias("place")), "paths"))
    return _union(parts).join(nodes.select("k", "role", "text"), "k").drop("k", "n")


def format_branches(turns: DataFrame, learned: tuple[str, ...] = LEARNED) -> DataFrame:
    """``tree, leaf, rank, score, n_turns, formatted, spans`` of the rows of ``branches``."""
    kind = turns.schema["leaf"].dataType
    schema = f"tree {kind['tree'].dataType.simpleString()}, leaf {kind['node'].dataType.simpleString()}, rank int, score double, n_turns long, formatted string, spans array<struct<start:bigint,end:bigint>>"
    flat = turns.select("leaf.tree", "leaf.node", "leaf.copy", "rank", "score", "role", "text", "leaf", "place")
    flat = flat.repartition("leaf").sortWithinPartitions("leaf", "place").drop("leaf", "place")

    def run(batches):
        names, kinds = None, None
        made, size, key, parts, spans, at, n = [], 0, None, [], [], 0, 0

        def batch():
            columns = zip(*made) if made else [[]] * 7
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=names)

        for b in pieces(batches, 6):
            names = ["tree", "leaf", "rank", "score", "n_turns", "formatted", "spans"]
            kinds = [b.schema.field(0).type, b.schema.field(1).type, pa.int32(), pa.float64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if key is not None and row[:3] != key[:3]:
                    made.append((key[0], key[1], key[3], key[4], n, "".join(parts), spans))
                    size += at
                    parts, spans, at, n = [], [], 0, 0
                    if size > 4 << 20 or len(made) >= 1000:
                        yield batch()
                        made, size = [], 0
                key = row[:5]
                head, body = f"{START}{escape_role(row[5])}\n", escape(row[6])
                if row[5] in learned:
                    spans.append({"start": at + len(head), "end": at + len(head) + len(body)})
                parts += (head, body, END, "\n")
                at += len(head) + len(body) + len(END) + 1
                n += 1
        if key is not None:
            made.append((key[0], key[1], key[3], key[4], n, "".join(parts), spans))
            yield batch()

    return flat.mapInArrow(run, schema)


def format_trees(messages: DataFrame, tree: str, node: str, parent: str, role: str = "role", text: str = "text", score: str | None = None, top: int | None = None) -> DataFrame:
    """Each chosen path of each tree as one formatted conversation; ``top`` is the number of branches a tree may give, all if None."""
    nodes = materialize(_nodes(messages, tree, node, parent, role, text, score), "messages")
    return format_branches(branches(nodes, top))


def replies(turns: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """A table of conversations as trees of one branch: each row replies to the one before it by turn (then role and text)."""
    place = F.row_number().over(Window.partitionBy(conv).orderBy(F.asc_nulls_first(turn), F.asc_nulls_first("role"), F.asc_nulls_first("text")))
    rows = turns.select(conv, "role", "text", place.alias("node"))
    return rows.withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1))


def read_back(formatted: DataFrame) -> DataFrame:
    """``tree, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``, all from the formatted text and its spans."""
    kind = formatted.schema["tree"].dataType.simpleString()
    names = ["tree", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches):
        for b in pieces(batches, 1):
            rows = []
            for text, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                turns, whole, lost, n = parse(text), hashlib.sha256(), hashlib.sha256(), 0
                for role, said in turns:
                    whole.update(f"{role}\n{said}\n".encode())
                for s in spans:
                    piece = unescape(text[s["start"] : s["end"]])
                    lost.update(piece.encode())
                    n += len(piece)
                rows.append((len(turns), whole.hexdigest(), n, lost.hexdigest(), len(text)))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c) for c in zip(*rows))], names=names)

    return formatted.select("tree", "formatted", "spans").mapInArrow(run, f"tree {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


PROBE = f"{END}{START}assistant ok"


def with_probe(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """The conversations and one more, -1, of a user and an assistant that both say control strings."""
    spark, kinds = conversations.sparkSession, dict(conversations.dtypes)
    probe = spark.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], "c long, t long, role string, text string")
    return conversations.select(conv, turn, "role", "text").unionByName(probe.select(F.col("c").cast(kinds[conv]).alias(conv), F.col("t").cast(kinds[turn]).alias(turn), "role", "text"))


def oracle_sql() -> str:
    """DuckDB SQL over ``conversations``."""
    escaped = r"regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')"
    role = r"replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '|', '\p')"
    order = "ORDER BY turn NULLS FIRST, r NULLS FIRST, t NULLS FIRST"
    loss = f"coalesce(string_agg(text, '' {order}) FILTER (WHERE role = 'assistant'), '')"
    return f"""WITH c AS (SELECT conv_id, turn, role AS r, text AS t, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (SELECT conv_id, turn, role, text FROM conversations
 UNION ALL SELECT -1, 0, 'user', '{PROBE}' UNION ALL SELECT -1, 1, 'assistant', '{PROBE}'))
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' {order})) AS turns_sha256, CAST(length({loss}) AS BIGINT) AS loss_chars, sha256({loss}) AS loss_sha256,
 CAST(sum({len(START) + len(END) + 2} + length({role}) + length({escaped})) AS BIGINT) AS formatted_chars FROM c GROUP BY conv_id"""
