"""The registered queries of the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from barloom.llm.common import finished, shared_dir
from barloom.llm import audit, chat, codes, decontaminate, embeddings, html_text, lm, packing, sharding, simhash, spans, suffixes, toxicity


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op7_simhash(spark, sf_dir):
    out = finished(spark, lambda: simhash.simhash_components(table(spark, sf_dir, "documents")), "op7")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op1_embedding_near_dedup(spark, sf_dir):
    out = finished(spark, lambda: embeddings.near_duplicates(table(spark, sf_dir, "embeddings")), "op1")
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op2_sharding(spark, sf_dir, arrivals: int = 4):
    """The table arrives in batches, is compacted, and is read back from the last manifest."""
    docs = table(spark, sf_dir, "documents")
    store = sharding.ShardStore(spark, f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}")
    for i in range(arrivals):
        store.append(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(arrivals)) == i))
    store.compact()
    store.vacuum()
    text = F.coalesce("text", F.lit(""))
    return store.read().select("doc_id", "lang", "source", F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("text_sha256"))


OP2_SQL = """SELECT doc_id, lang, source, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes, sha256(coalesce(text, '')) AS text_sha256 FROM documents"""


OP1_SQL = """WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0
 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE CASE WHEN len(a.e) = len(b.e) THEN list_cosine_similarity(a.e, b.e) >= 0.93 ELSE FALSE END),
r AS (SELECT vec_id AS node, vec_id AS root FROM v UNION SELECT l.w, r.root FROM r JOIN l ON l.u = r.node WHERE r.root < l.w),
c AS (SELECT node, min(root) AS root FROM r GROUP BY node), k AS (SELECT u, count(*) AS n FROM l GROUP BY u)
SELECT vec_id, CAST(coalesce(k.n, 0) AS BIGINT) AS n_links, coalesce(c.root, vec_id) AS component_id, vec_id = coalesce(c.root, vec_id) AS kept FROM embeddings LEFT JOIN c ON c.node = vec_id LEFT JOIN k ON k.u = vec_id"""


def op4_html_text(spark, sf_dir):
    return html_text.extract(table(spark, sf_dir, "pages"))


def op3_sentence_spans(spark, sf_dir):
    out = spans.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), counts=True)
    return out.select("doc_id", "n_sentences", "n_removed", F.length("text").cast("long").alias("n_chars"), "text")


def op5_suffix_array(spark, sf_dir):
    """With ``text``: what is left, where a cut inside a character leaves U+FFFD."""
    out = suffixes.remove_repeats(table(spark, sf_dir, "documents"))
    return out.withColumn("text", F.make_valid_utf8(F.col("kept").cast("string"))).drop("kept")


def op6_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op8_packing(spark, sf_dir):
    return finished(spark, lambda: packing.pack(table(spark, sf_dir, "documents")), "op8")


def op9_language_model(spark, sf_dir):
    return finished(spark, lambda: lm.score(table(spark, sf_dir, "documents")), "op9")


def op10_decontamination(spark, sf_dir):
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_filter_audit(spark, sf_dir):
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_chat_formatting(spark, sf_dir):
    turns = chat.replies(chat.with_probe(table(spark, sf_dir, "conversations")))
    read = finished(spark, lambda: chat.read_back(chat.format_trees(turns, "conv_id", "node", "parent", top=1)), "op12")
    return read.withColumnRenamed("tree", "conv_id")


def op13_vector_codes(spark, sf_dir):
    return finished(spark, lambda: codes.compress(table(spark, sf_dir, "embeddings")), "op13")


QUERIES = {
    "op1_embedding_near_dedup": op1_embedding_near_dedup,
    "op2_sharding": op2_sharding,
    "op3_sentence_spans": op3_sentence_spans,
    "op4_html_text": op4_html_text,
    "op5_suffix_array": op5_suffix_array,
    "op6_toxicity": op6_toxicity,
    "op7_simhash": op7_simhash,
    "op8_packing": op8_packing,
    "op9_language_model": op9_language_model,
    "op10_decontamination": op10_decontamination,
    "op11_filter_audit": op11_filter_audit,
    "op12_chat_formatting": op12_chat_formatting,
    "op13_vector_codes": op13_vector_codes,
}
ORACLE_SQL: dict[str, str] = {"op1_embedding_near_dedup": OP1_SQL, "op2_sharding": OP2_SQL, "op8_packing": packing.oracle_sql()}
ORACLE_SQL |= {"op11_filter_audit": audit.oracle_sql(), "op12_chat_formatting": chat.oracle_sql(), "op13_vector_codes": codes.oracle_sql()}
