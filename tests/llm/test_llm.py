"""The training-data operators against brute force on small inputs with nulls, copies and odd rows."""

import collections
import hashlib
import html
import itertools
import math
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from barloom.llm import decontaminate, embeddings, gru, html_text, lm, packing, queries, sharding, simhash, spans, suffixes, toxicity

DOC = "doc_id long, text string, node string, id int, h string"


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n)).capitalize() + "."


def corpus(seed=0, n=40):
    """Plain, copied, near-copied, shared-passage, empty, null, repeated and long documents."""
    rng = random.Random(seed)
    passage = " ".join(sentence(rng, 14) for _ in range(6))
    texts = [" ".join(sentence(rng, 12) for _ in range(rng.randint(1, 12))) for _ in range(n)]
    texts += [texts[0], texts[0], texts[1].replace(" ", "  ", 1)]
    texts += [sentence(rng, 9)[:-1] + " " + passage + " " + sentence(rng, 9) for _ in range(4)]
    texts += ["", None, "   ", "one", "a b", "é " * 30, "ab " * 400, texts[2] + " " + sentence(rng, 3)]
    rows = [(i, t) for i, t in enumerate(texts)]
    return [*rows, (0, texts[0]), (None, texts[3]), (None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in corpus()], DOC)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


def components(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


# Embeddings


def test_embeddings(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(60, 16))
    near = base[:20] + 0.15 * rng.normal(size=(20, 16))
    hub = rng.normal(size=16) + 0.02 * rng.normal(size=(50, 16))
    x = np.concatenate([base, near, hub, base[:3]]).astype(np.float32)
    rows = [(i, i % 2 if i < 80 else 0, [float(v) for v in r]) for i, r in enumerate(x)]
    odd = [(200, 0, None), (201, 0, []), (202, 0, [0.0] * 16), (203, 0, [float("nan")] * 16), (204, None, rows[0][2]), (205, 0, [None] * 16), (206, 0, [1.0, 2.0]), (207, 0, [2.0, 4.0]), (0, 0, rows[0][2])]
    df = spark.createDataFrame([(*r, 1) for r in rows + odd], "vec_id long, label int, embedding array<float>, node int")
    got = embeddings.near_duplicates(df, block=8).collect()
    assert len(got) == len(rows) + len(odd)
    full = rows + [odd[-1], odd[6], odd[7]]
    ok = lambda a, b: a[1] == b[1] and len(a[2]) == len(b[2]) and np.dot(a[2], b[2]) / np.linalg.norm(a[2]) / np.linalg.norm(b[2]) >= 0.93
    links = [(i, j) for i, a in enumerate(full) for j, b in enumerate(full[:i]) if ok(a, b)]
    count, root = collections.Counter(k for p in links for k in p), components(len(full), links)
    least = {}
    for i, r in enumerate(root):
        least[r] = min(least.get(r, 1 << 60), full[i][0])
    want = collections.Counter((full[i][0], count[i], least[root[i]]) for i in range(len(full)))
    want.update((r[0], 0, r[0]) for r in odd[:6])
    assert collections.Counter((r.vec_id, r.n_links, r.component_id) for r in got) == want
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_hadamard():
    x = np.random.default_rng(0).normal(size=(3, 8))
    np.testing.assert_allclose(embeddings.hadamard(embeddings.hadamard(x)), x)


def test_recall_at_the_threshold():
    rng = np.random.default_rng(1)
    a, r = rng.normal(size=(2, 2000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    r -= (r * a).sum(1, keepdims=True) * a
    r /= np.linalg.norm(r, axis=1, keepdims=True)
    b = 0.93 * a + math.sqrt(1 - 0.93**2) * r
    code = lambda x: embeddings.buckets(x, embeddings.TABLES, embeddings.HASHES, embeddings.PROBES)
    assert (embeddings._first_meeting(code(a), code(b))[0] >= 0).mean() > 0.99


# Sharding


def test_sharding(spark, docs, none, tmp_path):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/s", target_bytes=60_000, fanout=2, floor_bytes=512)
    for part in (docs.repartition(4), docs.limit(5), none, docs.repartition(3)):
        store.append(part)
    before = store.manifest()
    after = store.compact()
    assert after["version"] > before["version"] and len(after["shards"]) < len(before["shards"])
    assert not store.runs(after["shards"])
    key = lambda df: collections.Counter(map(tuple, df.collect()))
    whole = key(docs) + key(docs.limit(5)) + key(docs)
    assert key(store.read()) == whole == key(store.read(before["version"]))
    with pytest.raises(sharding.Conflict):
        store._commit(before, [], before["schema"])
    with pytest.raises(ValueError, match="other columns"):
        store.append(docs.drop("h"))
    assert store.vacuum() > 0 and key(store.read()) == whole and store.versions() == [after["version"]]
    store._write(docs)  # of a writer that failed before its commit
    assert store.vacuum() == 0 and store.vacuum(grace_s=-60) > 0 and key(store.read()) == whole


def test_sharding_with_two_writers(spark, docs, tmp_path):
    store, other = (sharding.ShardStore(spark, f"file://{tmp_path}/t", target_bytes=60_000, fanout=2, floor_bytes=512) for _ in range(2))
    for _ in range(3):
        store.append(docs.coalesce(1))
    commit, raced = store._commit, []

    def late(base, shards, schema):
        if not raced:  # the other writer is first
            raced.append(other.append(docs.limit(5)))
        return commit(base, shards, schema)

    store._commit = late
    store.append(docs.limit(3))
    assert len(raced) == 1 and store.read().count() == 3 * docs.count() + 8
    raced.clear()
    store.compact()
    assert len(raced) == 1 and store.read().count() == 3 * docs.count() + 13


# Sentence spans


def brute_sentences(text):
    """Words with their white space, and the first words of the sentences, by definition and not by windows."""
    found = re.findall(r"\S+\s*", text)
    ends = {i for i, w in enumerate(found) if w.rstrip()[-1] in ".!?" or "\n" in w}
    rank = [zlib.crc32(w.rstrip().lower().encode()) for w in found]
    more = set()
    for i in range(len(found) - 9):
        if not ends & set(range(i, i + 10)):
            more.add(min(range(i, i + 10), key=lambda j: (rank[j], -j)))
    return found, [0, *sorted(e + 1 for e in ends | more | ({len(found) - 1} if found else set()))]


def test_sentence_spans(docs, none):
    got = spans.remove_repeats(docs, counts=True).collect()
    assert len(got) == docs.count() and set(docs.columns) <= set(got[0].asDict())
    signed = lambda t: (xxhash.xxh64_intdigest(t.encode(), 42) + (1 << 63)) % (1 << 64)
    rows = sorted({(i, t or "") for i, t in corpus()}, key=lambda r: (r[0] is not None, r[0] or 0, signed(r[1])))
    seen, texts = {}, {}
    for i, t in rows:
        found, starts = brute_sentences(t)
        gone = set()
        for p in range(len(starts) - 1):
            e = next((e for e in range(p + 2, len(starts)) if starts[e] - starts[p] >= 14), None)
            words = e and tuple(w.rstrip().lower() for w in found[starts[p] : starts[e]])
            if words and seen.setdefault(words, (i, t, p)) != (i, t, p):
                gone |= set(range(p, e))
        left = "".join("".join(found[starts[p] : starts[p + 1]]) for p in range(len(starts) - 1) if p not in gone)
        texts[i, t] = t[: len(t) - len(t.lstrip())] + left if found else t
    want = collections.Counter((i, texts[i, t or ""]) for i, t in corpus())
    assert collections.Counter((r.doc_id, r.text) for r in got) == want
    shared = [r for r in got if r.doc_id is not None and 43 <= r.doc_id < 47]
    assert min(r.n_removed for r in shared) == 0 and sum(r.n_removed > 0 for r in shared) == 3
    assert spans.remove_repeats(none).count() == 0


def test_texts_are_parsed_side_by_side():
    """Texts parsed together give the sentences of each one alone."""
    rng = random.Random(5)
    texts = ["", " \n", "a", "\n\na b", "x" * 90 + " y" * 30, "Ünï \x1ccode " * 20, "a.\n b! c? D\n"]
    texts += ["".join(rng.choice("ab .!?\n\t\x0bA") * rng.randint(1, 3) for _ in range(rng.randint(0, 200))) for _ in range(300)]
    texts += [" ".join(rng.choice("abcdefgh") * rng.randint(1, 60) for _ in range(rng.randint(0, 80))) for _ in range(100)]
    parsed = spans._Parsed([t.encode() for t in texts])
    for t, a, z in zip(texts, parsed.of, parsed.of[1:]):
        words = [w.encode() for w in re.findall(r"[^ \t\n\r\x0b\x0c]+[ \t\n\r\x0b\x0c]*", t)]
        ends = {i for i, w in enumerate(words) if w.rstrip()[-1:] in b".!?" or b"\n" in w}
        rank = [zlib.crc32(w.rstrip().lower()) for w in words]
        windows = [range(i, i + 10) for i in range(len(words) - 9) if not ends & set(range(i, i + 10))]
        ends |= {min(w, key=lambda j: (rank[j], -j)) for w in windows} | ({len(words) - 1} if words else set())
        assert (parsed.starts[a : z + 1] - parsed.starts[a]).tolist() == [0, *(e + 1 for e in sorted(ends))]
        assert spans.sentences(t.encode())[0] == words


def test_equal_very_long_texts_lose_their_spans_but_for_the_first(spark):
    rng = random.Random(4)
    text = " ".join(sentence(rng, 12) for _ in range(20_000))
    rows = [(i, text if i else "short") for i in range(4)] + [(None, "a null id"), (None, "another")]
    got = spans.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    kept = sorted(len(r.text) for r in got if r.doc_id)
    assert kept[2] == len(text) and kept[1] < 120  # the words after the last span stay
    assert {r.text for r in got if not r.doc_id} == {"short", "a null id", "another"}


def test_every_repeated_run_of_51_words_holds_a_span():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))

    def keys(text):
        found, starts = spans.sentences(text.encode())
        ends = spans.span_ends(starts, spans.LEAST_SENTENCES, spans.LEAST_WORDS)
        return {b"".join(w.rstrip().lower() + b" " for w in found[starts[p] : starts[e]]) for p, e in enumerate(ends) if e < len(starts)}

    for n in range(500):
        few = [word() for _ in range(rng.choice([1, 3, 60]))]
        run = [rng.choice(few) if n % 3 else "|" + word() for _ in range(51)]
        a, b = (" ".join([word() for _ in range(rng.randint(0, 40))] + run + [word() for _ in range(rng.randint(1, 40))]) for _ in range(2))
        inside = " " + " ".join(run) + " "
        assert any(f" {k.decode()}" in inside for k in keys(a) & keys(b)), run


# HTML


def page(rng, i, article=True):
    body = "".join(f"<p>{sentence(rng, 8)} &amp; <b>x{i}</b>" for _ in range(3))
    nav = "<nav><ul><li>home<li>news</ul></nav><div class='cookie-notice'>we use cookies</div><!-- x -->"
    rest = "<div id=comments><p>first!</div><form>go</form><footer>&copy; site</footer><script>var a='</p>';</script>"
    shell = "<div>all rights of this fine site belong to us</div>"
    return f"<html><body>{nav}{shell}" + (f"<article><h1>T{i}</h1>{body}</article>" if article else f"<div>{body}</div>") + rest


def test_html(spark):
    rng = random.Random(3)
    rows = [(i, f"http://a.example/{i}", page(rng, i, i % 2 == 0)) for i in range(12)] + [(90, None, None), (91, "http://b.example/", ""), (92, "x", "plain &lt; text"), (93, "http://b.example/", "<p>cut <b")]
    got = {r.page_id: r for r in html_text.extract(spark.createDataFrame(rows + rows[:1], "page_id long, url string, html string")).dropDuplicates(["page_id"]).collect()}
    for i, _, h in rows[:12]:
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("<p>", re.search(r"(?:<article>|belong to us</div><div>)(.*?)(?:</article>|</div>)", h, re.S)[1])]
        blocks = [b for b in re.sub("</h1>", "\n", "\n".join(blocks)).split("\n") if b]
        assert got[i].text == "\n".join(blocks) and got[i].n_chars == len(got[i].text)
    split = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), group_bytes=1500)  # a hot host over several tasks
    assert {r.page_id: r.text for r in split.where("page_id < 12 AND page_id % 2 = 0").collect()} == {i: got[i].text for i in range(0, 12, 2)}
    assert got[90].text == got[91].text == "" and got[92].text == "plain < text"


def test_html_of_a_hot_host_does_not_depend_on_its_groups(spark):
    rng = random.Random(14)
    rows = []
    for i in range(40):
        notice = "<div>all rights of this fine site belong to us</div>" if i % 10 == 0 else ""
        rows.append((i, f"http://a.example/{i}", f"<html><body>{notice}<div><p>{sentence(rng, 30)}</div>"))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    whole, split = ({r.page_id: r.text for r in html_text.extract(df, group_bytes=n).collect()} for n in (1_000_000, 300))
    assert split == whole and not any("belong to us" in t for t in whole.values())


def test_suffix_array_of_tokens():
    t = np.array(random.Random(0).choices(range(3), k=200))
    order = html_text.suffix_array(t)
    assert order.tolist() == sorted(range(200), key=lambda i: t[i:].tolist())
    lcp = html_text.common_prefixes(t, order)
    assert all((t[a : a + k] == t[b : b + k]).all() for a, b, k in zip(order[1:], order, lcp[1:]))
    assert html_text.unique_runs([["a b c d e f x"], ["z a b c d e f"], ["a b"], ["a b c d e"]], 4) == [["x"], ["z"], ["a b"], [""]]


def test_what_is_main_text():
    text = lambda h: "\n".join(html_text.main_blocks([html_text.blocks(h)])[0])
    body = "<p>the body of this article is here and long enough</p>"
    plain = "the body of this article is here and long enough"
    for gone in (
        "<article class='comment'><p>me too</article>", "<article id='comment-3'>first</article>", "<section class='user-responses'><p>hm</section>", "<p style='display: none'>not seen</p>", "<div hidden>x</div>",
        "<div class='ad-slot'>buy</div>", "<div class='forum-comments'>hm</div>", "<ul class='share-links'><li>tell</ul>", "<div id=cookie-notice>ok</div>", "<aside>beside</aside>", "<form>go</form>", "<div class='sidebar left'>x</div>",
        "<div id='disqus_thread'>hm</div>", "<div class='discussion'><p>hm</div>", "<ul id='discussions'><li>hm</ul>", "<div class='promo-card'>buy</div>",
    ):
        assert text(f"<main>{body}{gone}</main>") == plain, gone
    for stays in ("<section class='related-work'><p>earlier</section>", "<p class='share-price'>9</p>", "<div class='content has-sidebar'>all of it</div>", "<section id='discussion'><p>what it means</section>", "<div class='thread'>a question</div>"):
        assert text(f"<main>{body}{stays}</main>") == plain + "\n" + re.sub("<[^>]*>", "", stays), stays
    assert text(f"<article class='teaser'>a teaser</article><div>{body * 2}</div>") == f"a teaser\n{plain}\n{plain}"
    assert text(f"<article>{body}</article><div>some words that are outside</div>") == plain


def brute_main(pages, least=5):
    """Windows counted over all distinct pages of a host, without a suffix array."""
    cut = [html_text.blocks(h) for h in pages]
    grams = lambda x: [tuple(x.split(" ")[i : i + least]) for i in range(len(x.split(" ")) - least + 1)]
    loose = collections.Counter()
    for c in {tuple(x for x, i in c if not i) for c in cut}:
        loose.update({g for x in c for g in grams(x)})
    n = lambda xs: sum(len(x.split()) for x in xs)
    out = []
    for c in cut:
        kept = []
        for x, inside in c:
            hit = {k + j for k, g in enumerate(grams(x)) if loose[g] > 1 for j in range(least)}
            kept.append((x if inside else " ".join(v for k, v in enumerate(x.split(" ")) if k not in hit), inside))
        whole = not any(i for _, i in c) or n([x for x, i in kept if not i]) > 3 * n([x for x, i in kept if i])
        out.append("\n".join(x for x, i in kept if x and (i or whole)))
    return out


def test_html_against_brute_force(spark):
    rng = random.Random(33)
    lines = [sentence(rng, rng.randint(2, 14)) for _ in range(12)]
    pages = []
    for i in range(60):
        own = lambda n: "".join(f"<p>{sentence(rng, rng.randint(3, 20))}</p>" for _ in range(n))
        some = lambda n: "".join(f"<p>{x}</p>" for x in rng.sample(lines, n))
        shape = rng.choice(["<article>{a}{b}</article><div>{c}</div>", "<div>{b}{a}{c}</div>", "<article>{b}</article><div>{a}</div>", "<main>{a}{b}<article class=comment>{c}</article></main>"])
        pages.append("<html><body>" + shape.format(a=own(rng.randint(1, 4)), b=some(rng.randint(0, 3)), c=some(2)))
    pages += pages[:5]
    df = spark.createDataFrame([(i, "http://one.example/", h) for i, h in enumerate(pages)], "page_id long, url string, html string")
    want = dict(enumerate(brute_main(pages)))
    for group_bytes in (10_000_000, 2_000):
        assert {r.page_id: r.text for r in html_text.extract(df, group_bytes=group_bytes).collect()} == want
    empty = html_text.extract(df.limit(0).withColumn("host", F.lit("clash")))
    assert empty.count() == 0 and empty.columns == ["page_id", "url", "text", "n_chars"]


# Suffix arrays


def brute_cover(texts, length):
    seen = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        mark = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                mark[i : i + length] = b"\1" * length
        out.append(mark)
    return out


@pytest.mark.parametrize("most", [50_000, 2])
def test_suffixes(docs, none, most):
    texts = [(t or "").encode() for _, t in corpus()]
    want = collections.Counter()
    for (i, _), t, m in zip(corpus(), texts, brute_cover(texts, 60)):
        kept = bytes(b for b, c in zip(t, m) if not c)
        want[i, len(t), sum(m), len(re.findall(b"\1+", bytes(m))), hashlib.sha256(kept).hexdigest(), kept] += 1
    got = suffixes.remove_repeats(docs, length=60, gram=16, most=most)
    assert collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in got.collect()) == want
    assert suffixes.remove_repeats(none).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="test data not present")
def test_suffix_query_against_brute_force(spark):
    rows = [(r.doc_id, (r.text or "").encode()) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    want = {}
    for (i, t), m in zip(rows, brute_cover([t for _, t in rows], 400)):
        kept = bytes(b for b, c in zip(t, m) if not c)
        want[i] = (len(t), sum(m), len(re.findall(b"\1+", bytes(m))), hashlib.sha256(kept).hexdigest(), kept.decode(errors="replace"))
    assert sum(w[1] for w in want.values()) > 0
    got = queries.op5_suffix_array(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(rows) and all((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id][:4] for r in got)
    assert all(r.text.replace("\ufffd", "") == want[r.doc_id][4].replace("\ufffd", "") for r in got)


def test_frequent_windows_stay_where_they_lie(spark):
    """One window in 4,000 rows over 8 partitions, 1,000 pairs and 1,000 single ones: no task gets a digest's rows."""
    rows = spark.range(0, 7000, 1, 8).select((F.col("id") % 50).alias("k1"), F.lit(1).cast("long").alias("k2"), F.col("id").cast("int").alias("s"), F.when(F.col("id") % 7 < 4, -1).when(F.col("id") % 7 == 6, F.col("id")).otherwise(F.expr("id div 7 + 100000")).alias("d1"), F.lit(0).cast("long").alias("d2"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = suffixes.shared_windows(rows, 100).select("s", "d1", F.spark_partition_id().alias("task")).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sorted(r.s for r in got) == [i for i in range(7000) if i % 7 < 6]
    tasks = collections.Counter(r.task for r in got if r.d1 == -1)
    assert len(tasks) == 8 and max(tasks.values()) < 600


def test_deep_shallow():
    rng = random.Random(1)
    s = [bytes(rng.choices(b"ab", k=rng.randint(0, 60))) for _ in range(200)]
    s += [b"x" * 100 + t for t in s] + s[:20]
    assert [s[i] for i in suffixes.deep_shallow(s, 0, 8)] == sorted(s)
    assert [s[i] for i in suffixes.blind_trie(s, list(range(len(s))))] == sorted(s)


# Toxicity


def test_toxicity(spark, none):
    rng = random.Random(5)
    bad = ["idiotus", "vilesome", "scumling"]
    rows = [(i, " ".join(sentence(rng, 20).split() + (rng.choices(bad, k=rng.randint(1, 4)) if i % 4 == 0 else [])), int(i % 4 == 0)) for i in range(600)]
    df = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(None, None), (900, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows[:300]] + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.train(df, labels)
    assert list(model.thresholds) == sorted(model.thresholds)
    out = {r.doc_id: r for r in toxicity.score(df, model).collect()}
    held = [(out[i].toxic, bool(y)) for i, _, y in rows[300:]]
    assert np.mean([a == b for a, b in held]) > 0.97
    assert abs(out[0].p_clean + out[0].p_mild + out[0].p_moderate + out[0].p_severe - 1) < 1e-9
    assert out[900].toxic is False and out[None].toxic is False and out[0].expected_severity > out[1].expected_severity
    kept = toxicity.drop_toxic(df, model)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, r in out.items() if not r.toxic}
    empty = toxicity.train(df, labels.limit(0))
    assert toxicity.score(df, empty).where("toxic").count() == 0 and toxicity.score(none, model).count() == 0


# SimHash


def brute_fingerprint(t, n=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + n]).encode(), 42) for i in range(max(1, len(w) - n + 1))] if w else []
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_simhash(docs, none):
    rows = corpus()
    fps = [brute_fingerprint(t) for _, t in rows]
    root = components(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2])
    least = {}
    for (i, _), r in zip(rows, root):
        least[r] = min([x for x in (least.get(r), i) if x is not None], default=None)
    want = collections.Counter((i, f, least[r]) for (i, _), f, r in zip(rows, fps, root))
    got = simhash.simhash_components(docs).collect()
    assert collections.Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got) == want
    assert simhash.simhash_components(none).count() == 0


def test_linked_fingerprints(spark):
    rng = random.Random(2)
    f = [rng.getrandbits(64) for _ in range(30)]
    f += [x ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for x in f] + [x ^ 7 for x in f]
    f = list({x - (1 << 64) if x >> 63 else x for x in f})
    want = {(min(a, b), max(a, b)) for i, a in enumerate(f) for b in f[:i] if ((a ^ b) % (1 << 64)).bit_count() <= 2}
    assert {(r.u, r.v) for r in simhash.linked_fingerprints(spark.createDataFrame([(x,) for x in f], "fp long")).collect()} == want


def test_near_duplicates(spark, docs, none):
    rng = random.Random(9)
    base = [[f"w{rng.randrange(5000)}" for _ in range(200)] for _ in range(30)]
    texts = [" ".join(b) for b in base]
    for b in base[:10]:
        c = list(b)
        for k in rng.sample(range(200), 2):
            c[k] = "changed"
        texts.append(" ".join(c))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in simhash.drop_near_duplicates(df).collect()} == set(range(30))
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and kept.where("doc_id IS NULL").count() == 2 and kept.where("doc_id IN (40, 41, 42)").count() == 0
    assert simhash.drop_near_duplicates(none).count() == 0


def shingle_set(t, n=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else {"", t or ""}


def brute_kept(rows, similarity=0.8):
    """Rows (id, text) that stay: one document, that of the smallest id, of each group."""
    docs = sorted({(i, t or "") for i, t in rows if i is not None})
    sets = [shingle_set(t) for _, t in docs]
    links = [(a, b) for a in range(len(docs)) for b in range(a) if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]) - 1e-9]
    first = {docs[k] for k, r in enumerate(components(len(docs), links)) if r == k}
    return collections.Counter((i, t) for i, t in rows if i is None or (i, t or "") in first)


def kept_rows(df):
    return collections.Counter((r.doc_id, r.text) for r in simhash.drop_near_duplicates(df).select("doc_id", "text").collect())


def test_near_duplicates_with_repeated_ids_and_blank_texts(spark, docs):
    rows = [(3, "X"), (5, "a text of its own"), (5, "X"), (6, "\t"), (7, "\n\n"), (8, "\t\t\n"), (9, "\t"), (9, "\t"), (10, None), (11, ""), (None, "X"), (None, None)]
    assert kept_rows(spark.createDataFrame(rows, "doc_id long, text string")) == brute_kept(rows)
    assert kept_rows(docs) == brute_kept(corpus())


def test_near_duplicates_find_every_pair(spark):
    """All similarities from 0.6 up, close to 0.8 above all, against brute force."""
    rng = random.Random(21)
    rows = []
    for _ in range(60):
        n = rng.choice([1, 4, 5, 7, 12, 40, 150])
        base = [f"w{rng.randrange(400)}" for _ in range(n)]
        rows.append(base)
        for _ in range(rng.randint(1, 5)):
            c = list(base)
            for _ in range(rng.randint(0, 1 + n // 25)):
                k = rng.randrange(len(c) + 1)
                c[k : k + rng.randint(0, 1)] = [f"w{rng.randrange(400)}"] * rng.randint(0, 3)
            rows.append(c)
    rows = [(i, " ".join(w)) for i, w in enumerate(rows)]
    assert kept_rows(spark.createDataFrame(rows, "doc_id long, text string")) == brute_kept(rows)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="test data not present")
def test_near_duplicates_of_the_test_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    assert kept_rows(df) == brute_kept(rows)


def test_near_duplicates_inside_a_template_family(spark):
    rng = random.Random(12)
    rows = []
    for i in range(1500):
        w = [f"t{k}" for k in range(300)]
        for k in rng.sample(range(300), 7):
            w[k] = f"own{i}x{k}"
        rows.append(w)
    for w in rows[-300:]:
        c = list(w)
        for k in rng.sample(range(300), 2):
            c[k] = f"late{len(rows)}x{k}"
        rows.append(c)
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string")
    assert {r.doc_id for r in simhash.drop_near_duplicates(df).collect()} == set(range(1500))


def test_long_texts_that_share_a_passage_are_not_read_again(spark):
    """Pairs of long texts that meet in a passage but are far apart go by their maps; similar ones of any size stay."""
    rng = random.Random(31)
    passage = [f"p{k}" for k in range(60)]
    rows = [passage + [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([2500, 4000, 4700]))] for _ in range(16)]
    for n, edits in ((700, 9), (820, 15), (820, 40), (1500, 20), (2600, 54), (2600, 60), (4000, 70), (4100, 120)):
        base = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        changed = list(base)
        for k in rng.sample(range(n), edits):
            changed[k] = f"x{rng.randrange(10**6)}"
        rows += [base, changed, base[: int(n * 0.83)]]
    rows = [(i, " ".join(w)) for i, w in enumerate(rows)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert kept_rows(df) == brute_kept(rows)
    sets = [np.unique(simhash.shingle_hashes(t.encode(), 5)) for _, t in rows]
    maps = [simhash.wide_parity(x) for x in sets]
    assert [m is None for m in maps] == [len(x) <= simhash.WIDE for x in sets]
    for (a, x), (b, y) in itertools.combinations(zip(maps, sets), 2):
        assert a is None or b is None or simhash.wide_apart(a, b) <= len(np.setxor1d(x, y))
    none = np.empty(0, np.int64)
    nodes = simhash._sets(df, none, none, "doc_id", "text", 5, 0.8).cache()
    met = nodes.alias("a").join(nodes.alias("b"), F.expr("a.node < b.node")).select(F.col("a.node").alias("u"), F.col("b.node").alias("v"))
    near = simhash._Verifier(df, nodes, "doc_id", "text", 5, 0.8)._may_reach(met)
    of = {r.node: r.id for r in nodes.collect()}
    near = {tuple(sorted((of[r.u], of[r.v]))) for r in near.collect()}
    similar = {(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))}
    assert similar and similar <= near and not any(i < 16 for i, _ in near)


def test_near_duplicates_that_differ_in_repeats(spark):
    rng = random.Random(13)
    rows = []
    for _ in range(20):
        base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
        line = [f"w{rng.randrange(10**6)}" for _ in range(15)]
        rows += [base + line, base + 11 * line]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string")
    assert {r.doc_id for r in simhash.drop_near_duplicates(df).collect()} == set(range(0, 40, 2))


# Packing


def test_boundaries_are_optimal():
    import itertools

    rng = random.Random(4)
    for _ in range(20):
        lengths = sorted(rng.sample(range(60), 8))
        counts = [rng.randint(1, 9) for _ in lengths]
        pad = lambda cuts: sum(c * (min(b for b in cuts if b >= x) - x) for x, c in zip(lengths, counts))  # noqa: E731, B023
        best = min(pad((*c, lengths[-1])) for k in range(3) for c in itertools.combinations(lengths[:-1], k))
        assert pad(packing.boundaries(lengths, counts, 3)) == best


def test_boundaries_of_many_lengths(spark):
    rng = np.random.default_rng(5)
    lengths = np.unique(rng.integers(0, 40_000, 12_000))
    counts = rng.integers(1, 50, len(lengths))
    below = np.concatenate([[0], np.cumsum(counts)])
    # two buckets by trying every boundary
    total = lengths * below[1:] + lengths[-1] * (below[-1] - below[1:])
    rows = spark.createDataFrame([(int(x), int(c)) for x, c in zip(lengths, counts)], "n_tokens long, c long")
    rows = rows.select(F.explode(F.array_repeat("n_tokens", F.col("c").cast("int"))).alias("n_tokens"))
    assert packing.plan_buckets(rows, 2) == ([int(lengths[total.argmin()]), int(lengths[-1])], int(below[-1]))


def test_boundaries_against_every_start():
    rng = random.Random(6)
    for _ in range(50):
        lengths = sorted(rng.sample(range(200), 40))
        counts = [rng.randint(1, 3) for _ in lengths]
        below = [sum(counts[:k]) for k in range(41)]
        best, steps = [x * below[j + 1] for j, x in enumerate(lengths)], []
        for _ in range(4):
            new = [min([(best[j], 0), *((best[i] + lengths[j] * (below[j + 1] - below[i + 1]), i + 1) for i in range(j))]) for j in range(40)]
            best, steps = [v for v, _ in new], [*steps, [p for _, p in new]]
        ends, j = [], 40
        for start in reversed(steps):
            ends, j = [lengths[j - 1], *ends], start[j - 1]
            if not j:
                break
        else:
            ends = [lengths[j - 1], *ends]
        assert packing.boundaries(lengths, counts, 5) == ends


def test_packing(docs, none):
    got = packing.pack(docs, budget=256, chunk_rows=10).collect()
    assert len(got) == docs.count()
    batches = collections.Counter((r.bucket_len, r.batch) for r in got)
    for (bucket, batch), n in batches.items():
        room = max(1, 256 // max(bucket, 1))
        last = max(b for k, b in batches if k == bucket)
        assert n == room or batch == last and n < room
    assert all(0 <= r.padding == r.bucket_len - r.n_tokens for r in got)
    assert packing.pack(none).count() == 0


# Language model


def test_gru_gradient():
    rng = np.random.default_rng(0)
    m = {k: a.astype(np.float64) for k, a in gru.init(np.ones(8), 4, 2).items()}
    texts = [rng.integers(0, 8, n) for n in (5, 3)]
    gru_f, gru._F = gru._F, np.float64
    try:
        grads = {}

        class Spy:
            def update(self, g):
                grads.update({k: a * 8 for k, a in g.items()})

        gru.train(m, texts, Spy(), window=8)
        for k in m:
            i = tuple(rng.integers(0, s) for s in m[k].shape)
            old, e = m[k][i], 1e-5
            m[k][i] = old + e
            up = gru.score(m, texts).sum()
            m[k][i] = old - e
            down = gru.score(m, texts).sum()
            m[k][i] = old
            assert abs(grads[k][i] + (up - down) / (2 * e)) < 1e-4
    finally:
        gru._F = gru_f


def test_state_is_carried_across_windows():
    m = gru.init(np.ones(8), 4, 2)
    texts = [np.random.default_rng(i).integers(0, 8, n) for i, n in enumerate((40, 7, 1))]
    np.testing.assert_allclose(gru.score(m, texts, window=8), gru.score(m, texts, window=100), rtol=1e-6)
    np.testing.assert_allclose(gru.score(m, texts, batch=1), gru.score(m, texts), rtol=1e-6)
    np.testing.assert_allclose([gru.score(m, [t])[0] for t in texts], gru.score(m, texts, batch=2), rtol=1e-6)
    assert len(gru.score(m, [])) == 0


@pytest.mark.parametrize("scale", [1, 300])
def test_model_is_a_distribution(scale):
    m = gru.init(np.arange(1, 9), 4, 2)
    m["C"] *= scale
    m["W"] *= scale
    start = np.array([3, 5, 2])
    before = gru.score(m, [start])[0]
    after = gru.score(m, [np.append(start, t) for t in range(8)])
    assert np.isclose(np.exp(after - before).sum(), 1, atol=1e-4)


def test_lanes():
    texts = [np.full(n, n) for n in (9, 2, 3, 1, 4)]
    lanes = gru._Lanes(texts, 2)
    assert sorted(lanes.length) == [9, 10]
    seen = np.concatenate([at for w in lanes.windows(4) for at in w])
    assert sorted(seen) == list(range(19))
    assert lanes.per_text(np.ones(19)).tolist() == [9, 2, 3, 1, 4]
    assert (lanes.x[lanes.fresh] == gru.END).all() and lanes.fresh.sum() == 5


def test_vocabulary_reads_as_the_head_does():
    head = lm.Head([("a", 5), ("b", 4), ("c", 3), ("\n", 2)], 20, 9, 4)
    for words in ([], [b"a", b"c", b"zz", b"b"]):
        assert head.read(words).tolist() == head.slots(head.ids(words)).tolist()


def test_words_of_all_texts_at_once():
    texts = ["  A b\x0b\x0c Éc\x1cd\u2003e \r", "", None, " \t", "B b\nb"]
    words, lens = lm.words_of(pa.array(["skipped", *texts]).slice(1))
    split = [(t or "").encode().lower().split() for t in texts]
    assert lens.tolist() == [len(w) for w in split]
    assert [w.encode() for w in words.to_pylist()] == [w for ws in split for w in ws]
    tokens = [w for ws in split for w in [*ws, b"\n"]]
    assert [[*words.to_pylist(), "\n"][i].encode() for i in lm.with_ends(lens)] == tokens
    rare, times = lm._rare(pa.array(["b", "a", "b", "a"]), np.array([1, 1, 1, 3]), 4)
    assert [dict(zip(*x)) for x in zip(rare.to_pylist(), times.to_pylist())] == [{}, {"b": 2, "a": 1}, {}, {"a": 1}]


def test_gradient_sums_by_token():
    rng = np.random.default_rng(0)
    keys = np.concatenate([np.zeros(500, np.int64), rng.integers(0, 90, 900), np.full(gru._MANY, 95)])
    rows, want = rng.normal(size=(len(keys), 6)), np.zeros((100, 6))
    np.add.at(want, keys, rows)
    np.testing.assert_allclose(gru._sums(rows, keys, 100), want, atol=1e-9)
    assert not gru._sums(rows[:0], keys[:0], 100).any()


@pytest.mark.parametrize("head", [150_000, 20])
def test_language_model(docs, none, head):
    rows = [(i, (t or "").lower().encode().split() + [b"\n"]) for i, t in corpus()]
    out = lambda i: i is None or zlib.crc32(str(i).encode()) % 10 == 0
    c = collections.Counter(w for i, ws in rows if not out(i) for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), out(i), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 6)) for i, ws in rows)
    got = lm.score(docs, head_size=head, vocabulary=16, hidden=4, classes=4).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert lm.score(none).count() == 0


def test_language_model_learns_the_order_of_words(spark):
    """Words that come round in a fixed order: the counts say nothing of it, the model must."""
    rows = [(i, " ".join("abcdefgh"[(i + k) % 8] for k in range(40 + i % 17))) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = lm.score(df, vocabulary=16, hidden=16, classes=4, rounds=((1, 0.02),) * 10).where("held_out").agg(F.sum("base_score"), F.sum("score"), F.sum("n_tokens")).first()
    assert out[1] / out[2] > 0.4 * out[0] / out[2]


def test_language_model_reads_a_very_long_text_whole(spark):
    text = " ".join(f"w{k % 700}" for k in range(300_000))
    out = {r.doc_id: r for r in lm.score(spark.createDataFrame([(1, text), (2, "w1 w2")], "doc_id long, text string")).collect()}
    assert out[1].n_tokens == 300_001 and math.isfinite(out[1].score)


# Decontamination


def test_decontamination(spark, docs, none):
    rng = random.Random(7)
    item = " ".join(f"word{rng.randrange(500)}" for _ in range(30))
    other = " ".join(f"other{rng.randrange(500)}" for _ in range(24))
    w = item.split()
    cases = {
        0: f"before it {item} after", 1: item.upper().replace(" ", ", "), 2: " ".join(w[:29] + ["changed"]), 3: " ".join(w[:15] + ["odd"] + w[16:]), 4: " ".join(w[:20]), 5: f"{other} x {item}", 6: "", 7: None, 8: "a b c", 9: item + " " + item,
    }
    df = spark.createDataFrame([(i, t, 1) for i, t in cases.items()] + [(0, cases[0], 1), (None, cases[0], 1)], "doc_id long, text string, item int")
    bench = spark.createDataFrame([(7, item), (8, other), (9, "too short"), (10, None), (11, item)], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.report(df, bench).collect()}
    hit = {0: [7, 11], 1: [7, 11], 2: [7, 11], 5: [7, 8, 11], 9: [7, 11], None: [7, 11]}
    assert {i: r["items"] for i, r in got.items() if r.contaminated} == hit and decontaminate.report(df, bench).count() == 12
    assert abs(got[2].best_similarity - 25 / 26) < 1e-9 and got[0].best_similarity == 1
    kept = decontaminate.drop_contaminated(df, bench)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {3, 4, 6, 7, 8}
    assert decontaminate.report(none, bench).count() == 0 and decontaminate.report(df, bench.limit(0)).where("contaminated").count() == 0


def test_decontamination_against_brute_force(spark):
    """Every window of every document against every item, without fingerprints."""
    rng = random.Random(17)
    items = [[f"w{rng.randrange(60)}" for _ in range(rng.choice([5, 9, 16, 30, 30, 45]))] for _ in range(12)] + [["same"] * 20]
    docs = [[f"w{rng.randrange(60)}" for _ in range(rng.randrange(80))] for _ in range(40)] + [["same"] * 150, ["same"] * 23 + ["end"], ["same"] * 21]
    for w in docs[:30]:
        part = list(rng.choice(items))
        for _ in range(rng.choice([0, 1, 1, 2])):
            k = rng.choice([0, 1, len(part) // 2, len(part) - 2, len(part) - 1])
            part[k : k + 1] = [f"w{rng.randrange(60)}"] * rng.randrange(3) or ["cut"]
        at = rng.randrange(len(w) + 1)
        w[at:at] = part
    grams = lambda w: [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    want = {}
    for i, d in enumerate(map(grams, docs)):
        for k, item in enumerate(map(grams, items)):
            for s in range(1 - len(item), len(d)):
                x = collections.Counter(d[max(0, s) : max(0, s + len(item))])
                both = (x & collections.Counter(item)).total()
                if both / (x.total() + len(item) - both) >= 0.8:
                    want.setdefault(i, {})[k] = max(want.get(i, {}).get(k, 0), both / (x.total() + len(item) - both))
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.report(df, bench).where("contaminated").collect()}
    assert len(want) > 15 and {i: r["items"] for i, r in got.items()} == {i: sorted(w) for i, w in want.items()}
    assert all(abs(r.best_similarity - max(want[i].values())) < 1e-9 for i, r in got.items())


# Pipeline and registration


def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    df = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = df.columns, df.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        df = stage(spark, df, sf)
        assert df.columns == columns and before * 0.5 < df.count() <= before, name
    packed = corpus_pipeline.run(spark, sf)
    assert packed.count() == df.count() and {r.doc_id for r in packed.collect()} == {r.doc_id for r in df.collect()}


def test_queries_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
