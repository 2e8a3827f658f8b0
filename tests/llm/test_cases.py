"""Nulls, empty tables, long texts, repeated rows and clashing names; and whole results against brute force."""

from __future__ import annotations

import random
import struct

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wxlake.llm import bpe, chat, common, fingerprints, langid, mih, neardup, packing, pii, queries, toxicity, url_filter

from test_operators import brute_components, docs_of, prose

PATH = public_tokenizers.path("word_bpe_49k.json")
CLASH = {"score": "s", "lang_pred": 1, "predicted": "p", "positive": 2, "spans": "x", "found": 3, "row": 4, "n": 5, "key": 6, "lang": "en"}


def edited(base, changes, r):
    words = base.split()
    for _ in range(changes):
        words[r.randrange(len(words))] = f"new{r.randrange(10**6)}"
    return " ".join(words)


# --- near duplicates


@pytest.mark.parametrize("limits", [{"table_rows": 1, "pivots": 1}, {"table_rows": 4, "pivots": 2}, {}])
def test_large_groups_are_split_and_lose_no_link(spark, limits):
    r = random.Random(8)
    texts = [edited(base, r.randrange(0, 9), r) for base in prose(3, 21, 120) for _ in range(60)] + prose(20, 22)
    got = neardup.near_duplicates(docs_of(spark, texts), k=4, **limits).collect()
    assert sorted(tuple(x) for x in got) == brute_components(texts, 4)


def test_recall_over_random_pairs(spark):
    """Pairs just above the threshold, each of a text of its own."""
    r = random.Random(9)
    bases = prose(150, 23, 100)
    texts = [t for b in bases for t in (b, edited(b, 2, r))]
    want = [x[2] for x in brute_components(texts, 5)]
    got = [x.component_id for x in sorted(neardup.near_duplicates(docs_of(spark, texts)).collect())]
    linked = [i for i in range(1, len(texts), 2) if want[i] == i - 1]
    assert len(linked) > 60 and sum(got[i] == i - 1 for i in linked) >= 0.98 * len(linked)
    assert all(g == w for g, w in zip(got, want, strict=True) if w == g or g < w)


def test_rows_are_deduplicated_one_by_one(spark):
    a, b = prose(2, 31)
    rows = [(1, a), (1, a), (None, a), (None, b), (None, b), (2, "other words"), (2, a), (3, None), (3, None), (None, None), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit("clash"))
    kept = neardup.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted((x.text or "") for x in kept.collect()) == sorted(["", "", "", "", a, b, "other words"])
    unique = docs_of(spark, [a, b, a, None, ""], lang="x")
    assert sorted(x.doc_id for x in neardup.deduplicated(unique).collect()) == [0, 1, 3, 4]
    assert neardup.deduplicated(unique.limit(0)).count() == 0


# --- fingerprints


def plain_fingerprint(text, k, words):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    w = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in low.split(" ") if x]
    out = set()
    for i in range(max(1, len(w) - words + 1) if w else 0):
        h = 42
        for x in w[i : i + words]:
            h = xxhash.xxh64_intdigest(struct.pack("<Q", x), seed=h)
        out.add(h >> 2)
    return sorted(out)[:k]


def test_fingerprints_equal_brute_force(spark):
    k, words = 16, 5
    texts = ["", None, "one", "A b\tc D e f", *prose(12, 3, 80), " ".join(prose(1, 4, 60_000))]
    rows = {r.doc_id: r for r in fingerprints.edited_pairs(docs_of(spark, texts), k=k, words=words, rows=4).collect()}
    for i, text in enumerate(texts):
        text, after = text or "", texts[(i - 1) % len(texts)] or ""
        n = len(text) // 3
        own, changed, other = (plain_fingerprint(t, k, words) for t in (text, text[: len(text) - n] + after[:n], after))

        def likeness(a, b):
            both = sorted({*a, *b})[:k]
            return sum(h in a and h in b for h in both) / len(both) if both else 1.0

        assert rows[i].fingerprint == "".join(f"{h:016x}" for h in own)
        assert rows[i].edited_fingerprint == "".join(f"{h:016x}" for h in changed)
        assert rows[i].near_edited == pytest.approx(likeness(own, changed)) and rows[i].near_next == pytest.approx(likeness(own, other))


def test_many_ranges_keep_the_order(spark):
    r = random.Random(2)
    ids = r.sample(range(-5000, 5000), 400) + [7, 7, None, None]
    docs = spark.createDataFrame([(i, f"text {i} {n}") for n, i in enumerate(ids)], "doc_id long, text string")
    got = fingerprints._bucketed(docs, 20).collect()
    got.sort(key=lambda x: (x.doc_id is None, -(x.doc_id or 0)))
    assert [x.bucket for x in got] == sorted(x.bucket for x in got) and len({x.bucket for x in got}) > 15
    assert fingerprints.edited_pairs(docs, rows=20).count() == len(ids)


# --- URLs


def test_long_urls_cost_no_more(spark):
    rules = [("net", "/", "block"), ("a.b.net", "/x/", "allow"), ("b.net", None, "block")]
    urls = ["http://" + "." * 200_000 + "net/" + "y" * 200_000, "http://" + "a." * 100_000 + "b.net/x/1", "http://q.b.net/x/", "http://.net/", "http://net./"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge(pages, url_filter.build(table)).collect()}
    assert got == {0: ("net/", "block"), 1: ("a.b.net/x/", "allow"), 2: ("b.net", "block"), 3: ("net/", "block"), 4: (None, "allow")}
    assert {r.page_id: (r.rule, r.verdict) for r in url_filter.join_judge(pages, table).collect()} == got
    assert url_filter.judge(pages.limit(0), url_filter.build(table)).count() == 0


# --- tokens


def test_joins_grow_until_they_agree():
    own, codec = Tokenizer.from_file(PATH), bpe.Codec(PATH)
    r = random.Random(1)
    texts = [" ".join(r.choice("storm's the night it's river éclair 12.5 wind, cold".split()) + str(r.randrange(99)) for _ in range(600)) for _ in range(4)] + ["", "a", " x ", "x" * 5000 + " y"]
    true, narrow = codec.words.ids, []

    def bent(given):
        """Windows of a few words get other ids at their edges."""
        out = true(given)
        for i, t in enumerate(given):
            if 2 <= len(t.split()) <= 5:
                narrow.append(t)
                out[i] = [1, *out[i][1:-1], 2]
        return out

    codec.words.ids = bent
    raw, offsets = common.text_bytes(pa.array(texts))
    got = [[int(x) for p in parts for x in p.said.split()] for parts in codec.encode(texts, raw, offsets)]
    assert got == [own.encode(t, add_special_tokens=False).ids for t in texts] and len(narrow) > 20


# --- toxicity


def test_nnpu_lowers_the_plain_risk():
    r = np.random.default_rng(3)
    n, features, prior = 400, 6, 0.2
    toxic = r.random(n) < prior
    x = np.where(r.random((n, features)) < np.where(toxic[:, None], 0.6, 0.2) * (np.arange(features) < 3) + 0.1, 1.0, 0.0)
    positive, unlabelled = toxic & (r.random(n) < 0.5), np.ones(n, bool)

    def risk(w, b):
        g = x @ w + b
        plus, minus = np.log1p(np.exp(-g)), np.log1p(np.exp(g))
        return prior * plus[positive].mean() + max(0.0, minus[unlabelled].mean() - prior * minus[positive].mean())

    text, feature = np.nonzero(x)
    w, b = toxicity.nnpu(text, feature, x[text, feature], positive, unlabelled, prior, features, epochs=400, batches=1, decay=0.0)
    start = np.zeros(features)
    best = risk(w, b)
    assert best < risk(start, np.log(prior / (1 - prior))) - 0.02
    # No small step in any direction does better by much: it is near a minimum of the plain formula.
    steps = [(w + d, b + e) for d, e in ((r.normal(0, 0.3, features), r.normal(0, 0.3)) for _ in range(300))]
    assert min(risk(*s) for s in steps) > best - 0.01


# --- every operator on nothing, on clashing columns and on a long text


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string, n_chars long")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    found, model = pii.personal_data(none)
    assert found.count() == 0 and pii.mask(none, model).count() == 0
    assert langid.fit(none) is None and langid.identify(none, None).count() == 0 and langid.known_language(none, None).count() == 0
    assert bpe.encode(none, PATH).count() == 0 and bpe.digests(none, PATH).count() == 0
    assert toxicity.fit(none, labels) is None and toxicity.score(none, None).count() == 0 and toxicity.not_toxic(none, None).count() == 0
    nodes = spark.createDataFrame([], "conv_id long, node long, parent long, role string, text string, score double")
    assert chat.read_back(chat.formatted(nodes)).count() == 0
    codes = spark.createDataFrame([], "id long, code long")
    assert mih.search(codes, codes).count() == 0


def test_without_labels_documents_stay(spark):
    docs = spark.createDataFrame([(1, "some words", None), (2, "12", None), (3, None, None)], "doc_id long, text string, lang string")
    assert langid.fit(docs) is None
    assert [r.doc_id for r in langid.known_language(docs, None).collect()] == [1]


def test_clashing_columns_and_long_texts(spark):
    long = " ".join(prose(1, 40, 150_000))
    texts = [*prose(40, 41), long, None, "", "mail me at a.b@example.com"]
    docs = docs_of(spark, texts, **CLASH)
    model = langid.fit(docs)
    assert {r.doc_id: r.lang_pred for r in langid.identify(docs, model).collect()}[40] == "en"
    assert langid.known_language(docs, model).columns == docs.columns
    labels = spark.createDataFrame([(i, 0, int(i % 5 == 0)) for i in range(40)], "doc_id long, quality int, toxic int").withColumns({"text": F.lit("t"), "positive": F.lit(1)})
    scorer = toxicity.fit(docs, labels)
    assert toxicity.score(docs, scorer).count() == len(texts) and toxicity.not_toxic(docs, scorer).columns == docs.columns
    found, spans = pii.personal_data(docs)
    assert {r.doc_id: r.n_email for r in found.collect()}[43] == 1 and pii.mask(docs, spans).columns == docs.columns
    rows = spark.createDataFrame([(i, i * 7, "x", 1) for i in range(30)], "id long, code long, query_id string, distance int")
    assert mih.search(rows, rows, k=3).count() == 90
    turns = spark.createDataFrame([(1, 1, "user", long), (1, 2, "assistant", None), (None, 1, "assistant", "a"), (None, 1, "assistant", "a"), (2, 1, None, "b"), (2, 1, None, "b")], "conv_id long, turn long, role string, text string").withColumns({"branch": F.lit(1), "formatted": F.lit("f")})
    read = {r.conv_id: r for r in chat.read_back(chat.formatted(chat.chain(turns))).collect()}
    assert [t.text for t in read[1].turns] == [long, ""] and read[None].learnt == "aa" and len(read[2].turns) == 2


# --- the pipeline


def test_pipeline_equals_its_stages_by_hand(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(12)
    clean = prose(120, 51, 80)
    bad = [i for i in range(120) if i % 6 == 0]
    texts = [t + (" scum idiot trash" * 3 if i in bad else "") for i, t in enumerate(clean)]
    copies = [edited(clean[i], 1, r) for i in (1, 2, 3)] + [clean[4]]
    private = ["call +1 (017) 555-7713 or write a.b@example.com " + prose(1, 60 + i, 60)[0] for i in range(6)]
    odd = ["12 34 56", "", None]
    every = [*texts, *copies, *private, *odd]
    rows = [(i, t, "en" if t and i < 130 else None, "web", len(t) if t is not None else None) for i, t in enumerate(every)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in bad)) for i in range(len(every))], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = common.written(stage(spark, docs, str(tmp_path)), name)
        kept.append(docs)
    ids = [{x.doc_id for x in df.select("doc_id").collect()} for df in kept]
    n = len(texts)
    assert ids[0] == set(range(len(every))) - {len(every) - 3, len(every) - 2, len(every) - 1}
    assert ids[1] == ids[0] - set(bad)
    parts = [x for x in brute_components([every[i] for i in sorted(ids[1])], 5) if x[3]]
    assert ids[2] == {sorted(ids[1])[x[0]] for x in parts} and not ids[2] & {n, n + 1, n + 2, n + 3}
    masked = {x.doc_id: x.text for x in kept[3].collect()}
    assert all("<PHONE>" in masked[i] and "<EMAIL>" in masked[i] and "555" not in masked[i] for i in range(n + 4, n + 10))
    assert all(masked[i] == every[i] for i in ids[3] if i < n)
    own = Tokenizer.from_file(PATH)
    got = {(x.doc_id, x.piece): x.length for x in kept[4].collect()}
    want = {(i, at // 2048): min(2048, size - at) for i, t in masked.items() for size in [len(own.encode(t, add_special_tokens=False).ids) + 1] for at in range(0, size, 2048)}
    assert got == want
    again = {(x.doc_id, x.piece, x.length) for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert again == {(*k, v) for k, v in got.items()}
    empty = docs_of(spark, [], lang="en", source="x").withColumn("n_chars", F.lit(0).cast("long"))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0


def test_queries_take_their_whole_tables(spark):
    sf = "/root/testdata/sf0.001"
    docs = common.table(spark, sf, "documents").count()
    for name in ("op1_pii", "op5_language_id", "op7_bpe", "op9_toxicity"):
        assert queries.QUERIES[name](spark, sf).count() == docs
    assert packing.pack(common.table(spark, sf, "documents"), PATH).select("doc_id").distinct().count() == docs


def test_near_duplicates_need_neither_sketches_nor_pivots(spark, monkeypatch):
    """Whatever the bounded steps turn down, the last step finds all links of a table's members."""
    draw = random.Random(5)
    texts = []
    for _ in range(6):
        base = [f"w{draw.randrange(10_000)}" for _ in range(120)]
        texts += [" ".join(base[: 115 + draw.randrange(5)]) for _ in range(6)]
    monkeypatch.setattr(neardup, "_likely", lambda *a, **k: F.lit(False))
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs_of(spark, texts), k=4, table_rows=1, pivots=1).collect()}
    assert got == {i: i // 6 * 6 for i in range(36)}
