"""The corpus operators against brute force, on small and awkward inputs."""

from __future__ import annotations

import hashlib
import json
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wxlake.llm import bpe, chat, common, fingerprints, langid, mih, neardup, packing, pii, toxicity, url_filter

PATH = public_tokenizers.path("word_bpe_49k.json")
RARE = "a" + chr(0xA0) + "b" + chr(0x2003) + "c\x0bd\x1ce"
AWKWARD = ["", " ", None, "a", "\n\n", RARE, "x" * 30_000, "é " * 5_000, "one two three", "one two three", "<|endoftext|> <|im_end|>", "日本語" * 900, "1 2 3 " * 2_000]


def docs_of(spark, texts, **extra):
    rows = [(i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({k: F.lit(v) for k, v in extra.items()})


def prose(n, seed=1, words=60):
    r = random.Random(seed)
    return [" ".join(r.choice("the of wind rain snow storm night river road light cold warm".split()) + str(r.randrange(40)) for _ in range(words)) for _ in range(n)]


# --- shingles and near duplicates


def brute_components(texts, k, threshold=80):
    sets = []
    for t in texts:
        w = [x for x in re.split(r"[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    root = list(range(len(texts)))

    def up(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= threshold * len(sets[i] | sets[j]):
                a, b = sorted((up(i), up(j)))
                root[b] = a
    return [(i, len(sets[i]), up(i), up(i) == i) for i in range(len(texts))]


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates_equal_brute_force(spark, k):
    r = random.Random(3)
    texts = list(AWKWARD)
    for base in prose(12):
        texts.append(base)
        for changes in (0, 1, 2, 3, 5):
            words = base.split()
            for _ in range(changes):
                words[r.randrange(len(words))] = f"new{r.randrange(10**6)}"
            texts.append(" ".join(words).upper() if changes == 1 else " ".join(words))
    got = neardup.near_duplicates(docs_of(spark, texts, key="x", id=1, n=2), k=k).collect()
    assert sorted(tuple(x) for x in got) == brute_components(texts, k)


def test_near_duplicates_of_nothing_nulls_and_repeats(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert neardup.near_duplicates(empty).count() == 0
    rows = [(None, "a b c d e f"), (None, None), (1, "a b c d e f"), (1, "a b c d e f"), (2, "other words stand in here now")]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((x.doc_id or 0, x.component_id or 0, x.kept) for x in got) == [(0, 0, True), (0, 0, True), (1, 1, True), (1, 1, True), (2, 2, True)]


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(100, 101), (105, 100), (105, 105)], "u long, v long")
    got = {r.node: r.root for r in neardup.components(edges).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {101: 100, 105: 100}


# --- fingerprints


def test_fingerprints(spark):
    texts = [t if t is None else t[:4000] for t in AWKWARD] + prose(20, words=400)
    rows = fingerprints.edited_pairs(docs_of(spark, texts, h=1, bucket=2), k=64, rows=7).collect()
    assert len(rows) == len(texts)
    by = {r.doc_id: r for r in rows}
    ids = sorted(by, reverse=True)
    for at, i in enumerate(ids):
        text, after = texts[i] or "", texts[ids[(at + 1) % len(ids)]] or ""
        n = len(text) // 3
        edited = text[: len(text) - n] + after[:n]
        assert by[i].n_chars == len(text)
        assert by[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= by[i].near_edited <= 1 and 0 <= by[i].near_next <= 1
        if n == 0:
            assert by[i].fingerprint == by[i].edited_fingerprint and by[i].near_edited == 1
    assert by[8].fingerprint == by[9].fingerprint
    long = [by[i] for i in range(len(AWKWARD), len(texts))]
    assert all(abs(r.near_edited - 0.5) < 0.25 and r.near_next < 0.2 for r in long)
    assert all(abs(r.shingles - 396) < 160 for r in long)


def test_fingerprints_merge(spark):
    whole = " ".join(f"w{i}" for i in range(300))
    words = whole.split()
    parts = spark.createDataFrame([(1, " ".join(words[:180])), (1, " ".join(words[176:]))], "key int, text string")
    parts = parts.select("key", fingerprints.fingerprint(F.col("text"), 32).alias("fingerprint"))
    want = spark.createDataFrame([(whole,)], "text string").select(fingerprints.fingerprint(F.col("text"), 32)).first()[0]
    assert fingerprints.merge_all(parts, "key", k=32).first().fingerprint == want
    assert fingerprints.edited_pairs(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# --- language and toxicity


def test_language(spark):
    en, de = prose(40, 1), [t.replace("w", "ü").replace("th", "sch") + " über nicht" for t in prose(40, 2)]
    rows = [(i, t, "en" if i < 40 else "de") for i, t in enumerate(en + de)] + [(100, None, None), (101, "12 34", "en"), (102, "", "de"), (None, en[0], None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs.where(~common.held_out()))
    got = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    assert all(got[i].lang_pred == ("en" if i < 40 else "de") and 0.5 < got[i].score <= 1 for i in range(80))
    assert [got[i].lang_pred for i in (100, 101, 102)] == ["und"] * 3 and got[None].lang_pred == "en"
    assert langid.known_language(docs, model).count() == 81
    assert {r.lang_pred for r in langid.identify(docs, None).collect()} == {"und"}


def test_texts_in_no_learnt_language_go(spark):
    import corpus_pipeline

    en, de = prose(40, 1), [t.replace("w", "ü").replace("th", "sch") + " über nicht" for t in prose(40, 2)]
    r = random.Random(4)
    odd = ["това е текст на български език за времето и реките", "日本語の文章です。今日は天気がいいですね", "".join(r.choice("bcdfghjklmnpqrstvwxyzäöü ") for _ in range(300))]
    rows = [(i, t, "en" if i < 40 else "de") for i, t in enumerate(en + de)] + [(80, "the wind", "en"), (81, "12 34", None)]
    held = [i for i in range(100, 200) if zlib.crc32(str(i).encode()) % 5 == 0]  # the odd texts are not learnt from
    docs = spark.createDataFrame(rows + [(held[i], t, None) for i, t in enumerate(odd)], "doc_id long, text string, lang string")
    assert sorted(x.doc_id for x in corpus_pipeline.language(spark, docs, "").collect()) == list(range(81))


def test_code_lengths_equal_a_plain_context_tree():
    texts = {"a": ["abracadabra", "abba"], "b": ["banana", "xyzzy"]}
    rows = []
    for lang, own in texts.items():
        for t in own:
            raw = [0, 0, 0, *t.encode()]
            rows += [(lang, int.from_bytes(bytes(raw[i : i + 4]), "big")) for i in range(len(t))]
    model = langid.build(["a", "b"], np.array([r[0] for r in rows], object), np.array([r[1] for r in rows]), np.ones(len(rows), np.int64), least=1)

    def bits(lang, text):
        counts = {}
        for t in texts[lang]:
            raw = "\0\0\0" + t
            for i in range(3, len(raw)):
                for k in range(4):
                    counts.setdefault(raw[i - k : i], {}).setdefault(raw[i], 0)
                    counts[raw[i - k : i]][raw[i]] += 1
        seen = set("".join(t for own in texts.values() for t in own))
        total, raw = 0.0, "\0\0\0" + "".join(c if c in seen else "\0" for c in text)
        for i in range(3, len(raw)):
            p, scale = 0.0, 1.0
            for k in (3, 2, 1, 0):
                c = counts.get(raw[i - k : i])
                if c:
                    n, d = sum(c.values()), len(c)
                    if raw[i] in c:
                        p = scale * c[raw[i]] / (n + d)
                        break
                    scale *= d / (n + d)
            else:
                p = scale / 256
            total -= np.log2(p)
        return total

    for text in ("abracadabra", "banana", "zzab!", "q"):
        raw = np.frombuffer(text.encode(), np.uint8)
        got = model.lengths(raw, np.array([0, len(raw)]))[0]
        assert got == pytest.approx([bits("a", text), bits("b", text)], rel=1e-5)


def test_toxicity(spark):
    texts = prose(300, 5)
    bad = [i for i in range(300) if i % 7 == 0]
    for i in bad:
        texts[i] += " scum idiot trash"
    docs = docs_of(spark, texts + ["", None])
    labels = spark.createDataFrame([(i, 1 if i in bad else 0) for i in range(0, 300, 2)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r.predicted for r in toxicity.score(docs, model).collect()}
    assert [i for i in range(302) if got[i]] == bad
    assert toxicity.not_toxic(docs, model).count() == 302 - len(bad)
    assert {r.score for r in toxicity.score(docs, toxicity.fit(docs, labels.where("toxic = 0"))).collect()} == {0.0}


# --- personal data

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    good = {
        "email": lambda s: True,
        "ip": lambda s: all(int(x) <= 255 for x in s.split(".")),
        "card": lambda s: 13 <= len(digits(s)) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(digits(s)[::-1])) % 10 == 0,
        "phone": lambda s: 9 <= len(digits(s)) <= 15,
    }
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS.items() for m in re.finditer(p, text) if good[k](m[0]))


def test_personal_data_equals_the_patterns(spark):
    r = random.Random(11)
    texts = ["".join(r.choice("1234567890.@+-() ab%\u00e9\n") for _ in range(r.randrange(120))) for _ in range(1500)]
    texts += ["a@b.c-d@e.f_x@y.zz", "@@a@b@c.d", "4111 1111 1111 1111", "1.2.3.4.5.6.7.8", "+1 (017) 555-7713 4111111111111111", "9" * 5000, "é 10.0.0.1", "call (212) 555-0188 now", "joe [at] mail [dot] com"]
    docs = docs_of(spark, [*texts, None, ""], base="x", found="y")
    found, model = pii.personal_data(docs)
    rows = {x.doc_id: x for x in found.collect()}
    for i, t in enumerate([*texts, "", ""]):
        assert rows[i].base == plain_spans(t), t
        assert set(filter(None, rows[i].base.split(","))) <= set(rows[i].spans.split(","))
        assert rows[i].n_ip == rows[i].base.count("ip:")
    masked = {x.doc_id: x for x in pii.mask(docs.withColumn("n_chars", F.length("text").cast("long")), model).collect()}
    assert masked[1500].text == "<EMAIL>@e.f_x@y.zz" or "<EMAIL>" in masked[1500].text
    assert masked[1506].text == "é <IP>" and masked[1506].n_chars == 6
    assert all(x.n_chars == (None if x.text is None else len(x.text)) for x in masked.values())


def test_cards_inside_longer_runs_are_masked(spark):
    card, spaced = "4465758382889437", "4465 7583 8288 9437"
    runs = [f"{card} {card}", f"{card}-{card} {card}", f"+1 212-555-0123 {card}", f"12 {card}", f"{spaced} {spaced}", f"7 {spaced}", "7536784127813050 4111111111111111"]
    texts = [f"paid with {r} today" for r in runs] + [f"paid with {card} today"] * 20 + [f"table {i} 1234567890123456 {i} 98765" for i in range(20)]
    docs = docs_of(spark, texts)
    out = {x.doc_id: x.text for x in pii.mask(docs, pii.fit(pii.candidates(docs))).collect()}
    for i, r in enumerate(runs):
        assert "<CARD>" in out[i] and not re.search("[0-9]{4}", re.sub("[ -]", "", out[i])), (r, out[i])
    assert out[2] == "paid with <PHONE> <CARD> today" and all("1234567890123456" in out[i] for i in range(27 + 1, 47))
    # Linear in the run, however the digits are grouped.
    for long in ("1 " * 20_000, "1234-" * 20_000, "9" * 5_000, f"{card} " * 5_000):
        assert len(pii.find(long)[1]) <= 7 * (long.count(" ") + long.count("-") + 1)


def test_em_recovers_reliabilities():
    r = np.random.default_rng(4)
    truth = r.random(20_000) < 0.3
    right = [0.95, 0.8, 0.7]
    votes = np.stack([np.where(r.random(len(truth)) < p, truth, ~truth) for p in right], 1).astype(int)
    patterns, counts = np.unique(["".join(map(str, v)) for v in votes], return_counts=True)
    prior, table, post = pii.em(list(patterns), counts.astype(float))
    assert prior == pytest.approx(0.3, abs=0.05)
    assert [table[1, i, 1] for i in range(3)] == pytest.approx(right, abs=0.06)
    assert post[list(patterns).index("111")] > 0.9 > 0.1 > post[list(patterns).index("000")]


# --- URLs


def test_url_filter(spark):
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("a.org", None, "block"), (None, "/x", "block"), ("a.org", "", "allow")]
    urls = [None, "", "no scheme", "http://", "http://x.NET/a", "http://x.net", "https://sub.example.net/en/q?x=1", "https://example.net/EN/", "http://myexample.com/de/", "http://example.com/de/?a://b.net/", "http://a.org/fr/", "x://b.a.org#frag", "http://y.org/fr/\nz", "ftp://A.B.org?/fr/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash"))
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    want = []
    for i, u in enumerate(urls):
        m = re.search(r"://([^/?#]*)([^?#]*)", u or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fits = [(len(h + (p or "")), v == "block", h + (p or "")) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p or "")]
        best = max(fits, default=None)
        want.append((i, host, path, best and best[2], "block" if best and best[1] else "allow"))
    assert sorted(tuple(r) for r in url_filter.judge(pages, url_filter.build(table)).collect()) == want
    assert sorted(tuple(r) for r in url_filter.join_judge(pages, table).collect()) == want
    assert {r.verdict for r in url_filter.judge(pages, url_filter.build(table.limit(0))).collect()} == {"allow"}
    with pytest.raises(ValueError):
        url_filter.build(table, most=10)


def test_rules_fold_as_hosts_do(spark):
    rules = spark.createDataFrame([("Éx.NET", "/", "block")], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://a.Éx.net/"), (2, "http://éx.net/")], "page_id long, url string")
    for judged in (url_filter.judge(pages, url_filter.build(rules)), url_filter.join_judge(pages, rules)):
        assert {r.page_id: r.verdict for r in judged.collect()} == {1: "block", 2: "allow"}


def test_equal_digests_are_told_apart(monkeypatch):
    monkeypatch.setattr(url_filter.xxhash, "xxh64_intdigest", lambda b: 7)
    keys, offsets, data, _ = url_filter.entries([("a.com", "", "block"), ("b.com", "", "allow")])
    assert list(keys) == [7, 7] and sorted(data[offsets[i] : offsets[i + 1]] for i in (0, 1)) == [b"Ab.com", b"Ba.com"]


# --- tokens and packing


def test_bpe_equals_the_library(spark):
    own = Tokenizer.from_file(PATH)
    texts = [*AWKWARD, *prose(30, 7, 300), *prose(30, 7, 300), "It's WE'LL don't", "e\u0301 cafe\u0301 \u0130"]
    got = {r.doc_id: r for r in bpe.encode(docs_of(spark, texts, ids=1), PATH).collect()}
    short = {r.doc_id: r for r in bpe.digests(docs_of(spark, texts), PATH).collect()}
    for i, t in enumerate(texts):
        ids = own.encode(t or "", add_special_tokens=False).ids
        assert got[i].ids == ids and got[i].decoded == own.decode(ids, skip_special_tokens=False)
        assert short[i].n_tokens == len(ids) and short[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert short[i].decoded_sha256 == hashlib.sha256(got[i].decoded.encode()).hexdigest()


def test_cuts_follow_the_content():
    text = " ".join(prose(1, 8, 2000)).encode()
    one = set(bpe.cuts(np.frombuffer(text, np.uint8)).tolist())
    two = set((bpe.cuts(np.frombuffer(b"in front " + text, np.uint8)) - 9).tolist())
    assert len(one & two) > 0.9 * len(one) > 5


def test_packing(spark):
    own = Tokenizer.from_file(PATH)
    texts = [*AWKWARD, *prose(60, 9, 150), *["same text"] * 30]
    rows = packing.pack(docs_of(spark, texts, offset=1, length=2), PATH, size=256, bucket_rows=10).toPandas()
    want = []
    for i, t in enumerate(texts):
        ids = [*own.encode(t or "", add_special_tokens=False).ids, 0]
        want += [(i, a // 256, a, len(ids[a : a + 256]), zlib.crc32(np.array(ids[a : a + 256], "<u4").tobytes())) for a in range(0, len(ids), 256)]
    assert sorted(map(tuple, rows[["doc_id", "piece", "start", "length", "ids_crc32"]].values.tolist())) == want
    for _, g in rows.sort_values("offset").groupby("sequence_id"):
        assert [0, *(g.offset + g.length)][:-1] == list(g.offset) and g.length.sum() <= 256
    # Pieces of more than half a sequence cannot share one; the shorter ones fill what they leave.
    half = rows.length[rows.length > 128]
    least = len(half) + max(0, -(-(rows.length.sum() - 256 * len(half)) // 256))
    assert least <= rows.sequence_id.nunique() <= least + 1
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_bin_completion_beats_best_fit():
    have = np.zeros(101, np.int64)
    have[[60, 45, 35, 20]] = 1
    assert sorted(packing.complete(have, 100)) == [20, 35, 45]
    bins = packing.plan({60: 2, 40: 1, 30: 2, 10: 1, 100: 3}, 100)
    # 60 + 40, 60 + 30 + 10 and 30, beside the three full ones.
    assert sum(r for r, _ in bins) == 3 + fewest_bins([60, 60, 40, 30, 30, 10], 100) == 6
    assert sum(r * sum(f) for r, f in bins) == 300 + 230
    # Many short pieces are one step each, not one a piece.
    assert sum(r for r, _ in packing.plan({3: 3, 2: 5000}, 2048)) == 5
    assert sum(r for r, _ in packing.plan({4: 3, 2: 5000, 3: 3}, 2048)) == 5


def fewest_bins(items, size):
    best = [len(items)]

    def put(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(items):
            best[0] = len(rooms)
            return
        for room in {r for r in rooms if r >= items[i]}:
            at = rooms.index(room)
            put(i + 1, [*rooms[:at], room - items[i], *rooms[at + 1 :]])
        put(i + 1, [*rooms, size - items[i]])

    put(0, [])
    return best[0]


@pytest.mark.parametrize("kept", [1, 32])
def test_plans_are_exact_over_all_sequences(monkeypatch, kept):
    monkeypatch.setattr(packing, "KEPT", kept)
    assert sum(r for r, _ in packing.plan({11: 1, 10: 1, 7: 3, 6: 1, 5: 1, 4: 1, 3: 1}, 20)) == 3  # the fullest first sequence needs 4
    r = random.Random(5)
    for _ in range(400):
        size = r.choice([10, 20, 50])
        items = sorted((r.randrange(max(1, size // 6), r.choice([size // 2, size]) + 1) for _ in range(r.randrange(1, 11))), reverse=True)
        bins = packing.plan({n: items.count(n) for n in items}, size)
        assert sorted((n for times, f in bins for n in f * times), reverse=True) == items and all(sum(f) <= size for _, f in bins)
        assert sum(times for times, _ in bins) == fewest_bins(items, size), (size, items)
    r = np.random.default_rng(2)
    many = {int(n): int(c) for n, c in zip(range(1, 257), r.integers(0, 10**6, 256), strict=True)}
    tokens = sum(n * c for n, c in many.items())
    assert sum(times for times, _ in packing.plan(many, 256, steps=300)) <= 1.01 * tokens / 256


# --- chat


def test_reply_trees(spark):
    rows = [(1, 1, None, "system", "s", 0.0), (1, 2, 1, "user", "u", 1.0), (1, 3, 2, "assistant", "bad", 0.5), (1, 4, 2, "assistant", "good", 2.0), (1, 5, 4, "user", "more", 0.0), (2, 1, 9, None, None, None), (3, 1, 2, "user", "x", 0.0), (3, 2, 1, "user", "y", 0.0)]
    nodes = spark.createDataFrame(rows, "conv_id long, node long, parent long, role string, text string, score double")
    got = {(r.conv_id, r.branch): r for r in chat.read_back(chat.formatted(nodes, branches=2)).collect()}
    assert {k: [t.text for t in v.turns] for k, v in got.items()} == {(1, 1): ["s", "u", "good", "more"], (1, 2): ["s", "u", "bad"], (2, 1): [""]}
    assert got[1, 1].learnt == "good" and got[1, 1].path_score == 3.0
    a, b = got[1, 1].loss_spans[0]
    assert got[1, 1].formatted[a:b] == "good"


def test_chat_is_reversible(spark):
    r = random.Random(2)
    bits = ["<|im_end|>", "<|im_start|>", "\\", "<", "|", "\n", "assistant", "\\l", "\x00", "\x00b", "é", "<\\|", ""]
    rows = [(c, t, r.choice(["user", "assistant", "a\nb"]), "".join(r.choice(bits) for _ in range(6))) for c in range(40) for t in range(c % 11 + 1)] + [(50, t, "assistant", str(t)) for t in range(150)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {x.conv_id: x for x in chat.read_back(chat.formatted(chat.chain(turns))).collect()}
    for c in {x[0] for x in rows}:
        own = [x for x in rows if x[0] == c]
        assert [(t.role, t.text) for t in got[c].turns] == [x[2:] for x in own]
        assert got[c].learnt == "".join(x[3] for x in own if x[2] == "assistant")


# --- Hamming search


def test_hamming_search_is_exact(spark):
    r = random.Random(6)
    codes = [r.getrandbits(64) for _ in range(300)]
    codes += [c ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for c in codes[:100]] + [codes[0]] * 30
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    rows = spark.createDataFrame([*enumerate(signed), (None, 5), (999, None)], "id long, code long")
    got = mih.search(rows, rows.where("id % 50 = 0"), k=7).collect()
    by = {}
    for x in got:
        by.setdefault(x.query_id, []).append((x.rank, x.distance, x.neighbor_id))
    for q in range(0, 430, 50):
        want = sorted(((codes[q] ^ c).bit_count(), i) for i, c in enumerate(codes))[:7]
        assert sorted(by[q]) == [(n + 1, *w) for n, w in enumerate(want)]
    few = rows.where("id < 3")
    assert mih.search(few, few, k=7).count() == 9
    assert mih.search(few.limit(0), few, k=7).count() == 0


def test_sign_code(spark):
    v = [1.0 if i % 3 == 0 else -1.0 for i in range(64)]
    df = spark.createDataFrame([(v,), (v[:5],), (None,)], "e array<double>").select(mih.sign_code("e").alias("c"))
    want = sum(1 << i for i in range(0, 64, 3))
    assert [r.c for r in df.collect()] == [want - (1 << 64) if want >> 63 else want, 0b01001, None]


def test_text_bytes_of_slices():
    column = pa.array(["ab", None, "é", ""])
    raw, offsets = common.text_bytes(column.slice(1))
    assert raw.tobytes() == "é".encode() and offsets.tolist() == [0, 0, 2, 2]
    assert json.dumps(list(common.passes(np.array([0, 5, 5, 9, 30]), 9))) == "[[0, 3], [3, 4]]"
