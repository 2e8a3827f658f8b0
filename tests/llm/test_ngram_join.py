"""The exact n-gram join against all pairs, with tiny blocks, frequent tokens and every way of forming keys."""

from __future__ import annotations

import random

import numpy as np
import pytest

from wxlake.llm import neardup, ngram_join

from test_operators import AWKWARD, brute_components, docs_of, prose


def mixture(seed, groups=6, copies=9, words=70):
    """Near copies on both sides of the threshold, a passage that all quote, exact copies, and awkward texts."""
    r = random.Random(seed)
    passage = " ".join(f"quoted{i}" for i in range(25))
    texts = list(AWKWARD)
    for base in prose(groups, seed, words):
        for i in range(copies):
            w = base.split()
            for _ in range(r.choice([0, 0, 1, 1, 2, 3, 5])):
                w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
            texts.append(" ".join(w) if i % 3 else passage + " " + " ".join(w).upper())
    texts += [f"{passage} own{i} word{i}" for i in range(20)] + prose(10, seed + 1) + [" ".join(f"t{i}" for i in range(n)) for n in range(1, 14)] * 2
    r.shuffle(texts)
    return texts


@pytest.mark.parametrize(("k", "threshold", "combination"), [(4, 85, 2), (5, 80, 2), (4, 85, 3), (3, 60, 2), (4, 50, 4), (2, 95, 2)])
def test_links_equal_all_pairs(spark, monkeypatch, k, threshold, combination):
    monkeypatch.setattr(ngram_join, "RARE", 4)
    texts = mixture(k + threshold)
    docs = docs_of(spark, texts, key="x", id=1, shared="y").repartition(5)
    got = ngram_join.linked(docs, k, threshold, combination).collect()
    assert sorted(tuple(x) for x in got) == [x[:3] for x in brute_components(texts, k, threshold)]


def test_small_blocks_and_ranges_change_nothing(spark, monkeypatch):
    for name, value in {"RARE": 3, "BLOCK_TOKENS": 500, "RANGE_BYTES": 1000, "ROWS": 4, "PARTNERS": 2}.items():
        monkeypatch.setattr(ngram_join, name, value)
    texts = mixture(77, groups=4, copies=30)
    got = ngram_join.linked(docs_of(spark, texts).repartition(3), 4, 85).collect()
    assert sorted(tuple(x) for x in got) == [x[:3] for x in brute_components(texts, 4, 85)]


def test_links_of_nothing_nulls_and_repeats(spark):
    kind = "doc_id long, text string"
    assert ngram_join.linked(spark.createDataFrame([], kind)).count() == 0
    a, b, c = prose(3, 41)
    rows = [(5, a), (5, a), (3, a), (None, a), (None, b), (4, b), (4, c), (2, c), (9, None), (8, ""), (None, None), (1, "x y")]
    got = sorted((tuple(x) for x in ngram_join.linked(spark.createDataFrame(rows, kind), 4, 85).collect()), key=str)
    n = {t: brute_components([t], 4)[0][1] for t in (a, b, c)}
    want = [(5, n[a], 3), (5, n[a], 3), (3, n[a], 3), (None, n[a], None), (None, n[b], None), (4, n[b], 2), (4, n[c], 2), (2, n[c], 2), (9, 0, 9), (8, 0, 8), (None, 0, None), (1, 1, 1)]
    assert got == sorted(want, key=str)


def test_prefixes_lose_no_pair():
    """Sets alike enough share a key, whatever their sizes and however many of their tokens are frequent."""
    r = np.random.default_rng(2)
    for threshold, k in ((85, 2), (85, 3), (60, 2), (50, 3), (99, 2)):
        lost = met = 0
        for _ in range(300):
            n = int(r.integers(1, 300))
            base = np.unique(r.integers(0, 1 << 62, n))
            rank = {int(t): (bool(r.random() < 0.3), int(t)) for t in r.permutation(base)}
            drop = base[r.random(len(base)) > r.uniform(0, 1.2 * (100 - threshold) / 100)]
            sizes = []
            for own in (base, drop):
                ordered = sorted(own.tolist(), key=lambda t: (not rank[t][0], t))
                sizes.append((len(own) + int(r.integers(0, 1 + len(own) // 20)), sum(rank[t][0] for t in ordered), np.array(ordered, np.int64)))
            (n1, r1, s1), (n2, r2, s2) = sizes
            if not n1 or not n2 or 100 * len(drop) < threshold * (n1 + n2 - len(drop)):
                continue
            own, keys = ngram_join.index_keys(np.array([n1, n2]), np.array([r1, r2]), [s1, s2], threshold, k)
            met += 1
            lost += not set(keys[own == 0].tolist()) & set(keys[own == 1].tolist())
        assert met > 20 and lost == 0


def test_bitmaps_only_leave_out_what_cannot_be():
    r = np.random.default_rng(3)
    n, rr, bits, sets = [], [], [], []
    for _ in range(120):
        size = int(r.integers(1, 4000))
        own = np.unique(r.integers(0, 5000, size)) if r.random() < 0.5 or not sets else np.unique(np.concatenate([sets[-1][r.random(len(sets[-1])) < 0.97], r.integers(0, 5000, 20)]))
        sets.append(own)
        unique = int(r.integers(0, 1 + len(own) // 15))
        n.append(len(own) + unique)
        rr.append(len(own))
        bits.append(ngram_join.bitmap(own))
    n, rr, bits = np.array(n), np.array(rr), np.array(bits)
    a, b = np.triu_indices(len(sets), 1)
    both = np.array([len(np.intersect1d(sets[i], sets[j])) for i, j in zip(a, b, strict=True)])
    alike = 100 * both >= 85 * (n[a] + n[b] - both)
    found = ngram_join.possible(n, rr, bits, a, b, 85)
    assert alike.any() and not (alike & ~found).any() and found.sum() < len(found) / 2


def _pairs(rows) -> set[tuple[int, int]]:
    """Pairs of different roots that meet in rows (key, i, j, x, id, root) as the comparison takes them."""
    met: dict[tuple, list] = {}
    for r in rows:
        met.setdefault((r.key, r.i, r.j), []).append(r)
    return {(min(a.id, b.id), max(a.id, b.id)) for (_, i, j), own in met.items() for a in own for b in own if a.root != b.root and (i == j or a.x != b.x)}


def test_blocks_of_a_large_group_meet_what_differs_only(spark, monkeypatch):
    """Of 200 members 190 are in one component: rows grow with the members, not with their blocks, and no pair is lost."""
    monkeypatch.setattr(ngram_join, "ROWS", 10)
    keys = spark.createDataFrame([(1, i) for i in range(200)] + [(2, i) for i in range(180, 230)] + [(3, i) for i in range(5)], "key long, id long")
    roots = spark.createDataFrame([(i, 0) for i in range(190)] + [(200, 200), (201, 200)], "node long, root long")
    rows = ngram_join._dealt(keys, roots).collect()
    assert sum(r.key == 1 for r in rows) <= 2 * 200 and not any(r.key == 3 for r in rows)
    of = {i: 0 for i in range(190)} | {200: 200, 201: 200}
    wanted = {(a, b) for lo, hi in ((0, 200), (180, 230)) for a in range(lo, hi) for b in range(a + 1, hi) if of.get(a, a) != of.get(b, b)}
    assert _pairs(rows) == wanted


def test_tables_of_one_band_are_one_group(spark):
    """Tables of near copies share a first band: they are compared once for it, and no pair of a table is lost."""
    r = random.Random(5)
    rows = {(r.randrange(60), 100 * x + t, x) for x in range(3) for t in range(20) for _ in range(40)}
    rows |= {(1000 + 2 * t + i, 500 + t, 9) for t in range(50) for i in range(2)}  # a common band that small tables take apart
    groups = neardup._groups(spark.createDataFrame(list(rows), "id long, key long, x long")).collect()
    held: dict[int, set[int]] = {}
    for g in groups:
        held.setdefault(g.key, set()).add(g.id)
    for table in {k for _, k, _ in rows}:
        own = {i for i, k, _ in rows if k == table}
        assert any(own <= members for members in held.values())
    assert len(groups) <= 3 * 60 + 100 and max(map(len, held.values())) <= 60
