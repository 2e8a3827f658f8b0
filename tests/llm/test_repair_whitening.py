"""Conversation repair against all edits of small conversations; whitening against a plain eigendecomposition."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from wxlake.llm import queries, repair, whitening

TURNS = "conv_id long, turn long, role string, text string"
GRAMMAR = re.compile(r"(s?(ua)+)?\Z")


def brute_least(rows):
    """Least (cost, audit, digest) over every sequence of edits with at most two insertions in a row."""
    best = None

    def walk(i, cost, audit, out, inserted):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        initials = "".join(r[:1] or "?" for r, _ in out)
        if not any(GRAMMAR.match(initials + rest) for rest in ("", "a", "ua")):
            return
        if i == len(rows) and GRAMMAR.match(initials):
            found = (cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest())
            best = found if best is None or found < best else best
        if inserted < 2:
            for role in ("user", "assistant"):
                walk(i, cost + 5, audit + "I", [*out, (role, "")], inserted + 1)
        if i < len(rows):
            role, text, wrong = rows[i]
            walk(i + 1, cost + 2, audit + "D", out, 0)
            if wrong in (repair.NONE, repair.TRUNCATED):
                more = 5 if wrong == repair.TRUNCATED else 0
                walk(i + 1, cost + more, audit + "K", [*out, (role, text)], 0)
                for new in ("user", "assistant"):
                    walk(i + 1, cost + more + 1, audit + "R", [*out, (new, text)], 0)

    walk(0, 0, "", [], 0)
    return best


def faults_of(rows):
    seen, out = set(), []
    for role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        wrong = repair.BLANK if not bare else repair.DUPLICATE if (role, text) in seen else repair.TRUNCATED if bare[-1] not in ".!?" else repair.NONE
        seen.add((role, text))
        out.append((role, text, wrong))
    return out


@pytest.mark.parametrize("block", [1, 2, 1024])
def test_least_repairs_equal_all_edits(monkeypatch, block):
    monkeypatch.setattr(repair, "BLOCK", block)
    r = random.Random(3)
    for _ in range(250):
        rows = faults_of([(r.choice(["system", "user", "assistant", "user", "assistant", "tool", ""]), r.choice(["Hi.", "Go on", "Yes!", "", " \n", "Why?", "One.", "Two", "é?"])) for _ in range(r.randrange(0, 6))])
        ways = repair.Ways()
        for row in rows:
            ways.feed(*row)
        assert ways.ended() == brute_least(rows), rows


def test_cuts_change_nothing_over_long_conversations(monkeypatch):
    r = random.Random(4)
    for n in (50, 700):
        rows = faults_of([(r.choice(["user", "assistant", "user", "system"]), r.choice([f"Turn {i}.", f"turn {i}", "Again.", ""])) for i in range(n)])
        found = []
        for block in (1, 7, 10_000):
            monkeypatch.setattr(repair, "BLOCK", block)
            ways = repair.Ways()
            for row in rows:
                ways.feed(*row)
            found.append(ways.ended())
        assert found[0] == found[1] == found[2] and len(found[0][1]) >= n


def brute_query(rows):
    """The query's rows in plain Python."""
    own: dict = {}
    for conv, turn, role, text in rows:
        said = lambda v: " " if v is None else str(v)
        role, text = said(role), said(text)
        kind = zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20
        kept = own.setdefault(conv, [])
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        kept += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = []
    for conv, kept in own.items():
        kept.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        rows = faults_of([x[1:] for x in kept])
        turns = [x[0] for x in kept if x[0] is not None]
        n = [sum(x[2] == k for x in rows) for k in range(4)]
        pairs = [a[0][:1] + b[0][:1] for a, b in zip(rows, rows[1:], strict=False)]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((conv, gaps, *n[1:], sum(p not in ("su", "ua", "au") for p in pairs), *brute_least(rows)))
    return sorted(out, key=str)


def test_repair_equals_brute_force(spark, tmp_path):
    r = random.Random(5)
    rows = [(c, t, r.choice(["user", "assistant", "system", None, "tool"]), r.choice(["Fine.", "Sure", None, "", "Really?", f"Text {c}."])) for c in range(60) for t in range(r.randrange(1, 6))]
    rows += [(None, 1, "user", "Hi."), (None, None, "user", "Hi."), (7, None, "system", "You help."), (8, 3, "user", "Same."), (8, 3, "user", "Same."), (8, 3, "assistant", "Same.")]
    spark.createDataFrame(rows, TURNS).selectExpr("*", "1 AS audit", "'x' AS gone", "2 AS again").repartition(5).write.parquet(str(tmp_path / "conversations.parquet"))
    found = queries.op13_repair(spark, str(tmp_path))
    assert found.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted((tuple(x) for x in found.collect()), key=str) == brute_query(rows)


def test_repair_of_nothing_and_of_long_texts(spark):
    assert repair.repaired(spark.createDataFrame([], TURNS)).count() == 0
    row = repair.repaired(spark.createDataFrame([(1, 0, "user", "long " * 200_000 + "."), (1, 1, "assistant", "Yes."), (2, None, None, None)], TURNS)).orderBy("conv_id").collect()
    assert [(x.audit, x.cost, x.blank) for x in row] == [("KK", 0, 0), ("D", 2, 1)]


# --- whitening


def plain_whitening(vectors, most=32):
    x = np.floor(64 * np.array(vectors, np.float64)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(0)
    c = (n * x - s) / n
    v = c.T @ c / n
    e, q = np.linalg.eigh(v)
    e, q = e[::-1][:most], q[:, ::-1][:, :most]
    return ((n * x - s) ** 2).sum(1), c @ q / np.sqrt(e), e / np.trace(v)


def test_whitening_equals_the_plain_way(spark, tmp_path):
    r = np.random.default_rng(6)
    good = (r.normal(size=(300, 40)) @ r.normal(size=(40, 40)) * 0.2).astype(np.float32)
    bad = [None, [], [1.0] * 39, [float("nan")] * 40, [float("inf")] + [0.0] * 39, [None] + [0.0] * 39, [3e38] * 40]
    rows = [(i, [float(c) for c in v], "x") for i, v in enumerate(good)] + [(None, [float(c) for c in good[5]], "x"), (5, [float(c) for c in good[5]], "y")]
    every = np.vstack([good, good[5:6], good[5:6]])
    rows += [(1000 + i, v, "z") for i, v in enumerate(bad)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, component string").repartition(6).write.parquet(str(tmp_path / "embeddings.parquet"))
    found = queries.op12_whitening(spark, str(tmp_path))
    assert found.dtypes == [("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double")]
    got = found.toPandas()
    apart, z, share = plain_whitening(every)
    assert len(got) == 302 * 32 and set(got.n) == {302} and got.identity_error.nunique() == 1 and got.identity_error.max() < 1e-9
    wide = got[got.vec_id.notna() & (got.vec_id != 5)].sort_values(["vec_id", "component"])
    ids = [i for i in range(300) if i != 5]
    mine = wide.whitened.to_numpy().reshape(-1, 32)
    sign = np.sign((mine * z[ids]).sum(0))
    assert np.allclose(mine * sign, z[ids], atol=1e-8) and np.allclose(wide.explained.to_numpy().reshape(-1, 32)[0], share, rtol=1e-9)
    assert list(wide.deviation.to_numpy().reshape(-1, 32)[:, 0]) == list(apart[ids])


def test_whitening_of_odd_tables(spark):
    kind = "vec_id long, embedding array<float>"
    for rows in ([], [(1, None)], [(1, [])], [(1, [2.0, 3.0])], [(i, [1.0, 1.0]) for i in range(9)]):
        table = spark.createDataFrame(rows, kind)
        assert whitening.whitened(table, whitening.fit(table)).count() == 0
    flat = spark.createDataFrame([(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(50)], kind)
    got = whitening.whitened(flat, whitening.fit(flat)).toPandas()
    assert sorted(set(got.component)) == [1, 2] and got.identity_error.max() < 1e-9
    mixed = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 1.0]), (3, [1.0]), (4, [2.0])], kind)  # the longer of equally frequent
    assert {r.vec_id for r in whitening.whitened(mixed, whitening.fit(mixed)).collect()} == {1, 2}


def test_wide_integers_stay_exact(spark):
    rows = [(i, [float(2.0**52 * (i - 3)), float(i * i)]) for i in range(8)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = whitening.fit(table)
    x = [[int(64 * c) + 1_000_000 for c in v] for _, v in rows]
    assert [int(s) for s in found.sums] == [sum(c) for c in zip(*x, strict=True)] and found.wide
    got = {r.vec_id: r.deviation for r in whitening.whitened(table, found).collect()}
    want = {i: sum((8 * a - int(s)) ** 2 for a, s in zip(v, found.sums, strict=True)) for i, v in enumerate(x)}
    assert got == {i: w if w < 1 << 63 else None for i, w in want.items()}
