"""Runs against comparing every lag, and digests against the contract written out."""
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from llm_fixtures import edge, edge_rows, empty, sf  # noqa: F401

from ledgerlens.llm import periodic_runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(w):
    """(start, period, end) of all runs."""
    n, best = len(w), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i < n - q and w[i] == w[i + q]:
                i += 1
            if i + q - s >= 2 * q:
                best.setdefault((s, i + q), q)
    return sorted((s, q, e) for (s, e), q in best.items() if e - s >= 12)


def found(w):
    s, e, q = periodic_runs.runs_of(np.array(w, np.int64))
    return [(int(a), int(c), int(b)) for a, b, c in zip(s, e, q)]


def sequence(r):
    k = r.choice([1, 2, 2, 3, 5, 50])
    base = [r.randrange(k) for _ in range(r.randint(1, 60))]
    w = []
    while len(w) < r.randint(10, 500):
        c = r.random()
        if c < .35:
            w += base[:r.randint(1, len(base))] * r.randint(1, 8)
        elif c < .5:
            w += [r.randrange(k)] * r.randint(1, 70)
        elif c < .6:
            w += [r.randrange(k) for _ in range(r.randint(1, 30))]
        elif c < .75 and w:
            w += w[-r.randint(1, len(w)):]
        elif c < .85:
            u = [0] * r.randint(1, 6) + [1]
            w += u * r.randint(2, 30) + u[:r.randint(0, len(u))]
        else:
            base = [r.randrange(k) for _ in range(r.randint(1, 60))]
    return w


@pytest.mark.parametrize("seed", range(6))
def test_random_sequences(seed):
    r = random.Random(seed)
    for _ in range(80):
        w = sequence(r)
        assert found(w) == brute(w)


def test_words_with_many_squares():
    fib, nxt = [0], [0, 1]
    while len(nxt) < 900:
        fib, nxt = nxt, nxt + fib
    assert found(nxt) == brute(nxt)
    thue = [bin(i).count("1") & 1 for i in range(900)]
    assert found(thue) == brute(thue)


@pytest.mark.parametrize("p", [1, 2, 3, 5, 7])
def test_two_runs_of_one_period_side_by_side(p):
    """Long periods that lie wholly inside runs of a short one: no window has a minimizer."""
    u = [1] * p + [0]
    for x in range(p + 2):
        for w in ((u * 60)[:160 + x] + u * 50, u * 40 + [0] * x + u * 40 + [0] * x + u * 40, (u * 30)[:70 + x] * 5):
            assert found(w) == brute(w)


@pytest.mark.parametrize("q", [15, 16, 17, 31, 32, 33, 63, 64, 100, 127, 128, 500])
def test_every_scale(q):
    r = random.Random(q)
    unit = [r.randrange(1000) for _ in range(q)]
    for extra in (0, 1, q // 2):
        w = [-1, -2] + (unit * 4)[:2 * q + extra] + [-3]
        assert found([x + 3 for x in w]) == brute(w)
        assert found([x + 3 for x in w[:2 + 2 * q - 1]]) == brute(w[:2 + 2 * q - 1])


def contract(doc_id, text, plant=True):
    words = WORD.findall(text or "")
    n = len(words)
    if plant and doc_id is not None and n and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g = zlib.crc32(str(doc_id).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    runs = brute([number[w] for w in words])
    top = min(runs, key=lambda r: (r[0] - r[2], r[0], r[1]), default=None)
    drop = set()
    for s, q, e in runs:
        drop.update(range(s + q, e))
    best = (None,) * 4 if top is None else (top[0], top[2] - top[0], top[1], 1000 * (top[2] - top[0]) // top[1])
    lines = "".join(f"{s},{e - s},{q}\n" for s, q, e in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in drop)
    return (doc_id, len(runs), *best, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def test_digests_of_awkward_rows(edge, edge_rows):
    rows = [(r[0], r[1]) for r in edge_rows if r[0] not in (9, 10)]  # the long texts: below
    got = sorted(map(tuple, periodic_runs.run_digests(edge.filter("doc_id is null or doc_id not in (9, 10)")).collect()), key=str)
    assert got == sorted((contract(*r) for r in rows), key=str)


def test_digests_of_long_texts(edge, edge_rows):
    """60,000 words with period 977 * 31, which is too long for a run; three copies of the text are one."""
    got = periodic_runs.run_digests(edge.filter("doc_id in (9, 10)"), plant=False).collect()
    assert {(r.n_runs, r.start, r.length, r.period) for r in got} == {(0, None, None, None)}
    twice = periodic_runs.runs(edge.filter("doc_id = 9").selectExpr("doc_id", "concat(text, ' ', text, ' ', text) as text")).collect()
    assert [(r.start, r.length, r.period) for r in twice] == [(0, 3 * 60_001, 60_001)]


def test_digests_of_whole_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.text is None or len(r.text) < 6000]
    want = {r[0]: r for r in (contract(*x) for x in rows)}
    got = {r.doc_id: tuple(r) for r in periodic_runs.run_digests(docs).collect()}
    assert {k: got[k] for k in want} == want and any(r[1] for r in want.values())


def test_collapsed_text(spark):
    docs = spark.createDataFrame([(1, "a b\n" * 9 + "end"), (2, "no repeats here"), (3, None)], "doc_id long, text string")
    assert {r.doc_id: r.text for r in periodic_runs.collapse(docs).collect()} == {1: "a b end", 2: "no repeats here", 3: ""}


def test_empty_table(empty):
    assert periodic_runs.run_digests(empty).collect() == [] and periodic_runs.runs(empty).collect() == []
