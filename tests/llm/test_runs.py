"""Periodic runs against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from citegrid.llm import runs


def brute(w):
    """(start, length, period) of every run, by definition."""
    out = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q) and not any(all(w[k] == w[k + r] for k in range(i, j + q - r)) for r in range(1, q)):
                out.append((i, j + q - i, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def made(rnd):
    w = []
    while len(w) < rnd.randint(0, 70):
        w += [rnd.choice("abcd"[: rnd.randint(1, 4)]) for _ in range(rnd.randint(1, 7))] * rnd.randint(1, 6)
        if rnd.random() < 0.3:
            w = w[: rnd.randint(1, len(w))]
    return w


def test_runs_are_those_of_the_definition(monkeypatch):
    monkeypatch.setattr(runs, "AT_ONCE", 90)
    rnd = random.Random(4)
    texts = [made(rnd) for _ in range(1500)]
    found, counts, kept = runs.search([" ".join(w) for w in texts])
    for w, own, n, text in zip(texts, found, counts, kept):
        expected = brute(w)
        gone = {i for s, length, q in expected for i in range(s + q, s + length)}
        assert (n, [tuple(r) for r in own.tolist()]) == (len(w), expected)
        assert text == " ".join(x for i, x in enumerate(w) if i not in gone)


@pytest.mark.parametrize("n", [5, 6, 7, 1000, 65_537])
def test_one_word_over_and_over(n):
    assert runs.find_runs(np.zeros(n, np.int64)).tolist() == ([[0, n, 1]] if n >= 6 else [])


def test_masking_keeps_every_word_of_a_run():
    rnd = random.Random(5)
    for _ in range(300):
        w = made(rnd)
        mask = runs.repeated(np.array([ord(c) for c in w], np.int64))
        assert all(mask[s : s + length].all() for s, length, _ in brute(w))


def test_query_on_corner_cases(spark):
    rnd = random.Random(6)
    rows = [(i, " ".join(made(rnd)) if i % 3 else " \n".join(f"w{k}" for k in range(i % 90))) for i in range(400)]
    rows += [(401, None), (402, ""), (403, " \t\n"), (None, "x " * 9), (7, rows[7][1]), (404, "é" * 50_000 + " a" * 20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = runs.op13(docs).collect()
    assert len(got) == len(rows) and got[0].asDict().keys() >= {"doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    edited = 0
    for (key, text), r in zip(rows, got):
        w = (text or "").split()
        h = zlib.crc32(str(key).encode())
        if key is not None and h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            edited += 1
        own = brute(w) if len(w) < 1000 else [(1, 20_000, 1)]
        best = min(own, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=(None, None, None))
        gone = {i for s, length, q in own for i in range(s + q, s + length)}
        assert r.doc_id == key and (r.n_runs, r.start, r.length, r.period) == (len(own), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if own else None)
        assert r.runs_sha256 == sha("".join(f"{s},{length},{q}\n" for s, length, q in own))
        assert r.collapsed_sha256 == sha(" ".join(x for i, x in enumerate(w) if i not in gone))
    assert edited > 20


def test_columns_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b " * 9, "mine", 2)], "doc_id long, text string, runs string, _n int")
    out = runs.periodic_runs(docs)
    assert sorted(out.columns) == sorted(["doc_id", "text", "_n", "n_words", "runs", "collapsed"])
    r = out.first()
    assert (r.doc_id, r._n, r.n_words, r.collapsed) == (1, 2, 18, "a b") and [tuple(x) for x in r.runs] == [(0, 18, 2)]
    assert runs.periodic_runs(docs.limit(0)).count() == 0
