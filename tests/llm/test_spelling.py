"""Spelling variants: the trie and the table against brute force."""

import random
import zlib

import pytest

from citegrid.llm import spelling


def one_apart(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :]
    a, b = sorted((a, b), key=len)
    return a[i:] == b[i + 1 :]


def brute(counts):
    """word -> (form, root, n, n_near, form_n) by comparing all pairs."""
    near = {w: [x for x in counts if one_apart(w, x)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * counts[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {w: (form[w], root(w), counts[w], len(near[w]), counts[form[w]] if form[w] is not None else None) for w in counts}


def test_trie_finds_each_neighbour_once():
    rnd = random.Random(2)
    for turn in range(1500):
        letters = "abé"[: rnd.randint(1, 3)]
        words = sorted({"".join(rnd.choice(letters) for _ in range(rnd.randint(turn % 2, 6))) for _ in range(rnd.randint(1, 30))})
        trie = spelling.Trie.loaded(spelling.Trie.of(words, list(range(1, len(words) + 1))).dumped())
        for w in [*words, "abé", "bbbbbbb"]:
            assert sorted(trie.near(w)) == [(x, i) for i, x in enumerate(words, 1) if one_apart(w, x)]


@pytest.mark.parametrize("shard_words,pass_bytes", [(1 << 17, 1 << 25), (7, 400), (1, 1)])
def test_passes_and_shards_change_nothing(spark, shard_words, pass_bytes):
    rnd = random.Random(3)
    counts = {}
    for _ in range(60):
        counts["".join(rnd.choice("abcé") for _ in range(rnd.randint(1, 5)))] = rnd.randint(1, 9)
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = {r.word: (r.n_near, r.best, r.best_n) for r in spelling.neighbours(df, shard_words, pass_bytes).collect()}
    for w in counts:
        near = [x for x in counts if one_apart(w, x)]
        best = min(near, key=lambda x: (-counts[x], x), default=None)
        assert got[w] == (len(near), best, counts.get(best, 0))
    assert len(got) == len(counts)


def test_variants_against_brute_force(spark):
    rnd = random.Random(4)
    counts = {"": 2, "x" * 300: 1, "x" * 301: 5}
    for k in range(9):  # a long chain: each form has twice the count
        counts["a" * k + "b" * (9 - k)] = 3 << k
    for _ in range(150):
        counts["".join(rnd.choice("abcdé") for _ in range(rnd.randint(1, 5)))] = rnd.choice([1, 1, 2, 3, 8, 20])
    rows = [(w, n, "x") for w, n in counts.items()] + [(None, 9, "x"), ("gone", 0, "x"), ("gone too", None, "x")]
    rows += [("twice", 1, "x"), ("twice", 2, "y")]
    df = spark.createDataFrame(rows, "word string, n long, form string")
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.spelling_variants(df).collect()}
    assert got == brute(counts | {"twice": 3})
    assert got["b" * 9][1] == "a" * 8 + "b"
    assert spelling.spelling_variants(df.limit(0)).count() == 0


def test_query_against_brute_force(spark):
    rnd = random.Random(5)
    words = ["Straße", "HOUSE", "house", "houses", "mouse", "ÉCOLE", "École", "element", "elements", "tree", "x" * 40]
    rows = [(i, " ".join(rnd.choice(words) + rnd.choice(["", ",", "1", "\n", "_"]) for _ in range(200))) for i in range(150)]
    rows += [(None, "house " * 5), (900, None), (901, ""), (902, "12 --"), (3, rows[3][1])]
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.op11(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    counts = {}
    for key, text in rows:
        run = ""
        for c in (text or "") + " ":
            if c.isascii() and c.isalpha() or "À" <= c <= "ÿ":
                run += c.lower() if c.isascii() else c
                continue
            if run:
                h = zlib.crc32(f"{key}:{run}".encode()) if key is not None else 1
                w = run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]
                counts[w] = counts.get(w, 0) + 1
            run = ""
    counts = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    assert got == brute(counts) and any(v[0] for v in got.values())
