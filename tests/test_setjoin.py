"""The similarity join of token sets, and the candidate search on it, against all pairs."""

import random

import pytest

from citegrid.operators import linkage, setjoin


def dice(a, b):
    return 2 * len(a & b) / (len(a) + len(b)) if a and b else 0.0


def sets(rnd, n, common=6, rare=400):
    """Sets of some common and some rare tokens, near copies among them."""
    out = []
    for _ in range(n):
        s = {f"c{rnd.randint(1, common)}" for _ in range(rnd.randint(0, 5))} | {f"r{rnd.randint(1, rare)}" for _ in range(rnd.randint(0, 9))}
        if out and rnd.random() < 0.4:
            s = set(rnd.choice(out))
            for _ in range(rnd.randint(0, 3)):
                s ^= {f"r{rnd.randint(1, rare)}"}
        out.append(s)
    return out


@pytest.mark.parametrize("least", [0.05, 0.3, 0.5, 2 / 3, 0.8, 1.0])
@pytest.mark.parametrize("part", [2048, 3])
def test_no_pair_is_lost(spark, monkeypatch, least, part):
    monkeypatch.setattr(setjoin, "PART_SETS", part)
    rnd = random.Random(int(least * 100))
    a, b = sets(rnd, 90), sets(rnd, 70)
    frame = lambda x: spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(x)] + [(len(x), None)], "id long, tokens array<string>")
    got = [tuple(r) for r in setjoin.candidates(frame(a), frame(b), least).collect()]
    true = {(i, j) for i, x in enumerate(a) for j, y in enumerate(b) if dice(x, y) >= least}
    assert len(got) == len(set(got)) and true <= set(got)
    alone = [tuple(r) for r in setjoin.candidates(frame(a), None, least).collect()]
    true = {(i, j) for i, x in enumerate(a) for j, y in enumerate(a) if i < j and dice(x, y) >= least}
    assert len(alone) == len(set(alone)) and true <= set(alone) and all(i < j for i, j in alone)


def test_bounds_keep_few_others(spark):
    """Tokens that all sets have bring no pairs of sets that differ in the rest."""
    rows = [(i, ["a", "b", "c", *[f"r{i}-{k}" for k in range(8)]]) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, tokens array<string>")
    assert setjoin.candidates(df, None, 0.5).count() == 0


@pytest.mark.parametrize("least", [0, -1, 1.1])
def test_least_must_be_a_share(spark, least):
    with pytest.raises(ValueError):
        setjoin.candidates(spark.createDataFrame([], "id long, tokens array<string>"), None, least)


@pytest.mark.parametrize("k,least", [(1, 0.5), (3, 0.5), (20, 0.3), (99, 0.7)])
def test_search_is_that_of_all_titles(spark, k, least):
    rnd = random.Random(k)
    records = [(f"k{i}", " ".join(sorted(s))) for i, s in enumerate(sets(rnd, 60))] + [("none", None), ("blank", " ")]
    held = [(i, " ".join(sorted(s))) for i, s in enumerate(sets(rnd, 80))] + [(900, None)]
    held += [(1000 + i, t) for i, (_, t) in enumerate(records[:20])]
    r = spark.createDataFrame([(e, t, "A") for e, t in records], "entry_key string, title string, author string")
    p = spark.createDataFrame([(i, t, "A") for i, t in held], "id long, title string, author string")
    got = {}
    for x in linkage.search(r, p, k, least).collect():
        got.setdefault(x.entry_key, []).append((x["rank"], x.shared, x.id))
    for key, title in records:
        a = set((title or "").split())
        near = sorted((-len(a & set(t.split())), i) for i, t in held if t and dice(a, set(t.split())) >= least)
        assert sorted(got.get(key, [])) == [(n, -s, i) for n, (s, i) in enumerate(near[: min(k, 20)], 1)]


@pytest.mark.parametrize("buckets", [1, 7])
def test_tokens_that_share_a_bucket_lose_no_pair(spark, monkeypatch, buckets):
    monkeypatch.setattr(setjoin, "BUCKETS", buckets)
    x = sets(random.Random(buckets), 90)
    got = {tuple(r) for r in setjoin.candidates(spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(x)], "id long, tokens array<string>"), None, 0.6).collect()}
    assert {(i, j) for i, a in enumerate(x) for j, b in enumerate(x) if i < j and dice(a, b) >= 0.6} <= got


def test_sets_that_share_their_last_tokens_do_not_meet(spark):
    """A shared token with too few behind it can't be the first of enough, however full the bitmaps."""
    rows = [(i, [*[f"c{k}" for k in range(300)], *[f"r{i}-{k}" for k in range(300)]]) for i in range(30)]
    df = spark.createDataFrame(rows, "id long, tokens array<string>")
    assert setjoin._met(df, None, 0.6).count() == 0


@pytest.mark.parametrize("rows", [7, 10000])
def test_pairs_of_large_sets_and_of_small_batches(spark, monkeypatch, rows):
    """Neither the larger bitmap nor sets of a token that come in several batches lose a pair."""
    monkeypatch.setattr(setjoin, "WIDE_FROM", 8)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    try:
        x = sets(random.Random(rows), 120, 20, 60)
        frame = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(x)], "id long, tokens array<string>")
        got = {tuple(r) for r in setjoin.candidates(frame, None, 0.5).collect()}
        both = {tuple(r) for r in setjoin.candidates(frame, frame, 0.5).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    true = {(i, j) for i, a in enumerate(x) for j, b in enumerate(x) if dice(a, b) >= 0.5}
    assert true <= both and {(i, j) for i, j in true if i < j} <= got


def test_large_sets_that_share_a_third_do_not_meet(spark):
    """512 bits are too full to part sets of 150 tokens."""
    rows = [(i, [*[f"c{k}" for k in range(50)], *[f"r{(i * 37 + k * 11) % 3000}-{k}" for k in range(100)]]) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, tokens array<string>")
    assert setjoin._met(df, None, 0.5).count() == 0


def family(n):
    """A title with copies, near copies of it (with other words, or some left out), and titles without a relative."""
    rnd = random.Random(n)
    words = [f"w{i}" for i in range(60)]
    titles = [" ".join(words)] * 4
    for i in range(n):
        kept = words[: rnd.choice([60, 60, 60, 40])]
        for k in range(rnd.randint(1, 4)):
            kept[rnd.randrange(len(kept))] = f"x{i}k{k}" if rnd.random() < 0.8 else f"y{rnd.randint(1, 3)}"
        titles.append(" ".join(kept))
    return titles + [f"alone{i} a{i} b{i}" for i in range(20)]


def test_near_copies_are_searched_without_all_their_pairs(spark, monkeypatch):
    """The best of a group of near copies are found, and it does not take all pairs of the group."""
    titles = family(200)
    looked = []
    close = setjoin._close
    monkeypatch.setattr(setjoin, "_close", lambda *a: looked.append(close(*a)) or looked[-1])
    r = spark.createDataFrame([(f"k{i}", t, "A") for i, t in enumerate(titles)], "entry_key string, title string, author string")
    p = spark.createDataFrame([(f"p{i:03}", t, "A") for i, t in enumerate(titles)], "id string, title string, author string")
    got = {(x.entry_key, x["rank"], x.shared, x.id) for x in linkage.search(r, p, 3).collect()}
    true = set()
    for i, t in enumerate(titles):
        a = set(t.split())
        near = sorted((-len(a & set(u.split())), f"p{j:03}") for j, u in enumerate(titles) if dice(a, set(u.split())) >= 0.5)
        true |= {(f"k{i}", n, -s, j) for n, (s, j) in enumerate(near[:3], 1)}
    assert got == true
    assert looked[0].count() < 200 * 20  # of some 40,000


def test_settled_steps_are_read_from_their_table(spark):
    from citegrid.storage import settled

    df = spark.range(50).selectExpr("id % 3 AS g").groupBy("g").count()
    out = settled(df, "step")
    assert sorted(map(tuple, out.collect())) == [(0, 17), (1, 17), (2, 16)]
    assert "Exchange" not in out._jdf.queryExecution().toString()
