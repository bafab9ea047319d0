"""Sharding, training order, mixing, near-duplicates, decontamination, repeated passages, the pipeline."""

import itertools
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from citegrid.llm import components, decontam, mixing, sharding, simhash, substring, tokens, training_order

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, l, s, len(t or "")) for i, t, l, s in rows], DOCS)


def prose(rnd, n, words=None):
    words = words or [f"{a}{b}" for a in "bdfgklmnprst" for b in ("a", "en", "il", "or", "us", "ex")]
    return " ".join(rnd.choice(words) for _ in range(n))


# --- sharding


@pytest.mark.parametrize("n,bits", [(2, 3), (3, 2), (1, 4)])
def test_hilbert_curve(spark, n, bits):
    names = [f"q{i}" for i in range(n)]
    df = spark.createDataFrame(list(itertools.product(range(2**bits), repeat=n)), names).withColumn("h", sharding.hilbert_index(names, bits))
    rows = sorted((r.h, tuple(r)[:n]) for r in df.collect())
    assert [h for h, _ in rows] == list(range(2 ** (n * bits)))
    assert all(sum(abs(a - b) for a, b in zip(x[1], y[1])) == 1 for x, y in zip(rows, rows[1:]))


def test_shards(spark, monkeypatch):
    monkeypatch.setattr(sharding, "LEAST_ROWS", 4)
    rows = [(i, f"text {i % 9}", "en" if i % 3 else None, f"s{i % 5}" if i % 7 else None) for i in range(201)] + [(7, "text 7", "en", "s2")] * 2 + [(None, None, None, None)]
    df = docs(spark, rows).withColumns({"shard": F.lit("old"), "_n": F.lit(1), "_u": F.lit(2), "slot": F.lit(3)})
    out = sharding.hilbert_shards(df, ["lang", "source", "n_chars"], 16).collect()
    assert len(out) == len(rows) and set(df.columns) | {"curve_index"} == set(out[0].asDict())
    by = {s: sorted(r.slot for r in out if r.shard == s) for s in range(16)}
    assert all(v == list(range(len(v))) for v in by.values()) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    order = [r.curve_index for r in sorted(out, key=lambda r: (r.shard, r.slot))]
    assert order == sorted(order)
    d = sharding.op3(docs(spark, rows)).filter("doc_id is null").first()
    assert d["size"] == 1 and d.text_crc32 == 0 and d.law == "rows" and d.grown_shard is None
    assert sharding.hilbert_shards(df.limit(0), ["lang", "n_chars"]).count() == 0


def test_steps_of_strings_look_at_whole_values(spark):
    """Names with a long common beginning part as well as short ones, and a value with a third of all rows has a step."""
    rows = [(i, "x", None, f"s{i % 40:02d}") for i in range(400)] + [(1000 + i, "x", None, "s07") for i in range(200)]
    short = docs(spark, rows)
    long = short.withColumn("source", F.concat(F.lit("https://a-long-name.example.org/" * 3), "source"))
    at = lambda df: {r.doc_id: r.curve_index for r in sharding.hilbert_shards(df, ["source", "n_chars"], 8).collect()}
    assert at(short) == at(long) and len(set(at(long).values())) >= 10
    bounds = sharding.string_bounds(long, "source", 16)
    counts, total, before, step, brute = {}, 600, 0, 0, []
    for r in rows:
        counts[r[3]] = counts.get(r[3], 0) + 1
    for v in sorted(counts):
        if before * 16 // total > step:
            step = before * 16 // total
            brute.append(v)
        before += counts[v]
    assert [b[-3:] for b in bounds] == brute
    assert sharding.string_bounds(long.limit(0), "source", 16) == []
    same = docs(spark, [(None, "t", "en", "s")] * 50 + [(7, "t", "en", "s")] * 50)
    assert sorted(r.slot for r in sharding.hilbert_shards(same, ["lang", "source"], 2).filter("shard = 0").collect()) == list(range(50))


def test_written_shards_prune(spark, tmp_path):
    df = docs(spark, [(i, "x" * (i % 50), "en" if i % 2 else "de", f"s{i % 4}") for i in range(400)])
    sharding.write_shards(sharding.hilbert_shards(df, ["lang", "source"], 8), str(tmp_path / "s"), 8)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == 400 and back.filter("lang = 'en'").select("shard").distinct().count() <= 5


# --- training order


@pytest.mark.parametrize("n", [1, 2, 3, 10, 257, 5000])
def test_feistel_is_a_permutation(n):
    p = training_order.feistel(np.arange(n), n)
    assert sorted(p.tolist()) == list(range(n))
    if n > 100:
        assert not np.array_equal(p, np.arange(n)) and not np.array_equal(p, training_order.feistel(np.arange(n), n, key=1))


def test_training_order(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tokens, "PIECE", 50)
    rnd = random.Random(1)
    rows = [(i, prose(rnd, rnd.randint(1, 90)), "en", "s") for i in range(40)] + [(50, None, "en", "s"), (51, "", "en", "s"), (52, "x" * 300, "en", "s"), (53, "same", None, None), (53, "same", None, None)]
    df, folder = docs(spark, rows).withColumn("part", F.lit(1)), str(tmp_path / "t")
    index = training_order.materialise(df, folder, length=16, rows=8, passes=3).collect()
    n = len(index)
    assert sorted(r.slot for r in index) == list(range(n)) and all(r.shard == r.slot // 8 and r.record == r.slot % 8 for r in index)
    ids = training_order.read_slots(folder, 0, n + 5, length=16, rows=8)
    assert len(ids) == n and all(zlib.crc32(ids[r.slot].tobytes()) == r.crc32 for r in index)
    encoding, end = tokens.encoding(tokens.vocabulary())
    for i, text, *_ in rows[:40] + [rows[42]]:
        parts = sorted((r.sequence, ids[r.slot][: r.n_tokens]) for r in index if r.doc_id == i)
        own = np.concatenate([p for _, p in parts]).tolist()
        assert own[-1] == end and own[:-1] == encoding.encode_ordinary(text)
    assert not {50, 51} & {r.doc_id for r in index} and sum(r.doc_id == 53 for r in index) == 2
    assert sorted(training_order.materialise(df, folder, length=16, rows=8, passes=3).collect()) == sorted(index)  # resumed
    assert np.array_equal(training_order.read_slots(folder, 5, 6, length=16, rows=8), ids[5:11])
    assert training_order.materialise(df.limit(0), str(tmp_path / "e")).count() == 0
    for other in ({"length": 32}, {"secret": 5}):
        with pytest.raises(ValueError, match="other documents or parameters"):
            training_order.materialise(df, folder, **({"length": 16, "rows": 8, "passes": 3} | other))
    with pytest.raises(ValueError, match="other documents or parameters"):
        training_order.materialise(df.filter("doc_id <> 3"), folder, length=16, rows=8, passes=3)
    monkeypatch.setattr(training_order, "PART_BYTES", 16)  # the order does not depend on how the work is parted
    assert sorted(training_order.materialise(df, str(tmp_path / "p"), length=16, rows=8, passes=2).collect()) == sorted(index)


# --- mixing


def test_mix(spark):
    rnd = random.Random(5)
    rows = [(i, "w " * rnd.randint(0, 30), "en", rnd.choice(["a", "b", "b", "b", "c", None])) for i in range(600)] + [(-1, None, "en", "a"), (600, "x", "en", "tiny")]
    df = docs(spark, rows).withColumns({"target": F.lit(1), "_place": F.lit(2), "size": F.lit(3)})
    out = mixing.mix(df).collect()
    sizes = {s: sum(len((t or "").split()) for _, t, _, q in rows if q == s) for s in ("a", "b", "c", "tiny", None)}
    names, total = ["a", "b", "c", "tiny", None], sum(sizes.values())
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    target, free = {}, set(names)
    while True:
        rest = total - sum(target.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            break
        target |= {s: 3 * sizes[s] for s in over}
        free -= set(over)
    target |= share
    of = {i: s for i, _, _, s in rows}
    for s in names:
        own = [r for r in out if of[r.doc_id] == s]
        assert all(abs(r.target - target[s]) < 1e-6 and r.source_size == sizes[s] for r in own)
        assert abs(sum(r.taken for r in own) - target[s]) <= 30 and all(r.taken <= 3 * r["size"] for r in own)
    assert sorted(map(tuple, out)) == sorted(map(tuple, mixing.mix(df.repartition(7)).collect()))
    mixed = mixing.apply_mix(df)
    assert mixed.columns == df.columns
    copies = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert all(r.taken == r["size"] * copies.get(r.doc_id, 0) for r in out if r["size"])
    assert mixing.mix(df.limit(0)).count() == 0
    assert all(r.taken == 0 for r in mixing.mix(df.withColumn("text", F.lit(None).cast("string"))).collect())


# --- near-duplicates


def test_fingerprint_brute():
    rnd = random.Random(2)
    for text in ["", "  ", "One two", "ÄB cd EF gh", prose(rnd, 4), prose(rnd, 57), "a a a a a a a"]:
        words = text.encode().lower().split()
        shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        fp = sum(1 << b for b in range(64) if 2 * sum(xxhash.xxh64_intdigest(s, seed=42) >> b & 1 for s in shingles) > len(shingles)) if shingles else 0
        assert simhash.fingerprint_of(text) == fp


def components_of(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        parent[find(a)] = find(b)
    groups = {}
    for x in list(parent):
        groups.setdefault(find(x), set()).add(x)
    return {x: min(g) for g in groups.values() for x in g}


def test_components(spark):
    rnd = random.Random(4)
    edges = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 40)] + [(rnd.randint(200, 260), rnd.randint(200, 260)) for _ in range(30)] + [(5, 5), (7, 8)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == components_of([e for e in edges if e[0] != e[1]])
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_ball_links_find_all_near_pairs(spark):
    rng = np.random.default_rng(7)
    base = rng.integers(0, 2**64, 40, dtype=np.uint64)
    points = [int(b) for b in base]
    for b in base:
        for d in (1, 2, 3, 4, 5, 6):
            x = int(b)
            for k in rng.choice(64, d, replace=False):
                x ^= 1 << int(k)
            points.append(x)
    points = sorted(set(points))
    signed = np.array(points, np.uint64).view(np.int64).tolist()
    links = simhash.ball_links(spark.createDataFrame([(x,) for x in signed], "fp long"), passes=4).collect()
    near = [(a, b) for a, b in itertools.combinations(points, 2) if bin(a ^ b).count("1") <= 4]
    got = [(r.a % 2**64, r.b % 2**64) for r in links]
    assert all(bin(a ^ b).count("1") <= 4 for a, b in got) and components_of(near) == components_of(got)


def test_near_duplicates(spark):
    rnd = random.Random(8)
    long = prose(rnd, 300)
    rows = [(10, long, "en", "s"), (3, long, "en", "s"), (11, long.replace(" ba ", " xx ", 1), "en", "s"), (12, prose(rnd, 200), "en", "s"), (13, None, None, None), (14, "", "en", "s"), (15, " \n", "en", "s"), (10, long, "en", "s")]
    df = docs(spark, rows).withColumn("_kept", F.lit("x"))
    got = sorted((r.doc_id, r.component_id, r.fingerprint) for r in simhash.near_duplicates(df).collect())
    fps = [simhash.fingerprint_of(t) for _, t, *_ in rows]
    expected = components_of([(rows[a][0], rows[b][0]) for a in range(len(rows)) for b in range(len(rows)) if (fps[a] ^ fps[b]).bit_count() <= 4])
    assert [(i, c) for i, c, _ in got] == sorted((r[0], expected[r[0]]) for r in rows)
    assert {f for i, _, f in got if i in (13, 14, 15)} == {"0" * 16}
    kept = simhash.drop_near_duplicates(df.withColumn("n", F.lit(1)))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(expected.values())) and kept.columns[-1] == "n"
    assert simhash.near_duplicates(df.limit(0)).count() == 0


# --- decontamination


def test_drop_near_duplicates_judges_rows(spark):
    rnd = random.Random(21)
    a, b, c = prose(rnd, 60), prose(rnd, 60), prose(rnd, 60)
    rows = [(5, a, "en", "s"), (5, b, "de", "s"), (2, b, "en", "t"), (None, c, "en", "s"), (None, c, "en", "s"), (9, c, "fr", "s"), (11, a, "en", "s"), (5, a, "en", "s")]
    df = docs(spark, rows).withColumns({"_key": F.lit(1), "fp": F.lit(2), "_own": F.lit(3)})
    kept = simhash.drop_near_duplicates(df)
    assert kept.columns == df.columns and sorted((r.doc_id, r.text) for r in kept.collect()) == sorted([(5, a), (2, b), (9, c)])
    assert simhash.drop_near_duplicates(df.limit(0)).count() == 0


def test_fingerprint_pieces(monkeypatch):
    rnd = random.Random(22)
    texts = [prose(rnd, n) for n in (1, 3, 4, 5, 50, 400)] + [" \n", "x" * 90 + " y", "a\tb\x0bc\r\nd  e f"]
    whole = [simhash.fingerprint_of(t) for t in texts]
    for size in (1, 5, 33, 100):
        monkeypatch.setattr(simhash, "PIECE", size)
        assert [simhash.fingerprint_of(t) for t in texts] == whole


def lcs_brute(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_lcs():
    rng = np.random.default_rng(0)
    for _ in range(200):
        a, b = rng.integers(0, 6, rng.integers(0, 20)), rng.integers(1, 6, rng.integers(1, 20))
        assert decontam.lcs(a, decontam._masks(b), len(b)) == lcs_brute(a.tolist(), b.tolist())


def test_leaks(spark):
    rnd = random.Random(9)
    words = [f"{a}{b}{c}" for a in "bdfgklmn" for b in "aeiou" for c in "lmnrst"]
    items = [(i, prose(rnd, n, words).capitalize() + ". " + prose(rnd, 6, words) + ".") for i, n in enumerate((8, 14, 22, 35, 50, 90))] + [(90, None), (91, ""), (92, "two words")]
    clean = [(i, prose(rnd, rnd.randint(1, 400), words), "en", "s") for i in range(60)]
    leaked = [(100 + i, prose(rnd, 130, words) + " " + t.upper() + "\n" + prose(rnd, 77, words), "en", "s") for i, t in items[:6]]
    para = items[3][1].split()
    for k in range(2, 30, 7):
        para[k] = "changed"
    extra = [(200, prose(rnd, 40, words) + " " + " ".join(para), "en", "s"), (201, None, "en", "s"), (202, "", "en", "s"), (203, items[2][1], "en", "s"), (203, items[2][1], "en", "s"), (None, items[2][1], "en", "s")]
    df = docs(spark, clean + leaked + extra).withColumns({"item_id": F.lit(1), "_leak": F.lit(2)})
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(df, bench).collect()}
    assert got == {(100 + i, i) for i in range(6)} | {(200, 3), (203, 2), (None, 2)}
    kept = decontam.drop_leaks(df, bench)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == set(range(60)) | {201, 202}
    assert decontam.leaks(df, bench.limit(0)).count() == 0 and decontam.leaks(df.limit(0), bench).count() == 0


def test_leaks_in_pieces_and_blocks(spark, monkeypatch):
    """Long texts in overlapping pieces, and a benchmark in blocks, find what one piece finds; short items are found word
    for word."""
    rnd = random.Random(19)
    words = [f"{a}{b}{c}" for a in "bdfgklmn" for b in "aeiou" for c in "lmnrst"]
    items = [(i, prose(rnd, rnd.randint(6, 80), words)) for i in range(12)] + [(20, "Two words"), (21, "three words here"), (22, "One"), (23, "?!")]
    texts = []
    for i in range(12):
        parts = [prose(rnd, rnd.randint(1, 900), words), items[i][1], prose(rnd, rnd.randint(1, 900), words), items[(i * 5 + 1) % 12][1]]
        texts.append((i, " ".join(parts), "en", "s"))
    texts += [(30, "So two words are no find here", "en", "s"), (31, "two, words!", "en", "s"), (32, "and three words here too", "en", "s"), (33, "three other words here", "en", "s"), (34, "one", "en", "s")]
    df, bench = docs(spark, texts), spark.createDataFrame(items, "item_id long, text string")
    read = lambda: {(r.doc_id, r.item_id): (r.start_word, r.window_words, round(r.lcs_share, 6)) for r in decontam.leaks(df, bench).collect()}
    whole = read()
    assert {(i, i) for i in range(12)} | {(i, (i * 5 + 1) % 12) for i in range(12)} | {(31, 20), (32, 21), (34, 22)} == set(whole)
    monkeypatch.setattr(decontam, "CHUNK", 128)
    assert read() == whole
    monkeypatch.setattr(decontam, "ITEMS", 5)
    assert set(read()) == set(whole)


def test_leaks_recall_of_paraphrases(spark):
    """Against an exhaustive search: every window of every text, the subsequence rule alone, no retrieval."""
    rnd = random.Random(23)
    words = [f"{a}{b}{c}" for a in "bdfgklmn" for b in "aeiou" for c in "lmnrst"]
    items = [(i, prose(rnd, rnd.randint(12, 60), words).capitalize() + ". " + prose(rnd, 5, words) + ".") for i in range(20)]
    texts = []
    for i in range(60):
        own = items[i % 20][1].split()
        changed = [rnd.choice(words) if rnd.random() < (i // 20) * 0.12 and k < len(own) - 5 else w for k, w in enumerate(own)]
        texts.append((i, prose(rnd, rnd.randint(20, 300), words) + " " + " ".join(changed) + " " + prose(rnd, rnd.randint(20, 300), words), "en", "s"))
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(docs(spark, texts), spark.createDataFrame(items, "item_id long, text string")).collect()}
    q = decontam.queries_of(items)
    true = set()
    for d, text, *_ in texts:
        own = np.array([q.vocabulary.get(w, 0) for w in decontam.terms_of(text)])
        for p in q.pieces:
            size = decontam.BLOCK * decontam.SIZES[p.group][1]
            for at in range(0, len(own), decontam.BLOCK):
                window = own[at : at + size]
                share = decontam.lcs(window, decontam._masks(p.terms), len(p.terms)) / len(p.terms)
                told = decontam.lcs(window, decontam._masks(p.answer), len(p.answer)) / max(1, len(p.answer))
                if share >= decontam.LCS_VERBATIM or (share >= decontam.LCS_PARAPHRASE and told >= decontam.ANSWER):
                    true.add((d, p.item_id))
    assert got <= true and len(got & true) >= 0.97 * len(true) and len(true) >= 55


# --- repeated passages


def test_compact_windows_brute():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n, t = int(rng.integers(1, 60)), int(rng.integers(1, 8))
        v = rng.integers(1, 25, n).astype(np.uint64)
        v[rng.random(n) < 0.05] = 0
        expected = set()
        for c in range(n):
            left = right = c
            while left > 0 and v[left - 1] > v[c]:
                left -= 1
            while right < n - 1 and v[right + 1] >= v[c]:
                right += 1
            if v[c] and right - left + 1 >= t:
                expected.add((left, c, right))
        assert set(zip(*(x.tolist() for x in substring.compact_windows(v, t)))) == expected


def test_repeated_passages(spark):
    rnd = random.Random(11)
    words = [f"{a}{b}{c}" for a in "bdfgklmnprst" for b in "aeiou" for c in "lmnrstx"]
    p = lambda n: prose(rnd, n, words)
    shared, short, near = p(60), p(30), p(80).split()
    changed = list(near)
    changed[40] = "other"
    rows = [(1, p(100) + " " + shared + " " + p(50)), (2, p(20) + " " + shared.upper()), (3, shared + "\n" + p(200)), (4, p(90) + " " + short), (5, short + " " + p(90)), (6, p(70) + " " + " ".join(near) + " " + p(9)), (7, " ".join(changed) + " " + p(70))]
    whole = p(120)
    rows += [(20, whole), (8, whole), (21, whole), (30, None), (31, ""), (32, short), (33, short), (8, whole)] + [(40 + i, p(150)) for i in range(20)]
    df = docs(spark, [(i, t, "en", "s") for i, t in rows]).withColumns({"tid": F.lit(1), "_key": F.lit(2)})
    out = substring.repeated_passages(df).collect()
    pairs = {(r.doc_id, r.other_doc_id) for r in out}
    assert components_of(pairs) == {1: 1, 2: 1, 3: 1, 6: 6, 7: 6, 8: 8, 20: 8, 21: 8}
    assert {(r.doc_id, r.other_doc_id, r.start_word, r.end_word) for r in out if r.is_copy} == {(20, 8, 0, 120), (21, 8, 0, 120), (8, 20, 0, 120)}
    assert {r.doc_id for r in out} == {1, 2, 3, 6, 7, 8, 20, 21}
    for r in out:
        if not r.is_copy and {r.doc_id, r.other_doc_id} <= {1, 2, 3}:
            text = {i: t.lower().split() for i, t in rows if t}
            assert text[r.doc_id][r.start_word : r.end_word] == text[r.other_doc_id][r.other_start : r.other_end] and r.end_word - r.start_word >= 60
    assert all(r.jaccard >= 0.8 for r in out)
    assert substring.repeated_passages(df.limit(0)).count() == 0


def test_pairs_do_not_depend_on_batches():
    import pyarrow as pa

    rng = np.random.default_rng(3)
    rows = np.sort(np.array([(k, s, t, c) for k in range(5) for s in range(2) for t in range(4) for c in range(3) if rng.random() < 0.6], dtype=[("k", "i8"), ("s", "i2"), ("t", "i8"), ("c", "i4")]))
    whole = pa.RecordBatch.from_arrays([pa.array(rows[n]) for n in "kstc"] + [pa.array(np.full(len(rows), 9, np.int32))] * 2, ["key", "side", "tid", "c", "before", "after"])
    read = lambda size: sorted(tuple(x.values()) for b in substring._pairs(iter([whole.slice(i, size) for i in range(0, len(rows), size)])) for x in b.to_pylist())
    assert read(1) == read(4) == read(1000) and read(1)
    # each window is paired with the first of its key and with the first of its side, if these are other texts
    made = {(r[2], r[0], r[1]) for r in read(1000)}
    for k in range(5):
        group = [r for r in rows.tolist() if r[0] == k]
        for r in group:
            for other in (group[0], next(x for x in group if x[1] == r[1])):
                assert other[2] == r[2] or (k, other[2], r[2]) in made


def test_salted_windows_stay_linked():
    rng = np.random.default_rng(5)
    key, side = rng.integers(0, 6, 400).astype(np.uint64) ** 3, rng.integers(0, 4, 400).astype(np.int16)
    tid = rng.integers(0, 50, 400)
    row, new = substring.salted(key, side, tid, 77)
    assert set(row.tolist()) == set(range(400))
    groups = {}
    for r, k in zip(row.tolist(), new.tolist()):
        groups.setdefault(k, set()).add(r)
    pairs = {(r, next(iter(g))) for g in groups.values() for r in g}
    root = components_of(pairs | {(r, r) for r in range(400)})
    assert all(root[i] == root[j] for i in range(400) for j in range(400) if key[i] == key[j])  # the group of all still links every window of a key
    assert max(map(len, groups.values())) < 60


def test_first_and_last_places_cover_all():
    rng = np.random.default_rng(6)
    m = substring.MIN_SHINGLES
    key, at = rng.integers(0, 3, 500), np.sort(rng.choice(2000, 500, replace=False))
    kept = substring.first_and_last(key, at)
    cover = lambda rows: {(k, q) for k, p in zip(key[rows].tolist(), at[rows].tolist()) for q in range(p, p + m)}
    assert cover(kept) == cover(np.arange(500)) and len(kept) <= 2 * 3 * (2000 // m + 1) < 500


def test_unsure_places():
    rng = np.random.default_rng(4)
    m, h = substring.MIN_SHINGLES, substring.HASHES
    windows = [(f, *w) for f in range(h) for w in zip(*(x.tolist() for x in substring.compact_windows(rng.permutation(300).astype(np.uint64) + np.uint64(1))))]
    some = np.array([w for w in windows if rng.random() < 0.8])
    depth = [sum(l <= p and p <= c < p + m and p + m - 1 <= r for _, l, c, r in some.tolist()) for p in range(300 - m + 1)]
    assert {p for s, e in substring.unsure(some) for p in range(s, e + 1)} == {p for p, n in enumerate(depth) if n > h - substring.NEED}
    x = rng.integers(1, 1 << 63, 100).astype(np.uint64)
    twice = substring.run_hashes(np.concatenate([x, x]))
    assert (twice[: 100 - m + 1] == twice[100:]).all() and len(set(twice[:100].tolist())) == 100 and not len(substring.run_hashes(x[: m - 1]))


def test_passages_around_a_frequent_line(spark):
    """Every run of 50 words that two texts share, found by brute force, is within a passage, though 40 are in all texts."""
    rnd = random.Random(13)
    words = [f"{a}{b}{c}" for a in "bdfgklmnprst" for b in "aeiou" for c in "lmnrstx"]
    p = lambda n: prose(rnd, n, words)
    line, texts = p(40), []
    for _ in range(40):
        before, after = p(10), p(10)
        texts += [f"{p(30)} {before} {line} {after} {p(30)}" for _ in range(2)]
    texts += [f"{p(30)} {line} {p(30)}" for _ in range(100)]
    rnd.shuffle(texts)
    out = substring.repeated_passages(docs(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])).collect()
    spans = {}
    for r in out:
        spans.setdefault((r.doc_id, r.other_doc_id), []).append((r.start_word, r.end_word))
    places = {}
    for i, t in enumerate(texts):
        own = t.split()
        for at in range(len(own) - 49):
            places.setdefault(" ".join(own[at : at + 50]), []).append((i, at))
    both = {(i, j, at, to) for found in places.values() for i, at in found for j, to in found if i < j}
    assert len({x[:2] for x in both}) == 40
    held = lambda i, j, at: any(s <= at and at + 50 <= e for s, e in spans.get((i, j), []))
    assert all(held(i, j, at) or held(j, i, to) for i, j, at, to in both)


@pytest.mark.parametrize("edits", [0.0, 0.005, 0.01, 0.02])
def test_passages_recall_against_all_pairs(spark, edits):
    """Families of near copies, a line in all texts and one in half of them: all pairs of texts are compared by brute force.

    What must be found: every word that lies in a passage which another text has too, reported under its own text; and a
    chain of links between any two texts with a common passage.
    """
    rnd = random.Random(int(edits * 1000) + 3)
    words = [f"{a}{b}{c}" for a in "bdfgklmnprst" for b in "aeiou" for c in "lmnrstx"]
    p = lambda n: prose(rnd, n, words)
    line, half, texts = p(30), p(45), []
    for _ in range(12):
        seed = p(rnd.randint(55, 140)).split()
        at = rnd.randint(10, 40)
        seed[at:at] = line.split()
        for _ in range(rnd.choice((2, 5, 12, 25))):
            own = [rnd.choice(words) if rnd.random() < edits else w for w in seed]
            texts.append(f"{p(rnd.randint(0, 60))} {' '.join(own)} {p(rnd.randint(0, 60))}" + (f" {half} {p(5)}" if rnd.random() < 0.5 else ""))
    rnd.shuffle(texts)
    hashes = [substring.shingle_hashes(h) for h in substring.hash_words(texts)]
    sets = [set(h.tolist()) for h in hashes]
    true, spans = set(), {}
    for i, j in itertools.combinations(range(len(texts)), 2):
        if len(sets[i] & sets[j]) < 20:
            continue
        shifts = {}
        for y, v in enumerate(hashes[j].tolist()):
            for x in np.flatnonzero(hashes[i] == v).tolist():
                shifts.setdefault(y - x, (x, y))
        region = [0, len(hashes[i]) - 1, 0, len(hashes[j]) - 1] + [c for xy in shifts.values() for c in xy]
        for a, b, c, d, _ in substring.passages(hashes[i], hashes[j], region):
            true.add((i, j))
            spans.setdefault(i, set()).update(range(a, b))
            spans.setdefault(j, set()).update(range(c, d))
    out = substring.repeated_passages(docs(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])).collect()
    held = {}
    for r in out:
        x, y = set(hashes[r.doc_id][r.start_word : r.end_word - 4].tolist()), set(hashes[r.other_doc_id][r.other_start : r.other_end - 4].tolist())
        assert len(x & y) / len(x | y) >= 0.8 and min(r.end_word - r.start_word, r.other_end - r.other_start) >= 50
        held.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
    covered = sum(len(v & held.get(i, set())) for i, v in spans.items()) / sum(map(len, spans.values()))
    root = components_of({(r.doc_id, r.other_doc_id) for r in out} | {(i, i) for i in range(len(texts))})
    linked = sum(root[i] == root[j] for i, j in true) / len(true)
    print(f"edits {edits}: {len(texts)} texts, {len(true)} pairs; words covered {covered:.4f}, pairs linked {linked:.4f}, texts named {len(set(held) & set(spans)) / len(spans):.4f}")
    assert covered >= 0.97 and linked >= 0.97 and len(set(held) & set(spans)) >= 0.97 * len(spans)


# --- the pipeline


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rnd = random.Random(12)
    words = {"en": [f"{a}{b}" for a in "thwhsh" for b in ("e", "at", "ing", "ed")], "de": [f"{a}{b}" for a in "schz" for b in ("ung", "heit", "ein", "ü")]}
    rows = [(i, prose(rnd, rnd.randint(30, 200), words[l]), l, f"s{i % 3}") for i, l in enumerate(rnd.choice(["en", "de"]) for _ in range(120))]
    item = " ".join(f"{x}{y}" for x in "qvkp" for y in ("alu", "eru", "imo", "obu", "uxa", "aze", "ego", "inu"))
    rows += [(200, rows[0][1], rows[0][2], "s1"), (201, "12 -- 34", "en", "s0"), (202, None, None, None), (203, prose(rnd, 60, words["en"]) + " " + item, "en", "s0")]
    docs(spark, rows).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "decontaminate", "mix_sources", "shard"]
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r.doc_id for r in out}
    assert not ids & {200, 201, 202, 203} and len(ids) > 80
    step = docs(spark, rows)
    for name, stage in corpus_pipeline.STAGES[:3]:
        step = stage(spark, step, str(tmp_path))
        assert step.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert {r.doc_id for r in step.collect()} == set(range(120))
    by = {s: sorted(r.slot for r in out if r.shard == s) for s in {r.shard for r in out}}
    assert all(v == list(range(len(v))) for v in by.values())


def test_pipeline_corner_cases(spark, tmp_path):
    """Empty tables, nulls in every column, repeated rows, a long text, extra columns with clashing names."""
    import corpus_pipeline

    rnd = random.Random(31)
    words = [f"{a}{b}" for a in "thwhsh" for b in ("e", "at", "ing", "ed")]
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(i, prose(rnd, 60, words), "en", f"s{i % 2}") for i in range(20)] + [(None, prose(rnd, 60, words), "en", None), (3, None, None, None), (4, prose(rnd, 60_000, words), None, "s1"), (5, "", "en", "s0")]
    df = docs(spark, rows + rows[:3]).withColumns({"_key": F.lit(1), "_tid": F.lit("t"), "slot": F.lit(2), "_own": F.lit(3), "lang_pred": F.lit("p")})
    for data in (df, df.limit(0)):
        step = data
        for name, stage in corpus_pipeline.STAGES[:-1]:
            step = stage(spark, step, str(tmp_path))
            assert step.columns == df.columns, name
        out = corpus_pipeline.STAGES[-1][1](spark, step, str(tmp_path)).collect()
        assert {"shard", "slot", "_key", "lang_pred"} <= set(out[0].asDict()) if out else data is not df
    assert out == []
