"""Fingerprints: sketches and their peeling against sets, the order of documents against sorting."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from citegrid.llm import fingerprints


def paragraphs(text):
    out = []
    for line in (text or "").split("\n"):
        out += re.findall(r"[^.!?]*[.!?]+|[^.!?]+", line) if len(line) > fingerprints.LONG_LINE else [line]
    return {p.strip(" \t\n\v\f\r") for p in out} - {""}


def alike(a, b):
    a, b = paragraphs(a), paragraphs(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_differences_are_those_of_sets(spark):
    """All sizes of differences, most of them too large for the first sketch, and sides that are empty or null."""
    rnd = random.Random(1)
    rows = []
    for i, (shared, a, b) in enumerate([(0, 0, 0), (5, 0, 0), (0, 1, 0), (0, 0, 1), (3, 1, 1), (0, 40, 2), (9, 2, 40), (500, 3, 4), (20, 700, 900), (2000, 0, 1)] + [(rnd.randint(0, 30), rnd.randint(0, 30), rnd.randint(0, 30)) for _ in range(60)]):
        keys = rnd.sample(range(1 << 60), shared + a + b)
        rows.append((i, keys[: shared + a], keys[:shared] + keys[shared + a :]))
    rows.append((900, None, [5]))
    got = {r.id: (sorted(r.only_a), sorted(r.only_b)) for r in fingerprints.differences(spark.createDataFrame(rows, "id long, a array<long>, b array<long>"), ["id"]).collect()}
    for i, a, b in rows:
        a, b = set(a or ()), set(b)
        assert got.get(i, ([], [])) == (sorted(a - b), sorted(b - a))


def test_sketches_subtract(spark):
    """The cells of the difference of two sketches are those of the sketch of the difference."""
    rnd = random.Random(2)
    a, b = rnd.sample(range(1 << 60), 30), rnd.sample(range(1 << 60), 10)
    rows = spark.createDataFrame([(1, 3, a + b), (2, 3, b), (3, 3, a)], "id long, level int, keys array<long>")
    cells = {(r.id, r.tab, r.place): (r.n, r.key, r.chk) for r in fingerprints.sketches(rows, ["id"]).collect()}
    for t in range(3):
        for p in range(8):
            x, y, z = (cells.get((i, t, p), (0, 0, 0)) for i in (1, 2, 3))
            assert (x[0] - y[0], x[1] ^ y[1], x[2] ^ y[2]) == z


@pytest.mark.parametrize("rows_in_range", [1 << 10, 4, 1])
def test_next_document(spark, monkeypatch, rows_in_range):
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", rows_in_range)
    rnd = random.Random(3)
    rows = [(rnd.randint(-50, 50) * 3, f"text {i}") for i in range(80)] + [(7, f"of seven {i}") for i in range(60)] + [(None, f"no key {i}") for i in range(20)] + [(7, "same"), (7, "same"), (8, None)]
    got = fingerprints.with_next(spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit("old")).repartition(5), "doc_id", "text").collect()
    assert len(got) == len(rows) == len({r.id for r in got})
    order = sorted(got, key=lambda r: r.id)
    assert [r.next_text for r in order] == [r.text for r in order[1:] + order[:1]]
    keys = [r.doc_id for r in order]
    assert keys == sorted(keys, key=lambda k: (k is None, -(k or 0)))
    one = spark.createDataFrame([(5, "alone")], "doc_id long, text string")
    assert fingerprints.with_next(one, "doc_id", "text").first().next_text == "alone"
    assert fingerprints.with_next(one.limit(0), "doc_id", "text").count() == 0


def test_query_on_corner_cases(spark):
    rnd = random.Random(4)
    words = ["of", "tree.", "house", "many!", "é", "\n", "is", "light?"]
    rows = [(i, " ".join(rnd.choice(words) for _ in range(rnd.choice([0, 1, 3, 40, 400])))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, " \n\t"), (103, "same.\n" * 3000), (104, "\n".join(f"line {i}" for i in range(3000))), (105, rows[9][1]), (106, rows[9][1]), (107, "\U0001f600" * 301)]
    got = {r.doc_id: r for r in fingerprints.op12(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == len(rows)
    order = sorted(rows, reverse=True)
    prints = {}
    for (key, text), (_, following) in zip(order, order[1:] + order[:1]):
        text, following, r = text or "", following or "", got[key]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(r.near_edited - alike(text, edited)) < 1e-12 and abs(r.near_next - alike(text, following)) < 1e-12
        for t, p in ((text, r.fingerprint), (edited, r.edited_fingerprint)):
            assert prints.setdefault(t, p) == p
    assert len(set(prints.values())) == len(prints)


def test_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "one.\ntwo.", "two.\nthree.", "x", 5), (2, None, "", "y", 6)], "id long, a string, b string, likeness string, tab int")
    out = {r.id: r for r in fingerprints.compare_texts(df, "id", ["a", "b"]).collect()}
    assert set(out[1].asDict()) == {"id", "tab", "fingerprints", "only_first", "only_other", "likeness"}
    assert out[1].likeness == [1 / 3] and len(out[1].only_first[0]) == len(out[1].only_other[0]) == 1 and out[1].tab == 5
    assert out[2].likeness == [1.0] and out[2].only_first == [[]] and out[2].fingerprints[0] == out[2].fingerprints[1]
    assert fingerprints.compare_texts(df.limit(0), "id", ["a", "b"]).count() == 0
