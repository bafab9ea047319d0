"""Joint commits of bibliography and ledger, decisions of people, and BibTeX files whose values hold entries."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from citegrid.operators import ledger, lifecycle, proposals
from citegrid.sources import bibtex
from citegrid.sources import ledger as store

NODE = "entry_type string, entry_key string, fields map<string,string>"


def test_an_edit_from_outside_stops_a_commit(spark, tmp_path):
    folder = str(tmp_path / "ledger")
    rows = lambda year: spark.createDataFrame([("misc", "k", {"title": "A", "year": year}), ("misc", "m", {"title": "B"})], NODE)
    to = lambda records, at: lambda state, _: (records, lifecycle.sync(state, records, "me", at))
    assert lifecycle.commit_edit(spark, folder, to(rows("1"), 1)) == 1
    with pytest.raises(lifecycle.OutOfSync, match="synchronise"):
        lifecycle.commit_edit(spark, folder, to(rows("3"), 2), lambda: rows("2"))
    reads = iter([rows("1"), rows("2")])
    with pytest.raises(lifecycle.OutOfSync, match="retry"):
        lifecycle.commit_edit(spark, folder, to(rows("3"), 2), lambda: next(reads))

    def overtaken(state, records):
        lifecycle.commit_edit(spark, folder, to(rows("5"), 2))
        return rows("3"), lifecycle.sync(state, rows("3"), "me", 3)

    with pytest.raises(lifecycle.OutOfSync, match="changed since"):
        lifecycle.commit_edit(spark, folder, overtaken)
    both = store.load(spark, folder)
    assert {r.fields["year"] for r in both["records"].collect() if r.entry_key == "k"} == {"5"} and both["revisions"].count() == 1


def test_hash_of_a_bibliography_knows_no_order(spark):
    a = spark.createDataFrame([("misc", "k", {"a": "1", "b": "2"}), ("misc", "m", {"c": "3"}), ("misc", "m", {"c": "3"})], NODE)
    assert lifecycle.bibliography_hash(a) == lifecycle.bibliography_hash(a.repartition(3)) != lifecycle.bibliography_hash(a.limit(2))
    assert lifecycle.bibliography_hash(a.limit(0)) == "0:0:0"


def test_what_people_decide(spark):
    records = spark.createDataFrame([("misc", k, {"title": k}) for k in "abcd"], NODE)
    state = lifecycle.sync(lifecycle.empty(spark), records, "me", 1)
    changes = spark.createDataFrame([(k, "misc", {"title": k.upper()}) for k in "abcd"], "target string, entry_type string, fields map<string,string>")
    other = spark.createDataFrame([("d", "misc", {"title": "again"})], "target string, entry_type string, fields map<string,string>")
    state["proposals"] = proposals.create(records, changes, "x", "r", 2).unionByName(proposals.create(records, other, "x", "s", 2))
    now = records.filter("entry_key <> 'b'").unionByName(spark.createDataFrame([("misc", "b", {"title": "edited"})], NODE))
    wanted = state["proposals"].select("id", (F.col("target") != "c").alias("adopt"), F.lit(" Alice ").alias("reviewer")).unionByName(spark.createDataFrame([("proposal:none", True, None)], "id string, adopt boolean, reviewer string"))
    out, after, outcome = lifecycle.decide_proposals(state, now, wanted, 9)
    by = {r.id: r.target for r in state["proposals"].collect()}
    got = sorted((by.get(r.id, ""), r.outcome, r.error) for r in outcome.collect())
    assert got == [("", None, "proposal not found"), ("a", "adopted", None), ("b", None, "proposal is stale"), ("c", "rejected", None), ("d", None, "several proposals for one record"), ("d", None, "several proposals for one record")]
    fields = {r.entry_key: r.fields for r in out.collect()}
    assert fields["a"]["title"] == "A" and fields["a"]["bibapprovalreviewer"] == "Alice" and fields["b"] == {"title": "edited"} and fields["c"] == {"title": "c"}
    entry = after["entries"].filter("entry_key = 'a'").first()
    assert entry.approval.content_hash == entry.content_hash and entry.approval.kind == "human"
    assert lifecycle.errors(after | {"proposals": after["proposals"].filter("target in ('a', 'c')")}).count() == 0
    again = lifecycle.decide_proposals(after, out, wanted.filter("adopt"), 10)[2].filter("error = 'proposal has already been decided'")
    assert {by[r.id] for r in again.collect()} == {"a"}


def test_differences_from_a_revision(spark):
    rows = lambda *r: spark.createDataFrame([("misc", k, f) for k, f in r], NODE)
    first = lifecycle.sync(lifecycle.empty(spark), rows(("k", {"a": "1", "b": "2"}), ("m", {"a": "1"})), "me", 1)
    state = lifecycle.sync(first, rows(("k", {"a": "1", "c": "3"})), "me", 2)
    wanted = state["revisions"].select(F.substring("id", 5, 8).alias("prefix")).unionByName(spark.createDataFrame([("ffffffffffff",)], "prefix string"))
    got = {(r.entry_key, r.field, r.old, r.new, r.error is None) for r in lifecycle.history_diff(state, wanted, rows(("k", {"a": "1", "c": "3"}))).collect()}
    assert got == {("k", "b", "2", None, True), ("k", "c", None, "3", True), ("m", None, None, None, False), (None, None, None, None, False)}


BIB = """% a comment
@string{ a = {Acta} } @string{B = a # { Math}}
@article{one, journal = b, note = {see
@book{inner, title = {x}}
@ home}, month = jan}
@string{b = {Later}}
@article{two, journal = B, abstract = "first
@misc{no, a = {b}}
last"}
@article(three, journal = a, note = {round
@misc(x)})
"""


@pytest.mark.parametrize("copies", [1, 40])
def test_lines_that_begin_with_at_and_macros_in_order(spark, tmp_path, copies):
    for i in range(copies):
        (tmp_path / f"f{i}.bib").write_text(BIB.replace("one", f"one{i}").replace("two", f"two{i}").replace("three", f"three{i}") if i % 2 == 0 else f"@misc{{plain{i}, title = {{t}}}}\n")
    got = {r.entry_key: (r.entry_type, r.fields) for r in bibtex.read(spark, str(tmp_path)).collect()}
    assert len(got) == sum(3 if i % 2 == 0 else 1 for i in range(copies))
    assert got["one0"] == ("article", {"journal": "Acta Math", "note": "see\n@book{inner, title = {x}}\n@ home", "month": "1"})
    assert got["two0"] == ("article", {"journal": "Later", "abstract": "first\n@misc{no, a = {b}}\nlast"})
    assert got["three0"] == ("article", {"journal": "Acta", "note": "round\n@misc(x)"})


@pytest.mark.parametrize("text", ["@misc{k, a = later}\n@string{later = {x}}\n", "@string{b = nothing # {x}}\n@misc{k, a = b}\n", "@misc{k, a = {never closed\n@misc{m, b = {c}}\n"])
def test_what_is_broken_fails(spark, tmp_path, text):
    (tmp_path / "f.bib").write_text(text)
    with pytest.raises(PySparkException):
        bibtex.read(spark, str(tmp_path)).collect()


def test_texts_of_one_task_are_parsed_by_many(spark):
    """Texts that one task reads are dealt before they are parsed; macros, spelt in any way, hold from where they stand on."""
    texts = [("f", (0, i), f"@misc{{k{i}, a = up # {{ {i}}}}}") for i in range(2, 200)] + [("f", (0, 0), "@ \u00a0STRING(Up = {A})"), ("f", (0, 100), "@misc{k100, a = {x}} @String{UP = {B}}"), ("f", (0, 1), "@misc{k1, b = {a string}}")]
    texts = [t for i, t in enumerate(texts) if i != 98]
    df = spark.createDataFrame(texts, "file string, at struct<block:bigint,row:bigint>, text string").coalesce(1)
    parsed = bibtex.parse(df)
    got = parsed.collect()
    fields = {r.entry_key: r.fields for r in got}
    assert fields == {f"k{i}": {"a": f"{'A' if i < 100 else 'B'} {i}"} for i in range(2, 200) if i != 100} | {"k100": {"a": "x"}, "k1": {"b": "a string"}}
    assert parsed._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_COL") >= 2


def test_ids_that_are_not_used_yet(spark):
    """Against going through the commits one hash at a time, with few digits so that many collide."""
    import random

    from citegrid.operators import ledger

    rnd = random.Random(1)
    known, used, ids = spark.createDataFrame([], "id string"), set(), {}
    for commit in range(3):
        new = [(k, "".join(rnd.choice("01") for _ in range(12))) for k in range(40)]
        new = list({h: (k, h) for k, h in new if h not in ids}.values())
        got = ledger.unused_ids(known, spark.createDataFrame(new, "k long, sha256 string"), "k", 2)
        for _, h in sorted(new):
            ids[h] = next(h[:n] for n in range(2, 13) if h[:n] not in used)
            used.add(ids[h])
        assert {r.sha256: r.id for r in got.collect()} == {h: f"rev:{ids[h]}" for _, h in new}
        known = known.unionByName(spark.createDataFrame([(f"rev:{ids[h]}",) for _, h in new], "id string"))
    with pytest.raises(PySparkException, match="no revision ID"):
        ledger.unused_ids(spark.createDataFrame([("rev:ab",), ("rev:abc",)], "id string"), spark.createDataFrame([(1, "abc")], "k long, sha256 string"), "k", 2).collect()


def test_ids_of_one_large_group(spark):
    """3000 hashes that begin alike, some of whose prefixes are known IDs: as one after the other, and none of it gathered."""
    import hashlib

    from citegrid.operators import ledger

    new = [(k, "ab" + hashlib.sha256(str(k).encode()).hexdigest()) for k in range(3000)]
    used = {"ab", "ab0", "abc12", new[7][1][:3]}
    df = ledger.unused_ids(spark.createDataFrame([(f"rev:{d}",) for d in used], "id string"), spark.createDataFrame(new[::-1], "k long, sha256 string"), "k", 2)
    expected = {}
    for _, h in new:
        expected[h] = next(h[:n] for n in range(2, 67) if h[:n] not in used)
        used.add(expected[h])
    assert {r.sha256: r.id for r in df.collect()} == {h: f"rev:{d}" for h, d in expected.items()}
    assert "collect_list" not in df._jdf.queryExecution().toString()


def test_whole_ids_that_begin_others(spark):
    """An ID of eight digits and a longer one that begins with it: whole IDs name each, the digits alone neither."""
    short, long = "rev:aaaaaaaa", "rev:aaaaaaaab"
    rows = lambda *r: spark.createDataFrame([("misc", k, f) for k, f in r], NODE)
    first = lifecycle.sync(lifecycle.empty(spark), rows(("k", {"a": "1"}), ("m", {"a": "1"})), "me", 1)
    now = rows(("k", {"a": "2"}), ("m", {"a": "2"}))
    state = lifecycle.sync(first, now, "me", 2)
    named = state["revisions"].withColumn("id", F.when(F.col("target") == "k", short).otherwise(long))
    state |= {"revisions": named, "entries": state["entries"].withColumn("head", F.when(F.col("entry_key") == "k", short).otherwise(long))}
    wanted = named.select(F.col("id").alias("prefix"))
    got = ledger.by_prefix(wanted.unionByName(spark.createDataFrame([("aaaaaaaa",), ("rev:aaaaaaa",)], "prefix string")), named).collect()
    assert {(r.prefix, r.id, r.error) for r in got} == {(short, short, None), (long, long, None), ("aaaaaaaa", None, "ambiguous"), ("rev:aaaaaaa", None, "prefix is too short")}
    assert {(r.entry_key, r.old, r.new, r.error) for r in lifecycle.history_diff(state, wanted, now).collect()} == {("k", "1", "2", None), ("m", "1", "2", None)}
    records, _ = lifecycle.restore(state, wanted, now, "me", 3)
    assert {(r.entry_key, r.fields["a"]) for r in records.collect()} == {("k", "1"), ("m", "1")}
