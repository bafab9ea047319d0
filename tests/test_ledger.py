"""The ledger: chains, tampering, edits, commits; and text edits of bibliographies."""

import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from citegrid.functions import canonical as cn
from citegrid.operators import evidence, ledger, lifecycle, linkage, proposals
from citegrid.sources import bibtex, files
from citegrid.sources import ledger as store

RECORD = "entry_type string, entry_key string, fields map<string,string>"


def test_chains_of_any_length_and_cycles(spark):
    """Long chains whole; a cycle found however many other revisions there are, and reported once for each head into it."""
    rows = [(f"a{i}", "a", f"a{i - 1}" if i else None) for i in range(300)] + [(f"c{i}", "c", f"c{(i + 1) % 3}") for i in range(3)] + [("t1", "c", "t0"), ("t0", "c", "c1"), ("s", "s", "s")]
    random.Random(1).shuffle(rows)
    rev = spark.createDataFrame(rows, "id string, target string, previous string")
    heads = spark.createDataFrame([("a", "a299"), ("b", "a4"), ("c", "t1"), ("s", "s"), ("n", None), ("m", "gone")], "entry_key string, head string")
    got = ledger.chain(rev, heads).collect()
    assert [r.id for r in sorted((r for r in got if r.entry_key == "a"), key=lambda r: r.position)] == [f"a{i}" for i in range(299, -1, -1)]
    assert [(r.id, r.position, r.error) for r in got if r.entry_key in "cs"] == [("t1", 0, "cycle"), ("s", 0, "cycle")] or {(r.id, r.error) for r in got if r.entry_key in "cs"} == {("t1", "cycle"), ("s", "cycle")}
    assert {r.error for r in got if r.entry_key == "b"} == {"revision of another target"} and [r.error for r in got if r.entry_key == "m"] == ["missing revision"]
    assert {r.id for r in ledger.cyclic(rev).collect()} == {"c0", "c1", "c2", "t0", "t1", "s"}
    assert ledger.cyclic(rev.filter("target = 'a'")).count() == 0 and ledger.chain(rev.limit(0), heads.limit(0)).count() == 0


@pytest.fixture()
def records(spark):
    return spark.createDataFrame([("misc", f"k{i}", {"title": f"T{i}", "year": "2000"}) for i in range(6)], RECORD)


def edited(records, **years):
    year = F.coalesce(*[F.when(F.col("entry_key") == k, v) for k, v in years.items()], F.col("fields")["year"])
    return records.withColumn("fields", F.map_concat(F.map_filter("fields", lambda k, v: k != "year"), F.create_map(F.lit("year"), year)))


def test_updates_are_checked_and_committed_once(spark, records, tmp_path):
    folder = str(tmp_path / "ledger")
    assert lifecycle.update(spark, folder, lambda s: lifecycle.sync(s, records, "me", 5)) == 1
    now = edited(records, k1="2001").filter("entry_key <> 'k2'")
    assert lifecycle.update(spark, folder, lambda s: lifecycle.edit(s, now, "edit", "me", 6)) == 2
    state = store.load(spark, folder)
    e = {r.entry_key: r for r in state["entries"].collect()}
    assert e["k2"].deleted and e["k1"].head and not e["k0"].head and state["revisions"].count() == 2
    assert lifecycle.status(state, now)["state"] == "locked" and lifecycle.status(state, records)["state"] == "stale"
    back, after = lifecycle.restore(state, state["revisions"].filter("target = 'k2'").select(F.substring("id", 5, 8).alias("prefix")), now, "me", 7)
    assert back.filter("entry_key = 'k2'").first().fields["title"] == "T2" and after["revisions"].count() == 3
    assert lifecycle.status(after, back)["state"] == "locked"
    unchanged = lifecycle.edit(state, now, "edit", "me", 8)
    assert unchanged["revisions"].count() == 2
    for column, value in (("snapshot", "{}"), ("actor", "someone"), ("id", "rev:0000"), ("revision_sha256", "0" * 64)):
        tampered = state | {"revisions": state["revisions"].withColumn(column, F.lit(value))}
        assert not lifecycle.errors(tampered).isEmpty()
    with pytest.raises(ValueError, match="invalid ledger"):
        lifecycle.update(spark, folder, lambda s: s | {"revisions": s["revisions"].withColumn("actor", F.lit("x"))})
    with pytest.raises(RuntimeError):
        store.commit(state, folder, 1)
    assert store.current_version(spark, folder) == 2


def test_rules_of_one_row_are_one_pass(spark, records, tmp_path):
    """An entry and a revision that break several rules are told of each, and the tables are not read once for each rule."""
    first = lifecycle.sync(lifecycle.empty(spark), records, "me", 1)
    state = lifecycle.sync(first, records.withColumn("fields", F.map_from_arrays(F.array(F.lit("title")), F.array(F.lit("another")))), "me", 2)
    e = state["entries"].withColumns({"content_hash": F.lit("x"), "integrity_hash": F.lit("y"), "integrity_source": F.lit("z"), "head": F.lit("rev:none")})
    r = state["revisions"].withColumns({"snapshot_key": F.lit("other"), "snapshot_sha256": F.lit("0"), "previous": F.lit("rev:gone")})
    for name, df in (("entries", e), ("revisions", r)):
        df.write.parquet(str(tmp_path / name))
    broken = {"entries": spark.read.parquet(str(tmp_path / "entries")), "revisions": spark.read.parquet(str(tmp_path / "revisions")), "sources": state["sources"]}
    found = lifecycle.errors(broken)
    key, rev = e.first()["entry_key"], r.first()["id"]
    told = {x.error for x in found.collect()}
    of_entry = ("references missing revision rev:none", "has invalid contentHash", "snapshot hash does not match", "has invalid integrity contentHash", "integrity source does not match")
    assert {f"entry {key} {x}" for x in of_entry} == {x for x in told if x.startswith(f"entry {key} ")}
    of_revision = ("snapshot belongs to another target", "snapshot hash does not match", "hash does not match", "references missing rev:gone")
    assert {f"revision {rev} {x}" for x in of_revision} == {x for x in told if x.startswith(f"revision {rev} ")}
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("FileScan parquet") <= 10


def test_seals_and_approvals_of_captured_entries(spark, records):
    content = cn.content_hash(F.col("entry_type"), F.col("fields"))
    more = F.when(F.col("entry_key") == "k0", F.create_map(F.lit("integrity"), content, F.lit("bibsource"), F.lit("s"))).when(F.col("entry_key") == "k1", F.create_map(F.lit("integrity"), F.lit("other"))).otherwise(F.create_map().cast("map<string,string>"))
    e = {r.entry_key: r for r in lifecycle.capture(records.withColumn("fields", F.map_concat("fields", more)), lifecycle.empty(spark)["entries"]).collect()}
    assert e["k0"].integrity_hash == e["k0"].content_hash and e["k0"].integrity_source == "s" and e["k1"].integrity_hash is None and e["k0"].snapshot.fields == {"title": "T0", "year": "2000"}
    half = records.withColumn("fields", F.map_concat("fields", F.create_map(F.lit("bibapprovalid"), F.lit("x"))))
    with pytest.raises(PySparkException, match="incomplete approval"):
        lifecycle.capture(half, lifecycle.empty(spark)["entries"]).collect()


def test_proposals_for_missing_records(spark, records):
    with pytest.raises(PySparkException, match="not found"):
        proposals.create(records, spark.createDataFrame([("nobody", "misc", {"a": "b"})], "target string, entry_type string, fields map<string,string>"), "a", "r", 1).collect()


def test_blockers_are_told_apart(spark):
    m = spark.createDataFrame([("k", 1, 0.5), ("k", 2, 0.95), ("j", 1, 0.95), ("j", 2, 0.95), ("i", 1, 0.95), ("h", 1, 0.95)], "entry_key string, id int, score double")
    chosen = spark.createDataFrame([("k", 1, 1.0, False), ("j", 1, 1.0, False), ("i", 1, 0.2, False), ("h", 1, 0.95, True), ("g", None, None, False)], "entry_key string, id int, record_score double, stale boolean")
    got = {r.entry_key: r.blocker for r in linkage.proposals(m, chosen).collect()}
    assert got == {"k": linkage.CANDIDATE_BELOW, "j": linkage.SEVERAL, "i": linkage.RECORD_BELOW, "h": linkage.STALE, "g": linkage.NO_PROVIDER}


def test_search_of_many_copies(spark):
    """A title that most records and provider rows have costs no pairs of rows, and its smallest IDs are found."""
    provider = spark.createDataFrame([(i, "the same common title" if i % 10 else f"rare word{i} title", "A, B") for i in range(500)], "id int, title string, author string")
    records = spark.createDataFrame([(f"k{i}", "The same common Title" if i % 5 else f"a rare word{i} here", "A, B") for i in range(200)], "entry_key string, title string, author string")
    got = linkage.search(records, provider, 3).collect()
    assert {r.id for r in got if r.entry_key == "k1"} == {1, 2, 3} and sum(r.entry_key == "k1" for r in got) == 3
    assert next(r for r in got if r.entry_key == "k20" and r.rank == 1).id == 20


def test_new_evidence_must_agree(spark):
    node = "entry_key string, fields map<string,string>"
    none, two = spark.createDataFrame([], node), spark.createDataFrame([("a", {"x": "1"}), ("a", {"x": "2"})], node)
    with pytest.raises(PySparkException, match="other content"):
        evidence.append_evidence(none, two).collect()
    assert evidence.append_evidence(none, spark.createDataFrame([("a", {"x": "1"})] * 3, node)).count() == 1


def test_names_that_differ_in_case(spark):
    df = spark.createDataFrame([({"Title": "A", "title": "B"},), ({"title": "B"},)], "f map<string,string>").select(cn.canonical_json(F.lit("misc"), F.col("f")).alias("j"))
    assert len({r.j for r in df.collect()}) == 1


def test_files_of_entries(spark, tmp_path):
    (tmp_path / "a.bib").write_text("Notes (draft), by me {\n  @misc{a, x = 1} @misc{b, x = 2}\n@comment{ @misc{no} }\n\t@MISC(c, x = {(})\n@misc{d, x = 4}")
    (tmp_path / "b.bib").write_text("@misc{e, x = 5}\nfree text\n")
    (tmp_path / "c.BIB").write_text("")
    (tmp_path / "d.bib").write_text("@misc{f, x = 6}\nwrite to me@example.org\n")
    got = bibtex.read(spark, str(tmp_path / "a.bib"), str(tmp_path / "b.bib"))
    assert {r.entry_key: r.fields["x"] for r in got.collect()} == {"a": "1", "b": "2", "c": "(", "d": "4", "e": "5"}
    with pytest.raises(PySparkException, match="no entry begins"):
        bibtex.read(spark, str(tmp_path / "d.bib")).collect()
    s = {r.file.rpartition("/")[2]: (r.entries, r.error is None) for r in files.scanned(spark, str(tmp_path)).collect()}
    assert s == {"a.bib": (4, True), "b.bib": (1, True), "c.BIB": (0, True), "d.bib": (1, False)}


def test_edits_of_whole_files():
    text = "% head\n@misc{a,\n  x = {1},\n}\n\n@misc{b, x = {2}}\n% tail"
    assert bibtex.replace_entry(text, "b", "@book{b, y = 3}") == text.replace("@misc{b, x = {2}}", "@book{b, y = 3}")
    assert bibtex.mark_file(bibtex.mark_file(text, {"a": "h"}), {"a": None}) == text
    for broken in (lambda: bibtex.replace_entry(text, "z", "@misc{z}"), lambda: bibtex.replace_entry(text, "a", "no entry"), lambda: bibtex.mark_file(text, {"z": "h"}), lambda: bibtex.edit_file(text + "@misc{a, x = 1}", {})):
        with pytest.raises(bibtex.BibtexError):
            broken()


def test_whole_and_endless_entries_of_one_task(spark, tmp_path):
    """More pieces than a batch has, put together again, and an entry without an end after them."""
    cut = "".join(f"@misc{{a{i}, note = {{see\n@ home}}}}\n" for i in range(30))
    (tmp_path / "a.bib").write_text(cut)
    (tmp_path / "b.bib").write_text("@misc{b, title = {x")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10)
    try:
        s = {r.file.rpartition("/")[2]: (r.entries, r.error is None) for r in files.scanned(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert s == {"a.bib": (30, True), "b.bib": (0, False)}
