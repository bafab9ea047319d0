import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from citegrid.functions import canonical as cn
from citegrid.functions import projections as pj
from citegrid.functions import webscan
from citegrid.operators import dedupe, evidence, ledger, proposals, resolve, status
from citegrid.sources import bibtex, providers
from citegrid.sources import ledger as ledger_source

SAMPLE = """% a comment
@string{jr = {Journal of X}}
@comment{ignored, @here}

@Article{alpha,
  title = {A {Nested, braces} title},
  AUTHOR = "Doe, Jane",
  journal = jr # { Y},
  month = Apr,
  year = 2020
}
@book(beta, title = {B (with brackets)}, year = "1999",)
"""


@pytest.fixture()
def bib(spark, tmp_path):
    (tmp_path / "a.bib").write_text(SAMPLE)
    return bibtex.read(spark, str(tmp_path / "a.bib"))


def test_scan(bib):
    rows = {r.entry_key: r for r in bib.collect()}
    assert rows["alpha"].entry_type == "article" and rows["alpha"].fields == {"title": "A {Nested, braces} title", "author": "Doe, Jane", "journal": "Journal of X Y", "month": "4", "year": "2020"}
    assert rows["beta"].fields == {"title": "B (with brackets)", "year": "1999"} and len(rows) == 2


def test_scan_roundtrip_and_duplicates(spark, bib, tmp_path):
    bibtex.write(bib, str(tmp_path / "out"))
    again = bibtex.read(spark, str(tmp_path / "out"))
    key = lambda d: sorted((r.entry_key, r.entry_type, sorted(r.fields.items())) for r in d.collect())
    assert key(bib) == key(again)
    with pytest.raises(bibtex.BibtexError, match="alpha|beta"):
        bibtex.checked(bib.unionByName(again))
    assert bibtex.checked(bib) is bib


def test_broken_entry_fails(spark, tmp_path):
    (tmp_path / "b.bib").write_text("@misc{x, title = {open\n")
    with pytest.raises(PySparkException, match="braces"):
        bibtex.read(spark, str(tmp_path / "b.bib")).collect()


def test_edits_keep_layout():
    text = "@misc{x,\n  title = {Old, {n}},   % c\n  year=1999\n}"
    text = text.replace("   % c", "")
    assert bibtex.edit_entry(text, {"title": "New"}) == "@misc{x,\n  title = {New},\n  year=1999\n}"
    added = bibtex.edit_entry(text, {"doi": "10.1/x"})
    assert added == "@misc{x,\n  title = {Old, {n}},\n  year=1999,\n  doi = {10.1/x},\n}"
    gone = bibtex.edit_entry(text, {"title": None})
    assert gone == "@misc{x,\n  year=1999\n}"
    with pytest.raises(bibtex.BibtexError):
        bibtex.edit_entry("@misc{x, a = {1}, a = {2}}", {"a": "3"})


def test_canonical_json(spark):
    f = F.create_map(F.lit("year"), F.lit("2020"), F.lit("title"), F.lit('Ünïcode "q" \\u000B \x0b/'), F.lit("bibsource"), F.lit("x"))
    r = spark.range(1).select(cn.canonical_json(F.lit("article"), f), cn.content_hash(F.lit("bibsource"), f)).first()
    expected = json.dumps({"ENTRYTYPE": "article", "title": 'Ünïcode "q" \\u000B \x0b/', "year": "2020"}, ensure_ascii=False, separators=(",", ":"))
    assert r[0] == expected and r[1] is None


def test_trust_states(spark):
    fields = {"title": "T", "author": "A"}
    rec = spark.createDataFrame([("k1", "misc", fields), ("k2", "misc", fields), ("k3", "misc", fields), ("k4", "misc", fields)], "entry_key string, entry_type string, fields map<string,string>").withColumn("h", cn.content_hash(F.col("entry_type"), F.col("fields")))
    rec = rec.withColumn("r", evidence.actor_receipt(F.when(F.col("entry_key") == "k1", "human").otherwise("agent"), F.lit("me"), F.col("entry_key"), F.col("h")))
    nodes = rec.select("r.entry_key", "r.fields")
    more = F.create_map(F.lit("bibsource"), F.col("r.entry_key"), F.lit("integrity"), F.when(F.col("entry_key") == "k3", "0").otherwise(F.col("h")))
    rec = rec.withColumn("fields", F.when(F.col("entry_key") == "k4", F.col("fields")).otherwise(F.map_concat("fields", more)))
    e = evidence.joined_evidence(rec, nodes)
    s = e.select("entry_key", status.trust_status(F.col("entry_type"), F.col("entry_key"), F.col("fields"), F.col("source")["kind"], F.col("error")).alias("s"))
    assert {r.entry_key: r.s for r in s.collect()} == {"k1": "verified", "k2": "valid", "k3": "stale", "k4": "invalid"}


def test_provider_evidence_chain(spark):
    rec = spark.createDataFrame([("k", "article", {"title": "T", "local": "x"})], "entry_key string, entry_type string, fields map<string,string>")
    provided = F.create_map(F.lit("title"), F.lit("T"), F.lit("bibprovider"), F.lit("crossref"), F.lit("bibproviderid"), F.lit("10.1/A"))
    res = evidence.resolution_receipt(F.lit("url-doi"), F.lit("https://doi.org/10.1000/a"), F.lit("https://doi.org/10.1000/a"), F.lit("doi"), F.lit("10.1000/a"), F.lit("exact"), F.array(F.struct(F.lit("doi-in-url").alias("kind"), F.lit("10.1000/a").alias("value"))))
    got = rec.withColumn("res", res).withColumn("r", evidence.provider_receipt(F.lit("crossref"), F.lit("10.1000/A"), F.lit("u"), F.lit("application/json"), F.lit("{}"), F.lit("article"), pj.adopted_fields(F.create_map().cast("map<string,string>"), F.map_concat(F.map_filter(provided, lambda k, v: k != "bibproviderid"), F.create_map(F.lit("bibproviderid"), F.lit("10.1000/A")))), resolution=F.col("res.entry_key")))
    nodes = got.select("r.entry_key", "r.fields").unionByName(got.select("res.entry_key", "res.fields"))
    adopted = got.withColumn("fields", F.map_concat(pj.adopted_fields(F.col("fields"), F.create_map(F.lit("title"), F.lit("T"), F.lit("bibprovider"), F.lit("crossref"), F.lit("bibproviderid"), F.lit("10.1000/A"))), F.create_map(F.lit("bibsource"), F.col("r.entry_key"))))
    e = evidence.joined_evidence(adopted.select("entry_key", "entry_type", "fields"), nodes)
    assert e.first().error is None
    assert evidence.trace(adopted.select("entry_key", "entry_type", "fields"), nodes).count() == 2
    forged = adopted.withColumn("fields", pj.overlay(F.col("fields"), F.create_map(F.lit("title"), F.lit("Other"))))
    assert "projection" in evidence.joined_evidence(forged.select("entry_key", "entry_type", "fields"), nodes).first().error


def test_append_evidence(spark):
    n = spark.createDataFrame([("a", {"x": "1"})], "entry_key string, fields map<string,string>")
    assert evidence.append_evidence(n, n).count() == 1
    other = spark.createDataFrame([("a", {"x": "2"})], "entry_key string, fields map<string,string>")
    with pytest.raises(PySparkException, match="other content"):
        evidence.append_evidence(n, other).collect()


def test_dedupe_is_exact(spark):
    rows = [(i, f"{t} study of {w}", a) for i, (t, w, a) in enumerate((t, w, a) for t in ("deep", "deep neural", "shallow") for w in ("cats", "cats and dogs", "dogs") for a in ("Doe, J", "J Doe", "Smith, A"))]
    df = spark.createDataFrame(rows + [(99, None, "x"), (98, "", "x")], "seq long, title string, author string")
    for m in (0.02, 0.15, 0.3, 0.31, 0.5, 0.75, 0.9):
        got = {(r.left_seq, r.right_seq): r.score for r in dedupe.dedupe(df, m).collect()}
        import re

        tok = lambda s: set(re.findall(r"[a-z0-9]+", s.lower()))
        sur = lambda a: {" ".join(re.findall(r"[a-z]+", a.split(",")[0].lower()))} if "," in a else {a.lower().split()[-1]}
        dice = lambda x, y: 2 * len(x & y) / (len(x) + len(y))
        exp = {}
        for i, t, a in rows:
            for j, u, b in rows:
                if i < j:
                    s = 0.7 * dice(tok(t), tok(u)) + 0.3 * (0.75 * dice(sur(a), sur(b)) + 0.25 * dice(tok(a), tok(b)))
                    if s >= m:
                        exp[i, j] = int(s * 10000 + 0.5) / 10000
        assert got == exp
    with pytest.raises(ValueError):
        dedupe.dedupe(df, 0)


def test_chain_errors(spark):
    rev = spark.createDataFrame([("a", "k", "b"), ("b", "k", "c"), ("c", "k", None), ("x", "k2", "y"), ("y", "k2", "x"), ("z", "k3", "gone"), ("w", "k4", "a")], "id string, target string, previous string")
    heads = spark.createDataFrame([("k", "a"), ("k2", "x"), ("k3", "z"), ("k4", "w")], "entry_key string, head string")
    rows = ledger.chain(rev, heads).collect()
    assert sorted((r.position, r.id) for r in rows if r.entry_key == "k") == [(0, "a"), (1, "b"), (2, "c")]
    assert any(r.error == "cycle" for r in rows if r.entry_key == "k2")
    assert [r.error for r in rows if r.id == "gone"] == ["missing revision"]
    assert "revision of another target" in {r.error for r in rows if r.entry_key == "k4"}


def test_restore_and_approvals(spark):
    rev = spark.createDataFrame([("rev:1", "k", "snap", "st")], "id string, target string, snapshot string, state string")
    cur = spark.createDataFrame([("other",)], "entry_key string")
    r = ledger.restore(rev, F.lit("rev:1"), cur).first()
    assert r.inserted and r.snapshot == "snap"
    recs = spark.createDataFrame([("k", "h1"), ("m", "h2")], "entry_key string, content_hash string")
    asked = spark.createDataFrame([("k", "h1"), ("m", "old")], "entry_key string, content_hash string")
    a = ledger.approvals(recs, asked, "me", 7).collect()
    assert [x.entry_key for x in a] == ["k"] and len(a[0].batch_id) == 16
    assert ledger.state(0, 0, False) == "unlocked" and ledger.state(1, 0) == "invalid" and ledger.state(0, 1) == "stale" and ledger.state(0, 0) == "locked"


def test_proposals(spark):
    records = spark.createDataFrame([("k", "misc", {"title": "A", "bibsource": "s"}), ("m", "misc", {"title": "B"})], "entry_key string, entry_type string, fields map<string,string>")
    changes = spark.createDataFrame([("k", "book", {"title": "C", "bibsource": "x"}), ("m", "book", {"title": "D"})], "target string, entry_type string, fields map<string,string>")
    p = proposals.create(records, changes, " a ", "r", 1)
    assert proposals.invalid(p).count() == 0 and p.count() == 2 and {r.id for r in p.collect()} == {r.id for r in proposals.identified(p.withColumn("id", F.lit("x"))).collect()}
    tampered = {"reason": F.lit(""), "after": F.col("before"), "before": F.create_map(F.lit("title"), F.lit("Z")), "after_json": F.lit("{}"), "timestamp": F.lit(2).cast("long"), "after_type": F.lit("article"), "outcome": F.lit("adopted"), "proposal_hash": F.col("baseline_hash"), "target": F.lit("q")}
    wrong = {name: {r.error for r in proposals.invalid(p.withColumn(name, value)).collect()} for name, value in tampered.items()}
    hashes, identity = {proposals.RULES["hash"]}, {proposals.RULES["id"]}
    assert wrong == {"reason": {proposals.RULES["asked"]}, "after": hashes, "before": hashes, "after_json": set(), "timestamp": identity, "after_type": hashes, "outcome": {proposals.RULES["decision"]}, "proposal_hash": hashes, "target": {proposals.RULES["key"]}}
    ids = spark.range(1).select(proposals.proposal_id(F.lit("[1]"), F.lit(None).cast("string")).alias("a"), proposals.proposal_id(F.lit("[1]"), F.lit("{}")).alias("b")).first()
    import hashlib

    assert ids.a == "proposal:" + hashlib.sha256(b"[1]").hexdigest() and ids.b == "proposal:" + hashlib.sha256(b"[[91,49,93],{}]").hexdigest()


def test_page_metadata(spark):
    html = """<head><meta name="Citation_DOI" content="10.1000/A"><meta property="dc.identifier" content="doi:10.1000/b.">
    <script type="application/ld+json">{"@graph": [{"identifier": {"value": "10.1000/c"}, "other": {"doi": "10.1000/no"}}]}</script>
    <script type="application/ld+json">{broken</script></head>"""
    assert [(x["signal"], x["text"]) for x in webscan.metadata(html)] == [("html-meta:citation_doi", "10.1000/A"), ("html-meta:dc.identifier", "doi:10.1000/b."), ("json-ld:identifier", "10.1000/c")]
    pages = spark.createDataFrame([("https://x.org/p", "https://x.org/p", "text/html", html)], "url string, final_url string, media_type string, html string")
    r = resolve.resolve_urls(spark.createDataFrame([(1, "https://x.org/p")], "id int, url string"), pages).first()
    assert r.status == "ambiguous" and [c.value for c in r.candidates] == ["10.1000/a", "10.1000/b", "10.1000/c"] and r.warnings
    xml = '<feed xmlns:a="u"><entry><a:doi>10.1/x</a:doi></entry></feed>'
    assert spark.range(1).select(webscan.atom_dois(F.lit(xml))).first()[0] == ["10.1/x"]


def test_crossref(spark):
    work = {"message": {"DOI": "https://doi.org/10.1/A", "type": "journal-article", "title": ["<i>T</i> one"], "author": [{"family": "Doe", "given": "J", "ORCID": "https://orcid.org/1"}, {"name": "Org"}], "container-title": ["J"], "issued": {"date-parts": [[2020, 5]]}, "published-print": {"date-parts": [[None]]}}}
    items = {"message": {"items": [{"score": 2.5, **work["message"]}, {"score": 1.0, **work["message"]}]}}
    df = spark.createDataFrame([(json.dumps(work), json.dumps(items))], "one string, many string")
    r = providers.crossref_lookup(df, "one").first().record
    assert r.id == "10.1/A" and r.title == "T one" and r.issued is None and [(a.family, a.given, a.orcid) for a in r.authors] == [("Doe", "J", "1"), ("Org", None, None)]
    assert [x.score for x in providers.crossref_search(df, "many", 1).collect()] == [2.5]
    note = {"notes": [{"id": "n", "content": {"title": {"value": "T"}, "authors": {"value": ["A B"]}, "venue": {"value": "X 2021"}}}, {"content": {}}]}
    o = providers.openreview_notes(spark.createDataFrame([(json.dumps(note),)], "body string")).collect()
    assert len(o) == 1 and o[0].record.issued.year == 2021


def test_identifier_precedence(spark):
    f = spark.createDataFrame([({"doi": "10.1000/a\\_b", "url": "https://x/10.1000/u"},), ({"url": "https://arxiv.org/abs/2301.00001", "title": "t"},), ({"title": "t"},), ({"x": "y"},)], "f map<string,string>")
    v = f.select(resolve.verify_identifier(F.col("f")).alias("v"), resolve.plan_identifier(F.col("f"), F.lit("crossref")).alias("p"), resolve.apply_identifier(F.lit(None).cast("string"), F.col("f")).alias("a")).collect()
    assert (v[0].v.doi, v[0].v.method, v[0].p.id, v[0].a) == ("10.1000/a_b", "doi-field", "10.1000/a\\_b", "10.1000/a\\_b")
    assert (v[1].v.doi, v[1].v.method, v[1].p.method) == ("10.48550/arXiv.2301.00001", "url", "unsupported-identifier")
    assert v[2].p.method == "title-search" and v[3].p.method == "unsupported"


def test_ledger_file_and_commits(spark, tmp_path):
    entry = {"contentHash": "h", "snapshot": {"entry_type": "misc", "entry_key": "k", "fields": {"a": "1"}}, "source": "s", "integrity": {"contentHash": "h", "source": "s"}, "head": "rev:1"}
    lock = {"lockfileVersion": "1.1", "toolVersion": "1", "bibliography": {"contentHash": "d"}, "entries": {"k": entry}, "deletedEntries": {"gone": entry}, "sources": {"s": {"kind": "human"}}, "revisions": {}}
    (tmp_path / "l.json").write_text(json.dumps(lock, indent=1))
    t = ledger_source.read(spark, str(tmp_path / "l.json"))
    assert {(r.entry_key, r.deleted) for r in t["entries"].collect()} == {("k", False), ("gone", True)} and t["sources"].count() == 1
    rec = spark.createDataFrame([("k", {"a": "1"}), ("new", {"a": "2"})], "entry_key string, fields map<string,string>")
    h = {r.entry_key: r.fields for r in ledger_source.hydrate(rec, t["entries"]).collect()}
    assert h["k"]["bibsource"] == "s" and h["k"]["integrity"] == "h" and h["new"] == {"a": "2"}
    folder = str(tmp_path / "store")
    assert ledger_source.commit({"x": rec}, folder, 0) == 1
    with pytest.raises(RuntimeError):
        ledger_source.commit({"x": rec}, folder, 0)
    assert ledger_source.load(spark, folder)["x"].count() == 2
    (tmp_path / "bad.json").write_text("{no")
    with pytest.raises(Exception, match="(?i)malformed|FAILED_READ|parse"):
        ledger_source.read(spark, str(tmp_path / "bad.json"))["header"].collect()


def test_stream_equals_batch(spark, tmp_path):
    from citegrid.streaming import ledger_stream as ls

    rows = [(i % 3, f"2024-01-0{1 + i % 5} 00:00:00", f"v{i}") for i in range(12)]
    batch = spark.createDataFrame(rows, "k int, t string, v string").withColumn("t", F.to_timestamp("t"))
    batch.repartition(3).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = ls.heads(s, "k", "t", ["v"]).writeStream.outputMode("complete").format("memory").queryName("heads").trigger(availableNow=True).start()
    q.awaitTermination()
    key = lambda d: sorted(map(tuple, d.collect()))
    assert key(spark.table("heads")) == key(ls.heads(batch, "k", "t", ["v"]))
    assert ls.edits_by_window(batch, "t", "k").count() > 0


def test_records_without_evidence_are_dealt(spark):
    """Neither records that name no evidence nor those whose evidence names no other meet in one task."""
    rows = [("misc", f"k{i}", {"bibsource": f"s{i}"} if i % 2 else {"title": "T"}) for i in range(400)]
    records = spark.createDataFrame(rows, "entry_type string, entry_key string, fields map<string,string>")
    nodes = spark.createDataFrame([(f"s{i}", {"kind": "agent"}) for i in range(400)], "entry_key string, fields map<string,string>")
    was = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = evidence.joined_evidence(records, nodes).select("entry_key", "source", "error", F.spark_partition_id().alias("p")).collect()
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    assert len(got) == 400 and all((r.source is None) == (int(r.entry_key[1:]) % 2 == 0) for r in got)
    assert {r.error for r in got if r.source is None} == {"record names no evidence"}
    for named in (True, False):
        share = [r.p for r in got if (r.source is not None) == named]
        assert max(share.count(p) for p in set(share)) < 100


def test_files_are_parsed_once(spark, tmp_path):
    (tmp_path / "a.bib").write_text("@string{p = {House}}\n@book{k, publisher = p, title = {T}}\n")
    records = bibtex.read(spark, str(tmp_path / "a.bib"))
    assert "_entries_of_pieces" not in records._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.entry_key, r.fields) for r in records.collect()] == [("k", {"publisher": "House", "title": "T"})]
