"""Proposals from a provider: frozen evidence, and what is refused."""

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from citegrid.functions import projections as pj
from citegrid.operators import proposals

RECORD = {"entry_key": "k", "entry_type": "article", "fields": {"title": "Example work", "author": "Doe, Jane", "year": "2000", "note": "mine", "bibsource": "old"}}


def literature(spark, id_, title, author="Doe, Jane"):
    f = F.create_map(F.lit("title"), F.lit(title), F.lit("author"), F.lit(author), F.lit("year"), F.lit("2001"), F.lit("doi"), F.lit(id_))
    return spark.range(1).select(pj.literature_of_fields(F.lit("crossref"), F.lit(id_), F.lit("article"), f).alias("r"))


def proposed(spark, found, chosen, returned=None, target="k"):
    """Proposal from a search that found (id, title) pairs, of which one is chosen."""
    records = spark.createDataFrame([(RECORD["entry_key"], RECORD["entry_type"], RECORD["fields"])], "entry_key string, entry_type string, fields map<string,string>")
    rows = spark.range(1)
    for i, (id_, title) in enumerate(found):
        rows = rows.crossJoin(literature(spark, id_, title).withColumnRenamed("r", f"r{i}"))
    candidates = F.array(*[F.col(f"r{i}") for i in range(len(found))])
    searches = rows.select(F.lit(target).alias("target"), F.lit("q").alias("query"), F.lit("u").alias("request_url"), F.lit("t").alias("media_type"), F.lit("{}").alias("response"), candidates.alias("candidates"), F.array(*[F.lit(1.0)] * len(found)).alias("scores"))
    record = literature(spark, returned or chosen, dict(found).get(chosen, "?"))
    lookups = record.select(F.lit(chosen).alias("record_id"), F.col("r").alias("record"), F.lit("u").alias("request_url"), F.lit("t").alias("media_type"), F.lit("{}").alias("response"))
    choices = spark.createDataFrame([(target, chosen.upper())], "target string, record_id string")
    return records, proposals.create_provider(records, choices, searches, lookups, " codex ", "r", 0.9, 7)


def view(spark, records, p):
    from citegrid.functions import canonical as cn

    return proposals.views(p, records.select("entry_key", cn.content_hash(F.col("entry_type"), F.col("fields")).alias("content_hash"))).first()


def test_a_single_good_candidate_may_be_adopted(spark):
    records, p = proposed(spark, [("10.1234/test", "Example work"), ("10.1234/far", "Different subject")], "10.1234/test")
    row = p.first()
    assert row.after == {"title": "Example work", "author": "Doe, Jane", "year": "2001", "doi": "10.1234/test", "note": "mine"} and row.agent == "codex"
    assert [s.entry_key.split(":")[1] for s in row.provider.sources] == ["search", "selection", "provider"]
    listed = json.loads(row.provider.sources[0].fields["candidates"])
    assert [c["id"] for c in listed] == ["10.1234/test", "10.1234/far"] and listed[0]["authors"] == ["Doe"] and listed[0]["year"] == 2001 and len(listed[0]["projection_sha256"]) == 64
    assert proposals.invalid(p).count() == 0
    v = view(spark, records, p)
    assert (v.score, v.blocker, v.adoptable, v.stale) == (1.0, None, True, False) and {c.field for c in v.changes} == {"doi", "year"}


@pytest.mark.parametrize("other,title,blocker", [("Example work", "Example work", "SEVERAL"), ("Far", "Different subject", "RECORD_BELOW")])
def test_ambiguous_and_low_scores_need_a_human(spark, other, title, blocker):
    from citegrid.operators import linkage

    records, p = proposed(spark, [("10.1234/test", title), ("10.1234/other", other)], "10.1234/test")
    v = view(spark, records, p)
    assert v.blocker == getattr(linkage, blocker) and v.adoptable is False and proposals.invalid(p).count() == 0


@pytest.mark.parametrize("kwargs,message", [({"chosen": "10.1/none"}, "no candidate"), ({"chosen": "10.1/a", "returned": "10.1/b"}, "another identifier"), ({"chosen": "10.1/a", "target": "nobody"}, "not found")])
def test_what_is_refused(spark, kwargs, message):
    with pytest.raises(PySparkException, match=message):
        proposed(spark, [("10.1/a", "Example work")], **kwargs)[1].collect()


def test_decisions_must_name_the_revision_they_made(spark):
    _, p = proposed(spark, [("10.1/a", "Example work")], "10.1/a")
    p = p.withColumn("decision_revision", F.lit("rev:1"))
    revision = lambda target, snapshot: p.select(F.lit("rev:1").alias("id"), F.lit(target).alias("target"), F.col(snapshot).alias("snapshot"))
    assert proposals.misplaced(p, revision("k", "before_json")).count() == 0
    assert proposals.misplaced(p, revision("k", "after_json")).count() == 1
    assert proposals.misplaced(p, revision("m", "before_json")).count() == 1
    assert proposals.misplaced(p, revision("k", "before_json").limit(0)).count() == 1


def test_words_are_computed_once_for_all_comparisons(spark):
    """However often a view compares a record, its text is normalised once; blank, null and odd texts score as ever."""
    from citegrid.functions import text as tx
    from citegrid.operators import proposals

    kind = f"id string, target string, baseline_hash string, before_type string, before map<string,string>, after_type string, after map<string,string>, outcome string, provider {proposals.PROVIDER}"
    shown = proposals.views(spark.createDataFrame([], kind), spark.createDataFrame([], "entry_key string, content_hash string")).select("score", "blocker", "adoptable")
    # three for each of the words of a title, of an author list, and of a surname with or without a comma, on three sides
    assert shown._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") <= 3 * 3 * 4
    texts = [None, "", " ", "{A} \\'e b", "A b c", "İx Σ, Y and Z"]
    df = spark.createDataFrame([(a, b, c, d) for a in texts for b in texts[:5] for c in texts[1:] for d in texts], "a string, b string, c string, d string")
    apart = df.select(*[F.transform(F.array(x), lambda v: v)[0].alias(x) for x in "abcd"])
    words = lambda v: None if v is None else {r for r in v}
    rows = apart.select("*", tx.similarity(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("s"), tx.tokens(F.col("a")).alias("x"), tx.tokens(F.col("c")).alias("y")).collect()
    for r in rows:
        assert (r.s is None) == (None in (r.a, r.b, r.c, r.d)) and (words(r.x) is None) == (r.a is None)
        if r.s is not None:
            both = len(words(r.x) & words(r.y))
            assert r.s.title_score == (round(2 * both / (len(r.x) + len(r.y)), 4) if r.x and r.y else 0)
            assert "" not in r.x


def test_a_hash_and_the_rules_are_computed_once(spark):
    from citegrid.functions import canonical as cn

    _, p = proposed(spark, [("10.1234/test", "Example work")], "10.1234/test")
    text = F.col("id").cast("string")
    records = spark.range(1).select(text.alias("entry_key"), text.alias("entry_type"), F.create_map(F.lit("title"), text).alias("fields"))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert plan(records.filter(cn.content_hash(F.col("entry_type"), F.col("fields")) == "x")).count("map_filter") == 1
    assert "sha2" not in plan(proposals.invalid(p))


@pytest.mark.parametrize("data", [b"", b"\x00", bytes(range(256))])
def test_bytes_as_numbers(data):
    assert b"[" + proposals.numbers(data) + b"]" == json.dumps(list(data), separators=(",", ":")).encode()


def test_new_proposals_are_written_once(spark):
    records = spark.createDataFrame([("k", "article", {"title": "a"})], "entry_key string, entry_type string, fields map<string,string>")
    p = proposals.create(records, records.withColumnRenamed("entry_key", "target"), "me", "r", 1)
    assert "Join" not in p._jdf.queryExecution().optimizedPlan().toString() and p.first().target == "k"


def test_the_bibliography_after_an_adoption_is_written_once(spark):
    from citegrid.operators import lifecycle

    records = spark.createDataFrame([("k", "article", {"title": "a"}), ("l", "book", {"title": "b"})], "entry_key string, entry_type string, fields map<string,string>")
    state = lifecycle.sync(lifecycle.empty(spark), records, "me", 1)
    changes = records.filter("entry_key = 'k'").select(F.col("entry_key").alias("target"), "entry_type", F.create_map(F.lit("title"), F.lit("c")).alias("fields"))
    state["proposals"] = proposals.create(records, changes, "me", "r", 2)
    wanted = state["proposals"].select("id", F.lit(None).cast("string").alias("blocker"))
    out, _, said = lifecycle.adopt_proposals(state, records, wanted, "agent", 3)
    assert {r.entry_key: r.fields["title"] for r in out.collect()} == {"k": "c", "l": "b"} and said.first().outcome == "adopted"
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
