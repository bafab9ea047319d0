"""Queries on trust states, the revision ledger, linkage and proposals."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from citegrid.functions import canonical as cn
from citegrid.operators import evidence, ledger, linkage, proposals, status
from citegrid.plans.identity import _CANON
from citegrid.sources import bibtex
from citegrid.storage import checkpoint, settled
from citegrid.plans.views import BIBLIO, TOKENS, WORDS, biblio, table


def sealed(spark, sf_dir):
    """Records of documents with markers, approvals and evidence made from their labels.

    label 1/0: an agent's receipt; 0/0: a human's; toxic: a receipt for other content; without label none. One in eleven
    has a marker of other content, one in thirteen a human approval, one in 26 a forged one.
    """
    b = biblio(spark, sf_dir).drop("bibsource").withColumn("fields", F.map_filter("fields", lambda k, v: k != "bibsource"))
    lab = table(spark, sf_dir, "labels").dropDuplicates(["doc_id"])
    j = b.join(lab, b.seq == lab.doc_id, "left").withColumn("hash", cn.content_hash(F.col("entry_type"), F.col("fields")))
    kind = F.when(F.col("quality") == 1, "agent").otherwise("human")
    receipt = evidence.actor_receipt(kind, F.lit("x"), F.col("entry_key"), F.when(F.col("toxic") == 1, F.sha2(F.lit("other"), 256)).otherwise(F.col("hash")))
    j = j.withColumn("r", F.when(F.col("quality").isNotNull(), receipt))
    stamp, i = F.lit(1700000000), F.col("seq")
    own = cn.approval_id(F.lit("human"), F.lit("browser-review"), F.lit(None).cast("string"), F.col("entry_key"), F.col("hash"), stamp, F.lit("b"))
    more = {
        "integrity": F.when(i % 11 == 0, "stale").when(F.col("quality").isNotNull(), F.col("hash")), "bibsource": F.col("r.entry_key"),
        "bibapprovalid": F.when(i % 26 == 0, "forged").when(i % 13 == 0, own), "bibapprovalkind": F.when(i % 13 == 0, "human"), "bibapprovalmethod": F.when(i % 13 == 0, "browser-review"),
        "bibapprovalcontent": F.when(i % 13 == 0, F.col("hash")), "bibapprovaltimestamp": F.when(i % 13 == 0, "1700000000"), "bibapprovalbatch": F.when(i % 13 == 0, "b"),
    }
    extra = F.map_filter(F.create_map(*[x for k, v in more.items() for x in (F.lit(k), v)]), lambda k, v: v.isNotNull())
    records = j.select("seq", "entry_key", "entry_type", F.map_concat("fields", extra).alias("fields"), "title", "author")
    nodes = j.filter("r IS NOT NULL").select("r.entry_key", "r.fields")
    return records, nodes


def _with_status(spark, sf_dir):
    records, nodes = sealed(spark, sf_dir)
    e = evidence.joined_evidence(records, nodes)
    return e.withColumn("status", status.trust_status(F.col("entry_type"), F.col("entry_key"), F.col("fields"), F.col("source")["kind"], F.col("error")))


def trust_status(spark, sf_dir):
    return _with_status(spark, sf_dir).select("entry_key", "status")


def status_summary(spark, sf_dir):
    return status.summary(_with_status(spark, sf_dir), ["entry_type"])


def readiness(spark, sf_dir):
    """All files, the verified records of each alone, these with an error somewhere, and no file at all."""
    s = _with_status(spark, sf_dir).withColumn("file", F.concat(F.lit("f"), F.col("seq") % 5))
    good, named = s.filter("status = 'verified'"), lambda name, rows, errors=0: status.ready(status.summary(rows, ["file"]), F.lit(errors)).select(F.lit(name).alias("of"), "ready")
    return named("all", s).unionByName(named("verified", good)).unionByName(named("with errors", good, 1)).unionByName(named("none", s.limit(0)))


def pending_paths(spark, sf_dir):
    return status.pending(_with_status(spark, sf_dir)).groupBy("status", "path").agg(F.count(F.lit(1)).alias("n"))


def next_actions(spark, sf_dir):
    rows = status.actions(status.pending(_with_status(spark, sf_dir)), F.lit("my refs.bib"))
    return rows.select("entry_key", F.col("step").cast("long").alias("step"), "command", "writes")


def browser_list(spark, sf_dir):
    s = _with_status(spark, sf_dir).withColumn("has_proposal", F.col("seq") % 17 == 0)
    return status.listed(s, "SRC1", only_pending=True).select("entry_key", "status")


def evidence_trace(spark, sf_dir):
    """Web evidence of pages: each page's receipt, for a record whose URL is the page's."""
    p = table(spark, sf_dir, "pages").withColumn("read", F.col("url")).withColumn("url", F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise(F.concat("url", F.lit("x"))))
    bare = p.select(F.concat(F.lit("p"), "page_id").alias("entry_key"), F.lit("misc").alias("entry_type"), F.create_map(F.lit("url"), F.col("url")).alias("f"), "html", "read")
    bare = bare.withColumn("r", evidence.web_receipt(F.col("entry_key"), cn.content_hash(F.col("entry_type"), F.col("f")), F.col("read"), F.col("read"), F.lit("text/html"), F.col("html")))
    records = bare.select("entry_key", "entry_type", F.map_concat("f", F.create_map(F.lit("bibsource"), F.col("r.entry_key"))).alias("fields"))
    t = evidence.trace(records, bare.select("r.entry_key", "r.fields"))
    return t.select("entry_key", F.col("depth").cast("long").alias("depth"), "role", F.col("node")["finalurl"].alias("url"))


def duplicate_keys(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("entry_key"), F.lit("misc").alias("entry_type"), F.col("source").alias("file"))
    return bibtex.duplicate_keys(d).select("entry_key", "n", F.array_join("files", ",").alias("files"))


def lock_consistency(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("entry_key"), (F.col("doc_id") % 2).cast("string").alias("content_hash"))
    k = table(spark, sf_dir, "labels").select((F.col("doc_id") + 7).cast("string").alias("entry_key"), F.col("quality").cast("string").alias("content_hash"))
    return ledger.consistency(d, k)


def dangling_refs(spark, sf_dir):
    return ledger.dangling(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", table(spark, sf_dir, "labels"), "doc_id")


def _event_chain(spark, sf_dir):
    """Each user's events as a chain, the newest at its head; every third user's head is unknown."""
    by_time = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").withColumns({"before": F.lag("event_id").over(by_time), "after": F.lead("event_id").over(by_time)})
    name = lambda c: F.concat(F.lit("e"), c)
    target = F.concat(F.lit("u"), "user_id")
    revisions = e.select(name(F.col("event_id")).alias("id"), target.alias("target"), name(F.col("before")).alias("previous"))
    heads = e.filter("after IS NULL AND user_id % 3 <> 0").select(target.alias("entry_key"), name(F.col("event_id")).alias("head"))
    return revisions, heads


def history_log(spark, sf_dir):
    return ledger.chain(*_event_chain(spark, sf_dir)).select("entry_key", "position", "id", "error")


def revision_counts(spark, sf_dir):
    revisions, heads = _event_chain(spark, sf_dir)
    return ledger.counts(revisions, ledger.chain(revisions, heads))


def version_chain(spark, sf_dir):
    v = ledger.versions(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], ["event_type"])
    return v.select("event_id", "user_id", F.col("version").cast("long").alias("version"), "is_change")


def restore_point(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    moment = F.lit("2024-06-01").cast("timestamp")
    return ledger.as_of(e, "user_id", "ts", moment, ["event_id", "event_type"]).select("user_id", "event_id", "event_type")


def _hashes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("sha256")).distinct()


def revision_prefix(spark, sf_dir):
    h = _hashes(spark, sf_dir)
    wanted = h.select(F.left("sha256", F.lit(10)).alias("prefix")).unionByName(h.select(F.left("sha256", F.lit(5)).alias("prefix"))).unionByName(h.select(F.concat(F.left("sha256", F.lit(9)), F.lit("zz")).alias("prefix"))).distinct()
    return ledger.by_prefix(wanted, h.select(F.concat(F.lit("rev:"), "sha256").alias("id")))


def unused_ids(spark, sf_dir):
    """IDs of two digits or more for the hashes of documents in two commits, each in the order of their numbers."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.concat_ws(":", "doc_id", "lang"), 256).alias("sha256"))
    first = checkpoint(ledger.unused_ids(spark.createDataFrame([], "id string"), d.filter("doc_id % 2 = 0"), "doc_id", 2))
    return first.unionByName(ledger.unused_ids(first, d.filter("doc_id % 2 = 1"), "doc_id", 2))


def shortest_ids(spark, sf_dir):
    return ledger.shortest_ids(_hashes(spark, sf_dir), least=4)


def edit_revisions(spark, sf_dir):
    b = biblio(spark, sf_dir)
    old = b.select("entry_key", cn.content_hash(b.entry_type, b.fields).alias("content_hash"), cn.canonical_json(b.entry_type, b.fields).alias("snapshot"), F.lit('{"a":1}').alias("state"), F.when(b.seq % 2 == 0, F.concat(F.lit("rev:"), b.entry_key)).alias("head"))
    new = old.filter(b.seq % 10 != 3).withColumn("content_hash", F.when(F.col("head").isNull(), F.col("content_hash")).otherwise(F.lit("changed")))
    return ledger.commit_edit(old, new, "edit", "me", 1700000000).select("entry_key", "tombstone", "previous", "snapshot_sha256", "revision_sha256")


def turn_revisions(spark, sf_dir):
    """Conversation turns as revisions, two of which make a chain; some were tampered with after they were hashed.

    A snapshot (conv_id % 7 = 0, turn 0), an actor (% 11, turn 1), an ID cut to seven digits (% 13, turn 2), a link to
    nothing (% 17, turn 3) and one that closes a circle (% 23, turn 0).
    """
    c, i, t = table(spark, sf_dir, "conversations"), F.col("conv_id"), F.col("turn")
    base = c.select("conv_id", "turn", F.concat(F.lit("d"), "conv_id").alias("target"), F.lit("edit").alias("operation"), F.col("role").alias("actor"), (F.lit(1700000000) + t).cast("long").alias("timestamp"),
        F.concat(F.lit('{"text":"'), F.sha2(F.coalesce("text", F.lit("")), 256), F.lit('"}')).alias("snapshot"), F.concat(F.lit('{"turn":'), t, F.lit("}")).alias("state"))
    name = lambda n=12: F.concat(F.lit("rev:"), F.left("revision_sha256", F.lit(n)))
    even = ledger.hashed(base.filter("turn % 2 = 0").withColumn("previous", F.lit(None).cast("string"))).withColumn("id", F.when((i % 13 == 0) & (t == 2), name(7)).otherwise(name()))
    odd = base.filter("turn % 2 = 1").join(even.select("conv_id", (t + 1).alias("turn"), F.col("id").alias("previous")), ["conv_id", "turn"], "left")
    odd = ledger.hashed(odd).withColumn("id", name())
    first = odd.filter("turn = 1").select("conv_id", F.lit(0).cast("long").alias("turn"), F.col("id").alias("_next"))
    both = even.unionByName(odd).join(first, ["conv_id", "turn"], "left")
    return both.withColumns({
        "snapshot": F.when((i % 7 == 0) & (t == 0), '{"text":""}').otherwise(F.col("snapshot")),
        "actor": F.when((i % 11 == 0) & (t == 1), "nobody").otherwise(F.col("actor")),
        "previous": F.when((i % 17 == 0) & (t == 3), F.concat(F.lit("rev:gone"), i)).when((i % 23 == 0) & (t == 0), F.col("_next")).otherwise(F.col("previous")),
        "snapshot_key": F.col("target"), "source": F.lit(None).cast("string"),
    }).drop("_next")


def ledger_validation(spark, sf_dir):
    b = biblio(spark, sf_dir)
    i = b.seq
    h = F.sha2("title", 256)
    own = cn.approval_id(F.lit("human"), F.lit("browser-review"), F.lit(None).cast("string"), b.entry_key, h, F.lit(5).cast("long"), F.lit("b"))
    approval = F.when(i % 9 == 0, F.struct(F.when(i % 18 == 0, own).otherwise("forged").alias("id"), F.lit("human").alias("kind"), F.lit("browser-review").alias("method"), F.lit(None).cast("string").alias("reviewer"), b.entry_key.alias("target"), h.alias("content_hash"), F.lit(5).cast("long").alias("timestamp"), F.lit("b").alias("batch_id")))
    revisions = turn_revisions(spark, sf_dir)
    # every fourth record has the first turn of its own conversation as head, every eighth that of the next one
    heads = revisions.filter("turn = 0").select(F.col("conv_id").alias("_c"), F.col("id").alias("_head"))
    entries = b.join(heads, F.col("_c") == i + F.when(i % 8 == 4, 1).otherwise(0), "left")
    head = F.when(i % 4 == 0, F.coalesce("_head", F.concat(F.lit("rev:none"), i)))
    entries = entries.select("entry_key", F.lit(False).alias("deleted"), F.when(i % 21 == 0, "bad").otherwise(h).alias("content_hash"), F.when(i % 8 == 0, "other").otherwise(b.entry_key).alias("snapshot_key"), F.when(i % 21 == 0, "bad").otherwise(h).alias("snapshot_hash"), F.when(i % 5 == 0, F.concat(F.lit("s"), i % 20)).alias("source"), F.when(i % 6 == 0, h).alias("integrity_hash"), F.when(i % 5 == 0, F.concat(F.lit("s"), i % 20)).alias("integrity_source"), approval.alias("approval"), head.alias("head"))
    sources = table(spark, sf_dir, "nation").filter("n_nationkey < 15").select(F.concat(F.lit("s"), "n_nationkey").alias("entry_key"))
    return ledger.validation_errors(entries, revisions, sources)


def _match(spark, sf_dir):
    """All documents as records; the benchmark and all documents as the provider."""
    b = biblio(spark, sf_dir).filter(F.col("title").isNotNull()).select("entry_key", "title", "author")
    provider = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text").unionByName(table(spark, sf_dir, "documents").select((F.col("doc_id") + 100000000000).alias("id"), "text"))
    provider = provider.select("id", F.substring_index("text", "\n", 1).alias("title"), F.concat(F.lit("src"), F.col("id") % 20, F.lit(", en")).alias("author"))
    return b, provider


def match_candidates(spark, sf_dir):
    b, p = _match(spark, sf_dir)
    return linkage.scored(linkage.search(b, p, 3), b, p).select("entry_key", "id", F.col("rank").cast("long").alias("rank"), "score", "title_score", "author_score")


def unique_adoptable(spark, sf_dir):
    b, p = _match(spark, sf_dir)
    return linkage.unique_adoptable(linkage.scored(linkage.search(b, p, 3), b, p), 0.7)


def adoption_blocker(spark, sf_dir):
    b, p = _match(spark, sf_dir)
    m = settled(linkage.scored(linkage.search(b, p, 3), b, p), "matches")  # read twice
    n = F.substring("entry_key", 2, 20).cast("long")
    # every third record's whole provider record has the score 1, whatever the search listed; every eleventh's has none
    record_score = F.when(n % 11 == 0, None).when(n % 3 == 0, F.lit(1.0)).otherwise(F.col("score"))
    chosen = m.filter("rank = 1").select("entry_key", F.when(n % 7 != 0, F.col("id")).alias("id"), record_score.alias("record_score"), (n % 5 == 0).alias("stale"))
    return linkage.proposals(m, chosen, 0.7).select("entry_key", "blocker", "adoptable")


def provider_fallback(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality")
    rows = d.join(lab, "doc_id", "left").select("doc_id", F.explode(F.array(F.struct(F.lit(1).alias("rank"), (F.col("quality") == 1).alias("ok"), F.lit("labels").alias("provider")), F.struct(F.lit(2).alias("rank"), (F.col("doc_id") % 2 == 0).alias("ok"), F.col("source").alias("provider")))).alias("l")).select("doc_id", "l.*")
    return linkage.first_success(rows, "doc_id", "rank", "ok").select("doc_id", "found", "provider")


def proposal_decisions(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id")
    p = d.filter("doc_id % 4 <> 3").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 10 == 0, "rejected").alias("outcome"), (F.col("doc_id") % 3 == 0).alias("stale"))
    asked = d.select(F.col("doc_id").alias("id"), (F.col("doc_id") % 2 == 0).alias("adopt"), F.lit(" me ").alias("reviewer"), F.lit(7).cast("long").alias("timestamp"))
    return proposals.decide(p, asked).select("id", "outcome", "reviewer", "error")


QUERIES = {
    f.__name__: f
    for f in (
        trust_status, status_summary, readiness, pending_paths, next_actions, browser_list, evidence_trace, duplicate_keys, lock_consistency, dangling_refs, history_log, revision_counts, version_chain, restore_point,
        revision_prefix, shortest_ids, unused_ids, edit_revisions, ledger_validation, match_candidates, unique_adoptable, adoption_blocker, provider_fallback, proposal_decisions,
    )
}

_STATUS = f"""{BIBLIO}, st AS (SELECT b.*, CASE WHEN seq % 13 = 0 THEN CASE WHEN seq % 26 = 0 THEN 'invalid' ELSE 'verified' END WHEN seq % 11 = 0 THEN 'stale' WHEN l.doc_id IS NULL THEN 'invalid' WHEN toxic = 1 THEN 'invalid' WHEN quality = 1 THEN 'valid' ELSE 'verified' END AS status,
  CASE WHEN doi IS NOT NULL OR note IS NOT NULL THEN 'api_verify' ELSE 'candidate_review' END AS path FROM biblio b LEFT JOIN labels l ON b.seq = l.doc_id)"""
_COUNTS = "count(*) AS total, count(*) FILTER (status = 'verified') AS verified, count(*) FILTER (status = 'valid') AS valid, count(*) FILTER (status = 'stale') AS stale, count(*) FILTER (status = 'invalid') AS invalid"
# a title may be blank
_PATH = "CASE WHEN path = 'candidate_review' AND trim(title) = '' THEN 'human_review' ELSE path END"
_T, _PT = TOKENS.format("title"), TOKENS.format("title")
_SUR = "[" + WORDS.format("split_part(author, ',', 1)") + "[1]]"
_DICE = "CASE WHEN len(a.{0}) = 0 OR len(b.{0}) = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * len(list_intersect(a.{0}, b.{0})) / (len(a.{0}) + len(b.{0})) END"
_MATCH = f"""{BIBLIO}, q0 AS (SELECT item_id AS id, text FROM benchmark UNION ALL SELECT doc_id + 100000000000, text FROM documents),
p0 AS (SELECT id, split_part(text, chr(10), 1) AS title, 'src' || (id % 20) || ', en' AS author FROM q0),
a AS (SELECT entry_key, seq, {_T} AS tt, {_SUR} AS an, {TOKENS.format('author')} AS aw FROM biblio), b AS (SELECT id, {_PT} AS tt, {_SUR} AS an, {TOKENS.format('author')} AS aw FROM p0),
s AS (SELECT entry_key, id, len(list_intersect(a.tt, b.tt)) AS n FROM a JOIN b ON len(a.tt) > 0 AND len(b.tt) > 0 WHERE 4 * len(list_intersect(a.tt, b.tt)) >= len(a.tt) + len(b.tt)),
k AS (SELECT *, row_number() OVER (PARTITION BY entry_key ORDER BY n DESC, id) AS rank FROM s),
d AS (SELECT k.entry_key, k.id, rank, a.seq, {_DICE.format('tt')} AS t, 0.75::DOUBLE * {_DICE.format('an')} + 0.25::DOUBLE * {_DICE.format('aw')} AS u FROM k JOIN a ON a.entry_key = k.entry_key JOIN b ON b.id = k.id WHERE rank <= 3),
m AS (SELECT entry_key, seq, id, rank, round((0.7::DOUBLE * t + 0.3::DOUBLE * u) * 10000) / 10000 AS score, round(t * 10000) / 10000 AS title_score, round(u * 10000) / 10000 AS author_score FROM d)"""
_H = "h AS (SELECT DISTINCT sha256(text) AS x FROM documents)"
ORACLES = {
    "trust_status": f"WITH {_STATUS} SELECT entry_key, status FROM st",
    "status_summary": f"WITH {_STATUS} SELECT entry_type, {_COUNTS} FROM st GROUP BY entry_type",
    "readiness": f"WITH {_STATUS} SELECT 'all' AS of, bool_and(status = 'verified') AS ready FROM st UNION ALL SELECT 'verified', count(*) > 0 FROM st WHERE status = 'verified' UNION ALL SELECT 'with errors', false UNION ALL SELECT 'none', false",
    "pending_paths": f"WITH {_STATUS} SELECT status, {_PATH} AS path, count(*) AS n FROM st WHERE status <> 'verified' GROUP BY 1, 2",
    "next_actions": f"""WITH {_STATUS}, p AS (SELECT entry_key, {_PATH} AS path FROM st WHERE status <> 'verified')
      SELECT entry_key, 0::BIGINT AS step, CASE path WHEN 'api_verify' THEN 'verify ''my refs.bib'' --key ' || entry_key WHEN 'candidate_review' THEN 'match ''my refs.bib'' --key ' || entry_key ELSE 'review ''my refs.bib''' END AS command, path = 'api_verify' AS writes FROM p
      UNION ALL SELECT entry_key, 1, 'propose ''my refs.bib'' --key ' || entry_key || ' --id PROVIDER_RECORD_ID --agent AGENT_ID', true FROM p WHERE path = 'candidate_review'""",
    "browser_list": f"WITH {_STATUS} SELECT entry_key, status FROM st WHERE contains(lower(concat_ws(' ', entry_key, title, author, year)), 'src1') AND (status <> 'verified' OR seq % 17 = 0)",
    "evidence_trace": "SELECT 'p' || page_id AS entry_key, 1::BIGINT AS depth, 'source' AS role, url FROM pages WHERE page_id % 2 = 0",
    "duplicate_keys": "SELECT sha256(text) AS entry_key, count(*) AS n, array_to_string(list_sort(list(DISTINCT source)), ',') AS files FROM documents GROUP BY 1 HAVING count(*) > 1",
    "lock_consistency": """SELECT coalesce(d.k, l.k) AS entry_key, CASE WHEN d.k IS NULL THEN 'missing from bibliography' WHEN l.k IS NULL THEN 'missing from lock' ELSE 'content hash does not match' END AS problem
      FROM (SELECT CAST(doc_id AS VARCHAR) AS k, doc_id % 2 AS h FROM documents) d FULL OUTER JOIN (SELECT CAST(doc_id + 7 AS VARCHAR) AS k, quality AS h FROM labels) l ON d.k = l.k WHERE d.k IS NULL OR l.k IS NULL OR d.h <> l.h""",
    "dangling_refs": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "history_log": "SELECT 'u' || user_id AS entry_key, (row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) - 1)::BIGINT AS position, 'e' || event_id AS id, NULL::VARCHAR AS error FROM events WHERE user_id % 3 <> 0",
    "revision_counts": "SELECT count(*) AS revisions, count(*) FILTER (user_id % 3 <> 0) AS referenced, count(*) FILTER (user_id % 3 = 0) AS orphaned FROM events",
    "version_chain": "SELECT event_id, user_id, row_number() OVER w AS version, (row_number() OVER w = 1 OR event_type IS DISTINCT FROM lag(event_type) OVER w) AS is_change FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
    "restore_point": "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC, event_type DESC) AS k FROM events WHERE ts <= TIMESTAMP '2024-06-01') WHERE k = 1",
    "revision_prefix": f"""WITH {_H}, w AS (SELECT left(x, 10) AS p FROM h UNION SELECT left(x, 5) FROM h UNION SELECT left(x, 9) || 'zz' FROM h), g AS (SELECT p, count(x) AS n, min('rev:' || x) AS id FROM w LEFT JOIN h ON left(x, 10) = p GROUP BY p)
      SELECT p AS prefix, CASE WHEN n = 1 THEN id END AS id, CASE WHEN length(p) < 8 THEN 'prefix is too short' WHEN n = 0 THEN 'not found' WHEN n > 1 THEN 'ambiguous' END AS error FROM g""",
    "unused_ids": """WITH RECURSIVE x AS (SELECT sha256(concat_ws(':', doc_id, lang)) AS h, row_number() OVER (ORDER BY doc_id % 2, doc_id) AS k FROM documents),
      f AS (SELECT 0::BIGINT AS k, NULL::VARCHAR AS h, NULL::VARCHAR AS d, []::VARCHAR[] AS used UNION ALL
        SELECT y.k, y.h, y.d, list_append(y.used, y.d) FROM (SELECT x.k, x.h, f.used, list_filter(list_transform(range(2, 65), lambda n: left(x.h, n)), lambda p: NOT list_contains(f.used, p))[1] AS d FROM f JOIN x ON x.k = f.k + 1) y)
      SELECT h AS sha256, 'rev:' || d AS id FROM f WHERE k > 0""",
    "shortest_ids": f"""WITH {_H}, c AS (SELECT x, unnest(range(4, 65)) AS n FROM h), g AS (SELECT x, n, count(*) OVER (PARTITION BY left(x, n::INT)) AS k FROM c)
      SELECT x AS sha256, 'rev:' || left(x, min(n)::INT) AS id FROM g WHERE k = 1 GROUP BY x""",
    "edit_revisions": f"""WITH {BIBLIO}, o AS (SELECT seq, entry_key, {_CANON} AS snapshot, CASE WHEN seq % 2 = 0 THEN 'rev:' || entry_key END AS previous FROM biblio WHERE seq % 10 = 3 OR seq % 2 = 0),
      s AS (SELECT *, sha256('[' || snapshot || ',{{"a":1}}]') AS ss FROM o)
      SELECT entry_key, seq % 10 = 3 AS tombstone, previous, ss AS snapshot_sha256, sha256('["' || entry_key || '",' || coalesce('"' || previous || '"', 'null') || ',"edit","me",1700000000,' || snapshot || ',{{"a":1}},"' || ss || '"]') AS revision_sha256 FROM s""",
    "ledger_validation": f"""WITH {BIBLIO}, t AS (SELECT conv_id AS c, turn AS n, role, '{{"text":"' || sha256(coalesce(text, '')) || '"}}' AS snap, '{{"turn":' || turn || '}}' AS state FROM conversations),
      t1 AS (SELECT *, sha256('[' || snap || ',' || state || ']') AS ss FROM t),
      ev AS (SELECT *, NULL::VARCHAR AS prev, sha256('["d' || c || '",null,"edit",' || to_json(role) || ',' || (1700000000 + n) || ',' || snap || ',' || state || ',"' || ss || '"]') AS rs FROM t1 WHERE n % 2 = 0),
      ei AS (SELECT *, 'rev:' || left(rs, CASE WHEN c % 13 = 0 AND n = 2 THEN 7 ELSE 12 END) AS id FROM ev),
      od AS (SELECT t1.*, ei.id AS prev, sha256('["d' || t1.c || '",' || coalesce('"' || ei.id || '"', 'null') || ',"edit",' || to_json(t1.role) || ',' || (1700000000 + t1.n) || ',' || t1.snap || ',' || t1.state || ',"' || t1.ss || '"]') AS rs FROM t1 LEFT JOIN ei ON ei.c = t1.c AND ei.n = t1.n - 1 WHERE t1.n % 2 = 1),
      r AS (SELECT c, n, id, prev FROM ei UNION ALL SELECT c, n, 'rev:' || left(rs, 12), prev FROM od),
      p AS (SELECT r.c, r.n, r.id, CASE WHEN r.c % 17 = 0 AND r.n = 3 THEN 'rev:gone' || r.c WHEN r.c % 23 = 0 AND r.n = 0 THEN o.id ELSE r.prev END AS prev, r.c % 23 = 0 AND r.n = 0 AND o.id IS NOT NULL AS loop FROM r LEFT JOIN r o ON o.c = r.c AND o.n = 1),
      e AS (SELECT seq AS i, 'entry ' || entry_key AS k, p.id AS hid, p.c AS hc, coalesce(p.loop, false) AS loop FROM biblio LEFT JOIN p ON p.n = 0 AND p.c = seq + CASE WHEN seq % 8 = 4 THEN 1 ELSE 0 END),
      x AS (SELECT k || ' references missing source s' || (i % 20) AS error FROM e WHERE i % 5 = 0 AND i % 20 >= 15
      UNION SELECT k || ' references missing revision rev:none' || i FROM e WHERE i % 4 = 0 AND hid IS NULL UNION SELECT k || ' head belongs to another target' FROM e WHERE i % 8 = 4 AND hid IS NOT NULL
      UNION SELECT k || ' has a history cycle' FROM e WHERE i % 4 = 0 AND loop
      UNION SELECT k || ' has invalid contentHash' FROM e WHERE i % 21 = 0 UNION SELECT k || ' snapshot hash does not match' FROM e WHERE i % 8 = 0
      UNION SELECT k || ' has invalid approval id' FROM e WHERE i % 9 = 0 AND i % 18 <> 0
      UNION SELECT 'revision ' || id || ' snapshot hash does not match' FROM p WHERE c % 7 = 0 AND n = 0
      UNION SELECT 'revision ' || id || ' hash does not match' FROM p WHERE (c % 7 = 0 AND n = 0) OR (c % 11 = 0 AND n = 1) OR (c % 13 = 0 AND n = 2) OR (c % 17 = 0 AND n = 3) OR loop
      UNION SELECT 'revision ' || id || ' references missing ' || prev FROM p WHERE c % 17 = 0 AND n = 3) SELECT error FROM x""",
    "match_candidates": f"WITH {_MATCH} SELECT entry_key, id, rank, score, title_score, author_score FROM m",
    "unique_adoptable": f"WITH {_MATCH} SELECT entry_key, count(*) FILTER (score >= 0.7::DOUBLE) AS n, count(*) FILTER (score >= 0.7::DOUBLE) = 1 AS adoptable, CASE WHEN count(*) FILTER (score >= 0.7::DOUBLE) = 1 THEN min(CASE WHEN score >= 0.7::DOUBLE THEN id END) END AS id FROM m GROUP BY entry_key",
    "adoption_blocker": f"""WITH {_MATCH}, g AS (SELECT entry_key, min(seq) AS n, bool_or(rank = 1 AND score >= 0.7::DOUBLE) AS own, bool_or(rank > 1 AND score >= 0.7::DOUBLE) AS others FROM m GROUP BY entry_key),
      b2 AS (SELECT entry_key, CASE WHEN n % 7 = 0 THEN 'no provider support; human approval required' WHEN n % 11 = 0 OR (n % 3 <> 0 AND NOT coalesce(own, false)) THEN 'exact provider record is below the title/author threshold or cannot be scored'
        WHEN NOT coalesce(own, false) THEN 'selected search candidate is below the title/author threshold' WHEN others THEN 'multiple title-search candidates meet the threshold; human review required' WHEN n % 5 = 0 THEN 'proposal baseline is stale' END AS blocker FROM g) SELECT entry_key, blocker, blocker IS NULL AS adoptable FROM b2""",
    "provider_fallback": """SELECT d.doc_id, coalesce(quality = 1, false) OR d.doc_id % 2 = 0 AS found, CASE WHEN quality = 1 THEN 'labels' WHEN d.doc_id % 2 = 0 THEN source END AS provider FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "proposal_decisions": """WITH x AS (SELECT doc_id AS id, CASE WHEN doc_id % 4 = 3 THEN 'proposal not found' WHEN doc_id % 10 = 0 THEN 'proposal has already been decided' WHEN doc_id % 2 = 0 AND doc_id % 3 = 0 THEN 'proposal is stale' END AS error FROM documents)
      SELECT id, CASE WHEN error IS NULL THEN CASE WHEN id % 2 = 0 THEN 'adopted' ELSE 'rejected' END END AS outcome, 'me' AS reviewer, error FROM x""",
}
