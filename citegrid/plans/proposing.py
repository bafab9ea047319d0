"""Queries on proposals: their identity, the evidence frozen in them, and what validation finds in tampered ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from citegrid.functions import canonical as cn
from citegrid.functions import projections as pj
from citegrid.operators import linkage, proposals
from citegrid.plans.lifecycle import _H
from citegrid.plans.views import BIBLIO, TOKENS, biblio
from citegrid.storage import checkpoint


def proposal_identity(spark, sf_dir):
    """Every record proposed with another year."""
    b = biblio(spark, sf_dir)
    changes = b.select(F.col("entry_key").alias("target"), "entry_type", pj.overlay(b.fields, F.create_map(F.lit("year"), F.lit("2031"))).alias("fields"))
    return proposals.create(b, changes, " agent ", "newer", 5).select("target", "id", "baseline_hash", "proposal_hash")


def _from_provider(spark, sf_dir):
    """A proposal for every record from a provider that knows it, by its own title or, for every third, by another."""
    b = biblio(spark, sf_dir)
    doi = F.concat(F.lit("10.1000/d"), "seq")
    title = F.when(F.col("seq") % 3 == 0, F.lit("Quite another work")).otherwise(F.coalesce("title", F.lit("")))
    made = lambda id_, t: pj.literature_of_fields(F.lit("crossref"), id_, F.col("entry_type"), F.create_map(F.lit("title"), t, F.lit("author"), F.col("author"), F.lit("year"), F.lit("2031"), F.lit("doi"), id_))
    rows = b.select("seq", F.col("entry_key").alias("target"), doi.alias("record_id"), made(doi, title).alias("record"), made(F.lit("10.1000/z"), F.lit("Something else")).alias("other"), F.coalesce("title", F.lit("")).alias("query"))
    rows = checkpoint(rows.withColumns({"request_url": F.lit("u"), "media_type": F.lit("application/json")}))
    searches = rows.select("target", "query", "request_url", "media_type", F.lit("{}").alias("response"), F.array("record", "other").alias("candidates"), F.array(F.lit(2.0), F.lit(1.0)).alias("scores"))
    lookups = rows.select("record_id", "record", "request_url", "media_type", F.to_json("record").alias("response"))
    return proposals.create_provider(b, rows.select("target", F.upper("record_id").alias("record_id")), searches, lookups, "agent", "provider knows better", 0.9, 7)


def provider_proposals(spark, sf_dir):
    b = biblio(spark, sf_dir)
    current = b.select("entry_key", F.when(b.seq % 7 == 0, "other").otherwise(cn.content_hash(b.entry_type, b.fields)).alias("content_hash"))
    v = proposals.views(_from_provider(spark, sf_dir), current)
    return v.select("target", "stale", "score", "blocker", "adoptable")


def proposal_validation(spark, sf_dir):
    """Proposals tampered with in twelve ways, half of them by someone who computes the identity anew."""
    p = checkpoint(_from_provider(spark, sf_dir)).withColumn("_i", F.substring("target", 2, 20).cast("long") % 14)
    i, source = F.col("_i"), F.col("provider.sources")
    changed = lambda at, name, value: p_with(at, F.col(name), value)

    def p_with(at, old, value):
        return F.when(i.isin(*at), value).otherwise(old)

    named = lambda k, v: F.struct(source[k]["entry_type"].alias("entry_type"), source[k]["entry_key"].alias("entry_key"), pj.overlay(source[k]["fields"], v).alias("fields"))
    forged = F.array(source[0], source[1], named(2, F.create_map(F.lit("responsesha256"), F.repeat(F.lit("0"), 64))))
    moved = F.array(named(0, F.create_map(F.lit("target"), F.lit("nobody"))), source[1], source[2])
    sources = F.when(i == 3, forged).when(i == 8, moved).when(i == 11, F.slice(source, 1, 0)).otherwise(source)
    candidates = F.when(i == 4, F.reverse("provider.candidates")).when(i == 5, F.slice("provider.candidates", 1, 1)).otherwise(F.col("provider.candidates"))
    threshold = F.when(i == 6, F.lit(1.5)).otherwise(F.col("provider.threshold"))
    p = checkpoint(p.withColumns({
        "provider": F.struct(F.col("provider.record").alias("record"), candidates.alias("candidates"), sources.alias("sources"), threshold.alias("threshold")),
        "after": changed([7], "after", pj.overlay(F.col("after"), F.create_map(F.lit("year"), F.lit("1")))),
    }))
    again = proposals.identified(p.drop("_i")).select(F.col("target").alias("_t"), F.col("id").alias("_id"), F.col("proposal_hash").alias("_h"))
    p = p.join(again, F.col("target") == F.col("_t")).withColumns({"id": F.col("_id"), "proposal_hash": F.col("_h")}).drop("_t", "_id", "_h")
    late = {
        "after": changed([1], "after", pj.overlay(F.col("after"), F.create_map(F.lit("title"), F.lit("Forged")))), "reason": changed([2], "reason", F.lit("another")), "agent": changed([9], "agent", F.lit(" ")),
        "before_key": changed([10], "before_key", F.lit("nobody")), "outcome": changed([12, 13], "outcome", F.lit("adopted")), "decided_at": changed([12, 13], "decided_at", F.lit(9).cast("long")),
        "decision_revision": changed([12, 13], "decision_revision", F.concat(F.lit("rev:"), "target")),
    }
    p = checkpoint(p.withColumns(late))
    revisions = p.filter(i.isin(12, 13)).select(F.concat(F.lit("rev:"), "target").alias("id"), "target", F.when(i == 12, F.col("before_json")).otherwise(F.col("after_json")).alias("snapshot"))
    errors = proposals.invalid(p).unionByName(proposals.misplaced(p, revisions).withColumn("error", F.lit("misplaced")))
    return p.select("target", F.col("id").alias("_id")).join(errors, F.col("_id") == F.col("id"), "left").select("target", "error")


QUERIES = {f.__name__: f for f in (proposal_identity, provider_proposals, proposal_validation)}

_JSON = """'{"entry_type":"' || entry_type || '","entry_key":"' || entry_key || '","fields":{"author":' || to_json(author) || CASE WHEN doi IS NULL THEN '' ELSE ',"doi":' || to_json(doi) END || CASE WHEN note IS NULL THEN '' ELSE ',"note":' || to_json(note) END || CASE WHEN title IS NULL THEN '' ELSE ',"title":' || to_json(title) END || ',"year":"' || %s || '"}}'"""
ORACLES = {
    "proposal_identity": f"""WITH {BIBLIO}, h AS (SELECT entry_key AS target, {_H % 'year'} AS b, {_H % "'2031'"} AS a, {_JSON % 'year'} AS bj, {_JSON % "'2031'"} AS aj FROM biblio)
      SELECT target, 'proposal:' || sha256('["' || target || '","agent","newer",5,"' || b || '","' || a || '",' || bj || ',' || aj || ',null]') AS id, b AS baseline_hash, a AS proposal_hash FROM h""",
    "provider_proposals": f"""WITH {BIBLIO}, x AS (SELECT seq, entry_key AS target, author, title, {TOKENS.format('title')} AS a, CASE WHEN seq % 3 = 0 THEN ['another', 'quite', 'work'] ELSE {TOKENS.format('title')} END AS b FROM biblio),
      s AS (SELECT *, CASE WHEN title IS NULL THEN NULL ELSE round((CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE 0.7 * 2 * len(list_intersect(a, b)) / (len(a) + len(b)) END + 0.3) * 10000) / 10000 END AS score FROM x)
      SELECT target, seq % 7 = 0 AS stale, score::DOUBLE AS score, CASE WHEN coalesce(score, 0) < 0.9 THEN '{linkage.RECORD_BELOW}' WHEN seq % 7 = 0 THEN '{linkage.STALE}' END AS blocker, coalesce(score, 0) >= 0.9 AND seq % 7 <> 0 AS adoptable FROM s""",
    "proposal_validation": f"""SELECT 'd' || doc_id AS target, CASE doc_id % 14 WHEN 1 THEN '{proposals.RULES['hash']}' WHEN 2 THEN '{proposals.RULES['id']}' WHEN 3 THEN 'provider provenance key does not match its metadata' WHEN 4 THEN '{proposals.RULES['order']}'
      WHEN 5 THEN '{proposals.RULES['count']}' WHEN 6 THEN '{proposals.RULES['threshold']}' WHEN 7 THEN '{proposals.RULES['projection'].replace("'", "''")}' WHEN 8 THEN 'search provenance key does not match its metadata' WHEN 9 THEN '{proposals.RULES['asked']}' WHEN 10 THEN '{proposals.RULES['key']}'
      WHEN 11 THEN '{proposals.RULES['receipts']}' WHEN 13 THEN 'misplaced' END AS error FROM documents""",
}
