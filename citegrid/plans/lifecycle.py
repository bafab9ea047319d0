"""Queries on the life of the ledger: an edited bibliography, its status, a restore, and older files."""

from __future__ import annotations

from pyspark.sql import functions as F

from citegrid.functions import canonical as cn
from citegrid.operators import lifecycle, proposals
from citegrid.plans.views import BIBLIO, biblio
from citegrid.sources import ledger as ledger_files
from citegrid.storage import shared_path

STAMP = 1700000000


def _before(spark, sf_dir):
    """The bibliography as it was: without evidence; records 10, 20, ... are still missing."""
    b = biblio(spark, sf_dir)
    return b.filter("seq % 10 <> 0").select("seq", "entry_type", "entry_key", cn.without(b.fields, ("bibsource",)).alias("fields"))


def _edited(spark, sf_dir):
    """As it is now: every tenth came, those with seq % 10 = 3 went, those with seq % 4 = 1 have another year."""
    b = biblio(spark, sf_dir)
    year = F.create_map(F.lit("year"), F.when(b.seq % 4 == 1, "2030").otherwise(b.fields["year"]))
    return b.filter("seq % 10 <> 3").select("seq", "entry_type", "entry_key", F.map_concat(cn.without(b.fields, ("bibsource", "year")), year).alias("fields"))


def _synced(spark, sf_dir):
    first = lifecycle.sync(lifecycle.empty(spark), _before(spark, sf_dir), "me", STAMP)
    return first, lifecycle.sync(first, _edited(spark, sf_dir), "me", STAMP + 1)


def ledger_sync(spark, sf_dir):
    _, state = _synced(spark, sf_dir)
    e, r = state["entries"], state["revisions"].select("id", "operation", F.col("entry.content_hash").alias("was"))
    return e.join(r, F.col("head") == F.col("id"), "left").select("entry_key", "deleted", "content_hash", "operation", "was")


def ledger_status(spark, sf_dir):
    """The states of the ledger before and after it was synchronised, and the errors of the first."""
    first, state = _synced(spark, sf_dir)
    now = _edited(spark, sf_dir)
    stale, locked = lifecycle.status(first, now), lifecycle.status(state, now)
    row = lambda name, s: spark.range(1).select(F.lit(name).alias("name"), F.lit(s["state"]).alias("value"), F.lit(int(s["revisions"])).cast("long").alias("n"), F.lit(int(s["orphaned"])).cast("long").alias("orphaned"))
    errors = stale["errors"].select(F.lit("error").alias("name"), F.col("error").alias("value"), F.lit(1).cast("long").alias("n"), F.lit(0).cast("long").alias("orphaned"))
    return errors.unionByName(row("first", stale)).unionByName(row("synced", locked)).unionByName(row("none", lifecycle.status(None, now)))


def ledger_restore(spark, sf_dir):
    """Every revision of a key whose number ends in 3 or 5 put back: the records then, and the chain of each."""
    _, state = _synced(spark, sf_dir)
    wanted = state["revisions"].filter("cast(substring(target, 2) as bigint) % 10 in (3, 5)").select(F.col("id").alias("prefix"))
    records, after = lifecycle.restore(state, wanted, _edited(spark, sf_dir), "me", STAMP + 2)
    depth = after["revisions"].groupBy(F.col("target").alias("entry_key")).agg(F.count(F.lit(1)).alias("revisions"))
    out = records.join(depth, "entry_key", "left").join(after["entries"].select("entry_key", "deleted"), "entry_key")
    return out.select("entry_key", F.col("fields")["year"].alias("year"), F.coalesce("revisions", F.lit(0)).cast("long").alias("revisions"), "deleted")


def embedded_import(spark, sf_dir):
    """Records of the older format: a third sealed with the hash of now, a third with the older kind, the rest wrongly."""
    b = biblio(spark, sf_dir)
    f = b.fields
    marker = F.when(b.seq % 3 == 0, cn.content_hash(b.entry_type, f)).when(b.seq % 3 == 1, cn.legacy_hash(b.entry_type, f)).otherwise("old")
    records = b.select("entry_type", "entry_key", F.map_concat(f, F.create_map(F.lit("integrity"), marker)).alias("fields"))
    e = lifecycle.embedded(records)["entries"]
    return e.select("entry_key", "source", (F.col("integrity_hash") == F.col("content_hash")).alias("sealed"), "integrity_source")


def history_diff(spark, sf_dir):
    """Every revision of the synchronised ledger against the bibliography of now; those of records that went have none."""
    _, state = _synced(spark, sf_dir)
    return lifecycle.history_diff(state, state["revisions"].select(F.col("id").alias("prefix")), _edited(spark, sf_dir)).select("entry_key", "field", "old", "new", "error")


def human_decisions(spark, sf_dir):
    """Proposals for another year that people adopt or reject, some of them stale; what is adopted is approved by its reviewer."""
    before = _before(spark, sf_dir)
    state = lifecycle.sync(lifecycle.empty(spark), before, "me", STAMP)
    changes = before.select(F.col("entry_key").alias("target"), "entry_type", F.map_concat(cn.without(before.fields, ("year",)), F.create_map(F.lit("year"), F.lit("2040"))).alias("fields"), "seq")
    state["proposals"] = proposals.create(before, changes, "agent", "newer", 2)
    number = F.substring("target", 2, 20).cast("long")
    asked = state["proposals"].select("id", (number % 3 > 0).alias("adopt"), F.concat(F.lit(" r"), number % 4).alias("reviewer"))
    now = before.select("entry_type", "entry_key", F.when(before.seq % 7 == 0, F.map_concat(cn.without(before.fields, ("year",)), F.create_map(F.lit("year"), F.lit("1")))).otherwise(before.fields).alias("fields"))
    state = lifecycle.sync(state, now, "me", STAMP + 1) | {"proposals": state["proposals"]}
    records, after, outcome = lifecycle.decide_proposals(state, now, asked, STAMP + 2)
    p = after["proposals"].select("id", "target", "decided_by", F.col("decision_revision").isNotNull().alias("revised")).join(outcome, "id")
    r = records.select("entry_key", F.col("fields")["year"].alias("year"))
    e = after["entries"].select("entry_key", (F.col("approval.content_hash") == F.col("content_hash")).alias("approved"))
    out = p.join(r, F.col("target") == F.col("entry_key")).join(e, "entry_key")
    return out.select("entry_key", "outcome", "error", "decided_by", "revised", "year", F.coalesce("approved", F.lit(False)).alias("approved"))


def joint_commit(spark, sf_dir):
    """Two committed edits of bibliography and ledger, and what an edit outside, one in between, and a torn commit come to."""
    folder = shared_path(spark, "joint")
    before, edited = _before(spark, sf_dir), _edited(spark, sf_dir).select("entry_type", "entry_key", "fields")
    to = lambda records, at: lambda state, _: (records, lifecycle.sync(state, records, "me", at))
    outcomes = [("first", str(lifecycle.commit_edit(spark, folder, to(before.select("entry_type", "entry_key", "fields"), STAMP))))]

    def refused(name, change, read=None):
        try:
            outcomes.append((name, str(lifecycle.commit_edit(spark, folder, change, read))))
        except lifecycle.OutOfSync as e:
            outcomes.append((name, str(e)))

    kept = ledger_files.load(spark, folder)["records"]
    refused("outside", to(edited, STAMP + 1), lambda: edited)
    reads = iter([kept, edited])
    refused("between", to(edited, STAMP + 1), lambda: next(reads))
    edited.write.parquet(f"{folder}/data/2-torn/records")  # data without a manifest
    refused("second", to(edited, STAMP + 1))
    state = ledger_files.load(spark, folder)
    heads = state["entries"].groupBy("deleted").agg(F.count(F.lit(1)).alias("n"), F.count("head").alias("revised")).select(F.when(F.col("deleted"), "deleted").otherwise("active").alias("name"), F.concat_ws(":", "n", "revised").alias("value"))
    rows = state["records"].agg(F.count(F.lit(1)).cast("string").alias("value")).select(F.lit("records").alias("name"), "value")
    return spark.createDataFrame(outcomes, "name string, value string").unionByName(heads).unionByName(rows)


QUERIES = {f.__name__: f for f in (ledger_sync, ledger_status, ledger_restore, embedded_import, history_diff, human_decisions, joint_commit)}

_H = """sha256('{"ENTRYTYPE":"' || entry_type || '","author":' || to_json(author) || CASE WHEN doi IS NULL THEN '' ELSE ',"doi":' || to_json(doi) END || CASE WHEN note IS NULL THEN '' ELSE ',"note":' || to_json(note) END || CASE WHEN title IS NULL THEN '' ELSE ',"title":' || to_json(title) END || ',"year":"' || %s || '"}')"""
_LIFE = f"{BIBLIO}, h AS (SELECT *, {_H % 'year'} AS was, {_H % chr(10).join(['CASE WHEN seq % 4 = 1 THEN', chr(39) + '2030' + chr(39), 'ELSE year END'])} AS now FROM biblio)"
ORACLES = {
    "ledger_sync": f"""WITH {_LIFE} SELECT entry_key, seq % 10 = 3 AS deleted, CASE WHEN seq % 10 = 3 THEN was ELSE now END AS content_hash,
      CASE WHEN seq % 10 = 3 OR (seq % 4 = 1 AND seq % 10 <> 0) THEN 'lock-sync' END AS operation, CASE WHEN seq % 10 = 3 OR (seq % 4 = 1 AND seq % 10 <> 0) THEN was END AS was FROM h""",
    "ledger_status": f"""WITH {BIBLIO}, n AS (SELECT count(*) AS n FROM biblio WHERE seq % 10 = 3 OR (seq % 4 = 1 AND seq % 10 <> 0))
      SELECT 'error' AS name, 'entry ' || entry_key || CASE WHEN seq % 10 = 3 THEN ' missing from bibliography' WHEN seq % 10 = 0 THEN ' missing from lock' ELSE ' content hash does not match' END AS value, 1::BIGINT AS n, 0::BIGINT AS orphaned FROM biblio WHERE seq % 10 IN (0, 3) OR seq % 4 = 1
      UNION ALL SELECT 'first', 'stale', 0, 0 UNION ALL SELECT 'synced', 'locked', n, 0 FROM n UNION ALL SELECT 'none', 'unlocked', 0, 0""",
    "ledger_restore": f"""WITH {BIBLIO} SELECT entry_key, CASE WHEN seq % 4 = 1 AND seq % 10 NOT IN (3, 5) THEN '2030' ELSE year END AS year,
      (CASE WHEN seq % 10 = 3 THEN 2 WHEN seq % 4 = 1 AND seq % 10 = 5 THEN 2 WHEN seq % 4 = 1 AND seq % 10 <> 0 THEN 1 ELSE 0 END)::BIGINT AS revisions, false AS deleted FROM biblio""",
    "embedded_import": f"WITH {BIBLIO} SELECT entry_key, bibsource AS source, seq % 3 <> 2 AS sealed, coalesce(bibsource, '') AS integrity_source FROM biblio",
    "history_diff": f"""WITH {BIBLIO} SELECT entry_key, CASE WHEN seq % 10 <> 3 THEN 'year' END AS field, CASE WHEN seq % 10 <> 3 THEN year END AS old, CASE WHEN seq % 10 <> 3 THEN '2030' END AS new, CASE WHEN seq % 10 = 3 THEN 'citation key not found' END AS error
      FROM biblio WHERE seq % 10 = 3 OR (seq % 4 = 1 AND seq % 10 <> 0)""",
    "human_decisions": f"""WITH {BIBLIO}, x AS (SELECT entry_key, seq, year, seq % 3 > 0 AS adopt, seq % 7 = 0 AS stale FROM biblio WHERE seq % 10 <> 0), y AS (SELECT *, CASE WHEN adopt AND stale THEN 'proposal is stale' END AS error FROM x)
      SELECT entry_key, CASE WHEN error IS NULL THEN CASE WHEN adopt THEN 'adopted' ELSE 'rejected' END END AS outcome, error, CASE WHEN error IS NULL THEN 'r' || (seq % 4) END AS decided_by, adopt AND error IS NULL AS revised,
      CASE WHEN adopt AND error IS NULL THEN '2040' WHEN stale THEN '1' ELSE year END AS year, adopt AND error IS NULL AS approved FROM y""",
    "joint_commit": f"""WITH {BIBLIO}, v AS (SELECT unnest([['first', '1'], ['outside', 'the bibliography was edited outside; synchronise it first'], ['between', 'the bibliography was edited while it was changed; retry'], ['second', '2']]) AS v)
      SELECT v[1] AS name, v[2] AS value FROM v UNION ALL SELECT 'records', CAST(count(*) AS VARCHAR) FROM biblio WHERE seq % 10 <> 3
      UNION ALL SELECT 'active', count(*) || ':' || count(*) FILTER (seq % 4 = 1 AND seq % 10 <> 0) FROM biblio WHERE seq % 10 <> 3 UNION ALL SELECT 'deleted', count(*) || ':' || count(*) FROM biblio WHERE seq % 10 = 3""",
}
