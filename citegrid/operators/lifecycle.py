"""The life of a ledger: capture, edits, sync, status, previews, restores and the import of embedded state.

A ledger is a dict of tables. entries: entry_key, deleted, content_hash, snapshot (STRUCT<entry_type, fields>), source,
provider, provider_id, integrity_hash, integrity_source, approval (struct), head. revisions: id, target, previous,
operation, actor, timestamp, snapshot and state (JSON), snapshot_sha256, revision_sha256, and the same again as columns,
snapshot_key, source and entry (the entry's columns). sources: entry_key, fields. proposals, if there are any: what
proposals.create() makes. Records are entry_type, entry_key and
fields, workflow fields included. Every step makes new tables from old ones: a join of keys and an aggregation or two,
whatever the number of entries; its tables are checkpointed, so that plans of many steps stay flat. update() is the one
that writes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citegrid.functions import canonical as cn
from citegrid.functions.vocab import SYSTEM_TYPES
from citegrid.operators import evidence, ledger, proposals
from citegrid.sources import ledger as store
from citegrid.storage import checkpoint

APPROVAL = {"id": "bibapprovalid", "kind": "bibapprovalkind", "method": "bibapprovalmethod", "reviewer": "bibapprovalreviewer", "content_hash": "bibapprovalcontent", "timestamp": "bibapprovaltimestamp", "batch_id": "bibapprovalbatch"}
STATE = ("content_hash", "snapshot", "source", "provider", "provider_id", "integrity_hash", "integrity_source", "approval")
ENTRY = (
    "entry_key string, deleted boolean, content_hash string, snapshot struct<entry_type:string,fields:map<string,string>>, source string, provider string, provider_id string, integrity_hash string, integrity_source string, "
    "approval struct<id:string,kind:string,method:string,reviewer:string,target:string,content_hash:string,timestamp:bigint,batch_id:string>, head string"
)
REVISION = f"id string, target string, previous string, operation string, actor string, timestamp bigint, snapshot string, state string, snapshot_sha256 string, revision_sha256 string, snapshot_key string, source string, entry struct<{ENTRY.replace(' string', ':string').replace(' boolean', ':boolean').replace(' struct', ':struct')}>"


def empty(spark: SparkSession) -> dict[str, DataFrame]:
    return {"entries": spark.createDataFrame([], ENTRY), "revisions": spark.createDataFrame([], REVISION), "sources": spark.createDataFrame([], "entry_key string, fields map<string,string>")}


def _ordinary(records: DataFrame) -> DataFrame:
    return records.filter(~F.lower("entry_type").isin(*SYSTEM_TYPES))


def approval_of(entry_key: Column, fields: Column) -> Column:
    """The approval that a record's fields spell, null if there is none; one with a part missing is an error."""
    parts = {n: fields[f] for n, f in APPROVAL.items()}
    missing = F.lit(False)
    for n in parts:
        missing = missing | (parts[n].isNull() if n != "reviewer" else F.lit(False))
    parts["timestamp"] = F.coalesce(parts["timestamp"].try_cast("bigint"), F.raise_error(F.concat(F.lit("invalid approval timestamp: "), entry_key)).cast("bigint"))
    made = F.struct(*[(entry_key if n == "target" else parts[n]).alias(n) for n in ("id", "kind", "method", "reviewer", "target", "content_hash", "timestamp", "batch_id")])
    some = F.coalesce(*[fields[f] for f in APPROVAL.values()]).isNotNull()
    return F.when(some & missing, F.raise_error(F.concat(F.lit("incomplete approval: "), entry_key)).cast(made_type())).when(some, made)


def made_type() -> str:
    return "struct<id:string,kind:string,method:string,reviewer:string,target:string,content_hash:string,timestamp:bigint,batch_id:string>"


def capture(records: DataFrame, entries: DataFrame) -> DataFrame:
    """The active entries that records stand for, given the entries before.

    A marker that is the content's hash seals it; another one keeps the seal of before, which is then stale; without one
    there is no seal. Heads stay.
    """
    old = entries.filter(~F.col("deleted")).select(F.col("entry_key").alias("_k"), F.col("integrity_hash").alias("_ih"), F.col("integrity_source").alias("_is"), F.col("head").alias("_head"))
    f = F.col("fields")
    r = _ordinary(records).withColumn("content_hash", cn.content_hash(F.col("entry_type"), f)).join(old, F.col("entry_key") == F.col("_k"), "left")
    fits, marked = f["integrity"] == F.col("content_hash"), f["integrity"].isNotNull()
    return r.select(
        "entry_key", F.lit(False).alias("deleted"), "content_hash", F.struct("entry_type", cn.bibliographic_fields(f).alias("fields")).alias("snapshot"),
        f["bibsource"].alias("source"), f["bibprovider"].alias("provider"), f["bibproviderid"].alias("provider_id"),
        F.when(fits, F.col("content_hash")).when(marked, F.col("_ih")).alias("integrity_hash"), F.when(fits, F.coalesce(f["bibsource"], F.lit(""))).when(marked, F.col("_is")).alias("integrity_source"),
        approval_of(F.col("entry_key"), f).alias("approval"), F.col("_head").alias("head"),
    )


def state_json(prefix: str = "") -> tuple[Column, Column]:
    """Snapshot and state (without head) of an entry as JSON."""
    c = lambda n: F.col(prefix + n)
    snapshot = cn.record_json(c("snapshot.entry_type"), c("entry_key"), c("snapshot.fields"))
    text = [F.concat(F.lit(f'"{n}":'), cn.json_text(c(n))) for n in STATE if n not in ("snapshot", "approval")]
    approval = F.concat(F.lit('"approval":'), F.coalesce(F.to_json(c("approval")), F.lit("null")))
    return snapshot, F.concat(F.lit("{"), F.concat_ws(",", *text, approval), F.lit("}"))


def _same(a: str, b: str) -> Column:
    """Whether two entries have the same state, heads aside."""
    plain = [n for n in STATE if n not in ("snapshot", "content_hash")]
    out = F.col(f"{a}.snapshot.entry_type").eqNullSafe(F.col(f"{b}.snapshot.entry_type")) & cn.json_map(F.col(f"{a}.snapshot.fields")).eqNullSafe(cn.json_map(F.col(f"{b}.snapshot.fields")))
    for n in plain:
        out = out & F.col(f"{a}.{n}").eqNullSafe(F.col(f"{b}.{n}"))
    return out


def edit(before: dict[str, DataFrame], records: DataFrame, operation: str, actor: str, timestamp: int, nodes: DataFrame | None = None) -> dict[str, DataFrame]:
    """The ledger after the bibliography has become ``records``; ``nodes`` are new evidence (entry_key, fields).

    Of an entry whose state changes, or that goes or comes back, what it was becomes a revision, which is its new head;
    one that goes leaves a tombstone. A new entry makes no revision. IDs are the shortest prefixes, of eight digits or
    more, that are no ID yet, in the order of keys.
    """
    entries, fresh = before["entries"], capture(records, before["entries"])
    active = entries.filter(~F.col("deleted")).select("entry_key")
    # an entry with its key both active and deleted is invalid; the active one counts
    old = entries.join(active.withColumnRenamed("entry_key", "_a"), F.col("deleted") & (F.col("entry_key") == F.col("_a")), "left_anti").alias("o")
    pairs = old.join(fresh.alias("n"), F.col("o.entry_key") == F.col("n.entry_key"), "full_outer")
    known, here = F.col("o.entry_key").isNotNull(), F.col("n.entry_key").isNotNull()
    gone = known & ~here & ~F.col("o.deleted")
    changed = known & F.col("o.snapshot").isNotNull() & (gone | (here & (F.col("o.deleted") | ~_same("o", "n"))))
    both = checkpoint(pairs.select(F.when(known, F.struct("o.*")).alias("o"), F.when(here, F.struct("n.*")).alias("n"), changed.alias("changed"), gone.alias("gone")))
    was = both.filter("changed").select("o.*")
    snapshot, state = state_json()
    made = was.select(F.col("entry_key").alias("target"), F.col("head").alias("previous"), F.lit(operation).alias("operation"), F.lit(actor).alias("actor"), F.lit(timestamp).cast("long").alias("timestamp"), snapshot.alias("snapshot"), state.alias("state"), F.col("entry_key").alias("snapshot_key"), "source", F.struct(*[n.split()[0] for n in ENTRY.split(", ")]).alias("entry"))
    made = ledger.hashed(made)
    ids = ledger.unused_ids(before["revisions"], made.select(F.col("revision_sha256").alias("sha256"), "target"), "target").withColumnRenamed("sha256", "_sha")
    made = checkpoint(made.join(ids, F.col("revision_sha256") == F.col("_sha")).drop("_sha"))
    heads = made.select(F.col("target").alias("_t"), F.col("id").alias("_id"))
    joined = both.join(heads, F.coalesce("n.entry_key", "o.entry_key") == F.col("_t"), "left")
    row = F.when(F.col("n").isNotNull(), F.col("n").withField("head", F.coalesce("_id", F.when(F.col("o").isNotNull(), F.col("o.head"))))).when(F.col("gone"), F.col("o").withField("deleted", F.lit(True)).withField("head", F.coalesce("_id", F.col("o.head")))).otherwise(F.col("o"))
    columns = [n.split()[0] for n in ENTRY.split(", ")]
    out = checkpoint(joined.select(row.alias("e")).select(*[F.col(f"e.{n}").alias(n) for n in columns]))
    sources = before["sources"] if nodes is None else evidence.append_evidence(before["sources"], nodes)
    revisions = before["revisions"].unionByName(made.select(*before["revisions"].columns))
    return before | {"entries": out, "revisions": revisions, "sources": sources}


def preview(before: dict[str, DataFrame], records: DataFrame) -> DataFrame:
    """The entries as an edit would leave them, nothing written."""
    return capture(records, before["entries"])


def sync(before: dict[str, DataFrame], records: DataFrame, actor: str, timestamp: int) -> dict[str, DataFrame]:
    """Take over what was edited outside."""
    return edit(before, records, "lock-sync", actor, timestamp)


def errors(state: dict[str, DataFrame]) -> DataFrame:
    """(error): the rules that the ledger breaks."""
    e = state["entries"].withColumns({"snapshot_key": F.when(F.col("snapshot").isNotNull(), F.col("entry_key")), "snapshot_hash": cn.content_hash(F.col("snapshot.entry_type"), F.col("snapshot.fields"))})
    asked = state.get("proposals")
    return ledger.validation_errors(e, state["revisions"], state["sources"], asked)


def status(state: dict[str, DataFrame] | None, records: DataFrame) -> dict:
    """unlocked, invalid, stale or locked, with all errors as a table (none to collect) and the numbers of revisions."""
    if state is None:
        return {"state": "unlocked", "errors": records.sparkSession.createDataFrame([("lockfile is missing",)], "error string"), "revisions": 0, "referenced": 0, "orphaned": 0}
    broken = checkpoint(errors(state))
    now = _ordinary(records).select("entry_key", cn.content_hash(F.col("entry_type"), F.col("fields")).alias("content_hash"))
    apart = ledger.consistency(now, state["entries"].filter(~F.col("deleted"))).select(F.concat(F.lit("entry "), "entry_key", F.lit(" "), "problem").alias("error"))
    found = "invalid" if not broken.isEmpty() else "stale" if not apart.isEmpty() else "locked"
    chains = ledger.chain(state["revisions"], state["entries"].select("entry_key", "head"))
    n = ledger.counts(state["revisions"], chains).first()
    return {"state": found, "errors": broken.unionByName(apart).distinct(), "revisions": n["revisions"], "referenced": n["referenced"], "orphaned": n["orphaned"]}


def state_fields(entry: str = "entry") -> Column:
    """The workflow fields that an entry's state stands for: what hydration and restores add to a snapshot's fields."""
    e = F.col(entry)
    values = {"bibsource": e["source"], "bibprovider": e["provider"], "bibproviderid": e["provider_id"], "integrity": e["integrity_hash"]} | {f: e["approval"][n].cast("string") for n, f in APPROVAL.items()}
    return F.map_filter(F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v)]), lambda k, v: v.isNotNull())


def restored(state: dict[str, DataFrame], wanted: DataFrame, records: DataFrame) -> DataFrame:
    """records with the revisions that ``wanted`` (prefix) names put in place: of keys that are there instead of what is,
    of others anew. An unknown or ambiguous prefix, and two revisions of one key, are errors."""
    found = ledger.by_prefix(wanted, state["revisions"])
    found = found.withColumn("id", F.when(F.col("error").isNull(), F.col("id")).otherwise(F.raise_error(F.concat(F.col("error"), F.lit(": "), "prefix")).cast("string")))
    r = state["revisions"].join(found.select("id"), "id").groupBy(F.col("target").alias("entry_key")).agg(F.count(F.lit(1)).alias("n"), F.first("entry").alias("entry"))
    r = r.withColumn("entry", F.when(F.col("n") == 1, F.col("entry")).otherwise(F.raise_error(F.concat(F.lit("several revisions of "), "entry_key")).cast(state["revisions"].schema["entry"].dataType)))
    back = r.select(F.col("entry.snapshot.entry_type").alias("entry_type"), "entry_key", F.map_concat("entry.snapshot.fields", state_fields()).alias("fields"))
    return records.select("entry_type", "entry_key", "fields").join(back.select("entry_key"), "entry_key", "left_anti").select("entry_type", "entry_key", "fields").unionByName(back)


def restore(state: dict[str, DataFrame], wanted: DataFrame, records: DataFrame, actor: str, timestamp: int) -> tuple[DataFrame, dict[str, DataFrame]]:
    """The bibliography and the ledger after a restore, which is an edit like any other and makes revisions of its own."""
    out = restored(state, wanted, records)
    return out, edit(state, out, "restore", actor, timestamp)


def adopt_proposals(state: dict[str, DataFrame], records: DataFrame, wanted: DataFrame, agent: str, timestamp: int) -> tuple[DataFrame, dict[str, DataFrame], DataFrame]:
    """wanted (id, blocker: why it can't be adopted, or null) -> the bibliography and the ledger after, and what each came to.

    Adopted are undecided proposals without a blocker whose record still has the baseline's content, of several for one
    record none; the decision names the revision that the change made. (id, outcome, error) says so.
    """
    p = state["proposals"]
    now = records.select(F.col("entry_key").alias("_k"), cn.content_hash(F.col("entry_type"), F.col("fields")).alias("_now"))
    j = wanted.select("id", "blocker").join(p, "id", "left").join(now, F.col("target") == F.col("_k"), "left")
    several = F.count(F.lit(1)).over(Window.partitionBy("target")) > 1
    error = (
        F.when(F.col("target").isNull(), "proposal not found").when(F.col("outcome").isNotNull(), "proposal has already been decided").when(F.col("blocker").isNotNull(), F.col("blocker"))
        .when(~F.col("_now").eqNullSafe(F.col("baseline_hash")), "proposal is stale").when(several, "several proposals for one record")
    )
    j = checkpoint(j.withColumn("error", error))
    j = j.withColumns({"_adopts": F.lit(True), "_fields": F.col("after"), "_who": F.lit(agent)})
    return _decided(state, records, j, agent, timestamp)


def _decided(state: dict[str, DataFrame], records: DataFrame, j: DataFrame, actor: str, timestamp: int) -> tuple[DataFrame, dict[str, DataFrame], DataFrame]:
    """j (proposals with error, _adopts, _fields: what the record becomes, _who) -> bibliography, ledger and outcomes, in one edit."""
    p, right = state["proposals"], j.filter("error IS NULL")
    good = right.filter("_adopts").select(F.col("after_type").alias("entry_type"), F.col("target").alias("entry_key"), F.col("_fields").alias("fields"))
    out = records.select("entry_type", "entry_key", "fields").join(good.select("entry_key"), "entry_key", "left_anti").select("entry_type", "entry_key", "fields").unionByName(good)
    out = checkpoint(out)
    after = edit(state, out, "proposal-adopt", actor, timestamp)
    heads = state["entries"].filter("NOT deleted").select(F.col("entry_key").alias("_e"), F.col("head").alias("_old")).join(after["entries"].filter("NOT deleted").select("entry_key", "head"), F.col("_e") == F.col("entry_key"))
    made = right.select(F.col("id").alias("_id"), F.col("target").alias("_t"), "_adopts", "_who").join(heads, F.col("_t") == F.col("_e"), "left")
    made = made.select("_id", "_adopts", "_who", F.when(F.col("_adopts") & ~F.col("head").eqNullSafe(F.col("_old")), F.col("head")).alias("_rev"))
    is_now, outcome = F.col("_id").isNotNull(), F.when(F.col("_adopts"), proposals.OUTCOMES[0]).otherwise(proposals.OUTCOMES[1])
    stored = {"outcome": outcome, "decided_by": F.col("_who"), "decided_at": F.lit(timestamp).cast("long"), "decision_revision": F.col("_rev")}
    next_p = p.join(made, F.col("id") == F.col("_id"), "left").withColumns({n: F.when(is_now, v).otherwise(F.col(n)) for n, v in stored.items()}).select(*p.columns)
    return out, after | {"proposals": checkpoint(next_p)}, j.select("id", F.when(F.col("error").isNull(), outcome).alias("outcome"), "error")


def decide_proposals(state: dict[str, DataFrame], records: DataFrame, decisions: DataFrame, timestamp: int) -> tuple[DataFrame, dict[str, DataFrame], DataFrame]:
    """decisions (id, adopt, reviewer) of people -> the bibliography and the ledger after, and what each came to (id, outcome,
    error).

    What is adopted is approved by its reviewer in the same edit: the record takes the proposal's content and an approval of
    it. A decided proposal, the adoption of a stale one, and of several for one record, are errors; a stale one may be rejected.
    """
    now = records.select(F.col("entry_key").alias("_k"), cn.content_hash(F.col("entry_type"), F.col("fields")).alias("_now"))
    j = decisions.select("id", F.col("adopt").alias("_adopts"), F.nullif(F.trim("reviewer"), F.lit("")).alias("_who")).join(state["proposals"], "id", "left").join(now, F.col("target") == F.col("_k"), "left")
    several = F.col("_adopts") & (F.count_if(F.col("_adopts")).over(Window.partitionBy("target")) > 1)
    error = (
        F.when(F.col("target").isNull(), "proposal not found").when(F.col("outcome").isNotNull(), "proposal has already been decided")
        .when(F.col("_adopts") & ~F.col("_now").eqNullSafe(F.col("baseline_hash")), "proposal is stale").when(several, "several proposals for one record")
    )
    batch = F.lit(ledger.batch_id(timestamp, "proposals"))
    values = {"kind": F.lit("human"), "method": F.lit("browser-review"), "reviewer": F.col("_who"), "content_hash": F.col("proposal_hash"), "timestamp": F.lit(str(timestamp)), "batch_id": batch}
    own = cn.approval_id(values["kind"], values["method"], values["reviewer"], F.col("target"), values["content_hash"], F.lit(timestamp).cast("long"), batch)
    spelt = F.create_map(*[x for n, f in APPROVAL.items() for x in (F.lit(f), own if n == "id" else values[n])])
    approval = F.map_filter(spelt, lambda k, v: v.isNotNull())
    j = checkpoint(j.withColumns({"error": error, "_fields": F.map_concat("after", approval)}))
    return _decided(state, records, j, "human", timestamp)


def history_diff(state: dict[str, DataFrame], wanted: DataFrame, records: DataFrame) -> DataFrame:
    """wanted (prefix) revisions against the records of now: prefix, id, entry_key, revised_type, current_type, field, old,
    new (one row for each field that differs, none if none does), error.

    Workflow fields count too, as a restore would put them back. An unknown or ambiguous prefix and a record that is no
    longer there are rows with an error.
    """
    found = ledger.by_prefix(wanted, state["revisions"]).select("prefix", "id", F.col("error").alias("_error"))
    r = state["revisions"].select(F.col("id").alias("_r"), F.col("target").alias("entry_key"), F.col("entry.snapshot.entry_type").alias("revised_type"), F.map_concat("entry.snapshot.fields", state_fields()).alias("_old"))
    now = records.select(F.col("entry_key").alias("_k"), F.col("entry_type").alias("current_type"), F.col("fields").alias("_new"))
    j = found.join(r, F.col("id") == F.col("_r"), "left").join(now, F.col("entry_key") == F.col("_k"), "left")
    error = F.coalesce("_error", F.when(F.col("_k").isNull(), "citation key not found"))
    names = F.array_sort(F.array_union(F.map_keys("_old"), F.map_keys("_new")))
    each = F.transform(names, lambda n: F.struct(n.alias("field"), F.try_element_at("_old", n).alias("old"), F.try_element_at("_new", n).alias("new")))
    rows = F.when(error.isNull(), F.filter(each, lambda x: ~x["old"].eqNullSafe(x["new"]))).otherwise(F.array(F.lit(None).cast("struct<field:string,old:string,new:string>")))
    return j.select("prefix", "id", "entry_key", "revised_type", "current_type", error.alias("error"), F.explode(rows).alias("x")).select("prefix", "id", "entry_key", "revised_type", "current_type", "x.*", "error")


def embedded(records: DataFrame) -> dict[str, DataFrame]:
    """The ledger that records of the older format hold in themselves: evidence rows, and workflow fields of entries. A
    marker that is the content's hash, of now or of the older kind, seals the content; any other stays as it is, stale."""
    f = F.col("fields")
    e = _ordinary(records).withColumns({"content_hash": cn.content_hash(F.col("entry_type"), f), "_legacy": cn.legacy_hash(F.col("entry_type"), f)})
    fits = (f["integrity"] == F.col("content_hash")) | (f["integrity"] == F.col("_legacy"))
    entries = e.select(
        "entry_key", F.lit(False).alias("deleted"), "content_hash", F.struct("entry_type", cn.bibliographic_fields(f).alias("fields")).alias("snapshot"),
        f["bibsource"].alias("source"), f["bibprovider"].alias("provider"), f["bibproviderid"].alias("provider_id"), F.when(fits, F.col("content_hash")).otherwise(f["integrity"]).alias("integrity_hash"),
        F.when(f["integrity"].isNotNull(), F.coalesce(f["bibsource"], F.lit(""))).alias("integrity_source"), F.lit(None).cast(made_type()).alias("approval"), F.lit(None).cast("string").alias("head"),
    )
    none = empty(records.sparkSession)
    return none | {"entries": entries, "sources": records.filter(F.lower("entry_type") == "bibsource").select("entry_key", "fields")}


def update(spark: SparkSession, folder: str, change: Callable[[dict[str, DataFrame]], dict[str, DataFrame]]) -> int:
    """Load the newest version of the ledger, change it, check it and commit it: the version that was written.

    A change that leaves errors is not written; nor is one made while another was committed, which fails and can be tried
    again on what is there then.
    """
    version = store.current_version(spark, folder)
    before = store.load(spark, folder, version) if version else empty(spark)
    after = change(before)
    broken = errors(after).limit(5).collect()
    if broken:
        raise ValueError("invalid ledger: " + "; ".join(r["error"] for r in broken))
    return store.commit(after, folder, version)


class OutOfSync(RuntimeError):
    """The bibliography is not what the ledger, or an edit, has read."""


def bibliography_hash(records: DataFrame) -> str:
    """A hash of the records (entry_type, entry_key, fields), in whatever order: their number and two sums over parts of the
    SHA-256 of each, a row to the driver."""
    h = F.sha2(cn.record_json(F.col("entry_type"), F.col("entry_key"), F.col("fields")), 256)
    part = lambda at: F.sum(F.conv(F.substring(h, at, 15), 16, 10).cast("decimal(38,0)"))
    row = records.agg(F.count(F.lit(1)).alias("n"), part(1).alias("a"), part(16).alias("b")).first()
    return f"{row['n']}:{row['a'] or 0}:{row['b'] or 0}"


Change = Callable[[dict[str, DataFrame], DataFrame], tuple[DataFrame, dict[str, DataFrame]]]


def commit_edit(spark: SparkSession, folder: str, change: Change, read: Callable[[], DataFrame] | None = None) -> int:
    """Change the bibliography and its ledger together: the version that was written, with the table ``records``.

    ``read`` gives the bibliography as it is (the last version's by default), ``change`` the two after the edit. Both are
    published by one manifest, so a torn commit is never seen. An OutOfSync error, and nothing written, if the bibliography
    has other content than the ledger knows (sync it first), if it is edited outside before the commit, or if another
    commit came first.
    """
    version = store.current_version(spark, folder)
    before = store.load(spark, folder, version) if version else empty(spark)
    last = before.pop("records", None)
    read = read or (lambda: last if last is not None else spark.createDataFrame([], "entry_type string, entry_key string, fields map<string,string>"))
    records = checkpoint(read().select("entry_type", "entry_key", "fields"))
    seen = bibliography_hash(records)
    now = _ordinary(records).select("entry_key", cn.content_hash(F.col("entry_type"), F.col("fields")).alias("content_hash"))
    if version and not ledger.consistency(now, before["entries"].filter(~F.col("deleted"))).isEmpty():
        raise OutOfSync("the bibliography was edited outside; synchronise it first")
    out, after = change(before, records)
    broken = errors(after).limit(5).collect()
    if broken:
        raise ValueError("invalid ledger: " + "; ".join(r["error"] for r in broken))
    if bibliography_hash(read()) != seen:
        raise OutOfSync("the bibliography was edited while it was changed; retry")
    try:
        return store.commit(after | {"records": out}, folder, version)
    except RuntimeError as e:
        raise OutOfSync(str(e)) from e
