"""The revision ledger: consistency, chains, versions, restores and validation.

Tables: entries (entry_key, deleted, content_hash, snapshot, source, integrity, approval, head), revisions (id, target,
previous, operation, actor, timestamp, snapshot, state), sources (entry_key, fields).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citegrid.functions import canonical as cn
from citegrid.functions import text as tx
from citegrid.operators import proposals as pr
from citegrid.storage import checkpoint


def consistency(bibliography: DataFrame, lock: DataFrame) -> DataFrame:
    """(entry_key, content_hash) on both sides -> entry_key and what is wrong, for the keys that do not agree."""
    b, k = bibliography.select("entry_key", F.col("content_hash").alias("b"), F.lit(1).alias("in_b")), lock.select("entry_key", F.col("content_hash").alias("k"), F.lit(1).alias("in_k"))
    both = b.join(k, "entry_key", "full_outer")
    problem = F.when(F.col("in_b").isNull(), "missing from bibliography").when(F.col("in_k").isNull(), "missing from lock").when(~F.col("b").eqNullSafe(F.col("k")), "content hash does not match")
    return both.select("entry_key", problem.alias("problem")).filter("problem IS NOT NULL")


def state(structural_errors: int, problems: int, exists: bool = True) -> str:
    """unlocked, invalid, stale or locked."""
    return "unlocked" if not exists else "invalid" if structural_errors else "stale" if problems else "locked"


def dangling(refs: DataFrame, ref: str, targets: DataFrame, target: str) -> DataFrame:
    """Rows whose reference is set but names nothing."""
    return refs.filter(F.col(ref).isNotNull()).join(targets.select(F.col(target).alias("_t")).distinct(), F.col(ref) == F.col("_t"), "left_anti")


def _jumps(revisions: DataFrame) -> tuple[list[DataFrame], DataFrame | None]:
    """Tables (at, to) of the ancestors 1, 2, 4, ... steps back, and the revisions (at) from which a cycle is reached.

    A path of more steps than there are links comes by a revision twice, so whatever has an ancestor that far back leads
    into a cycle, and nothing else does.
    """
    level = checkpoint(revisions.filter(F.col("previous").isNotNull()).select(F.col("id").alias("at"), F.col("previous").alias("to")))
    links, levels = level.count(), []
    while not level.isEmpty():
        if 1 << len(levels) > links:
            return levels, level.select("at").distinct()
        levels.append(level)
        level = checkpoint(level.alias("a").join(level.alias("b"), F.col("a.to") == F.col("b.at")).select(F.col("a.at").alias("at"), F.col("b.to").alias("to")))
    return levels, None


def cyclic(revisions: DataFrame) -> DataFrame:
    """(id) of the revisions from which a cycle is reached."""
    _, found = _jumps(revisions)
    return revisions.select("id").limit(0) if found is None else found.select(F.col("at").alias("id"))


def chain(revisions: DataFrame, heads: DataFrame) -> DataFrame:
    """(entry_key, head) -> entry_key, position (0 at the head), id, and ``error`` for a missing link or another's revision.

    Chains are followed by doubling: with the ancestors 2**k steps back, the positions reached are twice as many after
    each round, so rounds grow with the logarithm of the longest chain, of any length. Each round is checkpointed, which
    keeps the plan flat. A head from which a cycle is reached is not followed: it has one row, with the error ``cycle``.
    Revision IDs are unique; a null head has no rows.
    """
    levels, loops = _jumps(revisions)
    start = heads.filter(F.col("head").isNotNull()).select("entry_key", F.lit(0).cast("long").alias("position"), F.col("head").alias("id"))
    looped = None
    if loops is not None:
        looped = start.join(loops, F.col("id") == F.col("at"), "left_semi")
        start = start.join(loops, F.col("id") == F.col("at"), "left_anti")
    reached = start = checkpoint(start)
    for k, level in enumerate(levels):
        more = checkpoint(reached.join(level, F.col("id") == F.col("at")).select("entry_key", (F.col("position") + (1 << k)).alias("position"), F.col("to").alias("id")))
        if more.isEmpty():
            break
        reached = reached.unionByName(more)
    r = revisions.select(F.col("id").alias("rid"), "target")
    error = F.when(F.col("rid").isNull(), "missing revision").when(F.col("target") != F.col("entry_key"), "revision of another target")
    out = reached.join(r, F.col("id") == F.col("rid"), "left").select("entry_key", "position", "id", error.alias("error"))
    return out if looped is None else out.unionByName(looped.select("entry_key", "position", "id", F.lit("cycle").alias("error")))


def counts(revisions: DataFrame, chains: DataFrame) -> DataFrame:
    """Numbers of revisions, of those that a chain reaches, and of the rest."""
    reached = chains.filter("error IS NULL").agg(F.count_distinct("id").alias("referenced"))
    return revisions.agg(F.count(F.lit(1)).alias("revisions")).crossJoin(F.broadcast(reached)).withColumn("orphaned", F.greatest(F.lit(0), F.col("revisions") - F.col("referenced")))


def versions(events: DataFrame, key: str, order: list[str], content: list[str]) -> DataFrame:
    """Events as versions of a key: version (from 1) and whether its content differs from the one before."""
    w = Window.partitionBy(key).orderBy(*order)
    differs = F.lit(False)
    for c in content:
        differs = differs | ~F.col(c).eqNullSafe(F.lag(c).over(w))
    n = F.row_number().over(w)
    return events.withColumns({"version": n, "is_change": (n == 1) | differs})


def as_of(events: DataFrame, key: str, time: str, moment: Column, values: list[str]) -> DataFrame:
    """The last state of each key at a moment: an aggregation, no sort. Ties go to the larger values."""
    last = F.max(F.struct(time, *values)).alias("s")
    return events.filter(F.col(time) <= moment).groupBy(key).agg(last).select(key, *[F.col(f"s.{c}").alias(c) for c in [time, *values]])


def by_prefix(wanted: DataFrame, revisions: DataFrame) -> DataFrame:
    """(prefix) -> prefix, id, error. A prefix has eight hex digits or more and must name one revision only.

    A whole ID, ``rev:`` included, names its own revision even if other IDs begin with it. Prefixes meet IDs on their first
    eight digits, so no pairs are tried that cannot match.
    """
    digits = F.regexp_replace(F.col("id"), "^rev:", "")
    r = revisions.select("id", digits.alias("d"), F.left(digits, F.lit(8)).alias("d8"))
    p = wanted.select("prefix", F.regexp_replace("prefix", "^rev:", "").alias("p")).withColumn("p8", F.left("p", F.lit(8)))
    found = p.join(r, (F.col("p8") == F.col("d8")) & F.startswith("d", F.col("p")), "left").groupBy("prefix", "p").agg(F.count("id").alias("n"), F.min("id").alias("id"), F.max(F.when(F.col("id") == F.col("prefix"), F.col("id"))).alias("own"))
    found = found.withColumns({"n": F.when(F.col("own").isNotNull(), 1).otherwise(F.col("n")), "id": F.coalesce("own", "id")})
    error = F.when(F.length("p") < 8, "prefix is too short").when(F.col("n") == 0, "not found").when(F.col("n") > 1, "ambiguous")
    return found.select("prefix", F.when(error.isNull(), F.col("id")).alias("id"), error.alias("error"))


def shortest_ids(hashes: DataFrame, least: int = 8) -> DataFrame:
    """(sha256) -> sha256, id: rev: and the shortest prefix of ``least`` digits or more that no other hash begins with.

    Sorted neighbours have the longest prefix in common, so each hash is compared with two others only; hashes are dealt
    by their first digits, which bounds a window's rows to a 65,536th of all.
    """
    if least < 4:
        raise ValueError("prefixes have four digits or more")
    h = hashes.select("sha256").distinct()
    w = Window.partitionBy(F.left("sha256", F.lit(4))).orderBy("sha256")
    common = lambda a, b: F.coalesce(F.array_position(F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1))), True) - 1, F.lit(0))
    other = F.greatest(common(F.col("sha256"), F.lag("sha256").over(w)), common(F.col("sha256"), F.lead("sha256").over(w)))
    return h.withColumn("_n", F.greatest(F.lit(least), F.coalesce(other, F.lit(0)) + 1)).select("sha256", F.concat(F.lit("rev:"), F.left("sha256", F.col("_n").cast("int"))).alias("id"))


def unused_ids(known: DataFrame, new: DataFrame, order: str, least: int = 8) -> DataFrame:
    """new (sha256, order), one after the other in that order -> sha256, id: rev: and the shortest prefix of ``least`` digits
    or more that is no ID yet, neither of known (id) nor of the ones before.

    A prefix goes to the first of those hashes that got none of its shorter ones, so prefixes are given length by length:
    an aggregation each, in which no group is gathered, whatever its size. Lengths grow with the logarithm of the largest
    group. A hash that stands more often than there are prefixes left is an error.
    """
    digits = known.select(F.regexp_replace("id", "^rev:", "").alias("p"))
    rest = checkpoint(new.select("sha256", F.col(order).alias("_o"), F.monotonically_increasing_id().alias("_row")))
    none = F.lit(None).cast("string")
    found, n = rest.limit(0).select("sha256", none.alias("d")), least
    while not rest.isEmpty():
        last = F.coalesce(F.length("sha256") < n, F.lit(True))
        rest = rest.withColumn("p", F.when(last, F.raise_error(F.lit("no revision ID is left for a hash")).cast("string")).otherwise(F.left("sha256", F.lit(n))))
        first = rest.groupBy("p").agg(F.min(F.struct("_o", "sha256", "_row")).alias("f"))
        first = first.join(digits.filter(F.length("p") == n), "p", "left_anti").select("p", F.col("f._row").alias("_first"))
        first = F.broadcast(first) if n <= 3 else first  # 4096 rows at most, each for many
        step = checkpoint(rest.join(first, "p", "left").select("sha256", "_o", "_row", F.when(F.col("_row") == F.col("_first"), F.col("p")).alias("d")))
        found = found.unionByName(step.filter("d IS NOT NULL").select("sha256", "d"))
        rest, n = step.filter("d IS NULL").drop("d"), n + 1
    return found.select("sha256", F.concat(F.lit("rev:"), F.col("d")).alias("id"))


def snapshot_hash(snapshot: Column, state: Column) -> Column:
    """SHA-256 of a revision's [snapshot, state], both JSON."""
    return F.sha2(F.concat(F.lit("["), snapshot, F.lit(","), state, F.lit("]")), 256)


def revision_hash(target: Column, previous: Column, operation: Column, actor: Column, timestamp: Column, snapshot: Column, state: Column, snapshot_sha256: Column) -> Column:
    """SHA-256 of the eight values of a revision as a JSON array; its link to the one before is one of them."""
    parts = [cn.json_text(target), cn.json_text(previous), cn.json_text(operation), cn.json_text(actor), timestamp.cast("string"), snapshot, state, cn.json_text(snapshot_sha256)]
    return F.sha2(F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]")), 256)


def hashed(revisions: DataFrame) -> DataFrame:
    """revisions (target, previous, operation, actor, timestamp, snapshot, state) with snapshot_sha256 and revision_sha256."""
    c = F.col
    out = revisions.withColumn("snapshot_sha256", snapshot_hash(c("snapshot"), c("state")))
    return out.withColumn("revision_sha256", revision_hash(c("target"), c("previous"), c("operation"), c("actor"), c("timestamp"), c("snapshot"), c("state"), c("snapshot_sha256")))


def commit_edit(old: DataFrame, new: DataFrame, operation: str, actor: str, timestamp: int) -> DataFrame:
    """Revisions that an edit makes. ``old`` and ``new``: entry_key, content_hash, snapshot (JSON), state (JSON), head.

    A key that existed and has another state now gets a revision of what it was; one that is gone gets one too and leaves
    a tombstone; a new key gets none. The revision links to the key's head.
    """
    o = old.select("entry_key", F.col("content_hash").alias("oh"), F.col("state").alias("os"), "snapshot", F.col("head").alias("previous"))
    n = new.select("entry_key", F.col("content_hash").alias("nh"), F.col("state").alias("ns"), F.lit(True).alias("here"))
    j = o.join(n, "entry_key", "left").filter(F.col("here").isNull() | ~F.col("oh").eqNullSafe(F.col("nh")) | ~F.col("os").eqNullSafe(F.col("ns")))
    made = j.select("entry_key", F.col("entry_key").alias("target"), F.lit(operation).alias("operation"), F.lit(actor).alias("actor"), F.lit(timestamp).cast("long").alias("timestamp"), "previous", "snapshot", F.col("os").alias("state"), F.col("here").isNull().alias("tombstone"))
    return hashed(made)


def restore(revisions: DataFrame, revision_id: Column, current: DataFrame) -> DataFrame:
    """The rows (entry_key, snapshot, state) that restoring revisions puts in place, and whether the key is inserted anew."""
    r = revisions.filter(F.col("id") == revision_id).select(F.col("target").alias("entry_key"), "snapshot", "state")
    return r.join(current.select("entry_key", F.lit(True).alias("here")), "entry_key", "left").select("entry_key", "snapshot", "state", F.col("here").isNull().alias("inserted"))


def validation_errors(entries: DataFrame, revisions: DataFrame, sources: DataFrame, proposals: DataFrame | None = None, version: str = "1.1", tool_version: str = "1") -> DataFrame:
    """All violations as a set of (error), in no order; entries need entry_key, deleted,
    content_hash, snapshot_key, snapshot_hash, source, integrity_hash, integrity_source, approval (struct or null), head;
    revisions id, target, previous, operation, actor, timestamp, snapshot and state (JSON), snapshot_sha256,
    revision_sha256, snapshot_key, source; proposals what a ledger keeps of them (proposals.STORED).
    """
    spark = entries.sparkSession
    e, key = entries, F.concat(F.lit("entry "), "entry_key")
    say = lambda df, *parts: df.select(F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts]).alias("error"))
    bad_sha = lambda c: ~F.coalesce(tx.is_sha256(F.col(c)), F.lit(False))
    a = F.col("approval")
    own = cn.approval_id(a["kind"], a["method"], a["reviewer"], a["target"], a["content_hash"], a["timestamp"], a["batch_id"])
    heads = e.filter("head IS NOT NULL").join(revisions.select(F.col("id").alias("rid"), "target"), F.col("head") == F.col("rid"), "left")
    parents = revisions.filter("previous IS NOT NULL").alias("r").join(revisions.alias("p"), F.col("r.previous") == F.col("p.id"), "left")
    full = revision_hash(*[F.col(n) for n in ("target", "previous", "operation", "actor", "timestamp", "snapshot", "state", "snapshot_sha256")])
    digits = F.substring(F.col("id"), 5, 64)
    named = F.coalesce(F.startswith("id", F.lit("rev:")) & (F.length(digits) >= 8) & F.startswith(full, digits), F.lit(False))
    # rules on one row are one pass over the rows, those on a row and the revision it names one over both
    text = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    each = lambda df, *broken: df.select(F.explode(F.array(*[F.when(c, F.struct(text(*parts).alias("error"))) for c, *parts in broken])).alias("x")).filter("x IS NOT NULL").select("x.error")
    c, revision, some = F.expr, ("revision ", F.col("id")), a.isNotNull()
    rules = [
        say(dangling(e, "source", sources, "entry_key"), key, " references missing source ", F.col("source")),
        say(e.groupBy("entry_key").agg(F.count_distinct("deleted").alias("n")).filter("n > 1"), key, " is both active and deleted"),
        each(heads, (c("rid IS NULL"), key, " references missing revision ", F.col("head")), (c("target <> entry_key"), key, " head belongs to another target")),
        say(e.join(cyclic(revisions), F.col("head") == F.col("id"), "left_semi"), key, " has a history cycle"),
        each(
            e,
            (bad_sha("content_hash"), key, " has invalid contentHash"),
            (c("snapshot_key IS NOT NULL AND (snapshot_key <> entry_key OR NOT snapshot_hash <=> content_hash)"), key, " snapshot hash does not match"),
            (F.col("integrity_hash").isNotNull() & bad_sha("integrity_hash"), key, " has invalid integrity contentHash"),
            (c("integrity_hash IS NOT NULL AND NOT source <=> integrity_source"), key, " integrity source does not match"),
            (some & ((a["kind"] != "human") | (a["method"] != "browser-review")), key, " has invalid approval type"),
            (some & ((a["target"] != F.col("entry_key")) | ~F.coalesce(tx.is_sha256(a["content_hash"]), F.lit(False))), key, " has invalid approval target or contentHash"),
            (some & ((a["timestamp"] == 0) | (F.trim(a["batch_id"]) == "")), key, " has incomplete approval evidence"),
            (some & (a["id"] != own), key, " has invalid approval id"),
        ),
        say(dangling(revisions, "source", sources, "entry_key"), *revision, " references missing source ", F.col("source")),
        each(
            revisions,
            (c("snapshot_key <> target"), *revision, " snapshot belongs to another target"),
            (~F.col("snapshot_sha256").eqNullSafe(snapshot_hash(F.col("snapshot"), F.col("state"))), *revision, " snapshot hash does not match"),
            (~F.col("revision_sha256").eqNullSafe(full) | ~named, *revision, " hash does not match"),
        ),
        each(
            parents,
            (c("p.id IS NULL"), "revision ", F.col("r.id"), " references missing ", F.col("r.previous")),
            (c("p.target <> r.target"), "revision ", F.col("r.id"), " links to another target through ", F.col("r.previous")),
        ),
    ]
    if proposals is not None:
        rules.append(say(pr.invalid(proposals), "proposal ", F.col("id"), ": ", F.col("error")))
        rules.append(say(pr.misplaced(proposals, revisions), "proposal ", F.col("id"), " decision references an invalid adoption revision"))
    if version not in ("1.0", "1.1"):
        rules.append(spark.range(1).select(F.lit(f"unsupported lockfileVersion {version}").alias("error")))
    if not tool_version.strip():
        rules.append(spark.range(1).select(F.lit("toolVersion is empty").alias("error")))
    out = rules[0]
    for r in rules[1:]:
        out = out.unionByName(r)
    return out.distinct()


def approvals(records: DataFrame, requested: DataFrame, reviewer: str | None, timestamp: int) -> DataFrame:
    """Approvals for the requested (entry_key, content_hash) whose record still has that content: the approval struct's
    columns. One batch ID of 16 hex digits for all."""
    j = requested.join(records.select("entry_key", F.col("content_hash").alias("_now")), "entry_key").filter(F.col("_now") == F.col("content_hash"))
    batch = F.lit(batch_id(timestamp, reviewer))
    who = F.lit(reviewer).cast("string")
    out = j.select("entry_key", F.lit("human").alias("kind"), F.lit("browser-review").alias("method"), who.alias("reviewer"), F.col("entry_key").alias("target"), "content_hash", F.lit(timestamp).cast("long").alias("timestamp"), batch.alias("batch_id"))
    return out.withColumn("id", cn.approval_id(F.col("kind"), F.col("method"), F.col("reviewer"), F.col("target"), F.col("content_hash"), F.col("timestamp"), F.col("batch_id")))


def batch_id(timestamp: int, reviewer: str | None) -> str:
    import hashlib

    return hashlib.sha256(f"{timestamp}:{reviewer or ''}".encode()).hexdigest()[:16]
