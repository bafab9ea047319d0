"""Change proposals: identity, listing, decisions and validation, set at a time."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citegrid.functions import canonical as cn
from citegrid.functions import projections as pj
from citegrid.functions import text as tx
from citegrid.functions.vocab import CONTROLLED_FIELDS, SYSTEM_TYPES, WORKFLOW_FIELDS
from citegrid.operators import evidence, linkage
from citegrid.storage import checkpoint

OUTCOMES = ("adopted", "rejected")
#: The evidence that a provider proposal holds: the record, what the search found, receipts, the score to reach.
PROVIDER = f"struct<record:{pj.LITERATURE},candidates:array<{pj.LITERATURE}>,sources:array<struct<entry_type:string,entry_key:string,fields:map<string,string>>>,threshold:double>"


#: Each byte as a number with a comma, padded with zeros to four bytes.
_NUMBERS = np.array([list(f"{i},".encode().ljust(4, b"\0")) for i in range(256)], np.uint8)


def numbers(data: bytes) -> bytes:
    """The bytes as decimal numbers with commas between."""
    text = _NUMBERS[np.frombuffer(data, np.uint8)].ravel()
    return text[text != 0].tobytes()[:-1]


@F.pandas_udf(T.StringType())
def proposal_id(body: pd.Series, provider: pd.Series) -> pd.Series:
    """proposal: and the SHA-256 of the JSON tuple ``body``; with a provider, of the tuple's bytes as numbers and the
    provider's JSON. The nesting of bytes is why this is not an expression."""

    def one(b: str | None, p: str | None) -> str | None:
        if b is None:
            return None
        data = b.encode()
        if p is not None:
            data = b"[[" + numbers(data) + b"]," + p.encode() + b"]"
        return f"proposal:{hashlib.sha256(data).hexdigest()}"

    return pd.Series([one(b, p) for b, p in zip(body, provider)], dtype=object)


def literature_json(r: Column) -> Column:
    """A common literature record as JSON, without what it does not have."""
    some = lambda c: F.when(F.size(c) > 0, c)
    names = [f.split(":")[0] for f in ("provider", "id", "record_type", "title", "authors", "editors", "container_title", "publisher", "issued", "volume", "issue", "pages", "article_number", "doi", "url", "isbn", "issn")]
    lists = ("authors", "editors", "isbn", "issn")
    return cn._lower_escapes(F.to_json(F.struct(*[(some(r[n]) if n in lists else r[n]).alias(n) for n in names])))


def provider_json(p: Column) -> Column:
    """The frozen evidence of a provider (PROVIDER) as JSON; null as null."""
    listed_ = lambda c, f: F.concat(F.lit("["), F.array_join(F.transform(c, f), ","), F.lit("]"))
    sources = listed_(p["sources"], lambda s: cn.record_json(s["entry_type"], s["entry_key"], s["fields"]))
    whole = F.concat(F.lit('{"record":'), literature_json(p["record"]), F.lit(',"candidates":'), listed_(p["candidates"], literature_json), F.lit(',"sources":'), sources, F.lit(',"threshold":'), p["threshold"].cast("string"), F.lit("}"))
    return F.when(p.isNotNull(), whole)


def _identified(p: DataFrame) -> DataFrame:
    """p (target, agent, reason, timestamp, baseline_hash, proposal_hash, and before and after with _key and _type, provider)
    with what follows from its content: ``_before``, ``_after`` (content hashes), ``before_json``, ``after_json``, ``_id``."""
    for side in ("before", "after"):
        kind, key, fields = F.col(f"{side}_type"), F.col(f"{side}_key"), F.col(side)
        p = p.withColumns({f"_{side}": cn.content_hash(kind, fields), f"{side}_json": cn.record_json(kind, key, fields)})
    parts = [cn.json_text(F.col("target")), cn.json_text(F.col("agent")), cn.json_text(F.col("reason")), F.col("timestamp").cast("string"), cn.json_text(F.col("baseline_hash")), cn.json_text(F.col("proposal_hash")), F.col("before_json"), F.col("after_json"), F.lit("null")]
    p = p.withColumns({"_body": F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]")), "_provider": provider_json(F.col("provider"))})
    frozen = proposal_id(F.when(F.col("_provider").isNotNull(), F.col("_body")), F.col("_provider"))
    plain = F.concat(F.lit("proposal:"), F.sha2("_body", 256))
    return p.withColumn("_frozen", frozen).withColumn("_id", F.coalesce("_frozen", plain)).drop("_body", "_provider", "_frozen")


def _stored(p: DataFrame) -> DataFrame:
    """What a ledger keeps of new proposals (target, agent, reason, timestamp, before, after, their types, provider)."""
    p = p.withColumns({"before_key": F.col("target"), "after_key": F.col("target"), "baseline_hash": cn.content_hash(F.col("before_type"), F.col("before")), "proposal_hash": cn.content_hash(F.col("after_type"), F.col("after"))})
    none = F.lit(None).cast("string")
    p = _identified(p).withColumn("id", F.col("_id"))
    p = p.withColumns({"outcome": none, "decided_by": none, "decided_at": F.lit(None).cast("long"), "decision_revision": none, "threshold": F.col("provider.threshold")})
    return p.select(*STORED)


def identified(proposals: DataFrame) -> DataFrame:
    """proposals (STORED) under the hashes and the id that follow from what they hold."""
    p = proposals.withColumns({"baseline_hash": cn.content_hash(F.col("before_type"), F.col("before")), "proposal_hash": cn.content_hash(F.col("after_type"), F.col("after"))})
    return _identified(p).withColumn("id", F.col("_id")).select(*STORED)


#: What a ledger keeps of a proposal.
STORED = (
    "id", "target", "agent", "reason", "timestamp", "before_key", "before_type", "before", "before_json", "after_key", "after_type", "after", "after_json", "baseline_hash", "proposal_hash",
    "provider", "threshold", "outcome", "decided_by", "decided_at", "decision_revision",
)


def _current(records: DataFrame) -> DataFrame:
    return records.filter(~F.lower("entry_type").isin(*SYSTEM_TYPES)).select(F.col("entry_key").alias("_k"), F.col("entry_type").alias("before_type"), cn.bibliographic_fields(F.col("fields")).alias("before"))


def _or_error(bad: Column, what: str, value: Column) -> Column:
    return F.when(bad, F.raise_error(F.concat(F.lit(what), F.coalesce(F.col("target"), F.lit("?")))).cast("string")).otherwise(value)


def create(records: DataFrame, changes: DataFrame, agent: str, reason: str, timestamp: int) -> DataFrame:
    """changes (target, entry_type, fields) -> proposals to replace the records of those keys by these, with id, hashes
    and JSON of before and after. Workflow fields are no part of a proposal; a key that is not there is an error."""
    j = changes.select("target", F.col("entry_type").alias("after_type"), cn.bibliographic_fields(F.col("fields")).alias("after")).join(_current(records), F.col("target") == F.col("_k"), "left")
    j = j.withColumns({"target": _or_error(F.col("_k").isNull(), "citation key not found: ", F.col("_k")), "agent": F.lit(agent.strip()), "reason": F.lit(reason.strip()), "timestamp": F.lit(timestamp).cast("long"), "provider": F.lit(None).cast(PROVIDER)})
    return checkpoint(_stored(j))  # decisions read proposals several times


def create_provider(records: DataFrame, choices: DataFrame, searches: DataFrame, lookups: DataFrame, agent: str, reason: str, threshold: float, timestamp: int) -> DataFrame:
    """Proposals to adopt a provider's record, each with the evidence frozen in it: what was searched and found, which
    candidate was chosen, and what the provider returned for it.

    choices (target, record_id); searches (target, query, request_url, media_type, response, candidates: array of literature
    records, scores: array of double); lookups (record_id, record, request_url, media_type, response), one row for a target
    and one for an ID. An unknown key, a choice that is no candidate and a record of another ID are errors.
    """
    if not 0 <= threshold <= 1:
        raise ValueError("threshold must be from 0 to 1")
    found = lookups.select(F.lower("record_id").alias("_rid"), "record", F.struct(F.col("request_url").alias("url"), F.col("media_type").alias("type"), F.col("response").alias("body")).alias("got"))
    asked = searches.select(F.col("target").alias("_t"), "query", "candidates", "scores", F.struct(F.col("request_url").alias("url"), F.col("media_type").alias("type"), F.col("response").alias("body")).alias("heard"))
    j = choices.select("target", "record_id").join(_current(records), F.col("target") == F.col("_k"), "left").join(asked, F.col("target") == F.col("_t"), "left").join(found, F.lower("record_id") == F.col("_rid"), "left")
    j = j.withColumn("target", _or_error(F.col("_k").isNull(), "citation key not found: ", F.col("_k")))
    other = ~F.coalesce(F.lower(F.col("record")["id"]) == F.lower("record_id"), F.lit(False))
    j = j.withColumn("target", _or_error(other, "the provider returned another identifier for ", F.col("target")))
    provider = F.col("record")["provider"]
    j = j.withColumn("search", evidence.title_search_receipt(F.col("target"), cn.content_hash(F.col("before_type"), F.col("before")), provider, F.col("query"), F.col("heard.url"), F.col("heard.type"), F.col("heard.body"), F.col("candidates"), F.col("scores")))
    ids = F.transform("candidates", lambda c: c["id"])
    j = checkpoint(j.withColumn("selection", evidence.selection_receipt(F.col("search.entry_key"), ids, F.col("record")["id"], F.lit(agent), F.lit("agent-proposal"))))
    j = j.withColumn("target", _or_error(F.col("selection").isNull(), "the chosen record is no candidate of ", F.col("target")))
    kind, own = pj.entry_type_of(F.col("record")["record_type"]), pj.fields_of_literature(F.col("record"))
    receipt = evidence.provider_receipt(provider, F.col("record")["id"], F.col("got.url"), F.col("got.type"), F.col("got.body"), kind, cn.only(own, CONTROLLED_FIELDS), selection=F.col("selection.entry_key"))
    j = j.withColumns({"receipt": receipt, "after_type": kind, "after": cn.bibliographic_fields(pj.adopted_fields(F.col("before"), own))})
    frozen = F.struct("record", "candidates", F.array("search", "selection", "receipt").alias("sources"), F.lit(float(threshold)).alias("threshold"))
    j = j.withColumns({"agent": F.lit(agent.strip()), "reason": F.lit(reason.strip()), "timestamp": F.lit(timestamp).cast("long"), "provider": frozen.cast(PROVIDER)})
    return _stored(checkpoint(j.drop("search", "selection", "receipt")))


def listed(proposals: DataFrame, current: DataFrame) -> DataFrame:
    """proposals (id, target, baseline_hash, before, after, before_type, after_type, outcome) with ``stale``: the target
    is gone or has other content now, and the fields it changes."""
    now = current.select(F.col("entry_key").alias("_k"), F.col("content_hash").alias("_h"))
    out = proposals.join(now, F.col("target") == F.col("_k"), "left")
    return out.withColumns({"stale": ~F.col("_h").eqNullSafe(F.col("baseline_hash")), "changes": pj.changed_fields(F.col("before_type"), F.col("before"), F.col("after_type"), F.col("after"))}).drop("_k", "_h")


def decide(proposals: DataFrame, decisions: DataFrame) -> DataFrame:
    """decisions (id, adopt, reviewer, timestamp) -> id, outcome, error. A decided proposal, and the adoption of a stale
    one, are errors; a stale one can be rejected."""
    j = decisions.join(proposals.select("id", F.col("outcome").alias("_o"), "stale"), "id", "left")
    error = F.when(F.col("stale").isNull(), "proposal not found").when(F.col("_o").isNotNull(), "proposal has already been decided").when(F.col("adopt") & F.col("stale"), "proposal is stale")
    return j.select("id", F.when(error.isNull(), F.when(F.col("adopt"), OUTCOMES[0]).otherwise(OUTCOMES[1])).alias("outcome"), F.nullif(F.trim("reviewer"), F.lit("")).alias("reviewer"), "timestamp", error.alias("error"))


#: What breaks a rule, by the rule: words of our own, for people.
RULES = {
    "asked": "agent, reason and timestamp are required",
    "key": "proposal records have another key",
    "system": "a system record can't be proposed",
    "workflow": "proposal records hold workflow fields",
    "hash": "proposal hashes do not match the records",
    "id": "proposal id does not match its content",
    "decision": "proposal decision is invalid",
    "threshold": "threshold is out of range",
    "projection": "the proposed record is not the provider's",
    "receipts": "receipts are missing",
    "search": "the search was made for another record",
    "count": "the search lists another number of candidates",
    "order": "a candidate differs from the one that the search lists",
}


def invalid(proposals: DataFrame) -> DataFrame:
    """(id, error): the first rule that each stored proposal (STORED) breaks. Hashes and identities are computed anew from
    the records, receipts and candidates that are stored; none is taken from the row."""
    p = _identified(proposals.drop("before_json", "after_json"))
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    system = F.lower("before_type").isin(*SYSTEM_TYPES) | F.lower("after_type").isin(*SYSTEM_TYPES)
    dirty = lambda c: F.size(F.map_keys(c)) != F.size(F.map_keys(cn.bibliographic_fields(F.col(c))))
    content = (
        F.when(blank("agent") | blank("reason") | (F.coalesce("timestamp", F.lit(0)) == 0), "asked")
        .when(system, "system").when(~F.col("before_key").eqNullSafe(F.col("target")) | ~F.col("after_key").eqNullSafe(F.col("target")), "key")
        .when(dirty("before") | dirty("after"), "workflow")
        .when(~F.col("_before").eqNullSafe(F.col("baseline_hash")) | ~F.col("_after").eqNullSafe(F.col("proposal_hash")), "hash")
        .when(~F.col("_id").eqNullSafe(F.col("id")), "id")
        .when(F.col("outcome").isNotNull() & (~F.col("outcome").isin(*OUTCOMES) | (F.coalesce("decided_at", F.lit(0)) == 0)), "decision")
    )
    p = p.withColumn("_rule", content).select("id", "_rule", "target", "baseline_hash", "before", "after", "after_type", "provider")
    error = F.when(F.col("_rule").isNotNull(), _text("_rule")).when(F.col("provider").isNotNull(), F.col("_unfounded"))
    # a filter on what is computed here would be pushed below it and compute all of it again, several times over
    return checkpoint(_unfounded(p).select("id", error.alias("error"))).filter("error IS NOT NULL")


def _text(rule: str) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in RULES.items() for x in kv]), F.col(rule))


def _unfounded(p: DataFrame) -> DataFrame:
    """p with ``_unfounded``: why a proposal's frozen evidence does not lead to what it proposes, or null."""
    record, sources = F.col("provider.record"), F.col("provider.sources")
    own = pj.fields_of_literature(record)
    p = p.withColumns({"_own": own, "_projected": cn.bibliographic_fields(pj.adopted_fields(F.col("before"), own)), "_kind": pj.entry_type_of(record["record_type"])})
    node = lambda key: F.get(F.filter(sources, lambda s: s["entry_key"] == key), F.lit(0))["fields"]
    last = F.try_element_at(sources, F.lit(-1))
    p = p.withColumns({"_source_key": last["entry_key"], "_source": last["fields"], "_first": F.get(sources, F.lit(0))["fields"]})
    # the record as it would stand in a bibliography: with the provider's identity and the evidence it names
    workflow = F.map_filter("_own", lambda k, v: F.lower(k).isin(*WORKFLOW_FIELDS))
    p = p.withColumn("_fields", pj.overlay(pj.overlay(F.col("after"), workflow), F.create_map(F.lit("bibsource"), F.col("_source_key"))))
    p = p.withColumns({"_resolution": node(F.col("_source")["resolution"]), "_selection": node(F.col("_source")["selection"])}).withColumn("_search", node(F.col("_selection")["search"]))
    chain = F.coalesce(
        evidence.direct_error(F.col("after_type"), F.col("target"), F.col("_fields"), F.col("_source_key"), F.col("_source"), F.col("_resolution"), F.col("_selection")),
        F.when(F.col("_resolution").isNotNull(), evidence.resolution_error(F.col("_source")["resolution"], F.col("_resolution"))),
        F.when(F.col("_selection").isNotNull(), evidence.selection_error(F.col("_source")["selection"], F.col("_selection"), F.col("_search"))),
        F.when(F.col("_search").isNotNull(), evidence.search_error(F.col("_selection")["search"], F.col("_search"))),
    )
    listed_ = F.from_json(F.col("_first")["candidates"], "array<struct<id:string,projection_sha256:string>>")
    mine = F.transform("provider.candidates", lambda c: F.struct(c["provider"].alias("provider"), c["id"].alias("id"), cn.projection_hash(pj.entry_type_of(c["record_type"]), pj.fields_of_literature(c)).alias("projection_sha256")))
    p = p.withColumns({"_chain": chain, "_listed": listed_, "_mine": mine})
    same = F.zip_with("_listed", "_mine", lambda a, b: a["id"].eqNullSafe(b["id"]) & a["projection_sha256"].eqNullSafe(b["projection_sha256"]) & b["provider"].eqNullSafe(record["provider"]))
    first = lambda name: F.col("_first")[name]
    threshold = F.col("provider.threshold")
    broken = (
        F.when(threshold.isNull() | F.isnan(threshold) | ~threshold.between(0, 1), "threshold")
        .when(~F.col("after_type").eqNullSafe(F.col("_kind")) | (cn.json_map(F.col("after")) != cn.json_map(F.col("_projected"))), "projection")
        .when(F.coalesce(F.size(sources), F.lit(0)) < 1, "receipts")
        .when(F.col("_chain").isNotNull(), "chain")
        .when(~(first("inputsha256").eqNullSafe(F.col("baseline_hash")) & first("target").eqNullSafe(F.col("target")) & first("provider").eqNullSafe(record["provider"])), "search")
        .when(~F.coalesce(F.size("_listed") == F.size("_mine"), F.lit(False)), "count")
        .when(~F.forall(same, lambda x: x), "order")
    )
    p = p.withColumn("_broken", broken)
    return p.withColumn("_unfounded", F.coalesce(F.when(F.col("_broken") == "chain", F.col("_chain")), _text("_broken")))


def misplaced(proposals: DataFrame, revisions: DataFrame) -> DataFrame:
    """(id) of proposals whose decision names a revision (id, target, snapshot: JSON) that is not there, is of another record
    or did not replace what the proposal was made for."""
    p = proposals.filter("decision_revision IS NOT NULL").select(F.col("id").alias("pid"), F.col("target").alias("pt"), cn.record_json(F.col("before_type"), F.col("before_key"), F.col("before")).alias("pb"), "decision_revision")
    j = p.join(revisions.select(F.col("id").alias("rid"), F.col("target").alias("rt"), F.col("snapshot").alias("rs")), F.col("decision_revision") == F.col("rid"), "left")
    return j.filter(~(F.col("rt").eqNullSafe(F.col("pt")) & F.col("rs").eqNullSafe(F.col("pb")))).select(F.col("pid").alias("id"))


def views(proposals: DataFrame, current: DataFrame) -> DataFrame:
    """proposals as they are shown: id, target, ``stale``, ``changes``, the score of the provider's record against the one it
    would replace, and why an agent may not adopt it (``blocker``, null: it may), from the frozen evidence alone."""
    p = listed(proposals, current)
    record, sets = F.col("provider.record"), lambda r: tx.compared_sets(r["title"], tx.contributors_text(r["authors"]))
    # the words of the record and of each candidate once, before they are compared
    before = {f"_own_{n}": c for n, c in tx.compared_sets(F.col("before")["title"], F.col("before")["author"]).items()}
    theirs = {f"_their_{n}": c for n, c in sets(record).items()}
    each = F.transform("provider.candidates", lambda c: F.struct(F.lower(c["id"]).alias("id"), *[x.alias(n) for n, x in sets(c).items()]))
    p = p.withColumns(before | theirs | {"_sets": each})
    mine, its = ({n: F.col(f"_{of}_{n}") for n in ("title", "surnames", "author")} for of in ("own", "their"))
    score = lambda x: tx.similarity_of_sets(mine, x)["score"]
    p = p.withColumns({"_score": score(its), "_each": F.transform("_sets", lambda x: F.struct(x["id"].alias("id"), score(x).alias("score")))})
    good = lambda x: F.coalesce(x["score"] >= F.col("provider.threshold"), F.lit(False))
    own = lambda x: x["id"] == F.lower(record["id"])
    blocker = linkage.adoption_blocker(F.col("provider").isNotNull(), F.col("_score") >= F.col("provider.threshold"), F.exists("_each", lambda x: good(x) & own(x)), F.exists("_each", lambda x: good(x) & ~own(x)), F.col("stale"))
    return p.select("id", "target", "stale", "changes", F.col("_score").alias("score"), F.when(F.col("outcome").isNull(), blocker).alias("blocker"), F.when(F.col("outcome").isNull(), blocker.isNull()).alias("adoptable"))
