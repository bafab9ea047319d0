"""Reconciling records with provider records: adoption, seals, statuses and review rows, set at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citegrid.functions import canonical as cn
from citegrid.functions import identifiers as ids
from citegrid.functions import projections as pj
from citegrid.functions import text as tx
from citegrid.functions.vocab import APPROVAL_FIELDS, SYSTEM_TYPES
from citegrid.operators import evidence

DEFAULT_PROVIDER = "crossref"


def source_identity(fields: Column, requested: Column | None = None) -> Column:
    """STRUCT<provider, id>: the stored provider and ID, unless another provider is asked for; crossref by default."""
    both = fields["bibprovider"].isNotNull() & fields["bibproviderid"].isNotNull()
    stored, record_id = F.when(both, fields["bibprovider"]), F.when(both, fields["bibproviderid"])
    if requested is None:
        return F.struct(F.coalesce(stored, F.lit(DEFAULT_PROVIDER)).alias("provider"), record_id.alias("id"))
    provider = F.coalesce(requested, stored, F.lit(DEFAULT_PROVIDER))
    return F.struct(provider.alias("provider"), F.when(stored == provider, record_id).alias("id"))


def reconcile(rows: DataFrame) -> DataFrame:
    """rows (entry_key, fields, record: a common literature record, url, media_type, response, resolution: a receipt or
    null, selection: a receipt or null, seal: boolean) with what adopting the record makes of them:

    entry_type, fields (controlled ones replaced, approvals gone, the evidence named, sealed if asked for), receipt, and
    error where a resolved DOI is not the record's; then the fields stay as they were.
    """
    record, resolved = F.col("record"), F.col("resolution")["fields"]
    error = F.when((resolved["identifierkind"] == "doi") & (F.lower(resolved["identifier"]) != F.lower(record["id"])), F.concat(F.lit("resolved DOI "), resolved["identifier"], F.lit(" does not match provider record id "), record["id"]))
    out = rows.withColumns({"entry_type": pj.entry_type_of(record["record_type"]), "_new": pj.fields_of_literature(record), "error": error})
    out = out.withColumn("receipt", evidence.provider_receipt(record["provider"], record["id"], F.col("url"), F.col("media_type"), F.col("response"), F.col("entry_type"), F.col("_new"), resolution=F.col("resolution")["entry_key"], selection=F.col("selection")["entry_key"]))
    named = F.map_concat(F.map_filter(pj.adopted_fields(cn.without(F.col("fields"), APPROVAL_FIELDS), F.col("_new")), lambda k, v: k != "bibsource"), F.create_map(F.lit("bibsource"), F.col("receipt.entry_key")))
    out = out.withColumn("_named", named)
    out = out.withColumn("_sealed", F.when(F.col("seal"), pj.overlay(F.col("_named"), F.create_map(F.lit("integrity"), cn.content_hash(F.col("entry_type"), F.col("_named"))))).otherwise(F.col("_named")))
    return out.withColumn("fields", F.when(F.col("error").isNull(), F.col("_sealed")).otherwise(F.col("fields"))).drop("_new", "_named", "_sealed")


def seal(records: DataFrame, kind: str, actor: str) -> tuple[DataFrame, DataFrame]:
    """Records that an agent or a human vouches for, with their marker and evidence; and the receipts, as nodes."""
    content = cn.content_hash(F.col("entry_type"), F.col("fields"))
    out = records.withColumn("_r", evidence.actor_receipt(F.lit(kind), F.lit(actor), F.col("entry_key"), content)).withColumn("_h", content)
    sealed = pj.overlay(F.col("fields"), F.create_map(F.lit("bibsource"), F.col("_r.entry_key"), F.lit("integrity"), F.col("_h")))
    return out.withColumn("fields", sealed).drop("_r", "_h"), out.select("_r.entry_key", "_r.fields")


def unseal(fields: Column) -> Column:
    """Fields without marker and approvals; the evidence stays named."""
    return cn.without(fields, ("integrity", *APPROVAL_FIELDS))


def strip_responses(nodes: DataFrame) -> DataFrame:
    """Evidence rows without stored responses, and how many fields each lost."""
    kept = cn.without(F.col("fields"), ("response", "responseencoding"))
    return nodes.select("entry_key", kept.alias("fields"), (F.size("fields") - F.size(kept)).cast("long").alias("removed"))


def selected(records: DataFrame, keys: DataFrame | None) -> DataFrame:
    """The ordinary records of the keys (entry_key), or all if keys is None. No key, or one that is not there, is an error."""
    ordinary = records.filter(~F.lower("entry_type").isin(*SYSTEM_TYPES))
    if keys is None:
        return ordinary
    missing = keys.join(ordinary, "entry_key", "left_anti").limit(1).collect()
    if missing:
        raise KeyError(f"citation key not found: {missing[0]['entry_key']}")
    if not keys.limit(1).count():
        raise KeyError("no entries selected")
    return ordinary.join(keys.select("entry_key").distinct(), "entry_key", "left_semi")


def verify_status(already: Column, identifier: Column, supported: Column, looked_up: Column, verified: Column, searched: Column, n_candidates: Column, in_place: Column | None = None, unresolved: Column | None = None) -> Column:
    """The status of a record in a verification run; columns that do not apply are null. Without ``in_place`` everything
    is written; a run that writes nothing finds records ready. ``unresolved``: its URL could not be resolved."""
    yes, no = F.lit(True), F.lit(False)
    return (
        F.when(already, "already-verified")
        .when(identifier.isNull() & F.coalesce(no if unresolved is None else unresolved, no), "resolution-error")
        .when(identifier.isNotNull() & ~supported, "unsupported-identifier")
        .when(identifier.isNotNull() & ~F.coalesce(looked_up, no), "lookup-error")
        .when(identifier.isNotNull() & F.coalesce(verified, no), F.when(F.coalesce(yes if in_place is None else in_place, no), "verified").otherwise("ready"))
        .when(identifier.isNotNull(), "needs-review")
        .when(searched.isNull(), "unsupported")
        .when(~searched, "search-error")
        .when(n_candidates > 0, "needs-selection")
        .otherwise("unsupported")
    )


def reviewed(report: DataFrame, live: DataFrame) -> DataFrame:
    """A reviewed dry run against what a lookup finds now, both entry_key, baseline_hash and proposal_hash: entry_key and
    error, for every key of ``live``. Only what was reviewed, and is still the same, may be written."""
    r = report.select("entry_key", F.col("baseline_hash").alias("_b"), F.col("proposal_hash").alias("_p"))
    j = live.join(r, "entry_key", "left")
    changed = ~(F.col("baseline_hash").eqNullSafe(F.col("_b")) & F.col("proposal_hash").eqNullSafe(F.col("_p")))
    return j.select("entry_key", F.when(F.col("_p").isNull(), "the reviewed report has no replacement").when(changed, "the entry or what the provider returns has changed; review again").alias("error"))


def review_rows(records: DataFrame) -> DataFrame:
    """Ordinary records (with status) as a reviewer sees them: trimmed fields, a safe URL, content fields and hash."""
    f = F.col("fields")
    names = {"title": f["title"], "authors": f["author"], "year": f["year"], "doi": f["doi"]}
    ordinary = records.filter(~F.lower("entry_type").isin(*SYSTEM_TYPES)).withColumn("_hash", cn.content_hash(F.col("entry_type"), f))
    return ordinary.select("entry_key", "entry_type", "status", *[tx.text_or_null(c).alias(n) for n, c in names.items()], ids.safe_url(f["url"], f["doi"]).alias("url"), cn.json_map(cn.bibliographic_fields(f)).alias("fields"), F.col("_hash").alias("content_hash"))
