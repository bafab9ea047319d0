"""Trust states, summaries, recommended paths and next actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citegrid.functions import canonical as cn
from citegrid.functions import identifiers as ids
from citegrid.functions import text as tx
from citegrid.functions.vocab import SYSTEM_TYPES

STATES = ("verified", "valid", "stale", "invalid")


def trust_status(entry_type: Column, entry_key: Column, fields: Column, evidence_kind: Column, evidence_error: Column) -> Column:
    """The state of a record. Any approval field decides alone: incomplete or forged is invalid, for this content verified,
    for other content stale. Else no marker is invalid, a marker of other content stale, and the evidence decides."""
    content = cn.content_hash(entry_type, fields)
    stamp = fields["bibapprovaltimestamp"].try_cast("bigint")
    complete = (
        F.coalesce(fields["bibapprovalkind"] == "human", F.lit(False)) & F.coalesce(fields["bibapprovalmethod"] == "browser-review", F.lit(False)) & fields["bibapprovalid"].isNotNull()
        & fields["bibapprovalcontent"].isNotNull() & stamp.isNotNull() & (F.coalesce(stamp, F.lit(-1)) >= 0) & fields["bibapprovalbatch"].isNotNull()
    )
    own = cn.approval_id(F.lit("human"), F.lit("browser-review"), fields["bibapprovalreviewer"], entry_key, fields["bibapprovalcontent"], stamp, fields["bibapprovalbatch"])
    marker = tx.text_or_null(fields["integrity"])
    by_approval = F.when(~complete | (fields["bibapprovalid"] != own), "invalid").when(fields["bibapprovalcontent"] == content, "verified").otherwise("stale")
    by_evidence = F.when(marker.isNull(), "invalid").when(marker != content, "stale").when(evidence_error.isNotNull() | evidence_kind.isNull(), "invalid").when(evidence_kind.isin("provider", "human"), "verified").otherwise("valid")
    return F.when(cn.has_approval(fields), by_approval).otherwise(by_evidence)


def summary(records: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Total and counts by state of records with a ``status``, per group of ``by`` if given: one aggregation."""
    counts = [F.count(F.lit(1)).alias("total"), *(F.count_if(F.col("status") == s).alias(s) for s in STATES)]
    return records.groupBy(*(by or [])).agg(*counts)


def ready(summaries: DataFrame, errors: Column) -> DataFrame:
    """Whether all files are ready: no errors, and nothing that isn't verified."""
    return summaries.agg(F.coalesce(F.bool_and((errors == 0) & (F.col("total") == F.col("verified"))), F.lit(False)).alias("ready"))


def recommended_path(entry_type: Column, fields: Column) -> Column:
    """How to verify a record next; the first rule that fits."""
    has = lambda n: tx.text_or_null(fields[n]).isNotNull()
    return (
        F.when(has("doi") | ids.identifier_of_fields(fields).isNotNull(), "api_verify")
        .when(has("howpublished") | entry_type.isin("online", "www"), "human_review")
        .when(has("title") & has("author"), "candidate_review")
        .otherwise("human_review")
    )


def proposal_path(path: Column, adoptable: Column, undecided: Column) -> Column:
    """Proposals come before other paths."""
    return F.when(adoptable, "proposal_adopt").when(undecided, "proposal_review").otherwise(path)


def pending(records: DataFrame) -> DataFrame:
    """Records (entry_key, entry_type, fields, status, error) that are not verified, with a reason and a path."""
    reason = (
        F.when(F.col("status") == "valid", "backed by an agent or web receipt; API verification or human approval is still required")
        .when(F.col("status") == "stale", "content changed after it was sealed or approved")
        .otherwise(F.coalesce("error", F.lit("integrity or approval evidence is missing or invalid")))
    )
    kept = records.filter(~F.lower("entry_type").isin(*SYSTEM_TYPES) & (F.col("status") != "verified"))
    return kept.select("entry_key", "status", reason.alias("reason"), recommended_path(F.col("entry_type"), F.col("fields")).alias("path"))


#: Command words of each path; {file} and {key} stand for the record's.
ACTIONS = {
    "api_verify": (("verify", "{file}", "--key", "{key}"),),
    "candidate_review": (("match", "{file}", "--key", "{key}"), ("propose", "{file}", "--key", "{key}", "--id", "PROVIDER_RECORD_ID", "--agent", "AGENT_ID")),
    "human_review": (("review", "{file}"),),
    "proposal_adopt": (("adopt", "{file}", "--key", "{key}"),),
    "proposal_review": (("review", "{file}"),),
}
WRITES = ("propose", "adopt", "verify")


def actions(pending_rows: DataFrame, file: Column) -> DataFrame:
    """One row for each next action: entry_key, step, argv, command (quoted for a shell), writes."""
    key = F.col("entry_key")

    def argv(words: tuple[str, ...]) -> Column:
        return F.array(*[file if w == "{file}" else key if w == "{key}" else F.lit(w) for w in words])

    chosen = F
    for path, steps in ACTIONS.items():
        rows = F.array(*[F.struct(F.lit(i).alias("step"), argv(w).alias("argv"), F.lit(w[0] in WRITES).alias("writes")) for i, w in enumerate(steps)])
        chosen = chosen.when(F.col("path") == path, rows)
    rows = pending_rows.select("entry_key", F.explode(chosen).alias("a"))
    return rows.select("entry_key", "a.step", "a.argv", F.array_join(F.transform("a.argv", lambda w: tx.shell_quote(w)), " ").alias("command"), "a.writes")


def listed(records: DataFrame, text: str = "", only_pending: bool = False) -> DataFrame:
    """Records whose key, title, author or year holds the text, in any case; of these only those that need work."""
    f = F.col("fields")
    hay = F.lower(F.concat_ws(" ", "entry_key", f["title"], f["author"], f["year"]))
    kept = records.filter(F.contains(hay, F.lit(text.lower())))
    return kept.filter((F.col("status") != "verified") | F.coalesce(F.col("has_proposal"), F.lit(False))) if only_pending else kept
