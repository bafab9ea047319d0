"""Canonical JSON and content hashes as column expressions.

JSON is compact UTF-8 with control characters escaped in lower case, keys in byte order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from citegrid.functions.vocab import APPROVAL_FIELDS, CONTROLLED_FIELDS, SYSTEM_TYPES, WORKFLOW_FIELDS

#: Control characters whose escape has a letter, which to_json writes in upper case.
_LETTERED = ("0B", "0E", "0F", "1A", "1B", "1C", "1D", "1E", "1F")


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often use names it, in filters and inside lambdas too."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _lower_escapes(c: Column) -> Column:
    def fixed(x: Column) -> Column:
        for code in _LETTERED:
            x = F.regexp_replace(x, rf"(?<!\\)((?:\\\\)*)\\u00{code}", rf"$1\\u00{code.lower()}")
        return x

    return once(c, lambda x: F.when(F.contains(x, F.lit("\\u00")), fixed(x)).otherwise(x))


def json_text(c: Column) -> Column:
    """A string as a JSON string; null as null."""
    quoted = once(_lower_escapes(F.to_json(F.array(c))), lambda x: F.substring(x, F.lit(2), F.length(x) - 2))
    return F.when(c.isNull(), F.lit("null")).otherwise(quoted)


def json_map(m: Column) -> Column:
    """A map of strings as a JSON object, keys in byte order."""
    return _lower_escapes(F.to_json(F.map_from_entries(F.sort_array(F.map_entries(m)))))


#: Evidence fields whose JSON is kept as JSON in ledger files; all others are strings.
NATIVE_FIELDS = ("candidates", "projection", "signals")


def encode_source_fields(fields: Column) -> Column:
    """Evidence fields as the JSON object of a ledger file: of NATIVE_FIELDS valid JSON as it is, all else as strings."""
    native = lambda e: F.when(e["key"].isin(*NATIVE_FIELDS), F.to_json(F.try_parse_json(e["value"])))
    one = lambda e: F.concat(json_text(e["key"]), F.lit(":"), F.coalesce(native(e), json_text(e["value"])))
    return F.concat(F.lit("{"), F.array_join(F.transform(F.sort_array(F.map_entries(fields)), one), ","), F.lit("}"))


def decode_source_fields(json: Column) -> Column:
    """The inverse: a map of strings, values that are no strings as their JSON."""
    return F.from_json(json, "map<string,string>")


def sha256(c: Column) -> Column:
    return F.sha2(c, 256)


def without(fields: Column, names: tuple[str, ...]) -> Column:
    return F.map_filter(fields, lambda k, v: ~F.lower(k).isin(*names))


def only(fields: Column, names: tuple[str, ...]) -> Column:
    return F.map_filter(fields, lambda k, v: k.isin(*names))


def bibliographic_fields(fields: Column) -> Column:
    """The content of a record: its fields without workflow fields."""
    return without(fields, WORKFLOW_FIELDS)


def canonical_json(entry_type: Column, fields: Column, hidden: tuple[str, ...] = WORKFLOW_FIELDS) -> Column:
    """{"ENTRYTYPE": type, field: value, ...} without workflow fields and without the citation key.

    Names are written in lower case. Of names that differ in case only, the one last in byte order counts.
    """
    named = F.transform(F.sort_array(F.map_entries(without(fields, hidden))), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    last = once(named, lambda m: F.filter(m, lambda e, i: ~F.exists(F.slice(m, i + 2, F.size(m)), lambda x: x["key"] == e["key"])))
    entries = F.concat(F.array(F.struct(F.lit("ENTRYTYPE").alias("key"), entry_type.alias("value"))), last)
    return _lower_escapes(F.to_json(F.map_from_entries(F.sort_array(entries))))


def content_hash(entry_type: Column, fields: Column) -> Column:
    """SHA-256 of the canonical JSON; null for system records, which have none."""
    return F.when(~F.lower(entry_type).isin(*SYSTEM_TYPES), sha256(canonical_json(entry_type, fields)))


def legacy_hash(entry_type: Column, fields: Column) -> Column:
    """The hash of earlier files, which hides two fields only."""
    return sha256(canonical_json(entry_type, fields, ("integrity", "bibprevious")))


def record_json(entry_type: Column, entry_key: Column, fields: Column) -> Column:
    return F.concat(F.lit('{"entry_type":'), json_text(entry_type), F.lit(',"entry_key":'), json_text(entry_key), F.lit(',"fields":'), json_map(fields), F.lit("}"))


def projection_hash(entry_type: Column, fields: Column) -> Column:
    """SHA-256 of [type, {fields}]."""
    return sha256(F.concat(F.lit("["), json_text(F.lower(entry_type)), F.lit(","), json_map(fields), F.lit("]")))


def controlled_hash(entry_type: Column, fields: Column) -> Column:
    """The projection hash over the fields that providers control."""
    return projection_hash(entry_type, only(fields, CONTROLLED_FIELDS))


def evidence_identity(fields: Column) -> Column:
    """SHA-256 over all fields but stored responses, each with its byte length."""
    entries = F.sort_array(F.map_entries(without(fields, ("response", "responseencoding", "bibprevious"))))
    sized = lambda c: F.concat(F.octet_length(c).cast("string"), F.char(F.lit(0)), c)
    return sha256(F.array_join(F.transform(entries, lambda e: F.concat(sized(e["key"]), sized(e["value"]))), ""))


def _joined(*parts: Column) -> Column:
    return F.concat_ws(chr(0), *parts)


def actor_identity(kind: Column, actor: Column, key: Column, content: Column) -> Column:
    return sha256(_joined(kind, actor, key, content))


def provider_identity(fields: Column) -> Column:
    """Identity of a provider receipt: fixed parts in order, then the optional ones with their names."""
    fixed = [fields[n] for n in ("provider", "providerid", "requesturl", "mediatype", "projection", "toolversion", "responsesha256")]
    tagged = [F.when(fields[n].isNotNull(), _joined(F.lit(n), fields[n])) for n in ("requestmethod", "requestbodysha256", "projectionsha256", "resolution", "selection")]
    return sha256(_joined(F.lit("provider"), *fixed, *tagged))


def approval_id(kind: Column, method: Column, reviewer: Column, target: Column, content: Column, timestamp: Column, batch: Column) -> Column:
    """SHA-256 of the seven values as a JSON array; a missing reviewer is null in it."""
    parts = [json_text(kind), json_text(method), json_text(reviewer), json_text(target), json_text(content), timestamp.cast("string"), json_text(batch)]
    return sha256(F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]")))


def has_approval(fields: Column) -> Column:
    return F.exists(F.map_keys(fields), lambda k: k.isin(*APPROVAL_FIELDS))
