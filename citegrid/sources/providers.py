"""Provider snapshots: files of API responses as tables of common literature records.

Live requests are out of scope here; a crawl writes responses, one JSON text a row with its request URL, and these
readers project them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citegrid.functions import canonical as cn
from citegrid.functions import projections as pj
from citegrid.functions.text import clamp_limit
from citegrid.functions.vocab import SYSTEM_TYPES
from citegrid.sources import bibtex

PROVIDERS = ("crossref", "doi", "openreview")


def provider_name(c: Column) -> Column:
    """The registered name, in any case; an unknown one is an error that lists them."""
    name = F.lower(F.trim(c))
    return F.when(name.isin(*PROVIDERS), name).otherwise(F.raise_error(F.concat(F.lit("unknown provider "), c, F.lit("; there are " + ", ".join(PROVIDERS)))).cast("string"))


def crossref_lookup(responses: DataFrame, body: str = "body") -> DataFrame:
    """Responses of single works with ``record``, the common literature record; null for other JSON."""
    m = F.from_json(F.col(body), f"struct<message:{pj.CROSSREF_WORK}>")["message"]
    return responses.withColumn("_m", m).withColumn("record", F.when(F.col("_m.DOI").isNotNull(), pj.literature_of_crossref(F.col("_m")))).drop("_m")


def crossref_search(responses: DataFrame, body: str = "body", limit: int = 5) -> DataFrame:
    """Responses of searches, one row for each of the first ``limit`` (1 to 20) candidates: rank, score, record."""
    items = F.from_json(F.col(body), f"struct<message:struct<items:array<{pj.CROSSREF_WORK}>>>")["message"]["items"]
    rows = responses.select("*", F.posexplode(F.slice(items, F.lit(1), clamp_limit(F.lit(limit)))).alias("rank", "_w"))
    return rows.withColumns({"score": F.col("_w.score"), "record": pj.literature_of_crossref(F.col("_w"))}).drop("_w")


def openreview_notes(responses: DataFrame, body: str = "body") -> DataFrame:
    """Responses with notes, one row for each note that has an ID and content: record."""
    v = lambda kind: f"struct<value:{kind}>"
    schema = f"struct<notes:array<struct<id:string,content:struct<title:{v('string')},authors:{v('array<string>')},venue:{v('string')},_bibtex:{v('string')}>>>>"
    n = responses.select("*", F.explode(F.from_json(F.col(body), schema)["notes"]).alias("_n")).filter("_n.id IS NOT NULL AND _n.content IS NOT NULL")
    c = F.col("_n.content")
    return n.withColumns({"bibtex": c["_bibtex"]["value"], "record": pj.literature_of_note(F.col("_n.id"), c["title"]["value"], c["authors"]["value"], c["venue"]["value"])}).drop("_n")


def openreview_records(responses: DataFrame, body: str = "body") -> DataFrame:
    """(id, record) of the notes of responses: a note's embedded BibTeX counts before its own fields, with the note's URL.

    Note IDs name notes: of several responses with a note that of the smallest hash is taken.
    """
    notes = openreview_notes(responses.select(body), body).groupBy(F.col("record.id").alias("id")).agg(F.min_by(F.struct("bibtex", "record"), F.sha2(body, 256)).alias("n"))
    return _embedded(notes.select("id", F.col("id").alias("of"), "n.*")).select("id", "record")


def _embedded(notes: DataFrame) -> DataFrame:
    """notes (id, of: a key of its own, bibtex, record) with the record of the embedded BibTeX where there is one."""
    at = F.struct(F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("row"))
    entries = bibtex.parse(notes.filter("bibtex IS NOT NULL").select(F.col("of").alias("file"), at.alias("at"), F.col("bibtex").alias("text"))).filter(~F.col("entry_type").isin(*SYSTEM_TYPES))
    first = entries.groupBy(F.col("file").alias("_of")).agg(F.min_by(F.struct("entry_type", "fields"), "at.entry").alias("_e"))
    url = F.concat(F.lit("https://openreview.net/forum?id="), "id")
    embedded = pj.literature_of_fields(F.lit("openreview"), F.col("id"), F.col("_e.entry_type"), F.col("_e.fields")).withField("url", url)
    return notes.join(first, F.col("of") == F.col("_of"), "left").select("id", "of", F.when(F.col("_e").isNotNull(), embedded).otherwise(F.col("record")).alias("record"))


#: How a receipt may hold its response.
ENCODINGS = ("base64", "utf-8")


def replay(receipts: DataFrame) -> DataFrame:
    """Provider receipts (entry_key, fields) with a stored response: entry_key, provider, record (null with an error), error.

    The response is decoded, must have the receipt's hash, and is projected anew by its provider's projection; the record
    must be the receipt's and its controlled fields must hash to what the receipt recorded. Receipts without a response, and
    other evidence, have no row. Keys are distinct.
    """
    f = F.col("fields")
    held = receipts.filter((f["kind"] == "provider") & f["response"].isNotNull())
    encoding = F.lower(F.coalesce(f["responseencoding"], F.lit("utf-8")))
    data = F.when(encoding == "base64", F.try_to_binary(f["response"], F.lit("base64"))).when(encoding == "utf-8", F.encode(f["response"], "UTF-8"))
    r = held.select("entry_key", "fields", F.lower(f["provider"]).alias("provider"), encoding.isin(*ENCODINGS).alias("_known"), data.alias("_data")).withColumn("body", F.try_validate_utf8(F.col("_data").cast("string")))
    works = crossref_lookup(r.filter(F.col("provider").isin("crossref", "doi")).withColumn("body", F.when(F.col("provider") == "doi", F.concat(F.lit('{"message":'), "body", F.lit("}"))).otherwise(F.col("body"))))
    works = works.select("entry_key", F.col("record").withField("provider", F.col("provider")).alias("record"))
    notes = openreview_notes(r.filter("provider = 'openreview'").select("entry_key", "fields", "body")).filter(F.col("record")["id"] == F.col("fields")["providerid"])
    notes = notes.groupBy("entry_key").agg(F.min_by(F.struct("bibtex", "record"), F.coalesce("bibtex", F.lit(""))).alias("n")).select(F.col("n.record.id").alias("id"), F.col("entry_key").alias("of"), "n.bibtex", "n.record")
    found = works.unionByName(_embedded(notes).select(F.col("of").alias("entry_key"), "record")).withColumnsRenamed({"entry_key": "_k", "record": "_record"})
    j = r.join(found, F.col("entry_key") == F.col("_k"), "left")
    kind, own = pj.entry_type_of(F.col("_record")["record_type"]), pj.fields_of_literature(F.col("_record"))
    error = (
        F.when(~F.col("provider").isin(*PROVIDERS), "the provider is unknown").when(~F.col("_known"), "the response's encoding is unknown")
        .when(F.col("_data").isNull() | ~F.sha2("_data", 256).eqNullSafe(f["responsesha256"]), "the stored response has another hash")
        .when(F.col("_record").isNull(), "the stored response holds no record")
        .when(F.lower(F.col("_record")["id"]) != F.lower(f["providerid"]), "the stored response is of another record")
        .when(f["projectionsha256"].isNotNull() & (cn.controlled_hash(kind, own) != f["projectionsha256"]), "the stored response gives other fields")
    )
    j = j.withColumn("error", error)
    return j.select("entry_key", "provider", F.when(F.col("error").isNull(), F.col("_record")).alias("record"), "error")
