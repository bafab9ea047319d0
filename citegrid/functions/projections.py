"""Projections between field maps, the common literature record and provider payloads."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from citegrid.functions import text as tx
from citegrid.functions.canonical import without
from citegrid.functions.identifiers import doi_of_provider
from citegrid.functions.vocab import COMMON_TYPE, CONTROLLED_FIELDS, ENTRY_TYPE, WORKFLOW_FIELDS

#: The common literature record.
PERSON = "struct<family:string,given:string,orcid:string>"
LITERATURE = (
    f"struct<provider:string,id:string,record_type:string,title:string,authors:array<{PERSON}>,editors:array<{PERSON}>,container_title:string,publisher:string,"
    "issued:struct<year:int,month:int,day:int>,volume:string,issue:string,pages:string,article_number:string,doi:string,url:string,isbn:array<string>,issn:array<string>>"
)
#: What a Crossref work holds of it; a search result adds its score.
_CROSSREF_PERSON = "struct<family:string,given:string,ORCID:string,name:string>"
_CROSSREF_DATE = "struct<`date-parts`:array<array<int>>>"
CROSSREF_WORK = (
    f"struct<DOI:string,type:string,title:array<string>,author:array<{_CROSSREF_PERSON}>,editor:array<{_CROSSREF_PERSON}>,`container-title`:array<string>,publisher:string,"
    f"issued:{_CROSSREF_DATE},`published-print`:{_CROSSREF_DATE},`published-online`:{_CROSSREF_DATE},volume:string,issue:string,page:string,`article-number`:string,URL:string,ISBN:array<string>,ISSN:array<string>,score:double>"
)


def _case(c: Column, table: dict[str, str], other: Column) -> Column:
    out = F
    for k, v in table.items():
        out = out.when(c == k, F.lit(v))
    return out.otherwise(other)


def common_type(entry_type: Column) -> Column:
    return _case(entry_type, COMMON_TYPE, entry_type)


def entry_type_of(record_type: Column) -> Column:
    return _case(record_type, ENTRY_TYPE, F.lit("misc"))


def _listed(c: Column) -> Column:
    return F.filter(F.array(c), lambda x: x.isNotNull())


def literature_of_fields(provider: Column, record_id: Column, entry_type: Column, fields: Column) -> Column:
    """A field map as a common literature record."""
    year = fields["year"]
    issued = F.when(F.trim(year).try_cast("int").isNotNull(), F.struct(F.trim(year).try_cast("int").alias("year"), F.trim(fields["month"]).try_cast("int").alias("month"), F.lit(None).cast("int").alias("day")))
    return F.struct(
        provider.alias("provider"), record_id.alias("id"), common_type(entry_type).alias("record_type"), fields["title"].alias("title"),
        tx.contributors(fields["author"]).alias("authors"), tx.contributors(fields["editor"]).alias("editors"),
        F.coalesce(fields["journal"], fields["booktitle"]).alias("container_title"), fields["publisher"].alias("publisher"), issued.alias("issued"),
        fields["volume"].alias("volume"), fields["number"].alias("issue"), fields["pages"].alias("pages"), fields["eid"].alias("article_number"),
        fields["doi"].alias("doi"), fields["url"].alias("url"), _listed(fields["isbn"]).alias("isbn"), _listed(fields["issn"]).alias("issn"),
    ).cast(LITERATURE)


def fields_of_literature(r: Column) -> Column:
    """The field map of a common literature record, with its provider and ID."""
    kind = entry_type_of(r["record_type"])
    people = lambda c: F.when(F.size(c) > 0, tx.contributors_text(c))
    kept = lambda c: F.when(F.trim(c) != "", c)
    values = {
        "title": kept(r["title"]), "author": people(r["authors"]), "editor": people(r["editors"]),
        "journal": F.when(kind == "article", kept(r["container_title"])),
        "booktitle": F.when(kind.isin("inproceedings", "incollection"), kept(r["container_title"])),
        "publisher": kept(r["publisher"]), "year": r["issued"]["year"].cast("string"), "month": r["issued"]["month"].cast("string"),
        "volume": kept(r["volume"]), "number": kept(r["issue"]), "pages": kept(r["pages"]), "eid": kept(r["article_number"]),
        "doi": kept(r["doi"]), "url": kept(r["url"]), "isbn": F.try_element_at(r["isbn"], F.lit(1)), "issn": F.try_element_at(r["issn"], F.lit(1)),
        "bibprovider": r["provider"], "bibproviderid": r["id"],
    }
    return F.map_filter(F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v)]), lambda k, v: v.isNotNull())


def overlay(base: Column, top: Column) -> Column:
    """Two maps as one; where both have a key the second counts."""
    return F.map_concat(F.map_filter(base, lambda k, v: ~F.map_contains_key(top, k)), top)


def adopted_fields(current: Column, provider_fields: Column) -> Column:
    """A record's fields once a provider's are adopted: controlled fields go, the provider's come, local ones stay."""
    return overlay(without(current, CONTROLLED_FIELDS), provider_fields)


def clean_fields(fields: Column) -> Column:
    return without(fields, WORKFLOW_FIELDS)


def public_evidence(fields: Column) -> Column:
    """Evidence as it is shown: without stored responses."""
    return without(fields, ("response", "responseencoding", "bibprevious"))


def drop_blank(fields: Column) -> Column:
    return F.map_filter(fields, lambda k, v: F.trim(v) != "")


def clean_markup(c: Column) -> Column:
    """The text of a value with XML markup: tags, comments and entity references go, CDATA is text, the ends are trimmed.
    A value that is not well formed stays as it is.

    Innermost pairs of tags go first, again and again, as often as there are end tags at most; what is left of markup
    then is not well formed.
    """
    parts = F.split(c, r"<!\[CDATA\[")
    # characters of markup inside CDATA stand aside while tags are matched
    plain = lambda p: F.concat(F.translate(F.substring_index(p, "]]>", 1), "<&", "\ue000\ue001"), F.substring(p, F.length(F.substring_index(p, "]]>", 1)) + 4, F.length(p)))
    text = F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, p).when(F.contains(p, F.lit("]]>")), plain(p)).otherwise(F.concat(F.lit("<"), p))), "")
    text = F.regexp_replace(F.regexp_replace(text, r"(?s)<!--.*?-->|<\?.*?\?>", ""), r"<[A-Za-z][^<>]*/>", "")
    rounds = F.sequence(F.lit(0), F.regexp_count(text, F.lit("</")))
    bare = F.aggregate(rounds, text, lambda x, _: F.regexp_replace(x, r"<([A-Za-z][\w:.-]*)(?:\s[^<>]*)?>([^<]*)</\1\s*>", "$2"))
    bare = F.regexp_replace(bare, r"&(?:[A-Za-z][A-Za-z0-9]*|#[0-9]+|#x[0-9A-Fa-f]+);", "")
    return F.when(F.rlike(bare, F.lit("[<&]")), c).otherwise(F.trim(F.translate(bare, "\ue000\ue001", "<&")))


def literature_of_crossref(work: Column, provider: str = "crossref") -> Column:
    """A Crossref work as a common literature record. A print date counts before an online one even if it holds no year."""

    def people(c: Column) -> Column:
        one = lambda p: F.struct(
            F.when(F.coalesce(p["family"], F.lit("")) == "", F.coalesce(p["name"], F.lit(""))).otherwise(clean_markup(p["family"])).alias("family"),
            clean_markup(p["given"]).alias("given"),
            F.regexp_replace(p["ORCID"], r"^(https://orcid\.org/)+", "").alias("orcid"),
        )
        return F.coalesce(F.transform(c, one), F.array().cast(f"array<{PERSON}>"))

    parts = F.get(F.coalesce(work["published-print"], work["published-online"], work["issued"])["date-parts"], F.lit(0))
    at = lambda i: F.get(parts, F.lit(i))
    small = lambda c: F.when(c.between(0, 255), c)
    issued = F.when(at(0).isNotNull(), F.struct(at(0).alias("year"), small(at(1)).alias("month"), small(at(2)).alias("day")))
    first = lambda c: clean_markup(F.get(c, F.lit(0)))
    some = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    return F.struct(
        F.lit(provider).alias("provider"), doi_of_provider(work["DOI"]).alias("id"), F.coalesce(work["type"], F.lit("")).alias("record_type"), first(work["title"]).alias("title"),
        people(work["author"]).alias("authors"), people(work["editor"]).alias("editors"), first(work["container-title"]).alias("container_title"), clean_markup(work["publisher"]).alias("publisher"),
        issued.alias("issued"), work["volume"].alias("volume"), work["issue"].alias("issue"), work["page"].alias("pages"), work["article-number"].alias("article_number"),
        doi_of_provider(work["DOI"]).alias("doi"), work["URL"].alias("url"), some(work["ISBN"]).alias("isbn"), some(work["ISSN"]).alias("issn"),
    ).cast(LITERATURE)


def literature_of_note(note_id: Column, title: Column, authors: Column, venue: Column) -> Column:
    """A review-platform note without embedded BibTeX as a common record: names whole, the year from the venue only."""
    year = tx.extract_year(venue)
    none, url = F.lit(None).cast("string"), F.concat(F.lit("https://openreview.net/forum?id="), note_id)
    people = F.coalesce(F.transform(authors, lambda a: F.struct(a.alias("family"), none.alias("given"), none.alias("orcid"))), F.array().cast(f"array<{PERSON}>"))
    return F.struct(
        F.lit("openreview").alias("provider"), note_id.alias("id"), F.lit("posted-content").alias("record_type"), title.alias("title"), people.alias("authors"), F.array().cast(f"array<{PERSON}>").alias("editors"),
        venue.alias("container_title"), none.alias("publisher"), F.when(year.isNotNull(), F.struct(year.alias("year"), F.lit(None).cast("int").alias("month"), F.lit(None).cast("int").alias("day"))).alias("issued"),
        none.alias("volume"), none.alias("issue"), none.alias("pages"), none.alias("article_number"), none.alias("doi"), url.alias("url"), F.array().cast("array<string>").alias("isbn"), F.array().cast("array<string>").alias("issn"),
    ).cast(LITERATURE)


def changed_fields(type_a: Column, fields_a: Column, type_b: Column, fields_b: Column) -> Column:
    """ARRAY<STRUCT<field, current, proposed>> of the fields that differ, by name; first the type if that differs."""
    a, b = clean_fields(fields_a), clean_fields(fields_b)
    names = F.array_sort(F.array_union(F.map_keys(a), F.map_keys(b)))
    rows = F.filter(F.transform(names, lambda n: F.struct(n.alias("field"), F.try_element_at(a, n).alias("current"), F.try_element_at(b, n).alias("proposed"))), lambda r: ~r["current"].eqNullSafe(r["proposed"]))
    kind = F.when(F.lower(type_a) != F.lower(type_b), F.array(F.struct(F.lit("ENTRYTYPE").alias("field"), type_a.alias("current"), type_b.alias("proposed")))).otherwise(F.array().cast("array<struct<field:string,current:string,proposed:string>>"))
    return F.concat(kind, rows)
