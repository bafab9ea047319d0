"""DOIs, arXiv IDs and URLs as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from citegrid.functions.vocab import ARXIV_PATTERN, DOI_PATTERN, WORKFLOW_FIELDS


def doi_of_provider(c: Column) -> Column:
    """A DOI as providers are asked for it: without resolver or scheme, its case kept."""
    return F.trim(F.regexp_replace(F.trim(c), r"^(https://doi\.org/|http://doi\.org/|doi:)", ""))


def normalize_doi(c: Column) -> Column:
    """A DOI found in a text: without closing punctuation and unbalanced closing brackets, in lower case."""
    x = F.regexp_replace(F.trim(c), r"[.,;:]+$", "")
    run = F.length(x) - F.length(F.regexp_replace(x, r"\)+$", ""))
    surplus = F.greatest(F.lit(0), F.regexp_count(x, F.lit(r"\)")) - F.regexp_count(x, F.lit(r"\(")))
    return F.lower(F.left(x, F.length(x) - F.least(run, surplus)))


def find_dois(c: Column) -> Column:
    """All DOIs of a text as a sorted set."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(DOI_PATTERN), F.lit(0)), normalize_doi)))


def find_arxiv(c: Column) -> Column:
    """The first arXiv ID of a text without its version, or null."""
    return F.nullif(F.lower(F.regexp_extract(c, ARXIV_PATTERN, 1)), F.lit(""))


def percent_decode(c: Column) -> Column:
    """%XX decoded, plus signs kept; a text with a bad escape stays as it is."""
    return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)


def normalize_url(c: Column) -> Column:
    """An http or https URL without fragment, scheme and host in lower case; null for others and with credentials."""
    c = F.regexp_replace(c, r"(?s)#.*$", "")
    scheme, host = F.lower(F.try_parse_url(c, F.lit("PROTOCOL"))), F.try_parse_url(c, F.lit("HOST"))
    good = scheme.isin("http", "https") & host.isNotNull() & F.try_parse_url(c, F.lit("USERINFO")).isNull()
    rest = F.regexp_replace(c, r"(?i)^[a-z][a-z0-9+.-]*://[^/?]*", "")
    authority = F.lower(F.regexp_extract(c, r"(?i)^[a-z][a-z0-9+.-]*://([^/?#]*)", 1))
    return F.when(good, F.concat(scheme, F.lit("://"), authority, F.when(F.startswith(rest, F.lit("/")), rest).otherwise(F.concat(F.lit("/"), rest))))


def without_mailto(c: Column) -> Column:
    """A request URL as it is recorded: without its mailto parameter."""
    x = F.regexp_replace(c, r"([?&])mailto=[^&#]*(&|$|(?=#))", "$1")
    return F.regexp_replace(x, r"[?&]($|(?=#))", "")


def safe_url(url: Column, doi: Column) -> Column:
    """The URL, or failing that the DOI's, if it is http or https."""
    x = F.coalesce(F.nullif(F.trim(url), F.lit("")), F.concat(F.lit("https://doi.org/"), F.nullif(F.trim(doi), F.lit(""))))
    return F.when(F.rlike(x, F.lit("^https?://")), x)


def is_public_host(host: Column) -> Column:
    """Whether a host is a public address or a name that isn't local. Names aren't resolved."""
    a = lambda k: F.regexp_extract(host, r"^(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$", k).try_cast("int")
    private = (
        a(1).isin(0, 10, 127) | (a(1) >= 224) | ((a(1) == 172) & a(2).between(16, 31)) | ((a(1) == 192) & (a(2) == 168)) | ((a(1) == 169) & (a(2) == 254))
        | ((a(1) == 100) & a(2).between(64, 127)) | ((a(1) == 192) & (a(2) == 0) & a(3).isin(0, 2)) | ((a(1) == 198) & a(2).isin(18, 19)) | ((a(1) == 198) & (a(2) == 51) & (a(3) == 100)) | ((a(1) == 203) & (a(2) == 0) & (a(3) == 113))
    )
    v6 = F.rlike(host, F.lit(r"(?i)^\[?(::1?|f[cd][0-9a-f]{2}:.*|fe[89ab][0-9a-f]:.*|ff[0-9a-f]{2}:.*|2001:db8:.*)\]?$"))
    name = F.rlike(F.lower(host), F.lit(r"(^|\.)localhost\.?$"))
    return host.isNotNull() & (host != "") & ~F.coalesce(private, F.lit(False)) & ~v6 & ~name


def identifier_of_fields(fields: Column) -> Column:
    """STRUCT<kind, value, doi, field> of the first field, by name, that holds a DOI (the smallest) or else an arXiv ID."""

    def one(e: Column) -> Column:
        value = F.replace(e["value"], F.lit("\\_"), F.lit("_"))
        doi = F.try_element_at(find_dois(percent_decode(value)), F.lit(1))
        arxiv = find_arxiv(F.when(e["key"] == "eprint", F.concat(F.lit("https://arxiv.org/abs/"), F.trim(value))).otherwise(value))
        return F.struct(
            F.when(doi.isNotNull(), "doi").when(arxiv.isNotNull(), "arxiv").alias("kind"),
            F.coalesce(doi, arxiv).alias("value"),
            F.coalesce(doi, F.concat(F.lit("10.48550/arXiv."), arxiv)).alias("doi"),
            e["key"].alias("field"),
        )

    entries = F.array_sort(F.filter(F.map_entries(fields), lambda e: ~e["key"].isin(*WORKFLOW_FIELDS)))
    return F.try_element_at(F.filter(F.transform(entries, one), lambda x: x["kind"].isNotNull()), F.lit(1))
