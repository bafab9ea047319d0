"""Identifier resolution of URLs, pages and records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citegrid.functions import identifiers as ids


def discoveries(found: DataFrame, key: str) -> DataFrame:
    """(key, doi, confidence, signal) -> per key and DOI the best confidence and the sorted set of signals."""
    g = found.groupBy(key, "doi").agg(F.max((F.col("confidence") == "exact").cast("int")).alias("e"), F.array_sort(F.collect_set("signal")).alias("signals"))
    return g.select(key, "doi", F.when(F.col("e") == 1, "exact").otherwise("strong").alias("confidence"), "signals")


def status_of(candidates: Column) -> Column:
    return F.when(F.size(candidates) == 0, "unresolved").when(F.size(candidates) == 1, "resolved").otherwise("ambiguous")


def exact_candidate(candidates: Column) -> Column:
    """STRUCT<value, error>: the one candidate, or why there is not exactly one."""
    n = F.size(candidates)
    return F.struct(F.when(n == 1, F.get(candidates, F.lit(0))["value"]).alias("value"), F.when(n == 0, "no identifier was found").when(n > 1, "more than one identifier was found").alias("error"))


_CANDIDATE = "array<struct<kind:string,value:string,confidence:string,method:string,signals:array<string>>>"


def resolve_urls(urls: DataFrame, pages: DataFrame | None = None, atoms: DataFrame | None = None) -> DataFrame:
    """(id, url) -> id, url, status, candidates, warnings.

    DOIs in the decoded URL are exact; failing these an arXiv ID, looked up in ``atoms`` (arxiv, doi) if given; failing
    that the DOIs of the page in ``pages`` (url, final_url, media_type, html): in its final URL exact, in its metadata
    strong. Each stage sees only what the one before left open.
    """
    from citegrid.functions.webscan import page_dois

    none = F.array().cast(_CANDIDATE)
    text = ids.percent_decode(ids.normalize_url(F.col("url")))
    one = lambda kind, method, signal: lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value"), F.lit("exact").alias("confidence"), F.lit(method).alias("method"), F.array(F.lit(signal)).alias("signals"))
    out = urls.select("id", "url", F.coalesce(F.transform(ids.find_dois(text), one("doi", "url-doi", "doi-in-url")), none).alias("direct"), ids.find_arxiv(text).alias("arxiv"))
    if atoms is not None:
        out = out.join(atoms.select(F.col("arxiv").alias("_a"), F.lower("doi").alias("_d")), F.col("arxiv") == F.col("_a"), "left").drop("_a")
    else:
        out = out.withColumn("_d", F.lit(None).cast("string"))
    by_atom = F.when(F.col("_d").isNotNull(), F.array(one("doi", "arxiv-atom", "atom-doi")(F.col("_d"))))
    by_url = F.when(F.col("arxiv").isNotNull(), F.array(one("arxiv", "arxiv-url", "arxiv-id-in-url")(F.col("arxiv"))))
    out = out.withColumn("candidates", F.when(F.size("direct") > 0, F.col("direct")).otherwise(F.coalesce(by_atom, by_url, none)))
    if pages is not None:
        open_ = out.filter(F.size("candidates") == 0).select("id", F.col("url").alias("u"))
        p = open_.join(pages, F.col("u") == F.col("url")).filter(F.contains("media_type", F.lit("html")))
        final = p.select("id", F.explode(ids.find_dois(ids.percent_decode(F.col("final_url")))).alias("doi"), F.lit("exact").alias("confidence"), F.lit("doi-in-final-url").alias("signal"))
        meta = p.select("id", F.explode(page_dois(F.col("html"))).alias("m")).select("id", F.explode(ids.find_dois(F.col("m.text"))).alias("doi"), F.lit("strong").alias("confidence"), F.col("m.signal").alias("signal"))
        d = discoveries(final.unionByName(meta), "id")
        listed = d.groupBy("id").agg(F.array_sort(F.collect_list(F.struct(F.col("doi").alias("value"), "confidence", "signals"))).alias("l"))
        listed = listed.select("id", F.transform("l", lambda x: F.struct(F.lit("doi").alias("kind"), x["value"].alias("value"), x["confidence"].alias("confidence"), F.lit("html-metadata").alias("method"), x["signals"].alias("signals"))).alias("paged"))
        out = out.join(listed, "id", "left").withColumn("candidates", F.when(F.size("candidates") > 0, F.col("candidates")).otherwise(F.coalesce("paged", none)))
    warnings = F.when(F.size("candidates") > 1, F.array(F.lit("conflicting identifiers were found"))).when(F.exists("candidates", lambda c: c["kind"] == "arxiv"), F.array(F.lit("no DOI is known for the arXiv ID"))).otherwise(F.array().cast("array<string>"))
    return out.select("id", "url", status_of(F.col("candidates")).alias("status"), "candidates", warnings.alias("warnings"))


def verify_identifier(fields: Column) -> Column:
    """STRUCT<doi, method>: what a record is verified by. Its DOI field, else a field but the URL, else the URL."""
    rest = ids.identifier_of_fields(F.map_filter(fields, lambda k, v: k != "url"))
    by_url = ids.identifier_of_fields(F.map_filter(fields, lambda k, v: k == "url"))
    own = ids.doi_of_provider(F.replace(F.nullif(F.trim(fields["doi"]), F.lit("")), F.lit("\\_"), F.lit("_")))
    return F.struct(
        F.coalesce(own, rest["doi"], by_url["doi"]).alias("doi"),
        F.when(own.isNotNull(), "doi-field").when(rest["doi"].isNotNull(), F.concat(F.lit("field:"), rest["field"])).when(by_url["doi"].isNotNull(), "url").alias("method"),
    )


def plan_identifier(fields: Column, provider: Column) -> Column:
    """STRUCT<id, method>: what a record is planned by. Its stored ID of that provider, its DOI field, its URL's DOI; else
    a title search, or nothing. Here escapes are left as they are, and arXiv IDs are not supported."""
    stored = F.when(F.coalesce(fields["bibprovider"], F.lit("crossref")) == provider, fields["bibproviderid"])
    own = F.nullif(ids.doi_of_provider(fields["doi"]), F.lit(""))
    by_url = F.try_element_at(ids.find_dois(ids.percent_decode(fields["url"])), F.lit(1))
    arxiv = ids.find_arxiv(fields["url"])
    return F.struct(
        F.coalesce(stored, own, by_url).alias("id"),
        F.when(stored.isNotNull(), "stored").when(own.isNotNull(), "doi").when(by_url.isNotNull(), "url").when(arxiv.isNotNull(), "unsupported-identifier").when(fields["title"].isNotNull(), "title-search").otherwise("unsupported").alias("method"),
    )


def apply_identifier(given: Column, fields: Column) -> Column:
    """The ID to apply: given, stored, DOI field, URL, any field."""
    return F.coalesce(given, fields["bibproviderid"], F.nullif(ids.doi_of_provider(fields["doi"]), F.lit("")), F.try_element_at(ids.find_dois(ids.percent_decode(fields["url"])), F.lit(1)), ids.identifier_of_fields(fields)["doi"])
