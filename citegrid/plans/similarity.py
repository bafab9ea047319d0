"""Queries on text functions and record similarity."""

from __future__ import annotations

from pyspark.sql import functions as F

from citegrid.functions import text as tx
from citegrid.operators import dedupe
from citegrid.plans.views import BIBLIO, TOKENS, WORDS, biblio, table

T = TOKENS.format("title")
SURNAMES = "list_sort(list_distinct(list_filter([CASE WHEN instr(author, ',') > 0 THEN array_to_string(" + WORDS.format("split_part(author, ',', 1)") + ", ' ') ELSE " + WORDS.format("author") + "[-1] END], lambda x: x <> '')))"
_PREPARED = f"""p AS (SELECT seq, {T} AS tt, {SURNAMES} AS an, {TOKENS.format('author')} AS aw FROM biblio WHERE title IS NOT NULL AND author IS NOT NULL)"""
_DICE = "CASE WHEN len(l.{0}) = 0 OR len(r.{0}) = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * len(list_intersect(l.{0}, r.{0})) / (len(l.{0}) + len(r.{0})) END"
_PAIRS = f"""WITH {BIBLIO}, {_PREPARED},
c AS (SELECT l.seq AS left_seq, r.seq AS right_seq, {_DICE.format('tt')} AS t, 0.75::DOUBLE * {_DICE.format('an')} + 0.25::DOUBLE * {_DICE.format('aw')} AS a FROM p l JOIN p r ON l.seq < r.seq),
s AS (SELECT *, 0.7::DOUBLE * t + 0.3::DOUBLE * a AS s FROM c)
SELECT left_seq, right_seq, round(s * 10000) / 10000 AS score, round(t * 10000) / 10000 AS title_score, round(a * 10000) / 10000 AS author_score FROM s WHERE s >= 0.75::DOUBLE"""
_CLASSES = _PAIRS.replace(_PREPARED, f"p0 AS (SELECT seq, {T} AS tt, {SURNAMES} AS an, {TOKENS.format('author')} AS aw FROM biblio WHERE title IS NOT NULL AND author IS NOT NULL), p AS (SELECT min(seq) AS seq, tt, an, aw FROM p0 GROUP BY tt, an, aw)")


def dedupe_pairs(spark, sf_dir):
    return dedupe.dedupe(biblio(spark, sf_dir))


def dedupe_classes(spark, sf_dir):
    return dedupe.dedupe_classes(biblio(spark, sf_dir))


def dedupe_members(spark, sf_dir):
    return dedupe.class_members(biblio(spark, sf_dir))


def token_set_whole(spark, sf_dir):
    tokens = tx.tokens(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(tokens).cast("long").alias("n_tokens"), F.array_join(tokens, " ").alias("tokens"))


def author_surnames(spark, sf_dir):
    s = table(spark, sf_dir, "customer").withColumn("author", F.concat(F.lit("van "), "c_name", F.lit(", A. and B. "), "c_mktsegment", F.lit(" and  and De la "), "c_name"))
    return s.select("c_custkey", F.array_join(tx.author_surnames(F.col("author")), "|").alias("surnames"))


def title_query(spark, sf_dir):
    title = F.concat(F.lit("{"), "p_name", F.lit("}~ \\ "), "p_brand", F.lit("  "), "p_type")
    return table(spark, sf_dir, "part").select("p_partkey", tx.title_query(title).alias("query"))


def citation_query(spark, sf_dir):
    b = biblio(spark, sf_dir)
    return b.select("seq", tx.citation_query(b.fields).alias("query"))


def contributors_roundtrip(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("author", F.concat("c_name", F.lit(" , "), "c_mktsegment", F.lit(" and  and Solo and "), F.col("c_nationkey").cast("string"), F.lit(",")))
    people = tx.contributors(F.col("author"))
    return c.select("c_custkey", F.size(people).cast("long").alias("n"), tx.contributors_text(people).alias("author"))


def year_extract(spark, sf_dir):
    t = F.concat(F.lit("v12345 "), F.date_format("o_orderdate", "yyyyMMdd"), F.lit(" in "), F.date_format("o_orderdate", "yyyy"), F.lit(", no. "), F.col("o_orderkey").cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", tx.extract_year(t).cast("long").alias("year"))


def shell_words(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", tx.shell_quote(F.col("p_name")).alias("name"), tx.shell_quote(F.concat("p_brand", F.lit("'s"))).alias("brand"), tx.shell_quote(F.regexp_replace("p_brand", "[^A-Za-z0-9]", "_")).alias("bare"))


QUERIES = {f.__name__: f for f in (dedupe_pairs, dedupe_classes, dedupe_members, token_set_whole, author_surnames, title_query, citation_query, contributors_roundtrip, year_extract, shell_words)}

_CUSTOMER_NAME = WORDS.format("'van ' || c_name")
ORACLES = {
    "dedupe_pairs": _PAIRS,
    "dedupe_classes": _CLASSES,
    "dedupe_members": f"WITH {BIBLIO}, p AS (SELECT seq, {T} AS tt, {SURNAMES} AS an, {TOKENS.format('author')} AS aw FROM biblio WHERE title IS NOT NULL AND author IS NOT NULL) SELECT seq, min(seq) OVER (PARTITION BY tt, an, aw) AS class_seq FROM p",
    "token_set_whole": f"SELECT doc_id, len(t)::BIGINT AS n_tokens, array_to_string(t, ' ') AS tokens FROM (SELECT doc_id, {TOKENS.format('text')} AS t FROM documents)",
    "author_surnames": f"""SELECT c_custkey, array_to_string(list_sort(list_distinct([array_to_string({_CUSTOMER_NAME}, ' '), {WORDS.format('c_mktsegment')}[-1], {WORDS.format('c_name')}[-1]])), '|') AS surnames FROM customer""",
    "title_query": "SELECT p_partkey, trim(regexp_replace(p_name || '  ' || ' ' || p_brand || '  ' || p_type, '\\s+', ' ', 'g')) AS query FROM part",
    "citation_query": f"WITH {BIBLIO} SELECT seq, concat_ws('. ', author, title, year) AS query FROM biblio",
    "contributors_roundtrip": "SELECT c_custkey, 3::BIGINT AS n, trim(c_name) || ', ' || trim(c_mktsegment) || ' and Solo and ' || c_nationkey AS author FROM customer",
    "year_extract": "SELECT o_orderkey, CASE WHEN year(o_orderdate) BETWEEN 1900 AND 2099 THEN year(o_orderdate) ELSE NULL END::BIGINT AS year FROM orders",
    "shell_words": "SELECT p_partkey, CASE WHEN regexp_full_match(p_name, '[A-Za-z0-9_./:-]+') THEN p_name ELSE '''' || p_name || '''' END AS name, '''' || p_brand || '''\\''''s''' AS brand, regexp_replace(p_brand, '[^A-Za-z0-9]', '_', 'g') AS bare FROM part",
}
