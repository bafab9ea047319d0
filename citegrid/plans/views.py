"""Views of the test tables as bibliographic records, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def biblio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, entry_type, entry_key, title, author, fields of documents: the title is the whole first line."""
    i = F.col("doc_id")
    d = table(spark, sf_dir, "documents").select(
        i.alias("seq"),
        F.when(i % 3 == 0, "article").when(i % 3 == 1, "book").otherwise("misc").alias("entry_type"),
        F.concat(F.lit("d"), i.cast("string")).alias("entry_key"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.concat_ws(", ", "source", "lang").alias("author"),
        (F.lit(1990) + i % 35).cast("string").alias("year"),
        F.when(i % 4 == 0, F.concat(F.lit("https://doi.org/10."), (1000 + i % 9000).cast("string"), F.lit("/X"), i.cast("string"), F.lit(")."))).alias("doi"),
        F.when(i % 5 == 0, F.concat(F.lit("see https://arXiv.org/abs/2301."), F.lpad((i % 100000).cast("string"), 5, "0"), F.lit("v2"))).alias("note"),
        F.when(i % 7 == 0, F.concat(F.lit("provider:"), (i % 3).cast("string"))).alias("bibsource"),
    )
    values = ["title", "author", "year", "doi", "note", "bibsource"]
    fields = F.map_filter(F.create_map(*[x for v in values for x in (F.lit(v), F.col(v))]), lambda k, v: v.isNotNull())
    return d.withColumn("fields", fields)


BIBLIO = """biblio AS (SELECT doc_id AS seq, CASE doc_id % 3 WHEN 0 THEN 'article' WHEN 1 THEN 'book' ELSE 'misc' END AS entry_type,
 'd' || doc_id AS entry_key, split_part(text, chr(10), 1) AS title, concat_ws(', ', source, lang) AS author, CAST(1990 + doc_id % 35 AS VARCHAR) AS year,
 CASE WHEN doc_id % 4 = 0 THEN 'https://doi.org/10.' || (1000 + doc_id % 9000) || '/X' || doc_id || ').' END AS doi,
 CASE WHEN doc_id % 5 = 0 THEN 'see https://arXiv.org/abs/2301.' || lpad(CAST(doc_id % 100000 AS VARCHAR), 5, '0') || 'v2' END AS note,
 CASE WHEN doc_id % 7 = 0 THEN 'provider:' || (doc_id % 3) END AS bibsource FROM documents)"""

#: SQL of normalised words and of the token set of a column.
WORDS = "string_split(trim(lower(regexp_replace({0}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))), ' ')"
TOKENS = "list_sort(list_distinct(list_filter(" + WORDS + ", lambda x: x <> '')))"
