"""Quality rules: base text statistics and cross-document line frequency."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citegrid.llm.common import Shield, checkpoint, text_or_empty

#: A line is boilerplate on its host if more than LINE_DOCS documents and more than LINE_SHARE of the host's documents have it.
LINE_DOCS, LINE_SHARE = 10, 0.01
#: A document is depleted if fewer than LEFT_WORDS words or less than LEFT_SHARE of its words stay.
LEFT_WORDS, LEFT_SHARE = 10, 0.5
MIN_WORDS, REPEAT_PERCENT, WINDOW = 10, 20, 5

_SPACE, _SYMBOL = re.compile(r"[\x20\x09-\x0D]+"), re.compile(r"[#*$%&|<>]")


def repeat_words(words: list[str], window: int = WINDOW) -> int:
    """Number of words that lie in a window of ``window`` words found twice or more in the text."""
    n = len(words)
    if n <= window:
        return 0
    ids: dict[str, int] = {}
    one = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    if len(ids) == n:
        return 0
    code = one[: n - window + 1].copy()
    for k in range(1, window):  # exact: codes are made dense again before they could overflow
        if int(code.max()) + 1 > (1 << 62) // len(ids):
            code = np.unique(code, return_inverse=True)[1].astype(np.int64)
        code = code * len(ids) + one[k : n - window + 1 + k]
    order = np.argsort(code, kind="stable")
    same = code[order][1:] == code[order][:-1]
    if not same.any():
        return 0
    hit = np.zeros(len(code), bool)
    hit[order[1:][same]] = hit[order[:-1][same]] = True
    edge = np.zeros(n + 1, np.int32)
    edge[: len(code)] += hit
    edge[window : window + len(code)] -= hit
    return int((np.cumsum(edge)[:n] > 0).sum())


def _stats(text: str | None) -> tuple[int, int, int, int, int]:
    text = text or ""
    words = [w for w in _SPACE.split(text) if w]
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if line in seen:
            dup += bool(_SPACE.sub("", line))
        else:
            seen.add(line)
    return len(words), sum(map(len, words)), len(_SYMBOL.findall(text)), dup, repeat_words(words)


STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@F.pandas_udf(T.StructType([T.StructField(c, T.LongType()) for c in STATS]))
def text_stats(text: pd.Series) -> pd.DataFrame:
    """The five statistics of each whole text; a null text has zeros."""
    return pd.DataFrame([_stats(t) for t in text], columns=list(STATS))


def line_key(line: Column) -> Column:
    """64-bit hash of a normalised line: lower case, white space runs as one space, ends trimmed."""
    return F.xxhash64(F.trim(F.lower(F.regexp_replace(line, r"[\x20\x09-\x0D]+", " "))))


def _lines(text: str) -> Column:
    return F.filter(F.split(text_or_empty(text), "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))


def frequent_lines(docs: DataFrame, key: str = "doc_id", host: str = "source", text: str = "text", min_docs: int = LINE_DOCS, share: float = LINE_SHARE) -> DataFrame:
    """(_host, _line): the lines of each host that more than min_docs and more than ``share`` of its documents have.

    A document is a key; a row with a null key is one of its own. Every row gives each of its lines once, and counts are
    summed in the map tasks before the shuffle, so a line that all documents have costs one row for each task. Only the
    rows of keys that stand more than once, if there are any, are made distinct by key first.
    """
    slim = docs.select(F.col(key).alias("_key"), F.col(host).alias("_host"), F.array_distinct(F.transform(_lines(text), line_key)).alias("_own"))
    repeated = checkpoint(slim.filter("_key IS NOT NULL").groupBy("_key").count().filter("count > 1").select(F.col("_key").alias("_again")))

    def counted(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Documents of each host, and of each of its lines."""
        lines = rows.select("_host", F.explode("_own").alias("_line")).groupBy("_host", "_line").agg(F.count(F.lit(1)).alias("_docs"))
        return rows.groupBy(F.col("_host").alias("_h")).agg(F.count(F.lit(1)).alias("_all")), lines

    if repeated.isEmpty():
        hosts, lines = counted(slim)
    else:
        hosts, lines = counted(slim.join(repeated, F.col("_key") == F.col("_again"), "left_anti"))
        again = slim.join(repeated, F.col("_key") == F.col("_again"), "left_semi")
        keys = again.select("_host", "_key").distinct().groupBy(F.col("_host").alias("_h")).agg(F.count(F.lit(1)).alias("_all"))
        more = again.select("_host", "_key", F.explode("_own").alias("_line")).distinct().groupBy("_host", "_line").agg(F.count(F.lit(1)).alias("_docs"))
        hosts = hosts.unionByName(keys).groupBy("_h").agg(F.sum("_all").alias("_all"))
        lines = lines.unionByName(more).groupBy("_host", "_line").agg(F.sum("_docs").alias("_docs"))
    often = lines.filter(F.col("_docs") > min_docs)
    return often.join(hosts, F.col("_host").eqNullSafe(F.col("_h"))).filter(F.col("_docs") > share * F.col("_all")).select("_host", "_line")


def filter_lines(docs: DataFrame, key: str = "doc_id", host: str = "source", text: str = "text", min_docs: int = LINE_DOCS, share: float = LINE_SHARE, left_words: int = LEFT_WORDS, left_share: float = LEFT_SHARE) -> DataFrame:
    """docs with base statistics, ``base_failed``, ``removed_words``, ``clean_text`` and ``kept``.

    A line above both limits of its host is removed wherever it stands; ``kept`` is false if the base rules fail or the
    document is depleted. Null texts count as empty (and fail the base rules), null hosts are one host, rows with equal
    keys are one document when documents are counted but are judged each by its own lines, an empty table gives no rows.
    Of columns named like an added one the added one stays. ``clean_text`` costs nothing where it isn't selected. A task
    holds the lines and words of one text at a time, so memory follows the longest text.
    """
    shield = Shield(docs)
    docs, key, host, text = shield.df, shield(key), shield(host), shield(text)
    each = F.posexplode(F.transform(_lines(text), lambda x: F.struct(line_key(x).alias("line"), F.regexp_count(x, F.lit(r"[^\x20\x09-\x0D]+")).alias("words"))))
    lines = docs.select(F.col(key).alias("_key"), F.col(host).alias("_host"), F.xxhash64(text).alias("_tid"), each.alias("_pos", "_l"))
    often = frequent_lines(docs, key, host, text, min_docs, share).withColumnsRenamed({"_host": "_h", "_line": "_o"})
    hit = lines.join(often, F.col("_host").eqNullSafe(F.col("_h")) & (F.col("_l.line") == F.col("_o")), "left_semi")
    # rows of equal key, host and text lose the same lines: each place once
    removed = hit.groupBy("_key", "_host", "_tid").agg(F.collect_set(F.struct("_pos", "_l.line", "_l.words")).alias("_gone"))
    removed = removed.select("_key", "_host", "_tid", F.aggregate("_gone", F.lit(0).cast("long"), lambda n, x: n + x["words"]).alias("_words"), F.array_distinct(F.transform("_gone", lambda x: x["line"])).alias("_lines"))

    base = docs.withColumn("_own", F.xxhash64(text)).withColumn("_s", text_stats(F.col(text))).select("*", "_s.*").drop("_s")
    out = base.join(removed, F.col(key).eqNullSafe(F.col("_key")) & F.col(host).eqNullSafe(F.col("_host")) & (F.col("_own") == F.col("_tid")), "left")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    left = F.col("n_words") - F.coalesce(F.col("_words"), F.lit(0))
    depleted = (left < left_words) | (left < left_share * F.col("n_words"))
    clean = F.when(F.col("_lines").isNull(), F.col(text)).otherwise(F.array_join(F.filter(F.split(F.col(text), "\n"), lambda x: ~F.array_contains(F.col("_lines"), line_key(x))), "\n"))
    removed = F.coalesce(F.col("_words"), F.lit(0)).cast("long")
    return shield.restored(out, **{c: c for c in STATS}, base_failed=failed, removed_words=removed, clean_text=clean, kept=~failed & ~depleted)


def op1(docs: DataFrame) -> DataFrame:
    """The digest of :func:`filter_lines` over documents, with ``source`` as the host."""
    out = filter_lines(docs.select("doc_id", "source", "text"))
    return out.select("doc_id", *STATS, "base_failed", "removed_words", "kept")


ORACLE = """
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
l0 AS (SELECT doc_id, source, string_split(text, chr(10)) AS ls FROM d),
l1 AS (SELECT doc_id, source, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM l0),
l AS (SELECT *, lower(trim(regexp_replace(line, '[\\x20\\x09-\\x0D]+', ' ', 'g'))) AS norm, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS n,
   row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) AS k FROM l1),
dup AS (SELECT doc_id, count(*) AS n_dup_lines FROM l WHERE n > 0 AND k > 1 GROUP BY doc_id),
f AS (SELECT source, norm FROM (SELECT source, norm, count(DISTINCT doc_id) AS c FROM l WHERE n > 0 GROUP BY source, norm) JOIN
   (SELECT source AS s, count(DISTINCT doc_id) AS a FROM d GROUP BY source) ON source IS NOT DISTINCT FROM s WHERE c > 10 AND c > 0.01 * a),
rem AS (SELECT l.doc_id, sum(l.n) AS removed FROM l JOIN f ON l.source IS NOT DISTINCT FROM f.source AND l.norm = f.norm WHERE l.n > 0 GROUP BY l.doc_id),
g0 AS (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3] || ' ' || w[i+4] AS g FROM g0),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1),
rw AS (SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words FROM r, (SELECT unnest(range(5)) AS j) GROUP BY doc_id),
s AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g'))::BIGINT AS word_chars,
   len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
   coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(removed, 0)::BIGINT AS removed_words
   FROM d LEFT JOIN dup ON dup.doc_id = d.doc_id LEFT JOIN rw ON rw.doc_id = d.doc_id LEFT JOIN rem ON rem.doc_id = d.doc_id),
b AS (SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, removed_words,
  (NOT base_failed AND n_words - removed_words >= 10 AND 2 * (n_words - removed_words) >= n_words) AS kept FROM b
"""
