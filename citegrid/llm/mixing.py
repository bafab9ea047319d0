"""Mixing sources to target weights by hash-threshold histograms.

Each source has a budget of words. Documents have a fixed place on a line by a hash of their key; a source takes the
documents below a threshold. The threshold comes from histograms: words by source and by the first 12 bits of the
hash; the bucket in which the budget runs out is refined by the next 12 bits, and once more. No documents are sorted,
each level moves one row for each source, bucket and map task. What the budget leaves over where the next document is too
large is filled up the same way, with the documents from there on that are small enough. A target above a source's own size repeats the whole source and takes the rest by threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citegrid.llm.common import Shield, checkpoint, n_words

STEP, LEVELS = 12, 3
#: Rows of the table of sources up to which it is broadcast; beyond, it is joined by a shuffle.
SMALL = 20_000


def place(key: str) -> Column:
    """The document's place: the first 36 bits of the MD5 of its key as text (null: of the empty text)."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit(""))), 1, STEP * LEVELS // 4), 16, 10).cast("long")


def source_targets(totals: DataFrame, cycle: int = 3, most: float = 3.0) -> DataFrame:
    """(source, source_size) -> the same with ``target``: one row for each source.

    Sources by code point, null last, weigh 1 .. cycle, repeating. They share the total by weight; a target stops at
    ``most`` times its source's size and the excess is shared again by weight. With sources in order of
    most * size / weight those that stop are a prefix, so the water level is found with one window.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = totals.withColumn("_w", (F.row_number().over(by_name) - 1) % cycle + 1).withColumn("_cap", F.col("source_size") * most)
    w = w.withColumn("_ratio", F.col("_cap") / F.col("_w"))
    before = Window.orderBy("_ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    w = w.withColumn("_level", (F.sum("source_size").over(every) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / (F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0))))
    w = w.withColumn("_water", F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "_level"))).over(every)["_level"])
    return w.select("source", "source_size", F.least(F.col("_cap"), F.coalesce(F.col("_water") * F.col("_w"), F.col("_cap"))).alias("target"))


def _boundary(slim: DataFrame, state: DataFrame, nearest: bool) -> DataFrame:
    """state (source, _budget and more) with ``_below`` and ``_acc``: the documents of slim (source, size, _place) whose
    place is below it have ``_acc`` words, and with the next bucket they would exceed the budget. If ``nearest``, that
    bucket is below it too where this brings the words nearer to the budget."""
    state = state.withColumns({"_prefix": F.lit(0).cast("long"), "_acc": F.lit(0).cast("long")})
    kept = state.columns
    for level in range(LEVELS):
        rest = STEP * (LEVELS - level - 1)
        bucket = F.shiftright(F.col("_place"), rest)
        inside = slim
        if level:
            own = state.select(F.col("source").alias("_s"), F.col("_prefix").alias("_p"))
            inside = slim.join(own, F.col("source").eqNullSafe(F.col("_s")) & (F.shiftright(F.col("_place"), rest + STEP) == F.col("_p")), "left_semi")
        sums = inside.groupBy("source", bucket.alias("_bucket")).agg(F.sum("size").alias("_words"))
        upto = F.sum("_words").over(Window.partitionBy("source").orderBy("_bucket"))
        sums = sums.select(F.col("source").alias("_s"), "_bucket", "_words", upto.alias("_upto"))
        joined = state.join(sums, F.col("source").eqNullSafe(F.col("_s")), "left").withColumn("_upto", F.col("_upto") + F.col("_acc"))
        first = F.min(F.when(F.col("_upto") > F.col("_budget"), F.struct("_bucket", "_upto", "_words")))
        all_words = F.coalesce(F.max("_upto"), F.first("_acc"))  # of the prefix, if the budget does not run out in it
        state = joined.groupBy(*kept).agg(first.alias("_first"), all_words.alias("_all"))
        past_all = F.shiftleft(F.col("_prefix") + 1, STEP)
        state = state.withColumn("_acc", F.coalesce(F.col("_first._upto") - F.col("_first._words"), F.col("_all")))
        takes = (F.col("_acc") + F.col("_first._upto") <= 2 * F.col("_budget")) if nearest and level == LEVELS - 1 else F.lit(False)
        state = state.withColumn("_prefix", F.coalesce(F.col("_first._bucket") + takes.cast("long"), past_all)).drop("_first", "_all")
        state = checkpoint(state)  # a row for each source, used twice at the next level
    return state.withColumnRenamed("_prefix", "_below")


def thresholds(slim: DataFrame, targets: DataFrame) -> DataFrame:
    """targets with ``_full`` (whole repeats), ``_below`` (documents whose place is below it are taken once more), and
    ``_room`` and ``_last``: of the others those of at most _room words whose place is below _last.

    ``slim`` has source, size and _place. The first threshold stays within the budget; where a large document stands at it,
    the rest of the budget goes to smaller ones behind it, so the mix comes within half of such a document's size.
    """
    state = targets.withColumn("_full", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    state = _boundary(slim, state.withColumn("_budget", F.col("target") - F.col("_full") * F.col("source_size")), nearest=False)
    state = state.withColumn("_room", F.col("_budget") - F.col("_acc")).drop("_budget", "_acc")
    own = state.select(F.col("source").alias("_s"), F.col("_below").alias("_b"), F.col("_room").alias("_r"))
    behind = slim.join(own, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_place") >= F.col("_b")) & (F.col("size") <= F.col("_r")), "left_semi")
    again = _boundary(behind, state.select("source", F.col("_room").alias("_budget")), nearest=True)
    again = again.select(F.col("source").alias("_s"), F.col("_below").alias("_last"))
    return checkpoint(state.join(again, F.col("source").eqNullSafe(F.col("_s"))).drop("_s"))


def _planned(docs: DataFrame, key: str, source: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(key, source, size, _place) of each document, and per source its target and thresholds."""
    slim = docs.select(F.col(key), F.col(source).alias("source"), n_words(text).alias("size"), place(key).alias("_place"))
    slim = checkpoint(slim)  # the texts are read once; what follows passes over a few bytes for each document
    totals = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    limits = thresholds(slim, checkpoint(source_targets(totals))).withColumnRenamed("source", "_s")
    return slim, F.broadcast(limits) if limits.limit(SMALL + 1).count() <= SMALL else limits




def _copies() -> Column:
    """How many copies of a document the mix holds."""
    behind = (F.col("_place") >= F.col("_below")) & (F.col("_size") <= F.col("_room")) & (F.col("_place") < F.col("_last"))
    return F.col("_full") + ((F.col("_place") < F.col("_below")) | behind).cast("long")


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """Per document: key, size (words), source_size, target (of its source) and taken (words the mix takes).

    ``taken`` is size times the number of copies the mix holds, 0 to 3; a document without words takes 0. Null sources
    are one source, an empty table gives no rows, and documents with equal keys and sizes are taken or left together. Texts of any
    length are counted whole, one at a time. Other columns of docs are not read.
    """
    slim, limits = _planned(docs, key, source, text)
    return slim.join(limits, F.col("source").eqNullSafe(F.col("_s"))).withColumn("_size", F.col("size")).select(key, "size", "source_size", "target", (F.col("size") * _copies()).alias("taken"))


def apply_mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """docs with each row as often as the mix holds it (0 to 3 times); the columns of docs."""
    _, limits = _planned(docs, key, source, text)
    shield = Shield(docs)
    places = shield.df.withColumns({"_place": place(shield(key)), "_size": n_words(shield(text))}).join(limits, F.col(shield(source)).eqNullSafe(F.col("_s")))
    return shield.restored(places.withColumn("_copy", F.explode(F.array_repeat(F.lit(True), _copies().cast("int")))))


ORACLE = """
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
    ('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 9))::BIGINT AS place FROM documents),
t AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS w, source_size * 3.0::DOUBLE AS cap FROM t),
l AS (SELECT *, cap / w AS ratio, ((SELECT sum(source_size) FROM t)::DOUBLE
      - coalesce(sum(cap) OVER (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
      / ((SELECT sum(w) FROM w) - coalesce(sum(w) OVER (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS level FROM w),
s AS (SELECT source, source_size, least(cap, coalesce((SELECT level FROM l WHERE level <= ratio ORDER BY ratio, level LIMIT 1) * w, cap)) AS target FROM l),
b AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM s),
p AS (SELECT source, place, sum(size) AS words FROM d GROUP BY source, place),
c AS (SELECT source, place, words, sum(words) OVER (PARTITION BY source ORDER BY place) AS upto FROM p),
e AS (SELECT *, target - whole * source_size AS budget FROM b),
g AS (SELECT e.source, e.source_size, e.target, e.whole, min(CASE WHEN c.upto > e.budget THEN c.place END) AS below,
  any_value(e.budget) - coalesce(max(CASE WHEN c.upto <= e.budget THEN c.upto END), 0) AS room
  FROM e JOIN c ON c.source IS NOT DISTINCT FROM e.source GROUP BY e.source, e.source_size, e.target, e.whole),
p2 AS (SELECT d.source, d.place, sum(d.size) AS words FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source AND d.place >= g.below AND d.size <= g.room GROUP BY d.source, d.place),
c2 AS (SELECT source, place, words, sum(words) OVER (PARTITION BY source ORDER BY place) AS upto FROM p2)
SELECT d.doc_id, d.size, g.source_size, g.target,
  (d.size * (g.whole + CASE WHEN g.below IS NULL OR d.place < g.below OR (d.size <= g.room AND 2 * c2.upto - c2.words <= 2 * g.room) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source LEFT JOIN c2 ON c2.source IS NOT DISTINCT FROM d.source AND c2.place = d.place
"""
