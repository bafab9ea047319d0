"""Near-duplicate records: an exact set-similarity join over titles and authors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citegrid.functions import text as tx
from citegrid.functions.vocab import SYSTEM_TYPES
from citegrid.operators import setjoin

MIN_SCORE = 0.75
_EPS = 1e-9


def _prepared(records: DataFrame) -> DataFrame:
    """seq, title tokens, surnames and author tokens of the records that have a title and an author."""
    kept = records.filter(F.col("title").isNotNull() & F.col("author").isNotNull())
    if "entry_type" in records.columns:
        kept = kept.filter(~F.lower("entry_type").isin(*SYSTEM_TYPES))
    return kept.select("seq", tx.tokens(F.col("title")).alias("tt"), tx.author_surnames(F.col("author")).alias("an"), tx.tokens(F.col("author")).alias("at"))


def classes(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Classes of records that no score can tell apart, and the members of each.

    Copies meet in an aggregation only, so a title that a third of all records share costs no pairs.
    """
    p = _prepared(records).withColumn("cls", F.xxhash64("tt", "an", "at"))
    found = p.groupBy("cls").agg(F.first("tt").alias("tt"), F.first("an").alias("an"), F.first("at").alias("at"), F.min("seq").alias("rep"), F.count(F.lit(1)).alias("members"))
    return found, p.select("cls", "seq")


def _scored(pairs: DataFrame, min_score: float) -> DataFrame:
    title = tx.token_dice(F.col("l.tt"), F.col("r.tt"))
    author = tx.author_dice(F.col("l.an"), F.col("r.an"), F.col("l.at"), F.col("r.at"))
    scored = pairs.select(F.col("l.cls").alias("cls_l"), F.col("r.cls").alias("cls_r"), F.col("l.rep").alias("rep_l"), F.col("r.rep").alias("rep_r"), title.alias("t"), author.alias("a"))
    scored = scored.withColumn("s", tx.combined(F.col("t"), F.col("a"))).filter(F.col("s") >= min_score)
    return scored.select("cls_l", "cls_r", "rep_l", "rep_r", tx.rounded(F.col("s")).alias("score"), tx.rounded(F.col("t")).alias("title_score"), tx.rounded(F.col("a")).alias("author_score"))


def class_pairs(found: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """All pairs of different classes whose unrounded score is at least min_score, which is above 0.

    A score of m is 0.7 of the titles' similarity and 0.3 of the authors'. Above 0.3 titles must be (m - 0.3) / 0.7 alike,
    and classes meet on title words only. Below, one of both sides must have its share of the score: titles m / 1.4, or
    authors m / 0.6, which is a mean of their surnames' and their words' similarity, so one of these is as high. The union
    of the three joins holds every pair; then the exact score decides. (At 0 every pair of records is a result.)
    """
    side = lambda tokens: found.filter(F.size(tokens) > 0).select(F.col("cls").alias("id"), F.col(tokens).alias("tokens"))
    if min_score > 0.3 + _EPS:
        pairs = setjoin.candidates(side("tt"), None, (min_score - 0.3) / 0.7 - _EPS)
    elif min_score > 0:
        title, author = min_score / 1.4 - _EPS, min_score / 0.6 - _EPS
        pairs = setjoin.candidates(side("tt"), None, title)
        for tokens in ("an", "at"):
            pairs = pairs.unionByName(setjoin.candidates(side(tokens), None, author))
        pairs = pairs.distinct()
    else:
        raise ValueError("min_score must be above 0; at 0 the result is every pair of records")
    pairs = pairs.join(found.alias("l"), F.col("x") == F.col("l.cls")).join(found.alias("r"), F.col("y") == F.col("r.cls"))
    return _scored(pairs, min_score)


def self_pairs(found: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """Classes whose members are duplicates of each other: with words in title and author their score is 1."""
    several = found.filter("members > 1").alias("l")
    return _scored(several.join(found.alias("r"), F.col("l.cls") == F.col("r.cls")), min_score)


def dedupe_classes(records: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """Pairs of class representatives (the smallest seq) with scores; what scales: copies are not paired."""
    found, _ = classes(records)
    pairs = class_pairs(found, min_score)
    return pairs.select(F.least("rep_l", "rep_r").alias("left_seq"), F.greatest("rep_l", "rep_r").alias("right_seq"), "score", "title_score", "author_score")


def class_members(records: DataFrame) -> DataFrame:
    """seq and the representative of its class."""
    found, members = classes(records)
    return members.join(found.select("cls", "rep"), "cls").select("seq", F.col("rep").alias("class_seq"))


def dedupe(records: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """All pairs of records (seq, title, author[, entry_type]) with an unrounded score of min_score or more.

    left_seq < right_seq, score, title_score, author_score (rounded). Records without title or author and system records
    have none; blank ones score 0. The pairs of a class are expanded here, as its output asks for each; where copies are
    many, use dedupe_classes and class_members.
    """
    found, members = classes(records)
    pairs = class_pairs(found, min_score)
    between = pairs.join(members.select(F.col("cls").alias("cls_l"), F.col("seq").alias("a")), "cls_l").join(members.select(F.col("cls").alias("cls_r"), F.col("seq").alias("b")), "cls_r")
    same = self_pairs(found, min_score)
    inside = same.join(members.select(F.col("cls").alias("cls_l"), F.col("seq").alias("a")), "cls_l").join(members.select(F.col("cls").alias("cls_r"), F.col("seq").alias("b")), "cls_r").filter("a < b")
    cols = [F.least("a", "b").alias("left_seq"), F.greatest("a", "b").alias("right_seq"), "score", "title_score", "author_score"]
    return between.select(*cols).unionByName(inside.select(*cols))


def ordered(pairs: DataFrame) -> DataFrame:
    """Best score first, then by the two records."""
    return pairs.orderBy(F.desc("score"), "left_seq", "right_seq")
