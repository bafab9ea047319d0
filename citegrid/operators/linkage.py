"""Record linkage to providers: candidate search, scores, adoption rules and provider fallback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citegrid.functions import text as tx
from citegrid.operators import setjoin
from citegrid.storage import settled

MATCH_SCORE = 0.9
#: The title similarity that makes a candidate: low enough for every score that adoption asks for.
LEAST_TITLE = 0.5
#: Why an agent may not adopt a proposal. These sentences are what callers are shown.
NO_PROVIDER = "no provider support; human approval required"
RECORD_BELOW = "exact provider record is below the title/author threshold or cannot be scored"
CANDIDATE_BELOW = "selected search candidate is below the title/author threshold"
SEVERAL = "multiple title-search candidates meet the threshold; human review required"
STALE = "proposal baseline is stale"


def search(records: DataFrame, provider: DataFrame, k: int = 5, least: float = LEAST_TITLE) -> DataFrame:
    """(entry_key, title, author) x provider (id, title, author) -> the k candidates of each record that share most title
    words with it (ties by ID), of those whose titles have a similarity of at least ``least``.

    Exact: every title that similar is looked at, so all candidates are there that a score above 0.3 + 0.7 * least needs.
    (Titles below it have mostly words in common that all titles have.) Titles of equal word sets are searched once, and
    of equal provider titles the k smallest IDs can be candidates only; so copies, however many, cost neither pairs nor
    long groups.
    """
    k = min(max(k, 1), 20)
    # titles are taken apart once; what follows reads their words, as hashes, several times
    hashed = lambda df, key: df.select(key, tx.tokens(F.col("title")).alias("_t")).filter(F.size("_t") > 0).select(key, F.xxhash64("_t").alias("set"), F.transform("_t", lambda t: F.xxhash64(t)).alias("tokens"))
    asked, held = settled(hashed(records, "entry_key"), "asked"), settled(hashed(provider, "id"), "held")
    first = Window.partitionBy("set").orderBy("id")
    keys = held.select("set", "id").withColumn("_k", F.row_number().over(first)).filter(F.col("_k") <= k).groupBy("set").agg(F.array_sort(F.collect_list("id")).alias("keys"))
    sets = lambda df: df.groupBy("set").agg(F.first("tokens").alias("tokens"))
    wanted, known = settled(sets(asked).withColumnRenamed("set", "id"), "wanted"), settled(sets(held).join(keys, "set").withColumnRenamed("set", "id"), "known")
    top = setjoin.best(wanted, known, least, k)
    return asked.select("entry_key", F.col("set").alias("x")).join(top, "x").select("entry_key", F.col("key").alias("id"), F.col("shared").cast("long").alias("shared"), "rank")


def scored(candidates: DataFrame, records: DataFrame, provider: DataFrame) -> DataFrame:
    """Candidates with their similarity (score, title_score, author_score, rounded; null if it can't be told).

    Words travel as 64-bit hashes."""
    short = lambda words: F.transform(words, lambda t: F.xxhash64(t))
    parts = lambda df, key, p: df.select(key, *[short(c).alias(p + n) for n, c in (("t", tx.tokens(F.col("title"))), ("n", tx.author_surnames(F.col("author"))), ("a", tx.tokens(F.col("author"))))])
    j = candidates.join(parts(records, "entry_key", "_r"), "entry_key").join(parts(provider, "id", "_p"), "id")
    title, author = tx.token_dice(F.col("_rt"), F.col("_pt")), tx.author_dice(F.col("_rn"), F.col("_pn"), F.col("_ra"), F.col("_pa"))
    known = F.col("_rt").isNotNull() & F.col("_ra").isNotNull() & F.col("_pt").isNotNull() & F.col("_pa").isNotNull()
    j = j.withColumns({"_t": F.when(known, title), "_a": F.when(known, author)})
    return j.select(*candidates.columns, tx.rounded(tx.combined(F.col("_t"), F.col("_a"))).alias("score"), tx.rounded(F.col("_t")).alias("title_score"), tx.rounded(F.col("_a")).alias("author_score"))


def unique_adoptable(matches: DataFrame, min_score: float = MATCH_SCORE) -> DataFrame:
    """Per record the number of candidates at or above the (rounded) threshold, and the one there is if it is just one."""
    good = F.coalesce(F.col("score") >= min_score, F.lit(False))
    g = matches.groupBy("entry_key").agg(F.count_if(good).alias("n"), F.min(F.when(good, F.col("id"))).alias("_id"))
    return g.select("entry_key", "n", (F.col("n") == 1).alias("adoptable"), F.when(F.col("n") == 1, F.col("_id")).alias("id"))


def adoption_blocker(has_provider: Column, record_qualifies: Column, chosen_qualifies: Column, others_qualify: Column, stale: Column) -> Column:
    """Why a proposal cannot be adopted by an agent, the first rule that fits, or null."""
    return (
        F.when(~has_provider, NO_PROVIDER)
        .when(~F.coalesce(record_qualifies, F.lit(False)), RECORD_BELOW)
        .when(~F.coalesce(chosen_qualifies, F.lit(False)), CANDIDATE_BELOW)
        .when(F.coalesce(others_qualify, F.lit(False)), SEVERAL)
        .when(stale, STALE)
    )


def proposals(matches: DataFrame, chosen: DataFrame, min_score: float = MATCH_SCORE) -> DataFrame:
    """chosen (entry_key, id, record_score, stale; id null: no provider) -> entry_key, blocker, adoptable.

    ``record_score`` is that of the provider's whole record against the bibliography's; the scores of ``matches`` are
    those of the listed search candidates, whose titles may differ from the record's.
    """
    good = F.coalesce(F.col("m.score") >= min_score, F.lit(False))
    same = F.lower(F.col("m.id").cast("string")) == F.lower(F.col("c.id").cast("string"))
    j = chosen.alias("c").join(matches.alias("m"), F.col("c.entry_key") == F.col("m.entry_key"), "left")
    g = j.groupBy(*[F.col(f"c.{n}").alias(n) for n in ("entry_key", "id", "record_score", "stale")]).agg(F.bool_or(good & same).alias("own"), F.bool_or(good & ~same).alias("others"))
    blocker = adoption_blocker(F.col("id").isNotNull(), F.col("record_score") >= min_score, F.col("own"), F.col("others"), F.col("stale"))
    return g.select("entry_key", blocker.alias("blocker"), blocker.isNull().alias("adoptable"))


def first_success(lookups: DataFrame, key: str, rank: str, ok: str) -> DataFrame:
    """Of each key's lookups in several providers the first, by rank, that succeeded; an aggregation, not a sort."""
    others = [c for c in lookups.columns if c not in (key, rank, ok)]
    best = F.min(F.when(F.col(ok), F.struct(rank, *others))).alias("b")
    return lookups.groupBy(key).agg(best).select(key, F.col("b").isNotNull().alias("found"), F.col(f"b.{rank}").alias(rank), *[F.col(f"b.{c}").alias(c) for c in others])
