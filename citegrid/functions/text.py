"""Text normalisation and similarity as column expressions: no UDF, all of it stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def words(c: Column) -> Column:
    """Normalised words of a TeX text, in order.

    Braces vanish without a break, commands and escapes become breaks, letters and digits are kept in lower case, all
    else is a break. Lower-casing comes last, since it can make marks that are no letters.
    """
    c = F.regexp_replace(c, r"(?s)\\(\p{IsAlphabetic}+|.)?", " ")
    c = F.regexp_replace(c, r"[{}]", "")
    c = F.regexp_replace(c, r"[^\p{IsAlphabetic}\p{N}]+", " ")
    c = F.trim(F.lower(F.translate(c, "Σ", "σ")))
    return F.array_remove(F.split(c, " "), "")  # of a blank text one empty word; a condition would normalise it twice


def tokens(c: Column) -> Column:
    """The set of normalised words, sorted."""
    return F.array_sort(F.array_distinct(words(c)))


def author_surnames(c: Column) -> Column:
    """The set of surnames of an author list, sorted: with a comma all of the family part, without the last word."""
    one = lambda a: F.when(F.instr(a, ",") > 0, F.array_join(words(F.substring_index(a, ",", 1)), " ")).otherwise(F.coalesce(F.try_element_at(words(a), F.lit(-1)), F.lit("")))
    names = F.transform(F.split(c, " and "), one)
    return F.array_sort(F.array_distinct(F.filter(names, lambda x: x != "")))


def token_dice(a: Column, b: Column) -> Column:
    """Dice coefficient of two sets; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.lit(2.0) * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b)))


def rounded(c: Column) -> Column:
    """Four decimals, halves away from zero."""
    return F.round(c * 10000) / 10000


def combined(title: Column, author: Column) -> Column:
    """The score of two records: 0.7 title + 0.3 author, not rounded."""
    return F.lit(0.7) * title + F.lit(0.3) * author


def author_dice(surnames_a: Column, surnames_b: Column, tokens_a: Column, tokens_b: Column) -> Column:
    return F.lit(0.75) * token_dice(surnames_a, surnames_b) + F.lit(0.25) * token_dice(tokens_a, tokens_b)


def author_similarity(a: Column, b: Column) -> Column:
    return author_dice(author_surnames(a), author_surnames(b), tokens(a), tokens(b))


def similarity(title_a: Column, author_a: Column, title_b: Column, author_b: Column) -> Column:
    """STRUCT<score, title_score, author_score>, rounded; null if any of the four is null."""
    return similarity_of_sets(compared_sets(title_a, author_a), compared_sets(title_b, author_b))


def compared_sets(title: Column, author: Column) -> dict[str, Column]:
    """What similarity() compares of a record. As columns of their own they are computed once, however often it is compared."""
    return {"title": tokens(title), "surnames": author_surnames(author), "author": tokens(author)}


def similarity_of_sets(x: dict[str, Column] | Column, y: dict[str, Column] | Column) -> Column:
    """similarity() of two records by their compared_sets()."""
    t, a = token_dice(x["title"], y["title"]), author_dice(x["surnames"], y["surnames"], x["author"], y["author"])
    known = x["title"].isNotNull() & x["author"].isNotNull() & y["title"].isNotNull() & y["author"].isNotNull()
    return F.when(known, F.struct(rounded(combined(t, a)).alias("score"), rounded(t).alias("title_score"), rounded(a).alias("author_score")))


def title_query(title: Column) -> Column:
    """A title as a search query: no braces and backslashes, ties as spaces, single spaces."""
    return F.trim(F.regexp_replace(F.translate(title, "~{}\\", " "), r"\s+", " "))


def citation_query(fields: Column) -> Column:
    """author. title. journal or booktitle. year; absent parts are left out."""
    return F.concat_ws(". ", fields["author"], fields["title"], F.coalesce(fields["journal"], fields["booktitle"]), fields["year"])


def contributors(c: Column) -> Column:
    """ARRAY<STRUCT<family, given, orcid>> of an author list; an absent or empty list has none."""
    names = F.filter(F.transform(F.split(c, " and "), lambda x: F.trim(x)), lambda x: x != "")

    def one(x: Column) -> Column:
        comma = F.instr(x, ",") > 0
        given = F.when(comma, F.trim(F.regexp_replace(x, r"(?s)^[^,]*,", "")))
        return F.struct(
            F.trim(F.when(comma, F.substring_index(x, ",", 1)).otherwise(x)).alias("family"),
            F.when(given != "", given).alias("given"),
            F.lit(None).cast("string").alias("orcid"),
        )

    return F.coalesce(F.transform(names, one), F.array().cast("array<struct<family:string,given:string,orcid:string>>"))


def contributors_text(c: Column) -> Column:
    """Contributors as an author list: ``Family, Given``, or whichever of the two there is."""
    one = lambda x: F.when(x["given"].isNull() | (x["given"] == ""), x["family"]).when(x["family"] == "", x["given"]).otherwise(F.concat(x["family"], F.lit(", "), x["given"]))
    return F.array_join(F.transform(c, one), " and ")


def text_or_null(c: Column) -> Column:
    """Trimmed, null if blank."""
    return F.nullif(F.trim(c), F.lit(""))


def extract_year(c: Column) -> Column:
    """The first run of exactly four digits that begins with 19 or 20."""
    return F.try_element_at(F.filter(F.split(c, "[^0-9]"), lambda x: F.rlike(x, F.lit("^(19|20)[0-9]{2}$"))), F.lit(1)).cast("int")


def shell_quote(c: Column) -> Column:
    """The text as one shell word."""
    quoted = F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("'\\''")), F.lit("'"))
    return F.when(F.rlike(c, F.lit(r"^[A-Za-z0-9_./:\-]+$")), c).otherwise(quoted)


def is_sha256(c: Column) -> Column:
    return F.rlike(c, F.lit("^[0-9A-Fa-f]{64}$"))


def clamp_limit(c: Column) -> Column:
    """A number of candidates: 1 to 20."""
    return F.least(F.greatest(c, F.lit(1)), F.lit(20))
