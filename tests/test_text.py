from pyspark.sql import functions as F

from citegrid.functions import identifiers as ids
from citegrid.functions import projections as pj
from citegrid.functions import text as tx


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()[0]


def test_words_tex(spark):
    w = lambda s: one(spark, tx.words(F.lit(s)))
    assert w("Open-Source {LLM}s") == ["open", "source", "llms"]
    assert w("Open Source LLMs") == ["open", "source", "llms"]
    assert w(r"\emph{Gr\"u}n \& x_1") == ["gr", "u", "n", "x", "1"] or w(r"\emph{Grün}") == ["grün"]
    assert w("") == [] and w("--- {}") == []
    assert w("ΟΔΟΣ") == ["οδοσ"]


def test_surnames(spark):
    s = lambda v: one(spark, tx.author_surnames(F.lit(v)))
    assert s("van der Berg, Jean and Jean van der Berg") == ["berg", "van der berg"]
    assert s("Smith, John and Doe, Jane") == s("John Smith and Jane Doe")
    assert s("") == []


def test_similarity(spark):
    s = one(spark, tx.similarity(*map(F.lit, ("{A} Title", "Smith, John and Doe, Jane", "A Title", "John Smith and Jane Doe"))))
    assert s["title_score"] == 1.0 and s["score"] == 1.0
    assert one(spark, tx.similarity(F.lit("a"), F.lit(None).cast("string"), F.lit("a"), F.lit("b"))) is None
    assert one(spark, tx.rounded(F.lit(0.00005))) == 0.0001


def test_identifiers(spark):
    assert one(spark, ids.find_dois(F.lit("see (https://doi.org/10.1000/A(b)). 10.1000/zz;"))) == ["10.1000/a(b)", "10.1000/zz"]
    assert one(spark, ids.find_arxiv(F.lit("https://arXiv.org/pdf/2301.12345v2"))) == "2301.12345"
    assert one(spark, ids.find_arxiv(F.lit("nothing"))) is None
    f = F.create_map(F.lit("eprint"), F.lit("2301.12345"), F.lit("title"), F.lit("x"))
    r = one(spark, ids.identifier_of_fields(f))
    assert (r["kind"], r["doi"], r["field"]) == ("arxiv", "10.48550/arXiv.2301.12345", "eprint")
    assert not one(spark, ids.is_public_host(F.lit("127.0.0.1"))) and not one(spark, ids.is_public_host(F.lit("localhost"))) and one(spark, ids.is_public_host(F.lit("8.8.8.8")))
    assert one(spark, ids.normalize_url(F.lit("ftp://x/y"))) is None and one(spark, ids.normalize_url(F.lit("https://u:p@x/y"))) is None


def test_contributors(spark):
    c = tx.contributors(F.lit("Doe, Jane and  and Plato and Last,"))
    assert [(r["family"], r["given"]) for r in one(spark, c)] == [("Doe", "Jane"), ("Plato", None), ("Last", None)]
    assert one(spark, tx.contributors_text(c)) == "Doe, Jane and Plato and Last"
    assert one(spark, tx.contributors(F.lit(None).cast("string"))) == []


def test_clean_markup(spark):
    m = lambda s: one(spark, pj.clean_markup(F.lit(s)))
    assert m(" <i>Deep</i> nets ") == "Deep nets"
    assert m("a < b") == "a < b" and m("<i>open") == "<i>open"


def test_small_text(spark):
    assert one(spark, tx.shell_quote(F.lit("it's"))) == "'it'\\''s'" and one(spark, tx.shell_quote(F.lit("a/b:c"))) == "a/b:c"
    assert one(spark, tx.extract_year(F.lit("v12345 of 2021, 1999"))) == 2021
    assert one(spark, tx.title_query(F.lit("{A}~b \\c"))) == "A b c"
