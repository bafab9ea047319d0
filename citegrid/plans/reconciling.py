"""Queries on scans, edits, provider payloads and reconciliation."""

from __future__ import annotations

from pyspark.sql import functions as F

from citegrid.functions import canonical as cn
from citegrid.functions import identifiers as ids
from citegrid.functions import projections as pj
from citegrid.functions import webscan
from citegrid.operators import reconcile
from citegrid.plans.identity import _json
from citegrid.plans.views import BIBLIO, biblio, table
from citegrid.sources import bibtex, files, providers
from citegrid.storage import shared_path


def bibtex_scan(spark, sf_dir):
    """Parts as BibTeX text with a macro, quotes, nested braces and a month, parsed again."""
    p = table(spark, sf_dir, "part")
    n = F.col("p_partkey")
    text = F.concat(F.lit("@Book{p"), n, F.lit(",\n title = {{A} "), "p_name", F.lit("},\n PUBLISHER = pub # \" "), "p_brand", F.lit("\",\n month = Mar, year = "), (1990 + n % 30).cast("string"), F.lit(",\n}\n"))
    file = F.concat(F.lit("f"), n % 7)
    macro = spark.range(7).select(F.concat(F.lit("f"), "id").alias("file"), F.struct(F.lit(0).cast("long").alias("block"), F.lit(-1).cast("long").alias("row")).alias("at"), F.concat(F.lit("@string{pub = {House "), "id", F.lit("}}\n")).alias("text"))
    pieces = p.select(file.alias("file"), F.struct(F.lit(0).cast("long").alias("block"), n.alias("row")).alias("at"), text.alias("text")).unionByName(macro)
    r = bibtex.parse(pieces)
    return r.select("entry_key", "entry_type", cn.json_map(r.fields).alias("fields"))


def bibtex_files(spark, sf_dir):
    """Parts written as BibTeX files and read again: indented entries, two on a line, in parentheses, after free text, notes
    with lines that begin with "@", and a macro made of another, which is defined anew at the end of each file."""
    p = table(spark, sf_dir, "part")
    n = F.col("p_partkey")
    note = F.when(n % 5 == 1, F.concat(F.lit(", note = {see\n@book{x, title = {"), "p_type", F.lit("}}\n@ home}"))).otherwise("")
    body = lambda key: F.concat(F.lit(key), n, F.lit(",\n title = {{A} "), "p_name", F.lit("}, PUBLISHER = pub # \" "), "p_brand", F.lit("\", month = Mar"), note)
    braced = lambda key: F.concat(F.lit("@Book{"), body(key), F.lit(",\n}"))
    text = F.when(n % 4 == 0, F.concat(F.lit("\t "), braced("p"))).when(n % 4 == 1, F.concat(braced("p"), F.lit(" "), braced("q"))).when(n % 4 == 2, F.concat(F.lit("@book("), body("p"), F.lit(")"))).otherwise(F.concat(F.lit("free (text), % with {signs}\n"), braced("p")))
    files = 7 * (1 + p.count() // 20_000)
    of = lambda k: F.concat(F.lit("House "), k)
    rows = p.select((n % files).alias("file"), n.alias("at"), text.alias("value"))
    for at, name, value in ((-2, "base", of(F.col("id").cast("string"))), (-1, "PUB", None), (1 << 40, "pub", F.lit("Another house"))):
        definition = F.concat(F.lit("@string{pub = BASE # {,}}")) if value is None else F.concat(F.lit("@string{" + name + " = {"), value, F.lit("}}"))
        rows = rows.unionByName(spark.range(files).select(F.col("id").alias("file"), F.lit(at).alias("at"), definition.alias("value")))
    path = shared_path(spark, "bibtex")
    rows.repartition("file").sortWithinPartitions("file", "at").select("file", "value").write.partitionBy("file").text(path)
    r = bibtex.checked(bibtex.read(spark, path))
    house = F.regexp_replace(r.fields["publisher"], r"^House \d+,", "House,")
    return r.select("entry_key", "entry_type", cn.json_map(pj.overlay(r.fields, F.create_map(F.lit("publisher"), house))).alias("fields"))


def bibtex_marks(spark, sf_dir):
    """Files of two entries whose markers are set and taken out, or an entry of which is replaced."""
    p = table(spark, sf_dir, "part")
    n = F.col("p_partkey")
    text = F.concat(F.lit("% head\n@book{a"), n, F.lit(",\n  title = {"), "p_name", F.lit("},\n  integrity = {old}\n}\n\n@book{b"), n, F.lit(",\n  year = 1999\n}\n% tail\n"))
    marks = F.create_map(F.concat(F.lit("a"), n), F.lit(None).cast("string"), F.concat(F.lit("b"), n), F.lit("new"))
    entry = F.concat(F.lit("@misc{b"), n, F.lit(", year = 2000}"))
    return p.select("p_partkey", F.when(n % 2 == 0, bibtex.marked(text, marks)).otherwise(bibtex.replaced(text, F.concat(F.lit("b"), n), entry)).alias("file"))


def bibtex_render(spark, sf_dir):
    b = biblio(spark, sf_dir)
    return b.select("seq", F.sha2(bibtex.render(b.entry_type, b.entry_key, b.fields), 256).alias("sha256"))


def entry_edits(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    n = F.col("p_partkey").cast("string")
    text = F.concat(F.lit("@book{p"), n, F.lit(",\n  title = {"), "p_name", F.lit("},\n  year = 1999\n}"))
    updates = F.when(F.col("p_partkey") % 3 == 0, F.create_map(F.lit("title"), F.lit("New"))).when(F.col("p_partkey") % 3 == 1, F.create_map(F.lit("title"), F.lit(None).cast("string"))).otherwise(F.create_map(F.lit("doi"), F.lit("10.1/x")))
    return p.select("p_partkey", bibtex.edited(text, updates).alias("entry"))


def crossref_records(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    n = F.col("p_partkey")
    work = F.struct(
        F.concat(F.lit("https://doi.org/10.5/"), n).alias("DOI"), F.lit("journal-article").alias("type"), F.array(F.concat(F.lit("<i>"), "p_name", F.lit("</i>"))).alias("title"),
        F.array(F.struct(F.col("p_brand").alias("family"), F.when(n % 2 == 0, "A").alias("given"))).alias("author"), F.array(F.col("p_type")).alias("container-title"),
        F.when(n % 3 == 0, F.struct(F.array(F.array((2000 + n % 20).cast("int"), F.lit(5))).alias("date-parts"))).alias("issued"),
    )
    r = providers.crossref_lookup(p.select("p_partkey", F.to_json(F.struct(work.alias("message"))).alias("body")))
    f = pj.fields_of_literature(F.col("record"))
    return r.select("p_partkey", "record.id", "record.title", F.col("record.issued.year").cast("long").alias("year"), cn.json_map(f).alias("fields"))


def note_records(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", pj.literature_of_note(F.concat(F.lit("n"), "p_partkey"), F.col("p_name"), F.array("p_brand", "p_type"), F.concat(F.lit("Conf "), 1990 + F.col("p_size"))).alias("r"))
    return p.select("p_partkey", F.col("r.issued.year").cast("long").alias("year"), cn.json_map(pj.fields_of_literature(F.col("r"))).alias("fields"))


def page_metadata(spark, sf_dir):
    """Pages with DOI metadata put in: the signals and DOIs found."""
    p = table(spark, sf_dir, "pages")
    n = F.col("page_id")
    meta = F.concat(F.lit('<meta name="Citation_DOI" content="doi:10.1000/P'), n, F.lit('."><script type="application/ld+json">{"@graph":[{"identifier":"https://doi.org/10.1000/j'), n % 3, F.lit('"}]}</script>'))
    found = p.select("page_id", F.explode(webscan.page_dois(F.regexp_replace("html", F.lit("</head>"), F.concat(meta, F.lit("</head>"))))).alias("m"))
    return found.select("page_id", "m.signal", F.explode(ids.find_dois(F.col("m.text"))).alias("doi"))


def reconciled(spark, sf_dir):
    b = biblio(spark, sf_dir)
    new = F.create_map(F.lit("title"), F.concat(F.lit("New "), F.coalesce("title", F.lit(""))), F.lit("year"), F.lit("2020"))
    rows = b.select("seq", "entry_key", F.map_concat("fields", F.create_map(F.lit("bibapprovalid"), F.lit("x"))).alias("fields"), pj.literature_of_fields(F.lit("crossref"), F.concat(F.lit("10.1/"), "seq"), F.lit("book"), new).alias("record"), F.lit("u").alias("url"), F.lit("application/json").alias("media_type"), F.lit("{}").alias("response"))
    none = F.lit(None).cast("struct<entry_type:string,entry_key:string,fields:map<string,string>>")
    doi = F.when(F.col("seq") % 5 == 0, "10.9/other").otherwise(F.concat(F.lit("10.1/"), "seq"))
    receipt = F.struct(F.lit("bibsource").alias("entry_type"), F.lit("r").alias("entry_key"), F.create_map(F.lit("identifierkind"), F.lit("doi"), F.lit("identifier"), doi).alias("fields"))
    out = reconcile.reconcile(rows.withColumns({"resolution": receipt, "selection": none, "seal": F.lit(True)}))
    shown = cn.json_map(F.map_filter("fields", lambda k, v: ~k.isin("bibsource")))
    return out.select("seq", F.col("error").isNotNull().alias("failed"), shown.alias("fields"))


def sealed_records(spark, sf_dir):
    records, nodes = reconcile.seal(biblio(spark, sf_dir).select("seq", "entry_type", "entry_key", cn.without(F.col("fields"), ("bibsource",)).alias("fields")), "human", " me ")
    return records.join(nodes.withColumnRenamed("fields", "node"), records.fields["bibsource"] == nodes.entry_key).select("seq", records.fields["integrity"].alias("marker"), F.col("node")["actor"].alias("actor"), F.size(reconcile.unseal(records.fields)).cast("long").alias("unsealed"))


def stripped_responses(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    f = F.map_filter(F.create_map(F.lit("kind"), F.lit("web"), F.lit("response"), F.when(F.col("doc_id") % 2 == 0, F.col("text")), F.lit("responseencoding"), F.when(F.col("doc_id") % 4 == 0, "gzip")), lambda k, v: v.isNotNull())
    return reconcile.strip_responses(d.select(F.concat(F.lit("d"), "doc_id").alias("entry_key"), f.alias("fields"))).select("entry_key", "removed")


def verify_statuses(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id")
    i = F.col("doc_id")
    s = reconcile.verify_status(i % 11 == 0, F.when(i % 2 == 0, "10.1/x"), i % 5 != 0, i % 3 != 0, i % 7 != 0, F.when(i % 3 != 0, i % 5 != 0), i % 4, i % 8 != 0, i % 13 == 0)
    return d.select("doc_id", s.alias("status"))


def reviewed_report(spark, sf_dir):
    """A reviewed dry run of four in five records; since then one in three records, or what its provider returns, changed."""
    b = biblio(spark, sf_dir)
    live = b.select("entry_key", cn.content_hash(b.entry_type, b.fields).alias("baseline_hash"), F.sha2("title", 256).alias("proposal_hash"))
    i = F.substring("entry_key", 2, 20).cast("long")
    report = live.filter(i % 5 != 0).select("entry_key", F.when(i % 3 == 0, "before").otherwise(F.col("baseline_hash")).alias("baseline_hash"), F.when(i % 6 == 1, "before").otherwise(F.coalesce("proposal_hash", F.lit(""))).alias("proposal_hash"))
    return reconcile.reviewed(report, live.withColumn("proposal_hash", F.coalesce("proposal_hash", F.lit(""))))


def markup_cleaned(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    n = F.col("p_partkey")
    around = lambda a, b: F.concat(F.lit(a), F.col("p_name"), F.lit(b))
    c = F.when(n % 6 == 0, around(" <b>A <i x='1'>", "</i></b><br/>&amp; &#233;")).when(n % 6 == 1, around("<b><i>", "</b></i>")).when(n % 6 == 2, around("<![CDATA[x < y & ", "]]><sub>2</sub>")).when(n % 6 == 3, around("a <b>", "")).when(n % 6 == 4, around("<a><a>", "</a><!-- <b> --></a>")).otherwise(around("AT&T ", ""))
    return p.select("p_partkey", pj.clean_markup(c).alias("text"))


def bibliography_files(spark, sf_dir):
    """A folder of files, some broken, some empty: entries and errors of each. Tasks write the parts; the driver names them,
    as many as the rows need, and makes the empty ones."""
    p = table(spark, sf_dir, "part")
    n, path = F.col("p_partkey"), shared_path(spark, "folder")
    many = 5 * (1 + p.count() // 20_000)
    entry = F.concat(F.lit("@misc{p"), n, F.lit(", title = {"), "p_name", F.when(n % many % 5 == 2, "").otherwise("}}"))
    p.filter(n % many % 5 != 4).select((n % many).alias("f"), entry.alias("t")).repartition("f").write.partitionBy("f").text(f"{path}/parts")
    system, folder = files.spark_file(spark, path)
    for f in range(many):
        to = files.spark_file(spark, f"{path}/f{f}.BIB")[1]
        if f % 5 == 4:
            system.create(to, True).close()
            continue
        for s in system.listStatus(files.spark_file(spark, f"{path}/parts/f={f}")[1]):
            system.rename(s.getPath(), to)
    return files.scanned(spark, path).select(F.regexp_extract("file", r"(f\d+)\.BIB$", 1).alias("file"), "entries", F.col("error").isNotNull().alias("broken"))


def review_rows(spark, sf_dir):
    b = biblio(spark, sf_dir).withColumn("status", F.lit("stale"))
    return reconcile.review_rows(b).select("entry_key", "title", "authors", "year", "url", "content_hash")


def stored_sources(spark, sf_dir):
    b = biblio(spark, sf_dir)
    i = b.seq
    f = F.map_filter(F.create_map(F.lit("bibprovider"), F.when(i % 2 == 0, "doi"), F.lit("bibproviderid"), F.when(i % 4 == 0, b.entry_key)), lambda k, v: v.isNotNull())
    s = b.select("seq", reconcile.source_identity(f).alias("a"), reconcile.source_identity(f, F.when(i % 3 == 0, "crossref").otherwise("doi")).alias("b"))
    return s.select("seq", "a.provider", "a.id", F.col("b.provider").alias("asked"), F.col("b.id").alias("asked_id"))


QUERIES = {f.__name__: f for f in (bibtex_scan, bibtex_files, bibtex_marks, bibtex_render, entry_edits, crossref_records, note_records, page_metadata, reconciled, sealed_records, stripped_responses, verify_statuses, reviewed_report, markup_cleaned, bibliography_files, review_rows, stored_sources)}

_ENTRY = "' || chr(10) || '"
_CLEAN = _json("author", "doi", "note", "title", "year", head="entry_type")
_BOOK = "'book' AS entry_type, '{\"month\":\"3\",\"publisher\":' || to_json('House ' || (p_partkey % 7) || ' ' || p_brand) || ',\"title\":' || to_json('{A} ' || p_name) || '}' AS fields FROM part"
_FILED = "'book' AS entry_type, '{\"month\":\"3\"' || CASE WHEN p_partkey % 5 = 1 THEN ',\"note\":' || to_json('see' || chr(10) || '@book{x, title = {' || p_type || '}}' || chr(10) || '@ home') ELSE '' END || ',\"publisher\":' || to_json('House, ' || p_brand) || ',\"title\":' || to_json('{A} ' || p_name) || '}' AS fields FROM part"
ORACLES = {
    "bibtex_files": f"SELECT 'p' || p_partkey AS entry_key, {_FILED} UNION ALL SELECT 'q' || p_partkey, {_FILED} WHERE p_partkey % 4 = 1",
    "bibtex_marks": """SELECT p_partkey, '% head' || chr(10) || '@book{a' || p_partkey || ',' || chr(10) || '  title = {' || p_name || '}' || CASE WHEN p_partkey % 2 = 0 THEN ',' ELSE ',' || chr(10) || '  integrity = {old}' END || chr(10) || '}' || chr(10) || chr(10)
      || CASE WHEN p_partkey % 2 = 0 THEN '@book{b' || p_partkey || ',' || chr(10) || '  year = 1999,' || chr(10) || '  integrity = {new},' || chr(10) || '}' ELSE '@misc{b' || p_partkey || ', year = 2000}' END || chr(10) || '% tail' || chr(10) AS file FROM part""",
    "bibtex_scan": "SELECT 'p' || p_partkey AS entry_key, 'book' AS entry_type, '{\"month\":\"3\",\"publisher\":' || to_json('House ' || (p_partkey % 7) || ' ' || p_brand) || ',\"title\":' || to_json('{A} ' || p_name) || ',\"year\":\"' || (1990 + p_partkey % 30) || '\"}' AS fields FROM part",
    "bibtex_render": f"""WITH {BIBLIO} SELECT seq, sha256('@' || entry_type || '{{' || entry_key || ',' || chr(10) || '  author = {{' || author || '}},' || chr(10) || CASE WHEN bibsource IS NULL THEN '' ELSE '  bibsource = {{' || bibsource || '}},' || chr(10) END
      || CASE WHEN doi IS NULL THEN '' ELSE '  doi = {{' || doi || '}},' || chr(10) END || CASE WHEN note IS NULL THEN '' ELSE '  note = {{' || note || '}},' || chr(10) END || '  title = {{' || title || '}},' || chr(10) || '  year = {{' || year || '}},' || chr(10) || '}}' || chr(10)) AS sha256 FROM biblio""",
    "entry_edits": f"""SELECT p_partkey, '@book{{p' || p_partkey || ',' || CASE p_partkey % 3 WHEN 0 THEN '{_ENTRY}  title = {{New}},{_ENTRY}  year = 1999{_ENTRY}}}' WHEN 1 THEN '{_ENTRY}  year = 1999{_ENTRY}}}'
      ELSE '{_ENTRY}  title = {{' || p_name || '}},{_ENTRY}  year = 1999,{_ENTRY}  doi = {{10.1/x}},{_ENTRY}}}' END AS entry FROM part""",
    "crossref_records": f"""WITH n AS (SELECT p_partkey, '10.5/' || p_partkey AS bibproviderid, 'crossref' AS bibprovider, '10.5/' || p_partkey AS doi, trim(p_name) AS title, CASE WHEN p_partkey % 2 = 0 THEN p_brand || ', A' ELSE p_brand END AS author, p_type AS journal,
        CASE WHEN p_partkey % 3 = 0 THEN CAST(2000 + p_partkey % 20 AS VARCHAR) END AS year, CASE WHEN p_partkey % 3 = 0 THEN '5' END AS month FROM part)
      SELECT p_partkey, doi AS id, title, year::BIGINT AS year, {_json('author', 'bibprovider', 'bibproviderid', 'doi', 'journal', 'month', 'title', 'year')} AS fields FROM n""",
    "note_records": f"""WITH n AS (SELECT p_partkey, p_brand || ' and ' || p_type AS author, 'openreview' AS bibprovider, 'n' || p_partkey AS bibproviderid, p_name AS title, 'https://openreview.net/forum?id=n' || p_partkey AS url, CAST(1990 + p_size AS VARCHAR) AS year FROM part)
      SELECT p_partkey, year::BIGINT AS year, {_json('author', 'bibprovider', 'bibproviderid', 'title', 'url', 'year')} AS fields FROM n""",
    "page_metadata": "SELECT page_id, 'html-meta:citation_doi' AS signal, '10.1000/p' || page_id AS doi FROM pages UNION ALL SELECT page_id, 'json-ld:identifier', '10.1000/j' || (page_id % 3) FROM pages",
    "reconciled": f"""WITH {BIBLIO}, n AS (SELECT seq, 'book' AS entry_type, 'crossref' AS bibprovider, '10.1/' || seq AS bibproviderid, note, 'New ' || coalesce(title, '') AS title, '2020' AS year FROM biblio),
      o AS (SELECT seq, author, 'x' AS bibapprovalid, doi, note, title, year FROM biblio),
      s AS (SELECT *, sha256({_json('note', 'title', 'year', head='entry_type')}) AS integrity FROM n)
      SELECT seq, false AS failed, {_json('bibprovider', 'bibproviderid', 'integrity', 'note', 'title', 'year')} AS fields FROM s WHERE seq % 5 <> 0 UNION ALL SELECT seq, true, {_json('author', 'bibapprovalid', 'doi', 'note', 'title', 'year')} FROM o WHERE seq % 5 = 0""",
    "sealed_records": f"WITH {BIBLIO} SELECT seq, sha256({_CLEAN}) AS marker, 'me' AS actor, (4 + CASE WHEN doi IS NULL THEN 0 ELSE 1 END + CASE WHEN note IS NULL THEN 0 ELSE 1 END)::BIGINT AS unsealed FROM biblio",
    "stripped_responses": "SELECT 'd' || doc_id AS entry_key, (CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN doc_id % 4 = 0 THEN 1 ELSE 0 END)::BIGINT AS removed FROM documents",
    "verify_statuses": """SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'already-verified' WHEN doc_id % 2 = 1 AND doc_id % 13 = 0 THEN 'resolution-error' WHEN doc_id % 2 = 0 THEN CASE WHEN doc_id % 5 = 0 THEN 'unsupported-identifier' WHEN doc_id % 3 = 0 THEN 'lookup-error' WHEN doc_id % 7 = 0 THEN 'needs-review' WHEN doc_id % 8 = 0 THEN 'ready' ELSE 'verified' END
      WHEN doc_id % 3 = 0 THEN 'unsupported' WHEN doc_id % 5 = 0 THEN 'search-error' WHEN doc_id % 4 > 0 THEN 'needs-selection' ELSE 'unsupported' END AS status FROM documents""",
    "reviewed_report": """SELECT 'd' || doc_id AS entry_key, CASE WHEN doc_id % 5 = 0 THEN 'the reviewed report has no replacement' WHEN doc_id % 3 = 0 OR doc_id % 6 = 1 THEN 'the entry or what the provider returns has changed; review again' END AS error FROM documents""",
    "markup_cleaned": """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN trim('A ' || p_name || ' ') WHEN 1 THEN '<b><i>' || p_name || '</b></i>' WHEN 2 THEN 'x < y & ' || p_name || '2' WHEN 3 THEN 'a <b>' || p_name WHEN 4 THEN trim(p_name) ELSE 'AT&T ' || p_name END AS text FROM part""",
    "bibliography_files": "WITH m AS (SELECT 5 * (1 + count(*) // 20000) AS many FROM part) SELECT 'f' || (p_partkey % many) AS file, CASE WHEN p_partkey % many % 5 IN (2, 4) THEN 0 ELSE count(*) END::BIGINT AS entries, p_partkey % many % 5 = 2 AS broken FROM part, m GROUP BY p_partkey % many",
    "review_rows": f"WITH {BIBLIO} SELECT entry_key, nullif(trim(title), '') AS title, author AS authors, year, CASE WHEN doi IS NOT NULL THEN 'https://doi.org/' || doi END AS url, sha256({_CLEAN}) AS content_hash FROM biblio",
    "stored_sources": f"""WITH {BIBLIO}, s AS (SELECT seq, seq % 4 = 0 AS stored, entry_key, CASE WHEN seq % 3 = 0 THEN 'crossref' ELSE 'doi' END AS asked FROM biblio)
      SELECT seq, CASE WHEN stored THEN 'doi' ELSE 'crossref' END AS provider, CASE WHEN stored THEN entry_key END AS id, asked, CASE WHEN stored AND asked = 'doi' THEN entry_key END AS asked_id FROM s""",
}
