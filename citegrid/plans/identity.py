"""Queries on identifiers, URLs, canonical hashes, receipts and field projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from citegrid.functions import canonical as cn
from citegrid.functions import identifiers as ids
from citegrid.functions import projections as pj
from citegrid.operators import evidence, resolve
from citegrid.plans.views import BIBLIO, biblio, table


def _identifier_text(spark, sf_dir):
    i = F.col("doc_id")
    doi = F.concat(F.lit("https://doi.org/10."), (1000 + i % 9000).cast("string"), F.lit("/X("), i.cast("string"), F.lit(")")
    , F.when(i % 2 == 0, ").").otherwise(",;"))
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(doi, F.lit(" and doi:10.1234/ABC."), (i % 5).cast("string"), F.lit(" arXiv:2301."), F.lpad((i % 100000).cast("string"), 5, "0"), F.lit("v3")).alias("t"))


def doi_extract(spark, sf_dir):
    return _identifier_text(spark, sf_dir).select("doc_id", F.array_join(ids.find_dois(F.col("t")), " ").alias("dois"))


def doi_normalize(spark, sf_dir):
    d = _identifier_text(spark, sf_dir).withColumn("raw", F.regexp_extract("t", r"10\.[^ ]*", 0))
    return d.select("doc_id", ids.normalize_doi(F.col("raw")).alias("found"), ids.doi_of_provider(F.concat(F.lit(" https://doi.org/"), "raw", F.lit(" "))).alias("asked"))


def arxiv_extract(spark, sf_dir):
    return _identifier_text(spark, sf_dir).select("doc_id", ids.find_arxiv(F.col("t")).alias("arxiv"))


def record_identifier(spark, sf_dir):
    b = biblio(spark, sf_dir).withColumn("i", ids.identifier_of_fields(F.col("fields")))
    return b.select("seq", "i.kind", "i.value", "i.doi", "i.field")


def url_normalize(spark, sf_dir):
    u = F.concat(F.regexp_replace("url", "^http", "HTTP"), F.when(F.col("page_id") % 3 == 0, "#top").otherwise(""))
    return table(spark, sf_dir, "pages").select("page_id", ids.normalize_url(u).alias("url"))


def url_rules(spark, sf_dir):
    p = table(spark, sf_dir, "pages").withColumn("host", F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("10.0.0."), F.col("page_id") % 250)).when(F.col("page_id") % 4 == 1, "localhost").when(F.col("page_id") % 4 == 2, F.concat(F.lit("8.8.8."), F.col("page_id") % 250)).otherwise("example.com"))
    asked = F.concat(F.lit("https://api.example.org/works?rows=5&mailto=me@example.org&n="), F.col("page_id"))
    return p.select("page_id", ids.is_public_host(F.col("host")).alias("is_public"), ids.without_mailto(asked).alias("recorded"), ids.safe_url(F.when(F.col("page_id") % 2 == 0, F.lit(" ")).otherwise(F.col("url")), F.concat(F.lit("10.1/"), F.col("page_id"))).alias("safe"), ids.percent_decode(F.concat(F.lit("a%20b+c%2F"), F.col("page_id"))).alias("decoded"))


def canonical_hash(spark, sf_dir):
    b = biblio(spark, sf_dir)
    return b.select("seq", cn.canonical_json(b.entry_type, b.fields).alias("json"), cn.content_hash(b.entry_type, b.fields).alias("sha256"))


def legacy_hash(spark, sf_dir):
    b = biblio(spark, sf_dir)
    return b.select("seq", cn.legacy_hash(b.entry_type, b.fields).alias("sha256"))


def projection_hash(spark, sf_dir):
    b = biblio(spark, sf_dir)
    return b.select("seq", cn.projection_hash(b.entry_type, b.fields).alias("whole"), cn.controlled_hash(b.entry_type, b.fields).alias("controlled"))


def document_hash(spark, sf_dir):
    b = biblio(spark, sf_dir)
    b = b.withColumn("file", F.concat(F.lit("f"), F.col("seq") % (10 * (1 + b.count() // 5000))))  # files of some hundred records
    return evidence.document_hashes(b, "file", "seq")


def evidence_identity(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    fields = F.create_map(F.lit("kind"), F.lit("web"), F.lit("target"), F.concat(F.lit("d"), "doc_id"), F.lit("text"), F.col("text"), F.lit("response"), F.lit("hidden"))
    return d.select("doc_id", cn.evidence_identity(fields).alias("identity"))


def actor_identity(spark, sf_dir):
    b = biblio(spark, sf_dir)
    kind = F.when(b.seq % 2 == 0, "human").otherwise("agent")
    return b.select("seq", cn.actor_identity(kind, b.author, b.entry_key, cn.content_hash(b.entry_type, b.fields)).alias("identity"))


def provider_identity(spark, sf_dir):
    fields = F.create_map(*[x for k, v in (("provider", F.lit("crossref")), ("providerid", F.col("seq").cast("string")), ("requesturl", F.concat(F.lit("https://x/"), F.col("seq"))), ("mediatype", F.lit("application/json")), ("projection", F.lit("literature-record-v1")), ("toolversion", F.lit("1")), ("responsesha256", F.sha2("title", 256)), ("requestmethod", F.when(F.col("seq") % 2 == 0, "GET"))) for x in (F.lit(k), v)])
    return biblio(spark, sf_dir).select("seq", cn.provider_identity(fields).alias("identity"))


def approval_identity(spark, sf_dir):
    b = biblio(spark, sf_dir)
    out = cn.approval_id(F.lit("human"), F.lit("browser-review"), F.when(b.seq % 2 == 0, b.author), b.entry_key, F.sha2("title", 256), F.lit(1700000000) + b.seq, F.lit("b1"))
    return b.select("seq", out.alias("id"))


def web_receipt(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    r = evidence.web_receipt(F.concat(F.lit("p"), "page_id"), F.sha2("url", 256), F.col("url"), F.col("url"), F.lit("text/html"), F.col("html"))
    return p.select("page_id", r["entry_key"].alias("receipt"), r["fields"]["responsesha256"].alias("response"), r["fields"]["responsebytes"].cast("long").alias("n_bytes"))


def inspect(spark, sf_dir):
    b = biblio(spark, sf_dir)
    return b.filter(~F.lower("entry_type").isin("bibsource", "bibversion")).select("entry_key", "entry_type", cn.json_map(b.fields).alias("fields"), cn.content_hash(b.entry_type, b.fields).alias("expected"))


def biblio_fields(spark, sf_dir):
    b = biblio(spark, sf_dir)
    return b.select("seq", F.size(cn.bibliographic_fields(b.fields)).cast("long").alias("n"), F.array_join(F.array_sort(F.map_keys(cn.bibliographic_fields(b.fields))), ",").alias("names"))


def _versions(spark, sf_dir):
    """A record and its next version: another year, no note, a new publisher, and another type for one in six."""
    b = biblio(spark, sf_dir)
    after = F.map_concat(F.map_filter(b.fields, lambda k, v: ~k.isin("note", "year")), F.create_map(F.lit("year"), F.when(b.seq % 2 == 0, b.year).otherwise("2031"), F.lit("publisher"), F.lit("P")))
    return b.withColumn("after", after).withColumn("after_type", F.when(b.seq % 6 == 0, "book").otherwise(b.entry_type))


def field_diff(spark, sf_dir):
    v = _versions(spark, sf_dir)
    rows = v.select("seq", F.explode(pj.changed_fields(v.entry_type, v.fields, v.after_type, v.after)).alias("c"))
    return rows.select("seq", "c.field", "c.current", "c.proposed")


def field_states(spark, sf_dir):
    v = _versions(spark, sf_dir)
    rows = v.select("seq", F.explode(evidence.compared_fields(v.fields, v.after)).alias("c"))
    return rows.groupBy(F.col("c.field").alias("field"), F.col("c.state").alias("state")).agg(F.count(F.lit(1)).alias("n"))


def adopt_projection(spark, sf_dir):
    b = biblio(spark, sf_dir)
    new = F.create_map(F.lit("title"), F.concat(F.lit("New "), "title"), F.lit("year"), F.lit("2020"), F.lit("bibprovider"), F.lit("crossref"), F.lit("bibproviderid"), b.entry_key)
    return b.select("seq", cn.json_map(pj.adopted_fields(b.fields, new)).alias("fields"))


def common_roundtrip(spark, sf_dir):
    b = biblio(spark, sf_dir)
    r = pj.literature_of_fields(F.lit("x"), b.entry_key, b.entry_type, b.fields)
    out = b.withColumn("r", r)
    return out.select("seq", F.col("r.record_type").alias("record_type"), F.col("r.issued.year").cast("long").alias("year"), pj.entry_type_of(F.col("r.record_type")).alias("entry_type"), cn.json_map(pj.fields_of_literature(F.col("r"))).alias("fields"))


def doi_groups(spark, sf_dir):
    d = _identifier_text(spark, sf_dir)
    found = d.select((F.col("doc_id") % 300).alias("doc_id"), F.explode(ids.find_dois(F.col("t"))).alias("doi"), F.when(F.col("doc_id") % 3 == 0, "exact").otherwise("strong").alias("confidence"), F.concat(F.lit("signal-"), F.col("doc_id") % 4).alias("signal"))
    g = resolve.discoveries(found, "doc_id")
    return g.select("doc_id", "doi", "confidence", F.array_join("signals", ",").alias("signals"))


def resolution_status(spark, sf_dir):
    b = biblio(spark, sf_dir)
    url = F.when(b.seq % 4 == 0, b.doi).when(b.seq % 4 == 1, F.concat(F.lit("https://x.org/a?u=10.5%2Fq"), b.seq, F.lit("&v=10.1234/z"), b.seq)).when(b.seq % 4 == 2, F.lit("https://arxiv.org/pdf/2301.00001v2")).otherwise("https://x.org/10.1")
    return resolve.resolve_urls(b.select(F.col("seq").alias("id"), url.alias("url"))).select("id", "status", F.size("candidates").cast("long").alias("n"), F.array_join(F.transform("candidates", lambda c: c["value"]), ",").alias("identifiers"))


QUERIES = {
    f.__name__: f
    for f in (
        doi_extract, doi_normalize, arxiv_extract, record_identifier, url_normalize, url_rules, canonical_hash, legacy_hash, projection_hash, document_hash, evidence_identity, actor_identity,
        provider_identity, approval_identity, web_receipt, inspect, biblio_fields, field_diff, field_states, adopt_projection, common_roundtrip, doi_groups, resolution_status,
    )
}

_T = """t AS (SELECT doc_id, 'https://doi.org/10.' || (1000 + doc_id % 9000) || '/X(' || doc_id || ')' || CASE WHEN doc_id % 2 = 0 THEN ').' ELSE ',;' END || ' and doi:10.1234/ABC.' || (doc_id % 5)
 || ' arXiv:2301.' || lpad(CAST(doc_id % 100000 AS VARCHAR), 5, '0') || 'v3' AS t FROM documents)"""
_X, _A = "'10.' || (1000 + doc_id % 9000) || '/x(' || doc_id || ')'", "'10.1234/abc.' || (doc_id % 5)"


def _json(*names: str, head: str = "") -> str:
    parts = ([f"'\"ENTRYTYPE\":' || to_json({head})"] if head else []) + [f"'\"{n}\":' || to_json({n})" for n in names]
    return "'{' || array_to_string(list_filter([" + ", ".join(parts) + "], lambda x: x IS NOT NULL), ',') || '}'"


_CANON = _json("author", "doi", "note", "title", "year", head="entry_type")
_FIELDS = _json("author", "bibsource", "doi", "note", "title", "year")
_VERSION = f"""WITH {BIBLIO}, b AS (SELECT *, CASE WHEN seq % 2 = 0 THEN year ELSE '2031' END AS new_year, CASE WHEN seq % 6 = 0 THEN 'book' ELSE entry_type END AS new_type FROM biblio)"""
ORACLES = {
    "doi_extract": f"SELECT doc_id, array_to_string(list_sort([{_X}, {_A}]), ' ') AS dois FROM documents",
    "doi_normalize": f"SELECT doc_id, {_X} AS found, '10.' || (1000 + doc_id % 9000) || '/X(' || doc_id || ')' || CASE WHEN doc_id % 2 = 0 THEN ').' ELSE ',;' END AS asked FROM documents",
    "arxiv_extract": f"WITH {_T} SELECT doc_id, lower(regexp_extract(t, 'arXiv:(\\d{{4}}\\.\\d{{4,5}})', 1)) AS arxiv FROM t",
    "record_identifier": f"""WITH {BIBLIO} SELECT seq, CASE WHEN doi IS NOT NULL THEN 'doi' WHEN note IS NOT NULL THEN 'arxiv' END AS kind,
      CASE WHEN doi IS NOT NULL THEN '10.' || (1000 + seq % 9000) || '/x' || seq WHEN note IS NOT NULL THEN '2301.' || lpad(CAST(seq % 100000 AS VARCHAR), 5, '0') END AS value,
      CASE WHEN doi IS NOT NULL THEN '10.' || (1000 + seq % 9000) || '/x' || seq WHEN note IS NOT NULL THEN '10.48550/arXiv.2301.' || lpad(CAST(seq % 100000 AS VARCHAR), 5, '0') END AS doi,
      CASE WHEN doi IS NOT NULL THEN 'doi' WHEN note IS NOT NULL THEN 'note' END AS field FROM biblio""",
    "url_normalize": "SELECT page_id, regexp_replace(url, '#.*$', '') AS url FROM pages",
    "url_rules": """SELECT page_id, page_id % 4 >= 2 AS is_public, 'https://api.example.org/works?rows=5&n=' || page_id AS recorded, CASE WHEN page_id % 2 = 0 THEN 'https://doi.org/10.1/' || page_id ELSE url END AS safe, 'a b+c/' || page_id AS decoded FROM pages""",
    "canonical_hash": f"WITH {BIBLIO} SELECT seq, {_CANON} AS json, sha256({_CANON}) AS sha256 FROM biblio",
    "legacy_hash": f"WITH {BIBLIO} SELECT seq, sha256({_json('author', 'bibsource', 'doi', 'note', 'title', 'year', head='entry_type')}) AS sha256 FROM biblio",
    "projection_hash": f"WITH {BIBLIO} SELECT seq, sha256('[' || to_json(entry_type) || ',' || {_FIELDS} || ']') AS whole, sha256('[' || to_json(entry_type) || ',' || {_json('author', 'doi', 'title', 'year')} || ']') AS controlled FROM biblio",
    "document_hash": f"""WITH {BIBLIO}, r AS (SELECT 'f' || (seq % (10 * (1 + (SELECT count(*) FROM biblio) // 5000))) AS file, seq, '{{"entry_type":' || to_json(entry_type) || ',"entry_key":' || to_json(entry_key) || ',"fields":' || {_FIELDS} || '}}' AS j FROM biblio)
      SELECT file, sha256('[' || string_agg(j, ',' ORDER BY seq) || ']') AS sha256, count(*) AS n FROM r GROUP BY file""",
    "evidence_identity": """SELECT doc_id, sha256('4' || chr(0) || 'kind' || '3' || chr(0) || 'web' || '6' || chr(0) || 'target' || length('d' || doc_id) || chr(0) || 'd' || doc_id || '4' || chr(0) || 'text' || octet_length(encode(text)) || chr(0) || text) AS identity FROM documents""",
    "actor_identity": f"WITH {BIBLIO} SELECT seq, sha256(CASE WHEN seq % 2 = 0 THEN 'human' ELSE 'agent' END || chr(0) || author || chr(0) || entry_key || chr(0) || sha256({_CANON})) AS identity FROM biblio",
    "provider_identity": f"WITH {BIBLIO} SELECT seq, sha256('provider' || chr(0) || 'crossref' || chr(0) || seq || chr(0) || 'https://x/' || seq || chr(0) || 'application/json' || chr(0) || 'literature-record-v1' || chr(0) || '1' || chr(0) || sha256(title) || CASE WHEN seq % 2 = 0 THEN chr(0) || 'requestmethod' || chr(0) || 'GET' ELSE '' END) AS identity FROM biblio",
    "approval_identity": f"""WITH {BIBLIO} SELECT seq, sha256('["human","browser-review",' || CASE WHEN seq % 2 = 0 THEN to_json(author)::VARCHAR ELSE 'null' END || ',' || to_json(entry_key) || ',"' || sha256(title) || '",' || (1700000000 + seq) || ',"b1"]') AS id FROM biblio""",
    "web_receipt": """WITH p AS (SELECT *, sha256(html) AS h, octet_length(encode(html)) AS n, sha256(url) AS c, 'p' || page_id AS k FROM pages),
      f AS (SELECT *, [['contenthash', c], ['finalurl', url], ['inputurl', url], ['kind', 'web'], ['mediatype', 'text/html'], ['requesturl', url], ['responsebytes', n::VARCHAR], ['responsesha256', h], ['target', k], ['toolversion', '1.0']] AS kv FROM p)
      SELECT page_id, 'bibsource:web:' || sha256(array_to_string(list_transform(kv, lambda x: octet_length(encode(x[1])) || chr(0) || x[1] || octet_length(encode(x[2])) || chr(0) || x[2]), '')) AS receipt, h AS response, n::BIGINT AS n_bytes FROM f""",
    "inspect": f"WITH {BIBLIO} SELECT entry_key, entry_type, {_FIELDS} AS fields, sha256({_CANON}) AS expected FROM biblio",
    "biblio_fields": f"WITH {BIBLIO}, n AS (SELECT seq, list_filter(['author', CASE WHEN doi IS NOT NULL THEN 'doi' END, CASE WHEN note IS NOT NULL THEN 'note' END, 'title', 'year'], lambda x: x IS NOT NULL) AS l FROM biblio) SELECT seq, len(l)::BIGINT AS n, array_to_string(l, ',') AS names FROM n",
    "field_diff": f"""{_VERSION} SELECT seq, 'ENTRYTYPE' AS field, entry_type AS current, new_type AS proposed FROM b WHERE entry_type <> new_type
      UNION ALL SELECT seq, 'note', note, NULL FROM b WHERE note IS NOT NULL UNION ALL SELECT seq, 'publisher', NULL, 'P' FROM b UNION ALL SELECT seq, 'year', year, new_year FROM b WHERE year <> new_year""",
    "field_states": f"""{_VERSION}, s AS (SELECT 'author' AS field, 'unchanged' AS state FROM b UNION ALL SELECT 'title', 'unchanged' FROM b UNION ALL SELECT 'doi', 'unchanged' FROM b WHERE doi IS NOT NULL
      UNION ALL SELECT 'note', 'removed' FROM b WHERE note IS NOT NULL UNION ALL SELECT 'publisher', 'added' FROM b UNION ALL SELECT 'year', CASE WHEN year = new_year THEN 'unchanged' ELSE 'changed' END FROM b)
      SELECT field, state, count(*) AS n FROM s GROUP BY field, state""",
    "adopt_projection": f"""WITH {BIBLIO}, n AS (SELECT seq, 'crossref' AS bibprovider, entry_key AS bibproviderid, bibsource, note, 'New ' || title AS title, '2020' AS year FROM biblio) SELECT seq, {_json('bibprovider', 'bibproviderid', 'bibsource', 'note', 'title', 'year')} AS fields FROM n""",
    "common_roundtrip": f"""WITH {BIBLIO}, n AS (SELECT seq, entry_type AS et, author, 'x' AS bibprovider, entry_key AS bibproviderid, doi, CASE WHEN trim(title) <> '' THEN title END AS title, year FROM biblio)
      SELECT seq, CASE et WHEN 'article' THEN 'journal-article' ELSE et END AS record_type, year::BIGINT AS year, et AS entry_type, {_json('author', 'bibprovider', 'bibproviderid', 'doi', 'title', 'year')} AS fields FROM n""",
    "doi_groups": f"""WITH f AS (SELECT doc_id % 300 AS id, unnest([{_X}, {_A}]) AS doi, doc_id % 3 = 0 AS exact, 'signal-' || (doc_id % 4) AS signal FROM documents)
      SELECT id AS doc_id, doi, CASE WHEN bool_or(exact) THEN 'exact' ELSE 'strong' END AS confidence, array_to_string(list_sort(list(DISTINCT signal)), ',') AS signals FROM f GROUP BY id, doi""",
    "resolution_status": """SELECT doc_id AS id, CASE doc_id % 4 WHEN 0 THEN 'resolved' WHEN 1 THEN 'resolved' WHEN 2 THEN 'resolved' ELSE 'unresolved' END AS status, CASE doc_id % 4 WHEN 3 THEN 0 ELSE 1 END::BIGINT AS n,
      CASE doc_id % 4 WHEN 0 THEN '10.' || (1000 + doc_id % 9000) || '/x' || doc_id WHEN 1 THEN '10.1234/z' || doc_id WHEN 2 THEN '2301.00001' ELSE '' END AS identifiers FROM documents""",
}
