"""Queries on receipts and their chains, identifiers in order of precedence, approvals, notes and proposals."""

from __future__ import annotations

from pyspark.sql import functions as F

from citegrid.functions import canonical as cn
from citegrid.functions import projections as pj
from citegrid.functions import webscan
from citegrid.functions.vocab import CONTROLLED_FIELDS
from citegrid.operators import evidence, ledger, lifecycle, proposals, reconcile, resolve
from citegrid.plans.lifecycle import _H
from citegrid.plans.views import BIBLIO, biblio, table
from citegrid.sources import ledger as store
from citegrid.sources import providers
from citegrid.storage import checkpoint


def evidence_chain(spark, sf_dir):
    """Records adopted from a provider after a search, a selection and a resolution; each twelfth breaks another rule."""
    b = biblio(spark, sf_dir).select("seq", "entry_type", "entry_key", "title")
    i, kind = F.col("seq") % 12, F.col("entry_type")
    doi = F.concat(F.lit("10.1000/d"), "seq")
    ids = F.array(doi, F.lit("10.1000/z"))
    other = F.when(i == 10, F.concat(doi, F.lit("x"))).otherwise(doi)
    url = F.concat(F.lit("https://doi.org/"), other)
    new = F.create_map(F.lit("title"), F.concat(F.lit("T"), "seq"), F.lit("bibprovider"), F.lit("crossref"), F.lit("bibproviderid"), doi)
    none = F.create_map().cast("map<string,string>")
    c = b.withColumn("search", evidence.search_receipt(F.lit("crossref"), F.coalesce("title", F.lit("?")), F.lit("u"), F.transform(ids, lambda x: F.struct(x.alias("id")))))
    c = c.withColumn("selection", evidence.selection_receipt(F.col("search.entry_key"), ids, F.upper(doi), F.lit(" me "), F.when(i == 5, "guess").otherwise("agent-review")))
    c = c.withColumn("resolution", evidence.resolution_receipt(F.lit("url-doi"), url, url, F.lit("doi"), other, F.lit("exact"), F.array(F.struct(F.lit("doi-in-url").alias("kind"), other.alias("value")))))
    c = c.withColumn("source", evidence.provider_receipt(F.lit("crossref"), doi, F.lit("u"), F.lit("application/json"), F.lit("{}"), kind, pj.adopted_fields(none, new), resolution=F.col("resolution.entry_key"), selection=F.col("selection.entry_key")))
    c = checkpoint(c)  # receipts name each other, so their expressions nest
    node = lambda name, when, fields=None: c.filter(when).select(F.col(f"{name}.entry_key").alias("entry_key"), (F.col(f"{name}.fields") if fields is None else fields).alias("fields"))
    changed = lambda name, at, key, value: F.when(i == at, pj.overlay(F.col(f"{name}.fields"), F.create_map(F.lit(key), F.lit(value)))).otherwise(F.col(f"{name}.fields"))
    nodes = node("search", i != 4, changed("search", 8, "candidates", '[{"id":"10.1000/z"}]'))
    for more in (node("selection", i != 2), node("resolution", i != 3, changed("resolution", 9, "signals", '[{"kind":"k","value":"v"}]')), node("source", i != 6)):
        nodes = evidence.append_evidence(nodes, more)
    nodes = evidence.append_evidence(nodes, node("source", i == 0))  # once more, which changes nothing
    own = pj.overlay(pj.adopted_fields(none, new), F.create_map(F.lit("bibsource"), F.col("source.entry_key"), F.lit("title"), F.when(i == 1, "Other").otherwise(F.concat(F.lit("T"), "seq")), F.lit("bibproviderid"), F.when(i == 7, "10.1000/q").otherwise(doi)))
    e = evidence.joined_evidence(c.select("seq", "entry_type", "entry_key", own.alias("fields")), nodes)
    return e.select("seq", "error")


def identifier_precedence(spark, sf_dir):
    b = biblio(spark, sf_dir)
    f = b.fields
    return b.select("seq", resolve.verify_identifier(f).alias("v"), resolve.plan_identifier(f, F.lit("crossref")).alias("p"), resolve.apply_identifier(F.when(b.seq % 6 == 0, "given"), f).alias("applied")).select("seq", F.col("v.doi").alias("doi"), F.col("v.method").alias("method"), F.col("p.id").alias("planned"), F.col("p.method").alias("plan"), "applied")


def approvals_made(spark, sf_dir):
    """Approvals of all records, asked for with the hash of now or (every third) an older one."""
    b = biblio(spark, sf_dir)
    now = b.select("seq", "entry_key", cn.content_hash(b.entry_type, b.fields).alias("content_hash"))
    asked = now.select("entry_key", F.when(F.col("seq") % 3 == 0, "old").otherwise(F.col("content_hash")).alias("content_hash"))
    return ledger.approvals(now, asked, "me", 7).select("entry_key", "id", "batch_id")


def note_payloads(spark, sf_dir):
    """Notes of a review platform, every other with embedded BibTeX."""
    p = table(spark, sf_dir, "part")
    n = F.col("p_partkey")
    v = lambda c: F.struct(c.alias("value"))
    entry = F.when(n % 2 == 0, F.concat(F.lit("@inproceedings{x, title = {In "), "p_name", F.lit("}, author = {"), "p_brand", F.lit(", A.}, year = 2001}")))
    content = F.struct(v(F.col("p_name")).alias("title"), v(F.array("p_brand")).alias("authors"), v(F.concat(F.lit("Conf "), 1990 + F.col("p_size"))).alias("venue"), v(entry).alias("_bibtex"))
    body = F.to_json(F.struct(F.array(F.struct(F.concat(F.lit("n"), n).alias("id"), content.alias("content"))).alias("notes")))
    r = providers.openreview_records(p.select(body.alias("body")))
    return r.select("id", "record.title", "record.url", F.col("record.issued.year").cast("long").alias("year"), F.col("record.authors")[0]["family"].alias("family"))


def source_codec(spark, sf_dir):
    """Evidence fields to a ledger file's JSON and back."""
    d = table(spark, sf_dir, "documents")
    fields = F.create_map(F.lit("kind"), F.lit("search"), F.lit("query"), F.concat(F.lit('["q", '), "doc_id", F.lit("]")), F.lit("candidates"), F.when(d.doc_id % 3 == 0, "no json").otherwise(F.concat(F.lit('[{"id":"'), "doc_id", F.lit('"}]'))))
    encoded = cn.encode_source_fields(fields)
    return d.select("doc_id", encoded.alias("encoded"), (cn.json_map(cn.decode_source_fields(encoded)) == cn.json_map(fields)).alias("same"))


def hydrated_records(spark, sf_dir):
    """Records with the state of their entries, and the evidence as rows."""
    b = biblio(spark, sf_dir)
    sealed, nodes = reconcile.seal(b.select("entry_type", "entry_key", cn.without(b.fields, ("bibsource",)).alias("fields")), "agent", "me")
    entries = lifecycle.capture(sealed, lifecycle.empty(spark)["entries"])
    bare = sealed.select("entry_type", "entry_key", cn.bibliographic_fields(F.col("fields")).alias("fields"))
    out = store.hydrate(bare, entries, nodes)
    return out.select("entry_type", F.when(F.col("entry_type") == "bibsource", F.col("fields")["target"]).otherwise(F.col("entry_key")).alias("entry_key"), F.col("fields")["integrity"].alias("marker"), F.col("fields")["bibsource"].isNotNull().alias("named"))


def proposal_life(spark, sf_dir):
    """Proposals for every second record; some blocked, some stale, one in ten adopted before; what adoption comes to."""
    b = biblio(spark, sf_dir)
    records = b.select("entry_type", "entry_key", cn.without(b.fields, ("bibsource",)).alias("fields"))
    state = lifecycle.sync(lifecycle.empty(spark), records, "me", 1)
    n = F.substring("target", 2, 20).cast("long")
    changes = b.filter("seq % 2 = 0").select(F.col("entry_key").alias("target"), "entry_type", F.map_concat(cn.without(b.fields, ("bibsource", "year")), F.create_map(F.lit("year"), F.lit("2031"))).alias("fields"))
    state["proposals"] = proposals.create(records, changes, " agent ", "newer", 2)
    wanted = state["proposals"].select("id", F.when(n % 6 == 0, "no provider support; human approval required").alias("blocker"), n.alias("n"))
    records, state, _ = lifecycle.adopt_proposals(state, records, wanted.filter("n % 10 = 4").select("id", F.lit(None).cast("string").alias("blocker")), "first", 3)
    edited = records.withColumn("fields", F.when(F.substring("entry_key", 2, 20).cast("long") % 14 == 0, F.map_concat("fields", F.create_map(F.lit("pages"), F.lit("1")))).otherwise(F.col("fields")))
    _, state, said = lifecycle.adopt_proposals(state, edited, wanted, "agent", 4)
    p = state["proposals"].select("id", "target", F.col("outcome").alias("now"), (F.col("decision_revision").isNotNull()).alias("revised"))
    return said.join(p, "id").select("target", "outcome", "error", "now", "revised")


def atom_identifiers(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    feed = F.concat(F.lit('<feed xmlns:a="urn:x"><entry><a:doi>10.1000/p'), "p_partkey", F.lit("</a:doi><title>10.1000/no</title></entry></feed>"))
    return p.select("p_partkey", F.array_join(webscan.atom_dois(feed), ",").alias("dois"))


def evidence_replay(spark, sf_dir):
    """Receipts that hold the responses they were made of, two of three from one provider; some are tampered with."""
    b = biblio(spark, sf_dir)
    i, title = F.col("seq"), F.coalesce(F.trim("title"), F.lit("?"))
    work = F.to_json(F.struct(F.struct(F.concat(F.lit("10.1000/D"), i).alias("DOI"), F.lit("journal-article").alias("type"), F.array(F.lit("T"), title).alias("title"), F.array(F.struct(F.lit("Doe").alias("family"), F.lit("J").alias("given"))).alias("author")).alias("message")))
    value = lambda c: F.struct(c.alias("value"))
    note = F.to_json(F.struct(F.array(F.struct(F.concat(F.lit("n"), i).alias("id"), F.struct(value(title).alias("title"), value(F.array(F.lit("Jane Doe"))).alias("authors"), value(F.lit("V 2020")).alias("venue")).alias("content"))).alias("notes")))
    is_work = i % 3 > 0
    rows = b.select("seq", is_work.alias("work"), F.when(is_work, work).otherwise(note).alias("body"), F.when(is_work, F.concat(F.lit("10.1000/d"), i)).otherwise(F.concat(F.lit("n"), i)).alias("id"))
    records = providers.crossref_lookup(rows.filter("work")).select("seq", "body", "id", "record").unionByName(providers.openreview_notes(rows.filter("NOT work")).select("seq", "body", "id", "record"))
    r = F.col("record")
    own = cn.only(pj.fields_of_literature(r), CONTROLLED_FIELDS)
    receipt = evidence.provider_receipt(r["provider"], F.col("id"), F.lit("u"), F.lit("application/json"), F.col("body"), pj.entry_type_of(r["record_type"]), own)
    c = checkpoint(records.withColumn("receipt", receipt))
    k = F.col("seq") % 8
    more = F.create_map(
        F.lit("response"), F.when(k == 1, F.concat(F.base64(F.encode("body", "UTF-8")), F.lit("AAAA"))).when(k % 2 == 0, F.col("body")).otherwise(F.base64(F.encode("body", "UTF-8"))),
        F.lit("responseencoding"), F.when(k == 3, "rot13").when(k % 2 == 0, "UTF-8").otherwise("base64"),
        F.lit("providerid"), F.when(k == 5, "nobody").otherwise(F.col("id")), F.lit("projectionsha256"), F.when(k == 7, F.repeat(F.lit("0"), 64)).otherwise(F.col("receipt.fields")["projectionsha256"]),
    )
    nodes = c.select("seq", F.concat(F.lit("e"), "seq").alias("entry_key"), pj.overlay(F.col("receipt.fields"), more).alias("fields"))
    back = providers.replay(nodes.select("entry_key", "fields"))
    return back.select(F.substring("entry_key", 2, 20).cast("long").alias("seq"), "provider", F.col("record.id").alias("id"), F.col("record.title").alias("title"), "error")


QUERIES = {f.__name__: f for f in (evidence_replay, evidence_chain, identifier_precedence, approvals_made, note_payloads, source_codec, hydrated_records, proposal_life, atom_identifiers)}

_HASH = _H % "year"
_WITH = f"WITH {BIBLIO}, h AS (SELECT *, {_HASH} AS hash FROM biblio)"
_BATCH = "left(sha256('7:me'), 16)"
_REPLAY = "CASE doc_id % 8 WHEN 1 THEN 'the stored response has another hash' WHEN 3 THEN 'the response''s encoding is unknown' WHEN 5 THEN CASE WHEN doc_id % 3 > 0 THEN 'the stored response is of another record' ELSE 'the stored response holds no record' END WHEN 7 THEN 'the stored response gives other fields' END"
ORACLES = {
    "evidence_replay": f"""SELECT doc_id AS seq, CASE WHEN doc_id % 3 > 0 THEN 'crossref' ELSE 'openreview' END AS provider, CASE WHEN {_REPLAY} IS NULL THEN CASE WHEN doc_id % 3 > 0 THEN '10.1000/D' || doc_id ELSE 'n' || doc_id END END AS id,
      CASE WHEN {_REPLAY} IS NULL THEN CASE WHEN doc_id % 3 > 0 THEN 'T' ELSE coalesce(trim(split_part(text, chr(10), 1)), '?') END END AS title, {_REPLAY} AS error FROM documents""",
    "evidence_chain": """SELECT doc_id AS seq, CASE doc_id % 12 WHEN 1 THEN 'fields no longer match the recorded provider projection' WHEN 2 THEN 'selection evidence not found' WHEN 3 THEN 'resolution evidence not found' WHEN 4 THEN 'search evidence not found'
      WHEN 5 THEN 'unsupported selection method' WHEN 6 THEN 'evidence not found' WHEN 7 THEN 'provider identity no longer matches the receipt' WHEN 8 THEN 'selected id is not a recorded candidate' WHEN 9 THEN 'signals do not match the identifier'
      WHEN 10 THEN 'resolved DOI does not match provider record id' END AS error FROM documents""",
    "identifier_precedence": f"""WITH {BIBLIO}, x AS (SELECT seq, title, CASE WHEN doi IS NOT NULL THEN substr(doi, 17) END AS own, CASE WHEN note IS NOT NULL THEN '10.48550/arXiv.2301.' || lpad(CAST(seq % 100000 AS VARCHAR), 5, '0') END AS ax FROM biblio)
      SELECT seq, coalesce(own, ax) AS doi, CASE WHEN own IS NOT NULL THEN 'doi-field' WHEN ax IS NOT NULL THEN 'field:note' END AS method, own AS planned, CASE WHEN own IS NOT NULL THEN 'doi' WHEN title IS NOT NULL THEN 'title-search' ELSE 'unsupported' END AS plan,
      CASE WHEN seq % 6 = 0 THEN 'given' ELSE coalesce(own, ax) END AS applied FROM x""",
    "approvals_made": f"""{_WITH} SELECT entry_key, sha256('["human","browser-review","me","' || entry_key || '","' || hash || '",7,"' || {_BATCH} || '"]') AS id, {_BATCH} AS batch_id FROM h WHERE seq % 3 <> 0""",
    "note_payloads": """SELECT 'n' || p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 'In ' || p_name ELSE p_name END AS title, 'https://openreview.net/forum?id=n' || p_partkey AS url, CASE WHEN p_partkey % 2 = 0 THEN 2001 ELSE 1990 + p_size END::BIGINT AS year, p_brand AS family FROM part""",
    "source_codec": """SELECT doc_id, '{"candidates":' || CASE WHEN doc_id % 3 = 0 THEN '"no json"' ELSE '[{"id":"' || doc_id || '"}]' END || ',"kind":"search","query":"[\\"q\\", ' || doc_id || ']"}' AS encoded, true AS same FROM documents""",
    "hydrated_records": f"{_WITH} SELECT entry_type, entry_key, hash AS marker, true AS named FROM h UNION ALL SELECT 'bibsource', entry_key, NULL, false FROM h",
    "proposal_life": f"""WITH {BIBLIO}, x AS (SELECT entry_key AS target, seq % 10 = 4 AS earlier, seq % 6 = 0 AS blocked, seq % 14 = 0 AS stale FROM biblio WHERE seq % 2 = 0),
      y AS (SELECT *, CASE WHEN earlier THEN 'proposal has already been decided' WHEN blocked THEN 'no provider support; human approval required' WHEN stale THEN 'proposal is stale' END AS error FROM x)
      SELECT target, CASE WHEN error IS NULL THEN 'adopted' END AS outcome, error, CASE WHEN error IS NULL OR earlier THEN 'adopted' END AS now, error IS NULL OR earlier AS revised FROM y""",
    "atom_identifiers": "SELECT p_partkey, '10.1000/p' || p_partkey AS dois FROM part",
}
