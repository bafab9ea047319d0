"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests. All of it is DataFrame operations.

A text is cut into paragraphs, each distinct one has a digest, and a sketch of three tables of 2**level cells takes each
digest into one cell of each table: a count, the exclusive or of the digests, and that of their check values. Sketches of
one level subtract cell by cell, so what two versions share cancels out. A cell left with the count 1 or -1 whose check value
fits holds a single digest; taken out of its other cells it lays open further ones, and so on until all cells are empty:
the digests that only one version has are recovered, from sketches whose size follows the difference. If cells are left
over the sketches were too small, and these versions, no others, are compared once more with sketches four times as large.

Cells are rows and a sketch is an aggregation, so nothing is folded in one value: very long texts spill like any table.
In each step cells of one table only are emptied, where each digest has one cell, so none is found twice in a step, and
steps follow each other as aggregations by the same key, without a shuffle between them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citegrid.llm.common import Shield, text_or_empty, written

#: A paragraph is a line, cut behind its sentences if it has more code points than this.
LONG_LINE = 200
#: Digests are the first hexadecimal digits of an MD5, three times the bits of which a table takes the first for the place.
DIGITS, PLACE_BITS = 15, 20
#: Primes of the check value, both under 2**30.
PRIMES = (1073741789, 1073741783)
#: Steps of peeling before a sketch counts as too small; how many bits a retry adds to the level.
STEPS, GROWTH = 12, 2
#: Pairs, or texts, that one task sketches on average.
TASK_ROWS = 4096
TABLES, LEAST_LEVEL = 3, 2
#: Bytes and rows of documents that make one range of the order, on average; ranges at most.
RANGE_BYTES, RANGE_ROWS, RANGES = 1 << 24, 1 << 10, 1 << 16


def paragraphs(text: Column) -> Column:
    """The distinct paragraphs of a text that hold more than white space, each trimmed of it."""
    sentences = lambda line: F.regexp_extract_all(line, F.lit(r"[^.!?]*[.!?]+|[^.!?]+"), F.lit(0))
    cut = F.flatten(F.transform(F.split(text, "\n"), lambda line: F.when(F.length(line) > LONG_LINE, sentences(line)).otherwise(F.array(line))))
    trimmed = F.transform(cut, lambda p: F.btrim(p, F.lit(" \t\n\v\f\r")))
    return F.array_distinct(F.filter(trimmed, lambda p: p != ""))


def digests(text: Column) -> Column:
    """The distinct digests (longs of 60 bits) of a text's paragraphs; a null text has none."""
    return F.array_distinct(F.transform(paragraphs(text_or_empty(text)), lambda p: F.conv(F.substring(F.md5(p), 1, DIGITS), 16, 10).cast("long")))


def level_of(n: Column) -> Column:
    """The level of a sketch of n digests: its cells are 1.5 to 3 times as many, twelve at least."""
    return F.greatest(F.lit(LEAST_LEVEL), F.ceil(F.log2(F.greatest(n, F.lit(1)) / 2.0))).cast("int")


#: SQL: the check value of a digest.
CHECK = f"key % {PRIMES[0]} + key % {PRIMES[1]} * {1 << 30}L"


def place(table: int) -> str:
    """SQL: the cell of a digest in a table: as many of its bits as the mask has, from another one on for each table."""
    at, width = PLACE_BITS * table, PLACE_BITS * TABLES
    turned = f"(shiftright(key, {at}) | shiftleft(key, {width - at}))" if table else "key"
    return f"{turned} & mask"


def cell(tab: object, at: str, n: str, key: str, chk: str) -> str:
    return f"named_struct('tab', {tab}, 'place', {at}, 'n', {n}, 'key', {key}, 'chk', {chk})"


def summed(rows: str, by: list[str]) -> str:
    """SQL: cells summed up: counts added, digests and check values by exclusive or; empty ones go."""
    keys = ", ".join([*by, "mask", "tab", "place"])
    return f"SELECT {keys}, sum(n) AS n, bit_xor(key) AS key, bit_xor(chk) AS chk FROM ({rows}) GROUP BY {keys} HAVING sum(n) <> 0 OR bit_xor(key) <> 0 OR bit_xor(chk) <> 0"


def sketches(sets: DataFrame, by: list[str], sign: str = "1L") -> DataFrame:
    """Rows (by, level, keys array of digests) -> cells (by, mask, tab, place, n, key, chk), empty ones left out.

    Rows of equal ``by`` are one sketch; ``sign`` is an SQL expression, by which rows are put in (1) or taken out (-1): sketches
    are sums, so taking a set out of the sketch of another is subtracting its sketch.
    """
    names = ", ".join([*by, "mask"])
    cells = ", ".join(cell(t, place(t), "_sign", "key", CHECK) for t in range(TABLES))
    each = f"SELECT {', '.join(by)}, shiftleft(1L, level) - 1 AS mask, {sign} AS _sign, explode(keys) AS key FROM {{sets}}"
    return sets.sparkSession.sql(summed(f"SELECT {names}, inline(array({cells})) AS (tab, place, n, key, chk) FROM ({each})", by), sets=sets)


def peeled(cells: str, by: list[str]) -> str:
    """SQL: cells of differences, peeled in STEPS steps; a recovered digest is a row of the table TABLES, its n the side."""
    names = ", ".join([*by, "mask"])
    for step in range(STEPS):
        at = step % TABLES
        pure = f"tab = {at} AND abs(n) = 1 AND chk = {CHECK} AND place = {place(at)}"
        others = ", ".join(cell(t, place(t), "-n", "key", "chk") for t in range(TABLES) if t != at)
        now = f"CASE WHEN {pure} THEN array({cell(TABLES, 'key', 'n', 'key', '0L')}, {others}) ELSE array({cell('tab', 'place', 'n', 'key', 'chk')}) END"
        cells = summed(f"SELECT {names}, inline({now}) AS (tab, place, n, key, chk) FROM ({cells})", by)
    return cells


def _compared(pairs: DataFrame, by: list[str]) -> DataFrame:
    """(by, level, a, b) -> (by, only_a, only_b, left): the digests recovered on each side and the cells left over."""
    one = lambda sign, keys: F.struct(F.lit(sign).cast("long").alias("sign"), F.col(keys).alias("keys"))
    sides = pairs.select(*by, "level", F.explode(F.array(one(1, "a"), one(-1, "b"))).alias("s")).select(*by, "level", "s.*")
    sql = peeled("SELECT * FROM {both}", by)
    found = f"tab = {TABLES}"
    return pairs.sparkSession.sql(
        f"SELECT {', '.join(by)}, collect_list(CASE WHEN {found} AND n = 1 THEN key END) AS only_a, collect_list(CASE WHEN {found} AND n = -1 THEN key END) AS only_b, "
        f"count_if(NOT ({found} AND abs(n) = 1)) AS left FROM ({sql}) GROUP BY {', '.join(by)}",
        both=sketches(sides, by, "sign"),
    )


def _dealt(rows: DataFrame, key: str) -> DataFrame:
    """rows by key, in partitions whose cells fit in memory; what follows groups by this key and more, without a shuffle."""
    return rows.repartition(1 + rows.count() // TASK_ROWS, key)


def differences(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Pairs (by: columns that tell pairs apart, a, b: arrays of distinct digests) -> (by, only_a, only_b), the digests of
    one side only, for the pairs that differ.

    The first sketches have three to six cells for each digest of the larger side, room for sides that share nothing; pairs
    whose peeling does not end are compared again with larger ones, until none is left. Null arrays are empty. ``pairs`` is read again in each round, so give it as a table.
    """
    none = F.array().cast("array<bigint>")
    now = pairs.select(*by, *[F.coalesce(c, none).alias(c) for c in ("a", "b")])
    now = now.withColumn("level", level_of(F.greatest(F.size("a"), F.size("b"))) + 1)
    settled = []
    while True:
        tried = written(_compared(_dealt(now, by[0]), by), "sketch-differences")
        settled.append(tried.filter("left = 0").select(*by, "only_a", "only_b"))
        failed = tried.filter("left > 0").select(*[F.col(c).alias(f"_{c}") for c in by])
        if failed.isEmpty():
            return reduce(DataFrame.unionByName, settled)
        now = now.join(failed, [F.col(c) == F.col(f"_{c}") for c in by], "left_semi").withColumn("level", F.col("level") + GROWTH)


def likeness(n_a: Column, n_b: Column, only_a: Column, only_b: Column) -> Column:
    """Shared digests over all digests; two texts without any are alike (1)."""
    every = n_a + F.size(only_b)
    return F.when(every == 0, F.lit(1.0)).otherwise((n_a - F.size(only_a)) / every)


def shown() -> Column:
    """A cell (columns tab, place, n, key, chk) as text: ":<table>.<place>.<count>.<digests>.<checks>", hexadecimal."""
    return F.lower(F.concat(F.lit(":"), F.col("tab").cast("string"), *[x for c in ("place", "n", "key", "chk") for x in (F.lit("."), F.hex(c))]))


def fingerprint(cells: Column, seal: Column, n: Column) -> Column:
    """"<seal>:<level>" and the cells that are not empty, in order, as one string. The seal, a hash of the whole text, tells
    apart texts of the same paragraphs."""
    return F.concat(seal, F.lit(":"), level_of(n).cast("string"), F.coalesce(F.array_join(cells, ""), F.lit("")))


ADDED = ("fingerprints", "only_first", "only_other", "likeness")


def compare_texts(rows: DataFrame, key: str, texts: list[str], printed: int | None = None, keys: dict[str, str] | None = None) -> DataFrame:
    """rows without their texts, and with arrays: of each of the first ``printed`` texts (all) its ``fingerprints``, of each
    but the first against the first ``only_first`` and ``only_other`` (the paragraph digests of one of both only) and
    ``likeness`` (0 to 1).

    ``key`` is a column of distinct longs; ``keys`` names columns that hold the digests() of a text already. Null texts are
    empty; an empty text, or one of white space, has no paragraphs, and two such texts are alike (1). Repeated paragraphs of
    a text count once, paragraphs in another order are the same (but not the fingerprint). Equal rows need different keys;
    an empty table gives no rows; columns may have any names, those added take the place of others. Very long texts are cut
    in one value, their cells are rows.
    """
    shield, known = Shield(rows), keys or {}
    printed = len(texts) if printed is None else printed
    id_, columns = shield(key), [shield(t) for t in texts]
    of = [F.col(shield(known[t])) if t in known else digests(F.col(c)) for t, c in zip(texts, columns)]
    gone = {*columns, *(shield(k) for k in known.values())}
    kept = [c for c in shield.df.columns if c not in gone]
    seals = F.array(*[F.md5(text_or_empty(c)) for c in columns[:printed]])
    sets = written(shield.df.select(*kept, F.array(*of).alias("_keys"), seals.alias("_seals")), "text-digests")
    others = range(1, len(texts))

    pair = lambda i: F.struct(F.lit(i).alias("other"), F.get("_keys", F.lit(0)).alias("a"), F.get("_keys", F.lit(i)).alias("b"))
    pairs = sets.select(id_, F.explode(F.array(*map(pair, others))).alias("p")).select(id_, "p.*")
    found = differences(pairs, [id_, "other"]).groupBy(id_).agg(F.map_from_entries(F.collect_list(F.struct("other", F.struct("only_a", "only_b")))).alias("_found"))

    each = _dealt(sets.select(id_, F.slice("_keys", 1, printed).alias("_keys")), id_).select(id_, F.posexplode("_keys").alias("version", "keys")).withColumn("level", level_of(F.size("keys")))
    listed = sketches(each, [id_, "version"]).select(id_, F.struct("version", "tab", "place", shown().alias("shown")).alias("cell"))
    cells = listed.groupBy(id_).agg(F.array_sort(F.collect_list("cell")).alias("_cells"))

    out = sets.join(found.withColumnRenamed(id_, "_f"), F.col(id_) == F.col("_f"), "left").join(cells.withColumnRenamed(id_, "_c"), F.col(id_) == F.col("_c"), "left")
    none, at = F.array().cast("array<bigint>"), lambda column, i: F.get(column, F.lit(i))
    only = lambda side: F.array(*[F.coalesce(F.try_element_at("_found", F.lit(i))[side], none) for i in others])
    out = out.withColumns({"_a": only("only_a"), "_b": only("only_b")})
    sizes = F.transform("_keys", lambda k: F.size(k))
    own = lambda i: F.transform(F.filter("_cells", lambda c: c["version"] == i), lambda c: c["shown"])
    prints = [fingerprint(own(i), at("_seals", i), at(sizes, i)) for i in range(printed)]
    like = F.array(*[likeness(at(sizes, 0), at(sizes, i), at("_a", i - 1), at("_b", i - 1)) for i in others])
    out = shield.restored(out.withColumns(dict.fromkeys(gone, F.lit(None))), fingerprints=F.array(*prints), only_first="_a", only_other="_b", likeness=like)
    return out.drop(*[n for i, n in enumerate(rows.columns) if f"in{i}__" in gone and n not in ADDED])


def _range_of(key: str, bounds: Column) -> Column:
    """The range of a value among sorted bounds, by binary search: even ranges lie between bounds, odd ones are a bound."""
    steps = F.sequence(F.lit(16), F.lit(0), F.lit(-1))

    def below(is_below) -> Column:
        def step(low: Column, bit: Column) -> Column:
            ahead = low + F.call_function("shiftleft", F.lit(1), bit)
            return F.when(F.coalesce(is_below(F.get(bounds, ahead - 1)), F.lit(False)), ahead).otherwise(low)

        return F.aggregate(steps, F.lit(0), step)

    return below(lambda b: b < F.col(key)) + below(lambda b: b <= F.col(key))


def with_next(docs: DataFrame, key: str, text: str, carried: str | None = None) -> DataFrame:
    """docs with ``id`` (distinct longs) and ``next_text``, the text of the next row by descending key, a long; after the
    last row comes the first, of one row itself. With ``carried``, a column, ``next_carried`` is the next row's.

    Null keys come last, rows of one key are in the order of a hash of the text, null texts stay null. Rows are dealt to
    ranges of keys; a range of a single key is parted by the hash, so only equal rows must meet in a task. Texts are
    shuffled once; from range to range one row moves. Columns named like an added one give way.
    """
    shield = Shield(docs)
    docs, key, text = shield.df, shield(key), shield(text)
    taken = {"next_text": text} | ({"next_carried": shield(carried)} if carried else {})
    size = docs.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length(text)).alias("bytes")).first()
    n = min(RANGES, max(1, (size["bytes"] or 0) // RANGE_BYTES, size["rows"] // RANGE_ROWS))
    shares = [i / n for i in range(1, n)]
    found = docs.agg(F.percentile_approx(key, shares, max(10_000, 4 * n)).alias("b")).first()["b"] if shares else []
    bounds = F.split(F.lit(",".join(map(str, sorted(set(found or [0]))))), ",").cast("array<bigint>")  # folded to a literal
    rows = docs.withColumns({"_range": F.coalesce(-_range_of(key, bounds), F.lit(1)), "_u": F.shiftrightunsigned(F.xxhash64(text), 33)})
    many = rows.filter("_range % 2 <> 0").groupBy("_range").agg(F.expr(f"1 + count(*) div {4 * RANGE_ROWS}").alias("_parts"))
    many = many.filter("_parts > 1").withColumnRenamed("_range", "_r")
    rows = rows.join(F.broadcast(many), F.col("_range") == F.col("_r"), "left").withColumn("_part", F.coalesce(F.expr("shiftright(_u * _parts, 31)"), F.lit(0).cast("long"))).drop("_r", "_parts")
    inside = Window.partitionBy("_range", "_part").orderBy(F.col(key).desc_nulls_last(), "_u", F.length(text))
    whole = F.struct(*[F.col(c).alias(name) for name, c in taken.items()])
    rows = rows.withColumns({"_place": F.row_number().over(inside), "_next": F.lead(whole).over(inside)})
    first = rows.filter("_place = 1").select(F.col("_range").alias("r"), F.col("_part").alias("p"), whole.alias("_first"))
    # one row for each range or part of one, without texts, to learn which comes after which
    order, every = Window.orderBy("r", "p"), Window.partitionBy()
    chain = first.select("r", "p").withColumns({"number": F.row_number().over(order), "all": F.count(F.lit(1)).over(every)})
    ahead = first.join(chain.select("r", "p", F.expr("if(number = 1, all, number - 1)").alias("number")), ["r", "p"]).select("number", "_first")
    ahead = chain.select("r", "p", "number").join(ahead, "number")
    out = rows.join(ahead, (F.col("_range") == F.col("r")) & (F.col("_part") == F.col("p")))
    return shield.restored(out, id=F.col("number") * F.lit(1 << 40) + F.col("_place"), **{c: F.coalesce("_next", "_first")[c] for c in taken})


def op12(docs: DataFrame) -> DataFrame:
    """Every text of documents, the same with its second half replaced, and the next document: their fingerprints compared."""
    text = text_or_empty("text")
    docs = docs.select("doc_id", text.alias("text")).withColumn("keys", digests(F.col("text")))
    rows = with_next(docs, "doc_id", "text", "keys").withColumn("n_chars", F.length("text").cast("long"))
    half = F.expr("cast(n_chars div 2 as int)")
    rows = rows.withColumn("edited", F.concat(F.left("text", F.col("n_chars").cast("int") - half), F.left("next_text", half)))
    rows = rows.withColumn("edited_sha256", F.sha2("edited", 256))
    out = compare_texts(rows, "id", ["text", "edited", "next_text"], 2, {"text": "keys", "next_text": "next_carried"})
    at = lambda c, i: F.get(c, F.lit(i))
    return out.select("doc_id", "n_chars", "edited_sha256", at("fingerprints", 0).alias("fingerprint"), at("fingerprints", 1).alias("edited_fingerprint"), at("likeness", 0).alias("near_edited"), at("likeness", 1).alias("near_next"))


ORACLE = f"""
WITH o AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, row_number() OVER (ORDER BY doc_id DESC) AS r, count(*) OVER () AS c FROM documents),
e AS (SELECT o.doc_id, o.n, o.text AS t0, left(o.text, o.n - o.n // 2) || left(x.text, o.n // 2) AS t1, x.text AS t2 FROM o JOIN o x ON x.r = o.r % o.c + 1),
v AS (SELECT doc_id, unnest([0, 1, 2]) AS v, unnest([t0, t1, t2]) AS t FROM e),
l AS (SELECT doc_id, v, unnest(string_split(t, chr(10))) AS line FROM v),
q AS (SELECT doc_id, v, unnest(CASE WHEN length(line) > {LONG_LINE} THEN regexp_extract_all(line, '[^.!?]*[.!?]+|[^.!?]+') ELSE [line] END) AS p FROM l),
k AS (SELECT DISTINCT doc_id, v, ('0x' || substr(md5(trim(p, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), 1, {DIGITS}))::BIGINT AS key FROM q WHERE trim(p, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> ''),
s AS (SELECT v.doc_id, v.v, md5(v.t) AS seal, count(key) AS n, greatest({LEAST_LEVEL}, ceil(log2(greatest(count(key), 1) / 2.0)))::INT AS level FROM v LEFT JOIN k ON k.doc_id = v.doc_id AND k.v = v.v GROUP BY ALL),
c AS (SELECT s.doc_id, s.v, level, key, key % {PRIMES[0]} + key % {PRIMES[1]} * {1 << 30} AS chk FROM k JOIN s ON s.doc_id = k.doc_id AND s.v = k.v WHERE s.v < 2),
a AS (SELECT doc_id, v, tab, CASE tab {" ".join(f"WHEN {t} THEN (key >> {PLACE_BITS * t}) & ((1::BIGINT << level) - 1)" for t in range(TABLES))} END AS place, key, chk FROM c, (SELECT unnest(range({TABLES})) AS tab)),
g AS (SELECT doc_id, v, tab, place, count(*) AS n, bit_xor(key) AS key, bit_xor(chk) AS chk FROM a GROUP BY doc_id, v, tab, place),
f AS (SELECT doc_id, v, string_agg(':' || tab || '.' || lower(to_hex(place)) || '.' || lower(to_hex(n)) || '.' || lower(to_hex(key)) || '.' || lower(to_hex(chk)), '' ORDER BY tab, place) AS cells FROM g GROUP BY doc_id, v),
j AS (SELECT x.doc_id, y.v, count(*) AS both FROM k x JOIN k y ON x.doc_id = y.doc_id AND x.key = y.key WHERE x.v = 0 AND y.v > 0 GROUP BY x.doc_id, y.v),
z AS (SELECT s.doc_id, s.v, s.seal || ':' || s.level || coalesce(cells, '') AS print, CASE WHEN b.n + s.n = 0 THEN 1.0 ELSE coalesce(j.both, 0)::DOUBLE / (b.n + s.n - coalesce(j.both, 0)) END AS near
  FROM s JOIN s b ON b.doc_id = s.doc_id AND b.v = 0 LEFT JOIN f ON f.doc_id = s.doc_id AND f.v = s.v LEFT JOIN j ON j.doc_id = s.doc_id AND j.v = s.v)
SELECT e.doc_id, e.n::BIGINT AS n_chars, sha256(t1) AS edited_sha256, z0.print AS fingerprint, z1.print AS edited_fingerprint, z1.near::DOUBLE AS near_edited, z2.near::DOUBLE AS near_next
FROM e JOIN z z0 ON z0.doc_id = e.doc_id AND z0.v = 0 JOIN z z1 ON z1.doc_id = e.doc_id AND z1.v = 1 JOIN z z2 ON z2.doc_id = e.doc_id AND z2.v = 2
"""
