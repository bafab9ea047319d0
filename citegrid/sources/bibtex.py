"""BibTeX files as tables and back.

Files are read as text split where a line begins with ``@``, so one large file is read by many tasks like any text. A
small parser finds the entries of a piece, indented ones and several on a line too; text between entries is comment, and
an ``@`` that begins no whole entry is an error. A value with a line that begins with ``@`` is cut there: files with
pieces whose braces do not match are put together again, piece by piece in file order, as far as an entry goes. @string
macros hold from where they stand on, until they are defined anew, and may be made of earlier ones.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citegrid.functions.canonical import once
from citegrid.functions.vocab import SYSTEM_TYPES
from citegrid.storage import checkpoint

#: Months as macros.
MONTHS = {m: str(i) for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split(), 1)}
_HEAD = re.compile(r"@\s*([A-Za-z][\w-]*)\s*([{(])")
_NAME = re.compile(r"\s*([^\s=,{}()\"#%]+)\s*=\s*")
_SKIPPED = ("comment", "preamble")

_TOKEN = T.StructType([T.StructField("text", T.StringType()), T.StructField("is_macro", T.BooleanType())])
_FIELD = T.StructType([T.StructField("name", T.StringType()), T.StructField("tokens", T.ArrayType(_TOKEN))])
_ENTRY = T.StructType([T.StructField("kind", T.StringType()), T.StructField("key", T.StringType()), T.StructField("fields", T.ArrayType(_FIELD)), T.StructField("error", T.StringType())])


class BibtexError(ValueError):
    pass


class Unfinished(BibtexError):
    """The text ends within an entry."""


def _value(text: str, at: int) -> tuple[list[dict], int]:
    """The tokens of a value, parted by #, and where it ends."""
    tokens = []
    while True:
        while at < len(text) and text[at].isspace():
            at += 1
        if at >= len(text):
            raise Unfinished("a value is missing")
        if text[at] == "{":
            end = _closing(text, at)
            tokens.append({"text": text[at + 1 : end], "is_macro": False})
            at = end + 1
        elif text[at] == '"':
            end, depth = at + 1, 0
            while end < len(text) and (text[end] != '"' or depth):
                depth += (text[end] == "{") - (text[end] == "}")
                end += 2 if text[end] == "\\" else 1
            if end >= len(text):
                raise Unfinished("a quoted value does not end")
            tokens.append({"text": text[at + 1 : end], "is_macro": False})
            at = end + 1
        else:
            m = re.compile(r"[^\s,{}()\"#%=]+").match(text, at)
            if not m:
                raise BibtexError("a value is missing")
            tokens.append({"text": m[0], "is_macro": not m[0].isdigit()})
            at = m.end()
        while at < len(text) and text[at].isspace():
            at += 1
        if at < len(text) and text[at] == "#":
            at += 1
            continue
        return tokens, at


def _closing(text: str, at: int, close: str = "}") -> int:
    """Where the brace (or parenthesis) at ``at`` is closed. A backslash escapes the next character."""
    depth, at = 0, at + (close == ")")
    while at < len(text):
        c = text[at]
        if c == "\\":
            at += 1
        elif close == ")" and c == ")" and not depth:
            return at
        depth += (c == "{") - (c == "}")
        if close == "}" and not depth:
            return at
        at += 1
    raise Unfinished("braces do not match")


def _entry(text: str, head: re.Match) -> tuple[dict, int]:
    """The entry whose head was found, and where it ends."""
    kind, close, at = head[1].lower(), "}" if head[2] == "{" else ")", head.end()
    if kind in _SKIPPED:
        return {"kind": None, "key": None, "fields": [], "error": None}, _closing(text, at - 1, close) + 1
    key = None
    if kind != "string":
        k = re.compile(r"\s*([^\s,{}]+?)\s*(,|(?=[)}]))").match(text, at)
        if not k:
            raise BibtexError("the citation key is missing")
        key, at = k[1], k.end()
    fields = []
    while True:
        while at < len(text) and (text[at].isspace() or text[at] == ","):
            at += 1
        if at < len(text) and text[at] == close:
            return {"kind": kind, "key": key, "fields": fields, "error": None}, at + 1
        n = _NAME.match(text, at)
        if not n:
            raise (Unfinished if at >= len(text) else BibtexError)(f"a field is expected at character {at}")
        tokens, at = _value(text, n.end())
        fields.append({"name": n[1].lower(), "tokens": tokens})


def _broken(error: str) -> dict:
    return {"kind": "", "key": None, "fields": [], "error": error}


def entries_and_rest(text: str) -> tuple[list[dict], str | None, str | None]:
    """The entries of a text: kind, key, fields as tokens; comments and preambles are none. Then the text of the last one,
    if it ends within it, and what is wrong there. From the first that is broken on there is only its error."""
    out, at = [], 0
    while (at := text.find("@", at)) >= 0:
        try:
            head = _HEAD.match(text, at)
            if not head:
                raise BibtexError(f"no entry begins at {text[at : at + 20]!r}")
            entry, at = _entry(text, head)
        except Unfinished as e:
            return out, text[at:], str(e)
        except BibtexError as e:
            return [*out, _broken(str(e))], None, None
        if entry["kind"] is not None:
            out.append(entry)
    return out, None, None


def entries_of(text: str) -> list[dict]:
    """The entries of a whole text."""
    out, rest, error = entries_and_rest(text)
    return out if rest is None else [*out, _broken(error)]


@F.pandas_udf(T.ArrayType(_ENTRY))
def _entries(text: pd.Series) -> pd.Series:
    return pd.Series([entries_of(t or "") for t in text], dtype=object)


@F.pandas_udf(T.ArrayType(_ENTRY))
def _entries_of_pieces(columns: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Entries of the pieces of files, which come in order: all but a file's first one were cut after their ``@``."""
    before = None
    for files, blocks, texts in columns:
        out = []
        for file, block, text in zip(files, blocks, texts):
            first = file != before and block == 0
            before = file
            out.append(entries_of(text if first else "@" + text))
        yield pd.Series(out, dtype=object)


# Spark would filter on the result before it explodes it, and so call them twice, the second time without the pieces in between.
_entries, _entries_of_pieces = _entries.asNondeterministic(), _entries_of_pieces.asNondeterministic()


_OPEN, _SHUT = r"(?<!\\)(?:\\\\)*\{", r"(?<!\\)(?:\\\\)*\}"


def _cut(text: Column) -> Column:
    """Whether a piece may end within an entry: its braces do not match, or an entry in parentheses does not end with one."""
    return (F.regexp_count(text, F.lit(_OPEN)) != F.regexp_count(text, F.lit(_SHUT))) | (F.rlike(text, F.lit(r"(?s)^@?\s*[A-Za-z][\w-]*\s*\(")) & ~F.rlike(text, F.lit(r"(?s)\)\s*$")))


def _put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, at, text) in file order -> the same, texts ending with an entry: what ends within one takes in the pieces that
    follow until it is whole. One entry is in memory at a time; an entry that never ends takes in the rest of its file."""
    now, at, held, depth = None, None, [], 0
    made: list[tuple] = []

    def level(text: str) -> int:
        return sum((c[-1] == "{") - (c[-1] == "}") for c in _BRACE.findall(text) if len(c) % 2)

    def flush() -> None:
        if held:
            made.append((now, at, "".join(held)))
            held.clear()

    for batch in batches:
        for file, place, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if file != now:
                flush()
            begins = "@" if file == now else ""  # a file's first piece was not cut behind one
            if held:
                held.append("\n@" + text)
            else:
                now, at, depth = file, place, 0
                held.append(begins + text)
            depth += level(held[-1])
            if depth <= 0 and entries_and_rest("".join(held))[1] is None:
                flush()
        if made:
            yield _pieces(made)
            made.clear()
    flush()
    if made:
        yield _pieces(made)


_BRACE = re.compile(r"\\*[{}]")
_PIECE = pa.schema([("file", pa.string()), ("at", pa.struct([("block", pa.int64()), ("row", pa.int64())])), ("text", pa.string())])


def _pieces(made: list[tuple]) -> pa.RecordBatch:
    """Rows of one schema: all batches of a task must have the same."""
    return pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], _PIECE.field(i).type) for i in range(3)], schema=_PIECE)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _macro_values(definitions: pd.Series) -> pd.Series:
    """The values of a file's macros, JSON of (name, tokens) in file order, each made of texts and of earlier ones; null with
    an unknown one."""

    def of(text: str) -> list[str | None]:
        known, out = dict(MONTHS), []
        for d in json.loads(text):
            parts = [known.get(t["text"].lower()) if t["is_macro"] else t["text"] for t in d.get("tokens", [])]
            out.append(None if None in parts else "".join(parts))
            known[d["name"]] = out[-1]
        return out

    return pd.Series(list(map(of, definitions)), dtype=object)


def _macros(entries: DataFrame) -> DataFrame:
    """file -> ``macros``: of each name its values with where they are defined, in file order."""
    each = entries.filter("e.kind = 'string'").select("file", "at", F.posexplode("e.fields").alias("i", "f"))
    listed = each.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("at", "i", F.col("f.name").alias("name"), F.col("f.tokens").alias("tokens")))).alias("d"))
    values = listed.select("file", "d", _macro_values(F.to_json(F.transform("d", lambda x: F.struct(x["name"].alias("name"), x["tokens"].alias("tokens"))))).alias("v"))
    defined = values.select("file", F.posexplode("d").alias("k", "x"), "v").select("file", F.struct(F.col("x.at").alias("at"), "k", F.get("v", F.col("k")).alias("value")).alias("x"), F.col("x.name").alias("name"))
    names = defined.groupBy("file", "name").agg(F.array_sort(F.collect_list("x")).alias("x"))
    return names.groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("name", "x"))).alias("macros"))


def _resolved(macros: Column) -> Column:
    months = F.create_map(*[F.lit(x) for kv in MONTHS.items() for x in kv])
    own = lambda name: F.try_element_at(F.filter(F.try_element_at(macros, name), lambda x: x["at"] < F.col("at")), F.lit(-1))["value"]
    unknown = lambda t: F.raise_error(F.concat(F.lit("unknown BibTeX macro: "), t["text"])).cast("string")
    text = lambda t: F.when(~t["is_macro"], t["text"]).otherwise(F.coalesce(own(F.lower(t["text"])), F.try_element_at(months, F.lower(t["text"])), unknown(t)))
    return F.transform("e.fields", lambda f: F.struct(f["name"].alias("key"), F.array_join(F.transform(f["tokens"], text), "").alias("value")))


def parse(texts: DataFrame) -> DataFrame:
    """(file, at, text) -> file, at (with the entry's number in the text), entry_type, entry_key, fields: the entries of
    the texts, without macros, comments and preambles.

    A broken entry or an unknown macro fails the query. Of fields named twice in an entry the last counts. Parsing takes
    much longer than reading, so texts are dealt over all tasks first; for macros only texts that may define one are parsed.
    """
    dealt = lambda t: t.repartition("file", "at").select("file", "at", _entries(F.col("text")).alias("es"))
    return _records(dealt(texts), dealt(texts.filter(F.contains(F.lower("text"), F.lit("string")))))


def _records(parsed: DataFrame, defining: DataFrame | None = None) -> DataFrame:
    """``defining``: those of parsed that may hold macros, if that is less than all."""

    def each(of: DataFrame) -> DataFrame:
        e = of.select("file", "at", F.posexplode("es").alias("n", "e")).withColumn("at", F.struct("at.*", F.col("n").alias("entry")))
        return e.withColumn("e", F.when(F.col("e.error").isNull(), F.col("e")).otherwise(F.raise_error(F.concat(F.lit("BibTeX entry in "), "file", F.lit(": "), "e.error")).cast(_ENTRY)))

    e = each(parsed)
    none = F.create_map().cast("map<string,array<struct<at:struct<block:bigint,row:bigint,entry:int>,k:int,value:string>>>")
    out = e.filter("e.kind <> 'string'").join(_macros(e if defining is None else each(defining)), "file", "left").withColumn("macros", F.coalesce("macros", none))
    pairs = _resolved(F.col("macros"))
    last = F.map_from_entries(once(pairs, lambda all_: F.filter(all_, lambda p, i: ~F.exists(F.slice(all_, i + 2, F.size(all_)), lambda q: q["key"] == p["key"]))))
    return out.select("file", "at", F.col("e.kind").alias("entry_type"), F.col("e.key").alias("entry_key"), last.alias("fields"))


def _parsed(spark: SparkSession, *paths: str) -> DataFrame:
    raw = spark.read.option("lineSep", "\n@").text(list(paths)).select(F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("at"), F.col("value").alias("text"))
    pieces = raw.select("file", "at", _entries_of_pieces(F.col("file"), F.col("at.block"), F.col("text")).alias("es"))
    cut = checkpoint(raw.filter(_cut(F.col("text"))).select(F.col("file").alias("_file")).distinct())
    if cut.isEmpty():
        return pieces
    again = raw.join(cut, F.col("file") == F.col("_file"), "left_semi")
    whole = again.repartition("file").sortWithinPartitions("file", "at").mapInArrow(_put_together, "file string, at struct<block:bigint,row:bigint>, text string")
    return pieces.join(cut, F.col("file") == F.col("_file"), "left_anti").unionByName(whole.select("file", "at", _entries(F.col("text")).alias("es")))


def read(spark: SparkSession, *paths: str) -> DataFrame:
    """Records of BibTeX files: file, at (their order in the file), entry_type, entry_key, fields.

    Files are parsed once, when this is called: macros, records and checked() read what was parsed.
    """
    return _records(checkpoint(_parsed(spark, *paths)))


def scan(spark: SparkSession, *paths: str) -> DataFrame:
    """The entries of files as they stand, broken ones with their error: file, at, kind, key, error."""
    e = _parsed(spark, *paths).select("file", "at", F.posexplode("es").alias("n", "e"))
    return e.select("file", F.struct("at.*", F.col("n").alias("entry")).alias("at"), "e.kind", "e.key", "e.error")


def duplicate_keys(records: DataFrame) -> DataFrame:
    """Ordinary keys that stand more than once, with the files they stand in."""
    ordinary = records.filter(~F.col("entry_type").isin(*SYSTEM_TYPES))
    return ordinary.groupBy("entry_key").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("file")).alias("files")).filter("n > 1")


def checked(records: DataFrame) -> DataFrame:
    """records, if no ordinary key stands twice; otherwise an error that names one and its files."""
    bad = duplicate_keys(records).limit(1).collect()
    if bad:
        raise BibtexError(f"duplicate citation key {bad[0]['entry_key']} in {', '.join(bad[0]['files'])}")
    return records


def render(entry_type: Column, entry_key: Column, fields: Column) -> Column:
    """A record as BibTeX text, fields by name."""
    line = lambda e: F.concat(F.lit("  "), e["key"], F.lit(" = {"), e["value"], F.lit("},\n"))
    return F.concat(F.lit("@"), entry_type, F.lit("{"), entry_key, F.lit(",\n"), F.array_join(F.transform(F.array_sort(F.map_entries(fields)), line), ""), F.lit("}\n"))


def write(records: DataFrame, path: str) -> None:
    """Write records as BibTeX text files."""
    records.select(render(F.col("entry_type"), F.col("entry_key"), F.col("fields"))).write.mode("overwrite").text(path)


# Editing text in place: everything but the edited fields stays as it is.


def field_spans(text: str) -> dict[str, tuple[int, int, int, int]]:
    """Per field of an entry's text: where it begins and ends (with its comma), and where its value does."""
    m = _HEAD.search(text)
    k = re.compile(r"\s*([^\s,{}]+)\s*,?").match(text, m.end()) if m else None
    if not k:
        raise BibtexError("no entry")
    at, close, out = k.end(), "}" if m[2] == "{" else ")", {}
    while True:
        while at < len(text) and (text[at].isspace() or text[at] == ","):
            at += 1
        if at >= len(text) or text[at] == close:
            return out
        start = at
        n = _NAME.match(text, at)
        if not n:
            raise (Unfinished if at >= len(text) else BibtexError)(f"a field is expected at character {at}")
        _, end = _value(text, n.end())
        while text[end - 1].isspace():
            end -= 1
        comma = re.compile(r"\s*,").match(text, end)
        if n[1].lower() in out:
            raise BibtexError(f"field {n[1]} stands twice")
        out[n[1].lower()] = (start, comma.end() if comma else end, n.end(), end)
        at = comma.end() if comma else end


def edit_entry(text: str, updates: dict[str, str | None]) -> str:
    """The entry's text with fields replaced, added at its end, or (value None) removed, its layout kept."""
    spans, edits, new = field_spans(text), [], []
    for name, value in updates.items():
        if name in spans:
            start, stop, a, b = spans[name]
            if value is None:
                begin = start
                while begin and text[begin - 1] in " \t":
                    begin -= 1
                edits.append((begin - (begin > 0 and text[begin - 1] == "\n"), stop, ""))
            else:
                edits.append((a, b, "{" + value + "}"))
        elif value is not None:
            new.append(f"  {name} = {{{value}}},")
    if new:
        kept = [s for n, s in spans.items() if not (n in updates and updates[n] is None)]
        end = text.rstrip().rfind("}" if _HEAD.search(text)[2] == "{" else ")")
        if kept and (tail := max(kept, key=lambda s: s[1])) and text[tail[1] - 1] != ",":
            edits.append((tail[1], tail[1], ","))
        body = text[:end].rstrip()
        edits.append((len(body), end, "\n" + "\n".join(new) + "\n"))
    for a, b, value in sorted(edits, reverse=True):
        text = text[:a] + value + text[b:]
    return text


def entry_spans(text: str) -> dict[str, tuple[int, int]]:
    """Where each entry of a file's text begins and ends, by key; a key that stands twice is an error."""
    out, at = {}, 0
    while (at := text.find("@", at)) >= 0:
        head = _HEAD.match(text, at)
        if not head:
            raise BibtexError(f"no entry begins at {text[at : at + 20]!r}")
        start = at
        entry, at = _entry(text, head)
        if entry["key"] is not None:
            if entry["key"] in out:
                raise BibtexError(f"duplicate citation key {entry['key']}")
            out[entry["key"]] = (start, at)
    return out


def replace_entry(text: str, key: str, entry: str) -> str:
    """A file's text with the entry of ``key`` swapped for another whole one; everything around it stays."""
    spans = entry_spans(text)
    if key not in spans:
        raise BibtexError(f"no entry {key}")
    if [e["error"] for e in entries_of(entry)] != [None]:
        raise BibtexError("the replacement is not one entry")
    start, end = spans[key]
    return text[:start] + entry.strip() + text[end:]


def edit_file(text: str, updates: dict[str, dict[str, str | None]]) -> str:
    """A file's text with fields of several entries updated (see edit_entry), all else as it is. The result is parsed
    again, so that no edit leaves a text that reads otherwise."""
    spans = entry_spans(text)
    if missing := sorted(set(updates) - set(spans)):
        raise BibtexError(f"no entry {missing[0]}")
    for key in sorted(updates, key=lambda k: -spans[k][0]):
        start, end = spans[key]
        text = text[:start] + edit_entry(text[start:end], updates[key]) + text[end:]
    if set(entry_spans(text)) != set(spans):
        raise BibtexError("the edited text reads otherwise")
    return text


def mark_file(text: str, markers: dict[str, str | None]) -> str:
    """A file's text with the integrity markers of entries set, or (None) taken out, their layout kept."""
    return edit_file(text, {key: {"integrity": marker} for key, marker in markers.items()})


@F.pandas_udf(T.StringType())
def marked(text: pd.Series, markers: pd.Series) -> pd.Series:
    """mark_file for columns: a map of markers by key, a null one taking the marker out."""
    return pd.Series([mark_file(t, dict(m or {})) for t, m in zip(text, markers)], dtype=object)


@F.pandas_udf(T.StringType())
def replaced(text: pd.Series, key: pd.Series, entry: pd.Series) -> pd.Series:
    """replace_entry for columns."""
    return pd.Series([replace_entry(t, k, e) for t, k, e in zip(text, key, entry)], dtype=object)


@F.pandas_udf(T.StringType())
def edited(text: pd.Series, updates: pd.Series) -> pd.Series:
    """edit_entry for columns: a map of updates, a null value removing its field."""
    return pd.Series([edit_entry(t, dict(u or {})) for t, u in zip(text, updates)], dtype=object)
