"""DOIs in the metadata of web pages and feeds. HTML and JSON-LD are parsed by the standard library, batch by batch."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citegrid.functions.markup import Markup
from citegrid.functions.vocab import META_NAMES

_FOUND = T.ArrayType(T.StructType([T.StructField("signal", T.StringType()), T.StructField("text", T.StringType())]))
#: Keys of a JSON-LD object whose strings are searched, and keys that lead to more objects.
_VALUES, _MORE = ("doi", "identifier", "sameas", "@id", "value"), ("@graph", "mainentity", "mainentityofpage")


class _Metadata(Markup):
    def __init__(self) -> None:
        super().__init__()
        self.found: list[dict] = []
        self.problems: list[str] = []
        self.script: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        a = dict(reversed(attrs))
        if tag == "meta":
            name = (a["name"] if a.get("name") is not None else a.get("property") or "").strip().lower()
            if name in META_NAMES and a.get("content") is not None:
                self.found.append({"signal": f"html-meta:{name}", "text": a["content"]})
        elif tag == "script" and a.get("type") == "application/ld+json":
            self.script = []

    def handle_data(self, data):
        if self.script is not None:
            self.script.append(data)

    def handle_endtag(self, tag):
        if tag == "script" and self.script is not None:
            try:
                walk(loads("".join(self.script)), self.found)
            except ValueError:
                self.problems.append("JSON-LD that is no JSON")
            self.script = None


_TOKEN = re.compile(r'[ \t\n\r]*(?:([\[\]{},:])|(")|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null|NaN|-?Infinity)|(\Z))')


def loads(text: str):
    """A JSON text as json.loads gives it, of any depth; numbers of a very deep one stay text."""
    try:
        return json.loads(text)
    except RecursionError:
        return _deep(text)


def _deep(text: str):
    """Without recursion: the open lists and objects are on a stack, each waiting for what may come next."""
    top: list = []
    stack: list = [top]
    key, wants, at = None, "value", 0  # wants: value, first (or the end), key, colon, more (or the end)
    while True:
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"no JSON at {at}")
        at, mark, here = m.end(), m[1], stack[-1]
        value = m[3]
        if m[2]:
            value, at = json.decoder.scanstring(text, at)
        if m[4] is not None:
            if len(stack) == 1 and wants == "more":
                return top[0]
            raise ValueError("the JSON text ends early")
        if mark in ("]", "}") and len(stack) > 1 and isinstance(here, list if mark == "]" else dict) and wants in ("more", "first"):
            stack.pop()
            wants = "more"
            continue
        if mark == "," and wants == "more" and len(stack) > 1:
            wants = "key" if isinstance(here, dict) else "value"
            continue
        if mark == ":" and wants == "colon":
            wants = "value"
            continue
        if isinstance(here, dict) and wants in ("first", "key") and m[2]:
            key, wants = value, "colon"
            continue
        if mark in ("[", "{"):
            value = [] if mark == "[" else {}
        if (mark and mark not in "[{") or wants not in ("value", "first") or (isinstance(here, dict) and wants == "first"):
            raise ValueError(f"unexpected JSON at {at}")
        if isinstance(here, dict):
            here[key] = value
        else:
            here.append(value)
        wants = "more"
        if mark:
            stack.append(value)
            wants = "first"


def _strings(value, found: list[dict], key: str) -> None:
    """Every string nested in a value."""
    stack = [value]
    while stack:
        v = stack.pop()
        if isinstance(v, str):
            found.append({"signal": f"json-ld:{key}", "text": v})
        elif isinstance(v, list):
            stack += reversed(v)
        elif isinstance(v, dict):
            stack += reversed(v.values())


def walk(value, found: list[dict]) -> None:
    """The searched strings of a JSON-LD document."""
    stack = [value]
    while stack:
        v = stack.pop()
        if isinstance(v, list):
            stack += reversed(v)
        elif isinstance(v, dict):
            for k, x in v.items():
                if k.lower() in _VALUES:
                    _strings(x, found, k.lower())
                if k.lower() in _MORE:
                    stack.append(x)


def _read(html: str | None) -> _Metadata:
    p = _Metadata()
    p.read(html)
    if p.script is not None:
        p.problems.append("JSON-LD without an end")
    return p


def metadata(html: str | None) -> list[dict]:
    return _read(html).found


@F.pandas_udf(_FOUND)
def page_dois(html: pd.Series) -> pd.Series:
    """ARRAY<STRUCT<signal, text>>: metadata of a page in which DOIs may stand. No page is an error: broken markup and
    JSON-LD are read as far as they go; see page_problems()."""
    return pd.Series([metadata(h) for h in html], dtype=object)


@F.pandas_udf(T.ArrayType(T.StringType()))
def page_problems(html: pd.Series) -> pd.Series:
    """What of a page's metadata could not be read, an empty array for most."""
    return pd.Series([_read(h).problems for h in html], dtype=object)


def atom_dois(xml: Column) -> Column:
    """The texts of all elements named doi, whatever their namespace, of a well-formed feed."""
    return F.xpath(xml, F.lit("//*[translate(local-name(), 'DOI', 'doi')='doi']/text()"))
