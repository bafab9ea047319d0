"""Pages and JSON-LD of any shape: no error, linear time."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from citegrid.functions import webscan
from citegrid.functions.markup import Markup, tidy


class Text(Markup):
    def __init__(self):
        super().__init__()
        self.parts, self.tags = [], []

    def handle_data(self, data):
        self.parts.append(data)

    def handle_starttag(self, tag, attrs):
        self.tags.append((tag, attrs))


def read(html):
    p = Text()
    p.read(html)
    return "".join(p.parts), p.tags


@pytest.mark.parametrize(
    "html,text,tags",
    [
        ("a < b <c", "a < b <c", []),
        ("<p>x<!-- <b> -->y", "xy", ["p"]),
        ("<p>x<!-- y", "x", ["p"]),
        ("<p>x<!-->y", "xy", ["p"]),
        ("x<![CDATA[y]]>z<![ q >w", "xzw", []),
        ("<p>a<![ temp [x]]>b", "ab", ["p"]),
        ("<a title='1 > 2'>x</a>", "x", ["a"]),
        ('<a title="open>x</a> y', "x y", ["a"]),
        ("<script>if (a < b) {}</script>x", "if (a < b) {}x", ["script"]),
        ("<p>x<script>never closed <b>", "x", ["p", "script"]),
        ("</ >x<?php y ?>z", "xz", []),
    ],
)
def test_broken_markup(html, text, tags):
    got, found = read(html)
    assert (got, [t for t, _ in found]) == (text, tags)


def test_tidy_keeps_whole_pages():
    page = '<!DOCTYPE html><html><body class="a b"><p>1 &lt; 2 &amp; <b>x</b></p><br/></body></html>'
    assert tidy(page) == page.removeprefix("<!DOCTYPE html>")


@pytest.mark.parametrize("piece,n", [("<a ", 300_000), ('<x y="', 200_000), ("a<", 300_000), ("<!--", 300_000), ("<![ x", 200_000), ("<script>", 100_000), ("</", 300_000)])
def test_linear_time(piece, n):
    begin = time.perf_counter()
    read(piece * n)
    read(piece * n + ">")
    assert time.perf_counter() - begin < 6


def test_deep_and_broken_json():
    for value in ([1, {"a": ["x\n", {}], "b": []}, []], {"k": {"doi": "10.1000/x"}}):
        assert webscan._deep(json.dumps(value).replace("1,", '"1",')) == json.loads(json.dumps(value).replace("1,", '"1",'))
    for bad in ("[", "[1 2]", '{"a"}', '{"a":}', "[,]", "[1,]", '{"a":1,}', "1 2", "", "]", "{1:2}", '["a":1]'):
        with pytest.raises(ValueError):
            webscan._deep(bad)
    deep = "[" * 200_000 + '{"doi": "10.1000/deep"}' + "]" * 200_000
    assert webscan.metadata(f'<script type="application/ld+json">{deep}</script>') == [{"signal": "json-ld:doi", "text": "10.1000/deep"}]


def test_no_page_fails_the_job(spark):
    rnd = random.Random(8)
    odd = ["<![ x", "<![1]>", "<!--", "<", ">", '"', "<a b='", "<script type=application/ld+json>", "</script>", "{", "[" * 3000, "&#xD800;", "\0", '<meta name="citation_doi" content="10.1/x">']
    rows = [(k, "".join(rnd.choice(odd) for _ in range(rnd.randint(0, 30)))) for k in range(1500)] + [(1, None)]
    pages = spark.createDataFrame(rows, "page_id long, html string")
    out = pages.select("page_id", F.explode_outer(webscan.page_dois(F.col("html"))).alias("m")).select("page_id", "m.*").collect()
    assert {r.page_id for r in out} == {k for k, _ in rows}
    assert "html-meta:citation_doi" in {r.signal for r in out}
    found = pages.select(F.explode(webscan.page_problems(F.col("html"))).alias("p")).distinct().collect()
    assert "JSON-LD that is no JSON" in {r.p for r in found}
