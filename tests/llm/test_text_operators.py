"""Quality rules, HTML extraction, chat windows, language ID."""

import hashlib
import random
import re
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from citegrid.llm import chat, common, html, langid, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- quality rules


def brute_repeat(words, n=5):
    grams = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
    hit = set()
    for i, g in enumerate(grams):
        if grams.count(g) > 1:
            hit |= set(range(i, i + n))
    return len(hit)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=40))
def test_repeat_words(words):
    assert quality.repeat_words(words) == brute_repeat(words)


def test_repeat_words_many_distinct():
    words = [f"w{i}" for i in range(9000)] + [f"w{i}" for i in range(100, 110)]
    assert quality.repeat_words(words) == 20


def test_line_rules(spark):
    unique = lambda i: " ".join(f"w{i * 100 + k}" for k in range(12))
    rows = [(i, "h1", unique(i) + "\nShare  this PAGE\n" + unique(i + 500)) for i in range(30)]
    rows += [(100, "h1", "share this page\n" * 3 + "a b c d e f g h i j"), (101, "h2", unique(900) + "\nshare this page"), (102, None, None), (103, "h1", ""), (104, "h2", "x\n\n x")]
    df = spark.createDataFrame([(i, h, t, "clash", 1) for i, h, t in rows], "doc_id long, source string, text string, _key string, n_words int")
    out = {r.doc_id: r for r in quality.filter_lines(df, min_docs=10, share=0.05).collect()}
    assert len(out) == len(rows) and out[0]["_key"] == "clash"
    assert out[0].kept and "PAGE" not in out[0].clean_text and out[0].removed_words == 3
    assert not out[100].kept and out[100].n_dup_lines == 2
    assert out[101].clean_text.endswith("share this page")  # frequent on another host only
    assert out[102].n_words == 0 and out[102].base_failed and not out[102].kept and not out[103].kept
    assert out[104].n_dup_lines == 0 and out[104].n_words == 2
    assert quality.filter_lines(df.limit(0)).count() == 0


def test_line_rules_brute(spark):
    import random

    rnd = random.Random(3)
    pool = [" ".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 4))) for _ in range(25)]
    rows = [(i, rnd.choice("xy"), "\n".join(rnd.choice(pool) for _ in range(rnd.randint(1, 12)))) for i in range(60)]
    got = {r.doc_id: r for r in quality.filter_lines(spark.createDataFrame(rows, "doc_id long, source string, text string"), min_docs=3, share=0.2).collect()}
    hosts = {h: [t for _, g, t in rows if g == h] for h in "xy"}
    often = {(h, l) for h, ts in hosts.items() for l in pool if (c := sum(l in t.split("\n") for t in ts)) > 3 and c > 0.2 * len(ts)}
    for i, h, t in rows:
        n, gone = len(WORD.findall(t)), sum(len(l.split()) for l in t.split("\n") if (h, l) in often)
        assert got[i].removed_words == gone and got[i].n_repeat_words == brute_repeat(t.split())
        assert got[i].kept == (not got[i].base_failed and n - gone >= 10 and 2 * (n - gone) >= n)


def test_line_rules_count_documents_not_rows(spark):
    own = "\n".join(f"alpha beta gamma delta {w} {w}x {w}y" for w in "abcdef")
    rows = [(1, "h", own)] * 12 + [(i, "h", f"some other words here in line {i}, and more of them follow {i}") for i in range(2, 40)] + [(None, "h", own), (50, None, None), (50, "h", ""), (51, None, "x\n" * 3)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumns({"_key": F.lit(1), "_own": F.lit(2), "kept": F.lit("old")})
    out = quality.filter_lines(df).collect()
    assert len(out) == len(rows) and all(r.removed_words == 0 for r in out)  # twelve rows of one key are one document
    often = [(i, "h", own) for i in range(12)] + [(100 + i, "h", f"another text of words {i} that goes on and on") for i in range(10)] + [(3, "h", own)]
    out = quality.filter_lines(spark.createDataFrame(often, "doc_id long, source string, text string")).collect()
    assert {r.removed_words for r in out if r.doc_id < 12} == {42} and not any(r.kept for r in out if r.doc_id < 12)
    assert quality.filter_lines(df.limit(0)).count() == 0


# --- HTML


def test_html_article():
    page = """<html><head><title>T</title><script>var a = "<p>no</p>";</script></head><body><header><h1>Site</h1></header><nav><a href=/>Home</a></nav>
    <div class="cookie-notice">We use cookies, lots of them, for many long reasons indeed.</div><article><header><h1>Title &amp; more</h1></header><p>First   <b>bold</b>
    text &lt;here&gt; that is long enough.<br>Next line<p>Second &eacute;. <a href=x>link</a></p><div class="ad">Buy</div><ul><li>one</li><li>two</li></ul><form>mail <input></form>
    <section id="comments"><p>A comment that is quite long, as comments are, but not of the article.</p></section></article><aside>Side</aside><footer>&copy; us</footer>"""
    assert html.main_blocks(page) == ["Title & more", "First bold text <here> that is long enough. Next line", "Second é. link", "one", "two"]


def test_html_without_article():
    page = "<body><div class=menu><a>a</a><a>b</a></div><div id=content><h1>Head</h1>" + "".join(f"<p>Paragraph {i} with a fair number of words in it, as text has.</p>" for i in range(5)) + "</div><div class='sidebar'><p>Not this text which is long as well, to be sure.</p></div></body>"
    blocks = html.main_blocks(page)
    assert blocks[0] == "Head" and len(blocks) == 6 and "Not this" not in " ".join(blocks)


@pytest.mark.parametrize("page", [None, "", "<", "<p", "plain", "<nav>x</nav>", "<p>a<p>b</div></p></article>", "&#0;&#x110000;&bogus;", "<article>" * 300 + "deep"])
def test_html_odd(page):
    assert isinstance(html.main_blocks(page), list)


def test_html_parts():
    assert np.allclose(html.smooth(np.ones(7)), 1) and html.smooth(np.array([0.0, 9, 0]))[1] < 9
    assert 1 < html.cluster_threshold(np.array([1.0, 1, 9, 9])) < 9


PARAGRAPH = "A paragraph of the article that has a fair number of words in it, as text has."
LONG = " ".join([PARAGRAPH] * 12)


def test_html_paragraphs_in_boxes_of_their_own():
    """No article: each paragraph in a div, headings in sections, one paragraph far longer than the others."""
    body = "<section><h2>First part</h2></section>" + f"<div class=par><p>{LONG}</p></div>" + "".join(f"<div class=par><p>{i} {PARAGRAPH}</p></div>" for i in range(4)) + "<section><h2>Second part</h2></section>" + f"<div class=par><p>Short one.</p></div><div class=par><p>9 {PARAGRAPH}</p></div><div class=par><p>End.</p></div>"
    page = f"<body><div id=bar><a href=/>Home</a> <a href=/x>News</a></div><div id=wrap>{body}</div><div id=low><a href=/t>Terms</a> <a href=/p>Privacy</a></div><div>All rights reserved.</div></body>"
    assert html.main_blocks(page) == ["First part", LONG, *[f"{i} {PARAGRAPH}" for i in range(4)], "Second part", "Short one.", f"9 {PARAGRAPH}", "End."]


def test_html_regions_inside_a_container():
    tail = "<p><a href=/t>Terms of use</a></p><p><a href=/p>Privacy</a></p><p>Prices may change.</p>"
    body = "<h1>Head</h1>" + "".join(f"<p>{i} {PARAGRAPH}</p>" for i in range(4)) + "<p><a href=/more>A link alone</a></p><p>Short.</p>" + f"<p>8 {PARAGRAPH}</p><p>End.</p>"
    blocks = html.main_blocks(f"<article><p><a href=/>All articles</a></p>{body}{tail}</article>")
    assert blocks == ["Head", *[f"{i} {PARAGRAPH}" for i in range(4)], "A link alone", "Short.", f"8 {PARAGRAPH}", "End."]


@pytest.mark.parametrize("around", ['<div class="post share-price">{}</div>', "<form id=f method=post>{}</form>", '<div class="related-work legal"><article>{}</article></div>', '<div class=header><div>{}</div></div>'])
def test_html_misleading_names(around):
    body = f"<h1>Head</h1><p>{PARAGRAPH}</p><p>{PARAGRAPH}</p>"
    assert html.main_blocks("<body><nav><a>x</a></nav>" + around.format(body) + "<div class=sidebar><p>Some text at the side, of a few words.</p></div></body>") == ["Head", PARAGRAPH, PARAGRAPH]


def test_html_comments_longer_than_the_article():
    page = f"<body><div id=main><h1>Head</h1><p>{PARAGRAPH}</p><p>1 {PARAGRAPH}</p></div><div id=comments>" + f"<p>{LONG}</p>" * 3 + "</div></body>"
    assert html.main_blocks(page) == ["Head", PARAGRAPH, f"1 {PARAGRAPH}"]


def test_html_ratios_decide(monkeypatch):
    """Smoothing and clustering against brute force; without the threshold other lines are chosen."""
    page = "<body>" + "".join(f"<div><a>link {i}</a> <a>b</a></div>" for i in range(5)) + f"<div id=t><p>{PARAGRAPH}</p><p>{LONG}</p></div>" + "<div><a>more links</a></div>" * 5 + "<div>word</div></body>"
    rng = np.random.default_rng(2)
    for _ in range(50):
        x = rng.random(int(rng.integers(1, 40))) * rng.integers(0, 2, 1)
        w = lambda d: np.exp(-d * d / 2) if abs(d) <= 3 else 0.0
        brute = [sum(w(i - j) * v for j, v in enumerate(x)) / sum(w(i - j) for j in range(len(x))) for i in range(len(x))]
        assert np.allclose(html.smooth(x), brute)
        v = np.sort(np.concatenate([rng.normal(1, 0.1, 8), rng.normal(5, 0.3, 5)]))
        best = min(range(1, len(v)), key=lambda k: v[:k].var() * k + v[k:].var() * (len(v) - k))
        assert v[best - 1] < html.cluster_threshold(v) < v[best]
    assert html.main_blocks(page) == [PARAGRAPH, LONG]
    monkeypatch.setattr(html, "cluster_threshold", lambda values: -1.0)
    assert html.main_blocks(page) != [PARAGRAPH, LONG]


def test_html_is_linear():
    import time

    start = time.perf_counter()
    html.main_blocks("<b>" * 150_000 + "</i>" * 150_000)
    html.main_blocks("<i>" + "<b>" * 100_000 + "</i></p>" * 50_000 + "<div>" * 50_000 + "x" + "<p>y" * 20_000)
    assert time.perf_counter() - start < 30


def test_html_frame(spark):
    df = spark.createDataFrame([(1, "u", None), (2, "u", "<p>Hello  you</p>")], "page_id long, url string, html string")
    assert [(r.text, r.n_chars) for r in html.op2(df).orderBy("page_id").collect()] == [("", 0), ("Hello you", 9)]
    assert html.op2(df.limit(0)).count() == 0 and html.op2(df.unionByName(df)).count() == 4
    clash = html.extract(df.withColumns({"text": F.lit(7), "in0__": F.lit(1)})).orderBy("page_id").collect()
    assert [(r.text, r.in0__) for r in clash] == [("", 1), ("Hello you", 1)]


# --- chat


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="<[|\\/s>INST]YimtarUend_ \n", max_size=30))
def test_escape_roundtrip(text):
    assert chat.unescape(chat.escape(text)) == text
    part, a, b = chat.format_turn("user", text)
    assert chat.parse_window(part + part) == [("user", text)] * 2 and chat.unescape(part[a:b]) == text


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="a\\\n<|im_end|>n", max_size=12))
def test_roles_roundtrip(role):
    assert chat.parse_window(chat.format_turn(role, "x")[0]) == [(role, "x")]


def test_windows(spark):
    rows = [(1, 0, "system", "be kind")] + [(1, i, "user" if i % 2 else "assistant", f"turn {i} " + "w " * 20) for i in range(1, 21)]
    rows += [(2, 0, "user", None), (2, 1, "assistant", "</s>[INST] <|im_end|> ok"), (2, 2, None, "n"), (3, 0, "assistant", "long " * 200), (None, 0, "assistant", "x"), (2, 1, "assistant", "</s>[INST] <|im_end|> ok")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    w = chat.format_windows(df, budget=120, history=2, history_share=0.5)
    windows = [r for r in w.collect() if r.conv_id == 1]
    assert len(windows) > 3 and all(r.n_tokens <= 120 for r in windows)
    assert all(chat.parse_window(r.text)[0] == ("system", "be kind") for r in windows)
    assert windows[1].n_repeated >= 2 and [r.window for r in windows] == list(range(len(windows)))
    got = {r.conv_id: r for r in chat.read_back(w).collect()}
    again = {r.conv_id: r for r in chat.read_back(w, in_order=True).collect()}
    assert got == again and set(got) == {1, 2, 3, None}
    for c in got:
        turns = sorted(((t, r or "", x or "") for i, t, r, x in rows if i == c))
        assert got[c].n_turns == len(turns) and got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert got[c].loss_chars == len(loss) and got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.read_back(chat.format_windows(df.limit(0))).count() == 0


def test_probe_conversation(spark):
    df = spark.createDataFrame([(5, 0, "user", "hi")], "conv_id long, turn long, role string, text string")
    r = {x.conv_id: x for x in chat.op4(df).collect()}
    assert r[-1].n_turns == 2 and r[-1].loss_chars == len("</s>[INST] ok [/INST]") and len(r) == 2


# --- language ID


def test_langid(spark):
    texts = {"a": "the cat and the dog sat there with them", "b": "der hund und die katze sitzen dort zusammen"}
    rows = [(i, f"{texts[l]} {i}", l) for i, l in enumerate("ab" * 40)] + [(900, None, "a"), (901, "", "b"), (902, "123 --", None), (903, "the dog and cat " * 3000, None)]
    df = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, score double")
    out = {r.doc_id: r for r in langid.op6(df).collect()}
    assert len(out) == len(rows) and all(out[i].lang_pred == l for i, _, l in rows[:80])
    assert [out[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and out[900].score == 0 and out[903].lang_pred == "a"
    assert all(0 <= r.score <= 1 for r in out.values())
    kept = langid.keep_identified(df)
    assert kept.columns == df.columns and kept.count() == 81 and {r.score for r in kept.collect()} == {0.5}
    assert langid.op6(df.limit(0)).count() == 0
    none = langid.op6(df.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in none.collect()} == {"und"}


def test_langid_learns_rare_languages_from_a_sample(spark):
    df = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 1000 = 7 THEN 'rare' WHEN id % 3 = 0 THEN 'aa' ELSE 'bb' END AS lang", "CASE WHEN id % 1000 = 7 THEN 'qq' WHEN id % 3 = 0 THEN 'ab' ELSE 'cd' END AS text")
    langs, matrix = langid.fit(df, sample_rows=60)
    assert langs == ["aa", "bb", "rare"] and matrix.shape == (1 << langid.BITS, 3)
    assert langid.fit(df.filter("lang = 'rare'"))[1][:, 0].tolist() == matrix[:, 2].tolist()  # learnt whole


def test_langid_batches_are_independent():
    rng = np.random.default_rng(0)
    matrix = rng.random((1 << langid.BITS, 3)).astype(np.float32)
    texts = ["abc def", "é", "x" * 50, "Zwei Wörter"]
    whole = langid._log_likelihoods(texts, matrix)
    for i, t in enumerate(texts):
        assert np.allclose(whole[i], langid._log_likelihoods([t], matrix)[0])
        p = langid.code_points(t)
        brute = sum(matrix[b].sum(axis=0, dtype=np.float64) for b in langid.ngram_buckets(p))
        assert np.allclose(whole[i], brute)


def test_langid_long_texts_in_pieces(monkeypatch):
    rng = np.random.default_rng(1)
    matrix = rng.random((1 << langid.BITS, 2)).astype(np.float32)
    text = "Der Hund, İstanbul und Zwei Wörter " * 9
    grams = lambda: sum(np.bincount(b[:begin], minlength=1 << langid.BITS) for points, begin in langid.pieces_of(text) for b in langid.ngram_buckets(points))
    whole, score = grams(), langid._log_likelihoods([text], matrix)
    for size in (1, 2, 7, 50):
        monkeypatch.setattr(langid, "CHUNK", size)
        if size > 2:
            assert np.array_equal(grams(), whole) and np.allclose(langid._log_likelihoods([text], matrix), score)


def test_langid_of_many_languages(spark):
    rows = [(i, f"w{i % 700}x w{i % 700}y w{i % 700}z " * 5, f"l{i % 700:03d}") for i in range(1400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langs, matrix = langid.fit(df)
    assert len(langs) == 700 and matrix.shape == (1 << 14, 700)
    right = langid.predict(df, (langs, matrix)).filter("lang = lang_pred").count()
    assert right >= 1300 and langid.fit(df.limit(0))[0] == []


# --- shared helpers


def test_intermediates_go(spark):
    import os

    df = common.written(spark.range(3).toDF("x"), "probe")
    path = df.inputFiles()[0].removeprefix("file://").rpartition("/")[0]
    assert df.count() == 3 and os.path.isdir(path)
    common.discard_intermediates(spark)
    assert not os.path.exists(path)



def test_hash_words(monkeypatch):
    monkeypatch.setattr(common, "HASH_BYTES", 64)
    texts = [None, "", "  a\tB c ", "É é x " * 40, "a", "one two, three-four"]
    got = common.hash_words(texts)
    assert [len(g) for g in got] == [0, 0, 3, 120, 1, 3]
    known = {}
    for t, g in zip(texts, got):
        for w, h in zip((t or "").lower().split(), g.tolist()):
            assert known.setdefault(w, h) == h
    assert len(set(known.values())) == len(known)
    assert [len(g) for g in common.hash_words(texts, ",-")] == [0, 0, 3, 120, 1, 4]


# --- pages that are broken, and articles with links


def article(*blocks):
    return "<html><body><nav><a href=x>Home</a></nav><article>" + "".join(blocks) + "</article><footer>c</footer></body></html>"


BLOCK = "<p>" + "A paragraph of the article, which says something and goes on for a while. " * 3 + "</p>"


@pytest.mark.parametrize(
    "blocks,expected",
    [
        ((BLOCK, BLOCK, "<h2>Sources</h2><ul><li><a href=a>Report one</a></li><li><a href=b>Report two</a></li></ul>"), ["Sources", "Report one", "Report two"]),
        (("<h1>Title</h1><p><a href=x>A linked first paragraph</a></p>", BLOCK, "<p><a href=y>Mostly a link at the</a> end</p>"), ["Title", "A linked first paragraph", "Mostly a link at the end"]),
        ((BLOCK, "<p class='legal note'>The court ruled so.</p><p class=popular>It was.</p>", BLOCK), ["The court ruled so.", "It was."]),
        ((BLOCK, BLOCK, "<h3>3 comments</h3><p>Bob: " + "nice " * 50 + "</p>"), []),
        ((BLOCK * 4, "<div class='newsletter'><p>Subscribe now</p></div>", BLOCK * 4), []),
    ],
)
def test_blocks_of_an_article(blocks, expected):
    text = " ".join(html.main_blocks(article(BLOCK))[0].split())
    assert [b for b in html.main_blocks(article(*blocks)) if b != text] == expected


def test_no_page_fails_the_job(spark):
    rnd = random.Random(9)
    pages = [article(BLOCK * 3, f"<p>Page {i}.</p>") for i in range(40)]
    odd = ["<![ ", "<![1]>", "<![%x", "<p>a<![ temp [x]]>", "<!--", "-->", "<", ">", '"', "<a href='", "</", "<script>", "<![CDATA[", "]]>", "<?", "&#x110000;", "&#xD800;", "\0", "<!DOCTYPE", "<textarea>", "<title>", "<plaintext>", "<svg"]
    rows = [(k, o) for k, o in enumerate(odd)]
    for k in range(600):
        page = list(rnd.choice(pages))
        for _ in range(rnd.randint(1, 25)):
            page.insert(rnd.randint(0, len(page)), rnd.choice(odd))
        rows.append((100 + k, "".join(page)))
    out = html.extract(spark.createDataFrame(rows, "page_id long, html string")).collect()
    assert len(out) == len(rows) and all(r.text is not None for r in out)


@pytest.mark.parametrize("piece,n", [("<a ", 300_000), ('<x y="', 200_000), ("a<", 300_000), ("<!--", 200_000), ("<![ x", 200_000), ("<script>", 100_000)])
def test_unclosed_markup_takes_linear_time(piece, n):
    begin = time.perf_counter()
    html.main_blocks(article(BLOCK) + piece * n)
    assert time.perf_counter() - begin < 5
