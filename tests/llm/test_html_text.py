import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from veridra.llm import html_text, queries
from veridra.llm.html_text import render


@pytest.mark.parametrize(
    ("page", "wanted"),
    [
        ("<p>one<b> two<br>three<p>four", "one two\nthree\n\nfour"),
        ("<div>a</div><div>b</div>c", "a\nb\nc"),
        ("<ul><li>x<li>y<ol start=3><li>n<li>m</ol><li>z</ul>after", "- x\n- y\n  3. n\n  4. m\n- z\n\nafter"),
        ("<ol reversed start=2><li>a<li value=9>b</ol>", "2. a\n9. b"),
        ("<table><tr><th>Name<th>Qty<tr><td>apple pie<td>3<tr><td>fig<td>12</table>", "Name       Qty\napple pie  3\nfig        12"),
        ("<table><tr><td rowspan=2>r<td>a<tr><td>b<tr><td colspan=2>wide wide<tr><td>1<td>2</table>", "r  a\n   b\nwide wide\n1  2"),
        ("<table><tr><td>a<table><tr><td>i<td>j</table><td>b</table>", "a     b\n\ni  j"),
        ("x<table>stray<tr><td>c</table>y", "xstray\n\nc\n\ny"),
        ("<pre>\n a  b\n   c</pre>", " a  b\n   c"),
        ("<dl><dt>t<dd>d</dl><blockquote>q</blockquote>", "t\n  d\n\n  q"),
        ("<p hidden>no<p style='display: none'>no<p>yes", "yes"),
        ("<p style='visibility:hidden'>no <b style='visibility:visible'>yes</b></p>", "yes"),
        ("<style>.x,#y{display:none} @media print{p{display:none}}</style><i class='a x'>no</i><p id=y>no<p>yes", "yes"),
        ("<details><summary>S</summary>no</details><details open>yes</details>", "S\nyes"),
        ("<select><option>a<option selected>b</select>", "b"),
        ("<select multiple><option>a<option>b</select>", "a\nb"),
        ("<script>var a='</p>'</script><noscript>n</noscript><template>t</template>", "n"),
        ("a &amp; b &lt;c&gt; &#233; &nbsp;x", "a & b <c> é  x"),
        ("<!-- <p>no</p> -->yes<!DOCTYPE x>", "yes"),
        ("a<b>c</b>d <i>e</i>", "acd e"),
        ("1 < 2 and 3", "1 < 2 and 3"),
        ("<td>stray</td> text", "stray text"),
        ("<b>x<p>y</b>z</p>", "x\n\nyz"),
        ("<span hidden>no<p>no</p></span>yes", "yes"),
        ("<input type=hidden value=h><input type=submit value=Go>", "Go"),
        ("<q>said</q>", "“said”"),
        ("<title>T</title><textarea>\n a\n b</textarea>", " a\n b"),
        ("plain  text\n\n two", "plain text two"),
        ("", ""),
        (None, ""),
        ("<", "<"),
        ("<p", "<p"),
        ("</p></br>x</nothing>", "x"),
        ("<li>a<li>b", "- a\n- b"),
        ("<p>a<h2>b</h2>c", "a\n\nb\n\nc"),
        ("<plaintext><p>&amp;", "<p>&amp;"),
    ],
)
def test_rendering(page, wanted):
    assert render(page)[1].strip("\n") == wanted


def test_title():
    assert render("<title> A &amp;\n B </title><p>x")[0] == "A & B"


@pytest.mark.parametrize("page", ["<div>" * 60_000 + "x", "<b>" * 60_000 + "x" + "</b>" * 60_000, "<table><tr><td>" * 3000 + "x", "<ul><li>" * 5000 + "x", "<p>" * 60_000, "</div>" * 60_000, "<a b='" * 20_000])
def test_hostile_pages_end_soon(page):
    began = time.time()
    render(page)
    assert time.time() - began < 20


def test_wide_cells_are_not_padded_without_bound():
    long = "x" * 100_000
    text = render("<table>" + f"<tr><td>{long}<td>b" + "<tr><td>a<td>b" * 2000 + "</table>")[1]
    assert len(text) < 500_000


def test_tables_are_aligned_however_wide():
    long = "x" * 300
    rows = [line.split() for line in render(f"<table><tr><td>{long}<td>b<td>c<tr><td>a<td>{long}<td>d<tr><td>e<td>f<td>g</table>")[1].split("\n")]
    text = render(f"<table><tr><td>{long}<td>b<td>c<tr><td>a<td>{long}<td>d<tr><td>e<td>f<td>g</table>")[1].split("\n")
    assert rows == [[long, "b", "c"], ["a", long, "d"], ["e", "f", "g"]]
    assert [text[0].index(" b"), text[1].index(" xxx"), text[2].index(" f")] == [301] * 3
    assert len({line.rindex(cell) for line, cell in zip(text, "cdg")}) == 1
    spanned = render("<table><tr><td rowspan=3000>r<td>a" + "<tr><td>b" * 2999 + "<tr><td>last</table>")[1].split("\n")
    assert spanned[0] == "r     a" and spanned[2999] == "      b" and spanned[3000] == "last"


def test_drawings_and_formulas_show_their_text():
    page = "<title>T</title><p>a <math><mi>x</mi><mo>+</mo><semantics><annotation>no</annotation></semantics></math> b</p>"
    page += "<svg><title>no</title><desc>no</desc><defs><text>no</text></defs><text>label</text><text>other</text></svg><map><p>m</map>"
    assert render(page) == ("T", "a x+ b\n\nlabel\nother\n\nm")
    assert render("<svg><title>drawing</title></svg><p>x")[0] == ""


def random_page(chooser, depth=0):
    """(HTML, lines) of a random page: the lines are set from the tree, not from the HTML."""

    def words(n=3):
        return " ".join(f"w{int(chooser.integers(100))}" for _ in range(int(chooser.integers(1, n + 1))))

    def inline():
        text = words()
        return text.replace(" ", chooser.choice([" ", "\n  ", " <b>", "<i> "]) if chooser.random() < 0.3 else " ", 1), text

    html, blocks = [], []
    for _ in range(int(chooser.integers(1, 5))):
        kind = chooser.choice(["p", "h2", "div", "ul", "ol", "table", "quote"] if depth < 2 else ["p", "div"])
        if kind in ("p", "h2", "div"):
            source, text = inline()
            html.append(f"<{kind}>{source}</b></i></{kind}>" if kind != "p" or chooser.random() < 0.5 else f"<p>{source}</b></i>")
            blocks.append(([text], kind != "div"))
        elif kind in ("ul", "ol"):
            start = int(chooser.integers(1, 5))
            items, lines = [], []
            for i in range(int(chooser.integers(1, 4))):
                lead = "- " if kind == "ul" else f"{start + i}. "
                own = words()
                inner_html, inner = "", []
                if depth == 0 and chooser.random() < 0.3:
                    nested = [words() for _ in range(2)]
                    inner_html = "<ul>" + "".join(f"<li>{n}" for n in nested) + "</ul>"
                    inner = [" " * len(lead) + "- " + n for n in nested]
                items.append(f"<li>{own}{inner_html}" + chooser.choice(["", "</li>"]))
                lines += [lead + own, *inner]
            html.append(f"<{kind}{'' if kind == 'ul' else f' start={start}'}>{''.join(items)}</{kind}>")
            blocks.append((lines, True))
        elif kind == "table":
            rows = [[words(2) for _ in range(3)] for _ in range(int(chooser.integers(1, 4)))]
            html.append("<table>" + "".join("<tr>" + "".join(f"<td>{c}" for c in r) for r in rows) + "</table>")
            wide = [max(len(r[c]) for r in rows) for c in range(3)]
            blocks.append((["  ".join(c.ljust(w) for c, w in zip(r, wide)).rstrip() for r in rows], True))
        else:
            inner_html, inner = random_page(chooser, depth + 1)
            html.append(f"<blockquote>{inner_html}</blockquote>")
            blocks.append((["  " + line if line else "" for line in inner], True))
    out = []
    for k, (lines, apart) in enumerate(blocks):
        if k and (apart or blocks[k - 1][1]):
            out.append("")
        out += lines
    return "".join(html), out


def test_layout_of_random_pages():
    chooser = np.random.default_rng(12)
    for _ in range(400):
        html, lines = random_page(chooser)
        assert render(html)[1].split("\n") == lines, html


def test_columns(spark):
    rows = spark.createDataFrame([(1, "<p>a", "c"), (2, None, "c"), (2, "", None), (None, "<p>b", "c")], "page_id long, html string, text string")
    found = rows.withColumn("r", html_text.extract(F.col("html"))).collect()
    assert [(r["page_id"], r["r"]["text"]) for r in found] == [(1, "a"), (2, ""), (2, ""), (None, "b")]
    assert rows.limit(0).select(html_text.extract(F.col("html"))).count() == 0


def test_query_keeps_every_visible_word(spark):
    """Against a plain stripping of tags: the same words in the same order."""
    import re
    from html import unescape

    sf = "/root/testdata/sf0.001"
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    found = {r["page_id"]: r["text"] for r in queries.op3_html_extraction(spark, sf).collect()}
    assert set(found) == set(pages)
    for key, html in pages.items():
        body = re.sub(r"(?s)<(script|style|title)\b.*?</\1>|<!--.*?-->", " ", html)
        words = unescape(re.sub(r"<[^>]*>", " ", body)).replace("\xa0", " ").split()
        shown = [w for line in found[key].split("\n") for w in re.sub(r"^\s*- ", "", line).split()]
        assert shown == words
