import random
import time

import pytest

from riskloom.llm.html_layout import extract_html, html_text

CASES = {
    "<p>one<p>two": "one\n\ntwo",
    "a  <b> b </b>\n c": "a b c",
    "a<span>b</span>c": "abc",
    "x<br>y<br/>z": "x\ny\nz",
    "<h1>H</h1>t<div>d</div>e": "H\n\nt\nd\ne",
    "<ul><li>a<li>b<ul><li>c</ul><li>d</ul>": "- a\n- b\n  - c\n- d",
    "<ol start=9><li>a<li>b<li value=20>c</ol>": "9. a\n10. b\n20. c",
    "<table><tr><td>a<td>bb<tr><td>ccc<td>d</table>": "a    bb\nccc  d",
    "<table><tr><td>x<td>1<tr><td colspan=2>wide one<tr><td rowspan=2>r<td>2<tr><td>3</table>": "x         1\nwide one\nr         2\n          3",
    "<table><td>no row<td>b</table>": "no row  b",
    "<table><tr><td>a<br>b<td>c</table>": "a  c\nb",
    "<table><tr><td>日本<td>x<tr><td>abcd<td>y</table>": "日本  x\nabcd  y",
    "<table><tr><td><table><tr><td>in<td>ner</table><td>z</table>": "in  ner  z",
    "<table>stray<tr><td>a</table>": "stray\na",
    "<pre>\n a\n  b</pre>c": " a\n  b\n\nc".strip("\n"),
    "<p hidden>x<p style='color:red; display : none'>y<p>z": "z",
    "<div style='visibility:hidden'>a</div><template>t</template><noscript>n</noscript>b": "b",
    "<title>t</title><style>p{}</style><script>if(a<b){'</p>'}</script>b": "b",
    "<head><meta charset=x><p>in body": "in body",
    "<details><summary>S</summary>no</details><details open><summary>T</summary>yes</details>": "S\nT\nyes",
    "<select><option>a<option>b</select>": "a\nb",
    "<dl><dt>T<dd>D<dt>U<dd>E</dl>": "T\n    D\nU\n    E",
    "a<!-- no -->b<![CDATA[c]]>": "ab",
    "&lt;p&gt; &amp;amp; &#65;&nbsp;x": "<p> &amp; A\xa0x",
    "a</p>b</div></span>": "a\n\nb",
    "<a href=x>unclosed": "unclosed",
    "<p>t<hr>u": "t\n\nu",
    "": "",
    "<div><div></div></div>": "",
    "<b": "",
}


@pytest.mark.parametrize("html", CASES)
def test_layout(html):
    assert html_text(html).strip("\n") == CASES[html].strip("\n")


def test_no_visible_word_is_lost():
    """Random markup of visible elements keeps its words, in order, whatever is left open."""
    draw = random.Random(8)
    tags = "p div b i ul li ol span h2 blockquote section pre em a dl dt dd article".split()
    for _ in range(150):
        words, parts = [], []
        for k in range(draw.randrange(1, 60)):
            what = draw.random()
            if what < 0.4:
                words.append(f"w{k}x")
                parts.append(f" w{k}x ")
            else:
                parts.append(f"<{'/' if what > 0.75 else ''}{draw.choice(tags)}>")
        text = html_text("".join(parts))
        assert [w for w in text.split() if w.startswith("w") and w.endswith("x")] == words


def test_deep_and_long_markup_takes_linear_time():
    start = time.time()
    assert html_text("<div>" * 100_000 + "deep") == "deep"
    assert html_text("<p><table><tr><td>" * 2000 + "x").split() == ["x"]
    assert html_text("<p>" + "<b>" * 50_000 + "y" + "<div>" * 50_000).strip() == "y"
    assert len(html_text("<p>word " * 200_000).split()) == 200_000
    assert time.time() - start < 60


def test_rows(make):
    rows = [(1, "<p>a<p>b", "x"), (2, None, "x"), (3, "", "x"), (None, "z", "x"), (1, "<p>a<p>b", "x")]
    got = extract_html(make(rows, "page_id long, html string, text string")).collect()
    assert sorted(((r.page_id, r.text, r.n_chars, r.n_lines) for r in got), key=repr) == sorted(
        [(1, "a\n\nb", 4, 3), (1, "a\n\nb", 4, 3), (2, None, None, None), (3, "", 0, 0), (None, "z", 1, 1)], key=repr
    )
    assert extract_html(make([], "page_id long, html string")).count() == 0
