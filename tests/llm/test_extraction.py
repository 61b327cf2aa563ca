import time

import pytest

from tillwise.llm.extraction import extracted, main_text

A = "The first paragraph, which is long enough, says a thing or two."
B = "The second one, also not short, goes on about it for a while."

CASES = {
    "article": (f"<body><nav><a href=x>Menu</a></nav><article><h1>Title</h1><p>{A}</p><p>{B}</p></article><footer>f</footer></body>", ["Title", A, B]),
    "unclosed": (f"<div class=content><p><b>{A}<br><p>{B}<ul><li>one<li>two</ul></div>", [A, B, "one", "two"]),
    "references": ("<main><p>a &amp; b &lt;c&gt; &#233;&eacute; x&nbsp;y &am &copy z</p></main>", ["a & b <c> éé x y &am © z"]),
    "white space": ("<article><p>  a\n\t b <i>c</i>d<br/>e </p>\n<p> </p></article>", ["a b cd e"]),
    "scripts": (f"<article><script>if (a < b) {{ '</p>' }}</script><style>p{{}}</style><p>{A}</p><!-- <p>x</p> --><noscript>n</noscript></article>", [A]),
    "comments": (f"<article><p>{A}</p><div id='comments'><p>{B}, first!</p></div></article><section class='reader-comments'><p>{B}</p></section>", [A]),
    "forms": (f"<div><p>{A}</p><form><p>{B}</p><select><option>1<option>2</select></form></div>", [A]),
    "notices": (f"<div role=alert>{B}</div><div class='cookie-notice'>{B}</div><div class=adBox>x</div><div><p>{A}</p></div><aside>{B}</aside>", [A]),
    "siblings": (f"<body><div><p>{A}</p></div><div><p>{B}</p></div><div><a href=1>{B}</a></div></body>", [A, B]),
    "sections": (f"<article><section><p>{A}</p></section><section><h2>Next</h2><p>{B}</p></section></article>", [A, "Next", B]),
    "table": ("<article><table><tr><td>a<td>b<tr><td>c</table><blockquote>q</blockquote><pre>x  y</pre></article>", ["a b", "c", "q", "x y"]),
    "stray ends": (f"</p></div><article></b><p>{A}</i></p></p>{B}</article></body>", [A, B]),
    "plain": ("just text", ["just text"]),
    "names inside words": (f"<div class='shadow heading'><h2 class=header>T</h2><p>{A}</p></div>", ["T", A]),
    "quotes": (f"<article><p title=\"a>b\" data-role=search>{A}</p></article>", [A]),
    "only a menu": ("<nav>a</nav><footer>b</footer>", []),
    "cut off": (f"<article><p>{A}</p><p>{B}</p><a href=\"x", [A, B]),
}


@pytest.mark.parametrize("name", CASES)
def test_pages(name):
    source, blocks = CASES[name]
    assert main_text(source) == "\n\n".join(blocks)


def test_nothing():
    assert main_text(None) == main_text("") == main_text("<p></p>") == main_text("<!--") == ""


def test_long_pages_take_linear_time():
    began = time.process_time()
    for unit in ("<div>", "<p>x", "<a \"", "</div>", "<b><i>", "&amp;", "<!--", "<script>", "<td>", "<li>", "<p><b>"):
        main_text(unit * 20_000)
    assert time.process_time() - began < 60


def test_extracted(spark):
    rows = [(1, "u", CASES["article"][0], 7), (1, "u", CASES["article"][0], 7), (None, None, None, 7), (2, "v", "", 7), (3, "w", f"<article>{f'<p>{A}</p>' * 5000}</article>", 7)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")
    got = {r.page_id: r for r in extracted(pages).collect()}
    assert got[1].text == f"Title\n\n{A}\n\n{B}" and got[1].n_chars == len(got[1].text)
    assert (got[None].text, got[2].text) == ("", "") and got[3].text.count(A) == 5000
    assert extracted(pages).count() == 5 and extracted(pages.limit(0)).count() == 0


FULL = f"<article><h1>Title</h1><p>{A}</p><p>{B}</p></article>"
WHOLE = {
    "form around the page": (f"<body><form action=x><input type=hidden><nav>m</nav>{FULL}<footer>f</footer></form></body>", ["Title", A, B]),
    "role form": (f"<div role=form><div class=menu>m</div>{FULL}</div>", ["Title", A, B]),
    "role dialog": (f"<div role='dialog'><p>{A}</p><p>{B}</p></div>", [A, B]),
    "page that fades in": (f"<body style='visibility: hidden'><nav>m</nav>{FULL}</body>", ["Title", A, B]),
    "header of the article": (f"<header>Site <a href=/>home</a></header><article><header><h1>Title</h1><p>{A}</p></header><p>{B}</p></article>", ["Title", A, B]),
    "article without scripts": (f"<nav>m</nav><noscript><div>{FULL}</div></noscript>", ["Title", A, B]),
    "other forms, dialogs, headers": (
        f"<header><p>{B}</p></header><form><p>{B}</p></form><dialog><p>{B}</p></dialog><div role=dialog>{B}</div><div hidden>{B}</div>"
        f"<noscript><p>{B}</p></noscript><article><p>{A}</p><p>{A}</p><p>{A}</p><form><header>Log in</header><p>{B}</p></form></article>",
        [A, A, A],
    ),
    "named wrapper": (f"<div class='layout has-sidebar'><div class=sidebar>menu</div><article><p>{A}</p><p>{B}</p></article></div>", [A, B]),
    "named wrapper without article": (f"<body><div class=menu>m</div><div class='content-with-sidebar'><p>{A}</p><p>{B}</p></div></body>", [A, B]),
    "wrapper and comments": (
        f"<div class='post hasComments'><article><p>{A}</p></article><div class=comments><div class=comment><p>{B}</p></div></div></div>",
        [A],
    ),
    "long comments": (f"<article><p>{A}</p><p>{A}</p></article><div class=comments>{f'<p>{B}</p>' * 4}</div>", [A, A]),
    "named beside a teaser": (f"<body><article><p>{A}</p></article><div class='post social'><p>{A}</p><p>{B}</p></div></body>", [A, A, B]),
    "named inline": (f"<article><p>{A} <span class=share>Share</span>{B}</p></article>", [f"{A} {B}"]),
    "nested names": (f"<div class='page-header-wrap'><div id=widget-area><p>{A}</p><p>{B}</p></div></div>", [A, B]),
    "short later sections": (f"<body><section>{f'<p>{A}</p>' * 12}</section><section><p>{B}</p></section><section><p>Short.</p></section></body>", [*[A] * 12, B, "Short."]),
    "math": ("<article><p>So <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation encoding=tex>x=1</annotation></math> holds.</p></article>", ["So x=1 holds."]),
    "long attribute": (f"<article><p data-x=\"{'a>b ' * 5000}\">{A}</p></article>", [A]),
}


@pytest.mark.parametrize("name", WHOLE)
def test_whole_articles(name):
    source, blocks = WHOLE[name]
    assert main_text(source) == "\n\n".join(blocks)


def test_pages_with_many_names_and_quotes_end_in_time():
    began = time.process_time()
    for unit in ("<div class=menu>x", "<a \">\"", "<a '>\"", "<p class=ad>x, y</p>"):
        main_text(unit * 5_000)
    assert time.process_time() - began < 60
