import html
import itertools
import random
import re

import pyarrow.parquet as pq

from codeloom.llm import html_text as ht

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no</p>";</script></head><body>
<div id="cookie-banner">We use cookies on this site, and you agree.</div><header class="top"><a href="/">Site</a></header>
<nav><ul><li><a href="/a">x</a><li><a href="/b">y</a></ul></nav><!-- <p>gone</p> -->
<article><header><h1>Real &amp; title</h1></header><p>First <b>para</b>graph of   real<br>text &lt;b&gt; here.<p class="x>y">Short.
<div class="share">Share this with all your friends, please.</div><ul><li>one<li>two</ul><table><tr><td>c1<td>c2</table>
<section id="comments"><p>A reader says that this was very good.</p></section></article>
<aside>Sidebar text that is long enough to look like a paragraph.</aside><form>Name <button>Send</button></form><footer>&copy; me"""
WANT = "Real & title\nFirst paragraph of real text <b> here.\nShort.\none\ntwo\nc1\nc2"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "other") for r in rows], "page_id long, url string, html string, text string")


def test_extract(spark):
    long = "<article>" + "".join(f"<p>Paragraph {i} of a long page.</p>" for i in range(3000)) + "</article>"
    rows = [(1, "u1", PAGE), (2, "u2", None), (3, None, ""), (None, "u4", "<p>just text"), (5, "u5", long), (1, "u1", PAGE), (6, "u6", "<nav>menu only</nav>"), (7, "u7", "<<<>&& <p"), (8, "u8", "<script>never closed <p>x")]
    got = [tuple(r) for r in ht.extract(frame(spark, rows)).collect()]
    assert len(got) == len(rows)
    by = {(r[0], r[1]): r[2] for r in got}
    assert all(r[3] == len(r[2]) for r in got)
    assert by[1, "u1"] == WANT and sum(r[0] == 1 for r in got) == 2
    assert by[2, "u2"] == by[3, None] == by[6, "u6"] == by[8, "u8"] == ""
    assert by[5, "u5"].count("\n") == 2999
    assert ht.extract(frame(spark, [])).count() == 0


def test_smoothness_keeps_a_short_paragraph_among_long_ones():
    body = "".join(f"<div class='row'><p>{t}</p></div>" for t in ["This is a longer paragraph, with commas, and a stop at the end."] * 3 + ["oh"] + ["And another one of them, which is long, and has marks as well."] * 3)
    got = ht.main_text(f"<body><div>{body}</div><nav>oh</nav></body>", ht.WITHOUT)
    assert got.count("\n") == 6 and "\noh\n" in got


def test_minimum_cut_against_all_labellings():
    r = random.Random(5)
    for _ in range(150):
        n = r.randrange(1, 9)
        score = [round(r.uniform(-4, 4), 2) for _ in range(n)]
        edges = {(i, j): round(r.uniform(0, 3), 2) for i in range(n) for j in range(i + 1, n) if r.random() < 0.5}

        def cost(x):
            return sum(-s if keep and s < 0 else s if not keep and s > 0 else 0 for s, keep in zip(score, x)) + sum(w for (i, j), w in edges.items() if x[i] != x[j])

        best = min(map(cost, itertools.product([False, True], repeat=n)))
        assert abs(cost(ht.minimum_cut(score, edges)) - best) < 1e-6


def test_entities_and_white_space():
    assert ht.main_text("<article><p>&eacute;&#233;&#x41;&nbsp;&amp;amp; \n\t z</p></article>", ht.WITHOUT) == "ééA &amp; z" == html.unescape("&eacute;&#233;A &amp;amp; z")


KEPT = [
    ('<article><h2 id="search-algorithms">Search algorithms</h2><p>A long paragraph of text, with commas, here.</p></article>', "Search algorithms\nA long paragraph of text, with commas, here."),
    ('<article><p>Text of the paragraph, it is long.</p><h2 id="related-work">Related work</h2><p class="lead comment">A lead, with a comment in it.</p></article>', "Text of the paragraph, it is long.\nRelated work\nA lead, with a comment in it."),
    ('<article><p>It begins.</p><section id="sharing-memory"><h3>Sharing</h3><p>Memory is shared by threads, mostly.</p></section></article>', "It begins.\nSharing\nMemory is shared by threads, mostly."),
    ('<body><div class="page-tags-wrapper"><h1>Head</h1><p>Body text of the page, which is long enough.</p></div></body>', "Head\nBody text of the page, which is long enough."),
    ('<body><div class="page-tags-wrapper"><nav>menu</nav><article><h1>Head</h1><p>Body text, long.</p></article></div></body>', "Head\nBody text, long."),
    ("<article><p>Let <math><mi>n</mi><mo>+</mo><mn>1</mn><annotation>n+1</annotation></math> be a number.</p></article>", "Let n+1 be a number."),
    ('<article><p>Main text here.</p></article><div id="comments"><ol class="comment-list"><li><article class="comment-body"><p>I like it, thanks for all this.</p></article></li></ol></div>', "Main text here."),
    ('<article><p>Main text here.</p><section id="comments"><p>I like it.</p><p>' + "And more, at length. " * 60 + "</p></section></article>", "Main text here."),
]


def learned(pages):
    found = [ht.blocks(p) for p in pages]
    return ht.fit([(ht.described(f), ht.smoothness(f)) for f in found])


def test_names_have_a_bounded_say():
    rows = pq.read_table("/root/testdata/sf0.01/pages.parquet").column("html").to_pylist()
    for weights in (ht.WITHOUT, learned(rows)):
        assert (abs(weights[ht.SHAPES :] - ht.PRIOR) <= ht.BOUND + 1e-9).all()
        assert [ht.main_text(p, weights) for p, _ in KEPT] == [t for _, t in KEPT]


def article(page):
    """The text of the article, by its tags alone."""
    inside = re.sub(r"<!--.*?-->|<(script|style)\b.*?</\1>", "", re.search(r"<article[^>]*>(.*?)</article>", page, re.S)[1], flags=re.S)
    inside = re.sub(r"</?(?:b|i|a|em|span|strong)(?:\s[^>]*)?>", "", inside.replace("<br>", " "))
    return "\n".join(t for piece in re.split(r"<[^>]+>", inside) if (t := " ".join(html.unescape(piece).split())))


def test_whole_table_against_the_tags_and_the_cut_against_the_score_alone(spark):
    pages = pq.read_table("/root/testdata/sf0.1/pages.parquet").select(["page_id", "html"]).to_pylist()
    weights = learned([p["html"] for p in pages[:1000]])
    equal = {"cut": 0, "score": 0}
    for p in pages:
        want = article(p["html"])
        assert ht.main_text(p["html"], weights) == want
        # Without the article's tag and all names, shape and neighbours decide.
        found = ht.blocks(re.sub(r' class="[^"]*"', "", re.sub(r"<(/?)article", r"<\1div", p["html"])))
        alone = ht.scores(ht.described(found), weights) > 0
        for name, kept in (("cut", ht.label(found, weights)), ("score", alone)):
            equal[name] += "\n".join(b.text for b, keep in zip(found, kept) if keep) == want
    assert equal["cut"] == len(pages) > equal["score"]
    table = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: (r.text, r.n_chars) for r in ht.extract(table).collect()}
    assert got == {r.page_id: (t := article(r.html), len(t)) for r in table.collect()}
