"""Main text of pages: markup by hand-made pages, differencing against plain versions."""

import html as entities
import random
import re

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tideline.llm import pages as P
from tideline.llm.pages import common, main_lines, main_text, page_lines, with_neighbours


def text_of(html):
    found = page_lines(html)
    return "\n\n".join(found[i][0] for i in main_lines(found)[0])


def lcs_length(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], max(row[j + 1], row[j], last + 1 if x == y else 0)
    return row[-1]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=14), st.lists(st.integers(0, 5), max_size=14), st.sampled_from([1, 8, 1 << 20]))
def test_common_subsequence(a, b, room):
    places = common(a, b, room)
    assert places == sorted(set(places)) and len(places) == lcs_length(a, b)
    rest = iter(b)
    assert all(a[i] in rest for i in places)  # in this order in b


def test_common_subsequence_of_long_pages():
    rng = random.Random(1)
    a, b = [rng.randrange(40) for _ in range(700)], [rng.randrange(40) for _ in range(900)]
    assert len(common(a, b)) == len(common(a, b, 1000)) == lcs_length(a, b)


ARTICLE = "<article><h1>Title</h1><p>First <b>bold</b>\n\t text.<br>More.</p><p>Second &amp; last&nbsp;one</p>{}</article>"
WANT = "Title\n\nFirst bold text. More.\n\nSecond & last one"

PAGES = {
    "plain": ("<html><head><title>T</title></head><body>" + ARTICLE.format("") + "</body></html>", WANT),
    "chrome": ("<header>Site</header><nav><ul><li>Home<li>About</ul></nav><aside>side</aside><div id=sidebar>s</div>"
               + ARTICLE.format("") + "<section class='comments'><article class=comment><p>Nice!</p></article></section><footer>f</footer>", WANT),
    "inside": (ARTICLE.format("<div class='ad'>Buy</div><aside>x</aside><form><input value=1>Mail</form><div class='share-buttons'>s</div>"
                              "<section id='comments'><p>First!</p></section><footer>by me</footer>"), WANT),
    "script": (ARTICLE.format("<script>var a = '</p><p>no';</script><style>p{}</style><noscript>no</noscript><template><p>no</p></template>"), WANT),
    "notice": ("<div class='cookie-notice'>We use cookies</div><main>" + ARTICLE.format("") + "<div role=complementary>x</div></main>", WANT),
    "cut off": ("<nav><a href=/>Home</a></nav><article><h1>Title</h1><p><b>First bold text.<br>More.<p>Second &amp last one", WANT),
    "main": ("<div>top</div><main><h1>Title</h1><p>First bold text. More.</p><p>Second &#38; last one</p></main><div>end</div>", WANT),
    "role": ("<div>top</div><div role='main'><h1>Title</h1><p>First bold text. More.</p><p>Second &#x26; last one</p></div>", WANT),
    "named": ("<div>top</div><div class='x post-content'><h1>Title</h1><p>First bold text. More.</p><p>Second & last one</p></div>", WANT),
    "names beside": ("<body class='has-sidebar with-ads'><article class='no-comments'><h1>Title</h1><p>First bold text. More.</p>"
                     "<p>Second &amp; last one</p></article></body>", WANT),
    "article header": ("<header>Site</header><article><header class='entry-header'><h1>Title</h1></header><p>First bold text. More.</p>"
                       "Second &amp; last one</article>", WANT),
    "comment marks": ("<!-- <article>no</article> --><article><!-- a > b --><h1>Title</h1><p>First bold text.<!-- x --> More.</p>"
                      "<p>Second &amp; last one</article>", WANT),
    "lists": ("<article><ul><li>one<li>two <i>2</i></ul><table><tr><td>a<td>b<tr><td>c</table><blockquote>q</blockquote><pre> p\n q </pre></article>",
              "one\n\ntwo 2\n\na b\n\nc\n\nq\n\np q"),
    "references": ("<article><p>&lt;P&gt; &eacute;&#233;&#xe9; &copy 2 &unknown; &am &notin;</p></article>", "<P> ééé © 2 &unknown; &am ∉"),
    "nothing": ("", ""), "only chrome": ("<nav>a</nav><footer>b</footer>", ""), "no markup": ("just  text\n here", "just text here"),
    "empty article": ("<article></article><p>text</p>", "text"),
    "stray ends": ("</div></p><article><div><h1>Title</h1></span></section><p>First bold text. More.</p></div>Second &amp; last one</article></main>", WANT),
    "quotes": ("<article data-x='a > b' title=\"</article>\"><h1>Title</h1><p>First bold text. More.</p><p>Second &amp; last one</p></article>", WANT),
    "broken": ("<article><p>a < b <3 <![if x]>c<![endif]> <!x> <?php y ?> </ z> d</p></article>", "a < b <3 c d"),
}


@pytest.mark.parametrize("name", PAGES)
def test_markup(name):
    html, want = PAGES[name]
    assert text_of(html) == want


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div>", "</div>", "<article>", "</article>", "<nav>", "<b>", "x", "&", "<", ">", "<!", "<!--",
                                 "-->", "<![", "]]>", "<script>", "</script>", "'", '"', "<a b='", "=", "<td>", "<table>", "\n"]), max_size=30))
def test_any_markup_is_read(parts):
    for line, _ in page_lines("".join(parts)):
        assert line == " ".join(line.split()) != ""


def test_given_pages(spark, sf_dir):
    """The template of the test pages, taken apart with patterns."""
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    want = set()
    for r in rows:
        inner = re.search("<article>(.*)</article>", r.html, re.S).group(1).replace("<br>", " ")
        blocks = [" ".join(entities.unescape(re.sub("<[a-z/][^>]*>", "", b)).split()) for b in re.split("</?(?:p|h1)>", inner)]
        want.add((r.page_id, r.url, "\n\n".join(b for b in blocks if b)))
    got = main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    assert {tuple(r)[:3] for r in got.collect()} == want


SITE = ["Daily Example", "Home", "World", "Sport", "You may also like", "All rights are ours", "Write to us"]


def soup(lines):
    return "<body>" + "".join(f"<div><span>{line}</span></div>" for line in lines) + "</body>"


def site(host, pages, prose):
    out = []
    for k in range(pages):
        own = [prose(hash((host, k, j)) % 10**6, 25) for j in range(6)]
        out.append((f"https://{host}/news/{k // 4}/story-{k:03d}.html?ref=1#top", soup(SITE[:4] + own + SITE[4:]), "\n\n".join(own)))
    return out


def test_site_lines_go(spark, prose):
    made = site("a.example.org", 30, prose) + site("A.example.org:80", 1, prose) + site("b.example.org", 5, prose)
    rows = [(i, u, h, "x", 1) for i, (u, h, _) in enumerate(made)]
    want = {i: t for i, (_, _, t) in enumerate(made)}
    want[30] = "\n\n".join(SITE[:4]) + "\n\n" + want[30] + "\n\n" + "\n\n".join(SITE[4:])  # alone in its host
    rows += [(100 + i, *r[1:]) for i, r in enumerate(rows[:3])] * 2  # copies under other ids, twice
    want |= {100 + i: want[i] for i in range(3)}
    near = made[7][1].replace("the ", "a ", 1)  # a near copy beside its original tells nothing; the next page does
    rows.append((200, made[7][0].replace(".html", "-b.html"), near, "x", 1))
    rows += [(300, None, made[0][1], "x", 1), (301, "no url", made[0][1], "x", 1), (302, made[0][0], None, "x", 1), (None, made[1][0], "", "x", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, lines string, host int").repartition(4)
    got = main_text(df).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.page_id in want:
            assert r.text == want[r.page_id], r.page_id
    by_id = {r.page_id: r.text for r in got}
    assert by_id[302] == by_id[None] == ""
    assert by_id[300] == by_id[301] == "\n\n".join(SITE[:4]) + "\n\n" + want[0] + "\n\n" + "\n\n".join(SITE[4:])
    assert not any(line in by_id[200] for line in SITE) and by_id[200].count("\n\n") == 5


def test_neighbours_do_not_depend_on_ranges(spark):
    rng = random.Random(3)
    rows = sorted({(rng.choice("aab"), f"/{rng.randrange(400):03d}", i) for i in range(300)})
    df = spark.createDataFrame(rows, "host string, path string, k int").repartition(7)
    want = {}
    for i, (host, path, k) in enumerate(rows):
        before, after = rows[i - 1] if i else None, rows[i + 1] if i + 1 < len(rows) else None
        want[k] = tuple(x[2] if x and x[0] == host else None for x in (before, after))
    settings_before = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        for parts in ("1", "13", "400"):  # more ranges than rows leave some empty
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            got = with_neighbours(df, "host", ["path", "k"], ["k"]).collect()
            assert {r.k: tuple(x and x.k for x in (r.before, r.after)) for r in got} == want and len(got) == len(rows)
    finally:
        for c, v in settings_before.items():
            spark.conf.set(c, v)


def test_no_rows(spark):
    assert main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_the_closest_path_is_taken_first():
    page = {"path": "/a/b/2", "hashes": [1, 2, 3], "widths": [9, 9, 90], "places": [0, 1, 2]}
    far = {"path": "/a/c/1", "hashes": [2, 8], "widths": [9, 90], "places": [0, 1]}
    close = {"path": "/a/b/1", "hashes": [1, 7], "widths": [9, 90], "places": [0, 1]}
    assert P.site_lines(page, [far, close]) == [False, True, True]
    copy = close | {"hashes": [1, 3], "widths": [9, 90]}
    assert P.site_lines(page, [far, copy]) == [True, False, True]
    assert P.site_lines(page, [None, copy]) == [True, True, True]


def test_differencing_chooses_among_articles(spark, prose):
    """Every page is compared: an article element that the nearest page has too is the site's, one with own lines is whole."""
    pick = "<article><h2>Picked by us</h2><p>The same on every page</p></article>"
    passage = prose(7, 30)
    rows, want = [], {}
    for k in range(6):
        own = [prose(100 * k + j, 25) for j in range(4)]
        lines = [f"Title {k}", *own[:2], passage, *own[2:]]  # a passage that all articles quote stays
        html = f"<main><p>Top</p>{pick}<article>" + "".join(f"<p>{line}</p>" for line in lines) + "</article></main>"
        rows.append((k, f"https://a.example.org/{k}", html))
        want[k] = "\n\n".join(lines)
    for k in range(6, 9):  # the only article element is the site's, the main element holds the text
        own = [prose(100 * k + j, 25) for j in range(4)]
        rows.append((k, f"https://b.example.org/{k}", f"<main>{pick}" + "".join(f"<p>{line}</p>" for line in own) + "</main>"))
        want[k] = "\n\n".join(own)
    rows.append((9, "https://c.example.org/9", rows[0][2]))  # alone in its host: what markup says
    want[9] = "\n\n".join(["Picked by us", "The same on every page", want[0]])
    rows += [(10, "https://d.example.org/a", "<article><p>x</p></article>"), (11, "https://d.example.org/b", "<article><p>x</p><p>y</p></article>")]
    want |= {10: "x", 11: "x\n\ny"}
    got = main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()
    assert {r.page_id: r.text for r in got} == want and len(got) == len(rows)
    assert {r.page_id: r.n_lines for r in got} == {k: t.count("\n\n") + 1 for k, t in want.items()}
