import html
import random
import re
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from churnforge.llm.html_extract import (block_key, extract_main_text, induce_wrapper, induce_wrappers, layout_of, main_text,
                                         with_layout)
from churnforge.llm.html_tree import Page, match_trees
from churnforge.llm.queries import q_op6


def test_article_without_furniture():
    page = """<!doctype html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body class="x">
    <header>Top</header><nav><ul><li><a href=/>Home</a></ul></nav><div class="cookie-notice">We use cookies</div>
    <!-- a > b --><main><article class="post"><header><h1>Title &amp; more</h1></header><p>First<br>second <b>bold</b>ed
    <p>Next&nbsp;&#8212;&eacute; <i>in</i>line</p><form><input value="x">Search</form><aside>Side</aside><div class="ad">Buy</div>
    <ul><li>one<li>two</ul><table><tr><td>a<td>b<tr><td>c</table></article>
    <section id="comments"><article class="comment"><p>reader says</p></article></section></main>
    <div hidden>never</div><footer>&copy; me</footer></body></html>"""
    assert main_text(page) == "Title & more First second bolded Next —é inline one two a b c"


@pytest.mark.parametrize("page,want", [
    ("", ""), ("plain text", "plain text"), ("<p>a<p>b", "a b"), ("<article>x</article><article>longer y</article>", "x longer y"),
    ("a < b &lt; c", "a < b < c"), ("<p title='>'>q</p>", "q"), ("<script>x", ""), ("<!-- open", ""), ("<div><b>un<i>closed<p>x", "unclosed x"),
    ("</p></div>end", "end"), ("<nav>only</nav>", ""), ("<b>x</b>y<div>z</div>w", "xy z w"), ("<p>&amp;lt;</p>", "&lt;"),
    ("<main>m<p>n</main><p>o", "m n"), ("<div>" * 5000 + "deep", "deep"), ("<p>" + "w " * 60_000, ("w " * 60_000).strip())])
def test_odd_pages(page, want):
    assert main_text(page) == want


def brute_match(a, b):
    """Simple tree matching by its definition."""
    if a.path.rpartition(">")[2] != b.path.rpartition(">")[2]:
        return 0
    m = [[0] * (len(b.kids) + 1) for _ in range(len(a.kids) + 1)]
    for i, x in enumerate(a.kids, 1):
        for j, y in enumerate(b.kids, 1):
            m[i][j] = max(m[i - 1][j], m[i][j - 1], m[i - 1][j - 1] + brute_match(x, y))
    return m[-1][-1] + 1


def test_tree_matching_is_maximal():
    rng = random.Random(12)

    def tree(depth):
        return "".join(f"<{t}>{tree(depth - 1) if depth else 'x'}</{t}>" for t in rng.choices(["div", "span", "ul", "h2"], k=rng.randint(0, 4)))

    for _ in range(60):
        a, b = Page(tree(3)).root, Page(tree(3)).root
        pairs = match_trees(a, b)
        assert len(pairs) == brute_match(a, b)
        assert len({id(x) for x, _ in pairs}) == len(pairs) == len({id(y) for _, y in pairs})


def test_tree_matching_is_maximal_at_every_size():
    def pairs(a, b):
        return len(match_trees(Page(a).root, Page(b).root))

    assert pairs("<h2>x</h2>" + "<p>x</p>" * 700, "<p>x</p>" * 700 + "<h2>x</h2>") == 701
    assert pairs("<div>" * 1200 + "<ul></ul>", "<div>" * 1200 + "<ol></ol>") == 1201
    rng = random.Random(5)
    a, b = (Page("".join(f"<{t}>{'<b>y</b>' * rng.randint(0, 2)}</{t}>" for t in rng.choices(["div", "ul", "h2"], k=k))).root for k in (560, 530))
    assert len(match_trees(a, b)) == brute_match(a, b)


def blog(i, body):
    return (f"<html><body><div class=top><span>My Blog</span></div><div class=wrap><div class=text><p>{body}</p><p>More {i}.</p></div>"
            f"<div class=box>Read our other posts</div></div><div class=bottom>Contact</div></body></html>")


def test_wrapper_of_a_host_without_articles():
    pages = [blog(i, f"story number {i} " + "x" * i) for i in range(5)]
    keys, slot = induce_wrapper(pages)
    assert slot.endswith("div.wrap>div.text")
    assert main_text(pages[2], set(keys), slot) == "story number 2 xx More 2."
    assert main_text(blog(99, "unseen page"), set(keys), slot) == "unseen page More 99."
    assert induce_wrapper([pages[0]] * 9) == ([], None)      # copies are one page
    assert main_text(pages[2]).startswith("My Blog")         # without its wrapper the page is all text


@pytest.mark.parametrize("page,want", [
    ("<main>" + "<p>The long text of the page goes on.</p>" * 9 + "<article>Teaser one</article></main>",
     "The long text of the page goes on. " * 9 + "Teaser one"),
    ("<main><article>First part of it.</article><p>x</p><article>Second part of it.</article></main>", "First part of it. Second part of it."),
    ("<article>" + "".join(f"<div class=elementor-widget><p>Paragraph {i} of the text.</p></div>" for i in range(6)) + "</article>",
     " ".join(f"Paragraph {i} of the text." for i in range(6))),
    ("<article><div class='share-the-story'><p>All of the article is in here, whatever its name.</p></div><div class=share>Share</div></article>",
     "All of the article is in here, whatever its name."),
    ("<article><p>Own text of the article.</p><div id=comments><p>A reader says a lot, more than the article itself.</p></div></article>",
     "Own text of the article.")])
def test_names_prove_nothing(page, want):
    assert main_text(page) == want


def test_misleading_names_with_a_wrapper(spark):
    """No article element, content in an element named like furniture, menus that
    differ by language, a constant line at the end of every text."""
    def page(i):
        menu = "Home News Contact" if i % 2 else "Accueil Nouvelles Contact"
        body = "".join(f"<p>Sentence {i * 7 + k} of story {i} is told here.</p>" for k in range(3))
        return (f"<html><body><div class=intro><span>{menu}</span></div><div class=story><div class='notice widget'>{body}"
                f"<p>Thank you for reading our site.</p></div></div><div class=end>Imprint</div></body></html>")

    df = spark.createDataFrame([(i, f"http://odd.x/{i}", page(i)) for i in range(30)], "page_id bigint, url string, html string")
    got = {r["page_id"]: r["text"] for r in extract_main_text(df).collect()}
    alone = {r["page_id"]: r["text"] for r in extract_main_text(df.withColumn("url", F.lit(None).cast("string"))).collect()}
    for i in range(30):
        assert got[i] == " ".join(f"Sentence {i * 7 + k} of story {i} is told here." for k in range(3))
        assert alone[i] != got[i]                            # the wrapper is what finds it


def brute_texts(rows):
    """The operator page by page: layouts, samples, wrappers and counts in plain Python."""
    kinds = defaultdict(dict)
    for page_id, url, source in rows:
        host = re.match(r"[^:]*://([^/?#]*)", url or "")
        if host and host[1]:
            page = Page(source or "")
            keys = list(dict.fromkeys(block_key(n.path, t) for n, t in page.blocks))
            text = xxhash.xxh64_intdigest(repr(keys)) - (1 << 63)
            kinds[host[1].lower(), layout_of(page)].setdefault(text, []).append((page_id, source or "", page))
    wrappers = {}
    for kind, texts in kinds.items():
        classes = {}
        for text in sorted(texts):
            classes.setdefault(text % 8, texts[text])
        keys, slot = induce_wrapper([v[0][1] for v in classes.values()])
        n = Counter(k for v in texts.values() for k in {block_key(m.path, t) for m, t in v[0][2].blocks if not m.away})
        wrappers[kind] = ({k for k in keys if len(texts) >= 5 and n[k] >= 0.8 * len(texts)}, slot)
    out = {}
    for page_id, url, source in rows:
        host = re.match(r"[^:]*://([^/?#]*)", url or "")
        kind = (host[1].lower(), layout_of(Page(source or ""))) if host and host[1] else None
        out[page_id] = main_text(source or "", *wrappers.get(kind, (set(), None)))
    return out


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    want = brute_texts(rows)
    assert {r["page_id"]: r["text"] for r in q_op6(spark, sf).collect()} == want


def test_operator(spark):
    rows = [(i, f"http://blog.x/{i}", blog(i, f"story {i}")) for i in range(40)]
    rows += [(100, None, blog(100, "no host")), (101, "http://blog.x/n", None), (102, "http://other.y/", "<p>a"), (102, "http://other.y/", "<p>a"),
             (None, "http://blog.x/z", blog(7, "null id"))]
    df = spark.createDataFrame([(*r, "h", "t") for r in rows], "page_id bigint, url string, html string, host string, template string")
    out = extract_main_text(df).collect()
    assert len(out) == len(rows)
    got = {(r["page_id"], r["url"]): r["text"] for r in out}
    assert all(got[i, f"http://blog.x/{i}"] == f"story {i} More {i}." for i in range(40))
    assert got[100, None].startswith("My Blog") and got[101, "http://blog.x/n"] == "" and got[102, "http://other.y/"] == "a"
    assert got[None, "http://blog.x/z"] == "null id More 7."
    assert extract_main_text(df.limit(0)).count() == 0


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_whole_table_equals_the_article(spark, sf):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in q_op6(spark, sf).collect():
        article = re.search(r"<article>(.*)</article>", pages[r["page_id"]], re.S)[1]
        parts = re.split(r"</?(?:p|h1|br)>", re.sub(r"</?b>", "", article))
        want = " ".join(" ".join(html.unescape(p).split()) for p in parts if p.strip())
        assert r["text"] == want and r["n_chars"] == len(want)


def test_templates_of_every_layout_and_section(spark):
    """Two languages in one layout, a rare layout, many copies, and near copies of an article."""
    def page(menu, i):
        return (f"<html><body><div class=top><span>{menu}</span></div><div class=wrap><div class=text><p>story {i} {'w' * (i % 7)}</p></div></div>"
                "</body></html>")

    def forum(i):
        return f"<html><body><table class=forum><tr><td>Forum rules apply</td><td>post {i}</td></tr></table></body></html>"

    rows = [(i, f"http://two.x/{'en' if i % 2 else 'fr'}/{i}", page("Home and news" if i % 2 else "Accueil et infos", i)) for i in range(200)]
    rows += [(300 + i, f"http://two.x/f/t/{i}", forum(i)) for i in range(5)]
    rows += [(1000 + i, "http://hot.x/a", page("Menu of hot", 1)) for i in range(300)]
    rows += [(2000 + i, f"http://hot.x/b{i}", page("Menu of hot", 10 + i)) for i in range(4)]
    rows += [(3000 + i, f"http://near.x/{i}", f"<article><p>The same long article text on every page.</p><p>{i}</p></article>") for i in range(9)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r["page_id"]: r["text"] for r in extract_main_text(df).collect()}
    for i in range(200):
        assert got[i] == f"story {i} {'w' * (i % 7)}".strip()
    assert [got[300 + i] for i in range(5)] == [f"post {i}" for i in range(5)]
    assert {got[1000 + i] for i in range(300)} == {"story 1 w"}
    assert [got[2000 + i] for i in range(4)] == [f"story {10 + i} {'w' * ((10 + i) % 7)}".strip() for i in range(4)]
    assert got[3004] == "The same long article text on every page. 4"


def test_every_page_takes_part_in_the_wrapper(spark):
    """A block that 39 of 200 pages lack is template though eight pages may show
    otherwise; the wrapper in the tables is that of the list of all pages, deep
    pages included."""
    def page(i):
        extra = "" if i % 5 == 0 and i else "<div class=box>Read our other posts</div>"
        return (f"<html><body><div class=top><span>Blog</span></div>{extra}<div class=wrap><div class=text><p>story {i} {'x' * (i * 7 % 13)}</p>"
                f"<p>More of {i * i}.</p></div></div></body></html>")

    def deep(i):
        return "<div class=a>" * 70 + f"<p>told {i} times</p><p>and {i * 3} more</p>" + "</div>" * 70 + "<div class=z>Fixed line</div>"

    rows = [(i, f"http://all.x/{i}", page(i)) for i in range(200)] + [(300 + i, f"http://deep.x/{i}", deep(i)) for i in range(12)]
    rows += [(400 + i, f"http://all.x/copy{i}", page(5)) for i in range(300)]
    df = spark.createDataFrame(rows, "id bigint, link string, text string")
    laid = with_layout(df.select("id", "link", F.regexp_extract("link", "//([^/]*)", 1).alias("host"), F.col("text").alias("html")))
    got = {r["host"]: (set(r["template"]), r["slot"]) for r in induce_wrappers(laid).collect()}
    for host, made in (("all.x", [page(i) for i in range(200)]), ("deep.x", [deep(i) for i in range(12)])):
        assert got[host] == (set((w := induce_wrapper(made))[0]), w[1])
    assert got["deep.x"][1].count("div.a") == 70
    out = {r["id"]: r["text"] for r in extract_main_text(df, "id", "link", "text").select("id", "text").collect()}
    assert all(out[i] == f"story {i} {'x' * (i * 7 % 13)}".strip() + f" More of {i * i}." for i in range(200))
    assert out[303] == "told 3 times and 9 more"


def test_a_template_that_a_few_pages_hide(spark):
    """Nine of ten pages share a line; on two of these hosts eight sampled pages said otherwise."""
    def page(i):
        side = "Long words of the month are told at length in here" if i % 10 < 9 else f"A note of {i} only"
        return (f"<html><body><div class=top>Blog</div><div class=wrap><div class=text><p>Tale {i} is told</p><p>so {i * i}</p>"
                f"<div class=side>{side}</div></div></div></body></html>")

    rows = [(1000 * h + i, f"http://late{h}.x/{i}", page(i + 200 * h)) for h in (0, 1, 7) for i in range(200)]
    out = extract_main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    assert len(out) == 600 and not [r["page_id"] for r in out if "Long words" in r["text"]]
