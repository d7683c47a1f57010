import math
import re
from collections import defaultdict

from convops.llm import html_extraction as H
from tests.conftest import SF01

SCHEMA = "page_id long, url string, html string, text string, host int"


def text(page):
    return "\n\n".join(b.text for b in H.chosen(H.blocks(page)))


def run(spark, rows):
    docs = spark.createDataFrame([(i, u, h, "x", 1) for i, u, h in rows], SCHEMA).repartition(2)
    return {r.page_id: r.text for r in H.extract(docs).collect()}


def test_article_without_its_surroundings():
    page = ("<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var t='</p>';</script></head><body>"
            "<nav><ul><li>menu</ul></nav><header>top</header><!-- ad --><div class='ad box'>buy</div><article><header><h1>A &amp; B"
            "</h1></header><p><b>one\n  two<br><p>three&nbsp;four</p><div class=share>share</div><form>f</form><p>5 &lt; 6 &#233;</p>"
            "</article><aside>side</aside><section id=comments><article class=comment><p>reader " + "x" * 500 +
            "</p></article></section><footer>&copy;</footer></body></html>")
    assert text(page) == "A & B\n\none two\n\nthree four\n\n5 < 6 é"


def test_broken_and_odd_pages():
    assert text(None) == text("") == text("<p>") == text("<!-- x") == text("<script>var a = 1") == ""
    assert text("plain") == "plain"
    assert text("a < b <p>c</p") == "a < b\n\nc"
    assert text("<main><p>x</main><p>y") == "x"
    assert text("<ul><li>1<li>2</ul><p title='>'>3</i></b>") == "1\n\n2\n\n3"
    assert text("<div>" * 5000 + "deep") == "deep"
    assert text("<p>" + "w " * 200_000 + "</p>") == ("w " * 200_000).strip()


def test_subtrees_that_recur_on_a_host_go(spark):
    def page(i):
        return (f"<body><div class=top><p>Welcome to the site</p></div><div><p>story {i}</p><p>same words</p></div>"
                f"<div class=low><span>About</span> <span>us</span></div></body>")
    rows = [(i, f"http://a.example/{i}", page(i)) for i in range(10)]
    rows += [(100, "http://b.example/1", page(100)), (101, None, page(101)), (102, "http://a.example/x", None),
             (103, "http://A.example:80/y", "<body><p>alone</p></body>")]
    got = run(spark, rows)
    assert got[3] == "story 3"
    assert got[100] == got[101].replace("101", "100") == "Welcome to the site\n\nstory 100\n\nsame words\n\nAbout us"
    assert got[102] == "" and got[103] == "alone"


def test_passages_that_articles_share_stay(spark):
    """At other places than a notice, which stands at the same one everywhere."""
    rows = []
    for i in range(20):
        paragraphs = [f"<p>own {i} {k}</p>" for k in range(6)]
        paragraphs.insert(1 + i % 5, "<p>shared</p>")
        rows.append((i, "http://a.example/", f"<article>{''.join(paragraphs)}<p>Subscribe to our newsletter today</p></article>"))
    got = run(spark, rows)
    assert all("shared" in t and "Subscribe" not in t and f"own {i} 5" in t for i, t in got.items())


def test_a_block_on_some_pages_of_a_host_goes(spark):
    """A tenth of 100 pages; copies of one page are one page and lose nothing."""
    rows = [(i, "http://a.example/", "<article>" + ("<div><p>Vote now</p></div>" if i % 10 == 0 else "")
             + f"<p>story {i}</p></article>") for i in range(100)]
    rows += [(200 + i, "http://b.example/", "<article><div><p>Copied</p></div><p>again</p></article>") for i in range(60)]
    rows += [(300 + i, "http://b.example/", f"<article><p>page {i}</p></article>") for i in range(20)]
    got = run(spark, rows)
    assert [got[i] for i in (0, 10, 11)] == ["story 0", "story 10", "story 11"]
    assert got[200] == got[259] == "Copied\n\nagain" and got[303] == "page 3"


def test_all_articles_and_words_in_names():
    assert text("<article><p>short</p></article><div><article><p>a much longer article</p></article></div><p>out</p>") \
        == "short\n\na much longer article"
    page = ("<article><p class='ad notice-period'>Legal notice period</p><div id='social-history'><p>Social history of "
            "Rome</p></div><div class='cookie-notice x'>We use cookies</div><p>a <span class=share>tweet</span> b</p></article>")
    assert text(page) == "Legal notice period\n\nSocial history of Rome\n\na b"


def test_counts_equal_a_plain_recount(spark):
    """All subtrees of the given pages, counted again without Spark."""
    pages = spark.read.parquet(f"{SF01}/pages.parquet")
    seen, prints = defaultdict(set), defaultdict(set)
    rows = pages.select("url", "html").collect()
    for r in rows:
        host = re.match(r"\w+://(?:[^/?#@]*@)?([^/?#:]+)", r["url"])[1].lower()
        found = H.blocks(r["html"])
        whole = tuple(b.text for b in H.chosen(found))
        prints[host].add(whole)
        for b in found:
            for n in b.within():
                seen[host, n].add(whole)
    want = defaultdict(set)
    for (host, n), on in seen.items():
        total = len(prints[host])
        root = math.sqrt(total)
        if len(on) >= max(5, min(total / 2, 4 * root) if n & 1 else min(total / 5, root)):
            want[host].add(n)
    assert len(seen) > len(rows)  # subtrees are hashed on every page
    got = {r["host"]: set(r["template"]) for r in H.templates(pages).collect()}
    assert got == dict(want)


def test_few_pages_are_no_template_and_empty_table(spark):
    rows = [(i, "http://a.example/", "<body><p>twice</p></body>") for i in range(2)]
    assert run(spark, rows) == {0: "twice", 1: "twice"}
    assert run(spark, []) == {}
