import html as library
import re
import time

from triplewright.llm import html_text


def plain(page):
    """What the tables' one layout holds: the article's heading and paragraphs."""
    inside = page[page.index("<article>") + 9 : page.index("</article>")]
    blocks = [" ".join(library.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", x))).split()) for x in re.split(r"</?(?:p|h1)>", inside)]
    return "\n".join(b for b in blocks if b)


def test_pages_equal_plain_reading(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    texts = {r.page_id: r.html for r in pages.collect()}
    rows = html_text.main_text(pages).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.text == plain(texts[r.page_id]) and r.n_chars == len(r.text)


def page(i, body):
    return f"<html><head><title>T{i}</title></head><body><div class='x'><span>All sites</span> of ours</div>{body}<div class='y'>Made with love</div></body></html>"


def test_style_tree_removes_what_a_site_repeats(spark):
    rows = [(i, f"http://A.example.com:80/{i}", page(i, f"<div class='z'><p>Story {i} of many</p><p>has its own text {i * 7}</p></div>"), 1) for i in range(30)]
    rows += [(100, "http://b.example.com/", page(0, "<div><p>One page only</p></div>"), 1)]
    rows += [(200 + i, "http://c.example.com/", page(0, "<article><p>The same</p><div class='share-it'>Share</div><div class='q'>Repeated box</div></article>"), 1) for i in range(20)]
    got = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()}
    assert got[3] == "Story 3 of many\nhas its own text 21"
    assert got[100] == "All sites of ours\nOne page only\nMade with love"
    assert got[205] == "The same"


def test_many_branches_are_joined_by_salted_hosts(spark, monkeypatch):
    rows = [(i, "http://a/", f"<div class=t>Same words</div><div><p>Story {i}</p></div>") for i in range(20)]
    monkeypatch.setattr(html_text, "MOST_BROADCAST", -1)
    got = html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r.page_id, r.text) for r in got) == [(i, f"Story {i}") for i in range(20)]


def test_a_layout_on_few_of_a_hosts_pages_is_judged(spark, monkeypatch):
    rows = [(i, f"http://a/{i}", f"<div class=main><p>Story {i}</p></div>") for i in range(1500)]
    rows += [(2000 + i, f"http://a/x{i}", f"<div class=t>Same words</div><div class=u><p>Other story {i}</p></div>") for i in range(12)]
    rows += [(3000 + i, f"http://b/{i}", f"<div class=v>Words of b</div><div><p>Story {i}</p></div>") for i in range(12)]
    expected = sorted((i, f"Other story {i - 2000}" if 2000 <= i < 3000 else f"Story {i % 3000}") for i, _, _ in rows)
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for most in (html_text.MOST_LISTED, 0):
        monkeypatch.setattr(html_text, "MOST_LISTED", most)
        assert sorted((r.page_id, r.text) for r in html_text.main_text(df).collect()) == expected


def test_rules_and_references():
    cases = {
        "": "",
        "plain &amp; simple": "plain & simple",
        "<p>a<p>b&nbsp;&lt;c&gt;<br>d &eacute; &#233; &am": "a\nb <c> d é é &am",
        "<article><header><h1>Title</h1></header><p>Body <b>bold</b>ly</p><footer>by</footer><section class='comments'><p>nice</p></section></article><aside>x</aside>": "Title\nBody boldly",
        "<body><header>Site</header><form><p>q</p></form><div id=cookie-notice>ok</div><main>m</main></body>": "m",
        "<script>var a='<p>no</p>'</script><style>p{}</style><p>yes</p><!-- <p>no</p> --><p hidden>no</p><p style='display: none'>no</p>": "yes",
        "<ul><li>one<li>two</ul><table><tr><td>1<td>2</table>": "one\ntwo\n1\n2",
        "<p>1 < 2 and <unclosed": "1 < 2 and <unclosed",
        "<article class=comment>c</article><p>kept</p>": "kept",
        '<p>a <span style="display:none">HIDDEN</span> b</p>': "a b",
        "<article><p>x <span class='ad'>BUY NOW</span>y <a class='share'>Share this</a> <button>Go</button></p></article>": "x y",
        "<article><div class='related-work'><p>Others</p></div><div class='rail-transport'><p>Trains run.</p></div><section id='comment-on-method'><p>M</p></section></article>": "Others\nTrains run.\nM",
        "<article>t<div class='related box'>no</div><div id=comment-12>no</div><div class=adBanner>no</div><div class='cookie_notice'>no</div></article>": "t",
        "<article><p>so <math><mi>x</mi><annotation>no</annotation></math> is</p></article>": "so x is",
        "<p>Hello <script>var a</script>world <template><p>no</p></template>again</p>": "Hello world again",
        "<article><h1>T</h1></article><div><p>Body</p></div>": "T\nBody",
        "<ul><li class='ad'>" + "<i>" * 70 + "ad<li>real</ul>": "real",
        "<div>a<div hidden><p>no</p></div>b</div>": "ab",
    }
    for source, text in cases.items():
        assert html_text.extract(source) == text, source


def test_names_in_articles_are_words_of_the_text():
    """Ids made from headings, and classes within sentences, state nothing; a class of a section does."""
    kept = ["<section id='search'><h2>Search</h2><p>How</p></section>", "<section id='navigation'><p>ship navigation</p></section>", "<h2 id='search'>S</h2>", "<h2 id='comments'>C</h2>", "<section id='sharing'><p>s</p></section>", "<p id='notice'>n</p>", "<p class='banner'>b</p>",
            "<p>a <mark class='skip'>b</mark> <b class='promotion'>c</b> <i class='rail'>d</i> <a id='reply'>e</a></p>"]
    for inner in kept:
        text = "\n".join(" ".join(x.split()) for x in re.sub(r"</?(?:section|mark|b|i|a)(?: [^>]*)?>", "", inner).replace("</h2>", "\n").split("\n"))
        text = "\n".join(x for x in re.sub(r"<[^>]*>", "", text).split("\n") if x)
        assert html_text.extract(f"<article>{inner}</article>") == text, inner
    assert html_text.extract("<article><p>x</p><section class='comments'><p>y</p></section></article>") == "x"


def test_parts_of_names_of_containers():
    for name in ("user-comments", "post-comments", "article-comments", "fb-comments", "comment-respond", "google-ads", "c-ad", "ad-300x250", "adsbygoogle", "blog-sidebar", "cookie-policy-bar"):
        for t in (f"<p>text</p><div class='{name}'><p>no</p></div>", f"<article><p>text</p><div class='{name}'><p>no</p></div></article>", f"<p>text</p><section id='{name}'>no</section>"):
            assert html_text.extract(t) == "text", t
    for t in ("<div class='has-sidebar'><p>text</p></div>", "<body class='no-sidebar'><p>text</p>", "<div class='blog-sidebar-layout'><article><p>text</p></article></div>", "<div class='blog-sidebar'><p>text</p></div>", "<article><section class='ad-hoc-networks'><p>text</p></section></article>"):
        assert html_text.extract(t) == "text", t


def test_the_tree_changes_pages_of_the_tables(spark, sf_dir):
    """Without the tree's branches other text is left by importance alone, with them what the rules leave too."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet".replace("sf0.001", "sf0.1")).withColumn("host", html_text.host_of())
    low: dict = {}
    for r in html_text.style_tree(pages).collect():
        low.setdefault(r.host, set()).add(r.sig)
    rows = [r for r in pages.collect() if r.host in low]
    assert len(rows) > 100
    changed = sum(html_text.extract(r.html, frozenset(low[r.host]), rules=False) != html_text.extract(r.html, rules=False) for r in rows)
    assert changed > 0
    assert all(html_text.extract(r.html, frozenset(low[r.host])) == plain(r.html) for r in rows)


def test_odd_pages(spark):
    long = "<p>word &amp; more</p>" * 60_000
    rows = [(1, None, None, 1, "k"), (2, None, "<p>x</p>", 1, "k"), (None, "u", "<p>y</p>", 1, "k"), (3, "http://a/", "", 1, "k"), (4, "http://a/", long, 1, "k"), (2, None, "<p>x</p>", 1, "k")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int, host string")
    got = sorted((r.page_id or 0, r.text, r.n_chars) for r in html_text.main_text(df).collect())
    whole = "\n".join(["word & more"] * 60_000)
    assert got == [(0, "y", 1), (1, "", 0), (2, "x", 1), (2, "x", 1), (3, "", 0), (4, whole, len(whole))]
    assert html_text.main_text(df.limit(0)).count() == 0


def test_importance_alone_decides_without_rules(spark, sf_dir):
    """The tables' boilerplate comes in some 60 variants over all hosts, so that a higher limit than the operator's is needed to tell it from content there."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet".replace("sf0.001", "sf0.1")).withColumn("host", html_text.host_of())
    low = {}
    for r in html_text.style_tree(pages, least=0.75).collect():
        low.setdefault(r.host, set()).add(r.sig)
    changed = 0
    for r in pages.collect():
        theirs = frozenset(low.get(r.host, ()))
        with_tree, without = html_text.extract(r.html, theirs, rules=False), html_text.extract(r.html, rules=False)
        assert set(plain(r.html).split("\n")) <= set(with_tree.split("\n"))
        changed += with_tree != without
    assert changed > 0


def test_long_pages_are_linear():
    shapes = ("<" * 200_000, "<a " * 100_000, "<b>" * 50_000, "<p>" * 50_000, "<!--" * 50_000, "<a href='" * 50_000, "</p>" * 50_000, "<div>" * 3_000 + "x", "<b>x<p>y</p>" * 8_000, "<div>x" * 16_000)
    shapes += ("<!" * 60_000, "<?" * 60_000, "<!" * 60_000 + ">", "<a" * 60_000)
    shapes += ("<p><button>" + "<ul>" * 10_000 + "<p></p>" * 10_000, "<li><i>x" * 12_000)
    for t in shapes:
        began = time.process_time()
        html_text.extract(t)
        html_text.statistics(t)
        assert time.process_time() - began < 20 * len(t) / 1e6, t[:40]  # a few microseconds a character; a square of the length would take far more


def test_time_grows_with_the_length():
    def seconds(n):
        began = time.process_time()
        for _ in range(max(1, 40_000 // n)):
            html_text.statistics("<b>x<p>y</p>" * n)
        return time.process_time() - began

    assert seconds(40_000) < 6 * seconds(5_000) + 0.5
