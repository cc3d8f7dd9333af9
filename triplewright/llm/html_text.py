"""Main text of web pages by a site style tree.

Pages of a host are merged by element signatures (paths of block-level tags, classes and ids). For each signature of a host two
importances come from entropies to the base of its number of pages: that of presentation (how evenly its sequences
of children differ) and that of content (how few pages share the text below it). They are mixed with the weight GAMMA per
child: a node without children counts by content alone. A branch goes from each page if it and all below it are of an importance below
LEAST_IMPORTANCE and enough pages of the host have it: so a block of text goes by its own element, and within an article by a container around it.

Importance decides first, on hosts of LEAST_PAGES pages and more. What it leaves on a page is then cut by what pages state: elements that are menus, headers, footers, forms,
adverts, comments and so on by tag, role, or the name of a class or id; this decides alone on hosts of few pages. A name states something if all of its
parts do (cookie-notice, ad_slot), so that related-work or rail-transport state nothing; ids of headings and paragraphs, which are made of their words,
never do, and inside an article classes of headings and paragraphs and ids of sections don't either. Within a line only a class of span, a and ins counts. A part that
stands for comments, adverts or notices of a site (blog-sidebar, google-ads) is enough on containers; what is in these goes too, but for articles inside
them. Last, if what is left holds an article or main element with more than headings,
only what is inside stays. Importance touches there only containers that carry a class or id, so that pages whose articles are copies
of each other keep their text. If importance, or a part of a name, leaves nothing of a page, its other text stays: a page of boilerplate alone keeps what nothing else states.

Rows repeated as a whole give a row each; other columns are ignored, whatever their names. Empty tables give no rows.
What isn't shown (scripts, hidden elements) and inline elements that state an advert or a form's part are left out of their
block, which goes on after them. White space within a block becomes one space, blocks are joined by line ends. Null pages give an empty text.
"""

from __future__ import annotations

import re
from functools import lru_cache
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triplewright.llm import markup
from triplewright.llm.common import stage, table
from triplewright.llm.markup import HIDDEN

GAMMA = 0.9
LEAST_IMPORTANCE = 0.75
#: A branch is judged if it is on so many pages of its host, however many pages that has.
LEAST_PAGES = 10
#: Low branches of a host that go to its pages as one list; beyond that each page gets those of its own branches.
MOST_LISTED = 1_000
#: Branches of low importance that are broadcast (some 16 bytes each), and partitions of a host beyond that.
MOST_BROADCAST, SALTS = 200_000, 64
HIDDEN_TAGS = frozenset("head title script style noscript template iframe canvas object noembed noframes desc defs metadata annotation annotation-xml".split())
STATED_TAGS = frozenset("nav footer aside form button select option textarea input label fieldset dialog menu".split())
STATED_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())
STATED_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices popup modal newsletter subscribe sidebar rail menu nav navbar navigation breadcrumb breadcrumbs"
    " footer masthead comment comments commentlist reply replies disqus share sharing social related recommended widget toolbar pagination pager login signup search skip alert disclaimer copyright".split()
)
#: Enough as one part of a container's name.
STRONG_PARTS = frozenset("ad ads adsbygoogle advert adverts advertisement advertising sponsor sponsored comment comments commentlist disqus cookie cookies gdpr sidebar newsletter breadcrumb breadcrumbs navbar".split())
#: Containers inside an article whose name's parts count, and inline elements whose class does.
_BOXES, _MARKED = frozenset("div ul ol".split()), frozenset("span a ins".split())
#: Names of layouts that hold the main text beside what they name.
_LAYOUT = frozenset("has with without no single main content page wrapper layout".split())
#: Parts of names that state nothing by themselves and don't keep a name from stating something.
_NEUTRAL = frozenset(
    "area bar block body bottom box button buttons col column container content desktop fixed full global group holder icons inner item items label left link links list main mobile module outer page panel placeholder primary region right row"
    " secondary section site slot sticky text thread top unit wide wrap wrapper".split()
)
#: Stated only outside article and main elements.
_OUTER_NAMES = frozenset("header topbar sitename".split())
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+|[^\W\d_]+")
_PROSE = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li blockquote pre table thead tbody tfoot tr td th dl dt dd figure figcaption hr".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: What is known of an element and those around it: stated, of low importance, inside an article or main element, inside a heading, stated by a part of a name.
STATED, LOW, MAIN, HEADING, PART = 1, 2, 4, 8, 16


@lru_cache(maxsize=20_000)
def stated(names: str, inside: bool) -> bool:
    """Whether one of the names (of classes or an id) states what isn't main text; inside: of an article or main element."""
    for name in names.split():
        words = {p.lower() for p in _PARTS.findall(name)} - _NEUTRAL
        words = {w for w in words if not w.isdigit()}
        if words and words <= (STATED_NAMES if inside else STATED_NAMES | _OUTER_NAMES):
            return True
    return False


@lru_cache(maxsize=20_000)
def stated_by_part(names: str) -> bool:
    for name in names.split():
        words = {p.lower() for p in _PARTS.findall(name)}
        if words & STRONG_PARTS and not words & _LAYOUT:
            return True
    return False


def naming(tag: str, attrs: dict, inside: bool) -> str:
    """The names of an element that may state something; inside: of an article or main element."""
    classes, ident = attrs.get("class", ""), attrs.get("id", "")
    if tag in ("html", "body", "main") or tag in _HEADINGS:
        return ""
    if tag in markup.INLINE:
        return classes if tag in _MARKED else ""
    if tag == "p":
        return "" if inside else classes
    return classes if inside and tag == "section" else f"{classes} {ident}".strip()


def enter(tag: str, attrs: dict, outer, signature: int = 0, low=frozenset()):
    """HIDDEN for what isn't shown, else the flags that hold for an element; low: signatures of low importance on the page's host."""
    state = outer or 0
    if tag in HIDDEN_TAGS:
        return HIDDEN
    is_stated = tag in STATED_TAGS or tag == "header" and not state & MAIN
    if attrs:
        if "hidden" in attrs or attrs.get("aria-hidden") == "true" or _STYLE.search(attrs.get("style", "")):
            return HIDDEN
        if attrs.get("role", "").lower() in STATED_ROLES:
            is_stated = True
        elif names := naming(tag, attrs, bool(state & MAIN)):
            is_stated = is_stated or stated(names, bool(state & MAIN) or tag == "article")
            if tag in _BOXES or tag not in _PROSE and not state & MAIN:
                state |= PART * stated_by_part(names)
    if tag in markup.INLINE:
        return HIDDEN if is_stated else state & ~PART | (outer or 0) & PART
    if is_stated:
        state |= STATED
    if tag in ("article", "main") or attrs.get("role") == "main":
        return state & ~(LOW | PART) | MAIN
    if tag in _HEADINGS:
        state |= HEADING
    if not state & MAIN:
        state &= ~LOW  # a branch goes if all below it is low: each block is judged by its own element
    if signature in low and (not state & MAIN or tag not in _PROSE and bool(attrs.get("class") or attrs.get("id"))):
        state |= LOW
    return state


def shown(tag: str, attrs: dict, outer, signature: int = 0):
    """HIDDEN for what isn't shown; nothing else is known of an element."""
    return HIDDEN if enter(tag, attrs, MAIN) is HIDDEN else 0


def _hash(text: str) -> int:
    return int.from_bytes(blake2b(text.encode(), digest_size=8).digest(), "little", signed=True)


def statistics(html: str) -> set[tuple[int, int, int, int]]:
    """Distinct (signature, kind, feature, children) of a page: kind 0 the node is there, 1 its children's sequence, 2 all the text below it."""
    out: set[tuple[int, int, int, int]] = set()
    below: dict[int, int] = {}

    def add(element, feature):
        below[id(element)] = hash((below.get(id(element), 0), feature))

    def leave(element):
        if element.state is HIDDEN or element.tag in markup.INLINE:
            return
        out.add((element.signature, 0, 0, 0))
        if element.children:
            out.add((element.signature, 1, _hash(" ".join(element.children)), len(element.children)))
        if feature := below.pop(id(element), None):
            out.add((element.signature, 2, feature, 0))
            add(element.outer, feature)

    for block in markup.read(html, shown, leave):
        if block.kind == "text":
            add(block.element, _hash(block.text))
    return out


def extract(html: str, low=frozenset(), rules: bool = True) -> str:
    """The main text, low being the signatures of low importance on the page's host. Without rules, importance alone decides."""
    blocks = [b for b in markup.read(html or "", lambda *a: enter(*a, low)) if b.kind == "text"]
    blocks = [b for b in blocks if not (b.element.state or 0) & LOW] or blocks
    if rules:
        blocks = [b for b in blocks if not (b.element.state or 0) & STATED]
        blocks = [b for b in blocks if not (b.element.state or 0) & PART] or blocks
    if rules and any((b.element.state or 0) & (MAIN | HEADING) == MAIN for b in blocks):
        blocks = [b for b in blocks if (b.element.state or 0) & MAIN]
    return "\n".join(b.text for b in blocks)


def host_of(url: str = "url"):
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1))


def style_tree(pages: DataFrame, least: float = LEAST_IMPORTANCE) -> DataFrame:
    """(host, sig): signatures of each host's branches of an importance below `least`; pages has host and html."""
    schema = "host string, sig long, kind int, feature long, width long, n long"

    def run(batches):
        for batch in batches:
            counts: dict = {}
            for host, html in zip(batch.column("host").to_pylist(), batch.column("html")):
                for row in statistics(html.as_py() or ""):
                    counts[host, *row] = counts.get((host, *row), 0) + 1
            if counts:
                columns = list(zip(*counts))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip([*columns, list(counts.values())], [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()])], ["host", "sig", "kind", "feature", "width", "n"])

    found = pages.select("host", "html").mapInArrow(run, schema)
    per_feature = found.groupBy("host", "sig", "kind", "feature").agg(F.sum("n").alias("n"), F.max("width").alias("width"))
    ln = F.log("n")
    nodes = per_feature.groupBy("host", "sig").agg(
        F.max(F.when(F.col("kind") == 0, F.col("n"))).alias("m"),
        F.sum(F.when(F.col("kind") == 1, F.col("n") * ln)).alias("spread"),
        F.sum(F.when(F.col("kind") == 1, F.col("n") * F.col("width"))).alias("width"),
        F.avg(F.when(F.col("kind") == 2, ln)).alias("shared"),
    )
    base = F.log("m")
    presentation = F.coalesce((base - F.col("spread") / F.col("m")) / base, F.lit(0.0))
    content = F.coalesce(1 - F.col("shared") / base, F.lit(0.0))
    weight = F.pow(F.lit(GAMMA), F.coalesce(F.col("width") / F.col("m"), F.lit(0.0)))
    return nodes.where(f"m >= {LEAST_PAGES}").where((1 - weight) * presentation + weight * content < least).select("host", "sig")


def with_lists(pages: DataFrame, low: DataFrame) -> DataFrame:
    """pages with their host's list of low branches. Up to MOST_BROADCAST of them are broadcast, so that no page is moved; beyond that hosts are
    dealt to SALTS partitions each, whose pages may be a large share of all."""
    if (low.agg(F.sum(F.size("low"))).first()[0] or 0) <= MOST_BROADCAST:
        return pages.join(F.broadcast(low), "host", "left")
    salted = low.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return pages.withColumn("salt", F.expr(f"int(pmod(xxhash64(url, length(html)), {SALTS}))")).join(salted, ["host", "salt"], "left").drop("salt")


def own_signatures(pages: DataFrame) -> DataFrame:
    """(host, page, sig) of pages (host, page, html): signatures of each page."""

    def run(batches):
        for batch in batches:
            rows = [(h, p, s) for h, p, html in zip(*(batch.column(c).to_pylist() for c in ("host", "page", "html"))) for s in {r[0] for r in statistics(html or "")}]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64()))], ["host", "page", "sig"])

    return pages.select("host", "page", "html").mapInArrow(run, "host string, page long, sig long")


def with_low(pages: DataFrame, low: DataFrame) -> DataFrame:
    """pages with low, the signatures among low (host, sig) that their host has, or for hosts of more than MOST_LISTED those that they have themselves."""
    sizes = stage(low.groupBy("host").agg(F.count("*").alias("branches")))
    crowded = sizes.where(f"branches > {MOST_LISTED}").select("host")
    listed = low.join(crowded, "host", "left_anti").groupBy("host").agg(F.collect_list("sig").alias("low"))
    if crowded.isEmpty():
        return with_lists(pages, listed)
    # few hosts, each with many branches
    theirs = pages.join(F.broadcast(crowded), "host", "left_semi").withColumn("page", F.xxhash64("html"))
    own = own_signatures(theirs).distinct().join(low, ["host", "sig"]).groupBy("host", "page").agg(F.collect_list("sig").alias("low"))
    rest = with_lists(pages.join(F.broadcast(crowded), "host", "left_anti"), listed)
    return rest.unionByName(theirs.join(own.hint("merge"), ["host", "page"], "left").drop("page"))


def main_text(df: DataFrame, id: str = "page_id") -> DataFrame:
    """(id, url, text, n_chars) of each page of df (id, url, html)."""
    pages = df.select(F.col(id), F.col("url"), F.col("html"), host_of().alias("host"))
    joined = with_low(pages, stage(style_tree(pages))).select(id, "url", "html", "low")

    def run(batches):
        sets: dict = {}
        for batch in batches:
            texts = []
            for html, low in zip(batch.column("html"), batch.column("low").to_pylist()):
                key = tuple(low or ())
                if len(sets) > MOST_LISTED:
                    sets.clear()
                texts.append(extract(html.as_py() or "", sets.setdefault(key, frozenset(key))))
            yield pa.RecordBatch.from_arrays([batch.column(id), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [id, "url", "text", "n_chars"])

    kind = df.schema[id].dataType.simpleString()
    return joined.mapInArrow(run, f"{id} {kind}, url string, text string, n_chars long")


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
