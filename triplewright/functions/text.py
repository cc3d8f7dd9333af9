"""Labels, local names, languages, IRIs and licenses as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def local_name(iri: Column) -> Column:
    """After the last #, else the last path segment; one trailing slash is ignored."""
    bare = F.regexp_replace(iri, "/$", "")
    return F.when(iri.contains("#"), F.substring_index(iri, "#", -1)).otherwise(F.substring_index(bare, "/", -1))


def normalise_label(label: Column) -> Column:
    """Lower case, punctuation but : < > to blanks, blanks collapsed, a leading article dropped."""
    spaced = F.trim(F.regexp_replace(F.regexp_replace(F.lower(label), r"(?U)[^\w\s:<>]", " "), r"(?U)\s+", " "))
    return F.regexp_replace(spaced, r"^(the|a|an) ", "")


def split_compound(name: Column) -> Column:
    """Blanks at case boundaries and in place of _ and -."""
    cut = F.regexp_replace(F.regexp_replace(name, r"([a-z0-9])([A-Z])", "$1 $2"), r"([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.regexp_replace(cut, r"[_-]", " ")


def humanise(name: Column) -> Column:
    """The local name in words, or as it is where nothing is left."""
    out = F.trim(F.regexp_replace(split_compound(name), r"\s+", " "))
    return F.when(out == "", name).otherwise(out)


def search_text(primary: Column, short: Column, labels: Column, synonyms: Column) -> Column:
    """Primary label, local name, labels and synonyms, each as it is and split, without repeats, joined by blanks."""
    every = F.filter(F.concat(F.array(primary, short), F.coalesce(labels, F.array()), F.coalesce(synonyms, F.array())), lambda x: x.isNotNull() & (x != ""))
    return F.array_join(F.array_distinct(F.flatten(F.transform(every, lambda x: F.array(x, split_compound(x))))), " ")


def canonical_language(tag: Column) -> Column:
    """Lower-cased primary subtag; an empty tag stays empty."""
    return F.split_part(F.lower(F.trim(tag)), F.lit("-"), F.lit(1))


def corrupt_label(label: Column) -> Column:
    """At least two question marks, in a run or a fifth of what isn't white space."""
    marks = F.length(label) - F.length(F.replace(label, F.lit("?"), F.lit("")))
    solid = F.length(F.regexp_replace(label, r"\s", ""))
    return F.coalesce((marks >= 2) & (label.contains("??") | (marks >= 0.2 * solid)), F.lit(False))


def clean_label(primary: Column, alternatives: Column, short: Column) -> Column:
    """The primary label, else the first clean alternative, else the local name in words."""
    usable = F.filter(F.coalesce(alternatives, F.array()), lambda x: ~corrupt_label(x) & (x != ""))
    return F.when(primary.isNotNull() & (primary != "") & ~corrupt_label(primary), primary).otherwise(F.coalesce(F.try_element_at(usable, F.lit(1)), humanise(short)))


def choose_label(labels: Column, lang: str | None, primary: Column) -> Column:
    """From a map language -> label: the language asked for, English, untagged, the smallest tag; without one the primary label."""
    if not lang:
        return primary
    return F.coalesce(labels[lang], labels["en"], labels[""], labels[F.array_min(F.map_keys(labels))], primary)


def choose_from_list(entries: Column, lang: str | None) -> Column:
    """From an array of (value, lang) in order: requested, English, untagged, first; with its own tag."""
    rank = lambda e: F.when(F.lit(bool(lang)) & (e.lang == (lang or "")), 0).when(e.lang == "en", 1).when(e.lang == "", 2).otherwise(3)
    ranked = F.transform(entries, lambda e, i: F.struct(rank(e).alias("r"), i.alias("i"), e.value.alias("value"), e.lang.alias("lang")))
    best = F.array_min(ranked)
    return F.struct(best["value"].alias("value"), best["lang"].alias("lang"))


def canonical_iri(iri: Column) -> Column:
    """Identity of an ontology: a redundant /name.ext behind a segment of the same name goes, then trailing # and /."""
    bare = F.regexp_replace(iri, r"(?i)/([^/#]+)/\1\.[A-Za-z0-9]+$", "/$1")
    return F.regexp_replace(bare, r"[#/]+$", "")


def instability(iri: Column) -> Column:
    """Why an IRI is no stable identity: file, date, version, or nothing."""
    return (
        F.when(iri.rlike(r"(?i)\.(owl|rdf|ttl|obo|xml|jsonld|nt|ofn|omn)$"), "file").when(iri.rlike(r"(19|20)\d\d[-/.]?\d\d[-/.]?\d\d"), "date").when(iri.rlike(r"(?i)/v?\d+(\.\d+)+(/|$)|/v\d+(/|$)"), "version").otherwise("")
    )


def shortname(prefix: Column, title: Column, iri: Column) -> Column:
    """Prefix, else the title as a slug, else the tail of the IRI; 2 to 64 characters of a-z, 0-9 and -."""
    slug = lambda c: F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    options = [slug(prefix), slug(title), slug(F.regexp_replace(local_name(iri), r"\.[A-Za-z0-9]+$", ""))]
    return F.substring(F.coalesce(*(F.when(F.length(o) >= 2, o) for o in options), F.lit("ontology")), 1, 64)


def curie(iri: Column) -> Column:
    """An OBO-style local id with its first _ as a colon, else the local name."""
    name = local_name(iri)
    return F.when(name.rlike(r"^[A-Za-z]+_\d+$"), F.regexp_replace(name, "_", ":")).otherwise(name)


def display_name(short: Column, iri: Column) -> Column:
    return F.coalesce(F.when(short != "", short), F.regexp_replace(local_name(iri), r"\.[A-Za-z0-9]+$", ""))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1))


def extension(url: Column) -> Column:
    """Extension of the last path segment; query and fragment are ignored."""
    path = F.regexp_replace(url, r"[?#].*$", "")
    return F.lower(F.regexp_extract(path, r"^[^:/]+://[^/]*/(?:.*/)?[^/]*\.([A-Za-z0-9]+)$", 1))


def namespace_token(namespace: Column) -> Column:
    """Last path segment without extension that isn't a version or a date."""
    parts = F.filter(F.split(F.regexp_replace(F.regexp_replace(namespace, r"^[a-z]+://[^/]*", ""), r"[#/]+$", ""), "[/#]"), lambda x: (x != "") & ~x.rlike(r"^v?\d[\d._-]*$"))
    return F.lower(F.regexp_replace(F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit("")), r"\.[A-Za-z0-9]+$", ""))


#: License identifiers, and the addresses and names that stand for them.
SPDX = ("CC0-1.0", "CC-BY-3.0", "CC-BY-4.0", "CC-BY-SA-3.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "CC-BY-ND-4.0", "CC-BY-NC-SA-4.0", "MIT", "Apache-2.0", "BSD-3-Clause", "GPL-3.0", "LGPL-3.0", "ODbL-1.0", "PDDL-1.0")


def spdx(text: Column) -> Column:
    """License identifier: stated as such, by its address, or by its name; null if unknown."""
    t = F.lower(F.trim(text))
    exact = F.coalesce(*(F.when(t == s.lower(), s) for s in SPDX))
    kind = F.upper(F.regexp_extract(t, r"creativecommons\.org/licenses/([a-z-]+)/", 1))
    version = F.regexp_extract(t, r"creativecommons\.org/licenses/[a-z-]+/([0-9.]+[0-9])", 1)
    by_address = (
        F.when(t.contains("creativecommons.org/publicdomain/zero"), "CC0-1.0").when((kind != "") & (version != ""), F.concat(F.lit("CC-"), kind, F.lit("-"), version))
        .when(t.contains("opensource.org/licenses/mit"), "MIT").when(t.contains("apache.org/licenses/license-2.0"), "Apache-2.0").when(t.contains("gnu.org/licenses/gpl-3"), "GPL-3.0").when(t.contains("opendatacommons.org/licenses/odbl"), "ODbL-1.0")
    )
    by_name = F.when(t.rlike(r"\bcc0\b|public domain"), "CC0-1.0").when(t.rlike(r"\bmit license\b"), "MIT").when(t.rlike(r"apache license"), "Apache-2.0")
    cc = F.regexp_extract(t, r"\bcc[ -](by(?:[ -](?:nc|nd|sa))*)[ -]?v?([0-9]\.[0-9])", 1)
    by_text = F.when(cc != "", F.concat(F.lit("CC-"), F.upper(F.replace(cc, F.lit(" "), F.lit("-"))), F.lit("-"), F.regexp_extract(t, r"\bcc[ -](by(?:[ -](?:nc|nd|sa))*)[ -]?v?([0-9]\.[0-9])", 2)))
    return F.coalesce(exact, by_address, by_name, by_text)


#: Media types that are RDF, and those that may be.
RDF_TYPES = (
    "text/turtle", "application/x-turtle", "application/rdf+xml", "application/ld+json",
    "application/n-triples", "application/n-quads", "application/trig",
    "text/n3", "text/rdf+n3", "application/owl+xml", "application/xml",
)
GENERIC_TYPES = ("application/octet-stream", "text/plain")
#: Fixed value: what RDF has among its first bytes, in any case.
RDF_MARKERS = r'(?i)@prefix|@base|rdf:RDF|<rdf:|owl:Ontology|<owl:|"@context"'


def rdf_media(content_type: Column, head: Column) -> Column:
    """Whether a response is RDF: by its media type, or by its first 4,096 bytes where the type is generic or missing. Never null."""
    kind = F.trim(F.lower(F.split_part(content_type, F.lit(";"), F.lit(1))))
    read = F.decode(F.substring(F.encode(head, "UTF-8"), 1, 4096), "ISO-8859-1")  # what is looked for is ASCII
    start = F.lower(F.regexp_replace(read, r"^\s+", ""))
    looks = read.rlike(RDF_MARKERS) | read.rlike(r"<https?://[^>\s]+>\s+<https?://[^>\s]+>") | (start.startswith("<?xml") & (start.contains("rdf") | start.contains("owl")))
    missing = content_type.isNull() | (content_type == "")
    return F.coalesce(kind.isin(*RDF_TYPES), F.lit(False)) | ((missing | kind.isin(*GENERIC_TYPES)) & F.coalesce(looks, F.lit(False)))


def word_similarity(query: str, label: Column) -> Column:
    """Greatest share of the query's trigrams found among those of one stretch of the label's words, words padded by two blanks before and one after.

    The stretches are the runs of consecutive words no longer than the query's words.
    """
    words = query.lower().split()
    grams = sorted({("  " + w + " ")[i : i + 3] for w in words for i in range(len(w) + 1)})
    wanted = F.array(*map(F.lit, grams))
    tokens = F.filter(F.split(F.lower(label), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    trigrams = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.concat(F.lit("  "), w, F.lit(" ")).substr(i, F.lit(3)))
    per_word = F.transform(tokens, trigrams)
    n = len(words)
    runs = F.when(F.size(per_word) > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.size(per_word) - n + 1, F.lit(1))), lambda i: F.array_distinct(F.flatten(F.slice(per_word, i, n)))))
    share = F.array_max(F.transform(runs, lambda r: F.size(F.array_intersect(r, wanted)) / F.lit(float(len(grams)))))
    return F.coalesce(share, F.lit(0.0))
