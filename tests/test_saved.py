from triplewright.operators import browse, indexing
from triplewright.plans import saved
from triplewright.plans.mos_suggest import expects, suggest

from .test_sources import pizza  # noqa: F401


def test_library():
    text = '{"starters": [{"title": "All", "query": "SELECT * { ?s ?p ?o }", "tags": ["a", ""]}, {"title": "", "query": "x"}, {"title": "Bad", "query": "DELETE { }"}, 7]}'
    assert [(s.title, s.tags) for s in saved.parse_library(text)] == [("All", ["a"])]
    one = saved.parse_rq("# title: Mine\n# tags: x, y\nSELECT * { ?s ?p ?o } # title: no", "f.rq")
    assert (one.title, one.tags) == ("Mine", ["x", "y"]) and saved.parse_rq("ASK { ?s ?p ?o }", "named.rq").title == "named" and saved.parse_rq("DROP ALL", "x.rq") is None


def test_expects():
    assert expects("Piz") == ("entity", "Piz", None)
    assert expects("Pizza and has")[0] == "entity"
    assert expects("hasTopping some To") == ("filler", "To", "hasTopping")
    assert expects("hasTopping min ")[0] == "number" and expects("hasTopping min 2 ")[0] == "filler"
    assert expects("hasTopping s") == ("word", "s", "hasTopping")


def test_suggest(pizza):  # noqa: F811
    index = indexing.entity_index(pizza).cache()
    assert suggest(index, pizza, "hasTopping s") == ["some", "Self"]
    assert suggest(index, pizza, "Pizza ") == ["and", "or"]
    assert suggest(index, pizza, "hasTopping some ")[0] == "Tomato"
    assert "Margherita" in suggest(index, pizza, "Pizza and Marg")


def test_routes():
    assert [browse.route(q) for q in ("http://ex/a", "a and b", "p some q", "ab", "pizza", "two words")] == ["entity", "expression", "expression", "keyword", "semantic", "semantic"]
