"""RDF terms as strings, read and compared by column expressions that stay in generated code.

<iri>, _:label, and "lexical" followed by nothing, @lang or ^^<datatype>. Equal strings are equal terms.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

XSD = "http://www.w3.org/2001/XMLSchema#"
_LITERAL = r'(?s)^"(.*)"(?:@([A-Za-z0-9-]+)|\^\^<([^>]*)>)?$'
NUMERIC = [XSD + t for t in "integer decimal double float int long short byte nonNegativeInteger positiveInteger negativeInteger nonPositiveInteger unsignedInt unsignedLong unsignedShort unsignedByte".split()]

WHOLE = [t for t in NUMERIC if t.removeprefix(XSD) not in ("decimal", "double", "float")]


def iri(value: Column) -> Column:
    return F.concat(F.lit("<"), value, F.lit(">"))


def plain(value: Column) -> Column:
    return F.concat(F.lit('"'), value, F.lit('"'))


def tagged(value: Column, lang: str) -> Column:
    return F.concat(F.lit('"'), value, F.lit(f'"@{lang}'))


def typed(value: Column, datatype: str) -> Column:
    return F.concat(F.lit('"'), value.cast("string"), F.lit(f'"^^<{datatype}>'))


def is_iri(t: Column) -> Column:
    return t.startswith("<")


def is_blank(t: Column) -> Column:
    return t.startswith("_:")


def is_literal(t: Column) -> Column:
    return t.startswith('"')


def lexical(t: Column) -> Column:
    """STR(): the IRI, or the literal's lexical form; null for blank nodes."""
    return F.when(is_iri(t), t.substr(F.lit(2), F.length(t) - 2)).when(is_literal(t), F.regexp_extract(t, _LITERAL, 1))


def lang(t: Column) -> Column:
    return F.when(is_literal(t), F.regexp_extract(t, _LITERAL, 2))


def datatype(t: Column) -> Column:
    dt = F.regexp_extract(t, _LITERAL, 3)
    tag = F.regexp_extract(t, _LITERAL, 2)
    return F.when(is_literal(t), F.when(tag != "", F.lit("http://www.w3.org/1999/02/22-rdf-syntax-ns#langString")).when(dt != "", dt).otherwise(F.lit(XSD + "string")))


def _of_type(types: list[str], value: str) -> str:
    names = "|".join(t.removeprefix(XSD) for t in types)
    return rf'^"\s*({value})\s*"\^\^<{re.escape(XSD)}(?:{names})>$'


_NUMBER, _INTEGER = _of_type(NUMERIC, r"[^\"]*?"), _of_type(WHOLE, r"[+-]?\d+")
_STRING_END, _TRUE, _FALSE = f'"^^<{XSD}string>', *([f'"{x}"^^<{XSD}boolean>' for x in names] for names in (("true", "1"), ("false", "0")))
_ZONE = r"(Z|[+-]\d\d:\d\d)?"
_MOMENT = {"dateTime": rf'^"(-?\d{{4,}}-\d\d-\d\dT\d\d:\d\d:\d\d(?:\.\d+)?){_ZONE}"\^\^<{re.escape(XSD)}dateTime>$', "date": rf'^"(-?\d{{4,}}-\d\d-\d\d){_ZONE}"\^\^<{re.escape(XSD)}date>$'}
#: Types whose values are compared; literals of others are equal only as terms.
_KNOWN = rf"\^\^<{re.escape(XSD)}(?:{'|'.join([*(t.removeprefix(XSD) for t in NUMERIC), 'string', 'boolean', 'dateTime', 'date'])})>$"


def number(t: Column) -> Column:
    """Value of a numeric literal, null for any other term."""
    return F.regexp_extract(t, _NUMBER, 1).try_cast("double")


def integer(t: Column) -> Column:
    """Value of a literal of an integer type with up to 38 digits, null for any other term."""
    return F.regexp_extract(t, _INTEGER, 1).try_cast("decimal(38,0)")


def string(t: Column) -> Column:
    """A plain string's characters, null for any other term."""
    text = lambda end: t.substr(F.lit(2), F.length(t) - 1 - len(end))
    return F.when(t.startswith('"'), F.when(t.endswith(_STRING_END), text(_STRING_END)).when(t.endswith('"'), text('"')))


def boolean(t: Column) -> Column:
    return F.when(t.isin(_TRUE), True).when(t.isin(_FALSE), False)


def moment(t: Column, kind: str) -> Column:
    """Value of a dateTime or date, without a zone taken as UTC; null for any other term."""
    at = F.regexp_extract(t, _MOMENT[kind], 1)
    if kind == "date":
        return at.try_cast("date")
    zone = F.regexp_extract(t, _MOMENT[kind], 2)
    return F.when(at != "", F.concat(at, F.when(zone == "", "Z").otherwise(zone)).try_cast("timestamp"))


def unknown(t: Column) -> Column:
    """Whether a term is a literal of a type that isn't known: it can't be said to differ from another literal."""
    return t.startswith('"') & t.endswith(">") & ~t.rlike(_KNOWN)


def lexical_of(constant: str) -> str:
    """What stands between the quotes of a literal."""
    return constant[1 : constant.rindex('"')]


def kind_of(constant: str) -> str:
    """iri, blank, num, str, bool, dateTime, date, lang or other: what a constant term is compared as."""
    if not constant.startswith('"'):
        return "blank" if constant.startswith("_:") else "iri"
    if constant.endswith('"') or constant.endswith(_STRING_END):
        return "str"
    if not constant.endswith(">"):
        return "lang"
    if constant in _TRUE or constant in _FALSE:
        return "bool"
    return "num" if re.match(_NUMBER, constant) else next((k for k, pattern in _MOMENT.items() if re.match(pattern, constant)), "other")


def from_number(n: Column) -> Column:
    """A number as a term: whole numbers as integers, others as decimals."""
    whole = n == F.floor(n)
    return F.when(whole, typed(F.floor(n).cast("long"), XSD + "integer")).otherwise(typed(n, XSD + "decimal"))


def from_boolean(b: Column) -> Column:
    return typed(b, XSD + "boolean")


def sort_keys(t: Column) -> list[Column]:
    """Unbound, blank nodes, IRIs, literals; numbers by value, others by lexical form, then by the whole term."""
    kind = F.when(t.isNull(), 0).when(is_blank(t), 1).when(is_iri(t), 2).otherwise(3)
    return [kind, number(t), lexical(t), t]
