"""What may come next in a class expression that is being typed."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triplewright.operators.browse import observed_fillers
from triplewright.operators.search import autocomplete
from triplewright.plans import mos

AFTER_PROPERTY = ("some", "only", "value", "min", "max", "exactly", "Self")
AFTER_CLASS = ("and", "or")


def expects(text: str) -> tuple[str, str, str | None]:
    """(kind, beginning, property): kind is entity, filler, number, restriction word or connective."""
    m = re.search(r"([\w:./#~-]*|'[^']*)$", text)
    beginning = m[1].lstrip("'")
    tokens = [t for x in mos._TOKEN.finditer(text[: m.start()]) if (t := x[0].strip())]
    last = tokens[-1].lower() if tokens else ""
    if last in ("min", "max", "exactly"):
        return "number", beginning, None
    if last in ("some", "only", "value"):
        return "filler", beginning, tokens[-2].strip("<>'") if len(tokens) > 1 else None
    if last.isdigit() and len(tokens) > 2:
        return "filler", beginning, tokens[-3].strip("<>'")
    if not tokens or last in ("and", "or", "not", "(", "inverse", "that"):
        return "entity", beginning, None
    return "word", beginning, tokens[-1].strip("<>'")


def suggest(index: DataFrame, quads: DataFrame, text: str, limit: int = 10) -> list[str]:
    """Labels or words, the best first."""
    kind, beginning, prop = expects(text)
    if kind == "number":
        return ["1", "2", "3"]
    if kind == "entity":
        return [r.label for r in autocomplete(index.where(F.col("type") != "annotation_property"), beginning, limit).collect()]
    resolved = None
    if prop:
        try:
            resolved = mos.resolve(index, {prop})[prop]
        except ValueError:
            pass
    if kind == "filler":
        named = [r.label for r in autocomplete(index.where("type in ('class', 'individual')"), beginning, limit).collect()] if beginning else []
        if resolved and not named:
            fillers = observed_fillers(quads, resolved, limit).select(F.expr("substr(filler, 2, length(filler) - 2)").alias("iri"), "n")
            named = [r.label for r in fillers.join(index.select("iri", "label"), "iri").orderBy(F.desc("n"), "label").limit(limit).collect()]
        return named
    is_property = resolved is not None and not index.where((F.col("iri") == resolved) & F.col("type").isin("object_property", "datatype_property")).isEmpty()
    return [w for w in (AFTER_PROPERTY if is_property else AFTER_CLASS) if w.lower().startswith(beginning.lower())]
