"""Saved queries: a library as JSON, or single .rq texts whose leading comments hold their data."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from triplewright.plans.sparql_parser import SparqlError, guard

_FIELD = re.compile(r"^#\s*\+?\s*(title|name|description|summary|tags?)\s*:\s*(.*)$", re.I)


@dataclass
class Saved:
    title: str
    text: str
    description: str = ""
    tags: list[str] = field(default_factory=list)


def _entry(title, text, description="", tags=()) -> Saved | None:
    """None for an entry without a title or a text, or whose text this engine refuses."""
    if not (isinstance(title, str) and title.strip() and isinstance(text, str) and text.strip()):
        return None
    try:
        guard(text)
    except SparqlError:
        return None
    if isinstance(tags, str):
        tags = re.split(r"[,;]", tags)
    return Saved(title.strip(), text.strip(), str(description or "").strip(), [t.strip() for t in tags if isinstance(t, str) and t.strip()])


def parse_library(content: str) -> list[Saved]:
    """Entries of {"starters": [...]} or of a list; bad ones are skipped."""
    data = json.loads(content)
    items = data.get("starters", []) if isinstance(data, dict) else data
    out = (_entry(i.get("title") or i.get("name"), i.get("query") or i.get("sparql"), i.get("description", ""), i.get("tags") or ()) for i in items if isinstance(i, dict))
    return [e for e in out if e]


def parse_rq(content: str, name: str = "") -> Saved | None:
    """A query text; comments such as "# title: ..." before it give title, description and tags, the file's name stands in for a title."""
    found: dict[str, str] = {}
    for line in content.splitlines():
        if line.strip() and not line.lstrip().startswith("#"):
            break
        if m := _FIELD.match(line.strip()):
            found[m[1].lower()] = m[2].strip()
    title = found.get("title") or found.get("name") or re.sub(r"\.rq$", "", name)
    return _entry(title, content, found.get("description") or found.get("summary", ""), found.get("tags") or found.get("tag") or ())
