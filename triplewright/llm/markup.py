"""A tolerant HTML reader: one pass, linear in the page, no tree in memory.

It yields blocks of text and media elements in page order, each with the element around it. What a caller wants to know of the
elements further out it puts into their state, which is handed down. A signature is a hash of the path of tags, classes and ids of
the block-level elements from the root, so equal places in pages of a site have equal signatures.
"""

from __future__ import annotations

import re
from hashlib import blake2b
from html import unescape
from typing import NamedTuple

_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_DECLARATION = re.compile(r"<[!?][^>]*>")
_ATTRIBUTE = re.compile(r"([a-zA-Z_:@][\w:.@-]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
#: Elements within a line: they don't end a block of text and are no places of their own.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big button canvas cite code data del dfn em font i input ins kbd label map mark math meter object output progress q rp rt ruby s samp select small span strike strong sub sup svg"
    " textarea time tt u var wbr picture img source audio video track br"
    " mfrac mi mn mo mover mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics g path text textpath tspan".split()
)
MEDIA = frozenset("img video audio".split())
#: Open elements that a start tag ends: name -> (those it ends, those it does not reach past).
ENDS = {
    **{t: (frozenset(["p"]), frozenset(["button", "table", "td", "th", "caption", "template", "object", "article", "section", "div"])) for t in "address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()},
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}


class Hidden:
    """The state of an element that isn't shown: its text is left out and it doesn't end the block of text around it."""


HIDDEN = Hidden()


class Element(NamedTuple):
    tag: str
    signature: int
    attributes: dict
    #: What the reader's caller made of it and of the elements around it.
    state: object
    #: Tags of the block-level elements directly in it.
    children: list
    #: The block-level element around it.
    outer: object


class Block(NamedTuple):
    """kind "text" (text is the block's text) or "media" (element is the media element)."""

    kind: str
    text: str
    element: Element


def attributes(raw: str) -> dict:
    return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(raw)}


def signature(parent: int, tag: str, attrs: dict) -> int:
    mark = f"{parent}/{tag}.{'.'.join(sorted(attrs.get('class', '').split()))}#{attrs.get('id', '')}"
    return int.from_bytes(blake2b(mark.encode(), digest_size=8).digest(), "little", signed=True)


def read(html: str, enter, leave=None):
    """Yields Blocks. enter(tag, attributes, outer state, signature) gives an element's state, HIDDEN being handed down without asking;
    leave(element) is called as it ends. An element within a line has the signature of the block-level element around it."""
    root = Element("", 0, {}, None, [], None)
    #: The open elements, and for each the nearest block-level element: itself or one around it.
    stack, around, pieces, at = [root], [root], [], 0
    #: Places on the stack of the open elements of each tag.
    places: dict[str, list[int]] = {}
    known: dict = {}

    def flush():
        text = " ".join("".join(pieces).split())
        pieces.clear()
        return Block("text", text, around[-1]) if text else None

    def ending():
        """The block of text that ends with the innermost element."""
        return flush() if pieces and stack[-1] is around[-1] and stack[-1].state is not HIDDEN else None

    def pop():
        element = stack.pop()
        around.pop()
        places[element.tag].pop()
        if leave:
            leave(element)

    last = html.rfind(">")  # no tag ends behind it
    while True:
        lt = html.find("<", at)
        shown = stack[-1].state is not HIDDEN
        if lt < 0:
            if shown:
                pieces.append(unescape(html[at:]))
            break
        if lt > at and shown:
            pieces.append(unescape(html[at:lt]))
        if html.startswith("<!--", lt):
            end = html.find("-->", lt + 4)
            at = len(html) if end < 0 else end + 3
            continue
        m = _TAG.match(html, lt) if lt < last else None
        if not m:
            m = _DECLARATION.match(html, lt) if lt < last else None
            if m:
                at = m.end()
            else:
                if shown:
                    pieces.append("<")
                at = lt + 1
            continue
        at = m.end()
        closing, tag, raw = m[1], m[2].lower(), m[3]
        if closing:
            if places.get(tag):
                place = places[tag][-1]
                while len(stack) > place:
                    if b := ending():
                        yield b
                    pop()
            continue
        if tag in ENDS:
            ended, stops = ENDS[tag]
            place = max((places[t][-1] for t in ended if places.get(t)), default=0)
            if place and place > max((places[t][-1] for t in stops if places.get(t)), default=0):
                while len(stack) > place:
                    if b := ending():
                        yield b
                    pop()
        attrs = attributes(raw) if raw else {}
        outer, inline = stack[-1], tag in INLINE
        if inline:
            mark = outer.signature
        else:
            key = (outer.signature, tag, attrs.get("class"), attrs.get("id"))
            if key not in known:
                known[key] = signature(outer.signature, tag, attrs)
            mark = known[key]
        state = HIDDEN if outer.state is HIDDEN else enter(tag, attrs, outer.state, mark)
        if state is not HIDDEN:
            if tag == "br":
                pieces.append(" ")
            elif (not inline or tag in MEDIA) and pieces and (b := flush()):
                yield b
        element = Element(tag, mark, attrs, state, outer.children if inline else [], around[-1])
        if not inline:
            outer.children.append(tag)
        if tag in MEDIA and state is not HIDDEN:
            yield Block("media", "", element)
        if tag in VOID or raw.endswith("/") and tag not in RAW:
            if leave:
                leave(element)
            continue
        places.setdefault(tag, []).append(len(stack))
        stack.append(element)
        around.append(around[-1] if inline else element)
        if tag in RAW:
            end = re.compile(f"</{re.escape(tag)}", re.I).search(html, at)
            end = end.start() if end else len(html)
            if tag == "xmp" and state is not HIDDEN:
                pieces.append(html[at:end])
            at = end
    if pieces and (b := flush()):
        yield b
    while len(stack) > 1:
        pop()
