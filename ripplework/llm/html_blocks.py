"""HTML into leaf blocks: text that no block-level tag interrupts, with the path of open tags above it."""

from __future__ import annotations

import html
import re

#: Elements whose content is never text of a page, those of them whose content is no markup, and those that end a block.
HIDDEN = frozenset("script style noscript template head title svg math iframe object canvas select textarea button datalist".split())
RAW = frozenset("script style title textarea".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr nobr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Open elements that a new one of the kind closes.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_SPACE = re.compile(r"[ \t-\r]+")


class Block:
    """text: white space collapsed and trimmed; path: names of open elements and their classes; linked: characters in links."""

    __slots__ = ("linked", "path", "text")

    def __init__(self, text: str, path: tuple[str, ...], linked: int):
        self.text, self.path, self.linked = text, path, linked


def _names(tag: str, attributes: str) -> tuple[str, ...]:
    found = [tag]
    if "=" in attributes:
        for m in _NAMED.finditer(attributes):
            found += [f".{x}" for x in re.split(r"[\s_-]+", (m[2] or m[3] or m[4] or "").lower()) if x]
    return tuple(found)


def _end_of(page: str, tag: str, at: int) -> int:
    """Where a hidden element that begins before `at` ends. Without an end tag, raw content goes on to the page's end, a head
    to the body, and other elements are taken for a tag alone. An element of the same kind inside has its own end."""
    depth = 1
    for m in re.compile(rf"<(/?){re.escape(tag)}(?=[\s/>])[^>]*>", re.I).finditer(page, at):
        if m[1]:
            depth -= 1
        elif tag not in RAW and not m[0].endswith("/>"):
            depth += 1
        if not depth:
            return m.end()
    if tag == "head":
        body = re.compile(r"(?=<(?:body|article|main|div|p|h1|header|nav|section)\b)", re.I).search(page, at)
        return body.end() if body else at
    return len(page) if tag in RAW else at


def blocks_of(page: str | None) -> list[Block]:
    """The leaf blocks of a page, in order. Unclosed tags, stray ends and cut-off pages are taken as they come."""
    page = page or ""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    pieces: list[str] = []
    linked, in_link, at = 0, 0, 0

    def flush() -> None:
        nonlocal linked
        text = _SPACE.sub(" ", "".join(pieces)).strip(" ")
        if text:
            out.append(Block(text, tuple(n for _, names in stack for n in names), min(linked, len(text))))
        pieces.clear()
        linked = 0

    n = len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            rest = page[at:]
            if (cut := re.search(r"<[/!a-zA-Z][^>]*\Z", rest)) is not None:  # a tag that the page's end cuts off
                rest = rest[: cut.start()]
            pieces.append(html.unescape(rest))
            break
        if m.start() > at:
            pieces.append(html.unescape(page[at : m.start()]))  # a reference ends where a tag begins
            linked += (m.start() - at) if in_link else 0
        at = m.end()
        name, attributes = m[2] or m[5], m[3] or m[6] or ""  # the second form: a quote that nothing closes
        if name is None:
            continue
        tag, closing = name.lower(), bool(m[1] or m[4])
        if tag == "br":
            pieces.append(" ")
        elif tag in HIDDEN:
            if not closing and not attributes.endswith("/"):
                at = _end_of(page, tag, at)
            if tag in ("button", "svg", "math", "canvas"):
                pieces.append(" ")
        elif tag in INLINE:
            in_link = max(0, in_link + (-1 if closing else 1)) if tag == "a" else in_link
        elif closing:
            flush()
            in_link = 0
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
        else:
            flush()
            in_link = 0
            if tag in VOID:
                continue
            closes = CLOSES.get(tag, set()) | ({"p"} if tag in _ENDS_P else set())
            if closes and stack and stack[-1][0] in closes:
                stack.pop()
            stack.append((tag, _names(tag, attributes)))
    flush()
    return out
