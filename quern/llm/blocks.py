"""Leaf blocks of a page: runs of text between the tags that break lines, with where they stand.

A block knows the hashed features of its tag path (names of its ancestors, the words of their
class, id and role), its text with character references decoded and white space turned into
single spaces, and how many of its characters are in links. What is never text (scripts, styles,
the head, controls of forms) makes no block. Markup may be broken: elements that are not closed end with
the one around them, end tags without a start are nothing, a tag that is cut off at the end of the page is
dropped.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from html import unescape
from zlib import crc32

PATH_FEATURES = 384

#: Elements of HTML that stand within a line, that have no content, whose content is no text of the page, and that end by themselves where one of the same kind starts.
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
SILENT = set("audio button canvas datalist head iframe math noframes noscript object script select style svg template textarea title video".split())
ALIKE = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: A paragraph ends where one of these starts.
ENDS_P = set("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol pre section table ul".split())
#: The end of any of these ends whichever is open, and so does the start of another.
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
#: Elements that an implied end does not reach across.
WALLS = set("article aside body div footer form header main nav section table td th ul ol dl".split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)""", re.S)
_NAMED = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for name in ("script", "style", "textarea", "title", "noscript", "iframe", "template", "noframes")}


@dataclass
class Leaf:
    path: tuple[int, ...]
    text: str
    link_chars: int
    names: frozenset[str]


def _slot(feature: str) -> int:
    return crc32(feature.encode()) % PATH_FEATURES


def attribute_words(attributes: str) -> list[str]:
    """Words of class, id and role: parts between punctuation and capital letters."""
    return [w.lower() for found in _NAMED.findall(attributes) for w in _WORD.findall(" ".join(found))]


class _Open:
    """An element that is open: its name and the features and names of the path down to it, each once however deep it is."""

    __slots__ = ("name", "slots", "names")

    def __init__(self, name: str, words: list[str], above: _Open | None) -> None:
        self.name = name
        own = {_slot(f"tag {name}"), *(_slot(f"word {w}") for w in words)}
        self.slots = frozenset(own | above.slots) if above else frozenset(own)
        names = {name, *(f".{w}" for w in words)}
        self.names = frozenset(names | above.names) if above else frozenset(names)
        if above and self.slots == above.slots and self.names == above.names:
            self.slots, self.names = above.slots, above.names


def leaves(html: str) -> list[Leaf]:
    """The blocks of a page that have text, in page order."""
    found: list[Leaf] = []
    stack: list[_Open] = []  # block elements
    opened: dict[str, int] = {}  # how many of each name are on the stack
    text: list[str] = []
    links = link_chars = silent = at = 0
    mute = ""  # the element whose content is no text, with how deep it is nested

    def end_block() -> None:
        nonlocal link_chars
        if text:
            shown = " ".join(unescape("".join(text)).split())
            if shown:
                top = stack[-1] if stack else None
                above = stack[-2].name if len(stack) > 1 else ""
                own = {_slot(f"leaf {top.name}"), _slot(f"pair {above} {top.name}")} | top.slots if top else ()
                found.append(Leaf(tuple(sorted(own)), shown, link_chars, top.names if top else frozenset()))
            text.clear()
        link_chars = 0

    def push() -> None:
        stack.append(_Open(name, attribute_words(attributes), stack[-1] if stack else None))
        opened[name] = opened.get(name, 0) + 1

    def cut(k: int) -> None:
        for element in stack[k:]:
            opened[element.name] -= 1
        del stack[k:]

    def add(piece: str) -> None:
        nonlocal link_chars
        if piece and not mute:
            text.append(piece)
            link_chars += len(piece.strip()) if links else 0

    while True:
        token = _TOKEN.search(html, at)
        if token is None:
            add(html[at:])
            break
        add(html[at : token.start()])
        at = token.end()
        name = (token[2] or token[5] or "").lower()
        if not name:
            continue
        closing, attributes = token[1] or token[4], token[3] or token[6] or ""
        if mute:
            if name == mute:
                silent += -1 if closing else 1
                mute = mute if silent else ""
            elif mute == "head" and name == "body":  # a head that was not closed
                mute, silent = "", 0
                push()
        elif name in SILENT:
            if not closing and not attributes.endswith("/"):
                if name in _RAW_END:
                    end = _RAW_END[name].search(html, at)
                    at = end.end() if end else len(html)
                else:
                    mute, silent = name, 1
        elif name == "br":
            add(" ")
        elif name in INLINE:
            if name == "a":
                links = 0 if closing else 1
        elif name in VOID:
            if name == "hr":
                end_block()
        elif closing:
            end_block()
            links = 0
            ended = HEADINGS if name in HEADINGS else {name}
            if any(opened.get(x) for x in ended):
                k = len(stack) - 1
                while stack[k].name not in ended:
                    k -= 1
                cut(k)
        else:
            end_block()
            ended = ALIKE.get(name, set()) | ({"p"} if name in ENDS_P else set()) | (HEADINGS if name in HEADINGS else set())
            k = len(stack) - 1
            while k >= 0 and stack[k].name not in ended and stack[k].name not in WALLS:
                k -= 1
            if k >= 0 and stack[k].name in ended:
                if name == "tr" and stack[k].name != "tr":
                    k -= 1 if k and stack[k - 1].name == "tr" else 0
                cut(k)
            push()
    end_block()
    return found
