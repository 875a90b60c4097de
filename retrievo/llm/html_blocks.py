"""Leaf blocks of a page in order, each with the elements that it stands in. Broken markup is read as far as it goes."""

from __future__ import annotations

import re
from html import unescape
from typing import NamedTuple

# Elements of the HTML standard by how their content is read.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("iframe noembed noframes noscript script style svg template textarea title xmp".split())
BLOCK = frozenset("""address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset
figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol
optgroup option p pre search section select summary table tbody td tfoot th thead tr ul""".split())
CLOSED_BY_LIKE = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
                  "th": ("td", "th"), "option": ("option",)}

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""", re.S)
_NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_PART = re.compile(r"[a-z]+")


class Block(NamedTuple):
    text: str
    chain: tuple  # (element, name parts) from the outermost
    linked: float  # share of the text inside links
    breaks: int


def name_parts(attributes: str) -> tuple[str, ...]:
    """Lower-case letter runs of class, id and role."""
    spread = re.sub(r"([a-z])([A-Z])", r"\1 \2", " ".join(m.strip("\"'") for m in _NAMES.findall(attributes)))
    return tuple(dict.fromkeys(_PART.findall(spread.lower()))) if spread else ()


def blocks(html: str) -> list[Block]:
    out: list[Block] = []
    chain: list[tuple] = []
    held: list[str] = []
    linked, links, breaks = 0, 0, 0

    def close() -> None:
        nonlocal linked, breaks
        text = " ".join(unescape("".join(held)).split())
        if text:
            out.append(Block(text, tuple(chain), min(1.0, linked / len(text)), breaks))
        held.clear()
        linked = breaks = 0

    at = 0
    while True:
        found = _TAG.search(html, at)
        piece = html[at:found.start() if found else len(html)]
        if piece:
            held.append(piece)
            linked += len(piece) if links else 0
        if not found:
            break
        at = found.end()
        name = (found[2] or "").lower()
        if not name:
            continue
        if found[1]:
            if name == "a":
                links = max(0, links - 1)
            elif name in BLOCK and any(e == name for e, _ in chain):
                close()
                while chain.pop()[0] != name:
                    pass
            continue
        if name in RAW:
            end = re.compile(rf"</{name}\b[^>]*>|\Z", re.I).search(html, at)
            at = end.end()
            held.append(" ")
        elif name == "br":
            held.append(" ")
            breaks += 1
        elif name == "a":
            links = 1
        elif name in BLOCK:
            close()
            links = 0
            if chain and chain[-1][0] == "p":
                chain.pop()
            while chain and chain[-1][0] in CLOSED_BY_LIKE.get(name, ()):
                chain.pop()
            if name not in VOID and not found[3].endswith("/"):
                chain.append((name, name_parts(found[3])))
    close()
    return out
