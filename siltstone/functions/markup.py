"""HTML as a stream of tags: one pass over a page with a stack of open elements."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

# Fixed values of the HTML standard: elements without content, with raw text, and that begin a new block; what an opening tag closes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe noframes xmp".split())
BLOCKS = frozenset(
    "address article aside blockquote body dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li "
    "main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: An opening tag of the key closes an open element of the first set, unless one of the second was opened after it.
CLOSES = {tag: ({"p"}, {"button", "table", "td", "th", "body"}) for tag in BLOCKS - {"li", "dd", "dt", "option", "optgroup", "td", "th", "tr", "tbody", "thead", "tfoot", "html", "body", "legend"}} | {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "option": ({"option"}, {"select", "datalist"}),
    "td": ({"td", "th"}, {"table"}), "th": ({"td", "th"}, {"table"}), "tr": ({"tr"}, {"table"}), "tbody": ({"thead", "tbody"}, {"table"}), "tfoot": ({"thead", "tbody"}, {"table"}),
}
#: Elements within a block whose text is told.
NAMED = ("a", "button")
REGIONS = frozenset("nav main article aside header footer head".split())

# a quoted value may hold ">"; no part is tried twice
_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*\"|'[^']*')?+)*+)>")
_ATTRIBUTE = re.compile(r"([^\s=/>\"'][^\s=/>]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")


@dataclass(slots=True)
class Element:
    """An element as it was opened: its parent's place among the page's elements, its region (innermost of REGIONS) and number of open ancestors.

    `text` is what stands in it: all of raw text, titles, links and buttons (but what a further one of the kind inside has), of blocks what no block inside holds, of others nothing.
    """

    tag: str
    parent: int | None
    region: str
    depth: int
    attributes: dict[str, str]
    parts: list[str] = field(default_factory=list)

    @property
    def text(self) -> str:
        raw = "".join(self.parts)
        return raw if self.tag in RAW and self.tag != "title" else squeezed(raw)


@dataclass
class Page:
    """A parsed page: its elements in the order they open, and the runs of text between borders of blocks as (element, region, text)."""

    elements: list[Element]
    runs: list[tuple[int | None, str, str]]


def squeezed(text: str) -> str:
    return " ".join(html.unescape(text).split())


def attributes_of(raw: str) -> dict[str, str]:
    """Attributes by lower-case name; the first of a name counts, one without a value is empty."""
    found: dict[str, str] = {}
    for name, double, single, bare in _ATTRIBUTE.findall(raw):
        found.setdefault(name.lower(), html.unescape(double or single or bare))
    return found


def parsed(text: str | None) -> Page:
    """Read a page in one pass, in time linear in its length.

    Comments, declarations and the content of raw elements hold no tags. A closing tag closes the innermost open element of its name with all that
    is open inside, and nothing if none is open; opening tags close what CLOSES says; the page's end closes the rest, and a tag or comment that it cuts off is left out.
    """
    text = text or ""
    elements: list[Element] = []
    runs: list[tuple[int | None, str, str]] = []
    stack: list[int] = []
    n_open: dict[str, int] = {}
    regions, blocks = [""], [None]  # innermost last
    named: dict[str, list[int]] = {tag: [] for tag in NAMED}
    part: list[str] = []

    def end_run() -> None:
        whole = squeezed("".join(part))
        if whole:
            runs.append((blocks[-1], regions[-1], whole))
        part.clear()

    def close() -> None:
        k = stack.pop()
        tag = elements[k].tag
        n_open[tag] -= 1
        if tag in NAMED:
            named[tag].pop()
        if tag in BLOCKS:
            end_run()
            blocks.pop()
        if tag in REGIONS:
            regions.pop()

    def say(raw: str) -> None:
        if "head" in regions:
            return
        part.append(raw)
        if blocks[-1] is not None:
            elements[blocks[-1]].parts.append(raw)
        for open_ in named.values():
            if open_:
                elements[open_[-1]].parts.append(raw)

    at = 0
    while at < len(text):
        begin = text.find("<", at)
        if begin < 0:
            say(text[at:])
            break
        if begin > at:
            say(text[at:begin])
        if text.startswith("<!--", begin):
            end = text.find("-->", begin + 4)
            if end < 0:
                break
            at = end + 3
            continue
        after = text[begin + 1 : begin + 3]
        if after[:1] in ("!", "?") or (after[:1] == "/" and not after[1:2].isalpha()):
            end = text.find(">", begin)
            if end < 0:
                break
            at = end + 1
            continue
        if not after[:1].isalpha() and after[:1] != "/":
            say("<")
            at = begin + 1
            continue
        found = _TAG.match(text, begin)
        if not found:
            break
        at, tag = found.end(), found[2].lower()
        if found[1]:
            if n_open.get(tag):
                while elements[stack[-1]].tag != tag:
                    close()
                close()
            continue
        closed, fence = CLOSES.get(tag, ((), ()))
        if any(n_open.get(c) for c in closed):
            for k in range(len(stack) - 1, -1, -1):
                if elements[stack[k]].tag in closed:
                    while len(stack) > k:
                        close()
                    break
                if elements[stack[k]].tag in fence:
                    break
        if tag == "body" and n_open.get("head"):
            while n_open["head"]:
                close()
        if tag == "br":
            say(" ")
        if tag in BLOCKS:
            end_run()
        if tag in REGIONS:
            regions.append(tag)
        elements.append(Element(tag, stack[-1] if stack else None, regions[-1], len(stack), attributes_of(found[3]) if found[3].strip() else {}))
        if tag in VOID:
            continue
        if tag in RAW:
            end = _raw_end(text, tag, at)
            elements[-1].parts.append(text[at:end])
            at = end
            continue
        stack.append(len(elements) - 1)
        n_open[tag] = n_open.get(tag, 0) + 1
        if tag in NAMED:
            named[tag].append(stack[-1])
        if tag in BLOCKS:
            blocks.append(stack[-1])
    end_run()
    return Page(elements, runs)


_ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE) for tag in RAW}


def _raw_end(text: str, tag: str, at: int) -> int:
    found = _ENDS[tag].search(text, at)
    return found.start() if found else len(text)
