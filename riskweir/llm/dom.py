"""HTML to a tree of blocks: elements that lay out blocks, and runs of running text as leaves."""

from __future__ import annotations

import re
from functools import lru_cache
from html import unescape

# Fixed values of the HTML standard: elements without content, elements whose content is text, elements that begin a block,
# and elements that aren't rendered as text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes noscript".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html "
    "legend li listing main menu nav ol optgroup option p plaintext pre search section summary table tbody td tfoot th thead tr ul".split()
)
UNSEEN = frozenset("audio button canvas datalist head iframe map math noscript object picture script select style svg template textarea title video".split())
#: A block that begins closes an open paragraph; these close an open one of their own kind up to the element that holds them.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tr", "td", "th", "tbody", "thead", "tfoot", "caption"}, {"table"}),
    "tfoot": ({"tr", "td", "th", "tbody", "thead", "tfoot", "caption"}, {"table"}), "thead": ({"tr", "td", "th", "caption"}, {"table"}), "option": ({"option"}, {"datalist", "body"}),
}
_TOKEN = re.compile(
    r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*+(?:>|\Z)|</([a-zA-Z][^\s/>]*+)[^>]*+(?:>|\Z)|</[^a-zA-Z][^>]*+(?:>|\Z)"""
    r"""|<([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z))?+)*+)(>|\Z)""", re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']++)(?:\s*+=\s*+(?:"([^"]*+)"?|'([^']*+)'?|([^\s>]++)))?""")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")


@lru_cache(1 << 14)
def attributes(text: str) -> tuple[tuple[str, ...], str | None]:
    """Words of class, id, role and names of data attributes, and the value of ``data-main``."""
    words, label = [], None
    for name, *values in _ATTRIBUTE.findall(text):
        name, value = name.lower(), next((v for v in values if v), "")
        if name == "data-main":
            label = value
        elif name in ("class", "id", "role", "itemprop", "aria-label"):
            words += [w.lower() for w in _WORDS.findall(unescape(value)) if not w.isdigit()]
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            words.append("hidden")
        elif name.startswith("data-"):
            words += name[5:].split("-")
    return tuple(dict.fromkeys(words)), label


class Tree:
    """Nodes in page order, parents first. A leaf is a run of text; ``text`` is None for an element."""

    def __init__(self) -> None:
        self.parent, self.tag, self.words, self.text, self.links, self.label = [], [], [], [], [], []

    def add(self, parent: int, tag: str, words: tuple[str, ...] = (), text: str | None = None, links: int = 0, label: str | None = None) -> int:
        for column, value in ((self.parent, parent), (self.tag, tag), (self.words, words), (self.text, text), (self.links, links), (self.label, label)):
            column.append(value)
        return len(self.parent) - 1


def parse(html: str) -> Tree:
    """The tree of a page, whatever is missing or wrong in it.

    Character references are decoded, white space becomes one space, scripts, styles, comments and what else isn't text are left out. Inline
    elements belong to their run; a line break is white space. Linear in the length of the page.
    """
    tree = Tree()
    open_ = [(tree.add(-1, "html"), "html")]
    run: list[str] = []
    linked, anchors, at, end = 0, 0, 0, len(html)

    def flush() -> None:
        nonlocal linked
        text = " ".join(" ".join(run).split()) if len(run) == 1 else " ".join("".join(run).split())
        if text:
            tree.add(open_[-1][0], "#text", (), text, min(linked, len(text)))
        run.clear()
        linked = 0

    def text(piece: str) -> None:
        nonlocal linked
        piece = unescape(piece) if "&" in piece else piece
        run.append(piece)
        if anchors:
            linked += len(piece.strip())

    def close(names: set[str], within: set[str]) -> None:
        """Closes the outermost open element of these names inside the nearest of the others."""
        last = None
        for k in range(len(open_) - 1, 0, -1):
            if open_[k][1] in within:
                break
            if open_[k][1] in names:
                last = k
        if last:
            del open_[last:]

    while at < end:
        found = _TOKEN.search(html, at)
        if not found:
            text(html[at:])
            break
        if found.start() > at:
            text(html[at:found.start()])
        at = found.end()
        closing, opening, attrs, _ = found.groups()
        if opening:
            name = opening.lower()
            if name in RAW or name in UNSEEN:
                if name == "head":  # ends where the first element that a head can't have begins
                    continue
                if not attrs.endswith("/") or name in RAW:
                    at = _after(html, name, at)
            elif name == "br":
                run.append(" ")
            elif name == "a":
                anchors = 1
            elif name in BLOCKS:
                flush()
                anchors = 0
                if name in ("html", "body"):
                    if name == "body" and len(open_) == 1:
                        words, label = attributes(attrs)
                        open_.append((tree.add(0, "body", words, label=label), "body"))
                    continue
                if name in CLOSES:
                    close(*CLOSES[name])
                else:
                    close({"p"}, {"td", "th", "table", "body"})
                if name[0] == "h" and name[1:].isdigit() and open_[-1][1][0] == "h" and open_[-1][1][1:].isdigit():
                    open_.pop()
                if name not in VOID:
                    words, label = attributes(attrs) if attrs.strip() else ((), None)
                    open_.append((tree.add(open_[-1][0], name, words, label=label), name))
        elif closing:
            name = closing.lower()
            if name == "a":
                anchors = 0
            elif name in BLOCKS and name not in ("html", "body"):
                flush()
                for k in range(len(open_) - 1, 0, -1):
                    if open_[k][1] == name:
                        del open_[k:]
                        break
                    if open_[k][1] in ("td", "th", "table") and name not in ("table", "tr", "tbody", "thead", "tfoot", "td", "th"):
                        break
    flush()
    return tree


def _after(html: str, name: str, at: int) -> int:
    """Where the content of an element that holds no blocks ends; elements of its name may be nested unless its content is raw text."""
    pattern = _ends(name)
    depth = 1
    while depth:
        found = pattern.search(html, at)
        if not found:
            return len(html)
        at = found.end()
        if found.group(1):
            depth -= 1
        elif name not in RAW:
            depth += 1
    return at


@lru_cache(64)
def _ends(name: str) -> re.Pattern[str]:
    return re.compile(rf"<(/?){name}(?=[\s/>])[^>]*+(?:>|\Z)", re.I)
