"""A small tolerant HTML reader: block elements as a tree, with their runs of text.

Time is linear in the page, whatever its markup: quotes that never close are met
once, and open elements are found by counts and by lists kept for each scope.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

#: Element names of the HTML standard.
BLOCKS = frozenset(
    "address article aside blockquote body button canvas caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li link main menu meta nav noscript object ol optgroup option output p pre script search section select style summary svg table tbody td template textarea tfoot th thead title tr ul video audio".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What they hold is no markup.
RAW = frozenset("script style textarea title iframe".split())
#: Never text of a page.
SILENT = frozenset("script style head title template noscript iframe svg canvas object textarea select option optgroup button audio video meta link".split())
#: An open element of these names ends when one of the values begins.
ENDS = {
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "tbody", "tfoot"},
    "td": {"td", "th", "tr", "tbody", "tfoot"},
    "th": {"td", "th", "tr", "tbody", "tfoot"},
    "option": {"option", "optgroup"},
    "p": BLOCKS - {"button", "object", "noscript", "script", "style", "svg", "canvas", "audio", "video", "template", "link", "meta", "select", "option", "optgroup", "textarea", "output", "iframe"},
}
SCOPE = frozenset("table td th caption button object ul ol dl html body".split())
#: An element of the key begins inside open elements of the values, which end.
ENDED_BY = {new: [old for old, begins in ENDS.items() if new in begins] for new in set().union(*ENDS.values())}
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
#: A tag whose quotes close and hold neither < nor >; it ends or fails at the next of them.
PLAIN = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^<>"']++|"[^"<>]*+"|'[^'<>]*+')*+)>""")
STOP = re.compile(r"""[>"']""")
NAMES = re.compile(r"""\b(?:class|id|role|itemprop|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
HREF = re.compile(r"""(?:^|[\s"'/])href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORD = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


@dataclass
class Node:
    tag: str
    parent: int
    names: tuple[str, ...] = ()
    silent: bool = False
    depth: int = 0
    #: (place in the page, text, length of text in links)
    runs: list[tuple[int, str, int]] = field(default_factory=list)


def _names(attributes: str) -> tuple[str, ...]:
    found = [w for m in NAMES.finditer(attributes) for w in WORD.findall(CAMEL.sub("-", m[1]).lower())]
    return tuple(dict.fromkeys(found))


class Tags:
    """The tags of a page in order, as (start, end, name, closing, attributes).

    Comments and declarations have the name None; a CDATA section has its text
    as attributes. A ``>`` inside quotes doesn't end a tag, unless the quotes
    then never let it end: such a tag goes up to the first ``>``.
    """

    def __init__(self, page: str):
        self.page = page
        self.hopeless: set[int] = set()
        self.missing: dict[str, int] = {}

    def find(self, what: str, at: int) -> int:
        """Like str.find; what isn't found is not looked for again."""
        if at >= self.missing.get(what, len(self.page) + 1):
            return -1
        k = self.page.find(what, at)
        if k < 0:
            self.missing[what] = at
        return k

    def end(self, at: int) -> int:
        """Where the tag whose attributes begin at ``at`` ends (its ``>``), or -1."""
        plain = self.find(">", at)
        if plain < 0 or (self.page.find('"', at, plain) < 0 and self.page.find("'", at, plain) < 0):
            return plain
        met, k = [], at
        while m := STOP.search(self.page, k):
            if m[0] == ">":
                return m.start()
            if m.start() in self.hopeless:
                break
            met.append(m.start())
            k = self.find(m[0], m.end()) + 1
            if not k:
                break
        self.hopeless.update(met)
        return plain

    def __iter__(self) -> Iterator[tuple[int, int, str | None, bool, str]]:
        page, at = self.page, 0
        while (s := self.find("<", at)) >= 0:
            at = s + 1
            if m := PLAIN.match(page, s):
                at = (yield s, m.end(), m[2].lower(), bool(m[1]), m[3]) or m.end()
            elif m := TAG.match(page, s):
                e = self.end(m.end())
                if e >= 0:
                    at = (yield s, e + 1, m[2].lower(), bool(m[1]), page[m.end() : e]) or e + 1
            elif page[at : at + 1] in ("!", "?"):
                cdata = page.startswith("<![CDATA[", s)
                close = "]]>" if cdata else "-->" if page.startswith("<!--", s) else ">"
                e = self.find(close, s + 2)
                at = e + len(close) if e >= 0 else len(page)
                yield s, at, None, False, page[s + 9 : e if e >= 0 else at] if cdata else ""


class Open:
    """The open elements, with what is needed to find those that a tag ends."""

    def __init__(self):
        self.stack: list[tuple[int, str]] = [(0, "#root")]
        self.count: Counter[str] = Counter()
        self.scopes: list[tuple[int, dict[str, list[int]]]] = [(0, defaultdict(list))]

    def push(self, node: int, tag: str) -> None:
        if tag in SCOPE:
            self.scopes.append((len(self.stack), defaultdict(list)))
        elif tag in ENDS:
            self.scopes[-1][1][tag].append(len(self.stack))
        self.stack.append((node, tag))
        self.count[tag] += 1

    def cut(self, depth: int) -> None:
        while len(self.stack) > depth:
            _, tag = self.stack.pop()
            self.count[tag] -= 1
            if tag in SCOPE:
                self.scopes.pop()
            elif tag in ENDS:
                self.scopes[-1][1][tag].pop()

    def close(self, tag: str) -> None:
        """An end tag: the innermost element of that name and all inside it end."""
        if self.count[tag]:
            k = len(self.stack) - 1
            while self.stack[k][1] != tag:
                k -= 1
            self.cut(k)

    def begin(self, tag: str) -> None:
        """A start tag: the innermost element of this scope that it ends."""
        base, lists = self.scopes[-1]
        ends = ENDED_BY.get(tag, ())
        at = max((lists[old][-1] for old in ends if lists.get(old)), default=-1)
        if at < 0 and self.stack[base][1] in ends:
            at = base
        if at > 0:
            self.cut(at)


def href(attributes: str) -> str | None:
    """The address that an anchor's attributes hold, with character references decoded."""
    if "href" not in attributes.lower() or not (m := HREF.search(attributes)):
        return None
    return html.unescape(m[1] if m[1] is not None else m[2] if m[2] is not None else m[3]).strip()


def parse(page: str, links: list[str] | None = None) -> list[Node]:
    """Nodes in page order; a parent comes before its children. ``links`` gets the addresses of all anchors."""
    nodes = [Node("#root", -1)]
    here = Open()
    pending: list[str] = []
    linked = [0]
    in_link = False
    place = 0

    def flush() -> None:
        nonlocal place
        text = " ".join(html.unescape("".join(pending)).split())
        if text:
            nodes[here.stack[-1][0]].runs.append((place, text, linked[0]))
            place += 1
        pending.clear()
        linked[0] = 0

    def say(text: str) -> None:
        if text:
            pending.append(text)
            if in_link:
                linked[0] += len(text.strip())

    at, past, tags = 0, None, Tags(page)
    scan = iter(tags)
    while True:
        try:
            start, end, tag, closing, attributes = scan.send(past)
        except StopIteration:
            break
        past = None
        say(page[at:start])
        at = end
        if tag is None:
            say(html.escape(attributes))
            continue
        if tag not in BLOCKS:
            if tag == "a":
                in_link = not closing
                if links is not None and in_link and (found := href(attributes)) is not None:
                    links.append(found)
            elif tag == "br":
                say(" ")
            continue
        flush()
        if closing:
            here.close(tag)
            in_link = False
            continue
        here.begin(tag)
        top = here.stack[-1][0]
        up = nodes[top]
        nodes.append(Node(tag, top, _names(attributes) if "=" in attributes else (), up.silent or tag in SILENT, up.depth + 1))
        if tag in VOID or tag not in RAW and attributes.rstrip().endswith("/"):
            continue
        if tag in RAW:
            close = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            at = past = close.end() if close else len(page)
        else:
            here.push(len(nodes) - 1, tag)
    say(page[at:])
    flush()
    return nodes


def links(page: str) -> list[str]:
    """The addresses of all anchors outside scripts, styles and the like."""
    out: list[str] = []
    parse(page, out)
    return out


def visible_text(page: str, links: list[str] | None = None) -> str:
    """All blocks of text in page order, one a line. ``links`` gets the addresses of all anchors."""
    runs = [r for n in parse(page, links) if not n.silent for r in n.runs]
    return "\n".join(t for _, t, _ in sorted(runs))
