"""Web pages as block trees: tolerant parsing, folding of repeats, union-free expressions and their alignment.

An expression is a list of nodes: a text slot, an element with an expression inside, or a group that repeats. Any node can be
optional. There are no alternatives, so the expression of a page is the page itself with repeats folded, and what
two pages do not share becomes optional.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator

PERIOD = 32
DEPTH = 200

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|textarea|title|iframe|noembed|noframes|xmp)\b[^>]*>.*?(?:</\1[^>]*>|\Z)"
    r"""|<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/<>]*+)([^<>]*+)>|<[!?/][^<>]*+>""",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
# fixed values: elements that browsers show as blocks, and elements whose end tag may be left out with what ends them
BLOCKS = frozenset(
    "address article aside blockquote button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr legend li main menu nav noscript ol optgroup option p pre search section select summary svg table tbody td template tfoot th thead tr ul".split()
)
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "tfoot": ({"tbody", "thead"}, {"table"}),
}


class Node:
    """A text slot (``sym`` "#"), an element, or a repeated group (``sym`` "+"). ``texts`` are the page's texts in a slot."""

    __slots__ = ("sym", "kids", "optional", "texts", "key", "size")

    def __init__(self, sym: str, kids: list[Node] | None = None, optional: bool = False, texts: list[int] | None = None):
        self.sym, self.kids, self.optional, self.texts = sym, kids or [], optional, texts or []
        self.sized()

    def sized(self) -> Node:
        self.key = self.sym if self.sym == "#" else f"{self.sym}({','.join(k.key for k in self.kids)})"
        self.size = 1 + sum(k.size for k in self.kids)
        return self

    def plain(self) -> list:
        return [self.sym, int(self.optional), [k.plain() for k in self.kids]]

    @classmethod
    def of(cls, value: list) -> Node:
        return cls(value[0], [cls.of(v) for v in value[2]], bool(value[1]))


def symbol(name: str, attributes: str) -> str:
    """The element with its class, id, role and item property; digits count as equal, as they number pages."""
    if not attributes or attributes.isspace():
        return name
    found = sorted((m[1].lower(), " ".join(sorted(next(filter(None, m.groups()[1:]), "").split()))) for m in ATTRIBUTE.finditer(attributes))
    marks = [f"{k}={re.sub('[0-9]+', '0', v)}" for k, v in found if v] + ["hidden"] * bool(HIDDEN.search(attributes))
    return "|".join([name, *marks])


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """("open" or "close", name, attributes) of block elements, ("text", text, linked text) in between.

    White space in a text is one space; inline elements leave no trace, a line break is white space.
    """
    parts: list[str] = []
    linked: list[str] = []
    inside = False

    def text() -> Iterator[tuple[str, str, str]]:
        whole = " ".join("".join(parts).split())
        if whole:
            yield "text", whole, " ".join("".join(linked).split())
        parts.clear()
        linked.clear()

    def add(raw: str) -> None:
        if raw:
            raw = html.unescape(raw) if "&" in raw else raw
            parts.append(raw)
            if inside:
                linked.append(raw)

    at = 0
    for m in TOKEN.finditer(page):
        add(page[at : m.start()])
        at = m.end()
        name = m[3] or m[6]
        if not name:
            continue
        name, ends = name.lower(), m[2] or m[5]
        if name in BLOCKS:
            yield from text()
            inside = False
            yield ("close" if ends else "open"), name, m[4] or m[7] or ""
        elif name == "br":
            add(" ")
        elif name == "a":
            inside = not ends
    add(page[at:])
    yield from text()


def tree(page: str) -> tuple[list[Node], list[str], list[int]]:
    """(children of the page, its texts, linked characters of each text). Elements without text are left out.

    Elements nested more than ``DEPTH`` deep only part texts; they are not told apart from the one they stand in.
    """
    root = Node("")
    deeper: list[str] = []
    stack, names = [root], [""]
    texts, links = [], []

    def close(k: int) -> None:
        while len(stack) > k:
            node = stack.pop()
            names.pop()
            if node.kids:
                node.kids = fold(node.kids)
                stack[-1].kids.append(node.sized())

    for kind, name, more in tokens(page):
        if kind == "text":
            stack[-1].kids.append(Node("#", texts=[len(texts)]))
            texts.append(name)
            links.append(len(more))
        elif kind == "close" and name in deeper:
            del deeper[len(deeper) - 1 - deeper[::-1].index(name) :]
        elif kind == "close":
            for k in range(len(names) - 1, 0, -1):
                if names[k] == name:
                    close(k)
                    break
        else:
            if names[-1] == "p":
                close(len(stack) - 1)
            ended, within = ENDS.get(name, ((), ()))
            for k in range(len(names) - 1, 0, -1):
                if names[k] in within:
                    break
                if names[k] in ended:
                    close(k)
                    break
            if name != "hr" and len(stack) > DEPTH:
                deeper.append(name)
            elif name != "hr":
                stack.append(Node(symbol(name, more)))
                names.append(name)
    close(1)
    return fold(root.kids), texts, links


def absorb(into: list[Node], more: list[Node]) -> None:
    """Another instance of the same structure: its texts and options are added to the first."""
    for a, b in zip(into, more):
        a.texts += b.texts
        a.optional |= b.optional
        absorb(a.kids, b.kids)


def fold(nodes: list[Node]) -> list[Node]:
    """Equal neighbours, or runs of up to ``PERIOD`` nodes, as one group that repeats."""
    period = 1
    while period <= min(PERIOD, len(nodes)):
        out: list[Node] = []
        keys = [n.key for n in nodes]
        i, changed = 0, False
        while i < len(nodes):
            last = out[-1] if out else None
            here = keys[i : i + period]
            if last is not None and last.sym == "+" and len(last.kids) == period and here == [k.key for k in last.kids]:
                absorb(last.kids, nodes[i : i + period])
                i, changed = i + period, True
            elif last is not None and last.sym == "+" and nodes[i].key == last.key:
                absorb([last], [nodes[i]])
                i, changed = i + 1, True
            elif nodes[i].sym == "+" and len(nodes[i].kids) == period and [k.key for k in out[-period:]] == [k.key for k in nodes[i].kids]:
                first = out[-period:]
                del out[-period:]
                absorb(first, nodes[i].kids)
                out.append(Node("+", first, nodes[i].optional))
                i, changed = i + 1, True
            elif here == keys[i + period : i + 2 * period] and len(here) == period and (period > 1 or nodes[i].sym != "+"):
                first = nodes[i : i + period]
                optional = all(n.optional for n in first)
                absorb(first, nodes[i + period : i + 2 * period])
                out.append(Node("+", first, optional))
                i, changed = i + 2 * period, True
            else:
                out.append(nodes[i])
                i += 1
        nodes = out
        period = 1 if changed else period + 1
    return nodes


def grouped(nodes: list[Node], groups: list[list[str]]) -> list[Node]:
    """Single instances of groups that repeat in the other expression, as groups of their own."""
    for body in groups:
        out, i = [], 0
        while i < len(nodes):
            if [n.key for n in nodes[i : i + len(body)]] == body:
                part = nodes[i : i + len(body)]
                out.append(Node("+", part, all(n.optional for n in part)))
                i += len(body)
            else:
                out.append(nodes[i])
                i += 1
        nodes = out
    return nodes


def likeness(a: Node, b: Node) -> int:
    """How much it is worth to align two nodes; 0 if they cannot be the same part of a page."""
    if a.sym != b.sym:
        return 0
    if a.key == b.key:
        return 2 * a.size
    if a.sym == "+":
        return int(a.kids[0].sym == b.kids[0].sym)
    return 1


def aligned(a: list[Node], b: list[Node]) -> list[tuple[Node | None, Node | None]]:
    """Both expressions in order, each node with its partner or None, at the highest total likeness."""
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    worth = [[likeness(x, y) for y in b] for x in a]
    for i in range(len(a) - 1, -1, -1):
        row, below, w = best[i], best[i + 1], worth[i]
        for j in range(len(b) - 1, -1, -1):
            row[j] = max(below[j], row[j + 1], below[j + 1] + w[j] if w[j] else 0)
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if worth[i][j] and best[i][j] == best[i + 1][j + 1] + worth[i][j]:
            out.append((a[i], b[j]))
            i, j = i + 1, j + 1
        elif best[i][j] == best[i + 1][j]:
            out.append((a[i], None))
            i += 1
        else:
            out.append((None, b[j]))
            j += 1
    return out + [(x, None) for x in a[i:]] + [(None, y) for y in b[j:]]


def bodies(nodes: list[Node]) -> list[list[str]]:
    return [[k.key for k in n.kids] for n in nodes if n.sym == "+"]


def generalised(a: list[Node], b: list[Node]) -> list[Node]:
    """The union-free expression of all that ``a`` or ``b`` describe: what one of them lacks becomes optional."""
    groups = bodies(a), bodies(b)
    a, b = grouped(a, groups[1]), grouped(b, groups[0])
    out = []
    for x, y in aligned(a, b):
        if x is None or y is None:
            node = x or y
            out.append(Node(node.sym, node.kids, True))
        else:
            same = x.key == y.key and not (x.optional or y.optional)
            out.append(Node(x.sym, generalised(x.kids, y.kids) if not same or x.kids else x.kids, x.optional or y.optional))
    return fold(out)


def slots(nodes: list[Node], path: tuple[str, ...] = (), outside: int | None = None) -> Iterator[tuple[Node, tuple[str, ...], int | None]]:
    """(slot, enclosing elements, how many of them stand outside any repeated group, None if all and the slot do) in page order."""
    for n in nodes:
        if n.sym == "#":
            yield n, path, outside
        elif n.sym == "+":
            yield from slots(n.kids, path, len(path) if outside is None else outside)
        else:
            yield from slots(n.kids, (*path, n.sym), outside)


def placed(page: list[Node], wrapper: list[Node]) -> list[int]:
    """For every slot of ``page`` its slot of ``wrapper`` by number, -1 for none."""
    number = {id(n): k for k, (n, _, _) in enumerate(slots(wrapper))}
    found: dict[int, int] = {}

    def walk(a: list[Node], b: list[Node]) -> None:
        a = grouped(a, bodies(b))
        for x, y in aligned(a, b):
            if x is not None and y is not None:
                if x.sym == "#":
                    found[id(x)] = number[id(y)]
                walk(x.kids, y.kids)

    own = [n for n, _, _ in slots(page)]
    walk(page, wrapper)
    return [found.get(id(n), -1) for n in own]


def packed(nodes: list[Node]) -> str:
    return json.dumps([n.plain() for n in nodes], ensure_ascii=False, separators=(",", ":"))


def unpacked(text: str) -> list[Node]:
    return [Node.of(v) for v in json.loads(text)]
