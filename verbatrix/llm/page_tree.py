"""Pages as trees of blocks, and union-free expressions over them: fold repeats, align, map.

An expression is a node: a label, whether it repeats (+) or is optional (?), and its children in order; a text slot is a node
without children, labelled ``#``. Inline tags are no nodes, so a slot holds the text of a whole block. These are the small
helpers of ``wrapper_extraction``, which runs them inside Spark tasks.
"""

from __future__ import annotations

import re
from html import unescape

MARKUP = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
NAMES = frozenset(("class", "id", "role"))
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

#: Fixed values of HTML: tags without content, tags whose content is no markup, tags inside lines of text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var nobr wbr img area map picture source param track embed".split())
#: What an opening tag closes, and where the search for it ends.
BLOCKS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, **dict.fromkeys(("tbody", "thead", "tfoot"), {"tbody", "thead", "tfoot", "tr", "td", "th"})}
FENCES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}}
#: Tags that never hold main text, and words of class, id or role that say the same of any block.
ASIDE_TAGS = frozenset("nav footer aside form script style noscript template button select textarea option svg canvas object iframe dialog menu search head datalist".split())
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies copyright disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices notification pager pagination popup promo related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar topbar widget widgets".split()
)
MAIN_WORDS = frozenset("article content main post story entry".split())
NEGATIONS = frozenset("no not with without has is".split())
#: Nesting deeper than this is flattened into its last level, as browsers do.
DEPTH = 256
#: Repeats of up to this many different siblings in a row are folded; longer ones stay as they are.
PERIOD = 8


class Node:
    __slots__ = ("label", "children", "texts", "plus", "optional")

    def __init__(self, label, children=None, texts=None, plus=False, optional=False):
        self.label, self.children, self.texts, self.plus, self.optional = label, children if children is not None else [], texts if texts is not None else [], plus, optional


def label_of(tag: str, attributes: str) -> str:
    """tag, its first class word, ! for a block beside the main text, ^ for one that says that it is the main text."""
    name = tag if tag.isalnum() else re.sub(r"[^\w:-]", "_", tag)
    beside = tag in ASIDE_TAGS or tag == "header"
    if "=" not in attributes:
        return f"{name}!" if beside else name
    named = {}
    for key, *values in ATTRIBUTE.findall(attributes):
        if key.lower() in NAMES:
            named.setdefault(key.lower(), unescape("".join(values)))
    classes = named.get("class", "").split()
    tokens = [[w.lower() for w in WORDS.findall(token)] for token in (*classes, *named.get("id", "").split(), *named.get("role", "").split())]
    if beside:
        mark = "!"
    elif tag in ("article", "main"):
        # Readers' comments are often articles of their own; a page's article may only name them among its classes.
        mark = "!" if tokens and tokens[0][:1] in (["comment"], ["comments"], ["reply"]) else ""
    elif tag in ("html", "body"):
        mark = ""
    else:
        mark = next((m for t in tokens if t and t[0] not in NEGATIONS for m in ["!" if ASIDE_WORDS.intersection(t) else "^" if MAIN_WORDS.intersection(t) else "!" if "header" in t else ""] if m), "")
    first = WORDS.findall(classes[0])[:1] if classes else []
    return f"{name}{'.' + first[0].lower() if first else ''}{mark}"


def blocks(html: str) -> tuple[Node, list[str], list[int]]:
    """The tree of a page, its block texts in page order, and how many characters of each are links."""
    root, texts, linked = Node("page"), [], []
    stack, tags = [root], ["page"]
    line: list[str] = []
    in_link = links = 0

    def flush():
        nonlocal links
        text = " ".join("".join(line).split())
        line.clear()
        if text:
            stack[-1].children.append(Node("#", None, [len(texts)]))
            texts.append(text)
            linked.append(min(links, len(text)))
        links = 0

    def close(at: int):
        del stack[at:], tags[at:]

    position, n = 0, len(html)
    while position < n:
        found = MARKUP.search(html, position)
        if found is None:
            piece, position = html[position:], n
        else:
            piece, position = html[position : found.start()], found.end()
        if piece:
            piece = unescape(piece) if "&" in piece else piece
            line.append(piece)
            if in_link:
                links += len(piece.strip())
        if found is None:
            break
        ends, tag, attributes = found.group(1, 2, 3) if found.group(2) else found.group(4, 5, 6)
        if tag is None:
            continue
        tag = tag.lower()
        if ends:
            if tag == "a":
                in_link = 0
            elif tag == "br":
                line.append(" ")
            elif tag not in INLINE or tag in tags:
                flush()
                fence = "table" if tag not in ("table", "body", "html", "article", "main") else None
                for at in range(len(tags) - 1, 0, -1):
                    if tags[at] == tag:
                        close(at)
                        break
                    if tags[at] == fence:
                        break
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(html, position)
            position = end.start() if end else n
            if tag not in ("script", "style"):
                flush()
            continue
        label = label_of(tag, attributes)
        if tag == "br":
            line.append(" ")
            continue
        if tag == "a":
            in_link = 1
        if tag in INLINE and not label.endswith("!") and tag not in tags:
            continue
        flush()
        if tag in VOID:
            continue
        in_link = 0 if tag in BLOCKS else in_link
        if tag in CLOSES or tag in BLOCKS:
            closed = CLOSES.get(tag, ()) if tag not in BLOCKS else ("p",)
            fences = FENCES.get(tag, {"table"}) if tag not in BLOCKS else {"td", "th", "table", "button", "caption"}
            last = 0
            for at in range(len(tags) - 1, 0, -1):
                if tags[at] in fences:
                    break
                if tags[at] in closed:
                    last = at
                elif tag in BLOCKS and tags[at] in BLOCKS:
                    break
            if last:
                close(last)
        if len(stack) < DEPTH and not attributes.endswith("/"):
            node = Node(label)
            stack[-1].children.append(node)
            stack.append(node)
            tags.append(tag)
    flush()
    return root, texts, linked


def merged(a: Node, b: Node) -> Node:
    """The expression that fits what a or b fits; both bear one label."""
    return Node(a.label, aligned(a.children, b.children) if a.children or b.children else [], a.texts + b.texts, a.plus or b.plus, a.optional or b.optional)


def _grouped(nodes: list[Node], others: list[Node]) -> list[Node]:
    """nodes, where a single run of siblings that the other side has as a repeated group becomes such a group too."""
    for group in {o.label: o for o in others if o.label.startswith("(")}.values():
        wanted = [c.label for c in group.children]
        labels = [x.label for x in nodes]
        if group.label in labels:
            continue
        for i in range(len(nodes) - len(wanted) + 1):
            if labels[i : i + len(wanted)] == wanted:
                nodes = [*nodes[:i], Node(group.label, nodes[i : i + len(wanted)]), *nodes[i + len(wanted) :]]
                break
    return nodes


def aligned(a: list[Node], b: list[Node]) -> list[Node]:
    """Both sequences in one, by a longest common subsequence of labels; what only one has is optional."""
    a, b = _grouped(a, b), _grouped(b, a)
    if len(a) == len(b) and all(x.label == y.label for x, y in zip(a, b)):
        return [merged(x, y) for x, y in zip(a, b)]
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i].label == b[j].label else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and a[i].label == b[j].label:
            out.append(merged(a[i], b[j]))
            i, j = i + 1, j + 1
        else:
            left = j == len(b) or (i < len(a) and best[i + 1][j] >= best[i][j + 1])
            x = a[i] if left else b[j]
            i, j = i + left, j + (not left)
            out.append(Node(x.label, x.children, x.texts, x.plus, True))
    # What came in by two ways may stand side by side now.
    return _pairs(out)


def _pairs(nodes: list[Node]) -> list[Node]:
    out: list[Node] = []
    for node in nodes:
        if out and out[-1].label == node.label:
            out[-1] = merged(out[-1], node)
            out[-1].plus, out[-1].optional = True, out[-1].optional and node.optional
        else:
            out.append(node)
    return out


def folded(node: Node) -> Node:
    """The node with repeats among its children folded: single siblings first, then groups of up to PERIOD siblings."""
    nodes = _pairs([folded(c) if c.children else c for c in node.children])
    for period in range(2, min(PERIOD, len(nodes) // 2) + 1):
        i, out = 0, []
        while i < len(nodes):
            part = nodes[i : i + period]
            labels, again = [x.label for x in part], i + period
            while len(part) == period and [x.label for x in nodes[again : again + period]] == labels:
                part = [merged(x, y) for x, y in zip(part, nodes[again : again + period])]
                again += period
            if again > i + period:
                out.append(Node("(" + ",".join(labels) + ")", part, None, True))
                i = again
            else:
                out.append(nodes[i])
                i += 1
        nodes = out
    return Node(node.label, nodes, node.texts, node.plus, node.optional)


def leaves(node: Node, above: tuple = ()):
    """Text slots in order, each with the nodes above it."""
    for child in node.children:
        if child.label == "#":
            yield child, (*above, node)
        else:
            yield from leaves(child, (*above, node))


def written(node: Node) -> str:
    mark = ("+" if node.plus else "") + ("?" if node.optional else "")
    return f"{node.label}{mark}{{{' '.join(map(written, node.children))}}}" if node.children else f"{node.label}{mark}"


NODE = re.compile(r"(\([^\s{}+?]*\)|[^\s{}+?]+)(\+?)(\??)(\{?)|(\})")


def read(expression: str) -> Node:
    """The expression that ``written`` gave; its slots hold their numbers."""
    stack, slots = [Node("")], 0
    for label, plus, optional, opens, closes in NODE.findall(expression):
        if closes:
            stack.pop()
            continue
        node = Node(label, None, None, bool(plus), bool(optional))
        if label == "#":
            node.texts.append(slots)
            slots += 1
        stack[-1].children.append(node)
        if opens:
            stack.append(node)
    return stack[0].children[0]
