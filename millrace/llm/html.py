"""Main text of web pages by a tree-structured graphical model.

Each block element of a page is a node that is content or not. A child's label depends on its
parent's (parent-child potentials), a node's features on its own label (node potentials). Both are
estimated from labelled pages. Sum-product messages, up from the leaves and down from the root,
give every node's marginal probability of being content; text of likely content nodes is kept.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Names of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template title textarea".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
BOUNDS_P = CLOSES_P | frozenset("td th li dd dt button".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
KEEPS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
FOREIGN = ("svg", "math")

#: A tag that is not closed ends before the next one.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/<>]*)((?:\"[^\"]*\"|'[^']*'|[^<>])*+)(?:>|(?=<)|\Z)", re.S)
ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|hidden|aria-label|data-y)(?![\w-])(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Node:
    __slots__ = ("children", "links", "names", "parent", "parts", "tag", "text", "y")

    def __init__(self, tag: str, parent: Node | None, names: tuple[str, ...] = (), y: str | None = None) -> None:
        self.tag, self.parent, self.names, self.y = tag, parent, names, y
        self.children: list[Node] = []
        self.parts: list[str | Node] = []
        self.text = self.links = 0  # characters below, and of them within links
        if parent is not None:
            parent.children.append(self)
            parent.parts.append(self)


def parse(page: str) -> Node:
    """The tree of block elements, in time linear in the page.

    Inline elements without names melt into their block; open ends are closed as browsers do. Contents of scripts,
    styles, titles, text areas and of the element "template" are left out; where one of the last three has no end, it
    counts as an ordinary element, and a script or style goes on to the page's end.
    """
    root = Node("#root", None)
    open_: list[tuple[str, Node]] = [("#root", root)]  # element name and the node that its text goes to
    places: dict[str, list[int]] = defaultdict(list)  # where elements of a name are open
    blocks: list[int] = []  # where elements are open that are not inline
    bounds: list[int] = []  # where a "p" is open, or an element that no "p" outside is closed from
    endless: set[str] = set()
    at = 0

    def start(tag: str, node: Node) -> None:
        places[tag].append(len(open_))
        if tag not in INLINE:
            blocks.append(len(open_))
        if tag in BOUNDS_P:
            bounds.append(len(open_))
        open_.append((tag, node))

    def say(raw: str) -> None:
        if raw:
            if len(open_) == 1 and raw.strip():  # text outside of all elements is in a body
                start("body", Node("body", root))
            node = open_[-1][1]
            text = entities.unescape(raw) if "&" in raw else raw
            node.parts.append(text)
            n = len(text) - text.count(" ")
            node.text += n
            node.links += n if places["a"] else 0

    def shut(index: int) -> None:
        for name, _ in open_[index:]:
            places[name].pop()
        del open_[index:]
        for stack in (blocks, bounds):
            while stack and stack[-1] >= index:
                stack.pop()

    while at < len(page):
        m = TOKEN.search(page, at)
        if not m:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            # The end of an inline element within which a block is open closes nothing.
            if places[tag] and not (tag in INLINE and blocks and blocks[-1] > places[tag][-1]):
                shut(places[tag][-1])
            continue
        foreign = any(places[f] for f in FOREIGN)
        closed = m[3].rstrip().endswith("/") and (foreign or tag in FOREIGN)
        if tag in RAW and not closed and tag not in endless:
            end = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
            if end or tag in ("script", "style"):
                if tag in ("title", "textarea"):
                    Node(tag, open_[-1][1]).text = end.start() - at
                at = end.end() if end else len(page)
                continue
            endless.add(tag)
        if tag in CLOSES_P and bounds and open_[bounds[-1]][0] == "p":
            shut(bounds[-1])
        while tag in SAME:
            near = max((places[x][-1] for x in SAME[tag] | KEEPS[tag] if places[x]), default=0)
            if open_[near][0] not in SAME[tag]:
                break
            shut(near)
        found = {k.lower(): a or b or c or "" for k, a, b, c in ATTRIBUTE.findall(m[3])} if m[3] else {}
        names = tuple(dict.fromkeys(x.lower() for k in ("class", "id", "role", "aria-label") for x in NAME.findall(found.get(k, ""))))
        if tag == "br":
            open_[-1][1].parts.append(" ")
        if tag in VOID or closed:
            if tag in ("hr", "input"):
                Node(tag, open_[-1][1])
            continue
        if tag in INLINE and not names and "data-y" not in found:
            start(tag, open_[-1][1])
        else:
            start(tag, Node(tag, open_[-1][1], (*names, *(("hidden",) if "hidden" in found else ())), found.get("data-y")))
    return root


def in_order(root: Node) -> list[Node]:
    """Parents before their children."""
    out = [root]
    for node in out:
        out.extend(node.children)
    return out


def features(nodes: list[Node]) -> list[list[str]]:
    """What the model sees of each node: element, names, amount of text and share of links below it, inputs within."""
    below = {id(n): [n.text, n.links, n.tag in ("input", "textarea", "select", "button")] for n in nodes}
    for n in reversed(nodes):
        if n.parent is not None:
            up, own = below[id(n.parent)], below[id(n)]
            up[0] += own[0]
            up[1] += own[1]
            up[2] = up[2] or own[2]
    out = []
    for n in nodes:
        text, links, inputs = below[id(n)]
        share = links / text if text else 0
        f = ["tag=" + n.tag, f"text={min(4, int(math.log(1 + text, 5)))}", f"own={'top' if n.tag in ('#root', 'html', 'body') else ''}{min(3, int(math.log(1 + n.text, 5)))}", "links=" + ("all" if share > 0.7 else "some" if share > 0.3 else "few")]
        f += ["name=" + x for x in n.names]
        if inputs and n.tag not in ("#root", "html", "body"):
            f.append("inputs")
        out.append(f)
    return out


class TreeModel:
    """Counts with smoothing as potentials; the labels are 0 (other) and 1 (content)."""

    def __init__(self, pages: list[str]) -> None:
        pair: dict[tuple[int, str], list[float]] = defaultdict(lambda: [0.5, 0.5])
        emit: dict[str, list[float]] = defaultdict(lambda: [0.3, 0.3])
        total = [1.0, 1.0]
        for page in pages:
            nodes = in_order(parse(page))
            label: dict[int, int] = {}
            for n, f in zip(nodes, features(nodes), strict=True):
                above = label[id(n.parent)] if n.parent is not None else 0
                y = label[id(n)] = int(n.y) if n.y is not None else above
                if n.parent is not None:
                    for key in self.kinds(n):
                        pair[above, key][y] += 1
                total[y] += 1
                for x in f:
                    emit[x][y] += 1
        self.emit = {x: tuple(math.log(c / t) for c, t in zip(n, total, strict=True)) for x, n in emit.items()}
        self.pair = {k: tuple(math.log(c / sum(n)) for c in n) for k, n in pair.items()}

    @staticmethod
    def kinds(n: Node) -> list[str]:
        """What the potential of a child and its parent goes by, from the closest to the widest: the child's element, whether it is named, and whether it stands at the top of the page."""
        own = n.tag if n.tag in ("p", "div", "section", "article", "main", "ul", "ol", "li", "table", "h1", "h2", "h3", "body", "html", "head", "blockquote", "pre") else "other"
        own += "." if n.names else ""
        return [("top " if n.parent.tag in ("#root", "html", "body") else "in ") + own, own, ""]

    def potential(self, f: list[str]) -> tuple[float, float]:
        a = b = 0.0
        for x in f:
            e = self.emit.get(x)
            if e:
                a, b = a + e[0], b + e[1]
        return a, b

    def marginals(self, nodes: list[Node]) -> list[float]:
        """Probability of content of each node: messages up, then down. The root is not content."""
        place = {id(n): i for i, n in enumerate(nodes)}
        up = [list(self.potential(f)) for f in features(nodes)]
        trans = [None if n.parent is None else [next((self.pair[p, k] for k in self.kinds(n) if (p, k) in self.pair), (math.log(0.5),) * 2) for p in (0, 1)] for n in nodes]
        sent: list[tuple[float, float]] = [(0.0, 0.0)] * len(nodes)
        for i in range(len(nodes) - 1, 0, -1):
            t, (a, b) = trans[i], up[i]
            sent[i] = tuple(add(t[p][0] + a, t[p][1] + b) for p in (0, 1))
            above = up[place[id(nodes[i].parent)]]
            above[0] += sent[i][0]
            above[1] += sent[i][1]
        down = [(0.0, 0.0)] * len(nodes)
        down[0] = (0.0, -50.0)
        out = [0.0] * len(nodes)
        for i, n in enumerate(nodes):
            if i:
                j = place[id(n.parent)]
                a = down[j][0] + up[j][0] - sent[i][0]
                b = down[j][1] + up[j][1] - sent[i][1]
                t = trans[i]
                down[i] = (add(a + t[0][0], b + t[1][0]), add(a + t[0][1], b + t[1][1]))
            d = (down[i][1] + up[i][1]) - (down[i][0] + up[i][0])
            out[i] = 1 / (1 + math.exp(-max(-50.0, min(50.0, d))))
        return out


def add(a: float, b: float) -> float:
    """log(exp(a) + exp(b))."""
    return max(a, b) + math.log1p(math.exp(-abs(a - b)))


def main_text(page: str | None, model: TreeModel, threshold: float = 0.5) -> str:
    """Text of the content nodes: a block a line, white space within a block as one blank. Null and empty pages: empty. A page without elements is a block."""
    if not page:
        return ""
    root = parse(page)
    nodes = in_order(root)
    if [n.tag for n in nodes] == ["#root", "body"]:  # no element at all: plain text
        return " ".join("".join(nodes[1].parts).split())
    keep = {id(n): p >= threshold for n, p in zip(nodes, model.marginals(nodes), strict=True)}
    blocks: list[list[str]] = [[]]
    todo: list[str | Node | None] = [root]
    owner: list[bool] = [False]
    while todo:
        x = todo.pop()
        if x is None:
            owner.pop()
        elif isinstance(x, str):
            if owner[-1]:
                blocks[-1].append(x)
        elif x.tag == "#edge":
            blocks.append([])
        else:
            block = x.tag not in INLINE
            owner.append(keep[id(x)])
            edge = Node("#edge", None)
            todo += [*([edge] if block else []), None, *reversed(x.parts), *([edge] if block else [])]
    lines = (" ".join("".join(b).split()) for b in blocks)
    return "\n".join(x for x in lines if x)


def filled(page: str) -> str:
    """A training page with its counts in braces turned into so many words."""
    return re.sub(r"\{(\d+|n)\}", lambda m: " ".join(("lorem", "ipsum", "dolor", "amet", "elit,", "magna.")[i % 6] for i in range(25 if m[1] == "n" else int(m[1]))), page)


# Labelled pages. data-y: 1 content, 0 other, inherited below; {n}: n words of text.
HEAD = "<head data-y=0><meta charset=utf-8><title>{8}</title><style>p{{margin:0}}</style><script>var a;</script></head>"
LINKS = "<ul>" + "<li><a href=/x>{1}</a></li>" * 3 + "</ul>"
PAGES = [
    f"<html>{HEAD}<body data-y=0><nav>{LINKS}</nav><div class=ad>{{6}}</div><article data-y=1><h1>{{8}}</h1><p>{{60}}<p>{{40}}</p><p>{{3}}</p></article><footer>{{9}}</footer></body></html>",
    f"<html>{HEAD}<body data-y=0><nav>{LINKS}</nav><div class=ad>{{12}}</div><article data-y=1><h1>{{4}}</h1><p>{{9}}</p></article><footer>{{12}}</footer></body></html>",
    f"<html>{HEAD}<body data-y=0><header class=header><h1><a href=/>{{2}}</a></h1>{LINKS}</header><main><article data-y=1><h2>{{6}}</h2><p>{{90}}</p><p>{{20}}</p><ul><li>{{9}}</li><li>{{7}}</li></ul><p>{{50}}</p></article></main><aside class=sidebar><h3>{{2}}</h3>{LINKS}<p>{{12}}</p></aside><footer id=footer><p>{{10}}</p></footer></body></html>",
    f"<html>{HEAD}<body data-y=0><div id=header><div class=logo>{{2}}</div></div><div id=menu class=nav>{LINKS}</div><div id=content data-y=1><h1>{{7}}</h1><p>{{80}}</p><blockquote><p>{{30}}</p></blockquote><p>{{70}}</p><table><tr><td>{{3}}</td><td>{{2}}</td></tr></table></div><div id=sidebar><div class=widget>{LINKS}</div></div><div id=footer>{{8}}</div></body></html>",
    f"<html>{HEAD}<body data-y=0><div class='cookie notice banner'><p>{{18}}</p><button>{{1}}</button></div><nav>{LINKS}</nav><article data-y=1><header data-y=1><h1>{{9}}</h1></header><section><h2>{{4}}</h2><p>{{70}}</p></section><section><p>{{60}}</p><pre>{{20}}</pre></section></article><section id=comments class=comments><h3>{{1}}</h3><div class=comment><p>{{30}}</p></div><div class=comment><p>{{12}}</p></div><form><textarea></textarea><input><button>{{1}}</button></form></section><footer>{{12}}</footer></body></html>",
    f"<html>{HEAD}<body data-y=0><div class=advert>{{7}}</div><div class='main post entry' data-y=1><h1>{{7}}</h1><p>{{100}}</p><div class='ad promo' data-y=0><p>{{15}}</p></div><p>{{80}}</p><div class='share social' data-y=0>{LINKS}</div></div><div class='related posts'><h3>{{2}}</h3>{LINKS}</div><form class='newsletter subscribe'><p>{{10}}</p><input><button>{{1}}</button></form><footer class=site>{{20}}</footer></body></html>",
    f"<html>{HEAD}<body data-y=0><header>{{4}}</header><form class=search><label>{{1}}</label><input></form><main data-y=1><h1>{{5}}</h1><p>{{30}}</p><h2>{{3}}</h2><p>{{45}}</p><ol><li>{{12}}</li><li>{{15}}</li></ol><aside data-y=0 class=aside><p>{{25}}</p></aside></main><div class='popup modal notice' role=dialog><p>{{16}}</p></div><footer role=contentinfo>{{6}}</footer></body></html>",
    f"<html>{HEAD}<body data-y=0><nav role=navigation class=breadcrumb><a href=/>{{1}}</a> <a href=/b>{{1}}</a></nav><div class=container><div class='article body text' data-y=1><h1>{{8}}</h1><p>{{5}}</p><p>{{120}}</p></div><div class='sidebar right'><p>{{20}}</p>{LINKS}</div></div><div class='comments reader' id=comments><ol><li class=comment><p>{{40}}</p></li><li class=comment><p>{{25}}</p></li></ol></div><div class='footer copyright'>{{9}}</div></body></html>",
    f"<html>{HEAD}<body data-y=0><nav>{LINKS}</nav><div class=notice>{{14}}</div><article data-y=1><h1>{{10}}</h1><p>{{200}}</p><p>{{150}}</p><p>{{90}}</p><div><p>{{40}}</p></div><figure><figcaption>{{8}}</figcaption></figure></article><aside>{{30}}</aside><div class=comments><p>{{60}}</p></div><footer>{{14}}</footer></body></html>",
    f"<html>{HEAD}<body data-y=0><header>{LINKS}</header><article data-y=1><h1>{{3}}</h1><p>{{4}}</p><ul><li>{{2}}</li><li>{{3}}</li><li>{{1}}</li></ul><p>{{6}} <a href=/y>{{2}}</a> {{5}}</p><form data-y=0><p>{{4}}</p><input></form><section class=comments data-y=0><h3>{{1}}</h3><p>{{8}}</p><p>{{3}}</p></section></article><footer>{{8}}</footer></body></html>",
    f"<html>{HEAD}<body data-y=0><nav>{LINKS}</nav><main data-y=1><h1>{{5}}</h1><p>{{2}}</p><ol><li>{{20}}</li><li><p>{{10}}</p></li></ol><dl><dt>{{1}}</dt><dd>{{9}}</dd></dl><table><tr><th>{{1}}</th><td>{{2}}</td></tr></table><aside data-y=0>{{9}}</aside></main><section class=comments><p>{{5}}</p><ul><li>{{9}}</li></ul></section><footer>{{8}}</footer></body></html>",
    f"<html>{HEAD}<body data-y=0><nav>{LINKS}</nav><article data-y=1><h1>{{5}}</h1><p>{{9}}</p><ul><li>{{1}}</li><li>{{2}}</li><li>{{1}}</li><li>{{4}}</li><li>{{7}}</li><li>{{2}}</li></ul><p>{{20}}</p><ol><li>{{1}}</li><li>{{12}}</li><li>{{3}}</li></ol><ul><li>{{5}}</li><li>{{3}}</li></ul></article><footer>{{8}}</footer></body></html>",
    f"<html>{HEAD}<body data-y=0><header>{{2}}</header><div class=content data-y=1><h2>{{4}}</h2><ul><li>{{8}}</li><li>{{9}}</li><li>{{20}}</li><li>{{2}}</li></ul><p>{{30}}</p><h3>{{2}}</h3><ol><li>{{6}}</li><li>{{1}}</li><li>{{2}}</li></ol></div><div class=sidebar>{LINKS}</div></body></html>",
    f"<html>{HEAD}<body data-y=1><h1>{{5}}</h1><p>{{50}}</p><p>{{30}}</p><ul><li>{{5}}</li></ul><p>{{20}}</p></body></html>",
    f"<html>{HEAD}<body data-y=0><div id=wrapper><div class=page data-y=0><div class='post content' data-y=1><h2>{{5}}</h2><div><p>{{50}}</p></div><p>{{9}}</p><ul><li>{{3}}</li><li>{{6}}</li></ul></div></div></div><div class='banner consent'>{{20}}</div><div class='author meta tags'>{{4}}</div></body></html>",
]
# Pages without a wrapper, and layouts that name nothing.
PAGES += [
    "<html><body data-y=0><p data-y=1>{80}</p></body></html>",
    "<html><body data-y=0><p data-y=1>{6}</p></body></html>",
    "<html><body data-y=0><div data-y=1>{80}</div></body></html>",
    "<html><body data-y=1>{70}</body></html>",
    "<html><body data-y=1>{5}</body></html>",
    "<p data-y=1>{2}</p>",
    "<p data-y=1>{60}</p><p data-y=1>{30}</p>",
    "<div data-y=1>{90}</div>",
    "<div data-y=1><p>{3}</p></div>",
    "<h1 data-y=1>{5}</h1><p data-y=1>{40}</p><ul data-y=1><li>{5}</li><li>{9}</li></ul>",
    f"<html>{HEAD}<body data-y=0><h1 data-y=1>{{5}}</h1><p data-y=1>{{60}}</p><p data-y=1>{{9}}</p><blockquote data-y=1>{{20}}</blockquote><p data-y=1>{{40}}</p><hr><p data-y=1>{{12}}</p></body></html>",
    f"<html>{HEAD}<body data-y=0><nav>{LINKS}</nav><h1 data-y=1>{{5}}</h1><p data-y=1>{{60}}</p><p data-y=1>{{9}}</p><footer>{{9}}</footer></body></html>",
    f"<html>{HEAD}<body data-y=0><div data-y=1><p>{{50}}</p><p>{{20}}</p><div>{{12}}</div></div><div class=footer>{{9}}</div></body></html>",
    f"<html>{HEAD}<body data-y=0><table data-y=1><tr><td>{{9}}</td><td>{{30}}</td></tr><tr><td><p>{{20}}</p></td></tr></table></body></html>",
    f"<html>{HEAD}<body data-y=0><div>{LINKS}</div><div data-y=1><h2>{{4}}</h2><p>{{50}}</p></div><div class=copyright>{{9}}</div></body></html>",
    f"<html>{HEAD}<body data-y=0><article data-y=1><p>{{20}}</p><noscript>{{8}}</noscript><svg><text>{{2}}</text></svg><math><mi>{{1}}</mi></math><object>{{9}}</object><p>{{20}}</p><iframe></iframe></article></body></html>",
]
# Layouts by rule: a wrapper of content among blocks of readers' comments, sidebars and the like, with long paragraphs too.
BLOCKS = [
    "<section class=comments data-y=0><div class=comment><p>{n}</p></div><div class=comment><p>{30}</p><p>{n}</p></div></section>",
    "<aside class=sidebar data-y=0><h3>{2}</h3><p>{n}</p><p>{8}</p></aside>",
    "<div class='comment list' data-y=0><h4>{2}</h4><p>{n}</p><p>{n}</p></div>",
    "<div id=cookie class=notice data-y=0><p>{n}</p></div>",
    "<div class=related data-y=0><p>{n}</p><ul><li><a href=/>{6}</a></li></ul></div>",
    "<footer class=footer data-y=0><div><p>{n}</p><p>{n}</p></div></footer>",
    "<div class=advert data-y=0><p>{n}</p></div>",
]
for wrapper in ("<article data-y=1>{c}</article>", "<main data-y=1>{c}</main>", "<div class=content data-y=1>{c}</div>"):
    for i, block in enumerate(BLOCKS):
        for n in (12, 45):
            content = ("<h1>{5}</h1>" if i % 2 else "") + "<p>{40}</p><p>{12}</p>"
            other = BLOCKS[(i + 3) % len(BLOCKS)]
            PAGES.append(f"<html>{HEAD.replace('{{', '{').replace('}}', '}')}<body data-y=0><header>{{3}}</header>" + wrapper.replace("{c}", content + (block if n == 45 and i % 3 == 0 else "")) + block.replace("{n}", f"{{{n}}}") + other.replace("{n}", "{20}") + "</body></html>")
for n in (1, 2, 4, 8, 30, 100):
    PAGES += [f"<html><head data-y=0><title>{{4}}</title></head><body data-y=1>{{{n}}}</body></html>", f"<html><body data-y=1>{{{n}}}<br>{{9}}<p>{{{n}}}</p></body></html>", f"<html>{HEAD.replace('{{', '{').replace('}}', '}')}<body data-y=1>{{{n}}} <b>{{1}}</b> <p>{{{n}}}</p> {{3}}</body></html>"]


def trained() -> TreeModel:
    return TreeModel([filled(p.replace("{{", "{").replace("}}", "}") if "{{" in p else p) for p in PAGES])


def extract(pages: DataFrame, *, key: str = "page_id", url: str = "url", html: str = "html", threshold: float = 0.5) -> DataFrame:
    """page_id, url, text and n_chars of every row, from its whole html.

    Null html gives an empty text; repeated rows are extracted alike; an empty table gives an empty one. Pages of any
    length and depth are read whole, in time linear in them. Other columns are not read, whatever their names.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = trained()
        for batch in batches:
            text = [main_text(x, model, threshold) for x in batch["__html"]]
            yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": text, "n_chars": [len(t) for t in text]})

    plain = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("__html"))
    return plain.mapInPandas(run, "page_id long, url string, text string, n_chars long")
