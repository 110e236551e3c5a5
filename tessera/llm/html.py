"""Main-text extraction by tree scoring.

The markup is read into a tree (implied end tags, raw scripts and styles, comments dropped).
Elements that are furniture by tag, role or class (menus, headers, footers, sidebars, notices,
adverts, forms, reader comments) are cut off first. Outside an article or main element any word of
a class or id name marks furniture; inside one a whole name has to consist of such words, and words
that articles use themselves (share, legal, ...) count only where links make up much of the text. Each paragraph block then gives points for
its length and its commas to its ancestors (parent whole, grandparent half, further ones by
distance), a container's points are discounted by its link density, and the best container is
kept: the whole article or main element around it, or else the container together with its siblings
that are headings, hold few links or have points. Character references are
decoded, white space inside a block becomes one space, blocks are joined by an empty line.

Nulls: a null html is empty; an empty page, and one without any text left, gives an empty text.
Very long and repeated pages are extracted whole, each by itself; further columns are left aside.
"""

from __future__ import annotations

import re
from html import unescape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, small_batches

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|</([A-Za-z][^\s/>]*)[^>]*(?:>|\Z)"
    r"|<([A-Za-z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"']|[\"'])*?)(/?)(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_SPACE = re.compile(r"\s+")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_FURNITURE = frozenset(
    "head script style noscript template iframe object embed svg canvas nav header footer aside form button select option "
    "textarea input label dialog menu title".split()
)
_ROLES = frozenset(
    "navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar status note".split()
)
#: Words of class and id names that mark furniture. Fixed values.
_WORDS = frozenset(
    "ad ads advert advertisement adverts advertorial banner breadcrumb breadcrumbs comment comments commentlist cookie cookies "
    "consent disqus footer header masthead menu menus modal nav navbar navigation newsletter notice notices notification "
    "pagination pager popup promo promoted related replies respond share sharing shoutbox sidebar sidebars skip skyscraper "
    "social sponsor sponsored subscribe subscription toolbar widget widgets alert gdpr paywall signup login topbar bottombar "
    "recommended recommendations trending toc sitemap copyright legal disclaimer reply".split()
)
#: Of these, words that an article's own parts may be called: inside one they need links as well. Fixed values.
_AMBIGUOUS = frozenset("alert banner copyright disclaimer header footer legal reply replies share sharing social toc trending widget widgets related masthead".split())
#: Words that go with them in the names of furniture inside an article. Fixed values.
_BESIDE = frozenset("area bar block bottom box button buttons container form icons inner item items left links list panel post posts right section site slot top unit wrap wrapper".split())
#: Share of link text from which an element with an ambiguous name is furniture.
_LINKED = 0.3
#: An element whose class or id has one of these as well is no furniture.
_CONTENT = frozenset("article content body main entry post story text".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_CLOSES_P = _BLOCK - {"html", "body", "td", "th", "tr", "li", "dd", "dt", "caption", "tbody", "thead", "tfoot"} | {"p"}
_SCOPE = {"li": {"ul", "ol", "menu"}, "dd": {"dl"}, "dt": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
_PEERS = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


class Node:
    __slots__ = ("tag", "parent", "kids", "attrs", "score", "chars", "linked")

    def __init__(self, tag: str, parent: Node | None, attrs: str = "") -> None:
        self.tag, self.parent, self.attrs = tag, parent, attrs
        self.kids: list[Node | str] = []
        self.score = 0.0
        self.chars = self.linked = 0


#: Inline end tags don't close these.
_WALLS = frozenset("td th table article main section nav aside".split())


class _Open:
    """The open elements, innermost last, and how deep each kind of them is: what an end tag closes is found without a walk."""

    def __init__(self, root: Node) -> None:
        self.nodes, self.depth = [root], {}
        self.blocks: list[int] = []
        self.walls: list[int] = []

    @property
    def now(self) -> Node:
        return self.nodes[-1]

    def push(self, node: Node) -> None:
        at = len(self.nodes)
        self.depth.setdefault(node.tag, []).append(at)
        if node.tag in _BLOCK:
            self.blocks.append(at)
        if node.tag in _WALLS:
            self.walls.append(at)
        self.nodes.append(node)

    def close(self, depth: int) -> None:
        """Close the element at this depth and all inside it."""
        for node in self.nodes[depth:]:
            self.depth[node.tag].pop()
        del self.nodes[depth:]
        for kept in (self.blocks, self.walls):
            while kept and kept[-1] >= depth:
                kept.pop()

    def deepest(self, tags) -> int:
        """The depth of the innermost open element with one of these tags; 0 if there is none."""
        return max((x[-1] for t in tags if (x := self.depth.get(t))), default=0)


def tree(html: str) -> Node:
    """The document as a tree; broken nesting is mended as browsers do in the common cases."""
    root = Node("#root", None)
    open_ = _Open(root)
    at, n = 0, len(html)
    while at < n:
        i = html.find("<", at)
        m = _TOKEN.match(html, i) if i >= 0 else None
        if m is None:  # text up to a "<" that opens nothing
            end = html.find("<", i + 1) if i >= 0 else n
            end = n if end < 0 else end
            open_.now.kids.append(html[at:end])
            at = end
            continue
        if i > at:
            open_.now.kids.append(html[at:i])
        at = m.end()
        close, name = m[1], m[2]
        if close:
            tag = close.lower()
            depth = open_.deepest((tag,))
            if tag == "br":
                open_.now.kids.append(Node("br", open_.now))
            elif depth and (tag in _BLOCK or not open_.walls or open_.walls[-1] <= depth):
                open_.close(depth)
            continue
        if not name:
            if m[0].startswith("<![CDATA["):
                open_.now.kids.append(m[0][9:-3].replace("&", "&amp;"))
            continue
        tag = name.lower()
        if tag in _CLOSES_P:
            if open_.blocks and open_.nodes[open_.blocks[-1]].tag == "p":
                open_.close(open_.blocks[-1])
        elif tag in _PEERS:
            scope = open_.deepest(_SCOPE[tag])
            if tag == "tr":  # closes the cell and the row
                inside = [x[-1] for t in _PEERS[tag] if (x := open_.depth.get(t)) and x[-1] > scope]
                row = [d for d in inside if open_.nodes[d].tag == "tr"]
                if inside:
                    open_.close(min(row or inside))
            elif (depth := open_.deepest(_PEERS[tag])) > scope:
                open_.close(depth)
        node = Node(tag, open_.now, m[3])
        open_.now.kids.append(node)
        if tag in _RAW:
            e = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(html, at)
            if tag in ("title", "textarea"):
                node.kids.append(html[at : e.start() if e else n])
            at = e.end() if e else n
        elif tag not in _VOID and not (m[4] and tag not in _BLOCK and tag in ("path", "circle", "rect", "use")):
            open_.push(node)
    return root


def _weigh(root: Node) -> None:
    """Each element's number of characters, and of those in links."""
    for x in reversed(_order(root)):
        own = sum(len(k.strip()) for k in x.kids if isinstance(k, str))
        x.chars = own + sum(k.chars for k in x.kids if not isinstance(k, str))
        x.linked = x.chars if x.tag == "a" else sum(k.linked for k in x.kids if not isinstance(k, str))


def _furniture(node: Node, within: bool) -> bool:
    """Whether an element goes; ``within`` an article or main element its names have to say so as a whole."""
    if node.tag in _FURNITURE:
        return not (node.tag == "header" and within)  # a heading group inside the article is the article's own
    if node.tag == "fieldset":
        return not within or any(x.tag in ("input", "button", "select", "textarea") for x in _order(node))
    if not node.attrs:
        return False
    names: list[str] = []
    for k, a, b, c in _ATTR.findall(node.attrs):
        k, v = k.lower(), (a or b or c).lower()
        if k == "role" and v in _ROLES:
            return True
        if k == "hidden" or (k == "aria-hidden" and v == "true") or (k == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", v)):
            return True
        if k in ("class", "id"):
            names += v.split()
    if node.tag in ("body", "html", "article", "main"):
        return False
    if within:
        linked = node.linked >= _LINKED * max(1, node.chars)
        for name in names:
            words = [w for w in re.split(r"[^a-z]+", name) if w]
            marks = [w for w in words if w in _WORDS]
            if marks and all(w in _WORDS or w in _BESIDE for w in words) and (linked or not all(w in _AMBIGUOUS for w in marks)):
                return True
        return False
    words = {w for name in names for w in re.split(r"[^a-z]+", name)}
    return bool(words & _WORDS) and not (words & _CONTENT and not words & {"comment", "comments", "sidebar", "ad", "ads", "related", "footer", "nav"})


def _pruned(root: Node) -> None:
    todo = [(root, False)]
    while todo:
        x, within = todo.pop()
        within = within or x.tag in ("article", "main")
        x.kids = [k for k in x.kids if isinstance(k, str) or not _furniture(k, within)]
        todo += [(k, within) for k in x.kids if not isinstance(k, str)]


def _order(root: Node) -> list[Node]:
    out, todo = [], [root]
    while todo:
        x = todo.pop()
        out.append(x)
        todo += [k for k in reversed(x.kids) if not isinstance(k, str)]
    return out


def _squeezed(text: str) -> str:
    return _SPACE.sub(" ", unescape(text)).strip()


def blocks(node: Node) -> list[tuple[Node, str]]:
    """(element, text) of each block below a node, in page order: runs of text that no block element interrupts."""
    out: list[tuple[Node, str]] = []
    run: list[str] = []

    def flush(owner: Node) -> None:
        if run:
            if text := _squeezed("".join(run)):
                out.append((owner, text))
            run.clear()

    todo: list[tuple] = [(node, None)]
    owner = node
    while todo:
        x, back = todo.pop()
        if x is None:
            flush(owner)
            owner = back
        elif isinstance(x, str):
            run.append(x)
        elif x.tag == "br":
            run.append(" ")
        elif x.tag in _BLOCK:
            flush(owner)
            todo.append((None, owner))
            owner = x
            todo += [(k, None) for k in reversed(x.kids)]
        else:
            todo += [(k, None) for k in reversed(x.kids)]
    flush(owner)
    return out


def scored(root: Node) -> Node | None:
    """Points flow from paragraphs to ancestors; the container with the most points after discount."""
    _weigh(root)  # what furniture had is gone
    touched: dict[int, Node] = {}
    for owner, text in blocks(root):
        if owner.tag in _HEADINGS or owner.tag in ("th", "caption"):
            continue
        points = 1 + min(len(text) / 100, 30) + min(text.count(",") + text.count("、") + text.count("，"), 30)
        holder, level = (owner if owner.tag in ("article", "div", "section", "main", "body", "td", "#root") else owner.parent or owner), 0
        while holder is not None and level < 6:
            holder.score += points / (1 if level == 0 else 2 if level == 1 else 3 * level)
            touched[id(holder)] = holder
            holder, level = holder.parent, level + 1
    best, most = None, -1.0
    for x in touched.values():
        x.score *= 1 - x.linked / max(1, x.chars)
        if x.tag in ("#root", "html"):
            x.score *= 0.9
        if x.score > most:
            best, most = x, x.score
    return best


def main_text(html: str | None) -> str:
    """The main text of a page; empty if it has none."""
    if not html:
        return ""
    root = tree(html)
    _weigh(root)
    _pruned(root)
    best = scored(root)
    if best is None:
        return ""
    inline = ("p", "b", "span", "i", "em", "strong", "font", "a", "u", "small")
    above = [best]
    while above[-1].parent is not None:
        above.append(above[-1].parent)
    # an enclosing article or main, at any depth, is the article as a whole
    best = next((x for x in reversed(above) if x.tag in ("article", "main")), best)
    # a wrapper around the best container that adds no text is the same article
    while best.parent is not None and (best.tag in inline or (best.tag not in ("article", "main") and best.parent.chars == best.chars)):
        best = best.parent
    if best.parent is None or best.tag in ("article", "main"):
        return "\n\n".join(t for _, t in blocks(best))
    # furniture is gone: of what stands beside the container only lists of links are left out
    need, together = max(10.0, best.score * 0.2), Node(best.parent.tag, None)
    together.kids = [x for x in best.parent.kids if x is best or isinstance(x, str) or x.tag == "br" or (x.chars and (x.score >= need or x.linked < 0.25 * x.chars or x.tag in _HEADINGS))]
    return "\n\n".join(t for _, t in blocks(together))


def extract(df: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """Rows (keep..., text, n_chars): the main text of each page."""
    small_batches(df.sparkSession)
    kinds = "".join(f"`{k}` {df.schema[k].dataType.simpleString()}, " for k in keep)

    def run(*cols: list) -> list[tuple]:
        got = [main_text(h) for h in cols[-1]]
        return list(zip(*cols[:-1], got, map(len, got), strict=True))

    return map_rows(df.select(*keep, F.coalesce(F.col(html), F.lit("")).alias("html")), run, f"{kinds}text string, n_chars long")
