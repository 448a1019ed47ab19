"""Main text of HTML pages by scoring the tree.

Scripts, menus, hidden parts and the like never enter the tree; parts named like adverts, sidebars or notices are marked.
Every paragraph passes points for its length and commas to its ancestors, fewer with distance; an ancestor's points are
discounted by the share of its text in links. A marked part goes unless it holds most of the page's points and no article
stands beside it. The best container, widened to the article that holds it, and those of its siblings that score or read
like it give the blocks of the text. Nothing recurses, and every step is linear in the page.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import only, tidy

# Fixed values of HTML: elements by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("body head html td th tr tbody thead tfoot caption option".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tbody", "thead", "tr", "td", "th"}, "tfoot": {"tbody", "thead", "tr", "td", "th"}}
FENCE = frozenset("ul ol dl table select article section div body main aside form nav td th".split())

# Fixed values of the method: what is cut by tag and role, and what is marked by the words of a class or id.
CUT_TAGS = frozenset("nav footer aside button select dialog menu head svg canvas audio video object fieldset search".split())
CUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())
JUNK = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising sponsor sponsors sponsored cookie cookies consent gdpr comment comments commentlist "
    "disqus newsletter newsletters subscribe subscription signup login popup popups modal overlay breadcrumb breadcrumbs pagination pager navbar nav navigation "
    "navbox topnav sidenav menu menus adbox adslot adunit".split()
)
READERS = frozenset("comment comments commentlist disqus reply replies respond".split())
DOUBTFUL = frozenset("banner promo promos promotion notice notices alert alerts sidebar sidebars rail widget widgets footer reply replies respond share sharing social related recommended recommendations toolbar masthead header".split())
HINTS = frozenset("comments ad ads advert advertisement sponsored newsletter sidebar related recommended share promo cookie navigation popup signup notice".split())  # as first or last word
VENDORS = frozenset("adsbygoogle taboola outbrain disqus".split())
RESPONSES = frozenset("discussion responses feedback".split())  # names of readers' comments, or of a text
FILLER = frozenset(
    "site page top bottom left right side bar list lists box boxes container wrapper wrap area areas section block blocks unit units slot slots link links inner outer primary "
    "secondary global mobile desktop sticky fixed button buttons form posts stories items item icon icons panel row col column group module region user users reader readers "
    "thread div tag text message zone holder body full small large main the of and for".split()
)
LAYOUT = frozenset("content contents".split())  # filler after a cut word only: 'content-sidebar' names an arrangement
HEADING = frozenset("header masthead banner widget widgets".split())  # what may head an article
SIBLINGS = frozenset("section h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre figure table".split())
PARTS = frozenset("article dd div li section tr".split())
KEEP_TAGS = frozenset("html body main article".split())
KEPT, HINT, SOFT, FIRM, CUT = range(5)  # marks of an element; a hint is for the tree to decide
JUNK_POINTS = 10  # a part named as junk that holds fewer is never the text
PARAGRAPH = 80  # characters of a block that surely is one

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


NUMERIC = re.compile(r"&#([0-9]{8,})")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)", re.A | re.I) for t in RAW}


class Node:
    __slots__ = ("tag", "parent", "items", "raw", "mark", "readers", "cut", "open", "in_link", "held", "free", "around", "longest", "score", "length", "linked", "prose")

    def __init__(self, tag: str, parent: "Node | None"):
        self.tag, self.parent, self.items, self.raw = tag, parent, [], ""
        self.mark, self.readers, self.cut, self.open = KEPT, False, False, True  # open: nothing marked from here up
        self.in_link = tag == "a" or (parent is not None and parent.in_link)
        # points: of all below but readers' comments, of what no marked part below holds, of what stands unmarked around
        self.held, self.free, self.around, self.longest, self.score = 0.0, 0.0, 0.0, 0, 0.0
        self.length, self.linked, self.prose = 0, 0, 0  # characters: all, in links, in paragraphs


def named(token: str, excused: frozenset) -> tuple[int, bool]:
    """The mark that one whole class or id asks for, and whether it names readers' comments.

    All of its words are known for a firm or soft mark. With others among them it is a hint if its first word is one, or the
    last but for filler; readers' comments come last.
    """
    mark, readers = KEPT, False
    words = [w.lower() for w in NAME_WORD.findall(token)]
    for w in words:
        if w in excused:
            continue
        if w in JUNK or w in DOUBTFUL:
            mark, readers = max(mark, FIRM if w in JUNK else SOFT), readers or w in READERS
        elif token.lower() in VENDORS:
            return FIRM, w in READERS
        elif not (w.isdigit() or w in FILLER or (mark and w in LAYOUT)):
            last = next((x for x in reversed(words) if not x.isdigit() and x not in FILLER), "")
            heads = ({words[0]} - READERS | {last}) - excused
            return (HINT if heads & HINTS or (len(words) == 1 and heads & RESPONSES) else KEPT), bool(heads & (READERS | RESPONSES))
    return mark, readers


def mark_of(tag: str, raw: str, inside: bool, inside_form: bool = False) -> tuple[int, bool]:
    """How an element is marked; inside: within an article or main part; inside_form: within a form."""
    if tag in CUT_TAGS or (tag == "header" and not inside):
        return CUT, False
    if tag == "label" and inside_form:
        return CUT, False
    mark, readers = (SOFT if tag == "form" else KEPT), False
    if not raw.strip():
        return mark, readers
    at = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(raw)}
    if tag not in ("html", "body") and ("hidden" in at or at.get("aria-hidden") == "true" or HIDDEN.search(at.get("style", ""))):
        return CUT, False
    if tag in KEEP_TAGS and tag != "article":
        return KEPT, False
    if at.get("role", "").lower() in CUT_ROLES:
        return CUT, False
    for token in f"{at.get('class', '')} {at.get('id', '')}".split():
        m, r = named(token, HEADING if inside or tag == "article" else frozenset())
        mark, readers = max(mark, m), readers or r
    return mark, readers


class _Open:
    """The open elements, with the places of each tag and of block elements, so that no search walks the stack."""

    def __init__(self, root: Node):
        self.stack, self.places, self.blocks, self.cut = [root], {}, [], 0  # cut: depth at which a cut element began, or 0

    def last(self, tag: str) -> int:
        places = self.places.get(tag)
        return places[-1] if places else -1

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.stack))
        if node.tag in BLOCK:
            self.blocks.append(len(self.stack))
        self.stack.append(node)

    def pop_to(self, k: int) -> None:
        while len(self.stack) > k:
            node = self.stack.pop()
            self.places[node.tag].pop()
            if node.tag in BLOCK:
                self.blocks.pop()
        if self.cut and k <= self.cut:
            self.cut = 0

    def close(self, tag: str) -> None:
        k = self.last(tag)
        if k > 0 and (tag in BLOCK or not self.blocks or self.blocks[-1] < k):
            self.pop_to(k)

    def close_for(self, tag: str) -> None:
        """Ends what a start tag ends unsaid: head, a paragraph, cells and items of the same list."""
        if tag == "body" and self.last("head") > 0:
            self.pop_to(self.last("head"))
        if tag in CLOSES_P and self.blocks and self.blocks[-1] == self.last("p"):
            self.pop_to(self.blocks[-1])
        while tag in SAME:
            k = max(map(self.last, SAME[tag]))
            if k <= 0 or k < max(map(self.last, FENCE - SAME[tag])):
                break
            self.pop_to(k)
            if tag not in ("tr", "tbody", "tfoot"):
                break


def parse(html: str) -> tuple[Node, list[Node]]:
    """The tree of elements and texts without what is cut at once, and its elements in page order."""
    root = Node("#root", None)
    nodes, opened, at = [root], _Open(root), 0
    while m := TOKEN.search(html, at):
        if m.start() > at and not opened.cut:
            opened.stack[-1].items.append(html[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            if tag not in VOID:
                opened.close(tag)
            continue
        raw = m[3] if m[2] else m[6]
        if tag in RAW:
            if not raw.endswith("/") or tag != "iframe":
                end = RAW_END[tag].search(html, at)
                at = len(html) if end is None else (html.find(">", end.end()) + 1 or len(html))
            continue
        opened.close_for(tag)
        parent = opened.stack[-1]
        if tag in VOID:
            if not opened.cut:
                parent.items.append(Node(tag, parent))
            continue
        node = Node(tag, parent)
        if not opened.cut:
            node.mark, node.readers = mark_of(tag, raw, opened.last("article") > 0 or opened.last("main") > 0, opened.last("form") > 0)
            if node.mark == CUT:
                opened.cut = len(opened.stack)
            else:
                parent.items.append(node)
                nodes.append(node)
                node.raw = raw.strip()
        opened.push(node)
    if at < len(html) and not opened.cut:
        opened.stack[-1].items.append(html[at:])
    return root, nodes


def plain(run: list[str]) -> str:
    """The text of a block: character references decoded, white space as one space."""
    text = NUMERIC.sub(lambda m: "&#" + (m[1].lstrip("0")[:8] or "0"), "".join(run))  # any number of 8 digits is no character
    return " ".join(unescape(text).split())


def blocks_of(top: Node) -> list[tuple[str, Node]]:
    """The blocks below a node, without parts that are cut: (text, its block element)."""
    out, run, walk = [], [], [(top, iter(top.items))]

    def flush(node: Node) -> None:
        if run:
            text = plain(run)
            run.clear()
            if text:
                while node.tag not in BLOCK and node.parent is not None:
                    node = node.parent
                out.append((text, node))

    while walk:
        node, items = walk[-1]
        for x in items:
            if isinstance(x, str):
                run.append(x)
            elif x.tag == "br":
                run.append(" ")
            elif not x.cut:
                if x.tag in BLOCK:
                    flush(node)
                walk.append((x, iter(x.items)))
                break
        else:
            walk.pop()
            if node.tag in BLOCK or not walk:
                flush(node)
    return out


def points_of(text: str) -> float:
    return 1 + text.count(",") + min(len(text) / 100, 3)


def measure(nodes: list[Node]) -> None:
    """Lengths of all elements that aren't cut; children stand after their parents."""
    for node in reversed(nodes):
        if node.cut:
            continue
        own = sum(len(x.strip()) for x in node.items if isinstance(x, str))
        node.length += own
        node.linked += own * node.in_link
        node.prose = node.length if node.tag == "p" else node.prose
        if node.parent is not None:
            up = node.parent
            up.length, up.linked, up.prose = up.length + node.length, up.linked + node.linked, up.prose + node.prose


def cut_marked(root: Node, nodes: list[Node]) -> None:
    """Cuts marked parts, but for those that hold more points than what stands unmarked around them, if no article does."""
    if not any(n.mark for n in nodes):
        return
    for text, node in blocks_of(root):
        p = points_of(text)
        node.held, node.free, node.longest = node.held + p, node.free + p, max(node.longest, len(text))
    for node in reversed(nodes[1:]):
        up = node.parent
        up.held += 0 if node.readers else node.held
        if not node.mark:
            up.free, up.longest = up.free + node.free, max(up.longest, node.longest)
    root.around = root.free
    for node in nodes[1:]:
        node.open = node.parent.open and not node.mark
    beside = any(n.open and n.tag in ("article", "main") and n.longest >= PARAGRAPH for n in nodes)
    for node in nodes[1:]:
        node.cut, node.around = node.parent.cut, node.parent.around
        if node.mark and not node.cut:
            most = node.held > node.around and node.held >= (JUNK_POINTS if node.mark == FIRM else 0) and not (node.readers and node.around)
            node.cut, node.around = beside or not most, node.free


def repeated(node: Node) -> bool:
    """Whether most of an element's parts are alike by tag and class, two or more of them, as comments and teasers are; a text's
    paragraphs and headings are no such parts."""
    parts = [(x.tag, tuple(m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(x.raw) if m[1].lower() == "class")) for x in node.items if not isinstance(x, str) and x.tag in PARTS]
    most = max((parts.count(p) for p in set(parts[:16])), default=0)
    return most >= 2 and 2 * most > len(parts)


def settle_hints(nodes: list[Node]) -> None:
    """Makes of each hint a mark or nothing, by the tree. A part whose name hints at readers, adverts or teasers is one if most of
    it is links, if its parts are alike, or if it is short and no paragraph; readers' comments also if a text stands before them.
    A name that may be a text's own asks for parts that are alike. What holds most of the page's text never is."""
    hinted = [n for n in nodes if n.mark == HINT]
    if not hinted:
        return
    length, linked, longest, before, total = {}, {}, {}, {}, 0
    for node in nodes:  # in page order: how much text stands before each
        before[id(node)] = total
        total += sum(len(x.strip()) for x in node.items if isinstance(x, str))
    for node in reversed(nodes):
        own = sum(len(x.strip()) for x in node.items if isinstance(x, str))
        length[id(node)] = length.get(id(node), 0) + own
        linked[id(node)] = linked.get(id(node), 0) + own * node.in_link
        longest[id(node)] = max(longest.get(id(node), 0), own)
        if node.parent is not None:
            up = id(node.parent)
            length[up], linked[up] = length.get(up, 0) + length[id(node)], linked.get(up, 0) + linked[id(node)]
            longest[up] = max(longest.get(up, 0), longest[id(node)])
    for node in hinted:
        k = id(node)
        words = {w.lower() for t in node.raw.split() for w in NAME_WORD.findall(t)}
        alike, links = repeated(node), linked[k] * 2 > length[k]
        own_name = not words & HINTS
        follows = node.readers and not own_name and before[k] > length[k]
        junk = alike or links or (not own_name and (follows or longest[k] < PARAGRAPH))
        node.mark = (FIRM if node.readers else SOFT) if junk and 2 * length[k] <= total else KEPT
        node.readers = node.readers and node.mark != KEPT


def score_containers(every: list[tuple[str, Node]]) -> list[Node]:
    """Passes the points of each block to the elements above it, fewer with distance; returns the elements with points."""
    scored = {}
    for text, node in every:
        up = node if node.tag not in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "pre", "td") else node.parent
        for share in (1, 2, 6, 9, 12):
            if up is None or up.parent is None:
                break
            up.score += points_of(text) / share
            scored[id(up)] = up
            up = up.parent
    return list(scored.values())


def _density(node: Node) -> float:
    return node.linked / node.length if node.length else 0.0


def main_blocks(html: str) -> list[str]:
    root, nodes = parse(html)
    settle_hints(nodes)
    cut_marked(root, nodes)
    measure(nodes)
    every = blocks_of(root)
    scored = score_containers(every)
    if not scored:
        return [t for t, _ in every]
    best = max(scored, key=lambda n: n.score * (1 - _density(n)))
    top, node = best, best
    while node is not None:  # the whole article, or the main part, that holds the best container
        if node.tag == "article" or (node.tag == "main" and top.tag != "article"):
            top = node
        node = node.parent
    while top.tag in ("section", "p", "blockquote", "ul", "ol") and top.parent is not None and top.parent.tag not in ("body", "html", "#root"):
        top = top.parent  # a part of a text stands for the whole
    limit = max(10.0, 0.2 * best.score * (1 - _density(best)))
    chosen: list = []
    for x in top.parent.items if top.parent is not None and top.tag not in ("body", "html", "main") else [top]:
        if isinstance(x, str) or x.cut:
            continue
        plain_ = _density(x) < 0.25
        if x is top or (x.tag in SIBLINGS and plain_) or (x.score * (1 - _density(x)) >= limit and _density(x) < 0.5):
            chosen.append(x)
        elif x.tag == "p" and plain_ and (x.length > PARAGRAPH or top.tag != "article"):
            chosen.append(x)
        elif plain_ and x.prose >= PARAGRAPH and top.tag != "article":  # a part of a text that sibling parts divide
            chosen.append(x)
    return [t for x in chosen for t, _ in blocks_of(x)]


def main_text(html: str | None) -> str:
    return "\n\n".join(main_blocks(html)) if html else ""


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of pages (page_id, url, html), from the whole html.

    A null or empty html, or one without text, gives an empty text. Of containers with equal points the first wins.
    Pages of any length, depth or number of attributes take linear time. Rows stay as they are, repeated ones and nulls too;
    other columns are ignored; an empty table gives no rows. Unclosed and misnested tags are mended as browsers do.
    """

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                texts = [main_text(h) for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return only(pages, "page_id", "url", "html").selectExpr("cast(page_id as long) page_id", "url", "html").mapInArrow(tidy(run), "page_id long, url string, text string, n_chars long")
