"""Main text of web pages by scoring the tree.

Each paragraph gives points for its length and commas to its ancestors, fewer the further
away they are; a container's points are discounted by its link density. The best container
and those of its siblings that score near it are kept, without menus, headers, footers, sidebars, notices,
adverts, forms and reader comments.

Names of elements tell of parts beside an article. Outside one they drop what holds less than half of the page's text; inside, where they may be
the article's own, a named part with paragraphs of its own words stays, unless the name is of adverts, comments or consent.

Defined results: null or empty html and pages without any text give ''; broken markup
(unclosed or crossing tags, a page that stops inside a tag) is read as far as it goes; a page of plain text is one
block; references to characters that do not exist give U+FFFD; repeated rows are worked on each; an empty table gives an empty one; columns other
than ``page_id``, ``url`` and ``html`` are ignored. Pages of any length are taken whole, in time that grows with the length.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from meterline.llm.shared import arrow_schema, slices, table

EXTRACTED = "page_id long, url string, text string, n_chars long"

#: A start or end tag as most are written. Nothing in it is tried twice, and it never reaches over another tag, so that reading takes linear time.
_PLAIN_TAG = re.compile(r"""<(/?)([a-zA-Z][a-zA-Z0-9]*+)((?:\s++[a-zA-Z-]++(?:=(?:"[^"<>]*+"|'[^'<>]*+'|[^\s"'<>=`/]++))?+)*+\s*+/?+)>""")
_TAG_NAME = re.compile(r"[^\s/>]++")
_BETWEEN = re.compile(r"[\s/]*+")
_ATTRIBUTE_NAME = re.compile(r"=?[^\s/>=]*+")
_EQUALS = re.compile(r"\s*+=\s*+")
_UNQUOTED = re.compile(r"[^\s>]*+")
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?+""")
#: Elements whose content is no markup.
_RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "noembed", "noframes", "xmp", "template"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr", "param"}
_BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "tfoot", "thead", "tr", "ul",
}
#: What a start tag closes if it is open, and what bounds the search for it.
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Elements that are never part of an article.
_DROPPED = {"nav", "aside", "footer", "button", "select", "option", "input", "svg", "canvas", "object", "audio", "video", "dialog", "menu", "map", "head", "label", "fieldset", "datalist"}
_DROPPED_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "form", "toolbar"}
#: Words of class and id names that tell of parts beside an article. A name counts as a whole: all of its words must be such or be among those for boxes.
_BESIDE = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "adsense", "adbox", "adslot", "sponsor", "sponsored", "sponsors", "promo", "promoted",
    "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "pagination", "pager", "masthead", "topbar", "sidebar", "rail", "widget", "widgets",
    "comment", "comments", "commentlist", "reply", "replies", "respond", "disqus", "cookie", "cookies", "consent", "gdpr", "popup", "modal", "overlay", "lightbox",
    "share", "sharing", "social", "related", "recommended", "recommendations", "recirculation", "outbrain", "taboola", "subscribe", "subscription", "newsletter", "signup", "login", "signin", "paywall", "skip", "hidden",
}
#: The same, but inside an article they may be its own.
_BESIDE_OUTSIDE = {"header", "footer", "foot", "banner", "notice", "notices", "notification", "alert", "disclaimer", "copyright", "toolbar", "tabs", "toc", "aside", "search", "form", "discussion", "responses", "promotion"}
#: Words for boxes, which say nothing of what is in them.
_BOXES = {
    "box", "list", "section", "container", "wrapper", "wrap", "block", "area", "bar", "link", "links", "button", "buttons", "item", "items", "group", "inner", "outer", "left", "right", "top", "bottom", "primary", "secondary",
    "site", "page", "global", "post", "posts", "article", "articles", "stories", "unit", "slot", "zone", "panel", "icons", "count", "thread", "feed", "module", "row", "col", "column", "sticky", "fixed", "mobile", "desktop", "reader", "user", "js", "form", "header", "footer", "title", "main",
}
_KEPT = {"html", "body", "article", "main"}
#: Headings and paragraphs are named after what they tell of.
_NAMED_FREELY = {"h1", "h2", "h3", "h4", "h5", "h6", "p"}
#: Words of parts that stay out even if they are most of a page, unless the article is inside.
_OTHERS = {w for w in _BESIDE if w.startswith(("ad", "comment", "cookie", "consent", "disqus", "gdpr", "repl", "respon", "sponsor"))}
#: A number of a character with so many digits that it is better read without its zeros.
_LONG_NUMBER = re.compile(r"&#0*+([0-9]++);?+")
#: Elements that are named in sentences, too: they stay where text stands beside them.
_IN_TEXT = {"button", "label"}
_TEXTUAL = {"p", "li", "dd", "dt", "td", "th", "blockquote", "figcaption", "h1", "h2", "h3", "h4", "h5", "h6"}
_HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
#: What stands above reader comments.
_COMMENTS_BELOW = re.compile(r"(?:\(?\d+\)? )?(?:reader |user )?(?:comments?|replies|responses)(?: \(?\d+\)?)?:?|(?:leave|post|write) a (?:reply|comment)", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]++|[A-Z]++|[^a-zA-Z0-9_-]++")


#: What an element's own tag and names say: it stays; it stays in an article if it has paragraphs; it goes unless it holds most of the page; the same, but only around an article; it goes.
KEEP, OWN, WEAK, FOREIGN, OUT = range(5)


class Node:
    __slots__ = ("tag", "parent", "children", "dropped", "points", "chars", "link_chars", "links", "end", "out")

    def __init__(self, tag: str, parent: Node | None, dropped: bool):
        self.tag, self.parent, self.dropped = tag, parent, dropped
        self.children: list[Node | str] = []
        self.out = KEEP
        self.points = 0.0
        self.chars = self.link_chars = self.links = 0


def _drops(tag: str, attributes: str, in_article: bool) -> int:
    if tag in _DROPPED or tag == "header" and not in_article:
        return OUT
    out = WEAK if tag == "form" else KEEP
    if not attributes or tag in _KEPT and tag != "article":
        return out
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id"):
            if tag in _NAMED_FREELY or name == "id" and tag == "section" and in_article:
                continue
            beside = _OTHERS if tag == "article" else _BESIDE if in_article else _BESIDE | _BESIDE_OUTSIDE
            for one in value.split():
                words = {w.lower() for w in _WORD.findall(one)}
                if words & beside and words <= beside | _BOXES:
                    out = max(out, FOREIGN if words & _OTHERS else OWN if in_article else WEAK)
        elif name == "role" and value.lower() in _DROPPED_ROLES or name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return OUT
    return out


def _text(node: Node, most: int = 40) -> str:
    """The text of a small element; of one with more than ``most`` characters or elements, the beginning."""
    out, held, seen, stack = [], 0, 0, [node]
    while stack and held <= most and seen <= most:
        child = stack.pop()
        seen += 1
        if isinstance(child, str):
            out.append(child)
            held += len(child.strip())
        else:
            stack += child.children[most::-1]
    return " ".join("".join(out).split())


def _drop_comments(root: Node) -> None:
    """A heading that announces reader comments goes, and what follows it up to the next heading of its level or above."""
    nodes = [root]
    for node in nodes:
        level = 0
        for child in node.children:
            if not isinstance(child, Node):
                continue
            if child.tag in _HEADINGS:
                if level and child.tag <= f"h{level}":
                    level = 0
                if not level and _COMMENTS_BELOW.fullmatch(_text(child)):
                    level = int(child.tag[1])
            if level and child.tag not in ("article", "main"):
                child.out = OUT
            else:
                nodes.append(child)


def _own_words(root: Node) -> None:
    """Named parts inside an article: those whose text is mostly paragraphs outside links stay, others go. Elements that sentences name stay where their parent has text of its own."""
    held: dict[int, list] = {}
    stack: list[tuple[Node, Node | None, bool, bool]] = [(root, None, False, False)]
    while stack:
        node, own, in_paragraph, in_link = stack.pop()
        if node.out == OUT and node.tag in _IN_TEXT and node.parent is not None and (node.parent.tag in _TEXTUAL or in_paragraph) and any(isinstance(x, str) and x.strip() for x in node.parent.children):
            node.out = KEEP
        if node.out == OUT:
            continue
        if node.out == OWN:
            own = node
            held[id(node)] = [node, 0, 0]
        in_paragraph = in_paragraph if node.tag not in _BLOCK else node.tag == "p" or in_paragraph and node.tag != "div"
        in_link = in_link or node.tag == "a"
        for child in node.children:
            if isinstance(child, Node):
                stack.append((child, own, in_paragraph, in_link))
            elif own is not None:
                n = len(child.strip())
                held[id(own)][1] += n
                held[id(own)][2] += n * (in_paragraph and not in_link)
    for node, n, plain in held.values():
        node.out = KEEP if 2 * plain > n else WEAK


def _settle(root: Node) -> None:
    """Decides which elements are dropped. Text outside links counts for the nearest doubtful element around it; one with
    more than half of the page's text stays, and so do those around it.
    """
    _drop_comments(root)
    _own_words(root)
    held: dict[int, list] = {}
    total = 0
    stack: list[tuple[Node, Node | None, bool]] = [(root, None, False)]
    while stack:
        node, doubtful, in_link = stack.pop()
        if node.out == OUT:
            continue
        if node.out:
            doubtful = node
            held[id(node)] = [node, 0, False]
        in_link = in_link or node.tag == "a"
        if doubtful is not None and node.tag in ("article", "main", "h1"):
            held[id(doubtful)][2] = True
        for child in node.children:
            if isinstance(child, Node):
                stack.append((child, doubtful, in_link))
            elif not in_link:
                n = len(" ".join(child.split()))
                total += n
                if doubtful is not None:
                    held[id(doubtful)][1] += n
    for node, n, article in held.values():
        if 2 * n > total and (node.out == WEAK or article):
            at: Node | None = node
            while at is not None:
                at.out = KEEP
                at = at.parent
    nodes = [root]
    for node in nodes:
        node.dropped = node.out != KEEP or node.parent is not None and node.parent.dropped
        nodes += [x for x in node.children if isinstance(x, Node)]


def unescaped(text: str) -> str:
    """Character references decoded; numbers of any length are read."""
    if "&" not in text:
        return text
    return entities.unescape(_LONG_NUMBER.sub(lambda m: f"&#{m[1]};" if len(m[1]) < 8 else "\ufffd", text))


class Reader:
    """Finds the markup of a page, one piece after another, in linear time."""

    def __init__(self, page: str):
        self._page = page
        self._none_after: dict[str, int] = {}

    def _find(self, what: str, at: int) -> int:
        """As str.find; that there is no more is looked up once."""
        if at >= self._none_after.get(what, len(self._page) + 1):
            return -1
        found = self._page.find(what, at)
        if found < 0:
            self._none_after[what] = at
        return found

    def next(self, at: int) -> tuple[int, int, bool, str | None, str]:
        """From ``at`` on, the next markup's begin and end, whether it is an end tag, its name (None if it is no tag), attributes."""
        page, n = self._page, len(self._page)
        while True:
            begin = self._find("<", at)
            if begin < 0:
                return n, n, False, None, ""
            m = _PLAIN_TAG.match(page, begin)
            if m:
                return begin, m.end(), bool(m[1]), m[2], m[3]
            after = page[begin + 1 : begin + 4]
            if after == "!--":
                end = self._find("-->", begin + 4)
                return begin, n if end < 0 else end + 3, False, None, ""
            if after[:1] in ("!", "?"):
                end = self._find(">", begin)
                return begin, n if end < 0 else end + 1, False, None, ""
            closes = after[:1] == "/"
            if not after[closes : closes + 1].isascii() or not after[closes : closes + 1].isalpha():
                at = begin + 1  # a sign in the text
                continue
            name = _TAG_NAME.match(page, begin + 1 + closes)
            end = self._attributes_end(name.end())
            return begin, n if end is None else end + 1, closes, name[0] if end is not None else None, page[name.end() : end]

    def _attributes_end(self, at: int) -> int | None:
        """Where the tag's > is, or None if the page stops in the tag."""
        page, n = self._page, len(self._page)
        while True:
            at = _BETWEEN.match(page, at).end()
            if at >= n:
                return None
            if page[at] == ">":
                return at
            at = _ATTRIBUTE_NAME.match(page, at).end()
            m = _EQUALS.match(page, at)
            if m:
                at = m.end()
                quote = page[at : at + 1]
                end = self._find(quote, at + 1) if quote in ('"', "'") else -1
                at = end + 1 if end >= 0 else _UNQUOTED.match(page, at).end()


class Open:
    """The elements that are open, and where each kind is."""

    def __init__(self):
        self.tags = ["html"]
        self._at: dict[str, list[int]] = {}
        #: Of the first so many open elements, those that hold a paragraph open.
        self._holding = [0, 0]

    def push(self, tag: str) -> None:
        self._at.setdefault(tag, []).append(len(self.tags))
        self.tags.append(tag)
        self._holding.append(self._holding[-1] + (tag in _BLOCK or tag in ("td", "th", "button", "object")))

    def pop(self) -> str:
        tag = self.tags.pop()
        self._at[tag].pop()
        self._holding.pop()
        return tag

    def last(self, tags) -> int:
        """The place of the innermost of ``tags``, or 0."""
        return max((places[-1] for t in tags if (places := self._at.get(t))), default=0)

    def held_above(self, depth: int) -> bool:
        return self._holding[-1] > self._holding[depth + 1]


def parse(page: str) -> Node:
    root = Node("html", None, False)
    at = root
    opened, reader = Open(), Reader(page)
    articles = 0
    place, n = 0, len(page)

    def close_to(depth: int) -> None:
        nonlocal at, articles
        while len(opened.tags) > depth:
            articles -= opened.pop() in ("article", "main")
            at = at.parent

    while place < n:
        begin, end, closes, tag, attributes = reader.next(place)
        if begin > place:
            text = page[place:begin]
            at.children.append(unescaped(text))
        place = end
        if tag is None:
            continue
        tag = tag.lower()
        if closes:
            if depth := opened.last((tag,)):
                close_to(depth)
            elif tag == "br":
                at.children.append(" ")
            continue
        if tag in _RAW:
            stop = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I).search(page, place)
            place = reader._find(">", stop.end()) + 1 if stop else n
            place = place or n
            continue
        if tag in _VOID:
            at.children.append(Node("hr", at, False) if tag == "hr" else " ")
            continue
        if tag in _BLOCK and (depth := opened.last(("p",))) and not opened.held_above(depth):
            close_to(depth)  # a paragraph ends where a block begins, unless something between holds it open
        if tag in _CLOSES:
            shut, bound = _CLOSES[tag]
            while (depth := opened.last(shut)) > opened.last(bound):
                close_to(depth)
                if tag != "tr":
                    break
        if tag in ("html", "body"):
            continue
        child = Node(tag, at, False)
        child.out = _drops(tag, attributes, articles > 0)
        at.children.append(child)
        if not attributes.endswith("/") or tag in _BLOCK:
            at = child
            opened.push(tag)
            articles += tag in ("article", "main")
    _settle(root)
    return root


def blocks_of(root: Node) -> list[tuple[Node, str, int, int]]:
    """In page order, each run of text between block edges: its element, text, characters in links, links."""
    out: list[tuple[Node, str, int, int]] = []
    run: list[str] = []
    owner, linked, links = root, 0, 0

    def flush() -> None:
        nonlocal linked, links
        text = " ".join("".join(run).split())
        if text:
            out.append((owner, text, min(linked, len(text)), links))
        run.clear()
        linked = links = 0

    stack: list[tuple[Node, int, Node, bool]] = [(root, 0, root, False)]
    while stack:
        node, k, block, in_link = stack.pop()
        if k == 0 and node.tag in _BLOCK:
            flush()
        owner = block
        while k < len(node.children):
            child = node.children[k]
            k += 1
            if isinstance(child, str):
                run.append(child)
                if in_link:
                    linked += len(" ".join(child.split()))
            elif not child.dropped:
                stack.append((node, k, block, in_link))
                if child.tag in ("td", "th"):
                    run.append(" ")
                links += child.tag == "a"
                stack.append((child, 0, child if child.tag in _BLOCK else block, in_link or child.tag == "a"))
                break
            elif child.tag in _BLOCK:
                flush()
        else:
            if node.tag in _BLOCK:
                flush()
    flush()
    return out


def tags_of(node: Node) -> set[str]:
    """The tags of kept elements with text inside an element."""
    out, nodes = set(), [node]
    for x in nodes:
        out.add(x.tag)
        nodes += [y for y in x.children if isinstance(y, Node) and not y.dropped and y.chars]
    return out


def _led(root: Node) -> set[int]:
    """In articles and their sections, the elements that follow a heading directly."""
    out: set[int] = set()
    nodes = [(root, False)]
    for node, inside in nodes:
        inside = node.tag in ("article", "main") or inside and node.tag in ("section", "div")
        before: Node | str | None = None
        for child in node.children:
            if isinstance(child, Node):
                nodes.append((child, inside))
                if inside and isinstance(before, Node) and before.tag in _HEADINGS and not before.dropped:
                    out.add(id(child))
            if isinstance(child, Node) or child.strip():
                before = child
    return out


def main_text(page: str | None) -> str:
    """The article's blocks, joined by an empty line."""
    if not page:
        return ""
    found = blocks_of(parse(page))
    if not found:
        return ""
    for node, text, linked, links in found:
        node.chars += len(text)
        node.link_chars += linked
        node.links += links
    nodes = [found[0][0]]
    while nodes[0].parent is not None:
        nodes[0] = nodes[0].parent
    for node in nodes:
        nodes += [x for x in node.children if isinstance(x, Node)]
    for node in reversed(nodes[1:]):
        node.parent.chars += node.chars
        node.parent.link_chars += node.link_chars
        node.parent.links += node.links
    scored: dict[int, Node] = {}
    for node, text, linked, _ in found:
        points = (1 + text.count(",") + min(len(text) / 100, 3)) * (1 - linked / len(text))
        # of a paragraph, its parent is the first container; a container's own text counts for itself
        at, level = (node.parent if node.tag in ("p", "pre", "li", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6", "td", "dd", "dt") and node.parent else node), 0
        while at is not None and level < 6:
            at.points += points / (1, 2, 6, 9, 12, 15)[level]
            scored[id(at)] = at
            at, level = at.parent, level + 1

    def worth(node: Node) -> float:
        bonus = 1.5 if node.tag in ("article", "main") else 1.0
        return node.points * bonus * (1 - node.link_chars / max(1, node.chars))

    best = max(scored.values(), key=worth)
    at = best
    while at is not None and at.tag not in ("article", "main"):
        at = at.parent
    if at is not None:
        best = at
    keep = {id(best)}
    if best.parent is not None and best.tag != "main":
        least = max(2.0, 0.2 * worth(best))
        titled = "h1" in tags_of(best)
        met = False
        for other in best.parent.children:
            met = met or other is best
            if isinstance(other, Node) and other is not best and not other.dropped:
                dense = other.link_chars / max(1, other.chars)
                if best.tag == "article":
                    # beside an article, other articles with text of their own, and the title before it
                    if other.tag == "article" and other.points and dense < 0.25 or not (met or titled) and other.tag in ("h1", "hgroup") and dense < 0.25:
                        keep.add(id(other))
                elif other.points and worth(other) >= least or other.tag in ("p", "h1", "h2", "h3") and dense < 0.25 or dense < 0.25 and "p" in tags_of(other):
                    keep.add(id(other))
    led = _led(nodes[0])
    lines = []
    inside: dict[int, bool] = {}
    for node, text, _, _ in found:
        path, at = [], node
        while at is not None and id(at) not in inside:
            path.append(at)
            at = at.parent
        value = at is not None and inside[id(at)]
        listed = False
        for step in reversed(path):
            # a list or table that is mostly links is a menu, unless a heading of the article leads to it
            listed = step.tag in ("ul", "ol", "table", "dl") and step.links >= 3 and step.link_chars > 0.5 * step.chars and id(step) not in led
            value = (value or id(step) in keep) and not listed
            inside[id(step)] = value
        if inside[id(node)]:
            lines.append(text)
    return "\n\n".join(lines)


def extract(pages: DataFrame) -> DataFrame:
    schema = arrow_schema(EXTRACTED)

    def work(batches):
        for batch in batches:
            for some in slices(batch, "html", 4 << 20):
                ids, urls, pages = (some.column(k) for k in range(3))
                texts = [main_text(x) for x in pages.to_pylist()]
                yield pa.RecordBatch.from_arrays([ids, urls, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=schema)

    return pages.select(pages["page_id"].cast("long"), "url", "html").mapInArrow(work, EXTRACTED)


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
