"""Main text of web pages by tree scoring.

Paragraphs pass points for their length and commas to their ancestors, discounted by link
density. The best container is kept with those of its siblings that belong to the text.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
# An ordinary tag as a whole; what is longer or has an open quote takes the slow way, so that no place is scanned far in vain.
_ORDINARY = re.compile(r"""<(/?)([a-zA-Z][^\s/>"']{0,60}+)((?:\s[^"'<>]{0,300}+(?:"[^"]{0,300}+"[^"'<>]{0,100}+|'[^']{0,300}+'[^"'<>]{0,100}+){0,8}+)?+/?)>""")
_ASIDE = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)", re.S)
_STOP = re.compile(r"[\"'>]")
# A name starts where no part of a name stands before it, so that long runs are looked at once.
_ATTR = re.compile(r"""(?<![^\s"'>/=])([^\s"'>/=]++)\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_LONG_NUMBER = re.compile(r"&#(?:[xX]0*+([0-9a-fA-F]*)|0*+([0-9]*));?")

# Names of HTML elements by their role.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
_CLOSES_P = _BLOCK - frozenset("body caption html tbody td tfoot th thead tr title".split())
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_FENCE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
_DROP = frozenset("head script style noscript template iframe svg canvas object embed nav aside footer form button select option textarea input dialog menu audio video map".split())
_PARAGRAPH = frozenset("p pre td blockquote li dd h1 h2 h3 h4 h5 h6 figcaption".split())
_UNSEEN = frozenset("head script style noscript template iframe".split())
_PIECES = frozenset("table thead tbody tfoot tr td th ul ol dl li dt dd".split())
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
_BAD_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
# Words in class names and ids that mark what is not the text.
_BAD = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|banner|sponsor\w*|promo\w*|cookie\w*|consent|gdpr|notice|alert|popup|modal|overlay|comments?|commentlist|disqus|replies|respond|sidebar|side|aside|menu|nav|navbar|navigation|breadcrumbs?"
    r"|footer|foot|header|masthead|topbar|toolbar|share|sharing|social|related|recommend\w*|newsletter|subscribe|signup|login|search|pagination|pager|tags|widget|skip|hidden)(?:$|[\s_\d-])",
    re.I,
)
_GOOD = re.compile(r"(?:^|[\s_-])(?:article|body|content|entry|main|post|story|text|page)(?:$|[\s_-])", re.I)


class _Node:
    __slots__ = ("tag", "attrs", "parent", "items", "points", "size", "linked", "commas", "cut")

    def __init__(self, tag: str, attrs: str, parent: _Node | None):
        self.tag, self.attrs, self.parent, self.items = tag, attrs, parent, []
        self.points, self.size, self.linked, self.commas, self.cut = 0.0, 0, 0, 0, False


def _tags(page: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """(start, end, whether it ends an element, name, attributes) of each tag; comments and declarations have no name.

    A quote that is never closed is an ordinary character, and a tag that is never closed is text.
    The caller sends the place to go on from, or None for the tag's end. Each character is looked at a bounded number of times.
    """
    at, open_ended, ordinary = 0, set(), _ORDINARY.match
    while (start := page.find("<", at)) >= 0:
        if m := ordinary(page, start):
            ends, tag, attrs = m.groups()
            at = (yield start, m.end(), ends == "/", tag.lower(), attrs) or m.end()
            continue
        if page.startswith(("<!", "<?"), start):
            end = _ASIDE.match(page, start).end()
            at = (yield start, end, False, "", "") or end
            continue
        m = _TAG.match(page, start)
        if not m:
            at = start + 1
            continue
        to = m.end()
        while stop := _STOP.search(page, to):
            to = stop.end()
            mark = stop[0]
            if mark == ">":
                break
            if mark not in open_ended:
                closing = page.find(mark, to)
                if closing < 0:
                    open_ended.add(mark)
                else:
                    to = closing + 1
        else:
            return
        at = (yield start, to, bool(m[1]), m[2].lower(), page[m.end() : to - 1]) or to


class _Open:
    """The open elements, outermost first, and for each name the depths at which it is open."""

    def __init__(self, root: _Node):
        self.path, self.depths, self.blocks = [root], {}, [0]

    def push(self, node: _Node) -> None:
        self.depths.setdefault(node.tag, []).append(len(self.path))
        if node.tag in _BLOCK and node.tag != "p":
            self.blocks.append(len(self.path))
        self.path.append(node)

    def close(self, depth: int) -> None:
        """Close all that is open at this depth and below."""
        while len(self.path) > depth:
            node = self.path.pop()
            self.depths[node.tag].pop()
            if self.blocks[-1] == len(self.path):
                self.blocks.pop()

    def deepest(self, names) -> int:
        return max((d[-1] for t in names if (d := self.depths.get(t))), default=0)

    def outermost(self, names, below: int) -> int:
        """The smallest depth over ``below`` where one of the names is open; 0 without any."""
        return min((d[bisect_right(d, below)] for t in names if (d := self.depths.get(t)) and d[-1] > below), default=0)


def _tree(page: str) -> _Node:
    """Tree of a page, lenient as browsers are: tags may be left open, cross or end nowhere. Linear in the page."""
    root = _Node("#root", "", None)
    now = _Open(root)
    depths = now.depths
    at, n = 0, len(page)
    lower = None
    tags, onwards = _tags(page), None
    while True:
        try:
            start, end, ends, tag, attrs = tags.send(onwards)
        except StopIteration:
            break
        onwards = None
        if start > at:
            now.path[-1].items.append(page[at:start])
        at = end
        if not tag:
            continue
        if ends:
            if tag == "br":
                now.path[-1].items.append(" ")
                continue
            depth = d[-1] if (d := depths.get(tag)) else 0
            if depth and (tag in _BLOCK or depth >= now.deepest(("td", "th", "table"))):  # an inline end tag does not close a table
                now.close(depth)
            continue
        if shut := _CLOSES.get(tag):
            depth = now.outermost(shut | {"p"} if tag in _CLOSES_P else shut, now.deepest(_FENCE[tag]))
            if depth:
                now.close(depth)
        elif tag in _CLOSES_P and (d := depths.get("p")) and d[-1] > now.blocks[-1]:
            now.close(d[-1])
        node = _Node(tag, attrs, now.path[-1])
        node.parent.items.append(node)
        if tag in _RAW:
            if lower is None:
                lower = page.lower()
                if len(lower) != n:  # a few letters change their length; ASCII folding keeps it
                    lower = "".join(c.lower() if c < "\x80" else c for c in page)
            end = lower.find("</" + tag, at)
            end = n if end < 0 else end
            if tag in ("title", "textarea"):
                node.items.append(page[at:end])
            onwards = at = page.find(">", end) + 1 or n
        elif tag not in _VOID and not attrs.endswith("/"):
            now.push(node)
        elif tag in ("br", "hr"):
            node.parent.items.append(" ")
    if at < n:
        now.path[-1].items.append(page[at:])
    return root


def _marks(node: _Node) -> str:
    if not node.attrs or "=" not in node.attrs:
        return ""
    return " ".join(a[1] or a[2] or a[3] for a in _ATTR.findall(node.attrs) if a[0].lower() in ("class", "id"))


def _attr(node: _Node, name: str) -> str:
    return next((a[1] or a[2] or a[3] for a in _ATTR.findall(node.attrs) if a[0].lower() == name), "") if node.attrs else ""


def _is_clutter(node: _Node, inside: bool) -> bool:
    """``inside``: within an article, whose own header holds its title."""
    if node.tag in _DROP:
        return True
    if node.tag == "header":
        return not inside
    if node.attrs:
        if re.search(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", node.attrs, re.I):
            return True
        if "role" in node.attrs and _attr(node, "role").lower() in _BAD_ROLE:
            return True
        if node.tag not in ("html", "body", "article", "main"):
            marks = _marks(node)
            if marks and _BAD.search(marks) and not (node.tag in ("div", "section") and _GOOD.search(marks) and not re.search(r"comment|sidebar|footer|nav|ad(?:$|[\s_-])", marks, re.I)):
                return True
        elif node.tag == "article" and re.search(r"comment|reply|promo|related|sponsor", _marks(node), re.I):
            return True
    return False


def _walk(root: _Node) -> Iterator[tuple[_Node, bool]]:
    """Every node twice: on the way down (True) and up (False); no recursion, for deep pages."""
    stack = [(root, True)]
    while stack:
        node, down = stack.pop()
        yield node, down
        if down:
            stack.append((node, False))
            if not node.cut:
                stack.extend((x, True) for x in reversed(node.items) if type(x) is _Node)


def _prepare(root: _Node) -> None:
    """Cut clutter, sum up text and linked text, and let paragraphs pass their points up."""
    inside = 0
    for node, down in _walk(root):
        if down:
            node.cut = node.parent is not None and _is_clutter(node, inside > 0)
            if node.tag in ("article", "main") and not node.cut:
                inside += 1
            continue
        if node.cut:
            continue
        if node.tag in ("article", "main"):
            inside -= 1
        own = "".join(x for x in node.items if type(x) is str)
        below = [x for x in node.items if type(x) is _Node and not x.cut]
        bare, commas = len(own.strip()), own.count(",") + own.count("،") + own.count("，")
        node.size, node.commas = bare + sum(x.size for x in below), commas + sum(x.commas for x in below)
        node.linked = node.size if node.tag == "a" else sum(x.linked for x in below)
        if node.size and (node.tag in _PARAGRAPH or (node.tag in ("div", "section", "article", "main", "body") and bare)):
            whole = node.tag in _PARAGRAPH
            points = (1 + (node.commas if whole else commas) + min((node.size if whole else bare) / 100, 3)) * (1 - node.linked / max(1, node.size))
            share, up = 1.0, node.parent if whole else node
            level = 0
            while up is not None and level < 4:
                up.points += points * share
                level += 1
                share = 0.5 if level == 1 else 1 / (3 * level)
                up = up.parent


def _best(root: _Node) -> list[_Node]:
    """The best container with the siblings that belong to it, in page order."""
    nodes = [n for n, down in _walk(root) if down and not n.cut]
    rated = [(n.points * (1 - n.linked / n.size) * (1.25 if n.tag in ("article", "main") or _GOOD.search(_marks(n)) else 1), n) for n in nodes if n.size and n.points > 0 and n.tag not in ("html", "#root")]
    if not rated:
        return [root]
    top, best = max(rated, key=lambda x: x[0])
    while best.tag in _PIECES and best.parent is not None:  # parts of a table or list are no container of their own
        best = best.parent
    # an article around the best container is the text as its author marked it
    up = best
    while up is not None:
        if up.tag in ("article", "main") or _attr(up, "role") == "main" or "articlebody" in _attr(up, "itemprop").lower():
            best = up
            if up.tag == "article":
                break
        up = up.parent
    if best.tag in ("article", "main"):
        if best.tag == "article" and best.parent is not None:  # a text may be dealt over several articles
            return [x for x in best.parent.items if type(x) is _Node and not x.cut and (x is best or (x.tag == "article" and x.points >= max(10, 0.2 * top) and x.linked < 0.5 * x.size))]
        return [best]
    if best.parent is None or best.tag == "body":
        return [best]
    kept = []
    for x in best.parent.items:
        if type(x) is not _Node or x.cut or not x.size:
            continue
        loose = x.linked / x.size
        if x is best or x.points * (1 - loose) >= max(10, 0.2 * top) or (x.tag == "p" and loose < 0.25) or (x.tag in _HEADING and loose < 0.25):
            kept.append(x)
    return kept


def decoded(text: str) -> str:
    """Character references decoded; numbers beyond any character become U+FFFD, however long they are."""
    if "&" not in text:
        return text
    return html.unescape(_LONG_NUMBER.sub(lambda m: "\ufffd" if len(m[1] or m[2] or "") > 7 else m[0], text))


def _blocks(nodes: list[_Node]) -> list[str]:
    """Texts of the blocks in page order; white space is one space, character references are decoded."""
    out: list[str] = []
    now: list[str] = []

    def close():
        text = " ".join(decoded("".join(now)).split())
        now.clear()
        if text:
            out.append(text)

    for top in nodes:
        stack: list = [(top, True)]
        while stack:
            x, down = stack.pop()
            if type(x) is str:
                now.append(x)
                continue
            if x.cut:
                continue
            if x.tag in _BLOCK:
                close()
            if down:
                stack.append((x, False))
                stack.extend((y, True) for y in reversed(x.items))
        close()
    return out


def main_text(page: str | None) -> str:
    """Main text of a page: its blocks in page order, joined by line breaks; empty if there is none. Null counts as empty."""
    if not page:
        return ""
    root = _tree(page)
    _prepare(root)
    return "\n".join(_blocks(_best(root)))


def visible_text(page: str | None) -> str:
    """All text of a page but scripts, styles and the head: what a plain-text conversion keeps."""
    return outline(page)[0]


def outline(page: str | None) -> tuple[str, str, str, list[str]]:
    """(visible text, title, language, link targets in page order) of a page."""
    if not page:
        return "", "", "", []
    title, language, links = None, None, []
    out: list[str] = []
    now: list[str] = []

    def close():
        text = " ".join(decoded("".join(now)).split())
        now.clear()
        if text:
            out.append(text)

    stack: list = [(_tree(page), True)]
    while stack:
        x, down = stack.pop()
        if type(x) is str:
            now.append(x)
            continue
        tag = x.tag
        if down and tag == "a" and x.attrs and (to := _attr(x, "href").strip()):
            links.append(decoded(to))
        elif down and tag == "html" and language is None:
            language = _attr(x, "lang")
        elif down and tag in ("title", "head") and title is None:
            found = x if tag == "title" else next((y for y in x.items if type(y) is _Node and y.tag == "title"), None)
            if found is not None:
                title = " ".join(decoded("".join(y for y in found.items if type(y) is str)).split())
        if tag in _UNSEEN:
            continue
        if tag in _BLOCK:
            close()
        if down:
            stack.append((x, False))
            stack.extend((y, True) for y in reversed(x.items))
    close()
    return "\n".join(out), title or "", language or "", links


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) for every row, whatever its html: null, empty or broken pages give what text they have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["id", "url", "text", "n_chars"])

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(id_col, url_col, html_col).mapInArrow(run, f"id {kind}, url string, text string, n_chars long")
