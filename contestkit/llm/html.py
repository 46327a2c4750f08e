"""Main text of web pages by tree scoring.

Blocks of text pass points for length and commas to their ancestors, less the further away; an ancestor's
points are discounted by its link density. The best container and siblings of like standing are kept, without the
boilerplate inside them.
"""

from __future__ import annotations

import html as references
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(?:[!?]|/(?![a-zA-Z]))[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)(?:>|\Z)""", re.DOTALL)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]*+)))?+""")
#: Fixed values of HTML.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style title textarea noscript iframe noembed noframes xmp".split())
_BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_ENDS_P = _BLOCK - frozenset("td th tr tbody thead tfoot body html head option dd dt li summary figcaption".split())
#: A start tag ends open elements of these kinds, up to a boundary.
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("tr", "td", "th", "thead", "tbody"), "thead": ("tr", "td", "th"), "tfoot": ("tr", "td", "th", "tbody", "thead")}
_BOUNDARY = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "option": ("select",)}
#: Elements that never hold the article.
_DROPPED = frozenset("script style noscript iframe template textarea title head nav header footer aside form button select input menu dialog svg object embed audio video canvas noembed noframes xmp label fieldset".split())
_ROLES = frozenset("navigation banner contentinfo complementary search alert dialog alertdialog menu menubar form toolbar".split())
#: Words of a class or id that name a menu, header, footer, sidebar, notice, advert or readers' comments: dropped everywhere.
_PARTS = frozenset(
    "ad ads adsense adbox adslot adunit adcontainer adwrapper adspace adboxes adslots adunits banner sidebar comment comments commentlist disqus respond reply replies menu nav navbar navigation breadcrumb breadcrumbs pagination pager footer header masthead cookie cookies consent gdpr notice notices notification notifications".split()
)
_PART_STARTS, _PART_HOLDS = ("advert", "sponsor", "promo"), ("comments", "sidebar", "cookie", "menu", "banner", "navbar", "advert")
#: Words that name other boxes: dropped outside the article only.
_BOXES = frozenset("popup modal overlay share sharing social related recommended subscribe subscription newsletter signup login widget toolbar skip hidden".split())
#: What may follow such a word in a class within an article that still names the part, as in "comments-area"; others, as in "comments-policy", tell of prose.
_HOLDERS = frozenset("area bar block bottom box container content form frame group holder inner item items left link links list main outer panel right row section slot space thread top unit widget widgets wrap wrapper".split())
#: Elements of running text: no box name drops them, and within an article of the parts only adverts and notices.
_PROSE = frozenset("p li blockquote pre td th dd dt".split())
_APART = re.compile(r"[\s_-]+")
_REMARKS = re.compile(r"comment|disqus|respond|repl(?:y|ies)", re.IGNORECASE)
_LIKELY = re.compile(r"article|body|content|entry|main|page|post|story|text|blog", re.IGNORECASE)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
_PASSED_ON = (1.0, 0.5, 1 / 6, 1 / 9, 1 / 12)


def _is_part(word: str) -> bool:
    return word in _PARTS or word.startswith(_PART_STARTS) or any(x in word for x in _PART_HOLDS)


def _is_advert(word: str) -> bool:
    return word.startswith(("ad", "sponsor", "promo", "cookie", "consent", "gdpr", "notice", "notification")) and _is_part(word)


def _names_part(about: str, tag: str) -> bool:
    """Whether a class or id within an article names a part that is none: by its last word but for those of holders; running text only as an advert or notice."""
    for name in about.lower().split():
        words = [w.rstrip("0123456789") for w in _APART.split(name) if w.rstrip("0123456789")]
        while len(words) > 1 and words[-1] in _HOLDERS and not _is_part(words[-1]):
            words.pop()
        if words and (_is_advert(words[-1]) if tag in _PROSE else _is_part(words[-1]) or "side-bar" in name):
            return True
    return False


def _named_after(about: str, tag: str, within: bool) -> tuple[bool, bool]:
    """Whether a class and id name a part of the page that is no article, and whether some other box."""
    names = [w.rstrip("0123456789") for w in _APART.split(about.lower())]
    part = _names_part(about, tag) if within else "side-bar" in about or any(map(_is_part, names))
    return part, any(w in _BOXES or "newsletter" in w for w in names)


class Node:
    __slots__ = ("tag", "about", "parent", "children", "out", "points", "chars", "linked", "named")

    def __init__(self, tag: str, parent: Node | None, attributes: str = "", within: bool = False) -> None:
        """``within``: inside an article or main element."""
        self.tag, self.parent, self.children = tag, parent, []
        self.points, self.chars, self.linked = 0.0, 0, 0
        self.about, self.out, self.named = "", tag in _DROPPED, False
        if attributes.strip():
            found = {m[1].lower(): references.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(attributes)}
            self.about = f"{found.get('class', '')} {found.get('id', '')}".strip()
            self.out = self.out or "hidden" in found or found.get("aria-hidden", "").lower() == "true" or found.get("role", "").strip().lower() in _ROLES or bool(_HIDDEN.search(found.get("style", "")))
            if not self.out and self.about and tag not in ("body", "html", "article", "main") and tag not in _HEADINGS:
                part, box = _named_after(self.about, tag, within)
                self.out = self.named = part or (box and not within and tag not in _PROSE)


class _Open:
    """The open elements, with their places by tag, so that no search walks the stack."""

    def __init__(self, root: Node) -> None:
        self.stack, self.places, self.blocks = [root], {}, [0]

    def last(self, tag: str) -> int:
        """The innermost open element of the tag; zero if there is none."""
        places = self.places.get(tag)
        return places[-1] if places else 0

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.stack))
        if node.tag in _BLOCK:
            self.blocks.append(len(self.stack))
        self.stack.append(node)

    def close(self, place: int) -> None:
        """Closes the element at that place and all within it."""
        for node in reversed(self.stack[place:]):
            self.places[node.tag].pop()
            if node.tag in _BLOCK:
                self.blocks.pop()
        del self.stack[place:]

    def end(self, tag: str) -> None:
        place = self.last(tag)
        if place and (tag in _BLOCK or place > self.blocks[-1]):
            self.close(place)

    def make_room(self, tag: str) -> None:
        """Closes what a start tag ends without an end tag."""
        if tag in _ENDS_P and self.stack[self.blocks[-1]].tag == "p":
            self.close(self.blocks[-1])
        if tag not in _ENDS:
            return
        stop = max(map(self.last, _BOUNDARY.get(tag, ("table",))))
        if tag in _BOUNDARY:
            place = max(map(self.last, _ENDS[tag]))
        else:  # the outermost of them
            within = [p[bisect_right(p, stop)] for t in _ENDS[tag] if (p := self.places.get(t)) and p[-1] > stop]
            place = min(within, default=0)
        if place > stop:
            self.close(place)


def parse(page: str) -> Node:
    """A tree of elements and strings; forgiving, in one pass over the page."""
    root = Node("html", None)
    now = _Open(root)
    at = 0
    while m := _TOKEN.search(page, at):
        if m.start() > at:
            now.stack[-1].children.append(references.unescape(page[at : m.start()]))
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                now.stack[-1].children.append(page[m.start() + 9 : at].removesuffix("]]>"))
            continue
        tag = m[2].lower()
        if m[1]:
            now.end(tag)
            continue
        if not m[0].endswith(">"):
            continue
        now.make_room(tag)
        if tag in ("html", "body") and now.last(tag):
            continue
        node = Node(tag, now.stack[-1], m[3], bool(now.last("article") or now.last("main")))
        now.stack[-1].children.append(node)
        if tag in _RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.IGNORECASE).search(page, at)
            # no end tag without a ">" after it
            at = page.find(">", close.end()) + 1 if close else 0
            at = at or len(page)
        elif tag not in _VOID and not m[3].rstrip().endswith("/"):
            now.push(node)
    if at < len(page):
        now.stack[-1].children.append(references.unescape(page[at:]))
    _keep_headings(root)
    _forgive(root)
    return root


def _keep_headings(root: Node) -> None:
    """Of a header within an article the headings stay, and nothing else."""
    stack: list[tuple[Node, bool]] = [(root, False)]
    while stack:
        node, within = stack.pop()
        if node.out and not node.named and not (node.tag == "header" and within):
            continue
        if node.tag == "header" and within:
            node.children, node.out = _headings(node), False
            continue
        within = within or node.tag in ("article", "main")
        stack += [(c, within) for c in node.children if isinstance(c, Node)]


def _headings(header: Node) -> list[Node | str]:
    found, stack = [], header.children[::-1]
    while stack:
        node = stack.pop()
        if isinstance(node, str) or node.out:
            continue
        if node.tag in _HEADINGS or node.tag == "hgroup":
            found.append(node)
        else:
            stack += node.children[::-1]
    return found


def _forgive(root: Node) -> None:
    """Wrappers named after a part, such as "with-sidebar", stay if they hold the article or the heading and most text."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [c for c in node.children if isinstance(c, Node) and (c.named or not c.out)]
    if not any(n.named for n in order):
        return
    chars, holds = {}, {}
    for n in reversed(order):
        inside = [c for c in n.children if isinstance(c, Node) and id(c) in chars]
        chars[id(n)] = sum(len(c) for c in n.children if isinstance(c, str)) + sum(chars[id(c)] for c in inside)
        holds[id(n)] = max([holds[id(c)] for c in inside] + [2 * (n.tag in ("article", "main")) or (n.tag == "h1") * 1])
    for n in order:
        if n.named and not _REMARKS.search(n.about) and (holds[id(n)] == 2 or (holds[id(n)] == 1 and chars[id(n)] > 0.5 * chars[id(root)])):
            n.out = False


def blocks(node: Node) -> Iterator[tuple[Node, str]]:
    """(block, its own text) in page order, without what is out; white space runs are one space, blanks left out."""
    stack: list = [(node, None)]
    parts: list[str] = []
    holder = node

    def flush() -> Iterator[tuple[Node, str]]:
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            yield holder, text

    while stack:
        item, back = stack.pop()
        if back is not None:  # the end of a block
            yield from flush()
            holder = back
        elif isinstance(item, str):
            parts.append(item)
        elif item.tag == "br":
            parts.append(" ")
        elif not item.out or item is node:
            if item.tag in _BLOCK and item is not node:
                yield from flush()
                stack.append((None, holder))
                holder = item
            stack += [(child, None) for child in reversed(item.children)]
    yield from flush()


def _measure(root: Node) -> list[Node]:
    """Fills chars, linked and points below ``root``; returns the nodes with points."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [c for c in node.children if isinstance(c, Node) and not c.out]
    for node in reversed(order):
        node.chars += sum(len(c.strip()) for c in node.children if isinstance(c, str))
        if node.tag == "a":
            node.linked = node.chars
        if node.parent is not None:
            node.parent.chars += node.chars
            node.parent.linked += node.linked
    scored: dict[int, Node] = {}
    for block, text in blocks(root):
        density = block.linked / block.chars if block.chars else 0.0
        if block.tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            continue
        worth = (1 + sum(map(text.count, ",،、，")) + min(3.0, len(text) / 100)) * (1 - density)
        above = block if block.tag not in ("p", "pre", "td", "th", "li", "dd", "dt", "blockquote") else block.parent
        for share in _PASSED_ON:
            if above is None:
                break
            above.points += worth * share
            scored[id(above)] = above
            above = above.parent
    return list(scored.values())


def _density(node: Node) -> float:
    return node.linked / node.chars if node.chars else 0.0


def _standing(node: Node) -> float:
    points = node.points
    if node.tag in ("article", "main"):
        points *= 1.5
    elif node.about and _LIKELY.search(node.about):
        points *= 1.25
    return points * (1 - _density(node))


def _drop_link_lists(node: Node) -> None:
    """Marks lists, tables and boxes that are mostly links, below ``node``: the menus of a page whose text has no container of its own."""
    stack = [node]
    while stack:
        for child in stack.pop().children:
            if isinstance(child, Node) and not child.out:
                if child.tag in ("ul", "ol", "dl", "table", "div", "section") and child.chars and _density(child) > 0.6:
                    child.out = True
                else:
                    stack.append(child)


def _siblings(best: Node) -> list[Node]:
    """The best container among its siblings of like standing or kind, in page order.

    Short ones stay if they are of the best one's tag and class, further articles, paragraphs, or headings before it; what is mostly links goes.
    """
    if best.parent is None:
        return [best]
    kept, after = [], False
    least, whole = max(10.0, 0.2 * _standing(best)), best.tag in ("article", "main")
    for child in best.parent.children:
        if child is best:
            kept.append(child)
            after = True
        elif isinstance(child, Node) and not child.out and child.chars and _density(child) < 0.5:
            alike = child.tag == best.tag and (child.about == best.about if best.about else child.tag in ("article", "section"))
            bonus = 0.2 * _standing(best) if child.about and child.about == best.about else 0.0
            if alike or _standing(child) + bonus >= least or (child.tag == "p" and not whole) or (not after and _is_headline(child)):
                kept.append(child)
    return kept


def _is_headline(node: Node) -> bool:
    """Whether all its text is that of headings."""
    if node.tag in _HEADINGS:
        return True
    inside = sum(c.chars for c in _headings(node) if isinstance(c, Node))
    return bool(node.chars) and inside == node.chars


def _headline(best: Node) -> list[Node]:
    """The nearest headline before the best container's own siblings, where neither the container nor they have a first-rank heading."""
    if best.parent is None or any(c.tag == "h1" for n in _siblings(best) for c in (n, *_headings(n)) if isinstance(c, Node)):
        return []
    node = best.parent
    while node.parent is not None:
        earlier = node.parent.children[: next(k for k, c in enumerate(node.parent.children) if c is node)]
        for child in reversed(earlier):
            if isinstance(child, Node) and not child.out and child.chars and _density(child) < 0.5 and _is_headline(child) and (child.tag == "h1" or any(c.tag == "h1" for c in _headings(child) if isinstance(c, Node))):
                return [child]
        node = node.parent
    return []


def extract(page: str | None) -> str:
    """The main text of a page; empty for null, blank or text-free pages.

    In an article or main element only the parts named in ``_PARTS``, forms, scripts, styles and the like are left out, and of its
    headers all but the headings; lists of links stay, and so does running text that is merely styled like a part. Further articles of the same parent are text too. Time and memory are linear in the page, however it is nested.
    """
    if not page:
        return ""
    root = parse(page)
    scored = _measure(root)
    if not scored:
        return " ".join(text for _, text in blocks(root))
    best = max(scored, key=_standing)
    above = best
    while above is not None and above.tag not in ("article", "main"):
        above = above.parent
    if above is not None:
        best = above
    kept = _headline(best) + _siblings(best)
    if best.tag in ("body", "html"):
        _drop_link_lists(best)
    return " ".join(text for node in kept for _, text in blocks(node))


def main_text() -> Callable[[Column], Column]:
    """Column function: html to main text, never null.

    Each row is extracted by itself: repeated rows repeat, an empty table gives no rows, other columns are not looked at.
    """

    def of(pages: pa.Array) -> pa.Array:
        return pa.array([extract(x.as_py()) for x in pages], type=pa.string())

    return F.arrow_udf(of, "string")
