"""One pass over an event or listing page (SRC-16 to SRC-19): what its parsers and table functions read.

Its tags are met in order; an open capture is where its text begins, and is cut out of the page when its element ends. Time is linear in the page, whatever it
holds: a tag without an end is text, an element without an end lasts until the next of its kind or the end of its table row.

A table row whose cells are all written out (``_WRITTEN_OUT``) is taken cell by cell instead of tag by tag, with the same result; short cells, which pages repeat,
are remembered. Text is made plain when it is asked for.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field
from functools import cached_property

_TAG = re.compile("<([^<>]*+)>")
#: A paragraph without markup, or a tag.
_STEP = re.compile("<(?:p>([^<>]*+)</p>|([^<>]*+)>)")
_DIGITS = re.compile(r"\d+")
_ATTRIBUTE = re.compile(r"""([^\s=/"'<>]++)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"']++))""")


def plain(text: str) -> str:
    """A piece of a page as text: each start tag is a space, other tags are nothing."""
    if "<" in text:
        first, *others = text.split("<")
        out = [first]
        for own in others:
            tag, closed, rest = own.partition(">")
            out += (" " if tag[:1].isalpha() else "", rest) if closed else ("<", own)
        text = "".join(out)
    if "&" in text:
        text = text.replace("&amp;", "&") if text.count("&") == text.count("&amp;") else html.unescape(text)
    return " ".join(text.split())


@dataclass
class Link:
    href: str
    #: what of the page lies in it
    inner: str = ""
    #: the text of the first dated span after it, before the next link of its kind
    dated: str | None = None

    @cached_property
    def text(self) -> str:
        return plain(self.inner)


@dataclass
class Cell:
    """Rows may share a cell; nothing changes it once its row is read."""

    #: what of the page lies in its paragraphs, and in it
    paragraphs: list[str] = field(default_factory=list)
    inner: str = ""

    @cached_property
    def text(self) -> str:
        return plain(self.inner)

    @cached_property
    def parts(self) -> list[str]:
        """Its paragraphs that have text, else all its text."""
        return [t for p in self.paragraphs if (t := plain(p))] or [self.text]

    @cached_property
    def numbers(self) -> list[int | None]:
        """The first number of each part."""
        return [int(m[0]) if (m := _DIGITS.search(p)) else None for p in self.parts]


@dataclass(slots=True)
class Row:
    link: str
    cells: list[Cell] = field(default_factory=list)
    sides: list[Link] = field(default_factory=list)
    flag: str | None = None


@dataclass
class Scan:
    """Title, list items by label, rows that link to bouts, and links to events."""

    title: str | None = None
    items: dict[str, str] = field(default_factory=dict)
    rows: list[Row] = field(default_factory=list)
    events: list[Link] = field(default_factory=list)


def attributes(text: str) -> dict[str, str]:
    """Values by name in lower case; of a name that is written again, the first."""
    return {name.lower(): a or b or c for name, a, b, c in reversed(_ATTRIBUTE.findall(text))}


#: Labels of the list items that are kept.
LABELS = ("Date", "Location")


class _Scanner:
    def __init__(self, page: str) -> None:
        self.page = page
        self.at = self.after = 0  # begin and end of the tag that was met
        self.scan = Scan()
        self.open: dict[str, int] = {}  # begins of the captures under way, by what they are
        self.row: Row | None = None
        self.link: Link | None = None
        self.next_end = -1  # where the next end tag of a row begins that was found

    def row_end(self, begin: int) -> int | None:
        """Where a row's end tag begins, if no other row begins before it; each part of the page is searched once."""
        if self.next_end < begin:
            found = self.page.find("</tr>", begin)
            self.next_end = found if found >= 0 else len(self.page)
        return self.next_end if self.next_end < len(self.page) and self.page.find("<tr", begin, self.next_end) < 0 else None

    def rows(self, tag: str, begin: int) -> int | None:
        """Takes the row whose start tag ends at ``begin``, and those right after it, that are written out; where they end, None if there is none."""
        page, at = self.page, None
        while (end := self.row_end(begin)) is not None and (row := _row(tag, page[begin:end])):
            self.scan.rows.append(row)
            at = end + len("</tr>")
            if not page.startswith("<tr ", at):
                break
            if not (m := _TAG.match(page, at)):
                break
            tag, begin = m[1], m.end()
        return at

    def taken(self, what: str) -> str:
        return self.page[self.open.pop(what) : self.at]

    def start(self, tag: str, rest: str) -> None:
        if tag in ("table", "ul", "div"):
            self.end("li")
        if tag == "tr":
            self.end("tr")
            own = attributes(rest)
            if "data-link" in own:
                self.row = Row(own["data-link"])
        elif tag == "td" and self.row is not None:
            self.end("td")
            self.row.cells.append(Cell())
            self.open["td"] = self.after
        elif tag == "p" and "td" in self.open:
            self.end("p")
            self.open["p"] = self.after
        elif tag == "a":
            self.end("a")
            href = attributes(rest).get("href", "")
            if "event-details/" in href or "fighter-details/" in href:
                self.link, self.open["a"] = Link(href.strip()), self.after
        elif tag == "li":
            self.end("li")
            self.open["li"] = self.after
        if not rest:
            return
        if "b-content__title-highlight" in rest and self.scan.title is None:
            self.open["title"] = self.after
        elif "b-flag__text" in rest and self.row is not None and self.row.flag is None:
            self.open["flag"] = self.after
        elif tag == "span" and "date" in rest and self.scan.events and self.scan.events[-1].dated is None and "a" not in self.open:
            self.open["date"] = self.after

    def end(self, tag: str) -> None:
        if not self.open and self.row is None:
            return
        # the first end tag after it, whatever it ends
        if "title" in self.open:
            self.scan.title = plain(self.taken("title"))
        if "flag" in self.open:
            text = plain(self.taken("flag"))
            if self.row is not None:
                self.row.flag = text
        if tag == "span" and "date" in self.open:
            self.scan.events[-1].dated = plain(self.taken("date"))
        elif tag == "a" and "a" in self.open:
            self.link.inner = self.taken("a")
            if "event-details/" in self.link.href:
                self.open.pop("date", None)
                self.scan.events.append(self.link)
            elif self.row is not None:
                self.row.sides.append(self.link)
        elif tag == "p" and "p" in self.open:
            self.row.cells[-1].paragraphs.append(self.taken("p"))
        elif tag == "td" and "td" in self.open:
            self.end("p")
            self.row.cells[-1].inner = self.taken("td")
        elif tag in ("li", "ul", "ol") and "li" in self.open:
            label, colon, value = plain(self.taken("li")).partition(":")
            for name in LABELS:
                if colon and label.endswith(name):
                    self.scan.items.setdefault(name, value.strip())
        elif tag in ("tr", "tbody", "table") and self.row is not None:
            self.end("a")
            self.end("td")
            self.scan.rows.append(self.row)
            self.row = None


#: Tags that begin no capture and end none but a title's or a flag's, as they are mostly written.
_IDLE = frozenset(("b", "i", "br", "h2", "h3", "th", "thead", "strong", "em"))
_IDLE_ENDS = frozenset(f"/{n}" for n in _IDLE)
_TEXT = "[^<>]*+"
_IDLE_TAG = f"</?(?:{'|'.join(sorted(_IDLE, key=len, reverse=True))})>"
_FLAG = f'<i class="b-flag__text">({_TEXT})</i>'
#: What a cell holds besides text: idle tags, a flag, and links that hold text and idle tags.
_ITEM = f"(?:{_IDLE_TAG}|{_FLAG.replace('(', '').replace(')', '')}|<a\\s{_TEXT}>{_TEXT}(?:{_IDLE_TAG}{_TEXT})*+</a>)"
#: A cell up to its end tag: text, items, and paragraphs of text and items.
_WRITTEN_OUT = re.compile(f"\\s*+<td>({_TEXT}(?:(?:{_ITEM}|<p>{_TEXT}(?:{_ITEM}{_TEXT})*+</p>){_TEXT})*+)")
_FIRST_FLAG = re.compile(_FLAG)
#: Cells up to this length are remembered, so many of them.
_SHORT, _REMEMBERED = 200, 4096


#: An attribute after others that are written in lower case and double quotes.
_HREF, _DATA_LINK = (f' (?:(?!{name}=)[a-z-]++="[^"<>]*+" )*+{name}="([^"<>]*+)"' for name in ("href", "data-link"))
_DATA_LINK = re.compile(_DATA_LINK)
#: A link so written, and two of them in paragraphs of their own.
_PLAIN_LINK = f"<a({_HREF}{_TEXT})>({_TEXT}(?:{_IDLE_TAG}{_TEXT})*+)</a>"
_HREF = re.compile(_HREF)
_PAIR = re.compile(f"<td>(<p>{_PLAIN_LINK}</p>\\s*+<p>{_PLAIN_LINK}</p>)")


def _marks(rest: str) -> bool:
    """Whether attributes begin a capture, whatever tag has them."""
    return "b-content__title-highlight" in rest or "b-flag__text" in rest


#: A cell, its links to competitors and its flag.
_Read = tuple[Cell, list[Link], str | None]


def _cell(piece: str) -> _Read | None:
    """What stands before a cell's end tag; None unless it is written out."""
    if m := _PAIR.fullmatch(piece):
        inner, rest, href, text, other_rest, other_href, other_text = m.groups()
        found = [(rest, href, text), (other_rest, other_href, other_text)]
        paragraphs = inner[3:-4].split("</p>", 1)
        paragraphs[1] = paragraphs[1].split("<p>", 1)[1]
    elif m := _WRITTEN_OUT.fullmatch(piece):
        inner = m[1]
        found = []
        for own in inner.split("<a")[1:]:
            rest, _, text = own.partition(">")
            found.append((rest, m[1] if (m := _HREF.match(rest)) else attributes(rest).get("href", ""), text.partition("</a>")[0]))
        paragraphs = [p.partition("</p>")[0] for p in inner.split("<p>")[1:]]
    else:
        return None
    links = []
    for rest, href, text in found:
        if "event-details/" in href or _marks(rest):
            return None
        if "fighter-details/" in href:
            links.append(Link(href.strip(), text))
    flag = plain(own[1]) if "<i c" in inner and (own := _FIRST_FLAG.search(inner)) else None
    return Cell(paragraphs, inner), links, flag


_seen: dict[str, _Read] = {}


def _row(tag: str, inner: str) -> Row | None:
    """The row of a start tag and what stands before its end tag; None unless it has a link and its cells are written out."""
    link = m[1] if (m := _DATA_LINK.match(tag, 2)) else attributes(tag[2:]).get("data-link")
    if link is None or _marks(tag):
        return None
    *pieces, last = inner.split("</td>")
    if last and not last.isspace():
        return None
    read = [*map(_seen.get, pieces)]
    if None in read:
        for k, piece in enumerate(pieces):
            if read[k] is None:
                if (got := _cell(piece)) is None:
                    return None
                read[k] = got
                if len(piece) <= _SHORT and not got[1]:  # links are seldom the same, and rows share no link
                    if len(_seen) >= _REMEMBERED:
                        _seen.clear()
                    _seen[piece] = got
    row = Row(link, [cell for cell, _, _ in read])
    for _, links, flag in read:
        if links:
            row.sides += links
        if flag is not None and row.flag is None:
            row.flag = flag
    return row


def scan(page: str | None) -> Scan:
    """What a page holds; nothing for null."""
    page = page or ""
    s = _Scanner(page)
    begin: int | None = 0
    while begin is not None:
        begin = _steps(s, begin)
    s.at = len(page)
    for tag in ("a", "li", "span", "table"):
        s.end(tag)
    return s.scan


def _steps(s: _Scanner, begin: int) -> int | None:
    """Meets the tags from ``begin`` on, up to a row that is taken as a whole; where that ends."""
    page, open_ = s.page, s.open
    for m in _STEP.finditer(page, begin):
        own, tag = m.groups()
        marked = "flag" in open_ or "title" in open_
        # what most of a page is made of, without a call
        if own is not None:
            if marked or "td" not in open_ or "p" in open_:
                s.at, s.after = m.start(), m.start(1)
                s.start("p", "")
                s.at, s.after = m.end(1), m.end()
                s.end("p")
            else:
                s.row.cells[-1].paragraphs.append(own)
            continue
        if tag in _IDLE or (not marked and tag in _IDLE_ENDS):
            continue
        if not open_ and s.row is None and tag.startswith("tr ") and (end := s.rows(tag, m.end())) is not None:
            return end
        if not marked and s.row is not None and "p" not in open_:
            if tag == "td" and "td" not in open_:
                s.row.cells.append(Cell())
                open_["td"] = m.end()
                continue
            if tag == "/td" and "td" in open_:
                s.row.cells[-1].inner = page[open_.pop("td") : m.start()]
                continue
        ends = tag.startswith("/")
        if ends and not open_ and s.row is None:
            continue
        name = tag[1:] if ends else tag
        if not name[:1].isalpha():
            continue
        word = name.split(None, 1)[0].rstrip("/").lower()
        s.at, s.after = m.span()
        s.end(word) if ends else s.start(word, tag[len(word) :])
    return None
