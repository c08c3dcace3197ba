"""Main text of web pages by tree scoring.

A page is read into a tree of elements.  Parts that are never main text by their
element, role or name (menus, page headers, footers, sidebars, notices, adverts,
forms, comments, scripts, styles) are left out.  Every paragraph, that is, every
run of text that no block element interrupts, earns points for its length and its
commas, discounted by the share of its text that is links; its parent gets them in
full, the parent's parent half of them, and those above less and less.  The
container with the best score, discounted by its own share of links, is kept whole,
or the article or main element around it; so are those of its siblings that look
like more of the same text.  If that leaves nothing, the page is read again without
judging parts by their names, so that a page that calls its article "banner" still
has a text.

The text: character references decoded, white space inside a block turned into one
space, blocks trimmed and joined in page order by a line feed; blocks without text
are left out.  A line break element counts as white space.

Pages are independent: one ``mapInArrow`` pass, no shuffle, one page's tree in a
worker at a time however long the page is.  A null or empty page, and one without
main text, has an empty text and 0 characters; repeated rows give repeated rows; of
containers with equal scores the first counts; an empty table gives an empty one.
Other columns are passed on, but for those named like the two added.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from rentlens.llm.common import carried, sliced

# The elements of HTML by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset
    figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary
    table tbody td tfoot th thead tr ul""".split())
UNREAD = frozenset("script style title textarea noscript iframe noembed noframes xmp template".split())
#: Start tags that end an open element of the second kind, unless one of the third is open within it.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
        "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
        "option": ({"option"}, {"select"})}
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Blocks that are paragraphs themselves; text directly in another block is a paragraph of that block.
PARAGRAPHS = HEADINGS | frozenset("p pre li dt dd td th caption figcaption summary address blockquote".split())
#: Never main text, whatever they hold.
LEFT_OUT = UNREAD | frozenset("head nav footer aside button select input datalist svg canvas object audio video map menu dialog".split())
ROLES = frozenset("navigation banner complementary contentinfo search dialog alertdialog alert menu menubar toolbar form".split())
# Words in class names and ids: names of parts around a text, names of the text itself, and words that only say what a page has.
AROUND = frozenset("""ad ads adbox advert adverts advertisement advertising adsense sponsor sponsored promo promoted promotion
    banner cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe
    subscription signup login paywall comment comments commentlist disqus respond reply replies discussion feedback
    sidebar widget widgets related recommended recommendations teaser share sharing social nav navbar navigation menu
    breadcrumb breadcrumbs pagination pager footer footnav masthead toolbar skip copyright disclaimer search""".split())
TEXTUAL = frozenset("article content main post entry story text body blog page".split())
QUALIFIERS = frozenset("has with without no not enabled disabled open closed on off".split())
#: Points of a container by element.
BONUS = {"article": 30, "main": 25, "section": 3, "div": 5, "td": 3, "blockquote": 3, "pre": 3, "ul": -3, "ol": -3, "dl": -3, "form": -3}
#: Points of a container whose name is one of ``TEXTUAL``.
NAMED = 20
#: A sibling is kept from this share of the points that the best container's paragraphs have earned on.
SIBLING = 0.25
#: Length from which a paragraph beside the best container needs no full stop, and its largest share of links.
LONG, LINKS = 80, 0.25
#: Levels of a tree, as in browsers; what is nested deeper stands on the last level, with all its text.
LEVELS = 512

_TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>""")
_LOOSE = re.compile(r"<(/?)([A-Za-z][^\s/>]*)([^>]*)>")
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_ENDED = (".", "!", "?", "…", "。", "！", "？", ":", ";")


class Element:
    """An element: its children are elements and strings."""

    __slots__ = ("tag", "attrs", "children", "parent", "depth", "earned", "points", "chars", "linked")

    def __init__(self, tag: str, attrs: str, parent: "Element | None"):
        self.tag, self.attrs, self.children, self.parent = tag, attrs, [], parent
        self.depth = parent.depth + 1 if parent else 0
        self.earned, self.points, self.chars, self.linked = 0.0, 0.0, 0, 0

    def attributes(self) -> dict[str, str]:
        return {k.lower(): unescape(a or b or c) for k, a, b, c in _ATTR.findall(self.attrs)} if "=" in self.attrs or self.attrs.strip() else {}

    def up(self) -> Iterator["Element"]:
        at = self.parent
        while at is not None:
            yield at
            at = at.parent


def read(page: str) -> Element:
    """The tree of a page, at most ``LEVELS`` deep; unclosed and crossing elements are closed where the next block or end tag needs it."""
    root = here = Element("", "", None)
    at, end = 0, len(page)
    while at < end:
        start = page.find("<", at)
        if start < 0 or page.find(">", start) < 0:
            here.children.append(unescape(page[at:] if start < 0 or not _starts(page, start) else page[at:start]))
            break
        if start > at:
            here.children.append(unescape(page[at:start]))
        if page.startswith("<!--", start):
            close = page.find("-->", start + 4)
            at = end if close < 0 else close + 3
            continue
        if page[start + 1] in "!?":
            at = page.find(">", start) + 1
            continue
        m = _TAG.match(page, start) or _LOOSE.match(page, start)
        if not m:
            here.children.append("<")
            at = start + 1
            continue
        at, tag = m.end(), m.group(2).lower()
        if m.group(1):
            for e in (here, *here.up()):
                if e.tag == tag and e.parent is not None:
                    here = e.parent
                    break
                if e.tag in ("td", "th", "table") and tag not in BLOCK:
                    break  # an inline end tag closes nothing outside its cell
            continue
        here = _opened(here, tag)
        e = Element(tag, m.group(3), here)
        here.children.append(e)
        if tag in UNREAD:
            close = re.compile(rf"</{re.escape(tag)}(?![A-Za-z0-9])", re.I).search(page, at)
            after = page.find(">", close.end()) if close else -1
            at = after + 1 if after >= 0 else end
        elif tag not in VOID and not (m.group(3).endswith("/") and tag not in BLOCK) and e.depth < LEVELS:
            here = e
    return root


def _starts(page: str, at: int) -> bool:
    """Whether the last "<", with no ">" after it, begins a tag that is cut off."""
    return page[at + 1:at + 2].isalpha() or page[at + 1:at + 2] in ("/", "!", "?")


def _opened(here: Element, tag: str) -> Element:
    """The element in which a start tag opens its own, after those that it ends."""
    if tag in BLOCK:
        for e in (here, *here.up()):  # a block ends an open paragraph with all that is inline in it
            if e.tag == "p":
                here = e.parent
                break
            if e.tag in BLOCK:
                break
    ended, within = ENDS.get(tag, ((), ()))
    if ended:
        for e in (here, *here.up()):
            if e.tag in ended:
                return e.parent
            if e.tag in within:
                break
    return here


def names(e: Element, attrs: dict[str, str]) -> Iterator[list[str]]:
    """The words of each class and of the id."""
    for name in [*attrs.get("class", "").split(), attrs.get("id", "")]:
        words = [w.lower() for w in _WORD.findall(name)]
        if words:
            yield words


def left_out(e: Element, inside: bool, holds_main: set[int], by_name: bool) -> bool:
    """Whether an element (``inside``: of an article) and all in it are no main text."""
    if e.tag in LEFT_OUT:
        return True
    if e.tag in ("", "html", "body", "main"):
        return False
    if e.tag == "header" and not inside or e.tag == "form" and id(e) not in holds_main:
        return True
    attrs = e.attributes()
    if not attrs:
        return False
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", "").lower():
        return True
    if not by_name or id(e) in holds_main:
        return False
    if attrs.get("role", "").lower() in ROLES:
        return True
    for words in names(e, attrs):
        if e.tag == "article" and TEXTUAL.intersection(words):
            continue
        if not QUALIFIERS.intersection(words) and (AROUND.intersection(words) or "header" in words and not inside):
            return True
    return False


def pruned(root: Element, by_name: bool) -> None:
    """Take everything that is left out of the tree."""
    order, holds_main = [root], set()
    for e in order:
        order.extend(c for c in e.children if isinstance(c, Element))
        if e.tag in ("main", "article"):
            for a in e.up():
                if e.tag == "main" or a.tag == "form":
                    holds_main.add(id(a))
    inside = {id(root): False}
    for e in order:
        if id(e) in inside:  # else its parent has left it out
            within = inside[id(e)] or e.tag == "article"
            e.children = [c for c in e.children if isinstance(c, str) or not left_out(c, within, holds_main, by_name)]
            inside.update((id(c), within) for c in e.children if isinstance(c, Element))


def paragraphs(top: Element) -> Iterator[tuple[Element, str, int]]:
    """(block, text, characters in links) of each run of text between block boundaries, in page order."""
    block, words, linked, link = top, [], 0, 0
    stack: list = [top]

    def flush():
        text = " ".join("".join(words).split())
        out = (block, text, min(linked, len(text)))
        words.clear()
        return out

    while stack:
        e = stack.pop()
        if isinstance(e, str):
            words.append(e)
            linked += len(" ".join(e.split())) if link else 0
        elif isinstance(e, tuple):  # the end of an element
            e = e[0]
            link -= e.tag == "a"
            if e.tag in BLOCK or e is top:
                out, linked = flush(), 0
                if out[1]:
                    yield out
                block = next((a for a in e.up() if a.tag in BLOCK or a is top), top)
        else:
            link += e.tag == "a"
            if e.tag in BLOCK or e is top:
                out, linked, block = flush(), 0, e
                if out[1]:
                    yield out
            elif e.tag == "br":
                words.append(" ")
            if e.children or e is top or e.tag in BLOCK:
                stack.append((e,))
                stack.extend(reversed(e.children))
            else:
                link -= e.tag == "a"


def points(text: str, linked: int) -> float:
    commas = sum(text.count(c) for c in ",，、،")
    return (min(len(text) / 25, 1) + commas + min(len(text) / 100, 3)) * (1 - linked / len(text))


def scored(root: Element) -> list[Element]:
    """Containers with their points, in page order of their first paragraph."""
    found: dict[int, Element] = {}
    for block, text, linked in paragraphs(root):
        first = block.parent if block.tag in PARAGRAPHS and block.parent is not None else block
        earned = points(text, linked)
        for depth, a in enumerate((first, *first.up())):
            a.earned += earned / (1, 2)[depth] if depth < 2 else earned / (3 * depth)
            found.setdefault(id(a), a)
        for a in (block, *block.up()):
            a.chars += len(text)
            a.linked += linked
    for e in found.values():
        e.points = e.earned + BONUS.get(e.tag, 0)
        if any(TEXTUAL.intersection(words) for words in names(e, e.attributes())):
            e.points += NAMED
        e.points *= 1 - e.linked / max(e.chars, 1)
    return list(found.values())


def more(e: Element, best: Element, chosen: set[int]) -> bool:
    """Whether a sibling of the best container belongs to the text."""
    density = e.linked / max(e.chars, 1)
    if id(e) in chosen and e.earned * (1 - density) >= SIBLING * best.earned:
        return True
    if best.tag in ("article", "main"):
        return e.tag == "h1" and density == 0
    if e.tag in HEADINGS or e.tag in ("ul", "ol", "dl", "pre", "blockquote", "table", "figure"):
        return e.chars > 0 and density < LINKS
    text = "\n".join(t for _, t, _ in paragraphs(e))
    return e.tag == "p" and density < LINKS and (len(text) >= LONG or text.endswith(_ENDED) and density == 0)


def main_text(page: str | None) -> str:
    """The main text of one page."""
    if not page:
        return ""
    for by_name in (True, False):
        root = read(page)
        pruned(root, by_name)
        containers = scored(root)
        if not containers:
            continue
        best = max(containers, key=lambda e: e.points)  # the first of equals
        for tag in ("main", "article"):
            around = [a for a in (best, *best.up()) if a.tag == tag]
            if around:
                best = around[-1]
        if best.parent is None or best.tag in ("html", "body", "article", "main") and best.parent.tag in ("", "html"):
            kept: list[Element] = [best]
        else:
            chosen = {id(e) for e in containers}
            kept = [c for c in best.parent.children if isinstance(c, Element) and (c is best or more(c, best, chosen))]
        text = "\n".join(t for e in kept for _, t, _ in paragraphs(e))
        if text:
            return text
    return ""


def html_main_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """The rows of ``pages`` with ``text`` and ``n_chars`` (its code points) instead of the page."""
    others = [c for c in carried(pages, ["text", "n_chars"]) if c.lower() != html.lower()]
    rows = pages.select(html, *others)
    schema = T.StructType([*rows.schema.fields[1:], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in sliced(batch, text=batch.schema.names[0]):
                texts = [main_text(page) for page in some.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*some.columns[1:], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=[*some.schema.names[1:], "text", "n_chars"])

    return rows.mapInArrow(run, schema)
