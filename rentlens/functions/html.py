"""Per-document HTML helpers for the extraction operators.

``events`` splits a document into start tags, end tags and text in one scan;
``parse_html`` builds a light element tree from it, and ``ListingReader`` fills the
fields of listing containers without a tree.  Find-all / find-first by tag and
class behave like the usual soup API: a one-token class matches any token of the
attribute, several tokens must equal the whole attribute up to white space,
``text`` joins all descendant text, character references are decoded, comments
are skipped, and an end tag closes the nearest open element of that name
(unclosed tags are tolerated).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TEXT = frozenset(("script", "style"))

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']+|"[^"]*"|'[^']*')*+)>|[^<]+|<""", re.S)
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")


def attributes(text: str) -> dict[str, str]:
    """Attributes of a start tag; the first of a repeated name counts last, as parsers that build a dict do."""
    out = {}
    for name, a, b, c in _ATTR.findall(text):
        out[name.lower()] = unescape(a or b or c)
    return out


def events(doc: str | None) -> Iterator[tuple[str, str, str]]:
    """('start', tag, attribute text), ('end', tag, '') and ('text', '', text), in document order."""
    at, doc = 0, doc or ""
    while at < len(doc):
        raw = None
        for m in _TOKEN.finditer(doc, at):  # some alternative matches anywhere
            slash, tag, text = m.groups()
            if not tag:
                whole = m.group()
                if whole[:2] not in ("<!", "<?"):
                    yield "text", "", unescape(whole)
            elif slash:
                yield "end", tag.lower(), ""
            else:
                tag = tag.lower()
                yield "start", tag, text
                if tag in RAW_TEXT:
                    raw, at = tag, m.end()
                    break
        if raw is None:
            return
        # up to the end tag, nothing is markup
        m = re.compile(rf"</{raw}\b", re.I).search(doc, at)
        end = m.start() if m else len(doc)
        if end > at:
            yield "text", "", doc[at:end]
        at = end


def class_matches(have: str | None, cls: str | None) -> bool:
    if cls is None:
        return True
    if have is None:
        return False
    tokens, want = have.split(), cls.split()
    return tokens == want if len(want) > 1 else cls.strip() in tokens


@lru_cache(maxsize=4096)
def _short_matches(text: str, cls: str) -> bool:
    return class_matches(attributes(text).get("class"), cls)


def tag_matches(text: str, cls: str | None) -> bool:
    """Whether a start tag with the attribute text ``text`` has the class; short texts, which repeat, are remembered."""
    return cls is None or (_short_matches(text, cls) if len(text) <= 200 else class_matches(attributes(text).get("class"), cls))


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str | None, attrs: dict, parent: "Node | None"):
        self.tag, self.attrs, self.children, self.parent = tag, attrs, [], parent

    def iter(self):
        """Descendant elements in document order."""
        stack = list(reversed([c for c in self.children if isinstance(c, Node)]))
        while stack:
            n = stack.pop()
            yield n
            stack.extend(reversed([c for c in n.children if isinstance(c, Node)]))

    @property
    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                out.append(n)
            else:
                stack.extend(reversed(n.children))
        return "".join(out)

    def matches(self, tag: str | None, cls: str | None) -> bool:
        return (tag is None or self.tag == tag) and class_matches(self.attrs.get("class"), cls)

    def find_all(self, tag: str | None = None, cls: str | None = None) -> list["Node"]:
        return [n for n in self.iter() if n.matches(tag, cls)]

    def find(self, tag: str | None = None, cls: str | None = None) -> "Node | None":
        return next((n for n in self.iter() if n.matches(tag, cls)), None)

    def elements(self) -> list["Node"]:
        return [c for c in self.children if isinstance(c, Node)]


def parse_html(doc: str | None) -> Node:
    cur = root = Node(None, {}, None)
    for kind, tag, text in events(doc):
        if kind == "text":
            cur.children.append(text)
        elif kind == "start":
            n = Node(tag, attributes(text), cur)
            cur.children.append(n)
            if tag not in VOID and not text.rstrip().endswith("/"):
                cur = n
        else:
            n = cur
            while n is not None and n.tag != tag:
                n = n.parent
            if n is not None and n.parent is not None:
                cur = n.parent
    return root


def path_text(node: Node | None, path: list[tuple[str, str | None]]) -> str | None:
    """Text of the element reached by successive first matches, or None."""
    for tag, cls in path:
        if node is None:
            return None
        node = node.find(tag, cls)
    return None if node is None else node.text


class _Field:
    """Progress of one selector path inside one container: the steps reached, and the text once at the end."""

    __slots__ = ("path", "step", "depth", "text", "waits")

    def __init__(self, path: list[tuple[str, str | None]]):
        self.path, self.step, self.depth, self.text = path, 0, 0, None
        self.waits = False  # for a sibling of the element that closed, under the parent at ``depth``


class Container:
    """One open container: its depth and what its selectors found so far."""

    __slots__ = ("depth", "attrs", "fields", "wanted", "begun", "open")

    def __init__(self, depth: int, attrs: dict[str, str], paths: dict[str, list[tuple[str, str | None]]]):
        self.depth, self.attrs = depth, attrs
        self.fields = {k: _Field(p) for k, p in paths.items()}
        self.wanted: dict[str, list[_Field]] = {}  # by the tag of the next step
        self.begun: list[_Field] = []  # some step is found and still open, or its parent is
        self.open: list[_Field] = []  # all steps are
        for f in self.fields.values():
            self.want(f)

    def want(self, f: _Field) -> None:
        self.wanted.setdefault(f.path[f.step][0].lstrip("+"), []).append(f)

    def start(self, tag: str, text: str, depth: int) -> None:
        """An element of the tag, with the attribute text ``text``, begins."""
        for f in list(self.wanted.get(tag, ())):
            step, cls = f.path[f.step]
            if (step != tag and not (f.waits and f.depth == depth - 1)) or not tag_matches(text, cls):
                continue
            self.wanted[tag].remove(f)
            if not f.step:
                self.begun.append(f)
            f.step, f.depth, f.waits = f.step + 1, depth, False
            if f.step == len(f.path):
                f.text = []
                self.open.append(f)
            else:
                self.want(f)

    def close(self, depth: int) -> None:
        """Elements at ``depth`` and deeper end."""
        for f in [f for f in self.begun if f.depth >= depth]:
            if f.step == len(f.path):
                self.open.remove(f)
                self.begun.remove(f)
            elif f.depth == depth and not f.waits and f.path[f.step][0][0] == "+":
                f.depth, f.waits = depth - 1, True
            else:
                self.begun.remove(f)
                self.wanted[f.path[f.step][0].lstrip("+")].remove(f)


def read_containers(doc: str | None, container: tuple[str, str], paths: dict[str, list[tuple[str, str | None]]],
                    page: dict[str, list[tuple[str, str | None]]] | None = None) -> tuple[list[Container], dict[str, str | None]]:
    """Every container of a document with the text of the first match of each selector path, in one scan.

    A path's step is the first match inside the step before it, or, written ``+tag``,
    the first such element after it under the same parent; a step whose element
    (or its parent) closes before the next is found makes the field null, as
    successive first matches do.  ``page`` are paths from the document's root.  No tree is kept: only the
    open elements' tags and the open containers.
    """
    open_tags: list[str] = []
    found: list[Container] = []
    whole = Container(-1, {}, page or {})
    active: list[Container] = [whole]

    def close(depth: int) -> None:
        """Elements at ``depth`` and deeper end."""
        for c in active:
            if c.begun:
                c.close(depth)
        while len(active) > 1 and active[-1].depth >= depth:
            active.pop()

    for kind, tag, text in events(doc):
        if kind == "text":
            for c in active:
                for f in c.open:
                    f.text.append(text)
        elif kind == "end":
            for at in range(len(open_tags) - 1, -1, -1):
                if open_tags[at] == tag:
                    close(at)
                    del open_tags[at:]
                    break
        else:
            depth = len(open_tags)
            leaf = tag in VOID or text.rstrip().endswith("/")
            for c in active:
                if c.wanted.get(tag):
                    c.start(tag, text, depth)
            if tag == container[0] and not leaf and tag_matches(text, container[1]):
                found.append(Container(depth, attributes(text), paths))
                active.append(found[-1])
            if leaf:
                close(depth)
            else:
                open_tags.append(tag)
    return found, {k: None if f.text is None else "".join(f.text) for k, f in whole.fields.items()}


def field_texts(c: Container) -> dict[str, str | None]:
    return {k: None if f.text is None else "".join(f.text) for k, f in c.fields.items()}
