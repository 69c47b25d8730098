"""One pass over a page's HTML: open elements, role of every token, text blocks.

A token is a tag or a run of text between tags; its role is a 64-bit hash of the open elements' names and classes and of the
tag or the text (digits masked), so that equal tags in different places are different tokens.
"""

from __future__ import annotations

import html
import re

import xxhash

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>""", re.S)
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_DIGITS = re.compile(r"\d+")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template svg math".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
                  "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table "
                  "tbody td tfoot th thead tr ul".split())
# a start tag that ends an open element of these names, up to the given ones
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "datalist"}),
         "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
         "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"}),
         "body": ({"head"}, {"html"})}
_SCOPE = frozenset({"table", "td", "th", "caption", "button", "html"})
CONTAINER = frozenset("html body div section article main td table tbody tr center form".split())

# elements and landmark roles beside an article's text, and words in class and id that mark such a part
BESIDE = frozenset("head nav footer aside menu dialog button select option fieldset label search noscript audio video canvas object map datalist".split())
BESIDE_ROLE = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar status".split())
BESIDE_WORD = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promoted promotion banner sidebar nav navbar navigation menu "
                        "breadcrumb breadcrumbs masthead footer cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription "
                        "signup login share sharing social related recommended recommendations comment comments disqus replies respond pagination pager "
                        "toolbar widget teaser hidden".split())
OF_ARTICLE = frozenset({"article", "post", "entry", "content", "story"})
MAIN = frozenset({"article", "main"})

NONE, BY_WORD, BY_NAME = 0, 1, 2


class Element:
    __slots__ = ("name", "parent", "path", "beside", "block", "main", "chars")

    def __init__(self, name, parent, path, beside):
        self.name, self.parent, self.path, self.beside = name, parent, path, beside
        self.block, self.chars = name in BLOCK, 0
        self.main = name in MAIN or (parent is not None and parent.main)

    def out(self) -> bool:
        """Whether the element or one around it stands beside the article."""
        e = self
        while e is not None:
            if e.beside:
                return True
            e = e.parent
        return False


class Scanner:
    """Scans pages; keeps the roles of (path, tag) pairs seen, emptied at a fixed number."""

    LIMIT = 200_000

    def __init__(self):
        self.paths: dict = {}

    def _open(self, parent: Element | None, name: str, attrs: str) -> Element:
        key = (parent.path if parent else 0, parent is not None and parent.main, name, attrs)
        got = self.paths.get(key)
        if got is None:
            if len(self.paths) > self.LIMIT:
                self.paths.clear()
            got = self.paths[key] = self._kind(*key)
        e = Element(name, parent, *got)
        if "role" in attrs and not e.main and re.search(r"""role\s*=\s*["']?main\b""", attrs):
            e.main = True
        return e

    @staticmethod
    def _kind(path: int, in_main: bool, name: str, attrs: str) -> tuple[int, int]:
        values = {}
        for m in _ATTR.finditer(attrs) if attrs else ():
            values.setdefault(m.group(1).lower(), next((x for x in m.groups()[1:] if x is not None), ""))
        mark = " ".join(sorted(values.get("class", "").split())) + "#" + values.get("id", "")
        role = values.get("role", "").lower()
        beside = NONE
        if name in BESIDE or role in BESIDE_ROLE or "hidden" in values or values.get("aria-hidden") == "true" or _HIDDEN.search(values.get("style", "")):
            beside = BY_NAME
        elif name == "header" and not in_main:
            beside = BY_NAME
        elif name == "form":
            beside = BY_WORD
        elif name not in ("html", "body", "main", "article") or mark != "#" and name == "article":
            words = {w.lower() for w in _WORDS.findall(mark)}
            if words & BESIDE_WORD or "header" in words and not in_main and not words & OF_ARTICLE:
                beside = BY_WORD
        return xxhash.xxh64_intdigest(f"{path}<{name} {_DIGITS.sub('#', mark)}"), beside

    def scan(self, page: str):
        """(roles, blocks, elements): roles is [(role, element or None, text chars)] in page order, an element at its start tag;
        blocks is [(block element, [(element, text, role)])], text decoded but not yet trimmed."""
        roles, blocks, elements = [], [], []
        stack: list[Element] = []
        pieces: list = []
        at, n, first_main = 0, len(page), True

        def flush():
            nonlocal pieces
            if pieces:
                blocks.append((next((e for e in reversed(stack) if e.block), None), pieces))
                pieces = []

        def text(raw: str):
            if not raw:
                return
            value = html.unescape(raw) if "&" in raw else raw
            inner = stack[-1] if stack else None
            bare = " ".join(value.split())
            role = 0
            if bare:
                role = xxhash.xxh64_intdigest(f"{inner.path if inner else 0}|{_DIGITS.sub('#', bare)}")
                roles.append((role, None, len(bare)))
            pieces.append((inner, value, role))

        def pop_to(depth: int):
            for e in reversed(stack[depth:]):
                if e.block:
                    flush()
                stack.pop()
                roles.append((e.path ^ 0x5555555555555555, None, 0))

        while True:
            m = _TAG.search(page, at)
            text(page[at:m.start() if m else n])
            if not m:
                break
            at = m.end()
            name = m.group(2) or m.group(5)
            if name is None:
                continue
            name = name.lower()
            if m.group(1) or m.group(4):  # an end tag
                depth = len(stack) - 1
                inline = name not in BLOCK
                while depth >= 0 and stack[depth].name != name and not (inline and stack[depth].block):
                    depth -= 1
                if depth >= 0 and stack[depth].name == name:
                    pop_to(depth)
                elif name == "p":  # stands for an empty paragraph
                    flush()
                elif name == "br":
                    pieces.append((stack[-1] if stack else None, " ", 0))
                continue
            attrs = m.group(3) or m.group(6) or ""
            if name == "br":
                pieces.append((stack[-1] if stack else None, " ", 0))
            block = name in BLOCK
            if block:
                flush()
                for depth in range(len(stack) - 1, -1, -1):  # a block ends an open paragraph
                    if stack[depth].name == "p":
                        pop_to(depth)
                        break
                    if stack[depth].name in _SCOPE:
                        break
            if name in _ENDS:
                ends, within = _ENDS[name]
                low = None
                for depth in range(len(stack) - 1, -1, -1):
                    if stack[depth].name in within:
                        break
                    if stack[depth].name in ends:
                        low = depth
                if low is not None:
                    pop_to(low)
            e = self._open(stack[-1] if stack else None, name, attrs)
            if first_main and name in MAIN and not e.beside:
                first_main = False
                for up in stack:  # what holds the article isn't beside it, whatever its class says
                    if up.beside == BY_WORD:
                        up.beside = NONE
            roles.append((e.path, e, 0))
            elements.append(e)
            if name in VOID or attrs.endswith("/") and name not in BLOCK and name not in RAW:
                continue
            if name in RAW:
                end = self._end_of(page, at, name)
                at = end
                roles.append((e.path ^ 0x5555555555555555, None, 0))
                continue
            stack.append(e)
        pop_to(0)
        flush()
        return roles, blocks, elements

    _CLOSE: dict = {}

    @classmethod
    def _end_of(cls, page: str, at: int, name: str) -> int:
        """Behind the end tag of an element whose content isn't text of the page."""
        close = cls._CLOSE.get(name)
        if close is None:
            close = cls._CLOSE[name] = re.compile(rf"</{name}\b[^>]*>", re.I)
        m = close.search(page, at)
        if m:
            return m.end()
        return at if name in ("svg", "math", "template", "noscript", "title") else len(page)


def block_text(pieces) -> str:
    return " ".join("".join(x[1] for x in pieces).split())
