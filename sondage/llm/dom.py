"""Block trees of HTML pages: a tolerant reader of tags, and what a block's place says about it."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape

_OPEN = re.compile(r"<([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|(?![\"'])))*+)>")
_LOOSE = re.compile(r"<([a-zA-Z][^\s/>]*+)([^>]*+)>")
_CLOSE = re.compile(r"</([a-zA-Z][^\s/>]*+)[^>]*+>")
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?+")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

# Fixed values of HTML: elements by how they are laid out, closed and read.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li listing main menu nav ol optgroup option p "
    "pre search section select summary table tbody td template tfoot th thead title tr ul".split())
ENDS_P = BLOCKS - frozenset("body button caption head html legend option optgroup select tbody td template tfoot th thead title tr".split())
SCOPE = frozenset("table td th caption template object html".split())
TABLE = frozenset("table caption tbody thead tfoot tr td th".split())
# An element ends open ones of these kinds, looked for up to the elements that hold such kinds.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "optgroup"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}), "body": ({"head"}, {"html"}),
}
# Elements, roles and words of class and id that mark what is not the article.
NEVER = frozenset("head title script style noscript template svg math button select textarea iframe object canvas audio video "
                  "nav aside menu dialog search".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar".split())
BOILER = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promotion banner breadcrumb breadcrumbs "
    "comment comments disqus reply replies respond cookie cookies consent gdpr notice notices popup modal overlay footer nav "
    "navbar navigation menu menus topbar newsletter subscribe subscription signup login pagination pager share sharing social "
    "related recommended recommendations sidebar sidebars toolbar masthead".split())
MAIN = frozenset(("article", "main"))
DEEPEST = 200  # levels that alignment tells apart; what lies deeper hangs there


@dataclass
class Block:
    """A run of inline text: its element and the pieces, each with the innermost element that holds it."""

    node: int
    pieces: list[tuple[int, str, bool]] = field(default_factory=list)

    def text(self, dropped: list[bool]) -> str:
        return " ".join("".join(t for n, t, _ in self.pieces if not dropped[n]).split())


class Page:
    """Elements in order, their parents, and the text blocks."""

    def __init__(self, html: str):
        self.tags: list[str] = ["#page"]
        self.parents: list[int] = [-1]
        self.attributes: list[str] = [""]
        self.blocks: list[Block] = []
        self.title = ""
        self._stack = [0]
        self._links = 0
        self._block: Block | None = None
        self._read(html)
        self._judge()

    # reading

    def _text(self, text: str) -> None:
        if "&" in text:
            text = unescape(text)
        if self._block is None:
            if not text or text.isspace():
                return
            holder = next(n for n in reversed(self._stack) if not n or self.tags[n] in BLOCKS)
            self._block = Block(holder)
            self.blocks.append(self._block)
        self._block.pieces.append((self._stack[-1], text, self._links > 0))

    def _pop_to(self, place: int) -> None:
        for node in self._stack[place:]:
            tag = self.tags[node]
            if tag == "a":
                self._links -= 1
            elif tag in BLOCKS:
                self._block = None
        del self._stack[place:]

    def _pop(self, kinds: set[str] | frozenset[str], until: set[str] | frozenset[str]) -> None:
        """Closes the innermost open element of these kinds, unless one of ``until`` comes first."""
        for place in range(len(self._stack) - 1, 0, -1):
            tag = self.tags[self._stack[place]]
            if tag in kinds:
                self._pop_to(place)
                return
            if tag in until:
                return

    def _start(self, tag: str, attributes: str) -> None:
        if tag == "br":
            if self._block is not None:
                self._block.pieces.append((self._stack[-1], " ", False))
            return
        if tag == "a":
            self._pop({"a"}, BLOCKS)
        if tag in BLOCKS:
            self._block = None
            if tag in ENDS_P:
                self._pop({"p"}, SCOPE | {"button"})
            if tag in IMPLIED:
                kinds, until = IMPLIED[tag]
                for _ in range(3 if tag in ("tr", "tbody", "thead", "tfoot") else 1):
                    self._pop(kinds, until | {"table"} if tag[0] == "t" else until)
        if tag in VOID:
            return
        self.tags.append(tag)
        self.parents.append(self._stack[-1])
        self.attributes.append(attributes)
        self._stack.append(len(self.tags) - 1)
        if tag == "a":
            self._links += 1

    def _end(self, tag: str) -> None:
        if tag in ("body", "html") or tag in VOID:
            if tag == "br":
                self._start("br", "")
            return
        if tag in BLOCKS:
            self._block = None
            if tag[0] == "h" and tag[1:].isdigit():
                self._pop({f"h{n}" for n in range(1, 7)}, SCOPE)
            else:
                until = {"ul", "ol", "table"} if tag == "li" else {"table"} if tag in TABLE else SCOPE
                self._pop({tag}, until - {tag})
        else:
            self._pop({tag}, BLOCKS)

    def _read(self, html: str) -> None:
        at, size = 0, len(html)
        while at < size:
            sign = html.find("<", at)
            if sign < 0:
                self._text(html[at:])
                return
            if sign > at:
                self._text(html[at:sign])
            after = html[sign + 1:sign + 2]
            if after.isalpha() and after.isascii():
                found = _OPEN.match(html, sign) or _LOOSE.match(html, sign)
                if found is None:
                    return  # the page ends inside a tag
                tag, attributes = found[1].lower(), found[2]
                at = found.end()
                self._start(tag, attributes)
                if tag in RAW:
                    stop = re.compile(f"</{re.escape(tag)}(?=[\\s/>])", re.I).search(html, at)
                    inside = html[at:stop.start()] if stop else html[at:]
                    at = stop.start() if stop else size
                    if tag == "title" and not self.title:
                        self.title = " ".join(unescape(inside).split())
                elif attributes.endswith("/") and tag in ("svg", "math", "path"):
                    self._end(tag)
            elif after == "/":
                found = _CLOSE.match(html, sign)
                if found is not None:
                    self._end(found[1].lower())
                    at = found.end()
                else:
                    stop = html.find(">", sign)
                    if stop < 0:
                        return
                    at = stop + 1
            elif after == "!" or after == "?":
                if html.startswith("<!--", sign):
                    stop = html.find("-->", sign + 4)
                    if html.startswith(("<!-->", "<!--->"), sign):
                        at = html.index(">", sign) + 1
                    else:
                        at = stop + 3 if stop >= 0 else size
                else:
                    stop = html.find(">", sign)
                    at = stop + 1 if stop >= 0 else size
            else:
                self._text("<")
                at = sign + 1

    # judging

    def _judge(self) -> None:
        """Which elements are not the article by what they are, which lie in one, and labels for alignment."""
        count = len(self.tags)
        held = [False] * count  # holds an article or main
        found = [{m[1].lower(): next((x for x in m.groups()[1:] if x is not None), "") for m in _ATTRIBUTE.finditer(a)} if a else {}
                 for a in self.attributes]
        main = [t in MAIN or f.get("role", "").lower() in MAIN or f.get("itemprop", "").lower() == "articlebody"
                for t, f in zip(self.tags, found)]
        for node in range(count - 1, 0, -1):
            if main[node] or held[node]:
                held[self.parents[node]] = True
        self.article = [False] * count
        self.dropped = [False] * count
        self.labels: list[str] = []
        within = [0] * count  # articles around and at the node
        for node in range(count):
            tag, attributes, parent = self.tags[node], found[node], self.parents[node]
            named = f"{attributes.get('class', '')} {attributes.get('id', '')}"
            words = {w.lower() for w in _WORDS.findall(named)} if len(named) > 1 else set()
            self.labels.append(" ".join([tag, *sorted(words)]))
            if parent < 0:
                continue
            inside = self.article[parent] or main[node]
            within[node] = within[parent] + (tag == "article")
            marked = tag in NEVER or "hidden" in attributes or attributes.get("role", "").lower() in ROLES or \
                attributes.get("style", "").replace(" ", "").lower().find("display:none") >= 0
            if not held[node] and tag not in ("html", "body"):
                marked = marked or tag in ("footer", "form") or bool(words & BOILER) or (
                    not inside and (tag == "header" or "header" in words))
            self.dropped[node] = self.dropped[parent] or (marked and not (held[node] and tag not in NEVER))
            self.article[node] = inside
        # Articles in an article are readers' answers to it, if the outer one has paragraphs of its own.
        if max(within, default=0) > 1:
            own = {self._around(b.node) for b in self.blocks if within[b.node] == 1 and self.tags[b.node] == "p"}
            for node in range(1, count):
                outer = self.dropped[self.parents[node]]
                self.dropped[node] = self.dropped[node] or outer or (
                    self.tags[node] == "article" and within[node] > 1 and self._around(node) in own)
        # With an article on the page, main is more than the article.
        if any(t == "article" and not d for t, d in zip(self.tags, self.dropped)):
            kept = [w > 0 for w in within]
            if any(kept[b.node] and not self.dropped[b.node] for b in self.blocks):
                self.article = kept

    def _around(self, node: int) -> int:
        """The outermost article around a node."""
        found = -1
        while node >= 0:
            if self.tags[node] == "article":
                found = node
            node = self.parents[node]
        return found

    def tree(self) -> list[tuple[int, int]]:
        """(level, node) of the block elements that may hold text, in page order."""
        level = [0] * len(self.tags)
        out = [(0, 0)]
        for node in range(1, len(self.tags)):
            parent = self.parents[node]
            block = self.tags[node] in BLOCKS
            level[node] = min(level[parent] + block, DEEPEST)
            if block and not self.dropped[parent]:
                out.append((level[node], node))
        return out
