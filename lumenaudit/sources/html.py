"""HTML to page signals: a small forgiving tree builder, and one pass of questions to the tree.

No HTML parser library is assumed. `Tree` takes html.parser's tokens, the plain ones by patterns of its own, closes what
HTML closes by itself (paragraphs, list items, cells, options), ignores stray end tags, and gives a body even to a
fragment. A page that is no HTML at all gives empty signals, never an error.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Collection, Iterator, Sequence
from functools import cached_property, lru_cache, partial
from html import unescape
from html.entities import html5
from html.parser import HTMLParser
from urllib.parse import urldefrag, urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..schema import EXTRACTED, struct

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What an opening tag ends when it is the innermost open element of the kind, up to a boundary.
ENDS = {
    **dict.fromkeys("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split(), ("p",)),
    "li": ("li", "p"),
    "dt": ("dt", "dd", "p"),
    "dd": ("dt", "dd", "p"),
    "tr": ("tr", "td", "th", "p"),
    "td": ("td", "th", "p"),
    "th": ("td", "th", "p"),
    "option": ("option",),
    "body": ("head",),
}
BOUNDS = frozenset("table ul ol dl select button body html svg form div section article main nav header footer aside".split())
#: By opening tag: what it ends, each with the elements at which the search for it ends.
ENDED = {tag: tuple((e, BOUNDS - {e}) for e in ended) for tag, ended in ENDS.items()}
#: Of which a page has one each.
ONCE = frozenset(("html", "head", "body"))
IN_HEAD = frozenset("title meta link base script style noscript template html head".split())

#: Pages whose signals a worker holds at once.
AT_ONCE = 256
#: Characters of a tag's attributes that are kept for the next such tag, at most.
SHORT = 200

# Fixed values that the rules of the same names are about.
SKIPPED_LINKS = ("#", "mailto:", "tel:", "javascript:", "data:")
ACTION_TYPES = ("Event", "HowTo", "Product", "Service")
CREDENTIALS = ("affiliation", "alumniOf", "award", "jobTitle", "knowsAbout", "sameAs")
API_HINTS = ("api-docs", "openapi", "swagger")
ENTITY = re.compile(r"\b[A-ZÀ-Ý][\wÀ-ÿ]{2,}\b")
PLATFORMS = {
    "bsky.app": "bluesky",
    "crunchbase.com": "crunchbase",
    "dev.to": "devto",
    "facebook.com": "facebook",
    "github.com": "github",
    "instagram.com": "instagram",
    "linkedin.com": "linkedin",
    "mastodon": "mastodon",
    "medium.com": "medium",
    "patreon.com": "patreon",
    "pinterest.com": "pinterest",
    "reddit.com": "reddit",
    "threads.net": "threads",
    "tiktok.com": "tiktok",
    "twitter.com": "twitter",
    "x.com": "twitter",
    "youtube.com": "youtube",
}


# Text and the tag after it, if that and its attributes are plain, so that html.parser has no choice; it parses all others.
# Nothing is matched twice (possessive): what could follow a name, a value or blanks is in none of them.
_TOKEN = re.compile(r"""([^<]*+)(?:<(?:([a-zA-Z][a-zA-Z0-9-]*+)((?:[ \t\n]++[a-zA-Z][-a-zA-Z0-9_:.]*+(?:="[^"]*+"|='[^']*+')?+)*+)[ \t\n]*+(/?)>|/([a-zA-Z][-.a-zA-Z0-9:_]*+)\s*+>))?""")
_ATTRIBUTE = re.compile(r"""([a-zA-Z][-a-zA-Z0-9_:.]*)(?:(=)(?:"([^"]*)"|'([^']*)'))?""")
_RAW_END = {tag: re.compile(rf"</\s*{tag}\s*>", re.IGNORECASE) for tag in ("script", "style")}
_REFERENCE = re.compile(r"&(#[0-9]+;|#[xX][0-9a-fA-F]+;|[a-zA-Z][a-zA-Z0-9]*;)")


@lru_cache(1024)  # of SHORT ones
def _attributes(given: str) -> tuple[tuple[str, str | None], ...]:
    """Plain attributes of one tag; most tags of a site have the same ones."""
    return tuple((a.lower(), unescape(v or w) if eq else None) for a, eq, v, w in _ATTRIBUTE.findall(given))


def _complete(m: re.Match) -> str:
    return unescape(m[0]) if m[1][0] == "#" or m[1] in html5 else m[0]


class Node:
    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str | None], parent: Node | None) -> None:
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def attr(self, name: str) -> str:
        return (self.attrs.get(name) or "").strip()

    def walk(self) -> Iterator[Node]:
        """The elements below, in document order."""
        stack = self.children[::-1]
        while stack:
            child = stack.pop()
            if type(child) is not str:
                yield child
                stack.extend(reversed(child.children))

    def text(self, between: str = "") -> str:
        """Texts below, each stripped, blank ones left out."""
        out, stack = [], self.children[::-1]
        while stack:
            child = stack.pop()
            if type(child) is str:
                if text := child.strip():
                    out.append(text)
            elif child.children:
                stack += child.children[::-1]
        return between.join(out)

    def own_text(self) -> str:
        return "".join(c.strip() for c in self.children if isinstance(c, str))

    def first(self, *tags: str) -> Node | None:
        return next((n for n in self.walk() if n.tag in tags), None)


class Tree(HTMLParser):
    def __init__(self, html: str, scripts: bool = True, bare: bool = True) -> None:
        """scripts: whether the text of scripts and styles counts as text of the body; bare: whether a character reference
        without its semicolon (`&amp` before a tag, say), which HTML reads as one where it knows it, is one in texts."""
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", {}, None)
        self.scripts, self.bare = scripts, bare
        self.body: Node | None = None
        self.nodes: list[Node] = []
        self.rawdata = html
        self.goahead(True)
        self.body = self.body or self._fragment_body()

    def freed(self) -> None:
        """Takes the tree apart, so that its memory is free without a search for cycles."""
        for n in self.nodes:
            n.parent = None
        self.at = self.root

    def _text(self, data: str) -> None:
        if "&" in data:
            data = unescape(data) if self.bare else _REFERENCE.sub(_complete, data)
        self.handle_data(data)

    def goahead(self, end: bool) -> None:
        """html.parser's loop over a whole page, with its own methods for what isn't plain.

        Most of a page's time goes here, so what handle_starttag, handle_endtag and handle_data do stands here once more.
        """
        raw, i, n = self.rawdata, 0, len(self.rawdata)
        while i < n:
            i = self._plain(raw, i, n)

    def _plain(self, raw: str, i: int, n: int) -> int:
        """Plain tokens from some place on, and after them one that isn't, or the raw text of a script or style: where that ends."""
        nodes, at, plain = self.nodes, self.at, self.scripts
        for m in _TOKEN.finditer(raw, i):
            text, opened, given, slash, closed = m.groups()
            if text:
                if plain and "&" not in text:
                    at.children.append(text)
                else:
                    self.at = at
                    self._text(text)
            if closed:
                tag, node = closed.lower(), at
                while node.parent is not None:
                    if node.tag == tag:
                        at = node.parent
                        break
                    node = node.parent
                continue
            if opened:
                tag = opened.lower()
                attrs = () if not given else _attributes(given) if len(given) <= SHORT else _attributes.__wrapped__(given)
                if slash or tag in ONCE:
                    self.at = at
                    (self.handle_startendtag if slash else self.handle_starttag)(tag, attrs)
                    at = self.at
                    continue
                for ended, bounds in ENDED.get(tag, ()):
                    node = at
                    while node.parent is not None:
                        if node.tag == ended:
                            at = node.parent
                            break
                        if node.tag in bounds:
                            break
                        node = node.parent
                node = Node(tag, dict(reversed(attrs)), at)
                nodes.append(node)
                at.children.append(node)
                if tag not in VOID:
                    at = node
                if tag not in _RAW_END:
                    continue
                i = m.end()
            elif (i := m.end()) < n:
                self.at = at
                i, tag = self._odd(raw, i, n)
                at = self.at
            self.at = at
            return self._raw(raw, i, n, tag) if i < n and tag in _RAW_END else i
        return n

    def _raw(self, raw: str, i: int, n: int, tag: str) -> int:
        if (m := _RAW_END[tag].search(raw, i)) is None:  # what never ends isn't there
            return n
        if i < m.start():
            self.handle_data(raw[i : m.start()])
        self.handle_endtag(tag)
        return m.end()

    def _odd(self, raw: str, i: int, n: int) -> tuple[int, str]:
        """One token that isn't plain: where it ends, and which element it opens whose text is raw."""
        self.lasttag, self.cdata_elem = "", None
        if raw[i + 1 : i + 2].isascii() and raw[i + 1 : i + 2].isalpha():
            k = self.parse_starttag(i)
        elif raw.startswith("</", i):
            k = self.parse_endtag(i)
        elif raw.startswith("<!--", i):
            k = self.parse_comment(i)
        elif raw.startswith("<?", i):
            k = self.parse_pi(i)
        elif raw.startswith("<!", i):
            k = self.parse_html_declaration(i)
        else:
            self.handle_data("<")
            k = i + 1
        if k < 0:
            k = raw.find(">", i + 1) + 1 or raw.find("<", i + 1)
            k = i + 1 if k < 0 else k
            self._text(raw[i:k])
        return k, self.cdata_elem or ""

    def _fragment_body(self) -> Node | None:
        """What isn't in the head, where no body tag stands."""
        top = next((n for n in self.nodes if n.tag == "html"), self.root)
        body = Node("body", {}, None)
        body.children = [c for c in top.children if not isinstance(c, Node) or c.tag not in IN_HEAD]
        return body if self.nodes or body.children else None

    def handle_starttag(self, tag: str, attrs: Sequence[tuple[str, str | None]]) -> None:
        if tag in ("html", "body", "head") and (known := next((n for n in self._open() if n.tag == tag), None)) is not None:
            known.attrs = dict(attrs) | known.attrs
            return
        for ended, bounds in ENDED.get(tag, ()):
            self._end(ended, bounds)
        node = Node(tag, dict(reversed(attrs)) if attrs else {}, self.at)
        self.nodes.append(node)
        self.at.children.append(node)
        if tag == "body" and self.body is None:
            self.body = node
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: Sequence[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.at.tag == tag and any(n.tag in ("svg", "math") for n in self._open()):
            self.at = self.at.parent

    def _open(self) -> Iterator[Node]:
        node = self.at
        while node is not None:
            yield node
            node = node.parent

    def _end(self, tag: str, bounds: frozenset[str]) -> None:
        node = self.at
        while node.parent is not None:
            if node.tag == tag:
                self.at = node.parent
                return
            if node.tag in bounds:
                return
            node = node.parent

    def handle_endtag(self, tag: str) -> None:
        self._end(tag, frozenset())

    def handle_data(self, data: str) -> None:
        if self.scripts or self.at.tag not in ("script", "style"):
            self.at.children.append(data)
        elif self.at.attrs.get("type") == "application/ld+json":
            self.at.attrs["#text"] = (self.at.attrs.get("#text") or "") + data


def host_of(url: str) -> str:
    try:
        return (urlsplit(url).hostname or "").lower()
    except ValueError:
        return ""


def links_of(nodes: list[Node], base: str) -> list[str]:
    """Absolute http(s) links without fragment, sorted."""
    out = set()
    for n in nodes:
        href = n.attr("href") if n.tag == "a" and "href" in n.attrs else ""
        if href and not href.startswith(SKIPPED_LINKS):
            try:
                link = urldefrag(urljoin(base, href)).url
            except ValueError:
                continue
            if link.startswith(("http://", "https://")):
                out.add(link)
    return sorted(out)


class Structured:
    """What the JSON-LD blocks of a page say."""

    def __init__(self, blocks: list[str]) -> None:
        self.types: set[str] = set()
        self.actions: set[str] = set()
        self.same_as: set[str] = set()
        self.dates: list[str] = []
        self.author = self.credentials = False
        for raw in blocks:
            try:
                self._visit(json.loads(raw), False)
            except (ValueError, RecursionError):
                continue

    def _visit(self, node: object, in_action: bool) -> None:
        if isinstance(node, list):
            for x in node:
                self._visit(x, in_action)
        if not isinstance(node, dict):
            return
        kind = node.get("@type")
        names = {kind} if isinstance(kind, str) else {x for x in kind if isinstance(x, str)} if isinstance(kind, list) else set()
        self.types |= names
        if in_action:
            self.actions |= names
        self.author |= "Person" in names or "author" in node
        self.credentials |= "Person" in names and not node.keys().isdisjoint(CREDENTIALS)
        self.dates += [node[k] for k in ("datePublished", "dateModified") if isinstance(node.get(k), str)]
        same = node.get("sameAs")
        self.same_as |= {same} if isinstance(same, str) else {x for x in same if isinstance(x, str)} if isinstance(same, list) else set()
        for key, value in node.items():
            self._visit(value, in_action or key == "potentialAction")


def _named(node: Node, text: str) -> bool:
    return bool(node.attr("aria-label") or node.attr("aria-labelledby") or text)


def _decorative(svg: Node) -> bool:
    return svg.attr("aria-hidden").lower() == "true" or svg.attr("role").lower() in ("presentation", "none") or "display:none" in (svg.attrs.get("style") or "").replace(" ", "").lower()


def _labelled_around(svg: Node, levels: int = 5) -> bool:
    """Whether the nearest control within some levels has a name, or, without a control, the parent by its own text."""
    node = svg.parent
    for _ in range(levels):
        if node is None:
            break
        if node.tag in ("a", "button") or node.attr("role").lower() in ("button", "link"):
            return _named(node, node.text())
        node = node.parent
    return svg.parent is not None and _named(svg.parent, svg.parent.own_text())


def _icons(nodes: list[Node]) -> tuple[int, int]:
    shown = [n for n in nodes if n.tag == "svg" and not _decorative(n) and not _labelled_around(n)]
    title = lambda n: t.text() if (t := n.first("title")) else ""
    return len(shown), sum(_named(n, title(n)) for n in shown)


def _forms(nodes: list[Node]) -> dict[str, int]:
    out = dict.fromkeys(("usable", "found", "no_action", "no_fields", "no_label"), 0)
    for form in (n for n in nodes if n.tag == "form"):
        inside = list(form.walk())
        fields = [n for n in inside if n.tag in ("input", "select", "textarea")]
        labelled = any(n.tag == "label" for n in inside) or any(n.attrs.get("aria-label") or n.attrs.get("placeholder") for n in fields)
        kind = "no_action" if not (form.attrs.get("action") or form.attrs.get("method")) else "no_fields" if not fields else "usable" if labelled else "no_label"
        out[kind] += 1
        out["found"] += 1
    return out


def _count(text: str | None) -> int:
    return len((text or "").split())


class Page:
    """A page's tree, and what several of its signals share, made when the first of them asks."""

    def __init__(self, tree: Tree, url: str, html: str) -> None:
        self.nodes, self.body, self.url, self.html = tree.nodes, tree.body, url, html

    @cached_property
    def by(self) -> dict[str, list[Node]]:
        by: dict[str, list[Node]] = {}
        for n in self.nodes:
            by.setdefault(n.tag, []).append(n)
        return by

    def of(self, *tags: str) -> list[Node]:
        return [n for t in tags for n in self.by.get(t, ())]

    def first(self, *tags: str) -> Node | None:
        return next(iter(self.of(*tags)), None)

    def linked_as(self, rel: str) -> list[Node]:
        return [n for n in self.of("link") if n.attrs.get("rel") == rel]

    @cached_property
    def low(self) -> str:
        return self.html.lower()

    @cached_property
    def text(self) -> str:
        return self.body.text(" ") if self.body else ""

    @cached_property
    def words(self) -> int:
        return len(self.text.split())

    @cached_property
    def meta(self) -> dict[str, dict[str, str | None]]:
        meta = {"name": {}, "og": {}, "twitter": {}}
        for m in self.of("meta"):
            name, prop, content = (m.attrs.get("name") or "").lower(), (m.attrs.get("property") or "").lower(), m.attrs.get("content")
            if name in ("description", "robots"):
                meta["name"][name] = content
            key = prop or name
            for group in ("og", "twitter"):
                if key.startswith(f"{group}:"):
                    meta[group][key] = content or ""
        return meta

    @cached_property
    def links(self) -> list[tuple[str, str]]:
        """Links, each with its host."""
        return [(x, host_of(x)) for x in links_of(self.of("a"), self.url)]

    @cached_property
    def internal(self) -> list[str]:
        host = host_of(self.url)
        return [x for x, h in self.links if h == host]

    @cached_property
    def outside(self) -> list[str]:
        host = host_of(self.url)
        return sorted({h for _, h in self.links if h and h != host})

    @cached_property
    def data(self) -> Structured:
        return Structured([b for s in self.of("script") if s.attrs.get("type") == "application/ld+json" and (b := (s.attrs.get("#text") or s.text()).strip())])

    @cached_property
    def icons(self) -> tuple[int, int]:
        return _icons(self.of("svg"))

    @cached_property
    def forms(self) -> dict[str, int]:
        return _forms(self.of("form"))

    def title(self) -> str | None:
        title = self.first("title")
        return title.text() if title else None

    def lead_words(self) -> int:
        around = self.first("main") or self.body
        lead = around.first("p") if around else None
        return _count(lead.text()) if lead else 0

    def main_ratio(self) -> float | None:
        if not self.words:
            return None
        main = self.first("main") or self.first("article")
        words = _count(main.text(" ")) if main else max(0, self.words - sum(_count(n.text(" ")) for n in self.of("nav", "header", "footer", "aside")))
        return round(words / self.words, 4)

    def platforms(self) -> list[str]:
        hosts = [*self.outside, *map(host_of, self.data.same_as)]
        return sorted({name for h in hosts for part, name in PLATFORMS.items() if part in h})

    def webmcp(self) -> dict[str, bool | int]:
        register = "registertool" in self.low or "navigator.modelcontext" in self.low
        tools = sum("toolname" in n.attrs for n in self.nodes)
        return {"has_register_tool": register, "has_tool_attributes": tools > 0, "tool_count": tools, "partial_signals": "modelcontext" in self.low and not register and not tools}


#: The fields of schema.EXTRACTED, those of aso by their whole names.
SIGNALS: dict[str, Callable[[Page], object]] = {
    "title": Page.title,
    "meta_description": lambda p: p.meta["name"].get("description"),
    "canonical": lambda p: next((n.attrs.get("href") for n in p.linked_as("canonical")), None),
    "meta_robots": lambda p: p.meta["name"].get("robots"),
    "open_graph": lambda p: p.meta["og"],
    "twitter_card": lambda p: p.meta["twitter"],
    "hreflang": lambda p: {n.attr("hreflang"): n.attr("href") for n in p.linked_as("alternate") if n.attr("hreflang")},
    "h1_count": lambda p: len(p.of("h1")),
    "headings": lambda p: {f"h{k}": len(p.of(f"h{k}")) for k in range(1, 7) if p.of(f"h{k}")},
    "word_count": lambda p: p.words,
    "text_ratio": lambda p: round(len(p.text) / len(p.html), 4) if p.html else None,
    "structured_data_types": lambda p: sorted(p.data.types),
    "internal_links": lambda p: len(p.internal),
    "external_links": lambda p: len(p.links) - len(p.internal),
    "internal_link_targets": lambda p: p.internal,
    "images_total": lambda p: len(p.of("img")),
    "images_with_alt": lambda p: sum(bool(n.attr("alt")) for n in p.of("img")),
    "svg_total": lambda p: p.icons[0],
    "svg_accessible": lambda p: p.icons[1],
    "tables_count": lambda p: len(p.of("table")),
    "definition_lists_count": lambda p: len(p.of("dl")),
    "question_headings": lambda p: sum(n.text().endswith("?") for n in p.of("h2", "h3", "h4")),
    "lead_paragraph_words": Page.lead_words,
    "has_author": lambda p: p.data.author,
    "author_has_credentials": lambda p: p.data.credentials,
    "has_structured_dates": lambda p: bool(p.data.dates),
    "main_text_ratio": Page.main_ratio,
    "entity_count": lambda p: len(set(ENTITY.findall(p.text))),
    "external_link_domains": lambda p: p.outside,
    "content_date": lambda p: max(p.data.dates, default=None),
    "social_platforms": Page.platforms,
    "aso.webmcp": Page.webmcp,
    "aso.potential_actions": lambda p: sorted(p.data.actions),
    "aso.action_schema_types": lambda p: sorted(p.data.types.intersection(ACTION_TYPES)),
    "aso.agent_usable_forms": lambda p: p.forms["usable"],
    "aso.agent_usable_forms_detail": lambda p: {k: p.forms[k] for k in ("found", "no_action", "no_fields", "no_label")},
    "aso.openapi_links": lambda p: sorted({h for n in p.of("a", "link") if (h := n.attr("href")) and any(x in h.lower() for x in API_HINTS)}),
}
#: How a page is rendered, told from both its word counts.
RENDERING = ("render_mode", "render_source", "raw_word_count", "rendered_word_count")


def signals(url: str, html: str, scripts: bool = True, bare: bool = True) -> dict[str, object]:
    """The fields of schema.EXTRACTED for one page."""
    tree = Tree(html, scripts, bare)
    try:
        return _signals(Page(tree, url, html))
    finally:
        tree.freed()


def _signals(page: Page, only: frozenset[str] | None = None) -> dict[str, object]:
    out: dict[str, object] = {}
    for name, of in SIGNALS.items():
        if only is None or name in only:
            if name.startswith("aso."):
                out.setdefault("aso", {})[name[4:]] = of(page)
            else:
                out[name] = of(page)
    return out


def body_words(html: str | None, bare: bool = True) -> int:
    tree = Tree(html or "", bare=bare)
    words = _count(tree.body.text(" ")) if tree.body else 0
    tree.freed()
    return words


def render_mode(raw: int, rendered: int | None, mounts: bool, scripts: int) -> str:
    """By the two word counts if there is a rendering (1.5 times and 100 words more: csr), else by a rule of thumb."""
    if rendered is not None:
        return "csr" if rendered >= 1.5 * raw and rendered - raw >= 100 else "ssr"
    return "ssr" if raw >= 50 else "csr" if mounts or scripts > 5 else "ssr"


def _mount_and_scripts(nodes: list[Node]) -> tuple[bool, int]:
    return any(n.attrs.get("id") in ("root", "app") or "data-reactroot" in n.attrs or "ng-version" in n.attrs for n in nodes), sum(n.tag == "script" for n in nodes)


def _extracted(url: str, html: str, rendered: str | None, scripts: bool, bare: bool = True, only: frozenset[str] | None = None) -> dict[str, object]:
    """Signals of the rendered DOM if there is one, else of the HTML; and how the page is rendered."""
    shown = html if rendered is None else rendered
    tree = Tree(shown, scripts, bare)
    page = Page(tree, url, shown)
    out = _signals(page, only)
    if only is None or not only.isdisjoint(RENDERING):
        raw = page.words if rendered is None else body_words(html, bare)
        mount, count = _mount_and_scripts(tree.nodes) if rendered is None and raw < 50 else (False, 0)
        after = None if rendered is None else page.words
        out |= {"render_mode": render_mode(raw, after, mount, count), "render_source": "heuristic" if rendered is None else "dom_diff", "raw_word_count": None if rendered is None else raw, "rendered_word_count": after}
    tree.freed()
    return out


def _parsed(parts: Iterator[pa.RecordBatch], parse: Callable[..., dict], scripts: bool, bare: bool) -> Iterator[list[dict]]:
    """The signals of AT_ONCE pages at a time; a page's HTML is text in Python for its own parse only."""
    for whole in parts:
        for first in range(0, whole.num_rows, AT_ONCE):
            rows = []
            for audit, url, final, code, redirects, html, rendered in zip(*whole.slice(first, AT_ONCE).columns, strict=True):
                at = final.as_py() or url.as_py() or ""
                rows.append({"audit_id": audit.as_py(), "url": at, "status_code": code.as_py(), "redirects": redirects.as_py()} | parse(at, html.as_py() or "", rendered.as_py(), scripts, bare))
            yield rows


def _chosen(only: Collection[str] | None) -> tuple[T.StructType, frozenset[str] | None]:
    """The columns of the signals named (all, if None is), and the names with aso's parts instead of aso."""
    fields = struct(f"audit_id string, url string, status_code int, redirects int, render_mode string, render_source string, raw_word_count int, rendered_word_count int, {EXTRACTED}")
    if only is None:
        return fields, None
    parts = [f"aso.{f.name}" for f in fields["aso"].dataType]
    names = {"audit_id", "url", *only, *(parts if "aso" in only else ())} - {"aso"}
    if unknown := names.difference(fields.names, parts):
        raise ValueError(f"no such signals: {sorted(unknown)}")
    aso = T.StructType([f for f in fields["aso"].dataType if f"aso.{f.name}" in names])
    chosen = [f for f in fields if f.name in names]
    return T.StructType([*chosen, T.StructField("aso", aso)] if aso.fields else chosen), frozenset(names)


def extract(captures: DataFrame, scripts: bool = True, parse: Callable[..., dict] = _extracted, bare: bool = True, only: Collection[str] | None = None) -> DataFrame:
    """captures (schema.CAPTURE) to page signals (schema.PAGE_SIGNALS); each page is parsed once, in Arrow batches.

    The HTML ends here. The signals' URL is the final one; of several captures of one final URL the caller keeps one.
    bare: as for `Tree`. only: the signals wanted beside audit and URL (parts of aso as `aso.webmcp`); pages are parsed as
    ever, but no other signal is made of them, since Spark cannot leave out what Python returns.
    """
    fields, named = _chosen(only)
    arrow = to_arrow_schema(fields)
    names = ("audit_id", "url", "final_url", "status_code", "redirects", "html", "rendered_html")
    made = parse if named is None else partial(parse, only=named)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _parsed(parts, made, scripts, bare):
            yield pa.RecordBatch.from_pylist(rows, arrow)

    return captures.select(*names).mapInArrow(run, T.StructType(fields.fields))
