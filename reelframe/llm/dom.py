"""A page as a tree of nodes with features and pieces of text.

Nodes are block elements, and inline ones that have a class, an id or a role; other inline elements count to the node
around them. A page is read in one sweep: missing and misplaced end tags are allowed for by the usual rules (a new
paragraph, item or cell ends the one before it; an end tag without its start is passed over), and a tag or comment that
never ends goes up to the page's end.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape

# Names of elements in HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = set("script style template noscript iframe object svg math title textarea select canvas audio video noembed noframes xmp head".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split())
ENDS_PARAGRAPH = set("address article aside blockquote center details dialog dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table ul".split())
#: What a start tag ends, and where the search for it stops.
ENDED_BY = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "tbody": ({"thead", "tbody", "tr"}, {"table"})}

KINDS = {
    "article": "article main", "section": "section div center details table tbody tr td th", "paragraph": "p pre blockquote summary dd dt dl", "heading": "h1 h2 h3 h4 h5 h6 hgroup",
    "list": "ul ol li menu", "nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form fieldset button legend search", "figure": "figure figcaption", "page": "html body", "dialog": "dialog", "address": "address",
}
KIND_OF = {tag: kind for kind, tags in KINDS.items() for tag in tags.split()}
#: Words of a class, an id or a role that say what an element is for.
ROLES = {
    "content": "article articlebody content contents main maincontent post entry story body text prose page blog paragraph lead intro headline title",
    "nav": "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager pages tabs tabbar toolbar toc skip",
    "header": "header head masthead topbar brand branding logo banner",
    "footer": "footer foot bottom copyright legal colophon contentinfo imprint",
    "side": "sidebar side aside rail widget widgets complementary related recommended recommendations popular trending more tags tag tagcloud secondary",
    "ad": "ad ads adv advert adverts advertisement advertising adsense adslot sponsor sponsored sponsors promo promotion promoted teaser",
    "comment": "comment comments commentlist reply replies response responses respond discussion disqus thread reader readers feedback",
    "notice": "cookie cookies consent notice notices notification gdpr alert warning popup modal overlay newsletter subscribe subscription signup toast paywall message status alertdialog",
    "share": "share sharing social socials follow tweet facebook twitter like likes byline meta author bio",
    "form": "form search searchbox login signin register input field button",
    "hidden": "hidden invisible visuallyhidden",
}
ROLE_OF = {word: role for role, words in ROLES.items() for word in words.split()}
SIZES = (0, 1, 20, 60, 150, 400, 1200)
SHARES = (0.0, 0.05, 0.3, 0.6, 0.9)
PLACES = 4

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z))?|[^>=])*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)""", re.S
)
ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"?|'([^']*)'?|([^\s>]+)))?""")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _bucket(bounds: tuple, x: float) -> int:
    return sum(x > b for b in bounds)


#: Features by number.
NAMES = ["bias", *[f"kind:{k}" for k in [*KINDS, "inline", "other"]], *[f"role:{r}" for r in ROLES], *[f"size:{k}" for k in range(len(SIZES) + 1)], *[f"links:{k}" for k in range(len(SHARES) + 1)], *[f"whole:{k}" for k in range(len(SHARES) + 1)], *[f"place:{k}" for k in range(PLACES)], "stop", "copyright", "first", "last", "only"]
AT = {name: k for k, name in enumerate(NAMES)}
#: Edges by the child's kind, and whether the child has a role.
EDGES = [*KINDS, "inline", "other"]
EDGE_AT = {name: 2 * k for k, name in enumerate(EDGES)}


@dataclass
class Page:
    """Nodes in page order, parents first: parent (-1 for the root), depth, edge, features, and label where it is known."""

    parents: list[int] = field(default_factory=lambda: [-1])
    depths: list[int] = field(default_factory=lambda: [0])
    tags: list[str] = field(default_factory=lambda: ["html"])
    roles: list[list[str]] = field(default_factory=lambda: [[]])
    labels: list[int] = field(default_factory=lambda: [0])
    #: (node, text) in page order; a node of -1 stands for the border of a block.
    pieces: list[tuple[int, str]] = field(default_factory=list)
    own: list[int] = field(default_factory=lambda: [0])
    links: list[int] = field(default_factory=lambda: [0])

    def features(self) -> tuple[list[list[int]], list[int]]:
        """Numbers of each node's features, and its edge's kind."""
        n = len(self.parents)
        total, linked, children = self.own[:], self.links[:], [0] * n
        for k in range(n - 1, 0, -1):
            up = self.parents[k]
            total[up] += total[k]
            linked[up] += linked[k]
            children[up] += 1
        texts: list[list[str]] = [[] for _ in range(n)]
        begins = [-1] * n
        at = 0
        for node, text in self.pieces:
            if node >= 0:
                texts[node].append(text)
                if begins[node] < 0:
                    begins[node] = at
                at += len(text)
        # A node without text of its own begins where the next text does.
        last = at
        for k in range(n - 1, -1, -1):
            begins[k] = last if begins[k] < 0 else begins[k]
            last = min(last, begins[k])
        whole = max(total[0], 1)
        seen = [0] * n
        found, edges = [], []
        for k in range(n):
            tag, up = self.tags[k], self.parents[k]
            kind = KIND_OF.get(tag, "inline" if tag in INLINE else "other")
            text = "".join(texts[k])
            mine = ["bias", f"kind:{kind}", *[f"role:{r}" for r in self.roles[k]]]
            mine.append(f"size:{_bucket(SIZES, self.own[k])}")
            mine.append(f"links:{_bucket(SHARES, linked[k] / total[k]) if total[k] else 0}")
            mine.append(f"whole:{_bucket(SHARES, total[k] / whole)}")
            mine.append(f"place:{min(PLACES - 1, begins[k] * PLACES // max(at, 1))}")
            if any(c in text for c in ".!?…。"):
                mine.append("stop")
            if "©" in text:
                mine.append("copyright")
            if up >= 0:
                seen[up] += 1
                mine += ["only"] if children[up] == 1 else ["first"] if seen[up] == 1 else ["last"] if seen[up] == children[up] else []
            found.append([AT[m] for m in mine])
            edges.append(EDGE_AT[kind] + bool(self.roles[k]))
        return found, edges


def _said(attrs: str) -> dict[str, str]:
    return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in reversed(list(ATTR.finditer(attrs)))}


def _roles(said: dict[str, str]) -> list[str]:
    some = {ROLE_OF[w.lower()] for name in ("class", "id", "role", "itemprop") for w in WORD.findall(said.get(name, "")) if w.lower() in ROLE_OF}
    if "hidden" in said or said.get("aria-hidden", "").lower() == "true" or HIDING.search(said.get("style", "")):
        some.add("hidden")
    return sorted(some)


def parsed(html: str, label: str | None = None) -> Page:
    """The page's tree. Where label names an attribute, elements that have it are labelled with what lies in them: 1 unless
    its value is `no`."""
    page = Page()
    #: Open elements as (tag, node), and how many of each are open.
    stack: list[tuple[str, int]] = [("html", 0)]
    opened: dict[str, int] = {"html": 1}
    node = 0

    def popped(to: int) -> None:
        nonlocal node
        for tag, _ in stack[to:]:
            opened[tag] -= 1
            if tag not in INLINE:
                page.pieces.append((-1, ""))
        del stack[to:]
        node = stack[-1][1]

    def close(tags: set[str], stops: set[str]) -> None:
        if not any(opened.get(t) for t in tags):
            return
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in tags:
                return popped(k)
            if stack[k][0] in stops:
                return

    at, end = 0, len(html)
    endless: set[str] = set()
    while at < end:
        m = TOKEN.search(html, at)
        upto = m.start() if m else end
        if upto > at:
            text = unescape(html[at:upto])
            page.pieces.append((node, text))
            length = len(text.strip())
            page.own[node] += length
            if opened.get("a"):
                page.links[node] += length
        if not m:
            break
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if m["end"]:
            if tag in ("html", "body") or not opened.get(tag):
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    popped(k)
                    break
                # An inline element doesn't end across a block.
                if tag in INLINE and stack[k][0] not in INLINE:
                    break
            continue
        if tag in SKIPPED:
            closing = None if tag in endless else re.compile(rf"</{re.escape(tag)}\b[^>]*+(?:>|\Z)", re.I).search(html, at)
            # What follows a head or a drawing without an end is read; a script without an end goes on to the page's end.
            if closing:
                at = closing.end()
            elif tag in ("head", "svg", "math", "object", "audio", "video", "canvas"):
                endless.add(tag)
            else:
                at = end
            if tag not in INLINE:
                page.pieces.append((-1, ""))
            continue
        if tag in VOID:
            page.pieces.append((-1, ""))
            continue
        said = _said(m["attrs"]) if m["attrs"] else {}
        if tag in ("html", "body"):
            if len(page.parents) == 1:
                page.roles[0] = sorted({*page.roles[0], *_roles(said)})
            continue
        if tag in ENDS_PARAGRAPH:
            close({"p"}, {"table", "td", "th", "button", "object"})
        if tag in ENDED_BY:
            close(*ENDED_BY[tag])
        roles = _roles(said) if said else []
        if tag not in INLINE:
            page.pieces.append((-1, ""))
        named = any(said.get(k) for k in ("class", "id", "role")) or "hidden" in roles
        if tag not in INLINE or named:
            page.parents.append(node)
            page.depths.append(page.depths[node] + 1)
            page.tags.append(tag)
            page.roles.append(roles)
            page.own.append(0)
            page.links.append(0)
            page.labels.append((said[label] != "no") * 1 if label and label in said else page.labels[node])
            node = len(page.parents) - 1
        stack.append((tag, node))
        opened[tag] = opened.get(tag, 0) + 1
    return page


def joined(page: Page, kept: list[bool]) -> str:
    """The text of the kept nodes: white space is one space, blocks are joined by one space."""
    return " ".join("".join(" " if node < 0 else text if kept[node] else "" for node, text in page.pieces).split())
