"""A small HTML tree and what pages give: titles, main parts, headings, links, Markdown, questions with answers."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Tags and marks of class or id that are not content.
NOT_CONTENT = frozenset("nav footer header script style noscript iframe".split())
NOISE = "cookie banner sidebar breadcrumb menu navigation social share related advertisement ad- footer skip-to back-to-top".split()
BLOCKS = frozenset("p div section article main ul ol table tr blockquote pre body html dl dt dd figure form h1 h2 h3 h4 h5 h6 li".split())


@dataclass
class Node:
    tag: str = ""
    attrs: dict[str, str] = field(default_factory=dict)
    children: list["Node | str"] = field(default_factory=list)

    def all(self) -> "list[Node]":
        """Elements below, in the order of the page."""
        out, stack = [], [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            n = stack.pop()
            out.append(n)
            stack += [c for c in reversed(n.children) if isinstance(c, Node)]
        return out

    def find(self, *tags: str, cls: str | None = None) -> "list[Node]":
        mark = re.compile(cls, re.I) if cls else None
        return [n for n in self.all() if (not tags or n.tag in tags) and (mark is None or any(mark.search(c) for c in n.attrs.get("class", "").split()))]

    def text(self) -> str:
        """Stripped strings joined without a gap."""
        out: list[str] = []
        stack: list[Node | str] = [self]
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                out.append(n.strip())
            else:
                stack += reversed(n.children)
        return "".join(out)


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.path = [Node("[document]")]

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.path[-1].children.append(node)
        if tag not in VOID:
            self.path.append(node)

    def handle_startendtag(self, tag, attrs):
        self.path[-1].children.append(Node(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        for i in range(len(self.path) - 1, 0, -1):
            if self.path[i].tag == tag:
                del self.path[i:]
                break

    def handle_data(self, data):
        self.path[-1].children.append(data)


def parse(html: str | None, references: tuple[str, ...] | None = None) -> Node:
    """The tree; comments are left out. ``references``: names of the only character references that are decoded, where they end in a semicolon; without it all are, as browsers do."""
    html = html or ""
    if references is not None:  # the other ampersands stand for themselves
        html = re.sub(rf"&(?!(?:{'|'.join(map(re.escape, references))});)", "&amp;", html)
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.path[0]


def without_noise(root: Node) -> Node:
    """The tree without navigation, scripts and elements whose class or id speaks of it."""
    stack = [root]
    while stack:
        n = stack.pop()
        keep = []
        for c in n.children:
            if isinstance(c, Node):
                marks = f"{' '.join(c.attrs.get('class', '').split())} {c.attrs.get('id', '')}".lower()
                if c.tag in NOT_CONTENT or any(x in marks for x in NOISE):
                    continue
                stack.append(c)
            keep.append(c)
        n.children = keep
    return root


def full_text(root: Node) -> str:
    """All strings that are not blank, stripped, a line each."""
    out: list[str] = []
    stack: list[Node | str] = [root]
    while stack:
        n = stack.pop()
        if isinstance(n, str):
            if t := n.strip():
                out.append(t)
        else:
            stack += reversed(n.children)
    return "\n".join(out)


def title(root: Node) -> str:
    for n in root.find("meta"):
        if n.attrs.get("property") == "og:title" and n.attrs.get("content"):
            return n.attrs["content"].strip()
    for n in root.find("title")[:1]:
        if n.children and isinstance(n.children[0], str) and n.children[0]:
            return n.children[0].strip()
    return next((n.text() for n in root.find("h1")), "Untitled")


def main_part(root: Node, cls: str = r"field--name-body|page-content|main-content", article: bool = False) -> Node:
    """<main>, else <article> if asked for, else a div of the classes, else <body>, else all."""
    choices = [root.find("main"), root.find("article") if article else [], root.find("div", cls=cls), root.find("body")]
    return next((c[0] for c in choices if c), root)


def headings(root: Node) -> list[str]:
    return [t for n in root.find("h1", "h2", "h3", "h4") if (t := n.text())]


def links(root: Node, base: str, domains: list[str] | None = None) -> list[str]:
    """Distinct absolute links without fragments, sorted."""
    found = {urljoin(base, n.attrs["href"]).split("#")[0] for n in root.find("a") if "href" in n.attrs}
    return sorted(u for u in found if u.startswith("http") and (not domains or any(d in urlsplit(u).netloc for d in domains)))


def pdf_links(root: Node, base: str) -> list[str]:
    return [u for u in links(root, base) if u.lower().endswith(".pdf") or "/download" in u.lower()]


def markdown(root: Node) -> str:
    """Headings with marks, list items, emphasis and paragraphs; images go, links keep their text."""

    def inline(n: Node, depth: int) -> str:
        out = []
        for c in n.children:
            if isinstance(c, str):
                out.append(re.sub(r"[ \t\r\n]+", " ", c))
            elif c.tag not in ("img", "title", "head"):
                out.append(block(c, depth))
        return "".join(out)

    def block(n: Node, depth: int) -> str:
        inner = inline(n, depth + 1) if depth < 400 else n.text()
        if m := re.fullmatch(r"h([1-6])", n.tag):
            return f"\n\n{'#' * int(m[1])} {inner.strip()}\n\n"
        if n.tag in ("b", "strong"):
            return f"**{inner.strip()}**" if inner.strip() else ""
        if n.tag in ("i", "em"):
            return f"*{inner.strip()}*" if inner.strip() else ""
        if n.tag == "br":
            return "\n"
        if n.tag == "hr":
            return "\n\n---\n\n"
        if n.tag == "li":
            return f"\n* {inner.strip()}"
        if n.tag in BLOCKS:
            return f"\n\n{inner.strip()}\n\n"
        return inner

    text = re.sub(r"[ \t]+", " ", re.sub(r"\n{3,}", "\n\n", block(root, 0)))
    return re.sub(r"\n{3,}", "\n\n", "\n".join(x.strip() for x in text.split("\n"))).strip()


def questions(root: Node) -> list[tuple[str, str, str]]:
    """(question, answer, category) by the first way that gives any: marked items, definition lists, headings."""
    found = []
    for item in root.find(cls="faq|qa|question|accordion"):
        q, a = item.find(cls="question|title|header|toggle"), item.find(cls="answer|body|content|panel")
        if q and a and q[0].text() and a[0].text():
            found.append((q[0].text(), a[0].text(), ""))
    if not found:
        for dl in root.find("dl"):
            found += [(q.text(), a.text(), "") for q, a in zip(dl.find("dt"), dl.find("dd"), strict=False) if q.text() and a.text()]
    if found:
        return found
    category = ""
    marks = ("h2", "h3", "h4")
    for parent in [root, *root.all()]:
        rows = [c for c in parent.children if isinstance(c, Node)]
        for i, n in enumerate(rows):
            if n.tag not in marks or not n.text():
                continue
            if n.tag == "h2":
                category = n.text()
                continue
            end = next((j for j in range(i + 1, len(rows)) if rows[j].tag in marks), len(rows))
            answer = "\n".join(t for c in rows[i + 1 : end] if (t := c.text()))
            if answer:
                found.append((n.text(), answer, category))
    return found
