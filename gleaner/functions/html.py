"""Pages to text and sections: one Arrow UDF pass over the HTML, on the standard parser."""

from __future__ import annotations

import json
from html import unescape
from html.parser import HTMLParser

from gleaner.functions.arrow import row_udf

# Regions without content, for page text and for followed text; tags that end a line.
SKIPPED = {"nav", "header", "footer", "aside", "form", "script", "style"}
FOLLOW_SKIPPED = {"script", "style", "noscript", "svg", "iframe", "nav", "footer", "header"}
BLOCKS = {"p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "li", "br", "section", "article", "blockquote", "pre", "td", "tr", "ul", "ol", "table"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
CLOSED_BY_BLOCK = BLOCKS - {"br"} | {"nav", "header", "footer", "aside", "form", "main"}
SPACES = "\t\n\x0b\x0c\r \x85\xa0             　  "


class Node:
    __slots__ = ("attributes", "children", "tag")

    def __init__(self, tag: str, attributes: dict | None = None) -> None:
        self.tag, self.attributes, self.children = tag, attributes or {}, []

    def walk(self):
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            if isinstance(node, Node):
                stack.extend(reversed(node.children))

    def text(self) -> str:
        return "".join(x for x in self.walk() if isinstance(x, str))

    def find(self, *tags: str):
        return [x for x in self.walk() if isinstance(x, Node) and x.tag in tags]


class _Tree(HTMLParser):
    """A forgiving tree: unclosed tags close with their parent, ``p`` also before a block."""

    CDATA_CONTENT_ELEMENTS = ("script", "style", "title", "textarea")

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("#document")
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        if tag in CLOSED_BY_BLOCK:
            for i in range(len(self.open) - 1, 0, -1):
                if self.open[i].tag == "p":
                    del self.open[i:]
                    break
                if self.open[i].tag in CLOSED_BY_BLOCK:
                    break
        if tag in ("html", "body") and any(n.tag == tag for n in self.open):
            return
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].children.append(Node(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        if self.open[-1].tag in ("title", "textarea"):  # raw to the parser, but with character references
            data = unescape(data)
        last = self.open[-1].children
        if last and isinstance(last[-1], str):
            last[-1] += data
        else:
            last.append(data)


def parse(html: str) -> Node:
    tree = _Tree()
    tree.feed(html)
    tree.close()
    return tree.root


def body_text(root: Node) -> str:
    """Text nodes outside skipped regions, each trimmed, joined by a space."""
    parts: list[str] = []
    bodies = root.find("body")
    stack: list[Node | str] = [bodies[0] if bodies else root]
    while stack:  # a stack, since pages may nest deeper than calls can
        node = stack.pop()
        if isinstance(node, str):
            if node.strip(SPACES):
                parts.append(node.strip(SPACES))
        elif node.tag not in SKIPPED:
            stack.extend(reversed(node.children))
    return " ".join(parts)


def jsonld(chunks: list[str]) -> tuple[str | None, str | None]:
    """Author and date of JSON-LD chunks; a publisher stands in for an author."""
    author = published = None

    def name(x):
        return x if isinstance(x, str) else x.get("name") if isinstance(x, dict) and isinstance(x.get("name"), str) else None

    for chunk in chunks:
        try:
            value = json.loads(chunk.strip() or "null")
        except ValueError:
            continue
        graph = value.get("@graph") if isinstance(value, dict) else None
        for item in graph if isinstance(graph, list) else [value]:
            if not isinstance(item, dict):
                continue
            author = author or name(item.get("author"))
            date = item.get("datePublished")
            published = published if published is not None else date if isinstance(date, str) else None
            author = author or name(item.get("publisher"))
    return author, published


def page(html: str) -> dict:
    """Title, metadata, text and headings of a page."""
    root = parse(html)
    metas = root.find("meta")

    def meta(key: str, value: str):
        return next((m.attributes["content"] for m in metas if m.attributes.get(key) == value and "content" in m.attributes), None)

    titles = root.find("title")
    title = meta("property", "og:title")
    author, published = jsonld([s.text() for s in root.find("script") if s.attributes.get("type") == "application/ld+json"])
    own = meta("name", "author")
    date = next((x for x in (meta("property", "article:published_time"), meta("name", "date"), published) if x is not None), None)
    htmls = root.find("html")
    heads = [(int(h.tag[1]), h.text().strip(SPACES)) for h in root.find("h1", "h2", "h3", "h4", "h5", "h6")]
    return {
        "title": title if title is not None else titles[0].text().strip(SPACES) if titles else "", "author": own if own is not None else author, "published": date,
        "site_name": meta("property", "og:site_name") or "", "language": htmls[0].attributes.get("lang") if htmls else None, "full_text": body_text(root),
        "headings": [{"depth": d, "text": t} for d, t in heads if t],
    }


PAGE_SCHEMA = "title string, author string, published string, site_name string, language string, full_text string, headings array<struct<depth int, text string>>"


def sections(headings: list[tuple[int, str]], full_text: str) -> list[dict]:
    """Sections between headings found in order in the text; offsets and lengths in bytes.

    ``parent``: place of the enclosing section in the list, -1 for a root.  A
    heading no deeper than the last section goes inside it if that has any
    subsections of its own, else beside it.
    """
    raw, at, found = full_text.encode(), 0, []
    for depth, text in headings:
        name = text.encode()
        if 3 <= len(name) <= 100:
            place = raw.find(name, at)
            if place >= 0:
                found.append((depth, text, place))
                at = place + len(name)
    out: list[dict] = []
    roots: list[int] = []
    below: dict[int, list[int]] = {}

    def insert(siblings: list[int], parent: int, i: int) -> None:
        while siblings:
            last = siblings[-1]
            inner = below[last]
            if found[last][0] < found[i][0]:
                if not (inner and found[inner[-1]][0] < found[i][0]):
                    siblings, parent = inner, last
                    break
            elif not inner:
                break
            siblings, parent = inner, last
        siblings.append(i)
        out[i]["parent"] = parent

    for i, (depth, text, place) in enumerate(found):
        end = found[i + 1][2] if i + 1 < len(found) else len(raw)
        out.append({"heading": text, "depth": depth, "offset": place, "length": end - place, "content": raw[place:end].decode(errors="ignore"), "parent": -1})
        below[i] = []
        insert(roots, -1, i)
    return out


SECTION_SCHEMA = "array<struct<heading string, depth int, offset long, length long, content string, parent int>>"


def plain_sections(content: str) -> list[dict]:
    """Sections of plain text: a heading line on its block, or a heading block before a text block."""

    def heading(line: str) -> bool:
        t = line.strip(SPACES)
        return bool(t) and len(t.encode()) < 100 and t[-1] not in ".!?" and t.count(" ") < 12

    if len(content.encode()) < 50:
        return []
    blocks, out, offset, i = content.split("\n\n"), [], 0, 0
    size = [len(b.encode()) for b in blocks]
    while i < len(blocks):
        block, start = blocks[i].strip(SPACES), offset
        offset += size[i] + 2
        lines = block.split("\n")
        if block and len(lines) >= 2 and heading(lines[0]):
            out.append({"heading": lines[0].strip(SPACES), "depth": 2, "offset": start, "length": size[i], "content": "\n".join(lines[1:]), "parent": -1})
        elif block and len(lines) == 1 and heading(block) and i + 1 < len(blocks):
            following = blocks[i + 1].strip(SPACES)
            if following and not ("\n" not in following and heading(following)):
                out.append({"heading": block, "depth": 2, "offset": start, "length": size[i] + 2 + size[i + 1], "content": following, "parent": -1})
                i += 1
                offset += size[i] + 2
        i += 1
    return out


def follow(html: str, offset: int = 0, end: int = 40_000) -> dict:
    """Main text of a followed page; ``offset`` and ``end`` cut like JavaScript's substring."""
    import re

    root = parse(html)
    title = "".join(t.text() for t in root.find("title")[:1])
    main = [n for n in root.walk() if isinstance(n, Node) and (n.tag in ("main", "article") or n.attributes.get("role") == "main")]
    start = (main or root.find("body") or [root])[0]
    out: list[str] = []
    plain: list[str] = []

    stack: list[Node | str | None] = list(reversed(start.children))
    while stack:
        node = stack.pop()
        if node is None:  # the end of a block
            out.append("\n")
        elif isinstance(node, str):
            out.append(node)
            plain.append(node)
        elif node.tag not in FOLLOW_SKIPPED and not (node.tag in ("h1", "h2") and title and node.text().strip(SPACES).lower() == title.strip(SPACES).lower()):
            if node.tag in BLOCKS:
                stack.append(None)
            stack.extend(reversed(node.children))
    tidy = lambda x: re.sub(r"\n{2,}", "\n", re.sub(r"[ \t]+", " ", x)).strip(SPACES)
    text = tidy("".join(out))
    if len(text) < 80:
        text = tidy("".join(plain))
    if len(text) < 3:
        return {"title": title, "content": "", "error": f"content too short ({len(text)} chars)"}
    low, high = sorted((min(max(offset, 0), len(text)), min(max(end, 0), len(text))))
    return {"title": title, "content": text[low:high], "error": ""}


FOLLOW_SCHEMA = "title string, content string, error string"


def page_udf():
    return row_udf(PAGE_SCHEMA, lambda html: page(html or ""))


def follow_udf():
    return row_udf(FOLLOW_SCHEMA, lambda html: follow(html or ""))


def sections_udf():
    return row_udf(SECTION_SCHEMA, lambda headings, text: sections([(h["depth"], h["text"]) for h in headings or []], text or ""))


def plain_sections_udf():
    return row_udf(SECTION_SCHEMA, lambda text: plain_sections(text or ""))


def jsonld_udf():
    """Author and date of an array of JSON-LD chunks."""
    return row_udf("author string, published string", lambda chunks: dict(zip(("author", "published"), jsonld(chunks or []), strict=True)))
