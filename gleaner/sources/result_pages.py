"""Captured result pages of search engines as hit tables: one parse a page, on Arrow batches."""

from __future__ import annotations

import re
from urllib.parse import urljoin, urlsplit

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions import html as X
from gleaner.functions.arrow import row_udf
from gleaner.functions.html import Node
from gleaner.functions.url import GOOGLE_PATHS

# Addresses of the result pages.
LOCATION = {"brave": "https://search.brave.com/search", "google": "https://www.google.com/search"}

ROWS = "array<struct<title string, url string, snippet string, position int>>"
_SPACE = r"[\t-\r    -     　﻿]+"


def _collapsed(node: Node | None) -> str:
    return re.sub(_SPACE, " ", node.text()).strip(" ") if node else ""


def _classes(node: Node) -> list[str]:
    return node.attributes.get("class", "").split()


def _links(node: Node) -> list[Node]:
    return [a for a in node.find("a") if "href" in a.attributes]


def _address(href: str, engine: str) -> tuple[str, str] | None:
    """A link's absolute address and host; None if it is no address."""
    try:
        url = urljoin(LOCATION[engine], href.strip())
        parts = urlsplit(url)
        return (url if parts.path or not parts.netloc else f"{url}/"), parts.hostname or ""
    except ValueError:
        return None


def _google_own(url: str, host: str) -> bool:
    return host.removeprefix("www.") == "google.com" and re.match("/(?:" + "|".join(GOOGLE_PATHS) + ")", urlsplit(url).path) is not None


def brave_rows(page: str, count: int) -> list[dict]:
    """Title, address and snippet of each web block, twice ``count`` at most; blocks that lack one, or lead back, are left out."""
    out: list[dict] = []
    for block in X.parse(page).find("div"):
        if block.attributes.get("data-type") != "web" or len(out) >= 2 * count:
            continue
        links = _links(block)
        found = _address(links[0].attributes["href"], "brave") if links else None
        if not found or found[1] == urlsplit(LOCATION["brave"]).hostname:
            continue
        inner = [n for n in block.walk() if isinstance(n, Node)]
        title = _collapsed(next((n for n in inner if {"title", "search-snippet-title"} <= set(_classes(n))), None))
        snippets = (c for n in inner if "generic-snippet" in _classes(n) for c in n.walk() if isinstance(c, Node) and c is not n and "content" in _classes(c))
        snippet = _collapsed(next(snippets, None))
        if len(title) >= 2 and snippet:
            out.append({"title": title, "url": found[0], "snippet": snippet, "position": len(out) + 1})
    return out


def _is_snippet(node: Node) -> bool:
    clamped = node.tag == "span" and "webkit-line-clamp" in node.attributes.get("style", "")
    return "data-sncf" in node.attributes or clamped or "VwiC3b" in _classes(node)


def google_rows(page: str, count: int) -> list[dict]:
    """Links of the result containers that have a title and a snippet, without Google's own pages; twice ``count`` at most."""
    out: list[dict] = []
    stack: list[tuple[Node, Node | None]] = [(X.parse(page), None)]
    while stack and len(out) < 2 * count:
        node, container = stack.pop()
        if node.tag == "a" and "href" in node.attributes and container is not None:
            found = _address(node.attributes["href"], "google")
            title = re.sub(f"^{_SPACE}|{_SPACE}$", "", node.text())
            if found and found[1] != urlsplit(LOCATION["google"]).hostname and not _google_own(*found) and len(title) >= 2:
                snippet = _collapsed(next((n for n in container.walk() if isinstance(n, Node) and n is not container and _is_snippet(n)), None))
                if snippet:
                    out.append({"title": title, "url": found[0], "snippet": snippet, "position": len(out) + 1})
        if node.tag == "div" and {"data-hveid", "data-sokoban-container", "data-async-context"} & set(node.attributes):
            container = node
        stack.extend((child, container) for child in reversed(node.children) if isinstance(child, Node))
    return out


READERS = {"brave": brave_rows, "google": google_rows}


def read(pages: DataFrame, engine: str, count: int = 5) -> DataFrame:
    """Hits of (answer, body): answer, position, title, url, snippet.  A null or foreign page has none."""
    rows_of = READERS[engine]

    rows = row_udf(ROWS, lambda body: rows_of(body or "", count))
    return pages.select("answer", F.explode(rows("body")).alias("x")).select("answer", "x.position", "x.title", "x.url", "x.snippet")
