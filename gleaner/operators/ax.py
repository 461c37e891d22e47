"""Accessibility trees to short text, page by page.

``nodes``: page_id, node_id, role, name, ignored, child_ids, backend_dom_id,
properties (JSON).  One page is one task's unit; pages spread over tasks.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Roles by what becomes of them.
INTERACTIVE = ["button", "checkbox", "combobox", "grid", "gridcell", "link", "listbox", "menu", "menubar", "menuitem", "menuitemcheckbox", "menuitemradio", "option", "radio", "scrollbar", "searchbox", "slider", "spinbutton", "switch", "tab", "tablist", "textbox", "tree", "treegrid", "treeitem", "rowheader", "columnheader", "canvas"]
LANDMARK = ["application", "article", "banner", "complementary", "contentinfo", "form", "main", "navigation", "region", "search"]
DROP = ["Abbr", "cell", "deletion", "div", "figcaption", "figure", "generic", "group", "insertion", "list", "listitem", "none", "paragraph", "presentation", "row", "rowgroup", "section", "separator", "subscript", "superscript", "table"]
LEAF = ["InlineTextBox", "LineBreak", "ListMarker"]
FLAG_ORDER = ["focused", "checked", "mixed", "selected", "expanded", "disabled", "required", "pressed"]
MAX_NODES = 500


def keep_self(role: Column, name: Column) -> Column:
    """Whether a node stays for its own sake."""
    named = F.coalesce(name, F.lit("")) != ""
    kept = role.isin(INTERACTIVE) | role.isin(LANDMARK) | (role == "heading") | (named & ~role.isin(DROP))
    return ~role.isin(LEAF) & kept


def ready(has_root: Column, n_nodes: Column) -> Column:
    """Whether a snapshot is a tree worth comparing: a root and something below."""
    return has_root & (n_nodes >= 2)


def nodes_array(json_text: Column) -> Column:
    """The node array of a raw answer, as JSON: result.nodes, nodes, or the array itself."""
    whole = F.try_parse_json(json_text)
    get = lambda path: F.try_variant_get(whole, path, "array<variant>")
    return F.coalesce(F.to_json(get("$.result.nodes")), F.to_json(get("$.nodes")), F.to_json(get("$")), F.lit("[]"))


def _flags(p: dict) -> list[str]:
    checked = p.get("checked")
    on = {f: p.get(f) is True for f in ("focused", "selected", "expanded", "disabled", "required")}
    on |= {"checked": checked == "true", "mixed": checked == "mixed", "pressed": p.get("pressed") == "true"}
    return [f for f in FLAG_ORDER if on[f]]


def _value(p: dict) -> str:
    v = p.get("value")
    if isinstance(v, str):
        cut = v.encode()[:40].decode(errors="ignore")
        return f' ="{cut}"' if v else ""
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return f' ="{int(v) if float(v).is_integer() else v}"'
    return ""


def compress(nodes: list[dict], max_nodes: int | None = None) -> dict:
    """(tree, total_nodes, truncated) of one page's nodes; None: 500 lines, 0: no bound."""
    limit = MAX_NODES if max_nodes is None else max_nodes
    by_id = {n["node_id"]: n for n in nodes}
    inside = {c for n in nodes for c in n["child_ids"]}
    roots = [n for n in nodes if n["node_id"] not in inside] or nodes[:1]
    kids = lambda n: [by_id[c] for c in n["child_ids"] if c in by_id]
    role = lambda n: n["role"] or ""
    name = lambda n: n["name"] or ""

    def own(n: dict) -> bool:
        r = role(n)
        return r not in LEAF and (r in INTERACTIVE or r in LANDMARK or r == "heading" or (name(n) != "" and r not in DROP))

    order, stack = [], list(roots)
    seen: set[str] = set()
    while stack:
        n = stack.pop()
        if n["node_id"] in seen:
            continue
        seen.add(n["node_id"])
        order.append(n)
        if role(n) not in LEAF:
            stack.extend(kids(n))
    alive, survive = {}, set()
    for n in reversed(order):  # children come before their parents
        below = any(alive.get(c["node_id"], False) for c in kids(n))
        alive[n["node_id"]] = role(n) not in LEAF and (below if n["ignored"] else own(n) or below)
        if alive[n["node_id"]] and not n["ignored"]:
            survive.add(n["node_id"])

    def texts(n: dict) -> list[dict]:
        out, todo = [], list(reversed(kids(n)))
        passed: set[str] = set()
        while todo:
            c = todo.pop()
            if c["node_id"] in passed:
                continue
            passed.add(c["node_id"])
            if role(c) == "StaticText":
                out.append(c)
            todo.extend(reversed(kids(c)))
        return out

    hidden: set[str] = set()
    for n in nodes:
        if n["node_id"] in survive and role(n) != "StaticText" and name(n):
            under = texts(n)
            if " ".join(name(c) for c in under).split() == name(n).split():
                hidden |= {c["node_id"] for c in under}

    lines, refs, numbers = [], [], {}
    todo = [(n, 0) for n in reversed(roots)]
    told: set[str] = set()
    while todo:
        n, depth = todo.pop()
        i, r = n["node_id"], role(n)
        if i in hidden or i in told:
            continue
        told.add(i)
        if n["ignored"] or (r in DROP and r not in INTERACTIVE and r not in LANDMARK):
            todo.extend((c, depth) for c in reversed(kids(n)))
            continue
        if i not in survive or r in LEAF:
            continue
        p = json.loads(n["properties"] or "{}")
        mark = ""
        if n["backend_dom_id"] is not None and (r in INTERACTIVE or r == "heading" or (r != "StaticText" and name(n))):
            numbers.setdefault(i, len(numbers) + 1)
            refs.append((numbers[i], int(n["backend_dom_id"])))
            mark = f"[{numbers[i]}] "
        flags = _flags(p)
        level = f" (h{p['level']})" if r == "heading" and isinstance(p.get("level"), int) else ""
        lines.append("  " * depth + mark + r + (f' "{name(n)}"' if name(n) else "") + (f" <{' '.join(flags)}>" if flags else "") + level + _value(p))
        todo.extend((c, depth + 1) for c in reversed(kids(n)))
    total = len(lines)
    cut = limit > 0 and total > limit
    if cut:
        lines = [*lines[:limit], "", f"... truncated {total - limit} nodes (max {limit}) ..."]
    if refs:
        lines += ["", "# refs -> backendDOMNodeId", " ".join(f"[{a}]={b}" for a, b in refs)]
    return {"tree": "\n".join(lines), "total_nodes": total, "truncated": cut}


def compress_trees(nodes: DataFrame, max_nodes: int | None = None) -> DataFrame:
    """One row a page: page_id, tree, total_nodes, truncated."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place", kind="stable")
        listed = [{**r, "child_ids": list(r["child_ids"]) if r["child_ids"] is not None else [], "backend_dom_id": None if pd.isna(r["backend_dom_id"]) else r["backend_dom_id"]} for r in rows.to_dict("records")]
        return pd.DataFrame([{"page_id": rows["page_id"].iloc[0], **compress(listed, max_nodes)}])

    return nodes.groupBy("page_id").applyInPandas(one, "page_id long, tree string, total_nodes long, truncated boolean")


def settled(snapshots: DataFrame) -> DataFrame:
    """First poll of each page at which its tree equals the one before, has two nodes or more and a root in view.

    ``snapshots``: page_id, poll, fingerprint, n_nodes, has_root.
    """
    before = F.lag("fingerprint").over(Window.partitionBy("page_id").orderBy("poll"))
    ready = snapshots.withColumn("same", (F.col("fingerprint") == before) & (F.col("n_nodes") >= 2) & F.col("has_root"))
    return ready.groupBy("page_id").agg(F.min(F.when(F.col("same"), F.col("poll"))).alias("settled_at"), F.max("poll").alias("last_poll"))
