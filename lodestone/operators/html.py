"""HTML to markdown and main content, by the standard library's parser in Arrow batches."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

SKIP = {"script", "style", "nav", "footer", "aside", "noscript", "head"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
LEAST_HTML, LEAST_MARKDOWN = 100, 200


class Node:
    __slots__ = ("attrs", "parts", "tag")

    def __init__(self, tag: str, attrs: dict[str, str]) -> None:
        self.tag, self.attrs, self.parts = tag, attrs, []

    def walk(self):
        """Strings and nodes below, in order of the document, without recursion; what lies in SKIP is left out."""
        left = [iter(self.parts)]
        while left:
            part = next(left[-1], None)
            if part is None:
                left.pop()
                continue
            yield part
            if isinstance(part, Node) and part.tag not in SKIP:
                left.append(iter(part.parts))

    def text(self) -> str:
        return "".join(p for p in self.walk() if isinstance(p, str))

    def find(self, tag: str):
        return (p for p in self.walk() if isinstance(p, Node) and p.tag == tag)


class Tree(HTMLParser):
    def __init__(self, html: str) -> None:
        super().__init__()
        self.root = Node("", {})
        self.open = [self.root]
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag in ("p", "li", "tr", "td", "th") and self.open[-1].tag == tag:
            self.open.pop()
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].parts.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                break

    def handle_data(self, data):
        self.open[-1].parts.append(data)


def _flat(s: str) -> str:
    return " ".join(s.split())


def _table(node: Node) -> str:
    rows = [[c.text().strip().replace("|", "\\|").replace("\n", " ") for c in r.walk() if isinstance(c, Node) and c.tag in ("td", "th")] for r in node.find("tr")]
    rows = [r for r in rows if r]
    if not rows:
        return ""
    wide = max(map(len, rows))
    line = lambda r: "| " + " | ".join(r + [""] * (wide - len(r))) + " |"
    return "\n\n" + "\n".join([line(rows[0]), "| " + " | ".join(["---"] * wide) + " |", *map(line, rows[1:])]) + "\n\n"


def _block(said: str) -> str:
    return f"\n\n{said}\n\n" if said else ""


def _render(node: Node, inner: str, listed: list[str], parent: str) -> str:
    """The markdown of a node whose parts give `inner`; listed: of its own list items. What holds nothing gives nothing."""
    tag, said = node.tag, inner.strip()
    if tag in SKIP:
        return ""
    if len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
        plain = node.text().strip()
        return _block(f"{'#' * int(tag[1])} {plain}") if plain else ""
    if tag == "p":
        return _block(said)
    if tag == "a":
        href, plain = node.attrs.get("href", ""), node.text().strip()
        if not href or href.startswith(("#", "javascript:")):
            return inner
        return f"[{plain}]({href})" if plain else ""
    if tag in ("strong", "b", "em", "i"):
        mark = "**" if tag in ("strong", "b") else "*"
        return f"{mark}{said}{mark}" if said else ""
    if tag == "pre":
        code = node.text().strip()
        return _block(f"```\n{code}\n```") if code else ""
    if tag == "code" and parent != "pre":
        code = node.text().strip()
        return f"`{code}`" if code else ""
    if tag == "blockquote":
        return _block("\n".join(f"> {x}" for x in said.split("\n"))) if said else ""
    if tag in ("ul", "ol"):
        return _block("\n".join(f"{'-' if tag == 'ul' else f'{n}.'} {x}" for n, x in listed if x))
    if tag == "table":
        return _table(node)
    if tag == "img":
        return f"![{node.attrs.get('alt', '')}]({node.attrs['src']})" if node.attrs.get("src") else ""
    if tag in ("br", "hr"):
        return "\n" if tag == "br" else "\n\n---\n\n"
    return inner


def _convert(root: Node) -> str:
    """The tree as markdown, node by node from the leaves up, so that depth has no limit."""
    held: list[tuple[Node, list[str], list, bool]] = [(root, [], [], False)]
    left = [iter(root.parts)]
    while True:
        part = next(left[-1], None)
        node, parts, listed, code = held[-1]
        if isinstance(part, str):
            parts.append(part if code else re.sub(r"[ \t]+", " ", part))
        elif part is not None:
            held.append((part, [], [], code or part.tag == "pre"))
            left.append(iter(part.parts if part.tag not in SKIP else ()))
        else:
            held.pop()
            left.pop()
            if not held:
                return "".join(parts)
            above = held[-1]
            inner = "".join(parts)
            if node.tag == "li" and above[0].tag in ("ul", "ol"):
                above[2].append((len(above[2]) + 1, inner.strip()))
            above[1].append(_render(node, inner, listed, above[0].tag))


def to_markdown(html: str) -> str:
    return to_markdown_node(Tree(html or "").root)


def _weights(root: Node) -> dict[int, int]:
    """Of each node: characters of text without blanks at the edges, those in links taken off again; in one pass."""
    found: dict[int, int] = {}
    held, left = [(root, 0, False)], [iter(root.parts)]
    while held:
        part = next(left[-1], None)
        node, total, link = held[-1]
        if isinstance(part, str):
            held[-1] = (node, total + (-1 if link else 1) * len(_flat(part)), link)
        elif part is not None:
            held.append((part, 0, link or part.tag == "a"))
            left.append(iter(part.parts if part.tag not in SKIP else ()))
        else:
            held.pop()
            left.pop()
            found[id(node)] = total
            if held:
                held[-1] = (held[-1][0], held[-1][1] + total, held[-1][2])
    return found


def main_parts(html: str) -> tuple[str | None, str | None]:
    """Markdown and title of the article, or else the block with most text outside links; nulls if it is too short."""
    if len((html or "").strip()) < LEAST_HTML:
        return None, None
    root = Tree(html).root
    blocks = list(root.find("article")) or list(root.find("main")) or [b for t in ("div", "section", "td", "body") for b in root.find(t)]
    if not blocks:
        return None, None
    weight = _weights(root)
    best = max(blocks, key=lambda b: weight[id(b)])
    held = to_markdown_node(best)
    title = re.search(r"(?is)<title[^>]*>(.*?)</title>", html)
    return (held, _flat(title[1]) if title else None) if len(held) >= LEAST_MARKDOWN else (None, None)


def main_markdown(html: str) -> str | None:
    return main_parts(html)[0]


def to_markdown_node(node: Node) -> str:
    return re.sub(r"\n[ \t]*(?:\n[ \t]*)+\n|\n{3,}", "\n\n", _convert(node)).strip()


@F.pandas_udf(T.StringType())
def markdown(s: pd.Series) -> pd.Series:
    return s.map(to_markdown)


@F.pandas_udf(T.StringType())
def main_content(s: pd.Series) -> pd.Series:
    return s.map(main_markdown)


@F.pandas_udf(T.StructType([T.StructField("markdown", T.StringType()), T.StructField("title", T.StringType())]))
def main(s: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([main_parts(x) for x in s], columns=["markdown", "title"])
