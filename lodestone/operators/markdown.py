"""Markdown cleaning: runs of link lines, blocks and their neighbours. All within a row, by column functions: no key, no shuffle.

A null text counts as empty. Rows that repeat a key are rows like any other.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import dims, text
from ..functions.text import IMAGE, LINK, let

_EDGES = r"^\s+|\s+$"


def is_link_line(line: Column) -> Column:
    """A list item that is a link, a bare link, or a line of which links are over four fifths."""
    links = lambda s: s.rlike(rf"^[-*]?\s*{LINK}\s*$") | (text._inside(s, LINK) > 0.8 * F.length(s))
    return F.when(F.contains(line, F.lit("](")), let(F.trim(line), links)).otherwise(F.lit(False))


def _marked(items: Column, letter, pattern: str) -> Column:
    """Structs (x, mark): each item with its letter, after x's have taken the place of letters that the pattern finds among all of them."""
    letters = F.regexp_replace(F.array_join(F.transform(items, letter), ""), pattern, "x")
    return F.zip_with(items, F.split(letters, ""), lambda x, m: F.struct(x.alias("x"), m.alias("mark")))


def drop_link_runs(c: Column) -> Column:
    """Lines in runs of three or more links go."""
    lines = F.split(F.coalesce(c, F.lit("")), "\n")
    letter = lambda line: F.when(is_link_line(line), "l").otherwise("n")
    kept = F.filter(_marked(lines, letter, "l(?=ll)|(?<=l)l(?=l)|(?<=ll)l"), lambda m: m["mark"] != "x")
    return F.when(F.contains(c, F.lit("](")), F.array_join(F.transform(kept, lambda m: m["x"]), "\n")).otherwise(F.coalesce(c, F.lit("")))


def classify(block: Column, density: float = 0.5, short: int = 80) -> Column:
    """good, bad or uncertain, by length, share of links and boilerplate."""
    n = F.length(block)
    most = F.when(n > 300, F.least(F.lit(density + 0.25), F.lit(0.85))).when(n > 150, F.least(F.lit(density + 0.15), F.lit(0.75))).otherwise(density)
    judge = lambda d: F.when((n == 0) | (d > most) | ((n < short) & (d > 0.3)) | (text.holds_any(block, dims.BOILERPLATE_STEMS) & block.rlike(f"(?iu)(?:{dims.BOILERPLATE})")), "bad").when((n >= short) & (d < 0.3), "good").otherwise("uncertain")
    return let(text.link_density(block), judge)


def settle(classes: Column) -> Column:
    """An array of classes: uncertain ones are bad between two bad ones, and good elsewhere."""
    letter = lambda c: F.substring(c, 1, 1)
    found = _marked(classes, letter, r"(?<=b)u(?=u*b)|(?!^)\Gu(?=u*b)")
    return F.transform(found, lambda m: F.when((m["mark"] == "x") | (m["mark"] == "b"), "bad").otherwise("good"))


def blocks(c: Column) -> Column:
    """The blocks between blank lines, trimmed."""
    return F.transform(F.split(F.coalesce(c, F.lit("")), r"\n\s*\n"), lambda b: F.regexp_replace(b, _EDGES, ""))


def strip_links(c: Column) -> Column:
    """Images go, links leave their text."""
    return F.regexp_replace(F.regexp_replace(c, IMAGE, ""), r"\[([^\]]*)\]\([^)]+\)", "$1")


def repair_decimals(c: Column) -> Column:
    return F.regexp_replace(c, r"(\d+)\.\s+(\d+)", "$1.$2")


def clean(c: Column, links: bool = True, density: float = 0.5, short: int = 80) -> Column:
    """Without navigation, boilerplate and broken decimals; empty if nothing is left. links: whether links stay."""
    kept = let(
        blocks(drop_link_runs(c)),
        lambda bs: F.transform(F.filter(F.zip_with(bs, settle(F.transform(bs, lambda b: classify(b, density, short))), lambda b, k: F.struct(b.alias("b"), k.alias("k"))), lambda x: x["k"] == "good"), lambda x: x["b"]),
    )
    out = F.array_join(kept, "\n\n")
    out = out if links else strip_links(out)
    return F.regexp_replace(F.regexp_replace(repair_decimals(out), r"\n{3,}", "\n\n"), _EDGES, "")
