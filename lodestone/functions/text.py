"""Text expressions: language, tokens, cleaning, truncation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dims import AD_PATTERNS, AD_STEMS, BOT_PATTERNS, INJECTION_PATTERNS, NAMED_ENTITIES, ZH_STOP_WORDS

CJK = r"[\x{4E00}-\x{9FFF}]"
DROPPED_TAGS = ("script", "style", "nav", "footer", "header", "aside")


def as_text(c: Column) -> Column:
    """Trimmed; null if nothing is left."""
    return F.nullif(F.trim(c), F.lit(""))


def detect_language(c: Column) -> Column:
    return F.when(c.rlike(CJK), "zh-TW").otherwise("en")


def tokens(c: Column) -> Column:
    """Distinct lower-case words between white space, punctuation kept."""
    return F.array_distinct(F.filter(F.split(F.lower(c), r"(?U)\s+"), lambda x: x != ""))


def tokens_zh(c: Column) -> Column:
    """Distinct pairs of neighbouring Han characters and words of other scripts, without stop words; stands in for a dictionary."""
    runs = F.regexp_extract_all(F.lower(c), F.lit(rf"({CJK}+|[\p{{L}}\p{{N}}&&[^\x{{4E00}}-\x{{9FFF}}]]+)"), F.lit(1))
    pairs = F.flatten(F.transform(runs, lambda r: F.when(r.rlike(CJK) & (F.length(r) > 1), F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - 1, F.lit(1))), lambda i: F.substr(r, i, F.lit(2)))).otherwise(F.array(r))))
    return F.array_except(F.array_distinct(pairs), F.array(*[F.lit(w) for w in ZH_STOP_WORDS]))


def is_bot_page(c: Column) -> Column:
    """A short page (50 to 499 characters) that asks for proof of a human reader."""
    text = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", "")
    return F.length(text).between(50, 499) & text.rlike("(?iuUs)" + "|".join(f"(?:{p})" for p in BOT_PATTERNS))


def let(value: Column, body) -> Column:
    """body(value), with the value worked out once however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _numeric(c: Column) -> Column:
    """Numeric entities as characters; an ampersand as its own entity."""
    number = lambda e: F.when(F.lower(e).startswith("&#x"), F.conv(F.regexp_extract(e, "([0-9A-Fa-f]+);?$", 1), 16, 10)).otherwise(F.regexp_extract(e, "([0-9]+);?$", 1)).cast("long")
    valid = lambda n: n.isNotNull() & n.between(1, 0x10FFFF) & ~n.between(0xD800, 0xDFFF)
    char = lambda n: F.when(n == 38, F.lit("&amp;")).otherwise(F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"))
    entities = F.array_distinct(F.regexp_extract_all(c, F.lit("(&#(?:[xX][0-9A-Fa-f]{1,6}|[0-9]{1,7});?)"), F.lit(1)))
    entities = F.array_sort(entities, lambda a, b: F.length(b) - F.length(a))  # with the semicolon before without
    return F.when(F.contains(c, F.lit("&#")), F.aggregate(entities, c, lambda s, e: let(number(e), lambda n: F.when(valid(n), F.replace(s, e, char(n))).otherwise(s)))).otherwise(c)


def unescape(c: Column) -> Column:
    """Numeric entities, and the named ones of dims.NAMED_ENTITIES, as characters, once; an ampersand that comes out starts none."""
    names = F.array(*[F.struct(F.lit(f"&{e};").alias("e"), F.lit(x).alias("x")) for e, x in NAMED_ENTITIES.items() if e != "amp"])
    named = lambda c: F.replace(F.aggregate(names, c, lambda s, n: F.replace(s, n["e"], n["x"])), F.lit("&amp;"), F.lit("&"))
    return F.when(F.contains(c, F.lit("&")), named(_numeric(c))).otherwise(c)


def mask_injection(c: Column) -> Column:
    """Mask known phrasings. Invisible characters are taken out, for good, only where they hid one."""
    any_ = "(?iuU)" + "|".join(f"(?:{p})" for p in INJECTION_PATTERNS)
    masked = lambda plain: reduce(lambda x, p: F.regexp_replace(x, f"(?iuU){p}", "[FILTERED]"), INJECTION_PATTERNS, plain)
    plain = F.regexp_replace(F.regexp_replace(c, r"[\p{Mn}\p{Me}\p{Cf}]", ""), r"(?U)\s+", " ")
    return let(plain, lambda p: F.when(p.rlike(any_), masked(p)).otherwise(c))


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, "<[^>]+>", " "), "&[a-zA-Z]+;", " ")


def holds_any(c: Column, stems: list[str]) -> Column:
    """Whether the lower-cased text holds one of the strings; far cheaper than a pattern that ignores case."""
    words = F.array(*[F.lit(w) for w in stems])
    return let(F.lower(c), lambda low: F.exists(words, lambda w: F.contains(low, w)))


def drop_ads(c: Column, patterns: list[str] = AD_PATTERNS, stems: list[str] | None = None) -> Column:
    """Sentences with an advertisement's words go; if all would, all stay.

    stems: lower-case strings of which a text with an advertisement holds one; the patterns look at no other text.
    """
    if stems is None and patterns is AD_PATTERNS:
        stems = AD_STEMS
    simple, dots = r"(?<=[。.!！?？\n])\s*", r"\s*[·\x{30fb}]\s*"
    cut = F.when(F.contains(c, F.lit("·")) | F.contains(c, F.lit("\u30fb")), F.split(c, f"{simple}|{dots}")).otherwise(F.split(c, simple))
    pieces = F.filter(cut, lambda s: ~s.rlike(r"(?U)^\s*$"))
    clean = F.filter(pieces, lambda s: ~s.rlike("(?iuU)" + "|".join(f"(?:{p})" for p in patterns)))
    if stems:
        clean = F.when(holds_any(c, stems), clean).otherwise(pieces)
    return let(clean, lambda kept: F.when(F.size(kept) > 0, F.array_join(kept, " ")).otherwise(c))


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def truncate(c: Column, most: int) -> Column:
    """Cut at the last blank of the final fifth, if there is one, and mark the cut."""
    cut = F.substring(c, 1, most)
    last = F.length(cut) - F.instr(F.reverse(cut), " ")
    cut = F.when((F.instr(cut, " ") > 0) & (last > 0.8 * most), F.substr(cut, F.lit(1), last)).otherwise(cut)
    return F.when(F.length(c) > most, F.concat(F.rtrim(cut), F.lit("..."))).otherwise(c)


def sanitize(c: Column, most: int | None = None) -> Column:
    """Safe text for an answer: entities as characters, injections masked, no tags, no advertisements, single blanks, at most `most` characters. Each step is worked out once."""
    out = let(unescape(c), lambda x: mask_injection(x))
    out = squeeze(let(strip_tags(out), lambda x: drop_ads(x)))
    return let(out, lambda x: truncate(x, most)) if most else out


def page_title(html: Column) -> Column:
    return squeeze(F.regexp_extract(html, "(?is)<title[^>]*>(.*?)</title>", 1))


def page_text(html: Column) -> Column:
    """Text without the subtrees that hold no content."""
    for tag in DROPPED_TAGS:
        html = F.regexp_replace(html, rf"(?is)<{tag}\b.*?</{tag}\s*>", " ")
    return squeeze(F.regexp_replace(html, "(?s)<[^>]*>", " "))


LINK, IMAGE = r"\[[^\]]*\]\([^)]+\)", r"!\[[^\]]*\]\([^)]+\)"


def _inside(c: Column, pattern: str) -> Column:
    """Characters in matches of the pattern."""
    return F.aggregate(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), F.lit(0), lambda s, x: s + F.length(x))


def link_density(c: Column) -> Column:
    """Characters in links and images over all; an image counts as its link too."""
    return F.when((F.length(c) > 0) & F.contains(c, F.lit("](")), (_inside(c, LINK) + _inside(c, IMAGE)) / F.length(c)).otherwise(0.0)


def plain_fallback(html: Column) -> Column:
    """page_text() where it is over 100 characters, else null; what it gives counts as partial."""
    return let(page_text(html), lambda t: F.when(F.length(t) > 100, t))
