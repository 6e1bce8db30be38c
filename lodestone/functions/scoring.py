"""The factors of a result's score."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dims import DEFAULT_QUALITY, DOMAIN_QUALITY, HALF_LIFE_OTHER, HALF_LIVES, NAV_WORDS, WEIGHTS
from .text import CJK


def _known(domain: Column, which: str) -> Column:
    out = F.lit(None).cast("double")
    for name, score in reversed(DOMAIN_QUALITY.get(which, [])):
        hit = domain.endswith(name) if name.startswith(".") else (domain == name) | domain.endswith("." + name)
        out = F.when(hit, F.lit(score)).otherwise(out)
    return out


def quality(domain: Column, lang: str = "en") -> Column:
    return F.coalesce(_known(domain, lang), _known(domain, "default"), F.lit(DEFAULT_QUALITY))


def language(domain: Column, snippet: Column, lang: str) -> Column:
    """Two fifths for the domain's ending, three for the script of the snippet."""
    place = F.lit(0.5)
    if lang == "zh-TW":
        place = F.when(domain.endswith(".tw"), 0.9).when(domain.rlike(r"\.(cn|hk)$"), 0.7).otherwise(0.5)
    elif lang == "en":
        place = F.when(domain.endswith(".tw"), 0.3).when(domain.rlike(r"\.(com|org|io|dev|net)$"), 0.7).otherwise(0.5)
    letters = F.length(F.regexp_replace(snippet, r"\P{L}", ""))
    ratio = F.length(F.regexp_replace(snippet, CJK.replace("[", "[^"), "")) / F.greatest(letters, F.lit(1))
    script = F.lit(0.5)
    if lang.startswith("zh"):
        script = F.when(ratio > 0.3, 0.9).when(ratio > 0.1, 0.7).when((ratio == 0) & (letters > 10), 0.2).otherwise(0.5)
    elif lang == "en":
        script = F.when(ratio < 0.05, 0.8).when(ratio > 0.3, 0.3).otherwise(0.5)
    return place * 0.4 + script * 0.6


def snippet_factor(snippet: Column) -> Column:
    """Less for snippets that are short, or look like navigation."""
    n, low = F.length(snippet), F.lower(snippet)
    marks = n - F.length(F.translate(snippet, "|/>·・", ""))
    semicolons = n - F.length(F.replace(snippet, F.lit(";"), F.lit("")))
    navigation = sum((low.contains(w).cast("int") for w in NAV_WORDS), F.lit(0))
    return F.when(n < 30, 0.5).when(marks / n > 0.15, 0.3).when((semicolons >= 4) & (n < 200), 0.4).when((navigation >= 2) & (n < 120), 0.3).otherwise(1.0)


def freshness(date: Column, as_of: Column, window: str = "any") -> Column:
    hours = F.greatest(F.lit(0.0), (as_of.cast("double") - date.cast("double")) / 3600)
    return F.when(date.isNull(), 0.5).otherwise(F.exp(-0.693 * hours / HALF_LIVES.get(window, HALF_LIFE_OTHER)))


def engine_bonus(engines: Column) -> Column:
    return F.least(F.lit(0.1), (F.size(engines) - 1) * 0.05)


def hybrid(lexical: Column, semantic: Column, quality_: Column, factor: Column, fresh: Column, lang: Column, bonus: Column, penalty: Column, weights: dict[str, float] = WEIGHTS) -> Column:
    w = weights
    return F.round((w["lexical"] * lexical + w["semantic"] * semantic + w["quality"] * quality_ * factor + w["freshness"] * fresh + w["language"] * lang + bonus) * penalty, 4)
