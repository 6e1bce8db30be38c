"""What a crawl service's answer holds: the payload inside it, its content, and the form that is asked for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import as_text, let

DEPTH = 4


def _is_object(c: Column) -> Column:
    return F.coalesce(F.ltrim(c).startswith("{"), F.lit(False))


def _first_object(c: Column) -> Column:
    """The first object of a JSON array."""
    return F.get(F.filter(F.from_json(c, "array<string>"), _is_object), 0)


def result_payload(body: Column, depth: int = DEPTH) -> Column:
    """The object with the result, as JSON: `result`, else `results` (or its first object), else what `data` holds, else the answer itself; {} if there is none."""

    def inside(c: Column, left: int) -> Column:
        result, results, data = (F.get_json_object(c, f"$.{name}") for name in ("result", "results", "data"))
        listed = F.when(F.ltrim(results).startswith("["), _first_object(results))
        out = F.when(_is_object(result), result).when(_is_object(results), results).when(listed.isNotNull(), listed)
        return out.when(_is_object(data), inside(data, left - 1)).otherwise(c) if left else out.otherwise(c)

    return F.when(_is_object(body), inside(body, depth)).when(F.ltrim(body).startswith("["), F.coalesce(_first_object(body), F.lit("{}"))).otherwise(F.lit("{}"))


def fields(payload: Column) -> Column:
    """A struct of content, markdown, title, raw_html and partial; blank texts are null."""
    at = lambda path: as_text(F.get_json_object(payload, f"$.{path}"))
    field = at("markdown")
    markdown = F.when(_is_object(field), F.coalesce(at("markdown.fit_markdown"), at("markdown.raw_markdown"))).otherwise(field)
    markdown = F.coalesce(markdown, at("fit_markdown"), at("raw_markdown"))
    raw_html = F.coalesce(at("cleaned_html"), at("html"))
    true = lambda name: ~F.coalesce(F.get_json_object(payload, f"$.{name}"), F.lit("")).isin("", "false", "0", "null", "[]", "{}")
    return F.struct(
        F.coalesce(markdown, at("content"), at("text"), raw_html).alias("content"), markdown.alias("markdown"), at("title").alias("title"), raw_html.alias("raw_html"), (true("partial") | true("is_partial")).alias("partial")
    )


def select_format(content: Column, markdown: Column, html: Column, form: Column) -> Column:
    """html or else content; content; or markdown or else content. Empty counts as none."""
    some = lambda c: F.nullif(c, F.lit(""))
    return F.when(form == "html", F.coalesce(some(html), content)).when(form == "text", content).otherwise(F.coalesce(some(markdown), content))


def extract(body: Column) -> Column:
    """fields() of the payload of an answer."""
    return let(result_payload(body), fields)
