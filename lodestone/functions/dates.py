"""Dates as search results give them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let


def parse_date(raw: Column) -> Column:
    """A timestamp from the usual written forms; null for what is none of them, for blank and for null. Without a zone it is in the session's.

    Forms: ISO 8601 (also with slashes or without dashes), day and month by name in either order with a weekday, a
    time and a zone or without, and month/day/year. A form is tried only where its shape is found.
    """
    said = F.regexp_replace(F.trim(raw), r"^(?i)(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*,?\s+", "")
    said = F.regexp_replace(F.regexp_replace(said, r"(?i)\s+(?:gmt|utc|z)$", ""), r"(\d)(?i:st|nd|rd|th)\b", "$1")
    shape = lambda c, pattern, made, form: F.when(c.rlike(pattern), F.try_to_timestamp(made, F.lit(form)))

    def found(c: Column) -> Column:
        clock = r"( \d{1,2}:\d{2}(:\d{2}( [+-]\d{4})?)?)?$"
        short = lambda n: F.regexp_replace(c, r"([A-Za-z]{3})[a-z]*\.?", "$1") if n == 1 else F.regexp_replace(F.regexp_replace(c, r"^([A-Za-z]{3})[a-z]*\.?", "$1"), ",", "")
        return F.coalesce(
            F.when(c.rlike(r"^\d{4}[-/]\d{1,2}[-/]\d{1,2}([T ]\d|$)"), F.replace(c, F.lit("/"), F.lit("-")).try_cast("timestamp")),
            shape(c, r"^\d{8}$", c, "yyyyMMdd"),
            shape(c, r"^\d{1,2} [A-Za-z]{3,9}\.? \d{4}" + clock, short(1), "d MMM yyyy[ H:mm[:ss[ XX]]]"),
            shape(c, r"^[A-Za-z]{3,9}\.? \d{1,2},? \d{4}" + clock, short(2), "MMM d yyyy[ H:mm[:ss[ XX]]]"),
            shape(c, r"^\d{1,2}/\d{1,2}/\d{4}" + clock, c, "M/d/yyyy[ H:mm[:ss[ XX]]]"),
        )

    return let(said, found)
