"""Deduplication, relevance and rank of results; every statistic is that of one query's candidates."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dims, scoring, text, urls
from ..sources.shared import numbered, scratch


def merge_exact(results: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each canonical url: the first one's columns, engines in order of arrival, the longest snippet, the sum of scores."""
    first = lambda c: F.min_by(c, "rank").alias(c)
    kept = [c for c in results.columns if c not in {*keys, "rank", "engines", "snippet", "score"}]
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", "engines"))), lambda x: x["engines"])
    return results.groupBy(*keys).agg(
        F.min("rank").alias("rank"), *[first(c) for c in kept], F.array_distinct(F.flatten(ordered)).alias("engines"), F.max_by("snippet", F.struct(F.length("snippet"), -F.col("rank"))).alias("snippet"), F.sum("score").alias("score")
    )


def _alike(new: str, old: str, threshold: float) -> bool:
    """Whether the titles' ratio reaches the threshold; lengths, then letters, bound it from above at less cost."""
    both = len(new) + len(old)
    if both and 2 * min(len(new), len(old)) / both < threshold:
        return False
    match = SequenceMatcher(None, new, old)
    return match.quick_ratio() >= threshold and match.ratio() >= threshold


def _fuzzy(threshold: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        kept: list[dict] = []
        by_url: dict[str, dict] = {}
        for row in pdf.sort_values("rank").to_dict("records"):
            title = (row["title"] or "").lower()
            into = by_url.get(row["url"]) or next((k for k in kept if _alike(title, (k["title"] or "").lower(), threshold)), None)
            if into is None:
                kept.append(row | {"engines": list(dict.fromkeys(row["engines"]))})
                by_url[row["url"]] = kept[-1]
                continue
            into["engines"] = list(dict.fromkeys([*into["engines"], *row["engines"]]))
            into["score"] += row["score"]
            if len(row["snippet"] or "") > len(into["snippet"] or ""):
                into["snippet"] = row["snippet"]
        for row in kept:  # pandas reads a missing time as one of its own
            row.update({c: None for c, v in row.items() if v is pd.NaT})
        return pd.DataFrame(kept, columns=pdf.columns)

    return run


def merge_fuzzy(results: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Greedy, in order of rank, within one query's results (a few pages of a search, so a group is small): same url, or a title as alike as the threshold."""
    return results.groupBy("query_id").applyInPandas(_fuzzy(threshold), results.schema)


def gate(results: DataFrame, lang: str = "en", tokenizer=None) -> DataFrame:
    """Rows that share a token with their query; penalty 0.3 where the share is small for the query's length. Adds overlap, n_query, penalty, tokens.

    tokenizer: from a text column to its distinct tokens, in place of the language's own.
    """
    cut = tokenizer or (text.tokens_zh if lang.startswith("zh") else text.tokens)
    held = results.withColumn("query_tokens", cut(F.col("q"))).withColumn("tokens", cut(F.concat_ws(" ", "title", "snippet")))
    held = held.withColumn("overlap", F.size(F.array_intersect("query_tokens", "tokens"))).withColumn("n_query", F.size("query_tokens")).filter("overlap > 0")
    least = F.when(F.col("n_query") <= 2, 0.0).when(F.col("n_query") <= 5, 0.1).otherwise(0.15)
    return held.withColumn("penalty", F.when((F.col("n_query") > 2) & (F.col("overlap") / F.col("n_query") < least), 0.3).otherwise(1.0))


def bm25(candidates: DataFrame, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> DataFrame:
    """(query_id, rank, bm25): over token sets; negative idf becomes a quarter of the mean; divided by the query's best."""
    terms = candidates.select("query_id", "rank", "query_tokens", F.size("tokens").alias("dl"), F.explode("tokens").alias("term"))
    stats = candidates.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("tokens")).alias("avgdl"))
    df = terms.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("df"), F.bool_or(F.array_contains("query_tokens", F.col("term"))).alias("asked")).join(stats, "query_id")
    idf = df.withColumn("idf", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = idf.groupBy("query_id").agg(F.avg("idf").alias("mean_idf"))
    idf = idf.filter("asked").join(mean, "query_id").withColumn("idf", F.when(F.col("idf") < 0, epsilon * F.col("mean_idf")).otherwise(F.col("idf")))
    hits = terms.filter(F.array_contains("query_tokens", F.col("term"))).join(idf, ["query_id", "term"])
    one = F.col("idf") * (k1 + 1) / (1 + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    raw = hits.groupBy("query_id", "rank").agg(F.sum(one).alias("raw"))
    best = raw.groupBy("query_id").agg(F.max("raw").alias("_best"))
    return raw.join(best, "query_id").select("query_id", "rank", F.when(F.col("_best") > 0, F.col("raw") / F.col("_best")).otherwise(F.col("raw")).alias("bm25"))


def tfidf(candidates: DataFrame, stop_words: list[str] = dims.EN_STOP_WORDS, vocabulary: int = 5000) -> DataFrame:
    """(query_id, rank, cosine) of candidates and their query, fitted on both; words of two characters or more."""
    cut = lambda c: F.filter(F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0)), lambda w: ~w.isin(stop_words))
    docs = candidates.select("query_id", "rank", cut(F.concat_ws(" ", "title", "snippet")).alias("words"))
    asked = candidates.groupBy("query_id").agg(F.first("q").alias("q")).select("query_id", F.lit(-1).cast(docs.schema["rank"].dataType).alias("rank"), cut(F.col("q")).alias("words"))
    tf = docs.union(asked).select("query_id", "rank", F.explode("words").alias("term")).groupBy("query_id", "rank", "term").agg(F.count(F.lit(1)).alias("tf"))
    n = candidates.groupBy("query_id").agg((F.count(F.lit(1)) + 1).alias("n"))
    df = tf.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))
    # The most frequent terms of each part of a query's terms, then of those.
    most = [F.desc("cf"), "term"]
    df = df.withColumn("part", F.pmod(F.xxhash64("term"), F.lit(64))).withColumn("place", F.row_number().over(Window.partitionBy("query_id", "part").orderBy(*most))).filter(F.col("place") <= vocabulary)
    df = df.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(*most))).filter(F.col("place") <= vocabulary).drop("part").join(n, "query_id")
    w = tf.join(df, ["query_id", "term"]).withColumn("w", F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    norm = w.groupBy("query_id", "rank").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    q = w.filter("rank = -1").select("query_id", "term", F.col("w").alias("qw"))
    dot = w.filter("rank >= 0").join(q, ["query_id", "term"]).groupBy("query_id", "rank").agg(F.sum(F.col("w") * F.col("qw")).alias("dot"))
    qn = norm.filter("rank = -1").select("query_id", F.col("norm").alias("qnorm"))
    return dot.join(norm, ["query_id", "rank"]).join(qn, "query_id").select("query_id", "rank", (F.col("dot") / F.col("norm") / F.col("qnorm")).alias("cosine"))


def rank(candidates: DataFrame, as_of: str, lang: str = "en", freshness: str = "any", k: int | None = None, weights: dict[str, float] = dims.WEIGHTS) -> DataFrame:
    """The candidates with their hybrid score and place, best first (ties in order of arrival), at most k for each query.

    The candidates are written once, as the statistics read them again and again. Without k all rows are numbered, by
    range, so that a query with a third of them spreads over many tasks.
    """
    held = scratch(candidates, "candidates")
    scored = held.join(bm25(held), ["query_id", "rank"], "left").join(tfidf(held), ["query_id", "rank"], "left")
    place = urls.domain(F.col("url"))
    score = scoring.hybrid(
        F.coalesce("bm25", F.lit(0.0)), F.coalesce("cosine", F.lit(0.0)), scoring.quality(place, lang), scoring.snippet_factor(F.col("snippet")),
        scoring.freshness(F.col("parsed_date"), F.lit(as_of).cast("timestamp"), freshness), scoring.language(place, F.col("snippet"), lang), scoring.engine_bonus(F.col("engines")), F.col("penalty"), weights,
    )
    scored = scored.withColumn("score", score)
    if k:
        return scored.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "rank"))).filter(F.col("place") <= k)
    ranked = numbered(scored.withColumn("_less", -F.col("score")), ["query_id"], ["_less", "rank"], "place").drop("_less")
    return ranked.withColumn("place", (F.col("place") + 1).cast("int"))
