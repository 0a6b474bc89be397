"""Scores of items against a query, as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


# Parameters, weights and the authority of sources.
K1, B = 1.5, 0.75
WEIGHTS = {"title": 0.40, "content": 0.30, "url": 0.10, "authority": 0.15, "position": 0.05}
AUTHORITY = {
    "google": 1.0, "bing": 0.95, "duckduckgo": 0.90, "brave": 0.88, "startpage": 0.85, "qwant": 0.83, "yahoo": 0.80,
    "baidu": 0.95, "search360": 0.85, "sogou": 0.80, "yandex": 0.85, "mojeek": 0.75,
    "wikipedia": 0.95, "wikidata": 0.90, "github": 0.92, "stackoverflow": 0.93, "unsplash": 0.85,
}
OTHER_AUTHORITY = 0.70
#: The source of merged results, of no authority of its own.
MERGED = "aggregated"


def _each(words: list[str] | Column, value: Callable[[Column], Column]) -> Column:
    """The sum of a double over the words of a query, in their order; words: a list, or a column of arrays."""
    if isinstance(words, Column):
        return F.aggregate(words, F.lit(0.0), lambda total, w: total + value(w))
    total = F.lit(0.0)
    for w in words:
        total = total + value(F.lit(w))
    return total


def bm25(tokens: Column, query: list[str] | Column, mean_length: Column) -> Column:
    """Without document frequencies; query tokens count as often as they occur; at most 1."""
    norm = F.lit(K1) * (F.lit(1.0 - B) + F.lit(B) * F.try_divide(F.size(tokens).cast("double"), mean_length))

    def one(token: Column) -> Column:
        tf = F.size(F.filter(tokens, lambda x: x == token)).cast("double")
        return tf * F.lit(K1 + 1.0) / (tf + norm)

    n = F.size(query) if isinstance(query, Column) else F.lit(len(query))
    return F.when((F.size(tokens) == 0) | (n == 0), 0.0).otherwise(F.least(F.lit(1.0), F.try_divide(_each(query, one), n * F.lit(K1 + 1.0))))


def exact_match(text: Column, query: str | Column) -> Column:
    low, q = F.lower(text), F.lower(query) if isinstance(query, Column) else F.lit(query.lower())
    return F.when(low == q, 1.0).when(F.startswith(low, q), 0.8).when(F.contains(low, q), 0.5).otherwise(0.0)


def url_relevance(url: Column, query: list[str] | Column) -> Column:
    n = F.size(query) if isinstance(query, Column) else F.lit(len(query))
    hits = _each(query, lambda w: F.contains(F.lower(url), w).cast("double"))
    return F.when(n == 0, 0.0).otherwise(F.try_divide(hits, n))


def position_score(position: Column) -> Column:
    """position: from 0."""
    return F.lit(1.0) / (F.lit(1.0) + F.log(position.cast("double") + 1.0))


def authority(engine: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in AUTHORITY.items() for x in kv])
    return F.coalesce(table[F.lower(engine)], F.lit(OTHER_AUTHORITY))


def total(title: Column, title_tokens: Column, title_mean: Column, content: Column, content_tokens: Column, content_mean: Column, url: Column, position: Column, engine: Column, query: str | Column, query_tokens: list[str] | Column) -> Column:
    t = F.least(F.lit(1.0), 0.7 * bm25(title_tokens, query_tokens, title_mean) + 0.3 * exact_match(title, query))
    c = F.least(F.lit(1.0), 0.8 * bm25(content_tokens, query_tokens, content_mean) + 0.2 * exact_match(content, query))
    w = WEIGHTS
    s = w["title"] * t + w["content"] * c + w["url"] * url_relevance(url, query_tokens) + w["authority"] * authority(engine) + w["position"] * position_score(position)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), s))


def relevance(title: Column, content: Column, url: Column, query: str) -> Column:
    """By word: 2 for a title's beginning, 1 inside, 0.5 for the content; 1.5 for the query as it is in the URL."""
    t, c, score = F.lower(title), F.lower(content), F.lit(0.0)
    for term in query.lower().split():
        score = score + F.when(F.startswith(t, F.lit(term)), 2.0).when(F.contains(t, F.lit(term)), 1.0).otherwise(0.0) + F.when(F.contains(c, F.lit(term)), 0.5).otherwise(0.0)
    return score + F.when(F.contains(F.lower(url), F.lit(query)), 1.5).otherwise(0.0)


def freshness(published: Column, now: Column) -> Column:
    days = F.floor((F.unix_timestamp(now) - F.unix_timestamp(published)) / 86400)
    return F.when(published.isNull(), 0.0).when(days < 7, 1.0).when(days < 30, 0.5).when(days < 365, 0.2).otherwise(0.0)


def combined(relevance_: Column, score: Column, freshness_: Column) -> Column:
    return relevance_ * 0.6 + score * 0.3 + freshness_ * 0.1


def keyword_rescore(score: Column, title: Column, content: Column, query: str) -> Column:
    for k in query.lower().split():
        score = score + F.when(F.contains(F.lower(title), F.lit(k)), 0.3).otherwise(0.0) + F.when(F.contains(F.lower(content), F.lit(k)), 0.1).otherwise(0.0)
    return F.least(score, F.lit(1.0))


def occurrences(text: Column, word: str) -> Column:
    """How often a word that is not empty stands in a text, without overlap."""
    return (F.length(text) - F.length(F.replace(text, F.lit(word), F.lit("")))) / len(word)


def feed_score(title: Column, description: Column, keywords: list[tuple[str, float, bool]]) -> tuple[Column, Column]:
    """Score and matched keywords of a feed item; 0 and none if a required keyword is missing."""
    text = F.concat(F.lower(title), F.lit(" "), F.lower(F.coalesce(description, F.lit(""))))
    score, matched, missing = F.lit(0.0), F.array().cast("array<string>"), F.lit(False)
    for word, weight, required in keywords:
        low = word.lower()
        hit = F.contains(text, F.lit(low))
        gain = weight * (1.0 + F.log(F.greatest(F.lit(1.0), occurrences(text, low)))) if low else F.lit(weight)
        score = score + F.when(hit, gain).otherwise(0.0)
        matched = F.when(hit, F.concat(matched, F.array(F.lit(word)))).otherwise(matched)
        if required:
            missing = missing | ~hit
    return F.when(missing, 0.0).otherwise(score), F.when(missing, F.array().cast("array<string>")).otherwise(matched)


def clamp_weight(weight: float) -> float:
    return min(10.0, max(1.0, weight))


def keyword_list(specs: list[str]) -> list[tuple[str, float, bool]]:
    """``word:weight`` specifications; no or no valid weight: 5."""
    out = []
    for s in specs:
        word, _, weight = s.partition(":")
        try:
            out.append((word.strip(), clamp_weight(float(weight)), False))
        except ValueError:
            out.append((word.strip(), 5.0, False))
    return out


def keyword_spec(spec: Column) -> Column:
    """word and weight of a ``word:weight`` specification, as keyword_list has them."""
    told = F.trim(F.when(F.contains(spec, F.lit(":")), F.regexp_extract(spec, r"(?s)^[^:]*:(.*)$", 1)))
    number = F.when(told.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), told).try_cast("double")
    weight = F.when(number.isNotNull(), F.least(F.lit(10.0), F.greatest(F.lit(1.0), number)))
    return F.struct(F.trim(F.substring_index(spec, ":", 1)).alias("word"), F.coalesce(weight, F.lit(5.0)).alias("weight"))


def words(query: str) -> list[str]:
    import re

    return [w for w in re.split(r"[^\w]+", query.lower()) if w]


