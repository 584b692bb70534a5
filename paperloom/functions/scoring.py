"""Scoring functions as Column expressions.

Rounding to four digits is floor(x * 10000 + 0.5) / 10000 in every place: plain IEEE steps,
the same in any engine (the half-even rounding of exact binary values differs from it by
1e-4 on some exact ties).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Parts of the blended score.
PARTS = ("rel", "embedding", "citation", "recency", "venue", "title")
# Weights of PARTS by intent; the default is also that of `broad`.
WEIGHTS = {
    "method": (0.68, 0.12, 0.05, 0.05, 0.04, 0.06),
    "survey": (0.45, 0.10, 0.18, 0.10, 0.10, 0.07),
    "specific": (0.66, 0.12, 0.04, 0.04, 0.04, 0.10),
}
DEFAULT_WEIGHTS = (0.66, 0.12, 0.06, 0.06, 0.05, 0.05)
# Pass bars and bars of the upper tier by intent, the relevance the upper tier asks for.
THRESHOLDS, DEFAULT_THRESHOLD = {"survey": 0.05, "broad": 0.05, "method": 0.15}, 0.25
TIERS, DEFAULT_TIER = {"survey": 0.45, "broad": 0.45, "related": 0.50, "method": 0.55, "dataset": 0.55, "specific": 0.60}, 0.55
MIN_RELEVANCE = 0.5
# Parts of the names of well-known venues.
TOP_VENUES = "neurips nips icml iclr cvpr iccv eccv acl emnlp naacl coling tacl aaai ijcai kdd www sigir icde mlsys tpami ijcv jmlr tkde tods tois nature science cell".split()


def round4(x: Column) -> Column:
    return F.floor(x * 10000 + 0.5).cast("double") / 10000


def clip(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def _by_intent(intent: Column, table: dict[str, float], default: float) -> Column:
    out = F.lit(default)
    for name, value in table.items():
        out = F.when(F.lower(F.trim(F.coalesce(intent, F.lit("")))) == name, F.lit(value)).otherwise(out)
    return out


def threshold(intent: Column, override: Column | None = None) -> Column:
    bar = _by_intent(intent, THRESHOLDS, DEFAULT_THRESHOLD)
    return bar if override is None else F.coalesce(override, bar)


def tier_bar(intent: Column, override: Column | None = None) -> Column:
    bar = _by_intent(intent, TIERS, DEFAULT_TIER)
    return bar if override is None else F.coalesce(override, bar)


def weight(intent: Column, part: str) -> Column:
    k = PARTS.index(part)
    return _by_intent(intent, {i: w[k] for i, w in WEIGHTS.items()}, DEFAULT_WEIGHTS[k])


def coverage(query: Column, paper: Column, title: Column) -> Column:
    """Share of the query's tokens in the paper, plus 0.15 of their share in the title, at most 1.

    0.5 without query tokens, 0 without paper tokens. All arguments are arrays of distinct tokens.
    """
    n = F.size(query).cast("double")
    share = F.size(F.array_intersect(query, paper)) / n
    bonus = F.size(F.array_intersect(query, title)) / n * F.lit(0.15)
    return F.when(n == 0, F.lit(0.5)).when(F.size(paper) == 0, F.lit(0.0)).otherwise(round4(F.least(F.lit(1.0), share + bonus)))


def title_density(query: Column, title: Column) -> Column:
    """Share of the query's tokens in the title, 0 if either has none."""
    return F.when((F.size(query) == 0) | (F.size(title) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(query, title)) / F.size(query).cast("double"))


def citation_score(count: Column, most: Column) -> Column:
    """log(1 + count) / log(1 + most), 0 if most is 0 or less."""
    return F.when(most <= 0, F.lit(0.0)).otherwise(F.log1p(F.coalesce(count, F.lit(0)).cast("double")) / F.log1p(most.cast("double")))


def recency_score(year: Column, first: Column, last: Column) -> Column:
    """Place of the year between first and last, 0.5 if unknown or if there is no span."""
    return F.when(year.isNull() | (last <= first), F.lit(0.5)).otherwise((year - first) / (last - first).cast("double"))


def venue_score(venue: Column) -> Column:
    """1 if the venue's name holds one of TOP_VENUES, else 0."""
    return F.when(F.lower(F.coalesce(venue, F.lit(""))).rlike("|".join(TOP_VENUES)), F.lit(1.0)).otherwise(F.lit(0.0))


def blend(relevance: Column, embedding: Column, citation: Column, recency: Column, venue: Column, title: Column, intent: Column) -> Column:
    """Weighted sum in [0, 1]; where the embedding is null, its weight goes to the relevance."""
    w = {p: weight(intent, p) for p in PARTS}
    rel = clip(relevance)
    first = F.when(embedding.isNull(), (w["rel"] + w["embedding"]) * rel).otherwise(w["rel"] * rel + w["embedding"] * embedding)
    return round4(clip(first + w["citation"] * citation + w["recency"] * recency + w["venue"] * venue + w["title"] * title))


def normalize(score: Column, bar: Column) -> Column:
    """Score on a scale where the bar is 0.5: 0 stays 0, 1 stays 1, linear in between; the score itself if there is no bar."""
    s, t = clip(score), clip(bar)
    above = round4(0.5 + 0.5 * (s - t) / F.greatest(F.lit(1e-9), 1.0 - t))
    return F.when(s <= 0, F.lit(0.0)).when(t <= 0, round4(s)).when(s >= t, above).otherwise(round4(0.5 * s / F.when(t > 0, t)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in [0, 1]; 0 if a vector is null, empty or zero, or if the lengths differ."""
    x, y = a.cast("array<double>"), b.cast("array<double>")

    def total(v: Column) -> Column:
        return F.aggregate(v, F.lit(0.0), lambda s, e: s + e)

    dot = total(F.zip_with(x, y, lambda p, q: p * q))
    norm = F.sqrt(total(F.transform(x, lambda p: p * p))) * F.sqrt(total(F.transform(y, lambda p: p * p)))
    return F.when((F.size(x) > 0) & (F.size(x) == F.size(y)) & (norm > 0), F.coalesce(clip(dot / F.when(norm > 0, norm)), F.lit(0.0))).otherwise(F.lit(0.0))


def relevance_of(features: Column) -> Column:
    """The first of the features relevance, llm, keyword_coverage and filter; 1 if there is none."""
    return F.coalesce(*[F.try_element_at(features, F.lit(k)) for k in ("relevance", "llm", "keyword_coverage", "filter")], F.lit(1.0))


def tier(score: Column, relevance: Column, bar: Column) -> Column:
    return F.when((score >= bar) & (relevance >= MIN_RELEVANCE), F.lit("highly_relevant")).otherwise(F.lit("partially_relevant"))


def concurrency_schedule(n: Column) -> Column:
    """Numbers of parallel calls to try, one after the other: those of 32, 16, 8, 4 and 1 up to n, at least 1."""
    return F.filter(F.array(*[F.lit(x) for x in (32, 16, 8, 4, 1)]), lambda x: (x <= n) | (x == 1))
