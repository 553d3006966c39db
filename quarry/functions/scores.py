"""Score columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
SECTION_WEIGHTS = {
    "abstract": 1.15,
    "introduction": 1.0,
    "related_work": 0.95,
    "method": 1.2,
    "experiments": 1.15,
    "results": 1.25,
    "limitations": 1.35,
    "future_work": 1.25,
    "discussion": 1.1,
    "conclusion": 1.0,
    "body": 1.0,
}
STRONG_VENUES = "cvpr|iccv|eccv|neurips|icml|tpami"
NEGATIONS = ("no", "not", "never", "without", "none", "cannot", "dont")


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def nearest(x: Column, places: int) -> Column:
    """x at so many places, by the product with their power as a double; Spark's round() goes by the shortest decimal that names the double."""
    return F.round(x * 10.0**places) / 10.0**places


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def bm25(weight: Column, tf: Column, length: Column, mean: Column, k1: float = 1.5, b: float = 0.75) -> Column:
    return weight * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean))


def section_weight(section: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for pair in SECTION_WEIGHTS.items() for x in pair])[section], F.lit(1.0))


def metadata_prior(year: Column, venue: Column, citation_count: Column, this_year: int) -> Column:
    age = F.greatest(F.lit(0), F.lit(this_year) - year)
    by_year = F.when(year.isNull(), 1.0).otherwise(F.greatest(F.lit(0.85), F.lit(1.10) - F.least(age, F.lit(12)) * 0.015))
    by_venue = F.when(F.lower(venue).rlike(STRONG_VENUES), 1.08).otherwise(1.0)
    return by_year * by_venue * (1 + F.least(F.lit(0.20), F.log1p(F.greatest(citation_count, F.lit(0))) / 30))


def blend(score: Column, prior: Column, weight: float = 0.2) -> Column:
    return score * (1 + weight * (prior - 1))


def quality_prior(quality: Column, weight: float = 0.15) -> Column:
    return F.when(quality.isNull(), 1.0).otherwise(1 - weight * (1 - clamp(quality)))


def dot(x: Column, y: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, v: s + v)


def contradiction(a: Column, b: Column) -> Column:
    """Of two token sets: 0.65 for negation in one only plus 0.35 * Jaccard, 0 under a Jaccard of 0.3."""
    negated = lambda t: F.arrays_overlap(t, F.array(*[F.lit(w) for w in NEGATIONS]))
    jaccard = F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.size(F.array_union(a, b)))
    score = F.round(clamp(0.65 * (negated(a) != negated(b)).cast("double") + 0.35 * jaccard), 4)
    return F.when((F.size(a) == 0) | (F.size(b) == 0) | (jaccard < 0.3), 0.0).otherwise(score)
