"""Numbers: confidence scales, scores, cosine, hash vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words for confidence and their place on the scale of 1 to 5, in the four dialects.
LABELS = {
    "connect": {"low": 2, "medium": 3, "high": 4, "very_high": 5, "veryhigh": 5, "very high": 5, "low_to_medium": 2, "moderate": 3, "very low": 1},
    "detect": {"very_low": 1, "low": 2, "medium": 3, "moderate": 3, "high": 4, "very_high": 5, "veryhigh": 5, "very high": 5},
    "migrate": {"very_low": 1, "low": 2, "speculative": 2, "low_to_medium": 2, "medium": 3, "moderate": 3, "likely": 3, "high": 4, "derived": 5, "very_high": 5},
    "export": {},
}


def confidence(x: Column, dialect: str = "connect", fallback: int = 0) -> Column:
    """A word or number as an integer from 1 to 5; what is neither, the fallback."""
    low = F.lower(F.trim(x.cast("string")))
    if dialect == "migrate":
        low = F.regexp_replace(low, "[ -]+", "_")
    labels = [v for pair in LABELS[dialect].items() for v in pair]
    known = F.try_element_at(F.create_map(*map(F.lit, labels)), low) if labels else F.lit(None).cast("int")
    number = low.try_cast("double")
    number = F.when(~F.isnan(number) & (F.abs(number) < 1e9), number.cast("int"))
    placed = F.when(number.isNotNull(), F.least(F.lit(5), F.greatest(F.lit(1), number)))
    return F.coalesce(known, placed, F.lit(fallback))


def penalised(raw: Column, crossing: Column) -> Column:
    return F.when(crossing, F.greatest(F.lit(1), raw - 1)).otherwise(raw)


def score(conf: Column, novelty: Column) -> Column:
    return conf * F.when(novelty == "non-obvious", 2.0).when(novelty == "speculative", 0.5).otherwise(1.0)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector has no length."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def hash_vector(x: Column) -> Column:
    """A vector of 32 from the bytes of a SHA-256; tiled or not, its cosines are the same."""
    digest = F.sha2(x.cast("binary"), 256)
    return F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.conv(F.substr(digest, i * 2 + 1, F.lit(2)), 16, 10).cast("double") / 255 - 0.5)


def domain_confidence(top: Column, second: Column) -> Column:
    """From the two best scores, the second null or 0 where there is one; null or 0 for both: nothing matched."""
    top, second = F.coalesce(top, F.lit(0.0)), F.coalesce(second, F.lit(0.0))
    weak = F.bround(F.greatest(F.lit(0.15), 0.25 + top * 0.20), 3)
    strong = F.least(F.lit(0.98), 0.45 + F.least(top / 2.4, F.lit(1.0)) * 0.45 + F.least(top - second, F.lit(1.2)) * 0.12)
    return F.when(top <= 0, 0.15).when(top < 0.60, weak).otherwise(F.bround(strong, 3))


def item_budget(pages: Column, depth: Column, multipliers: dict) -> Column:
    times = F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for kv in multipliers.items() for v in kv]), depth), F.lit(multipliers[max(multipliers)]))
    return F.greatest(F.lit(1), F.when(pages > 0, pages).otherwise(12) * times)
