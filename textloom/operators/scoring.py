"""From findings to penalties, scores and verdicts. Sums are map-side combinable; nothing is collected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import locales as L
from ..functions import text as T


def weight(severity: Column) -> Column:
    out = F.lit(0)
    for s, w in L.WEIGHTS.items():
        out = F.when(severity == s, w).otherwise(out)
    return out.cast("long")


def penalty(raw: Column, words: Column, floor: int = L.WORDS_FLOOR) -> Column:
    return T.round_half_up(raw * F.lit(100.0) / F.greatest(words, F.lit(floor)), 2)


def score(p: Column) -> Column:
    return T.round_half_up(F.greatest(F.lit(0.0), F.lit(100.0) - p), 2)


def verdict(status: Column, validated: Column, quality: Column, criticals: Column, majors: Column, opened: Column, reasons: Column, legal: Column, notes: Column, threshold: float = L.PASS) -> Column:
    """The ladder: a segment that wasn't made or has an open critical finding fails; what people must see; notes; pass."""
    return (
        F.when(status != "OK", "FAIL")
        .when(~validated, "HUMAN_REVIEW")
        .when((criticals > 0) | (quality < threshold), "FAIL")
        .when(legal | (reasons > 0) | (majors > 0), "HUMAN_REVIEW")
        .when((opened > 0) | notes, "PASS_WITH_NOTES")
        .otherwise("PASS")
    )


def worst(c: Column) -> Column:
    """Aggregate: the worst verdict of a group."""
    rank = F.array_position(F.array(*(F.lit(v) for v in L.VERDICTS)), c)
    return F.element_at(F.array(*(F.lit(v) for v in L.VERDICTS)), F.min(rank).cast("int"))


def segment_scores(findings: DataFrame, keys: list[str], words: str = "words") -> DataFrame:
    """findings (keys…, words, severity or null) to one row a segment: counts, raw weight, penalty, score."""
    n = lambda s: F.count_if(F.col("severity") == s).alias(f"n_{s}")
    rows = findings.groupBy(*keys).agg(F.max(words).alias("words"), F.sum(weight(F.col("severity"))).alias("raw"), *(n(s) for s in L.WEIGHTS))
    p = penalty(F.col("raw"), F.col("words"))
    return rows.withColumn("penalty", p).withColumn("score", score(p))


def locale_scores(segments: DataFrame, keys: list[str]) -> DataFrame:
    """Segment rows (raw, words, verdict) to locales: weights and words are summed and normalised again, not averaged."""
    rows = segments.groupBy(*keys).agg(F.sum("raw").alias("raw"), F.sum("words").alias("words"), worst(F.col("verdict")).alias("verdict"), F.count("*").alias("segments"))
    p = penalty(F.col("raw"), F.col("words"))
    return rows.withColumn("penalty", p).withColumn("score", score(p))
