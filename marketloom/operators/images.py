"""Which stored picture shows an offer: scores of its title against the offer's, and the least that each kind of picture needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.functions.text import fold, once_each, pack_size_key

#: Verified pictures of good quality may be less alike than any other; verified ones rank higher.
LEAST_VERIFIED, LEAST_OTHER, GOOD_QUALITY, VERIFIED_BONUS = 0.72, 0.84, 70, 0.08


def _words(text: Column, least: int) -> Column:
    return F.array_distinct(F.filter(F.split(fold(text), " "), lambda w: F.length(w) >= least))


def lexical_score(left: Column, right: Column) -> Column:
    """A struct of ``score`` (0 to 1), ``common`` words and ``viable``: worth looking at.

    Containment in the smaller set counts 0.58 and Jaccard similarity 0.22; an
    equal pack size adds 0.16, a different one takes 0.18, and a shared word of
    five letters adds 0.08.
    """
    a, b = _words(left, 2), _words(right, 2)
    shared = F.array_intersect(a, b)
    common = F.size(shared)
    p, q = pack_size_key(left), pack_size_key(right)
    same, differs = F.coalesce(p == q, F.lit(False)), F.coalesce(p != q, F.lit(False))
    long = F.exists(shared, lambda w: F.length(w) >= 5)
    raw = common / F.least(F.size(a), F.size(b)) * 0.58 + common / F.size(F.array_union(a, b)) * 0.22 + F.when(same, 0.16).otherwise(0.0) + F.when(long, 0.08).otherwise(0.0) - F.when(differs, 0.18).otherwise(0.0)
    empty = F.coalesce((F.size(a) == 0) | (F.size(b) == 0), F.lit(True)) | left.isNull() | right.isNull()
    score = F.when(empty, 0.0).otherwise(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)), 6))
    count = F.when(empty, 0).otherwise(common)
    viable = (count >= 2) | ((count >= 1) & (same | (score >= 0.48)))
    return F.struct(score.alias("score"), count.alias("common"), viable.alias("viable"))


def lexical_scores(rows: DataFrame, left: Column, right: Column, names: list[str]) -> DataFrame:
    """``rows`` with ``m``, the :func:`lexical_score` of two texts made of the columns ``names``, which are compared once for each different pair."""
    return once_each(rows, names, lambda texts: texts.withColumn("m", lexical_score(left, right)))


def title_score(left: Column, right: Column) -> Column:
    """Coverage of the smaller set of words of three letters (0.72) and their Jaccard similarity (0.28)."""
    a, b = _words(left, 3), _words(right, 3)
    common = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.round(common / F.least(F.size(a), F.size(b)) * 0.72 + common / F.size(F.array_union(a, b)) * 0.28, 6)).otherwise(0.0)


def best_pictures(offers: DataFrame, pictures: DataFrame) -> DataFrame:
    """``offer_id``, ``url`` and ``score`` of the best picture (``url``, ``title``, ``verified``, ``quality``) that is alike enough.

    Offers and pictures meet by a shared word of their titles; each pair is
    scored once, and the best is kept by a partial maximum.
    """
    words = lambda rows, title: rows.withColumn("word", F.explode(_words(F.col(title), 3)))
    named = pictures.select("url", F.col("title").alias("picture"), "verified", "quality").where(F.col("url").rlike("(?i)^https://"))
    titles = offers.select("title").distinct()
    pairs = words(titles, "title").join(words(named, "picture"), "word").drop("word").distinct()
    score = title_score(F.col("title"), F.col("picture"))
    least = F.when(F.col("verified") & (F.col("quality") >= GOOD_QUALITY), LEAST_VERIFIED).otherwise(LEAST_OTHER)
    fit = pairs.withColumn("raw", score).where(F.col("raw") >= least)
    ranked = fit.withColumn("score", F.round(F.least(F.lit(1.0), F.col("raw") + F.when(F.col("verified"), VERIFIED_BONUS).otherwise(0.0)), 6))
    best = ranked.groupBy("title").agg(F.max_by(F.struct("url", "score"), F.struct("score", "url")).alias("b"))
    return offers.join(best, "title").select("offer_id", "b.url", "b.score")
