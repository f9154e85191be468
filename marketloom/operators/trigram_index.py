"""A stored inverted index of trigrams, for similarity, containment and joins of texts.

Each distinct text has its trigrams in order of rarity, the rarest first. Two
sets of at least a wanted similarity share one of their first few, so a lookup
reads only the postings of a query's first trigrams, and of those only the ones
that stand among the first of their text and whose size fits. Postings are
stored by bucket of their trigram; a lookup reads the buckets of its trigrams.
Containment asks for the rarest trigram that lies inside the searched text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketloom.functions.text import similarity_permille, trigrams

BUCKETS = 64
#: Texts of one block of :func:`similar_pairs`; a task compares two blocks.
BLOCK = 1000
#: Its cells are dealt to so many tasks at most.
CELLS = 1000
#: Pieces that are counted at once there.
PIECES = 2048


@dataclass(frozen=True)
class TrigramIndex:
    """Where an index lies: ``pieces`` (piece, in how many texts) and ``postings`` (bucket, piece, text, size, place)."""

    spark: SparkSession
    root: str

    @property
    def pieces(self) -> DataFrame:
        return self.spark.read.schema("piece string, texts long").parquet(f"{self.root}/pieces")

    @property
    def postings(self) -> DataFrame:
        return self.spark.read.schema("piece string, text string, size int, place int, bucket int").parquet(f"{self.root}/postings")

    @property
    def texts(self) -> DataFrame:
        return self.spark.read.schema("text string").parquet(f"{self.root}/texts")


def _bucket(piece: str) -> Column:
    return F.pmod(F.xxhash64(piece), F.lit(BUCKETS)).cast("int")


def _by_rarity(sets: DataFrame, pieces: DataFrame, key: str) -> DataFrame:
    """``key``, ``piece``, ``size`` and ``place`` of the pieces of each set; unknown pieces are the rarest."""
    each = sets.select(key, F.size("set").alias("size"), F.explode("set").alias("piece"))
    known = each.join(pieces, "piece", "left").withColumn("texts", F.coalesce("texts", F.lit(0)))
    w = Window.partitionBy(key).orderBy("texts", "piece")
    return known.select(key, "piece", "size", (F.row_number().over(w) - 1).alias("place"))


def build(texts: DataFrame, root: str) -> TrigramIndex:
    """Index the distinct folded ``text`` of ``texts`` below ``root``, a new folder."""
    spark = texts.sparkSession
    texts.select("text").where("text is not null").distinct().write.parquet(f"{root}/texts")
    index = TrigramIndex(spark, root)
    sets = index.texts.select("text", trigrams(F.col("text")).alias("set"))
    counted = sets.select(F.explode("set").alias("piece")).groupBy("piece").agg(F.count("*").alias("texts"))
    counted.write.parquet(f"{root}/pieces")
    placed = _by_rarity(sets, index.pieces, "text").withColumn("bucket", _bucket("piece"))
    placed.select("piece", "text", "size", "place", "bucket").repartition("bucket", F.pmod(F.xxhash64("text"), F.lit(8))).write.partitionBy("bucket").parquet(f"{root}/postings")
    return index


def _first(size: str, permille: int) -> Column:
    """How many of the first pieces of a set must be looked at: all but as many as a similar set shares, and one."""
    return F.col(size) - F.ceil(F.col(size) * permille / 1000).cast("int") + 1


def candidates(index: TrigramIndex, queries: DataFrame, permille: int) -> DataFrame:
    """``query`` and ``text`` that may be similar: a shared piece among the first of both, sizes that allow it."""
    wanted = queries.select("query").distinct().select("query", trigrams(F.col("query")).alias("set"))
    asked = _by_rarity(wanted, index.pieces, "query").where(F.col("place") < _first("size", permille))
    asked = asked.select("query", "piece", F.col("size").alias("asked"), _bucket("piece").alias("bucket"))
    held = index.postings.where(F.col("place") < _first("size", permille))
    fits = (F.col("size") * 1000 >= F.col("asked") * permille) & (F.col("asked") * 1000 >= F.col("size") * permille)
    return held.join(asked, ["bucket", "piece"]).where(fits).select("query", "text").distinct()


def similar(index: TrigramIndex, queries: DataFrame, permille: int) -> DataFrame:
    """``query``, ``text`` and ``permille`` of all texts at least so similar to a query (folded texts)."""
    alike = similarity_permille(trigrams(F.col("query")), trigrams(F.col("text")))
    return candidates(index, queries, permille).withColumn("permille", alike).where(F.col("permille") >= permille)


def _alike(rows: pd.DataFrame, permille: int) -> pd.DataFrame:
    """Pairs of one cell (``x``, ``y``, ``block``, ``text``, ``set``) at least so similar; shared pieces by products of 0/1 matrices."""
    own = rows["x"].iat[0] == rows["y"].iat[0]
    rows = rows.reset_index(drop=True)
    codes, known = pd.factorize(rows["set"].explode())
    sizes = rows["set"].map(len).to_numpy()
    at = np.repeat(np.arange(len(rows)), sizes)
    codes = codes[codes >= 0]  # an empty set explodes into a null
    left = np.flatnonzero(rows["block"] == rows["x"])
    right = left if own else np.flatnonzero(rows["block"] == rows["y"])
    shared = np.zeros((len(left), len(right)), np.float32)
    for start in range(0, len(known), PIECES):
        here = (codes >= start) & (codes < start + PIECES)
        holds = np.zeros((len(rows), min(PIECES, len(known) - start)), np.float32)
        holds[at[here], codes[here] - start] = 1
        shared += holds[left] @ holds[right].T
    both = shared.astype(np.int64)
    every = sizes[left][:, None] + sizes[right][None, :] - both
    value = both * 1000 // np.maximum(every, 1)
    wanted = value >= permille
    if own:
        wanted &= np.triu(np.ones_like(wanted), 1)
    i, j = np.nonzero(wanted)
    texts = rows["text"].to_numpy()
    a, b = texts[left[i]], texts[right[j]]
    first = np.array([p < q for p, q in zip(a, b)], bool)
    return pd.DataFrame({"query": np.where(first, a, b), "text": np.where(first, b, a), "permille": value[i, j]})


def similar_pairs(texts: DataFrame, permille: int, block: int = BLOCK) -> DataFrame:
    """``query`` < ``text`` and ``permille`` of all pairs of the distinct ``text`` at least so similar, each once.

    For a low similarity, where nearly all pairs share a piece and postings
    meet many times over: the texts are dealt into blocks, and each two blocks
    are compared in one cell. All pairs are looked at, so time grows with the
    square; a task's memory does not grow.
    """
    n = -(-texts.count() // block) or 1
    held = texts.select("text", trigrams(F.col("text")).alias("set"), F.pmod(F.xxhash64("text"), F.lit(n)).alias("block"))
    held = held.repartition(min(n, CELLS), "text")  # a task makes copies of about one block only
    each = held.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    cells = each.select(F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "text", "set")
    dealt = cells.repartition(min(n * (n + 1) // 2, CELLS), "x", "y")  # a number of its own: cells have little to read and much to do
    return dealt.groupBy("x", "y").applyInPandas(lambda rows: _alike(rows, permille), "query string, text string, permille long")


def containing(index: TrigramIndex, queries: DataFrame) -> DataFrame:
    """``query`` and ``text`` of all texts that contain a query as it stands (both folded).

    Any word's inner trigrams must be in the text's set; the rarest of them is
    looked up. A query without a word of three letters is compared with every
    distinct text.
    """
    inner = F.flatten(F.transform(F.filter(F.split("query", " "), lambda w: F.length(w) >= 3), lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3)))))
    asked = queries.select("query").distinct().withColumn("set", F.array_distinct(inner))
    rare = _by_rarity(asked.where(F.size("set") > 0), index.pieces, "query").where("place = 0").select("query", "piece", _bucket("piece").alias("bucket"))
    found = index.postings.join(rare, ["bucket", "piece"]).where(F.contains("text", "query")).select("query", "text")
    short = asked.where(F.size("set") == 0).select("query")
    return found.unionByName(index.texts.join(short, F.contains("text", "query")).select("query", "text"))
