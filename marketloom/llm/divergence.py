"""How the sources of a language differ in the terms they use.

Terms are counted in one pass over the texts, within batches first. Each
language keeps the terms of at least ``LEAST_DOCS`` of its documents. A source's
share of a term is ``p = 1 + floor(10^9 (count + 1) / (N + V))``; two sources
differ by the sum of ``floor((p - q)^2 / q)`` over all kept terms.

The sums are split by how many sources use a term. All terms together start from
what two sources without any of them would differ by, once for each term. A
*heavy* term, in more than ``LIGHT`` sources, is corrected in dense tiles: a
block of terms by two blocks of sources, all pairs at once in numpy. A *light*
term is corrected sparsely: once for each of its postings against every source
that lacks it, which only depends on the posting's share and so is summed by
equal shares, and once for each pair of its at most ``LIGHT`` postings. Sums are
whole numbers, so the parts add up exactly. A sum of differences stays below
``(10^9 + 1)(10^9 + V)``, and so in a long for up to a billion terms.

Defined cases: null text, lang and source are empty strings; a text without
terms still makes its group occur; repeated rows count as documents of their
own; a language without kept terms has differences of 0 and no terms; other
columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.llm.storage import materialise, release

LEAST_DOCS = 3
TOP_TERMS = 200
WHOLE = 1_000_000_000
#: Terms of at most so many sources are corrected pair by pair of their postings.
LIGHT = 6
#: A dense tile has at most about so many terms, and twice so many sources.
TILE_TERMS, TILE_SOURCES = 4096, 256
#: Counters of a task are given out when they hold so many terms.
HELD_TERMS = 1 << 18
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: bytes) -> list[bytes]:
    """Runs of letters and of whatever is not ASCII, A-Z lower-cased."""
    return text.translate(_LOWER).split()


def counted_terms(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``lang``, ``source``, ``term``, ``n`` occurrences in ``docs`` documents; a null term for each group that occurs."""
    plain = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (lang, source, text)]
    names = ["lang", "source", "term", "n", "docs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, docs) in total.items():
                found = [None, *n]
                columns = [[lang] * len(found), [source] * len(found), found, [0, *n.values()], [0, *(docs[t] for t in n)]]
                kinds = [pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64()]
                arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
                arrays[2] = arrays[2].cast(pa.string())
                yield pa.RecordBatch.from_arrays(arrays, names)
            total.clear()

        held = 0
        for b in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                n, docs = total.setdefault((lang, source), (Counter(), Counter()))
                found = terms(text)
                before = len(n)
                n.update(found)
                docs.update(set(found))
                held += len(n) - before
                if held > HELD_TERMS:
                    yield from flush()
                    held = 0
        yield from flush()

    each = docs.select(plain[0].alias("lang"), plain[1].alias("source"), plain[2].cast("binary").alias("text"))
    partial = each.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(n: str) -> Column:
    """A share, exact at any count; ``total`` and ``kept`` are columns beside ``n``."""
    return F.expr(f"1L + cast({n} + 1 as decimal(20,0)) * {WHOLE}BD div cast(greatest(total + kept, 1L) as decimal(20,0))")


def _differ(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q}) div {q})"


def kept_terms(counted: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """Counts of terms that at least so many documents of their language have; ``spread``: in how many of its sources."""
    w = Window.partitionBy("lang", "term")
    found = counted.where("term is not null")
    every = {"in_docs": F.sum("docs").over(w), "spread": F.count("*").over(w), "lang_n": F.sum("n").over(w), "nth": F.row_number().over(w.orderBy("source"))}
    return found.withColumns(every).where(F.col("in_docs") >= least).select("lang", "source", "term", "n", "spread", "lang_n", "nth")


def group_sizes(counted: DataFrame, postings: DataFrame) -> DataFrame:
    """Each group that occurs: its number ``gid`` in its language, ``total`` occurrences, the language's ``kept`` terms and ``lang_total``, ``none``: the share of an absent term."""
    total = postings.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    of_lang = postings.groupBy("lang").agg(F.count_if(F.col("nth") == 1).alias("kept"), F.sum("n").alias("lang_total"))
    groups = counted.where("term is null").select("lang", "source").join(total, ["lang", "source"], "left").join(of_lang, "lang", "left")
    filled = groups.fillna(0, ["total", "kept", "lang_total"])
    gid = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    return filled.withColumn("gid", gid).withColumn("none", _share("0L"))


def term_part(shares: DataFrame, top: int = TOP_TERMS) -> DataFrame:
    """Of each group the ``top`` terms that it uses more than its language does."""
    of_lang = shares.withColumn("total", F.col("lang_total")).withColumn("q", _share("lang_n"))
    more = of_lang.where("p > q").select("lang", "source", F.col("term").alias("item"), F.expr(_differ("p", "q")).alias("value"))
    w = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    return more.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def _tile(frame: pd.DataFrame) -> pd.DataFrame:
    """Corrections of the pairs of a tile: its sources with the share of an absent term (kind 0), and its terms' shares."""
    head, body = frame[frame["kind"] == 0].sort_values("gid"), frame[frame["kind"] == 1]
    gids, none = head["gid"].to_numpy(), head["p"].to_numpy()
    codes, named = pd.factorize(body["term"])
    at = np.searchsorted(gids, body["gid"].to_numpy())
    share = np.tile(none, (len(named), 1))
    share[codes, at] = body["p"].to_numpy()
    a, b = int(frame["a"].iloc[0]), int(frame["b"].iloc[0])
    left = np.flatnonzero(gids // TILE_SOURCES == a)
    right = np.flatnonzero(gids // TILE_SOURCES == b)
    found = []
    for rows, columns in ((left, right), (right, left))[: 1 + (a != b)]:
        p0, q0 = none[rows][:, None], none[columns][None, :]
        total = -len(named) * ((p0 - q0) ** 2 // q0)
        chunk = max(1, (1 << 20) // max(1, total.size))
        for k in range(0, len(named), chunk):
            p, q = share[k : k + chunk, rows, None], share[k : k + chunk, None, columns]
            total += ((p - q) ** 2 // q).sum(axis=0)
        g, h = (x.ravel() for x in np.meshgrid(gids[rows], gids[columns], indexing="ij"))
        found.append(pd.DataFrame({"lang": frame["lang"].iloc[0], "g": g, "h": h, "value": total.ravel()}))
    out = pd.concat(found)
    return out[(out["g"] != out["h"]) & (out["value"] != 0)]


def dense_corrections(shares: DataFrame, sizes: DataFrame) -> DataFrame:
    """``lang``, ``g``, ``h`` and ``value`` of the tiles over ``shares`` of heavy terms.

    A tile has at most about TILE_TERMS terms, taken by hash, and two blocks of
    sources; postings go to the tiles of their block with every other one.
    """
    deals = materialise(shares.groupBy("lang").agg(F.ceil(F.approx_count_distinct("term") / TILE_TERMS).cast("int").alias("deals")))
    blocks = sizes.groupBy("lang").agg((F.floor(F.max("gid") / TILE_SOURCES) + 1).cast("int").alias("blocks")).join(deals, "lang")
    block = F.floor(F.col("gid") / TILE_SOURCES).cast("int")
    placed = [
        sizes.select("lang", "gid", F.col("none").alias("p"), F.lit("").alias("term"), F.lit(0).alias("kind")).join(blocks, "lang").withColumn("deal", F.explode(F.sequence(F.lit(0), F.col("deals") - 1))),
        shares.select("lang", "gid", "p", "term", F.lit(1).alias("kind")).join(blocks, "lang").withColumn("deal", F.pmod(F.xxhash64("term"), F.col("deals")).cast("int")),
    ]
    each = placed[0].unionByName(placed[1]).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = each.select("lang", F.least(block, "other").alias("a"), F.greatest(block, "other").alias("b"), "deal", "kind", "gid", "term", "p")
    return tiles.groupBy("lang", "a", "b", "deal").applyInPandas(_tile, "lang string, g int, h int, value long")


def sparse_corrections(shares: DataFrame, sizes: DataFrame) -> DataFrame:
    """``lang``, ``g``, ``h`` and ``value`` for the pairs of postings of light terms, once for each two shares that occur together."""
    here = F.sort_array(F.collect_list(F.struct("gid", "p")))
    lists = shares.groupBy("lang", "term").agg(here.alias("at")).where("size(at) > 1")
    pairs = F.flatten(F.transform("at", lambda x, i: F.transform(F.slice("at", i + 2, LIGHT), lambda y: F.struct(x["gid"].alias("g"), y["gid"].alias("h"), x["p"].alias("pg"), y["p"].alias("ph")))))
    together = lists.select("lang", F.inline(pairs)).groupBy("lang", "g", "h", "pg", "ph").agg(F.count("*").alias("m"))
    none = sizes.select("lang", "gid", "none")
    known = together.join(none.select("lang", F.col("gid").alias("g"), F.col("none").alias("ng")), ["lang", "g"]).join(none.select("lang", F.col("gid").alias("h"), F.col("none").alias("nh")), ["lang", "h"])
    one = " + ".join((_differ("pg", "ph"), _differ("ng", "nh"))) + " - " + " - ".join((_differ("pg", "nh"), _differ("ng", "ph")))
    other = " + ".join((_differ("ph", "pg"), _differ("nh", "ng"))) + " - " + " - ".join((_differ("nh", "pg"), _differ("ph", "ng")))
    return known.select("lang", F.expr(f"inline(array(struct(g, h, m * ({one}) as value), struct(h as g, g as h, m * ({other}) as value)))"))


def start_and_lone(shares: DataFrame, sizes: DataFrame) -> DataFrame:
    """``lang``, ``g``, ``h`` and ``value`` of all pairs: no term in either, corrected for the light terms of one of them."""
    equal = shares.groupBy("lang", "gid", "p").agg(F.count("*").alias("m"))
    lone = equal.groupBy("lang", "gid").agg(F.collect_list(F.struct("p", "m")).alias("lone"))
    side = materialise(sizes.select("lang", "gid", "none", "kept").join(lone, ["lang", "gid"], "left"))
    one, other = (side.select("lang", F.col("gid").alias(n), F.col("none").alias(f"n{n}"), F.col("lone").alias(f"lone_{n}"), *([F.col("kept")] if n == "g" else [])) for n in "gh")
    pairs = one.join(other, "lang").where("g <> h")
    start = _differ("ng", "nh")
    with_g = f"aggregate(coalesce(lone_g, array()), 0L, (s, x) -> s + x.m * ({_differ('x.p', 'nh')} - {start}))"
    with_h = f"aggregate(coalesce(lone_h, array()), 0L, (s, x) -> s + x.m * ({_differ('ng', 'x.p')} - {start}))"
    return pairs.select("lang", "g", "h", F.expr(f"kept * {start} + {with_g} + {with_h}").alias("value"))


def pair_part(shares: DataFrame, sizes: DataFrame, light: int = LIGHT) -> DataFrame:
    """Every other source of each group's language, by how much the group differs from it."""
    few, many = shares.where(F.col("spread") <= light), shares.where(F.col("spread") > light)
    parts = start_and_lone(few, sizes).unionByName(sparse_corrections(few, sizes)).unionByName(dense_corrections(many, sizes))
    summed = parts.groupBy("lang", "g", "h").agg(F.sum("value").alias("value"))
    named = sizes.select("lang", "gid", "source")
    both = summed.join(named.withColumnRenamed("gid", "g"), ["lang", "g"]).join(named.select("lang", F.col("gid").alias("h"), F.col("source").alias("item")), ["lang", "h"])
    w = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    return both.select("lang", "source", "item", "value").withColumn("rank", F.row_number().over(w))


def divergence(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", light: int = LIGHT) -> DataFrame:
    """``lang``, ``source``, ``part`` (pair or term), ``item``, ``value`` and ``rank``."""
    counted = materialise(counted_terms(docs, text, lang, source))
    postings = materialise(kept_terms(counted))
    sizes = materialise(group_sizes(counted, postings))
    release(counted)
    shares = materialise(postings.join(sizes.drop("none"), ["lang", "source"]).withColumn("p", _share("n")).drop("n", "nth"))
    release(postings)
    names = ["lang", "source", "part", "item", "value", "rank"]
    found = materialise(
        pair_part(shares, sizes, light).withColumn("part", F.lit("pair")).select(*names).unionByName(term_part(shares).withColumn("part", F.lit("term")).select(*names))
    )
    release(sizes, shares)
    return found
