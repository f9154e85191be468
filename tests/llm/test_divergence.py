import re
from collections import Counter, defaultdict

import pytest

from marketloom.llm import divergence


def plain(rows):
    """The contract, term by term, of (text, lang, source)."""
    n, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        found = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        groups.add((lang, source))
        n[lang, source].update(found)
        docs[lang].update(set(found))
    out = []
    for lang, source in groups:
        kept = [t for t, k in docs[lang].items() if k >= 3]
        of_lang = Counter()
        for (a, _), c in n.items():
            if a == lang:
                of_lang.update(c)

        def shares(c):
            total = sum(c[t] for t in kept) + len(kept)
            return [1 + 10**9 * (c[t] + 1) // total for t in kept]

        mine = shares(n[lang, source])
        others = [(shares(n[lang, other]), other) for a, other in groups if a == lang and other != source]
        parts = {"pair": [(sum((p - q) ** 2 // q for p, q in zip(mine, theirs)), other) for theirs, other in others]}
        used = [(p, q, t) for p, q, t in zip(mine, shares(of_lang), kept) if n[lang, source][t]]
        parts["term"] = [((p - q) ** 2 // q, t) for p, q, t in used if p > q]
        for part, found in parts.items():
            for rank, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode())), 1):
                if part == "pair" or rank <= 200:
                    out.append((lang, source, part, item, value, rank))
    return sorted(out)


ROWS = [
    ("Alpha beta GAMMA alpha", "en", "a"), ("alpha beta delta delta", "en", "b"), ("ALPHA beta é東京 Ünï", "en", "c"), ("gamma é東京 x1x", "en", "a"), ("é東京 gamma x", "en", "d"),
    ("alpha alpha beta", "en", "b"), (None, "en", "silent"), ("alpha", None, None), ("solo wort", "de", "a"), ("", "de", "b"), ("alpha beta", "fr", "a"), ("alpha beta", "fr", "a"), ("alpha beta", "fr", "a"),
    ("alpha " * 5000 + "gamma", "fr", "ž"), ("123 !?", "fr", "z"),
]


@pytest.mark.parametrize("light", [0, 1, 2, 100])
def test_against_plain(spark, light, monkeypatch):
    monkeypatch.setattr(divergence, "LIGHT", max(light, 1))
    docs = spark.createDataFrame(ROWS, "text string, lang string, source string").selectExpr("*", "1 as term", "2 as n")
    assert sorted(map(tuple, divergence.divergence(docs, light=light).collect())) == plain(ROWS)


def test_tiles_of_blocks(monkeypatch):
    """Sources in two blocks: both directions of each pair, as the sum over terms says."""
    import numpy as np
    import pandas as pd

    monkeypatch.setattr(divergence, "TILE_SOURCES", 2)
    none, shares = [3, 4, 5, 6], {("t", 0): 50, ("t", 3): 9, ("u", 1): 70}
    rows = [("en", 0, 1, 0, 0, g, "", p) for g, p in enumerate(none)] + [("en", 0, 1, 0, 1, g, t, p) for (t, g), p in shares.items()]
    got = divergence._tile(pd.DataFrame(rows, columns=["lang", "a", "b", "deal", "kind", "gid", "term", "p"]))
    f = lambda p, q: (p - q) ** 2 // q
    want = {(g, h): sum(f(shares.get((t, g), none[g]), shares.get((t, h), none[h])) - f(none[g], none[h]) for t in "tu") for g in range(4) for h in range(4) if g // 2 != h // 2}
    assert {(r.g, r.h): r.value for r in got.itertuples()} == {k: v for k, v in want.items() if v}
    assert got["value"].dtype == np.int64


def test_query(spark, sf_dir, duck):
    from marketloom.llm.queries import op12_divergence
    from marketloom.llm.queries_sql import SQL

    got = op12_divergence(spark, sf_dir)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    rows = sorted(map(tuple, got.collect()))
    assert rows == sorted(duck.execute(SQL["op12_divergence"]).fetchall())
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang", "source").collect()
    assert rows == plain(map(tuple, docs))
    assert divergence.divergence(spark.createDataFrame([], "text string, lang string, source string")).count() == 0
