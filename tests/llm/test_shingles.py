import numpy as np

from marketloom.llm import shingles


def test_pairs_near_the_bound(spark):
    """Every pair of similarity 0.8 or more falls into one class, no pair below does."""
    rng = np.random.default_rng(4)
    rows, near = [], set()
    for k in range(0, 300, 2):
        words = [f"w{x}" for x in rng.integers(0, 10**6, 200)]
        other = list(words)
        for at in rng.choice(200, rng.integers(2, 9), replace=False):
            other[at] = "changed"
        rows += [(k, " ".join(words)), (k + 1, " ".join(other))]
        runs = [{tuple(w[i : i + 5]) for i in range(196)} for w in (words, other)]
        if len(runs[0] & runs[1]) >= 0.8 * len(runs[0] | runs[1]):
            near.add(k + 1)
    assert 30 < len(near) < 120
    kept = {r.doc_id for r in shingles.drop_similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(range(300)) - kept <= near and len(kept & near) <= 0.02 * len(near)


def test_edge_cases(spark):
    text = " ".join(f"word{k}" for k in range(300))
    rows = [(5, text, "a"), (3, text + " more", "b"), (3, text + " more", "b"), (8, "other text " * 9, "c"), (None, text, "d"), (8, None, "e"), (9, "", "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ident string")
    assert sorted(r.ident for r in shingles.drop_similar(docs).collect()) == ["b", "c", "e"]
    assert shingles.drop_similar(docs.limit(0)).count() == 0
