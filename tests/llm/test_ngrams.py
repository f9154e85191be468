import re

import numpy as np
import pytest

from marketloom.llm import ngrams


def plain_set(text, width=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def plain(rows, percent=85):
    """(id, size, least id of the class), by comparing all sets that share an n-gram."""
    sets = [plain_set(t) for _, t in rows]
    label, holders = list(range(len(rows))), {}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, s in enumerate(sets):
        seen = {}
        for g in s:
            for j in holders.setdefault(g, []):
                seen[j] = seen.get(j, 0) + 1
            holders[g].append(i)
        for j, both in seen.items():
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[root(i)] = min(k, least.get(root(i), k))
    return sorted(((k, len(s), least.get(root(i))) for i, ((k, _), s) in enumerate(zip(rows, sets))), key=str)


def found(docs, **more):
    return sorted((tuple(r) for r in ngrams.similar_classes(docs, ["doc_id"], **more).collect()), key=str)


def near_families(rng, sizes, length, edits):
    rows = []
    for size in sizes:
        base = [f"w{x}" for x in rng.integers(0, 10**6, length)]
        for _ in range(size):
            words = list(base)
            for at in rng.choice(length, rng.integers(0, edits + 1), replace=False):
                words[at] = f"e{rng.integers(0, 10**6)}"
            rows.append((len(rows), " ".join(words)))
    return rows


def test_pairs_around_the_bound(spark):
    """Families whose members are partly within the bound, among texts with common passages, in small cells."""
    rng = np.random.default_rng(11)
    rows = near_families(rng, [2] * 30 + [3] * 10 + [40], 60, 4) + near_families(rng, [25], 120, 6)
    rows = [(k, t) for k, (_, t) in enumerate(rows)]
    passages = [" ".join(f"p{k}x{i}" for i in range(50)) for k in range(3)]
    for k in range(60):  # mostly one passage, and a little of their own
        own = " ".join(f"o{rng.integers(0, 10**6)}" for _ in range(rng.integers(1, 14)))
        rows.append((len(rows), f"{passages[k % 3]} {own}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain(rows)
    assert 100 < len({c for _, _, c in want}) < len(rows) - 60
    assert found(docs) == want


def test_small_cells_and_tables(spark, monkeypatch):
    """N-grams with very many members in several classes are dealt into cells; the table of magnitudes has few slots."""
    rng = np.random.default_rng(5)
    rows = near_families(rng, [70, 5, 5], 80, 5)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(ngrams, "CELL_ROWS", 8)
    monkeypatch.setattr(ngrams, "HELD", 500)
    assert found(docs) == plain(rows)
    table = ngrams.magnitudes(docs, slots=64).value
    assert len(table) == 64 and (table > 0).sum() > 50


def test_magnitudes(spark):
    """0 where no n-gram occurs twice, else at least the bits of the count."""
    rows = [(k, "one two three four five") for k in range(9)] + [(10, "a b c d"), (11, "alone it stands here")]
    table = ngrams.magnitudes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).value
    shift = np.uint64(64 - int(np.log2(len(table))))
    assert set(table[ngrams.shingle_set(rows[0][1].encode(), 4) >> shift]) == {4}
    assert (table > 0).sum() <= 2


def test_bounds():
    for n in range(1, 300):
        least = -(-85 * n // 100)
        assert ngrams.prefix_size(n) in (0, n - least + 1)
        for m in range(n, min(300, 100 * n // 85 + 1)):
            both = min(b for b in range(m + n + 1) if 100 * b >= 85 * (n + m - b))
            assert ngrams.allowed_difference(np.array(n + m)) == n + m - 2 * both
    assert [ngrams.prefix_size(n) for n in (0, 1, 5, 6)] == [0, 0, 0, 1]


def test_edge_cases(spark):
    long = "É ä 東京 word " * 3 + " ".join(f"u{k}" for k in range(20000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "One two"), (5, "one TWO"), (6, "a b c d e f g"), (6, "a b c d e f g"), (None, "a b c d e f g"), (9, long), (10, long + " end"), (None, "quite alone here")]
    docs = spark.createDataFrame([(k, t, "x", "y") for k, t in rows], "doc_id long, text string, key string, n string")
    assert found(docs) == plain(rows)
    assert ngrams.similar_classes(docs.limit(0), ["doc_id"]).count() == 0
    clash = ngrams.similar_classes(docs.withColumnRenamed("key", "component_id"), ["doc_id", "component_id", "n"])
    assert clash.columns == ["doc_id", "component_id", "n", "n_shingles", "_component_id"] and clash.count() == len(rows)


@pytest.mark.parametrize("name", ["sf0.001", "sf0.01"])
def test_query(spark, sf_dir, name):
    from marketloom.llm.queries import op11_ngram_join

    at = sf_dir.replace("sf0.001", name)
    got = op11_ngram_join(spark, at)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    rows = [tuple(r) for r in spark.read.parquet(f"{at}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows)


def test_tables_are_released(spark, sf_dir):
    import glob
    import os

    from marketloom.llm.queries import op11_ngram_join
    from marketloom.llm.storage import shared_dir

    tables = lambda: set(glob.glob(shared_dir(spark).removeprefix("file://") + "/tables/*"))
    before = tables()
    got = op11_ngram_join(spark, sf_dir)
    left = tables() - before
    assert len(left) == 1 and os.path.basename(left.pop()) in got.inputFiles()[0]
