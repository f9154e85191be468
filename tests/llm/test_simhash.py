import re

import numpy as np
import xxhash

from marketloom.llm import simhash

EDGES = [(1, None, "x"), (2, "", "x"), (3, " \n", "x"), (4, "One two", "x"), (5, "one TWO", "x"), (6, "a b c d e f g", "x"), (6, "a b c d e f g", "x"), (None, "a b c d e f g", "x"), (9, "É ä 東京 word " * 3000, "x"), (10, "É ä 東京 word " * 2999 + "end", "x")]


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    parts = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    ones = [0] * 64
    for p in parts:
        h = xxhash.xxh64_intdigest(p.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(parts))


def classes(ids, fps, bits=4):
    fps = np.array(fps, np.uint64)
    label = list(range(len(fps)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= bits).tolist():
            a, b = root(i), root(j)
            label[max(a, b)] = min(a, b)
    least = {}
    for i, x in enumerate(ids):
        if x is not None:
            least[root(i)] = min(x, least.get(root(i), x))
    return [least.get(root(i)) for i in range(len(ids))]


def test_edge_cases(spark):
    docs = spark.createDataFrame(EDGES, "doc_id long, text string, fp string")
    got = simhash.near_classes(docs, ["doc_id"]).collect()
    fps = [plain(t) for _, t, _ in EDGES]
    want = sorted(zip([r[0] for r in EDGES], fps, classes([r[0] for r in EDGES], fps)), key=str)
    assert sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in got), key=str) == want
    assert simhash.near_classes(docs.limit(0), ["doc_id"]).count() == 0


def test_all_documents(spark, sf_dir):
    from marketloom.llm.queries import op1_simhash

    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    fps = [plain(r.text) for r in rows]
    want = sorted((r.doc_id, f"{f:016x}", c) for r, f, c in zip(rows, fps, classes([r.doc_id for r in rows], fps)))
    assert sorted(tuple(r) for r in op1_simhash(spark, sf_dir).collect()) == want


def test_hot_bucket_keeps_links(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 3, np.uint64)
    fps = []
    for k in range(900):  # all share 40 bits with a centre, so a few buckets hold a third of the rows each
        x = int(base[k % 3])
        for b in rng.integers(0, 24, 6):
            x ^= 1 << int(b)
        fps.append(x)
    fps = sorted(set(fps))
    signed = [x - 2**64 if x >= 2**63 else x for x in fps]
    links = simhash.gray_links(spark.createDataFrame([(x,) for x in signed], "fp long"), 4, bucket_rows=32)
    root = {r.u: r.v for r in simhash.connected_components(links).collect()}
    want = classes(signed, fps)
    assert [root.get(x, x) for x in signed] == want


def test_drop_near_copies(spark):
    text = " ".join(f"word{k}" for k in range(300))
    rows = [(5, text, "a"), (3, text + " more", "b"), (3, text + " more", "b"), (8, "other text " * 9, "c"), (None, text, "d"), (8, None, "e"), (9, "", "f")]
    got = simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string, ident string"))
    assert got.columns == ["doc_id", "text", "ident"]
    assert sorted(r.ident for r in got.collect()) == ["b", "c", "e"]


def test_the_index_prunes():
    """Of a bucket of 10,000 random codes, the hardest kind, the index compares a seventh of all pairs at most, and finds every near one."""
    rng = np.random.default_rng(8)
    x = rng.integers(0, 2**63, 9_000, np.uint64) * np.uint64(2)
    near = x[:1000] ^ (np.uint64(1) << rng.integers(0, 64, 1000).astype(np.uint64))
    x = np.unique(np.concatenate([x, near]) & ~np.uint64(0x1FFF << 51) | np.uint64(5 << 51))
    x = x[np.argsort(simhash.gray_order(x))]
    tally = [0]
    got = {(min(i, j), max(i, j)) for a, b in simhash.near_pairs(x, np.zeros(1, np.int64), 4, tally=tally) for i, j in zip(a.tolist(), b.tolist())}
    want = {(i, j) for i in range(len(x)) for j in (np.flatnonzero(np.bitwise_count(x[i + 1 :] ^ x[i]) <= 4) + i + 1).tolist()}
    assert got == want and len(want) >= 700
    assert tally[0] * 7 <= len(x) * (len(x) - 1) // 2


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b c d e", 7), (2, None, 8)], "doc_id long, text string, fp int")
    got = simhash.near_classes(docs, ["doc_id", "fp"])
    assert got.columns == ["doc_id", "fp", "_fp", "component_id"] and sorted(r.fp for r in got.collect()) == [7, 8]


def test_components_of_paths_stars_and_loops(spark, monkeypatch):
    """Components in any order of edges, repeated and turned around, where tasks contract a few edges at a time."""
    import random

    from marketloom.llm import components

    monkeypatch.setattr(components, "CONTRACTED", 7)
    rng = random.Random(5)
    name = rng.sample(range(-10**12, 10**12), 900)
    edges = [(k, k + 1) for k in range(299)] + [(300, k) for k in range(301, 600)] + [(600 + k, 600 + (k * 7 + 1) % 40) for k in range(40)]
    edges += [tuple(sorted(rng.sample(range(700, 900), 2))) for _ in range(120)] + [(5, 5)]
    edges += [(b, a) for a, b in edges[::3]]
    rng.shuffle(edges)
    root = list(range(900))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        root[find(a)] = find(b)
    members = {}
    for k in {x for e in edges for x in e}:
        members.setdefault(find(k), []).append(name[k])
    want = {m: min(group) for group in members.values() for m in group if m != min(group)}
    rows = [(name[a], name[b]) for a, b in edges]
    got = components.connected_components(spark.createDataFrame(rows, "u long, v long").repartition(5))
    assert {r.u: r.v for r in got.collect()} == want
    keyed = spark.createDataFrame([(a.to_bytes(8, "big", signed=True), b.to_bytes(8, "big", signed=True)) for a, b in rows], "u binary, v binary")
    pairs = {bytes(r.u): bytes(r.v) for r in components.connected_components(keyed).collect()}
    assert len(pairs) == len(want)
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).isEmpty()


def test_components_in_rounds_and_at_once(spark, monkeypatch):
    """Paths, stars and cliques: the same components whether the last edges are united at once or by rounds alone."""
    from marketloom.llm import components

    rng = np.random.default_rng(9)
    ids = rng.permutation(2000).tolist()
    edges = [(ids[k], ids[k + 1]) for k in range(600)] + [(ids[700], ids[k]) for k in range(701, 900)] + [(ids[a], ids[b]) for a in range(1000, 1020) for b in range(1000, a)]
    table = spark.createDataFrame(edges + edges[:50], "u long, v long").repartition(5)
    want = components.least_reached(2000, np.array([u for u, _ in edges]), np.array([v for _, v in edges]))
    for last in (1 << 15, 0):
        monkeypatch.setattr(components, "LAST", last)
        got = {r.u: r.v for r in components.connected_components(table).collect()}
        assert got == {u: int(v) for u, v in enumerate(want) if u != v}


def test_finished_stars_are_set_aside(spark, monkeypatch):
    """Rounds of the search for components get only what is not one star yet."""
    from marketloom.llm import components

    rows = [(3 * k + i, 3 * k) for k in range(300) for i in (1, 2)] + [(10_000 + k + 1, 10_000 + k) for k in range(200)]
    table = spark.createDataFrame(rows, "u long, v long").repartition(7)
    monkeypatch.setattr(components, "LAST", 0)
    moved = []

    def counted(edges):
        moved.append(edges.count())
        return edges  # tasks that meet no two edges of a component

    monkeypatch.setattr(components, "contracted", counted)
    got = {r.u: r.v for r in components.connected_components(table).collect()}
    assert got == {u: v if v < 10_000 else 10_000 for u, v in rows}
    assert len(moved) > 2 and max(moved[2:]) <= 400
