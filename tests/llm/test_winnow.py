from hashlib import sha256

import numpy as np

from marketloom.llm import winnow


def plain(text):
    """Each window's rightmost least hash, window by window."""
    codes = np.array([ord(c) for c in text], np.uint32)
    h = winnow.gram_hashes(codes) >> np.uint64(winnow._POSITION)
    kept = {}
    for a in range(max(1, len(h) - winnow.WINDOW + 1)):
        w = h[a : a + winnow.WINDOW]
        p = a + max(i for i in range(len(w)) if w[i] == w.min())
        kept[p] = int(h[p])
    return sorted(kept.items())


def test_against_windows():
    rng = np.random.default_rng(0)
    for n in (32, 33, 63, 64, 65, 300, 2000):
        for text in ("".join(rng.choice(list("ab c🙂"), n)), "a" * n):
            h, p = winnow.winnow(text)
            assert list(zip(p.tolist(), h.tolist())) == plain(text)


def test_rolling_hash_is_of_the_gram_alone():
    a, b = "xyz" * 20, "0" * 17 + "xyz" * 20
    ha = winnow.gram_hashes(np.array([ord(c) for c in a]))
    hb = winnow.gram_hashes(np.array([ord(c) for c in b]))
    assert (hb[17:] == ha).all()


def test_match_guarantee():
    rng = np.random.default_rng(5)
    shared = "".join(rng.choice(list("abcdefgh "), winnow.GRAM + winnow.WINDOW - 1))
    for _ in range(50):
        a, b = ("".join(rng.choice(list("ijklmnop"), rng.integers(1, 90))) for _ in "ab")
        ha, hb = winnow.winnow(a + shared)[0], winnow.winnow(b + shared + a)[0]
        assert set(ha.tolist()) & set(hb.tolist())


def test_query(spark, sf_dir):
    from marketloom.llm.queries import op4_winnowing

    rows = sorted(((r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()), reverse=True)
    got = {r.doc_id: r for r in op4_winnowing(spark, sf_dir).collect()}
    assert len(got) == len(rows)
    for (k, t), (_, after) in zip(rows, rows[1:] + rows[:1]):
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        one, two, three = (np.unique(winnow.winnow(x)[0]) for x in (t, edited, after))
        r = got[k]
        assert (r.n_chars, r.edited_sha256) == (len(t), sha256(edited.encode()).hexdigest())
        assert r.fingerprint == winnow.digest(winnow.winnow(t)) and r.edited_fingerprint == winnow.digest(winnow.winnow(edited))
        assert (r.near_edited, r.near_next) == (winnow.likeness(one, two), winnow.likeness(one, three))


def test_edge_cases(spark):
    one = spark.createDataFrame([(7, "only", 1)], "doc_id long, text string, _group int")
    (r,) = winnow.edited_fingerprints(one).collect()
    assert r.near_next == 1.0 and r.n_chars == 4
    rows = [(1, None), (2, ""), (None, "z" * 70), (2, "b" * 99), (2, "b" * 99)]
    got = winnow.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_chars) for r in got) == [(0, 70), (1, 0), (2, 0), (2, 99), (2, 99)]
    assert winnow.edited_fingerprints(one.limit(0)).count() == 0


def test_ranges_meet_their_successors(spark):
    """Many ranges, some of them empty; the ends of each meet in the join."""
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "40"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        for n in (400, 15):
            rows = [(k * 7 % 401, f"text {k} " * 20) for k in range(n)]
            got = {r.doc_id: r.edited_sha256 for r in winnow.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
            order = sorted(rows, reverse=True)
            for (k, t), (_, after) in zip(order, order[1:] + order[:1]):
                half = len(t) // 2
                assert got[k] == sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_ids_are_taken_as_they_are(spark):
    rows = [("b", "1" * 40), ("a", "2" * 40), ("c", None), (None, "3" * 40)]
    got = {r.name: r for r in winnow.edited_fingerprints(spark.createDataFrame(rows, "name string, text string"), ident="name").collect()}
    assert got["b"].edited_sha256 == sha256(("1" * 20 + "2" * 20).encode()).hexdigest() and got["c"].n_chars == 0
    great = spark.createDataFrame([(2**60 + k, "x" * k) for k in (1, 2)] + [(None, "y")], "doc_id long, text string")
    assert {r.doc_id for r in winnow.edited_fingerprints(great).collect()} == {2**60 + 1, 2**60 + 2, None}


def test_blocks_of_a_long_text(monkeypatch):
    rng = np.random.default_rng(6)
    texts = ["".join(rng.choice(list("abcd"), n)) for n in (700, 64, 191, 5000)]
    whole = [winnow.winnow(t) for t in texts]
    monkeypatch.setattr(winnow, "_BLOCK", 64)
    for t, (h, p) in zip(texts, whole, strict=True):
        got = winnow.winnow(t)
        assert (got[0] == h).all() and (got[1] == p).all()


def test_fingerprints_beside_any_columns(spark):
    docs = spark.createDataFrame([(1, "q" * 50, 2)], "`a.b` long, text string, hashes int")
    got = winnow.fingerprint_documents(docs, ["a.b", "hashes"])
    assert got.columns == ["a.b", "hashes", "_hashes", "positions"] and len(got.first()["_hashes"]) == 1
