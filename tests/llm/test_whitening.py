import numpy as np
import pytest

from marketloom.llm import whitening


def plain(rows):
    """Everything of the contract by whole arrays: (id, component) -> values."""
    kept = [(k, np.floor(256 * np.array(v, float)).astype(np.int64)) for k, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in kept}), np.int64)
    n, s = len(fit), fit.sum(axis=0)
    centred = (n * fit - s) / n
    e, w = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-e)[:4]
    return n, s, e[order], w[:, order], e.sum(), kept


def held(spark, rows, got):
    n, s, e, w, trace, kept = plain(rows)
    x = dict(kept)
    assert len(got) == 4 * len(kept)
    for r in got:
        k = r["component"] - 1
        here = n * x[r["vec_id"]] - s
        assert r["n"] == n and r["deviation"] == sum(int(v) ** 2 for v in here)
        assert r["explained"] == pytest.approx(e[k] / trace, rel=1e-9)
        assert abs(r["whitened"]) == pytest.approx(abs(here / n @ w[:, k] / np.sqrt(e[k])), rel=1e-7, abs=1e-9)
        assert r["identity_error"] < 1e-9
    for k in range(4):  # one sign for all rows
        signs = {np.sign(r["whitened"] * (n * x[r["vec_id"]] - s) @ w[:, k]) for r in got if r["component"] == k + 1 and abs(r["whitened"]) > 1e-6}
        assert len(signs) == 1


def test_query(spark, sf_dir):
    from marketloom.llm.queries import op13_whitening

    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    got = op13_whitening(spark, sf_dir)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    held(spark, rows, [r.asDict() for r in got.collect()])


def test_left_out_and_repeated_rows(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 6)).tolist()
    rows = list(enumerate(base)) + [(100, None), (101, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (102, [float("nan")] * 6), (103, [1.0, 2.0, 3.0, 4.0, 5.0, float("inf")]), (104, base[0]), (105, base[0])]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "vec_id as n", "'a' as x")
    model = whitening.fit(docs)
    got = whitening.whitened(docs, model, ["vec_id"]).collect()
    held(spark, rows, [r.asDict() for r in got])
    clash = whitening.whitened(docs, model, ["n", "x", "vec_id"])
    assert clash.columns[:3] == ["n", "x", "vec_id"] and clash.columns[4] == "_n" and clash.count() == len(got)


def test_edge_cases(spark):
    schema = "vec_id long, embedding array<float>"
    empty = spark.createDataFrame([], schema)
    assert whitening.fit(empty) is None and whitening.whitened(empty, None, ["vec_id"]).count() == 0
    same = spark.createDataFrame([(1, [1.0, 2.0]), (None, [1.0, 2.0])], schema)
    got = whitening.whitened(same, whitening.fit(same), ["vec_id"]).collect()
    assert sorted((str(r.vec_id), r.component, r.n, r.deviation, r.whitened, r.identity_error) for r in got) == [(i, k, 1, 0, None, None) for i in ("1", "None") for k in (1, 2)]
    # Shorter vectors are zero beyond their end; components without variance are null.
    short = spark.createDataFrame([(1, [1.0]), (2, [1.0, 0.0]), (3, [2.0, 0.0, 0.0]), (4, [])], schema)
    got = whitening.whitened(short, whitening.fit(short), ["vec_id"]).collect()
    assert {r.n for r in got} == {3} and len(got) == 12
    assert all((r.whitened is None) == (r.component > 1) for r in got)
    assert {r.vec_id: r.deviation for r in got} == {1: 0, 2: 0, 3: (3 * 256) ** 2, 4: (3 * 256) ** 2}


def test_very_large_entries(spark):
    rows = [(1, [1e300, 1.0]), (2, [-1e300, 2.0]), (3, [1e15, 5.0]), (4, [0.0, 0.0])]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = whitening.whitened(docs, whitening.fit(docs), ["vec_id"]).collect()
    assert len(got) == 8 and all(r.deviation is None for r in got if r.vec_id < 3) and all(r.n == 4 for r in got)
