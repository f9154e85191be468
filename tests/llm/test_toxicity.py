from zlib import crc32

import numpy as np

from marketloom.llm import toxicity


def auc(score, label):
    order = np.argsort(np.argsort(score)) + 1
    n, m = label.sum(), (1 - label).sum()
    return (order[label == 1].sum() - n * (n + 1) / 2) / (n * m)


def test_held_out_accuracy(spark, sf_dir):
    from marketloom.llm.queries import op10_toxicity

    d = sf_dir.replace("sf0.001", "sf0.1")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = op10_toxicity(spark, d).collect()
    assert len(rows) == spark.read.parquet(f"{d}/documents.parquet").count()
    for r in rows:
        assert r.held_out == (crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    far = [r for r in rows if r.held_out and labels.get(r.doc_id) is not None]
    y = np.array([labels[r.doc_id] for r in far])
    assert auc(np.array([r.score for r in far]), y) > 0.95
    clean = [r.predicted for r in far if labels[r.doc_id] == 0]
    assert sum(clean) <= 0.03 * len(clean)


def test_pairs_count_beyond_their_parts():
    """The label is true only where two terms meet, so no sum of weights can tell."""
    rng = np.random.default_rng(3)
    texts, y = [], []
    for _ in range(3000):
        a, b = rng.random(2) < 0.5
        filler = " ".join(f"w{k}" for k in rng.integers(0, 50, 5))
        texts.append(f"{'insult' if a else ''} {'group' if b else ''} {filler}")
        y.append(int(a and b))
    terms = toxicity.Terms()
    found = [terms.buckets(t) for t in texts]
    m = toxicity.fit(found, np.array(y))
    s = m.scores([terms.buckets(t) for t in ("insult w1 w2", "group w1 w2", "insult group w1 w2")])
    assert s[2] > 0.7 > max(s[0], s[1])


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (2, "", 1), (None, "x", 1), (3, "w " * 90000, 1)], "doc_id long, text string, label int")
    labels = spark.createDataFrame([(1, 1), (3, 0), (77, 1), (2, None)], "doc_id long, toxic int")
    machine = toxicity.train(docs, labels)
    assert toxicity.score(docs, machine, ["doc_id"]).where("score between 0 and 1").count() == 5
    assert toxicity.score(docs.limit(0), machine, ["doc_id"]).count() == 0
    none = toxicity.train(docs, labels.limit(0))
    assert {round(r.score, 9) for r in toxicity.score(docs, none, ["doc_id"]).collect()} == {0.0}


def test_pairs_with_a_term_that_is_even_by_itself():
    """A group is mentioned as often in clean texts as in toxic ones; next to an insult it tells."""
    rng = np.random.default_rng(5)
    texts, y = [], []
    for k in range(4000):
        insult, group = k % 2, rng.random() < 0.5
        toxic = insult and group
        if not insult and rng.random() < 0.5:
            group = rng.random() < 0.75
        filler = " ".join(f"w{x}" for x in rng.integers(0, 50, 5))
        texts.append(f"{'insult' if insult else ''} {'group' if group else 'other'} {filler}")
        y.append(int(toxic or (not insult and not group)))
    terms = toxicity.Terms()
    found = [terms.buckets(t) for t in texts]
    y = np.array(y)
    assert np.all(toxicity.log_odds(found, y)[terms.buckets("group")] == 0)
    m = toxicity.fit(found, y)
    s = m.scores([terms.buckets(t) for t in ("insult other w1 w2 w3 w4 w5", "insult group w1 w2 w3 w4 w5")])
    assert s[1] > 0.7 > 0.5 > s[0]


def test_margins_are_the_sum_over_pairs():
    rng = np.random.default_rng(2)
    n = toxicity.BUCKETS
    m = toxicity.Machine(0.3, np.where(rng.random(n) < 0.5, 0, rng.normal(0, 1, n)), rng.normal(0, 1, n), rng.normal(0, 1, (n, toxicity.FACTORS)))
    texts = [rng.choice(n, k, replace=False) for k in (0, 1, 2, 7, 40)]
    for t, got in zip(texts, m.margins(texts), strict=True):
        x = [m.value[k] if m.value[k] else 1 / np.sqrt(len(t)) for k in t]
        want = 0.3 + sum(m.weight[k] * m.value[k] for k in t)
        want += sum(m.vector[t[i]] @ m.vector[t[j]] * x[i] * x[j] for i in range(len(t)) for j in range(i))
        assert abs(got - want) < 1e-9 * max(1, abs(want)) + 1e-9


def test_a_label_that_only_pairs_explain():
    """Every term by itself is as frequent in both classes."""
    rng = np.random.default_rng(3)
    texts, y = [], []
    for _ in range(4000):
        a, b = rng.random(2) < 0.5
        filler = " ".join(f"w{k}" for k in rng.integers(0, 50, 5))
        texts.append(f"{'insult' if a else 'remark'} {'group' if b else 'thing'} {filler}")
        y.append(int(a == b))
    terms = toxicity.Terms()
    found, y = [terms.buckets(t) for t in texts], np.array(y)
    machine = toxicity.fit(found[:3000], y[:3000])
    assert auc(machine.scores(found[3000:]), y[3000:]) > 0.9


def test_shares_of_the_sample_are_corrected(spark, monkeypatch):
    """A bound on clean rows must not make every text look more toxic."""
    rng = np.random.default_rng(6)
    toxic = [k % 10 == 0 for k in range(3000)]
    rows = [(k, " ".join(f"w{x}" for x in rng.integers(0, 40, 6)) + (" insult" if t and rng.random() < 0.5 else "")) for k, t in enumerate(toxic)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(t)) for k, t in enumerate(toxic)], "doc_id long, toxic int")
    whole = np.mean([r.score for r in toxicity.score(docs, toxicity.train(docs, labels), ["doc_id"]).collect()])
    monkeypatch.setattr(toxicity, "MAX_CLEAN", 300)
    part = np.mean([r.score for r in toxicity.score(docs, toxicity.train(docs, labels), ["doc_id"]).collect()])
    assert abs(whole - 0.1) < 0.06 and abs(part - 0.1) < 0.06


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a", 0.5), (2, None, 0.1)], "doc_id long, text string, score double")
    got = toxicity.score(docs, toxicity.fit([], np.zeros(0)), ["doc_id", "score"])
    assert got.columns == ["doc_id", "score", "_score"] and got.where("score > 0 and _score < 0.1").count() == 2
