import itertools
import re
from hashlib import sha256

import numpy as np
import pytest

from marketloom.llm import pii

# Each kind's pattern and test as the query defines them.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text):
    spans = [(0, m.start(), m.end()) for m in EMAIL.finditer(text)]
    spans += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        d = re.sub("[ -]", "", m[0])
        odd = [int(c) for c in d[::-1]]
        if 13 <= len(d) <= 19 and sum(odd[::2] + [sum(divmod(2 * c, 10)) for c in odd[1::2]]) % 10 == 0:
            spans.append((2, m.start(), m.end()))
    spans += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(re.sub(r"\D", "", m[0])) <= 15]
    return spans


CASES = ["", "a@b.c", "a@b@c.de x", "..a%@x-y.z.", "x@y..z", "é@b.cz", "1.2.3.4.5.6.7.8", "01.002.0255.256 1.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1111 22", "+420 777 123 456.", "+1 (2) 3", "+12345678901234567890", "12+420.777.123.456+49 30 1234567", "a" * 5000 + "@", "1" * 3000, "@" * 50, "1.2.3", "a@b.c@d.e", "999.1.1.1.1", "5500-0000 0000 0004 7"]


def test_patterns(spark, sf_dir):
    texts = CASES + [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    for t in texts:
        assert pii.base_spans(t) == plain(t), t[:200]


def test_query(spark, sf_dir):
    from marketloom.llm.queries import op3_pii

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r.doc_id: r for r in op3_pii(spark, sf_dir).collect()}
    assert got.keys() == texts.keys()
    for k, t in texts.items():
        base = plain(t)
        told = ",".join(f"{pii.KINDS[x]}:{a}:{b}" for x, a, b in base)
        assert got[k].base_sha256 == sha256(told.encode()).hexdigest()
        assert [got[k][f"n_{n}"] for n in pii.KINDS] == [sum(x == i for x, _, _ in base) for i in range(4)]
        assert set(filter(None, told.split(","))) <= set(filter(None, got[k].spans.split(",")))


def test_field_finds_other_mentions():
    taught = [f"Call +420 777 123 {k:03d} or mail user{k}@mail.example.com, room {k}, page {k % 90}." for k in range(300)]
    w = pii.fit(taught)
    text = "Write to anna.kay@mail.example.com today. Later: anna.kay@mail.example.com again; room 12."
    base, spans = pii.spans_of(text, w)
    assert set(base) <= set(spans)
    assert pii.spans_of("Just room 12 and page 4 of 9.", w)[1] == []
    phone = "Call +420 777 123 456. I said 777123456, room 7."
    assert "777123456" in [phone[a:b] for _, a, b in pii.spans_of(phone, w)[1]]


def test_redact(spark):
    rows = [(1, None, 5), (2, "", 5), (3, "mail a.b@c.de now", 5), (3, "mail a.b@c.de now", 5), (4, "x " * 40000 + "1.2.3.4", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans int")
    out = pii.redact(docs, pii.train(docs))
    assert out.columns == docs.columns
    got = sorted((r.doc_id, r.text) for r in out.collect() if r.text)
    assert got[1] == (3, "mail [EMAIL] now") and got[-1][1].endswith("[IP]")
    assert out.where("text is null").count() == 1 and pii.redact(docs.limit(0), pii.fit([])).count() == 0


TAUGHT = [
    f"Call +420 777 {k % 900 + 100} {(37 * k) % 900 + 100} or mail u{k}.x@mail{k % 9}.example.com from 10.{k % 200}.3.{k % 250}, card 4111 1111 1111 1111, room {k}, page {k % 90} of look at page.two."
    for k in range(300)
]


@pytest.mark.parametrize("kind,mention,again,decoy", [
    (0, "anna.kay@mail.example.com", "anna.kay at mail.example.com", "look at shop.example.org"),
    (0, "anna.kay@mail.example.com", "anna.kay(at)mail.example.com", "bob(at)shop.example.org"),
    (1, "192.168.7.33", "192[.]168[.]7[.]33", "10[.]9[.]8[.]7"),
    (2, "5500 0000 0000 0004", "5500.0000.0000.0004", "4242.4242.4242.4242"),
    (3, "+420 777 123 456", "777123456", "605987321"),
    (3, "+49 30 1234567", "0049301234567", "0044201112223"),
])
def test_linked_mentions_that_patterns_miss(kind, mention, again, decoy):
    """A disguised mention is found through the plain one only: not by itself, not without skip edges."""
    w = pii.fit(TAUGHT)
    text = f"First: {mention} here. Some words between them. Then \"{again}\" once more, and {decoy} too."
    at = text.index(again)
    want = (kind, at, at + len(again))
    base, spans = pii.spans_of(text, w)
    assert want not in base and want in spans
    assert not any(a <= text.index(decoy) < b for _, a, b in spans)
    assert want not in pii.spans_of(text, w, skips=False)[1]
    assert want not in pii.spans_of(text.replace(mention, "nothing"), w)[1]


class Graph:
    def __init__(self, n, nexts, skips):
        self.spans, self.next, self.skips, self.features = [(0, 1)] * n, nexts, skips, [[k] for k in range(n)]


def enumerated(g, w):
    n = len(g.spans)
    p = np.zeros((n, pii.LABELS))
    for y in itertools.product(range(pii.LABELS), repeat=n):
        s = sum(w["node"][k, y[k]] for k in range(n)) + sum(w["chain"][y[k], y[k + 1]] for k in g.next) + sum(w["skip"][y[a], y[b]] for a, b in g.skips)
        for k in range(n):
            p[k, y[k]] += np.exp(s)
    return p / p.sum(1, keepdims=True)


def test_marginals_against_enumeration():
    rng = np.random.default_rng(1)
    sym = lambda m: (m + m.T) / 2
    for n, nexts, skips, near in ((5, [0, 1, 2, 3], [], 1e-3), (5, [0, 3], [(1, 3)], 1e-3), (4, [], [(0, 3), (1, 3), (2, 3)], 1e-3), (4, [0, 1, 2], [(0, 3)], 0.1), (3, [0, 1], [(0, 2)], 0.1)):
        w = {"node": rng.normal(0, 1, (n, pii.LABELS)), "chain": sym(rng.normal(0, 0.6, (pii.LABELS,) * 2)), "skip": sym(rng.normal(0, 0.6, (pii.LABELS,) * 2))}
        g = Graph(n, nexts, skips)
        assert np.abs(pii.marginals(g, w) - enumerated(g, w)).max() < near


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a@b.cz", 2, 3, 4)], "doc_id long, text string, base int, spans int, `a.b` int")
    got = pii.find_spans(docs, ["doc_id", "base", "a.b"], pii.fit([]))
    assert got.columns == ["doc_id", "base", "a.b", "_base", "spans"] and got.first()["_base"][0]["kind"] == "email"
    assert pii.digests(pii.find_spans(docs, ["a.b"], pii.fit([])), ["a.b"]).first()["n_email"] == 1
