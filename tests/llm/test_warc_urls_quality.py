import re

import pytest

from marketloom.llm import quality, urls, warc
from marketloom.llm.queries import oracle_sql, queries

Q, SQL = queries(), oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, sf_dir, duck, name):
    got = Q[name](spark, sf_dir)
    found = duck.execute(SQL[name])
    columns = [c[0] for c in found.description]
    names = sorted(columns)
    assert sorted(got.columns) == names
    want = sorted(str([r[columns.index(c)] for c in names]) for r in found.fetchall())
    assert sorted(str(list(r)) for r in got.select(*names).collect()) == want


def plain_repeats(words):
    windows = [" ".join(words[i : i + 8]) for i in range(len(words) - 7)]
    hit = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            hit.update(range(i, i + 8))
    return len(hit)


def test_quality_measures(spark):
    run = "a b c d e f g h "
    texts = [None, "", " \n\t", run * 3, "x " + run + "y z " + run, "b a " * 40, "line one\nline one\n\n\nline one\nother", "# $ % <a> |\x0b& *", "w" * 70000, "é\xa0ü 東京\x85x"]
    docs = spark.createDataFrame([(k, t, 1, 2) for k, t in enumerate(texts)], "doc_id long, text string, n_words int, _text int")
    for r in quality.judge(docs, ["doc_id"]).collect():
        t = texts[r.doc_id] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), plain_repeats(words))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, t[:40]
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
    kept = quality.quality_filter(docs)
    assert kept.columns == docs.columns and quality.quality_filter(docs.limit(0)).count() == 0


def test_quality_keeps_clean_prose(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").join(docs, "doc_id")
    judged = quality.judge(good, ["doc_id"])
    assert judged.where("kept or base_failed").count() > 0.97 * judged.count()


def test_url_rules(spark):
    cases = [
        (None, "", "", None, "allow"),
        ("no scheme/en/", "", "", None, "allow"),
        ("http://", "", "", None, "allow"),
        ("http://EXAMPLE.com/en/x?y#z", "example.com", "/en/x", "example.com/en/", "block"),
        ("http://a.www.example.com/en/", "a.www.example.com", "/en/", "www.example.com/en/", "allow"),
        ("http://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
        ("http://b.net/es/", "b.net", "/es/", "net/es/", "block"),
        ("http://b.net/es", "b.net", "/es", None, "allow"),
        ("http://net/fr/x", "net", "/fr/x", "net/fr/", "block"),
        ("http://com", "com", "", None, "allow"),
        ("http://best-casino.org/x", "best-casino.org", "/x", None, "block"),
        ("http://casinos.org/x?casino", "casinos.org", "/x", None, "allow"),
        ("http://casino.com/x", "casino.com", "/x", "com/", "allow"),
        ("http://ÉÄ.net/ES/", "ÉÄ.net", "/ES/", None, "allow"),
    ]
    pages = spark.createDataFrame([(k, c[0], "mine") for k, c in enumerate(cases)], "page_id long, url string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge_urls(pages).collect()}
    assert got == {k: c[1:] for k, c in enumerate(cases)}
    assert urls.judge_urls(pages.limit(0)).count() == 0


def test_url_index_takes_the_rarest_token():
    under, always = urls.rule_index(urls.SITE_RULES + (urls.UrlRule("any", ".*x", (), "block", 0),), {"com": 9, "example": 5, "en": 7, "www": 1, "net": 8, "es": 2, "fr": 3})
    assert {t: [r.label for r in rs] for t, rs in under.items()} == {"com": ["com/"], "example": ["example.com/en/"], "www": ["www.example.com/en/"], "es": ["net/es/"], "fr": ["net/fr/"]}
    assert [r.label for r in always] == ["any"]


def test_archive_round_trip(spark, tmp_path):
    long = "<p>žluťoučký " * 30
    rows = [(4, "http://a/\r\nx", long), (2, None, long), (9, "u", "short"), (3, "u", "short"), (5, "u", None), (2, None, long), (None, "u", long), (6, "u", "y" * 300_000)]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, payload string")
    got = {(r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in warc.archive(pages, f"file://{tmp_path}/w").collect()}
    size = len(long.encode())
    assert got == {(4, "revisit", 2, size), (2, "response", None, size), (9, "response", None, 5), (3, "response", None, 5), (5, "response", None, 0), (None, "revisit", 2, size), (6, "response", None, 300_000)}
    read = warc.archive(pages, f"file://{tmp_path}/w2").where("page_id = 2").collect()
    assert [bytes(r.payload) for r in read] == [long.encode()] * 2
    for f in (tmp_path / "w").glob("*.warc.zst"):
        assert f.read_bytes()[:4] == warc.DICTIONARY_FRAME
    assert warc.archive(pages.limit(0)).count() == 0


def test_archives_of_many_records(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(warc, "SAMPLE_BYTES", 20_000)
    pages = spark.createDataFrame([(k, f"http://x/{k}", f"<html>{k} common words of a page {k % 7}</html>" * 3) for k in range(700)], "page_id long, url string, html string")
    got = warc.archive(pages.repartition(2), f"file://{tmp_path}/w")
    assert got.count() == 700 and got.where("record_type = 'revisit'").count() == 0
