"""The pipeline stage by stage against plain versions, each on what its predecessor kept."""

from collections import defaultdict

import public_tokenizers
from test_lines import plain as removed_by_comparing_all
from tokenizers import Tokenizer

import corpus_pipeline
from marketloom.llm import pii, shingles
from marketloom.llm.queries import BYTE_BPE
from marketloom.llm.queries_sql import SQL
from marketloom.llm.storage import materialise


def rows_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()), key=str)


def test_stages(spark, sf_dir, duck):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality rules", "line dedup", "near dedup", "personal data", "packing"]

    kept = materialise(stages["quality rules"](spark, docs, sf_dir))
    wanted = {r[0] for r in duck.execute(f"SELECT doc_id FROM ({SQL['op7_quality']}) x WHERE kept").fetchall()}
    assert rows_of(kept) == [r for r in rows_of(docs) if r[0] in wanted] and kept.columns == docs.columns

    lined = materialise(stages["line dedup"](spark, kept, sf_dir))
    before = rows_of(kept)
    gone = removed_by_comparing_all([(r[0], r[1]) for r in before])
    cut = []
    for doc_id, text, *rest in before:
        left = None if text is None else "\n".join(x for n, x in enumerate(text.split("\n")) if n not in gone.get((doc_id, text), []))
        cut.append((doc_id, left, *rest[:2], None if left is None else len(left)))
    assert rows_of(lined) == sorted(cut, key=str)

    single = materialise(stages["near dedup"](spark, lined, sf_dir))
    rows = sorted(rows_of(lined))
    sets = [set(shingles.shingle_set((r[1] or "").encode()).tolist()) for r in rows]
    label = list(range(len(rows)))

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    assert rows_of(single) == sorted((r for k, r in enumerate(rows) if root(k) == k), key=str)

    clean = materialise(stages["personal data"](spark, single, sf_dir))
    field = pii.train(single)
    redacted = [(k, t if t is None else pii.redacted(t, pii.spans_of(t, field)[1]), *rest[:2]) for k, t, *rest in rows_of(single)]
    assert rows_of(clean) == sorted(((*r, None if r[1] is None else len(r[1])) for r in redacted), key=str)

    pieces = stages["packing"](spark, clean, sf_dir).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path(BYTE_BPE))
    of, spans = defaultdict(list), defaultdict(list)
    for p in pieces:
        of[p.doc_id].append(p)
        spans[p.sequence_id].append((p.offset, p.length))
    for doc_id, text, *_ in rows_of(clean):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        found = sorted(of[doc_id], key=lambda p: p.start)
        assert [x for p in found for x in p.ids] == ids and [p.start for p in found] == [sum(q.length for q in found[:k]) for k in range(len(found))]
    for held in spans.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 1024

    assert corpus_pipeline.run(spark, sf_dir).count() == len(pieces)


def test_an_empty_table(spark, sf_dir, tmp_path):
    spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
