import zlib

import numpy as np
import public_tokenizers as tokens
import pytest
from tokenizers import Tokenizer

from marketloom.llm import packing

PATH = tokens.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def theirs():
    return Tokenizer.from_file(PATH)


def check(rows, texts, theirs):
    """Every id in one piece, sequences gapless and within their length."""
    whole = {k: theirs.encode(t or "", add_special_tokens=False).ids + [0] for k, t in texts.items()}
    pieces, at = {}, {}
    for r in rows:
        ids = np.array(whole[r.doc_id][r.start : r.start + r.length], "<u4")
        assert len(ids) == r.length and zlib.crc32(ids.tobytes()) == r.ids_crc32 and r.doc_tokens == len(whole[r.doc_id])
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
        at.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert pieces.keys() == whole.keys()
    for k, found in pieces.items():
        assert [a for a, _ in sorted(found)] == np.cumsum([0] + [n for _, n in sorted(found)])[:-1].tolist()
        assert sum(n for _, n in found) == len(whole[k])
    for found in at.values():
        found.sort()
        assert [a for a, _ in found] == np.cumsum([0] + [n for _, n in found])[:-1].tolist()
        assert found[-1][0] + found[-1][1] <= packing.SEQUENCE
    return len(at), sum(map(len, whole.values()))


def test_query(spark, sf_dir, theirs):
    from marketloom.llm.queries import op9_packing

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    n, total = check(op9_packing(spark, sf_dir).collect(), texts, theirs)
    assert n <= 1.02 * total / packing.SEQUENCE + 2


def test_encoder(theirs):
    rng = np.random.default_rng(2)
    encode = packing._cache(PATH)
    parts = ["a", "the", " ", "  ", "\n", "é", "東京", "<|endoftext|>", "'s", "12", "!?", "\x1c", "\x85", " x"]
    for _ in range(1500):
        t = "".join(rng.choice(parts, rng.integers(0, 20)))
        assert np.frombuffer(encode.packed([t])[0], "<u4").tolist() == theirs.encode(t, add_special_tokens=False).ids, repr(t)


def test_knapsack_against_all_patterns():
    rng = np.random.default_rng(4)
    for _ in range(20):
        sizes = np.unique(rng.integers(2, 9, 4))
        value = rng.random(len(sizes))
        best = 0.0

        def fill(k, room, worth):
            nonlocal best
            best = max(best, worth)
            for j in range(k, len(sizes)):
                if sizes[j] <= room:
                    fill(j, room - sizes[j], worth + value[j])

        fill(0, 20, 0.0)
        got, pattern = packing.price(value, sizes, 20)
        assert abs(got - best) < 1e-9 and pattern @ sizes <= 20 and abs(pattern @ value - got) < 1e-9


def test_patterns_take_exactly_the_counts():
    rng = np.random.default_rng(6)
    for _ in range(10):
        counts = {int(s): int(n) for s, n in zip(rng.integers(1, 257, 40), rng.integers(1, 2000, 40))}
        used, sequences = dict.fromkeys(counts, 0), 0
        for pattern, times in packing.whole_patterns(counts, 256):
            assert sum(s * a for s, a in pattern.items()) <= 256
            sequences += times
            for s, a in pattern.items():
                used[s] += a * times
        assert used == counts
        small = sum(s * n for s, n in counts.items() if s <= 128)
        if small == sum(s * n for s, n in counts.items()):
            assert sequences <= 1.01 * small / 256 + len(counts)


def test_edge_cases(spark, theirs):
    rows = [(1, None, 1), (2, "", 1), (3, "word " * 5000, 1), (3, "word " * 5000, 1), (4, "hi", 1)]
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string, length int"), PATH, with_ids=True).collect()
    assert sum(r.length for r in got) == sum(len(r.ids) for r in got) == sum(len(theirs.encode(t or "").ids) + 1 for _, t, _ in rows)
    assert len({(r.sequence_id, r.offset) for r in got}) == len(got)
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
