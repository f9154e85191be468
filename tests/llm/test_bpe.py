import base64
import random
from hashlib import sha256

import public_tokenizers as tokens
import pytest
import tiktoken

from marketloom.llm import bpe

PATH = tokens.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def theirs():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_random_texts(theirs):
    random.seed(3)
    alphabet = ["a", "b", "the", "The", " ", "  ", "\n", "\t", "\x1c", "\x1f", "\x85", " ", "　", "\xa0", "'s", "'LL", "12", "é", "ß", "東", "京", "🙂", "​", "!", "--", "\r\n", "ﬁ", "\x00", "<|endoftext|>"]
    codec = bpe.codec(PATH, tokens.PATTERN)
    for n in range(3000):
        text = "".join(random.choices(alphabet, k=random.randint(0, 30)))
        ids = codec.encode([text])[0].tolist()
        assert ids == theirs.encode_ordinary(text), repr(text)
        assert codec.decode(ids) == text.encode()


def test_long_pieces(theirs):
    codec = bpe.codec(PATH, tokens.PATTERN)
    for text in ("a" * 5000, "ab" * 3001, "東京" * 2000, " " * 4000 + "x", "x" * 3 + "\n" * 3000):
        assert codec.encode([text])[0].tolist() == theirs.encode_ordinary(text)


def test_whole_table(spark, sf_dir, theirs):
    from marketloom.llm.queries import op2_byte_bpe

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r.doc_id: r for r in op2_byte_bpe(spark, sf_dir).collect()}
    assert got.keys() == texts.keys()
    for k, t in texts.items():
        ids = theirs.encode_ordinary(t or "")
        assert got[k].n_tokens == len(ids)
        assert got[k].ids_sha256 == sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[k].decoded_sha256 == sha256((t or "").encode()).hexdigest()


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 2), (3, "hi there", 3), (3, "hi there", 3)], "doc_id long, text string, ids long")
    coded = bpe.encode_documents(docs.drop("ids"), ["doc_id"], PATH, tokens.PATTERN)
    back = bpe.decode_documents(coded, PATH, tokens.PATTERN)
    assert sorted(bytes(r.decoded) for r in back.collect()) == [b"", b"", b"hi there", b"hi there"]
    assert bpe.round_trip(docs.limit(0), ["doc_id"], PATH, tokens.PATTERN).count() == 0


def test_side_by_side(theirs, monkeypatch):
    """Short pieces of a batch are merged together, as each would be alone; none goes by itself."""
    random.seed(4)
    codec = bpe.Codec(PATH, tokens.PATTERN)
    alphabet = ["a", "e", "th", "ing", "s", "é", "ß", "東", "🙂", "\x00", "qz"]
    words = ["".join(random.choices(alphabet, k=random.randint(1, 20))) for _ in range(3000)]
    for width in (2, 4, 8, 16, 32, 64):
        pieces = [p for w in words if max(width // 2, 1) < len(p := w.encode()) <= width and p not in codec.ranks]
        assert pieces or width == 2
        if pieces:
            assert bpe.merge_side_by_side(pieces, codec.pairs, width) == [bpe.merge(p, codec.ranks) for p in pieces]
    monkeypatch.setattr(bpe, "merge", None)
    texts = [" ".join(random.choices(words, k=40)) for _ in range(50)]
    texts = [t for t in texts if max(len(p.encode()) for p in codec.find(t)) <= bpe.SIDE_BY_SIDE]
    assert len(texts) > 5
    for text, ids in zip(texts, codec.encode(texts), strict=True):
        assert ids.tolist() == theirs.encode_ordinary(text)
