"""Byte-level BPE: encoding by a segment tree over byte positions, and decoding.

Defined cases: a null text counts as empty and has no ids; repeated rows are
encoded alike; other columns pass through; an empty table gives an empty
result. The vocabulary file is a parameter and must be readable on executors.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from marketloom.llm.storage import beside

NONE = 1 << 40


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: again and again the leftmost pair of least rank is merged.

    Leaf i of the tree holds the rank of the pair that begins at byte i, if a
    live token begins there; each node above holds the least below it. A merge
    changes the leaves of the merged token, of its right half and of its left
    neighbour, whose ancestors are renewed together on the way to the root.
    """
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    width = 1 << (n - 1).bit_length()
    get = ranks.get
    tree = [NONE] * width + [get(piece[i : i + 2], NONE) for i in range(n - 1)]
    tree += [NONE] * (2 * width - len(tree))
    for k in range(width - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a <= b else b
    end = list(range(1, n + 1))
    before = list(range(-1, n))
    while (rank := tree[1]) != NONE:
        k = 1
        while k < width:
            k *= 2
            if tree[k] != rank:
                k += 1
        i = k - width
        j = end[i]
        stop = end[j]
        end[i] = stop
        p = before[i]
        tree[width + j] = NONE
        if stop < n:
            before[stop] = i
            tree[k] = get(piece[i : end[stop]], NONE)
        else:
            tree[k] = NONE
        if p >= 0:
            tree[width + p] = get(piece[p:stop], NONE)
        else:
            p = i
        up, of_j, of_p = k >> 1, (width + j) >> 1, (width + p) >> 1
        while up:
            a, b = tree[2 * up], tree[2 * up + 1]
            tree[up] = a if a <= b else b
            if of_j != up:
                a, b = tree[2 * of_j], tree[2 * of_j + 1]
                tree[of_j] = a if a <= b else b
            if of_p != up:
                a, b = tree[2 * of_p], tree[2 * of_p + 1]
                tree[of_p] = a if a <= b else b
            up, of_j, of_p = up >> 1, of_j >> 1, of_p >> 1
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : end[i]]])
        i = end[i]
    return ids


#: Pieces of at most so many bytes are merged side by side.
SIDE_BY_SIDE = 64
_NO_RANK = np.int32((1 << 31) - 1)


class PairRanks:
    """Rank of each pair of tokens whose bytes together are a token: sorted keys of all splits of all tokens."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        get = ranks.get
        found = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = get(token[:cut]), get(token[cut:])
                if a is not None and b is not None:
                    found[a << 32 | b] = rank
        self.keys = np.fromiter(sorted(found), np.int64, len(found))
        self.ranks = np.append(np.fromiter((found[k] for k in self.keys.tolist()), np.int32, len(found)), _NO_RANK)
        self.keys = np.append(self.keys, np.int64(-1))
        self.byte = np.array([get(bytes([b]), -1) for b in range(256)], np.int32)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 32 | b
        at = np.searchsorted(self.keys[:-1], key)
        return np.where(self.keys[at] == key, self.ranks[at], _NO_RANK)


def merge_side_by_side(pieces: list[bytes], pairs: PairRanks, width: int) -> list[list[int]]:
    """:func:`merge` of pieces of two to ``width`` bytes (a power of two), a step of all of them at once: row r holds the tree of piece r."""
    size = np.array([len(p) for p in pieces])
    octets = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(-1, width)
    token = pairs.byte[octets]
    tree = np.full((len(pieces), 2 * width), _NO_RANK, np.int32)
    inside = np.arange(1, width) < size[:, None]
    tree[:, width:-1][inside] = pairs(token[:, :-1][inside], token[:, 1:][inside])
    at = width
    while at > 1:
        tree[:, at // 2 : at] = np.minimum(tree[:, at : 2 * at : 2], tree[:, at + 1 : 2 * at : 2])
        at //= 2
    end = np.tile(np.arange(1, width + 1), (len(pieces), 1))
    before = np.tile(np.arange(-1, width), (len(pieces), 1))
    live = np.ones((len(pieces), width), bool)
    live[:, 1:] = inside
    row = np.arange(len(pieces))
    while len(row := row[tree[row, 1] != _NO_RANK]):
        rank = tree[row, 1]
        k = np.ones(len(row), np.int64)
        for _ in range(width.bit_length() - 1):
            k *= 2
            k += tree[row, k] != rank
        i = k - width
        j = end[row, i]
        stop = end[row, j]
        end[row, i] = stop
        token[row, i] = rank
        live[row, j] = False
        p = before[row, i]
        before[row, stop] = i
        # Leaves of the merged token, of its right half and of its left neighbour.
        right, left = stop < size[row], p >= 0
        new = np.full(len(row), _NO_RANK, np.int32)
        new[right] = pairs(rank[right], token[row[right], stop[right]])
        tree[row, k] = new
        tree[row, width + j] = _NO_RANK
        p = np.where(left, p, i)
        tree[row[left], width + p[left]] = pairs(token[row[left], p[left]], rank[left])
        nodes = np.stack([k, width + j, width + p])
        for _ in range(width.bit_length() - 1):
            nodes >>= 1
            tree[row, nodes] = np.minimum(tree[row, 2 * nodes], tree[row, 2 * nodes + 1])
    ids, upto = token[live].tolist(), np.cumsum(live.sum(axis=1)).tolist()
    return [ids[a:b] for a, b in zip([0, *upto], upto, strict=False)]


#: A space between two characters that are not blank always begins a new piece.
_GAP = regex.compile(r"(?<=[^\s\x1c-\x1f]) (?=[^\s\x1c-\x1f])")
_ODD = regex.compile(r"(?:^|[\s\x1c-\x1f]) | (?:[\s\x1c-\x1f]|$)")


def chunks(text: str) -> list[str]:
    """``text`` cut at spaces where pieces begin in any case; those spaces are left out."""
    return _GAP.split(text) if _ODD.search(text) else text.split(" ")


class ChunkCache:
    """Packed ids of chunks, the recently used ones kept: two generations of at most ``size`` entries.

    ``encode`` gets a list of chunk texts and gives the ids of each.
    """

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], size: int = 300_000) -> None:
        self.encode, self.size = encode, size
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _fetch(self, missing: set[str]) -> None:
        found = {c: self.old[c] for c in missing if c in self.old}
        new = [c for c in missing if c not in found]
        found.update(zip(new, (np.array(x, "<u4").tobytes() for x in self.encode([" " + c for c in new])), strict=True))
        if len(self.young) + len(found) > self.size:
            self.old, self.young = self.young, {}
        self.young.update(found)

    def packed(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        found = [chunks(text) if text else [] for text in texts]
        heads = self.encode([c[0] for c in found if c])
        missing: set[str] = set()
        for c in found:
            missing.update(c[1:])
        missing = missing.difference(self.young)
        if missing:
            self._fetch(missing)
        young, old = self.young, self.old  # a fetch may have turned young into old
        out, head = [], iter(heads)
        for c in found:
            if not c:
                out.append(b"")
                continue
            rest = c[1:]
            parts = [young[x] if x in young else old[x] for x in rest] if missing else map(young.__getitem__, rest)
            out.append(np.array(next(head), "<u4").tobytes() + b"".join(parts))
        return out


def together(texts: list[str | None], size: int = 1 << 19) -> Iterator[list[str | None]]:
    """``texts`` in lists of about ``size`` characters."""
    held: list[str | None] = []
    n = 0
    for text in texts:
        held.append(text)
        n += len(text or "")
        if n >= size:
            yield held
            held, n = [], 0
    if held:
        yield held


@lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Codec:
    """Encoder and decoder of one rank file."""

    def __init__(self, path: str, pattern: str, pieces: int = 100_000) -> None:
        self.ranks = load_ranks(path)
        self.tokens = {i: t for t, i in self.ranks.items()}
        self.decimal = {i: b"%d" % i for i in self.tokens}
        self.pairs = PairRanks(self.ranks)
        self.find = regex.compile(pattern).findall
        self.known: dict[str, list[int]] = {}
        self.pieces = pieces
        self.cache = ChunkCache(self._encode)

    def _merged(self, pieces: list[str]) -> dict[str, list[int]]:
        """Ids of each of ``pieces``, which differ; those of one width go side by side."""
        out: dict[str, list[int]] = {}
        by_width: dict[int, tuple[list[str], list[bytes]]] = {}
        for piece in pieces:
            octets = piece.encode()
            whole = self.ranks.get(octets)
            if whole is not None:
                out[piece] = [whole]
            elif len(octets) > SIDE_BY_SIDE:
                out[piece] = merge(octets, self.ranks)
            else:
                names, all_octets = by_width.setdefault(1 << (len(octets) - 1).bit_length(), ([], []))
                names.append(piece)
                all_octets.append(octets)
        for width, (names, all_octets) in by_width.items():
            out.update(zip(names, merge_side_by_side(all_octets, self.pairs, width), strict=True))
        return out

    def _encode(self, texts: list[str]) -> list[list[int]]:
        found = [self.find(text) for text in texts]
        known = self.known
        ids = {piece: known.get(piece) for pieces in found for piece in pieces}
        new = self._merged([piece for piece, got in ids.items() if got is None])
        ids.update(new)
        if len(known) + len(new) > self.pieces:
            known.clear()
        known.update((piece, got) for piece, got in new.items() if len(piece) <= 64)
        return [ids[pieces[0]] if len(pieces) == 1 else [i for piece in pieces for i in ids[piece]] for pieces in found]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        return [np.frombuffer(p, "<u4") for p in self.cache.packed(texts)]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def joined(self, ids: list[int]) -> bytes:
        return b",".join(map(self.decimal.__getitem__, ids))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encode_documents(docs: DataFrame, keep: list[str], path: str, pattern: str, text: str = "text") -> DataFrame:
    """``keep`` and ``ids`` (array of int) for each row."""
    run = lambda texts: [pa.array([x.view("<i4") for some in together(texts) for x in codec(path, pattern).encode(some)], pa.list_(pa.int32()))]
    return beside(docs, keep, F.col(f"`{text}`"), "ids array<int>", run)


def decode_documents(encoded: DataFrame, path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """Columns of ``encoded`` but ``ids``, and ``decoded`` (binary); null ids give null."""
    run = lambda rows: [pa.array([None if x is None else codec(path, pattern).decode(x) for x in rows], pa.binary())]
    return beside(encoded, [c for c in encoded.columns if c != ids], F.col(f"`{ids}`"), "decoded binary", run)


def round_trip(docs: DataFrame, keep: list[str], path: str, pattern: str, text: str = "text") -> DataFrame:
    """``keep``, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``: encoded and decoded in one pass."""
    from hashlib import sha256

    def run(texts: list[str | None]) -> list[pa.Array]:
        c = codec(path, pattern)
        n, a, b = [], [], []
        for some in together(texts):
            for found in c.encode(some):
                ids = found.tolist()
                n.append(len(ids))
                a.append(sha256(c.joined(ids)).hexdigest())
                b.append(sha256(c.decode(ids)).hexdigest())
        return [pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]

    return beside(docs, keep, F.col(f"`{text}`"), "n_tokens long, ids_sha256 string, decoded_sha256 string", run)
