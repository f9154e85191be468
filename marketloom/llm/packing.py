"""Packing documents into sequences: cutting stock solved by column generation.

A document's ids, with an end id, are cut into full sequences and a tail, which
is cut at half a sequence if it is longer. Tails are counted by length; a linear program over patterns of lengths that
fit a sequence says how often each pattern is used, new patterns being priced
by a knapsack dynamic program. Rounded patterns are then dealt to the tails by
rank within their length.

Defined cases: a null or empty text is its end id alone; repeated rows are
packed each on its own; other columns are not read; an empty table gives an
empty result.
"""

from __future__ import annotations

import json
import math
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketloom.llm.bpe import ChunkCache
from marketloom.llm.storage import extended, materialise

SEQUENCE = 1024
END_ID = 0
#: Tails are rounded up to this many tokens for the linear program.
GRAIN = 4
MAX_ROUNDS = 1000
#: The program stops within this share of its least number of sequences.
SLACK = 1e-3


def byte_of() -> dict[str, int]:
    """The byte that each printable stand-in of a byte-level vocabulary means."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def load_encoder(path: str) -> Callable[[list[str]], list[list[int]]]:
    """Encoder of a tokenizer file, ids as the tokenizers library gives them.

    Where merges are ranked as their ids are (as in the usual byte-level
    vocabularies), the same ids come faster from the ranks.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    vocab = model.get("vocab", {})
    ranked = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in model.get("merges", [])]
    byte_level = model.get("type") == "BPE" and split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
    if byte_level and not spec.get("normalizer") and not model.get("ignore_merges") and ranked == sorted(ranked):
        import public_tokenizers
        import tiktoken

        table = byte_of()
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(table[c] for c in t): i for t, i in vocab.items() if t not in special}
        fast = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        return lambda texts: [fast.encode(t, allowed_special="all") for t in texts]
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return lambda texts: [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]


@lru_cache(maxsize=2)
def _cache(path: str) -> ChunkCache:
    return ChunkCache(load_encoder(path))


def cuts(n: int) -> list[tuple[int, int]]:
    """Where a document of ``n`` ids is cut: full sequences, then a half if more than that is left, then the rest.

    Without pieces above half a sequence (but full ones) patterns leave hardly
    any room unused.
    """
    at = [*range(0, n, SEQUENCE), n]
    if n % SEQUENCE > SEQUENCE // 2:
        at.insert(-1, n - n % SEQUENCE + SEQUENCE // 2)
    return list(zip(at, at[1:], strict=False))


def cut_documents(docs: DataFrame, path: str, ident: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """A row for each piece: ``doc_id``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens`` (and ``ids``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([END_ID], "<u4").tobytes()
        for b in batches:
            row, start, length, crc, total, ids = [], [], [], [], [], []
            for k, text in enumerate(b.column(1).to_pylist()):
                packed = memoryview(_cache(path).packed([text])[0] + end)
                for at, upto in cuts(len(packed) // 4):
                    piece = packed[4 * at : 4 * upto]
                    row.append(k)
                    start.append(at)
                    length.append(len(piece) // 4)
                    crc.append(zlib.crc32(piece))
                    total.append(len(packed) // 4)
                    if with_ids:
                        ids.append(np.frombuffer(piece, "<i4"))
            columns = [b.column(0).take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
            yield pa.RecordBatch.from_arrays([*columns, *([pa.array(ids, pa.list_(pa.int32()))] if with_ids else [])], schema.names)

    source = docs.select(F.col(f"`{ident}`").alias("doc_id"), F.col(f"`{text}`").alias("_text"))
    schema = source.drop("_text").schema
    for name in ("start", "length", "ids_crc32", "doc_tokens"):
        schema = schema.add(name, "long")
    if with_ids:
        schema = extended(schema, "ids array<int>")
    return source.mapInArrow(run, schema)


def price(value: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The pattern of greatest value: an unbounded knapsack by dynamic programming."""
    best = np.zeros(capacity + 1)
    pick = np.full(capacity + 1, -1)
    for c in range(int(sizes[0]), capacity + 1):
        fit = np.searchsorted(sizes, c, "right")
        got = value[:fit] + best[c - sizes[:fit]]
        k = int(got.argmax())
        if got[k] > best[c - 1] + 1e-12:
            best[c], pick[c] = got[k], k
        else:
            best[c] = best[c - 1]
    pattern, c = np.zeros(len(sizes)), capacity
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            pattern[pick[c]] += 1
            c -= int(sizes[pick[c]])
    return float(best[capacity]), pattern


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Matrix product without a threaded BLAS, which can stall in a driver that has forked."""
    return np.einsum("ij,j...->i...", a, b)


def solve(sizes: np.ndarray, need: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns of patterns and how often (not yet whole) each is used, with as few sequences as the program allows.

    Revised simplex with the inverse of the basis; it begins with patterns of
    one size each and stops when no pattern is worth more than ``SLACK`` above a
    sequence (its value is then at most that share above the least possible).
    Needs are raised by tiny distinct amounts, so that rounds don't stall.
    """
    need = need + 1e-3 * (1 + np.arange(len(sizes))) / len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    inverse = np.diag(1.0 / np.diag(basis))
    use = times(inverse, need)
    for turn in range(MAX_ROUNDS):
        worth, column = price(inverse.sum(axis=0).clip(min=0), sizes, capacity)
        if worth <= 1 + SLACK:
            break
        change = times(inverse, column)
        up = change > 1e-9
        if not up.any():
            break
        ratio = np.where(up, use / np.where(up, change, 1), np.inf)
        out = int(ratio.argmin())
        use = (use - ratio[out] * change).clip(min=0)
        use[out] = ratio[out]
        inverse[out] /= change[out]
        others = np.arange(len(sizes)) != out
        inverse[others] -= np.outer(change[others], inverse[out])
        basis[:, out] = column
        if turn % 200 == 199:  # one Newton step against drift
            inverse = 2 * inverse - times(inverse, times(basis, inverse))
            use = times(inverse, need).clip(min=0)
    return basis, use


def whole_patterns(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Patterns (size to copies) and whole multiplicities that take exactly ``counts``.

    The program's multiplicities are rounded down; what is left (at most one
    pattern's worth for each size) is filled largest first.
    """
    left = {s: n for s, n in sorted(counts.items(), reverse=True) if n > 0}
    found: list[tuple[dict[int, int], int]] = []
    if full := left.pop(capacity, 0):
        found.append(({capacity: 1}, full))
    if left:
        sizes = np.array(sorted(left))
        basis, use = solve(sizes, np.array([left[s] for s in sizes.tolist()], float), capacity)
        for column, times in zip(basis.T, np.floor(use + 1e-9).astype(int).tolist(), strict=True):
            pattern = {s: int(a) for s, a in zip(sizes.tolist(), column.tolist(), strict=True) if a}
            times = min([times, *(left[s] // a for s, a in pattern.items())])
            if times > 0:
                found.append((pattern, times))
                for s, a in pattern.items():
                    left[s] -= times * a
    while any(left.values()):
        room, pattern = capacity, {}
        for s, n in left.items():
            if take := min(n, room // s):
                pattern[s] = take
                room -= take * s
        times = min(left[s] // a for s, a in pattern.items())
        found.append((pattern, times))
        for s, a in pattern.items():
            left[s] -= times * a
    return found


def pack(pieces: DataFrame, grain: int = GRAIN) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``.

    Only the histogram of rounded lengths comes to the driver: at most
    SEQUENCE / ``grain`` rows at any input size. Ranks within a length are made
    of counts by hashed chunk and numbers within a chunk, so no window holds a
    whole length; the number of chunks grows with the square root of the rows.
    """
    spark = pieces.sparkSession
    sized = pieces.withColumn("_size", F.ceil(F.col("length") / grain).cast("int"))
    histogram = {r["_size"]: r["n"] for r in sized.groupBy("_size").agg(F.count("*").alias("n")).collect()}
    slots, first, at = [], 0, dict.fromkeys(histogram, 0)
    for pattern, times in whole_patterns(histogram, SEQUENCE // grain):
        for s, copies in pattern.items():
            slots.append((s, at[s], at[s] + times * copies, copies, first))
            at[s] += times * copies
        first += times
    table = spark.createDataFrame(slots, "_size int, _from long, _to long, _copies int, _first long")
    n_chunks = math.isqrt(sum(histogram.values())) + 1
    order = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    dealt = sized.withColumn("_chunk", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(n_chunks)))
    before = Window.partitionBy("_size").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("_size", "_chunk").agg(F.count("*").alias("_n")).select("_size", "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    numbered = dealt.withColumn("_nth", F.row_number().over(Window.partitionBy("_size", "_chunk").orderBy(*order)) - 1)
    ranked = numbered.join(offsets, ["_size", "_chunk"]).withColumn("_rank", F.col("_before") + F.col("_nth"))
    # Patterns are few whatever the input, so the slots may be sent to every task.
    placed = ranked.join(F.broadcast(table), "_size").where((F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))
    within = F.col("_rank") - F.col("_from")
    placed = placed.withColumn("sequence_id", F.col("_first") + F.expr("(_rank - _from) div _copies")).withColumn("_slot", within % F.col("_copies"))
    filled = Window.partitionBy("sequence_id").orderBy(F.desc("_size"), "_slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select(*pieces.columns, "sequence_id", F.coalesce(F.sum("length").over(filled), F.lit(0)).alias("offset"))


def pack_documents(docs: DataFrame, path: str, ident: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of every row of ``docs`` with their place: tokenized once, then packed by their lengths alone.

    Ids stay where they are while pieces are packed, and move once, to the place of their piece.
    """
    pieces = cut_documents(docs, path, ident, text, with_ids)
    if not with_ids:
        return pack(materialise(pieces))
    numbered = materialise(pieces.withColumn("_piece", F.monotonically_increasing_id()))
    placed = pack(numbered.drop("ids")).join(numbered.select("_piece", "ids"), "_piece")
    return placed.select(*pieces.columns, "sequence_id", "offset")
