"""Document fingerprints by winnowing.

Every run of ``GRAM`` code points is hashed by a rolling polynomial; of each
``WINDOW`` runs side by side the least hash is kept, the rightmost on ties, with
its position. Two texts that share ``GRAM + WINDOW - 1`` code points share a
kept hash; what is shorter than ``GRAM`` is never matched, except whole texts.

Defined cases: a null or empty text keeps nothing, and two such texts are alike
(1.0); a text shorter than ``GRAM`` keeps the hash of the whole; of repeated ids
the lesser text comes first, null before all; null ids come last; ids of any
type that can be ordered are taken as they are; other columns are not read; an empty table gives an empty result; a single document is its
own successor.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketloom.llm.storage import beside, extended, materialise


GRAM = 32
WINDOW = 32
_BASE = 0x9E3779B97F4A7C15
_POSITION = 24
_BLOCK = 1 << 23


def gram_hashes(codes: np.ndarray) -> np.ndarray:
    """64-bit hashes of all runs of ``GRAM`` code points, by doubling (GRAM is a power of two)."""
    h, width = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93), 1
    while width < GRAM and len(h) > width:
        factor = np.uint64(pow(_BASE, width, 1 << 64))
        h = h[:-width] * factor + h[width:]
        width *= 2
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def winnow(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Kept hashes (40 bits) and their positions, in order of position."""
    codes = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), "<u4")
    if not len(codes):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(codes) < GRAM:
        whole = int.from_bytes(blake2b(codes.tobytes(), digest_size=5).digest(), "little")
        return np.array([whole], np.uint64), np.zeros(1, np.int64)
    low = np.uint64((1 << _POSITION) - 1)
    hashes, places = [], []
    n = len(codes) - GRAM + 1
    for at in range(0, max(1, n - WINDOW + 1), _BLOCK):
        # Blocks overlap by a window, so each window lies within one block.
        h = gram_hashes(codes[at : at + _BLOCK + WINDOW + GRAM - 2])
        key = (h & ~low) | (low - np.arange(len(h), dtype=np.uint64))
        width = 1
        while width < WINDOW and len(key) > width:
            step = min(width, WINDOW - width)
            key = np.minimum(key[:-step], key[step:])
            width += step
        if width < WINDOW:
            key = key.min(keepdims=True)
        key = key[np.append(True, key[1:] != key[:-1])]
        hashes.append(key >> np.uint64(_POSITION))
        places.append((low - (key & low)).astype(np.int64) + at)
    h, p = np.concatenate(hashes), np.concatenate(places)
    fresh = np.append(True, p[1:] != p[:-1])
    return h[fresh], p[fresh]


def digest(kept: tuple[np.ndarray, np.ndarray]) -> str:
    return blake2b(kept[0].tobytes() + kept[1].tobytes(), digest_size=16).hexdigest()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Resemblance: shared hashes over all hashes of two sorted sets; 1 if both are empty."""
    if not len(a) and not len(b):
        return 1.0
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (len(a) + len(b) - shared)


def fingerprint_documents(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep``, ``hashes`` and ``positions`` for each row; nothing is shuffled."""

    def run(texts: list[str | None]) -> list[pa.Array]:
        kept = [winnow(t) for t in texts]
        return [pa.array([x[k].astype(np.int64) for x in kept], pa.list_(pa.int64())) for k in (0, 1)]

    return beside(docs, keep, F.col(f"`{text}`"), "hashes array<long>, positions array<long>", run)


def compared(body: str, kept: tuple, unique: np.ndarray, after: str, after_unique: np.ndarray) -> tuple:
    """Results for a text whose successor is ``after``."""
    half = len(body) // 2
    edited = body[: len(body) - half] + after[:half]
    new = winnow(edited)
    return len(body), sha256(edited.encode()).hexdigest(), digest(kept), digest(new), likeness(unique, np.unique(new[0])), likeness(unique, after_unique)


_RESULT = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_TYPES = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]


def edited_fingerprints(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """``ident``, and fingerprints of each text, of its edited text, and their likeness to each other and to the next text's.

    Successors go by descending id, and from the last to the first. The texts
    are shuffled once, into ranges of that order, where the row after each is
    its successor; the ranges are cut by id and the opening of the text, so
    rows without an id, or with one id, need not share a task. The first and
    the last text of each range are written beside the results and meet in a
    join; nothing is gathered on the driver.
    """
    name = F.col(f"`{ident}`")
    order = [F.desc_nulls_last("id"), F.asc_nulls_first("text")]
    rows = docs.select(name.alias("id"), F.col(f"`{text}`").alias("text"))
    ranged = rows.repartitionByRange(order[0], F.substring("text", 1, 64).asc_nulls_first()).sortWithinPartitions(*order)
    schema = extended(rows.select("id").schema, f"{_RESULT}, part int, head string, tail string")
    kind = [*_TYPES, pa.int32(), pa.string(), pa.string()]

    def batch(ids: list, columns: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
        fields = list(zip(*columns, strict=True)) if columns else [()] * len(kind)
        return pa.RecordBatch.from_arrays([pa.array(ids, id_type), *(pa.array(c, t) for c, t in zip(fields, kind, strict=True))], schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, id_type = TaskContext.get().partitionId(), None, None
        for b in batches:
            ids, out, id_type = [], [], b.column(0).type
            for key, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                body = body or ""
                kept = winnow(body)
                unique = np.unique(kept[0])
                if held is None:
                    ids.append(None)
                    out.append((None,) * 6 + (part, body, None))
                else:
                    ids.append(held[0])
                    out.append(compared(*held[1:], body, unique) + (None, None, None))
                held = key, body, kept, unique
            yield batch(ids, out, id_type)
        if held is not None:
            yield batch([held[0]], [(None,) * 6 + (part, None, held[1])], id_type)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for body, after in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                kept, other = winnow(body), winnow(after)
                out.append(compared(body, kept, np.unique(kept[0]), after, np.unique(other[0])))
            fields = list(zip(*out, strict=True)) if out else [()] * len(_TYPES)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(fields, _TYPES, strict=True))], schema.names[:7])

    found = materialise(ranged.mapInArrow(run, schema))
    heads, tails = found.where("head is not null").select("part", "head"), found.where("tail is not null").select("id", "part", "tail")
    # As many rows as there are ranges, each a number.
    around = Window.orderBy("part")
    follows = heads.select("part", F.coalesce(F.lead("part").over(around), F.min("part").over(around.rowsBetween(Window.unboundedPreceding, Window.currentRow))).alias("next"))
    ends = tails.join(follows, "part").join(heads.select(F.col("part").alias("next"), "head"), "next")
    met = ends.select("id", "tail", "head").mapInArrow(meet, extended(rows.select("id").schema, _RESULT))
    return found.where("part is null").select(met.columns).unionByName(met).withColumnRenamed("id", ident)
