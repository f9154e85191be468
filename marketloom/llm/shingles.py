"""Classes of documents whose sets of word runs have Jaccard similarity of at least ``SIMILARITY``.

The near-dedup of :mod:`simhash` for a wider bound than its few bits allow:
equal sets of runs are one node; each gets a SimHash fingerprint and blocked
codes (:mod:`blocks`). Those that meet in a bucket of a block are searched by
the Gray-order index within ``MAX_BITS``, and the exact similarity of the sets
links them. Linked nodes are united.

Defined cases: texts without words have the empty set and are one class; rows
that share id and text count once; null ids come after all others; an empty
table stays empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.blocks import block_keys, linked, majority_bits, mixed
from marketloom.llm.lines import hashed_words
from marketloom.llm.simhash import drop_marked
from marketloom.llm.storage import extended, materialise, release, sent

WIDTH = 5
SIMILARITY = 0.8
#: At similarity 0.8 fingerprints differ in 10 bits on average, and hardly ever in more than this.
MAX_BITS = 20
_FIELDS = "key binary, node long, fp long, keys array<long>"
_LOWER = bytes(c + 32 if 65 <= c <= 90 else 32 if 9 <= c <= 13 else c for c in range(256))


def shingle_set(text: bytes, width: int = WIDTH) -> np.ndarray:
    """Sorted hashes of the runs of ``width`` words, of all words if there are fewer; none without words."""
    h, _, _ = hashed_words(text.translate(_LOWER))
    if not len(h):
        return h
    width = min(width, len(h))
    run = np.zeros(len(h) - width + 1, np.uint64)
    for k in range(width):
        run = mixed(run + h[k : len(h) - width + 1 + k] * np.uint64(0x9E3779B97F4A7C15))
    return np.unique(run)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def _signed(docs: DataFrame, keep: str, text: str, width: int) -> DataFrame:
    source = docs.select(keep, F.col(text).cast("binary").alias("body"))
    schema = extended(source.drop("body").schema, _FIELDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, fps, buckets = [], [], []
            for t in b.column(1).to_pylist():
                found = shingle_set(t or b"", width)
                keys.append(xxhash.xxh3_128_digest(found.tobytes()))
                fps.append(majority_bits(found, np.zeros(1, np.int64))[0] if len(found) else 0)
                buckets.append(block_keys(found, np.zeros(len(found), np.int64), 1)[1].view(np.int64) if len(found) else [])
            nodes = [int.from_bytes(k[:8], "big", signed=True) for k in keys]
            columns = [pa.array(keys, pa.binary()), pa.array(nodes, pa.int64()), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(buckets, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], schema.names)

    return source.mapInArrow(run, schema)


def drop_similar(docs: DataFrame, ident: str = "doc_id", text: str = "text", width: int = WIDTH, least: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that are the first of their class: least id, then least text, one of rows equal in both."""
    row = F.struct(F.col(f"`{ident}`").isNull().alias("late"), F.col(f"`{ident}`").alias("ident"), F.xxhash64(F.col(f"`{text}`")).alias("hash"))
    bodies = docs.select(row.alias("row"), F.col(f"`{text}`").alias("text"))
    rows = materialise(_signed(bodies, "row", "text", width))
    nodes = materialise(rows.groupBy("key").agg(F.min("row").alias("least"), F.min("node").alias("node")))
    signed = materialise(rows.where(F.size("keys") > 0).select("node", "fp", "keys").dropDuplicates(["node"]))

    def fetch(wanted: DataFrame, most: int) -> DataFrame:
        """The sets of the nodes asked for, from the first row of each."""
        places = nodes.join(wanted, "node").select("least", "node", "key")
        here = sent(places.select(F.col("least.ident").alias("at"), F.col("least.hash").alias("hash"), "node", "key"), most * 128)
        same = F.col("row.ident").eqNullSafe(F.col("at")) & (F.col("row.hash").eqNullSafe(F.col("hash")))
        return bodies.join(here, same).select("node", "key", "text").mapInArrow(sets, "node long, key binary, body binary").dropDuplicates(["key"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shingle_set((t or "").encode(), width).tobytes() for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.binary())], ["node", "key", "body"])

    def similar(a: bytes, b: bytes) -> bool:
        return similarity(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)) >= least

    linked_keys = linked(signed, fetch, similar, MAX_BITS)
    members = materialise(linked_keys.join(nodes, "key").select("key", "group", F.col("least").alias("own")))
    named = materialise(members.groupBy("group").agg(F.min("own").alias("named")))
    of_key = members.join(named, "group").select("key", "named")
    classes = materialise(nodes.join(of_key, "key", "left").select("key", F.coalesce("named", "least").alias("first")))
    marked = rows.select("row", "key").join(classes, "key")
    stays = materialise(marked.select("row.ident", "row.hash", (F.col("row") == F.col("first")).alias("stays")))
    release(rows, nodes, signed, linked_keys, members, named, classes)
    return drop_marked(docs, stays, ident, text)
