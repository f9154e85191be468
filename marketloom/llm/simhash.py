"""SimHash fingerprints and near-duplicate classes.

Fingerprints are linked through a Gray-order hierarchical index. Blocks of bits
that two near fingerprints must share route them to the same bucket; in a
bucket, fingerprints sorted by Gray rank are grouped, each group keeps the bits
that its members share, and a pair of groups whose shared bits already differ
too often is dropped with all its members.

Defined cases: a null or empty text has no words and fingerprint zero, linked
like any other; repeated rows get equal rows; a null doc_id never names a class
unless nothing else is in it; an empty table gives an empty result; other
columns are not read; a kept column named as a result makes that ``_fp`` or
``_component_id``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.llm.components import connected_components
from marketloom.llm.storage import beside, fresh, materialise

WIDTH = 4
SEED = 42
MAX_BITS = 4
#: Buckets above this many rows are split into cells of at most twice as many.
BUCKET_ROWS = 1024
FANOUT = 2
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingle_hashes(text: bytes, width: int = WIDTH) -> list[int]:
    """XXH64 of each run of ``width`` words (all words if there are fewer)."""
    words = text.translate(_LOWER).split()
    if not words:
        return []
    line = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return [digest(line, SEED)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return [digest(line[a:b], SEED) for a, b in zip(starts[: 1 - width].tolist(), ends[width - 1 :].tolist(), strict=True)]


def majority(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """One fingerprint for each run of ``hashes``: the bits set in over half of it."""
    sizes = np.diff(np.append(starts, len(hashes)))
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
    return np.packbits(2 * ones > sizes[:, None], axis=1, bitorder="little").view("<u8").ravel()


def fingerprints(texts: list[bytes | None], hashes=shingle_hashes, chunk: int = 50_000) -> np.ndarray:
    """A fingerprint for each text; memory stays near ``chunk`` hashes or one text."""
    out = np.zeros(len(texts), np.uint64)
    held: list[int] = []
    owners: list[int] = []
    starts: list[int] = []

    def flush() -> None:
        if held:
            out[owners] = majority(np.array(held, np.uint64), np.array(starts))
        held.clear(), owners.clear(), starts.clear()

    for k, text in enumerate(texts):
        got = hashes(text or b"")
        if got:
            owners.append(k)
            starts.append(len(held))
            held.extend(got)
        if len(held) >= chunk:
            flush()
    flush()
    return out


def with_fingerprint(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` and ``fp`` (64 bits as a signed long) for each row."""
    return beside(docs, keep, F.col(f"`{text}`").cast("binary"), "fp long", lambda texts: [pa.array(fingerprints(texts).view(np.int64))])


def gray_rank(fp: Column) -> Column:
    """Place of a code in Gray order (its bits above and including each position, xored)."""
    for shift in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, shift))
    return fp


def block_masks(n: int, max_bits: int, target: int = BUCKET_ROWS // 4) -> list[int]:
    """Masks of bits such that near codes agree on at least one of them.

    The word is cut into ``b`` blocks; codes that differ in ``max_bits`` bits
    agree on ``b - max_bits`` of them. ``b`` is the smallest for which evenly
    spread codes fill a bucket with at most ``target`` of the ``n``.
    """
    for blocks in range(max_bits + 1, 2 * max_bits + 3):
        agree = blocks - max_bits
        if n / 2 ** (64 * agree // blocks) <= target:
            break
    edges = [64 * k // blocks for k in range(blocks + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(parts, agree)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def routed(rows: DataFrame, max_bits: int, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``rows`` (with a column ``fp``) once for each bucket, with ``mask_id``, ``key``, ``cell_a``, ``cell_b``.

    A bucket that holds more than ``bucket_rows`` is dealt into cells by pairs
    of salts, so every two of its rows still meet in one cell and no task gets
    more than twice ``bucket_rows`` of it.
    """
    n = rows.count()
    masks = block_masks(n, max_bits, bucket_rows // 4)
    each = F.array(*(F.struct(F.lit(k).alias("mask_id"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for k, m in enumerate(masks)))
    spread = rows.select("*", F.inline(each))
    counts = spread.groupBy("mask_id", "key").agg(F.count("*").alias("_n"))
    hot = materialise(counts.where(F.col("_n") > bucket_rows).select("mask_id", "key", F.ceil(F.col("_n") / (bucket_rows / 2)).cast("int").alias("_k")))
    spread = spread.join(hot, ["mask_id", "key"], "left").withColumn("_k", F.coalesce("_k", F.lit(1)))
    salt = F.pmod(F.xxhash64(*rows.columns), F.col("_k")).cast("int")
    return (
        spread.withColumn("_s", salt)
        .withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
        .select(*rows.columns, "mask_id", "key", F.least("_s", "_o").alias("cell_a"), F.greatest("_s", "_o").alias("cell_b"))
    )


CELL = ("mask_id", "key", "cell_a", "cell_b")


def whole_groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Tables that never cut a run of equal ``keys``; rows come sorted by them."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        change = np.zeros(b.num_rows, bool)
        for k in keys:
            v = b.column(b.schema.get_field_index(k)).to_numpy(zero_copy_only=False)
            change[1:] |= v[1:] != v[:-1]
            change[0] |= bool(held) and held[-1].column(held[-1].schema.get_field_index(k))[-1].as_py() != v[0]
        cuts = np.flatnonzero(change)
        if len(cuts):
            ready = [*held, b.slice(0, int(cuts[-1]))]
            held = [b.slice(int(cuts[-1]))]
            table = pa.Table.from_batches([x for x in ready if x.num_rows] or ready[:1])
            if table.num_rows:
                yield table
        else:
            held.append(b)
    if held:
        yield pa.Table.from_batches(held)


def group_starts(table: pa.Table, keys: tuple[str, ...]) -> np.ndarray:
    change = np.zeros(table.num_rows, bool)
    change[0] = True
    for k in keys:
        v = table.column(k).to_numpy()
        change[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(change)


def gray_order(codes: np.ndarray) -> np.ndarray:
    """Ranks of codes in Gray order, as :func:`gray_rank` gives them."""
    for shift in (1, 2, 4, 8, 16, 32):
        codes = codes ^ codes >> np.uint64(shift)
    return codes


def near_pairs(x: np.ndarray, groups: np.ndarray, max_bits: int, chunk: int = 20_000, tally: list[int] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of the pairs within ``max_bits`` in each group of ``x``, group by group of the index.

    ``groups`` holds where groups begin; each is sorted by Gray rank. A node of
    the index is a run of ``FANOUT`` nodes below it, the lowest are the codes
    themselves; it has the mask of the bits that all its codes share, and their
    values. Pairs of nodes descend together: each step counts the differences
    only on bits that the two share and their parents did not, adds them to
    what was counted above, and drops the pair with all its codes once the sum
    is over the limit. ``tally`` gets the number of comparisons made.
    """
    starts, counts = np.arange(len(x)), np.diff(np.append(groups, len(x)))
    levels = [(starts, starts + 1, np.full(len(x), ~np.uint64(0)), x)]
    while counts.max(initial=1) > 1 or len(levels) == 1:
        above = -(-counts // FANOUT)
        base = np.repeat(np.cumsum(counts) - counts, above)
        nth = np.arange(above.sum()) - np.repeat(np.cumsum(above) - above, above)
        child = base + FANOUT * nth
        starts = starts[child]
        both, any_ = np.bitwise_and.reduceat(x, starts), np.bitwise_or.reduceat(x, starts)
        levels.append((child, np.append(child[1:], counts.sum()), ~(both ^ any_), both))
        counts = above

    def descend(level: int, a: np.ndarray, b: np.ndarray, differ: np.ndarray, known: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        begin, end, _, _ = levels[level]
        _, _, mask, value = levels[level - 1]
        for at in range(0, len(a), chunk):
            p, q, d, seen = (c[at : at + chunk] for c in (a, b, differ, known))
            total = (end[p] - begin[p]) * (end[q] - begin[q])
            which = np.repeat(np.arange(len(p)), total)
            k = np.arange(total.sum()) - np.repeat(np.cumsum(total) - total, total)
            wide = (end[q] - begin[q])[which]
            i, j = begin[p][which] + k // wide, begin[q][which] + k % wide
            ordered = i < j if level == 1 else i <= j
            i, j, which = i[ordered], j[ordered], which[ordered]
            shared = mask[i] & mask[j]
            summed = d[which] + np.bitwise_count((value[i] ^ value[j]) & shared & ~seen[which])
            if tally is not None:
                tally[0] += len(i)
            near = summed <= max_bits
            if not near.any():
                continue
            if level == 1:
                yield i[near], j[near]
            else:
                yield from descend(level - 1, i[near], j[near], summed[near], shared[near])

    if len(x):
        top = levels[-1]
        root = np.arange(len(groups))
        yield from descend(len(levels) - 1, root, root, np.zeros(len(groups), np.int64), top[2])


def unite(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``label`` with the classes of each ``i`` and ``j`` joined under the lower root."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return label
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            shorter = label[label]
            if (shorter == label).all():
                break
            label = shorter


def gray_links(codes: DataFrame, max_bits: int = MAX_BITS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Links (``u``, ``v``) that connect the distinct ``fp`` of ``codes`` as all pairs within ``max_bits`` would.

    Each cell gives a star for each of its classes, not its pairs, so the
    result never has more rows than the routed input.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, CELL):
            x = table.column("fp").to_numpy().view(np.uint64)
            label = np.arange(len(x))
            for i, j in near_pairs(x, group_starts(table, CELL), max_bits):
                label = unite(label, i, j)
            (linked,) = np.nonzero(label != np.arange(len(x)))
            ends = [pa.array(x[linked].view(np.int64)), pa.array(x[label[linked]].view(np.int64))]
            yield pa.RecordBatch.from_arrays(ends, ["u", "v"])

    cells = routed(codes.select("fp"), max_bits, bucket_rows).withColumn("_rank", gray_rank(F.col("fp")))
    # Unsigned order of the rank: flip its sign bit.
    order = F.col("_rank").bitwiseXOR(F.lit(_signed(1 << 63)))
    return cells.repartition(*CELL).sortWithinPartitions(*CELL, order).select("fp", *CELL).mapInArrow(run, "u long, v long")


def near_classes(docs: DataFrame, keep: list[str], text: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """``keep``, ``fp`` and ``component_id`` for each row; ``keep[0]`` is the id that names classes.

    Texts are read once and never shuffled; equal fingerprints are one node.
    """
    kept = docs.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("kept"), F.col(f"`{text}`").alias("text"))
    rows = materialise(with_fingerprint(kept, ["kept"]))
    nodes = materialise(rows.groupBy("fp").agg(F.min(F.col("kept")[keep[0]]).alias("_least")))
    links = connected_components(gray_links(nodes, max_bits))
    members = links.select(F.col("u").alias("fp"), F.col("v").alias("_root")).unionByName(
        links.select(F.col("v").alias("fp"), F.col("v").alias("_root")).distinct()
    )
    members = materialise(members.join(nodes, "fp"))
    named = materialise(members.groupBy("_root").agg(F.min("_least").alias("_named")))
    of_code = materialise(members.join(named, "_root").select("fp", "_named"))
    classes = materialise(nodes.join(of_code, "fp", "left").select("fp", F.coalesce("_named", "_least").alias("component_id")))
    fp, component = fresh(docs.select(*(F.col(f"`{c}`") for c in keep)), "fp", "component_id")
    return rows.join(classes, "fp").select(*(F.col("kept")[c].alias(c) for c in keep), F.col("fp").alias(fp), F.col("component_id").alias(component))


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def drop_near_copies(docs: DataFrame, ident: str = "doc_id", text: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs`` that are the first of their class: least id, then least text, one of rows equal in both.

    Only ids and codes are grouped; the texts are read again and meet the ids to
    drop in a join that adaptive execution may split or broadcast. Null ids come
    after all others.
    """
    row = F.struct(F.col(f"`{ident}`").isNull().alias("late"), F.col(f"`{ident}`").alias("ident"), F.xxhash64(F.col(f"`{text}`")).alias("hash"))
    marked = near_classes(docs.select(row.alias("_row"), F.col(f"`{text}`").alias("_body")), ["_row"], "_body", max_bits)
    return drop_marked(docs, marked.select("_row.ident", "_row.hash", (F.col("_row") == F.col("component_id")).alias("stays")), ident, text)


def drop_marked(docs: DataFrame, marked: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose ``ident`` and text ``hash`` are marked to stay, each pair of them once."""
    counted = materialise(marked.groupBy("ident", "hash").agg(F.max("stays").alias("stays"), F.count("*").alias("n")).where("not stays or n > 1"))
    id_, hash_, stays_, n_ = fresh(docs, "ident", "hash", "stays", "n")
    touched = counted.toDF(id_, hash_, stays_, n_)
    same = F.col(f"`{ident}`").eqNullSafe(F.col(id_)) & (F.xxhash64(F.col(f"`{text}`")) == F.col(hash_))
    kept = docs.join(touched.select(id_, hash_), same, "left_anti")
    repeated = touched.where(F.col(stays_))
    if not repeated.isEmpty():
        # Rows that share id and text: one of them stays.
        once = docs.join(repeated, same).dropDuplicates([id_, hash_]).select(*(docs[f"`{c}`"] for c in docs.columns))
        kept = kept.unionByName(once)
    return kept
