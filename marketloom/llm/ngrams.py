"""Classes of documents whose sets of word n-grams have Jaccard similarity of at least ``PERCENT`` hundredths.

An exact grouped prefix join. All n-grams have one order, the rare before the
frequent; two sets that are similar enough share one of their first few
n-grams, the *prefix*. Sets of equal prefix and size are one group; groups meet
under the n-grams of their prefixes, pairs of groups whose sizes can't be similar
are dropped, and the members of those left are compared. N-grams that stand in
one document only come first in the order and meet nothing, so most documents
without a near copy have nothing to look up.

The order comes from counts over all documents: n-grams are counted in parts of
their hash, and a table of at most ``SLOTS`` bytes, which every task gets, holds
the magnitude of the greatest count of each slot. Any order gives the same
result, so a table too small for a corpus costs time, not links.

Links are only needed as far as they join classes. Under each n-gram first only
neighbours by size are compared, so a group of near copies costs as many
comparisons as it has members. Under n-grams that still hold several classes
follow a forest of their nearest members, and then all pairs between different
classes. Pairs that parity bits of the two sets show to differ too much are
never moved: bits that differ stand for at least as many n-grams that differ.

Defined cases: a text without words, or null, has the empty set and is linked
with nothing; one of fewer words than an n-gram has its whole sequence; equal sets are one
node, so copies are never compared; a null id never names a class unless
nothing else is in it; other columns are not read; an empty table gives an empty
result; a kept column named as a result renames that, as
:func:`marketloom.llm.storage.fresh` says. N-grams are told apart by 64 bits of
hash, sets by 128.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketloom.llm.blocks import forest
from marketloom.llm.components import connected_components
from marketloom.llm.shingles import shingle_set
from marketloom.llm.simhash import group_starts, whole_groups
from marketloom.llm.storage import beside, fresh, materialise, release, sent

WIDTH = 4
PERCENT = 85
#: Bytes of the table of magnitudes, at most; n-grams that a part of the count holds, about; n-grams that a task counts at once.
SLOTS, PART, HELD = 1 << 25, 1 << 22, 1 << 21
PARITY_BITS = 1024
#: Under an n-gram with more members than this, they are dealt into cells of at most so many.
CELL_ROWS = 1024
#: Neighbours by size are joined in blocks of so many, and the first of each again, so often; those left in a row.
BLOCK, LEVELS = 32, 3
#: An n-gram takes so many bytes of text, about.
NGRAM_BYTES = 6


def prefix_size(n: int, percent: int = PERCENT) -> int:
    """How many n-grams of a set of ``n`` must be looked at; none where only an equal set is similar."""
    return 0 if 100 * n < percent * (n + 1) else n + -percent * n // 100 + 1


def allowed_difference(size: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The n-grams that two similar sets, of so many together, may have apart at most."""
    return size - 2 * -(-percent * size // (100 + percent))


def _power(n: float) -> int:
    return max(0, int(np.ceil(np.log2(max(n, 1)))))


def _sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    return [shingle_set(t or b"", width) for t in texts.to_pylist()]


def magnitudes(docs: DataFrame, text: str = "text", width: int = WIDTH, slots: int = SLOTS) -> Broadcast:
    """A byte for each slot (leading bits) of n-gram hashes: the bits of the greatest count of an n-gram in it, 0 if none occurs twice."""
    spark = docs.sparkSession
    n_bytes = docs.agg(F.sum(F.octet_length(F.col(f"`{text}`")))).first()[0] or 0
    wanted = n_bytes / NGRAM_BYTES
    slot_bits = min(_power(slots), max(6, _power(2 * wanted)))
    part_bits = min(slot_bits, max(6, _power(wanted / PART)))
    in_part = slot_bits - part_bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            x, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            part = (x >> np.uint64(64 - part_bits)).astype(np.int32)
            rest = (x << np.uint64(part_bits) >> np.uint64(32)).astype(np.uint32)
            n = np.minimum(n, 255).astype(np.uint8)
            first = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            last = np.append(first[1:], len(part))
            blobs = [pa.array([y[a:b].tobytes() for a, b in zip(first, last, strict=True)], pa.binary()) for y in (rest, n)]
            return pa.RecordBatch.from_arrays([pa.array(part[first]), *blobs], ["part", "rest", "n"])

        size = 0
        for b in batches:
            for k in range(b.num_rows):
                found = _sets(b.column(0).slice(k, 1), width)[0]
                if len(found):
                    held.append(found)
                    size += len(found)
                if size >= HELD:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ("part",)):
            (starts,) = (group_starts(table, ("part",)),)
            for a, b in zip(starts, np.append(starts[1:], table.num_rows), strict=True):
                rows = table.slice(int(a), int(b - a))
                rest = np.frombuffer(b"".join(rows.column("rest").to_pylist()), np.uint32)
                n = np.frombuffer(b"".join(rows.column("n").to_pylist()), np.uint8)
                order = np.argsort(rest)
                rest, n = rest[order], n[order]
                first = np.flatnonzero(np.append(True, rest[1:] != rest[:-1]))
                total = np.add.reduceat(n.astype(np.int64), first)
                slot = (rest[first].astype(np.uint64) >> np.uint64(32 - in_part)).astype(np.int64)
                here = np.flatnonzero(np.append(True, slot[1:] != slot[:-1]))
                out = np.zeros(1 << in_part, np.uint8)
                most = np.maximum.reduceat(total, here)
                out[slot[here]] = np.where(most > 1, np.frexp(most.astype(float))[1], 0)
                yield pa.RecordBatch.from_arrays([rows.column("part").combine_chunks().slice(0, 1), pa.array([out.tobytes()], pa.binary())], ["part", "slots"])

    blobs = docs.select(F.col(f"`{text}`").cast("binary").alias("text")).mapInArrow(count, "part int, rest binary, n binary")
    found = blobs.repartition("part").sortWithinPartitions("part").mapInArrow(weigh, "part int, slots binary")
    table = np.zeros((1 << part_bits, 1 << in_part), np.uint8)
    for r in found.collect():  # SLOTS bytes in all
        table[r["part"]] = np.frombuffer(r["slots"], np.uint8)
    return spark.sparkContext.broadcast(table.ravel())


def parity(found: np.ndarray) -> bytes:
    """For each of PARITY_BITS residues of the n-grams, whether an odd number of them has it."""
    odd = np.bincount((found & np.uint64(PARITY_BITS - 1)).astype(np.int64), minlength=PARITY_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def signed(docs: DataFrame, keep: list[str], text: str, width: int, percent: int, table: Broadcast) -> DataFrame:
    """``keep``, and ``key``, size ``n``, the n-grams of the ``prefix`` that others may share, ``grp`` and ``parity`` of each text."""

    def run(texts: list) -> list[pa.Array]:
        rank = table.value
        shift = np.uint64(64 - _power(len(rank)))
        columns: list[list] = [[] for _ in range(5)]
        for t in texts:
            found = shingle_set(t or b"", width)
            n = len(found)
            often = rank[found >> shift]
            first = np.argsort(often, kind="stable")[: prefix_size(n, percent)]
            prefix = found[first[often[first] > 0]]
            grp = xxhash.xxh3_128_digest(prefix.tobytes() + n.to_bytes(8, "big")) if len(prefix) else None
            row = (xxhash.xxh3_128_digest(found.tobytes()) if n else None, n, prefix.view(np.int64), grp, parity(found) if len(prefix) else None)
            for c, v in zip(columns, row, strict=True):
                c.append(v)
        kinds = (pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary())
        return [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]

    return beside(docs, keep, F.col(f"`{text}`").cast("binary"), "key binary, n long, prefix array<long>, grp binary, parity binary", run)


def _leaders(rows: DataFrame, key: str) -> DataFrame:
    """``u`` and ``v`` (with sizes ``m`` and ``n``) of the members under each ``key``: each with the first of its ``BLOCK`` in order of size, and these in turn.

    So the members are joined within a few steps, however many there are.
    """
    w = Window.partitionBy(key).orderBy("n", "key")
    left = rows.withColumn("at", F.row_number().over(w) - 1)
    found = []
    for _ in range(LEVELS):
        of_block = Window.partitionBy(key, F.floor(F.col("at") / BLOCK)).orderBy("at")
        first = F.first(F.struct("key", "n")).over(of_block)
        led = left.withColumn("first", first)
        found.append(led.where(F.col("at") % BLOCK > 0).select(F.col("first.key").alias("u"), F.col("first.n").alias("m"), F.col("key").alias("v"), "n"))
        left = left.where(F.col("at") % BLOCK == 0).withColumn("at", F.floor(F.col("at") / BLOCK).cast("int"))
    last = left.select(F.lag("key").over(Window.partitionBy(key).orderBy("at")).alias("u"), F.lag("n").over(Window.partitionBy(key).orderBy("at")).alias("m"), F.col("key").alias("v"), "n").where("u is not null")
    for more in found:
        last = last.unionByName(more)
    return last


def neighbour_pairs(nodes: DataFrame, percent: int) -> DataFrame:
    """``u`` and ``v`` of neighbours by size: groups under each n-gram of their prefixes, and members within each group."""
    groups = nodes.groupBy("grp").agg(F.min("key").alias("key"), F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    under = materialise(groups.select("key", "n", F.explode("prefix").alias("ngram")))
    near = _leaders(under, "ngram").where(F.col("m") * 100 >= F.col("n") * percent)
    pairs = materialise(_ordered(near.select("u", "v").unionByName(_leaders(nodes.select("grp", "key", "n"), "grp").select("u", "v"))))
    release(under)
    return pairs


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _close(n: np.ndarray, bits: np.ndarray, percent: int, chunk: int = 32) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Positions ``i`` < ``j`` and differing bits of the pairs that sizes (ascending) and parity bits allow."""
    end = np.searchsorted(n, 100 * n // percent, "right")
    for a in range(0, len(n), chunk):
        b = min(a + chunk, len(n))
        stop = int(end[b - 1])
        differ = np.bitwise_count(bits[a:b, None, :] ^ bits[None, a:stop, :]).sum(axis=2, dtype=np.int64)
        i, j = np.nonzero(differ <= allowed_difference(n[a:b, None] + n[None, a:stop], percent))
        ok = (i < j) & (a + j < end[a + i])
        yield a + i[ok], a + j[ok], differ[i[ok], j[ok]]


_CELL = ("ngram", "kind", "x", "y")


def _class_pairs(rows: DataFrame, percent: int, nearest: bool) -> DataFrame:
    """``u`` and ``v`` of members of a cell in different classes, as far as sizes and parity bits allow; all, or a forest of the ``nearest``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, _CELL):
            starts = group_starts(table, _CELL)
            for a, b in zip(starts, np.append(starts[1:], table.num_rows), strict=True):
                cell = table.slice(int(a), int(b - a)).combine_chunks()
                if cell.num_rows < 2:
                    continue
                key, n, main = cell.column("key").combine_chunks(), cell.column("n").to_numpy(), cell.column("main").to_numpy()
                label = cell.column("label").combine_chunks().dictionary_encode().indices.to_numpy()
                bits = np.frombuffer(b"".join(cell.column("parity").to_pylist()), np.uint64).reshape(len(n), -1)
                crossed = cell.column("kind")[0].as_py() == 1
                found = [[], [], []]
                for pairs in _close(n, bits, percent):
                    i, j, _ = pairs
                    apart = label[i] != label[j]
                    if crossed:
                        apart &= main[i] | main[j]
                    for c, v in zip(found, pairs, strict=True):
                        c.append(v[apart])
                i, j, differ = (np.concatenate(c) for c in found)
                if not len(i):
                    continue
                if nearest:
                    order = np.argsort(differ, kind="stable")
                    _, first, group = np.unique(label, return_index=True, return_inverse=True)
                    kept = list(forest(first[group], i[order], j[order]))
                    i, j = (np.concatenate([p[k] for p in kept]) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([key.take(pa.array(i)), key.take(pa.array(j))], ["u", "v"])

    return _ordered(rows.repartition(*_CELL).sortWithinPartitions(*_CELL, "n").select(*_CELL, "key", "n", "label", "main", "parity").mapInArrow(run, "u binary, v binary"))


def _cells(nodes: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members of the n-grams whose members are of several classes, in the cells where those of different classes meet; and the table that they are read with.

    Of a very large one the greatest class is told from the others: its members
    only meet the others, which are dealt by pairs of salts.
    """
    member = materialise(nodes.join(labels, "key").select("key", "label", F.explode("prefix").alias("ngram")))
    several = member.groupBy("ngram").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("m")).where("low <> high")
    several = materialise(several.select("ngram", "m"))
    large = several.where(F.col("m") > CELL_ROWS)
    of_class = member.join(large, "ngram").groupBy("ngram", "m", "label").agg(F.count("*").alias("k"))
    greatest = materialise(of_class.groupBy("ngram", "m").agg(F.max_by("label", "k").alias("greatest"), F.max("k").alias("k")))
    half = CELL_ROWS // 2
    salts = greatest.select("ngram", "greatest", F.ceil(F.col("k") / half).cast("int").alias("ka"), F.ceil((F.col("m") - F.col("k")) / half).cast("int").alias("kb"))
    here = member.join(several.select("ngram"), "ngram").join(salts, "ngram", "left")
    here = here.withColumn("main", F.coalesce(F.col("label") == F.col("greatest"), F.lit(False)))
    hashed = F.xxhash64("key", "ngram")
    here = here.withColumns({"sa": F.pmod(hashed, F.col("ka")).cast("int"), "sb": F.pmod(hashed, F.col("kb")).cast("int")})
    place = F.expr("""case when ka is null then array(struct(0 as kind, 0 as x, 0 as y))
      when main then transform(sequence(0, kb - 1), b -> struct(1 as kind, b as x, sa as y))
      else concat(transform(sequence(0, ka - 1), a -> struct(1 as kind, sb as x, a as y)), transform(sequence(0, kb - 1), b -> struct(0 as kind, least(b, sb) as x, greatest(b, sb) as y))) end""")
    placed = here.select("ngram", "key", "label", "main", F.inline(place)).join(nodes.select("key", "n", "parity"), "key")
    return placed, [member, several, greatest]


class _Comparison:
    """Exact comparison of pairs: parity bits first, then the sets, each read once from its text."""

    def __init__(self, docs: DataFrame, nodes: DataFrame, width: int, percent: int) -> None:
        self.docs, self.nodes, self.width, self.percent = docs, nodes, width, percent
        self.bodies: list[DataFrame] = []
        self.tested: list[DataFrame] = []

    def _fetch(self, wanted: DataFrame) -> DataFrame:
        width = self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s.tobytes() for s in _sets(b.column(1), width)], pa.binary())], ["key", "body"])

        places = self.nodes.join(wanted, "key").select(F.col("place.ident").alias("at"), F.col("place.hash").alias("code"), "key")
        n_bytes = places.agg(F.sum(F.coalesce(F.octet_length(F.col("at").cast("string")), F.lit(0)) + 96)).first()[0]
        same = F.col("ident").eqNullSafe(F.col("at")) & (F.col("hash") == F.col("code"))
        found = self.docs.join(sent(places, n_bytes), same).select("key", F.col("text").cast("binary"))
        return materialise(found.mapInArrow(run, "key binary, body binary").dropDuplicates(["key"]))

    def links(self, pairs: DataFrame) -> DataFrame:
        """Those of ``pairs`` (``u``, ``v``), not compared before, that are similar."""
        percent = self.percent

        def may(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                m, n = b.column(2).to_numpy(), b.column(3).to_numpy()
                bits = [np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint8).reshape(b.num_rows, -1) for k in (4, 5)]
                differ = np.bitwise_count(bits[0] ^ bits[1]).sum(axis=1, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["u", "v"]).filter(pa.array(differ <= allowed_difference(m + n, percent)))

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                same = []
                for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                    p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                    both = len(np.intersect1d(p, q, assume_unique=True))
                    same.append(100 * both >= percent * (len(p) + len(q) - both))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(same, pa.bool_())], ["u", "v", "same"])

        for done in self.tested:
            pairs = pairs.join(done.select("u", "v"), ["u", "v"], "left_anti")
        one, other = (self.nodes.select(F.col("key").alias(k), F.col("n").alias(f"n{k}"), F.col("parity").alias(f"p{k}")) for k in "uv")
        near = pairs.join(one, "u").join(other, "v").select("u", "v", "nu", "nv", "pu", "pv")
        left = materialise(near.mapInArrow(may, "u binary, v binary"))
        wanted = left.select(F.explode(F.array("u", "v")).alias("key")).distinct()
        for known in self.bodies:
            wanted = wanted.join(known.select("key"), "key", "left_anti")
        self.bodies.append(self._fetch(wanted))
        bodies = self.bodies[0]
        for more in self.bodies[1:]:
            bodies = bodies.unionByName(more)
        one, other = (bodies.select(F.col("key").alias(k), F.col("body").alias(f"b{k}")) for k in "uv")
        tested = left.join(one, "u").join(other, "v").select("u", "v", "bu", "bv")
        self.tested.append(materialise(tested.mapInArrow(compare, "u binary, v binary, same boolean")))
        release(left)
        return self.tested[-1].where("same").select("u", "v")

    def close(self) -> None:
        release(*self.bodies, *self.tested)


def similar_classes(docs: DataFrame, keep: list[str], text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """``keep``, ``n_shingles`` and ``component_id`` for each row; ``keep[0]`` is the id that names classes."""
    body = F.col(f"`{text}`")
    kept = docs.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("kept"), F.xxhash64(body).alias("hash"), body.alias("text"))
    table = magnitudes(docs, text, width)
    rows = materialise(signed(kept, ["kept", "hash"], "text", width, percent, table))
    table.unpersist()
    ident = F.col("kept")[keep[0]]
    first = {c: F.first(c).alias(c) for c in ("n", "prefix", "grp", "parity")}
    nodes = materialise(rows.where("key is not null").groupBy("key").agg(F.min(ident).alias("least"), F.min(F.struct(ident.alias("ident"), "hash")).alias("place"), *first.values()))
    met = nodes.where("grp is not null")
    comparison = _Comparison(kept.select(F.col("kept")[keep[0]].alias("ident"), "hash", "text"), met, width, percent)
    links, scratch, joined = None, [], neighbour_pairs(met, percent)
    for nearest in (None, True, False):
        if nearest is not None:
            cells, read = _cells(met, labels)
            joined = materialise(_class_pairs(cells, percent, nearest))
            release(*read)
        scratch.append(joined)
        if nearest is not None and joined.isEmpty():
            break  # no two classes are left that could be joined
        same = comparison.links(joined)
        if nearest is not None and same.isEmpty():
            continue
        links = connected_components(same if links is None else links.unionByName(same))
        named = links.select(F.col("u").alias("key"), F.col("v").alias("label"))
        labels = materialise(nodes.select("key").join(named, "key", "left").select("key", F.coalesce("label", "key").alias("label")))
        scratch += [links, labels]
    of_class = nodes.select("key", "least").join(labels, "key")
    least = of_class.groupBy("label").agg(F.min("least").alias("component"))
    classes = materialise(labels.join(least, "label").select("key", "component"))
    n_name, component = fresh(docs.select(*(F.col(f"`{c}`") for c in keep)), "n_shingles", "component_id")
    told = F.when(F.col("key").isNull(), ident).otherwise(F.col("component"))
    found = rows.join(classes, "key", "left").select(*(F.col("kept")[c].alias(c) for c in keep), F.col("n").alias(n_name), told.alias(component))
    stored = materialise(found)
    comparison.close()
    release(rows, nodes, classes, *scratch)
    return stored
