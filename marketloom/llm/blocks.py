"""Near pairs by blocked SimHash codes.

What is compared (a line, a document) is a bag of hashed features: words or
word runs. The features are dealt by hash into parts, two to four in each, and
each part gets a SimHash block. A changed feature touches at most two parts, so
by the pigeonhole principle near bags agree on whole blocks; they meet in the
buckets of those blocks. Of a large bag's parts the first ``LOOKED`` are used,
the same ones in bags near it. In short bags pairs of five parts, in very short
ones all features but one, take the place of a block.

Inside a bucket the Gray-order index finds pairs whose whole codes differ in a
limited number of bits. A spanning forest of them is compared first. Where an
edge of it fails, a second forest joins the groups found so far by their nearest
codes, and then all other pairs of that bucket between groups still different
are compared too. So a group of near copies costs a few times as many
comparisons as it has members, and yet no pair is lost that all would link.
Where bodies are short all these other pairs are compared in the task in which
their members meet, each in one of the buckets they share, and only links leave
it; bodies go only to the buckets in which their owner is near a member of
another group. Where bags have sizes, those of which one is too small for the
other to be similar are no pair from the beginning.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.components import connected_components
from marketloom.llm.simhash import gray_order, group_starts, near_pairs, whole_groups
from marketloom.llm.storage import materialise, release, sent

LOOKED = 12
#: Bags of at most so many features use all but one of them; pairs of parts serve from the second to below the third size.
ALL_BUT_ONE, PAIR_FROM, PAIR_BELOW = 12, 8, 16
PARTS = 5
#: Similar bags that have a ``size`` have at least this share (numerator, denominator) of each other's.
SIZE_SHARE = (4, 5)
#: Buckets of more members than this, as counted in one of ``SAMPLED`` of them, are dealt into cells.
BUCKET_ROWS, SAMPLED = 1024, 16
#: Salts of a large bucket whose pairs are compared where they meet, as long as its cells stay bounded.
SALTS = 8
#: Bytes of a usual body; a pair of longer ones costs more, so their cells are smaller, down to ``LEAST_ROWS`` members of a side.
USUAL_BYTES, LEAST_ROWS = 400, 32
#: Pairs that are asked for at once whether they are surely apart.
ASKED = 4096
_LANES = np.array([sum((b >> k & 1) << 8 * k for k in range(8)) for b in range(256)], np.uint64)


@dataclass(frozen=True)
class Likeness:
    """Whether two bodies are ``similar``; ``quick`` tells of some that they surely are, ``apart`` which of many pairs (bodies, places of either side) surely are not."""

    similar: Callable[[bytes, bytes], bool]
    quick: Callable[[bytes, bytes], bool]
    apart: Callable[[list[bytes], np.ndarray, np.ndarray], np.ndarray]

    def __call__(self, a: bytes, b: bytes) -> bool:
        return self.similar(a, b)


def _maybe(similar: Callable[[bytes, bytes], bool], bodies: list[bytes], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which of the pairs of places ``i``, ``j`` remain to be compared."""
    return ~similar.apart(bodies, i, j) if isinstance(similar, Likeness) else np.ones(len(i), bool)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit over all."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def majority_bits(hashes: np.ndarray, starts: np.ndarray, width: int = 64) -> np.ndarray:
    """SimHash of each run of ``hashes``: the bits set in over half of it (the lowest ``width``)."""
    sizes = np.diff(np.append(starts, len(hashes)))
    octets = np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, 8)
    pieces = (sizes + 254) // 255  # a counter of one byte holds 255
    whose = np.repeat(np.arange(len(sizes)), pieces)
    cut = starts[whose] + 255 * (np.arange(len(whose)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    out = np.zeros((len(starts), 8), np.uint8)
    for k in range(width // 8):
        ones = np.add.reduceat(_LANES[octets[:, k]], cut).view(np.uint8).reshape(-1, 8).astype(np.int64)
        if len(cut) > len(starts):
            ones = np.add.reduceat(ones, np.cumsum(pieces) - pieces, axis=0)
        out[:, k] = np.packbits(2 * ones > sizes[:, None], axis=1, bitorder="little").ravel()
    return out.view(np.uint64).ravel()


def _starts(x: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, np.int64)


def block_keys(hashes: np.ndarray, owner: np.ndarray, bags: int, least: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Owners and bucket keys of the bags whose features are ``hashes``; ``owner`` ascends; a block has ``least`` features or more."""
    size = np.bincount(owner, minlength=bags)
    owners, keys = [], []
    # All but one feature, and all of them.
    few = (size <= ALL_BUT_ONE)[owner]
    if few.any():
        h, at = hashes[few], owner[few]
        spread = mixed(h ^ np.uint64(0xA5A5A5A5A5A5A5A5))
        first = _starts(at)
        whole = np.add.reduceat(spread, first)
        owners += [at, at[first]]
        keys += [mixed(np.repeat(whole, np.diff(np.append(first, len(at)))) - spread), mixed(whole)]
    # Blocks of parts; a bag takes the number of parts of its size, and that of the least bag near it.
    level = np.log2(np.maximum(size, 1)).astype(np.int64)
    below = np.log2(np.maximum(0.8 * size, 1)).astype(np.int64)
    some = size >= PAIR_FROM
    for chosen, lev, looked in ((some, level, LOOKED), (some & (below < level), below, LOOKED // 2)):
        lev = np.maximum(lev, 3)
        paired = lev < PAIR_BELOW.bit_length() - 1
        parts = np.where(paired, PARTS, 1 << np.minimum(lev - 1, 31))
        part = ((hashes >> np.uint64(20)) % parts[owner].astype(np.uint64)).astype(np.int64)
        mine = chosen[owner] & (part < looked)
        at, part, h = owner[mine], part[mine], hashes[mine]
        cell = at * LOOKED + part
        order = np.argsort(cell)
        cell, h = cell[order], h[order]
        first = _starts(cell)
        count = np.diff(np.append(first, len(cell)))
        at, part = cell[first] // LOOKED, cell[first] % LOOKED
        block = mixed(majority_bits(h, first, 32) ^ mixed((part + 1 + (lev[at] << 48)).astype(np.uint64)))
        single = ~paired[at] & (count >= least)
        owners.append(at[single])
        keys.append(block[single])
        rows = np.flatnonzero(chosen & paired)
        if len(rows):
            place = np.zeros(bags, np.int64)
            place[rows] = np.arange(len(rows))
            two = paired[at]
            where = place[at[two]], part[two]
            table, held = np.zeros((len(rows), PARTS), np.uint64), np.zeros((len(rows), PARTS), np.int64)
            table[where], held[where] = block[two], count[two]
            for i in range(PARTS):
                for j in range(i):
                    full = held[:, i] + held[:, j] >= least
                    owners.append(rows[full])
                    keys.append(mixed(table[full, i] ^ mixed(table[full, j] + np.uint64(8 * i + j))))
    at, key = np.concatenate(owners), np.concatenate(keys)
    order = np.lexsort((key, at))
    at, key = at[order], key[order]
    new = np.append(True, (at[1:] != at[:-1]) | (key[1:] != key[:-1]))[: len(at)]
    return at[new], key[new]


def forest(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of the pairs ``i``, ``j``, in order of preference, those that join groups of ``label``, which is changed."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return
        i, j, low, high = i[apart], j[apart], np.minimum(a, b)[apart], np.maximum(a, b)[apart]
        _, pick = np.unique(high, return_index=True)
        yield i[pick], j[pick]
        label[high[pick]] = low[pick]
        while True:
            shorter = label[label]
            if (shorter == label).all():
                break
            label[:] = shorter


def _fitting(size: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which of the pairs have sizes that similar bags may have."""
    share, of = SIZE_SHARE
    return of * np.minimum(size[i], size[j]) >= share * np.maximum(size[i], size[j])


def _sized(signed: DataFrame) -> list[str]:
    """Columns of a member but its bucket and group."""
    return [c for c in ("node", "fp", "size") if c in signed.columns]


def _columns(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table.column(n).to_numpy() for n in names]


def _pairs(rows: DataFrame, max_bits: int, groups: bool, nearest: bool = False) -> DataFrame:
    """``a`` < ``b`` and ``bucket`` of pairs that meet in a bucket within ``max_bits``.

    Without ``groups`` a spanning forest of each bucket's pairs; else all pairs
    of members of different ``grp``, or with ``nearest`` a forest of the groups.
    """
    names = ["a", "b", "bucket"]
    keys = ("bucket",)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, keys):
            (bucket,) = _columns(table, "bucket")
            new = np.append(True, bucket[1:] != bucket[:-1])
            shared = ~new | ~np.append(new[1:], True)
            if not shared.any():
                continue
            table = table.filter(pa.array(shared))
            bucket, node, fp = _columns(table, "bucket", "node", "fp")
            code = fp.view(np.uint64)
            order = np.lexsort((gray_order(code), bucket))
            bucket, node, code = bucket[order], node[order], code[order]
            of = _columns(table, "grp")[0][order] if groups else node
            size = _columns(table, "size")[0][order] if "size" in table.column_names else None
            label = np.arange(len(node))
            if nearest:
                _, first, group = np.unique(of, return_index=True, return_inverse=True)
                label = first[group]
            for i, j in near_pairs(code, _starts(bucket), max_bits):
                apart = of[i] != of[j]
                if size is not None:
                    apart &= _fitting(size, i, j)
                i, j = i[apart], j[apart]
                if groups and not nearest:
                    found = [(i, j)]
                else:
                    # Stars around the first of a class, as far as its members are near it; or the nearest codes.
                    bits = np.bitwise_count(code[i] ^ code[j])
                    order = np.argsort(bits, kind="stable") if nearest else np.lexsort((bits, np.minimum(i, j)))
                    found = forest(label, i[order], j[order])
                for p, q in found:
                    if len(p):
                        ends = np.minimum(node[p], node[q]), np.maximum(node[p], node[q]), bucket[p]
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in ends], names)

    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "a long, b long, bucket long")


def _hot(counted: DataFrame, times: int) -> DataFrame:
    """``bucket`` and number of ``cells`` of the buckets above ``BUCKET_ROWS``."""
    often = counted.groupBy("bucket").agg((F.count("*") * times).alias("n")).where(F.col("n") > BUCKET_ROWS)
    return materialise(often.select("bucket", F.ceil(F.col("n") / (BUCKET_ROWS / 2)).cast("int").alias("cells")))


def candidate_forest(signed: DataFrame, max_bits: int) -> tuple[DataFrame, DataFrame]:
    """Forest edges (``a``, ``b``, ``bucket``) of ``node``, ``fp``, ``keys`` (and ``size``); and the large buckets.

    A large bucket is dealt at random into cells, differently for each bucket,
    and each member goes to one cell.
    """
    member = signed.select(*_sized(signed), F.explode("keys").alias("bucket"))
    hot = _hot(member.where(F.pmod("node", F.lit(SAMPLED)) == 0), SAMPLED)
    if not hot.isEmpty():
        cell = F.pmod(F.xxhash64("node", "bucket"), F.col("cells"))
        member = member.join(hot, "bucket", "left").withColumn("bucket", F.when(F.col("cells").isNull(), F.col("bucket")).otherwise(F.xxhash64("bucket", cell, F.lit("cell"))))
    return materialise(_pairs(member.select(*_sized(signed), "bucket"), max_bits, False)), hot


def _other_pairs(signed: DataFrame, doubtful: DataFrame, group_of: DataFrame, max_bits: int, nearest: bool) -> DataFrame:
    """``a`` and ``b`` of pairs of the ``doubtful`` buckets between different groups, all or a forest; every two members meet in one cell."""
    sized = _sized(signed)
    member = signed.select(*sized, F.explode("keys").alias("bucket")).join(sent(doubtful, 24 * doubtful.count()), "bucket", "left_semi")
    member = materialise(member.join(group_of, "node", "left").select(*sized, "bucket", F.coalesce("grp", "node").alias("grp")))
    hot = _hot(member, 1)
    spread = member
    if not hot.isEmpty():
        spread = member.join(hot, "bucket", "left").withColumn("cells", F.coalesce("cells", F.lit(1)))
        own = F.pmod(F.xxhash64("node"), F.col("cells"))
        spread = spread.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
        cell = F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other"))
        spread = spread.select(*sized, "grp", F.when(F.col("cells") == 1, F.col("bucket")).otherwise(cell).alias("bucket"))
    pairs = materialise(_pairs(spread, max_bits, True, nearest).select("a", "b").distinct())
    release(member, hot)
    return pairs


def _several(signed: DataFrame, doubtful: DataFrame, group_of: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (``node``, ``fp``, ``size``, ``bucket``, ``grp``) of the ``doubtful`` buckets, and those buckets (with ``m`` members, ``heavy`` times as large as usual) that still hold several groups."""
    sized = _sized(signed)
    member = signed.select(*sized, F.explode("keys").alias("bucket")).join(sent(doubtful, 24 * doubtful.count()), "bucket", "left_semi")
    member = materialise(member.join(group_of, "node", "left").select(*sized, "bucket", F.coalesce("grp", "node").alias("grp")))
    heavy = F.greatest(F.lit(1.0), F.avg("size") / USUAL_BYTES) if "size" in sized else F.lit(1.0)
    found = member.groupBy("bucket").agg(F.min("grp").alias("low"), F.max("grp").alias("high"), F.count("*").alias("m"), heavy.alias("heavy")).where("low <> high")
    return member, materialise(found.select("bucket", "m", "heavy"))


_CELL = ("bucket", "kind", "x", "y")


def _met(signed: DataFrame, doubtful: DataFrame, group_of: DataFrame, bodies: Callable[[DataFrame], DataFrame], similar: Callable[[bytes, bytes], bool], max_bits: int) -> DataFrame:
    """Links (``u``, ``v``) between members of different groups of the ``doubtful`` buckets, compared where they meet.

    In a large bucket the members of its greatest group meet the others only,
    which are dealt by pairs of salts; so what moves is in proportion to the
    members outside the greatest group. A first pass over codes and sizes alone
    finds the members that have anyone to be compared with; only these get their
    bodies. Two members that share several buckets are compared in the least of
    them.
    """
    member, several = _several(signed, doubtful, group_of)
    here = member.join(several, "bucket")
    # A member goes to as many cells as its bucket has salts: these are few, until cells are as large as a task may hold.
    usual = F.greatest(F.lit(BUCKET_ROWS // 2), F.least(F.lit(BUCKET_ROWS * 4), F.ceil(F.col("m") / SALTS)))
    half = F.greatest(F.ceil(usual / F.col("heavy")), F.lit(min(LEAST_ROWS, BUCKET_ROWS // 2)))
    of_group = here.where(F.col("m") * F.col("heavy") > BUCKET_ROWS).groupBy("bucket", "m", "heavy", "grp").agg(F.count("*").alias("k"))
    greatest = of_group.groupBy("bucket", "m", "heavy").agg(F.max_by("grp", "k").alias("greatest"), F.max("k").alias("k")).withColumn("half", half)
    salts = materialise(greatest.select("bucket", "greatest", F.ceil(F.col("k") / F.col("half")).cast("int").alias("ka"), F.ceil((F.col("m") - F.col("k")) / F.col("half")).cast("int").alias("kb")))
    placed = here.join(salts, "bucket", "left").withColumn("main", F.coalesce(F.col("grp") == F.col("greatest"), F.lit(False)))
    hashed = F.xxhash64("node", "bucket")
    placed = placed.withColumns({"sa": F.pmod(hashed, F.col("ka")).cast("int"), "sb": F.pmod(hashed, F.col("kb")).cast("int")})
    cells = F.expr("""case when ka is null then array(struct(0 as kind, 0 as x, 0 as y))
      when main then transform(sequence(0, kb - 1), b -> struct(1 as kind, b as x, sa as y))
      else concat(transform(sequence(0, ka - 1), a -> struct(1 as kind, sb as x, a as y)), transform(sequence(0, kb - 1), b -> struct(0 as kind, least(b, sb) as x, greatest(b, sb) as y))) end""")
    sized = _sized(signed)
    dealt = placed.select(*sized, "grp", "main", "bucket", F.inline(cells))

    def near(cell: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of pairs of a cell that are to be compared, the nearest codes first as far as they come together."""
        code = cell.column("fp").to_numpy().view(np.uint64)
        order = np.argsort(gray_order(code))
        code = code[order]
        main, grp = (cell.column(n).to_numpy()[order] for n in ("main", "grp"))
        size = cell.column("size").to_numpy()[order] if "size" in sized else None
        crossed = cell.column("kind")[0].as_py() == 1
        for i, j in near_pairs(code, np.zeros(1, np.int64), max_bits):
            apart = grp[i] != grp[j]
            if crossed:
                apart &= main[i] != main[j]
            if size is not None:
                apart &= _fitting(size, i, j)
            i, j = i[apart], j[apart]
            nearest = np.argsort(np.bitwise_count(code[i] ^ code[j]), kind="stable")
            yield order[i[nearest]], order[j[nearest]]

    def each_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        for table in whole_groups(batches, _CELL):
            starts = group_starts(table, _CELL)
            for a, b in zip(starts, np.append(starts[1:], table.num_rows), strict=True):
                if b - a > 1:
                    yield table.slice(int(a), int(b - a)).combine_chunks()

    def with_partner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in each_cell(batches):
            has = np.zeros(cell.num_rows, bool)
            for i, j in near(cell):
                has[i] = has[j] = True
            if has.any():
                yield from cell.filter(pa.array(has)).to_batches()

    # As many tasks as there are partitions, a number given: the work is in pairs, not in the few bytes that the planner would join tasks by.
    n_tasks = int(signed.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def in_cells(rows: DataFrame) -> DataFrame:
        return rows.repartition(n_tasks, *_CELL).sortWithinPartitions(*_CELL)

    dealt = dealt.select(*_CELL, *sized, "grp", "main")
    paired = materialise(in_cells(dealt).mapInArrow(with_partner, dealt.schema))
    owned = paired.groupBy("node").agg(F.collect_set("bucket").alias("own"))
    known = materialise(bodies(owned.select("node")).join(owned, "node"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[tuple, np.ndarray, np.ndarray]] = []
        for cell in each_cell(batches):
            own = [frozenset(x) for x in cell.column("own").to_pylist()]
            label = np.unique(cell.column("grp").to_numpy(), return_inverse=True)[1]
            state = cell.column("bucket")[0].as_py(), cell.column("key"), cell.column("body").to_pylist(), own, label
            for i, j in near(cell):
                for at in range(0, len(i), ASKED):
                    held.append((state, i[at : at + ASKED], j[at : at + ASKED]))
                    if sum(len(h[1]) for h in held) >= ASKED:
                        yield settled(held)
                        held = []
        if held:
            yield settled(held)

    def settled(held: list[tuple[tuple, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        """Links among the pairs of some cells; their labels are joined."""
        asked: list[tuple[tuple, list[tuple[int, int]]]] = []
        bodies: list[bytes] = []
        sides: tuple[list[int], list[int]] = [], []
        for state, i, j in held:
            bucket, _, body, own, label = state
            pairs = zip(i.tolist(), j.tolist(), strict=True)
            mine = [(p, q) for p, q in pairs if label[p] != label[q] and min(own[p] & own[q]) == bucket]
            place: dict[int, int] = {}
            for side, ends in zip(sides, zip(*mine, strict=True), strict=False):
                for p in ends:
                    if p not in place:
                        place[p] = len(bodies)
                        bodies.append(body[p])
                    side.append(place[p])
            asked.append((state, mine))
        maybe = iter(_maybe(similar, bodies, np.array(sides[0], np.int64), np.array(sides[1], np.int64)).tolist())
        found: tuple[list[bytes], list[bytes]] = [], []
        for (_, key, body, _, label), mine in asked:
            for p, q in mine:
                if next(maybe) and label[p] != label[q] and similar(body[p], body[q]):
                    label[label == label[q]] = label[p]
                    found[0].append(key[p].as_py())
                    found[1].append(key[q].as_py())
        return pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in found], ["u", "v"])

    rows = paired.join(known, "node").select(*dealt.columns, "own", "key", "body")
    same = materialise(in_cells(rows).mapInArrow(run, "u binary, v binary").distinct())
    release(member, several, salts, paired, known)
    return same


def _compared(pairs: DataFrame, bodies: DataFrame, similar: Callable[[bytes, bytes], bool]) -> DataFrame:
    """``a``, ``b``, their keys ``u``, ``v``, and whether they are ``similar``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, other = batch.column(4).to_pylist(), batch.column(5).to_pylist()
            quick = similar.quick if isinstance(similar, Likeness) else similar
            same = np.fromiter(map(quick, one, other), bool, len(one))
            if quick is not similar:
                rest = np.flatnonzero(~same)
                rest = rest[_maybe(similar, one + other, rest, rest + len(one))]
                same[rest] = [similar(one[k], other[k]) for k in rest.tolist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(same)], ["a", "b", "u", "v", "same"])

    one, other = (bodies.select(F.col("node").alias(n), F.col("key").alias(k), F.col("body").alias(f"body_{n}")) for n, k in (("a", "u"), ("b", "v")))
    joined = pairs.join(one, "a").join(other, "b").select("a", "b", "u", "v", "body_a", "body_b")
    return materialise(joined.mapInArrow(run, "a long, b long, u binary, v binary, same boolean"))


def _nodes_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()


def _same(tested: DataFrame) -> DataFrame:
    return tested.where("same").select("u", "v")


def linked(signed: DataFrame, fetch: Callable[[DataFrame, int], DataFrame], similar: Callable[[bytes, bytes], bool], max_bits: int, short: bool = False) -> DataFrame:
    """``key`` and ``group`` (the least key) of each member of a class of similar bags.

    ``signed`` has ``node`` (64 bits of the key), ``fp`` and ``keys`` (buckets),
    once for each node, and may have ``size`` (see ``SIZE_SHARE``); ``fetch`` gives ``node``, ``key`` and ``body`` of the
    nodes asked for, of which there are as many as it is told at most; only
    these bodies are moved. ``short``: bodies are short enough to go to each
    bucket in which the other pairs are compared; there is no second forest then,
    as pairs are compared nearest first where they meet.
    """
    edges, hot = candidate_forest(signed, max_bits)
    wanted = materialise(_nodes_of(edges))
    held = [materialise(fetch(wanted, wanted.count()))]
    rounds = [_compared(edges.select("a", "b").distinct(), held[0], similar)]
    links = connected_components(_same(rounds[0]))
    scratch = [edges, hot, wanted, links]

    def bodies(nodes: DataFrame) -> DataFrame:
        """Bodies of ``nodes``, as far as they are not held yet."""
        more = materialise(nodes.join(_union(held).select("node"), "node", "left_anti"))
        if not more.isEmpty():
            held.append(materialise(fetch(more, more.count())))
        release(more)
        return _union(held)

    def grouped() -> DataFrame:
        key_of = _union(held).select("node", F.col("key").alias("u"))
        return materialise(key_of.join(links, "u", "left").select("node", F.xxhash64(F.coalesce("v", "u")).alias("grp")).dropDuplicates(["node"]))

    failed = edges.join(rounds[0].where("not same").select("a", "b"), ["a", "b"]).select("bucket")
    pure = hot.isEmpty()
    if not pure or not rounds[0].where("not same").isEmpty():
        group_of = grouped()
        if not pure:
            large = signed.select("node", F.explode("keys").alias("bucket")).join(hot, "bucket").join(group_of, "node", "left")
            grp = F.coalesce("grp", "node")
            several = large.groupBy("bucket").agg(F.min(grp).alias("low"), F.max(grp).alias("high")).where("low <> high")
            failed = failed.unionByName(several.select("bucket"))
        doubtful = materialise(failed.distinct())
        scratch.append(doubtful)
        for nearest in (False,) if short else (True, False):
            if not short:
                if not nearest:  # buckets whose groups have been joined need no more pairs
                    member, still = _several(signed, doubtful, group_of)
                    doubtful = still.select("bucket")
                    release(member)
                    scratch.append(still)
                others = _other_pairs(signed, doubtful, group_of, max_bits, nearest)
                new = others.join(_union(rounds).select("a", "b"), ["a", "b"], "left_anti")
                rounds.append(_compared(new, bodies(_nodes_of(new)), similar))
                same = _same(rounds[-1])
                scratch.append(others)
            else:
                same = _met(signed, doubtful, group_of, bodies, similar, max_bits)
                scratch.append(same)
            scratch.append(group_of)
            if not same.isEmpty():
                links = connected_components(links.unionByName(same))
                scratch.append(links)
            if nearest:
                group_of = grouped()
    classes = materialise(links.select(F.col("u").alias("key"), F.col("v").alias("group")).unionByName(links.select(F.col("v").alias("key"), F.col("v").alias("group")).distinct()))
    release(*scratch, *held, *rounds)
    return classes


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for more in tables[1:]:
        out = out.unionByName(more)
    return out
