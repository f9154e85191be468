"""Connected components by alternating large-star and small-star rounds over contracted edges."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.storage import materialise, release

#: Edges of a task that are contracted at once.
CONTRACTED = 1 << 20
#: So many edges at most are united by one task, which then sees all that are left; more are spread over rounds.
LAST = 1 << 15


def _crossed(edges: DataFrame) -> DataFrame:
    """Each ``u`` that occurs more than once or is a ``v`` too, by one pass with partial sums; none if the edges are stars."""
    ends = edges.select("u", F.lit(1).alias("low"), F.lit(0).alias("high")).unionByName(edges.select(F.col("v").alias("u"), F.lit(0).alias("low"), F.lit(1).alias("high")))
    return ends.groupBy("u").agg(F.sum("low").alias("low"), F.max("high").alias("high")).where("low > 1 or low = 1 and high = 1").select("u")


def _split(edges: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``edges`` of components that are one star each, and the others, if there are any; ``edges`` is used up."""
    crossed = materialise(_crossed(edges))
    if crossed.isEmpty():
        release(crossed)
        return edges, None
    centres = materialise(edges.join(crossed, "u").select("v").unionByName(crossed.select(F.col("u").alias("v"))).distinct())
    done, left = (materialise(edges.join(centres, "v", how).select("u", "v")) for how in ("left_anti", "left_semi"))
    release(edges, crossed, centres)
    return done, left


def least_reached(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of ``n`` nodes the least one that the edges ``i``, ``j`` connect it to."""
    label = np.arange(n)
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


def contracted(edges: DataFrame) -> DataFrame:
    """``u`` and ``v`` of stars that connect the same nodes as ``edges``, made within each task.

    The centre of a star is the least node that a task's edges reach, up to
    ``CONTRACTED`` of them at a time. A combination before the shuffle: no
    more edges leave a task than it has nodes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def stars() -> pa.RecordBatch:
            both = pa.chunked_array([b.column(k) for k in (0, 1) for b in held]).combine_chunks()
            nodes = both.unique()
            nodes = nodes.take(pc.sort_indices(nodes))
            at = pc.index_in(both, nodes).to_numpy().astype(np.int64)
            half = len(at) // 2
            least = least_reached(len(nodes), at[:half], at[half:])
            moved = np.flatnonzero(least != np.arange(len(nodes)))
            return pa.RecordBatch.from_arrays([nodes.take(pa.array(moved)), nodes.take(pa.array(least[moved]))], ["u", "v"])

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= CONTRACTED:
                yield stars()
                held = []
        if held:
            yield stars()

    return edges.select("u", "v").mapInArrow(run, edges.select("u", "v").schema)


def connected_components(edges: DataFrame) -> DataFrame:
    """``u`` and ``v``, for each node ``u`` that is not the least of its component, which is ``v``.

    ``edges`` has ``u`` and ``v`` of any one orderable type, without nulls.
    Edges are contracted in the tasks that read them, and again where those
    of one ``u`` have come together, sorted, so that a task run anew gives the
    same stars. A node has then one edge for each contraction it was part of,
    however large its component, and most components are done: these are set
    aside, so that no round moves them again. For the rest
    every round is a few joins and partial aggregations, written to the shared
    folder, so lineage stays short and no component is gathered anywhere. The
    last few edges, at most ``LAST``, are united in one task. The
    least neighbours are written before they are joined: both sides of that
    join are then plain exchanges, which adaptive execution can split where one
    node has very many edges.
    """

    def met(rows: DataFrame) -> DataFrame:
        """Contracted in the tasks that hold them, then where edges of one ``u`` meet."""
        return materialise(contracted(contracted(rows).repartition("u").sortWithinPartitions("u", "v")).distinct())

    done, e = _split(met(edges.where("u <> v")))
    if e is None:
        return done
    parts = [done]
    while e is not None:
        if e.count() <= LAST:
            parts.append(materialise(contracted(e.coalesce(1))))
            release(e)
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialise(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")))
        # Large star: neighbours above a node move to its least neighbour.
        large = materialise(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        release(e, low)
        # Small star: a node and its neighbours below it move to the least of them.
        low = materialise(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        done, e = _split(met(small.unionByName(low.select("u", F.col("m").alias("v")))))
        parts.append(done)
        release(large, low)
    found = materialise(reduce(DataFrame.unionByName, parts))
    release(*parts)
    return found
