"""Whitening of embeddings by their principal components.

A vector's entries become whole numbers, ``floor(256 * c)``. The distinct
vectors are the fit list: their number and sums are exact, so its rows are
centred exactly before MLlib's ``RowMatrix`` multiplies them. The Gramian over
the number of rows is the covariance, of the size of the dimension alone; its
eigenvectors are found on the driver and sent to the tasks that project.

Defined cases: rows whose vector is null, or has null or non-finite entries, are
left out; entries beyond a long become its largest or smallest value; a shorter
vector counts as zero beyond its end; repeated rows give repeated results; a null
id passes through, other columns are not read, and a kept column named as a result
renames the result as :func:`marketloom.llm.storage.fresh` says. A component
without variance (a single vector, or fewer independent ones than components) has
null ``whitened`` and takes no part in ``identity_error``; a ``deviation`` that a
long can't hold is null. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from marketloom.llm.storage import fresh, materialise, release

COMPONENTS = 4
SCALE = 256
_RESULTS = "component int, n long, deviation long, whitened double, explained double, identity_error double"


@dataclass
class Whitening:
    """What is fitted: everything has the size of the dimension."""

    n: int
    sums: list[int]
    #: Largest absolute entry of the fit list.
    largest: int
    #: Unit eigenvectors as columns, by falling eigenvalue.
    vectors: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float | None = None

    @property
    def exact(self) -> bool:
        """Whether a long holds every centred entry, ``n * x - sum``."""
        return 2 * self.largest * self.n < 1 << 62

    def centred(self, x: np.ndarray) -> np.ndarray:
        """``n * x - sum``, as whole numbers."""
        if self.exact:
            return self.n * x - np.array(self.sums, np.int64)
        return self.n * x.astype(object) - np.array(self.sums, object)

    def project(self, centred: np.ndarray) -> np.ndarray:
        """Whitened rows; a component without variance has NaN."""
        with np.errstate(divide="ignore", invalid="ignore"):
            rows = (centred / self.n).astype(float) @ self.vectors / np.sqrt(np.maximum(self.eigenvalues, 0))
        rows[:, ~self.varied] = np.nan
        return rows

    @property
    def varied(self) -> np.ndarray:
        return self.eigenvalues > max(self.trace, 0) * len(self.sums) * np.finfo(float).eps


def quantised(rows: DataFrame, column: str, keep: list[str]) -> DataFrame:
    """``keep`` and ``x``, whole numbers, of the rows whose vector has only finite entries."""
    entry = F.col(f"`{column}`")
    finite = F.forall(entry, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    x = F.transform(entry, lambda c: F.floor(c.cast("double") * SCALE).cast("long"))
    return rows.where(entry.isNotNull() & finite).select(*(F.col(f"`{c}`") for c in keep), x.alias(fresh_x(keep)))


def fresh_x(keep: list[str]) -> str:
    name = "x"
    while name.lower() in {c.lower() for c in keep}:
        name = "_" + name
    return name


def _padded(x: Column, size: int) -> Column:
    return F.when(F.size(x) < size, F.concat(x, F.array_repeat(F.lit(0).cast("long"), F.lit(size) - F.size(x)))).otherwise(x)


def _matrix(lists: pd.Series, size: int) -> np.ndarray:
    """A row of ``size`` entries for each list, zero beyond its end."""
    out = np.zeros((len(lists), size), np.int64)
    for k, x in enumerate(lists):
        out[k, : min(len(x), size)] = x[:size]
    return out


def _sums(vectors: DataFrame, size: int) -> list[int]:
    """Exact sums of each entry: within batches first, so few rows are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = b.column(0).flatten().to_numpy().reshape(-1, size)
                wide = np.abs(x.astype(float)).max(initial=0) * len(x) >= 2.0**62
                total = (x.astype(object) if wide else x).sum(axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array([str(t) for t in total.tolist()])], ["at", "total"])

    parts = vectors.select("x").mapInArrow(run, "at int, total string")
    found = parts.groupBy("at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    totals = {r["at"]: int(r["total"]) for r in found}
    return [totals.get(k, 0) for k in range(size)]


def fit(rows: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """The whitening of the distinct vectors of ``rows``; None if there are none."""
    plain = quantised(rows, column, [])
    size = plain.agg(F.max(F.size("x"))).first()[0]
    if not size:
        return None
    vectors = materialise(plain.select(_padded(F.col("x"), size).alias("x")).distinct())
    ends = F.greatest(F.abs(F.array_max("x").cast("decimal(20,0)")), F.abs(F.array_min("x").cast("decimal(20,0)")))
    n, largest = vectors.agg(F.count("*"), F.max(ends)).first()
    sums = _sums(vectors, size)
    model = Whitening(n, sums, int(largest), np.zeros((size, 0)), np.zeros(0), 0.0)
    if model.exact:
        totals = F.array(*(F.lit(s).cast("long") for s in sums))
        centred = F.zip_with("x", totals, lambda v, s: (v * F.lit(n).cast("long") - s).cast("double") / n)
    else:
        totals = F.array(*(F.lit(s / n) for s in sums))
        centred = F.zip_with("x", totals, lambda v, s: v.cast("double") - s)
    as_rows = MLUtils.convertVectorColumnsFromML(vectors.select(array_to_vector(centred).alias("row")), "row")
    covariance = RowMatrix(as_rows).computeGramianMatrix().toArray() / n
    values, found = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[:components]
    chosen = found[:, order]
    chosen = chosen * np.where(chosen[np.abs(chosen).argmax(axis=0), np.arange(chosen.shape[1])] < 0, -1, 1)  # one of the two signs, always the same
    model.vectors, model.eigenvalues, model.trace = chosen, values[order], float(np.trace(covariance))
    model.identity_error = _identity_error(vectors, model)
    release(vectors)
    return model


def _identity_error(vectors: DataFrame, model: Whitening) -> float | None:
    """Largest absolute entry of the covariance of the whitened fit list, less the identity."""
    names = [f"c{k}" for k in np.flatnonzero(model.varied)]
    if not names:
        return None
    sent = vectors.sparkSession.sparkContext.broadcast(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = sent.value
        for f in frames:
            yield pd.DataFrame(m.project(m.centred(_matrix(f["x"], len(m.sums))))[:, m.varied], columns=names)

    rows = vectors.mapInPandas(run, ", ".join(f"{c} double" for c in names))
    pairs = [(a, b) for k, a in enumerate(names) for b in names[: k + 1]]
    found = rows.agg(*(F.covar_pop(a, b) for a, b in pairs)).first()
    return float(max(abs(c - (a == b)) for c, (a, b) in zip(found, pairs, strict=True)))


def whitened(rows: DataFrame, model: Whitening | None, keep: list[str], column: str = "embedding") -> DataFrame:
    """``keep``, and for each component its number, ``n``, ``deviation``, ``whitened``, ``explained`` and ``identity_error``."""
    x = fresh_x(keep)
    source = quantised(rows, column, keep)
    kept = source.drop(x)
    added = StructType.fromDDL(_RESULTS)
    schema = StructType(kept.schema.fields + [StructField(n, f.dataType) for n, f in zip(fresh(kept, *added.names), added.fields, strict=True)])
    if model is None:
        return rows.sparkSession.createDataFrame([], schema)
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = sent.value
        k = len(m.eigenvalues)
        for f in frames:
            centred = m.centred(_matrix(f[x], len(m.sums)))
            if m.exact and np.abs(centred.astype(float)).max(initial=0) ** 2 * len(m.sums) < 2.0**62:
                deviation = (centred * centred).sum(axis=1).tolist()
            else:
                whole = (centred.astype(object) ** 2).sum(axis=1).tolist() if len(centred) else []
                deviation = [d if d < 1 << 63 else None for d in whole]
            projected = m.project(centred)
            out = f.drop(columns=x)
            out = out.loc[out.index.repeat(k)].reset_index(drop=True)
            names = schema.names[-6:]
            out[names[0]] = np.tile(np.arange(1, k + 1, dtype=np.int32), len(f))
            out[names[1]] = m.n
            out[names[2]] = pd.array(np.repeat(np.array(deviation, object), k), "Int64")
            flat = projected.ravel()
            out[names[3]] = pd.Series(np.where(np.isnan(flat), None, flat), dtype=object)
            out[names[4]] = np.tile(m.eigenvalues / m.trace if m.trace > 0 else np.zeros(k), len(f))
            out[names[5]] = pd.Series([m.identity_error] * len(out), dtype=object)
            yield out[schema.names]

    return source.select(*(F.col(f"`{c}`") for c in source.columns)).mapInPandas(run, schema)
