"""Toxicity: a factorization machine over hashed terms.

Terms of a text are its distinct lower-cased words and their openings of five
letters, hashed to buckets. The machine adds a weight for each term and, for
each pair of terms, the product of their learned vectors, so an insult may
count more next to the mention of a group than either does alone.

Defined cases: a null or empty text has no terms and gets the score of the
intercept; repeated rows are scored alike; labels of unknown documents and null
labels are left out; other columns are not read, and a kept column named
``score`` makes the result's ``_score``; without labels of both classes
every score is 0; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.llm.storage import beside, extended

BUCKETS = 1 << 18
FACTORS = 4
#: Bounds of the training sample, by class; rows are taken by the hash of their id.
MAX_TOXIC, MAX_CLEAN = 3000, 9000
EPOCHS, BATCH, DECAY = 6, 128, 1e-4
#: Log odds are smoothed by so many pseudo-texts.
SMOOTH = 20.0
#: Settings that are tried: the learning rate, and the bound below which log odds count as even.
SETTINGS = ((0.05, 0.7), (0.2, 0.3), (0.2, 0.7))
#: Settings are compared on so many texts of the training sample at most, by the hash of the id; one in TRIED of them tells.
COMPARED, TRIED = 2500, 5
CACHE = 200_000
_EDGES = ".,;:!?\"'()[]{}|*#$%&<>-_"


class Terms:
    """Buckets of a text's terms; those of words seen before are remembered, within a bound."""

    def __init__(self) -> None:
        self.known: dict[str, tuple[int, ...]] = {}

    def _of(self, chunk: str) -> tuple[int, ...]:
        word = chunk.strip(_EDGES)
        if not word:
            return ()
        one = crc32(word.encode()) % BUCKETS
        return (one, crc32(b"^" + word[:5].encode()) % BUCKETS) if len(word) > 5 else (one,)

    def buckets(self, text: str | None) -> np.ndarray:
        found: set[int] = set()
        for chunk in set((text or "").lower().split()):
            got = self.known.get(chunk)
            if got is None:
                if len(self.known) >= CACHE:
                    self.known.clear()
                got = self.known[chunk] = self._of(chunk)
            found.update(got)
        return np.fromiter(found, np.int64, len(found))


@dataclass
class Machine:
    """``value`` is what a term counts in the weighted sum: its log odds, 0 if those are near even.

    In the pairs every term takes part: one that is near even by itself counts 1
    over the root of the number of terms of its text, so that long texts have no
    more weight than short ones.
    """

    bias: float
    value: np.ndarray
    weight: np.ndarray
    vector: np.ndarray

    def paired(self, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """What each of the terms ``at`` counts in pairs; ``sizes`` are those of their texts, in order."""
        return np.where(self.value[at] != 0, self.value[at], np.repeat(1 / np.sqrt(np.maximum(sizes, 1)), sizes))

    def margins(self, terms: list[np.ndarray]) -> np.ndarray:
        """Bias, weighted values, and products of the vectors of each pair of terms."""
        out = np.full(len(terms), self.bias)
        full = [k for k, t in enumerate(terms) if len(t)]
        if full:
            sizes = np.array([len(terms[k]) for k in full])
            at = np.concatenate([terms[k] for k in full])
            starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            v = self.vector[at] * self.paired(at, sizes)[:, None]
            total = np.add.reduceat(v, starts, axis=0)
            own = np.add.reduceat(np.einsum("ij,ij->i", v, v), starts)
            out[full] += np.add.reduceat(self.weight[at] * self.value[at], starts) + 0.5 * ((total**2).sum(axis=1) - own)
        return out

    def scores(self, terms: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(terms), -30, 30)))


def log_odds(terms: list[np.ndarray], labels: np.ndarray, even: float = SETTINGS[-1][1]) -> np.ndarray:
    """Of each bucket: how much likelier it is in toxic texts, smoothed towards even; 0 within ``even``."""
    share = labels.mean()
    toxic = np.bincount(np.concatenate([t for t, y in zip(terms, labels, strict=True) if y]), minlength=BUCKETS)
    clean = np.bincount(np.concatenate([t for t, y in zip(terms, labels, strict=True) if not y]), minlength=BUCKETS)
    odds = np.log((toxic + SMOOTH * share) / (clean + SMOOTH * (1 - share))) - np.log(share / (1 - share))
    return np.where(np.abs(odds) < even, 0.0, odds)


def fit(terms: list[np.ndarray], labels: np.ndarray, rate: float = SETTINGS[-1][0], even: float = SETTINGS[-1][1]) -> Machine:
    """Logistic loss by minibatches with per-coordinate rates; the seed is fixed."""
    rng = np.random.default_rng(7)
    nothing = np.zeros(BUCKETS)
    if len(set(labels.tolist())) < 2 or not any(map(len, terms)):
        return Machine(-30.0, nothing, nothing, np.zeros((BUCKETS, FACTORS)))
    terms = [np.asarray(t, np.int64) for t in terms]
    m = Machine(0.0, log_odds(terms, labels, even), nothing.copy(), rng.normal(0, 0.01, (BUCKETS, FACTORS)))
    seen_w, seen_v, seen_b = np.full(BUCKETS, 1e-4), np.full((BUCKETS, FACTORS), 1e-4), 1e-4
    for _ in range(EPOCHS):
        order = rng.permutation(len(labels))
        for k in range(0, len(order), BATCH):
            chosen = order[k : k + BATCH]
            error = (m.scores([terms[r] for r in chosen]) - labels[chosen]) / len(chosen)
            gb = error.sum()
            seen_b += gb**2
            m.bias -= rate * gb / np.sqrt(seen_b)
            sizes = np.array([len(terms[r]) for r in chosen])
            if not sizes.any():
                continue
            at = np.concatenate([terms[r] for r in chosen])
            which = np.repeat(np.arange(len(chosen)), sizes)
            x = m.paired(at, sizes)[:, None]
            v = m.vector[at] * x
            total = np.stack([np.bincount(which, v[:, f], len(chosen)) for f in range(FACTORS)], 1)
            touched, place = np.unique(at, return_inverse=True)
            gw = np.bincount(place, error[which] * m.value[at]) + DECAY * m.weight[touched]
            grad_v = error[which, None] * x * (total[which] - v)
            gv = np.stack([np.bincount(place, grad_v[:, f]) for f in range(FACTORS)], 1) + DECAY * m.vector[touched]
            seen_w[touched] += gw**2
            seen_v[touched] += gv**2
            m.weight[touched] -= rate * gw / np.sqrt(seen_w[touched])
            m.vector[touched] -= rate * gv / np.sqrt(seen_v[touched])
    return m


def chosen(terms: list[np.ndarray], labels: np.ndarray, tried: np.ndarray) -> tuple[float, float]:
    """The setting with the least logistic loss on the texts ``tried`` after a fit on the others; the last if they cannot tell."""
    both = [len(set(labels[part].tolist())) == 2 for part in (tried, ~tried)]
    if not all(both):
        return SETTINGS[-1]
    rest, apart = np.flatnonzero(~tried), np.flatnonzero(tried)
    losses = []
    for rate, even in SETTINGS:
        margins = fit([terms[k] for k in rest], labels[rest], rate, even).margins([terms[k] for k in apart])
        losses.append(np.logaddexp(0, np.where(labels[apart] == 1, -margins, margins)).mean())
    return SETTINGS[int(np.argmin(losses))]


def held_out(ident: Column) -> Column:
    """True where crc32 of the id as text leaves remainder 1 by 3; false for a null id."""
    return F.coalesce(F.crc32(ident.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _known(labels: DataFrame, ident: str, label: str) -> DataFrame:
    known = labels.select(F.col(f"`{ident}`").alias("doc_id"), F.col(f"`{label}`").alias("label"))
    return known.where("doc_id is not null and label in (0, 1)").where(~held_out(F.col("doc_id")))


def training_sample(docs: DataFrame, labels: DataFrame, ident: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """``text`` and ``label`` of at most MAX_TOXIC and MAX_CLEAN rows that are not held out.

    The ids are chosen first, on the narrow table; only their texts are fetched.
    """
    known = _known(labels, ident, label)
    order = F.xxhash64("doc_id"), "doc_id", "label"
    some = known.where("label = 1").orderBy(*order).limit(MAX_TOXIC).unionByName(known.where("label = 0").orderBy(*order).limit(MAX_CLEAN))
    texts = docs.select(F.col(f"`{ident}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return texts.join(F.broadcast(some.dropDuplicates(["doc_id"])), "doc_id")


def train(docs: DataFrame, labels: DataFrame, ident: str = "doc_id", text: str = "text", label: str = "toxic") -> Machine:
    """A machine fitted on :func:`training_sample`; only buckets of its bounded rows come to the driver.

    The setting is chosen on a part of the sample. Where a bound of the sample
    takes a smaller share of one class, the intercept is moved back by the
    logarithm of the ratio of the shares, counted over all labels.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms()
        for b in batches:
            found = [np.sort(terms.buckets(t)).astype("<i4").tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label").cast(pa.int32()), pa.array(found, pa.binary())], ["doc_id", "label", "terms"])

    sample = training_sample(docs, labels, ident, text, label)
    schema = extended(sample.select("doc_id").schema, "label int, terms binary")
    rows: pd.DataFrame = sample.select("doc_id", "label", "text").mapInArrow(run, schema).toPandas()
    rows = rows.sort_values(["doc_id", "label"], kind="stable")
    terms, y = [np.frombuffer(t, "<i4") for t in rows["terms"]], rows["label"].to_numpy()
    order = np.array([crc32(f"tried {i}".encode()) for i in rows["doc_id"]], np.int64)
    some = np.argsort(order, kind="stable")[:COMPARED]
    machine = fit(terms, y, *chosen([terms[k] for k in some], y[some], order[some] % TRIED == 0)) if len(y) else fit(terms, y)
    n = {int(r["label"]): r["count"] for r in _known(labels, ident, label).groupBy("label").count().collect()}
    if n.get(0) and n.get(1):
        machine.bias -= float(np.log(min(1, MAX_TOXIC / n[1]) / min(1, MAX_CLEAN / n[0])))
    return machine


def score(docs: DataFrame, machine: Machine, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` and ``score`` for each row. The machine is sent to tasks; its size is fixed by BUCKETS and FACTORS."""
    model = docs.sparkSession.sparkContext.broadcast((machine.bias, *(x.astype(np.float32) for x in (machine.value, machine.weight, machine.vector))))

    def run(texts: list[str | None]) -> list[pa.Array]:
        m, terms = Machine(*model.value), Terms()
        parts = [m.scores([terms.buckets(t) for t in texts[k : k + 256]]) for k in range(0, len(texts), 256)]
        return [pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())]

    return beside(docs, keep, F.col(f"`{text}`"), "score double", run)
