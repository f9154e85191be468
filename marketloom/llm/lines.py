"""Fuzzy line dedup: near-equal lines form groups, and one occurrence of each group stays.

Lines are normalised (ASCII case, punctuation and digits folded); equal ones,
of any length, become one node. Distinct lines get blocked SimHash codes of
their words and meet in the buckets of their blocks (:mod:`blocks`); pairs that
meet are compared, and linked if their edit similarity is at least
``SIMILARITY``. Of each connected group the occurrence with the least
(document, place) stays in its document, the rest are cut out.

Defined cases: lines of fewer than ``FUZZY_WORDS`` words are linked only if
equal, lines without any word always stay; a null text
stays null, an empty one empty; rows that share id and text lose the same
lines, so of repeated rows none counts as a copy of the other; null ids come
before all others; other columns pass through, whatever their names; a text or
a line of any length is read whole; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.blocks import Likeness, block_keys, linked, majority_bits, mixed
from marketloom.llm.storage import extended, fresh, materialise, release, sent

MIN_WORDS, FUZZY_WORDS = 1, 5
#: Pairs whose SimHash codes differ in more bits are not compared. Codes of lines of similarity 0.8 differ in about
#: 13 bits, of unrelated ones in 32; among similar pairs 99.7 % are within the bound (sf0.1).
MAX_BITS = 18
SIMILARITY = 0.8
#: Shorter words (bytes) are no features if a line has FUZZY_WORDS others; with up to one more, all words are used as well.
FEATURE_BYTES = 4
#: Bytes of texts that are hashed at once.
HASHED_BYTES = 1 << 19

_FOLD = bytes(
    ord("0") if chr(c).isdigit() and c < 128 else ord(chr(c).lower()) if c < 128 and chr(c).isalpha() else c if c >= 128 or c == 10 else 32
    for c in range(256)
)


def normalised(text: str) -> list[list[bytes]]:
    """Words of each line of ``text``, folded."""
    return [line.split() for line in text.encode().translate(_FOLD).split(b"\n")]


def hashed_words(folded: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, bytes and line of each word of a folded text."""
    n = len(folded)
    raw = np.frombuffer(folded + bytes(16), np.uint8)
    inside = (raw[:n] != 32) & (raw[:n] != 10)
    edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
    start, size = edges[::2], edges[1::2] - edges[::2]
    octets = np.ndarray((n + 8,), "<u8", raw, 0, (1,))  # the eight bytes from each place on
    h = size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    going, at = np.arange(len(start)), 0
    while len(going):
        left = np.minimum(size[going] - at, 8).astype(np.uint64)
        part = octets[start[going] + at] & (~np.uint64(0) >> (np.uint64(8) * (np.uint64(8) - left)))
        h[going] = mixed(h[going] ^ part)
        at += 8
        going = going[size[going] > at]
    return h, size, np.searchsorted(np.flatnonzero(raw[:n] == 10), start)


def _pieces(texts: list[bytes]) -> Iterator[list[tuple[int, int, bytes]]]:
    """(row, line of its first, folded bytes) of whole lines, about HASHED_BYTES at a time."""
    held: list[tuple[int, int, bytes]] = []
    size = 0
    for k, text in enumerate(texts):
        text, line = text.translate(_FOLD), 0
        while True:
            cut = text.find(b"\n", HASHED_BYTES)
            part = text if cut < 0 else text[:cut]
            held.append((k, line, part))
            size += len(part)
            if size >= HASHED_BYTES:
                yield held
                held, size = [], 0
            if cut < 0:
                break
            line += part.count(b"\n") + 1
            text = text[cut + 1 :]
    if held:
        yield held


def signed_lines(texts: list[bytes]) -> dict[str, np.ndarray]:
    """``row``, ``line_no``, ``key`` (two words), ``fp``, ``size`` (bytes, normalised), and ``keys`` with their ``sizes``, of each line with a word."""
    out: dict[str, list[np.ndarray]] = {n: [] for n in ("row", "line_no", "key", "fp", "size", "sizes", "keys")}
    for held in _pieces(texts):
        h, size, line = hashed_words(b"\n".join(p for _, _, p in held))
        if not len(h):
            continue
        first = np.flatnonzero(np.append(True, line[1:] != line[:-1]))
        count = np.diff(np.append(first, len(h)))
        place = np.arange(len(h)) - np.repeat(first, count)
        # Sums of hashes, each times an odd factor of its place.
        factor = [mixed((place.astype(np.uint64) + np.uint64(1)) * np.uint64(c)) | np.uint64(1) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]
        out["key"].append(np.stack([mixed(np.add.reduceat(h * f, first) + count.astype(np.uint64)) for f in factor], 1))
        out["size"].append(np.add.reduceat(size, first) + count - 1)
        owner = np.repeat(np.arange(len(first)), count)
        long = size >= FEATURE_BYTES
        n_long = np.add.reduceat(long.astype(np.int64), first)
        fuzzy = count >= FUZZY_WORDS
        several, few = fuzzy & (n_long >= FUZZY_WORDS), fuzzy & (n_long < FUZZY_WORDS + 2)
        coded = long | (n_long < FUZZY_WORDS)[owner]
        out["fp"].append(majority_bits(h[coded], np.searchsorted(owner[coded], np.arange(len(first)))))
        found = []
        for used, least in ((several[owner] & long, 2), (few[owner], 4)):
            found.append(block_keys(h[used], owner[used], len(first), least))
        at, key = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(at, kind="stable")
        out["keys"].append(key[order])
        out["sizes"].append(np.bincount(at, minlength=len(first)))
        # Which piece, and so which row and line.
        begins = np.cumsum([0] + [p.count(b"\n") + 1 for _, _, p in held])
        piece = np.searchsorted(begins, line[first], "right") - 1
        rows, firsts = np.array([k for k, _, _ in held]), np.array([n for _, n, _ in held])
        out["row"].append(rows[piece])
        out["line_no"].append(line[first] - begins[piece] + firsts[piece])
    empty = {"key": np.zeros((0, 2), np.uint64), "fp": np.zeros(0, np.uint64), "keys": np.zeros(0, np.uint64)}
    return {n: np.concatenate(x) if x else empty.get(n, np.zeros(0, np.int64)) for n, x in out.items()}


def _binary(words: np.ndarray) -> pa.Array:
    """Rows of two words as binary values of 16 bytes, high byte first."""
    data = np.ascontiguousarray(words).astype(">u8").tobytes()
    offsets = np.arange(len(words) + 1, dtype=np.int32) * 16
    return pa.Array.from_buffers(pa.binary(), len(words), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)])


def _source(docs: DataFrame, ident: str, text: str) -> DataFrame:
    body = F.col(f"`{text}`")
    return docs.select(F.col(f"`{ident}`").alias("doc_id"), F.xxhash64(body).alias("row_hash"), body.cast("binary").alias("body"))


def line_table(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``row_hash``, ``line_no``, ``key`` (128-bit hash of the normalised line), ``node``, ``fp``, ``size`` and ``keys`` of each line that counts."""
    source = _source(docs, ident, text).where("body is not null")
    schema = extended(source.drop("body").schema, "line_no int, key binary, node long, fp long, size long, keys array<long>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(2)
            at = 0
            while at < b.num_rows:  # results of about as many texts as HASHED_BYTES holds
                end, size = at, 0
                while end < b.num_rows and size < HASHED_BYTES:
                    size += len(texts[end].as_buffer())
                    end += 1
                got = signed_lines(texts.slice(at, end - at).to_pylist())
                rows = pa.array(got["row"].astype(np.int64) + at)
                offsets = np.concatenate(([0], np.cumsum(got["sizes"]))).astype(np.int32)
                keys = pa.ListArray.from_arrays(pa.array(offsets), pa.array(got["keys"].view(np.int64)))
                node = np.ascontiguousarray(got["key"][:, 0]).view(np.int64)
                columns = [pa.array(got["line_no"].astype(np.int32)), _binary(got["key"]), pa.array(node), pa.array(got["fp"].view(np.int64)), pa.array(got["size"].astype(np.int64)), keys]
                yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), *columns], schema.names)
                at = end

    return source.mapInArrow(run, schema)


def _allowed(longer: int, least: float = SIMILARITY) -> int:
    return int((1 - least) * longer + 1e-9)


#: How many words of either side are passed over to find the next equal word, the least first.
_STEPS = sorted(((i, j) for i in range(5) for j in range(5) if i or j), key=lambda s: (max(s), abs(s[0] - s[1])))


def _aligned(x: list[bytes], y: list[bytes], enough: int) -> int:
    """What one alignment of two lists of words costs: at least their edit distance, each word with a blank behind it."""
    i = j = cost = 0
    n, m = len(x), len(y)
    while i < n and j < m and cost <= enough:
        if x[i] == y[j]:
            i += 1
            j += 1
            continue
        for p, q in _STEPS:
            if i + p < n and j + q < m and x[i + p] == y[j + q]:
                break
        else:
            p = q = 1
        cost += max(sum(map(len, x[i : i + p])) + p, sum(map(len, y[j : j + q])) + q)
        i += p
        j += q
    return cost + max(sum(map(len, x[i:])) + n - i, sum(map(len, y[j:])) + m - j)


GRAM = 3


def _runs(a: bytes) -> np.ndarray:
    x = np.frombuffer(a, np.uint8).astype(np.int32)
    return np.sort((x[:-2] << 16) + (x[1:-1] << 8) + x[2:]) if len(x) >= GRAM else x[:0]


def _shared_runs(a: bytes, b: bytes) -> int:
    """How many runs of GRAM bytes two texts have in common, each as often as both have it."""
    both = np.sort(np.concatenate([_numbered(_runs(a)), _numbered(_runs(b))]))
    return int((both[1:] == both[:-1]).sum())


def _numbered(runs: np.ndarray) -> np.ndarray:
    """Sorted runs with the number of each among its equals, so that all differ."""
    if not len(runs):
        return runs.astype(np.int64)
    at = np.arange(len(runs))
    first = np.maximum.accumulate(np.where(np.append(True, runs[1:] != runs[:-1]), at, 0))
    return (runs.astype(np.int64) << 32) + at - first


def _between(a: bytes, b: bytes) -> tuple[list[bytes], list[bytes]]:
    """The words of two texts without the equal ones at both ends."""
    x, y = a.split(b" "), b.split(b" ")
    k, shorter = 0, min(len(x), len(y))
    while k < shorter and x[k] == y[k]:
        k += 1
    e = 0
    while e < shorter - k and x[-1 - e] == y[-1 - e]:
        e += 1
    return x[k : len(x) - e], y[k : len(y) - e]


def surely_similar(a: bytes, b: bytes, least: float = SIMILARITY) -> bool:
    """Whether one alignment of the words costs little enough; else nothing is known."""
    allowed = _allowed(max(len(a), len(b)), least)
    return abs(len(a) - len(b)) <= allowed and _aligned(*_between(a, b), allowed) <= allowed


def edit_similar(a: bytes, b: bytes, least: float = SIMILARITY) -> bool:
    """Whether 1 - (edit distance / longer length) is at least ``least``.

    Equal words at both ends are left out. What remains is similar if a way to
    align its words costs little enough, and is not if the counts of its bytes
    or runs of bytes differ too much; else a bit-parallel column per byte decides.
    """
    allowed = _allowed(max(len(a), len(b)), least)
    if abs(len(a) - len(b)) > allowed:
        return False
    x, y = _between(a, b)
    if _aligned(x, y, allowed) <= allowed:
        return True
    a, b = b" ".join(x), b" ".join(y)
    if not a or not b:
        # Where no word is left on one side, the blank beside the others goes with them: as aligned above.
        return bool(x and y) and max(len(a), len(b)) <= allowed
    counts = np.bincount(np.frombuffer(a, np.uint8), minlength=256) - np.bincount(np.frombuffer(b, np.uint8), minlength=256)
    if max(counts[counts > 0].sum(), -counts[counts < 0].sum()) > allowed:
        return False
    # An edit changes at most GRAM runs of GRAM bytes.
    if max(len(a), len(b)) - GRAM + 1 - _shared_runs(a, b) > GRAM * allowed:
        return False
    return distance_within(a, b, allowed)


def distance_within(a: bytes, b: bytes, allowed: int) -> bool:
    """Whether the edit distance of two texts that are not empty is at most ``allowed``."""
    where: dict[int, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    plus, minus, distance, left = full, 0, len(a), len(b)
    for c in b:
        match = where.get(c, 0)
        carry = (((match & plus) + plus) ^ plus) | match | minus
        up = minus | ~(carry | plus) & full
        down = plus & carry
        if up & top:
            distance += 1
        if down & top:
            distance -= 1
        left -= 1
        if distance - left > allowed:
            return False
        up = (up << 1 | 1) & full
        plus = (down << 1) & full | ~(carry | up) & full
        minus = up & carry & full
        # carry uses the row's vertical deltas, which already hold matches of minus
    return distance <= allowed


#: Bytes of a part whose rows one machine word holds; the class of bytes in the margins between texts, which equals nothing.
WORD, MARGIN = 64, 30
#: Pairs that :func:`surely_apart` takes side by side, at most and at least; fewer are compared one by one.
BESIDE, FEW = 4096, 64
#: Bytes of the other texts that are looked at for a part of each of these pairs, at most; still longer texts are compared one by one.
LOOKED_AT = 1 << 20
#: Classes of folded bytes: letters, blank, digit, and two for all others. Fewer classes make texts more alike, never less.
_CLASS = np.array([c - 97 if 97 <= c <= 122 else 26 if c == 32 else 27 if c == 48 else 28 + c % 2 if c else MARGIN for c in range(256)], np.uint8)


def surely_apart(bodies: list[bytes], i: np.ndarray, j: np.ndarray, least: float = SIMILARITY) -> np.ndarray:
    """Which of the pairs of places ``i``, ``j`` can't be similar, without a doubt; of all others nothing is known.

    A text is cut into parts of ``WORD`` bytes. Of texts within a distance each
    part lies in the other one shifted by the distance at most, and what the
    parts cost there does not sum to more than the distance. The least cost of
    a part is counted for many pairs side by side, a byte of all their other
    texts at a time, as long as its sum may come to more than is allowed.
    """
    size = np.fromiter(map(len, bodies), np.int64, len(bodies))
    longer = np.maximum(size[i], size[j])
    allowed = ((1 - least) * longer + 1e-9).astype(np.int64)
    out = np.abs(size[i] - size[j]) > allowed
    going = np.flatnonzero(~out & (size[i] >= WORD))
    going = going[np.argsort(longer[going], kind="stable")]
    while len(going) >= FEW:
        n = min(BESIDE, len(going))
        while n >= FEW and n * (WORD + 2 * allowed[going[n - 1]]) > LOOKED_AT:
            n //= 2
        if n < FEW:
            break  # all that follow are longer
        left, going = going[:n], going[n:]
        used, at = np.unique(np.concatenate([i[left], j[left]]), return_inverse=True)
        # A margin behind each text, and before the first, is wider than any shift.
        margin = 2 * int(allowed[left[-1]]) + WORD
        begin = np.cumsum(size[used] + margin) - size[used]
        code = _CLASS[np.frombuffer(bytes(margin).join([b"", *(bodies[k] for k in used.tolist()), b""]), np.uint8)]
        part, other = begin[at[:n]], begin[at[n:]]
        cost, first = np.zeros(n, np.int64), 0
        while len(left) >= FEW:
            cost += _least_costs(code, part, other, first, int(allowed[left].max()))
            first += WORD
            out[left] = far = cost > allowed[left]
            own = size[i[left]]
            more = ~far & (own >= first + WORD) & (cost * own > allowed[left] * first)
            left, cost, part, other = left[more], cost[more], part[more], other[more]
    return out


def _least_costs(code: np.ndarray, part: np.ndarray, other: np.ndarray, first: int, shift: int) -> np.ndarray:
    """Least edit distance of the part from ``first`` on of each text to any part of the other text that lies within ``shift`` of it."""
    parts, row = np.unique(part, return_inverse=True)
    n = np.arange(len(parts))
    where = np.zeros((MARGIN + 1, len(parts)), np.uint64)
    for bit in range(WORD):
        where[code[parts + (first + bit)], n] |= np.uint64(1 << bit)
    where[MARGIN] = 0
    flat = where.ravel()
    back = min(shift, first)
    places = code[(other + (first - back)) + np.arange(WORD + shift + back)[:, None]].astype(np.int64) * len(parts) + row
    plus, minus = np.full(len(part), ~np.uint64(0)), np.zeros(len(part), np.uint64)
    match, across, up, down = (np.empty(len(part), np.uint64) for _ in range(4))
    cost = np.full(len(part), WORD, np.uint64)
    least, one, top = cost.copy(), np.uint64(1), np.uint64(WORD - 1)
    for at in places:
        flat.take(at, out=match, mode="clip")
        np.bitwise_or(match, minus, out=across)
        # A column as in distance_within: carry in place of down, then up and down.
        np.bitwise_and(match, plus, out=down)
        down += plus
        down ^= plus
        down |= match
        np.bitwise_or(down, plus, out=up)
        np.invert(up, out=up)
        up |= minus
        down &= plus
        cost += np.right_shift(up, top, out=match)
        cost -= np.right_shift(down, top, out=match)
        np.minimum(least, cost, out=least)
        up <<= one
        if not first:  # texts begin together
            up |= one
        down <<= one
        np.bitwise_or(across, up, out=plus)
        np.invert(plus, out=plus)
        plus |= down
        np.bitwise_and(up, across, out=minus)
    return least.view(np.int64)


def _bodies(docs: DataFrame, ident: str, text: str, nodes: DataFrame, wanted: DataFrame, most: int) -> DataFrame:
    """``node``, ``key`` and ``body`` of the at ``most`` so many lines of ``wanted``, each read where it stands first."""
    places = nodes.join(wanted, "node").select("first.*", "node", "key")
    places = places.groupBy("doc_id", "row_hash").agg(F.collect_list(F.struct("line_no", "node", "key")).alias("lines"))
    here = sent(places.select(F.col("doc_id").alias("at"), F.col("row_hash").alias("hash"), "lines"), most * 112)
    found = _source(docs, ident, text).join(here, F.col("doc_id").eqNullSafe(F.col("at")) & (F.col("row_hash") == F.col("hash"))).select("lines", "body")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, edge = b.column(0).flatten(), b.column(0).offsets.to_numpy()
            numbers, bodies = flat.field(0).to_numpy(), []
            for k, folded in enumerate(t.translate(_FOLD) for t in b.column(1).to_pylist()):
                lines = folded.split(b"\n")
                bodies += [b" ".join(lines[n].split()) for n in numbers[edge[k] - edge[0] : edge[k + 1] - edge[0]]]
            yield pa.RecordBatch.from_arrays([flat.field(1), flat.field(2), pa.array(bodies, pa.binary())], ["node", "key", "body"])

    return found.mapInArrow(run, "node long, key binary, body binary").dropDuplicates(["key"])


def removed_lines(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``row_hash`` and ``removed`` (line numbers from 0, sorted) of each document that loses lines."""
    rows = materialise(line_table(docs, ident, text))
    place = F.struct("doc_id", "row_hash", "line_no")
    nodes = materialise(rows.groupBy("key").agg(F.min(place).alias("first"), F.count("*").alias("n"), F.min("node").alias("node")))
    signed = materialise(rows.where(F.size("keys") > 0).select("node", "fp", "size", "keys").dropDuplicates(["node"]))
    classes = linked(signed, lambda wanted, most: _bodies(docs, ident, text, nodes, wanted, most), Likeness(edit_similar, surely_similar, surely_apart), MAX_BITS, short=True)
    members = materialise(classes.join(nodes, "key").select("key", "group", "first"))
    kept = materialise(members.groupBy("group").agg(F.min("first").alias("kept")))
    grouped = members.join(kept, "group").select("key", "kept")
    repeated = nodes.where("n > 1").join(grouped, "key", "left_anti").select("key", F.col("first").alias("kept"))
    doubtful = grouped.unionByName(repeated)
    cut = rows.join(doubtful, "key").where(~place.eqNullSafe(F.col("kept")))
    removed = materialise(cut.groupBy("doc_id", "row_hash").agg(F.array_sort(F.collect_list("line_no")).alias("removed")))
    release(rows, nodes, signed, classes, members, kept)
    return removed


def dedup_lines(docs: DataFrame, ident: str = "doc_id", text: str = "text", count: str | None = None) -> DataFrame:
    """``docs`` without the removed lines; ``count`` names a column for how many went, if it is wanted."""
    removed = removed_lines(docs, ident, text)
    gone_id, gone_hash, gone, parts = fresh(docs, "gone_id", "gone_hash", "gone", "parts")
    n_bytes = removed.agg(F.sum(F.size("removed") * 4 + 48)).first()[0]
    cuts = sent(removed.select(F.col("doc_id").alias(gone_id), F.col("row_hash").alias(gone_hash), F.col("removed").alias(gone)), n_bytes)
    body = F.col(f"`{text}`")
    joined = docs.join(cuts, F.col(f"`{ident}`").eqNullSafe(F.col(gone_id)) & (F.xxhash64(body) == F.col(gone_hash)), "left")
    # A column of its own: the function below must not split the text for each line.
    joined = joined.withColumn(parts, F.when(F.col(gone).isNotNull(), F.split(body, "\n")))
    stay = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), gone)
    new = F.when(F.col(gone).isNull(), body).otherwise(F.array_join(F.transform(stay, lambda i: F.get(parts, i)), "\n"))
    columns = [new.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns]
    if count:
        columns.append(F.coalesce(F.size(gone), F.lit(0)).cast("long").alias(count))
    return joined.select(*columns)
