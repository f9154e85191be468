"""Personal data: patterns, and a skip-chain conditional random field that adds to them.

Patterns find e-mail addresses, IP addresses, payment cards and phone numbers.
The field labels the mentions of a document that hold a digit, ``@`` or ``+``, or
an address with its sign in words: side by side they form chains, and repeated
or similar ones far apart are joined by skip edges. Loopy messages let an entity
recognised in one place label its other mentions, which patterns alone miss.

Defined cases: a null or empty text has no spans; repeated rows are judged
alike, each on its own; very long texts are scanned once from left to right;
other columns pass through :func:`redact`; kept columns named ``base`` or
``spans`` make the results ``_base`` and ``_spans``; an empty table gives an
empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.storage import beside

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]  # kind, start, end

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def card_like(w: str) -> bool:
    digits = "".join(c for c in w if "0" <= c <= "9")
    return 13 <= len(digits) <= 19 and luhn(digits)


def _emails(text: str) -> Iterator[Span]:
    """As the pattern read from the left, but led by ``@``, so a long run of letters is read once."""
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            done = found.end()
            yield 0, start, done
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """Spans of the patterns, by kind and start; a match that fails its test is dropped."""
    spans = list(_emails(text))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            spans.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            spans.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                spans.append((3, m.start(), m.end()))
    return spans


# The field. Labels: 0 for none, then KINDS.
LABELS = 1 + len(KINDS)
FEATURES = 4096
#: Bounds of the training sample: texts, and their code points in all.
SAMPLE, SAMPLE_CHARS = 2000, 8_000_000
EPOCHS, RATE, DECAY = 200, 0.5, 1e-4
#: Messages go around at most so often, and stop once none changes by more than STILL.
ROUNDS, STILL = 40, 1e-5
SURE = 0.9
#: Logarithm by which a pattern's label outweighs the others where it was found.
KNOWN = 50.0
_TOKEN = re.compile(r"[^\s]*[0-9@+][^\s]*")
_AT = re.compile(r"\(at\)|\[at\]|(?<=\S) at (?=\S)", re.IGNORECASE)
_TRIM = ".,;:!?\"'<>[]{}|"
#: A repeated token is joined to its last mention; a similar one to the last that shares its digits' end.
SIMILAR_DIGITS = 7


def plainly(w: str) -> str:
    """A mention as it would be written for a pattern to find: signs put in words or brackets are put back."""
    return _AT.sub("@", w.lower()).replace("[.]", ".").replace("(.)", ".").replace("[@]", "@").replace(" ", "")


def _mentions(text: str) -> list[tuple[int, int]]:
    """Places of what may be personal data: tokens with a digit, ``@`` or ``+``, and addresses with their sign in words."""
    spans, done = [], 0
    for m in _AT.finditer(text):
        start = m.start()
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        found = _DOMAIN.match(text, m.end()) if start < m.start() else None
        if found:
            done = found.end()
            spans.append((start, done))
    worded = spans[:]
    for m in _TOKEN.finditer(text):
        a, b = m.span()
        while a < b and text[a] in _TRIM:
            a += 1
        while b > a and text[b - 1] in _TRIM:
            b -= 1
        if a < b:
            spans.append((a, b))
    if worded:
        spans.sort()
        clear: list[tuple[int, int]] = []
        for a, b in spans:
            if not clear or a >= clear[-1][1]:
                clear.append((a, b))
            elif (a, b) in worded:
                clear[-1] = (min(a, clear[-1][0]), max(b, clear[-1][1]))
        return clear
    return spans


class Tokens:
    """Mentions that may be personal data, their features and edges."""

    def __init__(self, text: str) -> None:
        self.spans = _mentions(text)
        words = [text[a:b] for a, b in self.spans]
        n = len(words)
        # Token k and k + 1 are side by side if only blanks lie between them.
        self.next = [k for k in range(n - 1) if self.spans[k + 1][0] - self.spans[k][1] <= 2 and not text[self.spans[k][1] : self.spans[k + 1][0]].strip()]
        self.skips: list[tuple[int, int]] = []
        last: dict[str, int] = {}
        beside = {k + 1 for k in self.next}
        digits = ""
        for k, w in enumerate(words):
            # A number may be written in several tokens side by side.
            digits = (digits[-15:] if k in beside else "") + "".join(c for c in w if "0" <= c <= "9")
            keys = {"=" + plainly(w)}
            if len(digits) >= SIMILAR_DIGITS:
                keys.add("#" + digits[-SIMILAR_DIGITS:])
            for j in {last[key] for key in keys if key in last}:
                self.skips.append((j, k))
            last.update(dict.fromkeys(keys, k))
        self.features = [self._features(w) for w in words]

    @staticmethod
    def _features(w: str) -> list[int]:
        shape = re.sub(r"[A-Za-z]+", "a", re.sub(r"[0-9]", "9", w))
        digits = sum("0" <= c <= "9" for c in w)
        named = (
            "bias",
            "shape " + shape[:40],
            "short " + re.sub(r"(.)\1+", r"\1", shape)[:24],
            f"digits {min(digits, 20)}",
            f"at {'@' in w} {bool(_AT.search(w))} dots {min(w.count('.'), 5)} plus {w.startswith('+')}",
            f"letters {any(c.isalpha() for c in w)}",
            f"card {card_like(w)}",
        )
        return [crc32(f.encode()) % FEATURES for f in named]

    def labels(self, spans: list[Span]) -> np.ndarray:
        """Label of each token by the spans that it overlaps."""
        out = np.zeros(len(self.spans), np.int64)
        ordered = sorted(spans, key=lambda s: s[1])
        ends = np.array([a for a, _ in self.spans])
        for kind, start, end in ordered:
            for k in range(max(0, int(np.searchsorted(ends, start, "right")) - 1), len(self.spans)):
                a, b = self.spans[k]
                if a >= end:
                    break
                if b > start:
                    out[k] = kind + 1
        return out


def _uncertain(text: str, tokens: Tokens, labels: np.ndarray) -> np.ndarray:
    """Tokens that a pattern may have missed: they teach nothing. A long number without a check digit is no such token."""
    odd = np.zeros(len(labels), bool)
    for k, (a, b) in enumerate(tokens.spans):
        digits = sum("0" <= c <= "9" for c in text[a:b])
        odd[k] = labels[k] == 0 and (9 <= digits <= 12 or card_like(text[a:b]) or "@" in plainly(text[a:b]))
    for a, b in tokens.skips:
        odd[a] |= labels[a] == 0 and labels[b] > 0
        odd[b] |= labels[b] == 0 and labels[a] > 0
    return odd


def disguised(kind: int, mention: str, pick: int) -> str:
    """Another way to write a mention, which no pattern finds: how an entity is named again."""
    digits = "".join(c for c in mention if "0" <= c <= "9")
    if kind == 0:
        return mention.replace("@", (" at ", "(at)", "[at]")[pick % 3])
    if kind == 1:
        return mention.replace(".", ("[.]", "(.)")[pick % 2])
    if kind == 2:
        return ("/", ".", "_")[pick % 3].join(digits[k : k + 4] for k in range(0, len(digits), 4))
    tail = digits[-9:]
    return (digits, tail, "-".join((tail[:3], tail[3:6], tail[6:])), "00" + digits)[pick % 4]


def _other_digits(mention: str, rng: np.random.Generator) -> str:
    return "".join(str(rng.integers(10)) if "0" <= c <= "9" else chr(97 + int(rng.integers(26))) if c.isascii() and c.isalpha() else c for c in mention)


def fit(texts: list[str]) -> dict[str, np.ndarray]:
    """Weights of features, of neighbours' labels and of skip neighbours' labels, by pseudo-likelihood.

    Labels are those of the patterns. Beside its features, a token's label is
    explained by those of its neighbours; pair weights are kept symmetric. The
    patterns label no mention that they miss, so for each labelled mention the
    sample also gets a disguised one, linked to it and of its label, and two of
    that writing with other letters and digits, one alone and one linked to
    what is none, without a label. Their features tell nothing apart: how far a
    linked mention decides is learned from them.
    """
    rng = np.random.default_rng(4)
    rows, ys, left, skip = [], [], [], []
    nothing = np.zeros((1, LABELS))
    for text in texts:
        t = Tokens(text)
        base = base_spans(text)
        y = t.labels(base)
        beside, far = np.zeros((len(y), LABELS)), np.zeros((len(y), LABELS))
        for k in t.next:
            beside[k, y[k + 1]] += 1
            beside[k + 1, y[k]] += 1
        for a, b in t.skips:
            far[a, y[b]] += 1
            far[b, y[a]] += 1
        keep = ~_uncertain(text, t, y)
        rows += [f for f, good in zip(t.features, keep, strict=True) if good]
        ys.append(y[keep]), left.append(beside[keep]), skip.append(far[keep])
        for kind, start, end in base:
            again = disguised(kind, text[start:end], int(rng.integers(12)))
            for word, label, linked in ((again, kind + 1, kind + 1), (_other_digits(again, rng), 0, None), (_other_digits(again, rng), 0, 0)):
                rows.append(Tokens._features(word))
                ys.append(np.array([label])), left.append(nothing)
                skip.append(nothing if linked is None else np.eye(LABELS)[[linked]])
    w = {"node": np.zeros((FEATURES, LABELS)), "chain": np.zeros((LABELS, LABELS)), "skip": np.zeros((LABELS, LABELS))}
    if not rows:
        w["node"][:, 0] = 1.0
        return w
    x, y, near, far = np.array(rows), np.concatenate(ys), np.concatenate(left), np.concatenate(skip)
    near, far = near / np.maximum(near.sum(1, keepdims=True), 1), far / np.maximum(far.sum(1, keepdims=True), 1)
    want = np.eye(LABELS)[y]
    balance = (1 / np.sqrt(np.maximum(want.sum(0), 1)))[y]
    balance /= balance.mean()
    seen = {name: np.full(part.shape, 1e-6) for name, part in w.items()}
    for _ in range(EPOCHS):
        z = w["node"][x].sum(1) + near @ w["chain"] + far @ w["skip"]
        p = np.exp(z - z.max(1, keepdims=True))
        g = (p / p.sum(1, keepdims=True) - want) * balance[:, None] / len(y)
        step = {"node": np.stack([np.bincount(x.ravel(), np.repeat(g[:, c], x.shape[1]), FEATURES) for c in range(LABELS)], 1)}
        for name, part in (("chain", near), ("skip", far)):
            change = part.T @ g
            step[name] = (change + change.T) / 2
        for name, change in step.items():
            change = change + DECAY / len(y) * w[name]
            seen[name] += change**2
            w[name] -= RATE * change / np.sqrt(seen[name])
    return w


def marginals(tokens: Tokens, w: dict[str, np.ndarray], seen: np.ndarray | None = None) -> np.ndarray:
    """Beliefs after damped messages along chain and skip edges (sum-product, in logarithms).

    ``seen`` has the labels that are known; 0 where there is none.
    """
    n = len(tokens.spans)
    node = w["node"][np.array(tokens.features)].sum(1)
    if seen is not None:
        (sure,) = np.nonzero(seen)
        node[sure] = -KNOWN
        node[sure, seen[sure]] = 0.0
    edges = [(k, k + 1, 0) for k in tokens.next] + [(a, b, 1) for a, b in tokens.skips]
    belief = node - node.max(1, keepdims=True)
    if edges:
        a, b, kind = (np.array(c) for c in zip(*edges, strict=True))
        source, target = np.concatenate([a, b]), np.concatenate([b, a])
        pair = np.stack([w["chain"], w["skip"]])[np.concatenate([kind, kind])]
        m = len(a)
        back = np.concatenate([np.arange(m, 2 * m), np.arange(m)])
        message = np.zeros((2 * m, LABELS))
        for _ in range(ROUNDS):
            total = node.copy()
            np.add.at(total, target, message)
            out = (total[source] - message[back])[:, :, None] + pair
            top = out.max(1)
            new = top + np.log(np.exp(out - top[:, None, :]).sum(1))
            new -= new.max(1, keepdims=True)
            change = np.abs(new - message).max()
            message = 0.5 * message + 0.5 * new
            if change < STILL:
                break
        belief = node.copy()
        np.add.at(belief, target, message)
        belief -= belief.max(1, keepdims=True)
    p = np.exp(belief)
    assert len(p) == n
    return p / p.sum(1, keepdims=True)


def spans_of(text: str, w: dict[str, np.ndarray], skips: bool = True) -> tuple[list[Span], list[Span]]:
    """Spans of the patterns, and all spans: those and what the field adds clear of them; without ``skips`` it is a plain chain."""
    base = base_spans(text)
    if not _TOKEN.search(text) and not _AT.search(text):
        return base, base
    tokens = Tokens(text)
    if not tokens.spans:
        return base, base
    if not skips:
        tokens.skips = []
    seen = tokens.labels(base)
    p = marginals(tokens, w, seen)
    best = p.argmax(1)
    sure = (best > 0) & (p.max(1) >= SURE) & (seen == 0)
    digits = [sum("0" <= c <= "9" for c in text[a:b]) for a, b in tokens.spans]
    side = set(tokens.next)
    added: list[Span] = []
    k = 0
    while k < len(best):
        if not sure[k]:
            k += 1
            continue
        upto = k
        while upto in side and sure[upto + 1] and best[upto + 1] == best[k]:
            upto += 1
        start, end, kind = tokens.spans[k][0], tokens.spans[upto][1], int(best[k]) - 1
        # An address needs its sign in some form, a card its check digit, other numbers enough digits.
        enough = ("@" in plainly(text[start:end]), sum(digits[k : upto + 1]) >= 4, card_like(text[start:end]), 7 <= sum(digits[k : upto + 1]) <= 15)
        if enough[kind]:
            added.append((kind, start, end))
        k = upto + 1
    return base, sorted(base + added)


def told(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def train(docs: DataFrame, text: str = "text") -> dict[str, np.ndarray]:
    """A field fitted on at most SAMPLE texts with a digit, ``@`` or ``+``, of at most SAMPLE_CHARS code points in all.

    Texts of any length are chosen by their hash, so the choice does not depend
    on how the table is split. The number of distinct texts sets the share of
    hashes that can be chosen, so what tasks send grows with neither the table
    nor its number of partitions; equal texts count once.
    """
    hashed = docs.select(F.col(f"`{text}`").alias("text")).where(F.col("text").rlike("[0-9@+]")).withColumn("h", F.xxhash64("text"))
    n = hashed.agg(F.approx_count_distinct("h")).first()[0]
    if n > 2 * SAMPLE:
        hashed = hashed.where(F.shiftrightunsigned("h", 11) < int(2 * SAMPLE / n * (1 << 53)))
    sizes = hashed.groupBy("h").agg(F.max(F.length("text")).alias("n")).orderBy("h").limit(SAMPLE).collect()
    room, known = SAMPLE_CHARS, []
    for r in sizes:
        if r["n"] <= room:
            room -= r["n"]
            known.append(r["h"])
    rows = hashed.where(F.col("h").isin(known)).groupBy("h").agg(F.max("text").alias("text")).collect() if known else []
    return fit([r["text"] for r in sorted(rows, key=lambda r: r["h"])])


def find_spans(docs: DataFrame, keep: list[str], weights: dict[str, np.ndarray], text: str = "text") -> DataFrame:
    """``keep``, ``base`` and ``spans`` (arrays of kind, start, end in code points) for each row."""
    model = docs.sparkSession.sparkContext.broadcast(weights)
    shape = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(texts: list[str | None]) -> list[pa.Array]:
        found = [spans_of(t or "", model.value) for t in texts]
        return [pa.array([[{"kind": KINDS[k], "start": a, "end": z} for k, a, z in sorted(x[i])] for x in found], shape) for i in (0, 1)]

    kind = "array<struct<kind:string,start:long,end:long>>"
    return beside(docs, keep, F.col(f"`{text}`"), f"base {kind}, spans {kind}", run)


def redacted(text: str, spans: list[Span]) -> str:
    """``text`` with each span replaced by its kind in brackets; of overlapping spans the first and longest counts."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2], s[0])):
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
            at = end
        elif end > at:
            at = end
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, weights: dict[str, np.ndarray], text: str = "text") -> DataFrame:
    """``docs`` with personal data in ``text`` replaced; other columns as they are, null stays null."""
    model = docs.sparkSession.sparkContext.broadcast(weights)
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = [None if t is None else redacted(t, spans_of(t, model.value)[1]) for t in b.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:place], pa.array(new, b.schema.field(place).type), *b.columns[place + 1 :]], names)

    names = docs.columns
    return docs.toDF(*(f"column{k}" for k in range(len(names)))).mapInArrow(run, docs.schema)


def digests(found: DataFrame, keep: list[str]) -> DataFrame:
    """Counts and digests of the result of :func:`find_spans`."""
    told_ = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    # Arrays come sorted by kind as listed, then by start.
    return found.select(*(F.col(f"`{c}`") for c in keep), *(count(k) for k in KINDS), F.sha2(told_(F.col("base")), 256).alias("base_sha256"), told_(F.col("spans")).alias("spans"))
