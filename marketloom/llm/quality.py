"""Quality rules: one threshold table compiled into one projection, JVM-side only.

Words are maximal runs of characters other than space and U+0009..U+000D.

Defined cases: a null or empty text has no words, so it fails the word-count
rule; repeated rows are judged alike, each on its own; extra columns pass
through :func:`quality_filter` untouched; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.llm.storage import fresh

# Frequent function words of the four corpus languages.
STOP_WORDS = {
    "en": "a an and are as at be by for from in is it of on that the this to was with",
    "de": "das dem den der des die ein eine für im in ist mit nicht sich und von zu",
    "fr": "au avec dans de des du elle en est et il la le les par pour qui sur un une",
    "es": "al con de del el en es la las lo los no por que se su un una y",
}
SYMBOLS = r"[#*$%&|<>]"
BLANKS = " \t\n\x0b\x0c\r"
HAS_WORD = r"[^\x20\x09-\x0D]"
WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """A measure (SQL over the columns of :func:`measures`) and its allowed range."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None


#: The threshold table. Ratios are per word, per letter or per line.
RULES = (
    Rule("mean_word_length", "word_chars / n_words", 2.0, 14.0),
    Rule("symbol_ratio", "n_symbols / n_words", None, 0.25),
    Rule("stop_word_ratio", "n_stop_words / n_words", 0.03, None),
    Rule("upper_ratio", "n_upper / word_chars", None, 0.4),
    Rule("exclamation_ratio", "n_exclamations / n_words", None, 0.25),
    Rule("duplicate_line_ratio", "n_dup_lines / greatest(n_lines, 1)", None, 0.5),
)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.transform(F.array(value), use)[0]


def _words(text: Column) -> Column:
    for blank in BLANKS[1:]:
        text = F.replace(text, F.lit(blank), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def _window_hashes(words: Column) -> Column:
    """A hash of each run of ``WINDOW`` words, of runs half as long side by side; null if there are fewer words."""

    def doubled(h: Column, width: int) -> Column:
        return _let(h, lambda x: F.zip_with(x, F.slice(x, width + 1, F.size(x)), lambda a, b: F.xxhash64(a, b)))

    h = F.transform(words, lambda w: F.xxhash64(w))
    width = 1
    while width < WINDOW:
        h, width = doubled(h, width), 2 * width
    return F.when(F.size(words) >= WINDOW, F.slice(h, 1, F.size(words) - (WINDOW - 1)))


def _window_texts(words: Column) -> Column:
    starts = F.sequence(F.lit(1), F.size(words) - (WINDOW - 1))
    return F.transform(starts, lambda i: F.array_join(F.slice(words, i, WINDOW), " "))


def _covered(windows: Column) -> Column:
    """Positions that lie in a window found twice or more, first included.

    Equal window texts are sorted side by side; the positions of those are then
    merged as intervals.
    """
    ranked = F.array_sort(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))

    def twice(r: Column) -> Column:
        """Positions of the entries of ``r`` that equal a neighbour."""
        last = F.size(r) - 1
        kept = F.filter(
            r,
            lambda e, k: ((k > 0) & (e["w"] == F.get(r, F.greatest(k - 1, F.lit(0)))["w"]))
            | ((k < last) & (e["w"] == F.get(r, F.least(k + 1, last))["w"])),
        )
        return F.array_sort(F.transform(kept, lambda e: e["i"]))

    zero = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).alias("end"))
    step = lambda a, p: F.struct(
        (a["sum"] + (p + WINDOW - F.greatest(p, a["end"])).cast("long")).alias("sum"),
        (p + WINDOW).alias("end"),
    )
    return F.aggregate(F.transform(F.array(ranked), twice)[0], zero, step, lambda a: a["sum"])


def measures(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` and the counts that rules refer to, one row per row of ``docs``.

    Two projections follow each other, because each builds on arrays that the
    one before has made; nothing is shuffled.
    """
    names = {c: f"_{k}_kept" for k, c in enumerate(keep)}
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    base = docs.select(*(F.col(f"`{c}`").alias(a) for c, a in names.items()), body.alias("_text"))
    split = base.select("*", _words(F.col("_text")).alias("_words"), F.filter(F.split("_text", "\n"), lambda line: line.rlike(HAS_WORD)).alias("_lines"))
    stops = sorted({f for words in STOP_WORDS.values() for w in words.split() for f in (w, w.capitalize(), w.upper())})
    counted = split.select(
        *names.values(),
        "_words",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count(F.col("_text"), F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.length("_text") - F.length(F.replace(F.col("_text"), F.lit("!"), F.lit("")))).cast("long").alias("n_exclamations"),
        F.regexp_count(F.col("_text"), F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("_words", lambda w: w.isin(stops))).cast("long").alias("n_stop_words"),
        _window_hashes(F.col("_words")).alias("_hashes"),
    )
    # Windows whose hashes all differ do differ; the others are compared as they are.
    unique = F.col("_hashes").isNull() | (F.size(F.array_distinct("_hashes")) == F.size("_hashes"))
    repeated = _covered(_window_texts(F.col("_words")))
    found = F.struct(*(c for c in counted.columns if not c.startswith("_")), F.when(unique, F.lit(0).cast("long")).otherwise(repeated).alias("n_repeat_words"))
    # A generator of one row: filters on its columns stay above it, so no measure is computed twice.
    return counted.select(*(F.col(a).alias(c) for c, a in names.items()), F.inline(F.array(found)))


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """The threshold table as one boolean expression; a row without words fails."""
    passed = F.lit(True)
    for rule in rules:
        value = F.expr(f"try_divide({rule.measure.replace(' / ', ', ')})")
        if rule.low is not None:
            passed &= value >= rule.low
        if rule.high is not None:
            passed &= value <= rule.high
    return F.coalesce(passed, F.lit(False))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def judge(docs: DataFrame, keep: list[str], text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``keep``, all measures, ``base_failed`` and ``kept``."""
    m = measures(docs, keep, text)
    return m.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def quality_filter(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that the rules keep, columns unchanged."""
    (whole,) = fresh(docs, "row")
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias(whole), F.col(f"`{text}`").alias("text"))
    kept = judge(packed, [whole], "text", rules).where("kept")
    return kept.select(*(F.col(whole)[c].alias(c) for c in docs.columns))
