"""Text functions of the offer domain, all built-in column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Accented letters of the catalogue's languages and what they fold to.
ACCENTED = "áäčćďéěëíľĺňńóôöřŕšśťúůüýžź"
PLAIN = "aaccdeeeillnnooorrsstuuuyzz"

# Words that decide the filter group of a folded title; the first rule that matches counts.
GROUP_RULES = (
    ("drugstore", "sampon|mydlo|deodorant|zubni|praci|toaletni"),
    ("pharmacy", "vitamin|ibuprofen|paralen|magnesium"),
    ("electronics", "telefon|notebook|televize|sluchatka"),
    ("pets", "krmivo|granule|stelivo"),
    ("fashion", "mikina|bunda|kosile|tricko|ponozky"),
    ("garden", "zahrada|sekacka|substrat|gril"),
    ("home", "nabytek|postel|hrnec|panev|rucnik"),
    ("drinks", "pivo|vino|limonada|dzus|kava|caj"),
    ("food", "mleko|jogurt|syr|maslo|chleb|rohlik|cokolada|mouka|kureci|losos"),
)
# First words of labels too general to identify a product.
GENERIC = "akce|ruzne|vybrane|nabidka|sleva"
# Units of a pack with the base unit they are counted in, and words for tablets.
UNITS = {
    "kg": ("g", "1000"), "g": ("g", "1"), "mg": ("g", "0.001"), "l": ("ml", "1000"), "cl": ("ml", "10"), "ml": ("ml", "1"),
    "ks": ("ks", "1"), "kus": ("ks", "1"), "kusy": ("ks", "1"), "kusu": ("ks", "1"), "davka": ("davka", "1"), "davky": ("davka", "1"), "davek": ("davka", "1"),
    "role": ("role", "1"), "roli": ("role", "1"), "rol": ("role", "1"), "baleni": ("bal", "1"),
}
TABLETS = "tableta|tablety|tablet|pastilka|pastilky|tobolka|tobolky|kapsle|draze"


def fold(text: Column) -> Column:
    """Lower case, accents dropped, everything but letters and digits turned to single blanks."""
    plain = F.translate(F.lower(text), ACCENTED, PLAIN)
    return F.trim(F.regexp_replace(plain, "[^a-z0-9]+", " "))


def slug(text: Column) -> Column:
    return F.replace(fold(text), F.lit(" "), F.lit("-"))


def filter_group(folded: Column, rules: tuple[tuple[str, str], ...] = GROUP_RULES) -> Column:
    """Group of the first rule one of whose words occurs; ``other`` if none does."""
    found = F.lit("other")
    for group, words in reversed(rules):
        found = F.when(folded.rlike(rf"\b({words})\b"), F.lit(group)).otherwise(found)
    return found


def label_is_specific(text: Column) -> Column:
    """False for what is short, has no letters, or opens with a general word."""
    folded = fold(text)
    return F.coalesce((F.length(folded) >= 3) & folded.rlike("[a-z]") & ~folded.rlike(rf"^({GENERIC})\b"), F.lit(False))


#: The texts of products are worked on by so many tasks: they are few bytes and much work.
TEXT_TASKS = 48


def once_each(rows: DataFrame, names: list[str], made: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``rows`` with the columns that ``made`` adds to the texts ``names``, made once for each different combination of them; rows whose texts it drops go."""
    texts = rows.select(*names).repartition(TEXT_TASKS, *names).distinct()
    once = made(texts).withColumnsRenamed({c: f"_{c}" for c in names})
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in names]
    return rows.join(once, same).drop(*(f"_{c}" for c in names))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with ``value`` computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _trimmed(number: Column) -> Column:
    """A decimal of some places as text, without zeros at its end."""
    return F.regexp_replace(number.cast("string"), r"\.?0+$", "")


def pack_size_key(text: Column) -> Column:
    """Pack size in base units, by the first rule that fits; null if none does.

    A count of tablets at the end of a medicine's title comes before its dose;
    then the last ``2 x 900 ml``; then the last single quantity.
    """
    unit = rf"({'|'.join(sorted(UNITS, key=lambda u: (-len(u), u)))})(?:[^\p{{L}}]|$)"
    base = F.create_map(*(F.lit(x) for name, (to, _) in UNITS.items() for x in (name, to)))
    scale = F.create_map(*(F.lit(x).cast(t) for name, (_, by) in UNITS.items() for x, t in ((name, "string"), (by, "decimal(10,6)"))))

    def last(plain: Column, pattern: str) -> Column:
        return F.try_element_at(F.regexp_extract_all(plain, F.lit(pattern + unit), F.lit(0)), F.lit(-1))

    def sized(found: Column) -> Column:
        times = F.coalesce(F.nullif(F.regexp_extract(found, r"^([0-9]+)\s*[x×]", 1), F.lit("")), F.lit("1")).try_cast("decimal(18,0)")
        amount = F.replace(F.regexp_extract(found, r"([0-9]+(?:[.,][0-9]+)?)\s*\p{L}+[^\p{L}]?$", 1), F.lit(","), F.lit(".")).try_cast("decimal(18,6)")
        name = F.regexp_extract(found, r"(\p{L}+)[^\p{L}]?$", 1)
        return F.concat(_trimmed((amount * times * F.try_element_at(scale, name)).cast("decimal(30,6)")), F.try_element_at(base, name))

    def key(plain: Column) -> Column:
        tablets = F.nullif(F.regexp_extract(plain, rf"(?:{TABLETS})[^0-9]{{0,40}}([0-9]{{1,4}})\s*$", 1), F.lit(""))
        many, single = last(plain, r"[0-9]+\s*[x×]\s*[0-9]+(?:[.,][0-9]+)?\s*"), last(plain, r"[0-9]+(?:[.,][0-9]+)?\s*")
        return F.coalesce(F.concat(tablets, F.lit("ks")), _once(F.coalesce(many, single), sized))

    return _once(F.translate(F.lower(text), ACCENTED, PLAIN), key)


def ordered_trigrams(folded: Column) -> Column:
    """The three-letter pieces of each word, padded by two blanks before and one after, in their order."""
    words = F.filter(F.split(folded, " "), lambda w: w != "")
    pieces = F.transform(
        words,
        lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))),
    )
    return F.flatten(pieces)


def trigrams(folded: Column) -> Column:
    """The set of three-letter pieces of each word."""
    return F.array_distinct(ordered_trigrams(folded))


def word_similarity_permille(wanted: Column, ordered: Column) -> Column:
    """The greatest similarity of the set ``wanted`` to the pieces of any run of ``ordered``, in whole thousandths.

    A run counts each piece once. The best run begins and ends with a wanted
    piece; from each such beginning one walk to the end keeps two counts: pieces
    not yet seen since the beginning, and wanted ones among them.
    """

    def walked(rows: Column) -> Column:
        start = F.struct(F.lit(0).alias("pieces"), F.lit(0).alias("shared"), F.lit(0).cast("bigint").alias("best"))

        def from_(first: Column) -> Column:
            def step(acc: Column, row: Column) -> Column:
                new = (row["before"] < first["at"]).cast("int")
                pieces, shared = acc["pieces"] + new, acc["shared"] + F.when(row["wanted"], new).otherwise(0)
                alike = F.floor(shared * 1000 / (F.size(wanted) + pieces - shared)).cast("bigint")
                best = F.when(row["wanted"], F.greatest(acc["best"], alike)).otherwise(acc["best"])
                return F.struct(pieces.alias("pieces"), shared.alias("shared"), best.alias("best"))

            return F.aggregate(F.slice(rows, first["at"] + 1, F.size(rows)), start, step, lambda acc: acc["best"])

        return F.array_max(F.transform(F.filter(rows, lambda r: r["wanted"]), from_))

    def placed(pieces: Column) -> Column:
        def row(piece: Column, at: Column) -> Column:
            back = F.array_position(F.reverse(F.slice(pieces, 1, at)), piece).cast("int")
            return F.struct(F.array_contains(wanted, piece).alias("wanted"), at.alias("at"), F.when(back == 0, -1).otherwise(at - back).alias("before"))

        return F.transform(pieces, row)

    # Arrays of one element hold what the inner functions use again and again.
    rows = F.transform(F.array(ordered), placed)
    return F.coalesce(F.get(F.transform(rows, walked), F.lit(0)), F.lit(0).cast("bigint"))


def similarity_permille(a: Column, b: Column) -> Column:
    """Shared trigrams over all trigrams of two sets, in whole thousandths."""
    shared = F.size(F.array_intersect(a, b))
    return F.coalesce(F.floor(F.try_divide(shared * 1000, F.size(a) + F.size(b) - shared)), F.lit(0)).cast("bigint")


def metres(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column) -> Column:
    """Great-circle distance, to the metre."""
    d_lat, d_lon = F.radians(lat_b - lat_a) / 2, F.radians(lon_b - lon_a) / 2
    h = F.sin(d_lat) * F.sin(d_lat) + F.cos(F.radians(lat_a)) * F.cos(F.radians(lat_b)) * F.sin(d_lon) * F.sin(d_lon)
    return F.round(2 * 6371000 * F.asin(F.sqrt(F.least(h, F.lit(1.0))))).cast("bigint")
