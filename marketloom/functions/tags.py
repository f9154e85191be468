"""Tags that say what an offer is, from the words of its folded text.

A rule's words may end in ``*``: any ending. A tag is given if one of ``words``
stands in the text, one of each further list in ``also`` too, and none of
``unless``. A query is mapped to a tag before any text search; the offers of a
tag are then found by the tag alone, within the tag's filter group.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words of the catalogue's language by what they mean, and the words beside which they mean something else.
BEER = "pivo pivni lezak radler pils* porter stout"
MILK = "mleko mlecny mlecne plnotuc* polotuc* odtuc* bezlaktoz* kondenzovan*"
BREAD = "peciv* chleb* rohlik* housk* baget* veka dalam* kaiser* toast* koblih* croissant* kolac* buchta zavin* snek"
CHEESE = "syr* eidam* gouda emental* hermelin* niva mozzarell* cheddar* parenic* korbac* balkansk* cottage"
MEAT = "maso masov* vepr* hovez* kure* kurec* kruti kruta kruty kachn* jehnec* kralic* krkovic* kyta plec kotlet* panenk* svickov* rosten* steak* zebro zeber bucek koleno gulasov* jatr*"
BREAST_OF_CLOTHES = "paska podprsenk* nalepk* ochran* bradavk* kosmetik* odev* trick* top plavk*"
PETS = "granule pamlsk* krmivo"
FRUIT = "jablk* hrusk* banan* pomeranc* mandarink* citron* hrozn* jahod* malin* boruv* tresn* visn* merunk* broskv* svestk* mango ananas* kiwi meloun*"
NOT_FRESH = "napoj* dzus* juice nektar stava smoothie sirup* liker* vino pivo jogurt* dezert* tycink* bonbon* cokolad* zmrzlin* dzem* marmelad* kompot* pyre caj susen* mrazen* ovocn* prichut* pasta vitamin* mydlo sampon*"
DRINKS = "napoj* dzus* nektar stava smoothie"
VEGETABLES = "brambor* cibul* cesnek* rajcat* paprik* okurk* mrkev petrzel celer* kvetak* brokolic* cuket* redkv* salat* spenat* hras* kukuric* fazol*"
NOT_VEGETABLES = "napoj* dzus* stava smoothie pomazank* protlak* pyre omack* chips* syrov* syr* tunak* lahudk* hotov*"


@dataclass(frozen=True)
class Tag:
    name: str
    group: str
    words: str
    unless: str = ""
    also: tuple[str, ...] = ()

    @staticmethod
    def pattern(words: str) -> str:
        """A regular expression for one of ``words``, alike in Spark and DuckDB."""
        return r"\b(" + "|".join(w.replace("*", "[a-z0-9]*") for w in words.split()) + r")\b"


#: From the general to the specific: of several tags of a query the last counts. A parameter of all functions here.
TAGS = (
    Tag("beer", "drinks", BEER),
    Tag("milk", "food", MILK),
    Tag("bread", "food", BREAD, "zavinace"),
    Tag("rolls", "food", "rohlik*"),
    Tag("loaf", "food", "chleb*"),
    Tag("baguette", "food", "baget*"),
    Tag("eggs", "food", "vejce vajec*"),
    Tag("butter", "food", "maslo maslicko ghee ghi"),
    Tag("cheese", "food", CHEESE),
    Tag("eidam", "food", "eidam*"),
    Tag("gouda", "food", "gouda"),
    Tag("meat", "food", MEAT + " prsa", f"{BREAST_OF_CLOTHES} {PETS}"),
    Tag("chicken", "food", "kure* kurec* steh* kridl* palick* prsa", f"{BREAST_OF_CLOTHES} {PETS}"),
    Tag("pork", "food", "vepr* krkovic* kyta plec kotlet* panenk* bucek koleno", PETS),
    Tag("pork_neck", "food", "krkovic*", PETS),
    Tag("beef", "food", "hovez* svickov* rosten* steak* gulasov*", PETS),
    Tag("fruit_fresh", "food", FRUIT, NOT_FRESH),
    Tag("fruit_frozen", "food", FRUIT, "", ("mrazen*",)),
    Tag("fruit_dried", "food", FRUIT, "", ("susen*",)),
    Tag("fruit_drink", "drinks", "ovocn* jablk* pomeranc* mango ananas*", "", (DRINKS,)),
    Tag("veg_fresh", "food", VEGETABLES, NOT_VEGETABLES),
    Tag("potatoes", "food", "brambor*"),
    Tag("tomatoes", "food", "rajcat*"),
)


def offer_tags(folded: Column, tags: tuple[Tag, ...] = TAGS) -> Column:
    """Sorted names of the tags of a folded text; none for null."""
    found = []
    for tag in tags:
        test = folded.rlike(Tag.pattern(tag.words))
        for more in tag.also:
            test = test & folded.rlike(Tag.pattern(more))
        if tag.unless:
            test = test & ~folded.rlike(Tag.pattern(tag.unless))
        found.append(F.when(test, F.lit(tag.name)))
    return F.array_sort(F.array_compact(F.array(*found)))


def query_tag(tags_of_query: Column, tags: tuple[Tag, ...] = TAGS) -> Column:
    """The most specific of the tags of a query; null if it has none, and the search is by text."""
    order = F.array(*(F.lit(t.name) for t in reversed(tags)))
    return F.try_element_at(F.filter(order, lambda name: F.array_contains(tags_of_query, name)), F.lit(1))


def tag_group(tag: Column, tags: tuple[Tag, ...] = TAGS) -> Column:
    """The filter group that a search by a tag stays in."""
    return F.try_element_at(F.create_map(*(F.lit(x) for t in tags for x in (t.name, t.group))), tag)


def tags_sql(folded: str, tags: tuple[Tag, ...] = TAGS) -> str:
    """DuckDB SQL of :func:`offer_tags`, for checks."""
    cases = []
    for tag in tags:
        tests = [f"regexp_matches({folded}, '{Tag.pattern(w)}')" for w in (tag.words, *tag.also)]
        if tag.unless:
            tests.append(f"NOT regexp_matches({folded}, '{Tag.pattern(tag.unless)}')")
        cases.append(f"CASE WHEN {' AND '.join(tests)} THEN '{tag.name}' END")
    return f"list_sort(list_filter([{', '.join(cases)}], lambda t: t IS NOT NULL))"
