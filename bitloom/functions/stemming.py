"""The public Snowball stemmer for Spanish, as column expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from bitloom.functions.columns import let

VOWELS = "aeiouáéíóúü"

# The algorithm's endings.
PRONOUNS = "me se sela selo selas selos la le lo las les los nos".split()
ACCENTED_VERBS = "iéndo ándo ár ér ír".split()
PLAIN_VERBS = "ando iendo ar er ir".split()
PLAIN = "anza anzas ico ica icos icas ismo ismos able ables ible ibles ista istas oso osa osos osas amiento amientos imiento imientos".split()
AFTER_IC = "adora ador ación adoras adores aciones ante antes ancia ancias".split()
Y_VERBS = "ya ye yan yen yeron yendo yo yó yas yes yais yamos".split()
E_VERBS = "en es éis emos".split()
LAST = "os a o á í ó e é".split()
VERBS = (
    "arían arías arán arás aríais aría aréis aríamos aremos ará aré erían erías erán erás eríais ería eréis eríamos eremos erá eré "
    "irían irías irán irás iríais iría iréis iríamos iremos irá iré aba ada ida ía ara iera ad ed id ase iese aste iste an aban ían aran ieran asen "
    "iesen aron ieron ado ido ando iendo ió ar er ir as abas adas idas ías aras ieras ases ieses ís áis abais íais arais ierais aseis ieseis asteis "
    "isteis ados idos amos ábamos íamos imos áramos iéramos iésemos ásemos"
).split()
#: ending -> (what replaces it, what may go before it, in order of trial)
SUFFIXES: dict[str, tuple[str, tuple[str, ...]]] = {
    **dict.fromkeys(PLAIN, ("", ())),
    **dict.fromkeys(AFTER_IC, ("", ("ic",))),
    **dict.fromkeys(("logía", "logías"), ("log", ())),
    **dict.fromkeys(("ución", "uciones"), ("u", ())),
    **dict.fromkeys(("encia", "encias"), ("ente", ())),
    "mente": ("", ("ante", "able", "ible")),
    **dict.fromkeys(("idad", "idades"), ("", ("abil", "ic", "iv"))),
    **dict.fromkeys(("iva", "ivo", "ivas", "ivos"), ("", ("at",))),
}




def _longest(word: Column, endings: Iterable[str], start: Column | None = None) -> Column:
    """The longest of the endings that lies wholly in the word from `start`, else nothing: a search goes from the left, so what it
    finds first before the end is the longest."""
    region = word if start is None else F.substr(word, start + 1)
    return F.regexp_extract(region, f"({'|'.join(endings)})$", 1)


def _without(word: Column, ending: Column) -> Column:
    return F.left(word, F.length(word) - F.length(ending))


def _unaccented(word: Column) -> Column:
    return F.translate(word, "áéíóú", "aeiou")


def _regions(word: Column) -> Column:
    """Where the regions begin: r1 after the first consonant behind a vowel, r2 likewise within r1, rv the verbs' own."""
    n, after = F.length(word), rf"^.*?[{VOWELS}][^{VOWELS}]"
    start = lambda w, pattern: F.length(F.regexp_extract(w, pattern, 0))
    r1 = F.when(start(word, after) > 0, start(word, after)).otherwise(n)
    within = lambda r: start(F.substr(word, r + 1), after)
    r2 = lambda r: F.when(within(r) > 0, r + within(r)).otherwise(n)
    second = F.when(F.regexp_like(word, F.lit(rf"^.[^{VOWELS}]")), start(word, rf"^..[^{VOWELS}]*[{VOWELS}]")).otherwise(start(word, rf"^..[{VOWELS}]*[^{VOWELS}]"))
    rv = F.when(n < 3, n).when(F.regexp_like(word, F.lit(rf"^[^{VOWELS}][{VOWELS}]")), F.lit(3)).when(second > 0, second).otherwise(n)
    return let(r1, lambda r: F.struct(r.alias("r1"), r2(r).alias("r2"), rv.alias("rv")))


def _pronoun(word: Column, rv: Column) -> Column:
    """Without a pronoun that a verb form carries."""

    def rest(base: Column) -> Column:
        accented = _longest(base, ACCENTED_VERBS, rv)
        verb = (_longest(base, PLAIN_VERBS, rv) != "") | (base.endswith("uyendo") & (F.length(base) - 5 >= rv))
        return F.when(accented != "", F.concat(_without(base, accented), _unaccented(accented))).when(verb, base).otherwise(word)

    found = _longest(word, PRONOUNS, rv)
    return F.when(found != "", let(_without(word, found), rest)).otherwise(word)


def _standard(word: Column, r1: Column, r2: Column) -> Column:
    """Without an ending of a noun, an adjective or an adverb."""

    def adverb(stem: Column) -> Column:
        cut = let(_without(stem, F.lit("iv")), lambda s: F.when(stem.endswith("iv") & s.endswith("at") & (F.length(s) - 2 >= r2), _without(s, F.lit("at"))).otherwise(s))
        more = (_longest(stem, ("iv", "os", "ic", "ad")) != "") & (F.length(stem) - 2 >= r2)
        return F.when(F.length(stem) < r1, word).when(more, cut).otherwise(stem)

    def other(ending: Column, stem: Column) -> Column:
        new, before = F.lit(""), F.lit("")
        for replaced in sorted({v for v in SUFFIXES.values() if any(v)}):
            of = ending.isin([k for k, v in SUFFIXES.items() if v == replaced])
            new = F.when(of, F.lit(replaced[0])).otherwise(new)
            before = F.when(of, _longest(stem, replaced[1]) if replaced[1] else F.lit("")).otherwise(before)
        return let(before, lambda b: F.when(F.length(stem) < r2, word).when((b != "") & (F.length(stem) - F.length(b) >= r2), _without(stem, b)).otherwise(F.concat(stem, new)))

    def cut(ending: Column) -> Column:
        return F.when(ending == "", word).otherwise(let(_without(word, ending), lambda stem: F.when(ending == "amente", adverb(stem)).otherwise(other(ending, stem))))

    return let(_longest(word, [*SUFFIXES, "amente"]), cut)


def _verb(word: Column, rv: Column) -> Column:
    """Without an ending of a verb."""

    def cut(x: Column) -> Column:
        y, other = x["y"], x["other"]
        rest = _without(word, other)
        more = other.isin(E_VERBS) & rest.endswith("gu")
        return F.when((y != "") & _without(word, y).endswith("u"), _without(word, y)).when(other == "", word).when(more, _without(rest, F.lit("u"))).otherwise(rest)

    return let(F.struct(_longest(word, Y_VERBS, rv).alias("y"), _longest(word, E_VERBS + VERBS, rv).alias("other")), cut)


def _last(word: Column, rv: Column) -> Column:
    """Without the vowel that is left."""

    def cut(ending: Column) -> Column:
        rest = _without(word, ending)
        more = ending.isin("e", "é") & rest.endswith("gu") & (F.length(rest) > rv)
        return F.when(ending == "", word).when(more, _without(rest, F.lit("u"))).otherwise(rest)

    return let(_longest(word, LAST, rv), cut)


def spanish(word: Column) -> Column:
    """The stem of a word; null of null."""
    lower = F.lower(word)

    def steps(w: Column) -> Column:
        at = lambda f: let(_regions(w), lambda r: f(r["r1"], r["r2"], r["rv"]))

        def run(r1: Column, r2: Column, rv: Column) -> Column:
            standard = lambda bare: let(_standard(bare, r1, r2), lambda s: F.when(s == bare, _verb(s, rv)).otherwise(s))
            return let(let(_pronoun(w, rv), standard), lambda v: _unaccented(_last(v, rv)))

        return at(run)

    return let(lower, steps)
