"""The public Snowball stemmer for Spanish as a plain function; tests hold the column expression against it."""

from bitloom.functions.stemming import (
    ACCENTED_VERBS,
    E_VERBS,
    PLAIN_VERBS,
    PRONOUNS,
    SUFFIXES,
    VERBS,
    VOWELS,
    Y_VERBS,
)

ACCENTS = str.maketrans("áéíóú", "aeiou")


def _after(word: str, start: int) -> int:
    """Where the part after the first consonant that follows a vowel begins."""
    for i in range(start + 1, len(word)):
        if word[i] not in VOWELS and word[i - 1] in VOWELS:
            return i + 1
    return len(word)


def _verb_region(word: str) -> int:
    if len(word) < 3:
        return len(word)
    first, second = (c in VOWELS for c in word[:2])
    if first != second and not first:
        return 3
    want_vowel = not second
    return next((i + 1 for i in range(2, len(word)) if (word[i] in VOWELS) == want_vowel), len(word))


def _longest(word: str, endings, start: int = 0) -> str | None:
    """The longest of the endings that lies wholly in the word from `start`."""
    return max((e for e in endings if word.endswith(e) and len(word) - len(e) >= start), key=len, default=None)


def spanish(word: str) -> str:
    word = word.lower()
    r1 = _after(word, 0)
    r2, rv = _after(word, r1), _verb_region(word)

    # A pronoun that a verb form carries.
    pronoun = _longest(word, PRONOUNS, rv)
    if pronoun:
        base = word[: -len(pronoun)]
        if accented := _longest(base, ACCENTED_VERBS, rv):
            word = base[: -len(accented)] + accented.translate(ACCENTS)
        elif _longest(base, PLAIN_VERBS, rv) or (base.endswith("uyendo") and len(base) - 5 >= rv):
            word = base

    before = word
    word = _standard(word, r1, r2)
    if word == before:
        ending = _longest(word, Y_VERBS, rv)
        if ending and word[: -len(ending)].endswith("u"):
            word = word[: -len(ending)]
        elif ending := _longest(word, E_VERBS + VERBS, rv):
            word = word[: -len(ending)]
            if ending in E_VERBS and word.endswith("gu"):
                word = word[:-1]

    ending = _longest(word, ("os", "a", "o", "á", "í", "ó", "e", "é"), rv)
    if ending:
        word = word[: -len(ending)]
        if ending in "eé" and word.endswith("gu") and len(word) > rv:
            word = word[:-1]
    return word.translate(ACCENTS)


def _standard(word: str, r1: int, r2: int) -> str:
    ending = _longest(word, [*SUFFIXES, "amente"])
    if ending is None:
        return word
    stem = word[: -len(ending)]
    if ending == "amente":
        if len(stem) < r1:
            return word
        for more in ("iv", "os", "ic", "ad"):
            if stem.endswith(more) and len(stem) - 2 >= r2:
                stem = stem[:-2]
                return stem[:-2] if more == "iv" and stem.endswith("at") and len(stem) - 2 >= r2 else stem
        return stem
    if len(stem) < r2:
        return word
    new, leading = SUFFIXES[ending]
    for more in leading:
        if stem.endswith(more) and len(stem) - len(more) >= r2:
            return stem[: -len(more)]
    return stem + new
