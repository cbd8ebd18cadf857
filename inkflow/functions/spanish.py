"""The published Spanish stemmer: regions of a word, and steps that take endings off where they lie in a region."""

from __future__ import annotations

VOWELS = "aeiouáéíóúü"

# The endings of the published algorithm, by step.
PRONOUNS = ("me", "se", "sela", "selo", "selas", "selos", "la", "le", "lo", "las", "les", "los", "nos")
GERUNDS_ACCENTED = {"iéndo": "iendo", "ándo": "ando", "ár": "ar", "ér": "er", "ír": "ir"}
GERUNDS = ("iendo", "ando", "ar", "er", "ir")
PLAIN = (
    "anza", "anzas", "ico", "ica", "icos", "icas", "ismo", "ismos", "able", "ables", "ible", "ibles", "ista", "istas", "oso", "osa", "osos", "osas", "amiento", "amientos", "imiento", "imientos",
)
AFTER_IC = ("adora", "ador", "ación", "adoras", "adores", "aciones", "ante", "antes", "ancia", "ancias")
REPLACED = {"logía": "log", "logías": "log", "ución": "u", "uciones": "u", "encia": "ente", "encias": "ente"}
NOUNS_OF_QUALITY, ADJECTIVES = ("idad", "idades"), ("iva", "ivo", "ivas", "ivos")
Y_VERBS = ("ya", "ye", "yan", "yen", "yeron", "yendo", "yo", "yó", "yas", "yes", "yais", "yamos")
GU_VERBS = ("en", "es", "éis", "emos")
VERBS = (
    "arían", "arías", "arán", "arás", "aríais", "aría", "aréis", "aríamos", "aremos", "ará", "aré", "erían", "erías", "erán", "erás", "eríais", "ería", "eréis", "eríamos", "eremos", "erá", "eré",
    "irían", "irías", "irán", "irás", "iríais", "iría", "iréis", "iríamos", "iremos", "irá", "iré", "aba", "ada", "ida", "ía", "ara", "iera", "ad", "ed", "id", "ase", "iese", "aste", "iste", "an",
    "aban", "ían", "aran", "ieran", "asen", "iesen", "aron", "ieron", "ado", "ido", "ando", "iendo", "ió", "ar", "er", "ir", "as", "abas", "adas", "idas", "ías", "aras", "ieras", "ases", "ieses",
    "ís", "áis", "abais", "íais", "arais", "ierais", "aseis", "ieseis", "asteis", "isteis", "ados", "idos", "amos", "ábamos", "íamos", "imos", "áramos", "iéramos", "iésemos", "ásemos",
)
RESIDUAL, RESIDUAL_E = ("os", "a", "o", "á", "í", "ó"), ("e", "é")
UNACCENTED = str.maketrans("áéíóú", "aeiou")

_STANDARD = sorted([*PLAIN, *AFTER_IC, *REPLACED, *NOUNS_OF_QUALITY, *ADJECTIVES, "amente", "mente"], key=len, reverse=True)
_PRONOUNS = sorted(PRONOUNS, key=len, reverse=True)
_BEFORE = sorted([*GERUNDS_ACCENTED, *GERUNDS, "yendo"], key=len, reverse=True)
_Y_VERBS, _ALL_VERBS = sorted(Y_VERBS, key=len, reverse=True), sorted([*VERBS, *GU_VERBS], key=len, reverse=True)


def _after(word: str, start: int, vowel: bool) -> int:
    """The place after the first letter from `start` that is (or is no) vowel; the word's length if there is none."""
    return next((k + 1 for k in range(start, len(word)) if (word[k] in VOWELS) == vowel), len(word))


def regions(word: str) -> tuple[int, int, int]:
    """Where RV, R1 and R2 begin."""
    r1 = _after(word, _after(word, 0, True), False)
    r2 = _after(word, _after(word, r1, True), False)
    if len(word) < 3:
        return len(word), r1, r2
    if word[1] not in VOWELS:
        rv = _after(word, 2, True)
    elif word[0] in VOWELS:
        rv = _after(word, 2, False)
    else:
        rv = 3
    return rv, r1, r2


def _ending(word: str, endings) -> str | None:
    """The longest of endings (given longest first) that the word ends in."""
    return next((e for e in endings if word.endswith(e)), None)


def _without(word: str, ending: str, region: int) -> str | None:
    """The word without an ending that it has in the region, else None."""
    return word.removesuffix(ending) if word.endswith(ending) and len(word) - len(ending) >= region else None


def _pronoun(word: str, rv: int) -> str:
    own = _ending(word, _PRONOUNS)
    if own is None:
        return word
    rest = word.removesuffix(own)
    before = _ending(rest, [x for x in _BEFORE if len(rest) - len(x) >= rv])
    if before in GERUNDS_ACCENTED:
        return rest.removesuffix(before) + GERUNDS_ACCENTED[before]
    return rest if before in GERUNDS or before == "yendo" and rest.endswith("uyendo") else word


def _standard(word: str, r1: int, r2: int) -> str | None:
    own = _ending(word, _STANDARD)
    if own is None or (cut := _without(word, own, r1 if own == "amente" else r2)) is None:
        return None
    if own in REPLACED:
        return cut + REPLACED[own]
    if own in AFTER_IC:
        return _without(cut, "ic", r2) or cut
    if own == "amente":
        if (less := _without(cut, "iv", r2)) is not None:
            return _without(less, "at", r2) or less
        return next((x for e in ("os", "ic", "ad") if (x := _without(cut, e, r2)) is not None), cut)
    further = {"mente": ("ante", "able", "ible"), "idad": ("abil", "ic", "iv"), "idades": ("abil", "ic", "iv")}.get(own, ("at",) if own in ADJECTIVES else ())
    return next((x for e in further if (x := _without(cut, e, r2)) is not None), cut)


def _verb(word: str, rv: int) -> str:
    tail = word[rv:]
    own = _ending(tail, _Y_VERBS)
    if own and word.removesuffix(own).endswith("u"):
        return word.removesuffix(own)
    own = _ending(tail, _ALL_VERBS)
    if own is None:
        return word
    cut = word.removesuffix(own)
    return cut[:-1] if own in GU_VERBS and cut.endswith("gu") else cut


def _residual(word: str, rv: int) -> str:
    own = _ending(word, (*RESIDUAL, *RESIDUAL_E))
    if own is None or (cut := _without(word, own, rv)) is None:
        return word
    return cut[:-1] if own in RESIDUAL_E and cut.endswith("gu") and len(cut) - 1 >= rv else cut


def stem(word: str) -> str:
    """The stem of a lower-case word."""
    rv, r1, r2 = regions(word)
    word = _pronoun(word, rv)
    word = _standard(word, r1, r2) or _verb(word, rv)
    return _residual(word, rv).translate(UNACCENTED)
