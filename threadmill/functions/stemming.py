"""English word stems and stop words for text search.

The stemmer is the published revision of Porter's suffix stripping: suffixes go
in a fixed order of steps, each only where enough of the word is left before it.
"""

from __future__ import annotations

import functools
import re
import unicodedata

#: Words too frequent to search for.
STOP_WORDS = frozenset(
    (
        "a about above after again against all am an and any are as at be because been before being below between both but by can could did do does doing down during each few for from "
        "further had has have having he her here hers herself him himself his how i if in into is it its itself just me more most my myself no nor not now of off on once only or other our "
        "ours ourselves out over own same she should so some such than that the their theirs them themselves then there these they this those through to too under until up very was we were "
        "what when where which while who whom why will with would you your yours yourself yourselves"
    ).split()
)

_VOWELS = "aeiouy"
_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
#: Letters after which "li" is a suffix.
_LI = "cdeghkmnrt"
#: Suffix and replacement, tried from the longest.
_STEP_2 = {
    "ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate",
    "alism": "al", "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble",
}
_STEP_3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ness": "", "ful": ""}
_STEP_4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic")
_EXCEPTIONS = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
_INVARIANT = frozenset("sky news howe atlas cosmos bias andes".split())
_AFTER_1A = frozenset("inning outing canning herring earring proceed exceed succeed".split())

_REGION = re.compile("[aeiouy][^aeiouy]")


def _regions(word: str) -> tuple[int, int]:
    """Where the parts begin that suffixes may be taken from: after the first vowel and consonant, and after the next ones."""
    for head in ("gener", "commun", "arsen"):
        if word.startswith(head):
            first = len(head)
            break
    else:
        found = _REGION.search(word)
        first = found.end() if found else len(word)
    found = _REGION.search(word, first)
    return first, found.end() if found else len(word)


def _short(word: str, first: int) -> bool:
    """A word whose only syllable is short."""
    if first < len(word):
        return False
    if len(word) == 2:
        return word[0] in _VOWELS and word[1] not in _VOWELS
    return len(word) > 2 and word[-3] not in _VOWELS and word[-2] in _VOWELS and word[-1] not in _VOWELS + "wxY"


def _plural(word: str) -> str:
    if word.endswith("sses"):
        return word[:-2]
    if word.endswith(("ied", "ies")):
        return word[:-2] if len(word) > 4 else word[:-1]
    if word.endswith("s") and not word.endswith(("us", "ss")) and any(c in _VOWELS for c in word[:-2]):
        return word[:-1]
    return word


def _past(word: str, first: int) -> str:
    for suffix in ("eedly", "eed"):
        if word.endswith(suffix):
            return word[: -len(suffix)] + "ee" if len(word) - len(suffix) >= first else word
    for suffix in ("ingly", "edly", "ing", "ed"):
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            if not any(c in _VOWELS for c in stem):
                return word
            if stem.endswith(("at", "bl", "iz")):
                return stem + "e"
            if stem.endswith(_DOUBLES):
                return stem[:-1]
            return stem + "e" if _short(stem, min(first, len(stem))) and first >= len(stem) else stem
    return word


@functools.lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """The stem of a word in lower-case letters; words of two letters or less are their own."""
    if len(word) <= 2 or word in _INVARIANT:
        return word
    if word in _EXCEPTIONS:
        return _EXCEPTIONS[word]
    # a y that begins a word or follows a vowel is a consonant
    word = re.sub(r"^y|(?<=[aeiouy])y", "Y", word)
    first, second = _regions(word)
    word = _plural(word)
    if word in _AFTER_1A:
        return word
    word = _past(word, first)
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in _VOWELS:
        word = word[:-1] + "i"
    for suffix, made in _STEP_2.items():
        if word.endswith(suffix):
            word = word[: -len(suffix)] + made if len(word) - len(suffix) >= first else word
            break
    else:
        if word.endswith("ogi") and len(word) - 3 >= first and word[-4:-3] == "l":
            word = word[:-1]
        elif word.endswith("li") and len(word) - 2 >= first and word[-3:-2] in tuple(_LI):
            word = word[:-2]
    for suffix, made in _STEP_3.items():
        if word.endswith(suffix):
            word = word[: -len(suffix)] + made if len(word) - len(suffix) >= first else word
            break
    else:
        if word.endswith("ative") and len(word) - 5 >= second:
            word = word[:-5]
    for suffix in _STEP_4:
        if word.endswith(suffix):
            word = word[: -len(suffix)] if len(word) - len(suffix) >= second else word
            break
    else:
        if word.endswith("ion") and len(word) - 3 >= second and word[-4:-3] in ("s", "t"):
            word = word[:-3]
    if word.endswith("e"):
        if len(word) - 1 >= second or len(word) - 1 >= first and not _short(word[:-1], first):
            word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= second:
        word = word[:-1]
    return word.lower()


_ASCII = re.compile("[a-z]+")
_LETTERS = re.compile(r"[^\W\d_]+")


def terms(text: str | None, every_script: bool = False) -> list[str]:
    """Search terms of a text: lower case, accents off, stop words out, stems.

    ``every_script`` keeps words of letters other than a to z as they are; else
    such letters only part words.
    """
    if not text:
        return []
    plain = text.lower()
    if not plain.isascii():
        plain = "".join(c for c in unicodedata.normalize("NFD", plain) if not unicodedata.combining(c) or every_script and not "̀" <= c <= "ͯ")
    found = (_LETTERS if every_script else _ASCII).findall(plain)
    return [stem(w) if w.isascii() else w for w in found if w not in STOP_WORDS]
