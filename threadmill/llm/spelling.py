"""Typed names as comparable tokens, and the pigeonhole segment join.

A name as typed is stripped of what is not a name (addresses, numbers, emoji,
remarks in brackets), written in plain Latin letters and cut into tokens; each
token is then spelled so that letters that stand for one sound agree.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Latin letters of Cyrillic ones, spelled by letter.
CYRILLIC = dict(
    zip(
        "абвгдеёжзийклмнопрстуфхцчшщъыьэюяіїєґў",
        "a b v g d e e zh z i y k l m n o p r s t u f h ts ch sh sch  y  e yu ya i yi ye g u".split(" "),
    )
)
#: Letters that do not decompose into a base letter and a mark.
LETTERS = {"ø": "o", "ł": "l", "đ": "d", "ð": "d", "þ": "th", "æ": "ae", "œ": "oe", "ß": "ss", "ı": "i", "ħ": "h", "ŧ": "t", "ŋ": "n", "ĸ": "k"}

#: Words that stand next to a name and are none.
REMARKS = frozenset(
    "mr mrs ms miss mx dr prof professor sir madam mme mlle herr frau senor sra sr the new old work home office private mobile cell number phone tel support team official design store shop ltd limited inc llc gmbh co corp sa ag plc bv js".split()
)

#: Words that say what kind of organisation, event or product a name is.
KINDS = frozenset(
    "academy agency analytics association bakery bank base bistro cafe cloud clinic db flow kit mesh club collective college company conference consulting council energy expo fair farm festival foundation fund gallery garage group hackathon health holdings hospital hotel institute kitchen labs laboratory library logistics marathon market media meetup museum network partners pharmacy press query restaurant robotics school script services society software solutions studio summit systems technologies theatre trust union university ventures workshop works".split()
)

_MAIL = regex.compile(r"\S+\s*(?:@|\(at\)|\[at\])\s*\S+|https?://\S+|www\.\S+")
_NUMBER = regex.compile(r"[+(]?\p{Nd}[\p{Nd}\s().\-/]{4,}\p{Nd}|\p{Nd}+")
_ASIDE = regex.compile(r"\([^)]*\)|\[[^\]]*\]|\|.*$|\s[-–—]\s.*$")
_CAMEL = regex.compile(r"(?<=\p{Ll}{2})(?=\p{Lu}\p{Ll}{2})")
_CYRILLIC = regex.compile(r"\p{Cyrillic}")


def plain(text: str) -> str:
    """Lower-case Latin letters without marks; other scripts stay as they are."""
    lowered = text.lower()
    if _CYRILLIC.search(lowered):
        lowered = lowered.replace("дж", "j").replace("кс", "x")
        lowered = "".join(CYRILLIC.get(c, c) for c in lowered)
    decomposed = unicodedata.normalize("NFKD", lowered)
    return "".join(LETTERS.get(c, c) for c in decomposed if not unicodedata.combining(c))


def sound(token: str) -> str:
    """One spelling for letters that stand for one sound."""
    return token.replace("ph", "f").replace("ks", "x").replace("ck", "k").replace("c", "k").replace("q", "k").replace("w", "v")


def tokens_of(text: str | None) -> list[str]:
    """The tokens of a typed name in the order given names first, as far as a comma tells."""
    if not text:
        return []
    text = unicodedata.normalize("NFKC", text)
    kept = _NUMBER.sub(" ", _ASIDE.sub(" ", _MAIL.sub(" ", text))).replace("'", "").replace("’", "")
    kept = _CAMEL.sub(" ", kept) if not kept.isupper() else kept
    family, comma, given = kept.partition(",")
    if comma and len(given.split()) <= 3 and given.strip():
        kept = f"{given} {family}"
    words = regex.findall(r"[\p{L}\p{M}]+", plain(kept))
    return [sound(w) for w in words if w not in REMARKS]


def edits(a: str, b: str, most: int) -> int:
    """Edit distance with transpositions of neighbours, in a band of ``most``; more than that gives most + 1."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        low, high = max(1, i - most), min(len(b), i + most)
        row = [i if low == 1 else most + 1] * low + [most + 1] * (len(b) - low + 1)
        for j in range(low, high + 1):
            best = min(last[j - 1] + (x != b[j - 1]), row[j - 1] + 1, last[j] + 1)
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == b[j - 1]:
                best = min(best, before[j - 2] + 1)
            row[j] = best
        if min(row[low : high + 1]) > most:
            return most + 1
        before, last = last, row
    return min(last[len(b)], most + 1)


def segments(length: int, parts: int) -> list[tuple[int, int]]:
    """Start and length of the segments of a string: ``parts`` of nearly equal length."""
    size, larger = divmod(length, parts)
    found, at = [], 0
    for i in range(parts):
        step = size + (i >= parts - larger)
        found.append((at, step))
        at += step
    return found


def segment_keys(text: str, k: int, probe: bool) -> list[str]:
    """Keys under which a string is stored, or looked up.

    An edit damages one segment, or two if it swaps the letters at a border, so
    of 2k + 1 segments at least one survives k edits, shifted by at most k.  The
    shorter or equal one of a pair is stored, so a look-up tries the lengths
    from len - k to len.
    """
    n, parts = len(text), 2 * k + 1
    if not probe:
        return [f"{n}|{i}|{text[at : at + size]}" for i, (at, size) in enumerate(segments(n, parts))]
    keys = set()
    for length in range(max(parts, n - k), n + 1):
        for i, (at, size) in enumerate(segments(length, parts)):
            for start in range(max(0, at - k), min(n - size, at + k) + 1):
                keys.add(f"{length}|{i}|{text[start : start + size]}")
    return sorted(keys)


def segment_join(strings: DataFrame, column: str, k: int) -> DataFrame:
    """``a, b``: all pairs of different strings of ``column`` within k edits, a < b.

    Edits are inserted, dropped, changed and swapped letters.  Strings shorter
    than 2k + 1 have no segments and are in no pair.  Nulls are left out,
    repeats count once.
    """
    base = strings.select(F.col(column).alias("s")).where(F.length("s") > 2 * k).distinct()

    @F.pandas_udf("array<string>")
    def stored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: segment_keys(t, k, False))

    @F.pandas_udf("array<string>")
    def asked(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: segment_keys(t, k, True))

    @F.pandas_udf("boolean")
    def near(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for left, right in batches:
            yield pd.Series([edits(a, b, k) <= k for a, b in zip(left, right)], dtype=bool)

    index = base.select(F.col("s").alias("x"), F.explode(stored("s")).alias("key"))
    probes = base.select(F.col("s").alias("y"), F.explode(asked("s")).alias("key"))
    pairs = probes.join(index, "key").where(F.col("x") != F.col("y"))
    pairs = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    # a transposition is two plain edits, so twice the bound keeps all that the exact check may accept
    close = pairs.where(F.levenshtein("a", "b", 2 * k) >= 0)
    return close.where(near("a", "b"))
