r"""Personal information inside free text, by weak supervision.

Wide patterns propose spans.  Labelers (formats, gazetteers, words around the
span, its shape) vote for or against each proposal or abstain.  Expectation
maximisation over the counts of all vote patterns estimates how far each
labeler can be trusted and how likely each pattern is; a logistic classifier
over votes and shape, trained on these likelihoods, takes the decision.  Vote
patterns and shapes are drawn from finite sets, so what the driver sees is
bounded however many messages there are, and it counts all of them.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadmill.llm.names import Lexicon, learn_lexicon, typed_names
from threadmill.llm.spelling import plain, sound
from threadmill.session import cut_lineage

KIND_ORDER = ("email", "address", "id_number", "phone", "name")
PLACEHOLDER = {kind: f"[{kind.upper()}]" for kind in KIND_ORDER}

#: A word is ordinary if at least one in so many words of all texts is it, so
#: there are at most so many ordinary words.
VOCABULARY = 20_000

# ---------------------------------------------------------------- proposals

_AT = r"(?:@|＠|\s?[\[(<{]\s?(?:at|AT|arroba)\s?[\])>}]\s?|\s(?:at|AT|arroba)\s)"
_DOT = r"(?:\.|\s?[\[(<{]\s?(?:dot|DOT|punto|punkt)\s?[\])>}]\s?|\s(?:dot|DOT|punto|punkt)\s)"
EMAIL = regex.compile(rf"[\p{{L}}\p{{Nd}}][\p{{L}}\p{{Nd}}._%+'-]*{_AT}[\p{{L}}\p{{Nd}}-]+(?:{_DOT}[\p{{L}}\p{{Nd}}-]+)+")
_EMAIL_HINT = regex.compile(r"@|＠|[\[(<{]\s?(?:at|AT|arroba)\s?[\])>}]|\b(?:at|AT|arroba)\b.{1,60}\b(?:dot|DOT|punto|punkt)\b")

URL = regex.compile(r"(?:https?://|www\.)\S+")

#: Street words by their place before or after the name.
_STREET_AFTER = "Street|St|Road|Rd|Avenue|Ave|Av|Lane|Ln|Court|Ct|Drive|Dr|Park|Square|Sq|Way|Close|Terrace|Place|Pl|Boulevard|Blvd|Crescent|Gardens|Hill|Grove|Mews|Row|Parade|Quay|Walk|Yard|Alley"
_STREET_BEFORE = r"Calle|C/|C\.|Avda\.?|Avenida|Av\.|Plaza|Pza\.?|Paseo|Pº|Camino|Carrer|Rua|R\.|Travessa|Praça|Largo|Estrada|Via|Viale|Piazza|Corso|Vicolo|Largo|[Uu]l\.|[Uu]litsa|ул\.|улица|пр\.|проспект|пер\."
_STREET_FRENCH = r"rue|avenue|av\.|boulevard|bd|place|chemin|quai|all[ée]e|impasse|cours|passage|route|square"
_STREET_GERMAN = r"[Ss]tra(?:ß|ss)e|[Ss]tr\.|[Ww]eg|[Pp]latz|[Gg]asse|[Aa]llee|[Rr]ing|[Dd]amm|[Uu]fer|[Ss]teig|[Hh]of"
_WORD = r"[\p{Lu}][\p{L}\p{M}'’-]*"
_SMALL = r"(?:de|del|de la|de las|de los|du|des|da|do|dos|das|la|le|les|of|the|di|della|dei|d['’]|l['’])"
_FLAT = r"(?:,?[ \u00a0](?:Flat|Apt\.?|Apartment|Unit|Suite|Ste\.?|Room|Floor|Piso|App\.?|Wohnung|Whg\.?|Etage|кв\.)[ \u00a0]?\p{Nd}+[A-Za-z]?|,?[ \u00a0]?\#[ \u00a0]?\p{Nd}+[A-Za-z]?)"
ADDRESS = [
    (
        "english",
        regex.compile(
            rf"(?:(?:Unit|Flat|Apt\.?|Suite)[ \u00a0]\p{{Nd}}+[A-Za-z]?,?[ \u00a0])?(?<![\p{{L}}\p{{Nd}}.:/-])\p{{Nd}}{{1,5}}[A-Za-z]?[ \u00a0](?:St\.[ \u00a0])?(?:{_WORD}[ \u00a0]){{1,3}}(?:{_STREET_AFTER})\b(?:\.(?=[ \u00a0]*[,\#)]|[ \u00a0]*$|[ \u00a0])|)(?:{_FLAT})?"
        ),
    ),
    ("french", regex.compile(rf"(?<![\p{{L}}\p{{Nd}}.:/-])\p{{Nd}}{{1,5}}(?:[ \u00a0]?(?:bis|ter|quater)|[A-Za-z])?,?[ \u00a0](?:{_STREET_FRENCH})[ \u00a0](?:{_SMALL}[ \u00a0]?)*{_WORD}(?:[ -]{_WORD})*(?:{_FLAT})?")),
    (
        "romance",
        regex.compile(
            rf"(?<![\p{{L}}\p{{Nd}}])(?:{_STREET_BEFORE})[ \u00a0]?(?:{_SMALL}[ \u00a0])*{_WORD}(?:[ \u00a0](?:{_SMALL}[ \u00a0])*{_WORD})*,?[ \u00a0](?:(?:n\.?º|nº|n°|No\.|núm\.?|д\.)[ \u00a0]?)?\p{{Nd}}{{1,5}}[A-Za-z]?(?:,[ \u00a0]\p{{Nd}}{{1,2}}[ \u00a0]?[ºª°](?:[ \u00a0][\p{{L}}]\b)?|{_FLAT})*"
        ),
    ),
    ("german", regex.compile(rf"(?<![\p{{L}}\p{{Nd}}])(?:\p{{Lu}}[\p{{L}}\p{{M}}'’-]*(?:{_STREET_GERMAN})|{_WORD}[ -](?:Stra(?:ß|ss)e|Str\.|Weg|Platz|Gasse|Allee|Ring))[ \u00a0]\p{{Nd}}{{1,4}}[ \u00a0]?[a-z]?\b(?:{_FLAT})?")),
]
_ADDRESS_HINT = regex.compile(r"\p{Nd}")

NUMBER = regex.compile(
    r"(?<![\p{L}\p{Nd}.,:/@#€$£+-])"
    r"(?:\p{Lu}{2}\s?\p{Nd}{2}\s?\p{Nd}{2}\s?\p{Nd}{2}\s?\p{Lu}(?!\p{L})"
    r"|\p{Lu}{1,3}-?\p{Nd}{6,12}\p{Lu}?(?!\p{L})"
    r"|\p{Nd}{7,10}-?\p{Lu}(?!\p{L})"
    r"|(?:\+|\(|\+ )?\p{Nd}(?:[\p{Nd}]|[   ]?[()./‐-―-][  ]?(?=[\p{Nd}(])|[   ](?=[\p{Nd}(])|\)(?=[\p{Nd}]))*\p{Nd}(?:[ ,]{0,2}(?:ext\.?|extension|x|доб\.)\s?\p{Nd}{1,6})?)"
    r"(?![\p{L}\p{Nd}])"
)
_DIGITS = regex.compile(r"\p{Nd}")

PHONE_FORMATS = [
    regex.compile(r"(?:\+|00)\s?\p{Nd}{1,3}[\s().-]*(?:\p{Nd}[\s()./-]*){6,13}\p{Nd}"),
    regex.compile(r"\(\p{Nd}{2,5}\)[\s./-]?\p{Nd}{3,4}[\s./-]?\p{Nd}{3,4}"),
    regex.compile(r"0\p{Nd}{2,4}[\s/-]?\p{Nd}{2,5}(?:[\s-]?\p{Nd}{2,5}){1,3}"),
    regex.compile(r"0\p{Nd}(?:[\s.]\p{Nd}{2}){4}"),
    regex.compile(r"\p{Nd}{3}[-.\s]\p{Nd}{3}[-.\s]\p{Nd}{4}"),
    regex.compile(r"[2-9]\p{Nd}{2}[2-9]\p{Nd}{6}"),
]
ID_FORMATS = [
    regex.compile(r"\p{Nd}{3}-\p{Nd}{2}-\p{Nd}{4}"),
    regex.compile(r"\p{Nd}{3}[-.]\p{Nd}{3}[-.]\p{Nd}{3}-\p{Nd}{1,2}"),
    regex.compile(r"\p{Lu}{2}\s?\p{Nd}{2}\s?\p{Nd}{2}\s?\p{Nd}{2}\s?\p{Lu}"),
    regex.compile(r"\p{Lu}{1,3}-?\p{Nd}{6,12}\p{Lu}?"),
    regex.compile(r"\p{Nd}{7,8}-?\p{Lu}"),
]
_NO_NUMBER = [
    regex.compile(r"\p{Nd}{1,3}(?:\.\p{Nd}{1,3}){3}"),  # network addresses
    regex.compile(r"\p{Nd}{4}[-./]\p{Nd}{1,2}[-./]\p{Nd}{1,2}(?:\s\p{Nd}{1,2})?|\p{Nd}{1,2}[-./]\p{Nd}{1,2}[-./]\p{Nd}{2,4}"),  # dates
    regex.compile(r"\p{Nd}+[.,]\p{Nd}+"),  # decimals
]

#: Words around a span that speak for a kind, or for none.
_CUES = {
    "phone": "call|calling|reach|ring|phone|tel|telefon|telephone|mobile|mobil|cell|landline|whatsapp|text me|number is|new number|nummer|ruf|appelle|llám\\w*|liga\\w*|téléphone|fax|hotline|driver|sms|dial",
    "id_number": "passport|passeport|pasaporte|passaporte|reisepass|ssn|social security|id|identity|ausweis\\w*|dni|nie|nif|cpf|cni|bsn|tax|steuer\\w*|insurance|versicherung\\w*|nino|licen[cs]e|personal\\w*",
    "email": "mail|e-mail|email|write|contact|kontakt|cc|mándalo|schick|address|send|escribe|écris|reply|invoices|adresse|correo",
    "address": "live|lives|living|parcel|pick me up|drop|vivo|vive|wohn\\w*|habit\\w*|mor[oa]\\w*|address|adresse|dirección|party is|deliver\\w*|ship|send|meet|moved|house|home|casa|flat is|come",
    "none": "order|ref|reference|code|tracking|ticket|invoice|server|build|version|room|gate|pin|serial|isbn|sku|case|booking|bestell\\w*|pedido|commande|meeting|flight|lot|deck|job|jobs|notes|issue",
}
_BEFORE = {kind: regex.compile(rf"(?<![\p{{L}}])(?:{words})(?![\p{{L}}])[^\p{{Nd}}\n]{{0,24}}\Z", regex.IGNORECASE) for kind, words in _CUES.items()}
_BEHIND = {
    "phone": regex.compile(r"\W{0,3}(?:is the (?:landline|number|mobile)|after \w+|is my (?:cell|number|mobile)|anytime)", regex.IGNORECASE),
    "id_number": regex.compile(r"\W{0,3}(?:as (?:tax|my|the)? ?(?:id|number)|is my (?:id|passport|ssn))", regex.IGNORECASE),
    "email": regex.compile(r"\W{0,3}(?:is the address|is my (?:mail|address|email)|please)", regex.IGNORECASE),
    "address": regex.compile(r"(?!x)x"),
    "none": regex.compile(r"\W{0,2}(?:shipped|euros?|€|%|minutes?|people|nights?|tickets?|is closed|is back)", regex.IGNORECASE),
}

# ---------------------------------------------------------------- names

TOKEN = regex.compile(r"[\p{L}\p{M}](?:[\p{L}\p{M}'’]*[\p{L}\p{M}])?")
#: Titles that belong to a name.
TITLES = frozenset("mr mrs ms miss mx dr prof professor sir madam mme mlle herr frau señor señora sr sra don doña г-н г-жа".split())
_JOINED = regex.compile(r"(\p{Lu}?[\p{Ll}\p{M}]{2,})(\p{Lu}[\p{L}\p{M}]+)")


def _vote(yes: bool, no: bool = False) -> str:
    return "+" if yes and not no else "-" if no else "0"


class Finder:
    """Proposes spans with their votes; built once a worker from broadcast parts."""

    def __init__(self, lexicon: Lexicon, ordinary: frozenset):
        self.lexicon, self.ordinary = lexicon, ordinary
        self._known: dict[str, tuple[str, str]] = {}

    def sort_of(self, raw: str) -> str:
        """given, nearly given, letter, kind, title, ordinary or rare."""
        found = self._known.get(raw)
        if found is None:
            if len(self._known) > 500_000:
                self._known.clear()
            found = self._known[raw] = self._sort(raw)
        return found

    def _sort(self, raw: str) -> str:
        if raw.lower() in TITLES:
            return "title"
        if len(raw) == 1:
            return "letter"
        if parts := _JOINED.fullmatch(raw):
            first, last = (sound(plain(part)) for part in parts.groups())
            whole = (first in self.lexicon.given or first in self.lexicon.nicknames) and len(last) >= 6 and last not in self.lexicon.kinds
            return "whole" if whole else "kind"
        word = sound(plain(raw).replace("'", "").replace("’", ""))
        if word in self.lexicon.given:
            return "given"
        if word in self.lexicon.nicknames:
            return "given"
        if word in self.lexicon.kinds or any(word.endswith(k) and len(word) - len(k) >= 4 and len(k) > 3 for k in self.lexicon.kinds):
            return "kind"
        if raw.lower() in self.ordinary:
            return "ordinary"
        if len(word) >= (4 if raw[0].isupper() else 5) and self.lexicon.given_form(word, True):
            return "near"
        return "rare" if len(word) >= 5 else "ordinary"

    def names(self, text: str, taken: list[tuple[int, int]]) -> Iterator[tuple[int, int, str, str]]:
        tokens = [(m.start(), m.end(), m.group()) for m in TOKEN.finditer(text)]
        sorts = [self.sort_of(t[2]) for t in tokens]
        for (start, end, _), sort in zip(tokens, sorts):
            if sort == "whole" and not any(a < end and start < b for a, b in taken):
                yield start, end, "++++0+", "wg--"
        if "rare" not in sorts and "near" not in sorts:
            return
        n, at = len(tokens), 0

        def joined(i: int, comma: bool) -> bool:
            """Only a space, a full stop after a letter or title, or a comma stands between i and i + 1."""
            if i + 1 >= n:
                return False
            gap = text[tokens[i][1] : tokens[i + 1][0]]
            if gap in (" ", " ", "  ", "_"):
                return True
            if gap in (". ", ".", ". ", ".  "):
                return sorts[i] in ("letter", "title") or gap == "." and tokens[i][2].islower() and tokens[i + 1][2].islower()
            return comma and gap in (", ", ",  ", ",")

        while at < n:
            found = self._name_at(text, tokens, sorts, at, joined)
            if found:
                first, last, votes, shape = found
                start, end = tokens[first][0], tokens[last][1]
                if not any(a < end and start < b for a, b in taken):
                    yield start, end, votes, shape
                at = last + 1
            else:
                at += 1

    def _name_at(self, text, tokens, sorts, at, joined):
        n, first = len(tokens), at
        title = sorts[at] == "title" and joined(at, False)
        i = at + 1 if title else at
        if i >= n:
            return None
        family = given = None
        order = "given"
        middle = False
        if sorts[i] in ("given", "near", "letter"):
            j = i
            while joined(j, False) and sorts[j + 1] == "letter" and sorts[i] != "letter":
                j += 1
                middle = True
            if joined(j, False) and sorts[j + 1] in ("rare", "near") and len(tokens[j + 1][2]) >= 5:
                given, family, last = i, j + 1, j + 1
        if given is None and sorts[i] in ("rare", "near") and joined(i, True) and sorts[i + 1] in ("given", "near", "letter"):
            comma = "," in text[tokens[i][1] : tokens[i + 1][0]]
            # after a comma a letter is a name only if its full stop shows it
            dotted = text[tokens[i + 1][1] : tokens[i + 1][1] + 1] == "."
            if sorts[i + 1] != "letter" or (dotted and not comma) or (comma and dotted):
                given, family, last, order = i + 1, i, i + 1, "comma" if comma else "family"
                if joined(last, False) and sorts[last + 1] == "letter" and sorts[given] != "letter" and text[tokens[last + 1][1] : tokens[last + 1][1] + 1] == ".":
                    last, middle = last + 1, True
                elif sorts[given] != "letter" and joined(last, False) and sorts[last + 1] in ("rare", "near") and tokens[last + 1][2][0].isupper():
                    return None  # the given name belongs to what follows
        if given is None:
            return None
        a, b = tokens[given][2], tokens[family][2]
        sort = sorts[given]
        case = (a[0].isupper() == b[0].isupper()) or sort == "letter"
        if a[0].islower() and b[0].isupper():
            return None  # an ordinary word that is also a short form
        shown = b[0].isupper()
        follows_kind = joined(last, False) and sorts[last + 1] == "kind" and tokens[last + 1][2][0].isupper() == shown
        before_kind = first > 0 and joined(first - 1, False) and sorts[first - 1] == "kind" and tokens[first - 1][2][0].isupper() and shown
        if follows_kind:
            return None  # the name of an organisation
        long = len(b) >= 7
        bare_letter = sort == "letter" and text[tokens[given][1] : tokens[given][1] + 1] != "." and not (order == "given" and (a.isupper() and a not in "AIOYEÀ" or b[0].islower() == a.islower()))
        votes = "".join(
            (
                _vote(sort in ("given", "near"), False),
                _vote(case, not case),
                _vote(long, len(b) < 6),
                _vote(False, before_kind),
                _vote(title or middle or sort == "given", bare_letter),
                _vote(b[0].isupper(), b[0].islower() and sort != "given"),
            )
        )
        return first, last, votes, f"{sort[0]}{order[0]}{'t' if title else '-'}{'m' if middle else '-'}"

    def spans(self, text: str, names: bool) -> Iterator[tuple[int, int, str, str, str]]:
        """(start, end, kind, votes, shape) of every proposal in a text."""
        taken: list[tuple[int, int]] = []
        if _EMAIL_HINT.search(text):
            for m in EMAIL.finditer(text):
                hit = m.group()
                plain_at = "@" in hit or "＠" in hit
                worded = regex.search(r"\s(?:at|AT|arroba)\s", hit) is not None
                top = regex.search(r"(\p{L}{2,})\Z", hit)
                before, behind = text[max(0, m.start() - 40) : m.start()], text[m.end() : m.end() + 30]
                votes = "".join(
                    (
                        _vote(plain_at and "." in hit.rpartition("@")[2], False),
                        _vote(not plain_at and not worded, worded and not regex.search(r"\s(?:dot|DOT|punto|punkt)\s|[\[(]\s?(?:dot|DOT)", hit)),
                        _vote(bool(top), not top),
                        _vote(bool(_BEFORE["email"].search(before) or _BEHIND["email"].match(behind) or before.rstrip()[-1:] == "<"), False),
                    )
                )
                yield m.start(), m.end(), "email", votes, "p" if plain_at else "w" if worded else "b"
                taken.append(m.span())
        if "://" in text or "www." in text:
            taken += [m.span() for m in URL.finditer(text)]
        if _ADDRESS_HINT.search(text):
            for style, pattern in ADDRESS:
                for m in pattern.finditer(text):
                    if any(a < m.end() and m.start() < b for a, b in taken):
                        continue
                    before, behind = text[max(0, m.start() - 40) : m.start()], text[m.end() : m.end() + 30]
                    hit = m.group()
                    words = [self.sort_of(w) for w in regex.findall(r"\p{L}{3,}", hit)]
                    votes = "".join(
                        (
                            _vote(True),
                            _vote(bool(_BEFORE["address"].search(before)), bool(_BEFORE["none"].search(before))),
                            _vote(bool(regex.search(_FLAT, hit)) or style != "english", bool(_BEHIND["none"].match(behind))),
                            _vote(hit[0].isdigit() or style != "english", "given" in words and style == "english" and _BEFORE["address"].search(before) is None),
                        )
                    )
                    yield m.start(), m.end(), "address", votes, style[0]
                    taken.append(m.span())
            for m in NUMBER.finditer(text):
                if any(a < m.end() and m.start() < b for a, b in taken):
                    continue
                found = list(self._number(text, m))
                yield from found
                if found:
                    taken.append(m.span())
        if names:
            for start, end, votes, shape in self.names(text, taken):
                yield start, end, "name", votes, shape

    @staticmethod
    def _ascii(text: str) -> str:
        """The same length with every digit of any script as 0 to 9."""
        return "".join(str(unicodedata.decimal(c)) if c.isdecimal() else c for c in text)

    def _number(self, text: str, m) -> Iterator[tuple[int, int, str, str, str]]:
        start, end, hit = m.start(), m.end(), m.group()
        digits = len(_DIGITS.findall(hit))
        if digits < 6:
            return
        # a bracket that the number does not open or close belongs to the text around it
        while hit.count("(") > hit.count(")") and hit.startswith("("):
            start, hit = start + 1, hit[1:]
        read = hit if hit.isascii() else self._ascii(hit)
        main = regex.sub(r"[ ,]{0,2}(?:ext\.?|extension|x|доб\.)\s?\p{Nd}+\Z", "", read)
        before, behind = text[max(0, start - 40) : start], text[end : end + 30]
        phone = any(f.fullmatch(main) for f in PHONE_FORMATS)
        ident = any(f.fullmatch(read) for f in ID_FORMATS)
        lettered = any(c.isalpha() for c in main)
        wrong = any(f.fullmatch(main) for f in _NO_NUMBER) or text[end : end + 1] in ",." and text[end + 1 : end + 2].isdigit()
        cue = {kind: bool(_BEFORE[kind].search(before) or _BEHIND[kind].match(behind)) for kind in ("phone", "id_number", "none")}
        opened = read.startswith(("+", "(")) or read.startswith("00") and not ident
        shape = f"{min(digits, 15) // 2}{'l' if lettered else 'o' if opened else '-'}"
        held = len(_DIGITS.findall(main))
        votes = "".join((_vote(phone and not ident, lettered), _vote(False, ident), _vote(cue["phone"], cue["id_number"]), _vote(False, cue["none"] and not cue["phone"]), _vote(False, wrong or not 7 <= held <= 15)))
        yield start, start + len(hit), "phone", votes, shape
        votes = "".join((_vote(ident, phone and not ident), _vote(False, opened), _vote(cue["id_number"], cue["phone"]), _vote(False, cue["none"] and not cue["id_number"]), _vote(False, wrong or not 7 <= sum(map(str.isalnum, read)) <= 14)))
        yield start, start + len(hit), "id_number", votes, shape


# ---------------------------------------------------------------- aggregation


def expectation_maximisation(votes: list[str], counts: np.ndarray, rounds: int = 60) -> np.ndarray:
    """How likely each vote pattern is a true one, from the counts of all patterns.

    Each labeler has a table of how often the votes it casts are + or - on true
    and on false proposals; it starts from the majority of the votes.
    """
    table = np.array([["+0-".index(v) for v in pattern] for pattern in votes])
    n_patterns, n_labelers = table.shape
    balance = (table == 0).sum(axis=1) - 1.5 * (table == 2).sum(axis=1)
    likely = np.clip(0.5 + 0.2 * balance, 0.02, 0.98)
    anchored = likely.copy()
    for _ in range(rounds):
        weight = np.stack([likely * counts, (1 - likely) * counts])
        share = np.clip(weight.sum(axis=1) / counts.sum(), 0.05, 0.95)
        # a prior of imagined votes keeps + on the side of true and - on that of false
        prior = np.array([[6.0, 0.0, 1.0], [1.0, 0.0, 6.0]]) * max(1.0, 0.05 * counts.sum())
        logs = np.log(share)[:, None] + np.zeros((2, n_patterns))
        for labeler in range(n_labelers):
            seen = np.stack([np.bincount(table[:, labeler], w, minlength=3) for w in weight]) + prior
            cast = seen[:, [0, 2]] / seen[:, [0, 2]].sum(axis=1, keepdims=True)
            # who abstains says nothing
            logs += np.log(np.stack([cast[:, 0], np.ones(2), cast[:, 1]], axis=1))[:, table[:, labeler]]
        updated = 1 / (1 + np.exp(np.clip(logs[1] - logs[0], -30, 30)))
        if np.abs(updated - likely).max() < 1e-6:
            break
        likely = updated
    # labelers that agree by construction must not overrule the plain majority altogether
    return 0.7 * likely + 0.3 * anchored


def _features(votes: str, shape: str, shapes: dict[str, int]) -> np.ndarray:
    row = np.zeros(1 + 2 * len(votes) + len(shapes))
    row[0] = 1
    for i, v in enumerate(votes):
        row[1 + 2 * i] = v == "+"
        row[2 + 2 * i] = v == "-"
    if shape in shapes:
        row[1 + 2 * len(votes) + shapes[shape]] = 1
    return row


def train_classifier(votes: list[str], shapes: list[str], counts: np.ndarray, likely: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Logistic regression on soft labels; returns the decision score of each pattern."""
    known = {s: i for i, s in enumerate(sorted(set(shapes)))}
    x = np.stack([_features(v, s, known) for v, s in zip(votes, shapes)])
    weight = np.sqrt(counts)
    weight = weight / weight.sum()
    beta = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], 1e-4)
    ridge[1 + 2 * len(votes[0]) :] = 3e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (weight * (p - likely)) + ridge * beta
        hessian = (x * (weight * np.maximum(p * (1 - p), 1e-4))[:, None]).T @ x + np.diag(ridge + 1e-9)
        step = np.linalg.solve(hessian, gradient)
        beta -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-7:
            break
    return 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))


def decide(patterns: pd.DataFrame) -> pd.DataFrame:
    """``kind, votes, shape, n`` with the probability that the classifier gives."""
    parts = []
    for _, group in patterns.groupby("kind"):
        group = group.sort_values(["votes", "shape"]).reset_index(drop=True)
        by_votes = group.groupby("votes", as_index=False)["n"].sum()
        likely = expectation_maximisation(list(by_votes["votes"]), by_votes["n"].to_numpy(float))
        target = group["votes"].map(dict(zip(by_votes["votes"], likely))).to_numpy()
        parts.append(group.assign(probability=train_classifier(list(group["votes"]), list(group["shape"]), group["n"].to_numpy(float), target)))
    return pd.concat(parts, ignore_index=True) if parts else patterns.assign(probability=pd.Series(dtype=float))


def ordinary_words(texts: DataFrame, column: str, rarity: int = VOCABULARY) -> frozenset:
    """Words in lower case that are at least one in ``rarity`` of all words written in lower case."""
    words = texts.select(F.explode(F.regexp_extract_all(F.col(column), F.lit(r"(?<![\p{L}@./])\p{Ll}[\p{Ll}\p{M}'’]*(?![\p{L}@])"), F.lit(0))).alias("word"))
    counts = cut_lineage(words.groupBy("word").agg(F.count(F.lit(1)).alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    return frozenset(r["word"] for r in counts.where(F.col("n") >= max(3, math.ceil(total / rarity))).select("word").collect())


def proposals(messages: DataFrame, lexicon: Lexicon, ordinary: frozenset) -> DataFrame:
    """``id, chat_jid, field_name, kind, start, end, found, votes, shape`` of every proposal.

    Repeated rows of a message propose the same again.  Null and blank texts propose nothing.
    """
    shared = messages.sparkSession.sparkContext.broadcast((lexicon, ordinary))
    columns = ["id", "chat_jid", "field_name", "kind", "start", "end", "found", "votes", "shape"]

    def propose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = Finder(*shared.value)
        for batch in batches:
            rows = []
            for ident, chat, text, pushed in zip(batch["id"], batch["chat_jid"], batch["text_content"], batch["push_name"]):
                for field, content in (("text_content", text), ("push_name", pushed)):
                    if not content or content.isspace():
                        continue
                    for start, end, kind, votes, shape in finder.spans(content, True):
                        found = content[start:end]
                        left = len(found) - len(found.lstrip(" .,;:!?<>[]{}\"'"))
                        found = found.strip(" .,;:!?<>[]{}\"'")
                        if found:
                            rows.append((ident, chat, field, kind, start + left, start + left + len(found), found, votes, shape))
            yield pd.DataFrame(rows, columns=columns)

    plain_rows = messages.select("id", "chat_jid", "text_content", "push_name")
    return plain_rows.mapInPandas(propose, "id string, chat_jid string, field_name string, kind string, start int, end int, found string, votes string, shape string")


def find_pii(messages: DataFrame, contacts: DataFrame, entities: DataFrame, nicknames: DataFrame, least: float = 0.5) -> DataFrame:
    """``id, chat_jid, field_name, pii_kind, start, end, pii_text``, one row a piece and place."""
    names = typed_names(contacts, entities)
    lexicon = learn_lexicon(names.select("name").distinct(), contacts, nicknames)
    ordinary = ordinary_words(messages, "text_content")
    proposed = cut_lineage(proposals(messages, lexicon, ordinary))
    # names are learnt from texts, if any holds one; a push name is mostly one name and would shift the shares
    learnt = (F.col("field_name") == "text_content") | (F.col("kind") != "name")
    patterns = proposed.groupBy("kind", "votes", "shape").agg(F.count_if(learnt).alias("n"), F.count(F.lit(1)).alias("every")).toPandas()
    patterns["n"] = patterns["n"].where(patterns.groupby("kind")["n"].transform("sum") > 0, patterns["every"])
    decided = decide(patterns.drop(columns="every"))
    spark = messages.sparkSession
    model = spark.createDataFrame(decided[["kind", "votes", "shape", "probability"]], "kind string, votes string, shape string, probability double")
    scored = proposed.join(F.broadcast(model), ["kind", "votes", "shape"]).where(F.col("probability") >= least)
    # a number may be a phone or an identity number; the likelier one stays
    rank = F.struct("probability", "kind")
    best = scored.groupBy("id", "chat_jid", "field_name", "start", "end", "found").agg(F.max(rank).getField("kind").alias("pii_kind"))
    return best.select("id", "chat_jid", "field_name", "pii_kind", "start", "end", F.col("found").alias("pii_text"))


def redact(messages: DataFrame, found: DataFrame) -> DataFrame:
    """``id, chat_jid, text_content, push_name`` with placeholders in place of what was found.

    One row a row of ``messages``; texts without personal information are
    untouched, and so is a repeated row that has lost the name.  Of spans that
    overlap the one that starts first is replaced.
    """

    @F.pandas_udf("string")
    def replace(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for text, marks in zip(texts, spans):
            if text is None or marks is None:
                out.append(text)
                continue
            parts, at = [], 0
            for mark in sorted(marks, key=lambda m: (m["start"], -m["end"])):
                if mark["start"] >= at and text[mark["start"] : mark["end"]] == mark["pii_text"]:
                    parts += [text[at : mark["start"]], PLACEHOLDER[mark["pii_kind"]]]
                    at = mark["end"]
            out.append("".join([*parts, text[at:]]))
        return pd.Series(out, dtype=object)

    marks = found.distinct()
    marks = marks.groupBy("id", "chat_jid").agg(*(F.collect_list(F.when(F.col("field_name") == f, F.struct("start", "end", "pii_kind", "pii_text"))).alias(f"_{f}") for f in ("text_content", "push_name")))
    joined = messages.select("id", "chat_jid", "text_content", "push_name").join(marks, ["id", "chat_jid"], "left")
    return joined.select("id", "chat_jid", *(replace(F.col(f), F.col(f"_{f}")).alias(f) for f in ("text_content", "push_name")))
