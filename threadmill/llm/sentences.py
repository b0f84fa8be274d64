r"""Sentence boundaries across languages and scripts.

Cascading segmentation rule tables: at every candidate position (after an end
mark with its closing quotes and brackets, after an emoji run, at a space
between Thai letters) the rules of the guards, of quotations, of ellipses, of
the language and of the defaults are tried in this order, and the first one
whose left and right patterns match decides between break and no break.

A rule is (breaks, zone, left, right).  ``left`` is matched against the end of
the text before the position and ``right`` against the start of the text behind
it.  ``zone`` names what surrounds the position:

* ``inside``   within a quotation or bracket that closes later in the line
* ``first``    the position ends a quotation that opens its sentence
* ``colon``    it ends a quotation that a colon introduces
* ``amid``     it ends a quotation that opens in the middle of its sentence
* ``bracket``  it ends a bracket that opens in the middle of its sentence
* ``emoji``    an emoji run stands directly before it
* ``label``    nothing but the line's label is before it
* ``brief``    at most three words of its sentence are before it
* ``*``        anywhere

The rules that apply in a set of zones are compiled into one alternation, which
tries them in their order.  Every line has the table of its own language, told
from the script and, among Latin ones, from its frequent words; what a line
leaves open is taken from the whole text and then from the declared language,
which is often missing or wrong.
"""

from __future__ import annotations

import functools
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame

MARKS = ".!?…‥。！？｡．।॥؟۔"
#: Marks that end a sentence whatever follows without a space.
FULL_MARKS = "。！？｡．।॥؟۔"
PAIRS = {"“": "”", "«": "»", "‹": "›", "「": "」", "『": "』", "（": "）", "(": ")", "[": "]", "{": "}", "【": "】", "《": "》", "〈": "〉", "„": "“", "‘": "’"}
BRACKETS = "([{（【"
CLOSERS = "”»›」』）)]}】》〉"

_EMOJI_BASE = "\U0001f000-\U0001faff☀-➿⬀-⯿⌚-⏿〰〽"
EMOJI_RUN = f"[{_EMOJI_BASE}](?:[{_EMOJI_BASE}\ufe0f\u20e3\u200d\U000e0020-\U000e007f]|[ \u00a0]+(?=[{_EMOJI_BASE}]))*"
THAI = "ก-ฺเ-๎"

LINE = regex.compile(r"[^\n\r\u2028\u2029\x0b\x0c\x85]+")
TOKEN = regex.compile(rf"(?P<mark>[{MARKS}]++(?:(?<=[{FULL_MARKS}])|(?![\p{{Ll}}\p{{N}}])))|(?P<emoji>{EMOJI_RUN})|(?P<thai>(?<=[{THAI}])[ \u00a0]+(?=[{THAI}]))")
QUOTE = regex.compile(r"[\"“”„«»‹›「」『』（）()\[\]{}【】《》〈〉]")
AFTER_EMOJI = regex.compile(rf"[ \u00a0]*(?:{EMOJI_RUN}|(?<=[ \u00a0])[:;]-?[()DP](?![\p{{L}}\p{{N}}]))")
_NAMED = r"[\p{Lu}\p{Lo}][\p{L}\p{M}.'’-]{0,29}"
LABEL = regex.compile(
    rf"\s*(?:(?:\(?[0-9]{{1,4}}[.)]|[A-Za-z][.)]|[ivx]{{1,4}}[.)]|[-*•▪◦‣·–—]|\[[^\]\n]{{1,20}}\]|[0-9]{{1,2}}[:.][0-9]{{2}}(?:\s?[-–])?|{_NAMED}(?: {_NAMED}){{0,3}}[:：])\s+)*"
)

#: Abbreviations within a sentence, whatever follows, by language.
LINKING = {
    "en": "e.g i.e vs cf Cf approx viz incl excl esp w/o ca",
    "de": "z.B d.h u.a i.d.R u.U z.T bzw vgl Vgl ca inkl exkl evtl ggf bes sog",
    "es": "p.ej aprox cf Cf vs EE",
    "fr": "p.ex c.-à-d env cf Cf av.J ex",
    "pt": "p.ex aprox cf Cf vs",
    "ru": "т.е т.к см См напр ср Ср",
}

#: Titles and other words before a name, by language.
TITLES = {
    "en": "Mr Mrs Ms Dr Prof St Capt Lt Sgt Gen Col Maj Rev Hon Gov Sen Rep Pres Messrs Mt Ft",
    "de": "Dr Prof Hr Hrn Fr Frl Fa St Ing Dipl Mag",
    "es": "Sr Sra Srta Sres Dr Dra Lic Ing Arq Prof Profa D Dña Av Avda Pza Ud Uds Vd St Sto Sta",
    "fr": "M MM Mme Mmes Mlle Mlles Dr Pr Me Mgr St Ste",
    "pt": "Sr Sra Srs Sras Dr Dra Eng Prof Profa Arq D Exmo Exma Av Pç Tv St Sto Sta",
    "ru": "ул просп пер пл Проф проф акад доц им",
    "ar": "د أ م",
    "hi": "डॉ श्री प्रो कु",
    "th": "ดร นพ ผศ รศ ศ",
    "zh": "Dr Mr Mrs Ms Prof St",
    "ja": "Dr Mr Mrs Ms Prof St",
}

#: Words before a number or in the middle of a clause, by language.
COUNTING = {
    "en": "No Nos no nos Nr p pp P fig figs Fig Figs eq Eq eqs Eqs sec Sec sect ch Ch vol Vol art Art pt v ed eds est dept univ tel Tel ext",
    "de": "Nr Nrn Abs Art Kap Abb Tab S Bd Aufl Hrsg Anm St Str Tel geb gest Std min max",
    "es": "núm Núm nº pág págs Pág cap art fig Fig vol tel Tel c",
    "fr": "chap Chap art Art fig Fig vol p pp tél Tél av bd Bd éd no No apr",
    "pt": "núm Núm pág págs Pág cap art fig Fig vol tel Tel",
    "ru": "стр с д кв корп к рис табл гл ст п пп тел Тел тыс млн млрд коп",
    "ar": "ص ج ق هـ ت س",
    "hi": "पृ सं रु",
    "th": "พ.ศ ค.ศ กม ซม อ จ ต ถ น",
    "zh": "No Nos vol p",
    "ja": "No Nos vol p",
}

#: Abbreviations that end a sentence where a capital follows, by language.
ENDING = {
    "en": "Inc Ltd Co Corp LLC Jr Sr Bros etc a.m p.m A.M P.M Ave Rd Blvd Ln hrs min max Jan Feb Mar Apr Jun Jul Aug Sep Sept Oct Nov Dec Mon Tue Tues Wed Thu Thur Thurs Fri Sat Sun",
    "de": "usw usf etc GmbH Co m.b.H Jan Feb Apr Jun Jul Aug Sept Sep Okt Nov Dez Mo Di Mi Do Sa So",
    "es": "etc S.A S.L S.A.U Cía Ltda a.m p.m h hs min kg Jr UU ene feb mar abr jun jul ago sept oct nov dic",
    "fr": "etc S.A Cie Inc h min janv févr avr juil sept oct nov déc",
    "pt": "etc Lda Ltda S.A Cia a.m p.m h min jan fev mar abr jun jul ago set out nov dez",
    "ru": "т.д т.п др пр руб чел г гг",
    "ar": "الخ إلخ",
    "hi": "आदि",
    "th": "ฯลฯ",
    "zh": "Inc Ltd Co etc",
    "ja": "Inc Ltd Co etc",
}

#: Words that mostly open a sentence where they are written with a capital.
OPENING = {
    "en": "The A An This That These Those It He She We They You I There Here What Why Who How When Where Which In On At For By As After Before But And Or So Then If Our My Your His Her Their Its Please No Yes Not Nobody Everyone Everybody Someone Somebody Do Does Did Is Are Was Were Can Could Would Should Have Has Had Let Thanks Thank Now Also However Meanwhile According Between From With To Once While Because Since Although Both Each Every All Some Any Many Most Only Just Still Maybe Perhaps Otherwise Instead",
    "de": "Der Die Das Ein Eine Er Sie Es Wir Ihr Ich Du Man Wer Was Wie Wann Wo Warum Am Im In An Auf Bei Mit Nach Vor Von Zu Zum Zur Aber Und Oder Dann Denn Doch Wenn Weil Als Alle Alles Bitte Ja Nein Nicht Kein Keine Mein Meine Unser Unsere Dieser Diese Dieses Jetzt Heute Morgen Hier Da Dort Auch Nur Noch Danach",
    "es": "El La Los Las Un Una Lo Él Ella Ellos Nosotros Yo Tú Usted Se Me Te Nos Es Son Está Hay No Sí Qué Quién Cómo Cuándo Dónde Por Para En Con De Al A Y O Pero Si Cuando Luego Después Antes Entonces Ya También Mi Tu Su Este Esta Eso Todos Nadie Gracias",
    "fr": "Le La Les L Un Une Des Il Elle Ils Elles On Nous Vous Je J Tu C Ce Cette Ces Ça Qui Que Quoi Où Quand Comment Pourquoi En Dans Sur Avec Pour Par Sans Mais Et Ou Donc Puis Si Alors Ensuite Après Avant Tout Tous Mon Ma Mes Son Sa Ses Notre Merci Oui Non Pas Personne",
    "pt": "O A Os As Um Uma Ele Ela Eles Elas Nós Eu Tu Você Isto Isso Este Esta Que Quem Como Quando Onde Porque Por Para Em No Na Com De Do Da Ao Mas E Ou Se Depois Antes Então Já Também Meu Minha Seu Sua Todos Ninguém Não Sim Obrigado Obrigada",
    "ru": "Он Она Оно Они Мы Вы Я Ты Это Этот Эта Все Всё Кто Что Как Когда Где Почему Зачем В Во На По С Со Из От До Для Без О Об При За К У Но А И Или Если Потом Затем Сейчас Теперь Там Здесь Тут Нет Да Не Наш Мой Так Уже Ещё Пожалуйста Спасибо",
}

#: Words that carry a sentence on behind a closed quotation.
CARRY_ON = {
    "en": "and but or then so yet nor while before after when as because since until at in on for to with without by from of off into onto over under near behind below above beside between during about across around through against toward towards upon",
    "de": "und aber oder dann doch sondern als während bevor weil in im an am auf aus bei mit nach von vom zu zum zur über unter vor hinter neben zwischen für gegen ohne um",
    "es": "y e pero o u luego mientras cuando porque a al de del en con sin por para sobre bajo ante tras desde hasta hacia según entre contra",
    "fr": "et mais ou puis quand avant après car à au aux de du des en dans sur sous avec sans par pour chez vers devant derrière entre contre depuis",
    "pt": "e mas ou depois quando porque a ao à de do da em no na com sem por para sobre sob ante desde até entre contra",
    "ru": "и а но или потом когда пока в во на по под над с со из от до для без о об при за к у через между",
    "ar": "ثم لكن أو قبل بعد",
    "hi": "और फिर लेकिन पर या कहकर",
    "th": "แล้ว และ แต่",
    "zh": "然后 就 并 而 但 接着 便",
    "ja": "と だけ って の を が は に で も という",
}

#: The most frequent function words, by which Latin-script languages are told apart.
FREQUENT = {
    "en": "the and of to is was it in on for at by with will we i you no this that not are from my who what be have has so or as they he she his her our but",
    "de": "der die das und ist nicht am im mit auf den dem von für zu wir ich sie er es ein eine bin hat haben sind war um bei auch noch wie wer aber des vom zum zur bis",
    "es": "el la los las y en de que por un una es está con del no se lo al nos quién ya para su como más pero sin hay son fue",
    "fr": "le la les et est un une des du de à il elle je pour pas que qui en ce se dans au suis sont nous vous avec sur mais plus par aux été ont",
    "pt": "o a os as e é de do da em um uma que para por com não se no na está já até foi das dos ao mas mais são nos",
}

_MONTHS = {
    "en": "January February March April May June July August September October November December Jan Feb Mar Apr Jun Jul Aug Sept Sep Oct Nov Dec Monday Tuesday Wednesday Thursday Friday Saturday Sunday",
    "de": "Januar Februar März April Mai Juni Juli August September Oktober November Dezember Jan Feb Quartal Stock Klasse Jahrhundert Etage Kapitel",
}
_UNCASED = r"[\p{Arabic}\p{Devanagari}\p{Han}\p{Hiragana}\p{Katakana}]"
_OPEN = r"[\"“„«‹‘'(\[¿¡—–-]"
_HEAD = r"(?<![\p{L}\p{M}\p{N}])"


def _words(names: str) -> str:
    return "|".join(regex.escape(w).replace(r"\.", r"\.\s?") for w in sorted(names.split(), key=len, reverse=True))


Rule = tuple[bool, str, str, str]


def _guards() -> list[Rule]:
    return [
        (False, "inside", "", ""),
        (False, "*", "", r"[,;:)\]}»”،؛、，；：]|[.!?…。！？]|\s+[!?;:»](?!\S*\w)"),
        (True, "*", "", r"\s*\Z"),
        (True, "emoji", "", ""),
        (False, "label", "", ""),
    ]


def _quotations(lang: str) -> list[Rule]:
    carry = _words(CARRY_ON[lang])
    spaced = lang not in ("zh", "ja", "th")
    on = rf"\s+(?:{carry})\b" if spaced else rf"\s*(?:{carry})"
    rules: list[Rule] = [(False, zone, "", on) for zone in ("first", "amid", "colon")]
    rules += [(False, zone, "", r"\s*[—–-]+\s*\p{Ll}") for zone in ("first", "amid", "colon", "*")]
    rules += [(False, "bracket", "", rf"\s*(?:\p{{Ll}}|\p{{N}}|{_UNCASED}|[{THAI}])")]
    rules += [(False, "first", "", r"\s+\p{Ll}"), (False, "first", "", r"(?:他|她|我|你|大家|\p{Han}{1,4}[说問问喊道])")]
    rules += [(False, "amid", "", rf"\s*{_UNCASED}")]
    return rules


def _ellipses() -> list[Rule]:
    return [(False, "*", r"(?:\.{2,}|…+|‥+)", rf"\s*(?:\p{{Ll}}|{_UNCASED})")]


def _language(lang: str) -> list[Rule]:
    # in scripts without spaces an abbreviation may follow any other letter
    head = r"(?<![\p{Latin}\p{N}])" if lang in ("zh", "ja") else _HEAD
    capital = rf"\s+(?:{_OPEN}\s?)*\p{{Lu}}"
    opening = rf"\s+(?:{_OPEN}\s?)*(?:{_words(OPENING[lang])})(?!\p{{L}})" if lang in OPENING else r"(?!)"
    ordinal = rf"(?:\p{{N}}|{_calendar(lang)})"
    # letters with full stops make a chain: "J. R. Ames", "z. B."
    rules: list[Rule] = [(False, "*", r"(?<!\.)" + head + r"\p{L}\.", r"\s*\p{L}\.")]
    if lang in LINKING:
        rules += [(False, "*", head + rf"(?:{_words(LINKING[lang])})\.", r"\s*\S")]
    if lang == "en":
        rules += [
            (True, "*", r"\p{N}\p{L}?\s(?:\p{Lu}[\p{L}'’-]*\s){1,3}(?:St|Dr)\.", opening),
            (False, "brief", r"(?i:after|before|until|till|since|by|at|from|around)\s\S{1,8}\s?[AaPp]\.\s?[Mm]\.", r"\s+\S"),
        ]
    if lang == "de":
        rules += [(False, "*", r"\p{L}[Ss]tr\.", r"\s*\p{N}"), (False, "*", head + r"(?:Mio|Mrd|Tsd)\.", rf"(?!{opening})")]
    if lang == "ru":
        # a year or a page before it ends what a place would begin
        rules += [(True, "*", r"\p{N}\s?(?:г|гг)\.", capital), (False, "*", head + r"г\.", r"\s*\p{Lu}")]
    rules += [
        (False, "*", head + rf"(?:{_words(TITLES[lang])})\.", r"\s*\S"),
        (False, "*", head + rf"(?:{_words(COUNTING[lang])})\.", r"\s*(?:\p{N}|[(#№]|\p{Ll}|[IVXLC]+(?!\p{L}))"),
        (False, "*", head + rf"(?:{_words(ENDING[lang])})\.", rf"\s+{ordinal}"),
        (False, "*", head + rf"(?:{_words(ENDING[lang])})\.", rf"(?!{capital})"),
        (True, "*", head + rf"(?:{_words(ENDING[lang])})\.", capital),
    ]
    if lang == "de":
        months = _words(_MONTHS["de"])
        whole = r"(?<![\p{N}][.,:])(?<!\p{N})\p{N}{1,3}\."
        rules += [
            (False, "*", whole, rf"\s+(?:{months})(?!\p{{L}})"),
            (False, "*", r"(?i:(?<!\p{L})(?:am|den|vom|zum|beim|im|der|des|dem|die|das|ins|seit|ab|bis)\s)\p{N}{1,2}\.", r"\s+\p{L}"),
        ]
    rules += [
        # an initial goes on before a name, but not before a word that opens a sentence
        (True, "*", r"\p{Lu}\.", opening),
        (False, "*", r"(?:" + head + r"|\.)\p{Lu}\.", r"\s*\p{Lu}|\s+(?:de|del|da|di|du|la|le|van|von|der)\s"),
        (False, "*", r"\p{L}\.\p{Lu}\.", r"\s+\p{Ll}"),
        # single letters such as those of "u. dgl."
        (False, "*", head + r"\p{Ll}\.", r"\s*[\p{Ll}\p{N}]"),
        (False, "*", head + r"\p{Ll}\.\s?\p{Lu}\.", r"\s*[\p{L}\p{N}]"),
    ]
    return rules


def _calendar(lang: str) -> str:
    return rf"(?:{_words(_MONTHS[lang])})(?!\p{{L}})" if lang == "en" else r"(?!)"


def _defaults() -> list[Rule]:
    return [
        (True, "*", rf"[{FULL_MARKS}][{regex.escape(CLOSERS)}\"]*", ""),
        (True, "*", r"[!?]+", r"[\p{Han}\p{Hiragana}\p{Katakana}]"),
        (True, "*", "", r"\s"),
        # the space is missing: a word, not an address, before a capital
        (True, "*", rf"(?<!(?:@|//|www\.)\S{{0,99}})(?:\p{{Ll}}{{2}}|[\p{{L}}\p{{N}})\"”»](?=[!?]))[{MARKS}]+[\"”»)]*(?<!www\.)", r"\p{Lu}(?:\p{Ll}|[\s.'’])"),
        (False, "*", "", ""),
    ]


@functools.lru_cache(maxsize=None)
def rule_table(lang: str) -> tuple[Rule, ...]:
    """The cascade of a language: guards, quotations, ellipses, language, defaults."""
    return (*_guards(), *_quotations(lang), *_ellipses(), *_language(lang), *_defaults())


@functools.lru_cache(maxsize=None)
def cascade(lang: str, zones: frozenset[str]) -> regex.Pattern:
    """The rules of these zones as one alternation that tries them in order; the group that matches says ``b`` or ``n``."""
    parts = []
    for number, (breaks, zone, left, right) in enumerate(rule_table(lang)):
        if zone == "*" or zone in zones:
            parts.append(f"(?P<{'b' if breaks else 'n'}{number}>{f'(?<={left})' if left else ''}{f'(?={right})' if right else ''})")
    return regex.compile("|".join(parts))


_SCRIPT = regex.compile(r"(?P<th>\p{Thai})|(?P<ja>[\p{Hiragana}\p{Katakana}])|(?P<zh>\p{Han})|(?P<ar>\p{Arabic})|(?P<hi>\p{Devanagari})|(?P<ru>\p{Cyrillic})")
_ALL_OF = {
    "th": regex.compile(r"\p{Thai}"),
    "ja": regex.compile(r"[\p{Hiragana}\p{Katakana}]"),
    "zh": regex.compile(r"\p{Han}"),
    "ar": regex.compile(r"\p{Arabic}"),
    "hi": regex.compile(r"\p{Devanagari}"),
    "ru": regex.compile(r"\p{Cyrillic}"),
}
_LATIN = regex.compile(r"\p{Latin}")
_TOLD = tuple(FREQUENT)
_WEIGHT = {word: tuple(i for i, lang in enumerate(_TOLD) if word in FREQUENT[lang].split()) for words in FREQUENT.values() for word in words.split()}
#: Letters that a script needs for each Latin one before a line counts as written in it.
_SHARE = {"zh": 3, "ja": 1, "th": 1, "ar": 1, "hi": 1, "ru": 1}


def _script_of(line: str) -> str | None:
    """The language of a script other than Latin in which most of a line is written."""
    if not _SCRIPT.search(line):
        return None
    letters = {lang: len(pattern.findall(line)) for lang, pattern in _ALL_OF.items()}
    letters["ja"] = letters["ja"] * 3 if letters["ja"] * 5 > letters["zh"] else 0
    best = max(letters, key=letters.get)
    return best if letters[best] * _SHARE[best] * 2 > len(_LATIN.findall(line)) else None


def _latin_votes(line: str) -> list[int]:
    votes = [0] * len(_TOLD)
    for word in line.lower().split():
        if word in _WEIGHT:
            for i in _WEIGHT[word]:
                votes[i] += 1
    return votes


def languages_of(lines: list[str], declared: str | None = None) -> list[str]:
    """The language of each line of a text, in the order of certainty: its script, its own words, those of all lines, the declared one."""
    scripts = [None if line.isascii() else _script_of(line) for line in lines]
    votes = [None if script else _latin_votes(line) for line, script in zip(lines, scripts)]
    total = [sum(v[i] for v in votes if v) for i in range(len(_TOLD))]
    told = (declared or "").lower()
    whole = max(range(len(_TOLD)), key=lambda i: (total[i], _TOLD[i] == told, -i))
    found = []
    for script, own in zip(scripts, votes):
        if script is None:
            own[whole] += 1.5
            script = _TOLD[own.index(max(own))]
        found.append(script)
    return found


def language_of(text: str, declared: str | None = None) -> str:
    """The language whose table fits a whole text, taken as one line."""
    return languages_of([text], declared)[0]


def _pairs(line: str) -> list[tuple[int, int]]:
    """Positions of matching quotes and brackets of a line, unmatched ones left out."""
    found, stack = [], []
    straight = 0
    for match in QUOTE.finditer(line):
        char, at = match.group(), match.start()
        if stack and (line[stack[-1]], char) in (("“", "”"), ("„", "“"), ("„", "”"), ('"', '"'), ("»", "«")) or stack and PAIRS.get(line[stack[-1]]) == char:
            straight -= char == '"'
            found.append((stack.pop(), at))
        elif char == '"':
            if straight:
                while line[stack[-1]] != '"':
                    stack.pop()
                straight -= 1
                found.append((stack.pop(), at))
            else:
                straight += 1
                stack.append(at)
        elif char in PAIRS:
            stack.append(at)
        else:
            # closes the nearest that it can; a line without that one leaves the stack alone
            opener = next((depth for depth in range(len(stack) - 1, max(-1, len(stack) - 9), -1) if PAIRS.get(line[stack[depth]]) == char), None)
            if opener is not None:
                found.append((stack[opener], at))
                straight -= sum(line[s] == '"' for s in stack[opener:])
                del stack[opener:]
    return found


def _outermost(pairs: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the pairs that no other pair holds, ascending."""
    starts, ends = [], []
    for a, b in sorted(pairs):
        if not ends or a > ends[-1]:
            starts.append(a)
            ends.append(b)
    return starts, ends


_ANYWHERE = frozenset("*")


def _may_be_emoji(line: str, at: int) -> bool:
    """Whether what stands behind a position, spaces aside, could be an emoji at all."""
    ahead = line[at : at + 2].lstrip()[:1]
    return not ahead and at + 1 < len(line) or ahead in (":", ";") or ahead > "\u2300"


def _line_breaks(line: str, lang: str) -> Iterator[int]:
    """Positions inside a stripped line where a sentence ends."""
    body = start = done = None
    for token in TOKEN.finditer(line):
        if body is None:
            body, start, done = LABEL.match(line).end(), 0, 0
            pairs = _pairs(line) if QUOTE.search(line) else []
            closing = {b: a for a, b in pairs}
            begins, stops = _outermost(pairs)
        if token.start() < done:
            continue
        at, zones = token.end(), []
        kind = token.lastgroup
        quote = None
        if kind == "mark":
            while at < len(line):
                if at in closing:
                    quote = closing[at] if closing[at] >= start else quote
                    at += 1
                elif line[at] in " \u00a0\u202f" and at + 1 in closing and line[at + 1] == "»":
                    quote = closing[at + 1] if closing[at + 1] >= start else quote
                    at += 2
                else:
                    break
        opens = max(start, body) if start == 0 else start
        if kind == "emoji":
            if not line[opens : token.start()].strip():
                continue
            zones.append("emoji")
        elif kind == "mark" and _may_be_emoji(line, at) and (more := AFTER_EMOJI.match(line, at)):
            at = more.end()
            zones.append("emoji")
        elif kind == "thai":
            at = token.start()
        if begins:
            held = bisect_right(begins, token.start() - 1) - 1
            if held >= 0 and stops[held] >= at:
                zones.append("inside")
        if start == 0 and kind == "mark" and at <= body:
            zones.append("label")
        if at - opens < 24 and line[opens:at].strip().count(" ") < 3:
            zones.append("brief")
        if quote is not None and "emoji" not in zones:
            before = line[opens:quote].rstrip()
            if line[quote] in BRACKETS:
                if before:
                    zones.append("bracket")
            else:
                zones.append("first" if not before else "colon" if before[-1] in ":：" else "amid")
        if kind == "thai":
            breaks = "inside" not in zones and "label" not in zones
        else:
            breaks = cascade(lang, frozenset(zones) if zones else _ANYWHERE).match(line, at).lastgroup[0] == "b"
        if breaks:
            yield at
            start = at
        done = at


def sentence_spans(text: str | None, declared: str | None = None) -> list[tuple[int, int]]:
    """``(start, end)`` of every sentence of a whole text, in code points."""
    if not text or text.isspace():
        return []
    found = [(match.start(), match.group()) for match in LINE.finditer(text)]
    lines = [(at + len(raw) - len(raw.lstrip()), raw.strip()) for at, raw in found]
    lines = [(offset, line) for offset, line in lines if line]
    spans = []
    for (offset, line), lang in zip(lines, languages_of([line for _, line in lines], declared)):
        start = 0
        for end in [*_line_breaks(line, lang), len(line)]:
            piece = line[start:end]
            begin = start + len(piece) - len(piece.lstrip())
            stop = start + len(piece.rstrip())
            if stop > begin:
                spans.append((offset + begin, offset + stop))
            start = end
    return spans


def sentences(documents: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``key, sent_no, start_pos, end_pos`` for every sentence of every document.

    Null, empty and blank texts have no sentence.  Repeated rows of a document
    give its sentences once each; other columns are ignored.
    """
    kind = documents.schema[key].dataType.simpleString()

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys, numbers, starts, ends = [], [], [], []
            for ident, content, declared in zip(batch["k"], batch["t"], batch["l"]):
                for number, (start, end) in enumerate(sentence_spans(content, declared if isinstance(declared, str) else None), 1):
                    keys.append(ident)
                    numbers.append(number)
                    starts.append(start)
                    ends.append(end)
            out = pd.DataFrame({key: pd.Series(keys, dtype=batch["k"].dtype), "sent_no": numbers, "start_pos": starts, "end_pos": ends})
            yield out.astype({"sent_no": "int32", "start_pos": "int32", "end_pos": "int32"})

    plain = documents.selectExpr(f"`{key}` AS k", f"`{text}` AS t", f"`{lang}` AS l")
    return plain.mapInPandas(split, f"`{key}` {kind}, sent_no int, start_pos int, end_pos int")
