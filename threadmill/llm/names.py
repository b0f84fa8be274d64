"""Variant spellings of names typed by people, linked to one person, organisation or product.

Every name is read as a core (a family name, or what an organisation, event or
product is called) and a form beside it (a given name, nickname or initial, or
the kind of organisation).  Cores within one edit are found by the pigeonhole
segment join and share the most frequent spelling; forms are resolved among the
forms that occur with the same core: a nickname or an abbreviation to the one it
may stand for, an initial to the only one that starts with it.  Names with
equal core and form mean the same.

Given names, kinds and nicknames beyond the listed ones are learned from the
names themselves.  A token is taken for a given name or kind if it stands beside
at least one in ``RARITY`` of all distinct pairs of tokens, so at most
2 x ``RARITY`` tokens can be, however many names there are.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadmill.llm.spelling import KINDS, edits, plain, segment_join, sound, tokens_of
from threadmill.plans.graph import pairs_within
from threadmill.session import cut_lineage

RARITY = 500
#: Edits allowed between two spellings of one core.
EDITS = 1
_ACRONYM = regex.compile(r"\s*(\p{Lu}{2,4})\s+\p{Lu}?\p{Ll}")


def _with_one_dropped(token: str) -> set[str]:
    """A token and what is left of it without any one letter."""
    return {token, *(token[:i] + token[i + 1 :] for i in range(len(token)))}


@dataclass
class Lexicon:
    """Given names, what nicknames stand for, and kinds, all as sounds."""

    given: frozenset = frozenset()
    nicknames: dict = field(default_factory=dict)
    kinds: frozenset = frozenset()

    def __post_init__(self):
        # two tokens within one edit become equal by dropping at most one letter of each
        self._dropped: dict[str, list[str]] = {}
        for name in (*self.given, *self.nicknames):
            if len(name) > 3:
                for part in _with_one_dropped(name):
                    self._dropped.setdefault(part, []).append(name)
        self._near = functools.lru_cache(maxsize=200_000)(self._nearest_given)
        self._parts = functools.lru_cache(maxsize=200_000)(self._kinds_for)

    def __getstate__(self):
        return {"given": self.given, "nicknames": self.nicknames, "kinds": self.kinds}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.__post_init__()

    def _nearest_given(self, token: str) -> str | None:
        """The listed given name or nickname that a token misspells by one edit."""
        if len(token) < 4:
            return None
        candidates = {g for part in _with_one_dropped(token) for g in self._dropped.get(part, ())}
        close = [g for g in candidates if edits(g, token, 1) <= 1]
        return min(close, key=lambda g: (g not in self.given, g)) if close else None

    def _kinds_for(self, token: str) -> tuple[str, ...]:
        """Kinds that a token abbreviates or misspells."""
        if len(token) < 3:
            return ()
        short = [k for k in self.kinds if k.startswith(token)]
        return tuple(sorted(short or [k for k in self.kinds if len(k) > 4 and edits(k, token, 1) <= 1]))

    def given_form(self, token: str, near: bool) -> tuple[str, str, tuple[str, ...]] | None:
        """(form, sort, what it may stand for) of a given name, else None."""
        if token in self.given:
            return token, "full", (token,)
        if token in self.nicknames:
            return token, "short", tuple(self.nicknames[token])
        if near and (close := self._near(token)):
            return self.given_form(close, False)
        return None

    def read(self, name: str, person_only: bool) -> tuple[str, str, str, str, list[str]] | None:
        """(what, core, form, sort, stands for) of a typed name, None if it names nothing whole."""
        tokens = tokens_of(name)
        words = [t for t in tokens if len(t) > 1]
        letters = [t for t in tokens if len(t) == 1]
        if not words:
            return None
        whole = [i for i, w in enumerate(words) if w in self.kinds]
        if whole and len(words) > 1:
            return self._thing(words, whole[-1], words[whole[-1]], "full", (words[whole[-1]],))
        if len(words) == 1 and words[0] not in self.given and words[0] not in self.nicknames:
            kind = max((k for k in self.kinds if words[0].endswith(k) and len(words[0]) - len(k) >= 4), key=len, default=None)
            if kind and not letters:
                return "thing", words[0][: -len(kind)], kind, "full", [kind]
        for near in (False, True):
            for i, word in enumerate(words):
                if len(words) > 1 and (form := self.given_form(word, near)):
                    rest = [w for j, w in enumerate(words) if j != i]
                    family = max(rest, key=len)
                    if len(family) > 3:
                        return "person", family, form[0], form[1], list(form[2])
            if letters and len(words) == 1 and len(words[0]) > 3 and not self.given_form(words[0], near):
                return "person", words[0], letters[0], "letter", []
        acronym = _ACRONYM.match(name)
        if acronym and len(words) == 2:
            return "thing", words[1], "".join(sound(c)[0] for c in plain(acronym.group(1))), "acronym", []
        if len(words) > 1:
            for i in range(len(words) - 1, -1, -1):
                if parts := self._parts(words[i]):
                    return self._thing(words, i, words[i], "short", parts)
            if len(words) == 2 and min(map(len, words)) > 2:
                return "person", max(words, key=len), min(words, key=len), "odd", []
            return None
        if person_only:
            return None
        return "thing", "".join(words), "", "full", [""]

    def _thing(self, words, at, form, sort, stands):
        rest = [w for i, w in enumerate(words) if i != at and w not in self.kinds] or [words[0]]
        return "thing", rest[0], form, sort, list(stands)

    def initials(self, name: str) -> str | None:
        """First letters of the three words or more of an organisation's name."""
        tokens = tokens_of(name)
        return "".join(t[0] for t in tokens) if len(tokens) > 2 and tokens[-1] in self.kinds else None


def learn_lexicon(names: DataFrame, contacts: DataFrame, nicknames: DataFrame, rarity: int = RARITY) -> Lexicon:
    """``names`` has distinct ``name``; ``contacts`` ``push_name, full_name``; ``nicknames`` ``given, nickname``."""
    known: dict[str, set] = {}
    for row in nicknames.where("given is not null and nickname is not null").collect():  # a curated list
        known.setdefault(sound(plain(row["nickname"])), set()).add(sound(plain(row["given"])))
    listed = {g for gs in known.values() for g in gs}
    kinds = {sound(k) for k in KINDS}

    @F.pandas_udf("array<string>")
    def words(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: [w for w in tokens_of(t) if len(w) > 1])

    pairs = cut_lineage(names.select(words("name").alias("w")).where(F.size("w") == 2).select(F.col("w")[0].alias("x"), F.col("w")[1].alias("y")).where("x <> y").distinct())
    total = pairs.count()
    least = max(5, -(-total // rarity))
    prefixes = {k[:n] for k in kinds for n in range(3, len(k) + 1)}
    both = pairs.select(F.col("x").alias("token"), F.col("y").alias("other"), F.lit(1).alias("first")).unionByName(pairs.select(F.col("y").alias("token"), F.col("x").alias("other"), F.lit(0).alias("first")))
    sides = both.groupBy("token").agg(F.count_distinct("other").alias("n"), F.avg("first").alias("first"), F.avg(F.col("other").isin(*prefixes).cast("int")).alias("kinds"), F.avg(F.col("other").isin(*listed, *known).cast("int") if known else F.lit(0)).alias("given"))
    common = sides.where(F.col("n") >= least).collect()  # at most 2 x rarity rows
    given = listed | {r["token"] for r in common if r["first"] >= 0.5 and r["kinds"] < 0.3 and r["token"] not in kinds and r["token"] not in known}
    kinds |= {r["token"] for r in common if r["n"] >= 3 * least and r["first"] < 0.5 and r["given"] < 0.3 and r["kinds"] < 0.3 and r["token"] not in given and r["token"] not in known and r["token"] not in prefixes}
    # a misspelling that is common enough to be learned yields to the name it misspells
    weight = {r["token"]: r["n"] for r in common}
    given -= {g for g in given - listed if any(h != g and weight.get(h, 10**9) > 3 * weight.get(g, 0) and edits(g, h, 1) <= 1 for h in given)}

    told = contacts.where("push_name is not null and full_name is not null").select(words("push_name").alias("p"), words("full_name").alias("f")).where(F.size("f") == 2)
    spoken = told.select(F.explode("p").alias("short"), "p", "f").where(F.size("p").between(1, 2) & ((F.size("p") == 1) | F.arrays_overlap("p", "f")) & ~F.array_contains("f", F.col("short")))
    cited = spoken.select("short", F.explode("f").alias("given")).where(F.col("given").isin(*given)) if given else None
    learned: dict[str, set] = {k: set(v) for k, v in known.items()}
    if cited is not None:
        counts = cited.groupBy("short", "given").agg(F.count(F.lit(1)).alias("n"))
        enough = max(2, cited.count() // 5000)  # so at most 5,000 rows
        all_of = counts.groupBy("short").agg(F.sum("n").alias("all"))
        for r in counts.where(F.col("n") >= enough).join(all_of, "short").where("n * 2 >= all").collect():
            # the longer and more common of the two is the full form
            fuller = (len(r["given"]), weight.get(r["given"], 0)) > (len(r["short"]), weight.get(r["short"], 0))
            if len(r["short"]) > 1 and r["short"] not in listed and fuller and edits(r["short"], r["given"], 1) > 1:
                learned.setdefault(r["short"], set()).add(r["given"])
    given -= set(learned)
    given |= {g for gs in learned.values() for g in gs}
    return Lexicon(frozenset(given), {k: tuple(sorted(v)) for k, v in learned.items()}, frozenset(kinds - given))


def _spelled_alike(cores: DataFrame, most: int) -> DataFrame:
    """``what, core, rep``: the most frequent spelling that a chain of ever more frequent ones, each within reach of the last, leads to."""
    counts = cores.groupBy("what", "core").agg(F.sum("n").alias("n"))
    near = segment_join(counts, "core", most)
    sides = near.select(F.col("a").alias("core"), F.col("b").alias("other")).unionByName(near.select(F.col("b").alias("core"), F.col("a").alias("other")))
    there = counts.select("what", F.col("core").alias("other"), F.col("n").alias("m"))
    up = sides.join(counts, "core").join(there, ["what", "other"]).where((F.col("m") > F.col("n")) | ((F.col("m") == F.col("n")) & (F.col("other") < F.col("core"))))
    found = cut_lineage(up.groupBy("what", "core").agg(F.max_by("other", F.struct("m", "other")).alias("rep")))
    while True:
        # every pointer jumps to where its target points, so a chain of n takes log n rounds
        further = found.select("what", F.col("core").alias("rep"), F.col("rep").alias("top"))
        jumped = cut_lineage(found.join(further, ["what", "rep"], "left").select("what", "core", F.coalesce("top", "rep").alias("rep"), F.col("top").isNotNull().alias("moved")))
        found = jumped.select("what", "core", "rep")
        if jumped.where("moved").isEmpty():
            return found


def linked_names(names: DataFrame, lexicon: Lexicon, most: int = EDITS) -> DataFrame:
    """``source, key, what, rep, meaning``: what each ``source, key, name, n`` means.

    Names that hold no core with a form have no row, and neither have forms
    that may stand for several others of the same core.
    """
    spark = names.sparkSession
    shared = spark.sparkContext.broadcast(lexicon)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for batch in batches:
            rows = []
            for source, name in zip(batch["source"], batch["name"]):
                if found := own.read(name, source == "contact"):
                    rows.append((source, name, *found, own.initials(name)))
            yield pd.DataFrame(rows, columns=["source", "name", "what", "core", "form", "sort", "stands", "initials"])

    typed = names.select("source", "name").distinct()
    parsed = cut_lineage(typed.mapInPandas(read, "source string, name string, what string, core string, form string, sort string, stands array<string>, initials string"))
    used = parsed.join(names.groupBy("source", "name").agg(F.sum("n").alias("n")), ["source", "name"])
    reps = _spelled_alike(used.where(F.length("core") > 4), most)
    placed = cut_lineage(parsed.join(reps, ["what", "core"], "left").withColumn("rep", F.coalesce("rep", "core")))

    forms = placed.select("what", "rep", "form", "sort", "stands").distinct()
    full = forms.where("sort = 'full'").select("what", "rep", F.col("form").alias("meaning")).distinct()
    short = forms.where("sort in ('short', 'odd')")
    # what a short form may stand for: a listed meaning, or a longer form that it begins or is part of
    mates = short.join(full, ["what", "rep"]).where(
        F.array_contains("stands", F.col("meaning")) | ((F.col("sort") == "odd") & (F.length("form") > 2) & (F.col("meaning").contains(F.col("form")) | (F.levenshtein("meaning", "form", 2) >= 0)))
    )
    picked = mates.groupBy("what", "rep", "form", "sort").agg(F.collect_set("meaning").alias("m"))
    settled = short.join(picked, ["what", "rep", "form", "sort"], "left").select(
        "what",
        "rep",
        "form",
        "sort",
        F.when(F.size("m") == 1, F.col("m")[0]).when((F.col("m").isNull()) & (F.size("stands") == 1), F.col("stands")[0]).otherwise(F.col("form")).alias("meaning"),
    )
    known = full.select("what", "rep", F.col("meaning").alias("form"), F.lit("full").alias("sort"), "meaning").unionByName(settled).distinct()
    meanings = known.select("what", "rep", "meaning").distinct()
    letters = (
        forms.where("sort = 'letter'")
        .join(meanings, ["what", "rep"])
        .where(F.col("meaning").startswith(F.col("form")))
        .groupBy("what", "rep", "form", "sort")
        .agg(F.collect_set("meaning").alias("m"))
    )
    alone = forms.where("sort = 'letter'").join(letters.select("what", "rep", "form"), ["what", "rep", "form"], "left_anti").select("what", "rep", "form", "sort", F.concat("form", F.lit(".")).alias("meaning"))
    only = letters.where(F.size("m") == 1).select("what", "rep", "form", "sort", F.col("m")[0].alias("meaning"))
    firsts = placed.where("initials is not null and sort = 'full'").select("what", "rep", F.col("initials").alias("form"), F.col("form").alias("meaning")).distinct()
    acronyms = forms.where("sort = 'acronym'").join(firsts, ["what", "rep", "form"]).groupBy("what", "rep", "form", "sort").agg(F.collect_set("meaning").alias("m")).where(F.size("m") == 1)
    acronyms = acronyms.select("what", "rep", "form", "sort", F.col("m")[0].alias("meaning"))
    resolved = known.unionByName(only).unionByName(alone).unionByName(acronyms)
    meant = placed.join(resolved, ["what", "rep", "form", "sort"]).select("source", "name", "what", "rep", "meaning")
    return names.select("source", "key", "name").distinct().join(meant, ["source", "name"]).select("source", "key", "name", "what", "rep", "meaning").distinct()


def typed_names(contacts: DataFrame, entities: DataFrame) -> DataFrame:
    """``source, key, name, n`` of contacts that are no groups and of entities that are no addresses."""
    people = contacts.where(~F.coalesce("is_group", F.lit(False)) & F.col("jid").isNotNull()).select("jid", F.explode(F.array("push_name", "full_name")).alias("name"))
    people = people.where(F.length(F.trim("name")) > 0).groupBy("jid", "name").agg(F.count(F.lit(1)).alias("n"))
    values = entities.where(F.coalesce(F.col("entity_type") != "url", F.lit(True)) & (F.length(F.trim("entity_value")) > 0))
    values = values.groupBy("entity_value").agg(F.count(F.lit(1)).alias("n"))
    return people.select(F.lit("contact").alias("source"), F.col("jid").alias("key"), "name", "n").unionByName(
        values.select(F.lit("entity").alias("source"), F.col("entity_value").alias("key"), F.col("entity_value").alias("name"), "n")
    )


def variant_meanings(contacts: DataFrame, entities: DataFrame, nicknames: DataFrame) -> DataFrame:
    """``source, key, what, rep, meaning``: what each account or spelling means; a key may mean several things."""
    names = cut_lineage(typed_names(contacts, entities))
    lexicon = learn_lexicon(names.select("name").distinct(), contacts, nicknames)
    return cut_lineage(linked_names(names, lexicon).select("source", "key", "what", "rep", "meaning").distinct())


def variant_pairs(contacts: DataFrame, entities: DataFrame, nicknames: DataFrame) -> DataFrame:
    """``pair_kind, key_a, key_b``: accounts or spellings of one person, organisation or product.

    All pairs of one meaning are asked for; those of a very common one are made
    in parts.  ``variant_classes`` gives the same in one row a key.
    """
    linked = variant_meanings(contacts, entities, nicknames)
    pairs = pairs_within(linked, ["source", "what", "rep", "meaning"], "key", "key_a", "key_b").where(F.col("key_a") < F.col("key_b"))
    return pairs.select(F.col("source").alias("pair_kind"), "key_a", "key_b").distinct()


def variant_classes(contacts: DataFrame, entities: DataFrame, nicknames: DataFrame) -> DataFrame:
    """``pair_kind, key, class_id, n_keys``: every account or spelling that means something, the smallest one of the same meaning, and how many there are."""
    linked = variant_meanings(contacts, entities, nicknames)
    meaning = ["source", "what", "rep", "meaning"]
    classes = linked.groupBy(*meaning).agg(F.min("key").alias("class_id"), F.count(F.lit(1)).alias("n_keys"))
    return linked.join(classes, meaning).select(F.col("source").alias("pair_kind"), "key", "class_id", "n_keys").distinct()
