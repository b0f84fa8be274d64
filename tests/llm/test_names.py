import itertools
import random

from threadmill.llm.names import Lexicon, _spelled_alike, variant_classes, variant_pairs
from threadmill.llm.spelling import edits, segment_join, tokens_of


def test_edits_with_swaps():
    assert edits("abcd", "abdc", 1) == 1 and edits("abcd", "abc", 1) == 1 and edits("abcd", "badc", 1) == 2 and edits("kitten", "sitting", 3) == 3 and edits("", "ab", 1) == 2


def test_segment_join_against_brute_force(spark):
    rng = random.Random(4)
    words = {"".join(rng.choice("abc") for _ in range(rng.randint(3, 9))) for _ in range(250)} | {"ab", ""}
    df = spark.createDataFrame([(w,) for w in words] + [(None,), ("abcabc",)], "s string")
    words |= {"abcabc"}
    for k in (1, 2):
        want = {(a, b) for a, b in itertools.combinations(sorted(words), 2) if min(len(a), len(b)) > 2 * k and edits(a, b, k) <= k}
        assert {(r["a"], r["b"]) for r in segment_join(df, "s", k).collect()} == want


def test_tokens():
    assert tokens_of("Dr. Zoé  MÜLLER-Okafor (work) +49 30 123456") == ["zoe", "muller", "okafor"]
    assert tokens_of("Okafor, Zoé 🌙") == ["zoe", "okafor"]
    assert tokens_of("ВИНКЕНТ Сакс") == tokens_of("Vincent Sax")
    assert tokens_of("zoe.okafor zoe@x.example") == ["zoe", "okafor"] and tokens_of(None) == [] and tokens_of("🌙 .") == []


def test_reading():
    lex = Lexicon(frozenset({"margaret", "robert"}), {"peggy": ("margaret",)}, frozenset({"studio", "labs"}))
    assert lex.read("Margaret Okafor", True)[:4] == ("person", "okafor", "margaret", "full")
    assert lex.read("Okafor Peggy", True)[:4] == ("person", "okafor", "peggy", "short")
    assert lex.read("Margarte Okafor", True)[:4] == ("person", "okafor", "margaret", "full")
    assert lex.read("okafor m.", True)[:4] == ("person", "okafor", "m", "letter")
    assert lex.read("Okafor Studio", True)[:3] == ("thing", "okafor", "studio")
    assert lex.read("Okaforstudio", False)[:3] == ("thing", "okafor", "studio")
    assert lex.read("Margaret", True) is None and lex.read("🌙", True) is None


def test_pairs(spark):
    names = ["Margaret", "Robert", "Helena", "Victor", "Oliver"]
    families = ["Okaforlund", "Brennwaldt", "Tessingham", "Quillmonte", "Dravenhold", "Ostrander", "Pellworth", "Kimbrough"]
    rows = [(f"{i}@s", f"{g} {f}", None, None, False, None) for i, (g, f) in enumerate(itertools.product(names, families))]
    rows += [("x1@s", "okaforlund, margaret 🌙", None, None, None, None), ("x2@s", "Peggy Okaforlund", "Peggy", None, False, None), ("x3@s", "M. Okafrolund", None, None, False, None), ("x4@s", "Margaret", None, None, False, None), ("g@g", "Margaret Okaforlund", None, None, True, None), ("x5@s", None, "", None, False, None)]
    contacts = spark.createDataFrame(rows, "jid string, push_name string, full_name string, business_name string, is_group boolean, group_name string")
    entities = spark.createDataFrame([("m", "c", "tech", v) for v in ("RegnexCloud", "Regnex-Cloud", "regnexcloud.js", "RegnexCloud 3", "NumvisDB")] + [("m", "c", "url", "https://regnexcloud.example")] + [("m", "c", "org", v) for v in ("Tazfetzer Health", "Health Tazfetzer", "Tazfetzer Studio", "Tazfetezr Health Ltd")], "message_id string, chat_jid string, entity_type string, entity_value string")
    nick = spark.createDataFrame([("Margaret", "Peggy")], "given string, nickname string")
    found = {(r["pair_kind"], r["key_a"], r["key_b"]) for r in variant_pairs(contacts, entities, nick).collect()}
    same = ["0@s", "x1@s", "x2@s", "x3@s"]
    tech = ["RegnexCloud", "Regnex-Cloud", "regnexcloud.js", "RegnexCloud 3"]
    org = ["Tazfetzer Health", "Health Tazfetzer", "Tazfetezr Health Ltd"]
    want = {("contact", a, b) for a, b in itertools.combinations(sorted(same), 2)} | {("entity", *sorted(p)) for group in (tech, org) for p in itertools.combinations(group, 2)}
    assert found == want
    assert variant_pairs(contacts.limit(0), entities.limit(0), nick).count() == 0
    classes = [tuple(r) for r in variant_classes(contacts, entities, nick).collect()]
    of = {}
    for kind, key, class_id, n in classes:
        of.setdefault((kind, class_id, n), set()).add(key)
    assert all(len(keys) == n and min(keys) == class_id for (_, class_id, n), keys in of.items())
    assert set(same) in of.values() and set(tech) in of.values() and set(org) in of.values()


def test_misspelt_given_names_are_looked_up():
    rng = random.Random(6)
    given = {"".join(rng.choice("abcde") for _ in range(rng.randint(4, 8))) for _ in range(120)}
    lex = Lexicon(frozenset(given), {}, frozenset())
    for _ in range(400):
        token = "".join(rng.choice("abcde") for _ in range(rng.randint(4, 8)))
        close = [g for g in given if edits(g, token, 1) <= 1]
        assert lex._near(token) == (min(close) if close else None)


def test_spellings_follow_the_whole_chain(spark):
    # each within one edit of the next, ever more frequent
    chain = ["brandon", "brandan", "brandax", "brantax", "brantix", "krantix"]
    cores = spark.createDataFrame([("person", c, i + 1) for i, c in enumerate(chain)] + [("person", "unlike", 9)], "what string, core string, n bigint")
    assert {r["core"]: r["rep"] for r in _spelled_alike(cores, 1).collect()} == {c: "krantix" for c in chain[:-1]}
