import numpy as np
import pytest

from threadmill.llm.names import Lexicon
from threadmill.llm.pii import Finder, expectation_maximisation, find_pii, redact

LEX = Lexicon(frozenset({"margaret", "robert", "konstantin"}), {"peggy": ("margaret",), "will": ("villiam",)}, frozenset({"studio", "foundation", "labs"}))
FINDER = Finder(LEX, frozenset("the at and with met call me on will is of order from who ask".split()))


def _spans(text, kinds):
    return {(k, text[a:b].strip(" .,;:!?<>()")) for a, b, k, votes, _ in FINDER.spans(text, True) if k in kinds and votes.count("+") > votes.count("-")}


@pytest.mark.parametrize("text,want", [("write to a.b+c@x.example.org, ok", "a.b+c@x.example.org"), ("cc a_b (at) mail.x.example please", "a_b (at) mail.x.example"), ("mail is a[at]x[dot]test", "a[at]x[dot]test"), ("write to ab at cd dot test", "ab at cd dot test")])
def test_mail_in_any_form(text, want):
    assert ("email", want) in _spans(text, {"email"})


@pytest.mark.parametrize("text,want", [("call +44 7700 900771 after", "+44 7700 900771"), ("(099) 348.3099 ext. 57 is the landline", "(099) 348.3099 ext. 57"), ("call 01 99 00 32 77", "01 99 00 32 77"), ("call 617.555.0114", "617.555.0114"), ("text me on ７１８５５５０１５６", "７１８５５５０１５６")])
def test_phones(text, want):
    found = {text[a:b] for a, b, k, votes, _ in FINDER.spans(text, True) if k == "phone"}
    assert want in {f.strip() for f in found} or want in {f.strip(" ()") for f in found}


@pytest.mark.parametrize("text,want", [("we live at 688 Venbridge Street, Flat 2 now", "688 Venbridge Street, Flat 2"), ("vivo en Calle Bob 37, 5º B", "Calle Bob 37, 5º B"), ("wohne jetzt Lattuvstr. 68a", "Lattuvstr. 68a"), ("at 15 bis, avenue Lulsep", "15 bis, avenue Lulsep"), ("drop it at 142 North Larch Court #46", "142 North Larch Court #46")])
def test_addresses(text, want):
    assert ("address", want) in _spans(text, {"address"})


def test_names():
    assert _spans("met Margaret Okaforlund and Dr. Robert K. Brennwaldt", {"name"}) == {("name", "Margaret Okaforlund"), ("name", "Dr. Robert K. Brennwaldt")}
    assert _spans("with Brennwaldt, Robert", {"name"}) == {("name", "Brennwaldt, Robert")}
    assert _spans("the Margaret Okaforlund Foundation", {"name"}) == set()
    assert _spans("will Okaforlund ask", {"name"}) == set()
    assert _spans("Margaret is at the studio", {"name"}) == set()


def test_expectation_maximisation_trusts_agreement():
    votes, counts = ["++0", "--0", "+0+", "0-+", "000"], np.array([500.0, 400, 300, 20, 50])
    likely = expectation_maximisation(votes, counts)
    assert likely[0] > 0.8 and likely[2] > 0.8 and likely[1] < 0.2 and likely[3] < likely[2]


def test_whole_operator_and_placeholders(spark):
    texts = [("call +44 7700 900771 after six", "phone", "+44 7700 900771"), ("my id is X8373275", "id_number", "X8373275"), ("write to a.b@x.example", "email", "a.b@x.example"), ("we live at 12 Foxglove Lane", "address", "12 Foxglove Lane"), ("met Margaret Okaforlund", "name", "Margaret Okaforlund")]
    filler = ["order no 9325-634 shipped", "server is 10.0.27.3", "see you at 15.15", "meeting code 2056 906", "", " ", None]
    rows = [(f"m{i}-{n}", "c", t, "n") for n in range(30) for i, t in enumerate([x[0] for x in texts] + filler)] + [("long", "c", "the day " * 20_000 + texts[0][0], None)]
    messages = spark.createDataFrame(rows, "id string, chat_jid string, text_content string, push_name string")
    contacts = spark.createDataFrame([("1@s", "Peggy", "Margaret Okaforlund", None, False, None)], "jid string, push_name string, full_name string, business_name string, is_group boolean, group_name string")
    entities = spark.createDataFrame([], "message_id string, chat_jid string, entity_type string, entity_value string")
    nick = spark.createDataFrame([("Margaret", "Peggy")], "given string, nickname string")
    found = find_pii(messages, contacts, entities, nick).cache()
    assert {(r["id"], r["pii_kind"], r["pii_text"]) for r in found.where("id like 'm%-0'").collect()} == {(f"m{i}-0", k, v) for i, (_, k, v) in enumerate(texts)}
    assert found.where("id = 'long'").count() == 1
    clean = {r["id"]: r["text_content"] for r in redact(messages, found).where("id like 'm%-0'").collect()}
    assert clean["m0-0"] == "call [PHONE] after six" and clean["m4-0"] == "met [NAME]" and clean["m5-0"] == filler[0] and clean["m11-0"] is None
    assert redact(messages, found).count() == len(rows)
    assert find_pii(messages.limit(0), contacts.limit(0), entities, nick).count() == 0


def test_names_in_push_names_are_redacted_but_not_counted(spark, monkeypatch):
    from threadmill.llm import queries

    rows = [(f"m{n}", "c", "met Margaret Okaforlund" if n < 20 else "see you", "Margaret Okaforlund" if n % 2 else "a.b@x.example") for n in range(40)]
    messages = spark.createDataFrame(rows, "id string, chat_jid string, text_content string, push_name string")
    contacts = spark.createDataFrame([("1@s", "Peggy", "Margaret Okaforlund", None, False, None)], "jid string, push_name string, full_name string, business_name string, is_group boolean, group_name string")
    entities = spark.createDataFrame([], "message_id string, chat_jid string, entity_type string, entity_value string")
    nick = spark.createDataFrame([("Margaret", "Peggy")], "given string, nickname string")
    tables = {"messages": messages, "contacts": contacts, "extracted_entities": entities, "known_nicknames": nick}
    monkeypatch.setattr(queries, "reader", lambda spark, root: tables.get)
    pushed = {r["id"]: r["push_name"] for r in queries.p7_redacted(spark, "").collect()}
    assert pushed == {f"m{n}": "[NAME]" if n % 2 else "[EMAIL]" for n in range(40)}
    counted = {(r["field_name"], r["pii_kind"]) for r in queries.p7_found(spark, "").collect()}
    assert counted == {("text_content", "name"), ("push_name", "email")}
