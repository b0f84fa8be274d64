import pytest

from threadmill.llm.sentences import language_of, sentence_spans, sentences

CASES = [
    ("en", "Dr. Ames paid 3.5 EUR, i.e. less. Was it No. 7? Yes.", ["Dr. Ames paid 3.5 EUR, i.e. less.", "Was it No. 7?", "Yes."]),
    ("en", 'He wrote "No. Not today." and left. See docs.a.example now!', ['He wrote "No. Not today." and left.', "See docs.a.example now!"]),
    ("en", "1. First item here\n- second (really!) one\n[21:10] third 🙂 and more\nAnn: ok", ["1. First item here", "- second (really!) one", "[21:10] third 🙂", "and more", "Ann: ok"]),
    ("en", "It rained... but we went. Done… Next one.", ["It rained... but we went.", "Done…", "Next one."]),
    ("de", "Am 9. April kommt Fr. Prof. Dr. Kern. Das gilt z. B. für alle. „Gut. Ja“, sagte er.", ["Am 9. April kommt Fr. Prof. Dr. Kern.", "Das gilt z. B. für alle.", "„Gut. Ja“, sagte er."]),
    ("es", "—¿Vienes? —preguntó la Sra. Paz. ¡Qué bien! Falla en EE. UU. y ya.", ["—¿Vienes? —preguntó la Sra. Paz.", "¡Qué bien!", "Falla en EE. UU. y ya."]),
    ("fr", "M. Roux a dit : « Bien. » Pourquoi pas ? Voir p. 9.", ["M. Roux a dit : « Bien. »", "Pourquoi pas ?", "Voir p. 9."]),
    ("ru", "А. Б. Кот живёт на ул. Мира, д. 3. См. стр. 5 и т. д. по плану.", ["А. Б. Кот живёт на ул. Мира, д. 3.", "См. стр. 5 и т. д. по плану."]),
    ("zh", "她说：“门开了吗？我不知道。”然后走了。真的吗？！版本是2.8，快。", ["她说：“门开了吗？我不知道。”然后走了。", "真的吗？！", "版本是2.8，快。"]),
    ("ja", "「もう？知らない。」と書いた。本当に？行く！", ["「もう？知らない。」と書いた。", "本当に？", "行く！"]),
    ("th", "ดีมาก! ราคา 9.5 บาทแล้ว ใครดูแล", ["ดีมาก!", "ราคา 9.5 บาทแล้ว", "ใครดูแล"]),
    ("ar", "قال د. مردان نعم. لماذا لا؟ تم", ["قال د. مردان نعم.", "لماذا لا؟", "تم"]),
    ("hi", "डॉ. वेरकर आए। क्यों नहीं? ठीक है", ["डॉ. वेरकर आए।", "क्यों नहीं?", "ठीक है"]),
]


CASES += [
    ("en", "We chose plan B. Then the vote was closed. J. R. Ames left.", ["We chose plan B.", "Then the vote was closed.", "J. R. Ames left."]),
    ("en", "We will meet you on Sun. Bring the list. It is due at 8 a.m. On Friday we rest.", ["We will meet you on Sun.", "Bring the list.", "It is due at 8 a.m.", "On Friday we rest."]),
    ("en", "After 7 p.m. Capt. Orr joined. She was made C.E.O. She left at 9 a.m. Monday.", ["After 7 p.m. Capt. Orr joined.", "She was made C.E.O.", "She left at 9 a.m. Monday."]),
    ("en", "That is all.Between us, is it?Was it read? See www.Foo.Example/a.B today.", ["That is all.", "Between us, is it?", "Was it read?", "See www.Foo.Example/a.B today."]),
    ("en", "Hier sind wir.\nEr kommt am 9. April zu uns. Ja.\nThe end of it.", ["Hier sind wir.", "Er kommt am 9. April zu uns.", "Ja.", "The end of it."]),
    ("de", "Wir treffen uns am So. Bitte kommt. Es kostet 5,56. Mail genügt.", ["Wir treffen uns am So.", "Bitte kommt.", "Es kostet 5,56.", "Mail genügt."]),
    ("es", "La cena es a las 5 h. Luego vamos. solo dijo: «Vale.» nos vemos", ["La cena es a las 5 h.", "Luego vamos.", "solo dijo: «Vale.»", "nos vemos"]),
    ("ru", "В 2020 г. Он приехал в г. Омск. Ждут 4 тыс. чел. сразу.", ["В 2020 г.", "Он приехал в г. Омск.", "Ждут 4 тыс. чел. сразу."]),
]


@pytest.mark.parametrize("lang,text,want", CASES)
def test_languages(lang, text, want):
    assert [text[a:b] for a, b in sentence_spans(text, lang)] == want


def test_spans_hold_all_text_but_outer_space():
    for _, text, _ in CASES:
        spans = sentence_spans("  " + text + " \n")
        joined = "".join(("  " + text)[a:b] for a, b in spans)
        assert "".join(joined.split()) == "".join(text.split())
        assert all(a < b for a, b in spans) and all(p[1] <= q[0] for p, q in zip(spans, spans[1:]))


def test_no_sentence_in_blank_texts(spark):
    df = spark.createDataFrame([(1, None, None), (2, "", "en"), (3, " \n ", "EN"), (4, "Hi. You.", None), (4, "Hi. You.", None)], "doc_id bigint, text string, lang string")
    found = sorted((r["doc_id"], r["sent_no"], r["start_pos"], r["end_pos"]) for r in sentences(df).collect())
    assert found == [(4, 1, 0, 3), (4, 1, 0, 3), (4, 2, 4, 8), (4, 2, 4, 8)]
    assert sentences(df.limit(0)).count() == 0


def test_very_long_text():
    assert len(sentence_spans("This is one. " * 20_000)) == 20_000


def test_language_is_told_from_the_text():
    assert language_of("the cat is on the table and we will go", "ja") == "en"
    assert language_of("die Katze ist auf dem Tisch und wir", None) == "de"
    assert language_of("кот на столе", "en") == "ru"


#: Sentences none of whose nouns, names or verbs stand in a rule table; joined in all orders they must come apart again.
PLANTED = {
    "en": ["Mrs. Quill repaired the turbine vs. all odds.", "Does the ladder fold?", "See Fig. 4 and pp. 7-9 of the atlas.", 'The pilot whispered "Hold on. Wait." and jumped.', "Rust cost approx. 3.5 million, i.e. plenty.", "Velvet shrank... but linen held!", "It ships to Harlow Ltd. for repair at 9 p.m.", "Magnets (see vol. 2) repel.", "K. L. Brandt sold no. 12 quietly.", "(Ask the clerk first.)"],
    "de": ["Hr. Brandner schweißte Nr. 7 am 3. Juni.", "Faltet sich die Leiter?", "Das gilt u. a. für Magnete bzw. Spulen.", "„Halt! Warte“, rief Jutta.", "Samt schrumpfte usw. recht schnell.", "Es kostete ca. 3,5 Mio. Taler!", "Vgl. Abb. 4 im Atlas."],
    "es": ["El Dr. Quiroga soldó la turbina n.º 7.", "¿Se pliega la escalera?", "Costó aprox. 3,5 duros, p. ej. ayer.", "«¡Alto! Espera», gritó Jimena.", "El tren sale a las 9:30 h. y vuelve pronto.", "Véase la pág. 4 del atlas.", "Terciopelo... y lino también."],
    "fr": ["Mme Quillard soude la turbine no 7.", "L'échelle se plie-t-elle ?", "« Halte ! Attends », crie Josette.", "Voir p. 4, art. 2 du registre.", "Le velours coûte env. 3,5 écus, etc.", "M. Brandet vend tout !"],
    "pt": ["A Dra. Quintela soldou a turbina n.º 7.", "A escada dobra?", "Disse “Alto. Espera.” e saltou.", "Ver pág. 4 do atlas.", "A Vidros Lda. vendeu tudo!", "Veludo... e linho também."],
    "ru": ["Проф. Квинт чинит насос.", "Лестница складная?", "«Стой! Жди», — крикнула Жанна.", "См. рис. 4 и т. п. в атласе.", "Бархат стоил 3,5 тыс. руб. вчера!", "К. Л. Брандт живёт на ул. Цветочной, д. 7."],
    "zh": ["他喊：“停！等等。”然后跳了下去。", "梯子能折叠吗？", "丝绒缩水了……但亚麻没有。", "价格是3.5元，真贵！"],
    "ja": ["「止まれ！待て。」と彼は叫んだ。", "はしごは畳めますか？", "値段は3.5倍です！", "ビロードは縮んだ。"],
    "ar": ["قال د. كوينت إن المضخة تعمل.", "هل السلم قابل للطي؟", "انظر ص. 4 من الأطلس.", "كتبت \"قف. انتظر.\" ثم قفزت!"],
    "hi": ["डॉ. क्विंट ने पंप सुधारा।", "क्या सीढ़ी मुड़ती है?", "पृ. 4 पर नक्शा है।", "मखमल सिकुड़ गया!"],
    "th": ["ดร. ควินต์ซ่อมปั๊มแล้ว", "บันไดพับได้ไหม?", "ราคา 3.5 เท่า!", "กำมะหยี่หดลง"],
}


@pytest.mark.parametrize("lang", PLANTED)
def test_planted_sentences_are_found(lang):
    planted, found, hits = 0, 0, 0
    parts = PLANTED[lang]
    for first in parts:
        for second in parts:
            for third in parts:
                text = " ".join((first, second, third))
                a, b = len(first), len(first) + 1 + len(second)
                want = {(0, a), (a + 1, b), (b + 1, len(text))}
                got = set(sentence_spans(text, lang))
                planted, found, hits = planted + 3, found + len(got), hits + len(got & want)
    assert hits / planted >= 0.97 and hits / found >= 0.97, (hits / planted, hits / found)


def test_stray_quotes_cost_no_more_than_their_line():
    line = "a “ b. " * 4_000
    assert len(sentence_spans(line + "\nOne. Two.")) > 2
