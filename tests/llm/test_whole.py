"""Dictionaries, letters and phrases count every text, however many and long there are."""

from __future__ import annotations

from tapemill.llm import encodings


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string")


def test_letters_are_counted_over_all_texts(spark):
    just, under = "àâçéèêëîïô", "ùûüÿœæñõøå"
    texts = [f"Le marché {i}. " + "".join(f"n{c} " for c in (just if i < 30 else "") + (under if 970 < i else "")) for i in range(1000)]
    _, letters = encodings.dictionaries(frame(spark, [(i, t, "fr") for i, t in enumerate(texts)]))
    assert letters == {"fr": "".join(sorted(just))}  # 30 of 1,000 texts have these, 29 the others


def test_long_texts_teach(spark):
    known, letters = encodings.dictionaries(frame(spark, [(i, "Der Börsenhandel ruht. " * 500, "de") for i in range(4)]))
    assert "Der Börsenhandel ruht. " in known["de"].decode() and letters == {"de": "ö"}


def test_phrases_are_counted_at_every_place(spark):
    rows = [(i, "Un café noir. " * (1 + (i % 4 == 0)) + f"Le thé {i}.", "fr-CH" if i % 2 else " FR ") for i in range(2000)] + [(2000, "Un cafÃ© noir.", "fr"), (2001, "Un caf� noir.", "fr")]
    known, _, phrases = encodings.models(frame(spark, rows))
    counts = {x[:3]: x[3] for x in phrases["fr"]}
    assert counts["Un ", "café ", "noir. "] == 2500
    assert sum(n for x, n in counts.items() if x[1] == "thé ") == 2000
    assert encodings.Describer(known, {"fr": "é"}, phrases).between("fr", "af", " n", 1) == "é"


def test_what_is_filled_in_is_what_all_texts_have_most(spark):
    # Of two equally common kinds of phrase the one with fewer forms is the more frequent at its places.
    rows = [(i, f"Prix {'élevé' if i % 10 < 7 else 'ôlevé'} {'stable' if i % 10 < 7 else 'abcdefghij'[i // 10 % 10] * 5}.", "fr") for i in range(1000)]
    known, letters, phrases = encodings.models(frame(spark, rows))
    assert encodings.Describer(known, letters, phrases).fill("Prix �levé", "fr") == "Prix élevé"


def test_a_misread_phrase_does_not_describe_itself(spark):
    text = "Торги приостановлены до утра."
    rows = [(i, text, "ru") for i in range(40)] + [(100 + i, text.encode("koi8_r").decode("cp1251"), "ru") for i in range(3)]
    got = {g["doc_id"]: g["restored"] for g in encodings.restored(frame(spark, rows)).collect()}
    assert got == {100 + i: text for i in range(3)}


def test_no_break_spaces_are_blanks_however_rare(spark):
    rows = [(i, f"Según el boletín, la suspensión terminará pronto: {i}.", "es") for i in range(400)] + [(i, f"Już rząd wyjaśnił, że opóźnienie trwa: {i}. Zęby bolą ŻÓŁĆ Ę.", "pl") for i in range(400, 800)]
    rows += [(1000 + i, f"Según\xa0el\xa0boletín,\xa0la\xa0suspensión terminará pronto: {i}.", "es") for i in range(4)]
    assert encodings.restored(frame(spark, rows)).count() == 0
