"""Misread texts of other scripts that stand without blanks beside Latin names and symbols."""

from __future__ import annotations

import random

from tapemill.llm import encodings

ZH = ["更正：{s}收盘价为{n}.38，成交量超过{n}股。", "{c}于2026-03-21公布了季度业绩，净利润较去年有所上升。", "据了解，数据检查发现{n}行记录有误，已在次日更正。", "{c} ({s}), reported on 2026-03-21 for the year then ended: 净利润上升 {n}"]
RU = ["Биржа приостановила торги {s} до публикации недостающих сведений {n}.", "Компания {c}сообщила о завершении проверки отчётности {n}."]
ES = ["La compañía {c} comunicó que su emisión {n} quedó suspendida.", "Según la compañía, {s} cerró la sesión en {n}."]


def line(r, forms):
    return r.choice(forms).format(s="".join(r.choices("QBDLMKTX", k=5)), n=r.randint(1, 9999), c=r.choice(["Orcas Polymers Limited", "Caske Steel Ltd", "Pedita Leasing Limited"]))


def test_joined_and_sparse_texts_are_restored(spark):
    r = random.Random(3)
    rows, want = [], {}
    kinds = [("zh", ZH, "gbk", "latin-1"), ("ru", RU, "cp1251", "latin-1"), ("es", ES, "cp1252", "mac_roman")]
    for i in range(900):
        lang, forms, _, _ = kinds[i % 3]
        rows.append((i, "\n".join(line(r, forms) for _ in range(3)), lang))
    # Few of each language: what many of its texts have counts as its letters.
    for lang, forms, written, read in kinds:
        for form in forms:
            want[len(rows)] = line(r, [form])
            rows.append((len(rows), want[len(rows)].encode(written).decode(read), lang))
    got = {g["doc_id"]: g["restored"] for g in encodings.restored(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()}
    assert got == want


def test_any_sentence_has_its_double_byte_candidates(spark):
    describer = encodings.Describer({"zh": "".join(f.format(s="", n=1, c="") for f in ZH).encode()}, {"zh": "".join(sorted({c for f in ZH for c in f if c > "\x7f"}))})
    for form in ZH:
        text = form.format(s="QBDLD", n=7, c="Orcas Polymers Limited")
        assert text in {new for _, new, _ in describer.candidates(text.encode("gbk").decode("latin-1"))}


def test_what_stands_for_lost_bytes_is_described_too(spark):
    r = random.Random(6)
    marks = ["The loader marks lost bytes with “\ufffd” in row {n}.", "A “\ufffd” stands for a lost byte, {n} times."]
    rows = [(i, "\n".join([line(r, ES), line(r, ES)]) if i % 2 else f"The board of {i} “met” – and put off its decision.", "es" if i % 2 else "en") for i in range(600)]
    rows += [(1000 + i, m.format(n=i), "en") for i, m in enumerate(marks)]
    damaged = {2000 + i: line(r, ES) for i in range(4)}
    rows += [(i, t.encode("cp1252").decode("utf-8", "replace"), "es") for i, t in damaged.items()]
    got = {g["doc_id"]: g for g in encodings.restored(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()}
    assert set(got) == set(damaged)
    assert all(g["status"] == "lossy" and g["chains"] == ["lost>es"] and g["restored"] == damaged[i] for i, g in got.items())


def test_every_language_has_its_dictionary(spark):
    names = [f"{a}{b}" for a in "abcdefgh" for b in "vwxyz"]
    rows = [(i, f"{name} élan n° {i} über", f" {name.upper()}-XX ") for i, name in enumerate(names * 12)]
    known, letters = encodings.dictionaries(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert set(known) == set(letters) == set(names)
