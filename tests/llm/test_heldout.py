"""Texts damaged in the test, of each language, judged by dictionaries that were fitted on other documents."""

from __future__ import annotations

from collections import Counter, defaultdict
from pathlib import Path

import pytest

from tapemill.llm import encodings


def read(text, written, as_):
    return "".join(bytes([b]).decode(as_, "ignore") or chr(b) for b in text.encode(written, "ignore"))


#: How the texts of a language may be damaged, besides UTF-8 read as cp1252, once or twice, and as the old codes of two systems.
OWN = {
    "ru": {"cp1251 as cp1252": lambda t: read(t, "cp1251", "cp1252"), "koi8_r as cp1251": lambda t: read(t, "koi8_r", "cp1251"), "lost": lambda t: t.encode("cp1251", "ignore").decode("utf-8", "replace")},
    "zh": {"gbk as cp1252": lambda t: read(t, "gbk", "cp1252"), "UTF-8 as gbk, lost": lambda t: encodings._RUN.sub(lambda m: m[0].encode().decode("gbk", "replace"), t)},
    "pl": {"cp1250 as cp1252": lambda t: read(t, "cp1250", "cp1252")}, "tr": {"cp1254 as cp1252": lambda t: read(t, "cp1254", "cp1252")}, "ur": {"UTF-8 as cp1256": lambda t: read(t, "utf-8", "cp1256")},
    **{k: {"cp1252 as mac": lambda t: read(t, "cp1252", "mac_roman"), "lost": lambda t: t.encode("cp1252", "ignore").decode("utf-8", "replace")} for k in ("en", "fr", "de", "es", "pt")},
}
COMMON = {"UTF-8 as cp1252": lambda t: read(t, "utf-8", "cp1252"), "twice": lambda t: read(read(t, "utf-8", "cp1252"), "utf-8", "cp1252"), "UTF-8 as mac": lambda t: read(t, "utf-8", "mac_roman"), "UTF-8 as cp437": lambda t: read(t, "utf-8", "cp437")}


@pytest.fixture(scope="module")
def halves(spark):
    path = Path("/root/testdata/sf0.1/documents.parquet")
    if not path.exists():
        pytest.skip("no test tables here")
    documents = spark.read.parquet(str(path))
    found = {r["doc_id"] for r in encodings.restored(documents).select("doc_id").collect()}
    known, letters = encodings.dictionaries(documents.where("doc_id % 2 = 0"))
    texts = defaultdict(list)
    for r in documents.where("doc_id % 2 = 1 and length(text) between 20 and 2000").select("doc_id", "lang", "text").orderBy("doc_id").collect():
        lang = (r["lang"] or "").strip().lower()
        if lang in OWN and r["doc_id"] not in found and not r["text"].isascii() and len(texts[lang]) < 40:
            texts[lang].append(r["text"])
    return encodings.Describer(known, letters), texts


def test_found_and_restored_by_language(halves):
    describer, texts = halves
    assert set(texts) == set(OWN)
    hit, right, many, false = Counter(), Counter(), Counter(), Counter()
    for lang, own in texts.items():
        for text in own:
            false[lang] += bool(describer.restore_all(encodings.sentences(text))[1])
            for name, damage in {**COMMON, **OWN[lang]}.items():
                damaged = damage(text)
                if damaged == text:
                    continue
                parts, chains = describer.restore_all(encodings.sentences(damaged))
                many[lang, name] += 1
                hit[lang, name] += bool(chains)
                right[lang, name] += "".join(parts) == text
    told = {f"{lang} {name}": (n, hit[lang, name], right[lang, name]) for (lang, name), n in sorted(many.items())}
    print(told, dict(false))
    assert sum(hit.values()) >= 0.98 * sum(many.values()), told
    assert all(n >= 0.85 * many[k] for k, n in hit.items() if many[k] >= 10), told
    whole = [k for k in many if not k[1].endswith("lost")]
    assert sum(right[k] for k in whole) >= 0.93 * sum(many[k] for k in whole), told
    assert sum(false.values()) <= 0.005 * sum(map(len, texts.values())), false
