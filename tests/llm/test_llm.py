"""Containers (P8), mixtures (P9) and repaired encodings (P10)."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from tapemill.llm import encodings, mixture, packing
from tapemill.llm.tokens import encoder

WORDS = "the board of the company met and put off its decision on the interim payout until next quarter market closed higher".split()


def texts(seed, n):
    r = random.Random(seed)
    return [" ".join(r.choice(WORDS) for _ in range(r.choice([3, 20, 60, 300]))) for _ in range(n)]


def documents(spark, rows):
    return spark.createDataFrame([(i, t, s, "clash", 1) for i, (t, s) in enumerate(rows)], "doc_id bigint, text string, source string, tokens string, piece int")


def test_hilbert_neighbours_differ_by_one_step():
    cells = np.array(np.meshgrid(*[np.arange(8)] * 3)).reshape(3, -1).T
    keys = packing.hilbert_keys(cells, 3)
    assert sorted(keys) == list(range(512))
    ordered = cells[np.argsort(keys)]
    assert (np.abs(np.diff(ordered, axis=0)).sum(axis=1) == 1).all()


def test_packing(spark):
    rows = [(t, None) for t in texts(1, 400)] + [(None, None), ("", None), ("x " * 5000, None), ("\ud800 lone".encode("utf-8", "replace").decode(), None)] + [("same text", None)] * 300
    docs = documents(spark, rows)
    specs = spark.createDataFrame([(1, "a", 64), (2, "b", 1024), (3, "none", 0), (4, "null", None)], "spec_id int, spec_name string, capacity_tokens int")
    got = packing.pack(docs, specs).collect()
    sizes = {i: len(encoder().encode_ordinary(t or "")) for i, (t, _) in enumerate(rows)}
    for spec, capacity in ((1, 64), (2, 1024)):
        own = [g for g in got if g["spec_id"] == spec]
        total, pieces = Counter(), defaultdict(list)
        for g in own:
            total[g["container_id"]] += g["tokens"]
            pieces[g["doc_id"]].append(g["tokens"])
        assert max(total.values()) <= capacity
        assert {d: sum(p) for d, p in pieces.items()} == sizes
        assert all(len(p) == max(1, -(-sizes[d] // capacity)) for d, p in pieces.items())
        assert sum(sizes.values()) / (len(total) * capacity) > 0.9
    assert {g["spec_id"] for g in got} == {1, 2}
    filled = {r["spec_id"]: r for r in packing.fill(packing.pack(docs, specs)).collect()}
    assert filled[2]["tokens"] == sum(sizes.values())


def test_packing_nothing(spark):
    specs = spark.createDataFrame([(1, "a", 64)], "spec_id int, spec_name string, capacity_tokens int")
    assert packing.pack(documents(spark, []), specs).count() == 0
    assert packing.pack(documents(spark, [("x", None)]), specs.limit(0)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 65, 1000])
def test_permutations(n):
    index = np.arange(n)
    seen = [mixture.permuted(index, np.full(n, n), np.full(n, k)) for k in (1, 2)]
    assert all(sorted(s) == list(index) for s in seen)
    assert n < 10 or not np.array_equal(seen[0], seen[1])


def test_quotas():
    assert mixture.quotas({"a": 100, "b": 10}, {"a": 0.5, "b": 0.5}, {"a": 1, "b": 3}) == {"a": 30, "b": 30}
    assert mixture.quotas({"a": 100}, {"a": 0.5, "b": 0.5}, {"a": 2, "b": 3}) == {"a": 200}
    assert mixture.quotas({}, {"a": 1.0}, {"a": 2}) == {}
def test_shards_draw_all_slots_once():
    q = np.array([5000, 2500, 1])
    rows = list(mixture.shard_draws(q, 0, 10**9))
    assert [r[0] for r in rows] == list(range(8)) and {int(k.sum()) for _, _, k in rows} <= {937, 938}
    assert (sum(k for _, _, k in rows) == q).all()
    assert (np.cumsum([k for _, _, k in rows], axis=0)[:-1] == [f for _, f, _ in rows][1:]).all()
    for a, b in ((0, 3), (3, 4), (5, 8)):  # a task draws the same as all others do
        assert str(list(mixture.shard_draws(q, a, b))) == str(rows[a:b])
    counts = np.array([k for _, _, k in mixture.shard_draws(np.array([600_000, 400_000]), 0, 10**9)])
    assert 0.5 < counts[:, 0].std() / np.sqrt(1024 * 0.24) < 1.5  # as of a multinomial, not the same in every shard


def test_shards_of_a_very_large_mixture():
    q = np.array([120_000_000_000, 79_999_999_999, 7, 2_000_000_000])
    shards = mixture.shard_total(int(q.sum()))
    for a in (0, 12_345_678, shards - 3):
        rows = list(mixture.shard_draws(q, a, a + 3))
        assert [r[0] for r in rows] == [a, a + 1, a + 2] and all(1023 <= k.sum() <= 1025 and (k >= 0).all() and (f + k <= q).all() for _, f, k in rows)
        assert all((f + k == g).all() for (_, f, k), (_, g, _) in zip(rows, rows[1:], strict=False))
        assert all(abs(f - q * (s / shards)).max() < 2e6 for s, f, _ in rows)  # the shares hold all along


def test_mixture(spark):
    r = random.Random(2)
    rows = [(t, r.choice(["big", "big", "big", "small", "other", None])) for t in texts(3, 500)] + [(None, "big"), ("", "small")]
    docs = documents(spark, rows)
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.4, 2), ("absent", 0.1, 5)], "source string, target_share double, max_repeats int")
    got = mixture.mix(docs, targets, block=32).collect()
    times = Counter((g["source"], g["block_index"]) for g in got)
    caps = {"big": 1, "small": 2}
    assert all(n <= caps[s] for (s, _), n in times.items())
    slots = Counter(g["source"] for g in got)
    assert abs(slots["big"] / len(got) - 0.5 / 0.9) < 1 / len(got) + 1e-9
    assert all(g["n_tokens"] == len(g["tokens"]) == 32 for g in got if g["n_tokens"] == 32) and sum(g["n_tokens"] < 32 for g in got) <= 3
    again = mixture.mix(docs, targets, block=32).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))  # the same draw each time
    shown = {s["source"]: s for s in mixture.shares(mixture.mix(docs, targets, block=32), targets).collect()}
    assert all(r["capped"] and r["shared"] for r in mixture.held(mixture.shares(mixture.mix(docs, targets, block=32), targets)).collect())
    assert shown["absent"]["slots"] == 0 and shown["small"]["most_repeats"] <= 2 and abs(sum(s["actual_share"] for s in shown.values()) - 1) < 1e-9


def test_blocks_hold_every_token_once(spark):
    rows = [(t, s) for t, s in zip(texts(4, 200), ["a", "b"] * 100, strict=True)]
    blocks = mixture.token_blocks(documents(spark, rows), block=48, buckets=5).collect()
    for s in "ab":
        own = sorted((b for b in blocks if b["source"] == s), key=lambda b: b["block_index"])
        assert [b["block_index"] for b in own] == list(range(len(own)))
        assert all(b["n_tokens"] == 48 for b in own[:-1])
        want = Counter(x for t, source in rows if source == s for x in encoder().encode_ordinary(t))
        assert Counter(x for b in own for x in b["tokens"]) == want
        whole = defaultdict(list)
        for b in own:
            for d, start, end in zip(b["doc_ids"], b["doc_starts"], [*b["doc_starts"][1:], b["n_tokens"]], strict=True):
                whole[d] += b["tokens"][start:end]
        assert all(encoder().decode(whole[i]) == t for i, (t, source) in enumerate(rows) if source == s)


def test_no_mixture(spark):
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    assert mixture.mix(documents(spark, []), targets).count() == 0
    assert mixture.mix(documents(spark, [("x", "a")]), targets.limit(0)).count() == 0


SOUND = {
    "fr": ["Les échanges ont été suspendus dès l’ouverture, à la demande de l’émetteur. Année {}.", "Le marché reste prudent, où les volumes n’ont guère dépassé {} titres."],
    "de": ["Höhere Strompreise drückten das Ergebnis, während Rücklagen aufgelöst wurden: {}.", "Die Börse bestätigte, dass die Aktie künftig im Hauptsegment geführt wird ({})."],
    "ru": ["Компания сообщила {} о завершении проверки отчётности за прошлый год.", "Биржа приостановила торги до публикации недостающих сведений {}."],
    "en": ["The fund’s trustee re-read “the gap” between bid and offer – {} units at 39 °C.", "│   └── rejected/A{}.csv  25 rows"],
}
DAMAGE = {"cp1252": lambda t: read(t.encode(), "cp1252"), "mac": lambda t: read(t.encode(), "mac_roman"), "cp437": lambda t: read(t.encode(), "cp437"), "twice": lambda t: read(read(t.encode(), "cp1252").encode(), "cp1252")}


def read(data, encoding):
    return "".join(bytes([b]).decode(encoding, "ignore") or chr(b) for b in data)


def test_steps_undo_damage():
    for t in (x.format(7) for own in SOUND.values() for x in own):
        assert encodings.reread_utf8(DAMAGE["cp1252"](t), "cp1252") == t
        assert encodings.reread_utf8(t.encode().decode("latin-1"), "cp1252") == t
        assert encodings.reread_utf8(t, "cp1252") == t
    assert encodings.reread_bytes("Ïðèâåò", "cp1252", "cp1251") == "Привет"


def test_sentences_join_to_the_text():
    for t in ("a. b\n\nc? d", "", "x", "一。二！", "a.b", "\n", "end. "):
        assert "".join(encodings.sentences(t)) == t


def test_misread_texts_are_found_and_restored(spark):
    r = random.Random(8)
    rows, want = [], {}
    for _ in range(700):
        lang = r.choice(list(SOUND))
        text = "\n".join(r.choice(SOUND[lang]).format(r.randint(1, 9999)) for _ in range(3))
        damaged = text
        if r.random() < 0.1:
            whole = r.random() < 0.5
            damage = DAMAGE[r.choice(list(DAMAGE))]
            damaged = damage(text) if whole else "\n".join([*text.split("\n")[:2], damage(text.split("\n")[2])])
            want[len(rows)] = text
        rows.append((len(rows), damaged, lang if r.random() < 0.95 else None))
    rows += [(1000, None, "en"), (1001, "", "en"), (1002, "a � b", "en"), (1003, "Ÿ unusual ß þ but sound ∑ ≈ ∆", "en"), (1004, rows[next(iter(want))][1], "de")]
    want |= {1002: None, 1004: want[next(iter(want))]}
    df = spark.createDataFrame([(*x, "clash") for x in rows], "doc_id bigint, text string, lang string, status string")
    got = {g["doc_id"]: g for g in encodings.restored(df).collect()}
    assert set(got) - set(want) == set()
    assert len(set(want) & set(got)) >= 0.97 * len(want)
    right = [g["restored"] == want[i] for i, g in got.items() if want[i]]
    assert sum(right) >= 0.95 * len(right)
    assert got[1002]["status"] == "lossy" and all(g["status"] == "restored" for i, g in got.items() if i != 1002)


def test_no_texts(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string, lang string")
    assert encodings.restored(df).count() == 0
    assert encodings.restored(spark.createDataFrame([(1, "é", None)], df.schema)).count() == 0
