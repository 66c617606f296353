"""Texts read in a wrong character encoding: found and restored by minimum description length.

A text is taken apart into sentences. For each, candidate decodings are made, step by step: the characters are turned
back into the bytes of the encoding they were read in, and these are read in another. The length of a candidate is its
size under zstandard with a dictionary of a language (the best of those whose letters it uses) plus the cost of the
steps; the shortest wins, and the text stays as it is unless a chain makes it shorter by more than it costs.

Characters that stand for lost bytes are described like others: a further step fills them with what the language has in such
a place, or drops them where it has nothing, and must pay for itself too.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter, deque
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import repeat

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapemill.llm.tokens import sound, spread

#: Encodings in which UTF-8 may have been read. Where one leaves a byte undefined, the control character stands for it.
READ_AS = ("cp1252", "mac_roman", "cp437", "cp850", "cp1251", "cp1250", "cp1254", "cp1256", "cp852", "cp866", "koi8_r", "cp1253", "cp1255", "cp1257", "cp1258", "mac_cyrillic", "iso8859_2", "iso8859_5", "iso8859_9", "iso8859_15")
#: Pairs of single-byte encodings: (that it was read in, that it was written in).
CONFUSED = tuple(
    (read, written)
    for written, reads in {
        "cp1252": ("mac_roman", "cp437", "cp850", "cp1251", "cp1250", "cp1256", "cp866", "koi8_r", "cp1253"),
        "mac_roman": ("cp1252", "cp437"), "cp437": ("cp1252", "cp1251"), "cp850": ("cp1252", "cp1251"),
        "cp1251": ("cp1252", "mac_roman", "koi8_r", "cp866", "cp437", "cp1250", "iso8859_5"), "koi8_r": ("cp1252", "cp1251", "cp866"), "cp866": ("cp1252", "cp1251", "koi8_r"),
        "cp1250": ("cp1252", "mac_roman", "cp437", "cp1251", "cp1254"), "cp1254": ("cp1252", "mac_roman", "cp437", "cp1250", "cp1251"), "cp1256": ("cp1252", "mac_roman", "cp1251", "cp437"),
        "iso8859_2": ("cp1252", "cp1250"), "cp852": ("cp1252", "cp1250"),
    }.items()
    for read in reads
)
#: Double-byte encodings that may have been read in a single-byte one, and in which UTF-8 may have been read. They are tried
#: where a language of the texts is written in them.
DOUBLE_BYTE = ("gbk", "big5", "shift_jis", "euc_jp", "euc_kr")
CONFUSED += tuple((read, written) for written in DOUBLE_BYTE for read in ("cp1252", "cp1251", "mac_roman", "cp437"))
#: Bytes that a step must save. Sound text is hardly ever valid UTF-8 in disguise, so that step costs less, and least
#: by the commonest way.
STEP_COST = {"cp1252>utf_8": 0.5, "utf_8": 1, "other": 5}
#: Bytes that tell what fills the place of lost bytes, and that they are dropped, for each place.
FILL_COST, DROP_COST = 0.5, 8
#: What stands for lost bytes.
LOST = "\ufffd"
#: Languages that fill it: those that describe the rest of the sentence best.
FILL_LANGUAGES = 2
#: Characters before and after such a place that a language must have around what fills it; the first that are found decide.
CONTEXTS = ((3, 3), (2, 2), (0, 3), (3, 0), (1, 1))
#: Bytes that each character which UTF-8 in disguise takes up in vain tells against chance, up to eight of them.
EVIDENCE = 0.25
#: Share of a language's texts that must have a character for it to be one of the language's letters.
COMMON = 0.03
#: Bytes that a symbol, or a letter, in no language's letters costs more.
STRANGE_COST = (4, 8)
#: Bytes that a capital after a small letter, either beyond ASCII, costs more.
CASE_COST = 3
#: Bytes that tell that a text is in capitals throughout.
CAPITALS_COST = 1
#: Bytes that a Cyrillic or Arabic letter beside a Latin one costs more. Chinese and Japanese need no blank there.
MIXED_COST = 4
#: Steps of a chain, and chains that a further step is tried on.
MOST_STEPS, BEAM = 3, 8
#: Share of the distinct characters beyond ASCII that must be a language's own for it to describe a text.
FAMILIAR = 0.8
#: A dictionary's size. Every language has its dictionary; with more than ``FULL_LANGUAGES`` of them all have less, so that
#: they stay bounded together.
DICTIONARY_BYTES, FULL_LANGUAGES = 131_072, 32
#: So many times as frequent as a phrase is what it was misread from.
FAR_MORE = 4
#: Counts that a task holds before it hands them on.
HELD_COUNTS = 300_000
LEVEL = 6
#: At this level no match begins in the last 16 bytes, which would make a sentence's end dear by chance; these stand there.
TAIL = bytes(range(1, 17))

_UTF8 = re.compile("(?<![\x80-\xff])(?:[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3})+(?![\x80-\xff])")
_SENTENCE = re.compile(r"[^\n]*?(?:[.!?:;](?:\s+|$)|[。！？]|\n|$)")
#: They begin with what is rare, so that most places are passed over at once.
_CASE = re.compile("[À-ÖØ-ÞА-ЯЁ](?<=[a-zà-öø-ÿа-яё].)|[à-öø-ÿа-яё][A-Z]")
_MIXED = tuple(re.compile(p) for p in ("[\u0400-\u04ff\u0600-\u06ff](?=[A-Za-z])", "[\u0400-\u04ff\u0600-\u06ff](?<=[A-Za-z].)"))
_RUN = re.compile("([^\x00-\x7f]+)")
_DIGIT = re.compile("[0-9]")
#: Words with their blank, bounded in length, and the characters of scripts that are written without blanks.
_TOKEN = re.compile("[^\\s\u2e80-\U0010ffff]{1,24}\\s?|[\u2e80-\U0010ffff]|\\s")
_UNSOUND = re.compile(f"[\x80-\x9f{LOST}]")
#: Three words of a text, nothing standing before its first and after its last, and how often they are.
Phrase = tuple[str, str, str, int]
_FOREIGN = ""


@lru_cache(None)
def _characters(encoding: str) -> dict[int, str]:
    return {} if encoding in DOUBLE_BYTE else {b: bytes([b]).decode(encoding, "ignore") or chr(b) for b in range(0x80, 0x100)}


@lru_cache(None)
def _to_bytes(encoding: str) -> dict[int, str]:
    """Each character to the one whose code is its byte; other characters below 256 to one that is no byte."""
    table = {c: _FOREIGN for c in range(0x80, 0x100)}
    if encoding == "cp1252":  # also what Latin-1 makes of the bytes in which the two differ
        table |= {c: chr(c) for c in range(0x80, 0xA0)}
    return table | {ord(ch): chr(b) for b, ch in _characters(encoding).items()}


def _wide(char: str) -> bool:
    return char >= "\u2e80" and char != LOST


@lru_cache(200_000)
def _run_as_utf8(run: str, read: str) -> str:
    if read in DOUBLE_BYTE:
        try:
            return run.encode(read).decode("utf-8")
        except UnicodeError:
            return run
    disguised = run.translate(_to_bytes(read))
    out, at = [], 0
    for m in _UTF8.finditer(disguised):
        try:
            decoded = m[0].encode("latin-1").decode("utf-8")
        except UnicodeDecodeError:
            continue
        out += [run[at : m.start()], decoded]
        at = m.end()
    return "".join([*out, run[at:]]) if out else run


@lru_cache(200_000)
def _run_as_bytes(run: str, read: str, written: str) -> str:
    disguised = run.translate(_to_bytes(read))
    return run if max(disguised) > "\xff" else disguised.translate(_characters(written))


def reread_utf8(text: str, read: str) -> str:
    """Runs of characters that are whole UTF-8 in the bytes of ``read``, decoded; the rest as it is."""
    return _RUN.sub(lambda m: _run_as_utf8(m[0], read), text)


def reread_bytes(text: str, read: str, written: str) -> str:
    """Runs of characters beyond ASCII as bytes of ``read``, decoded as ``written``; a run with one that is no byte stays.

    Of double-byte encodings, whose second bytes may be ASCII, the text is read as a whole, and stays if that fails.
    """
    if written in DOUBLE_BYTE:
        try:
            return text.translate(_to_bytes(read)).encode("latin-1").decode(written)
        except UnicodeError:
            return text
    return _RUN.sub(lambda m: _run_as_bytes(m[0], read, written), text)


def _beyond(text: str) -> str:
    """The distinct characters beyond ASCII, in order."""
    return "".join(sorted(c for c in set(text) if c > "\x7f"))


class Describer:
    """Description lengths under the languages' dictionaries."""

    def __init__(self, dictionaries: dict[str, bytes], alphabets: dict[str, str], phrases: dict[str, list[Phrase]] | None = None):
        """Without ``phrases`` the dictionaries' own text is what a language has between two characters."""
        self._zip = {k: zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False) for k, d in dictionaries.items()}
        self._taught = {k: _laid_out((phrases or {}).get(k) or [("", d.decode("utf-8", "ignore"), "", 1)]) for k, d in dictionaries.items()}
        self._letters = {k: frozenset(a + a.lower() + a.upper()) for k, a in alphabets.items()}
        self._known = frozenset().union(*self._letters.values())
        self._double = tuple(e for e in DOUBLE_BYTE if any(self._written_in(a, e) for a in alphabets.values()))
        self._plain = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
        self.length = lru_cache(50_000)(self._length)
        self.decided = lru_cache(100_000)(self.restore)
        self.languages = lru_cache(50_000)(self._languages)
        self.plausible = lru_cache(50_000)(self._plausible)
        self.fill = lru_cache(10_000)(self._fill)
        self.between = lru_cache(50_000)(self._between)

    @staticmethod
    def _written_in(alphabet: str, encoding: str) -> bool:
        wide = [c for c in alphabet if _wide(c)]
        return len(wide) > FAMILIAR * len(alphabet) and sum(c.encode(encoding, "ignore") != b"" for c in wide) >= FAMILIAR * len(wide)

    def _languages(self, chars: str) -> tuple[str, ...]:
        """Those whose letters most of the distinct characters beyond ASCII are."""
        return tuple(k for k, letters in self._letters.items() if sum(c in letters for c in chars) >= FAMILIAR * len(chars))

    def _length(self, text: str, decoded: bool = True) -> int:
        """Bytes under any language, or, of what a step decoded that fits any text, under those it may be in.

        A text in capitals may be described by its small letters: dictionaries hold few others.
        """
        chars = _beyond(text)
        some = decoded and self.languages(chars) or self._zip
        strange = sum(text.count(c) * STRANGE_COST[c.isalpha() or c == LOST] for c in chars if not (c in self._known or c.isspace()) or c == LOST)
        size = self._bytes(text, some)
        if text.isupper():
            size = min(size, self._bytes(text.lower(), some) + CAPITALS_COST)
        return size + strange + CASE_COST * len(_CASE.findall(text)) + MIXED_COST * sum(len(m.findall(text)) for m in _MIXED)

    def _bytes(self, text: str, languages: Iterable[str]) -> int:
        data = text.encode("utf-8", "replace") + TAIL
        return min((len(self._zip[k].compress(data)) for k in languages), default=len(self._plain.compress(data)))

    def _plausible(self, chars: str) -> tuple[tuple[str, str], ...]:
        """The steps that texts with these characters beyond ASCII may have gone through.

        Where letters stand says nothing: other scripts are written without blanks beside Latin names and symbols.
        """
        coded = {read: chars.translate(_to_bytes(read)) for read in {*READ_AS, *(r for r, _ in CONFUSED)}}
        steps = [(read, "utf_8") for read in READ_AS if min(coded[read]) < "\xc0" and any("\xc1" < c < "\xf5" for c in coded[read])]
        if any(map(_wide, chars)):
            steps += [(read, "utf_8") for read in self._double]
        for read, written in CONFUSED:
            if written in DOUBLE_BYTE:
                if written in self._double and max(coded[read]) <= "\xff":
                    steps.append((read, written))
                continue
            new = "".join(c if b > "\xff" else b.translate(_characters(written)) for c, b in zip(chars, coded[read], strict=True))
            if new != chars and self.languages(new):
                steps.append((read, written))
        return tuple(steps)

    def _between(self, language: str, left: str, right: str, most: int) -> str:
        """What of at most so many characters beyond ASCII a language has most often between two texts; empty for nothing."""
        text, starts, middles, ends, counts = self._taught[language]
        found: Counter[str] = Counter()
        for m in re.finditer(f"{re.escape(left)}([^\x00-\x7f]{{1,{most}}}){re.escape(right)}", text):
            i = bisect_right(starts, m.start(1)) - 1
            if middles[i] <= m.start(1) < ends[i]:  # where it is the middle of a phrase, each place counts once
                found[m[1]] += counts[i]
        return min(found, key=lambda c: (-found[c], c), default="")

    def _fill(self, text: str, language: str) -> str:
        """The places of lost bytes filled with what the language has most often between such characters."""
        def best(m: re.Match) -> str:
            before, after = text[: m.start()], text[m.end() :]
            for a, b in CONTEXTS:
                left, right = _DIGIT.sub("0", before[len(before) - a :] if a else ""), _DIGIT.sub("0", after[:b])
                if len(left) < a or len(right) < b or LOST in left + right:
                    continue
                if found := self.between(language, left, right, len(m[0])):
                    return found
            return m[0]

        return re.sub(f"{LOST}+", best, text)

    def step(self, text: str, name: str) -> str:
        read, written = name.split(">")
        if read == "lost":
            return text.replace(LOST, "") if written == "" else self.fill(text, written)
        return reread_utf8(text, read) if written == "utf_8" else reread_bytes(text, read, written)

    def candidates(self, text: str) -> Iterator[tuple[str, str, float]]:
        """(step, decoding, cost) for each plausible step that changes the text."""
        seen, chars = {text}, _beyond(text)
        pieces = _RUN.split(text)  # every other one is a run
        for read, written in self.plausible(chars):
            name = f"{read}>{written}"
            if written in DOUBLE_BYTE:
                new = reread_bytes(text, read, written)
            else:
                runs = [_run_as_utf8(r, read) if written == "utf_8" else _run_as_bytes(r, read, written) for r in pieces[1::2]]
                if runs == pieces[1::2]:
                    continue
                parts = pieces.copy()
                parts[1::2] = runs
                new = "".join(parts)
            if new not in seen and (written not in DOUBLE_BYTE or self.languages(_beyond(new))):
                seen.add(new)
                if written == "utf_8":
                    yield name, new, STEP_COST.get(name, STEP_COST["utf_8"]) - EVIDENCE * min(8, len(text) - len(new))
                else:
                    yield name, new, STEP_COST["other"]
        places = len(re.findall(f"{LOST}+", text))
        if places:
            rest = text.replace(LOST, "").encode("utf-8", "replace")
            for language in sorted(self._zip, key=lambda k: (len(self._zip[k].compress(rest)), k))[:FILL_LANGUAGES]:
                new = self.step(text, f"lost>{language}")
                if new not in seen:
                    seen.add(new)
                    yield f"lost>{language}", new, STEP_COST["other"] + FILL_COST * places
            yield "lost>", self.step(text, "lost>"), STEP_COST["other"] + DROP_COST * places

    def sentence(self, text: str) -> tuple[str, tuple[str, ...]]:
        """:meth:`restore`, decided alike for sentences that differ in their digits only."""
        plain = _DIGIT.sub("0", text)
        new, chain = self.decided(plain)
        if not chain or plain == text:
            return (text, ()) if not chain else (new, chain)
        for name in chain:
            text = self.step(text, name)
        return text, chain

    def _language(self, texts: list[str]) -> frozenset[str]:
        """The letters of the language that describes these texts best."""
        data = "".join(texts).encode("utf-8", "replace")
        best = min(self._zip, key=lambda k: (len(self._zip[k].compress(data)), k), default=None)
        return self._letters[best] if best else frozenset()

    def restore_all(self, parts: list[str]) -> tuple[list[str], set[tuple[str, ...]]]:
        """Restore each sentence; a chain that one sentence paid for costs the others nothing more.

        Of equally long ways the one with fewer characters that are none of the text's language is taken.
        """
        found = [(s, ()) if s.isascii() else self.sentence(s) for s in parts]
        chains = {chain for _, chain in found if chain}
        if not chains:
            return parts, chains
        letters = self._language([text for text, chain in found if chain])
        foreign = lambda text: sum(c not in letters for c in _beyond(text))
        for i, old in enumerate(parts):
            for known in sorted(chains) if not old.isascii() else ():
                new = old
                for name in known:
                    new = self.step(new, name)
                text = found[i][0]
                if new not in (old, text) and (self.length(new), foreign(new)) < (self.length(text, text != old), foreign(text)):
                    found[i] = (new, known)
        return [text for text, _ in found], {chain for _, chain in found if chain}

    def restore(self, text: str) -> tuple[str, tuple[str, ...]]:
        """The shortest description's text and chain; the text itself and no chain if none is shorter."""
        ways = {text: list(self.candidates(text))}
        if not ways[text]:
            return text, ()
        best, chain, least = text, (), self.length(text, False)
        going = least
        frontier = [(text, (), 0)]
        for _ in range(MOST_STEPS):
            found = []
            for current, steps, cost in frontier:
                if current.isascii():
                    continue
                for name, new, price in ways.get(current) or self.candidates(current):
                    found.append((self.length(new, price >= STEP_COST["other"]) + cost + price, new, (*steps, name), cost + price))
            found.sort(key=lambda x: (x[0], len(x[2]), x[2]))
            if found and found[0][0] < least:
                least, best, chain = found[0][:3]
            # A further step starts from what is about as short as the best that may have one: after one of two
            # misreadings a text is shorter already. ``BEAM`` of them are followed.
            found = [x for x in found if "utf_8" in x[2][-1]]
            going = min(going, found[0][0]) if found else going
            frontier = [(new, steps, cost) for length, new, steps, cost in found[:BEAM] if length <= going + 2]
            if not frontier:
                break
        return best, chain


def _laid_out(phrases: list[Phrase]) -> tuple[str, list[int], list[int], list[int], list[int]]:
    """The phrases' text, and where each begins, its middle begins and ends, and how often it is."""
    out, at, starts, middles, ends = [], 0, [], [], []
    for before, word, after, _ in phrases:
        starts.append(at)
        middles.append(at + len(before))
        ends.append(middles[-1] + len(word))
        out.append(f"{before}{word}{after}\0")
        at += len(out[-1])
    return "".join(out), starts, middles, ends, [n for *_, n in phrases]


def _without_misread(phrases: list[Phrase]) -> list[Phrase]:
    """The phrases but those that, read in another encoding, are ``FAR_MORE`` times as frequent: they would describe themselves."""
    often: Counter[str] = Counter()
    for *words, n in phrases:
        often["".join(words).lower()] += n

    def misread(text: str, n: int) -> bool:
        ways = {reread_bytes(text, read, written) for read, written in CONFUSED if written not in DOUBLE_BYTE} - {text}
        return any(often[new.lower()] >= FAR_MORE * n for new in ways)

    return [x for x in phrases if (text := "".join(x[:3])).isascii() or not misread(text, x[3])]


def _arranged(phrases: list[Phrase], whole: list[Phrase], most: int) -> tuple[bytes, list[Phrase]]:
    """A dictionary's content and the phrases in it, in their order, as many as fit; the first ones stand last.

    Each stands in its likeliest sentence, continued both ways by the most frequent phrase that shares two words. Whole
    sentences, most frequent first, take what room is left.
    """
    after: dict[tuple[str, str], Phrase] = {}
    before: dict[tuple[str, str], Phrase] = {}
    for x in phrases:
        after.setdefault(x[:2], x)
        before.setdefault(x[1:3], x)
    held: set[Phrase] = set()
    rows, size = [], 0
    for phrase in phrases:
        if phrase in held or size + len("".join(phrase[:3]).encode()) > most:
            continue
        row, there = deque(phrase[:3]), {phrase}
        while row[-1] and (x := after.get((row[-2], row[-1]))) and x not in there:
            row.append(x[2])
            there.add(x)
        while row[0] and (x := before.get((row[0], row[1]))) and x not in there:
            row.appendleft(x[0])
            there.add(x)
        text = "".join(row).encode()
        if size + len(text) <= most:
            held |= there
            rows.append(text)
            size += len(text)
    for text in (x[0].encode() for x in whole):
        if size + len(text) <= most:
            rows.append(text)
            size += len(text)
    return b"".join(reversed(rows)), [x for x in phrases if x in held]


@lru_cache(200_000)
def _disguised(run: str) -> bool:
    return any(_run_as_utf8(run, read) != run for read in ("cp1252", "mac_roman", "cp437", "cp1251", "cp1250"))


def _counted(texts: DataFrame, columns: list[str], count: Callable[[Counter, str, str], None]) -> DataFrame:
    """How often each is what ``count`` counts in every text that holds no controls, replacement characters or UTF-8 in disguise.

    Tasks add up what they see and hand it on when they hold ``HELD_COUNTS``; the parts are added up by a shuffle.
    """
    def rows(total: Counter) -> pa.RecordBatch:
        keys = list(zip(*total, strict=True)) or [()] * len(columns)
        return pa.RecordBatch.from_arrays([*(pa.array(x, pa.string()) for x in keys), pa.array(total.values(), pa.int64())], [*columns, "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), map(sound, batch.column("text").to_pylist()), strict=True):
                if text.isascii() or not (_UNSOUND.search(text) or any(map(_disguised, _RUN.findall(text)))):
                    count(total, lang, text)
                if len(total) >= HELD_COUNTS:
                    yield rows(total)
                    total = Counter()
        yield rows(total)

    return texts.mapInArrow(run, ", ".join(f"{c} string" for c in columns) + ", n bigint").groupBy(*columns).agg(F.sum("n").alias("n"))


def _letters(texts: DataFrame) -> dict[str, str]:
    """The characters beyond ASCII that two texts of a language, and ``COMMON`` of all, have; of a language with less than three texts all."""
    def count(total: Counter, lang: str, text: str) -> None:
        total[lang, ""] += 1
        for c in _beyond(text):
            total[lang, c] += 1

    out: dict[str, str] = {}
    own = F.max(F.when(F.col("c") == "", F.col("n"))).over(Window.partitionBy("lang"))
    counts = _counted(texts, ["lang", "c"], count).withColumn("own", own)
    for lang, c in sorted(tuple(r) for r in counts.where(f"c = '' or own < 3 or n >= greatest(2, own * {COMMON})").select("lang", "c").collect()):
        out[lang] = out.get(lang, "") + c
    return out


def models(documents: DataFrame) -> tuple[dict[str, bytes], dict[str, str], dict[str, list[Phrase]]]:
    """A zstandard dictionary, the letters beyond ASCII and the phrases around them of each language, from all labelled texts.

    A language is a label's part before a hyphen or underscore. Every text of it counts that holds no controls, replacement
    characters or UTF-8 in disguise, whatever its length. The phrases are three words, digits alike, counted at every place of
    every text, and so are sentences; a dictionary holds the most frequent ones, those with characters beyond ASCII before others. What comes to the driver is bounded by the dictionaries' size and
    the letters; rows of a language that a task arranges, by the size too: each phrase adds a byte at least.
    """
    label = F.regexp_extract(F.lower(F.trim("lang")), "^([a-z]{2,8})([-_].*)?$", 1)
    texts = documents.where(F.col("text") != "").select(label.alias("lang"), "text").where("lang <> ''")
    letters = _letters(texts)
    most = int(DICTIONARY_BYTES * min(1.0, FULL_LANGUAGES / max(1, len(letters))))
    blanks = frozenset(map(chr, range(0x80))) | {"\xa0"}  # a no-break space is a blank in any language, whether common or not
    allowed = {k: blanks | frozenset(v) for k, v in letters.items()}

    def count(total: Counter, lang: str, text: str) -> None:
        for s in sentences(text):
            # A misread text would describe itself: only sentences all in the language's letters teach.
            if allowed[lang].issuperset(s):
                s = _DIGIT.sub("0", s)
                words = ["", *_TOKEN.findall(s), ""]
                total.update(zip(repeat(lang), words, words[1:], words[2:]))
                total[lang, s, "", ""] += 1

    def arrange(rows: pa.Table) -> pa.Table:
        counts = sorted(zip(*(rows.column(c).to_pylist() for c in ("a", "b", "c", "n")), strict=True), key=lambda x: ("".join(x[:3]).isascii(), -x[3], x[:3]))
        content, held = _arranged(*(_without_misread([x for x in counts if bool(x[1]) == part]) for part in (True, False)), most)
        held = [x for x in held if not x[1].isascii()]
        return pa.table({"lang": [rows.column("lang")[0].as_py()], "content": [content], **{k: pa.array([[x[i] for x in held]], pa.list_(t)) for i, (k, t) in enumerate({"a": pa.string(), "b": pa.string(), "c": pa.string(), "n": pa.int64()}.items())}})

    counts = _counted(texts, ["lang", "a", "b", "c"], count).where("b <> '' or n > 1")  # a sentence found once is left to its phrases
    words = F.concat("a", "b", "c")
    ranked = [F.octet_length(words) == F.length(words), F.desc("n"), "a", "b", "c"]  # what is beyond ASCII first: of it is decided
    # Spark keeps only each task's first rows of every language before the shuffle.
    first = counts.withColumn("r", F.row_number().over(Window.partitionBy("lang", F.col("b") == "").orderBy(*ranked))).where(F.col("r") <= most)
    made = first.drop("r").groupBy("lang").applyInArrow(arrange, "lang string, content binary, a array<string>, b array<string>, c array<string>, n array<bigint>").collect()
    made = [r for r in sorted(made, key=lambda r: r["lang"]) if r["content"]]
    return {r["lang"]: bytes(r["content"]) for r in made}, letters, {r["lang"]: list(zip(r["a"], r["b"], r["c"], r["n"], strict=True)) for r in made}


def dictionaries(documents: DataFrame) -> tuple[dict[str, bytes], dict[str, str]]:
    """The dictionary and the letters beyond ASCII of each language; see :func:`models`."""
    return models(documents)[:2]


def sentences(text: str) -> list[str]:
    return [m[0] for m in _SENTENCE.finditer(text) if m[0]]


def restored(documents: DataFrame) -> DataFrame:
    """(doc_id, status, chains, restored) of the documents any part of whose text was misread.

    ``restored``: every misread part found was decoded; ``lossy``: bytes were lost, what stands in their place in ``restored`` is
    the language's most likely filling, nothing, or still the mark. ``chains`` are the distinct chains used. Sound, null and
    empty texts, however unusual, do not come out; equal texts are judged alike. Whole texts are judged, sentence by
    sentence. One pass without shuffle after two that count; the dictionaries and phrases, of bounded size, travel with the tasks.
    """
    known, letters, phrases = models(documents)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        describer = Describer(known, letters, phrases)
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if not text or text.isascii():
                    continue
                parts, used = describer.restore_all(sentences(sound(text)))
                chains = {" ".join(c) for c in used}
                lossy = any("lost>" in c for c in chains) or LOST in "".join(parts)
                if chains:
                    out.append((doc, "lossy" if lossy else "restored", sorted(chains), "".join(parts)))
            kinds = (pa.int64(), pa.string(), pa.list_(pa.string()), pa.string())
            columns = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], ["doc_id", "status", "chains", "restored"])

    return spread(documents.select("doc_id", "text")).mapInArrow(run, "doc_id bigint, status string, chains array<string>, restored string")
