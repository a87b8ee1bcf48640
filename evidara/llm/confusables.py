"""Problem 5: one consistent form for texts that look the same."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache, reduce

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters of other scripts, and below them the Latin letters they look like.
LOOK_ALIKE = {
    "Cyrillic": dict(zip(
        "АВЕЅІЈКМНОРСТУХѴԚԜаеѕіјорсухѵһԁԛԝӏгԌԍ",
        "ABESIJKMHOPCTYXVQWaesijopcyxvhdqwlrGg", strict=True)),
    "Greek": dict(zip(
        "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονϲϳιρυϹͿαγσ",
        "ABEZHIKMNOPTYXovcjipuCJayo", strict=True)),
    "Armenian": dict(zip(
        "օսհցՕՍոռզգյՏլ",
        "ouhgOUnnqqjSl", strict=True)),
    "Cherokee": dict(zip(
        "ᎠᎡᎢᎥᎪᎫᎬᎳᎷᎻᎽᏀᏂᏃᏏᏒᏔᏕᏙᏚᏞᏟᏢᏦᏧᏳᏴ",
        "DRTiAJEWMHYGhZbRWSVSLCPKdGB", strict=True)),
    "Lisu": dict(zip(
        "ꓐꓑꓒꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ",
        "BPdDTGKJCZFMNLSRVHWXYAEIOU", strict=True)),
    "Coptic": dict(zip(
        "ⲂⲎⲒⲔⲘⲚⲞⲟⲢⲣⲤⲥⲦⲨⲬⲌ",
        "BHIKMNOoPpCcTYXZ", strict=True)),
    "Latin": dict(zip(
        "ɡɑıɩᴄᴏᴠᴡᴢꜱᴜɪʏʋ",
        "gaiicovwzsuiyv", strict=True)),
}
#: Letters that are used as symbols (receptor types and the like) and are read as Latin only beside a small Latin letter.
SYMBOLS = frozenset("αβγδεκλμπσω")
#: Signs that are drawn like the hyphen of ASCII.
HYPHENS = "‐‑﹣"
#: Compatibility forms that are drawn differently, so they stay.
DRAWN_APART = ("<super>", "<sub>", "<fraction>", "<circle>", "<square>", "<vertical>", "<noBreak>")
#: Ranges of the scripts that matter for choosing a spelling.
SCRIPT_RANGES = (
    ("Latin", 0x41, 0x5A), ("Latin", 0x61, 0x7A), ("Latin", 0xC0, 0x24F), ("Latin", 0x250, 0x2AF), ("Latin", 0x1E00, 0x1EFF),
    ("Greek", 0x370, 0x3FF), ("Greek", 0x1F00, 0x1FFF), ("Cyrillic", 0x400, 0x52F), ("Armenian", 0x531, 0x58A),
    ("Latin", 0x1D00, 0x1D25), ("Latin", 0xA720, 0xA7FF), ("Cherokee", 0x13A0, 0x13FF), ("Lisu", 0xA4D0, 0xA4FF), ("Coptic", 0x2C80, 0x2CFF),
    ("Hebrew", 0x590, 0x5FF), ("Arabic", 0x600, 0x6FF), ("Devanagari", 0x900, 0x97F), ("Kana", 0x3040, 0x30FF), ("Han", 0x4E00, 0x9FFF), ("Hangul", 0xAC00, 0xD7AF),
)
#: The blocks with compatibility forms, blanks and invisible characters.
SCANNED = ((0x80, 0x3400), (0xF900, 0x10000), (0x1D400, 0x1D800), (0xE0000, 0xE01F0))
_TO_LATIN = {c: t for table in LOOK_ALIKE.values() for c, t in table.items()}
#: Scripts that hold a letter drawn like each Latin one.
_ALSO = {t: frozenset(s for s, table in LOOK_ALIKE.items() if t in table.values()) for t in set(_TO_LATIN.values())}


def _plain(ch: str) -> str:
    """The form of one character without widths, ligatures, invisibles and special blanks; scripts stay."""
    if ch < "\x7f":
        return ch
    kind = unicodedata.category(ch)
    if kind == "Cf" or ch == "͏" or 0xFE00 <= ord(ch) <= 0xFE0F:
        return ""
    if kind == "Zs":
        return " "
    if ch in HYPHENS:
        return "-"
    form = unicodedata.decomposition(ch)
    if form.startswith("<") and not form.startswith(DRAWN_APART):
        return "".join(map(_plain, unicodedata.normalize("NFKC", ch)))
    return ch


def _scan() -> tuple[dict[int, str], str]:
    """A translation for all characters that change by themselves, and a class of suspicious ones as few ranges.

    The ranges also span rare characters that aren't suspicious, which only costs a look at the text in Python; a class
    of many small ranges would cost far more on every character in the JVM.
    """
    table = {c: _plain(chr(c)) for a, b in SCANNED for c in range(a, b)}
    table = {c: t for c, t in table.items() if t != chr(c)}
    odd = sorted({*table, *(ord(c) for c in _TO_LATIN if c not in SYMBOLS), *(c for c in range(0x300, 0x2100) if unicodedata.combining(chr(c)))})
    common = sorted({*range(0x80, 0x180), *map(ord, SYMBOLS), *range(0x3B1, 0x3CA), *map(ord, "–—‘’“”„•…·»«€™−≤≥≈×→↑≡")} - set(odd))
    runs: list[list[int]] = []
    for c in odd:
        if runs and bisect_left(common, c) == bisect_left(common, runs[-1][1]):
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return table, "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in runs)


_TABLE, _CLASS = _scan()
_NEAR = "".join(sorted(SYMBOLS & set(_TO_LATIN)))
_BESIDE = f"[a-z][{_NEAR}]|[{_NEAR}][a-z]"
_SUSPICIOUS = re.compile(re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: f"\\U{int(m.group(1), 16):08x}", f"[{_CLASS}]|{_BESIDE}"))


def suspicious(text: Column) -> Column:
    """True for texts with any character that could look like others; the symbols, rarer, are sought by themselves."""
    symbol = reduce(lambda x, y: x | y, [F.contains(text, F.lit(c)) for c in _NEAR])
    return text.rlike(f"[{_CLASS}]") | (symbol & text.rlike(_BESIDE))


@cache
def _script(ch: str) -> str | None:
    if not ch.isalpha():
        return None
    code = ord(ch)
    return next((s for s, a, b in SCRIPT_RANGES if a <= code <= b), "Other")


@cache
def _readings(ch: str) -> frozenset[str] | None:
    """The scripts a letter can be read in: its own, Latin if it has a look-alike there, and for a Latin letter every
    script that holds one drawn like it; None for what is no letter."""
    own = _script(ch)
    if own is None:
        return None
    base = unicodedata.normalize("NFD", ch)[0]
    also = frozenset(["Latin"]) if base in _TO_LATIN else frozenset()
    return also | {own} | (_ALSO.get(base, frozenset()) if own == "Latin" else frozenset())


@cache
def _is_small(ch: str) -> bool:
    """Whether a letter is a small Latin one or reads as one."""
    base = unicodedata.normalize("NFD", ch)[0]
    return base not in SYMBOLS and "a" <= _TO_LATIN.get(base, base) <= "z"


def _is_symbol(token: str, i: int) -> bool:
    """Whether a letter stands as a symbol: among at most two of its script, and with no small Latin letter next to it."""
    if token[i] not in SYMBOLS:
        return False
    low, high = i, i + 1
    while low and _script(token[low - 1]) == "Greek":
        low -= 1
    while high < len(token) and _script(token[high]) == "Greek":
        high += 1
    return high - low <= 2 and not any(map(_is_small, token[max(0, low - 1) : low] + token[high : high + 1]))


def script_sets(token: str) -> set[str] | None:
    """The scripts that all letters of ``token`` can be read in, symbols left aside; None when it has no other letters."""
    common: frozenset[str] | None = None
    for i, ch in enumerate(token):
        can = _readings(ch)
        if can is not None and not _is_symbol(token, i):
            common = can if common is None else common & can
    return None if common is None else set(common)


_TOKEN = re.compile(r"[^\W_]+(?:[̀-ͯ]+[^\W_]*)*")


def aligned(text: str) -> tuple[str, list[int]]:
    """``text`` in one consistent form, and for each character of it the position in ``text`` it starts at (one more
    entry: the end).

    Invisible characters are gone, widths, ligatures, blanks and hyphens plain, accents composed. A token whose letters
    can all be read as Latin is spelled in Latin, be it mixed or wholly in another script; a token with a letter that has
    no Latin reading, such as a real Russian or Greek word, stays. Case and visibly different letters stay.
    """
    parts, at, i, n = [], [], 0, len(text)
    while i < n:
        j = i + 1
        while j < n and text[j] >= "\x80" and (unicodedata.combining(text[j]) or _TABLE.get(ord(text[j])) == "" or "\u1160" <= text[j] <= "\u11ff"):
            j += 1
        part = text[i] if j == i + 1 and text[i] < "\x80" else unicodedata.normalize("NFC", text[i:j].translate(_TABLE))
        if part:
            parts.append(part)
            at.append(i)
        i = j
    plain = "".join(parts)
    starts = [0]
    for part in parts:
        starts.append(starts[-1] + len(part))
    if not plain.isascii():
        for m in _TOKEN.finditer(plain):
            token = m.group()
            if token.isascii() or "Latin" not in (script_sets(token) or ()):
                continue
            for k in range(bisect_left(starts, m.start()), bisect_left(starts, m.end())):
                if not parts[k].isascii():
                    parts[k] = _spelled(parts[k], token, starts[k] - m.start())
    where = [p for part, p in zip(parts, at, strict=True) for _ in part]
    return "".join(parts), [*where, n]


def _spelled(part: str, token: str, place: int) -> str:
    """One base letter (or ligature) with its marks, in Latin."""
    if _is_symbol(token, place):
        return part
    return unicodedata.normalize("NFC", "".join(_TO_LATIN.get(c, c) for c in unicodedata.normalize("NFD", part)))


def unify(text: str) -> str:
    """``text`` in one consistent form (see ``aligned``)."""
    return text if text.isascii() and text.isprintable() else aligned(text)[0]


class Terms:
    """The terms by their unified names, and a matcher for whole words of a unified text."""

    def __init__(self, rows: list[tuple[int, str]]) -> None:
        self.by_form: dict[str, list[tuple[int, str]]] = {}
        for term_id, name in rows:
            self.by_form.setdefault(unify(name), []).append((term_id, name))
        self.odd = any(name != form for form, pairs in self.by_form.items() for _, name in pairs)
        self.reach = max(map(len, self.by_form), default=0) + 4
        self.matcher = ahocorasick.Automaton()
        for form in self.by_form:
            if form:
                self.matcher.add_word(form, form)
        if len(self.matcher):
            self.matcher.make_automaton()

    def same(self, text: str) -> set[int]:
        """Terms that the whole ``text`` looks like without being them."""
        return {i for i, name in self.by_form.get(unify(text), []) if name != text}

    def _windows(self, text: str) -> list[tuple[int, int]]:
        """The stretches around suspicious characters that can hold an occurrence: what lies between two of them within
        one occurrence is ordinary, so it is no longer than the longest name."""
        if self.odd:
            return [(0, len(text))]
        out: list[list[int]] = []
        for m in _SUSPICIOUS.finditer(text):
            low, high = max(0, m.start() - self.reach), min(len(text), m.end() + self.reach)
            if out and low <= out[-1][1]:
                out[-1][1] = high
            else:
                out.append([low, high])
        return [(a, b) for a, b in out]

    def inside(self, text: str) -> set[int]:
        """Terms that a whole word or words of ``text`` look like without being them."""
        found: set[int] = set()
        if not len(self.matcher):
            return found
        for low, high in self._windows(text):
            found |= self._in_window(text[low:high], low == 0, high == len(text))
        return found

    def _in_window(self, text: str, begins: bool, ends: bool) -> set[int]:
        found: set[int] = set()
        form, at = aligned(text)
        for last, word in self.matcher.iter(form):
            start, end = last - len(word) + 1, last + 1
            # At the cut edge of a window stands a neighbour, whose own word isn't known: no suspicious character is near.
            if (start and form[start - 1].isalnum()) or (end < len(form) and form[end].isalnum()) or (not start and not begins) or (end == len(form) and not ends):
                continue
            lo, hi = at[start], at[end]
            while lo < hi and _TABLE.get(ord(text[lo])) == "":  # invisible characters around the word are not part of it
                lo += 1
            while hi > lo and _TABLE.get(ord(text[hi - 1])) == "":
                hi -= 1
            found |= {i for i, name in self.by_form[word] if text[lo:hi] != name}
        return found


def _blocks(reference: DataFrame, block: int) -> Iterator[Terms]:
    """The terms with a name, at most about ``block`` at a time."""
    named = reference.where("name IS NOT NULL AND name <> ''").select("term_id", "name")
    many = max(1, -(-named.count() // block))
    for k in range(many):
        yield Terms([(r["term_id"], r["name"]) for r in named.where(F.pmod(F.xxhash64("term_id", "name"), F.lit(many)) == k).collect()])


def find_look_alikes(texts: DataFrame, id_col: str, text: str, reference: DataFrame, whole: bool, block: int = 200_000) -> DataFrame:
    """(record_id, term_id), each pair once: records whose ``text`` (a string, or an array of strings) looks like a term.

    With ``whole`` the entire text must look the same as the term's name, else a whole word or words in it; in both
    cases what is written must not be the name itself. The terms are held in memory ``block`` at a time; a larger
    reference takes one pass over the texts for each block. Texts without any suspicious character, sought in the JVM,
    are never sent to Python; names that are themselves written oddly send every text.

    Null texts, null elements, empty texts and null or empty names give no row. Repeated rows give one. Letter case and
    accents count. Other columns are ignored.
    """
    is_list = dict(texts.dtypes)[text].startswith("array")
    kind = dict(reference.dtypes)["term_id"]
    every = texts.select(F.col(id_col).cast("string").alias("record_id"), (F.explode(text) if is_list else F.col(text)).alias("t"))

    def sought(terms: Terms) -> DataFrame:
        held = texts.sparkSession.sparkContext.broadcast(terms)

        def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            known = held.value
            look = known.same if whole else known.inside
            for b in batches:
                hits = [(r, i) for r, t in zip(b["record_id"], b["t"], strict=True) for i in look(t)]
                yield pd.DataFrame(hits, columns=["record_id", "term_id"])

        rows = every.where(F.col("t").isNotNull() if terms.odd else suspicious(F.col("t")))
        return rows.mapInPandas(search, f"record_id string, term_id {kind}")

    return reduce(DataFrame.unionByName, map(sought, _blocks(reference, block))).distinct()


def unify_texts(texts: DataFrame, text: str) -> DataFrame:
    """The rows with ``text`` (a string or an array of strings) unified. Nulls stay null, empty texts empty.

    Rows without suspicious characters pass unchanged inside the JVM plan; only the others are rewritten in Python.
    """
    is_list = dict(texts.dtypes)[text].startswith("array")
    joined = F.array_join(text, "") if is_list else F.col(text)

    @F.pandas_udf("array<string>" if is_list else "string")
    def rewrite(values: pd.Series) -> pd.Series:
        if is_list:
            return values.map(lambda v: None if v is None else [None if x is None else unify(x) for x in v])
        return values.map(lambda v: None if v is None else unify(v))

    # A null input costs the UDF nothing, so unsuspicious texts don't travel.
    odd = F.when(suspicious(joined), F.col(text))
    return texts.withColumn(text, F.coalesce(rewrite(odd), F.col(text)))
