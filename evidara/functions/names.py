"""Names of entities: normal form with positions, distance, variants, tokens. Python, for distinct names only."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Greek letters, and their names, as one Latin letter each.
GREEK = dict(zip("αβγδεζηθικλμνξοπρςστυφχψω", "abgdezhqiklmnxoprsstufcyw", strict=True))
GREEK_NAMES = dict(zip("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split(), "abgdezhqiklmnxoprstufcyw", strict=True))
#: Dashes that count as a hyphen.
DASHES = "‐‑‒–—―−﹘﹣－"
#: Words without meaning in a name.
STOPWORDS = frozenset("a an and as at by for from in into of on or the to with".split())
_ROMAN = re.compile(r"\b(M{0,3}(?:CM|CD|D?C{0,3})(?:XC|XL|L?X{0,3})(?:IX|IV|V?I{0,3}))\b", re.I)
_NAME = re.compile("(?:" + "|".join(GREEK_NAMES) + r")(?![^\W\d_])", re.I)
_PLURALS = (("", "s"), ("", "es"), ("y", "ies"), ("a", "um"), ("i", "us"), ("is", "es"), ("a", "on"), ("ex", "ices"), ("ix", "ices"))


def normalise(text: str) -> tuple[str, list[int]]:
    """(normal form, source position of each of its characters and of its end).

    Lower case without accents; Greek letters and names (at the end of a word) as one letter, without a blank before; no
    apostrophe within words, decimal point or hyphen before a digit; anything else is one blank. Positions count in the
    text without accents.
    """
    src = "".join("-" if c in DASHES else c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn")
    out: list[str] = []
    at: list[int] = []

    def put(piece: str, where: int, joined: bool = False) -> None:
        if joined and out and out[-1] == " ":
            out.pop()
            at.pop()
        for c in piece:
            out.append(c)
            at.append(where)

    greek = {m.start(): m for m in _NAME.finditer(src)}
    i = 0
    while i < len(src):
        c = src[i]
        if named := greek.get(i):
            put(GREEK_NAMES[named.group().lower()], i, joined=True)
            i = named.end()
            continue
        inner = 0 < i < len(src) - 1
        if c.lower() in GREEK:
            put(GREEK[c.lower()], i, joined=True)
        elif c.isalnum():
            put(c.lower(), i)
        elif inner and _dropped(src[i - 1], c, src[i + 1]):
            pass
        elif out and out[-1] != " ":
            put(" ", i)
        i += 1
    if out and out[-1] == " ":
        out.pop()
        end = at.pop()
    else:
        end = len(src)
    return "".join(out), [*at, end]


def _dropped(before: str, c: str, after: str) -> bool:
    return (c == "'" and before.isalnum() and after.isalnum()) or (c == "." and before.isdigit() and after.isdigit()) or (c == "-" and not before.isdigit() and after.isdigit())


def _arabic(m: re.Match) -> str:
    values = [{"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}[c] for c in m.group().upper()]
    total = sum(-v if v < max(values[i:], default=0) else v for i, v in enumerate(values))
    return str(total) if values and (total <= 39 or 1900 <= total <= 2100) else m.group()


def comparable(text: str) -> str:
    """The normal form after small Roman numerals and years became Arabic."""
    return normalise(_ROMAN.sub(_arabic, text))[0]


def osa(a: str, b: str) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours that turn ``a`` into ``b``, no part edited twice."""
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            best = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, older[j - 2] + 1)
            row.append(best)
    return row[-1]


def _folded(text: str) -> str:
    return text.replace("ae", "e").replace("oe", "e").replace("our", "or")


def obvious_variant(a: str, b: str) -> str | None:
    """spelling, spacing or plural when two normal forms differ in nothing else."""
    x, y = _folded(a), _folded(b)
    if x == y:
        return "spelling"
    if x.replace(" ", "") == y.replace(" ", "") != "":
        return "spacing"
    short, long = (x, y) if len(x) <= len(y) else (y, x)
    if any(short.endswith(one) and long == short[: len(short) - len(one)] + many for one, many in _PLURALS):
        return "plural"
    for p, q in ((x, y), (y, x)):
        if (p.endswith("ise") and q == p[:-3] + "ize") or (p.endswith("re") and len(p) > 3 and q == p[:-2] + "er"):
            return "spelling"
    return None


def only_numbers_differ(a: str, b: str) -> bool:
    """Whether two names differ in numbers only, or have a digit where the other has a letter."""
    a, b = re.sub(r"\s", "", a.lower()), re.sub(r"\s", "", b.lower())
    if a == b:
        return False
    p, q = (re.findall(r"\d+|\D", t) for t in (a, b))
    for x, y in zip(p, q):  # noqa: B905
        if x[0].isdigit() != y[0].isdigit():
            return True
        if not x[0].isdigit() and x != y:
            return False
    return len(p) == len(q) and any(x[0].isdigit() for x in p)


def names_match(a: str, b: str) -> tuple[bool, int, str | None]:
    """(matched, distance, how): exact, spelling, plural, spacing or fuzzy."""
    x, y = comparable(a), comparable(b)
    if x == y:
        return True, 0, "exact"
    distance = osa(x, y)
    if kind := obvious_variant(x, y):
        return True, distance, kind
    short = min(len(x), len(y))
    close = short >= 10 and distance <= 1 + short // 10 and 1 - distance / short >= 0.7
    return (True, distance, "fuzzy") if close and not only_numbers_differ(x, y) else (False, distance, None)


def tokens(name: str) -> list[str]:
    """Normal words of a name, with hyphenated words and the whole name also joined."""
    found = {comparable(p) for p in re.split(r"[\s\-/]+", name)} | {comparable(w.replace("-", "")) for w in name.split() if "-" in w}
    found = {t for t in found if t and t not in STOPWORDS}
    if found and re.search(r"[\s\-/]", name):
        whole = comparable(re.sub(r"[\s\-/]+", "", name))
        found |= {whole} - {""} - STOPWORDS
    return sorted(found)


def slash_forms(text: str) -> list[str]:
    """The text and what its one slash abbreviates: 'A / B', 'type I/II cells', 'GDF1/2', 'HuC/D', 'COL1A1/COL1A2'."""
    bare = re.sub(r"\([^)]*\)", "", text)
    if bare.count("/") != 1 or text.count("/") != 1:
        return [text]
    left, right = (t.strip() for t in text.split("/"))
    if not left or not right:
        return [text]
    if " / " in text:
        return [text, left, right]
    words = text.split()
    k = next(i for i, w in enumerate(words) if "/" in w)
    a, b = words[k].split("/")
    if not a or not b:
        return [text]
    if len(words) > 1:
        return [text, *(" ".join([*words[:k], w, *words[k + 1 :]]) for w in _slash_token(a, b))]
    return [text, *_slash_token(a, b)]


def _slash_token(a: str, b: str) -> tuple[str, str]:
    shared = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))  # noqa: B905
    if shared >= 2 and shared * 2 >= min(len(a), len(b)):
        return a, b
    tail = _tail(a, b)
    return (a, a[:-tail] + b) if 0 < tail < len(a) else (a, b)


def _tail(word: str, ending: str) -> int:
    """How many characters at the end of a word an ending of its kind replaces: all of its digits or letters, or one letter
    for a single one, Greek ones included; 0 for an ending of another kind."""
    if ending.isdigit():
        return len(word) - len(word.rstrip("0123456789"))
    if re.fullmatch(r"[A-Za-z]+", ending):
        letters = len(re.search(r"[A-Za-z]*$", word).group())
        return min(letters, 1) if len(ending) == 1 else letters
    if re.fullmatch(r"[α-ωΑ-Ω]", ending):
        return len(re.search(r"[α-ωΑ-Ω]?$", word).group())
    return 0


def acronyms(name: str) -> list[str]:
    """Initials of a name of several words, once with words in capitals as one letter and once spelled out."""
    words = [w for w in re.split(r"[\s\-]+", name) if w and w[0].isalnum()]
    if len(words) < 2:
        return []
    plain = "".join(w[0].upper() for w in words)
    spelled = "".join(w if w.isupper() and len(w) > 1 else w[0].upper() for w in words)
    return sorted({x for x in (plain, spelled) if len(x) >= 2 and x != name})


def variants(name: str, aliases: list[str] | None) -> list[tuple[str, int, str]]:
    """(form, speculation, origin) of a name and its aliases: 0 as written, 1 without or inside parentheses, 2 slash
    forms, 4 acronyms; one more for an alias. Each normal form once, at its least speculation."""
    best: dict[str, tuple[str, int, str]] = {}
    for text, extra, whose in [(name, 0, ""), *((a, 1, "alias:") for a in aliases or [] if a)]:
        forms = [(text, 0, "original")]
        if m := re.match(r"^(.*\S)\s*\(([^)]+)\)\s*$", text):
            forms += [(m.group(1), 1, "base"), (m.group(2), 1 if len(m.group(2)) > len(m.group(1)) or " " in m.group(2) else 2, "paren")]
        forms += [(f, 2, "slash") for f in slash_forms(text)[1:]]
        forms += [(f, 4, "acronym") for f in acronyms(text)]
        for form, level, origin in forms:
            key = comparable(form)
            if key and (key not in best or best[key][1] > level + extra):
                best[key] = (form, level + extra, whose + origin)
    return [(k, v[1], v[2]) for k, v in sorted(best.items())]


def shorthand(text: str) -> list[str]:
    """What 'ISCA1,2', 'COL1A1/A2', 'exons 2-4' and the like stand for; the text itself where nothing is short."""
    if m := re.fullmatch(r"(.*?)(\d+)((?:\s*[,/]\s*\d+)+)", text):
        return [m.group(1) + n for n in [m.group(2), *re.findall(r"\d+", m.group(3))]]
    if m := re.fullmatch(r"(\w+?)([A-Z]\d+)((?:/[A-Z]\d+)+)", text):
        return [m.group(1) + n for n in [m.group(2), *m.group(3)[1:].split("/")]]
    if m := re.fullmatch(r"(\w+ )(\d+)\s*[-–]\s*(\d+)", text):
        low, high = int(m.group(2)), int(m.group(3))
        if low < high <= low + 20:
            return [f"{m.group(1)}{n}" for n in range(low, high + 1)]
    return [text]


def mentions_of(names: list[str], text: str) -> list[tuple[int, int]]:
    """(start, end) in the text of every whole-word mention of a name, also in the plural, compared in normal form."""
    return [(s, e) for _, s, e in mentions_in({"": names}, text)]


def mentions_in(entities: dict[str, list[str]], text: str) -> list[tuple[str, int, int]]:
    """(entity, start, end) of the mentions of several entities by their forms; the text is brought to normal form once."""
    plain, at = normalise(text)
    out = []
    for entity, forms in entities.items():
        known = sorted({f for f in map(comparable, forms) if f and f in plain}, key=len, reverse=True)
        if known:
            pattern = rf"\b(?:{'|'.join(map(re.escape, known))})(?:s|es)?\b"
            out += [(entity, at[m.start()], at[m.end() - 1] + 1) for m in re.finditer(pattern, plain)]
    return out


def all_match(forms: list[str]) -> bool:
    """Whether every two of a set of names match, so that they differ in writing only."""
    return all(names_match(a, b)[0] for i, a in enumerate(forms) for b in forms[i + 1 :])


def _comparable(names: pd.Series) -> pd.Series:
    return names.map(lambda x: None if x is None else comparable(x))


def _tokens(names: pd.Series) -> pd.Series:
    return names.map(lambda x: None if x is None else tokens(x))


def _match(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([(False, None, None) if x is None or y is None else names_match(x, y) for x, y in zip(a, b, strict=True)], columns=["matched", "distance", "how"])


def _variants(names: pd.Series, aliases: pd.Series) -> pd.Series:
    return pd.Series([None if n is None else [{"form": f, "speculation": s, "origin": o} for f, s, o in variants(n, None if a is None else list(a))] for n, a in zip(names, aliases, strict=True)])


def _osa(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else osa(x, y) for x, y in zip(a, b, strict=True)], dtype="Int32")


def comparable_of(name: Column) -> Column:
    return F.pandas_udf(_comparable, "string")(name)


def tokens_of(name: Column) -> Column:
    return F.pandas_udf(_tokens, "array<string>")(name)


def match_of(a: Column, b: Column) -> Column:
    return F.pandas_udf(_match, "struct<matched:boolean,distance:int,how:string>")(a, b)


def variants_of(name: Column, aliases: Column) -> Column:
    return F.pandas_udf(_variants, "array<struct<form:string,speculation:int,origin:string>>")(name, aliases)


def all_match_of(forms: Column) -> Column:
    """all_match for an array; null for null."""
    return F.pandas_udf(lambda x: x.map(lambda v: None if v is None else all_match([f for f in v if f])), "boolean")(forms)


def osa_of(a: Column, b: Column) -> Column:
    return F.pandas_udf(_osa, "int")(a, b)


def offsets(text: str) -> list[tuple[int, int]]:
    """The positions of the normal form as (position, delta) entries, one wherever the delta changes."""
    _, at = normalise(text)
    out: list[tuple[int, int]] = []
    for i, p in enumerate(at):
        if not out or out[-1][1] != p - i:
            out.append((i, p - i))
    return out


def mapped(entries: list[tuple[int, int]], position: int) -> int:
    """Looks a position up in such entries: the last one at or before it."""
    k = bisect_right([p for p, _ in entries], position) - 1
    return position + (entries[k][1] if k >= 0 else 0)
