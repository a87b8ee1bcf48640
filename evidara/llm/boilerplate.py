"""Problem 3: page furniture found by differencing pages with their nearest URLs.

Pages of a host are ordered by URL path and each is aligned, by a longest common subsequence of its lines, with NEIGHBOURS
pages on either side. Lines shared with any of them are furniture; what the alignments say about a line's template (digits
made equal, menus told by an item) on its host is used for all of its occurrences, and carried over a whole block of short
lines. How often a template is shared with the NEAREST pages tells lines of the site from lines that articles have in
common. An exact check then keeps what is shared but belongs to articles: the title, headings (short lines that regularly stand right above
paragraphs), list items and sentences that only ever follow paragraphs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidara.plans.lineage import Scratch
from evidara.plans.ranking import running_sum

#: Bits that describe a line.
PARAGRAPH, HEADING, ITEM, SENTENCE, BEFORE_TITLE, TITLE, ABOVE_PARAGRAPH, BELOW_PARAGRAPH, LONG = (1 << k for k in range(9))
#: Neighbours on either side, and those among them whose rates count; pages in a block of neighbours.
NEIGHBOURS, NEAREST, BLOCK = 24, 2, 128
#: Bits an alignment may hold at once.
TABLE_BITS = 1 << 26
#: A page with this share of the other's paragraphs is a copy of it and says nothing about furniture.
COPY = 0.3
#: A long paragraph that so many of a host's pages hold, and this share of them beside pages they are no copies of, is furniture.
LONG_PAGES, LONG_SHARED = 5, 0.6
_DIGITS = re.compile(r"\d+")
_WORD = re.compile(r"[^\W_]+")
_HOST = re.compile(r"^[a-z]+://(?:(?:www|amp|m)\.)*([^/?#:]*)[^/?#]*([^#]*)", re.I)
_NUMBERED = re.compile(r"^\d+[.)]\s")
_BETWEEN = re.compile(r"\s*[/|·•]\s*|\s{2,}")


def _digest() -> Column:
    """Tells rows that repeat a doc_id apart."""
    return F.xxhash64("url", "title", "text")


def place(url: str | None) -> tuple[str, str]:
    """(host, path) of a URL; ("", "") when it is null or has none."""
    m = _HOST.match(url or "")
    return (m.group(1).lower(), m.group(2)) if m else ("", "")


@lru_cache(1024)
def _parts_of(host: str) -> frozenset[str]:
    """All stretches of four characters in a host; a line with none of them can't hold a longer part of it."""
    return frozenset(host[i : i + 4] for i in range(len(host) - 3))


def _key(line: str, host: str, prose: bool) -> int:
    """A number for the line's template: digits made equal, the site's own name masked, of a line that is no prose only
    what comes before an early colon, and of a menu (three short items or more) its first item in binary order, for menus
    come shortened and in any order."""
    items = [] if prose or line[-1] in ".!?" else [x for x in _BETWEEN.split(line) if x]
    if len(items) > 2 and max(map(len, items)) <= 30:
        line = "menu: " + min(items)
        prose = True
    line, low = _DIGITS.sub("0", line), line.lower()
    if any(part in low for part in _parts_of(host)):
        line = _WORD.sub(lambda m: "@" if len(m.group()) > 3 and m.group().lower() in host else m.group(), line)
    colon = line.find(":")
    if 0 < colon < 30 and not prose and len(line) > colon + 1:
        line = line[: colon + 1]
    return xxhash.xxh64_intdigest(line) - (1 << 63) or 1


def describe(text: str, title: str | None, host: str = "") -> tuple[list[int], list[int], list[int]]:
    """(numbers, template keys, bits) of the lines that are not blank. Prose is a long line that ends like a sentence, or
    one long word (sequence data)."""
    lines = [x.strip() for x in text.split("\n")]
    bits = []
    for line in lines:
        b = 0
        if line:
            ends = line[-1] in ".!?" or line[-2:] in ('."', ".)", ".”")
            b |= SENTENCE if ends else 0
            b |= LONG if len(line) > 200 else 0
            b |= HEADING if line[0] == "#" or (line.startswith("**") and line.endswith("**")) else 0
            b |= ITEM if line[:2] in ("* ", "- ", "• ") else 0
            if (ends and len(line) >= 80 or len(line) >= 60 and " " not in line) and not b & (HEADING | ITEM) and not _NUMBERED.match(line):
                b |= PARAGRAPH
        bits.append(b)
    if title:
        want = set(_WORD.findall(title.lower()))
        for i, line in enumerate(lines):
            if line and not bits[i] & LONG:
                has = set(_WORD.findall(line.lower()))
                if has and want and len(has & want) >= 0.6 * len(has | want):
                    bits[i] = bits[i] & ~PARAGRAPH | TITLE
                    for j in range(i):
                        bits[j] |= BEFORE_TITLE
                    break
    for i in range(len(lines)):
        if i + 1 < len(lines) and bits[i + 1] & PARAGRAPH:
            bits[i] |= ABOVE_PARAGRAPH
        if i and bits[i - 1] & PARAGRAPH:
            bits[i] |= BELOW_PARAGRAPH
    full = [i for i, line in enumerate(lines) if line]
    return full, [_key(lines[i], host, bool(bits[i] & (PARAGRAPH | TITLE))) for i in full], [bits[i] for i in full]


def _rows(a: list[int], b: list[int]) -> Iterator[int]:
    """Bit vectors over ``b`` after each line of ``a``: bit j is 0 where a common subsequence grows with line j of ``b``."""
    masks: dict[int, int] = {}
    for j, key in enumerate(b):
        masks[key] = masks.get(key, 0) | 1 << j
    full = row = (1 << len(b)) - 1
    yield row
    for key in a:
        hits = row & masks.get(key, 0)
        row = (row + hits | row - hits) & full
        yield row


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Lengths of the longest common subsequences of ``a`` with each beginning of ``b``."""
    for row in _rows(a, b):  # noqa: B007
        pass
    grows = ((1 << len(b)) - 1) & ~row
    bits = np.unpackbits(np.frombuffer(grows.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate(([0], np.cumsum(bits)))


def _common(a: list[int], b: list[int], i: int, j: int, out: list[tuple[int, int]]) -> None:
    """Adds the positions of a longest common subsequence, offset by (i, j): bits in rows where these fit in TABLE_BITS,
    halves of ``a`` otherwise, so the room needed grows with the lines and not with their product."""
    begin, end = 0, 0
    while begin < min(len(a), len(b)) and a[begin] == b[begin]:
        out.append((i + begin, j + begin))
        begin += 1
    while end < min(len(a), len(b)) - begin and a[-1 - end] == b[-1 - end]:
        end += 1
    x, y = a[begin : len(a) - end], b[begin : len(b) - end]
    if x and y and len(x) * len(y) <= TABLE_BITS:
        rows, found = list(_rows(x, y)), []
        p, q = len(x), len(y)
        while p and q:
            below = (1 << q) - 1
            if x[p - 1] == y[q - 1]:
                p, q = p - 1, q - 1
                found.append((i + begin + p, j + begin + q))
            elif (~rows[p - 1] & below).bit_count() == (~rows[p] & below).bit_count():
                p -= 1
            else:
                q -= 1
        out += reversed(found)
    elif len(x) == 1 and y:
        out += [(i + begin, j + begin + y.index(x[0]))] if x[0] in y else []
    elif x and y:
        middle = len(x) // 2
        cut = int(np.argmax(_lengths(x[:middle], y) + _lengths(x[middle:][::-1], y[::-1])[::-1]))
        _common(x[:middle], y[:cut], i + begin, j + begin, out)
        _common(x[middle:], y[cut:], i + begin + middle, j + begin + cut, out)
    out += [(i + len(a) - k, j + len(b) - k) for k in range(end, 0, -1)]


def align(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Positions of a longest common subsequence of two lists of line keys."""
    return _aligned(a, b, set(a) & set(b))


def _aligned(a: list[int], b: list[int], common: set[int]) -> list[tuple[int, int]]:
    if not common:
        return []
    x, y = [i for i, k in enumerate(a) if k in common], [j for j, k in enumerate(b) if k in common]
    out: list[tuple[int, int]] = []
    _common([a[i] for i in x], [b[j] for j in y], 0, 0, out)
    return [(x[p], y[q]) for p, q in out]


def _difference(pages: pd.DataFrame) -> pd.DataFrame:
    """Each page of the block proper, and for every line whether any neighbour and whether one of the nearest shares it."""
    pages = pages.sort_values("place").drop_duplicates("place")
    keys, bits = list(map(list, pages["keys"])), list(map(list, pages["bits"]))
    spots, own = pages["place"].tolist(), pages["own"].tolist()
    roots = [p.rstrip("/").partition("?")[0].removesuffix(".html") for p in pages["path"]]
    titles = [next((k for k, b in zip(ks, bs, strict=True) if b & TITLE), None) for ks, bs in zip(keys, bits, strict=True)]
    shared, near = [[0] * len(k) for k in keys], [[0] * len(k) for k in keys]
    # Long lines under many titles don't make two pages copies of each other.
    under: dict[int, list] = {}
    for ks, bs, t in zip(keys, bits, titles, strict=True):
        for k in {k for k, b in zip(ks, bs, strict=True) if b & LONG}:
            under.setdefault(k, []).append(t)
    spread = {k for k, ts in under.items() if len(set(ts)) >= LONG_PAGES and 2 * len(ts) > len(keys)}
    prose = [[b & PARAGRAPH and k not in spread for k, b in zip(ks, bs, strict=True)] for ks, bs in zip(keys, bits, strict=True)]
    every = [[b & PARAGRAPH for b in bs] for bs in bits]
    sets, some, lengths = [set(k) for k in keys], [any(p) for p in prose], [(sum(map(bool, p)), sum(map(bool, e))) for p, e in zip(prose, every, strict=True)]
    for i in range(len(keys)):
        for j in range(i + 1, min(len(keys), i + 1 + NEIGHBOURS)):
            if spots[j] - spots[i] > NEIGHBOURS or not (own[i] or own[j]):
                continue
            if titles[i] is not None and titles[i] == titles[j] or len(roots[i]) > 8 and (roots[j].startswith(roots[i]) or roots[i].startswith(roots[j])) and len(roots[j]) > 8 and "?" not in pages["path"].iloc[i]:
                continue
            pairs = _aligned(keys[i], keys[j], sets[i] & sets[j])
            # A page of such lines only is compared by them.
            own_prose = some[i] and some[j]
            x = prose[i] if own_prose else every[i]
            if sum(x[p] > 0 for p, _ in pairs) > COPY * max(1, min(lengths[k][0 if own_prose else 1] for k in (i, j))):
                continue
            for p, q in pairs:
                shared[i][p] = shared[j][q] = 1
                if spots[j] - spots[i] <= NEAREST:
                    near[i][p] = near[j][q] = 1
    mine = [i for i, o in enumerate(own) if o]
    return pd.DataFrame({"row": pages["row"].to_numpy()[mine], "shared": pd.Series([shared[i] for i in mine], dtype=object), "near": pd.Series([near[i] for i in mine], dtype=object)})


def decide(lines: list[tuple]) -> list[int]:
    """Numbers of the furniture among one page's lines.

    A line is (number, bits, n, shared with the nearest on its host, n everywhere, shared with the nearest everywhere,
    before titles, above paragraphs, below paragraphs, shared with any neighbour on its host).
    """
    no = [x[0] for x in lines]
    bits = [x[1] for x in lines]
    rate = lambda part, whole: part / whole if whole else 0.0
    host_rate = [rate(x[3], x[2]) for x in lines]
    before = [rate(x[6], x[4]) for x in lines]
    above, below = [rate(x[7], x[4]) for x in lines], [rate(x[8], x[4]) for x in lines]
    seen = [x[3] > 0 or x[9] > 0 or x[5] > 1 for x in lines]
    all_rate = [rate(x[5], x[4]) for x in lines]
    notice = [bool(b & LONG and b & PARAGRAPH) and lines[i][2] >= LONG_PAGES and host_rate[i] > LONG_SHARED for i, b in enumerate(bits)]
    paragraph = [bool(b & PARAGRAPH) and not notice[i] and not (b & LONG == 0 and seen[i] and (before[i] > 0.05 or host_rate[i] > 0.3 or (lines[i][4] >= 5 and lines[i][5] > 1))) for i, b in enumerate(bits)]
    heading = [not paragraph[i] and bool(bits[i] & HEADING) or (not bits[i] & (ITEM | LONG) and above[i] >= 0.5 and below[i] <= 0.7 and before[i] < 0.1 and i + 1 < len(lines) and no[i + 1] == no[i] + 1 and paragraph[i + 1]) for i in range(len(lines))]
    titles = [i for i, b in enumerate(bits) if b & TITLE]
    if titles:
        title = titles[0]
    else:
        first = next((i for i, p in enumerate(paragraph) if p), len(lines))
        marked = [i for i in range(first) if bits[i] & HEADING]
        rare = [i for i in range(first) if not seen[i] and not heading[i] and lines[i][4] <= 3 and not bits[i] & ITEM]
        title = marked[0] if marked else rare[-1] if rare else next((i for i in range(first) if heading[i]), first)
    keep = [paragraph[i] or heading[i] or i == title for i in range(len(lines))]
    for i in range(title + 1, len(lines)):
        if keep[i] or notice[i] or not (bits[i] & (SENTENCE | ITEM)) or not i or no[i] != no[i - 1] + 1:
            continue
        # A sentence or list item that follows a paragraph here and nearly everywhere.
        listed = paragraph[i - 1] or (keep[i - 1] and bits[i] & ITEM and bits[i - 1] & ITEM)
        keep[i] = bool(listed) and before[i] < 0.02 and (host_rate[i] if lines[i][2] >= 10 else all_rate[i]) < 0.5 and (below[i] >= 0.75 or lines[i][4] < 3)
    out = [i < title for i in range(len(lines))]
    for i in range(len(lines)):
        out[i] = (out[i] or seen[i]) and not (keep[i] and i >= title)
    # Furniture comes in blocks: lines without a blank between them and one that is furniture.
    for order in (range(1, len(lines)), range(len(lines) - 2, -1, -1)):
        for i in order:
            j = i - 1 if order.step > 0 else i + 1
            out[i] |= not keep[i] and out[j] and abs(no[i] - no[j]) == 1
    # A line that always introduces a text, without being a heading, takes that text along.
    for i in range(len(lines) - 1):
        out[i + 1] |= out[i] and not bits[i] & LONG and lines[i][4] >= 3 and above[i] >= 0.9 and not heading[i] and no[i + 1] == no[i] + 1 and not titles[:1] == [i + 1]
    # What stands alone after the last paragraph is no part of the article.
    last = max((i for i in range(len(lines)) if paragraph[i]), default=-1)
    for i in range(last + 1, len(lines)):
        out[i] |= not keep[i] and i > title
    return [n for n, o in zip(no, out, strict=True) if o]


def _furniture(pages: DataFrame) -> DataFrame:
    """(doc_id, digest, line_no, evidence): furniture by page; equal rows are one page. Evidence is "line" where a
    neighbour shares the line, "template" where neighbours share its template elsewhere on the host, "elsewhere" where
    they do on another host, and "block" where it only stands among such lines."""
    scratch = Scratch(pages.sparkSession, "furniture")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for row, doc, digest, url, title, text in zip(b["row"], b["doc_id"], b["digest"], b["url"], b["title"], b["text"], strict=True):
                host, path = place(url)
                rows.append((row, doc, digest, host, path, *describe(text, title, host)))
            yield pd.DataFrame(rows, columns=["row", "doc_id", "digest", "host", "path", "numbers", "keys", "bits"])

    full = pages.where("text IS NOT NULL AND text <> ''").select(F.monotonically_increasing_id().alias("row"), "doc_id", _digest().alias("digest"), "url", "title", "text")
    lines = scratch.save(full.mapInPandas(read, "row long, doc_id string, digest long, host string, path string, numbers array<int>, keys array<long>, bits array<int>"))
    order = running_sum(lines.select("host", "path", "doc_id", "row", "keys", "bits"), scratch, ["host"], ["path", "doc_id", "row"], None, "place")

    blocks = F.array_distinct(F.transform(F.array(*[F.lit(k) for k in (0, -NEIGHBOURS, NEIGHBOURS)]), lambda k: F.floor((F.col("place") + k) / BLOCK)))
    spread = order.withColumn("block", F.explode(blocks)).withColumn("own", F.col("block") == F.floor(F.col("place") / BLOCK))
    compared = spread.groupBy("host", "block").applyInPandas(_difference, "row long, shared array<int>, near array<int>")
    compared = scratch.save(compared)

    pair = F.arrays_zip("numbers", "keys", "bits", "shared", "near")
    long = lines.join(compared, "row").select("row", "host", F.explode(pair).alias("x"))
    long = long.select("row", "host", F.col("x.numbers").alias("no"), F.col("x.keys").alias("key"), F.col("x.bits").alias("bits"), "x.shared", "x.near")
    flag = lambda bit: F.sum(F.when(F.col("bits").bitwiseAND(bit) > 0, 1).otherwise(0))
    hosts = long.groupBy("host", "key").agg(F.count(F.lit(1)).alias("n"), F.sum("near").alias("s"), F.sum("shared").alias("w"), flag(BEFORE_TITLE).alias("before"), flag(ABOVE_PARAGRAPH).alias("above"), flag(BELOW_PARAGRAPH).alias("below"))
    hosts = scratch.save(hosts)
    every = hosts.groupBy("key").agg(*[F.sum(c).alias(f"all_{c}") for c in ("n", "s", "w", "before", "above", "below")]).where("all_n > 1")
    told_of = ("n", "s", "all_n", "all_s", "all_before", "all_above", "all_below", "w", "all_w")
    known = hosts.join(every, "key").select("host", "key", *told_of)
    told = long.select("row", "host", "no", "key", "bits", "shared").join(known, ["host", "key"], "left")
    zero = [F.coalesce(F.col(c), F.lit(0)).cast("int").alias(c) for c in told_of]
    grouped = told.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("no", "bits", *zero, "shared"))).alias("lines"))

    @F.pandas_udf("array<struct<line_no:int,evidence:string>>")
    def furniture(values: pd.Series) -> pd.Series:
        def judge(lines: list) -> list[dict]:
            rows = [tuple(x.values()) if isinstance(x, dict) else tuple(x) for x in lines]
            why = {x[0]: "line" if x[11] else "template" if x[9] else "elsewhere" if x[10] else "block" for x in rows}
            return [{"line_no": n, "evidence": why[n]} for n in decide([x[:10] for x in rows])]

        return values.map(judge)

    found = grouped.select("row", F.explode(furniture("lines")).alias("f"))
    return found.join(lines.select("row", "doc_id", "digest"), "row").select("doc_id", "digest", "f.line_no", "f.evidence").distinct()


def find_furniture(pages: DataFrame) -> DataFrame:
    """(doc_id, line_no): lines of ``text`` that are not blank and not part of the article.

    ``pages`` has doc_id, url, title and text; other columns are ignored. Null or empty texts give no row. A null URL is
    a page of an unnamed host. Pages with a null title are judged by their first line that looks like one. Rows that
    repeat a doc_id are judged each for itself, their lines listed once. Ties in the path are ordered by doc_id.

    No host, however large, comes to one task: pages are numbered in order of host and path, and blocks of BLOCK
    neighbours (with the NEIGHBOURS before and after them) are compared.
    """
    return _furniture(pages).select("doc_id", "line_no").distinct()


def evidence(pages: DataFrame) -> DataFrame:
    """(evidence, lines): how many lines of furniture alignments shared ("line", "template") and how many follow from others."""
    return _furniture(pages).groupBy("evidence").agg(F.count(F.lit(1)).alias("lines"))


def keep_articles(pages: DataFrame) -> DataFrame:
    """The pages with ``article``, the text without its furniture and without blank lines at either end; null stays null.
    Rows that repeat a doc_id keep each its own article."""
    drop = _furniture(pages).groupBy(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest")).agg(F.collect_set("line_no").alias("__drop"))
    rest = F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains(F.coalesce("__drop", F.array().cast("array<int>")), i))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (_digest() == F.col("__digest"))
    return pages.join(drop, same, "left").withColumn("article", F.trim(F.array_join(rest, "\n"), F.lit("\n \t"))).drop("__drop", "__id", "__digest")
