"""Texts: quotes, contexts, headings and sections, redaction."""

from __future__ import annotations

import re
from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidara.functions import names
from evidara.operators import articles, islands

#: Headings that accompany an abstract alone, of publishers and of the pages around it.
BESIDE_ABSTRACT = (
    r"abstract", r"keywords?", r"author\s+(?:information|contributions)", r"data\s+availability(?:\s+statement)?", r"conflicts?\s+of\s+interest(?:\s+statement)?", r"competing\s+interests?", r"funding", r"acknowledge?ments?",
    r"references", r"footnotes", r"associated\s+data", r"similar\s+articles", r"citing\s+articles", r"publication\s+types", r"mesh\s+terms", r"related\s+information", r"grants?\s+and\s+funding", r"actions", r"permalink", r"resources", r"figures?", r"tables?",
    r"supplementary\s+materials?", r"ethics\s+statement", r"licence", r"license", r"copyright", r"buy\s+now", r"access\s+(?:this\s+article|options|through\s+your\s+institution)", r"read\s+this\s+article", r"rent\s+or\s+buy", r"subscribe",
    r"institutional\s+access", r"affiliations?", r"authors?(?:\s+and\s+affiliations?)?", r"subjects?", r"explore\s+related\s+subjects", r"linkout", r"update\s+(?:of|in)", r"supporting\s+information",
    r"financial\s+&?\s*competing\s+interests(?:\s+disclosure)?", r"cite\s+this\s+article", r"share\s+this\s+article", r"similar\s+content", r"about\s+this\s+article", r"rights\s+and\s+permissions", r"search", r"navigation", r"main\s+content",
)
#: An abstract alone is no longer than this.
ABSTRACT_LENGTH = 3500


def quote_start(quote: Column, text: Column) -> Column:
    """Where a quote stands verbatim, from 0; null if it doesn't."""
    return F.when(quote != "", F.nullif(F.instr(text, quote), F.lit(0)) - 1)


#: The quotes of a text usually follow each other, so its normal form is kept.
_normal = lru_cache(8)(names.normalise)


def locate(quote: str, text: str, least: float = 0.8) -> tuple[str, list[tuple[int, int]]]:
    """(how, spans): every verbatim place, else in normal form (segments around an ellipsis in order), else what a
    shorthand in it stands for, else the closest passage of at least ``least`` similarity, else none."""
    if not quote or not text:
        return "none", []
    found = [(m.start(), m.start() + len(quote)) for m in re.finditer(f"(?={re.escape(quote)})", text)]
    if found:
        return "verbatim", found
    plain, at = _normal(text)
    if spans := _in_normal_form(quote, plain, at):
        return "normal", spans
    for variant in names.shorthand(quote):
        if variant != quote and (spans := _in_normal_form(variant, plain, at)):
            return "shorthand", spans
    form = names.normalise(quote)[0]
    best, where = 0.0, None
    words = [m.start() for m in re.finditer(r"\S+", plain)]
    sizes = (len(form), len(form) - len(form) // 10, len(form) + len(form) // 10)[: 3 if len(form) >= 10 else 1]
    needed = lambda n, ratio: (1.5 * ratio - 1) * (len(form) + n) - 1 - 1e-9
    windows = [(-shared, k, s) for k, size in enumerate(sizes) for s, shared in zip(words, _shared_bigrams(form, plain, words, size), strict=True) if shared >= needed(min(size, len(plain) - s), least)]
    # The likeliest windows come first, so that the best ratio soon rules out most others.
    for shared, k, s in sorted(windows):
        piece = plain[s : s + sizes[k]]
        # A ratio r matches r / 2 of all characters in at most one block more than characters are left out of it.
        if -shared < needed(len(piece), max(least, best)):
            continue
        match = SequenceMatcher(None, form, piece, autojunk=False)
        if match.quick_ratio() < max(least, best):
            continue
        score = match.ratio()
        if score > best or score == best and where and (k, s) < where[2:]:
            best, where = score, (s, min(s + sizes[k], len(plain)), k, s)
    if where and best >= least:
        return "fuzzy", [whole_words(text, at[where[0]], at[where[1] - 1] + 1)]
    return "none", []


def whole_words(text: str, start: int, end: int) -> tuple[int, int]:
    """The span widened to the ends of the words it cuts."""
    while 0 < start < len(text) and text[start - 1].isalnum() and text[start].isalnum():
        start -= 1
    while 0 < end < len(text) and text[end - 1].isalnum() and text[end].isalnum():
        end += 1
    return start, end


def words_around(text: Column, start: Column, end: Column) -> Column:
    """The same inside the JVM, as (s, e)."""
    cut = lambda at: F.substring(text, at, F.lit(2)).rlike(r"^[\p{L}\p{N}]{2}$")
    before = F.when(cut(start), F.length(F.regexp_extract(F.substring(text, F.lit(1), start), r"[\p{L}\p{N}]*$", 0))).otherwise(0)
    after = F.when(cut(end), F.length(F.regexp_extract(F.substring(text, end + 1, F.length(text)), r"^[\p{L}\p{N}]*", 0))).otherwise(0)
    return F.struct((start - before).alias("s"), (end + after).alias("e"))


def corrected(quote: str, text: str) -> str | None:
    """What of a quote stands in the text: where it isn't found as it is, the parts of the closest passage that match it, with
    gaps of at most two blanks as one and any other left out; null where there is no such passage."""
    how, spans = locate(quote, text)
    if how == "none":
        return None
    if how != "fuzzy":
        return " ".join(" ".join(text[s:e].split()) for s, e in spans[: 1 if how == "verbatim" else None])
    plain, parts, last = names.normalise(text[spans[0][0] : spans[0][1]])[0], [], None
    for block in SequenceMatcher(None, names.normalise(quote)[0], plain, autojunk=False).get_matching_blocks()[:-1]:
        if last is not None and 0 < block.b - last <= 2 and not plain[last : block.b].strip():
            parts.append(" ")
        parts.append(plain[block.b : block.b + block.size])
        last = block.b + block.size
    return " ".join("".join(parts).split())


def _in_normal_form(quote: str, plain: str, at: list[int]) -> list[tuple[int, int]]:
    """Where the quote's segments around an ellipsis stand in order in a text in normal form; none unless all do."""
    spans, cursor = [], 0
    for part in re.split(r"\s*(?:…|\.\.\.|\[\.\.\.\])\s*", quote):
        form = names.normalise(part)[0]
        if not form:
            continue
        k = plain.find(form, cursor)
        if k < 0:
            return []
        spans.append((at[k], at[k + len(form) - 1] + 1))
        cursor = k + len(form)
    return spans


def _codes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    return points[:-1] << np.uint64(32) | points[1:]


@lru_cache(8)
def _bigrams(plain: str) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of characters of a text in order, and where each stands, equal ones from left to right."""
    codes = _codes(plain)
    order = np.argsort(codes, kind="stable")
    return codes[order], order


def _shared_bigrams(form: str, plain: str, starts: list[int], size: int) -> list[int]:
    """For the window of ``size`` at each start, how many pairs of characters it has in common with the form.

    Of a pair that the form has n times, a place counts in the windows that hold it but not the n-th place before it.
    """
    codes, at = _bigrams(plain)
    need, n = np.unique(_codes(form), return_counts=True)
    low, high = np.searchsorted(codes, need, "left"), np.searchsorted(codes, need, "right")
    held = high - low
    rank = np.arange(held.sum()) - np.repeat(np.cumsum(held) - held, held)
    places, n = np.repeat(low, held) + rank, np.repeat(n, held)
    before = np.where(rank >= n, at[places - n], -1) if places.size else places
    last = at[places]
    first = np.minimum(np.maximum(np.maximum(before + 1, last - size + 2), 0), last + 1)
    count = np.cumsum(np.bincount(first, minlength=len(plain) + 2) - np.bincount(last + 1, minlength=len(plain) + 2))
    return count[starts].tolist() if starts else []


def located(quotes: DataFrame, quote: str, text: str) -> DataFrame:
    """Adds ``how`` and ``spans``. Quotes that stand verbatim in one place are settled in the JVM; the others go to Python."""
    first = quote_start(F.col(quote), F.col(text))
    first = F.when(F.call_function("locate", F.col(quote), F.col(text), (first + 2).cast("int")) == 0, first)

    def find(q: pd.Series, t: pd.Series) -> pd.DataFrame:
        got = [("none", []) if x is None or y is None else locate(x, y) for x, y in zip(q, t, strict=True)]
        return pd.DataFrame({"how": [g[0] for g in got], "spans": pd.Series([[{"s": s, "e": e} for s, e in g[1]] for g in got], dtype=object)})

    slow = F.pandas_udf(find, "struct<how:string,spans:array<struct<s:int,e:int>>>")
    rest = F.when(first.isNull(), F.col(quote))
    out = quotes.withColumn("__f", slow(rest, F.when(first.isNull(), F.col(text))))
    one = F.array(F.struct(first.cast("int").alias("s"), (first + F.length(quote)).cast("int").alias("e")))
    return out.withColumn("how", F.when(first.isNotNull(), "verbatim").otherwise(F.col("__f.how"))).withColumn("spans", F.when(first.isNotNull(), one).otherwise(F.col("__f.spans"))).drop("__f")


def corrections(quotes: DataFrame, quote: str, text: str) -> DataFrame:
    """Adds ``corrected``, the text's own words for each quote; null where it isn't found."""

    def find(q: pd.Series, t: pd.Series) -> pd.Series:
        once = {(x, y): None if x is None or y is None else corrected(x, y) for x, y in dict.fromkeys(zip(q, t, strict=True))}
        return pd.Series([once[pair] for pair in zip(q, t, strict=True)], dtype=object)

    return quotes.withColumn("corrected", F.pandas_udf(find, "string")(quote, text))


def region_text(text: Column, chunks: Column, first: Column, last: Column, pad: int) -> Column:
    """The chunks from ``first`` to ``last`` and ``pad`` on either side, joined by newlines."""
    low, high = F.greatest(first - pad, F.lit(0)), F.least(last + pad, F.size(chunks) - 1)
    return F.array_join(F.transform(F.sequence(low, high), lambda i: F.substring(text, F.element_at(chunks, i + 1)["start"] + 1, F.element_at(chunks, i + 1)["end"] - F.element_at(chunks, i + 1)["start"])), "\n")


def lines(documents: DataFrame, doc: str, text: str) -> DataFrame:
    return documents.where(F.col(text).isNotNull()).select(doc, F.posexplode(F.split(text, "\n", -1)).alias("line_no", "line"))


def headings(documents: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, line_no, level, heading, kind): lines marked by # or set in bold as a whole (level 7), with their class."""
    mark = F.regexp_extract("line", r"^\s*(#{1,6})\s+\S", 1)
    bold = F.regexp_extract("line", r"^\s*\*\*([^*]+)\*\*\s*$", 1)
    level = F.when(mark != "", F.length(mark)).when(bold != "", 7)
    name = F.trim(F.when(mark != "", F.regexp_replace("line", r"^\s*#+\s*|\s*#*\s*$", "")).otherwise(bold))
    return lines(documents, doc, text).where(level.isNotNull()).select(doc, "line_no", level.alias("level"), name.alias("heading"), articles.kind_column(name).alias("kind"))


def without_apparatus(documents: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, text): the text without irrelevant sections, each from its heading to the next of the same or a higher level.

    One fold over a document's lines, inside the JVM."""
    mark = lambda x: F.regexp_extract(x, r"^\s*(#{1,6})\s+\S", 1)
    state = "struct<level:int,kept:array<string>>"

    def step(acc: Column, x: Column) -> Column:
        level = F.length(mark(x))
        cut = articles.kind_column(F.trim(F.regexp_replace(x, r"^\s*#+\s*", ""))).isin("irrelevant", "paywall")
        now = F.when(level == 0, acc["level"]).when((acc["level"] > 0) & (level > acc["level"]), acc["level"]).when(cut, level).otherwise(0)
        return F.struct(now.cast("int").alias("level"), F.when(now == 0, F.concat(acc["kept"], F.array(x))).otherwise(acc["kept"]).alias("kept")).cast(state)

    start = F.struct(F.lit(0).alias("level"), F.array().cast("array<string>").alias("kept")).cast(state)
    folded = F.aggregate(F.split(text, "\n", -1), start, step)["kept"]
    return documents.select(doc, F.array_join(folded, "\n").alias(text))


def reference_lines(documents: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, reference_no, line): what follows the last references heading."""
    all_lines = lines(documents, doc, text)
    start = all_lines.where(F.col("line").rlike(r"(?i)^\s*(#{1,6}\s*|\*\*)?(references|bibliography)\b")).groupBy(doc).agg(F.max("line_no").alias("__s"))
    after = all_lines.join(start, doc).where((F.col("line_no") > F.col("__s")) & (F.trim("line") != ""))
    return after.select(doc, "line_no", "line")


def skeletons(quotes: DataFrame, doc: str, start: str, end: str, documents: DataFrame, text: str, gap: int = 60, share: float = 0.05, total: int = 5000, floor: int = 300) -> DataFrame:
    """(doc, island, start, end, passage): the quoted passages of a text, merged where nearly adjacent, until they come to
    the permitted share of it; the last is cut to fit at a blank and ends in an ellipsis.

    The budget is the lesser of ``total`` characters and the ``share`` of the text, but at least ``floor`` or all of it.
    """
    sized = documents.where(F.col(text).isNotNull()).select(doc, F.length(text).alias("__n"))
    valid = quotes.join(sized, doc).where((F.col(start) >= 0) & (F.col(end) > F.col(start)) & (F.col(start) < F.col("__n")))
    valid = valid.withColumn(end, F.least(end, "__n"))
    merged = islands.merged_spans(valid, [doc], start, end, gap).join(sized, doc).withColumn("__l", F.col(end) - F.col(start))
    budget = F.greatest(F.least(F.lit(total).cast("double"), F.col("__n") * share), F.least(F.lit(floor), F.col("__n")).cast("double")).cast("int")
    kept = islands.within_budget(merged, [doc], [start], "__l", budget)
    body = kept.join(documents.select(doc, text), doc)
    whole = F.substring(F.col(text), F.col(start) + 1, F.col("taken").cast("int"))
    clipped = F.concat(F.regexp_replace(whole, r"\s+\S*$", ""), F.lit("…"))
    return body.select(doc, "island", start, end, F.when(F.col("taken") < F.col("__l"), clipped).otherwise(whole).alias("passage"))


def source_kind(text: Column) -> Column:
    """EMPTY, ABSTRACT or FULL_TEXT: an abstract is short, has a heading that says so, and after the first heading none but
    such as accompany an abstract."""
    marks = F.regexp_extract_all(text, F.lit(r"(?m)^#+[ \t]+(.+?)[ \t]*$"), 1)
    beside = "(?i)^(?:" + "|".join(BESIDE_ABSTRACT) + r")\b"
    other = F.exists(F.slice(marks, 2, F.greatest(F.size(marks), F.lit(1))), lambda h: ~F.trim(h).rlike(beside))
    short = (F.length(text) <= ABSTRACT_LENGTH) & text.rlike(r"(?im)^#+[ \t]*abstract\b") & ~other
    return F.when(F.coalesce(F.regexp_replace(text, r"\s", ""), F.lit("")) == "", "EMPTY").when(short, "ABSTRACT").otherwise("FULL_TEXT")


def occurrences(spans: Column, segments: Column) -> Column:
    """How often a quote of so many segments occurs, of which each occurrence has a span."""
    return F.floor(F.size(spans) / F.greatest(segments, F.lit(1))).cast("int")


def occurrence_text(text: Column, spans: Column, number: Column) -> Column:
    """The text of the occurrence with this number, from 0; null if there is none."""
    span = F.try_element_at(spans, number + 1)
    return F.substring(text, span["s"] + 1, span["e"] - span["s"])


def relevant_text(text: Column, chunks: Column, spans: Column, pad: int) -> Column:
    """The chunks from the first to the last one that any span touches, and ``pad`` on either side; null if none is."""
    touched = F.flatten(F.transform(spans, lambda x: islands.chunks_of(chunks, x["s"], x["e"])))
    return F.when(F.size(touched) > 0, region_text(text, chunks, F.array_min(touched), F.array_max(touched), pad))


def chunk_contexts(text: Column, chunks: Column, span: Column, pad: int) -> Column:
    """For each chunk a span touches, its text with ``pad`` chunks on either side."""
    return F.transform(islands.chunks_of(chunks, span["s"], span["e"]), lambda k: region_text(text, chunks, k, k, pad))


def shift_headings(text: str, target: int) -> str:
    """Headings moved so that the highest is at ``target``; levels stay within 1 to 6."""
    levels = [len(m) for m in re.findall(r"(?m)^(#{1,6})\s", text)]
    by = target - min(levels, default=target)
    return re.sub(r"(?m)^(#{1,6})(\s)", lambda m: "#" * min(6, max(1, len(m.group(1)) + by)) + m.group(2), text)
