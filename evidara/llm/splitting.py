"""Problem 4: pieces under a size limit that end at natural breaks and overlap."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Natural breaks, strongest first; a piece ends where the match ends.
BREAKS = (
    r"\n[ \t]*\n\s*",  # paragraph
    r"\n",  # line
    r"[.!?]['\")\]]*\s+",  # sentence
    r"[;:,]\s+",  # clause
    r"\s+",  # word
)
_BREAKS = [re.compile(b) for b in BREAKS]


def _snap(text: str, target: int, reach: int) -> int:
    """The end of the strongest break within ``reach`` of ``target``; of equally strong ones the nearest, then the earlier."""
    if reach < 1:
        return target
    low, high = max(1, target - reach), min(len(text) - 1, target + reach)
    for pattern in _BREAKS:
        best = None
        for m in pattern.finditer(text, max(0, low - 4), min(len(text), high + 4)):
            if low <= m.end() <= high and (best is None or abs(m.end() - target) < abs(best - target)):
                best = m.end()
        if best is not None:
            return best
    return target


def cut(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of the pieces of ``text``: as few as possible, about equally long, each at most ``limit`` characters.

    Each piece but the first starts ``overlap`` characters before the end of the one before it. The least number of
    pieces gives equally spaced targets, each is moved to the strongest break nearby, and a piece is added when a piece
    comes out too long. A text within the limit, or an empty one, is one piece.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be at least 0 and less than the limit")
    n = len(text)
    if n <= limit:
        return [(0, n)]
    step = limit - overlap
    least = -(-(n - overlap) // step)
    for count in range(least, least + least // 2 + 8):
        each = (n + (count - 1) * overlap) / count
        reach = int(min(limit * 0.15, (each - overlap) / 3))
        ends, start = [], 0
        for i in range(1, count):
            ends.append(_snap(text, round(i * (each - overlap) + overlap), reach))
            if not overlap < ends[-1] - start <= limit:
                break
            start = ends[-1] - overlap
        else:
            if overlap < n - start <= limit:
                return list(zip([0, *(e - overlap for e in ends)], [*ends, n], strict=True))
    # No room for equal pieces with moved ends: full pieces, each ending at the strongest break of its last part.
    out, start = [], 0
    while n - start > limit:
        end = start + limit
        back = (limit - overlap - 1) // 3
        if back:
            snapped = _snap(text, end - back // 2, back // 2)
            end = snapped if overlap < snapped - start <= limit and snapped != end - back // 2 else end
        out.append((start, end))
        start = end - overlap
    return [*out, (start, n)]


_PIECES = "array<struct<chunk_no:int,piece_no:int,start:int,end:int,text:string>>"


def _pieces_of(text: str, spans: list[tuple[int, int, int]], limit: int, overlap: int) -> list[dict]:
    out = []
    for number, start, end in spans:
        span = text[start:end]
        out += [{"chunk_no": number, "piece_no": k, "start": a, "end": b, "text": span[a:b]} for k, (a, b) in enumerate(cut(span, limit, overlap))]
    return out


def split_oversized(rows: DataFrame, keys: list[str], text: str, limit: int, overlap: int) -> DataFrame:
    """(keys, piece_no, start, end, text) for each row whose text is longer than ``limit`` characters.

    Positions are relative to the row's text, ``end`` exclusive. Rows within the limit, null and empty texts give no
    row. Repeated rows give repeated pieces; other columns are ignored. Only oversized texts leave the JVM.
    """
    large = rows.where(F.length(text) > limit).select(*keys, F.col(text).alias("__text"))

    @F.pandas_udf(_PIECES)
    def pieces(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([_pieces_of(t, [(0, 0, len(t))], limit, overlap) for t in batch])

    out = large.select(*keys, F.explode(pieces("__text")).alias("__p"))
    return out.select(*keys, *[F.col(f"__p.{c}").alias(c) for c in ("piece_no", "start", "end", "text")])


def chunk_bounds() -> Column:
    """(chunk_no, start, end) of the spans of ``chunks``, cut off at the end of ``text``.

    Null or empty ``chunks`` make the whole text span 0. A null start counts as 0, a null end as the end of the text, a
    span that is reversed or beyond the text as empty.
    """
    n = F.length("text")
    whole = F.array(F.struct(F.lit(0).alias("start"), n.alias("end")))
    spans = F.when(F.coalesce(F.size("chunks"), F.lit(0)) > 0, F.col("chunks")).otherwise(whole)

    def bound(span: Column, number: Column) -> Column:
        start = F.least(F.greatest(F.coalesce(span["start"], F.lit(0)), F.lit(0)), n)
        return F.struct(number.alias("chunk_no"), start.alias("start"), F.greatest(start, F.least(F.coalesce(span["end"], n), n)).alias("end"))

    return F.transform(spans, bound)


def split_chunks(resources: DataFrame, limit: int, overlap: int) -> DataFrame:
    """(doc_id, chunk_no, piece_no, start, end, text) for each span of ``chunks`` longer than ``limit`` characters.

    Spans are those of ``chunk_bounds``; positions are relative to the span. Null texts give no row. Each text leaves the JVM once, with its oversized spans, and only if it has any.
    """
    large = F.filter(chunk_bounds(), lambda s: s["end"] - s["start"] > limit)
    rows = resources.where(F.col("text").isNotNull()).select("doc_id", "text", large.alias("spans")).where(F.size("spans") > 0)

    @F.pandas_udf(_PIECES)
    def pieces(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([_pieces_of(t, [(s["chunk_no"], s["start"], s["end"]) for s in x], limit, overlap) for t, x in zip(texts, spans, strict=True)])

    out = rows.select("doc_id", F.explode(pieces("text", "spans")).alias("p"))
    return out.select("doc_id", *[F.col(f"p.{c}").alias(c) for c in ("chunk_no", "piece_no", "start", "end", "text")])


def size_limit(limits: DataFrame, name: str) -> tuple[int, int] | None:
    """(max_size, overlap_size) of a limit; null parts make 0 overlap; None if there is no such limit."""
    row = limits.where(F.col("limit_name") == name).agg(F.max("max_size").alias("m"), F.max("overlap_size").alias("o")).first()
    return (row["m"], row["o"] or 0) if row["m"] else None
