import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from evidara.llm.splitting import chunk_bounds, cut, size_limit, split_chunks, split_oversized


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab .,;\n\té😀", max_size=600), st.integers(5, 60), st.integers(0, 40))
def test_pieces_fit_overlap_and_rebuild(text, limit, overlap):
    if overlap >= limit:
        with pytest.raises(ValueError):
            cut(text, limit, overlap)
        return
    pieces = cut(text, limit, overlap)
    assert all(0 <= e - s <= limit for s, e in pieces)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    rebuilt = text[: pieces[0][1]]
    for (_, last), (s, e) in zip(pieces, pieces[1:]):
        assert s == last - overlap and e > last
        rebuilt += text[last:e]
    assert rebuilt == text
    assert len(pieces) == 1 or len(text) > limit


def test_breaks_are_preferred():
    text = "\n\n".join(" ".join(["word"] * 18) + "." for _ in range(10))
    pieces = cut(text, 300, 20)
    assert len(pieces) == -(-(len(text) - 20) // 280) or len(pieces) == -(-(len(text) - 20) // 280) + 1
    assert all(text[:e].endswith(("\n\n", " ", "\n")) for _, e in pieces[:-1])


def test_spans_and_defined_cases(spark):
    schema = "doc_id string, text string, chunks array<struct<start:int,end:int>>, piece_no int, start int"
    rows = [
        ("a", "x" * 50, None, 1, 1), ("b", "x" * 50, [], 1, 1), ("c", "x" * 50, [(0, 10), (5, 999), (60, 70), (9, 3), (None, None)], 1, 1),
        ("d", None, [(0, 99)], 1, 1), ("e", "", None, 1, 1),
    ]
    df = spark.createDataFrame(rows, schema)
    size = {(r["doc_id"], s["chunk_no"]): s["end"] - s["start"] for r in df.select("doc_id", chunk_bounds().alias("s")).where("doc_id <> 'd'").collect() for s in r["s"]}
    assert size == {("a", 0): 50, ("b", 0): 50, ("c", 0): 10, ("c", 1): 45, ("c", 2): 0, ("c", 3): 0, ("c", 4): 50, ("e", 0): 0}
    pieces = split_chunks(df, 44, 4).collect()
    assert {(r["doc_id"], r["chunk_no"]) for r in pieces} == {("a", 0), ("b", 0), ("c", 1), ("c", 4)}
    assert all(len(r["text"]) == r["end"] - r["start"] <= 44 for r in pieces)
    assert split_chunks(df.limit(0), 44, 4).count() == 0 and split_oversized(df.limit(0), ["doc_id"], "text", 44, 4).count() == 0
    whole = split_oversized(df, ["doc_id"], "text", 44, 4).collect()
    assert {r["doc_id"] for r in whole} == {"a", "b", "c"} and all(r["text"] == "x" * (r["end"] - r["start"]) for r in whole)


def test_full_pieces_end_at_breaks_too():
    text = "ab cde fgh " * 40
    pieces = cut(text, 12, 8)
    assert sum(text[e - 1] == " " for _, e in pieces[:-1]) >= 0.2 * len(pieces)


def test_limits(spark):
    limits = spark.createDataFrame([("chunk", 20, None)], "limit_name string, max_size int, overlap_size int")
    assert size_limit(limits, "chunk") == (20, 0) and size_limit(limits, "none") is None
