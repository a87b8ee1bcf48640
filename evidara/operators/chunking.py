"""Texts cut into pieces of whole sentences, without a model."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sentence_chunks(documents: DataFrame, doc: str, text: str, words: int) -> DataFrame:
    """(doc, chunk_no, text, wordcount): pieces of whole sentences; a sentence goes to the piece that the words before it in
    the text have come to, ``words`` to a piece, so a piece holds less than ``words`` and one sentence.

    Null and blank texts give no row. A window runs over one document's sentences.
    """
    split = F.filter(F.split(text, r"(?<=[.!?])\s+|\n+"), lambda s: F.trim(s) != "")
    sentences = documents.where(F.col(text).isNotNull()).select(doc, F.posexplode(split).alias("i", "s")).withColumn("n", F.size(F.split(F.trim("s"), r"\s+")))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(doc).orderBy("i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pieces = sentences.withColumn("k", F.floor(before / words)).groupBy(doc, "k").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda x: F.trim(x["s"])), " ").alias("text"), F.sum("n").alias("wordcount"))
    number = F.row_number().over(Window.partitionBy(doc).orderBy("k")) - 1
    return pieces.withColumn("chunk_no", number).select(doc, "chunk_no", "text", "wordcount")
