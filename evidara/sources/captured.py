"""Captured search responses as a table, in place of network clients."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidara.sources.readers import responses

_RESULT = "struct<query:string,results:array<struct<title:string,url:string,content:string,score:double>>>"


def captured_search(spark: SparkSession, path: str) -> DataFrame:
    """(query, position, title, url, snippet, score) of the JSON responses under ``path``, on any file system Spark reads.

    A file holds {"query": ..., "results": [{"title", "url", "content", "score"}, ...]}; results without URL are left
    out, and a file that is no JSON gives no rows, as a failed query would.
    """
    rows = responses(spark, path).select(F.from_json("content", _RESULT).alias("r")).select("r.query", F.posexplode("r.results").alias("position", "x"))
    return rows.where("x.url <> ''").select("query", "position", "x.title", "x.url", F.col("x.content").alias("snippet"), F.coalesce("x.score", F.lit(0.0)).alias("score"))
