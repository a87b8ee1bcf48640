"""Readers and writers: URL and term lists, captured responses, run files, pair reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidara.functions import scalars

RESOURCES = "doc_id string, url string, title string, text string, chunks array<struct<start:int,end:int>>, doi string, publication_date string"
RUN = f"topic string, resources array<struct<{', '.join(c.replace(' ', ':', 1) for c in RESOURCES.split(', '))}>>, judgments array<struct<entity1:string,kind1:string,entity2:string,kind2:string,relationship:string,accepted:boolean,overall:int>>, usage map<string,bigint>"


def url_list(spark: SparkSession, path: str) -> DataFrame:
    """The lines of text files that are not blank, trimmed."""
    return spark.read.text(path).select(F.trim("value").alias("url")).where("url <> ''")


def term_list(spark: SparkSession, path: str) -> DataFrame:
    """(name, kind, attributes) of 'name # remark &key=value' lines; lines without a name are left out."""
    return spark.read.text(path).select(scalars.term_line(F.col("value")).alias("t")).where("t IS NOT NULL").select("t.*")


def run_file(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """A run's JSON document as tables: run, resources, judgments, usage."""
    run = spark.read.schema(RUN).option("multiLine", True).json(path)
    return {
        "run": run.select("topic", F.coalesce(F.size("resources"), F.lit(0)).alias("resources"), F.coalesce(F.size("judgments"), F.lit(0)).alias("judgments")),
        "resources": run.select(F.posexplode("resources").alias("ord", "r")).select("ord", "r.*"),
        "judgments": run.select(F.posexplode("judgments").alias("ord", "j")).select("ord", "j.*"),
        "usage": run.select(F.explode("usage").alias("agent", "tokens")),
    }


def save_run(tables: dict[str, DataFrame], path: str, stage: str) -> None:
    """Tables as Parquet under the stage's folder; a stage written again replaces itself only."""
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{path}/stage={stage}/{name}")


def load_run(spark: SparkSession, path: str, stage: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/stage={stage}/{n}") for n in names}


def responses(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of captured responses, one a file."""
    return spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def write_report(pairs: DataFrame, path: str) -> None:
    """One line a pair, tab-separated, in the order of the table."""
    pairs.select(F.concat_ws("\t", *[F.col(c).cast("string") for c in pairs.columns]).alias("value")).write.mode("overwrite").text(path)
