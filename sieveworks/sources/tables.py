"""Relational sources: JDBC or stored tables with pushed-down projections, query tables, catalog inspection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Connection:
    """Where a database is; credentials come from the caller, never from files of the repository."""

    url: str
    driver: str | None = None
    fetch_size: int = 10000

    @classmethod
    def from_properties(cls, text: str) -> Connection:
        p = dict(line.split("=", 1) for line in text.splitlines() if "=" in line and not line.startswith("#"))
        return cls(p["url"].strip(), p.get("driver", "").strip() or None, int(p.get("fetchSize", "10000")))


def jdbc(spark: SparkSession, at: Connection, query: str, properties: dict | None = None) -> DataFrame:
    """A query's rows, streamed in fetches; Spark pushes further projections and filters down."""
    reader = spark.read.format("jdbc").option("url", at.url).option("query", query).option("fetchsize", at.fetch_size)
    for k, v in ({"driver": at.driver} if at.driver else {} | (properties or {})).items():
        reader = reader.option(k, v)
    return reader.load()


def data(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*columns)


def data_between(df: DataFrame, columns: list[str], key: str, low, high) -> DataFrame:
    """Rows with low < key < high."""
    return df.where((F.col(key) > low) & (F.col(key) < high)).select(*columns)


def entity_queries(queries: DataFrame, max_mrr: float | None = None, relevant: DataFrame | None = None) -> DataFrame:
    """A query table's rows with trimmed text, commas as blanks, and the text as name and description attributes."""
    out = queries
    if max_mrr is not None:
        out = out.where(F.col("mrr") < max_mrr)
    if relevant is not None:
        out = out.join(relevant.select("fbid"), "fbid", "left_semi")
    text = F.translate(F.trim("text"), ",", " ")
    return out.withColumn("text", text).withColumn("attribs", F.create_map(F.lit("name"), F.col("text"), F.lit("description"), F.col("text")))


def add_attribute(queries: DataFrame, name: str, value: str) -> DataFrame:
    return queries.withColumn("attribs", F.map_concat("attribs", F.create_map(F.lit(name), F.lit(value))))


def question_queries(questions: DataFrame) -> DataFrame:
    """(qid, text, freq, answer): all known answers, or the accepted one if none is known."""
    answers = F.when(F.size("all_answers") > 0, F.col("all_answers")).otherwise(F.array("accepted"))
    return questions.select(F.col("id").alias("qid"), "text", F.col("test_views").alias("freq"), F.explode(answers).alias("answer"))


def catalog(spark: SparkSession, database: str = "default") -> DataFrame:
    """(table_name, column_name, data_type) of a database's tables."""
    rows = [(t.name, c.name, c.dataType) for t in spark.catalog.listTables(database) for c in spark.catalog.listColumns(t.name if t.isTemporary else f"{database}.{t.name}")]
    return spark.createDataFrame(rows, "table_name string, column_name string, data_type string")


def drop_like(spark: SparkSession, prefix: str) -> int:
    """Drop temporary views by prefix; returns their number."""
    names = [t.name for t in spark.catalog.listTables() if t.isTemporary and t.name.startswith(prefix)]
    for n in names:
        spark.catalog.dropTempView(n)
    return len(names)


def table_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def is_empty(df: DataFrame) -> bool:
    return df.isEmpty()
