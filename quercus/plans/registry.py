"""Named queries over the driver's tables and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F


def table(spark, sf_dir, name):
    """One parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


QUERIES: dict = {}
ORACLES: dict = {}


def query(name, sql=None):
    """Register a query function, with its SQL where SQL can express it."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


@query(
    "long_documents",
    """SELECT doc_id, count(DISTINCT line) AS n_lines
       FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
       WHERE trim(line) <> '' GROUP BY doc_id HAVING count(DISTINCT line) > 20""",
)
def long_documents(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return (
        lines.where(F.trim("line") != "")
        .distinct()
        .groupBy("doc_id")
        .agg(F.count("*").alias("n_lines"))
        .where("n_lines > 20")
    )
