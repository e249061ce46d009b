"""Result writers."""

from pyspark.sql import DataFrame, functions as F


def write_insights(documents: DataFrame, path: str) -> None:
    """One JSON document per row, dates in ISO-8601, one folder per repository."""
    (documents.write.mode("overwrite").partitionBy("repo_id")
     .option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss").json(path))


def pretty_json(documents: DataFrame, column: str = "document") -> DataFrame:
    """``repo_id`` and the other columns of the row as indented JSON text."""
    body = F.struct(*[c for c in documents.columns if c != "repo_id"])
    options = {"pretty": "true", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss",
               "ignoreNullFields": "false"}
    return documents.select("repo_id", F.to_json(body, options).alias(column))


def write_bucketed(df: DataFrame, table: str, keys=("repo_id", "commit_hash"), buckets: int = 1024) -> None:
    """Managed table bucketed on the commit keys: later joins on them need no exchange."""
    df.write.mode("overwrite").format("parquet").bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(table)
