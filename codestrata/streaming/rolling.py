"""Rolling hotspots and daily velocity over a stream of touches or commits."""

import uuid

from pyspark.sql import DataFrame, functions as F

from ..session import shared_folder


def rolling_hotspots(touches: DataFrame, window: str = "30 days", slide: str = "1 day",
                     watermark: str = "1 day", time: str = "committed_at") -> DataFrame:
    """Touches per file and sliding window; rows later than the watermark are dropped."""
    return (touches.withWatermark(time, watermark)
            .groupBy(F.window(time, window, slide).alias("w"), "repo_id", "file_path")
            .agg(F.count(F.lit(1)).alias("touches"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                    "repo_id", "file_path", "touches"))


def daily_velocity(commits: DataFrame, watermark: str = "1 day", time: str = "committed_at") -> DataFrame:
    """Commits per repository and day."""
    return (commits.withWatermark(time, watermark)
            .groupBy(F.window(time, "1 day").alias("w"), "repo_id")
            .agg(F.count(F.lit(1)).alias("commits"))
            .select(F.to_date("w.start").alias("day"), "repo_id", "commits"))


def drain(result: DataFrame, folder: str | None = None) -> DataFrame:
    """Run a windowed stream over all data there is and return the windows that are final.

    Append mode: a window is written once, when the watermark has passed its end, and its state goes at that
    moment; rows later than the watermark are dropped, and windows still open wait in the state. ``close``
    ends a stream. The stream's progress is kept beside the result, so a run in the same folder goes on where the
    last one stopped.
    """
    spark = result.sparkSession
    base = folder or f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    target = f"{base}/result"
    # A stream without any final window still leaves a readable, empty table.
    spark.createDataFrame([], result.schema).write.mode("ignore").parquet(target)
    query = (result.writeStream.outputMode("append").foreachBatch(
                 lambda batch, number: batch.write.mode("overwrite").parquet(f"{target}/batch={number}"))
             .option("checkpointLocation", f"{base}/progress").trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(result.schema).option("recursiveFileLookup", "true").parquet(target)


def close(rows: DataFrame, at: str, time: str = "committed_at") -> DataFrame:
    """One row without a key at time ``at``: appended to a stream's source it moves the watermark past all windows
    that end before ``at`` less the watermark's delay, and so closes them.

    Windows of the row itself carry a null key and stay open.
    """
    one = rows.sparkSession.range(1)
    return one.select(*[F.lit(at).cast(f.dataType).alias(f.name) if f.name == time
                        else F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema])
