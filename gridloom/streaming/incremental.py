"""Point sets that follow a stream of updates, a micro-batch at a time.

The state is a Parquet table in versions, named by the number of the batch that wrote them; a
version counts once its success mark is there. A batch that is repeated after a failure writes the
same version again, from the one before it. The last KEEP versions stay.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Versions that stay.
KEEP = 3


def version(path: str, batch: int) -> str:
    return f"{path}/v={batch}"


def follow(updates: DataFrame, path: str, id: str, coords: Sequence[str], checkpoint: str, empty: DataFrame, trigger: dict | None = None):
    """Start a query that applies `updates` (id, coordinates, op: insert or delete; the last op of an id in a batch by `seq` wins)."""

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        last = batch.groupBy(id).agg(F.max_by(F.struct(*coords, "op"), "seq").alias("u"))
        state = spark.read.parquet(version(path, number - 1)) if number else empty
        new = last.where("u.op = 'insert'").select(id, *[F.col("u")[c].alias(c) for c in coords])
        state.select(id, *coords).join(last.select(id), id, "left_anti").unionByName(new).write.mode("overwrite").parquet(version(path, number))
        if number >= KEEP:  # a batch that is run again needs the version before it, readers the newest; older ones go
            old = spark._jvm.org.apache.hadoop.fs.Path(version(path, number - KEEP))
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)

    return updates.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The newest version that was written whole."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    numbers = [int(s.getPath().getName()[2:]) for s in fs.listStatus(root) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return spark.read.parquet(version(path, max(numbers)))


def window_counts(events: DataFrame, time: str, late: str, length: str, slide: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Points by time window and group, late ones up to a watermark."""
    w = F.window(time, length, slide) if slide else F.window(time, length)
    return events.withWatermark(time, late).groupBy(w, *by).agg(F.count(F.lit(1)).alias("n"))
