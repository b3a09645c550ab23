"""Micro-batches over files: counts per day, and a snapshot kept by upserts."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from noticeweave.operators.merge import upsert


def read_stream(spark: SparkSession, path: str, schema: StructType, files: int = 16) -> DataFrame:
    """Files that arrive in ``path`` as a stream, so many per micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def daily_counts(events: DataFrame, at: str, group: str, hours: int = 8, late: str = "1 day") -> DataFrame:
    """``(day, group, n)`` by local day of UTC+``hours``; rows later than ``late`` behind the newest are dropped.

    ``at`` must be a timestamp. The same function serves batches, where the watermark has no effect.
    """
    start = f"{(24 - hours) % 24} hours"
    w = F.window(at, "1 day", startTime=start)
    day = F.to_date(F.col("w.start") + F.make_dt_interval(F.lit(0), F.lit(hours), F.lit(0), F.lit(0)))
    return events.withWatermark(at, late).groupBy(w.alias("w"), group).agg(F.count(F.lit(1)).alias("n")).select(day.alias("day"), group, "n")


def run_available(stream: DataFrame, sink: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there now and stop; a restart with the same checkpoint goes on after it."""
    stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(sink).awaitTermination()


def keep_snapshot(stream: DataFrame, folder: str, checkpoint: str, key: str, order: str, keep_old: list[str], fill: list[str] = ()) -> None:
    """Upsert every micro-batch into a snapshot under ``folder``.

    Each batch writes the next version beside the last and readers take the newest complete one, so a failed batch is
    written again without harm; versions before the last two are removed.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = latest(spark, folder, before=number)
        new = batch if old is None else upsert(old, batch, key, order, keep_old, fill)
        if old is None:
            new = upsert(batch.limit(0), batch, key, order, [], [])
        new.write.mode("overwrite").parquet(f"{folder}/v{number:012d}")
        fs, path = _fs(spark, folder)
        for s in fs.listStatus(path):
            name = s.getPath().getName()
            if name.startswith("v") and int(name[1:]) < number - 1:
                fs.delete(s.getPath(), True)

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _fs(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    return fs, path


def latest(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame | None:
    """The newest complete version of a snapshot."""
    fs, path = _fs(spark, folder)
    done = [s.getPath().getName() for s in fs.listStatus(path)]
    done = [n for n in done if n.startswith("v") and (before is None or int(n[1:]) < before)]
    done = [n for n in sorted(done) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(os.path.join(folder, n, "_SUCCESS")))]
    return spark.read.parquet(f"{folder}/{done[-1]}") if done else None
