"""Session helpers: table access and lineage cuts that survive lost executors."""

from __future__ import annotations

import tempfile
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables; Catalyst prunes columns and pushes filters into the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a temporary folder only where that is unset, as in local tests."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="noticeweave-"))
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back.

    Never a localCheckpoint: with the files in a folder that all executors share, a lost executor loses nothing.
    """
    _shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as a compressed table to the shared checkpoint folder and read back.

    Like ``checkpoint``, but columns can be pruned when it is read and texts take a fraction of the space. The files
    are deleted when the application ends.
    """
    return df.sparkSession.read.schema(df.schema).parquet(_written(df))


def _written(df: DataFrame, *by: str) -> str:
    spark = df.sparkSession
    path = f"{_shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(there)
    return path


def stored_parts(df: DataFrame, by: str) -> str:
    """The path of ``df`` in the shared checkpoint folder, where ``part_rows`` reads the rows of one value of ``by`` within any task."""
    return _written(df, by)


def remove_parts(spark: SparkSession, path: str) -> None:
    """Delete what ``stored_parts`` wrote, once nothing reads it any more."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def part_rows(path: str, by: str, value: object, columns: list[str]) -> dict[str, list]:
    """Columns of the rows that ``stored_parts`` wrote for ``value``, read by Python; none if there are no files."""
    import pyarrow.fs
    import pyarrow.parquet

    url = urlparse(path)
    if url.scheme in ("", "file"):
        fs, root = pyarrow.fs.LocalFileSystem(), unquote(url.path) if url.scheme else path
    else:
        fs, root = pyarrow.fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
    rows: dict[str, list] = {c: [] for c in columns}
    for f in sorted(fs.get_file_info(pyarrow.fs.FileSelector(f"{root}/{by}={value}", allow_not_found=True)), key=lambda f: f.path):
        if f.path.endswith(".parquet"):
            with fs.open_input_file(f.path) as there:
                got = pyarrow.parquet.ParquetFile(there).read(columns, use_threads=False)
            for c in columns:
                rows[c] += got[c].to_pylist()
    return rows


def unsized(df: DataFrame) -> DataFrame:
    """``df`` without Spark's guess of its size, for few rows that Python turns into many: else joins would broadcast what comes out."""
    spark = df.sparkSession
    return DataFrame(spark._jsparkSession.createDataFrame(df._jdf.toDF().toJavaRDD(), df._jdf.schema()), spark)


def parallelism(spark: SparkSession) -> int:
    """Tasks that Python-heavy stages should have: a few waves of the cores at hand."""
    return max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(df: DataFrame, *cols: str) -> DataFrame:
    """Redistribute rows over the cluster before a Python stage, where files are few.

    One file of one row group is one task however many executors there are. Hashing by a unique key keeps
    retries deterministic, unlike a round-robin repartition.
    """
    return df.repartition(parallelism(df.sparkSession), *[F.col(c) for c in cols])


def bounded_broadcast(df: DataFrame, max_rows: int = 200_000) -> DataFrame:
    """Hint a broadcast of ``df`` only if it has at most ``max_rows`` rows; else leave the join to shuffle.

    ``df`` should be cheap to count, such as one that was checkpointed.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def numbered(df: DataFrame, group: list[str], order: list[str], count: str | None = None) -> DataFrame:
    """``df`` with ``n``, the place of each row from 0 in its group, and no task that holds a group.

    All rows are sorted over ranges at once; a row's place is its place in its range plus the sizes of the ranges before. With
    ``count``, a column of numbers, ``n`` is the sum of that column over the rows before instead.
    """
    parts = df.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
    parts = stored(parts.withColumn("_m", F.monotonically_increasing_id()))
    part = F.shiftright("_m", 33)
    weight = F.col(count).cast("long") if count else F.lit(1).cast("long")
    here = Window.partitionBy(part, *group).orderBy("_m")
    sizes = parts.groupBy(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)], part.alias("_p")).agg(F.sum(weight).alias("_w"))
    before = Window.partitionBy(*[f"_g{i}" for i in range(len(group))]).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_w").over(before), F.lit(0))).drop("_w")
    same = part == F.col("_p")
    for i, c in enumerate(group):
        same = same & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    own = F.coalesce(F.sum(weight).over(here.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = parts.withColumn("_own", own).join(bounded_broadcast(sizes), same)
    return rows.withColumn("n", F.col("_own") + F.col("_before")).drop("_m", "_p", "_own", "_before", *[f"_g{i}" for i in range(len(group))])
