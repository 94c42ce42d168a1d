"""Session helpers: the shared scratch folder, settled tables and size checks."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A side is broadcast only when it was counted and its rows stay under this.
BROADCAST_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Where the setting is absent, a local master gets a temporary folder, which its
    single machine shares with itself; a cluster without the setting is an error.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
    base = tempfile.mkdtemp(prefix="tessera-")
    spark.conf.set("spark.checkpoint.dir", base)
    spark.sparkContext.setCheckpointDir(base)
    return base


#: Paths of the tables that settle has written and clear has not deleted, in order.
SETTLED: list[str] = []


#: Rows of a file of a settled table whose size is known before.
FILE_ROWS = 250_000
#: Writer's options for a shared folder on a plain disk (other stores do not read them): without checksum files, for
#: each of which the JVM would start a chmod process.
PLAIN = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def settle(df: DataFrame, label: str, rows: int | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts the lineage.

    rows: what df holds at most, if known; few rows are written in few files.
    """
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // FILE_ROWS)))
    df.write.options(compression="zstd", **PLAIN).parquet(path)
    SETTLED.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession, since: int = 0, last: bool = True) -> None:
    """Delete the settled tables from number `since` on, once no frame reads them any more; the latest stays if not last."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    gone = SETTLED[since:] if last else SETTLED[since:-1]
    for p in gone:
        path(p).getFileSystem(spark._jsc.hadoopConfiguration()).delete(path(p), True)
        SETTLED.remove(p)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, whose Python may not find it otherwise; once a session."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).parent
    # the driver's file server hands this small archive out for as long as the session lives
    with zipfile.ZipFile(f"{tempfile.mkdtemp(prefix='tessera-')}/tessera-{uuid.uuid4().hex}.zip", "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(z.filename)
    _SHIPPED.add(sc.applicationId)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it was counted to have at most that many rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def sized(rows: int) -> Callable[[DataFrame], DataFrame]:
    """The hint for a side of a join that has at most so many rows: broadcast if they are few enough, else merge.

    Without the latter Spark goes by the size of files, and broadcasts a settled table of millions of numbers, which
    zstd makes a few MB, through the driver.
    """
    return F.broadcast if rows <= BROADCAST_ROWS else lambda df: df.hint("merge")


def numbered(df: DataFrame, name: str, *order) -> DataFrame:
    """df with rows counted from 0 in the given order, without a window over all rows in one task.

    Rows are dealt to sorted ranges and numbered within each; a count for each range tells where it starts.
    """
    spark = df.sparkSession
    ranges = df.repartitionByRange(partitions(spark), *order).withColumn("__range", F.spark_partition_id())
    held = settle(ranges, "ranges")
    at, starts = 0, []
    for r in held.groupBy("__range").count().orderBy("__range").collect():  # a row for each partition
        starts.append((r["__range"], at))
        at += r["count"]
    begin = F.broadcast(spark.createDataFrame(starts, "__range int, __begin bigint"))
    within = F.row_number().over(Window.partitionBy("__range").orderBy(*order)) - 1
    return held.join(begin, "__range").withColumn(name, F.col("__begin") + within).drop("__range", "__begin")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame) -> DataFrame:
    """df, dealt out anew where it comes in fewer parts than the cluster has cores."""
    spark = df.sparkSession
    return df.repartition(partitions(spark)) if df.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism else df
