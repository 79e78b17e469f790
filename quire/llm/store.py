"""Tables written on the way, which cut lineage and survive lost executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import work_path

#: Documents of some KB each: what an Arrow batch holds on both sides of a Python worker's socket stays at a few MB.
BATCHES = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),
    "spark.sql.parquet.columnarReaderBatchSize": "1000",  # what a scan holds unpacked, in arrays that double as they fill
}
#: Bytes of a row group, which a task holds whole as it writes or reads it.
GROUP = 8 << 20
_RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read back; the shuffle files it was made from are released."""
    spark = df.sparkSession
    path = work_path(spark, label)
    before = spark.conf.get(_RELEASE, "false")
    for key, value in BATCHES.items():
        spark.conf.set(key, value)
    spark.conf.set(_RELEASE, "true")
    try:
        df.write.option("parquet.block.size", GROUP).parquet(path)
    finally:
        spark.conf.set(_RELEASE, before)
    return spark.read.schema(df.schema).parquet(path)


def generation(df: DataFrame, label: str, before: str | None = None) -> tuple[DataFrame, str]:
    """df as a compressed table in the shared folder, and its path; the table at `before`, which df was read from, goes."""
    spark = df.sparkSession
    path = work_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    if before:
        old = spark._jvm.org.apache.hadoop.fs.Path(before)
        old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
    return spark.read.schema(df.schema).parquet(path), path


def shuffle_parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


#: Ids that may be broadcast: as a hash table of long keys, some tens of MB.
BROADCAST_ROWS = 1_000_000


def small_enough(ids: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A written table of ids, marked for broadcast if its counted rows are within the bound; else joined by shuffle."""
    return F.broadcast(ids) if ids.count() <= rows else ids
