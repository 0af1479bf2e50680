"""Session-level helpers of the llm operators: scratch tables, input readers, deletions."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_root(spark: SparkSession) -> str:
    """The folder shared by driver and executors, from ``spark.checkpoint.dir``.

    Only a local master may leave the setting unset (as in tests); it then gets
    a temporary folder of its own.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or getattr(
        spark.sparkContext, "_own_scratch", None
    )
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    root = "file://" + tempfile.mkdtemp(prefix="scratch-")
    spark.sparkContext.setCheckpointDir(root)
    spark.sparkContext._own_scratch = root
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the application's own part of the shared folder. Hadoop's file
    system deletes that part when the driver ends, so results that are still
    lazy may read from it until then."""
    mine = f"{scratch_root(spark)}/{spark.sparkContext.applicationId}"
    if getattr(spark.sparkContext, "_scratch_owner", None) != mine:
        p = spark._jvm.org.apache.hadoop.fs.Path(mine)
        fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
        # deleteOnExit only takes paths that exist
        fs.mkdirs(p)
        fs.deleteOnExit(p)
        spark.sparkContext._scratch_owner = mine
    return f"{mine}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the
    lineage, survives lost executors. Returns the new frame and its path."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch table through Hadoop's file system API."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(col: str, n: int):
    """crc32 of the value as text, modulo ``n`` (null ids count as empty text)."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % n


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` doesn't have yet."""
    taken, name = {c.lower() for c in df.columns}, base
    while name.lower() in taken:
        name += "_"
    return name

