"""Shared-folder tables: how the operators cut lineage so that a lost executor costs one stage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FALLBACK: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where none is set, a temporary one if the master is local, else an error.

    Executors of a cluster don't share the driver's temporary folders.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[.*\])?", master):
        raise RuntimeError(f"set spark.checkpoint.dir to a folder that all machines of {master} share")
    return _FALLBACK.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="axisloom-"))


def table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._shared_path = path
    return back


def table_by(df: DataFrame, key: str, name: str) -> DataFrame:
    """Like :func:`table`, in buckets of ``key``: joins on it read the table without shuffling it again."""
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    known = f"axisloom_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}-{known}"
    df.repartition(buckets, key).write.bucketBy(buckets, key).option("path", path).saveAsTable(known)
    back = spark.table(known)
    back._shared_path, back._shared_table = path, known
    return back


def unbucketed(df: DataFrame) -> DataFrame:
    """What :func:`table_by` wrote, read without its buckets: joins shuffle it, so that a hot key on the other side can be split."""
    return df.sparkSession.read.schema(df.schema).parquet(df._shared_path)


def drop_table(*tables: DataFrame) -> None:
    """Delete what :func:`table` or :func:`table_by` wrote for some frames, once nothing reads them any more."""
    for df in tables:
        known = getattr(df, "_shared_table", None)
        if known:
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {known}")
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df._shared_path)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the supplied tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
