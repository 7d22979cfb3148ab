"""Reading tables and cutting lineage through the shared folder of the cluster."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` in at least as many partitions as there are cores, for stages that work long on each row. A table of more
    partitions, which is any large one, stays as it is and isn't shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``; where that is unset, a temporary one in local mode
    and an error on a cluster, whose machines don't share one."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="lanternfish-")
        sc.setCheckpointDir(at)
        at = sc.getCheckpointDir() or at
    return at


def write_lines(texts: DataFrame, path: str) -> None:
    """Reports and locks, one text column, as lines of text files; the folder must not be there yet."""
    texts.write.text(path, lineSep="\n")


def cut(df: DataFrame, name: str, schema: StructType | None = None) -> DataFrame:
    """Write ``df`` into the shared folder and read it back: later plans start from the files, so a lost
    executor costs no recomputation. schema: types to read it with where they are stored alike. The files are removed
    when the driver's Python ends."""
    spark = df.sparkSession
    at = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").parquet(at)
    _written.append((spark, at))
    return spark.read.schema(schema or df.schema).parquet(at)


#: A table is broadcast up to this many narrow rows; beyond it :func:`looked_up` joins by salted keys and :func:`unsent` by merging.
BROADCAST_ROWS = 200_000
SALTS = 32


def unsent(table: DataFrame) -> DataFrame:
    """A table of :func:`cut` as a side of joins. Spark takes the size of its compressed files for that of its rows, which
    may be forty times as much, and would broadcast millions of them through the driver; a long one is merged instead."""
    return table if table.count() <= BROADCAST_ROWS else table.hint("merge")


def looked_up(rows: DataFrame, table: DataFrame, keys: list[str], by: str) -> DataFrame:
    """``rows`` left joined with a table of unique ``keys``, whatever share of the rows one key holds: a lookup while the
    table is short, else each key's rows are spread over SALTS tasks by the hash of the column ``by``, and the table is
    repeated for each."""
    if table.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(table), keys, "left")
    salted = table.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("__salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).join(salted.hint("merge"), [*keys, "__salt"], "left").drop("__salt")


def release() -> None:
    """Remove every table written by :func:`cut`."""
    while _written:
        spark, at = _written.pop()
        try:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # the session is gone; nothing can be removed through it
            pass


atexit.register(release)
