"""Small tables that later passes lean on: cut from their lineage, size-checked."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Largest lookup table that is broadcast; override with this session setting.
BROADCAST_SETTING = "spark.tablog.broadcastBytes"
BROADCAST_BYTES = 256 * 1024 * 1024
# The driver holds a lookup as rows, as a hash table several times their size and in
# blocks to send, so without the setting one has no more than this part of its heap.
HEAP_PARTS = 32
# Beyond that size a key is hot if it has more than this share of a task's rows
# on average, and is dealt to so many tasks that none has more.
HOT_SHARE = 1.0


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see, as named by ``spark.checkpoint.dir``.

    Only a session whose tasks run in the driver may do without: a temporary
    folder of one machine would lose the rows of the others.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        folder = spark.sparkContext.getCheckpointDir()
    if folder is None:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that {master} shares")
        folder = tempfile.mkdtemp(prefix="tablog-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path for a table written in the shared folder."""
    return f"{shared_folder(spark)}/tablog/{label}-{uuid.uuid4().hex}"


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a file or folder, if it is there."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def durable(df: DataFrame) -> DataFrame:
    """The rows computed once and kept where a lost executor cannot take them."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def row_bytes(df: DataFrame) -> Column:
    """Rough size of one row in memory."""
    total = F.lit(16)
    for column in df.schema:
        kind = column.dataType
        if isinstance(kind, (T.StringType, T.BinaryType)):
            total = total + F.coalesce(F.octet_length(column.name), F.lit(0)) + 8
        elif isinstance(kind, T.ArrayType):
            total = total + F.greatest(F.size(column.name), F.lit(0)) * 16 + 16
        elif isinstance(kind, T.StructType):
            total = total + 24 + 8 * len(kind)
        else:
            total = total + 8
    return total


def broadcast_limit(spark: SparkSession) -> int:
    """Bytes of rows that may be broadcast: as set, or what the driver can hold."""
    heap = spark._jvm.Runtime.getRuntime().maxMemory()
    return int(spark.conf.get(BROADCAST_SETTING, str(min(BROADCAST_BYTES, heap // HEAP_PARTS))))


def fits_broadcast(lookup: DataFrame) -> bool:
    """Whether the lookup, measured, is small enough to send to every executor."""
    size = lookup.agg(F.coalesce(F.sum(row_bytes(lookup)), F.lit(0))).first()[0]
    return size <= broadcast_limit(lookup.sparkSession)


def attach(
    data: DataFrame,
    lookup: DataFrame,
    keys: list[str],
    spread: str,
    how: str = "left",
    small: bool | None = None,
) -> DataFrame:
    """Join a lookup to the data, leaving the data where it is.

    A lookup that fits is broadcast.  A larger one is shuffled.  Then rows are
    counted by key first, and a key with more rows than a task should have is
    salted by ``spread``: its rows go to as many tasks as they fill, and only
    its rows of the lookup are copied to these.
    """
    if fits_broadcast(lookup) if small is None else small:
        return data.join(F.broadcast(lookup), keys, how)
    if spread in keys:  # unique on both sides: nothing to spread
        return data.join(lookup.hint("merge"), keys, how)
    hot = hot_keys(data, keys)
    if hot is None:
        return data.join(lookup.hint("merge"), keys, how)
    salts = F.coalesce("_salts", F.lit(1).cast("bigint"))
    salted = data.join(F.broadcast(hot), keys, "left")
    salted = salted.withColumn("_salt", F.pmod(F.xxhash64(spread), salts)).drop("_salts")
    copied = lookup.join(F.broadcast(hot), keys, "left")
    copied = copied.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), salts - 1)))
    return salted.join(copied.drop("_salts").hint("merge"), [*keys, "_salt"], how).drop("_salt")


def hot_keys(data: DataFrame, keys: list[str]) -> DataFrame | None:
    """``_salts``, by measured rows, for keys that are too many for one task; None if there are none.

    No more keys are hot than the shuffle has tasks, divided by ``HOT_SHARE``.
    """
    tasks = int(data.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = durable(data.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")))
    share = max(int((counts.agg(F.sum("_rows")).first()[0] or 0) * HOT_SHARE / tasks), 1)
    hot = durable(
        counts.where(F.col("_rows") > share).select(*keys, F.ceil(F.col("_rows") / share).alias("_salts"))
    )
    return None if hot.isEmpty() else hot
