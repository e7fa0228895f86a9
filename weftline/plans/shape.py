"""Lineage cuts, checked broadcasts and partition counts."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a side that may be broadcast.  The callers' rows are narrow (under
#: about 100 bytes), so this bounds a broadcast to some 10 MB.
BROADCAST_ROWS = 100_000


def shuffle_partitions(spark: SparkSession) -> int:
    """Partitions of a shuffle, as set in the session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder that the cluster names in ``spark.checkpoint.dir``.

    Only where none is set and the session is local, as in tests, a temporary
    folder is made, which goes with the process; on a cluster a missing folder
    is an error, since files on one machine would be lost with it.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            named = tempfile.mkdtemp(prefix="weftline-")
            atexit.register(shutil.rmtree, named, True)
        context.setCheckpointDir(named)
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and written to the shared checkpoint folder.

    It runs when it is called.  Spark removes the files once the frame is no
    longer used, where ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set.
    """
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def narrowed(df: DataFrame, *columns: str) -> DataFrame:
    """``df``, a few rows, computed once, with its decimal(38, 0) columns as bigint if all their values fit; one that holds a greater value stays decimal(38, 0)."""
    df = cut(df)
    least, most = -(1 << 63), (1 << 63) - 1
    ends = df.agg(*[f(c).alias(f"{f.__name__}_{c}") for c in columns for f in (F.min, F.max)]).first()
    fit = [c for c in columns if ends[f"min_{c}"] is None or least <= ends[f"min_{c}"] and ends[f"max_{c}"] <= most]
    return df.withColumns({c: F.col(c).cast("bigint") for c in fit})


def within(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``rows`` rows; reads no more than it must."""
    return df.limit(rows + 1).count() <= rows


def broadcast_within(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it is small, else as it is.

    Without the hint the planner shuffles both sides and AQE splits skewed
    partitions.
    """
    return F.broadcast(df) if within(df, rows) else df


def semi_by_keys(rows: DataFrame, keys: DataFrame, columns: list[str], bound: int = BROADCAST_ROWS, salts: int = 32) -> DataFrame:
    """Rows whose ``columns`` occur in ``keys`` (distinct, without NULLs).

    A small key set is broadcast.  A larger one is repeated under each of
    ``salts`` values and the rows are spread over them, so that a key with a
    large share of all rows is met by many tasks.
    """
    if within(keys, bound):
        return rows.join(F.broadcast(keys), columns, "left_semi")
    salted = keys.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    spread = rows.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(c) for c in rows.columns]), F.lit(salts)).cast("int"))
    return spread.join(salted, [*columns, "_salt"], "left_semi").drop("_salt")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores, where it is a scan of fewer partitions than there are cores.

    For steps whose cost is in their own work, not in moving rows: a table in a
    few small files would otherwise leave cores idle.  Tables with more
    partitions than cores are not moved.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if (tasks_of(df) or cores) < cores else df


def tasks_of(df: DataFrame) -> int | None:
    """Partitions of a plan without a shuffle; None where only running it would tell."""
    plan = df._jdf.queryExecution()
    return None if "Exchange" in plan.executedPlan().toString() else plan.toRdd().getNumPartitions()
