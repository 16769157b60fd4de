"""Session settings, lineage cuts and the size limits shared by all operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: A side is broadcast only when its known size is below this many bytes.
BROADCAST_BYTES = 64 * 1024 * 1024
#: Bytes of one stored entry (two 64-bit indices and a double).
ENTRY_BYTES = 24
#: A key with more entries than this is split over several tasks.
HOT_ENTRIES = 1_000_000
#: A key that makes more pairs than this in a join is split, whatever its entries.
HOT_PAIRS = 1_000_000_000
#: Largest number of doubles in one dense block.
MAX_BLOCK_CELLS = 1 << 22


def build_session(app: str = "blockweave", master: str | None = None, **options: str) -> SparkSession:
    """A session with adaptive execution and checkpoint clean-up switched on."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    if master:
        builder = builder.master(master)
    for key, value in options.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts: the session's own, or a temporary one in local mode."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    wanted = spark.conf.get("spark.checkpoint.dir", None)
    if not wanted:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        wanted = tempfile.mkdtemp(prefix="blockweave-")
    context.setCheckpointDir(wanted)
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back with no lineage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared checkpoint folder, for tables written on the way."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
