"""Session settings the operators are tuned for."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

PARTITION_BYTES = 256 << 20
MIN_PARTITIONS = 200

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # A hot author or word is split at run time, also below an operator that
    # would otherwise reuse the join's partitioning.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def shuffle_partitions_for(shuffled_bytes: int) -> int:
    """Shuffle partitions so that each holds about :data:`PARTITION_BYTES`.

    Take the bytes of the largest shuffle, which for a cut that cannot be
    broadcast is the text of all posts.  Adaptive execution merges partitions
    that turn out small.
    """
    return max(MIN_PARTITIONS, -(-shuffled_bytes // PARTITION_BYTES))


def build_session(
    app: str = "tidemark",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    **extra: str,
) -> SparkSession:
    """A session with :data:`SETTINGS`; ``extra`` keys use ``_`` for ``.``."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in extra.items():
        builder = builder.config(key.replace("_", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as named by ``spark.checkpoint.dir``.

    On a cluster the setting is required; a local session without it (tests)
    gets a fresh folder of its own.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tidemark-"))
    return folder or context.getCheckpointDir()
