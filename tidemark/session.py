"""Session settings and the few places where cluster state matters."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tidemark", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with adaptive execution, UTC time and Arrow transfer.

    On a cluster ``master`` and ``shuffle_partitions`` stay unset: the submit
    configuration decides, and AQE coalesces from there.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false").config("spark.driver.memory", "12g")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage and stream state.

    A cluster names it in ``spark.checkpoint.dir``; a folder of our own is made only in local mode where that is
    unset, as in tests: on a cluster a machine-local folder would lose what executors write.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = tempfile.mkdtemp(prefix="tidemark-ckpt-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


#: A scan of so many splits is never spread; with fewer it holds at most so many times the split size.
SPREAD_SPLITS = 64


def spread(df: DataFrame, tasks_a_core: int = 1) -> DataFrame:
    """Spread the scan of a small table over the cores, ``tasks_a_core`` on each, up to ``SPREAD_SPLITS``.

    Text work costs far more CPU per byte than reading; one file with one row group would keep a single core
    busy. The bound is one of size: a scan of ``SPREAD_SPLITS`` splits or more (8 GB at the default split size)
    is left alone whatever the number of cores.
    """
    want = min(SPREAD_SPLITS, tasks_a_core * df.sparkSession.sparkContext.defaultParallelism)
    return df.repartition(want) if df.rdd.getNumPartitions() < want else df


#: Rows of a small record that a task sorts or groups at once, some 100 MB.
TASK_ROWS = 500_000


def parts_for(table: DataFrame) -> int:
    """Shuffle partitions for the rows of a stored table (its files know their number): the session's, more where a task would hold more than ``TASK_ROWS``."""
    return max(int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-table.count() // TASK_ROWS))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder (survives lost executors)."""
    spark = df.sparkSession
    spark.sparkContext.setCheckpointDir(checkpoint_dir(spark))
    return df.checkpoint(eager=True)
