"""Session settings and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Settings the jobs expect; a cluster profile may override all of them.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


#: Spark 4.1 lets a union of equally partitioned inputs count as partitioned
#: itself. When adaptive execution coalesces those inputs differently, rows
#: of one key end up in different partitions and groups come out split, so
#: the shortcut stays off.
UNION_SHORTCUT = "spark.sql.unionOutputPartitioning"


#: Rows that Python workers get at once. Rows here carry whole texts, so that
#: ten thousand of them would fill a worker; a value set by the user stays.
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the setting that results depend on, and the batch size; returns the session.

    Python workers on this machine also find the package, wherever the driver
    was started; a cluster gets it by ``--py-files`` as usual.
    """
    if tuple(int(x) for x in spark.version.split(".")[:2]) >= (4, 1):
        spark.conf.set(UNION_SHORTCUT, "false")
    if spark.conf.get(BATCH_ROWS) == "10000":  # the default suits numbers
        spark.conf.set(BATCH_ROWS, "1000")
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[1]))
    return spark


def local_session(cores: int = 8, shuffle_partitions: int = 8, **extra: str) -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("lorespark")
    settings = {
        **DEFAULTS,
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.driver.memory": "12g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        **extra,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return prepare(builder.getOrCreate())


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    A temporary folder is used only in local mode with nothing configured; on
    a cluster a machine-local folder would not survive a lost executor.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get(
        "spark.checkpoint.dir", None
    )
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        folder = context.getCheckpointDir() or tempfile.mkdtemp(prefix="spark-checkpoint-")
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder; runs a job."""
    context = prepare(df.sparkSession).sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def new_run_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, for stream sinks and progress."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
