"""Session settings and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

# Settings the operators are written for. Partition counts stay the cluster's own.
RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # One row of a series table carries a whole series, so keep Arrow batches short.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "500",
}


def build_session(app_name: str = "shelfcast", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the recommended settings; keyword arguments use ``__`` for dots."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in RECOMMENDED_CONF.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ship_by_value(*modules) -> None:
    """Pickle functions of these modules into the tasks that use them, so that executors need no
    copy of the package."""
    for module in modules:
        cloudpickle.register_pickle_by_value(module)


def series_partitions(spark: SparkSession) -> int:
    """Partition count for shuffles by series key.

    Stated explicitly because the rows grow after the shuffle (gap filling, model fits), which
    adaptive coalescing cannot see from the shuffled bytes.
    """
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def is_local(spark: SparkSession) -> bool:
    """Whether driver and executors are one process: masters ``local`` and ``local[...]``, not ``local-cluster``."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Only a local master falls back to a folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not is_local(spark):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="shelfcast-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def shared_folder(spark: SparkSession, stem: str) -> str:
    """A new folder name that driver and executors share, under the checkpoint folder; its files stay until the
    owner of that folder removes them."""
    return f"{checkpoint_folder(spark)}/{stem}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of ``df`` in the cluster's shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(checkpoint_folder(df.sparkSession))
    return df.checkpoint()
