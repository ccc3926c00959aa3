"""Session defaults and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "geoweave", cpus: str | int = "*", shuffle_partitions: int | None = None) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster pass the session you already have."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]").appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.streaming.stateStore.providerClass",
                "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        .config("spark.driver.memory", os.environ.get("GEOWEAVE_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Folder of intermediate tables: the cluster's `spark.checkpoint.dir`. Only a local master may do without and gets a scratch folder.

    On several machines a scratch folder of the driver would be another folder on each of them, so there it is refused.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows once to the shared checkpoint folder and continue from that table.

    Survives executor loss. Unlike an RDD checkpoint the rows are computed once, later readers prune columns, and the
    size is known to the optimizer, so whether a side is small enough to broadcast is decided on facts.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the input: it is met by a shuffle and never broadcast.

    The planner knows a table by the size of its compressed files, a tenth and less of what its rows take in memory, and so would collect sides of some 100 MB on the driver.
    """
    return df.hint("merge")


def drop_table(df: DataFrame) -> None:
    """Delete a table that `cut_lineage` returned, once nothing reads it any more."""
    spark = df.sparkSession
    root = ensure_checkpoint_dir(spark).rstrip("/") + "/table-"
    for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        if root.split(":", 1)[-1].lstrip("/") in folder:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
