"""Session and scratch-folder helpers shared by every part of the library."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = "*", memory: str = "8g", partitions: int = 8) -> SparkSession:
    """A session for tests and for bench.py; on a cluster, use the cluster's own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("loomline")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders made for local applications that set none, by the application's id.
_MADE: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one made for this application where that is unset, as in tests, which a cluster refuses."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        context = spark.sparkContext
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if context.applicationId not in _MADE:
            _MADE[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="loomline-", dir=os.environ.get("LOOMLINE_TMP"))
        base = _MADE[context.applicationId]
    return base.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A new path under the shared folder; every call gets another, so reruns never meet old files."""
    return f"{shared_dir(spark)}/loomline-{label}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Cuts the lineage: df as a Parquet table in the shared folder, read again. It survives lost executors."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Intermediate tables of one operator. On leaving, they are deleted: what outlives them is to be written elsewhere before."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def written(self, df: DataFrame, label: str) -> DataFrame:
        self.paths.append(scratch(self.spark, label))
        df.write.parquet(self.paths[-1])
        return self.spark.read.schema(df.schema).parquet(self.paths[-1])

    def drop(self) -> None:
        jvm, conf = self.spark._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for at in self.paths:
            path = jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(conf).delete(path, True)
        self.paths = []

    def __enter__(self) -> "Scratch":
        return self

    def __exit__(self, *_) -> None:
        self.drop()
