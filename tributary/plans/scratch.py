"""Tables written once and read back, in the folder the cluster shares.

A written table cuts lineage and survives the loss of any executor.  The
folder is ``spark.checkpoint.dir`` of the session; only where that is unset
and the master is local (tests, notebooks) a temporary folder of this machine
takes its place.  On a cluster without the setting ``shared_dir`` raises.

The shuffle files behind a written table go as soon as it is written, and the
tables that remain go when the driver ends.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Removes an execution's shuffle files at its end; what reads the written table has no use for them.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors can read and write."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError(f"spark.checkpoint.dir has to name a folder that the whole cluster shares (master {master})")
        path = tempfile.mkdtemp(prefix="tributary-")
        spark.sparkContext.setCheckpointDir(path)
    return path


class Scratch:
    """Working tables of one operator call, each under a name of its own."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/tributary-{label}-{uuid.uuid4().hex}"
        fs, path = self._at(self.root)
        fs.mkdirs(path)
        fs.deleteOnExit(path)

    def _at(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return it as a scan of what was written."""
        path = f"{self.root}/{name}"
        before = self.spark.conf.get(CLEANUP, "false")
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.mode("overwrite").parquet(path)
        finally:
            self.spark.conf.set(CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that no later plan reads; all of them without names."""
        for path in [f"{self.root}/{n}" for n in names] or [self.root]:
            fs, p = self._at(path)
            fs.delete(p, True)
