"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset and all of Spark is one process, a temporary folder.

    On a cluster no folder of one machine will do, so an unset spark.checkpoint.dir raises there.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.conf.get("spark.tessella.scratch", None)
    if not found:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tessella-")
        spark.conf.set("spark.tessella.scratch", found)
    return found.rstrip("/")


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, lengthened until none is among the columns (letter case aside)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


class Scratch:
    """Tables of one query under the shared folder.

    ``keep`` writes a DataFrame as Parquet and reads it again, which cuts its lineage:
    an executor lost later costs a read, never the work before. ``drop`` deletes a table
    that nothing lazy refers to any more.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/tessella-{uuid.uuid4().hex}"
        self.tables: dict[str, str] = {}

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        schema = df.schema
        df.write.option("compression", "zstd").parquet(path)
        self.tables[name] = path
        return self.spark.read.schema(schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        conf = self.spark._jsc.hadoopConfiguration()
        for name in names:
            if path := self.tables.pop(name, None):
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(conf).delete(p, True)
