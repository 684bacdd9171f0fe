"""A local session with the settings that the queries expect."""

from __future__ import annotations

import os

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def local_session(cpus: int | None = None, name: str = "quarrylens") -> SparkSession:
    n = cpus or os.cpu_count() or 8
    return (
        SparkSession.builder.master(f"local[{n}]").appName(name).config("spark.sql.shuffle.partitions", str(n)).config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "8g")).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share; a local session without one gets its own."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        at = sc.getConf().get("spark.checkpoint.dir", "")
        if not at and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(at or tempfile.mkdtemp(prefix="quarrylens-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


class Shelf:
    """Tables of one piece of work as Parquet in the shared folder, which cuts lineage and leaves no constraints behind; clear deletes them all."""

    def __init__(self, spark: SparkSession):
        self.spark, self.at = spark, f"{shared_folder(spark)}/shelf-{uuid.uuid4().hex[:12]}"

    def __call__(self, df: DataFrame) -> DataFrame:
        path = f"{self.at}/{self.name()}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def name(self) -> str:
        return uuid.uuid4().hex[:12]

    def counted(self, df: DataFrame, name: str = "", **counts: Column) -> tuple[DataFrame, dict[str, int]]:
        """The table and counts of the rows that were written, in one job; with a name, the rows of all that were written under it."""
        seen, path = Observation(), f"{self.at}/{name or self.name()}"
        df.observe(seen, *(c.cast("long").alias(k) for k, c in counts.items())).write.mode("append").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), {k: seen.get.get(k) or 0 for k in counts}

    def clear(self) -> None:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.at)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
