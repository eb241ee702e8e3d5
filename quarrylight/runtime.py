"""Tables of the session's input folder and durable intermediate tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset and the master is local (tests, a
    single machine) a folder of this process."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="quarrylight-")
        atexit.register(shutil.rmtree, found, True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def durable(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Cut the lineage with files that outlive executors."""
    path = f"{shared_dir(df.sparkSession)}/engine/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table that ``durable`` made and nothing reads any more."""
    spark = df.sparkSession
    mine = f"{shared_dir(spark)}/engine/"
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if mine.lstrip("/") in folder:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """What runs inside has its shuffles deleted as each action ends, not when the
    driver next collects garbage: for several actions on large tables in a row."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


class Grown:
    """A table that grows by appended rows; what is there is never written again."""

    def __init__(self, first: DataFrame, name: str):
        self.spark, self.schema = first.sparkSession, first.schema
        self.path = f"{shared_dir(self.spark)}/engine/{name}-{uuid.uuid4().hex}"
        self.parts: list[str] = []
        self.last = self.add(first)

    def add(self, rows: DataFrame) -> DataFrame:
        """Append ``rows`` and return them, read back."""
        self.parts.append(f"{self.path}/part-{len(self.parts)}")
        rows.write.parquet(self.parts[-1])
        self.last = self.spark.read.schema(self.schema).parquet(self.parts[-1])
        return self.last

    def read(self) -> DataFrame:
        """All rows so far, as one scan."""
        return self.spark.read.schema(self.schema).parquet(*self.parts)
