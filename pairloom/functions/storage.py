"""Tables in the folder that driver and executors share: they cut lineage and survive the loss of executors."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The session's checkpoint folder. Only a local session that names none (tests) gets one set; a cluster has to name it."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    root = "file://" + tempfile.mkdtemp(prefix="pairloom-")
    spark.sparkContext.setCheckpointDir(root)
    return root


_made: ContextVar[list[str] | None] = ContextVar("_made", default=None)


def shared_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_root(spark)}/pairloom/{name}-{uuid.uuid4().hex}"
    if (made := _made.get()) is not None:
        made.append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes, at its end, whatever was written to the shared folder within. A result is a plan over such tables, so it has to
    be written or collected within, too."""
    token = _made.set(made := [])
    try:
        yield
    finally:
        _made.reset(token)
        for path in made:
            for p in (path, path + ".txt"):  # the second: a graph file beside its folder
                remove(spark, p)


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def written(df: DataFrame, name: str, **options: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.options(**{"compression": "zstd", **options}).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


FACTOR = "spark.sql.sources.fileCompressionFactor"
#: Bytes of a row in a hashed table to those in its file: ids in order take about one byte there (4 million: 4.2 MB), and 56 to 96 in a broadcast.
UNPACKED = 32
_lock, _open = threading.Lock(), {}


@contextmanager
def by_memory(spark: SparkSession) -> Iterator[None]:
    """Plans made within take files for as large as their rows are in memory, so that tables of millions of ids, whose files are
    small, are not broadcast. A plan that is carried out later needs to be written within."""
    key = str(spark._jsparkSession.hashCode())
    with _lock:
        n, before = _open.get(key, (0, None))
        if n == 0:
            before = spark.conf.get(FACTOR)
            spark.conf.set(FACTOR, str(max(float(before), UNPACKED)))
        _open[key] = (n + 1, before)
    try:
        yield
    finally:
        with _lock:
            n, before = _open.pop(key)
            if n > 1:
                _open[key] = (n - 1, before)
            else:
                spark.conf.set(FACTOR, before)


class Tables:
    """The written tables of one computation, which go together once they are out of use."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df, path = written(df, name)
        self.paths.append(path)
        return df

    def drop(self) -> None:
        for path in self.paths:
            remove(self.spark, path)
        self.paths = []
