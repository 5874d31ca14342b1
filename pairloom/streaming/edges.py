"""A graph that grows: a stream of edge rows kept as a normalised edge table.

Each micro-batch is normalised, freed of edges that the table has, and appended under its batch number, so a batch that is
run again after a failure replaces its own part: exactly once. The table is parted by a hash of the edge, and a batch reads the
buckets of its own edges only. A matching is computed from the table whenever one is wanted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.graph import normalise

EDGES, BUCKETS = "u long, v long", 256
TABLE = EDGES + ", batch long, bucket int"


def read_graph(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TABLE).parquet(path).select("u", "v")


def keep_edges(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Starts the query; stop it, or let an availableNow trigger end it."""

    def batch(df: DataFrame, k: int) -> None:
        spark = df.sparkSession
        new = normalise(df).withColumn("bucket", F.pmod(F.xxhash64("u", "v"), F.lit(BUCKETS)).cast("int"))
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            own = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # BUCKETS rows at most
            old = spark.read.schema(TABLE).parquet(path).filter((F.col("batch") != k) & F.col("bucket").isin(own)).select("u", "v")
            new = new.join(old, ["u", "v"], "left_anti")
        new.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/batch={k}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
