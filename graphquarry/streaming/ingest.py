"""Streaming ingest: a stream of node rows kept as a table by keep-last upserts, a micro-batch at a time.

The table is cut into partitions by the hash of the key, and a batch rewrites only those that its keys fall into. Each partition's
versions stand side by side, named by the batch that wrote them; the newest counts. A replayed batch writes the same files again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.storage import keep_last, upsert


def _versions(spark: SparkSession, path: str, before: int | None = None) -> dict[int, str]:
    """The newest folder of each partition, of batches up to ``before``."""
    top = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    found: dict[int, tuple[int, str]] = {}
    for folder in fs.listStatus(top) if fs.exists(top) else []:
        name = folder.getPath().getName()
        if not name.startswith("batch="):
            continue
        batch = int(name.removeprefix("batch="))
        if before is not None and batch >= before or not fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}/_SUCCESS")):
            continue
        for part in fs.listStatus(folder.getPath()):
            p = part.getPath().getName()
            if p.startswith("part=") and found.get(int(p.removeprefix("part=")), (-1, ""))[0] < batch:
                found[int(p.removeprefix("part="))] = batch, f"{path}/{name}/{p}"
    return {p: folder for p, (_, folder) in found.items()}


def table(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The table as it is now."""
    folders = list(_versions(spark, path).values())
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def ingest(stream: DataFrame, path: str, checkpoint: str, key: list[str], order: list[str], parts: int = 64) -> StreamingQuery:
    """Runs what the stream has and stops."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if batch.isEmpty():
            return
        part = F.pmod(F.xxhash64(*key), F.lit(parts)).cast("int")
        rows = keep_last(batch, key, order).withColumn("part", part)
        touched = [r["part"] for r in rows.select("part").distinct().collect()]
        known = _versions(spark, path, number)
        old = [known[p] for p in touched if p in known]
        if old:
            rows = upsert(spark.read.schema(batch.schema).parquet(*old).withColumn("part", part), rows, key)
        rows.repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
