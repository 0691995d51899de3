"""Tables in the folder that driver and executors share: they cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def shared_folder(spark) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder, which only a local master shares with its executors."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{tempfile.gettempdir()}/graphquarry-{spark.sparkContext.applicationId}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet under the shared folder and read back."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/graph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def freed(*tables: DataFrame) -> None:
    """Delete the files of tables made by stored() that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def keep_last(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Upsert semantics on plain tables: of the rows of a key, the last by ``order`` (descending, nulls last) stays."""
    by = Window.partitionBy(*key).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return rows.withColumn("__rn", F.row_number().over(by)).where("__rn = 1").drop("__rn")


def upsert(table: DataFrame, batch: DataFrame, key: list[str]) -> DataFrame:
    """``table`` with the rows of ``batch`` in place of those with their keys."""
    return table.join(batch.select(*key), key, "left_anti").unionByName(batch)


def stale_files(current: DataFrame, known: DataFrame) -> DataFrame:
    """Current (file_path, content_hash) that are new or changed."""
    return current.join(known, ["file_path", "content_hash"], "left_anti")


def delete_file(nodes: DataFrame, edges: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without a file's nodes and what touches them."""
    gone = nodes.where(F.col("file_path") == path).select("id")
    kept = edges.join(gone, edges.source_id == gone.id, "left_anti").join(gone, edges.target_id == gone.id, "left_anti")
    return nodes.where(~F.col("file_path").eqNullSafe(F.lit(path))), kept


def orphans(vectors: DataFrame, nodes: DataFrame, key: str = "node_id") -> DataFrame:
    """Vectors whose node is gone."""
    return vectors.join(nodes.select(F.col("id").alias(key)), key, "left_anti")


def current_hashes(hashes: DataFrame, paths: DataFrame) -> DataFrame:
    """Hashes of the files that are still there."""
    return hashes.join(paths.select("file_path").distinct(), "file_path", "left_semi")
