"""Embeddings of nodes: the text of a node, a plug point for models, incremental runs, status."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import storage

#: A model: texts of a batch to rows of floats.
Model = Callable[[list[str]], np.ndarray]


def node_text() -> Column:
    return F.concat_ws(" ", "type", "name", "qualified_name")


class HashedWords:
    """The model that needs no weights: signed hashes of words and of their runs of three characters, scaled to length one."""

    def __init__(self, dimension: int = 384):
        self.dimension, self.name = dimension, f"hashed-words-{dimension}"

    def __call__(self, texts: list[str]) -> np.ndarray:
        import re
        import zlib

        out = np.zeros((len(texts), self.dimension), np.float32)
        for row, text in zip(out, texts, strict=True):
            for word in re.findall(r"[a-z]+|\d+", re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", text or "").lower()):
                for part in {word, *(f"#{word[i : i + 3]}" for i in range(len(word) - 2))}:
                    h = zlib.crc32(part.encode())
                    row[(h >> 1) % self.dimension] += 1.0 if h & 1 else -1.0
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm == 0, 1, norm)


def pooled(hidden: np.ndarray, mask: np.ndarray, how: str = "mean") -> np.ndarray:
    """One vector for each text of token vectors (texts, tokens, dimension) and a mask: mean or max of those that count, or the first."""
    if how == "cls":
        return hidden[:, 0]
    there = mask[:, :, None].astype(bool)
    if how == "max":
        return np.where(there, hidden, -np.inf).max(axis=1)
    return (hidden * there).sum(axis=1) / np.maximum(there.sum(axis=1), 1)


def embed(rows: DataFrame, text: Column, model: Model, key: str = "id", batch: int = 32) -> DataFrame:
    """node_id, embedding of the rows' texts, ``batch`` texts at a time; the model travels to the workers once."""
    kind = rows.schema[key].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for at in range(0, len(part), batch):
                some = part.iloc[at : at + batch]
                yield pd.DataFrame({"node_id": some["k"].array, "embedding": [v.tolist() for v in np.asarray(model(some["t"].tolist()), np.float32)]})

    return rows.select(F.col(key).alias("k"), F.coalesce(text, F.lit("")).alias("t")).mapInPandas(run, f"node_id {kind}, embedding array<float>")


def embed_nodes(nodes: DataFrame, model: Model, name: str = "hashed-words") -> DataFrame:
    found = embed(nodes.where("type <> 'external'"), node_text(), model)
    return found.withColumns({"model": F.lit(name), "created_at": F.current_timestamp()})


def incremental(nodes: DataFrame, hashes: DataFrame, current: DataFrame, vectors: DataFrame, model: Model, name: str = "hashed-words") -> tuple[DataFrame, DataFrame]:
    """(vectors, hashes) after a run: nodes in new or changed files are embedded anew, vectors of nodes that are gone and hashes of files
    that are gone are dropped. ``hashes`` and ``current`` are (file_path, content_hash)."""
    stale = storage.stale_files(current, hashes.select("file_path", "content_hash"))
    fresh = storage.stored(embed_nodes(nodes.join(stale.select("file_path"), "file_path", "left_semi"), model, name))
    kept = storage.upsert(vectors, fresh.select(*vectors.columns), ["node_id"])
    there = kept.join(nodes.select(F.col("id").alias("node_id")), "node_id", "left_semi")
    return there, current.select("file_path", "content_hash").withColumn("updated_at", F.current_timestamp())


def status(nodes: DataFrame, hashes: DataFrame, current: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row: total, embedded, missing, stale (nodes in new or changed files), coverage (percent), model (the most frequent)."""
    own = nodes.where("type <> 'external'").select("id", "file_path")
    stale = storage.stale_files(current, hashes.select("file_path", "content_hash")).select("file_path", F.lit(1).alias("stale"))
    marked = own.join(vectors.select(F.col("node_id").alias("id"), F.lit(1).alias("have")).dropDuplicates(["id"]), "id", "left").join(stale, "file_path", "left")
    counted = marked.agg(F.count(F.lit(1)).alias("total"), F.count("have").alias("embedded"), F.count_if(F.col("have").isNull()).alias("missing"), F.count_if(F.col("have").isNotNull() & F.col("stale").isNotNull()).alias("stale"))
    modal = vectors.groupBy("model").agg(F.count(F.lit(1)).alias("n")).agg(F.max(F.struct("n", "model")).alias("m")).select(F.col("m.model").alias("model"))
    return counted.join(F.broadcast(modal)).withColumn("coverage", F.when(F.col("total") > 0, F.round(100.0 * F.col("embedded") / F.col("total"), 2)).otherwise(0.0))
