"""Vector and keyword search."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import stored


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where lengths differ or a vector is zero."""
    size = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (size > 0), _dot(a, b) / size).otherwise(F.lit(0.0))


def vector_search(vectors: DataFrame, query: list[float], k: int = 10, threshold: float = 0.0, key: str = "node_id", column: str = "embedding") -> DataFrame:
    """(key, similarity) of the k nearest, ties by key; nothing for a zero query. Vectors that are null or hold nulls are skipped.

    The query is scaled on the driver, and a row's product and length are summed in one pass.
    """
    length = math.sqrt(sum(float(x) ** 2 for x in query))
    if not length:
        return vectors.select(key, F.lit(0.0).alias("similarity")).limit(0)
    unit = F.lit([float(x) / length for x in query])
    pairs = F.zip_with(column, unit, lambda x, q: F.struct(x.cast("double").alias("x"), q.alias("q")))
    sums = F.aggregate(pairs, F.struct(F.lit(0.0).alias("dot"), F.lit(0.0).alias("square")), lambda s, p: F.struct((s["dot"] + p["x"] * p["q"]).alias("dot"), (s["square"] + p["x"] * p["x"]).alias("square")))
    fits = F.size(column) == len(query)
    rows = vectors.where(F.col(column).isNotNull() & ~F.exists(column, lambda x: x.isNull())).select(key, F.when(fits, sums).alias("s"))
    scored = rows.select(key, F.when(F.col("s.square") > 0, F.col("s.dot") / F.sqrt("s.square")).otherwise(F.lit(0.0)).alias("similarity"))
    return scored.where(F.col("similarity") >= threshold).orderBy(F.desc("similarity"), key).limit(k)


def semantic_search(nodes: DataFrame, vectors: DataFrame, query: list[float], k: int = 10, threshold: float = 0.1) -> DataFrame:
    """id, name, type, file_path, similarity of the nearest nodes."""
    found = vector_search(vectors, query, k, threshold).withColumnRenamed("node_id", "id")
    return nodes.select("id", "name", "type", "file_path").join(F.broadcast(found), "id").orderBy(F.desc("similarity"), "id")


def keyword_search(nodes: DataFrame, word: str, k: int = 10) -> DataFrame:
    """Nodes whose name or qualified name holds a word, whatever the case: those that begin with it first, then the most complex."""
    low = word.lower()
    found = nodes.where(F.lower("name").contains(low) | F.coalesce(F.lower("qualified_name").contains(low), F.lit(False)))
    ranked = found.orderBy(F.when(F.lower("name").startswith(low), 0).otherwise(1), F.col("complexity").desc_nulls_last(), "id").limit(k)
    return ranked.select("id", "name", "type", "file_path", "complexity", F.lit(1.0).alias("similarity"))


# Words of a question that say nothing about code.
STOP_WORDS = ("what", "does", "do", "how", "the", "a", "an", "is", "are", "this", "that", "it", "to", "for", "in", "on", "of", "and", "or", "can", "could", "would", "should", "will", "why", "where", "when", "which", "who", "there", "here", "with", "from", "by", "about", "into", "through", "during", "before", "after", "above", "below", "between", "under", "again", "further", "then", "once", "any", "all", "both", "each", "few", "more", "most", "other", "some", "such", "only", "own", "same", "than", "too", "very", "just", "also", "now", "use", "uses", "used", "using", "work", "works", "working", "call", "calls", "called", "get", "gets", "getting", "set", "sets", "setting", "find", "finds", "finding", "make", "makes", "making", "take", "takes", "taking", "show", "shows", "showing", "help", "helps", "code", "function", "method", "class", "module", "file", "files", "implement", "implements")


def keywords(question: Column) -> Column:
    """Words of a question of three characters or more that aren't STOP_WORDS, as they are written."""
    return F.filter(F.split(question, r"[^\p{L}\p{N}_]+"), lambda w: (F.octet_length(w) > 2) & ~F.lower(w).isin(*STOP_WORDS))


def words_of(question: str) -> list[str]:
    """keywords() of a text in the driver."""
    return [w for w in re.split(r"[^\w]+", question) if len(w.encode()) > 2 and w.lower() not in STOP_WORDS]


def explain_question(nodes: DataFrame, edges: DataFrame, question: str, vectors: DataFrame | None = None, query: list[float] | None = None, depth: int = 1) -> DataFrame:
    """id, name, type, file_path, similarity, hop, depends_on (at most five names) of what a question is about.

    Starts from the five nearest nodes (similarity 0.1 or more) where vectors are there and find any, else from ten nodes by keywords;
    then goes ``depth`` (1 to 3) hops along the edges, at most five names of a node a hop, each to the first node of that name. What is
    reached has similarity 0.5.
    """
    columns = ["id", "name", "type", "file_path"]
    start = None
    if vectors is not None and query is not None:
        start = stored(semantic_search(nodes, vectors, query, 5).select(*columns, "similarity", F.lit(0).alias("hop")))
    if start is None or start.isEmpty():
        start = stored(keyword_rank(nodes, words_of(question)).select("id", "similarity").join(nodes.select(*columns), "id").select(*columns, "similarity", F.lit(0).alias("hop")))
    named = nodes.where("type <> 'external'").groupBy("name").agg(F.min_by(F.struct(*columns), "id").alias("n"))
    found = frontier = start
    for hop in range(1, max(1, min(3, depth)) + 1):
        near = _depends_on(nodes, edges, frontier.select("id")).select(F.explode("depends_on").alias("name")).distinct()
        reached = near.join(named, "name").select("n.*", F.lit(0.5).alias("similarity"), F.lit(hop).alias("hop"))
        frontier = stored(reached.join(found.select("id"), "id", "left_anti").dropDuplicates(["id"]))
        found = found.unionByName(frontier)
    return found.join(_depends_on(nodes, edges, found.select("id")), "id", "left").orderBy("hop", F.desc("similarity"), "id")


def _depends_on(nodes: DataFrame, edges: DataFrame, ids: DataFrame, most: int = 5) -> DataFrame:
    names = edges.where("type <> 'contains'").join(ids, edges.source_id == ids.id, "left_semi").join(nodes.select(F.col("id").alias("target_id"), "name"), "target_id").select(F.col("source_id").alias("id"), "name").distinct()
    first = names.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("name"))).where(F.col("rank") <= most)
    return first.groupBy("id").agg(F.array_sort(F.collect_list("name")).alias("depends_on"))


def source_lines(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """id, source: the lines of a node in files (path, source)."""
    rows = nodes.where("line_start is not null and line_end >= line_start").join(files.select(F.col("path").alias("file_path"), F.split("source", "\n").alias("lines")), "file_path")
    return rows.select("id", F.array_join(F.slice("lines", F.greatest(F.lit(1), F.col("line_start")), F.col("line_end") - F.greatest(F.lit(1), F.col("line_start")) + 1), "\n").alias("source"))


def keyword_rank(nodes: DataFrame, words: list[str], k: int = 10) -> DataFrame:
    """Two points for each word in the name, one for each in the id, as a share of the most possible; ties by complexity and id."""
    score = sum((2 * F.lower("name").contains(w.lower()).cast("int") + F.lower("id").contains(w.lower()).cast("int") for w in words), F.lit(0))
    found = nodes.where("type <> 'external'").withColumn("score", score).where("score > 0")
    return found.orderBy(F.desc("score"), F.col("complexity").desc_nulls_last(), "id").limit(k).select("id", "name", "complexity", F.round(F.col("score") / (3 * max(1, len(words))), 6).alias("similarity"))
