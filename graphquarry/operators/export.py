"""Graph exports as one text line per row, in order (column ``line``, ``ord``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIGILS = {"module": "!", "class": "$", "function": "#", "external": "@"}


def _safe(c: str):
    return F.regexp_replace(c, r"[^A-Za-z0-9_]", "_")


def mermaid(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    a = nodes.select(F.lit(1).alias("part"), F.col("id").alias("ord"), F.concat(F.lit("    "), _safe("id"), F.lit('["'), "name", F.lit('"]')).alias("line"))
    b = edges.select(F.lit(2).alias("part"), F.concat_ws("|", "source_id", "type", "target_id").alias("ord"), F.concat(F.lit("    "), _safe("source_id"), F.lit(" -->|"), "type", F.lit("| "), _safe("target_id")).alias("line"))
    head = nodes.sparkSession.createDataFrame([(0, "", "graph TD")], "part int, ord string, line string")
    return head.unionByName(a).unionByName(b).orderBy("part", "ord")


def d2(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    a = nodes.select(F.lit(1).alias("part"), F.col("id").alias("ord"), F.concat(_safe("id"), F.lit(': "'), "name", F.lit('"')).alias("line"))
    b = edges.select(F.lit(2).alias("part"), F.concat_ws("|", "source_id", "type", "target_id").alias("ord"), F.concat(_safe("source_id"), F.lit(" -> "), _safe("target_id"), F.lit(": "), "type").alias("line"))
    return a.unionByName(b).orderBy("part", "ord")


def cytoscape(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    a = nodes.select(F.lit(1).alias("part"), F.col("id").alias("ord"), F.to_json(F.struct(F.struct("id", F.col("name").alias("label"), "type").alias("data"))).alias("line"))
    b = edges.select(F.lit(2).alias("part"), F.concat_ws("|", "source_id", "type", "target_id").alias("ord"), F.to_json(F.struct(F.struct(F.col("source_id").alias("source"), F.col("target_id").alias("target"), "type").alias("data"))).alias("line"))
    return a.unionByName(b).orderBy("part", "ord")


def compact(nodes: DataFrame) -> DataFrame:
    """One line per node: a sigil by type, the name, and the complexity where there is one."""
    sigil = F.create_map(*[F.lit(x) for kv in SIGILS.items() for x in kv])
    return nodes.select(F.lit(1).alias("part"), F.col("id").alias("ord"), F.concat(F.try_element_at(sigil, "type"), "name", F.when(F.col("complexity") > 0, F.concat(F.lit(" c="), F.col("complexity").cast("string"))).otherwise("")).alias("line")).orderBy("part", "ord")


def select_graph(nodes: DataFrame, edges: DataFrame, types: list[str] | None = None, word: str | None = None, ids: list[str] | None = None, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of some types, with a word in id or name, of some ids; at most ``limit`` nodes by id. Edges touch a node that stays."""
    if types:
        nodes = nodes.where(F.col("type").isin(types))
    if word:
        nodes = nodes.where(F.lower("id").contains(word.lower()) | F.lower("name").contains(word.lower()))
    if ids:
        nodes = nodes.where(F.col("id").isin(ids))
    if limit is not None:
        nodes = nodes.orderBy("id").limit(limit)
    own = nodes.select("id")
    touching = edges.join(own, edges.source_id == own.id, "left_semi").unionByName(edges.join(own, edges.target_id == own.id, "left_semi"))
    return nodes, touching.dropDuplicates(["source_id", "target_id", "type"])


def graph_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One JSON object a line: nodes by id, then edges."""
    row = lambda df, kind, order, part: df.select(F.lit(part).alias("part"), order.alias("ord"), F.to_json(F.struct(F.lit(kind).alias("kind"), *[F.col(c) for c in df.columns])).alias("line"))
    return row(nodes, "node", F.col("id"), 1).unionByName(row(edges, "edge", F.concat_ws("|", "source_id", "type", "target_id"), 2)).orderBy("part", "ord")


def module_text(nodes: DataFrame, edges: DataFrame, title: str = "graph") -> DataFrame:
    """Text by module: a heading, the module, its classes with their bases, its functions with their complexity and how often they are called."""
    calls = edges.where("type = 'calls'").groupBy(F.col("target_id").alias("id")).agg(F.count(F.lit(1)).alias("calls"))
    bases = edges.where("type = 'inherits'").groupBy(F.col("source_id").alias("id")).agg(F.array_sort(F.collect_set(F.regexp_extract("target_id", r"([^:]*)$", 1))).alias("bases"))
    rows = nodes.where("type <> 'external'").join(calls, "id", "left").join(bases, "id", "left")
    owned = F.regexp_extract("id", r":([^:]*)$", 1)
    rank = F.when(F.col("type") == "module", 0).when(F.col("type") == "class", 1).otherwise(2)
    more = F.concat(F.when(F.col("complexity") > 0, F.concat(F.lit(" c="), "complexity")).otherwise(""), F.when(F.col("calls").isNotNull(), F.concat(F.lit(" calls="), "calls")).otherwise(""))
    line = F.when(F.col("type") == "module", F.concat(F.lit("!module "), "name", F.lit("  "), F.coalesce("file_path", F.lit("")))).when(F.col("type") == "class", F.concat(F.lit("  $"), "name", F.when(F.col("bases").isNotNull(), F.concat(F.lit(" < "), F.array_join("bases", ", "))).otherwise(""))).otherwise(F.concat(F.when(owned.contains("."), "    #").otherwise("  #"), "name", more))
    body = rows.select(F.coalesce("file_path", F.lit("")).alias("part"), F.concat_ws("|", F.when(F.col("type") == "module", "0").otherwise(F.concat(F.lit("1"), F.split(owned, r"\.")[0])), rank.cast("string"), "id").alias("ord"), line.alias("line"))
    head = nodes.agg(F.concat(F.lit(f"# {title}: "), F.count_if(F.col("type") != "external"), F.lit(" nodes")).alias("line")).select(F.lit("").alias("part"), F.lit("").alias("ord"), "line")
    return head.unionByName(body).orderBy("part", "ord")


def csv(rows: DataFrame) -> DataFrame:
    """A result as lines of CSV under a heading; null is empty, and what holds a comma, a quote or a line break is quoted."""
    text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    cell = lambda c: F.when(text(c).rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(text(c), F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text(c))
    head = rows.sparkSession.createDataFrame([(0, ",".join(rows.columns))], "part int, line string")
    return head.unionByName(rows.select(F.lit(1).alias("part"), F.concat_ws(",", *map(cell, rows.columns)).alias("line")))


def jsonl(rows: DataFrame) -> DataFrame:
    """A result as one JSON object a line."""
    return rows.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns])).alias("line"))


def envelope(rows: DataFrame) -> DataFrame:
    """One row, line: columns, how many rows, and the rows, for results that a limit bounds."""
    return rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("r")).agg(F.to_json(F.struct(F.array(*map(F.lit, rows.columns)).alias("columns"), F.count(F.lit(1)).alias("row_count"), F.collect_list("r").alias("rows"))).alias("line"))
