"""Graph operators as level-synchronous joins. An edge source -> target says that source depends on target.

Each level joins the frontier with the edges (filtered by type before the loop), drops visited nodes and stores the new level; the
driver sees only whether a level is empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import stored


def load(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose ends are both nodes."""
    ids = nodes.select("id")
    return edges.join(ids, edges.source_id == ids.id, "left_semi").join(ids, edges.target_id == ids.id, "left_semi")


def oriented(edges: DataFrame, direction: str, types: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """(a, b, type): steps from a to b. direction: out, in or both."""
    if types:
        edges = edges.where(F.col("type").isin(types))
    if exclude:
        edges = edges.where(~F.col("type").isin(exclude))
    out = edges.select(F.col("source_id").alias("a"), F.col("target_id").alias("b"), "type")
    back = edges.select(F.col("target_id").alias("a"), F.col("source_id").alias("b"), "type")
    return {"out": out, "in": back, "both": out.unionByName(back)}[direction]


#: Searches of at most so many hops read the edges as they are; deeper ones store the steps, which every hop reads, once: edges may be
#: made by large joins, which each hop would make again.
SHALLOW = 1


def reach(steps: DataFrame, seeds: DataFrame, max_depth: int | None = None, paths: bool = False) -> DataFrame:
    """(id, depth, edge_type) of all nodes reached from ``seeds`` (id), seeds at depth 0; the type is the least of a first step.

    With ``paths`` also path, the ids from a seed to the node: of the shortest paths the smallest.
    """
    if max_depth is None or max_depth > SHALLOW:
        steps = stored(steps)
    own = [F.array("id").alias("path")] if paths else []
    visited = stored(seeds.dropDuplicates(["id"]).select("id", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("edge_type"), *own))
    frontier, depth = visited, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        from_ = frontier.select(F.col("id").alias("a"), *(["path"] if paths else []))
        more = [F.min("path").alias("path")] if paths else []
        near = from_.join(steps, "a").groupBy(F.col("b").alias("id")).agg(F.min("type").alias("edge_type"), *more)
        fresh = near.join(visited.select("id"), "id", "left_anti").select("id", F.lit(depth).alias("depth"), "edge_type", *([F.concat("path", F.array("id")).alias("path")] if paths else []))
        if depth == max_depth:
            return visited.unionByName(stored(fresh))
        frontier = stored(fresh)
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
    return visited


def impact(edges: DataFrame, seeds: DataFrame, types=None, max_depth=None) -> DataFrame:
    """What the seeds depend on, transitively; the seeds themselves are left out."""
    return reach(oriented(edges, "out", types), seeds, max_depth).where("depth > 0")


def ancestors(edges: DataFrame, seeds: DataFrame, types=None, max_depth=None) -> DataFrame:
    """What depends on the seeds, transitively."""
    return reach(oriented(edges, "in", types), seeds, max_depth).where("depth > 0")


dependents = ancestors


def neighbors(edges: DataFrame, seeds: DataFrame, direction: str = "both", depth: int = 1, types=None) -> DataFrame:
    return reach(oriented(edges, direction, types), seeds, depth).where("depth > 0")


def deps(edges: DataFrame, seeds: DataFrame, reverse: bool = False, depth: int = 1, include_contains: bool = False, nodes: DataFrame | None = None) -> DataFrame:
    """Dependencies up to ``depth`` without contains edges; forward searches also start from the seed's module where it exists."""
    start = seeds.select("id")
    if not reverse and nodes is not None:
        module = start.select(F.concat(F.lit("mod:"), F.regexp_extract("id", r"^(?:cls|fn):([^:]*):", 1)).alias("id"))
        start = start.unionByName(module.join(nodes.select("id"), "id", "left_semi")).distinct()
    found = reach(oriented(edges, "in" if reverse else "out", None, None if include_contains else ["contains"]), start, depth)
    return found.where("depth > 0")


def shortest_path(edges: DataFrame, source: str, target: str, types=None, most: int | None = None) -> list[str] | None:
    """Node ids of a shortest path: along the edges, else against them, else in either direction; ties by smallest predecessor."""
    if source == target:
        return [source]
    seed = edges.sparkSession.createDataFrame([(source,)], "id string")
    for direction in ("out", "in", "both"):
        end = reach(oriented(edges, direction, types), seed, most, paths=True).where(F.col("id") == target).first()
        if end:
            return end["path"]
    return None


def edge_types(edges: DataFrame) -> DataFrame:
    return edges.select("type").distinct()


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """kind (node or edge), type, n."""
    count = lambda df, kind: df.groupBy("type").agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "type", "n")
    return count(nodes, "node").unionByName(count(edges, "edge"))


def has_node(nodes: DataFrame, node: str) -> bool:
    return not nodes.where(F.col("id") == node).isEmpty()


def impacted(nodes: DataFrame, edges: DataFrame, seed: DataFrame, depth: int = 10) -> DataFrame:
    """id, name, type, file_path, depth of what depends on a node over edges of all types, by path and name."""
    found = ancestors(edges, seed, None, depth).select("id", "depth")
    return found.join(nodes.select("id", "name", "type", "file_path"), "id").orderBy(F.coalesce("file_path", F.lit("")), "name", "id")


def impact_risk(found: DataFrame) -> DataFrame:
    """One row, files, level: how many files (names, where there is none) are impacted."""
    n = F.col("files")
    level = F.when(n <= 5, "low").when(n <= 15, "medium").when(n <= 50, "high").otherwise("extreme")
    return found.agg(F.countDistinct(F.coalesce("file_path", "name")).alias("files")).withColumn("level", level)


def components(edges: DataFrame, types=None) -> DataFrame:
    """(id, component) of strongly connected components of two or more nodes; component is the smallest id in it.

    Nodes without in- or out-edges are trimmed, then a forward colouring with pointer jumping and a backward search inside each colour
    take at least one component of each colour in a round.
    """
    rest = stored(oriented(edges, "out", types).where("a <> b").select("a", "b").distinct())
    out = None
    while True:
        # Two layers go before each colouring; what hangs on in long chains has colours of its own and costs no round.
        for _ in range(2):
            rest = rest.join(rest.select(F.col("b").alias("a")).distinct(), "a", "left_semi").join(rest.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a", "b")
        rest = stored(rest)
        if rest.isEmpty():
            break
        color = stored(rest.select(F.col("a").alias("id")).union(rest.select("b")).distinct().withColumn("color", F.col("id")))
        while True:
            into = rest.join(color.withColumnRenamed("id", "a"), "a").groupBy(F.col("b").alias("id")).agg(F.min("color").alias("c"))
            low = color.join(into, "id", "left").select("id", F.least("color", F.coalesce("c", "color")).alias("low"), F.col("color").alias("was"))
            # A colour's own colour reaches what the colour reaches: chains shorten geometrically.
            jump = color.select(F.col("id").alias("low"), F.col("color").alias("to"))
            new = stored(low.join(jump, "low", "left").select("id", F.least("low", F.coalesce("to", "low")).alias("color"), "was"))
            color = new.select("id", "color")
            if new.where("color <> was").isEmpty():
                break
        colored = rest.join(color.select(F.col("id").alias("a"), F.col("color").alias("ca")), "a").join(color.select(F.col("id").alias("b"), F.col("color").alias("cb")), "b").where("ca = cb")
        back = reach(colored.select(F.col("b").alias("a"), F.col("a").alias("b"), F.lit("x").alias("type")), color.where("id = color").select("id"))
        found = stored(back.join(color, "id").select("id", F.col("color").alias("component")))
        out = found if out is None else out.unionByName(found)
        rest = stored(rest.join(found.select(F.col("id").alias("a")), "a", "left_anti").join(found.select(F.col("id").alias("b")), "b", "left_anti").select("a", "b"))
    if out is None:
        return edges.sparkSession.createDataFrame([], "id string, component string")
    large = out.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("low")).where("n > 1")
    return out.join(large, "component").select("id", F.col("low").alias("component"))


def degree(edges: DataFrame) -> DataFrame:
    """(id, degree): edge ends at each node, self loops count two."""
    return edges.select(F.explode(F.array("source_id", "target_id")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
