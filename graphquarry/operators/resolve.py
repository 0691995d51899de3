"""Entity resolution: the node that a partial name means. Each resolver is one ranked scan; the best row of it goes to the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class NotResolved(LookupError):
    """No node, or several; ``matches`` are (id, name, type) of up to ten of them."""

    def __init__(self, query: str, matches: list[tuple] = ()):
        listed = "".join(f"\n  {name} [{kind}] {node}" for node, name, kind in matches)
        super().__init__(f"Multiple nodes match '{query}'. Be more specific:{listed}" if matches else f"Node not found: {query}")
        self.matches = list(matches)


def _kind_rank(*kinds: str) -> Column:
    rank = F.lit(len(kinds))
    for i, kind in reversed(list(enumerate(kinds))):
        rank = F.when(F.col("type") == kind, i).otherwise(rank)
    return rank


def _contains(column: str, word: str) -> Column:
    return F.coalesce(F.lower(column).contains(word.lower()), F.lit(False))


def _ranked(nodes: DataFrame, rank: Column, *order: Column) -> DataFrame:
    return nodes.withColumn("rank", rank).where("rank is not null").orderBy("rank", *order, "id").select("rank", "id", "name", "type", *[c for c in ("file_path", "line_start", "line_end") if c in nodes.columns])


def candidates(nodes: DataFrame, query: str) -> DataFrame:
    """All that a query may mean, best first: an id or a name as it is, else any that holds it in either, whatever the case; classes,
    modules, functions, others, then by name."""
    exact = (F.col("id") == query) | (F.col("name") == query)
    rank = F.when(exact, 0).when(_contains("name", query) | _contains("id", query), 1)
    return _ranked(nodes, rank, _kind_rank("class", "module", "function"), F.col("name"))


def node(nodes: DataFrame, query: str) -> str:
    """The id that a query means: an exact id or name (the first by kind and name), else the only one that holds it."""
    found = candidates(nodes, query).limit(11).collect()
    if found and (found[0]["rank"] == 0 or len(found) == 1):
        return found[0]["id"]
    raise NotResolved(query, [(r["id"], r["name"], r["type"]) for r in found[:10]])


def risky_node(nodes: DataFrame, query: str) -> str:
    """By id, the module of a file path, or a part of an id or path: a module that ends with it, then classes, modules, functions."""
    part = F.col("id").contains(query) | F.coalesce(F.col("file_path").contains(query), F.lit(False))
    rank = F.when(F.col("id") == query, 0).when((F.col("file_path") == query) & (F.col("type") == "module"), 1).when(F.col("id").startswith("mod:") & F.col("id").endswith(query), 2).when(part, 3)
    return _first(_ranked(nodes, rank, _kind_rank("class", "module", "function")), query)


def impact_target(nodes: DataFrame, query: str) -> str:
    """By id, file path, or a part of an id: those that end with it, or with it as a last name, come first."""
    rank = F.when(F.col("id") == query, 0).when(F.col("file_path") == query, 1).when(F.col("id").endswith(query) | F.col("id").endswith(f":{query}"), 2).when(F.col("id").contains(query), 3)
    return _first(_ranked(nodes, rank, _kind_rank("module", "class", "function")), query)


def history_node(nodes: DataFrame, query: str) -> str:
    """As node(), but the best of several is taken."""
    return _first(candidates(nodes, query), query)


def readable_node(nodes: DataFrame, query: str) -> str:
    """By id, else the only id that holds the query."""
    found = _ranked(nodes, F.when(F.col("id") == query, 0).when(F.col("id").contains(query), 1)).limit(11).collect()
    if found and (found[0]["rank"] == 0 or len(found) == 1):
        return found[0]["id"]
    raise NotResolved(query, [(r["id"], r["name"], r["type"]) for r in found[:10]])


def place(nodes: DataFrame, query: str) -> tuple[str, int | None, int | None]:
    """(file_path, line_start, line_end) of the node of an id, else of the first id that holds it."""
    row = _ranked(nodes.where("file_path is not null"), F.when(F.col("id") == query, 0).when(F.col("id").contains(query) | F.col("name").contains(query), 1)).first()
    if row is None:
        raise NotResolved(query)
    return row["file_path"], row["line_start"], row["line_end"]


def find(nodes: DataFrame, name: str, limit: int = 10) -> DataFrame:
    """Nodes of a name, or whose name ends with it after a dot."""
    return nodes.where((F.col("name") == name) | F.col("name").endswith(f".{name}")).orderBy("id").limit(limit)


def file_of(node_id: Column) -> Column:
    """The file path in a node's id."""
    return F.regexp_extract(node_id, r"^[a-z]+:([^:]*)", 1)


def _first(found: DataFrame, query: str) -> str:
    row = found.first()
    if row is None:
        raise NotResolved(query)
    return row["id"]
