"""The terse query language and virtual tables on temporary views."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, resolve

HEADS = {**dict.fromkeys(("fn", "func", "functions", "meth", "method", "methods"), "function"), **dict.fromkeys(("cls", "class", "classes"), "class"), **dict.fromkeys(("mod", "module", "modules"), "module")}
#: Verbs by what they do: the direction, the edge types (None: all), and whether contains edges are left out.
VERBS = {"deps": ("out", None, True), "dependents": ("in", None, True), "impact": ("out", None, False), "ancestors": ("in", None, False), "callers": ("in", ["calls"], False), "callees": ("out", ["calls"], False)}
#: Hops that a verb goes where it isn't said.
DEPTHS = {"deps": 1, "dependents": 1, "callers": 1, "callees": 1}
COLUMNS = ("id", "type", "name", "file_path", "line_start", "line_end", "complexity")


def register(nodes: DataFrame, edges: DataFrame) -> None:
    """Views nodes, edges, functions, classes, modules: the virtual tables are views, so they work in joins and under aliases."""
    nodes.createOrReplaceTempView("nodes")
    edges.createOrReplaceTempView("edges")
    for view, kind in (("functions", "function"), ("classes", "class"), ("modules", "module")):
        nodes.where(F.col("type") == kind).createOrReplaceTempView(view)


def normalised(sql: str) -> str:
    """The dialect shim: type literals in lower case, ::TEXT, GLOB '[A-Z]*', list functions."""
    sql = re.sub(r"""(\btype\s*=\s*)(['"])(\w+)\2""", lambda m: f"{m[1]}'{m[3].lower()}'", sql, flags=re.I)
    sql = re.sub(r"::\s*TEXT\b", "::STRING", sql, flags=re.I)
    sql = re.sub(r"\bGLOB\s+'\[A-Z\]\*'", "rlike '^[A-Z]'", sql, flags=re.I)
    return re.sub(r"\blist_(contains|append)\b", r"array_\1", sql, flags=re.I)


def terse(nodes: DataFrame, text: str) -> DataFrame | None:
    """The rows that a terse query asks for; None where the text isn't one (SQL, or a graph verb)."""
    head, *rest = text.split() or [""]
    if head.lower() not in HEADS:
        return None
    found, order, limit = nodes.where(F.col("type") == HEADS[head.lower()]), None, 100
    for word in rest:
        if m := re.fullmatch(r"c(>=|<=|>|<|=)(\d+)", word):
            found = found.where(f"complexity {m[1]} {m[2]}")
        elif m := re.fullmatch(r"l(\d+)", word):
            limit = int(m[1])
        elif m := re.fullmatch(r"(n|name|f|file|path)%(.+)", word):
            found = found.where(F.col("name" if m[1].startswith("n") else "file_path").like(f"%{m[2].lower()}%"))
        elif m := re.fullmatch(r"o:(-?)(\w+)", word):
            if m[2] in COLUMNS:
                order = F.col(m[2]).desc_nulls_last() if m[1] else F.col(m[2]).asc_nulls_last()
        else:
            found = found.where(F.col("name").like(f"%{word}%"))
    found = found.select(*[c for c in COLUMNS if c in nodes.columns])
    return (found.orderBy(order, "id") if order is not None else found).limit(limit)


def verb(nodes: DataFrame, edges: DataFrame, text: str) -> DataFrame | None:
    """The rows that a graph verb asks for; None where the text isn't one.

    deps X, dependents X, callers X, callees X go one hop, impact X and ancestors X as far as edges lead; dN or a number says how many
    hops, lN how many rows (100 without). Rows are id, name, type, file_path, depth by depth and name. path X Y gives step, id of a
    shortest path. X is resolved as resolve.node() does.
    """
    head, *rest = text.split() or [""]
    head = head.lower()
    depths = [int(m[1]) for w in rest if (m := re.fullmatch(r"d(?:epth)?(\d+)|(\d+)", w)) and m[1]] or [int(w) for w in rest if w.isdigit()]
    limits = [int(w[1:]) for w in rest if re.fullmatch(r"l\d+", w)]
    names = [w for w in rest if not re.fullmatch(r"d(?:epth)?\d+|l?\d+", w)]
    spark = nodes.sparkSession
    if head == "path" and len(names) == 2:
        found = graph.shortest_path(edges, *(resolve.node(nodes, n) for n in names)) or []
        return spark.createDataFrame(list(enumerate(found)), "step int, id string")
    if head not in VERBS or len(names) != 1:
        return None
    direction, types, outer = VERBS[head]
    seed = spark.createDataFrame([(resolve.node(nodes, names[0]),)], "id string")
    depth = depths[0] if depths else DEPTHS.get(head)
    if outer:
        found = graph.deps(edges, seed, reverse=direction == "in", depth=depth, nodes=nodes)
    else:
        found = graph.reach(graph.oriented(edges, direction, types), seed, depth).where("depth > 0")
    rows = found.join(nodes.select("id", "name", "type", "file_path"), "id").select("id", "name", "type", "file_path", "depth")
    return rows.orderBy("depth", "name", "id").limit(limits[0] if limits else 100)


#: What --schema and --examples say.
SCHEMA = {"nodes": ("id", "type", "name", "qualified_name", "file_path", "line_start", "line_end", "properties", "complexity"), "edges": ("id", "source_id", "target_id", "type", "properties")}
EXAMPLES = ("fn c>10 o:-complexity l20", "cls n%service", "mod f%src/api", "deps Auth d2", "path A B", "SELECT type, COUNT(*) FROM nodes GROUP BY type")


def query(spark: SparkSession, text: str, limit: int | None = None, args: list | dict | None = None) -> DataFrame:
    """A terse query, a graph verb or SQL (with parameters) over the registered views. A limit is added to SQL that has none."""
    found = terse(spark.table("nodes"), text)
    if found is None:
        found = verb(spark.table("nodes"), spark.table("edges"), text)
    if found is None:
        found = spark.sql(normalised(text), args=args) if args else spark.sql(normalised(text))
        return found if limit is None or re.search(r"\slimit\s", text, re.I) else found.limit(limit)
    return found.limit(limit) if limit is not None else found


def as_dicts(found: DataFrame) -> list[dict]:
    """The rows of a result as tables in the driver; for results that a limit bounds."""
    return [r.asDict(recursive=True) for r in found.collect()]
