"""What is left of parsed modules when boilerplate goes, places in texts, and edits of sources."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Methods, imports and parameters that say nothing of a module.
METHODS = ("__repr__", "__str__", "__hash__", "__eq__", "__ne__", "__lt__", "__le__", "__gt__", "__ge__")
IMPORTS = ("typing", "__future__")
PARAMETERS = ("self", "cls")


def strips_method(name: Column, methods: tuple[str, ...] = METHODS) -> Column:
    """Whether a method goes: by its name, or, for a pattern with *, by what it holds."""
    out = F.lit(False)
    for m in methods:
        out = out | (name.contains(m.replace("*", "")) if "*" in m else name == m)
    return out


def strips_import(module: Column, imports: tuple[str, ...] = IMPORTS) -> Column:
    out = F.lit(False)
    for i in imports:
        out = out | (module == i) | module.startswith(f"{i}.")
    return out


def reduced(module: Column, methods: tuple[str, ...] = METHODS, imports: tuple[str, ...] = IMPORTS, parameters: tuple[str, ...] = PARAMETERS) -> Column:
    """A parsed module without stripped methods, imports and parameters."""
    plain = lambda f: f.withField("parameters", F.filter(f["parameters"], lambda p: ~p["name"].isin(*parameters)))
    left = lambda fs: F.transform(F.filter(fs, lambda f: ~strips_method(f["name"], methods)), plain)
    classes = F.transform(module["classes"], lambda c: c.withField("methods", left(c["methods"])))
    return module.withField("imports", F.filter(module["imports"], lambda i: ~strips_import(i["module"], imports))).withField("classes", classes).withField("functions", left(module["functions"]))


def line_and_column(text: Column, position: Column) -> Column:
    """(line, column) of a position in a text, all in characters; both count from one, the position from zero."""
    before = text.substr(F.lit(1), position)
    last = F.regexp_extract(before, r"([^\n]*)\z", 1)
    return F.struct((F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1).alias("line"), (F.length(last) + 1).alias("column"))


def edited(files: DataFrame, edits: DataFrame) -> DataFrame:
    """path, source, failed of files (path, source) after their edits (path, ord, start, stop, put) in the order of ``ord``.

    start and stop are byte offsets into the source as it is then. An edit beyond its ends, backwards, or inside a character is left out
    and counted in ``failed``.
    """
    listed = edits.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("ord", "start", "stop", "put"))).alias("edits"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            rows = []
            for path, source, own in zip(part["path"], part["source"], part["edits"], strict=True):
                raw, failed = (source or "").encode(), 0
                for e in own if own is not None else ():
                    new = raw[: max(0, e["start"])] + (e["put"] or "").encode() + raw[max(0, e["stop"]) :]
                    try:
                        new.decode(), raw[: max(0, e["start"])].decode()
                        good = 0 <= e["start"] <= e["stop"] <= len(raw)
                    except UnicodeDecodeError:
                        good = False
                    raw, failed = (new, failed) if good else (raw, failed + 1)
                rows.append((path, raw.decode(), failed))
            yield pd.DataFrame(rows, columns=["path", "source", "failed"])

    return files.select("path", "source").join(listed, "path", "left").mapInPandas(run, "path string, source string, failed int")
