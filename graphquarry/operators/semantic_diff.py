"""Semantic diff of two sets of parsed modules (see sources.parsers.MODULE): entities as rows, one full outer join by their keys.

A change is path, entity_type, parent, name, change, breaking, old_signature, new_signature, details. Children of what was added or
removed as a whole aren't listed. Of entities with one key the last counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import stored

#: What is counted, in the order of a summary.
KINDS = ("module", "function", "class", "method", "parameter", "import")
_COLUMNS = ("path", "entity_type", "parent", "name", "scope", "signature", "returns", "is_async", "is_static", "complexity", "bases", "kind", "preset", "note", "at")


def signature(f: Column) -> Column:
    """[async ]name(p: type = default, ...)[ -> type]"""
    text = lambda mark, c: F.coalesce(F.concat(F.lit(mark), c), F.lit(""))
    parameters = F.transform(f["parameters"], lambda p: F.concat(p["name"], text(": ", p["type_annotation"]), text(" = ", p["default_value"])))
    return F.concat(F.when(f["is_async"], "async ").otherwise(""), f["name"], F.lit("("), F.array_join(parameters, ", "), F.lit(")"), text(" -> ", f["return_type"]))


def entities(modules: DataFrame) -> DataFrame:
    """Rows of all entities of modules (path, m); ``scope`` is the key of the entity that an entity belongs to."""
    key = lambda kind, *parts: F.concat_ws("\x1f", F.lit(kind), *parts)
    none = {"parent": F.lit(None).cast("string"), "signature": F.lit(None).cast("string"), "returns": F.lit(None).cast("string"), "is_async": F.lit(None).cast("boolean"), "is_static": F.lit(None).cast("boolean"), "complexity": F.lit(None).cast("int"), "bases": F.lit(None).cast("array<string>"), "kind": F.lit(None).cast("string"), "preset": F.lit(None).cast("string"), "note": F.lit(None).cast("string"), "at": F.lit(0)}

    def rows(df: DataFrame, **known: Column) -> DataFrame:
        return df.select(*[(known.get(c, none.get(c))).alias(c) for c in _COLUMNS])

    ok = modules.where("m.error is null")
    said = lambda f: {"signature": signature(f), "returns": f["return_type"], "is_async": f["is_async"], "is_static": f["is_static"], "complexity": f["body_complexity"]}
    n_functions, n_classes = F.size("m.functions"), F.size("m.classes")
    whole = rows(ok, path=F.col("path"), entity_type=F.lit("module"), name=F.col("m.name"), scope=F.lit(""), note=F.when(n_functions + n_classes > 0, F.concat(n_functions, F.lit(" functions, "), n_classes, F.lit(" classes"))))
    functions = ok.select("path", F.posexplode("m.functions").alias("at", "f"))
    classes = ok.select("path", F.posexplode("m.classes").alias("at", "c"))
    methods = classes.select("path", "c", F.posexplode("c.methods").alias("at", "f"))
    module, f, c = key("module", "path"), F.col("f"), F.col("c")
    bases = F.when(F.size("c.bases") > 0, F.concat(F.lit("bases: "), F.array_join("c.bases", ", ")))
    found = [
        whole,
        rows(functions, path=F.col("path"), entity_type=F.lit("function"), name=f["name"], scope=module, at=F.col("at"), **said(f)),
        rows(classes, path=F.col("path"), entity_type=F.lit("class"), name=c["name"], scope=module, bases=F.array_sort(F.array_distinct("c.bases")), note=bases, at=F.col("at")),
        rows(methods, path=F.col("path"), entity_type=F.lit("method"), parent=c["name"], name=f["name"], scope=key("class", "path", c["name"]), at=F.col("at"), **said(f)),
        rows(classes.select("path", "c", F.explode("c.attributes").alias("a")), path=F.col("path"), entity_type=F.lit("attribute"), parent=c["name"], name=F.col("a"), scope=key("class", "path", c["name"])),
        rows(ok.select("path", F.explode("m.imports.module").alias("i")), path=F.col("path"), entity_type=F.lit("import"), name=F.col("i"), scope=module),
    ]
    for of, parent, scope in ((functions, f["name"], key("function", "path", f["name"])), (methods, F.concat_ws(".", c["name"], f["name"]), key("method", "path", c["name"], f["name"]))):
        each = of.select("path", *(["c"] if "c" in of.columns else []), "f", F.posexplode("f.parameters").alias("n", "p"))
        note = F.concat_ws(", ", F.concat(F.lit("type: "), "p.type_annotation"), F.concat(F.lit("default: "), "p.default_value"))
        found.append(rows(each, path=F.col("path"), entity_type=F.lit("parameter"), parent=parent, name=F.col("p.name"), scope=scope, kind=F.col("p.type_annotation"), preset=F.col("p.default_value"), note=F.when(note != "", note), at=F.col("n")))
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df)
    by = ["path", "entity_type", "parent", "name", "scope"]
    return out.groupBy(*by).agg(F.max_by(F.struct(*[x for x in _COLUMNS if x not in by]), "at").alias("v")).select(*by, "v.*")


def changed_files(base: DataFrame, head: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The files (path, source) of both sides whose paths don't have the same sources in both, as often: only these can have changes, as
    all keys hold the path, so that the others, which are compared as they are, needn't be parsed."""
    signed = base.select("path", "source", F.lit(1).alias("n")).unionByName(head.select("path", "source", F.lit(-1).alias("n")))
    paths = stored(signed.groupBy("path", "source").agg(F.sum("n").alias("n")).where("n <> 0").select("path").distinct())
    return base.join(paths, "path", "left_semi"), head.join(paths, "path", "left_semi")


def semantic_diff(base: DataFrame, head: DataFrame) -> DataFrame:
    """The changes from modules (path, m) of ``base`` to those of ``head``.

    Removals break, and so do changed types of parameters, changed results and lost bases. A function is modified if its result, its
    flags, its complexity or a parameter changed; a module if anything in it did.
    """
    keys = ["path", "entity_type", "parent", "name", "scope"]
    side = lambda df, letter: entities(df).select(*[F.col(k).alias(f"{letter}_{k}") for k in keys], F.struct(*[c for c in _COLUMNS if c not in keys]).alias(letter))
    a, b = side(base, "a"), side(head, "b")
    # A module is known by its path alone.
    plain = [F.col(f"a_{k}") == F.col(f"b_{k}") for k in ("path", "entity_type", "scope")]
    a, b = (x.withColumn(f"{n}_key", F.when(F.col(f"{n}_entity_type") == "module", "").otherwise(F.col(f"{n}_name"))) for x, n in ((a, "a"), (b, "b")))
    both = stored(a.join(b, [*plain, F.col("a_key") == F.col("b_key")], "full").select(*[F.coalesce(f"b_{k}", f"a_{k}").alias(k) for k in keys], F.col("a_name").alias("old_name"), "a", "b"))
    own = F.concat_ws("\x1f", "entity_type", "path", F.when(F.col("entity_type") == "method", F.col("parent")), F.when(F.col("entity_type") != "module", F.col("name")))
    common = both.where("a is not null and b is not null").select(own.alias("scope")).distinct()
    gone = both.where("a is null or b is null")
    # Parts of what is there on one side only are left out.
    single = gone.where("entity_type = 'module'").unionByName(gone.where("entity_type <> 'module'").join(common, "scope", "left_semi").select(*gone.columns))
    no, off = F.lit(None).cast("string"), F.lit(False)
    lone = single.select("path", "entity_type", "parent", "name", "scope", F.when(F.col("a").isNull(), "added").otherwise("removed").alias("change"), F.col("b").isNull(), F.col("a.signature"), F.col("b.signature"), F.when(F.col("a").isNull() & F.col("entity_type").isin("module", "class", "parameter"), F.col("b.note")))
    lone = lone.toDF("path", "entity_type", "parent", "name", "scope", "change", "breaking", "old_signature", "new_signature", "details")
    pairs = both.where("a is not null and b is not null")
    differs = lambda c: ~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    was = lambda label, c, none=None: F.when(differs(c), F.concat(F.lit(f"{label}: "), F.coalesce(F.col(f"a.{c}").cast("string"), F.lit(none)) if none else F.col(f"a.{c}").cast("string"), F.lit(" -> "), F.coalesce(F.col(f"b.{c}").cast("string"), F.lit(none)) if none else F.col(f"b.{c}").cast("string")))
    changed = pairs.where("entity_type = 'parameter'").where(differs("kind") | differs("preset")).select("path", "entity_type", "parent", "name", "scope", F.lit("modified").alias("change"), differs("kind").alias("breaking"), no.alias("old_signature"), no.alias("new_signature"), F.concat_ws(", ", was("type", "kind", "none"), was("default", "preset", "none")).alias("details"))
    parameters = lone.where("entity_type = 'parameter'").unionByName(changed)
    per = parameters.groupBy(F.col("scope").alias("own")).agg(F.count(F.lit(1)).alias("n_parameters"))
    fns = pairs.where("entity_type in ('function', 'method')").withColumn("own", own).join(per, "own", "left")
    fns = fns.where(differs("returns") | differs("is_async") | differs("is_static") | differs("complexity") | F.col("n_parameters").isNotNull())
    counted = F.when(F.col("n_parameters").isNotNull(), F.concat("n_parameters", F.lit(" param changes")))
    fns = fns.select("path", "entity_type", "parent", "name", "scope", F.lit("modified").alias("change"), differs("returns").alias("breaking"), F.col("a.signature").alias("old_signature"), F.col("b.signature").alias("new_signature"), F.concat_ws(", ", was("return", "returns", "none"), was("async", "is_async"), was("static", "is_static"), was("complexity", "complexity"), counted).alias("details"))
    more, less = F.array_except("b.bases", "a.bases"), F.array_except("a.bases", "b.bases")
    listed = lambda mark, c: F.when(F.size(c) > 0, F.concat(F.lit(f"{mark}bases: "), F.array_join(c, ", ")))
    classes = pairs.where("entity_type = 'class'").where(differs("bases")).select("path", "entity_type", "parent", "name", "scope", F.lit("modified").alias("change"), (F.size(less) > 0).alias("breaking"), no.alias("old_signature"), no.alias("new_signature"), F.concat_ws("; ", listed("+", more), listed("-", less)).alias("details"))
    inner = lone.unionByName(changed).unionByName(fns).unionByName(classes)
    touched = inner.where("entity_type <> 'module'").groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    names = pairs.where("entity_type = 'module'").select("path", F.col("old_name").alias("name"))
    modified = touched.join(names, "path").select("path", F.lit("module").alias("entity_type"), no.alias("parent"), "name", F.lit("").alias("scope"), F.lit("modified").alias("change"), off.alias("breaking"), no.alias("old_signature"), no.alias("new_signature"), F.concat("n", F.lit(" entity changes")).alias("details"))
    return inner.unionByName(modified).drop("scope")


def _plural(kind: str) -> str:
    return "classes" if kind == "class" else f"{kind}s"


def summary(changes: DataFrame) -> DataFrame:
    """One row of 18 counters: what was added, removed and modified of each kind (imports aren't modified), and breaking_changes."""
    of = lambda kind, change: F.count_if((F.col("entity_type") == kind) & (F.col("change") == change)).alias(f"{_plural(kind)}_{change}")
    counters = [of(k, c) for k in KINDS for c in ("added", "removed", "modified") if (k, c) != ("import", "modified")]
    return changes.agg(*counters, F.count_if("breaking").alias("breaking_changes"))


def summary_text(counters: DataFrame) -> DataFrame:
    """One row, text: the counters that aren't zero, by kind; 'No changes' without any."""
    parts = []
    for kind in KINDS:
        each = [F.when(F.col(f"{_plural(kind)}_{c}") > 0, F.concat(F.col(f"{_plural(kind)}_{c}"), F.lit(f" {c}"))) for c in ("added", "removed", "modified") if f"{_plural(kind)}_{c}" in counters.columns]
        joined = F.concat_ws(", ", *each)
        parts.append(F.when(joined != "", F.concat(F.lit(f"{_plural(kind)}: "), joined)))
    parts.append(F.when(F.col("breaking_changes") > 0, F.concat(F.lit("BREAKING: "), "breaking_changes")))
    text = F.concat_ws("; ", *parts)
    return counters.select(F.when(text == "", "No changes").otherwise(text).alias("text"))


def select_changes(changes: DataFrame, kinds: list[str] | None = None, change: str | None = None, breaking: bool = False) -> DataFrame:
    """The changes of some kinds, of one sort, or that break."""
    if kinds:
        changes = changes.where(F.col("entity_type").isin(kinds))
    if change:
        changes = changes.where(F.col("change") == change)
    return changes.where("breaking") if breaking else changes


def named_diff(base: DataFrame, head: DataFrame, removed_files: list[str] = ()) -> DataFrame:
    """path, kind, name, change of entities by their names alone; a file that is gone has one row of its own."""
    names = lambda df: entities(df).where("entity_type in ('function', 'class', 'method')").select("path", F.col("entity_type").alias("kind"), "name").distinct()
    a, b = names(base), names(head)
    there = F.col("path").isin(list(removed_files)) if removed_files else F.lit(False)
    lost = a.where(~there).exceptAll(b).withColumn("change", F.lit("removed"))
    files = a.where(there).select("path", F.lit("file").alias("kind"), F.col("path").alias("name"), F.lit("removed").alias("change")).distinct()
    return b.exceptAll(a).withColumn("change", F.lit("added")).unionByName(lost).unionByName(files)
