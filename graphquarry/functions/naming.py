"""Naming conventions as column expressions: case predicates, case converters, and what a language expects of an entity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SNAKE, PASCAL, CAMEL, SCREAMING = "snake_case", "PascalCase", "camelCase", "SCREAMING_SNAKE_CASE"
# Other names of the conventions and of the entities.
CONVENTIONS = {"snake": SNAKE, "snake_case": SNAKE, "pascal": PASCAL, "pascalcase": PASCAL, "pascal_case": PASCAL, "camel": CAMEL, "camelcase": CAMEL, "camel_case": CAMEL, "screaming": SCREAMING, "screaming_snake": SCREAMING, "screaming_snake_case": SCREAMING, "constant": SCREAMING, "constants": SCREAMING}
ENTITIES = {"function": "function", "func": "function", "fn": "function", "method": "method", "class": "class", "struct": "struct", "interface": "interface", "trait": "interface", "protocol": "interface", "enum": "enum", "constant": "constant", "const": "constant", "variable": "variable", "var": "variable", "module": "module", "mod": "module", "package": "module", "property": "property", "prop": "property", "field": "property", "parameter": "parameter", "param": "parameter", "arg": "parameter"}
# Endings of a module's name that say nothing about its case.
SUFFIXES = (".native", ".web", ".ios", ".android", ".macos", ".windows", ".test", ".spec", ".stories", ".styles", ".styled", ".mock")

#: What a language expects of functions (and methods), variables (and parameters), constants, modules and properties; types are always
#: in PascalCase. Other languages are as Python.
EXPECTED = {
    "python": (SNAKE, SNAKE, SCREAMING, SNAKE, SNAKE), "rust": (SNAKE, SNAKE, SCREAMING, SNAKE, SNAKE), "go": (PASCAL, CAMEL, PASCAL, SNAKE, PASCAL),
    "javascript": (CAMEL, CAMEL, SCREAMING, CAMEL, CAMEL), "typescript": (CAMEL, CAMEL, SCREAMING, CAMEL, CAMEL), "java": (CAMEL, CAMEL, SCREAMING, SNAKE, CAMEL),
    "csharp": (PASCAL, CAMEL, PASCAL, PASCAL, PASCAL), "c": (SNAKE, SNAKE, SCREAMING, SNAKE, SNAKE), "cpp": (SNAKE, SNAKE, SCREAMING, SNAKE, SNAKE), "ruby": (SNAKE, SNAKE, SCREAMING, PASCAL, SNAKE),
    "php": (CAMEL, CAMEL, SCREAMING, PASCAL, CAMEL), "kotlin": (CAMEL, CAMEL, SCREAMING, SNAKE, CAMEL), "swift": (CAMEL, CAMEL, CAMEL, PASCAL, CAMEL),
}
_GROUPS = {"function": 0, "method": 0, "variable": 1, "parameter": 1, "constant": 2, "module": 3, "property": 4}


def is_dunder(name: Column) -> Column:
    return (F.length(name) > 4) & name.rlike(r"(?s)^__.*__\z") & ~name.substr(F.lit(3), F.length(name) - 4).contains("__")


def is_snake(name: Column) -> Column:
    return is_dunder(name) | (name.rlike(r"^_*(?:[a-z0-9][a-z0-9_]*)?\z") & (name != "") & ~F.regexp_replace(name, "^_+", "").contains("__"))


def is_pascal(name: Column) -> Column:
    suffixes = "|".join(s.replace(".", r"\.") for s in SUFFIXES)
    return F.regexp_replace(F.regexp_replace(name, r"(?s)<.*", ""), rf"(?:{suffixes})\z", "").rlike(r"^[A-Z][A-Za-z0-9]*\z")


def is_camel(name: Column) -> Column:
    return name.rlike(r"^[a-z][A-Za-z0-9]*\z")


def is_screaming(name: Column) -> Column:
    return name.rlike(r"^[A-Z0-9][A-Z0-9_]*\z") & ~name.contains("__")


def is_kebab(name: Column) -> Column:
    return name.rlike(r"^[a-z0-9]+(?:-[a-z0-9]+)*\z")


def is_exempt(name: Column) -> Column:
    """Constants, and private names but for those with two underscores on both sides."""
    return is_screaming(name) | (name.startswith("_") & ~is_dunder(name))


def is_csharp_test(name: Column, path: Column) -> Column:
    """Parts in PascalCase joined by underscores: two in a test file, three anywhere."""
    parts = F.split(name, "_")
    tested = F.coalesce(F.lower(path).rlike("test|spec"), F.lit(False))
    return name.rlike(r"^[A-Z][^_]*(?:_[A-Z][^_]*)+\z") & (tested | (F.size(parts) >= 3))


def to_snake(name: Column) -> Column:
    split = F.regexp_replace(F.regexp_replace(F.regexp_replace(name, r"[-_ ]+", "_"), r"([^A-Z_])([A-Z])", "$1_$2"), r"([A-Z])([A-Z][a-z])", "$1_$2")
    return F.lower(F.regexp_replace(split, r"^_+|_+\z", ""))


def to_pascal(name: Column) -> Column:
    words = F.filter(F.split(name, r"[-_ ]+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(w.substr(F.lit(2), F.length(w))))), "")


def to_camel(name: Column) -> Column:
    """A name with capitals inside only loses its first one."""
    keeps = name.rlike(r"(?s)^..*\p{Lu}") & ~name.rlike(r"[-_ ]") & name.rlike(r"\p{Ll}")
    whole = F.when(keeps, name).otherwise(to_pascal(name))
    return F.concat(F.lower(F.substring(whole, 1, 1)), whole.substr(F.lit(2), F.length(whole)))


def to_screaming(name: Column) -> Column:
    return F.upper(to_snake(name))


def expected(language: Column, entity: Column, path: Column) -> Column:
    """The convention for an entity of a language; modules of components (.tsx, .jsx) that begin with a capital are in PascalCase."""
    rows = EXPECTED | {"": EXPECTED["python"]}
    table = F.create_map(*[x for lang, found in rows.items() for x in (F.lit(lang), F.array(*map(F.lit, found)))])
    row = F.coalesce(F.try_element_at(table, language), F.try_element_at(table, F.lit("")))
    group = F.try_element_at(F.create_map(*[F.lit(x) for kv in _GROUPS.items() for x in kv]), entity)
    component = (entity == "module") & F.coalesce(path.rlike(r"(?:^|[/\\])\p{Lu}[^/\\]*\.[tj]sx\z"), F.lit(False))
    return F.when(component, PASCAL).when(group.isNull(), PASCAL).otherwise(F.get(row, group))


def suggestion(name: Column, convention: Column) -> Column:
    """The name as the convention has it; null where it follows it."""
    out = F.lit(None).cast("string")
    for which, follows, turned in ((SNAKE, is_snake, to_snake), (PASCAL, is_pascal, to_pascal), (CAMEL, is_camel, to_camel), (SCREAMING, is_screaming, to_screaming)):
        out = F.when(convention == which, F.when(~follows(name), turned(name))).otherwise(out)
    return out
