"""Checks of a code base: naming, tests, imports, undocumented interfaces. An issue is file, category, message, suggestion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import naming
from ..sources import files

# Names that a framework gives to files.
FRAMEWORK_FILES = ("not-found", "error", "loading", "layout", "page", "route", "middleware", "global-error", "default", "template", "sitemap", "robots", "manifest", "opengraph-image", "twitter-image", "icon", "apple-icon", "instrumentation")
# Folders of what a build leaves.
BUILD_FOLDERS = ("/_expo/", "/dist/", "/build/", "/.next/", "/node_modules/", "/.turbo/", "/coverage/", "/target/", "/__pycache__/", "/.venv/")
# Types of nodes by the entity whose convention they follow.
CHECKED = {"function": "function", "method": "method", "class": "class", "struct": "struct", "interface": "interface", "trait": "interface", "enum": "enum", "constant": "constant", "variable": "variable", "module": "module", "property": "property", "field": "property"}


def _or(parts: list[Column]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | p
    return out


def is_build_artifact(path: Column) -> Column:
    return F.coalesce(_or([path.contains(p) for p in BUILD_FOLDERS]) | path.rlike(r"-[a-f0-9]{8,}\."), F.lit(False))


def is_test_file(path: Column) -> Column:
    low = F.lower(path)
    return _or([low.contains(p) for p in ("/tests/", "/test/", "/__tests__/", ".test.", ".spec.", "_test.")]) | low.startswith("test_") | low.endswith("tests.cs")


def under(nodes: DataFrame, path: str, column: str = "file_path") -> DataFrame:
    """Nodes whose file path holds ``path``; '.' and '' are all that have one."""
    found = nodes.where(F.col(column).isNotNull())
    return found if path in ("", ".") else found.where(F.col(column).contains(path))


def naming_issues(nodes: DataFrame, convention: str | None = None) -> DataFrame:
    """file, category, message, suggestion (and id, expected) of names that don't follow their language's convention, or ``convention``.

    Left out: no name, two underscores on both sides, constants, private names, build artifacts, migrations, files that a framework
    names, dotted modules, other types of nodes, C# tests, components in .tsx and .jsx, and modules of JavaScript and TypeScript in
    kebab-case or PascalCase.
    """
    name, path, entity = F.col("name"), F.col("file_path"), F.try_element_at(F.create_map(*[F.lit(x) for kv in CHECKED.items() for x in kv]), "type")
    language = F.coalesce(files.language(path, files.NAMED), F.lit("unknown"))
    rows = nodes.where(F.col("name") != "").select("id", "name", "file_path", "type", entity.alias("entity"), language.alias("language"))
    lang, ent, callable_ = F.col("language"), F.col("entity"), F.col("entity").isin("function", "method")
    module, web = ent == "module", F.col("language").isin("javascript", "typescript")
    skipped = ent.isNull() | naming.is_dunder(name) | naming.is_exempt(name) | is_build_artifact(path) | F.coalesce(path.rlike(r"[/\\]Migrations[/\\]"), F.lit(False))
    skipped = skipped | (module & (name.isin(*FRAMEWORK_FILES) | name.contains("."))) | ((lang == "csharp") & callable_ & naming.is_csharp_test(name, path))
    skipped = skipped | (callable_ & F.coalesce(path.rlike(r"\.[tj]sx\z"), F.lit(False)) & name.rlike(r"^\p{Lu}")) | (module & web & (naming.is_kebab(name) | naming.is_pascal(name)))
    want = F.lit(naming.CONVENTIONS[convention.lower()]) if convention else naming.expected(lang, ent, path)
    rows = rows.where(~skipped).withColumn("expected", want).withColumn("better", naming.suggestion(name, F.col("expected"))).where("better is not null")
    message = F.concat(F.initcap("entity"), F.lit(" '"), "name", F.lit("' should use "), "expected", F.lit(" ("), "language", F.lit(")"))
    return rows.select(F.coalesce("file_path", "id").alias("file"), F.lit("naming").alias("category"), message.alias("message"), F.concat(F.lit("Rename to '"), "better", F.lit("'")).alias("suggestion"), "id", "expected")


def test_path(path: Column) -> Column:
    """Where the tests of a file would be, by its language."""
    lang, name, folder = files.language(path, files.NAMED), F.regexp_extract(path, r"([^/]*)$", 1), F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    project = F.get(F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "src") & ~p.contains(".")), 0)
    base = F.regexp_replace(name, r"\.(?:tsx?|jsx?)\z", "")
    return (
        F.when(lang == "csharp", F.concat(F.lit("tests/"), F.coalesce(project, F.lit("Project")), F.lit(".Tests/"), F.replace(name, F.lit(".cs"), F.lit("Tests.cs"))))
        .when(lang.isin("typescript", "javascript"), F.concat(F.lit("__tests__/"), base, F.lit(".test."), F.when(lang == "typescript", "ts").otherwise("js")))
        .when(lang == "go", F.concat(F.when(folder == "", ".").otherwise(folder), F.lit("/"), F.regexp_replace(name, r"\.go\z", ""), F.lit("_test.go")))
        .when(lang == "rust", F.concat(F.lit("tests/"), F.regexp_replace(name, r"\.rs\z", ""), F.lit("_test.rs")))
        .when((lang == "java") & path.contains("src/main/java/"), F.replace(F.replace(path, F.lit("src/main/java/"), F.lit("src/test/java/")), F.lit(".java"), F.lit("Test.java")))
        .when(lang == "java", F.concat(F.lit("src/test/java/"), F.regexp_replace(name, r"\.java\z", ""), F.lit("Test.java")))
        .when(path.contains("src/"), F.replace(path, F.lit("src/"), F.lit("tests/test_")))
        .otherwise(F.concat(F.lit("tests/test_"), name))
    )


def untested(nodes: DataFrame, path: str = ".") -> DataFrame:
    """file_path, name of functions outside tests whose name no test function's name holds.

    A name that a test's holds is one of its substrings: those of the tests' names, as long as names are, meet the functions by equality.
    """
    functions = under(nodes.where("type = 'function'"), path)
    tests = functions.where(F.col("file_path").contains("test")).select("name").distinct()
    own = functions.where(~F.col("file_path").contains("test") & ~F.col("name").startswith("__")).select("file_path", "name").distinct()
    starts = F.sequence(F.lit(1), F.length("name"))
    parts = tests.where("name <> ''").select(F.explode(F.array_distinct(F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), F.length("name") - i + 1), lambda n: F.col("name").substr(i, n)))))).alias("name")).distinct()
    return own.join(parts, "name", "left_anti").select("file_path", "name")


def test_issues(nodes: DataFrame, path: str = ".", functions: int = 100, files_: int = 20) -> DataFrame:
    """Files with functions that have no test: of the first functions by path, at most so many files."""
    first = under(nodes.where("type = 'function'"), path).where(~F.col("file_path").contains("test") & ~F.col("name").startswith("__")).select("file_path", "name").distinct().orderBy("file_path", "name").limit(functions)
    lone = untested(nodes, path).join(first, ["file_path", "name"], "left_semi").groupBy("file_path").agg(F.count(F.lit(1)).alias("n"))
    return lone.orderBy("file_path").limit(files_).select(F.col("file_path").alias("file"), F.lit("testing").alias("category"), F.concat("n", F.lit(" function(s) without corresponding tests")).alias("message"), F.concat(F.lit("Create test file: "), test_path(F.col("file_path"))).alias("suggestion"))


def import_issues(nodes: DataFrame, edges: DataFrame, path: str = ".", most: int = 50) -> DataFrame:
    """Files that import more than ``most`` external modules."""
    outside = edges.where("type = 'imports'").where(F.col("target_id").startswith("ext:")).select(F.col("source_id").alias("id"))
    many = outside.join(under(nodes, path).select("id", "file_path"), "id").groupBy("file_path").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)
    return many.select(F.col("file_path").alias("file"), F.lit("imports").alias("category"), F.concat(F.lit("Excessive imports: "), "n", F.lit(" external dependencies")).alias("message"), F.lit("Consider breaking this module into smaller pieces").alias("suggestion"))


def interface_issues(nodes: DataFrame, path: str = ".", limit: int = 50) -> DataFrame:
    """Functions named after interfaces, endpoints or routes without a docstring, outside tests."""
    name = F.col("name")
    found = under(nodes.where("type = 'function'"), path).where(_or([name.contains(w) for w in ("api", "endpoint", "route")]) & ~F.col("file_path").contains("test"))
    found = found.where(F.col("properties").isNull() | ~F.col("properties").contains("docstring")).orderBy("id").limit(limit)
    found = found.where(~is_test_file(F.col("file_path")) & ~(name.startswith("_") & ~naming.is_dunder(name)))
    return found.select(F.col("file_path").alias("file"), F.lit("api").alias("category"), F.concat(F.lit("API function '"), "name", F.lit("' lacks documentation")).alias("message"), F.lit("Add docstring with parameters and return type").alias("suggestion"))


def unique_files(nodes: DataFrame, path: str = ".") -> DataFrame:
    return under(nodes, path).agg(F.countDistinct("file_path").alias("files"))
