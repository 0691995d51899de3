"""Source trees as DataFrames: languages of files, scans with ignore rules, stale parses."""

from __future__ import annotations

import fnmatch
import json
import os
import re
import subprocess

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Languages by extension, as a scan sees them.
SCANNED = {
    "python": "py pyw pyi", "javascript": "js mjs", "jsx": "jsx", "typescript": "ts", "tsx": "tsx", "csharp": "cs", "go": "go", "rust": "rs", "java": "java", "kotlin": "kt kts", "ruby": "rb", "php": "php",
    "swift": "swift", "c": "c h", "cpp": "cpp hpp cc", "yaml": "yaml yml", "json": "json", "toml": "toml", "markdown": "md", "sql": "sql", "shell": "sh bash zsh",
}
# Languages by extension, as naming conventions see them.
NAMED = {
    "python": "py pyi pyw", "rust": "rs", "go": "go", "javascript": "js mjs cjs jsx", "typescript": "ts mts cts tsx", "java": "java", "csharp": "cs", "c": "c h", "cpp": "cpp cc cxx hpp hxx", "ruby": "rb", "php": "php",
    "kotlin": "kt kts", "swift": "swift", "scala": "scala", "elixir": "ex exs", "erlang": "erl hrl", "haskell": "hs lhs", "ocaml": "ml mli", "fsharp": "fs fsi fsx", "clojure": "clj cljs cljc edn", "lua": "lua", "r": "r",
    "julia": "jl", "nim": "nim", "zig": "zig", "v": "v", "d": "d", "dart": "dart",
}
# Languages by extension (in this case only) that a diff compares.
COMPARED = {"python": "py", "typescript": "ts tsx", "javascript": "js jsx", "go": "go", "rust": "rs", "java": "java", "csharp": "cs"}
# Languages that a scan keeps.
SUPPORTED = ("python", "typescript", "tsx", "javascript", "jsx", "csharp", "go", "rust", "java", "yaml", "json", "toml", "markdown")
# What is always ignored.
IGNORED = (".git/", "node_modules/", "__pycache__/", "*.pyc", ".venv/", "venv/", "target/", "archive/")


def _by_extension(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for language, found in table.items() for e in found.split() for x in (e, language)])


def language(path: Column, table: dict[str, str] = SCANNED) -> Column:
    """The language of a path by its extension; null where the table has none ('unknown' by NAMED)."""
    extension = F.regexp_extract(path, r"[^/]\.([^./]+)$", 1)
    found = F.try_element_at(_by_extension(table), extension if table is COMPARED else F.lower(extension))
    return F.coalesce(found, F.lit("unknown")) if table is NAMED else found


def is_supported(language: Column) -> Column:
    return F.coalesce(language.isin(*SUPPORTED), F.lit(False))


def ignore_pattern(rules: list[str]) -> str:
    """A regular expression of the relative paths that rules in the manner of .gitignore leave out. Later rules that begin with ! can't
    take a file back that an earlier one left out with its folder."""
    parts = []
    for rule in (r.strip() for r in rules):
        if not rule or rule.startswith(("#", "!")):
            continue
        folder, body = rule.endswith("/"), rule.strip("/")
        pattern = fnmatch.translate(body.replace("**/", "*")).replace("(?s:", "").rsplit(")", 1)[0].replace(".*", "[^/]*" if "**" not in rule else ".*")
        parts.append(("^" if rule.startswith("/") or "/" in body else "(?:^|/)") + pattern + ("/" if folder else "(?:/|$)"))
    return "|".join(parts) or r"(?!)"


def rules_of(root: str, *names: str) -> list[str]:
    """Rules of the ignore files at a root that the driver can read."""
    found = []
    for name in names or (".gitignore", ".scanignore"):
        if os.path.isfile(path := os.path.join(root, name)):
            with open(path, encoding="utf-8", errors="replace") as f:
                found += f.read().splitlines()
    return found


def listing(spark: SparkSession, root: str) -> DataFrame:
    """path (relative to ``root``), uri, size_bytes of all files under it. Names and sizes go through the driver, contents don't.

    Spark's own file sources leave out names that begin with _ or ., which __init__.py does.
    """
    top = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    base, rows, found = fs.makeQualified(top).toString().rstrip("/"), [], fs.listFiles(top, True)
    while found.hasNext():
        status = found.next()
        uri = status.getPath().toString()
        rows.append((uri[len(base) + 1 :], uri, status.getLen()))
    return spark.createDataFrame(rows, "path string, uri string, size_bytes long")


def _read(batches):
    from pyarrow import fs

    for part in batches:
        for i in range(len(part)):
            row = part.iloc[i : i + 1]
            store, path = fs.FileSystem.from_uri(row["uri"].iat[0])
            with store.open_input_stream(path) as f:
                yield row.drop(columns="uri").assign(content=[f.read()])


def scan(spark: SparkSession, root: str, extensions: list[str] | None = None, max_bytes: int | None = None, languages: list[str] | None = None, ignore: list[str] | None = None, hidden: bool = False, hashes: bool = True, lines: bool = True) -> DataFrame:
    """path (relative to ``root``), language, size_bytes, hash, lines, source of the files in a supported language.

    Filters are those of a scan: extension, language known and supported, ``languages``, ``max_bytes``, ignore rules (IGNORED, the root's
    own ignore files, ``ignore``), hidden files and folders. They hold before any content is read, which each task does for its files.
    """
    files = listing(spark, root).withColumn("language", language(F.col("path")))
    files = files.where(is_supported(F.col("language"))).where(~F.col("path").rlike(ignore_pattern([*IGNORED, *rules_of(root), *(ignore or [])])))
    if not hidden:
        files = files.where(~F.col("path").rlike(r"(?:^|/)\.[^/]"))
    if extensions:
        files = files.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin([e.lower().lstrip(".") for e in extensions]))
    if languages:
        files = files.where(F.col("language").isin(languages))
    if max_bytes is not None:
        files = files.where(F.col("size_bytes") <= max_bytes)
    files = files.select("path", "language", "size_bytes", "uri").mapInPandas(_read, "path string, language string, size_bytes long, content binary")
    text = F.decode("content", "utf-8")
    return files.select("path", "language", "size_bytes", (F.sha2("content", 256) if hashes else F.lit(None).cast("string")).alias("hash"), (line_count(text) if lines else F.lit(0)).alias("lines"), text.alias("source"))


def line_count(text: Column) -> Column:
    """Line breaks, as a scan counts lines."""
    return (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))).cast("int")


def total_lines(text: Column) -> Column:
    """Lines, as a parser counts them: the last may lack its line break."""
    return F.when(F.length(text) == 0, 0).otherwise(line_count(text) + F.when(text.endswith("\n"), 0).otherwise(1)).cast("int")


def skipped(spark: SparkSession, root: str) -> DataFrame:
    """language (null for an unknown one), files: what a scan of ``root`` leaves out for its language."""
    files = listing(spark, root).select(language(F.col("path")).alias("language"))
    return files.where(~is_supported(F.col("language"))).groupBy("language").agg(F.count(F.lit(1)).alias("files"))


def unparsed(files: DataFrame, cache: DataFrame) -> DataFrame:
    """The files whose (path, hash) the cache of parsed modules lacks."""
    return files.join(cache.select("path", "hash"), ["path", "hash"], "left_anti")


def cached(files: DataFrame, cache: DataFrame) -> DataFrame:
    """The cache without modules of files that are gone or changed."""
    return cache.join(files.select("path", "hash"), ["path", "hash"], "left_semi")


def hit_rate(files: DataFrame, cache: DataFrame) -> DataFrame:
    """One row: files, hits, hit_rate."""
    marked = files.select("path", "hash").join(cache.select("path", "hash", F.lit(1).alias("hit")), ["path", "hash"], "left")
    return marked.agg(F.count(F.lit(1)).alias("files"), F.count("hit").alias("hits")).withColumn("hit_rate", F.when(F.col("files") > 0, F.col("hits") / F.col("files")).otherwise(0.0))


def mentions(files: DataFrame, word: str, context: int = 30, limit: int = 20) -> DataFrame:
    """path, line, text of the first ``limit`` files that hold ``word``, each with up to ``context`` lines from its first mention on."""
    found = files.where(F.col("source").contains(word)).select("path", F.split("source", "\n").alias("rows"))
    first = F.array_position(F.transform("rows", lambda r: r.contains(word)), F.lit(True)).cast("int")
    return found.select("path", first.alias("line"), F.array_join(F.slice("rows", first, F.lit(context)), "\n").alias("text")).orderBy("path").limit(limit)


# --- git ---------------------------------------------------------------------------------------------------------------


def _git(root: str, *words: str) -> str:
    return subprocess.run(["git", "-C", root, *words], check=True, capture_output=True, text=True).stdout


def commits(spark: SparkSession, root: str, path: str | None = None, limit: int | None = None) -> DataFrame:
    """hash, author, date, subject, file of the commits of a repository that the driver can read, newest first."""
    args = ["log", "--name-only", "--date=iso-strict", "--format=%x1e%H%x1f%an%x1f%ad%x1f%s"] + ([f"-{limit}"] if limit else []) + (["--", path] if path else [])
    rows = []
    for entry in _git(root, *args).split("\x1e")[1:]:
        head, *files = entry.strip("\n").split("\n")
        rows += [(*head.split("\x1f"), f) for f in files if f]
    return spark.createDataFrame(rows, "hash string, author string, date string, subject string, file string")


def changed_files(spark: SparkSession, root: str, base: str, head: str) -> DataFrame:
    """file, language of the files that differ between the merge base of two revisions and the second."""
    rows = [(f,) for f in _git(root, "diff", "--name-only", f"{base}...{head}").splitlines()]
    return spark.createDataFrame(rows, "file string").withColumn("language", language(F.col("file"), COMPARED))


def at_revision(spark: SparkSession, root: str, revision: str, paths: list[str]) -> DataFrame:
    """path, source of files at a revision; those that it lacks have no row."""
    rows = []
    for p in paths:
        try:
            rows.append((p, _git(root, "show", f"{revision}:{p}")))
        except subprocess.CalledProcessError:
            continue
    return spark.createDataFrame(rows, "path string, source string")


# --- path aliases and workspaces -----------------------------------------------------------------------------------------


def _json(path: str) -> dict:
    """JSON with comments and trailing commas; an empty table where a file can't be read."""
    try:
        with open(path, encoding="utf-8") as f:
            text = f.read()
        text = re.sub(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/', lambda m: m[1] or "", text, flags=re.S)
        return json.loads(re.sub(r",(\s*[}\]])", r"\1", text))
    except (OSError, ValueError):
        return {}


def path_aliases(root: str) -> list[tuple[str, str]]:
    """(pattern, target) of the paths in tsconfig.json or jsconfig.json at a root and what they extend; one * in a pattern stands for any
    text. Targets are relative to the root."""
    for name in ("tsconfig.json", "jsconfig.json"):
        config, folder, seen = _json(os.path.join(root, name)), root, set()
        while config:
            options = config.get("compilerOptions", {})
            if options.get("paths"):
                base = os.path.relpath(os.path.join(folder, options.get("baseUrl", ".")), root)
                return [(k, os.path.normpath(os.path.join(base, v[0]))) for k, v in options["paths"].items() if v]
            above = config.get("extends")
            if not isinstance(above, str) or above in seen or not above.startswith("."):
                break
            seen.add(above)
            path = os.path.join(folder, above if above.endswith(".json") else above + ".json")
            config, folder = _json(path), os.path.dirname(path)
    return []


def workspaces(root: str) -> list[tuple[str, str]]:
    """(package, folder) of the workspaces that package.json at a root names, one level of /* deep."""
    named = _json(os.path.join(root, "package.json")).get("workspaces", [])
    found = []
    for pattern in named.get("packages", []) if isinstance(named, dict) else named:
        folders = sorted(os.listdir(os.path.join(root, pattern[:-2]))) if pattern.endswith("/*") and os.path.isdir(os.path.join(root, pattern[:-2])) else []
        for folder in [f"{pattern[:-2]}/{f}" for f in folders] if pattern.endswith("/*") else [pattern]:
            name = _json(os.path.join(root, folder, "package.json")).get("name")
            if name:
                found.append((name, folder))
    return found
