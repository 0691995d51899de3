"""History of files from commits (hash, author, date, subject, file), as sources.files.commits() reads them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def file_history(commits: DataFrame, path: str, limit: int | None = None) -> DataFrame:
    """hash, author, date, subject, change (added for the first, else modified) of a file's commits, newest first."""
    own = commits.where(F.col("file") == path).dropDuplicates(["hash"])
    first = F.row_number().over(Window.partitionBy("file").orderBy("date", "hash")) == 1
    found = own.select("hash", "author", "date", "subject", F.when(first, "added").otherwise("modified").alias("change")).orderBy(F.desc("date"), F.desc("hash"))
    return found.limit(limit) if limit is not None else found


def _numbers(pattern: str) -> Column:
    return F.flatten(F.collect_list(F.regexp_extract_all("subject", F.lit(pattern), F.lit(1))))


def references(commits: DataFrame, path: str) -> DataFrame:
    """One row, issues (#n) and requests (n of pr n or pull #n) that a file's commits name, sorted as texts."""
    own = commits.where(F.col("file") == path)
    pulls = r"(?i)(?:pr|pull)\s*#?(\d+)"
    return own.agg(F.array_sort(F.array_distinct(F.transform(_numbers(r"#(\d+)"), lambda n: F.concat(F.lit("#"), n)))).alias("issues"), F.array_sort(F.array_distinct(_numbers(pulls))).alias("requests"))


def cochanged(commits: DataFrame, path: str, last: int = 50, limit: int = 10) -> DataFrame:
    """other, together: files that changed in the last ``last`` commits of a file, most often first."""
    own = commits.where(F.col("file") == path).select("hash", "date").distinct().orderBy(F.desc("date"), F.desc("hash")).limit(last)
    others = commits.join(F.broadcast(own.select("hash")), "hash", "left_semi").where(F.col("file") != path).select("hash", "file").distinct()
    return others.groupBy(F.col("file").alias("other")).agg(F.count(F.lit(1)).alias("together")).orderBy(F.desc("together"), "other").limit(limit)


# Words of a subject that tell what a commit is, in order of precedence.
CATEGORIES = (("features", ("feat", "add", "implement")), ("fixes", ("fix", "bug")), ("refactors", ("refactor", "clean")), ("docs", ("doc", "comment")))


def category(subject: Column) -> Column:
    low, out = F.lower(subject), F.lit("other")
    for name, words in reversed(CATEGORIES):
        out = F.when(low.rlike("|".join(words)), name).otherwise(out)
    return out


def categories(commits: DataFrame) -> DataFrame:
    """category, n of commits."""
    each = commits.select("hash", "subject").distinct()
    return each.groupBy(category(F.col("subject")).alias("category")).agg(F.count(F.lit(1)).alias("n"))


def about_file(commits: DataFrame, path: str, recent: int = 10) -> DataFrame:
    """One row: commits, contributors, primary_author, origin (its first commit), last, evolution (what its latest commits were)."""
    own = commits.where(F.col("file") == path).select("hash", "author", "date", "subject").distinct()
    authors = own.groupBy("author").agg(F.count(F.lit(1)).alias("n")).agg(F.array_sort(F.collect_list("author")).alias("contributors"), F.min(F.struct(-F.col("n"), "author"))["author"].alias("primary_author"))
    ends = own.agg(F.count(F.lit(1)).alias("commits"), F.min_by("hash", F.struct("date", "hash")).alias("origin"), F.max_by("hash", F.struct("date", "hash")).alias("last"))
    counted = own.orderBy(F.desc("date"), F.desc("hash")).limit(recent).agg(*[F.count_if(category(F.col("subject")) == name).alias(name) for name, _ in CATEGORIES])
    evolution = F.concat_ws(", ", *[F.when(F.col(name) > 0, F.concat(name, F.lit(f" {name}"))) for name, _ in CATEGORIES])
    return ends.join(F.broadcast(authors)).join(F.broadcast(counted.select(evolution.alias("evolution"))))


def about_repository(commits: DataFrame, limit: int = 10) -> DataFrame:
    """author, commits, files of those who changed most."""
    return commits.groupBy("author").agg(F.countDistinct("hash").alias("commits"), F.countDistinct("file").alias("files")).orderBy(F.desc("commits"), "author").limit(limit)
