"""Semantic diff and history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def entity_diff(base: DataFrame, head: DataFrame, key: list[str], value: str) -> DataFrame:
    """key, change (added, removed, modified), breaking: a full outer join on the key; removals break."""
    a, b = base.select(*key, F.col(value).alias("x"), F.lit(True).alias("in_a")), head.select(*key, F.col(value).alias("y"), F.lit(True).alias("in_b"))
    both = a.join(b, key, "full")
    change = F.when(F.col("in_a").isNull(), "added").when(F.col("in_b").isNull(), "removed").when(~F.col("x").eqNullSafe(F.col("y")), "modified")
    return both.select(*key, change.alias("change"), F.col("in_b").isNull().alias("breaking")).where("change is not null")


def diff_summary(changes: DataFrame) -> DataFrame:
    return changes.agg(*[F.count_if(F.col("change") == c).alias(c) for c in ("added", "removed", "modified")], F.count_if("breaking").alias("breaking"))


def contributors(commits: DataFrame, file: str = "file", author: str = "author") -> DataFrame:
    """file, contributors, commits, primary author (most commits, then the smallest name)."""
    each = commits.groupBy(file, author).agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy(file).agg(F.count(F.lit(1)).alias("contributors"), F.sum("n").alias("commits"), F.min(F.struct(-F.col("n"), author))[author].alias("primary_author"))


def cochange(commits: DataFrame, commit: str = "commit", file: str = "file") -> DataFrame:
    """file, other, together: in how many commits two files changed together. A commit's files are bounded by the commit."""
    pairs = commits.select(commit, file).distinct()
    other = pairs.select(commit, F.col(file).alias("other"))
    return pairs.join(other, commit).where(F.col(file) < F.col("other")).groupBy(file, "other").agg(F.count(F.lit(1)).alias("together"))
