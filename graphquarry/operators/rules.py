"""Rule analytics: risk of nodes, detected patterns, omega scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Words in a name or path that mark security code.
SECURITY = ("auth", "crypto", "password", "token", "secret", "key", "session", "credential")


def tested(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id of nodes with tests: a file of tests or specs points at them, or such a file's path holds their file's name.

    The second is a join by words of paths: a test's path holds test, Tests or Spec beside the stem, so the stem is looked for as a
    substring of the few test paths only, among pieces of them that begin and end where words do.
    """
    marked = F.col("file_path").contains("test") | F.col("file_path").contains("spec")
    direct = edges.join(nodes.where(marked).select(F.col("id").alias("source_id")), "source_id", "left_semi").select(F.col("target_id").alias("id"))
    stem = F.regexp_replace(F.regexp_extract("file_path", r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    stems = nodes.where("file_path is not null").select("id", stem.alias("stem")).where("stem <> ''")
    paths = nodes.where(F.col("file_path").rlike("test|Tests|Spec")).select("file_path").distinct()
    starts, length = F.sequence(F.lit(1), F.length("file_path")), F.lit(64)
    pieces = paths.select("file_path", F.explode(starts).alias("at")).select("file_path", "at", F.explode(F.sequence(F.lit(1), F.least(length, F.length("file_path") - F.col("at") + 1))).alias("n"))
    pieces = pieces.select(F.col("file_path").substr(F.col("at"), F.col("n")).alias("stem"), F.col("file_path").substr(F.lit(1), F.col("at") - 1).alias("before"), F.col("file_path").substr(F.col("at") + F.col("n"), F.lit(10_000)).alias("after"))
    wanted = pieces.join(stems.select("stem").distinct(), "stem", "left_semi").where("before like '%test%' or after like '%test%' or after like 'Tests%' or after like 'Spec%'").select("stem").distinct()
    # A stem of over 64 characters isn't among the pieces.
    long = stems.where("length(stem) > 64")
    named = stems.join(wanted, "stem", "left_semi").select("id")
    by_long = long.join(paths, F.col("file_path").contains(F.col("stem")) & F.col("file_path").rlike("test|Tests|Spec")).where(F.expr("file_path like concat('%test%', stem, '%') or file_path like concat('%', stem, '%test%') or file_path like concat('%', stem, 'Tests%') or file_path like concat('%', stem, 'Spec%')")).select("id")
    return direct.unionByName(named).unionByName(by_long).distinct()


def risk(nodes: DataFrame, edges: DataFrame, kind: str | None = "module", threshold: int = 1) -> DataFrame:
    """id, file_path, dependents, risk (at most 10), warnings (level, category, message) of the nodes of a kind (None: all).

    Points for dependents, complexity, security words in name or path (more without tests), and dependents without tests. Warnings below
    ``threshold`` (1 info, 2 warn, 3 error) are left out, their points stay.
    """
    count = edges.groupBy(F.col("target_id").alias("id")).agg(F.countDistinct("source_id").alias("dependents"))
    rows = nodes.where(F.col("type") == kind) if kind else nodes
    rows = rows.join(count, "id", "left").withColumn("dependents", F.coalesce("dependents", F.lit(0)))
    rows = rows.join(tested(nodes, edges).withColumn("tested", F.lit(True)), "id", "left").withColumn("tested", F.coalesce("tested", F.lit(False)))
    secure = F.lit(False)
    for w in SECURITY:
        secure = secure | F.lower("name").contains(w) | F.coalesce(F.lower("file_path").contains(w), F.lit(False))
    n, c = F.col("dependents"), F.coalesce("complexity", F.lit(0))
    depend, cyclomatic = F.concat(n, F.lit(" files/modules depend on this code")), lambda how: F.concat(F.lit("Cyclomatic complexity is "), c, F.lit(f" ({how})"))
    checks = (
        (n > 20, 3, 3, "high impact", depend), ((n > 10) & (n <= 20), 2, 2, "high impact", depend), ((n > 5) & (n <= 10), 1, 1, "impact", depend),
        (c > 15, 3, 3, "complexity", cyclomatic("very high")), ((c > 10) & (c <= 15), 2, 2, "complexity", cyclomatic("high")),
        (secure & F.col("tested"), 1, 1, "security", F.lit("Security-sensitive code (auth/crypto) with test coverage")), (secure & ~F.col("tested"), 4, 3, "security sensitive", F.lit("Security-sensitive code WITHOUT test coverage")),
        (~F.col("tested") & (n > 0), 2, 2, "no tests", F.lit("No test coverage detected for this code")),
    )
    score = sum((F.when(cond, points).otherwise(0) for cond, points, _, _, _ in checks), F.lit(0))
    warnings = F.array_compact(F.array(*[F.when(cond, F.struct(F.lit(level).alias("level"), F.lit(category).alias("category"), message.alias("message"))) for cond, _, level, category, message in checks if level >= threshold]))
    return rows.select("id", "file_path", "dependents", F.least(score, F.lit(10)).alias("risk"), warnings.alias("warnings"))


def most_risky(nodes: DataFrame, edges: DataFrame, scanned: int = 1000, limit: int = 20, threshold: int = 1) -> DataFrame:
    """The modules of most risk among the first ``scanned`` by path that aren't tests, specs or mocks."""
    modules = nodes.where("type = 'module' and file_path is not null and file_path not like '%test%' and file_path not like '%spec%' and file_path not like '%mock%'").orderBy("file_path", "id").limit(scanned)
    found = risk(nodes, edges, "module", threshold).join(modules.select("id"), "id", "left_semi").where("risk > 0")
    return found.orderBy(F.desc("risk"), "file_path", "id").limit(limit)


def impact_level(count):
    return F.when(count <= 5, "low").when(count <= 15, "medium").when(count <= 50, "high").otherwise("extreme")


def patterns(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """pattern, hits, confidence (0 below a detector's threshold): one aggregation of the nodes, one of the imports edges."""
    fn, cls, mod = (F.col("type") == k for k in ("function", "class", "module"))
    low = F.lower("name")

    def like(column: str, *forms: str):
        found = F.lit(False)
        for form in forms:
            found = found | F.col(column).like(form)
        return found

    one = nodes.agg(
        F.count_if(fn).alias("fns"), F.count_if(cls).alias("classes"), F.count_if(mod).alias("modules"),
        F.count_if(fn & F.col("name").contains("_") & (low == F.col("name"))).alias("snake"), F.count_if(cls & F.col("name").rlike("^[A-Z]")).alias("pascal"),
        F.count_if(cls & F.col("name").endswith("Service")).alias("service"), F.count_if(low.contains("test") & fn).alias("tests"), F.count_if(low.contains("log") & fn).alias("logs"),
        F.count_if(cls & like("name", "%Repository", "%Repo")).alias("repository"), F.count_if((cls | fn) & like("name", "%Factory%")).alias("factory"), F.count_if((cls | fn) & like("name", "%Handler%")).alias("handler"),
        F.countDistinct(F.when(like("file_path", "%test%", "%spec%"), F.col("file_path"))).alias("test_files"), F.count_if(cls & like("name", "%Error", "%Exception")).alias("errors"),
        F.count_if(fn & like("name", "get_%", "post_%", "put_%", "delete_%", "create_%", "update_%")).alias("rest"), F.count_if(fn & like("name", "%_route", "%_endpoint", "%_view")).alias("routes"),
        F.count_if(fn & like("name", "async_%", "%_async")).alias("asyncs"),
    ).crossJoin(edges.agg(F.count_if(F.col("type") == "imports").alias("imports")))
    average = F.col("imports") / F.greatest("modules", F.lit(1))
    some = (F.col("modules") > 0) & (F.col("imports") > 0)
    # Name, count, least count, confidence.
    fixed = (("repository", "repository", 1, 0.9), ("factory", "factory", 1, 0.85), ("handler", "handler", 2, 0.8), ("test_files", "test_files", 1, 0.9), ("custom_exceptions", "errors", 2, 0.9), ("rest_naming", "rest", 3, 0.85), ("route_handlers", "routes", 2, 0.9), ("async_naming", "asyncs", 2, 0.8))
    rows = F.array(
        F.struct(F.lit("snake_case_functions").alias("pattern"), F.col("snake").alias("hits"), F.round(F.col("snake") / F.greatest("fns", F.lit(1)), 6).alias("confidence")),
        F.struct(F.lit("pascal_case_classes").alias("pattern"), F.col("pascal").alias("hits"), F.round(F.col("pascal") / F.greatest("classes", F.lit(1)), 6).alias("confidence")),
        F.struct(F.lit("service_suffix").alias("pattern"), F.col("service").alias("hits"), F.when(F.col("service") >= 2, 0.8).otherwise(0.0).alias("confidence")),
        F.struct(F.lit("modular").alias("pattern"), F.col("modules").alias("hits"), F.when(F.col("modules") >= 5, F.round(F.least(F.col("modules") / 20, F.lit(1.0)), 6)).otherwise(0.0).alias("confidence")),
        F.struct(F.lit("test_functions").alias("pattern"), F.col("tests").alias("hits"), F.when(F.col("tests") >= 3, 0.95).otherwise(0.0).alias("confidence")),
        F.struct(F.lit("logging").alias("pattern"), F.col("logs").alias("hits"), F.when(F.col("logs") >= 1, 0.85).otherwise(0.0).alias("confidence")),
        *[F.struct(F.lit(name).alias("pattern"), F.col(n).alias("hits"), F.when(F.col(n) >= least, sure).otherwise(0.0).alias("confidence")) for name, n, least, sure in fixed],
        F.struct(F.lit("minimal_imports").alias("pattern"), F.col("imports").alias("hits"), F.when(some & (average < 5), F.round(1 - average / 10, 6)).otherwise(0.0).alias("confidence")),
        F.struct(F.lit("heavy_imports").alias("pattern"), F.col("imports").alias("hits"), F.when(some & (average > 15), F.round(F.least(average / 30, F.lit(1.0)), 6)).otherwise(0.0).alias("confidence")),
    )
    return one.select(F.inline(rows))


def omega(nodes: DataFrame, degrees: DataFrame) -> DataFrame:
    """id, score: complexity / 10 and degree / 5, each up to 5, and a bonus by type."""
    rows = nodes.join(degrees, "id", "left")
    bonus = F.when(F.col("type") == "class", 2.0).when(F.col("type") == "module", 1.0).when(F.col("type") == "function", 0.5).otherwise(0.0)
    score = F.least(F.coalesce("complexity", F.lit(0)) / 10, F.lit(5.0)) + F.least(F.coalesce("degree", F.lit(0)) / 5, F.lit(5.0)) + bonus
    return rows.select("id", F.round(score - F.when(F.coalesce("name", F.lit("")) == "", 10.0).otherwise(0.0), 6).alias("score"))
