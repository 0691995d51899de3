"""Overviews of a code base: domain entities, hot paths, clusters, state flows, integrations, and the compressed S-expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import graph, rules

# Parts of names and paths of classes that are infrastructure.
INFRA_NAMES = ("test", "spec", "mock", "fake", "stub", "base", "abstract", "context", "dbcontext", "connection", "session", "middleware", "filter", "handler", "interceptor", "extension", "helper", "util", "utils", "config", "configuration", "settings", "options", "validator", "serializer", "mapper", "converter", "factory", "builder", "provider", "dto", "request", "response", "viewmodel", "exception", "error", "migration", "seed", "schema", "startup", "program", "host", "controller", "endpoint", "api", "repository", "service", "event", "publisher", "subscriber", "listener", "mixin", "trait", "protocol", "coordinator", "orchestrator", "manager")
INFRA_PATHS = ("/test", "/tests/", "/spec/", "/__tests__/", "_test.", "/migrations/", "/seeds/", "/fixtures/", "/config/", "/configuration/", "/middleware/", "/interceptors/", "/filters/", "/infrastructure/", "/framework/", "/bootstrap/", "/controllers/", "/endpoints/", "/api/", "/services/", "/repositories/", "/contracts/", "/responses/", "/requests/", "/dtos/", "/viewmodels/", "/shared/", "/common/", "/base/", "/events/", "/messaging/", "/pubsub/")
# Names of core, child, supporting and generic entities.
CORE = ("transaction", "payment", "order", "invoice", "customer", "user", "account", "merchant", "product", "subscription", "payout", "refund", "booking", "reservation", "shipment", "delivery", "cart", "checkout", "contract", "agreement", "claim", "policy", "ticket", "case", "ride", "trip", "driver", "vehicle", "passenger", "route", "message", "conversation", "chat", "employee", "company", "organization", "team", "riderequest", "ridebooking", "request", "notification", "rating")
CHILD = ("line", "item", "entry", "detail", "history", "log", "event", "assignment", "membership", "attachment", "note", "comment", "status", "state", "type")
SUPPORT = ("preference", "setting", "config", "token", "session", "cache", "job", "task", "queue", "import", "export", "sync", "audit", "template", "lookup", "reference", "code", "attempt")
GENERIC = ("item", "data", "record", "object", "entity", "model", "info", "result")
# What external modules integrate, and the stacks that they make.
INTEGRATIONS = (("stripe", "payments"), ("braintree", "payments"), ("paypal", "payments"), ("sendgrid", "email"), ("mailgun", "email"), ("rabbitmq", "messaging"), ("kafka", "messaging"), ("redis", "cache"), ("elasticsearch", "search"), ("auth0", "auth"), ("cognito", "auth"), ("s3", "storage"), ("datadog", "monitoring"), ("sentry", "monitoring"), ("twilio", "sms"))
STACKS = (("tokio", "Rust/Tokio"), ("actix", "Rust/Actix"), ("axum", "Rust/Axum"), ("django", "Python/Django"), ("flask", "Python/Flask"), ("fastapi", "Python/FastAPI"), ("express", "Node.js/Express"), ("spring", "Java/Spring"), ("aspnet", "C#/ASP.NET"), ("postgres", "PostgreSQL"), ("mysql", "MySQL"), ("mongodb", "MongoDB"), ("redis", "Redis"), ("kafka", "Kafka"))


def _any(text: Column, parts: tuple[str, ...], how: str = "contains") -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | getattr(text, how)(p)
    return out


def is_infrastructure(name: Column, path: Column) -> Column:
    low, place = F.lower(name), F.lower(path)
    named = (name.contains("Report") & name.endswith("Model")) | _any(low, INFRA_NAMES) | name.rlike(r"^I\p{Lu}")
    model = name.endswith("Model") & ~F.coalesce(place.contains("/entities/") | place.contains("/domain/"), F.lit(False))
    return named | model | F.coalesce(_any(place, INFRA_PATHS), F.lit(False))


def is_entity_path(path: Column) -> Column:
    low = F.lower(path)
    return F.coalesce(_any(low, ("/entities/", "/models/", "/aggregates/")) | (low.contains("/domain/") & ~low.contains("/domain/shared/")), F.lit(False))


def attributes(properties: Column) -> Column:
    """The attributes (or variants) that a node's properties list."""
    return F.coalesce(F.from_json(F.get_json_object(properties, "$.attributes"), "array<string>"), F.array().cast("array<string>"))


def foreign_keys(properties: Column) -> Column:
    return F.size(F.filter(attributes(properties), lambda a: F.lower(a).endswith("id")))


def relation(kind: Column, properties: Column, target: Column) -> Column:
    """What an edge says of two entities."""
    key = F.exists(attributes(properties), lambda a: F.lower(a).contains(F.lower(target)) & F.lower(a).endswith("id"))
    return F.when(kind == "inherits", "extends").when(kind == "contains", "has_many").when(kind.isin("calls", "uses"), F.when(key, "belongs_to").otherwise("uses")).otherwise(kind)


def related_counts(edges: DataFrame) -> DataFrame:
    """id, n_in, n_out: edges but for contains."""
    rows = edges.where("type <> 'contains'").select(F.explode(F.array(F.struct(F.col("source_id").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("target_id").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e"))
    return rows.groupBy("e.id").agg(F.sum("e.i").alias("n_in"), F.sum("e.o").alias("n_out"))


def entity_scores(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, name, score of classes: how likely they are a domain's entities."""
    classes = nodes.where("type = 'class'")
    low = F.lower("name")
    stateful = classes.where(low.endswith("status") | low.endswith("state")).select(F.lower(F.regexp_replace("name", r"(?:(?:Status|status)+|(?:State|state)+)\z", "")).alias("low")).where("low <> ''").distinct().withColumn("has_status", F.lit(20))
    rows = classes.withColumn("low", low).join(stateful, "low", "left").join(related_counts(edges), "id", "left").fillna(0, ["n_in", "n_out", "has_status"])
    path, if_ = F.coalesce(F.lower("file_path"), F.lit("")), lambda cond, points: F.when(cond, points).otherwise(0)
    score = 3 * F.col("n_in") + F.col("n_out") + 2 * foreign_keys(F.col("properties")) + F.floor(F.size(attributes(F.col("properties"))) / 2)
    score = score + if_(is_infrastructure(F.col("name"), F.col("file_path")), -100) + if_(F.col("low").isin(*CORE), 25) + F.col("has_status")
    score = score + if_(_any(F.col("low"), CHILD, "endswith"), -15) + if_(_any(F.col("low"), SUPPORT), -10) + if_(F.col("low").isin(*GENERIC), -15)
    score = score + if_(_any(path, ("/entities/", "/aggregates/")), 30) + if_(path.contains("/models/"), 20) + if_(path.contains("/domain/") & ~path.contains("/domain/shared/"), 15)
    score = score + if_(_any(path, ("/contracts/", "/responses/", "/requests/", "/dtos/", "/viewmodels/")), -25) + if_(path.contains("/core/") & is_entity_path(F.col("file_path")), 15)
    return rows.select("id", "name", "file_path", score.cast("long").alias("score"))


def entities(nodes: DataFrame, edges: DataFrame, limit: int = 8) -> DataFrame:
    """id, name, score, stars of the best classes of positive score that are no infrastructure, one of each name whatever its case."""
    found = entity_scores(nodes, edges).where(~is_infrastructure(F.col("name"), F.col("file_path"))).where("score > 0")
    one = found.groupBy(F.lower("name").alias("low")).agg(F.min(F.struct(-F.col("score"), "id", "name")).alias("b"))
    best = one.select(F.col("b.id").alias("id"), F.col("b.name").alias("name"), (-F.col("b.col1")).alias("score")).orderBy(F.desc("score"), "id").limit(limit)
    top = best.agg(F.max("score").alias("top"))
    return best.join(F.broadcast(top)).select("id", "name", "score", F.greatest(F.lit(1), F.least(F.lit(3), F.ceil(F.col("score") / F.col("top") * 3))).cast("int").alias("stars"))


def hot_paths(nodes: DataFrame, edges: DataFrame, limit: int = 20) -> DataFrame:
    """id, name, complexity, calls, heat: functions by complexity and twice their calls."""
    calls = edges.where("type = 'calls'").groupBy(F.col("target_id").alias("id")).agg(F.count(F.lit(1)).alias("calls"))
    rows = nodes.where("type = 'function'").join(calls, "id", "left").fillna(0, ["calls", "complexity"]).withColumn("heat", F.col("complexity") + 2 * F.col("calls"))
    return rows.orderBy(F.desc("heat"), "id").limit(limit).select("id", "name", "complexity", "calls", "heat")


def clusters(nodes: DataFrame, edges: DataFrame, limit: int = 10, each: int = 10) -> DataFrame:
    """id, name, n, outgoing, incoming (name and type of at most ``each``) of the classes with most relations."""
    best = nodes.where("type = 'class'").select("id", "name").join(related_counts(edges), "id").select("id", "name", (F.col("n_in") + F.col("n_out")).alias("n")).orderBy(F.desc("n"), "id").limit(limit)
    names = nodes.select(F.col("id").alias("other"), F.col("name").alias("to"))
    out = best
    for column, a, b in (("outgoing", "source_id", "target_id"), ("incoming", "target_id", "source_id")):
        rel = edges.where("type <> 'contains'").select(F.col(a).alias("id"), F.col(b).alias("other"), "type").join(F.broadcast(best.select("id")), "id", "left_semi").join(names, "other")
        first = rel.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("to", "type", "other"))).where(F.col("rank") <= each)
        out = out.join(first.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("to", "type"))).alias(column)), "id", "left")
    return out


def flows(nodes: DataFrame) -> DataFrame:
    """name, states of classes that list the states of something: named after a status, state, phase or stage, with two values at least."""
    values = F.filter(F.coalesce(F.from_json(F.get_json_object("properties", "$.variants"), "array<string>"), attributes(F.col("properties"))), lambda v: ~v.startswith("_"))
    found = nodes.where(F.col("type") == "class").where(_any(F.lower("name"), ("status", "state", "phase", "stage"), "endswith"))
    return found.select("id", F.regexp_replace("name", r"(?:Status)*(?:State)*(?:Phase)*(?:Stage)*\z", "").alias("name"), values.alias("states")).where(F.size("states") >= 2)


def _matched(nodes: DataFrame, table: tuple[tuple[str, str], ...]) -> DataFrame:
    outside = nodes.where("type = 'external'").select(F.lower("name").alias("low"))
    rows = F.array(*[F.when(F.col("low").contains(p), F.struct(F.lit(i).alias("rank"), F.lit(p).alias("pattern"), F.lit(v).alias("is"))) for i, (p, v) in enumerate(table)])
    return outside.select(F.explode(F.array_compact(rows)).alias("m")).select("m.*").distinct()


def integrations(nodes: DataFrame) -> DataFrame:
    return _matched(nodes, INTEGRATIONS).orderBy("rank").select("pattern", F.col("is").alias("category"))


def tech_stack(nodes: DataFrame, limit: int = 5) -> DataFrame:
    return _matched(nodes, STACKS).orderBy("rank").limit(limit).select(F.col("is").alias("technology"))


def domain_name(found: DataFrame, root: str = "") -> DataFrame:
    """One row, domain: the first word that two of five entities' names begin with, as a system; else the root's name."""
    prefix = F.regexp_extract("name", r"^(...[^\p{Lu}]*|..[^\p{Lu}]+)(?=\p{Lu})", 1)
    vote = found.orderBy(F.desc("score"), "id").limit(5).select(prefix.alias("p")).where(F.length("p") >= 3).groupBy("p").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    title = " ".join(w[:1].upper() + w[1:] for w in root.rstrip("/").rsplit("/", 1)[-1].replace("-", " ").replace("_", " ").split())
    best = vote.agg(F.max(F.struct("n", "p")).alias("b"))
    return best.select(F.coalesce(F.concat(F.col("b.p"), F.lit(" System")), F.lit(title or None)).alias("domain"))


def folder_tree(nodes: DataFrame) -> DataFrame:
    """folder, parent, modules, classes, functions of every folder and what is right in it."""
    folder = F.regexp_extract("file_path", r"^(.*)/[^/]*$", 1)
    own = nodes.where("file_path is not null").groupBy(folder.alias("folder")).agg(*[F.count_if(F.col("type") == k).alias(c) for k, c in (("module", "modules"), ("class", "classes"), ("function", "functions"))])
    parts = F.split("folder", "/")
    above = own.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("folder")).distinct()
    every = above.unionByName(own.select("folder")).distinct().join(own, "folder", "left").fillna(0)
    return every.select("folder", F.when(F.col("folder") == "", None).otherwise(F.regexp_extract("folder", r"^(.*)/[^/]*$", 1)).alias("parent"), "modules", "classes", "functions")


# --- S-expressions -------------------------------------------------------------------------------------------------------


def selected_nodes(nodes: DataFrame, edges: DataFrame, tokens: int = 2000, each: int = 50) -> DataFrame:
    """The nodes of highest score that fit two thirds of a budget of tokens (15 a node), at most ``each`` of a type."""
    scored = rules.omega(nodes, graph.degree(edges)).join(nodes.select("id", "type", "name", "file_path", "complexity"), "id")
    ranked = scored.orderBy(F.desc("score"), "id").limit(max(0, (tokens - 100) * 2 // 3 // 15))
    return ranked.withColumn("rank", F.row_number().over(Window.partitionBy("type").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= each)


def selected_edges(chosen: DataFrame, edges: DataFrame, tokens: int = 2000) -> DataFrame:
    """Edges that touch the chosen nodes, up to a 30th of the budget: others first, contains edges where room is left."""
    ids = F.broadcast(chosen.select("id"))
    touching = edges.join(ids, edges.source_id == ids.id, "left_semi").unionByName(edges.join(ids, edges.target_id == ids.id, "left_semi")).dropDuplicates(["source_id", "target_id", "type"])
    return touching.orderBy(F.col("type") == "contains", "source_id", "type", "target_id").limit(max(0, tokens // 30))


def s_expressions(nodes: DataFrame, edges: DataFrame, tokens: int = 2000) -> DataFrame:
    """part, ord, line: the chosen nodes by type and the chosen edges as S-expressions."""
    chosen = selected_nodes(nodes, edges, tokens)
    head = {"module": "mod", "class": "cls", "function": "fn", "external": "ext"}
    tag = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in head.items() for x in kv]), "type"), F.col("type"))
    quoted = lambda c: F.concat(F.lit('"'), F.regexp_replace(c, r'(["\\])', r"\\$1"), F.lit('"'))
    more = F.concat(F.when(F.coalesce("complexity", F.lit(0)) > 0, F.concat(F.lit(" :c "), F.col("complexity").cast("string"))).otherwise(""), F.when(F.col("file_path").isNotNull(), F.concat(F.lit(" :path "), quoted("file_path"))).otherwise(""))
    a = chosen.select(F.col("type").alias("part"), F.lpad(F.col("rank").cast("string"), 8, "0").alias("ord"), F.concat(F.lit("("), tag, F.lit(" "), quoted("name"), more, F.lit(")")).alias("line"))
    b = selected_edges(chosen, edges, tokens).select(F.lit("~edges").alias("part"), F.concat_ws("|", "source_id", "type", "target_id").alias("ord"), F.concat(F.lit("("), "type", F.lit(" "), quoted("source_id"), F.lit(" "), quoted("target_id"), F.lit(")")).alias("line"))
    return a.unionByName(b).orderBy("part", "ord")
