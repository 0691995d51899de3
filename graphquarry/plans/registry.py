"""Named queries over the driver's tables, and the SQL that says the same.

The graph is derived from parts, suppliers and order lines; the SQL of its nodes and edges runs on Spark and in the oracle alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import diff, graph, rules, search, storage
from . import terse

_S = "cast({} as varchar(20))".format
_FN = lambda p: f"concat('fn:part/', {_S(f'{p}.p_partkey')}, ':', {p}.p_name)"
_CLS = lambda p: f"concat('cls:part/', {_S(f'{p}.p_partkey')}, ':', {p}.p_brand)"
NODES = f"""select concat('mod:supplier/', {_S('s_suppkey')}) as id, 'module' as type, s_name as name, concat('supplier/', {_S('s_suppkey')}) as file_path, 0 as complexity from supplier
union all select {_CLS('p')}, 'class', p_brand, concat('part/', {_S('p_partkey')}), 0 from part p
union all select {_FN('p')}, 'function', p_name, concat('part/', {_S('p_partkey')}), p_size from part p
union all select distinct concat('ext:', p_type), 'external', p_type, cast(null as varchar(20)), 0 from part"""
_NEXT = "select a.l_suppkey as s1, b.l_suppkey as s2, a.l_partkey as p1, b.l_partkey as p2 from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and b.l_linenumber = a.l_linenumber + 1"
EDGES = f"""select distinct source_id, target_id, type from (
select {_CLS('p')} as source_id, {_FN('p')} as target_id, 'contains' as type from part p
union all select {_CLS('p')}, concat('ext:', p_type), 'inherits' from part p
union all select concat('mod:supplier/', {_S('l_suppkey')}), {_CLS('p')}, 'contains' from lineitem join part p on l_partkey = p.p_partkey
union all select concat('mod:supplier/', {_S('s1')}), concat('mod:supplier/', {_S('s2')}), 'imports' from ({_NEXT}) n1 where s1 <> s2
union all select {_FN('x')}, {_FN('y')}, 'calls' from ({_NEXT}) n join part x on x.p_partkey = p1 join part y on y.p_partkey = p2 where p1 <> p2) q"""
_WITH = f"with recursive nodes as ({NODES}), edges as ({EDGES})"
_SEED = "mod:supplier/1"
COMMITS = "select distinct cast(user_id as varchar(20)) as author, cast(cast(ts as date) as varchar(10)) as commit, event_type as file from events"


def _views(spark: SparkSession, sf_dir: str, *tables: str) -> None:
    for t in tables:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)


def _edges(spark: SparkSession) -> DataFrame:
    """The rows of EDGES: pairs of keys are made distinct and then written out as ids, which say their keys, so that no long texts are
    shuffled and compared. Where a part's key, brand or name is null, ids don't say their keys, and EDGES is run as it is."""
    if not spark.table("part").where("p_partkey is null or p_brand is null or p_name is null").isEmpty():
        return spark.sql(EDGES)
    module, parts = lambda c: f"concat('mod:supplier/', {_S(c)})", lambda c: f"(select distinct p_partkey, {c} from part)"
    return spark.sql(f"""select distinct {_CLS('p')} as source_id, {_FN('p')} as target_id, 'contains' as type from part p
union all select distinct {_CLS('p')}, concat('ext:', p_type), 'inherits' from part p
union all select {module('s')}, {_CLS('p')}, 'contains' from (select distinct l_suppkey as s, l_partkey as k from lineitem) l join {parts('p_brand')} p on l.k = p.p_partkey
union all select {module('s1')}, {module('s2')}, 'imports' from (select distinct s1, s2 from ({_NEXT}) n where s1 <> s2) i
union all select {_FN('x')}, {_FN('y')}, 'calls' from (select distinct p1, p2 from ({_NEXT}) n where p1 <> p2) c join {parts('p_name')} x on x.p_partkey = p1 join {parts('p_name')} y on y.p_partkey = p2""")


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    _views(spark, sf_dir, "supplier", "part", "lineitem")
    return spark.sql(NODES), _edges(spark)


def _seed(spark):
    return spark.createDataFrame([(_SEED,)], "id string")


def _walk(types: str, step: str, most: int) -> str:
    """Oracle SQL of a depth-bounded walk from the seed."""
    a, b = ("source_id", "target_id") if step == "out" else ("target_id", "source_id")
    return f"{_WITH}, w as (select '{_SEED}' as id, 0 as depth union select e.{b}, w.depth + 1 from w join edges e on e.{a} = w.id where w.depth < {most} and {types}) select id, min(depth) as depth from w group by id having min(depth) > 0"


QUERIES, SQL = {}, {}


def named(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


@named(f"{_WITH} select id, type, name, file_path, complexity from nodes where type = 'function' and complexity > 10 order by complexity desc, id limit 25")
def terse_functions(spark, sf_dir):
    return terse.terse(_graph(spark, sf_dir)[0], "fn c>10 l25 o:-complexity")


@named(f"{_WITH} select id, name, complexity from nodes where type = 'function' and (complexity >= 45 or name like '%10%')")
def virtual_table_or(spark, sf_dir):
    terse.register(*_graph(spark, sf_dir))
    return terse.query(spark, "select id, name, complexity from functions f where complexity >= 45 or name like '%10%'")


@named(f"{_WITH} select type, count(*) as n from nodes where type in ('function', 'class') group by type")
def sql_shim(spark, sf_dir):
    terse.register(*_graph(spark, sf_dir))
    return terse.query(spark, "select type, count(*) as n from nodes where type = 'Function' or type = \"CLASS\" group by type")


@named(f"{_WITH} select type, count(*) as n from nodes group by type")
def type_counts(spark, sf_dir):
    return _graph(spark, sf_dir)[0].groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@named(f"{_WITH} select id, count(*) as degree from (select source_id as id from edges union all select target_id from edges) q group by id")
def degree(spark, sf_dir):
    return graph.degree(_graph(spark, sf_dir)[1])


@named(f"{_WITH} select target_id as id, count(*) as calls from edges where type = 'calls' group by target_id")
def call_counts(spark, sf_dir):
    return _graph(spark, sf_dir)[1].where("type = 'calls'").groupBy(F.col("target_id").alias("id")).agg(F.count(F.lit(1)).alias("calls"))


@named(_walk("e.type <> 'contains'", "out", 2))
def deps_depth2(spark, sf_dir):
    return graph.deps(_graph(spark, sf_dir)[1], _seed(spark), depth=2).select("id", "depth")


@named(_walk("e.type <> 'contains'", "in", 2))
def usedby_depth2(spark, sf_dir):
    return graph.deps(_graph(spark, sf_dir)[1], _seed(spark), reverse=True, depth=2).select("id", "depth")


@named(_walk("e.type = 'imports'", "in", 3))
def ancestors_depth3(spark, sf_dir):
    return graph.ancestors(_graph(spark, sf_dir)[1], _seed(spark), ["imports"], 3).select("id", "depth")


@named(f"{_WITH}, w as (select '{_SEED}' as id union select e.target_id from w join edges e on e.source_id = w.id) select id from w where id <> '{_SEED}'")
def impact_all(spark, sf_dir):
    return graph.impact(_graph(spark, sf_dir)[1], _seed(spark)).select("id")


@named(f"{_WITH}, w as (select '{_SEED}' as id, 0 as depth union select case when e.source_id = w.id then e.target_id else e.source_id end, w.depth + 1 from w join edges e on w.id in (e.source_id, e.target_id) where w.depth < 2 and e.type = 'imports') select id, min(depth) as depth from w group by id having min(depth) > 0")
def neighbors_both(spark, sf_dir):
    return graph.neighbors(_graph(spark, sf_dir)[1], _seed(spark), "both", 2, ["imports"]).select("id", "depth")


@named(f"{_WITH}, w as (select '{_SEED}' as id, 0 as depth union select e.target_id, w.depth + 1 from w join edges e on e.source_id = w.id where w.depth < 6 and e.type = 'imports') select cast(min(depth) as bigint) as edges from w where id = 'mod:supplier/7'")
def shortest_path_length(spark, sf_dir):
    path = graph.shortest_path(_graph(spark, sf_dir)[1], _SEED, "mod:supplier/7", ["imports"])
    return spark.createDataFrame([(len(path) - 1 if path else None,)], "edges long")


@named(f"{_WITH}, r as (select distinct source_id as a, target_id as b from edges where type = 'imports' union select r.a, e.target_id from r join edges e on e.source_id = r.b where e.type = 'imports'), m as (select x.a, x.b from r x join r y on x.a = y.b and x.b = y.a) select a as id, min(b) as component from m group by a having count(*) > 1")
def scc_members(spark, sf_dir):
    return graph.components(_graph(spark, sf_dir)[1], ["imports"])


@named(f"{_WITH} select target_id as id, count(distinct source_id) as n, case when count(distinct source_id) <= 5 then 'low' when count(distinct source_id) <= 15 then 'medium' when count(distinct source_id) <= 50 then 'high' else 'extreme' end as level from edges group by target_id")
def yolo_levels(spark, sf_dir):
    edges = _graph(spark, sf_dir)[1]
    return edges.groupBy(F.col("target_id").alias("id")).agg(F.countDistinct("source_id").alias("n")).withColumn("level", rules.impact_level(F.col("n")))


@named("with q as (select cast(embedding as double[]) as v from embeddings where vec_id = 0) select vec_id, round(list_cosine_similarity(cast(embedding as double[]), (select v from q)), 6) as similarity from embeddings where list_cosine_similarity(cast(embedding as double[]), (select v from q)) >= 0 order by similarity desc, vec_id limit 10")
def vector_topk(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    query = vectors.where("vec_id = 0").first()["embedding"]
    return search.vector_search(vectors, list(query), 10, key="vec_id").withColumn("similarity", F.round("similarity", 6))


@named(f"{_WITH} select id, name, complexity, round((2 * cast(lower(name) like '%brand%' as int) + cast(lower(id) like '%brand%' as int) + 2 * cast(lower(name) like '%12%' as int) + cast(lower(id) like '%12%' as int)) / 6.0, 6) as similarity from nodes where type <> 'external' and (lower(name) like '%brand%' or lower(id) like '%brand%' or lower(name) like '%12%' or lower(id) like '%12%') order by similarity desc, complexity desc, id limit 10")
def keyword_rank(spark, sf_dir):
    return search.keyword_rank(_graph(spark, sf_dir)[0], ["brand", "12"])


_COUNTED = {
    "fns": "type = 'function'", "classes": "type = 'class'", "modules": "type = 'module'", "snake": "type = 'function' and name like '%\\_%' escape '\\' and lower(name) = name", "pascal": "type = 'class' and regexp_matches(name, '^[A-Z]')",
    "service": "type = 'class' and name like '%Service'", "tests": "type = 'function' and lower(name) like '%test%'", "logs": "type = 'function' and lower(name) like '%log%'", "repository": "type = 'class' and (name like '%Repository' or name like '%Repo')",
    "factory": "type in ('class', 'function') and name like '%Factory%'", "handler": "type in ('class', 'function') and name like '%Handler%'", "errors": "type = 'class' and (name like '%Error' or name like '%Exception')",
    "rest": "type = 'function' and regexp_matches(name, '^(get|post|put|delete|create|update).')", "routes": "type = 'function' and regexp_matches(name, '._?(route|endpoint|view)$')", "asyncs": "type = 'function' and (regexp_matches(name, '^async.') or regexp_matches(name, '.async$'))",
}
# Names of a fixture in which every detector fires, in turn; LIKE patterns of the detectors have _ for any character.
_PARTS = ("UserRepository", "OrderRepo", "WidgetFactory", "makeHandler", "onHandler", "get_user", "post_item", "put_x", "a_route", "b_endpoint", "async_load", "load_async", "test_one", "log_it", "ParseError", "IoException", "PayService", "plain")
_FIXTURE = f"select case when p_partkey % 3 = 0 then 'class' when p_partkey % 3 = 1 then 'function' else 'module' end as type, list_value({', '.join(f"'{x}'" for x in _PARTS)})[p_partkey % {len(_PARTS)} + 1] as name, concat('src/', {_S('p_partkey % 50')}, case when p_partkey % 4 = 0 then '.test.py' else '.py' end) as file_path from part"
_ROWS = (("service_suffix", "service", "case when service >= 2 then 0.8 else 0.0 end"), ("modular", "modules", "case when modules >= 5 then round(least(modules / 20.0, 1.0), 6) else 0.0 end"), ("test_functions", "tests", "case when tests >= 3 then 0.95 else 0.0 end"), ("logging", "logs", "case when logs >= 1 then 0.85 else 0.0 end"), ("repository", "repository", "case when repository >= 1 then 0.9 else 0.0 end"), ("factory", "factory", "case when factory >= 1 then 0.85 else 0.0 end"), ("handler", "handler", "case when handler >= 2 then 0.8 else 0.0 end"), ("test_files", "files", "case when files >= 1 then 0.9 else 0.0 end"), ("custom_exceptions", "errors", "case when errors >= 2 then 0.9 else 0.0 end"), ("rest_naming", "rest", "case when rest >= 3 then 0.85 else 0.0 end"), ("route_handlers", "routes", "case when routes >= 2 then 0.9 else 0.0 end"), ("async_naming", "asyncs", "case when asyncs >= 2 then 0.8 else 0.0 end"), ("snake_case_functions", "snake", "round(snake / greatest(fns, 1.0), 6)"), ("pascal_case_classes", "pascal", "round(pascal / greatest(classes, 1.0), 6)"), ("minimal_imports", "imports", "case when imports / (modules + 0.0) < 5 then round(1 - imports / (modules + 0.0) / 10, 6) else 0.0 end"), ("heavy_imports", "imports", "case when imports / (modules + 0.0) > 15 then round(least(imports / (modules + 0.0) / 30, 1.0), 6) else 0.0 end"))


@named(f"with n as ({_FIXTURE}), c as (select {', '.join(f'count(*) filter ({x}) as {k}' for k, x in _COUNTED.items())}, count(distinct file_path) filter (file_path like '%test%' or file_path like '%spec%') as files, (select count(*) from supplier) as imports from n) " + " union all ".join(f"select '{name}' as pattern, {n} as hits, cast({sure} as double) as confidence from c" for name, n, sure in _ROWS))
def detected_patterns(spark, sf_dir):
    _views(spark, sf_dir, "part")
    name = F.element_at(F.array(*map(F.lit, _PARTS)), (F.col("p_partkey") % len(_PARTS) + 1).cast("int"))
    kind = F.when(F.col("p_partkey") % 3 == 0, "class").when(F.col("p_partkey") % 3 == 1, "function").otherwise("module")
    path = F.concat(F.lit("src/"), F.col("p_partkey") % 50, F.when(F.col("p_partkey") % 4 == 0, ".test.py").otherwise(".py"))
    nodes = spark.table("part").select(kind.alias("type"), name.alias("name"), path.alias("file_path"))
    imports = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.lit("imports").alias("type"))
    return rules.patterns(nodes, imports)


@named(f"{_WITH}, d as (select id, count(*) as degree from (select source_id as id from edges union all select target_id from edges) q group by id) select id, round(least(complexity / 10.0, 5.0) + least(coalesce(degree, 0) / 5.0, 5.0) + case type when 'class' then 2.0 when 'module' then 1.0 when 'function' then 0.5 else 0.0 end, 6) as score from nodes left join d using (id)")
def omega_scores(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    return rules.omega(nodes, graph.degree(edges))


@named("select o_custkey, o_orderkey from (select *, row_number() over (partition by o_custkey order by o_orderdate desc nulls last, o_orderkey desc) as rn from orders) q where rn = 1")
def keep_last(spark, sf_dir):
    return storage.keep_last(spark.read.parquet(f"{sf_dir}/orders.parquet"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


@named("select p_name as file_path, p_type as content_hash from part where not (p_partkey % 10 <> 3) or p_partkey % 10 = 5")
def stale_files(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    known = part.where("p_partkey % 10 <> 3").select(F.concat("p_name", F.lit("#"), "p_partkey").alias("file_path"), F.when(F.expr("p_partkey % 10 = 5"), "old").otherwise(F.col("p_type")).alias("content_hash"))
    current = part.select(F.concat("p_name", F.lit("#"), "p_partkey").alias("file_path"), F.col("p_type").alias("content_hash"))
    return storage.stale_files(current, known).withColumn("file_path", F.substring_index("file_path", "#", 1))


@named("select vec_id from embeddings where vec_id not in (select p_partkey from part where p_partkey % 3 = 0)")
def orphan_vectors(spark, sf_dir):
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("id"))
    return storage.orphans(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), parts, "vec_id").select("vec_id")


@named("with a as (select l_partkey, max(l_quantity) as q from lineitem where l_returnflag = 'R' group by 1), b as (select l_partkey, max(l_quantity) as q from lineitem where l_returnflag = 'A' group by 1) select l_partkey, case when a.q is null then 'added' when b.q is null then 'removed' else 'modified' end as change, b.q is null as breaking from a full join b using (l_partkey) where a.q is distinct from b.q")
def entity_diff(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    side = lambda f: lines.where(F.col("l_returnflag") == f).groupBy("l_partkey").agg(F.max("l_quantity").alias("q"))
    return diff.entity_diff(side("R"), side("A"), ["l_partkey"], "q")


@named(f"with c as ({COMMITS}), e as (select file, author, count(*) as n from c group by 1, 2), r as (select *, row_number() over (partition by file order by n desc, author) as rn from e) select file, count(*) as contributors, cast(sum(n) as bigint) as commits, max(case when rn = 1 then author end) as primary_author from r group by file")
def contributors(spark, sf_dir):
    _views(spark, sf_dir, "events")
    return diff.contributors(spark.sql(COMMITS))


@named(f"with c as (select distinct commit, file from ({COMMITS}) q) select a.file, b.file as other, count(*) as together from c a join c b using (commit) where a.file < b.file group by 1, 2")
def cochange(spark, sf_dir):
    _views(spark, sf_dir, "events")
    return diff.cochange(spark.sql(COMMITS))


_COUNT = lambda k: f"cast((length(text) - length(replace(text, '{k}', ''))) // {len(k)} as int)"


@named("select doc_id, cast(1 + " + " + ".join(map(_COUNT, text.KEYWORDS + text.OPERATORS)) + " as int) as complexity from documents")
def text_complexity(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", text.complexity(F.col("text")).alias("complexity"))


@named("select doc_id, cast(len(list_distinct(regexp_extract_all(coalesce(text, ''), '\\b([A-Z][a-zA-Z0-9_]*)\\b', 1))) as int) as n_types from documents")
def type_references(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", F.size(text.type_references(F.coalesce("text", F.lit("")))).alias("n_types"))


_FOUND = " + ".join("len(regexp_extract_all(coalesce(text, ''), '" + p.replace("'", "''") + "'))" for _, p in text.SECRETS)


@named(f"select doc_id, cast({_FOUND} as int) as n_secrets from documents")
def secrets(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", F.size(text.find_secrets("text")).alias("n_secrets"))


_CASES = "case when regexp_matches(name, '^__[a-z0-9_]+__$') then 'dunder' when regexp_matches(name, '^[A-Z][A-Z0-9]*(_[A-Z0-9]+)+$') then 'screaming' when regexp_matches(name, '^_*[a-z0-9]+(_[a-z0-9]+)*_?$') then 'snake' when regexp_matches(name, '^[a-z]+[a-zA-Z0-9]*$') then 'camel' when regexp_matches(name, '^[A-Z][a-zA-Z0-9]*$') then 'pascal' when regexp_matches(name, '^[a-z0-9]+(-[a-z0-9]+)+$') then 'kebab' else 'other' end"


@named(f"{_WITH} select id, {_CASES} as convention from nodes")
def naming(spark, sf_dir):
    return _graph(spark, sf_dir)[0].select("id", text.naming(F.col("name")).alias("convention"))


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)


from . import source_queries  # noqa: E402, F401  registers its queries
