"""Whole batches: the row pipeline, identifier enrichment, curation and configuration as tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ferrolith.operators import curation, enrichment, settings
from ferrolith.plans.records import records_of
from ferrolith.plans.row_pipeline import run_batch
from ferrolith.queries import query, table
from ferrolith.sources.resources import closed_errors


def _results(d):
    """Answers of three extractors about ``documents``: names, an identifier, and terms of use with keywords; every seventh resource has none."""
    k = F.col("doc_id")
    kind = "array<struct<key:string,value:string>>"
    one = lambda key, value: F.struct(key.alias("key"), value.alias("value"))
    row = lambda n, field, shape, value, items, error=None: F.struct(
        F.lit(n).alias("ord"), F.lit(f"c{n}").alias("call"), F.lit(field).alias("field"), F.lit(shape).alias("kind"), (F.lit(None) if value is None else value).cast("string").alias("value"),
        (F.lit(None) if items is None else items).cast(kind).alias("items"), (F.lit(None) if error is None else error).cast("string").alias("error"),
    )
    identifier = F.when(k % 3 != 0, F.array(one(F.lit("scheme"), F.lit("DOI")), one(F.lit("value"), F.concat(F.lit("10.5555/b."), k.cast("string"))))).otherwise(F.array(one(F.lit("scheme"), F.lit(""))))
    rows = F.array(
        row(0, "name", "scalar", F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("Data of "), "source")), None),
        row(1, "identifier", "dict", None, identifier),
        row(2, "license", "list", None, F.when(k % 2 == 0, F.array(one(F.lit(None).cast("string"), F.concat(F.lit("Terms of "), "source")))).otherwise(F.array())),
        row(3, "keywords", "list", None, F.array(one(F.lit(None).cast("string"), F.col("source")))),
        row(4, "description", "scalar", None, None, F.when(k % 6 == 0, F.concat(F.lit("timeout "), "source"))),
    )
    return d.where(k % 7 != 0).select(k.alias("resource"), F.explode(rows).alias("r")).select("resource", "r.*")


@query("orc_03_row_pipeline", """with d as (select doc_id, source, doc_id % 10 = 0 as unread, doc_id % 7 = 0 as nothing, doc_id % 6 = 0 as late, doc_id % 4 = 1 and doc_id % 3 <> 0 as known from documents where source is not null)
select doc_id as resource, case when unread or nothing then 'failed' when late then 'partial' else 'ok' end as status,
  case when unread then 'not read: not JSON' when nothing then 'no fields' when late then 'timeout ' || source end as error,
  case when unread or nothing then null when doc_id % 5 <> 0 then 'Data of ' || source when known then 'Work ' || doc_id else '' end as name,
  case when unread or nothing then null when length(source) = 4 then 'r-' || source else '' end as publisher_id,
  case when unread or nothing then null else (doc_id % 3 = 0)::int + (doc_id % 2 = 1)::int + (doc_id % 5 = 0 and not known)::int end as n_violations,
  case when unread or nothing then null else (doc_id % 3 = 0)::int + (doc_id % 2 = 1)::int + (doc_id % 5 = 0 and not known)::int end as n_missing from d""")
def orc_03(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where(F.col("source").isNotNull()).select("doc_id", "source")
    k, office = F.col("doc_id"), F.concat(F.lit("Office of "), "source")
    resources = d.select(k.alias("resource"), F.concat(F.lit("https://data.example.org/"), k.cast("string")).alias("url"), office.alias("publisher"), F.when(k % 10 == 0, "not JSON").alias("error"))
    works = d.where(k % 4 == 1).select(F.concat(F.lit("10.5555/B."), k.cast("string")).alias("doi"), F.concat(F.lit("Work "), k.cast("string")).alias("title"), F.array().cast("array<string>").alias("authors"), F.lit("").alias("publisher"), F.lit("2020").alias("issued"))
    names = d.select("source", office.alias("name")).distinct()
    organisations = names.select("name", F.lit("ROR").alias("scheme"), F.concat(F.lit("r-"), "source").alias("value"), F.when(F.length("source") == 4, "auto").otherwise("review").alias("status"))
    people = spark.createDataFrame([], "given string, family string, value string, status string")
    out = run_batch(resources, _results(d), works, organisations, people, "2026-01-01")
    return out.select("resource", "status", "error", "name", F.col("publisher.id_value").alias("publisher_id"), F.size("violations").alias("n_violations"), F.size("missing").alias("n_missing"))


@query("join_08_enrich", """with d as (select doc_id, coalesce(source, '') as s, coalesce(lang, '') as l from documents where source is not null and lang is not null)
select doc_id, case when doc_id % 6 = 0 then '' else (case when doc_id % 2 = 0 then '0000-0002-1825-0097' when length(s) = 4 then 'o-' || s else '' end)
    || case when doc_id % 4 = 1 then ',' || (case when l in ('de', 'en') then 'r-' || l else '' end) else '' end end as creator_ids,
  case when doc_id % 9 = 0 then null else 'p-' || s end as publisher_id from d""")
def join_08(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where(F.col("source").isNotNull() & F.col("lang").isNotNull())
    given = F.transform("creator", lambda a: F.when(a["kind"] == "Person", a.withField("given", F.lit("Ann")).withField("family", F.substring(a["name"], 5, 100))).otherwise(a))
    records = records_of(d).withColumn("creator", given)
    langs, sources = d.select("lang").distinct(), d.select("source").distinct()
    offices = langs.select(F.concat(F.lit("Office "), "lang").alias("name"), F.concat(F.lit("r-"), "lang").alias("value"), F.when(F.col("lang").isin("de", "en"), "auto").otherwise("review").alias("status"))
    publishers = sources.select(F.concat(F.lit("Data Office "), "source").alias("name"), F.concat(F.lit("p-"), "source").alias("value"), F.lit("auto").alias("status"))
    organisations = offices.unionByName(publishers).withColumn("scheme", F.lit("ROR"))
    people = sources.select(F.lit("Ann").alias("given"), F.col("source").alias("family"), F.concat(F.lit("o-"), "source").alias("value"), F.when(F.length("source") == 4, "auto").otherwise("review").alias("status"))
    out = enrichment.enrich(records, organisations, people)
    return out.select("doc_id", F.array_join(F.transform("creator", lambda a: a["id_value"]), ",").alias("creator_ids"), F.col("publisher.id_value").alias("publisher_id"))


@query("src_16_overrides", """with e as (select s_suppkey, 'Office ' || s_nationkey as name, case s_suppkey % 3 when 0 then ' cl ' when 1 then 'CL' else '' end as country, case when s_suppkey % 2 = 0 then 'r' || s_suppkey end as ror_id, case when s_suppkey % 5 = 0 then 'i' || s_suppkey else '' end as isni_id from supplier),
v as (select lower(name) as name_key, nullif(upper(trim(country)), '') as country, name, ror_id, nullif(isni_id, '') as isni_id, s_suppkey from e where ror_id is not null or isni_id <> ''),
r as (select *, row_number() over (partition by name_key, country order by s_suppkey desc) as n from v) select name_key, country, name, ror_id, isni_id from r where n = 1""")
def src_16(spark, sf_dir):
    k = F.col("s_suppkey")
    entries = table(spark, sf_dir, "supplier").select(
        k, F.concat(F.lit("Office "), F.col("s_nationkey").cast("string")).alias("name"), F.when(k % 3 == 0, " cl ").when(k % 3 == 1, "CL").otherwise("").alias("country"),
        F.when(k % 2 == 0, F.concat(F.lit("r"), k.cast("string"))).alias("ror_id"), F.when(k % 5 == 0, F.concat(F.lit("i"), k.cast("string"))).otherwise("").alias("isni_id"),
    )
    return curation.load_overrides(entries, "s_suppkey")


@query("agg_18_curation", """select count(*) filter (where s_suppkey % 3 = 0 and s_suppkey % 4 <> 0) as confident, count(*) filter (where s_suppkey % 3 = 1 and s_suppkey % 4 <> 0) as review, count(*) filter (where s_suppkey % 3 = 2 and s_suppkey % 4 <> 0) as nothing from supplier""")
def agg_18(spark, sf_dir):
    """Suppliers as organisations; every fourth has a registry identifier already."""
    k = F.col("s_suppkey")
    have = F.when(k % 4 == 0, F.array(F.struct(F.lit("ROR").alias("scheme"), F.lit("r").alias("value")))).otherwise(F.array(F.struct(F.lit("ISNI").alias("scheme"), F.lit("i").alias("value"))))
    entries = table(spark, sf_dir, "supplier").where(curation.needs_curation(have))
    return curation.curation_counts(entries.select(F.when(k % 3 == 0, F.col("s_name")).alias("ror_candidate"), F.when(k % 3 == 1, F.array("s_name")).otherwise(F.array().cast("array<string>")).alias("ror_alternatives")))


def _agents(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    return s.select(F.col("s_name").alias("agent"), F.concat(F.lit("p"), F.col("s_nationkey").cast("string")).alias("provider"), F.concat(F.lit("m"), (F.col("s_suppkey") % 3).cast("string")).alias("model"))


def _providers(spark, sf_dir):
    return table(spark, sf_dir, "nation").select(F.concat(F.lit("p"), F.col("n_nationkey").cast("string")).alias("provider"), F.when(F.col("n_nationkey") % 5 != 0, F.concat(F.lit("KEY_"), F.col("n_nationkey").cast("string"))).alias("env"))


@query("agg_20_used_by", """select 'p' || n_nationkey as provider, coalesce(string_agg(s_name, ',' order by s_name), '') as agents from nation left join supplier on s_nationkey = n_nationkey group by 1""")
def agg_20(spark, sf_dir):
    return settings.used_by(_agents(spark, sf_dir), _providers(spark, sf_dir)).select("provider", F.concat_ws(",", "agents").alias("agents"))


@query("val_18_missing_keys", """select 'p' || n_nationkey as provider, 'KEY_' || n_nationkey as env, string_agg(s_name, ',' order by s_name) as agents from nation join supplier on s_nationkey = n_nationkey where n_nationkey % 5 <> 0 and n_nationkey % 3 <> 0 group by 1, 2""")
def val_18(spark, sf_dir):
    """Every third key is set, every second of the others empty."""
    n = F.col("n_nationkey")
    environment = table(spark, sf_dir, "nation").where((n % 3 == 0) | (n % 2 == 0)).select(F.concat(F.lit("KEY_"), n.cast("string")).alias("name"), F.when(n % 3 == 0, "x").otherwise("").alias("value"))
    return settings.missing_keys(_agents(spark, sf_dir), _providers(spark, sf_dir), environment).select("provider", "env", F.concat_ws(",", "agents").alias("agents"))


@query("join_12_context", """select o_orderkey as resource, a.agent, 'priority' as field, o_orderpriority as value from orders, (values ('a0'), ('a1')) a(agent) where o_orderkey % 4 <> 0
union all select o_orderkey, 'a1', 'price', cast(o_custkey as varchar) from orders""")
def join_12(spark, sf_dir):
    """Two agents: the first declares one field, the second two; every fourth answer failed."""
    agents = spark.createDataFrame([("a0", ["priority"]), ("a1", ["priority", "price"])], "agent string, context array<string>")
    fields = F.array(F.struct(F.lit("priority").alias("field"), F.col("o_orderpriority").alias("value"), F.when(F.col("o_orderkey") % 4 == 0, "failed").alias("error")),
                     F.struct(F.lit("price").alias("field"), F.col("o_custkey").cast("string").alias("value"), F.lit(None).cast("string").alias("error")))
    results = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("resource"), F.explode(fields).alias("r")).select("resource", "r.*")
    return settings.upstream_context(agents, results)


@query("join_19_agent_overrides", """select s_name as agent, case when s_suppkey % 2 = 0 and s_suppkey % 4 = 0 then 'p1' else 'p' || s_nationkey end as provider, case when s_suppkey % 2 = 0 and s_suppkey % 3 = 0 then 'big' else 'm' || s_suppkey % 3 end as model from supplier""")
def join_19(spark, sf_dir):
    """Overrides of every second agent: half of them name a provider that does not exist, two thirds a blank model."""
    k = F.col("s_suppkey")
    overrides = table(spark, sf_dir, "supplier").where(k % 2 == 0).select(F.col("s_name").alias("agent"), F.when(k % 4 == 0, "p1").otherwise("nowhere").alias("provider"), F.when(k % 3 == 0, "big").otherwise("").alias("model"))
    return settings.apply_overrides(_agents(spark, sf_dir), overrides, _providers(spark, sf_dir))


@query("join_20_swap", """select s_name as agent, case when s_nationkey = 3 then 'p7' else 'p' || s_nationkey end as provider, case when s_nationkey = 3 then 'large' else 'm' || s_suppkey % 3 end as model, true as restored from supplier""")
def join_20(spark, sf_dir):
    """A provider swapped for another, and whether restoring gives back what was."""
    agents = _agents(spark, sf_dir)
    swapped = settings.swap_provider(agents, "p3", "p7", "large")
    back = settings.restore_provider(swapped, "p7", "large").select(F.col("agent").alias("b_agent"), F.struct("provider", "model").alias("back"))
    was = agents.select(F.col("agent").alias("w_agent"), F.struct("provider", "model").alias("was"))
    joined = swapped.join(back, F.col("agent") == F.col("b_agent")).join(was, F.col("agent") == F.col("w_agent"))
    return joined.select("agent", "provider", "model", (F.col("back") == F.col("was")).alias("restored"))


@query("src_04_variables", """select p_partkey, p_name || '/' || case p_partkey % 3 when 0 then 'north' when 1 then '' else '${open' end as text from part""")
def src_04(spark, sf_dir):
    variables = spark.createDataFrame([("REGION", "north")], "name string, value string")
    rest = F.when(F.col("p_partkey") % 3 == 0, "${REGION}").when(F.col("p_partkey") % 3 == 1, "${UNSET}").otherwise("${open")
    return settings.expand_variables(F.concat("p_name", F.lit("/"), rest), variables, table(spark, sf_dir, "part").select("p_partkey", "p_name"), "text").select("p_partkey", "text")


_CONFIG = """case s_suppkey % 6
  when 0 then concat('{"llm":{"model":"', s_name, '","retries":', s_nationkey, '},"agents":[{"name":"a"},{"name":"b"}]}')
  when 1 then concat('{"llm":{"model":', s_nationkey, ',"modle":"x"},"agents":[{},{"name":"b","extra":{"deep":1}}]}')
  when 2 then concat('{"agents":"', s_name, '","who":[1]}')
  when 3 then '  ' when 4 then '[1]' end"""


@query("src_04_closed", """select s_suppkey, e.path as path, e.error as error from (select s_suppkey, unnest(case s_suppkey % 6
  when 0 then [] when 1 then [{'path': 'llm.model', 'error': 'not a string'}, {'path': 'llm.modle', 'error': 'unknown'}, {'path': 'agents[0].name', 'error': 'missing'}, {'path': 'agents[1].extra', 'error': 'unknown'}]
  when 2 then [{'path': 'llm', 'error': 'missing'}, {'path': 'agents', 'error': 'not a array'}, {'path': 'who', 'error': 'unknown'}]
  when 4 then [{'path': '', 'error': 'not a JSON object'}] else [{'path': '', 'error': 'empty'}] end) as e from supplier)""")
def src_04_closed(spark, sf_dir):
    """Configurations against their declared keys: unknown, missing and ill-typed ones at two depths, empty texts and nulls."""
    declared = [("llm", "object", True), ("llm.model", "string", True), ("llm.retries", "number", False), ("agents", "array", False), ("agents[]", "object", False), ("agents[].name", "string", True)]
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.expr(_CONFIG).alias("json"))
    return closed_errors(rows, "s_suppkey", "json", declared)


@query("src_05_first_existing", "select s_suppkey, case when s_suppkey % 2 = 0 then 'explicit' when s_suppkey % 3 = 0 then 'folder' else 'environment' end as place from supplier")
def src_05(spark, sf_dir):
    k = F.col("s_suppkey")
    places = F.array(*[F.struct(F.lit(n).alias("rank"), F.lit(p).alias("place"), e.alias("exists")) for n, (p, e) in enumerate([("explicit", k % 2 == 0), ("folder", k % 3 == 0), ("environment", F.lit(True))])])
    candidates = table(spark, sf_dir, "supplier").select(k, F.explode(places).alias("c")).select("s_suppkey", "c.*")
    return settings.first_existing(candidates, "s_suppkey", "rank", "exists").select("s_suppkey", "place")


@query("val_03_deprecated", "select s_suppkey, case when s_suppkey % 2 = 0 then 1 else 0 end as warned, 'model=' || s_name as kept from supplier")
def val_03(spark, sf_dir):
    given = F.when(F.col("s_suppkey") % 2 == 0, F.create_map(F.lit("model"), "s_name", F.lit("max_calls"), F.lit("3"))).otherwise(F.create_map(F.lit("model"), "s_name"))
    kept, warnings = settings.without_deprecated(given, ["max_calls"])
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.size(warnings).alias("warned"), F.array_join(F.transform(F.map_entries(kept), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("kept"))
