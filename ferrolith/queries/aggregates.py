"""Merging, accounting and scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from ferrolith.operators import curation, evaluation, merging, validation
from ferrolith.queries import query, table


def _results(spark, sf_dir):
    """Events as partial results: the user is the resource, the event type the field, three events make a call."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    kind = F.when(F.length("event_type") % 3 == 0, "list").when(F.length("event_type") % 3 == 1, "dict").otherwise("scalar")
    text = F.col("event_id").cast("string")
    items = F.when(kind == "list", F.array(F.struct(F.lit(None).cast("string").alias("key"), text.alias("value")))).when(kind == "dict", F.array(F.struct((F.col("event_id") % 3).cast("string").alias("key"), F.when(F.col("event_id") % 2 == 0, text).otherwise("").alias("value"))))
    return e.select(
        F.col("user_id").alias("resource"), F.col("event_id").alias("ord"), F.floor(F.col("event_id") / 3).alias("call"), F.col("event_type").alias("field"), kind.alias("kind"), F.when(kind == "scalar", text).alias("value"), items.alias("items"),
        F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("error "), (F.col("event_id") % 5).cast("string"))).alias("error"), (F.floor(F.col("event_id") / 3) % 100).alias("prompt"), (F.floor(F.col("event_id") / 3) % 10).alias("completion"),
    )


@query("agg_01_merge", """with r as (select user_id as resource, event_id as ord, event_type as field, length(event_type) % 3 as k, event_id from events where event_id % 7 <> 0),
s as (select resource, field, 'scalar' as kind, max_by(event_id, ord)::varchar as value from r where k = 2 group by 1, 2), l as (select resource, field, 'list' as kind, string_agg(event_id::varchar, ',' order by ord) as value from r where k = 0 group by 1, 2),
d1 as (select resource, field, event_id % 3 as key, min(ord) as first, arg_min(event_id::varchar, ord) filter (where event_id % 2 = 0) as v from r where k = 1 group by 1, 2, 3), d as (select resource, field, 'dict' as kind, string_agg(key || '=' || coalesce(v, ''), ',' order by first) as value from d1 group by 1, 2)
select * from s union all select * from l union all select * from d""")
def agg_01(spark, sf_dir):
    merged = merging.merge_fields(_results(spark, sf_dir))
    flat = F.when(F.col("kind") == "scalar", F.col("value")).when(F.col("kind") == "list", F.array_join(F.transform("items", lambda x: x["value"]), ",")).otherwise(F.array_join(F.transform("items", lambda x: F.concat(x["key"], F.lit("="), x["value"])), ","))
    return merged.select("resource", "field", "kind", flat.alias("value"))


@query("agg_02_usage", """with c as (select distinct user_id as resource, event_id // 3 as call from events) select resource, count(*) as calls, cast(sum(call % 100) as bigint) as prompt, cast(sum(call % 10) as bigint) as completion, cast(sum(call % 100 + call % 10) as bigint) as total from c group by 1""")
def agg_02(spark, sf_dir):
    return merging.usage_by_call(_results(spark, sf_dir))


@query("agg_04_failures", """with e as (select user_id as resource, case when event_id % 7 = 0 then 'error ' || event_id % 5 end as error from events)
select resource, case when bool_or(error is not null) then 'failed' else 'ok' end as status, coalesce(array_to_string(list_sort(list_distinct(list(error) filter (where error is not null)))[1:3], '; '), '') as errors from e group by 1""")
def agg_04(spark, sf_dir):
    return merging.failure_summary(_results(spark, sf_dir))


@query("agg_05_partial", """with e as (select user_id as resource, event_id % 7 = 0 as bad from events) select status, g, count(*) as n from (select resource % 10 as g, resource, case when bool_and(bad) then 'failed' when bool_or(bad) then 'partial' else 'ok' end as status from e group by 1, 2) group by 1, 2""")
def agg_05(spark, sf_dir):
    found = merging.failure_summary(_results(spark, sf_dir), allow_partial=True)
    return found.groupBy("status", (F.col("resource") % 10).alias("g")).agg(F.count(F.lit(1)).alias("n"))


@query("agg_03_models_used", "select user_id as resource, event_type as agent, arg_min('m' || event_id % 3, event_id) as model from events where event_id % 4 <> 0 group by 1, 2")
def agg_03(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("resource"), F.col("event_id").alias("ord"), F.col("event_type").alias("agent"), F.when(F.col("event_id") % 4 != 0, F.concat(F.lit("m"), (F.col("event_id") % 3).cast("string"))).alias("model"))
    return merging.models_used(rows)


@query("agg_07_org_entries", """with u as (select c_name as name, c_custkey as file, 'ror' || c_nationkey as id from customer where c_custkey % 3 = 0 union all select 'Customer of ' || o_orderpriority, o_custkey, 'p' || o_orderkey % 4 from orders)
select name, count(distinct file) as files, count(distinct id) as ids from u group by 1""")
def agg_07(spark, sf_dir):
    """Organisations of several places in one list, with different identifiers and files."""
    c = table(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select(F.col("c_name").alias("name"), F.col("c_custkey").alias("file"), F.concat(F.lit("ror"), "c_nationkey").alias("id"))
    o = table(spark, sf_dir, "orders").select(F.concat(F.lit("Customer of "), "o_orderpriority").alias("name"), F.col("o_custkey").alias("file"), F.concat(F.lit("p"), (F.col("o_orderkey") % 4).cast("string")).alias("id"))
    return curation.organisation_entries(c.unionByName(o), "name", "file", "id")


@query("agg_12_freq", "select o_orderpriority as value, count(*) as n from orders group by 1")
def agg_12(spark, sf_dir):
    return evaluation.frequencies(table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("value")), "value").orderBy(F.desc("n"), "value")


@query("agg_13_exit", """select o_custkey as batch, case when count(*) filter (where o_orderstatus <> 'F') = 0 then 1 when count(*) filter (where o_orderstatus <> 'F') < count(*) or count(*) filter (where o_orderpriority like '1%') > 0 then 2 else 0 end as code from orders group by 1""")
def agg_13(spark, sf_dir):
    sums = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("batch")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") != "F").alias("ok"), F.count_if(F.col("o_orderpriority").startswith("1")).alias("warned"))
    return sums.select("batch", merging.exit_code(F.col("n"), F.col("ok"), F.col("warned")).alias("code"))


@query("agg_14_duplicates", "select l_partkey, l_suppkey, count(*) as n from lineitem group by 1, 2 having count(*) > 1")
def agg_14(spark, sf_dir):
    return validation.duplicates(table(spark, sf_dir, "lineitem"), "l_partkey", "l_suppkey")


@query("agg_15_best_attempt", """with a as (select l_orderkey, l_linenumber as attempt, cast(l_quantity as int) % 16 as n_fields from lineitem), s as (select l_orderkey, min(attempt) filter (where n_fields >= 12) as stop from a group by 1)
select l_orderkey, attempt, n_fields from (select a.*, row_number() over (partition by a.l_orderkey order by n_fields desc, attempt) as p from a join s using (l_orderkey) where stop is null or attempt <= stop) where p = 1""")
def agg_15(spark, sf_dir):
    a = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("attempt"), (F.col("l_quantity").cast("int") % 16).alias("n_fields"))
    return merging.best_attempt(a, "l_orderkey")


@query("agg_11_rollup", """select o_orderpriority as g, count(v) as n, count(*) - count(v) as failed, round(avg(v), 6) as mean, min(v) as least, max(v) as greatest, coalesce(avg(v) >= 150000, false) as passed from (select o_orderpriority, case when o_orderkey % 10 <> 0 then o_totalprice end as v from orders) group by 1""")
def agg_11(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("g"), F.when(F.col("o_orderkey") % 10 != 0, F.col("o_totalprice")).alias("v"))
    return evaluation.rollup(rows, "g", "v", 150000).withColumn("mean", F.round("mean", 6))


@query("agg_21_field_similarity", """select coalesce(a.k, b.k) as k, cast(case when a.k is not null and b.k is not null and a.v = b.v then 1 else 0 end as double) as similarity, case when a.k is null then 'right' when b.k is null then 'left' else 'both' end as side
from (select s_suppkey as k, s_nationkey as v from supplier where s_suppkey % 2 = 0) a full join (select s_suppkey as k, case when s_suppkey % 4 = 0 then s_nationkey else -1 end as v from supplier where s_suppkey % 3 = 0) b on a.k = b.k""")
def agg_21(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    a = s.where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("v"))
    b = s.where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("k"), F.when(F.col("s_suppkey") % 4 == 0, F.col("s_nationkey")).otherwise(-1).alias("v"))
    return evaluation.compare_keys(a, b, "k", "v")


def _score_pairs(spark, sf_dir):
    """Truth and outcome by supplier: brands and sizes of its parts in odd and in even orders."""
    l = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_partkey")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    rows = l.join(p, F.col("l_partkey") == F.col("p_partkey"))
    side = lambda odd, c: F.array_sort(F.collect_set(F.when(F.col("l_orderkey") % 2 == odd, F.col(c).cast("string"))))
    columns = {"creators_name": "p_brand", "subjects": "p_type", "categories": "p_size", "languages": "p_brand", "geo_places": "p_type", "media_formats": "p_size", "ror_match": "p_brand", "field_coverage": "p_type"}
    sets = [side(odd, c).alias(f"{t}_{m}") for m, c in columns.items() for t, odd in (("t", 1), ("a", 0))]
    rights = [F.min(F.when(F.col("l_orderkey") % 2 == odd, F.col("p_brand"))).alias(f"{t}_rights") for t, odd in (("t", 1), ("a", 0))]
    return rows.groupBy("l_suppkey").agg(*sets, *rights)


def _set_sql(c: str) -> str:
    return f"""list_distinct(list({c}) filter (where l_orderkey % 2 = 1)) as t_{c}, list_distinct(list({c}) filter (where l_orderkey % 2 = 0)) as a_{c}"""


_SCORES_SQL = f"""with g as (select l_suppkey, {_set_sql('p_brand')}, {_set_sql('p_type')}, {_set_sql('p_size')}, min(p_brand) filter (where l_orderkey % 2 = 1) as tr, min(p_brand) filter (where l_orderkey % 2 = 0) as ar from lineitem join part on l_partkey = p_partkey group by 1),
n as (select l_suppkey, tr, ar, {", ".join(f"coalesce(t_{c}, []) as t_{c}, coalesce(a_{c}, []) as a_{c}" for c in ("p_brand", "p_type", "p_size"))} from g),
j as (select *, {", ".join(f"case when len(list_distinct(list_concat(t_{c}, a_{c}))) = 0 then 1.0 else len(list_intersect(t_{c}, a_{c})) / len(list_distinct(list_concat(t_{c}, a_{c}))) end as j_{c}" for c in ("p_brand", "p_type", "p_size"))},
  case when len(t_p_brand) > 0 then len(list_intersect(t_p_brand, a_p_brand)) / len(t_p_brand) when len(a_p_brand) > 0 then 0.0 else 1.0 end as ror, case when len(t_p_type) > 0 then len(list_intersect(t_p_type, a_p_type)) / len(t_p_type) else 0.0 end as cov, case when coalesce(tr, '') = coalesce(ar, '') then 1.0 else 0.0 end as rights from n)"""


@query("agg_09_scores", _SCORES_SQL + " select l_suppkey, round(j_p_brand, 6) as creators_name, round(ror, 6) as ror_match, round(cov, 6) as field_coverage, rights::double as rights, round(0.2 * j_p_brand + 0.15 * ror + 0.1 * j_p_type + 0.1 * j_p_size + 0.1 * rights + 0.05 * j_p_brand + 0.1 * j_p_type + 0.05 * j_p_size + 0.15 * cov, 6) as overall from j")
def agg_09(spark, sf_dir):
    s = evaluation.score_documents(_score_pairs(spark, sf_dir), "l_suppkey")
    return s.select("l_suppkey", *[F.round(c, 6).alias(c) for c in ("creators_name", "ror_match", "field_coverage")], "rights", F.round("overall", 6).alias("overall"))


@query("set_01_jaccard", _SCORES_SQL + " select l_suppkey, round(j_p_type, 6) as similarity from j")
def set_01(spark, sf_dir):
    from ferrolith.functions.values import jaccard

    return _score_pairs(spark, sf_dir).select("l_suppkey", F.round(jaccard(F.col("t_subjects"), F.col("a_subjects")), 6).alias("similarity"))


@query("val_15_worst_status", """select o_custkey as k, case max(case o_orderstatus when 'F' then 2 when 'P' then 1 else 0 end) when 2 then 'FAIL' when 1 then 'WARN' else 'PASS' end as worst from orders group by 1""")
def val_15(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.when(F.col("o_orderstatus") == "F", "FAIL").when(F.col("o_orderstatus") == "P", "WARN").otherwise("PASS").alias("status"))
    return validation.worst_status(rows, "k")


@query("val_02_dangling", "select l_orderkey, l_linenumber from lineitem where l_suppkey not in (select s_suppkey from supplier where s_suppkey % 5 <> 0)")
def val_02(spark, sf_dir):
    known = table(spark, sf_dir, "supplier").where("s_suppkey % 5 <> 0")
    return validation.dangling(table(spark, sf_dir, "lineitem"), "l_suppkey", known, "s_suppkey").select("l_orderkey", "l_linenumber")


@query("val_22_retryable", """select case when o_orderkey % 4 = 0 then false when o_orderkey % 4 = 1 then true else o_orderkey % 5 in (0, 2) end as again, count(*) as n from orders group by 1""")
def val_22(spark, sf_dir):
    k = F.col("o_orderkey")
    kind = F.when(k % 4 == 0, "validation").when(k % 4 == 1, "transport").otherwise("http")
    status = F.element_at(F.array(*map(F.lit, (429, 400, 503, 404, 200))), (k % 5 + 1).cast("int"))
    return table(spark, sf_dir, "orders").groupBy(validation.retryable(status, kind).alias("again")).agg(F.count(F.lit(1)).alias("n"))
