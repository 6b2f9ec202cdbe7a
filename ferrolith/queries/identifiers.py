"""Identifier checks over numbers made from order keys, and walks over JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from ferrolith.functions import identifiers as ids
from ferrolith.operators.validation import leaks
from ferrolith.queries import query, table
from ferrolith.sources.resources import id_pairs

_CHECK = """case (12 - list_reduce(list_prepend(0::bigint, [cast(substr(d, i, 1) as bigint) for i in range(1, 16)]), lambda a, b: (a + b) * 2) % 11) % 11 when 10 then 'X' else cast((12 - list_reduce(list_prepend(0::bigint, [cast(substr(d, i, 1) as bigint) for i in range(1, 16)]), lambda a, b: (a + b) * 2) % 11) % 11 as varchar) end"""
_DIGITS = "select o_orderkey, lpad(cast(o_orderkey as varchar), 15, '0') as d from orders"


@query("scl_31_mod11_2", f"with t as ({_DIGITS}) select o_orderkey, d || {_CHECK} as isni from t")
def scl_31(spark, sf_dir):
    d = F.lpad(F.col("o_orderkey").cast("string"), 15, "0")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.concat(d, ids.check_digit(d)).alias("isni"))


@query("val_07_pid_format", f"""with t as ({_DIGITS}), c as (select *, {_CHECK} as chk from t),
p as (select o_orderkey, case o_orderkey % 4 when 0 then 'ISNI' when 1 then 'ORCID' when 2 then 'DOI' else 'ROR' end as scheme, d, chk from c)
select scheme, case scheme when 'ISNI' then (o_orderkey % 10)::varchar = chk when 'ORCID' then chk = '1' when 'DOI' then o_orderkey % 3 <> 0 else o_orderkey % 5 <> 0 end as ok, count(*) as n from p group by 1, 2""")
def val_07(spark, sf_dir):
    k, d = F.col("o_orderkey"), F.lpad(F.col("o_orderkey").cast("string"), 15, "0")
    scheme = F.element_at(F.array(*map(F.lit, ("ISNI", "ORCID", "DOI", "ROR"))), (k % 4 + 1).cast("int"))
    orcid = F.concat_ws("-", F.substring(d, 1, 4), F.substring(d, 5, 4), F.substring(d, 9, 4), F.concat(F.substring(d, 13, 3), F.lit("1")))
    value = (
        F.when(k % 4 == 0, F.concat(d, (k % 10).cast("string")))
        .when(k % 4 == 1, F.concat(F.lit("https://orcid.org/"), orcid))
        .when(k % 4 == 2, F.concat(F.when(k % 3 == 0, "12.").otherwise("https://doi.org/10.5555/"), k.cast("string")))
        .otherwise(F.concat(F.when(k % 5 == 0, "https://ror.org/l").otherwise("https://ror.org/0"), F.lit("abcdef12")))
    )
    rows = table(spark, sf_dir, "orders").select(scheme.alias("scheme"), ids.pid_format_ok(scheme, value).alias("ok"))
    return rows.groupBy("scheme", "ok").agg(F.count(F.lit(1)).alias("n"))


@query("val_08_resolved", "select case when s < 400 then true when s = 404 then false end as resolved, count(*) as n from (select case o_orderkey % 5 when 0 then 200 when 1 then 301 when 2 then 404 when 3 then 403 else 503 end as s from orders) group by 1")
def val_08(spark, sf_dir):
    status = F.element_at(F.array(*map(F.lit, (200, 301, 404, 403, 503))), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "orders").groupBy(ids.resolved_from_status(status).alias("resolved")).agg(F.count(F.lit(1)).alias("n"))


@query("scl_30_prefixes", "select s_suppkey, '10.5555/s.' || s_suppkey as doi, '0000-0002-1825-0097' as orcid from supplier")
def scl_30(spark, sf_dir):
    k = F.col("s_suppkey")
    prefix = F.element_at(F.array(*map(F.lit, ("https://doi.org/", "http://dx.doi.org/", "DOI.org/", " "))), (k % 4 + 1).cast("int"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", ids.strip_doi(F.concat(prefix, F.lit("10.5555/s."), k)).alias("doi"), ids.strip_orcid(F.lit("HTTPS://ORCID.org/0000-0002-1825-0097")).alias("orcid"))


@query("scl_32_comparison_form", """select s_suppkey, case s_suppkey % 3 when 0 then '000000012146438X' when 1 then '02ap3w078' else '0000-0002-1825-009x' end as form from supplier""")
def scl_32(spark, sf_dir):
    k = F.col("s_suppkey") % 3
    scheme = F.when(k == 0, "ISNI").when(k == 1, "ROR").otherwise("ORCID")
    value = F.when(k == 0, "https://isni.org/isni/0000 0001 2146 438x").when(k == 1, "https://ror.org/02AP3w078").otherwise("http://orcid.org/0000-0002-1825-009X")
    return table(spark, sf_dir, "supplier").select("s_suppkey", ids.comparison_form(scheme, value).alias("form"))


@query("scl_33_write_policy", """select s_suppkey, case when s_suppkey % 2 = 0 then 'ROR' when s_suppkey % 3 = 0 then 'ISNI' else 'ORCID' end as first_scheme,
  case when s_suppkey % 2 = 0 then 'https://ror.org/02ap3w078' when s_suppkey % 3 = 0 then '000000012146438X' else '0000-0002-1825-0097' end as first_value, (s_suppkey % 2 = 0)::int + (s_suppkey % 3 = 0)::int + 1 as n from supplier""")
def scl_33(spark, sf_dir):
    k = F.col("s_suppkey")
    entries = ids.identifier_entries(F.when(k % 2 == 0, F.when(k % 4 == 0, "02ap3w078").otherwise("https://ror.org/02ap3w078")), F.when(k % 3 == 0, "000000012146438X").otherwise(""), F.lit("https://orcid.org/0000-0002-1825-0097"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.get(entries, 0)["scheme"].alias("first_scheme"), F.get(entries, 0)["value"].alias("first_value"), F.size(entries).alias("n"))


@query("scl_38_scheme_of_url", """select case s_suppkey % 5 when 0 then 'ROR' when 1 then 'ISNI' when 2 then 'ORCID' when 3 then 'DOI' end as scheme, count(*) as n from supplier group by 1""")
def scl_38(spark, sf_dir):
    url = F.element_at(F.array(*map(F.lit, ("https://ror.org/02ap3w078", "https://www.isni.org/isni/1", "http://orcid.org/1", "https://dx.doi.org/10.5/1", "https://example.org/1"))), (F.col("s_suppkey") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "supplier").groupBy(ids.scheme_of_url(url).alias("scheme")).agg(F.count(F.lit(1)).alias("n"))


@query("scl_42_digest_kind", "select case doc_id % 3 when 0 then 'sha256' when 1 then 'md5' end as kind, count(*) as n from documents group by 1")
def scl_42(spark, sf_dir):
    k, text = F.col("doc_id") % 3, F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").groupBy(ids.digest_kind(F.when(k == 0, F.sha2(text, 256)).when(k == 1, F.md5(text)).otherwise(F.sha1(text))).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


_ORGS = """select s_suppkey, named_struct('id', concat('https://ror.org/0', s_suppkey)) as x"""


@query("scl_34_registry_fields", """select s_suppkey, case when s_suppkey % 2 = 0 then s_name || ' (display)' else s_name end as name, case when s_suppkey % 3 = 0 then '000000012146438X' when s_suppkey % 3 = 1 then '0000000121464381' end as isni,
  case when s_suppkey % 4 <> 0 then 'CL' end as country, case when s_suppkey % 5 = 0 then 'p' || s_suppkey end as parent_id from supplier""")
def scl_34(spark, sf_dir):
    k, name = F.col("s_suppkey"), F.col("s_name")
    names = F.array(F.struct(name.alias("value"), F.array(F.lit("label")).alias("types")), F.struct(F.concat(name, F.lit(" (display)")).alias("value"), F.when(k % 2 == 0, F.array(F.lit("ror_display"))).otherwise(F.array(F.lit("alias"))).alias("types")))
    external = F.when(k % 3 == 2, F.array().cast("array<struct<type:string,preferred:string,all:array<string>>>")).otherwise(F.array(F.struct(F.lit("isni").alias("type"), F.when(k % 3 == 0, "0000 0001 2146 438X").alias("preferred"), F.array(F.lit("0000 0001 2146 4381")).alias("all"))))
    places = F.when(k % 4 != 0, F.array(F.struct(F.lit("cl").alias("country_code")))).otherwise(F.array().cast("array<struct<country_code:string>>"))
    relations = F.when(k % 5 == 0, F.array(F.struct(F.lit("c").alias("id"), F.lit("c").alias("label"), F.lit("child").alias("type")), F.struct(F.concat(F.lit("p"), k).alias("id"), F.lit("p").alias("label"), F.lit("parent").alias("type")))).otherwise(F.array().cast("array<struct<id:string,label:string,type:string>>"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", ids.ror_display_name(names).alias("name"), ids.ror_isni(external).alias("isni"), ids.ror_country(places).alias("country"), ids.ror_parent(relations)["id"].alias("parent_id"))


_JSON = """concat('{"creator":[{"name":"', s_name, '","id":{"value":"', s_suppkey, '","scheme":"ISNI"}},{"id":{"value":"v', s_suppkey, '"}}],"value":"top","scheme":"DOI","other":{"deep":{"scheme":"ROR","value":"r', s_nationkey, '"}}}')"""


@query("scl_40_pid_walk", """with p as (select s_suppkey, unnest([{'scheme': 'DOI', 'value': 'top', 'path': ''}, {'scheme': 'ISNI', 'value': s_suppkey::varchar, 'path': 'creator[0].id'}, {'scheme': 'ROR', 'value': 'r' || s_nationkey, 'path': 'other.deep'}]) as e from supplier)
select s_suppkey, e.scheme as scheme, e.value as value, e.path as path from p""")
def scl_40(spark, sf_dir):
    return id_pairs(table(spark, sf_dir, "supplier").withColumn("json", F.expr(_JSON)), "s_suppkey", "json")


@query("val_16_leak", """select s_suppkey, unnest(['creator[0].id.scheme', 'creator[0].id.value', 'creator[1].id.value', 'other', 'other.deep.scheme', 'other.deep.value', 'scheme', 'value']) as path from supplier""")
def val_16(spark, sf_dir):
    """Keys outside an allowed list at the top, and forbidden keys at any depth."""
    rows = table(spark, sf_dir, "supplier").withColumn("json", F.expr(_JSON))
    return leaks(rows, "s_suppkey", "json", ["creator"], ["scheme", "value"]).select("s_suppkey", "path")
