"""Names and strings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ferrolith.functions import names, values
from ferrolith.queries import query, table

#: Names with what normalisation deals with, from supplier keys.
_NAMES = """case s_suppkey % 8 when 0 then 'Universidad de Concepción S.A.' when 1 then '  Univ. de  Chile ' when 2 then 'MIN. de Educación, Gob. de Chile' when 3 then 'Acme Corp.'
  when 4 then 'U.  de Ñuble' when 5 then 'Data-Works (GmbH)' when 6 then 'Inst. Élan & Søn Ltd' else s_name end"""


@query("scl_03_normalize_org", """select s_suppkey, case s_suppkey % 8 when 0 then 'universidad de concepcion sa' when 1 then 'universidad de chile' when 2 then 'ministerio de educacion gobierno de chile' when 3 then 'acme'
  when 4 then 'universidad de nuble' when 5 then 'data-works gmbh' when 6 then 'instituto elan søn' else lower(regexp_replace(s_name, '[^A-Za-z0-9_ -]', '', 'g')) end as name from supplier""")
def scl_03(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", names.normalize_org(F.expr(_NAMES)).alias("name"))


@query("scl_01_fold_accents", "select doc_id, strip_accents(text) as folded from documents where text is not null")
def scl_01(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(F.col("text").isNotNull()).select("doc_id", names.fold_accents(F.col("text")).alias("folded"))


@query("scl_04_publisher", "select s_suppkey, s_name as name from supplier")
def scl_04(spark, sf_dir):
    tail = F.element_at(F.array(*map(F.lit, ("", " - Gobierno de Chile", " (Chile)", " (CHILE) - gobierno de chile "))), (F.col("s_suppkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", names.clean_publisher(F.concat("s_name", tail)).alias("name"))


@query("scl_06_escape_query", r"""select p_partkey, regexp_replace(p_name || ' (x/y): "z"?', '([\\+\-&|!(){}\[\]^"~*?:/])', '\\\1', 'g') as q from part""")
def scl_06(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", names.escape_query(F.concat("p_name", F.lit(' (x/y): "z"?'))).alias("q"))


@query("scl_07_model_label", """select distinct p_brand as brand, 'p' as provider, replace(replace(replace(p_brand || '/a.b:c', '.', '_'), ':', '__'), '/', '_') as label from part""")
def scl_07(spark, sf_dir):
    provider, _ = names.split_provider(F.concat(F.lit("p:"), "p_brand"), "d")
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), provider.alias("provider"), names.model_label(F.concat("p_brand", F.lit("/a.b:c"))).alias("label")).distinct()


@query("scl_08_output_name", """select doc_id, case when doc_id % 3 = 0 then 'Ahint-1' when doc_id % 3 = 1 then '10.5555_x-' || doc_id else 'Title' || doc_id end || '.json' as name from documents""")
def scl_08(spark, sf_dir):
    k = F.col("doc_id") % 3
    return table(spark, sf_dir, "documents").select("doc_id", names.output_name(F.when(k == 0, "A hint-1!"), F.when(k <= 1, F.concat(F.lit("10.5555/x:"), "doc_id")), F.concat(F.lit("Title: "), "doc_id")).alias("name"))


@query("scl_09_citation", """select p_partkey, concat_ws(', ', p_name, case when p_partkey % 2 = 0 then p_size || case when p_partkey % 3 = 0 then '(' || p_brand || ')' else '' end end, case when p_partkey % 4 = 0 then '10-20' when p_partkey % 4 = 1 then '10' end, case when p_partkey % 5 = 0 then 'ed. 2' end, case when p_partkey % 6 = 0 then 'Lima' end, case when p_partkey % 7 = 0 then '2001' end) || '.' as citation from part""")
def scl_09(spark, sf_dir):
    k, none = F.col("p_partkey"), F.lit("")
    at = lambda n, v, r=0: F.when(k % n == r, v).otherwise("")
    return table(spark, sf_dir, "part").select("p_partkey", names.citation(F.col("p_name"), at(2, F.col("p_size").cast("string")), at(3, F.col("p_brand")), F.when(k % 4 <= 1, "10").otherwise(none), at(4, F.lit("20")), at(5, F.lit("2")), at(6, F.lit("Lima")), at(7, F.lit(" 2001 "))).alias("citation"))


@query("scl_10_contact", "select c_custkey, case c_custkey % 3 when 0 then c_name || ' (a@b.org)' when 1 then c_name else 'a@b.org' end as contact from customer")
def scl_10(spark, sf_dir):
    k = F.col("c_custkey") % 3
    return table(spark, sf_dir, "customer").select("c_custkey", names.contact_line(F.when(k != 2, F.col("c_name")), F.when(k != 1, "a@b.org")).alias("contact"))


@query("scl_13_prompt", """select conv_id, 'Talk ' || conv_id || ': ' || string_agg(coalesce(role, '') || '=' || coalesce(text, ''), chr(10) order by turn, role, text) as prompt from conversations group by conv_id""")
def scl_13(spark, sf_dir):
    lines = F.array_sort(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(lines.alias("lines"))
    body = F.concat_ws("\n", F.transform("lines", lambda x: F.concat(x["role"], F.lit("="), x["text"])))
    return rows.select("conv_id", names.render_prompt(F.lit("Talk {id}: {body}"), {"id": F.col("conv_id").cast("string"), "body": body}).alias("prompt"))


@query("scl_17_language_code", "select lang, case lang when 'en' then 'en' when 'fr' then 'fr' when 'de' then 'de' when 'es' then 'es' end as code, count(*) as n from documents where lang is not null group by 1, 2")
def scl_17(spark, sf_dir):
    spelled = F.when(F.col("lang") == "en", " English ").when(F.col("lang") == "fr", "français").when(F.col("lang") == "de", "Deutsch").otherwise("es")
    return table(spark, sf_dir, "documents").where("lang is not null").select("lang", names.language_code(spelled).alias("code")).groupBy("lang", "code").agg(F.count(F.lit(1)).alias("n"))


@query("scl_18_date_parts", "select o_orderkey, case o_orderkey % 3 when 0 then strftime(o_orderdate, '%Y') when 1 then strftime(o_orderdate, '%Y-%m') else strftime(o_orderdate, '%Y-%m-%d') end as d, strftime(o_orderdate, '%Y') as y from orders")
def scl_18(spark, sf_dir):
    parts = F.slice(F.array(F.year("o_orderdate"), F.month("o_orderdate"), F.day("o_orderdate")), F.lit(1), (F.col("o_orderkey") % 3 + 1).cast("int"))
    made = values.date_from_parts(parts)
    return table(spark, sf_dir, "orders").select("o_orderkey", made.alias("d"), values.year_of(made).alias("y"))


@query("scl_49_cache_key", "select conv_id, turn, sha256(concat_ws(':', role, text)) as key from conversations")
def scl_49(spark, sf_dir):
    from ferrolith.operators.caching import cache_key

    return table(spark, sf_dir, "conversations").select("conv_id", "turn", cache_key(F.col("role"), F.col("text")).alias("key"))


@query("val_20_email", "select doc_id, regexp_extract(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}') as email from documents where regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}')")
def val_20(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", names.email_in(F.col("text")).alias("email")).where(F.col("email").isNotNull())
