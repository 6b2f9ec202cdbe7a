"""Sources, model answers, reports and samples: operators over rows that stand for files, hits and calls."""

from __future__ import annotations

from pyspark.sql import functions as F

from ferrolith.functions import names, shapes
from ferrolith.operators import evaluation, merging, ranking, settings, validation
from ferrolith.plans import document
from ferrolith.queries import query, table
from ferrolith.queries.documents import RECORD_SQL, TODAY, records
from ferrolith.operators.storage import new_folder
from ferrolith.sources import registries, resources
from ferrolith.sources.files import parts_for, read_folder, write_folder


@query("src_01_resources", """select doc_id, case when doc_id % 5 > 1 then 'https://e.org/' || doc_id end as url, case when doc_id % 5 > 2 then source end as title, case when doc_id % 5 > 1 then text end as description,
  case doc_id % 5 when 0 then 'not JSON' when 1 then 'not an object' end as error from documents""")
def src_01(spark, sf_dir):
    """Files of resource descriptions: broken ones, lists, and objects with and without a title."""
    k = F.col("doc_id")
    whole = F.to_json(F.struct(F.concat(F.lit("https://e.org/"), k).alias("url"), F.when(k % 5 > 2, F.col("source")).alias("title"), F.col("text").alias("description"), k.alias("more")))
    files = table(spark, sf_dir, "documents").select(k.cast("string").alias("path"), F.when(k % 5 == 0, '{"url": ').when(k % 5 == 1, "[1, 2]").otherwise(whole).alias("value"))
    return resources.parse_resources(files).select(F.col("path").cast("bigint").alias("doc_id"), "url", "title", "description", "error")


def _folder(spark, sf_dir):
    """A folder with a file for each document, every fifth of them broken and every fifth a list; many documents are in parts of it."""
    k, documents = F.col("doc_id"), table(spark, sf_dir, "documents")
    whole = F.to_json(F.struct(k.alias("id"), "source", "n_chars"))
    value = F.when(k % 5 == 0, F.concat(F.lit('{"id": '), k, F.lit(","))).when(k % 5 == 1, F.concat(F.lit("["), k, F.lit("]"))).otherwise(whole)
    folder = new_folder(spark, "documents")
    write_folder(documents.select(F.format_string("doc-%d.json", k).alias("name"), value.alias("value")), folder, parts=parts_for(documents.count()))
    return folder


_FILES_SQL = """select 'doc-' || doc_id || '.json' as name, case doc_id % 5 when 0 then '{"id": ' || doc_id || ',' when 1 then '[' || doc_id || ']'
  else '{"id":' || doc_id || ',"source":"' || source || '","n_chars":' || n_chars || '}' end as value, case doc_id % 5 when 0 then 'not JSON' when 1 then 'not an object' end as error, doc_id from documents"""


@query("snk_01_files", f"select name, strlen(value) as length, md5(value) as digest from ({_FILES_SQL})")
def snk_01_files(spark, sf_dir):
    """One file for each document, found and read in tasks."""
    files = resources.whole_files(spark, _folder(spark, sf_dir))
    return files.select(F.substring_index("path", "/", -1).alias("name"), "length", F.md5("content").alias("digest"))


@query("src_03_files", f"select name, strlen(value) as length, error, case when error is null then doc_id end as id from ({_FILES_SQL}) where name like 'doc-1%'")
def src_03_files(spark, sf_dir):
    """Files of a folder, those whose names begin alike; the broken ones are rows, too."""
    files = read_folder(spark, _folder(spark, sf_dir)).where(F.col("name").startswith("doc-1") & (F.col("scheme") == "file"))
    return files.select("name", "length", "error", F.when(F.col("error").isNull(), F.get_json_object("value", "$.id").cast("bigint")).alias("id"))


@query("src_08_chosen", "select s_suppkey, 'org ' || s_nationkey as organization from supplier where s_suppkey % 3 = 1")
def src_08(spark, sf_dir):
    """The hit that the registry itself chose; hits without a mark are not chosen."""
    key = F.col("s_suppkey")
    hits = table(spark, sf_dir, "supplier").select("s_suppkey", F.when(key % 3 == 0, False).when(key % 3 == 1, True).alias("chosen"), F.concat(F.lit("org "), "s_nationkey").alias("organization"))
    return registries.chosen_hits(hits).select("s_suppkey", "organization")


@query("src_15_snapshot", """select 'stale' as kind, n_nationkey, 'bundled' as origin from nation union all select 'young', n_nationkey, 'cache' from nation where n_nationkey < 20""")
def src_15(spark, sf_dir):
    """A snapshot of 40 days gives way to the bundled rows, one of 10 days does not."""
    now = F.lit("2026-01-31").cast("timestamp")
    nations = table(spark, sf_dir, "nation").select("n_nationkey")
    made = lambda day, origin: nations.select(F.lit(day).cast("timestamp").alias("last_updated"), "n_nationkey", F.lit(origin).alias("origin"))
    of = lambda kind, day: registries.fresh_or_bundled(made(day, "cache").where("n_nationkey < 20"), made("2020-01-01", "bundled"), now).select(F.lit(kind).alias("kind"), "n_nationkey", "origin")
    return of("stale", "2025-12-22").unionByName(of("young", "2026-01-21"))


@query("src_24_unwrap", "select doc_id, source as name from documents")
def src_24(spark, sf_dir):
    """The same record in an envelope and flat."""
    flat = F.to_json(F.struct("source"))
    wrapped = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit('{"metadata":{"id":1,"attributes":'), flat, F.lit("}}"))).otherwise(flat)
    inner = resources.unwrap_attributes(F.try_parse_json(wrapped))
    return table(spark, sf_dir, "documents").select("doc_id", F.try_variant_get(inner, "$.source", "string").alias("name"))


@query("scl_05_scoring_form", "select n_nationkey, 'angstrom nino uber ' || lower(n_name) as form from nation")
def scl_05(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", names.scoring_form(F.concat(F.lit("  Ångström Niño ÜBER "), "n_name", F.lit("\t"))).alias("form"))


@query("scl_15_described", """with g as (select lang, list_sort(list(distinct source)) as s from documents group by 1), c as (select c_custkey, c_custkey * 7 % 400 as sec from customer)
select 'set ' || lang as thing, array_to_string(s, ', ') as shown from g union all
select 'case ' || c_custkey, case c_custkey % 4 when 0 then '(file not found)' when 1 then '(no extractor for this metric)' when 2 then '(empty)' else 'a, b' end from c union all
select 'time ' || c_custkey, case when sec < 60 then printf('%.1fs', sec::double) else (sec // 60) || 'm ' || (sec % 60) || 's' end from c""")
def scl_15(spark, sf_dir):
    """What a report shows: sets in order, the three ways of having nothing, and durations."""
    sets = table(spark, sf_dir, "documents").where(F.col("lang").isNotNull()).groupBy("lang").agg(F.collect_set("source").alias("s"))
    key = F.col("c_custkey")
    customers = table(spark, sf_dir, "customer")
    values = F.when(key % 4 == 3, F.array(F.lit("b"), F.lit("a"))).otherwise(F.array().cast("array<string>"))
    return (
        sets.select(F.concat(F.lit("set "), "lang").alias("thing"), shapes.display(F.col("s")).alias("shown"))
        .unionByName(customers.select(F.concat(F.lit("case "), key).alias("thing"), shapes.described(values, key % 4 != 0, key % 4 != 1).alias("shown")))
        .unionByName(customers.select(F.concat(F.lit("time "), key).alias("thing"), shapes.duration(key * 7 % 400).alias("shown")))
    )


@query("scl_16_friendly_error", """with e as (select o_orderkey, case o_orderkey % 4 when 0 then 'HTTP 401' when 1 then 'No Auth Credentials found: ' || o_clerk when 2 then 'timeout after ' || o_clerk else 'AuthenticationError' end as raw from (select o_orderkey, o_orderpriority as o_clerk from orders))
select o_orderkey, case when o_orderkey % 4 = 2 then raw else 'The API key was rejected: check it in the settings. (' || raw || ')' end as shown from e""")
def scl_16(spark, sf_dir):
    k = F.col("o_orderkey")
    raw = F.when(k % 4 == 0, "HTTP 401").when(k % 4 == 1, F.concat(F.lit("No Auth Credentials found: "), "o_orderpriority")).when(k % 4 == 2, F.concat(F.lit("timeout after "), "o_orderpriority")).otherwise("AuthenticationError")
    return table(spark, sf_dir, "orders").select("o_orderkey", names.friendly_error(raw).alias("shown"))


@query("scl_44_answer_json", "select doc_id, case when doc_id % 4 < 3 then doc_id end as a from documents")
def scl_44(spark, sf_dir):
    """JSON out of answers: plain, fenced, in the midst of words, and not there at all."""
    k = F.col("doc_id")
    plain = F.concat(F.lit('{"a": '), k, F.lit(', "b": {}}'))
    answer = F.when(k % 4 == 0, plain).when(k % 4 == 1, F.concat(F.lit("```json\n"), plain, F.lit("\n```"))).when(k % 4 == 2, F.concat(F.lit("Here you are: "), plain, F.lit(" Bye."))).otherwise(F.concat(F.lit("I {cannot} say "), k))
    return table(spark, sf_dir, "documents").select("doc_id", F.try_variant_get(resources.json_of(answer), "$.a", "bigint").alias("a"))


@query("scl_45_coerced", "select doc_id, case when doc_id % 3 = 0 then source || ';' || doc_id end as items from documents")
def scl_45(spark, sf_dir):
    """Lists given as text; objects and other text are no lists."""
    k = F.col("doc_id")
    text = F.when(k % 3 == 0, F.to_json(F.array("source", k.cast("string")))).when(k % 3 == 1, F.to_json(F.struct("source"))).otherwise(F.col("source"))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(resources.coerced_list(text, "array<string>"), ";").alias("items"))


@query("scl_52_role", "select doc_id, doc_id % 3 <> 2 as role from documents")
def scl_52(spark, sf_dir):
    """A role is known by its keys: its type says nothing."""
    k = F.col("doc_id")
    node = F.when(k % 3 == 0, '{"@type":"schema:Person","schema:roleName":"Editor"}').when(k % 3 == 1, '{"schema:contributor":{"schema:name":"Ann"}}').otherwise('{"@type":"schema:Role","schema:name":"Ann"}')
    return table(spark, sf_dir, "documents").select("doc_id", shapes.is_role(F.try_parse_json(node)).alias("role"))


@query("val_05_merge_warning", f"""with {RECORD_SQL} select k as doc_id, case when name = '' and doi = '' then 'missing required fields: name, identifier' when name = '' then 'missing required fields: name' when doi = '' then 'missing required fields: identifier' end as warning from rec""")
def val_05(spark, sf_dir):
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    gaps = {"name": empty("name"), "identifier": empty("identifier.value") & empty("identifier.url"), "subject_of": F.col("subject_of").isNull()}
    return document.envelope(records(spark, sf_dir), TODAY).select("doc_id", validation.merge_warning(gaps).alias("warning"))


@query("val_02_context", """with recursive up(node, ancestor) as (select n_nationkey, n_nationkey // 2 from nation where n_nationkey > 0 union select up.node, n.n_nationkey // 2 from up join nation n on n.n_nationkey = up.ancestor where n.n_nationkey > 0),
given as (select up.node, up.ancestor % 7 as f from up) select n_nationkey as agent, 'f' || (n_nationkey * 3 % 7) as field from nation where not exists (select 1 from given where node = n_nationkey and f = n_nationkey * 3 % 7)""")
def val_02_context(spark, sf_dir):
    """Agents in a tree, each wanting a field that must come from one it depends on."""
    k = F.col("n_nationkey").cast("bigint")
    nodes = table(spark, sf_dir, "nation").select(k.alias("n_nationkey"))
    field = lambda n: F.concat(F.lit("f"), (n % 7).cast("string"))
    needs = nodes.where("n_nationkey > 0").select(k.alias("node"), F.floor(k / 2).cast("bigint").alias("needs"))
    return settings.context_problems(nodes.select(k.alias("agent"), field(k * 3).alias("field")), needs, nodes.select(k.alias("agent"), field(k).alias("field")))


@query("agg_19_rounds", """select l_orderkey, count(*) as rounds, sum(l_partkey) as prompt, sum(l_suppkey) as completion, sum(case when l_linenumber % 2 = 0 or l_partkey = 0 then l_partkey + l_suppkey else l_partkey end)::bigint as total from lineitem group by 1""")
def agg_19(spark, sf_dir):
    """Calls with several rounds; every other round reports no total, and a total of zero counts as none."""
    total = F.when(F.col("l_linenumber") % 2 == 1, F.col("l_partkey"))
    rounds = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").cast("bigint").alias("prompt"), F.col("l_suppkey").cast("bigint").alias("completion"), total.cast("bigint").alias("total"))
    return merging.usage_of_rounds(rounds, "l_orderkey")


@query("agg_23_overlay", "select c_custkey, case when c_custkey % 3 = 0 then 'new' else c_name end as c_name, case when c_custkey % 6 = 0 then -1 else c_nationkey end as c_nationkey from customer")
def agg_23(spark, sf_dir):
    """Another document's values over a document's own, nulls excepted; customers of every third key have one."""
    base = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.col("c_nationkey").cast("bigint").alias("c_nationkey"))
    other = base.where("c_custkey % 3 = 0").select("c_custkey", F.lit("new").alias("c_name"), F.when(F.col("c_custkey") % 6 == 0, F.lit(-1)).cast("bigint").alias("c_nationkey"))
    return merging.overlay(base, other, "c_custkey")


@query("win_06_redraw", """with p as (select doc_id, source, row_number() over (partition by source order by md5('11:' || doc_id), doc_id) as place from documents), d as (select * from p where place <= 8),
ok as (select *, row_number() over (partition by source order by place) as n from d where doc_id % 3 <> 0) select doc_id, source, n as place from ok where n <= 5""")
def win_06(spark, sf_dir):
    """Five documents of each source; those of every third id fail, and up to three reserves take their places."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    seats = docs.select("source").distinct().withColumn("seats", F.lit(5).cast("bigint"))
    drawn = ranking.stratified_draw(docs, "source", F.struct(F.md5(F.concat(F.lit("11:"), "doc_id")), F.col("doc_id")), seats, reserves=3)
    return ranking.redraw(drawn, docs.where("doc_id % 3 = 0"), "source", "doc_id").select("doc_id", "source", F.col("place").cast("bigint").alias("place"))


@query("win_07_sample", "select c_custkey, c_nationkey from customer where c_acctbal > 5000 order by md5('7:' || c_custkey), c_custkey limit 12")
def win_07(spark, sf_dir):
    """A sample of twelve that satisfy a predicate, in a seeded order."""
    return ranking.first_matching(table(spark, sf_dir, "customer"), F.col("c_acctbal") > 5000, 12, 7, "c_custkey").select("c_custkey", "c_nationkey")


@query("snk_09_input_report", "select count(*) as written, count(*) filter (doc_id % 4 > 1) as fetch_ok, count(*) filter (doc_id % 4 <= 1) as fetch_failed, count(*) filter (doc_id % 5 = 0) as fallbacks from documents")
def snk_09(spark, sf_dir):
    k = F.col("doc_id")
    inputs = table(spark, sf_dir, "documents").select((k % 5 == 0).alias("used_fallback"), F.when(k % 4 == 0, " ").when(k % 4 > 1, "page").alias("fetched"))
    return evaluation.input_report(inputs)
