"""What is written and read again: documents as linked data, exports beside documents, results model by model, review tables, listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ferrolith.operators import curation
from ferrolith.operators.storage import new_folder
from ferrolith.plans.crosswalks import croissant, croissant_documents
from ferrolith.queries import query, table
from ferrolith.queries.documents import RECORD_SQL, records
from ferrolith.sources import resources, sinks
from ferrolith.sources.files import parts_for, write_folder


@query("cr_01_json", f"""with {RECORD_SQL} select k as doc_id, 'http://mlcommons.org/croissant/' as context, case when has_file then 'cr:FileObject' end as file, has_file as digested,
  concat_ws(',', '@context,@type,conformsTo,name,description', case when lic > 0 then 'license' end, case when url <> '' or doi <> '' then 'url' end, case when not no_creator then 'creator' end,
    case when publisher is not null then 'publisher' end, case when published <> '' or created <> '' then 'datePublished' end, case when created <> '' then 'dateCreated' end, case when has_file then 'distribution' end,
    case when not no_keywords then 'keywords' end, 'inLanguage') as members from rec""")
def cr_01_json(spark, sf_dir):
    """Croissant documents as linked data: context, members in order, files as nodes with their digests."""
    rows = croissant_documents(croissant(records(spark, sf_dir)))
    get = lambda path: F.get_json_object("json", path)
    known = F.filter(F.json_object_keys("json"), lambda k: ~k.isin("version", "sameAs"))
    return rows.select(
        "doc_id", get("$['@context']['cr']").alias("context"), get("$.distribution[0]['@type']").alias("file"), F.coalesce(F.length(get("$.distribution[0].md5")) == 32, F.lit(False)).alias("digested"),
        F.array_join(known, ",").alias("members"),
    )


@query("snk_02_export", "select doc_id, true as written, strlen(text) as bytes from documents")
def snk_02(spark, sf_dir):
    """Documents and an export of them, side by side, read again."""
    docs = table(spark, sf_dir, "documents")
    folder = new_folder(spark, "exported")
    sinks.write_with_export(docs.select("doc_id", "source"), docs.select("doc_id", F.octet_length("text").cast("bigint").alias("bytes")), folder, "doc_id")
    written = spark.read.text(f"{folder}/documents").select(F.get_json_object("value", "$.source").isNotNull().alias("written")).groupBy().agg(F.bool_and("written").alias("written"))
    return spark.read.parquet(f"{folder}/export").crossJoin(F.broadcast(written)).select("doc_id", "written", "bytes")  # one row


@query("snk_05_checkpoints", "select s_suppkey, s_nationkey % 3 as model, case when s_nationkey % 3 = 1 then 2 else 1 end as run from supplier")
def snk_05(spark, sf_dir):
    """Results model by model; one model runs again and replaces its part."""
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_nationkey") % 3).cast("int").alias("model"))
    folder = new_folder(spark, "results")
    for model, run in ((0, 1), (1, 1), (2, 1), (1, 2)):
        sinks.append_results(rows.where(F.col("model") == model).withColumn("run", F.lit(run)), folder, "model")
    return spark.read.parquet(folder).select("s_suppkey", "model", "run")


@query("src_20_review", "select c_custkey::varchar as id, case when c_custkey % 3 = 0 then 'Señal \"' || c_name || '\", y más' else c_name end as name from customer")
def src_20(spark, sf_dir):
    """A review table with a byte order mark, written and read again: quotes, commas and accents."""
    name = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit('Señal "'), "c_name", F.lit('", y más'))).otherwise(F.col("c_name"))
    folder = new_folder(spark, "review")
    curation.write_review_csv(table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id"), name.alias("name")), folder)
    return resources.read_review_csv(spark, folder)


@query("src_02_listing", "select 'p-' || page_id || '.json' as name, case when page_id % 3 = 0 then 'not JSON' end as error from pages where page_id % 4 <> 0")
def src_02(spark, sf_dir):
    """A folder's own JSON files, without those of other names and below."""
    k = F.col("page_id")
    pages = table(spark, sf_dir, "pages")
    folder, parts = new_folder(spark, "listing"), parts_for(pages.count())
    write_folder(pages.select(F.concat(F.lit("p-"), k, F.when(k % 4 == 0, ".txt").otherwise(".json")).alias("name"), F.when(k % 3 == 0, "{").otherwise("{}").alias("value")), folder, parts=parts)
    write_folder(pages.select(F.concat(F.lit("q-"), k, F.lit(".json")).alias("name"), F.lit("{}").alias("value")), f"{folder}/below", parts=parts)
    return resources.read_resources(spark, folder).select(F.substring_index("path", "/", -1).alias("name"), "error")


@query("src_18_objects", "select 'o-' || page_id as name, strlen(url) as length, md5(url) as digest from pages where page_id % 3 <> 0")
def src_18(spark, sf_dir):
    """Objects below a prefix; empty ones, which stand for folders, are left out."""
    k = F.col("page_id")
    pages = table(spark, sf_dir, "pages")
    folder = new_folder(spark, "objects")
    write_folder(pages.select(F.concat(F.lit("o-"), k).alias("name"), F.when(k % 3 == 0, "").otherwise(F.col("url")).alias("value")), folder, parts=parts_for(pages.count()))
    return resources.listed_objects(spark, folder).select(F.substring_index("path", "/", -1).alias("name"), "length", F.md5("content").alias("digest"))


@query("snk_03_report", """select '| region | nations |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || r_name || ' | ' || n || ' |', chr(10) order by r_name) || chr(10) as report
from (select r_name, count(*) as n from nation join region on n_regionkey = r_regionkey group by 1)""")
def snk_03(spark, sf_dir):
    """A report of a few rows as a Markdown table."""
    joined = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    counts = joined.groupBy(F.col("r_name").alias("region")).agg(F.count(F.lit(1)).alias("nations")).orderBy("region")
    return spark.createDataFrame([(sinks.markdown_table(counts),)], "report string")


@query("snk_04_overrides", """with o as (select s_suppkey as k, case when s_suppkey % 2 = 0 then 'Oficina "' || s_name || '"' else s_name end as name from supplier where s_suppkey % 5 <> 0)
select 'overrides:' as line, 1 as n union all select '  - name: "' || replace(name, '"', chr(92) || '"') || '"', 1 from o
union all select '    country: "CL"', count(*) from o where k % 3 = 0 union all select '    ror_id: "r' || k || '"', 1 from o""")
def snk_04(spark, sf_dir):
    """Overrides written for people to edit, line by line: quotes, missing countries, entries without an identifier left out."""
    k = F.col("s_suppkey")
    name = F.when(k % 2 == 0, F.concat(F.lit('Oficina "'), "s_name", F.lit('"'))).otherwise(F.col("s_name"))
    entries = table(spark, sf_dir, "supplier").select(name.alias("name"), F.when(k % 3 == 0, "cl").alias("country"), F.when(k % 5 != 0, F.concat(F.lit("r"), k)).alias("ror_id"), F.lit("").alias("isni_id"), k.alias("at"))
    folder = new_folder(spark, "overrides")
    curation.write_overrides_yaml(curation.load_overrides(entries, "at"), folder)
    return spark.read.text(folder).groupBy(F.col("value").alias("line")).agg(F.count(F.lit(1)).alias("n"))
