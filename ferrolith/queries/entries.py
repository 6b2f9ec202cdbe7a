"""Entries of documents: their identifiers, keys and prompts; searches; and files whose pages are read."""

from __future__ import annotations

from pyspark.sql import functions as F

from ferrolith.functions import identifiers, names
from ferrolith.functions.web import main_content
from ferrolith.operators import enrichment, matching, validation
from ferrolith.operators.storage import new_folder
from ferrolith.plans.records import records_of
from ferrolith.plans.row_pipeline import with_pages
from ferrolith.queries import query, table
from ferrolith.sources.files import parts_for, read_folder, write_folder
from ferrolith.sources.resources import parse_resources


@query("join_09_funders", """select doc_id, 'f-' || lang as funder_id, case when doc_id % 2 = 0 then 'given' when lang in ('de', 'en') then 'r-' || lang else '' end as second_id, case when doc_id % 3 = 0 then 'a-' || lang end as affiliation_id from documents""")
def join_09(spark, sf_dir):
    """Funders and affiliations: sure matches, matches for review, and funders that have an identifier already."""
    k, lang = F.col("doc_id"), F.coalesce("lang", F.lit("none"))
    actor = lambda name, value: F.struct(F.lit("Organization").alias("kind"), name.alias("name"), *[F.lit("").alias(c) for c in ("given", "family", "email", "id_scheme")], value.alias("id_value"), F.lit("").alias("affiliation"))
    grant = lambda name, value: F.struct(F.lit("g").alias("name"), F.lit("").alias("identifier"), actor(F.concat(F.lit(name), lang), value).alias("funder"))
    docs = table(spark, sf_dir, "documents")
    records = records_of(docs).join(docs.select(F.col("doc_id").alias("d_id"), F.col("lang").alias("d_lang")), F.col("doc_id") == F.col("d_id"))
    lang = F.coalesce("d_lang", F.lit("none"))
    person = F.struct(F.lit("Person").alias("kind"), F.lit("Lee, Ann").alias("name"), F.lit("Ann").alias("given"), F.lit("Lee").alias("family"), *[F.lit("").alias(c) for c in ("email", "id_scheme", "id_value")], F.when(k % 3 == 0, F.concat(F.lit("Lab "), lang)).otherwise("").alias("affiliation"))
    records = records.withColumns({"funding": F.array(grant("Fund ", F.lit("")), grant("Office ", F.when(k % 2 == 0, "given").otherwise(""))), "creator": F.array(person)})
    langs = docs.select(F.coalesce("lang", F.lit("none")).alias("l")).distinct()
    entry = lambda name, value, status: langs.select(F.concat(F.lit(name), "l").alias("name"), F.lit("ROR").alias("scheme"), F.concat(F.lit(value), "l").alias("value"), status.alias("status"))
    found = entry("Fund ", "f-", F.lit("auto")).unionByName(entry("Office ", "r-", F.when(F.col("l").isin("de", "en"), "auto").otherwise("review"))).unionByName(entry("Lab ", "a-", F.lit("auto")))
    people = spark.createDataFrame([], "given string, family string, value string, status string")
    out = enrichment.enrich(records, found, people)
    return out.select("doc_id", F.col("funding")[0]["funder"]["id_value"].alias("funder_id"), F.col("funding")[1]["funder"]["id_value"].alias("second_id"), F.col("affiliation_ids")[0].alias("affiliation_id"))


@query("val_12_shapes", "select s_suppkey, s_suppkey % 7 in (1, 4) as has from supplier")
def val_12(spark, sf_dir):
    """Identifiers as an object, as a list, blank, empty, of another kind, and none."""
    one = lambda v: F.concat(F.lit('{"schema:value":"'), v, F.lit('"}'))
    k, name = F.col("s_suppkey"), F.col("s_name")
    shapes = [F.lit("[]"), one(name), one(F.lit("")), F.lit("[{},null]"), F.concat(F.lit('[3,'), one(name), F.lit("]")), F.concat(F.lit('"'), name, F.lit('"'))]
    entry = F.when(k % 7 == 6, "{}").otherwise(F.concat(F.lit('{"schema:identifier":'), F.element_at(F.array(*shapes), (F.least(k % 7, F.lit(5)) + 1).cast("int")), F.lit("}")))
    return table(spark, sf_dir, "supplier").select("s_suppkey", enrichment.entry_has_identifier(F.try_parse_json(entry)).alias("has"))


@query("src_09_first_hits", """select n_name as asked, 'name\\:' || n_name as query, s_suppkey, hit from (select s_nationkey, s_suppkey, row_number() over (partition by s_nationkey order by s_acctbal desc, s_suppkey) as hit from supplier) join nation on s_nationkey = n_nationkey where hit <= 5""")
def src_09(spark, sf_dir):
    """Searches with reserved characters, and the first five hits of each."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    hits = table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", F.struct((-F.col("s_acctbal")).alias("b"), "s_suppkey").alias("rank"))
    found = matching.first_hits(hits, "s_nationkey", "rank").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return found.select(F.col("n_name").alias("asked"), names.escape_query(F.concat(F.lit("name:"), "n_name")).alias("query"), "s_suppkey", "hit")


@query("agg_08_populated", """select doc_id, 'blank,' || case when doc_id % 2 = 0 then 'list,' else '' end || case when doc_id % 3 = 0 then 'object,' else '' end || 'number' || case when lang is null then '' else ',word' end as fields from documents""")
def agg_08(spark, sf_dir):
    """Which members of a document hold something."""
    k = F.col("doc_id")
    json = F.concat(F.lit('{"word":'), F.coalesce(F.concat(F.lit('"'), "lang", F.lit('"')), F.lit("null")), F.lit(',"number":0,"blank":"","list":'), F.when(k % 2 == 0, "[null]").otherwise("[]"), F.lit(',"object":'), F.when(k % 3 == 0, '{"a":null}').otherwise("{}"), F.lit("}"))
    found = validation.populated_fields(json)
    order = F.filter(F.array(*map(F.lit, ("blank", "list", "object", "number", "word"))), lambda f: F.array_contains(found, f))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(order, ",").alias("fields"))


@query("set_02_keys", """select s_suppkey, case s_suppkey % 4 when 0 then 'b' when 1 then '' when 2 then 'b' else 'a,b' end as missing, case s_suppkey % 4 when 0 then 'url' when 1 then 'c' else '' end as extra, case when s_suppkey % 4 = 0 then 'url' else '' end as disallowed from supplier""")
def set_02(spark, sf_dir):
    """Keys of an object against those declared: missing, extra and disallowed ones; a text that is no object lacks all."""
    json = F.element_at(F.array(*map(F.lit, ('{"a":1,"url":2}', '{"a":1,"b":null,"c":{"x":1}}', '{"a":[]}', "[1]"))), (F.col("s_suppkey") % 4 + 1).cast("int"))
    found = validation.key_differences(json, ["a", "b"], ["url"])
    return table(spark, sf_dir, "supplier").select("s_suppkey", *[F.array_join(found[c], ",").alias(c) for c in ("missing", "extra", "disallowed")])


@query("scl_13_context", """select doc_id, 'About ' || source || '.' || case when doc_id % 2 = 0 then chr(10) || chr(10) || 'name: ' || source || case when doc_id % 3 = 0 then chr(10) || 'lang: ' || lang else '' end else '' end
  || chr(10) || chr(10) || 'title: T' || doc_id || case when doc_id % 5 = 0 then '' else chr(10) || 'url: https://e.org' end || chr(10) || 'alpha: ' || n_chars || chr(10) || 'zeta: {source}' as prompt from documents""")
def scl_13_context(spark, sf_dir):
    """Prompts with what earlier results gave and with the resource, known members first; braces of values are not written out again."""
    k = F.col("doc_id")
    one = lambda f, v: F.struct(F.lit(f).alias("field"), v.alias("value"))
    context = F.when(k % 2 == 0, F.array(one("name", F.col("source")), one("none", F.lit("  ")), one("lang", F.when(k % 3 == 0, F.col("lang")))))
    resource = F.create_map(
        F.lit("zeta"), F.lit("{source}"), F.lit("url"), F.when(k % 5 == 0, " ").otherwise("https://e.org"), F.lit("alpha"), F.col("n_chars").cast("string"),
        F.lit("title"), F.concat(F.lit("T"), k), F.lit("doi"), F.lit(None).cast("string"),
    )
    return table(spark, sf_dir, "documents").select("doc_id", names.prompt(F.lit("About {source}."), {"source": F.col("source")}, context, resource).alias("prompt"))


@query("scl_38_entity", """select s_suppkey, unnest(case s_suppkey % 4 when 0 then ['DOI|10.5/x|', 'ISNI|1|https://isni.org/isni/1'] when 1 then ['ROR|r1|', 'ISNI|1|https://isni.org/isni/1']
  when 2 then ['ROR|r1|'] else ['ORCID|0-1|https://orcid.org/0-1/', '||https://example.org/a'] end) as identifier from supplier""")
def scl_38_entity(spark, sf_dir):
    """An entity's own identifier, the older list, and other addresses of known and unknown registries."""
    k = F.col("s_suppkey") % 4
    one = lambda s, v: F.struct(F.lit(s).alias("scheme"), F.lit(v).alias("value"), F.lit("").alias("url"))
    primary = F.when(k == 0, one("DOI", "10.5/x")).when(k == 1, one("ROR", "r1")).when(k == 2, one("", ""))
    legacy = F.when(k != 3, F.array(one("ROR", "r1"), one("ISNI", "")))
    others = F.when(k < 2, F.array(F.lit("https://isni.org/isni/1"), F.lit("https://isni.org/isni/1"))).when(k == 3, F.array(F.lit("https://orcid.org/0-1/"), F.lit(""), F.lit("https://example.org/a")))
    found = F.transform(identifiers.entity_identifiers(primary, legacy, others), lambda x: F.concat_ws("|", *[F.coalesce(x[c], F.lit("")) for c in ("scheme", "value", "url")]))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.explode(found).alias("identifier"))


@query("orc_01_fetched", """select page_id, case page_id % 5 when 0 then 'not JSON' end as error, case page_id % 5 when 1 then md5('given') when 2 then null when 0 then null else 'page' end as content from pages""")
def orc_01(spark, sf_dir):
    """A folder of resources, listed and read, with their pages' texts: broken files, content that is there, no address, a bare DOI, an address."""
    k = F.col("page_id")
    pages = table(spark, sf_dir, "pages").select("page_id", F.when(k % 5 == 3, F.concat(F.lit("https://doi.org/10.5555/p."), k)).otherwise(F.concat(F.lit("https://e.org/"), k)).alias("url"), "html")
    address = F.when(k % 5 == 3, F.concat(F.lit("10.5555/p."), k)).when(k % 5 != 2, F.col("url"))
    text = F.when(k % 5 == 0, "{").otherwise(F.to_json(F.struct(address.alias("url"), F.when(k % 5 == 1, "given").alias("fetched_content"))))
    folder = new_folder(spark, "resources")
    write_folder(pages.select(F.format_string("page-%d.json", k).alias("name"), text.alias("value")), folder, parts=parts_for(pages.count()))
    rows = with_pages(parse_resources(read_folder(spark, folder)), pages.select("url", "html"))
    number = F.regexp_extract("path", r"page-([0-9]+)\.json$", 1).cast("bigint")
    own = pages.select(F.col("page_id").alias("o_id"), main_text_digest(F.col("html")).alias("o_digest"))
    found = rows.select(number.alias("page_id"), "error", F.md5("fetched_content").alias("content")).join(own, F.col("page_id") == F.col("o_id"))
    return found.select("page_id", "error", F.when(F.col("content") == F.col("o_digest"), "page").otherwise(F.col("content")).alias("content"))


def main_text_digest(html):
    """What a page's text should be, by the page alone."""
    return F.md5(main_content(html))
