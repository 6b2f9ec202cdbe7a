"""Evaluation over documents, and values whose shape varies; JSON texts are made of the tables' own columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ferrolith.functions import shapes
from ferrolith.operators import evaluation as ev
from ferrolith.queries import query, table

_TYPES = """case p_partkey % 3 when 0 then '["schema:' || p_type || '"]' when 1 then '"dcat:' || p_type || '"' else '["", "x:", "a:b:' || p_name || '"]' end"""


@query("scl_12_type_label", "select p_partkey, case p_partkey % 3 when 2 then 'b:' || p_name else p_type end as label from part")
def scl_12(spark, sf_dir):
    v = F.try_parse_json(F.expr(_TYPES))
    return table(spark, sf_dir, "part").select("p_partkey", shapes.type_label(v).alias("label"))


_LISTS = """case p_partkey % 3 when 0 then '{"@list":["' || p_brand || '","' || p_name || '"]}' when 1 then '["' || p_name || '"]' else '{"other":"' || p_name || '"}' end"""


@query("scl_43_list_items", """select p_partkey, case p_partkey % 3 when 0 then 2 when 1 then 1 else 0 end as n, case p_partkey % 3 when 0 then p_brand || '|' || p_name when 1 then p_name else '' end as items from part""")
def scl_43(spark, sf_dir):
    items = F.transform(shapes.list_items(F.try_parse_json(F.expr(_LISTS))), lambda x: F.try_variant_get(x, "$", "string"))
    return table(spark, sf_dir, "part").select("p_partkey", F.size(items).alias("n"), F.concat_ws("|", items).alias("items"))


_SHAPES = """case p_partkey % 5 when 0 then '["", " ' || p_name || ' ", "second"]' when 1 then '{"k":"' || p_name || '"}' when 2 then '" ' || p_name || ' "' when 3 then '[]' else '[{"schema:name":"' || p_brand || '"}, " ' || p_name || ' ", 5]' end"""


@query("scl_46_shapes", """select p_partkey, case p_partkey % 5 when 3 then '' when 4 then '{"schema:name":"' || p_brand || '"}' else p_name end as text,
  case p_partkey % 5 when 0 then 2 when 2 then 1 else null end as strings,
  case p_partkey % 5 when 0 then '{"schema:name":"' || p_name || '"};{"schema:name":"second"}' when 1 then '{"k":"' || p_name || '"}' when 2 then '{"schema:name":"' || p_name || '"}'
    when 3 then '' else '{"schema:name":"' || p_brand || '"};{"schema:name":"' || p_name || '"}' end as objects,
  case p_partkey % 5 when 0 then '{}' when 1 then '{"k":"' || p_name || '"}' when 2 then '{"schema:name":"' || p_name || '"}' when 3 then '{}' else '{"schema:name":"' || p_brand || '"}' end as object from part""")
def scl_46(spark, sf_dir):
    v = F.try_parse_json(F.expr(_SHAPES))
    strings = F.when((F.col("p_partkey") % 5).isin(0, 2), F.size(shapes.as_strings(v)))
    return table(spark, sf_dir, "part").select("p_partkey", shapes.as_string(v).alias("text"), strings.alias("strings"), F.concat_ws(";", shapes.as_objects(v)).alias("objects"), shapes.as_object(v).alias("object"))


@query("scl_50_collapse", """select p_partkey, case p_partkey % 3 when 0 then null else 'DOI' end as scheme, case p_partkey % 3 when 2 then 'https://x/' || p_brand || ',' || p_name || case when p_partkey % 2 = 0 then '' else '' end
  when 1 then null else case when p_partkey % 2 = 0 then 'old' end end as same_as from part""")
def scl_50(spark, sf_dir):
    k, kind = F.col("p_partkey"), "array<struct<scheme:string,value:string,url:string>>"
    one = lambda scheme, value, url: F.struct(scheme.alias("scheme"), value.alias("value"), url.alias("url"))
    first = one(F.lit("DOI"), F.col("p_type"), F.lit(""))
    more = F.array(first, one(F.lit("URL"), F.col("p_brand"), F.concat(F.lit("https://x/"), "p_brand")), one(F.lit("ID"), F.col("p_name"), F.lit("")))
    identifiers = F.when(k % 3 == 0, F.array().cast(kind)).when(k % 3 == 1, F.array(first)).otherwise(more)
    same_as = F.when((k % 3 == 0) & (k % 2 == 0), F.array(F.lit("old"))).otherwise(F.array().cast("array<string>"))
    identifier, links = shapes.collapse_identifiers(identifiers, same_as)
    return table(spark, sf_dir, "part").select("p_partkey", identifier["scheme"].alias("scheme"), F.when(links.isNotNull(), F.concat_ws(",", links)).alias("same_as"))


_FILES = "case p_partkey % 3 when 0 then p_size || '.' || p_partkey || '. ' || p_name || '.json' when 1 then p_partkey || '.json' else p_name || '.json' end"


@query("scl_14_file_name", f"""with f as (select p_partkey, {_FILES} as name from part)
select p_partkey, nullif(regexp_extract(name, '^([0-9]+(?:\\.[0-9]+)*)\\.?\\s*(.*)\\.json$', 1), '') as id, case when regexp_matches(name, '^[0-9]') then regexp_extract(name, '^([0-9]+(?:\\.[0-9]+)*)\\.?\\s*(.*)\\.json$', 2) end as title from f""")
def scl_14(spark, sf_dir):
    number, title = shapes.id_and_title(F.expr(_FILES))
    return table(spark, sf_dir, "part").select("p_partkey", number.alias("id"), title.alias("title"))


@query("scl_57_total_tokens", "select o_orderkey, case when o_custkey % 3 = 0 then o_orderkey + o_custkey else o_custkey % 3 end as total from orders")
def scl_57(spark, sf_dir):
    reported = F.when(F.col("o_custkey") % 6 == 0, F.lit(None)).otherwise(F.col("o_custkey") % 3)
    return table(spark, sf_dir, "orders").select("o_orderkey", shapes.total_tokens(F.col("o_orderkey"), F.col("o_custkey"), reported).cast("bigint").alias("total"))


_TRUTH = """'{"roles":[{"type":"Creator","role_name":" Ann ' || s || ' ","name_identifiers":[{"name_identifier":"https://ror.org/' || s || '","name_identifier_scheme":"ROR"}]},{"type":"Contributor","role_name":"Bob ' || l || '","contributor_type":"Editor"},{"type":"Other","role_name":"x"}],"publishers":[{"publisher_name":"Office ' || l || '","publisher_identifier":"R' || l || '","publisher_identifier_scheme":"ror"},{"publisher_identifier":"1","publisher_identifier_scheme":"ISNI"}],"languages":[{"lang_code":"' || upper(l) || '"},{"lang_code":" "}],"rights":[{"rights_identifier":""},{"rights_identifier":"CC-' || s || '"}],"categories":[{"name":"C' || l || '","sub_category":"' || s || '"},{"name":""}],"geo_locations":[{"geo_location_place":" Place ' || l || '"}],"descriptions":[{"description":"first","description_type":"Other"},{"description":"about ' || s || '","description_type":"' || case when doc_id % 2 = 0 then ' ABSTRACT' else 'Methods' end || '"}],"titles":[{"name":"T' || doc_id || '"}],"resource":{"identifier":"https://d/' || doc_id || '"}}'"""
_NAMED = "select doc_id, coalesce(lang, 'xx') as l, coalesce(source, 'none') as s from documents"


def _truth(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("lang", F.lit("xx")).alias("l"), F.coalesce("source", F.lit("none")).alias("s"))
    return rows.withColumn("t", F.from_json(F.expr(_TRUTH), ev.TRUTH))


@query("scl_54_scoring_sets", f"""with d as ({_NAMED}) select doc_id, 'ann ' || lower(s) || '|bob ' || lower(l) as creators, 'ROR ' || lower(s) || '|ROR r' || lower(l) as rors, lower(l) as languages, 'cc-' || lower(s) as rights,
  'c' || lower(l) || '|' || lower(s) as categories, 'place ' || lower(l) as places from d""")
def scl_54(spark, sf_dir):
    sets = ev.scoring_sets(F.col("t"))
    joined = {"creators": "creators_name", "rors": "ror_match", "languages": "languages", "categories": "categories", "places": "geo_places"}
    return _truth(spark, sf_dir).select("doc_id", *[F.concat_ws("|", sets[c]).alias(n) for n, c in joined.items()], sets["rights"].alias("rights"))


@query("scl_56_adapted_roles", f"with d as ({_NAMED}) select doc_id, 2 as n, ' Ann ' || s || ' ' as first_name, 'Editor' as second_kind from d")
def scl_56(spark, sf_dir):
    creators = ev.adapted_creators(F.col("t")["roles"])
    return _truth(spark, sf_dir).select("doc_id", F.size(creators).alias("n"), F.get(creators, F.lit(0))["creator_name"].alias("first_name"), F.get(creators, F.lit(1))["contributor_type"].alias("second_kind"))


@query("scl_55_minimal_input", f"""with d as ({_NAMED}) select doc_id, 'https://d/' || doc_id as url, 'T' || doc_id as title, case when doc_id % 2 = 0 then 'about ' || s else 'first' end as description, 'Office ' || l as publisher, doc_id % 2 <> 0 as used_fallback from d""")
def scl_55(spark, sf_dir):
    return ev.minimal_inputs(_truth(spark, sf_dir), "doc_id", "t")


@query("agg_10_identifier_match", f"with d as ({_NAMED}) select doc_id, case when doc_id % 3 = 0 then 1.0 when doc_id % 3 = 1 then 0.5 else 0.0 end::double as score, 1.0::double as orcid from d")
def agg_10(spark, sf_dir):
    """Truth against an answer with all, half or none of its identifiers."""
    creators, publishers = ev.adapted_creators(F.col("t")["roles"]), F.col("t")["publishers"]
    truth = ev.identifier_set(creators, publishers, ["ROR"])
    k = F.col("doc_id") % 3
    actual = F.when(k == 0, truth).when(k == 1, F.slice(truth, 1, 1)).otherwise(F.array(F.lit("ROR other")))
    orcid = ev.identifier_set(creators, publishers, ["ORCID"])
    return _truth(spark, sf_dir).select("doc_id", ev.recall_or_absent(truth, actual).alias("score"), ev.recall_or_absent(orcid, orcid).alias("orcid"))


@query("join_14_truth", """select 'd' || doc_id || '.json' as file, case when doc_id % 5 = 0 then 'no ground truth' when doc_id % 7 = 0 then 'failed: ' || source when doc_id % 3 = 0 then 'empty output' end as error from documents""")
def join_14(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("file", F.concat(F.lit("d"), "doc_id", F.lit(".json")))
    outputs = d.select("file", F.when(F.col("doc_id") % 3 != 0, F.coalesce("text", F.lit(""))).alias("output"), F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("failed: "), "source")).alias("error"))
    truth = d.where(F.col("doc_id") % 5 != 0).select("file", F.coalesce("text", F.lit("")).alias("truth"))
    return ev.match_truth(outputs, truth, "file").select("file", "error")


_BOTH = """both_ as (select source, doc_id, (doc_id % 100) / 100.0 as overall, (n_chars % 100) / 100.0 as judge from documents where doc_id % 4 <> 0)"""


def _both(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    scores = d.select("source", "doc_id", ((F.col("doc_id") % 100) / 100.0).alias("overall"))
    judged = d.select("source", "doc_id", F.when(F.col("doc_id") % 4 != 0, (F.col("n_chars") % 100) / 100.0).alias("judge"))
    return ev.judged_and_scored(scores, judged, "source", "doc_id")


@query("join_15_judged", f"with {_BOTH} select source, doc_id, cast(overall as double) as overall, cast(judge as double) as judge, round(abs(overall - judge), 4)::double as difference from both_ where source is not null and judge is not null")
def join_15(spark, sf_dir):
    return _both(spark, sf_dir).withColumn("difference", F.round("difference", 4))


@query("win_09_disagreements", f"""with {_BOTH}, r as (select *, row_number() over (partition by source order by round(abs(overall - judge), 4) desc, doc_id desc) as place from both_ where source is not null and judge is not null) select source, doc_id, place from r where place <= 5""")
def win_09b(spark, sf_dir):
    rounded = _both(spark, sf_dir).withColumn("difference", F.round("difference", 4))
    return ev.disagreements(rounded, "source", "doc_id").select("source", "doc_id", F.col("place").cast("bigint").alias("place"))


@query("join_16_titles", "select doc_id, case when doc_id % 3 = 0 then 'Title of ' || source end as title from documents")
def join_16(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    manifest = d.where(F.col("doc_id") % 3 == 0).select(F.col("doc_id").alias("file"), F.concat(F.lit("Title of "), "source").alias("original"))
    return ev.with_titles(d.select("doc_id"), manifest, "doc_id", "file", "original")


@query("scl_48_ignored_fields", "select event_id, array_to_string(list_sort(list_filter(json_keys(props), lambda k: k <> 'page')), ',') as keys from events")
def scl_48(spark, sf_dir):
    kept = ev.without_ignored(F.col("props"), ["page"])
    return table(spark, sf_dir, "events").select("event_id", F.concat_ws(",", F.array_sort(F.json_object_keys(kept))).alias("keys"))


@query("agg_22_overlap", """with k as (select event_id, json_keys(props) as a, ['a', 'missing'] as e from events)
select event_id, round((0.5 * len(list_intersect(a, e)) + 0.3 * len(list_filter(a, lambda x: not list_contains(e, x)))) / len(list_distinct(list_concat(a, e))), 9)::double as score from k""")
def agg_22(spark, sf_dir):
    score = ev.overlap_score(F.col("props"), F.lit('{"a": 1, "missing": 2}'))
    return table(spark, sf_dir, "events").select("event_id", F.round(score.cast("double"), 9).alias("score"))
