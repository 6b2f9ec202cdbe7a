"""The rarer parts of the DataCite layout, and checks of truth records."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

from ferrolith.operators.storage import new_folder
from ferrolith.operators.truth import REQUIRED, folder_problems, truth_problems
from ferrolith.plans import members
from ferrolith.plans.crosswalks import datacite
from ferrolith.plans.schema import RECORD
from ferrolith.queries import query, table
from ferrolith.queries.crosswalk import _flat
from ferrolith.queries.documents import records
from ferrolith.sources import registries
from ferrolith.sources.files import parts_for, read_folder, write_folder


def _full(spark, sf_dir):
    """Records with the parts that the rule-based extractor leaves empty, in the DataCite layout."""
    k = F.col("doc_id")
    number, none = k.cast("string"), lambda c: F.array().cast(RECORD[c])
    url = lambda host: F.concat(F.lit(f"https://{host}.example.org/"), number)
    text, blank = F.lit, F.lit("")
    fund = F.struct(text("Organization"), text("Fund"), blank, blank, blank, blank, blank, blank)
    parts = {
        "audience": F.when(k % 3 == 0, F.array(F.struct(text("Researchers"), blank, blank, blank), F.struct(blank, blank, blank, blank)).cast(RECORD["audience"])).otherwise(none("audience")),
        "periodicity": F.when(k % 4 == 1, "Monthly").when(k % 4 == 2, " now and then ").when(k % 4 == 3, "Diario").otherwise(""),
        "spatial": F.when(k % 2 == 0, F.array(F.struct(F.concat(text("Place "), number), text("a place"), text("1,2,3,4"))).cast(RECORD["spatial"])).otherwise(none("spatial")),
        "funding": F.when(k % 5 == 0, F.array(F.struct(F.concat(text("Award "), number), F.concat(text("A-"), number), fund)).cast(RECORD["funding"])).otherwise(none("funding")),
        "related": F.when(k % 3 == 1, F.array(F.struct(text("References"), url("r"), blank), F.struct(text("Thumbnail"), url("t"), blank)).cast(RECORD["related"])).otherwise(none("related")),
        "derived_from": F.when(k % 4 == 1, F.array(F.struct(text("d"), url("d"))).cast(RECORD["derived_from"])).otherwise(none("derived_from")),
        "same_as": F.when(k % 5 == 1, F.array(F.struct(url("s"), blank), F.struct(F.concat(text("local-"), number), blank)).cast(RECORD["same_as"])).when(k % 5 == 2, F.array(F.struct(blank, blank)).cast(RECORD["same_as"])).otherwise(none("same_as")),
        "citation": F.when(k % 6 == 0, F.array(F.concat(text("Paper "), number))).otherwise(none("citation")),
    }
    return datacite(records(spark, sf_dir).withColumns(parts))


@query("dc_09_audiences", "select doc_id, case when doc_id % 3 = 0 then 'Researchers' else '' end as audiences from documents")
def dc_09(spark, sf_dir):
    return _full(spark, sf_dir).select("doc_id", _flat("audiences", "audience").alias("audiences"))


@query("dc_11_temporal", "select doc_id, case doc_id % 4 when 1 then 'monthly|' when 2 then '|now and then' when 3 then 'daily|' else '' end as events from documents")
def dc_11(spark, sf_dir):
    return _full(spark, sf_dir).select("doc_id", _flat("temporal_events", "frequency_type", "description").alias("events"))


@query("dc_12_places", "select doc_id, case when doc_id % 2 = 0 then 'Place ' || doc_id || '|a place|1,2,3,4' else '' end as places from documents")
def dc_12(spark, sf_dir):
    return _full(spark, sf_dir).select("doc_id", _flat("geo_locations", "place", "description", "box").alias("places"))


@query("dc_14_funding", "select doc_id, case when doc_id % 5 = 0 then 'Fund|Award ' || doc_id || '|A-' || doc_id else '' end as funding from documents")
def dc_14(spark, sf_dir):
    return _full(spark, sf_dir).select("doc_id", _flat("funding_references", "funder", "award", "award_number").alias("funding"))


@query("dc_15_related", """select doc_id, concat_ws(';', case when doc_id % 3 = 1 then 'https://r.example.org/' || doc_id || '|References' end, case when doc_id % 4 = 1 then 'https://d.example.org/' || doc_id || '|IsDerivedFrom' end) as related from documents""")
def dc_15(spark, sf_dir):
    return _full(spark, sf_dir).select("doc_id", _flat("related_identifiers", "identifier", "relation").alias("related"))


@query("dc_16_alternates", """select doc_id, case when doc_id % 5 = 1 then 'https://s.example.org/' || doc_id || '|URL;local-' || doc_id || '|Local' else '' end as alternates from documents""")
def dc_16(spark, sf_dir):
    return _full(spark, sf_dir).select("doc_id", _flat("alternate_identifiers", "identifier", "type").alias("alternates"))


@query("dc_17_citations", "select doc_id, case when doc_id % 6 = 0 then 'Paper ' || doc_id else '' end as citations from documents")
def dc_17(spark, sf_dir):
    return _full(spark, sf_dir).select("doc_id", _flat("citations", "title").alias("citations"))


_REST = ",".join(f'"{k}":[]' for k in REQUIRED if k not in ("roles", "publishers", "titles"))
_TRUTH = f"""concat('{{{_REST},', if(doc_id % 7 = 0, '', '"titles":[],'),
  '"roles":[{{"name_identifiers":[{{"name_identifier_scheme":"ORCID","name_identifier":"', if(doc_id % 3 = 0, '0000-0002-1825-0097', 'Ann'), '","scheme_uri":"https://orcid.org', if(doc_id % 4 = 0, '/123456', ''), '"}}],',
  '"affiliations":[{{"affiliation_identifier_scheme":"ISNI","affiliation_identifier":"0000 0001 2146 438', if(doc_id % 2 = 0, 'X', '1'), '"}}]}}],',
  '"publishers":[{{"publisher_identifier":"', if(doc_id % 5 = 0, 'Q1","publisher_identifier_scheme":"Wikidata","publisher_scheme_uri":"https://w.example.org/9999999', '02ap3w078","publisher_identifier_scheme":"ROR'), '"}}],',
  '"rights":[{{"rights_identifier":"', case doc_id % 6 when 0 then 'cc-by-4.0' when 1 then 'ODbL-1.0' else 'CC-BY-4.0' end, '"}}]}}')"""


@query("val_13_ground_truth", """select doc_id, '' as location, 'missing: titles' as problem, false as warning from documents where doc_id % 7 = 0
union all select doc_id, 'roles[0].name_identifiers[0]', 'not the form of ORCID', false from documents where doc_id % 3 <> 0
union all select doc_id, 'roles[0].name_identifiers[0]', 'identifier in scheme address', false from documents where doc_id % 4 = 0
union all select doc_id, 'roles[0].affiliations[0]', 'check digit of ISNI', false from documents where doc_id % 2 = 1
union all select doc_id, 'publishers[0]', 'identifier in scheme address', false from documents where doc_id % 5 = 0
union all select doc_id, 'rights[0]', 'case of CC-BY-4.0', true from documents where doc_id % 6 = 0""")
def val_13(spark, sf_dir):
    return truth_problems(table(spark, sf_dir, "documents").select("doc_id", F.expr(_TRUTH).alias("truth")), "doc_id", "truth")


@query("src_19_folder", """with f as (select doc_id, 'truth-' || doc_id || '.json' as name from documents)
select name, '' as location, case doc_id % 9 when 0 then 'not JSON' else 'not an object' end as problem from f where doc_id % 9 < 2
union all select name, '', 'missing: titles' from f where doc_id % 9 > 1 and doc_id % 7 = 0
union all select name, 'roles[0].name_identifiers[0]', 'not the form of ORCID' from f where doc_id % 9 > 1 and doc_id % 3 <> 0
union all select name, 'roles[0].name_identifiers[0]', 'identifier in scheme address' from f where doc_id % 9 > 1 and doc_id % 4 = 0
union all select name, 'roles[0].affiliations[0]', 'check digit of ISNI' from f where doc_id % 9 > 1 and doc_id % 2 = 1
union all select name, 'publishers[0]', 'identifier in scheme address' from f where doc_id % 9 > 1 and doc_id % 5 = 0
union all select name, 'rights[0]', 'case of CC-BY-4.0' from f where doc_id % 9 > 1 and doc_id % 6 = 0""")
def src_19(spark, sf_dir):
    """A folder of truth files, some broken and some without an object, written and scanned."""
    k = F.col("doc_id")
    text = F.when(k % 9 == 0, '{"titles": [').when(k % 9 == 1, "[]").otherwise(F.expr(_TRUTH))
    folder, documents = new_folder(spark, "truth"), table(spark, sf_dir, "documents")
    write_folder(documents.select(F.format_string("truth-%d.json", k).alias("name"), text.alias("value")), folder, parts=parts_for(documents.count()))
    found = folder_problems(read_folder(spark, folder))
    return found.select(F.substring_index("path", "/", -1).alias("name"), "location", "problem")


_MEDIA_SQL = """with r as (select n_nationkey as k, lower(r_name) as registry, replace(lower(n_name), ' ', '-') as name from nation join region on n_regionkey = r_regionkey)
select k, registry, case when k % 4 = 0 then 'json' else name end as name, case when k % 3 = 0 then registry || '/vnd.' || name when k % 4 = 0 then registry || '/json' else registry || '/' || name end as template,
  case k % 5 when 0 then 'RFC12; Ann Lee' when 1 then 'https://e.org/x' when 2 then 'draft-1; RFC Errata 7' when 3 then 'Registry: r' else '' end as reference from r"""


@query("src_14_registry", f"""with m as ({_MEDIA_SQL}), s as (select split_part(template, '/', 2) as short, min(template) as template from (select distinct template from m) group by 1 having count(*) = 1)
select m.k as k, registry, name, m.template as template, reference, short from m left join s on m.template = s.template""")
def src_14(spark, sf_dir):
    """A registry's XML with registries inside: templates, records without one, references of every kind, short names of one template alone."""
    k = F.col("k")
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = rows.select(F.col("n_nationkey").alias("k"), F.lower("r_name").alias("registry"), F.replace(F.lower("n_name"), F.lit(" "), F.lit("-")).alias("own"))
    ref = lambda kind, data, text="": f'<xref type="{kind}" data="{data}">{text}</xref>'
    refs = F.element_at(F.array(*map(F.lit, (ref("rfc", "rfc12") + ref("person", "Ann_Lee"), ref("uri", "u", "https://e.org/x"), ref("draft", "RFC-draft-1") + ref("rfc-errata", "7"), ref("registry", "r"), ""))), (k % 5 + 1).cast("int"))
    file = F.when(k % 3 == 0, F.concat(F.lit('<file type="other">x</file><file type="template">'), "registry", F.lit("/vnd."), "own", F.lit("</file>"))).otherwise("")
    record = F.concat(F.lit("<record><name> "), F.when(k % 4 == 0, "json").otherwise(F.col("own")), F.lit(" </name>"), file, refs, F.lit("</record><record><title>no name</title></record>"))
    inner = F.concat(F.lit('<registry xmlns="http://www.iana.org/assignments" id="all"><title>Media</title><registry id="'), "registry", F.lit('">'), record, F.lit("</registry></registry>"))
    found = registries.registry_records(rows.select("k", inner.alias("xml")), "k", "xml")
    short = registries.unambiguous_names(found).select("short", F.col("template").alias("s_template"))
    return found.join(short, F.col("template") == F.col("s_template"), "left").drop("s_template")


@query("dc_19_members", """with t as (select doc_id as k, source, lang from documents)
select k, '{"titles":[' || case when k % 3 = 0 then '' else '{"title":"' || source || '"}' || case when k % 2 = 0 then ',' else '' end end || case when k % 2 = 0 then '{' || case when k % 5 = 0 then '' else '"title":"second",' end || '"lang":"' || lang || '"}' else '' end || '],"publisher":{"name":"'
  || case when k % 4 = 0 then 'second' else 'first' end || '"' || case when k % 7 = 0 then ',"place":{"city":"b"}' else ',"place":{"city":"a","country":"c"}' end || '},"version":"' || case when k % 2 = 0 then '2' else '1' end || '"' || case when k % 2 = 0 then ',"year":2020' else '' end || ',"extra":' || k || '}' as document,
  concat_ws(',', case when k % 3 = 0 and k % 2 = 1 then 'titles' end, case when k % 2 = 0 and k % 5 = 0 then case when k % 3 = 0 then 'titles[0].title' else 'titles[1].title' end end, case when k % 7 = 0 then 'publisher.place.country' end, case when k % 2 = 1 then 'year' end) as missing from t""")
def dc_19(spark, sf_dir):
    """Two partial exports merged, put in the model's order and checked for required members, with nulls at two depths."""
    k = F.col("doc_id")
    title = lambda t, l: F.struct(l.alias("lang"), t.alias("title"))
    null = F.lit(None).cast("string")
    none = F.array().cast("array<struct<lang:string,title:string>>")
    place = F.when(k % 7 != 0, F.struct(F.lit("c").alias("country"), F.lit("a").alias("city")))
    one = F.struct(
        F.lit("1").alias("version"), F.struct(place.alias("place"), F.when(k % 4 == 0, "").otherwise("first").alias("name")).alias("publisher"),
        F.when(k % 3 == 0, none).otherwise(F.array(title(F.col("source"), null))).alias("titles"), F.lit(None).cast("int").alias("year"), k.alias("extra"),
    )
    other_place = F.struct(null.alias("country"), F.lit("b").alias("city"))
    two = F.when(k % 2 == 0, F.struct(
        F.lit("2").alias("version"), F.struct(other_place.alias("place"), F.lit("second").alias("name")).alias("publisher"),
        F.array(title(F.when(k % 5 != 0, "second"), F.col("lang"))).alias("titles"), F.lit(2020).alias("year"), k.alias("extra"),
    )).otherwise(F.struct(null.alias("version"), F.struct(other_place.alias("place"), F.when(k % 4 == 0, "second").alias("name")).alias("publisher"), F.lit(None).cast("array<struct<lang:string,title:string>>").alias("titles"), F.lit(None).cast("int").alias("year"), F.lit(None).cast("bigint").alias("extra")))
    rows = table(spark, sf_dir, "documents").select("doc_id", one.alias("one"), two.alias("two"))
    kind = rows.schema["one"].dataType
    whole = rows.select(k.alias("k"), members.merged(F.col("one"), F.col("two"), kind).alias("d"))
    out = whole.select("k", members.ordered(F.col("d"), kind, _parse_datatype_string(_EXPORT)).alias("d"))
    required = {"titles", "titles[].title", "publisher.name", "publisher.place.country", "year"}
    return out.select("k", F.to_json("d").alias("document"), F.concat_ws(",", members.missing_members(F.col("d"), out.schema["d"].dataType, required)).alias("missing"))


#: An export model: its members in their order.
_EXPORT = "titles array<struct<title:string,lang:string>>, publisher struct<name:string,place:struct<city:string,country:string>>, version string, year int"
