"""The catalogue layouts over records that carry every part: roles, addresses of mail, methods, embargoes, further dates and languages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ferrolith.plans.crosswalks import croissant, datacite, dataverse, dataverse_json
from ferrolith.plans.schema import RECORD
from ferrolith.queries import query
from ferrolith.queries.crosswalk import _flat
from ferrolith.queries.documents import RECORD_SQL, records


def _rich(spark, sf_dir):
    """Records whose rarer parts follow from their numbers."""
    k = F.col("doc_id")
    number, blank = k.cast("string"), F.lit("")
    none = lambda c: F.array().cast(RECORD[c])
    some = lambda c, when, *items: F.when(when, F.array(*items).cast(RECORD[c])).otherwise(none(c))
    person = lambda first, email, scheme, value, office: F.struct(F.lit("Person"), F.concat(F.lit(first), number), blank, blank, email, scheme, value, office)
    plain = lambda first: person(first, blank, blank, blank, blank)
    role = lambda name, actor: F.struct(F.lit(name), actor)
    desk = person("Desk ", F.when(k % 4 == 0, "call us").otherwise(F.concat(F.lit("Mail: desk"), number, F.lit("@example.org; fax 1"))), blank, blank, blank)
    writer = person(
        "Writer ", F.when(k % 2 == 0, F.concat(F.lit("w"), number, F.lit("@example.org"))).otherwise(""),
        F.when(k % 5 == 0, "ORCID").when(k % 5 == 1, "House").otherwise(""), F.when(k % 5 < 2, "0000-0002-1825-0097").otherwise(""), F.when(k % 3 == 0, "Institute").otherwise(""),
    )
    parts = {
        "contributor": some("contributor", k % 3 != 2, role("ContactPerson", desk), role("Editor", plain("Ed ")), role("Editor", plain("Co-ed ")), role("Sponsor", plain("Sponsor "))),
        "creator": some("creator", k % 7 != 0, writer),
        "technique": some("technique", k % 2 == 0, F.lit("survey"), F.lit(""), F.lit("sensor")),
        "about": some("about", k % 4 == 0, F.struct(F.lit("Physics"), F.lit("areas"), blank), F.struct(blank, blank, blank)),
        "other_languages": some("other_languages", k % 6 == 0, F.lit("Deutsch"), F.lit("")),
        "temporal": some("temporal", k % 5 == 0, F.lit("2001/2002"), F.lit("2004")),
        "conditions": some("conditions", k % 4 == 1, F.struct(F.lit("on request"), blank), F.struct(F.lit("closed"), F.lit("2030-01-01"))),
        "date_accepted": F.when(k % 9 == 0, "2019-01-01").otherwise(""), "date_submitted": F.when(k % 9 == 1, "2018-01-01").otherwise(""),
        "copyright_year": F.when(k % 8 == 0, "2017").otherwise(""), "version": F.when(k % 2 == 1, "1.0").otherwise(""),
        "same_as": some("same_as", k % 5 == 1, F.struct(F.concat(F.lit("https://s.example.org/"), number), blank)),
        "date_modified": F.lit("2026-01-02"),
    }
    return records(spark, sf_dir).withColumns(parts)


@query("dc_03_methods", f"""with {RECORD_SQL} select k as doc_id, concat_ws(';', case when description <> '' then description || '|Abstract' end, case when k % 2 = 0 and not has_file then 'survey|Methods;sensor|Methods' end) as descriptions from rec""")
def dc_03(spark, sf_dir):
    """Techniques are methods only where no file carries them."""
    return datacite(_rich(spark, sf_dir)).select("doc_id", _flat("descriptions", "description", "type").alias("descriptions"))


@query("dc_04_languages", f"with {RECORD_SQL} select k as doc_id, concat_ws(';', nullif(lang, ''), case when k % 6 = 0 then 'de' end) as languages from rec")
def dc_04(spark, sf_dir):
    return datacite(_rich(spark, sf_dir)).select("doc_id", F.array_join("languages", ";").alias("languages"))


@query("dc_08_categories", f"with {RECORD_SQL} select k as doc_id, case when k % 4 = 0 then 'Physics|areas' else '' end as categories from rec")
def dc_08(spark, sf_dir):
    return datacite(_rich(spark, sf_dir)).select("doc_id", _flat("categories", "name", "sub_category").alias("categories"))


@query("dc_10_all_dates", f"""with {RECORD_SQL} select k as doc_id, concat_ws(';', case when created <> '' then created || '|Created|' end, case when published <> '' then published || '|Issued|' end, '2026-01-02|Updated|',
  case when k % 8 = 0 then '2017|Copyrighted|' end, case when k % 9 = 0 then '2019-01-01|Accepted|' end, case when k % 9 = 1 then '2018-01-01|Submitted|' end,
  case when k % 5 = 0 then '2001/2002|Collected|;2004|Collected|' end, case when k % 4 = 1 then '2030-01-01|Available|closed' end) as dates from rec""")
def dc_10_all(spark, sf_dir):
    return datacite(_rich(spark, sf_dir)).select("doc_id", _flat("dates", "date", "type", "information").alias("dates"))


@query("agg_06_slots", f"""with {RECORD_SQL} select k as doc_id, case when k % 3 = 2 then '' when k % 4 = 0 then 'Desk ' || k || ' (call us)' else 'Desk ' || k || ' (Mail: desk' || k || '@example.org; fax 1)' end as contact,
  case when k % 3 = 2 then '' else 'Ed ' || k end as editor, '' as producer, case when k % 3 = 2 then '' else 'editor: Co-ed ' || k end as warnings,
  concat_ws(';', case when k % 7 <> 0 then 'Creator|Writer ' || k end, case when k % 3 <> 2 then 'Sponsor|Sponsor ' || k end) as credits from rec""")
def agg_06(spark, sf_dir):
    """The first contributor of a role takes its slot, the others are named in a warning, other roles become creators."""
    d = datacite(_rich(spark, sf_dir))
    return d.select("doc_id", "resource.contact", "resource.editor", "resource.producer", F.array_join("warnings", ";").alias("warnings"), _flat("creators", "role", "name").alias("credits"))


@query("scl_11_sizes", f"with {RECORD_SQL} select k as doc_id, case when has_file then length(text) / 1000.0 end as size, case when has_file then ' kB' end as unit from rec")
def scl_11(spark, sf_dir):
    """Size and unit of the first file, out of the written size: Spark and SQL write doubles differently."""
    size = F.get("media_files", F.lit(0))["size"]
    return datacite(_rich(spark, sf_dir)).select("doc_id", F.regexp_extract(size, "^([^ ]+)", 1).cast("double").alias("size"), F.regexp_extract(size, "( .*)$", 1).alias("unit"))


@query("cr_06_agents", f"""with {RECORD_SQL} select k as doc_id, case when k % 7 <> 0 then 'sc:Person|Writer ' || k || '|' || case when k % 5 = 0 then 'https://orcid.org/0000-0002-1825-0097' else '' end end as creator, 'sc:Organization' || '|' || publisher || '|' as publisher from rec""")
def cr_06(spark, sf_dir):
    c = croissant(_rich(spark, sf_dir))
    publisher = F.when(F.col("publisher").isNotNull(), _flat(F.array("publisher"), "type", "name", "url"))
    return c.select("doc_id", _flat("creator", "type", "name", "url").alias("creator"), publisher.alias("publisher"))


@query("cr_09_rest", f"""with {RECORD_SQL} select k as doc_id, case when not no_keywords then source || ';' || lang end as keywords, case when k % 5 = 1 then 'https://s.example.org/' || k end as same_as, case when k % 2 = 1 then '1.0' end as version,
  nullif(created, '') as date_created, '2026-01-02' as date_modified, nullif(lang, '') as in_language, case when has_file then md5(text) end as checksum from rec""")
def cr_09(spark, sf_dir):
    c = croissant(_rich(spark, sf_dir))
    return c.select("doc_id", F.array_join("keywords", ";").alias("keywords"), F.array_join("same_as", ";").alias("same_as"), "version", "date_created", "date_modified", "in_language", F.get("distribution", F.lit(0))["checksum"].alias("checksum"))


_CITATION = """case when k % 7 = 0 then 'Unknown' else 'Writer ' || k end as author, case when k % 7 <> 0 and k % 3 = 0 then 'Institute' end as affiliation, case when k % 7 <> 0 and k % 5 = 0 then '0000-0002-1825-0097' end as orcid,
  case when k % 3 <> 2 and k % 4 <> 0 then 'desk' || k || '@example.org' when k % 7 <> 0 and k % 2 = 0 then 'w' || k || '@example.org' else 'unknown@example.org' end as mail,
  case when k % 3 <> 2 and k % 4 <> 0 then 'Desk ' || k when k % 7 <> 0 then 'Writer ' || k else 'Unknown' end as contact,
  case when k % 2 = 0 then 'Physics' else 'Other' end as subject, case when name <> '' then name when doi <> '' then doi else 'Untitled resource' end as title,
  case when description <> '' then description else 'No description was extracted for this resource.' end as about, case when url <> '' then url when doi <> '' then 'https://doi.org/' || doi end as address"""


def _citation(spark, sf_dir):
    """Citation blocks; a classifier's answers come as a column, some of them outside the vocabulary."""
    k = F.col("doc_id")
    return dataverse(_rich(spark, sf_dir), F.when(k % 2 == 0, "Physics").when(k % 4 == 1, "Alchemy"))


@query("dv_04_contact", f"""with {RECORD_SQL} , c as (select *, {_CITATION} from rec) select k as doc_id, author || '|' || coalesce(affiliation, '') || '|' || case when orcid is null then '' else 'ORCID' end || '|' || coalesce(orcid, '') as authors, contact as contact_name, mail as contact_email, subject, about as ds_description,
  concat_ws(',', case when name = '' then 'title' end, case when k % 7 = 0 then 'author' end, case when mail = 'unknown@example.org' then 'contact' end, case when description = '' then 'description' end) as warnings from c""")
def dv_04(spark, sf_dir):
    d = _citation(spark, sf_dir)
    authors = _flat("author", "author_name", "affiliation", "identifier_scheme", "identifier")
    return d.select("doc_id", authors.alias("authors"), "contact_name", "contact_email", F.array_join("subject", ";").alias("subject"), "ds_description", F.array_join("warnings", ",").alias("warnings"))


def _sql_field(name, value, kind="primitive"):
    """SQL for one field of the citation block as JSON text."""
    return f"""'{{"value":' || to_json({value}) || ',"typeClass":"{kind}","multiple":false,"typeName":"{name}"}}'"""


def _sql_several(name, inner, kind="compound"):
    return f"""'{{"value":[' || {inner} || '],"typeClass":"{kind}","multiple":true,"typeName":"{name}"}}'"""


_AUTHOR = f"""'{{"authorName":' || {_sql_field("authorName", "author")} || case when affiliation is not null then ',"authorAffiliation":' || {_sql_field("authorAffiliation", "affiliation")} else '' end
  || case when orcid is not null then ',"authorIdentifierScheme":' || {_sql_field("authorIdentifierScheme", "'ORCID'", "controlledVocabulary")} || ',"authorIdentifier":' || {_sql_field("authorIdentifier", "orcid")} else '' end || '}}'"""
_CONTACT = f"""'{{"datasetContactName":' || {_sql_field("datasetContactName", "contact")} || ',"datasetContactEmail":' || {_sql_field("datasetContactEmail", "mail")} || '}}'"""
_ABOUT = f"""'{{"dsDescriptionValue":' || {_sql_field("dsDescriptionValue", "about")} || '}}'"""
_WORDS = f"""'{{"keywordValue":' || {_sql_field("keywordValue", "source")} || '}},{{"keywordValue":' || {_sql_field("keywordValue", "lang")} || '}}'"""
_LICENSE = '{"name":"CC0 1.0","uri":"http://creativecommons.org/publicdomain/zero/1.0"}'


@query("dv_08_dataset_json", f"""with {RECORD_SQL} , c as (select *, {_CITATION} from rec) select k as doc_id, '{{"datasetVersion":{{"license":{_LICENSE},"metadataBlocks":{{"citation":{{"fields":['
  || concat_ws(',', {_sql_field("title", "title")}, {_sql_several("author", _AUTHOR)}, {_sql_several("datasetContact", _CONTACT)}, {_sql_several("dsDescription", _ABOUT)},
     {_sql_several("subject", "to_json(subject)", "controlledVocabulary")}, case when not no_keywords then {_sql_several("keyword", _WORDS)} end, case when address is not null then {_sql_field("alternativeURL", "address")} end)
  || '],"displayName":"Citation Metadata"}}}}}}}}' as json from c""")
def dv_08(spark, sf_dir):
    return dataverse_json(_citation(spark, sf_dir))
