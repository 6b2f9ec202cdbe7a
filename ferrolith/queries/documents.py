"""Records: fallbacks, envelope, required parts, shapes and identifiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ferrolith.operators import validation
from ferrolith.plans import document, shapes
from ferrolith.plans.records import records_of
from ferrolith.queries import query, table

TODAY = "2026-01-02"

#: The extractor's rules once more, in SQL.
RECORD_SQL = """rec as (select doc_id as k, source, lang, case when doc_id % 11 = 0 then '' else 'Record ' || doc_id end as name, case when doc_id % 7 = 0 then '' else text end as description,
  case when doc_id % 5 = 0 then '' else 'https://data.example.org/' || source || '/' || doc_id end as url, case when doc_id % 3 = 0 then '10.5555/rec.' || doc_id else '' end as doi, doc_id % 4 as lic,
  doc_id % 6 = 0 as no_creator, doc_id % 4 = 1 as two, doc_id % 3 = 1 as has_file, case when doc_id % 20 = 0 then '' else (1990 + doc_id % 30) || '-01-02' end as created, case when doc_id % 10 = 0 then '' else (2000 + doc_id % 25) || '-05' end as published,
  doc_id % 8 = 0 as no_keywords, case when doc_id % 9 <> 0 then 'Data Office ' || source end as publisher, text from documents)"""


def records(spark, sf_dir):
    return records_of(table(spark, sf_dir, "documents"))


@query("scl_53_cascade", f"""with {RECORD_SQL}, f as (select *, coalesce(publisher, case when k % 2 = 0 then 'Office of ' || lang end) as pub from rec)
select k as doc_id, case when url = '' then 'https://example.org/' || k else url end as url, pub as publisher, case when no_creator and pub is not null then pub when no_creator then '' else 'Ann ' || source end as creator, case when pub is not null then pub else '' end as holder from f""")
def scl_53(spark, sf_dir):
    k = F.col("doc_id")
    docs = records(spark, sf_dir).join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("d"), "lang"), k == F.col("d"))
    filled = document.fill_blanks(docs, F.concat(F.lit("https://example.org/"), k), F.when(k % 2 == 0, F.concat(F.lit("Office of "), "lang", F.lit(" (Chile)"))))
    return filled.select("doc_id", "url", F.col("publisher.name").alias("publisher"), F.coalesce(F.get("creator", F.lit(0))["name"], F.lit("")).alias("creator"), F.col("copyright_holder").alias("holder"))


@query("scl_51_envelope", f"""with {RECORD_SQL} select k as doc_id, case when doi <> '' then 'https://doi.org/' || doi else 'urn:ferrolith:' || sha256(k::varchar) end as id, '{TODAY}' as date_modified, case when doi <> '' then 'https://doi.org/' || doi else 'urn:ferrolith:' || sha256(k::varchar) end || '#metadata' as entry, 2 as profiles from rec""")
def scl_51(spark, sf_dir):
    e = document.envelope(records(spark, sf_dir), TODAY)
    return e.select("doc_id", "id", "date_modified", F.col("subject_of.id").alias("entry"), F.size("subject_of.conforms_to").alias("profiles"))


@query("val_04_required", f"""with {RECORD_SQL} select k as doc_id, concat_ws(', ', case when name = '' then 'name' end, case when doi = '' then 'identifier' end, case when lic = 0 then 'license or conditions' end, case when url = '' and not has_file then 'url or distribution' end) as missing from rec""")
def val_04(spark, sf_dir):
    e = document.envelope(records(spark, sf_dir), TODAY)
    return e.select("doc_id", F.concat_ws(", ", document.required_missing()).alias("missing"))


@query("val_06_shapes", f"""with {RECORD_SQL}, b as (select unnest([case when name = '' then 'nameProperty|Violation' end, case when doi = '' then 'resourceIdentifierProperty|Violation' end, case when lic = 0 then 'rightsProperty|Violation' end, case when url = '' and not has_file then 'accessProperty|Violation' end,
  case when not no_keywords then 'termLabelProperty|Violation' end, case when description = '' then 'descriptionProperty|Warning' end, case when no_creator then 'creatorProperty|Warning' end, case when no_keywords then 'keywordsProperty|Warning' end]) as s, k from rec)
select k as doc_id, string_split(s, '|')[1] as shape, string_split(s, '|')[2] as severity from b where s is not null""")
def val_06(spark, sf_dir):
    return document.shape_results(document.envelope(records(spark, sf_dir), TODAY))


@query("val_14_publishable", f"""with {RECORD_SQL}, c as (select k, unnest([{{'c': 'name', 's': case when name = '' then 'FAIL' else 'PASS' end}}, {{'c': 'creators', 's': case when no_creator then 'FAIL' else 'PASS' end}}, {{'c': 'dates', 's': case when created = '' and published = '' then 'WARN' else 'PASS' end}},
  {{'c': 'year', 's': case when published = '' then 'WARN' else 'PASS' end}}, {{'c': 'kind', 's': 'PASS'}}, {{'c': 'abstract', 's': case when length(regexp_replace(description, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')) < 30 then 'FAIL' else 'PASS' end}}, {{'c': 'keywords', 's': case when no_keywords then 'WARN' else 'PASS' end}}]) as x from rec)
select x.c as "check", x.s as status, count(*) as n from c group by 1, 2""")
def val_14(spark, sf_dir):
    r = records(spark, sf_dir)
    flat = r.select("doc_id", "name", F.size("creator").alias("creators"), ((F.col("date_created") != "").cast("int") + (F.col("date_published") != "").cast("int")).alias("dates"), F.substring("date_published", 1, 4).alias("year"), "kind", F.col("description").alias("abstract"), F.size("keywords").alias("keywords"))
    return validation.publishable_checks(flat).groupBy("check", "status").agg(F.count(F.lit(1)).alias("n"))


@query("scl_41_pids", f"""with {RECORD_SQL} select k as doc_id, 'DOI' as scheme, doi as value, 'identifier' as location from rec where doi <> '' union all select k, 'ORCID', '0000-0002-1825-0097', 'creator[0]' from rec where k % 2 = 0 and not no_creator""")
def scl_41(spark, sf_dir):
    return document.pids_of(records(spark, sf_dir))


@query("val_10_pid_problems", f"""with {RECORD_SQL} select scheme, problem, count(*) as n from (select 'DOI' as scheme, case when k % 6 = 0 then 'DOI does not resolve at identifier' end as problem from rec where doi <> '' union all select 'ORCID', null from rec where k % 2 = 0 and not no_creator) group by 1, 2""")
def val_10(spark, sf_dir):
    pids = document.pids_of(records(spark, sf_dir))
    statuses = table(spark, sf_dir, "documents").where("doc_id % 6 = 0").select(F.concat(F.lit("10.5555/rec."), "doc_id").alias("value"), F.lit(False).alias("resolved"))
    return validation.pid_problems(pids, statuses).groupBy("scheme", "problem").agg(F.count(F.lit(1)).alias("n"))


@query("join_10_doi_backfill", f"""with {RECORD_SQL} select k as doc_id, case when name = '' and doi <> '' then 'Work ' || k else name end as name, case when not no_creator then 'Ann ' || source when doi <> '' then 'Author ' || lang else '' end as creator, case when published = '' and doi <> '' then '1999' else published end as published from rec""")
def join_10_doi(spark, sf_dir):
    works = table(spark, sf_dir, "documents").select(F.upper(F.concat(F.lit("10.5555/rec."), "doc_id")).alias("doi"), F.concat(F.lit("Work "), "doc_id").alias("title"), F.array(F.concat(F.lit("Author "), "lang")).alias("authors"), F.lit("P").alias("publisher"), F.lit("1999").alias("issued"))
    b = document.backfill(records(spark, sf_dir), works)
    return b.select("doc_id", "name", F.coalesce(F.get("creator", F.lit(0))["name"], F.lit("")).alias("creator"), F.col("date_published").alias("published"))


_LINKED = """concat('{"@id":"d', doc_id, '","@type":["schema:Dataset"],"schema:identifier":', case when doc_id % 2 = 0 then '{"@type":"schema:PropertyValue","schema:value":""}' else '"10.5/x"' end,
  case when doc_id % 3 = 0 then '' else concat(',"schema:name":"', source, '"') end, case when doc_id % 5 = 0 then ',"schema:license":{"@type":"schema:CreativeWork","schema:url":"no address"}' when doc_id % 5 = 1 then '' else ',"schema:license":"CC0"' end,
  ',"schema:dateModified":"', case when doc_id % 7 = 0 then '2026' else '2026-01-31' end, '","schema:url":"https://e.org/","schema:creator":{"@id":"p1"},"schema:datePublished":"2025-03","schema:keywords":["ab",',
  case when doc_id % 4 = 0 then '"a, b"' else '{"@type":"schema:DefinedTerm","schema:name":"a"}' end, '],"schema:variableMeasured":[{"@type":"schema:PropertyValue","schema:propertyID":"depth of water","schema:description":"depth of the water","schema:name":"', case when doc_id % 11 = 0 then 'I0' else 'depth' end,
  '","schema:minValue":', case when doc_id % 13 = 0 then '"0"' else '0' end, '}],"schema:spatialCoverage":{"@type":"schema:Place","schema:geo":{"@type":"schema:GeoCoordinates","schema:latitude":1.5', case when doc_id % 17 = 0 then '' else ',"schema:longitude":2' end, '}}',
  case when doc_id % 19 = 0 then ',"schema:citation":"x"' else '' end, ',"schema:subjectOf":{"@id":"r', doc_id, '","@type":"schema:Dataset","schema:additionalType":"dcat:CatalogRecord","schema:about":{"@id":"d', doc_id,
  '"},"dcterms:conformsTo":[{"@id":"https://w3id.org/cdif/core/1.0"}', case when doc_id % 6 = 0 then '' else ',{"@id":"https://w3id.org/cdif/discovery/1.0"}' end, ']}', case when doc_id % 23 = 0 then '' else concat(',"schema:description":"of ', source, '"') end, '}')"""

_CONFORMANCE_SQL = """with b as (select doc_id, 'd' || doc_id as d, unnest([
  case when doc_id % 2 = 0 then ['resourceIdentifierValue', 'Violation', '$.schema:identifier', null] end, case when doc_id % 2 = 0 then ['resourceIdentifierScheme', 'Warning', '$.schema:identifier', null] end,
  case when doc_id % 3 = 0 then ['nameProperty', 'Violation', null, null] end, case when doc_id % 5 = 1 then ['rightsProperty', 'Violation', null, null] end,
  case when doc_id % 5 = 0 then ['rightsAddress', 'Violation', '$.schema:license', '$.schema:license.schema:url'] end, case when doc_id % 7 = 0 then ['dateModifiedProperty', 'Violation', null, '$.schema:dateModified'] end,
  case when doc_id % 4 = 0 then ['keywordsNoCommaTest', 'Warning', null, '$.schema:keywords'] else ['definedTermProperty', 'Violation', '$.schema:keywords[1]', '$.schema:keywords[1].schema:name'] end,
  case when doc_id % 11 = 0 then ['name3Property', 'Warning', '$.schema:variableMeasured[0]', '$.schema:variableMeasured[0].schema:name'] end,
  case when doc_id % 13 = 0 then ['variableMinimum', 'Info', '$.schema:variableMeasured[0]', '$.schema:variableMeasured[0].schema:minValue'] end,
  case when doc_id % 17 = 0 then ['geoLongitude', 'Violation', '$.schema:spatialCoverage.schema:geo', null] end, case when doc_id % 19 = 0 then ['citationProperty', 'Info', null, null] end,
  case when doc_id % 6 = 0 then ['metadataProfileProperty', 'Violation', 'r' || doc_id, null] end, case when doc_id % 23 = 0 then ['descriptionProperty', 'Warning', null, null] end]) as s from documents)
select doc_id, s[1] as shape, s[2] as severity, coalesce(s[3], d) as focus, s[4] as at from b where s is not null"""


@query("val_06_conformance", _CONFORMANCE_SQL)
def val_06_conformance(spark, sf_dir):
    """Linked-data documents against all shapes, with the node and the value that break each."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.expr(_LINKED).alias("json"))
    return shapes.conformance(rows, "doc_id", "json").select("doc_id", "shape", "severity", "focus", "at")
