"""Records in the layouts of other catalogues, flattened so that SQL can say the same."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ferrolith.plans.crosswalks import croissant, datacite, dataverse
from ferrolith.plans.document import CONTEXT, PROFILES, envelope
from ferrolith.plans.schema import CURIES, RECORD
from ferrolith.queries import query
from ferrolith.queries.documents import RECORD_SQL, TODAY, records
from ferrolith.sources.sinks import as_json


def _datacite(spark, sf_dir):
    return datacite(records(spark, sf_dir))


def _flat(array, *parts):
    """Parts of each entry joined by ``|``, entries by ``;``."""
    return F.array_join(F.transform(array, lambda x: F.concat_ws("|", *[F.coalesce(x[p], F.lit("")) for p in parts])), ";")


@query("dc_01_resource", f"""with {RECORD_SQL} select k as doc_id, case when doi <> '' then doi else url end as identifier, case when doi <> '' then 'DOI' when url <> '' then 'URL' else '' end as identifier_type, substr(case when published <> '' then published else created end, 1, 4) as publication_year, 'Dataset' as resource_type, lang as language from rec""")
def dc_01(spark, sf_dir):
    r = "resource."
    return _datacite(spark, sf_dir).select("doc_id", F.coalesce(r + "identifier", F.lit("")).alias("identifier"), r + "identifier_type", r + "publication_year", r + "resource_type", r + "language")


@query("dc_02_titles", f"with {RECORD_SQL} select k as doc_id, case when name <> '' then name || '|MainTitle' else '' end as titles, case when description <> '' then description || '|Abstract' else '' end as descriptions, lang as languages from rec")
def dc_02(spark, sf_dir):
    return _datacite(spark, sf_dir).select("doc_id", _flat("titles", "name", "type").alias("titles"), _flat("descriptions", "description", "type").alias("descriptions"), F.array_join("languages", ";").alias("languages"))


@query("dc_05_creators", f"""with {RECORD_SQL} select k as doc_id, case when no_creator then '' else 'Creator|Ann ' || source || '|Personal|' || case when k % 2 = 0 then 'ORCID' else '' end || case when two then ';Creator|Office ' || lang || '|Organizational|' else '' end end as creators, coalesce(publisher, '') as publishers from rec""")
def dc_05(spark, sf_dir):
    return _datacite(spark, sf_dir).select("doc_id", _flat("creators", "role", "name", "name_type", "identifier_scheme").alias("creators"), _flat("publishers", "name").alias("publishers"))


@query("dc_07_subjects", f"with {RECORD_SQL} select k as doc_id, case when no_keywords then '' else source || ';' || lang end as subjects, 0 as categories from rec")
def dc_07(spark, sf_dir):
    return _datacite(spark, sf_dir).select("doc_id", _flat("subjects", "subject").alias("subjects"), F.size("categories").alias("categories"))


@query("dc_10_dates", f"""with {RECORD_SQL} select k as doc_id, concat_ws(';', case when created <> '' then created || '|Created' end, case when published <> '' then published || '|Issued' end) as dates from rec""")
def dc_10(spark, sf_dir):
    return _datacite(spark, sf_dir).select("doc_id", _flat("dates", "date", "type").alias("dates"))


@query("dc_13_rights", f"""with {RECORD_SQL} select k as doc_id, case lic when 0 then '' when 1 then 'CC BY 4.0|CC-BY-4.0|SPDX' when 2 then 'Terms of ' || source || '||' else 'CC BY 4.0|CC-BY-4.0|SPDX;Terms of ' || source || '||' end as rights from rec""")
def dc_13(spark, sf_dir):
    return _datacite(spark, sf_dir).select("doc_id", _flat("rights", "rights", "identifier", "scheme").alias("rights"))


@query("dc_18_media", f"with {RECORD_SQL} select k as doc_id, case when has_file then 'https://files.example.org/' || k || '.csv|CSV|' || md5(text) || '|Digital' else '' end as media from rec")
def dc_18(spark, sf_dir):
    return _datacite(spark, sf_dir).select("doc_id", _flat("media_files", "file_uri", "format", "checksum", "physical_carrier").alias("media"))


@query("cr_01_croissant", f"""with {RECORD_SQL} select k as doc_id, case when name <> '' then name when doi <> '' then doi else 'Untitled resource' end as name, case when description <> '' then description else 'No description was extracted for this resource.' end as description,
  case lic when 1 then 'https://creativecommons.org/licenses/by/4.0/' when 2 then 'Terms of ' || source when 3 then 'https://creativecommons.org/licenses/by/4.0/;Terms of ' || source end as license, case when url <> '' then url when doi <> '' then 'https://doi.org/' || doi end as url,
  case when published <> '' then published when created <> '' then created end as date_published, case when has_file then 'md5' end as digest,
  concat_ws(',', case when name = '' then 'name' end, case when description = '' then 'description' end, case when lic = 0 then 'license' end, case when url = '' and doi = '' then 'url' end, case when no_creator then 'creator' end, case when published = '' and created <> '' then 'datePublished from dateCreated' end, case when published = '' and created = '' then 'datePublished' end) as warnings from rec""")
def cr_01(spark, sf_dir):
    c = croissant(records(spark, sf_dir))
    return c.select("doc_id", "name", "description", F.array_join("license", ";").alias("license"), "url", "date_published", F.get("distribution", F.lit(0))["digest"].alias("digest"), F.array_join("warnings", ",").alias("warnings"))


@query("dv_01_dataverse", f"""with {RECORD_SQL} select k as doc_id, case when name <> '' then name when doi <> '' then doi else 'Untitled resource' end as title, case when no_creator then 'Unknown|' else 'Ann ' || source || '|' || case when k % 2 = 0 then 'ORCID' else '' end || case when two then ';Office ' || lang || '|' else '' end end as authors,
  case when no_creator then 'Unknown' else 'Ann ' || source end as contact_name, 'unknown@example.org' as contact_email, 'Other' as subject, case when no_keywords then '' else source || ';' || lang end as keywords, case when url <> '' then url when doi <> '' then 'https://doi.org/' || doi end as alternative_url from rec""")
def dv_01(spark, sf_dir):
    d = dataverse(records(spark, sf_dir))
    return d.select("doc_id", "title", _flat("author", "author_name", "identifier_scheme").alias("authors"), "contact_name", "contact_email", F.array_join("subject", ";").alias("subject"), F.array_join("keyword", ";").alias("keywords"), "alternative_url")


def _text(value):
    """SQL for a text as JSON."""
    return f"to_json({value})"


def _members(**values):
    """SQL for members with these values, which are SQL for JSON texts; members of null are left out."""
    return "concat_ws(',', " + ", ".join(f"""'"{name}":' || {value}""" for name, value in values.items()) + ")"


def _object(**values):
    return f"'{{' || {_members(**values)} || '}}'"


_ACTOR_REST = dict.fromkeys(("given", "family", "email"), "'\"\"'")
_PERSON = _object(
    kind="'\"Person\"'", name=_text("'Ann ' || source"), **_ACTOR_REST,
    id_scheme=_text("case when k % 2 = 0 then 'ORCID' else '' end"), id_value=_text("case when k % 2 = 0 then '0000-0002-1825-0097' else '' end"), affiliation="'\"\"'",
)
_OFFICE = lambda name: _object(kind="'\"Organization\"'", name=_text(name), **_ACTOR_REST, id_scheme="'\"\"'", id_value="'\"\"'", affiliation="'\"\"'")
_TERM = lambda name: _object(name=_text(name), scheme="'\"\"'", identifier="'\"\"'")
_CC = """'{"name":"CC BY 4.0","url":"https://creativecommons.org/licenses/by/4.0/","identifier":"CC-BY-4.0"}'"""
_OWN = _object(name=_text("'Terms of ' || source"), url="'\"\"'", identifier="'\"\"'")
_FILE = _object(url=_text("'https://files.example.org/' || k || '.csv'"), format="'\"CSV\"'", size="(length(text) / 1000.0)::double::varchar", unit="'\"kB\"'", checksum=_text("md5(text)"))
_IDENTIFIER = _object(scheme=_text("case when doi <> '' then 'DOI' else '' end"), value=_text("doi"), url=_text("case when doi <> '' then 'https://doi.org/' || doi else '' end"))
_ENTRY = _object(
    id=_text("id || '#metadata'"), type="'\"schema:Dataset\"'", additional_type="'\"dcat:CatalogRecord\"'", about=_text("id"), conforms_to=f"'{json.dumps(PROFILES, separators=(',', ':'))}'"
)
#: JSON of each column of a record, in SQL; the columns that the extractor leaves empty are not listed.
_DOCUMENT = {
    "id": _text("id"), "type": "'[\"schema:Dataset\"]'", "context": f"'{json.dumps(CONTEXT, separators=(',', ':'))}'", "date_modified": f"'\"{TODAY}\"'", "subject_of": _ENTRY,
    "name": _text("name"), "identifier": _IDENTIFIER, "license": f"case lic when 0 then '[]' when 1 then '[' || {_CC} || ']' when 2 then '[' || {_OWN} || ']' else '[' || {_CC} || ',' || {_OWN} || ']' end",
    "url": _text("url"), "distribution": f"case when has_file then '[' || {_FILE} || ']' else '[]' end", "description": _text("description"),
    "kind": "case when k % 13 = 0 then '\"Report of things\"' else '\"Dataset\"' end", "language": _text("lang"), "date_created": _text("created"), "date_published": _text("published"),
    "keywords": f"case when no_keywords then '[]' else '[' || {_TERM('source')} || ',' || {_TERM('lang')} || ']' end",
    "creator": f"case when no_creator then '[]' when two then '[' || {_PERSON} || ',' || {_OFFICE("'Office ' || lang")} || ']' else '[' || {_PERSON} || ']' end",
    "publisher": f"case when publisher is not null then {_OFFICE('publisher')} end",
}
_EMPTY = {c: "'[]'" if kind.startswith("array") else "'\"\"'" for c, kind in RECORD.items() if c not in _DOCUMENT}
_NAMED = {name: (_DOCUMENT | _EMPTY)[c] for c, name in CURIES.items()} | {c: _EMPTY[c] for c in sorted(_EMPTY.keys() - CURIES.keys())}
_WITH_ID = "d as (select *, case when doi <> '' then 'https://doi.org/' || doi else 'urn:ferrolith:' || sha256(k::varchar) end as id from rec)"


@query("snk_01_json", f"with {RECORD_SQL}, {_WITH_ID} select k as doc_id, {_object(**_NAMED)} as json from d")
def snk_01(spark, sf_dir):
    """Whole documents as linked data, in field order."""
    return as_json(envelope(records(spark, sf_dir), TODAY), "doc_id")
