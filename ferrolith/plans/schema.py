"""The typed record that every projection reads, and the names it has as linked data."""

from __future__ import annotations

ACTOR = "struct<kind:string,name:string,given:string,family:string,email:string,id_scheme:string,id_value:string,affiliation:string>"
TERM = "struct<name:string,scheme:string,identifier:string>"

#: Column types of a record.
RECORD = {
    "name": "string", "description": "string", "url": "string", "identifier": "struct<scheme:string,value:string,url:string>",
    "license": "array<struct<name:string,url:string,identifier:string>>", "conditions": "array<struct<condition:string,date:string>>",
    "distribution": "array<struct<url:string,format:string,size:double,unit:string,checksum:string>>",
    "kind": "string", "version": "string", "language": "string", "date_created": "string", "date_published": "string", "date_accepted": "string", "date_submitted": "string", "other_languages": "array<string>", "copyright_year": "string", "copyright_holder": "string",
    "keywords": f"array<{TERM}>", "about": f"array<{TERM}>", "audience": "array<struct<audience:string,mediator:string,level:string,method:string>>",
    "creator": f"array<{ACTOR}>", "contributor": f"array<struct<role:string,actor:{ACTOR}>>", "publisher": ACTOR, "provider": f"array<{ACTOR}>",
    "funding": f"array<struct<name:string,identifier:string,funder:{ACTOR}>>", "citation": "array<string>",
    "spatial": "array<struct<name:string,description:string,box:string>>", "temporal": "array<string>", "technique": "array<string>", "periodicity": "string",
    "same_as": "array<struct<value:string,name:string>>", "related": "array<struct<relation:string,url:string,name:string>>", "derived_from": "array<struct<name:string,url:string>>",
}

# Names of the columns in the linked-data form, in the order of the form.
CURIES = {
    "id": "@id", "type": "@type", "context": "@context", "date_modified": "schema:dateModified", "subject_of": "schema:subjectOf", "name": "schema:name", "identifier": "schema:identifier",
    "license": "schema:license", "conditions": "schema:conditionsOfAccess", "url": "schema:url", "distribution": "schema:distribution", "description": "schema:description", "kind": "schema:additionalType",
    "same_as": "schema:sameAs", "version": "schema:version", "language": "schema:inLanguage", "date_created": "schema:dateCreated", "date_published": "schema:datePublished", "related": "schema:relatedLink",
    "keywords": "schema:keywords", "about": "schema:about", "audience": "schema:audience", "creator": "schema:creator", "contributor": "schema:contributor", "publisher": "schema:publisher",
    "provider": "schema:provider", "copyright_holder": "schema:copyrightHolder", "copyright_year": "schema:copyrightYear", "funding": "schema:funding", "citation": "dcterms:bibliographicCitation",
    "spatial": "schema:spatialCoverage", "temporal": "schema:temporalCoverage", "technique": "schema:measurementTechnique", "derived_from": "prov:wasDerivedFrom",
    "other_languages": "dcterms:language", "date_accepted": "dcterms:dateAccepted", "date_submitted": "dcterms:dateSubmitted",
}
