"""Export models, shapes and registries on awkward documents."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

from ferrolith.operators import enrichment, validation
from ferrolith.plans import members
from ferrolith.plans.shapes import SHAPES, Shape, as_text, conformance
from ferrolith.sources import registries

KIND = "titles array<struct<title:string,lang:string>>, publisher struct<name:string,place:struct<city:string,country:string>>, version string, year int"


def rows_of(spark, *documents):
    return spark.createDataFrame([(i, json.dumps(d) if isinstance(d, dict) else d) for i, d in enumerate(documents)], "key int, json string")


def test_members_in_order_with_missing_ones(spark):
    kind = _parse_datatype_string(KIND)
    given = spark.createDataFrame([("1", ("x", "a"), [("en", "t"), ("de", None)]), (None, None, None)], "year string, publisher struct<extra:string,name:string>, titles array<struct<lang:string,title:string>>")
    rows = given.select(F.struct("*").alias("d"))
    out = rows.select(members.ordered(F.col("d"), rows.schema["d"].dataType, kind).alias("d"))
    assert [f.name for f in out.schema["d"].dataType.fields] == ["titles", "publisher", "version", "year"]
    assert [f.name for f in out.schema["d"].dataType["publisher"].dataType.fields] == ["name", "place", "extra"]
    required = {"titles", "titles[].title", "publisher.name", "publisher.place.city", "year", "version"}
    found = [sorted(r[0]) for r in out.select(members.missing_members(F.col("d"), out.schema["d"].dataType, required)).collect()]
    assert found == [["titles[1].title", "version"], ["titles", "version", "year"]]
    assert out.first().d.publisher.name == "a" and out.first().d.year == 1


def test_merging_partial_documents(spark):
    kind = _parse_datatype_string(KIND)
    one = ([("a", None)], ("", ("x", None)), "1", None)
    two = ([("b", "en")], ("p", ("y", "z")), "2", 5)
    rows = spark.createDataFrame([(one, two), (one, None), (None, two), (None, None), (one, (None, ("", None), None, None))], f"one struct<{KIND.replace(' ', ':').replace(',:', ',')}>, two struct<{KIND.replace(' ', ':').replace(',:', ',')}>")
    got = [r[0] for r in rows.select(members.merged(F.col("one"), F.col("two"), kind)).collect()]
    assert [tuple(t) for t in got[0].titles] == [("a", None), ("b", "en")] and got[0].publisher.name == "p" and tuple(got[0].publisher.place) == ("x", None)
    assert got[0].version == "2" and got[0].year == 5 and got[1].version == "1" and got[2].year == 5 and got[3] is None
    assert got[4].publisher.name == "" and got[4].version == "1"


def test_shapes_on_awkward_documents(spark):
    term = {"@type": "schema:DefinedTerm", "schema:identifier": {"@type": "schema:PropertyValue", "schema:value": "x"}}
    fine = {
        "@id": "d", "@type": "schema:Dataset", "schema:identifier": "x", "schema:name": "n", "schema:license": {"@id": "https://l"}, "schema:dateModified": "2026-01-31T10:00:00Z", "schema:url": "https://u",
        "schema:description": "d", "schema:creator": {"@type": "schema:Person"}, "schema:keywords": [term, "word"], "schema:datePublished": "2026-01",
        "schema:subjectOf": {"@type": "schema:Dataset", "schema:additionalType": ["dcat:CatalogRecord"], "schema:about": {"@id": "d"}, "dcterms:conformsTo": [{"@id": p} for p in SHAPES[[s.name for s in SHAPES].index("metadataProfileProperty")].has]},
    }
    wrong = fine | {
        "@id": "w", "schema:contributor": ["Ann"], "schema:distribution": [[{"@type": "schema:DataDownload", "spdx:checksum": {"@type": "spdx:Checksum"}}]], "schema:name": ["", None],
        "schema:spatialCoverage": [{"@type": "schema:Place"}, {"@type": "schema:GeoShape", "schema:box": 3}], "schema:about": {"@type": "https://schema.org/Dataset"},
    }
    found = conformance(rows_of(spark, fine, wrong, "no json", None, "[]", "{}"), "key", "json").collect()
    assert [(r.shape, r.focus) for r in found if r.key == 0] == []
    assert sorted((r.shape, r.severity, r.focus) for r in found if r.key == 1) == [
        ("checksumValue", "Violation", "$.schema:distribution[0][0].spdx:checksum"), ("contributorProperty", "Info", "w"), ("datasetNamespace2", "Violation", "$.schema:about"),
        ("geoShapeNode", "Violation", "$.schema:spatialCoverage[1]"), ("nameProperty", "Violation", "w"), ("spatialExtentProperty", "Violation", "$.schema:spatialCoverage[0]"),
    ]
    assert {r.key for r in found} == {1}
    lines = conformance(rows_of(spark, wrong), "key", "json", (Shape("s", "Info", "dataset", ("schema:none",), "wanted", 1),))
    assert [r[0] for r in lines.select(as_text(lines)).collect()] == ["wanted | shape=s | focus_node=w"]


def test_registry_of_registries(spark):
    xml = '<?xml version="1.0"?><registry xmlns="u" id="all"><registry id="text"><record><name>csv</name><file type="template">text/csv</file><xref type="rfc" data="rfc4180"/></record><record><name>xml</name></record></registry><registry id="application"><record><name>xml</name><xref type="note">see <b>it</b></xref></record></registry></registry>'
    found = registries.registry_records(spark.createDataFrame([(1, xml), (2, "no xml"), (3, None), (4, "<registry/>")], "key int, xml string"), "key", "xml")
    assert sorted((r.key, r.template, r.reference) for r in found.collect())[:1] == [(1, "application/xml", "")] or found.count() == 3
    assert {r.short: r.template for r in registries.unambiguous_names(found).collect()} == {"csv": "text/csv"}


@pytest.mark.parametrize(("entry", "has"), [('{"schema:identifier":{"schema:value":"x"}}', True), ('{"schema:identifier":[{},{"schema:value":"x"}]}', True), ('{"schema:identifier":[]}', False), ('{"schema:identifier":null}', False), ("{}", False), ("no json", False)])
def test_identifier_shapes(spark, entry, has):
    assert spark.range(1).select(enrichment.entry_has_identifier(F.try_parse_json(F.lit(entry)))).first()[0] is has


def test_keys_and_populated_fields(spark):
    rows = spark.createDataFrame([('{"a":1,"b":"","c":[],"d":{},"e":null,"f":[null],"g":{"x":null}}',), ("no json",), (None,), ("[1]",)], "j string")
    found = rows.select(validation.populated_fields(F.col("j")).alias("p"), validation.key_differences(F.col("j"), ["a", "z"], ["b"]).alias("k")).collect()
    assert found[0].p == ["a", "b", "f", "g"] and (found[0].k.missing, found[0].k.disallowed) == (["z"], ["b"])
    assert [r.k.missing for r in found[1:]] == [["a", "z"]] * 3
