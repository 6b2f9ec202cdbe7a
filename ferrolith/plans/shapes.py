"""Profile shapes as rows, checked over linked-data documents by joins.

A document is flattened once, in its task, into nodes with the places they stand at and links from nodes to values. A shape names its target nodes,
the properties it looks at (any of them counts), how many valid values it wants, and what a value must be. All shapes are checked in one pass: targets
meet their shapes by name, shapes meet the links of their nodes, and one aggregation for each node and shape decides. A result is a row with the
shape, its severity, a message, the node it was found at and the value that broke it, if any.

Blank strings and nulls are no values. A node without ``@id`` is named by its place in the document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple, dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrolith.plans.document import PROFILES
from ferrolith.sources.resources import in_tasks, parsed

# Fixed patterns: dates of a record, dates of publication, and addresses.
DATE = r"^[12][0-9]{3}-(0[1-9]|1[0-2])(-([0-2][0-9]|3[01])(T([01][0-9]|2[0-3])(:[0-5][0-9])?(:[0-5][0-9](\.[0-9]+)?)?(Z|[+-][0-2][0-9]:[0-5][0-9])?)?)?$"
ADDRESS = r"^https?://[^\s]+$"
# Properties whose defined terms are checked.
TERM_PLACES = ("schema:linkRelationship", "schema:measurementTechnique", "schema:keywords", "schema:name")
#: Properties of a value that count as the node's own, one step further.
STEPS = (("schema:subjectOf", "dcterms:conformsTo"),)


@dataclass(frozen=True)
class Shape:
    """What the nodes of a target must have.

    ``target`` is a class, ``dataset``, ``record``, ``term``, ``variable``, or ``property>class`` for values of a property (``dataset:property>class``: of a dataset's own). ``may_be`` lists kinds of
    values (string, number, iri) and classes, none for any; ``pattern`` and ``length`` are for strings. ``has`` are values that must all be there.
    ``lenient``: values that are not valid do not count, and are no fault in themselves.
    """

    name: str
    severity: str
    target: str
    path: tuple[str, ...]
    message: str
    least: int = 0
    most: int | None = None
    may_be: tuple[str, ...] = ()
    pattern: str | None = None
    length: int = 0
    has: tuple[str, ...] = ()
    lenient: bool = False


_TEXT, _LINK = ("string",), ("string", "iri")
#: The profile's shapes: datasets, catalogue records, defined terms, variables, files, places and namespaces.
SHAPES = (
    Shape(
        "resourceIdentifierProperty", "Violation", "dataset", ("schema:identifier",),
        "an identifier is needed, a string or a PropertyValue", 1, may_be=("string", "schema:PropertyValue"),
    ),
    Shape(
        "resourceIdentifierValue", "Violation", "dataset:schema:identifier>schema:PropertyValue", ("schema:url", "schema:value"),
        "an identifier needs a url or a value", 1, may_be=_TEXT,
    ),
    Shape(
        "resourceIdentifierScheme", "Warning", "dataset:schema:identifier>schema:PropertyValue", ("schema:propertyID",),
        "an identifier should name its scheme", 1,
    ),
    Shape("nameProperty", "Violation", "dataset", ("schema:name",), "a name is needed", 1, may_be=_TEXT),
    Shape(
        "rightsProperty", "Violation", "dataset", ("schema:license", "schema:conditionsOfAccess"),
        "a license or conditions of access are needed", 1, may_be=("string", "iri", "schema:CreativeWork"),
    ),
    Shape(
        "rightsAddress", "Violation", "dataset:schema:license>schema:CreativeWork", ("schema:url",),
        "a license's work needs an address", 1, may_be=_TEXT, pattern=ADDRESS,
    ),
    Shape(
        "conditionsAddress", "Violation", "dataset:schema:conditionsOfAccess>schema:CreativeWork", ("schema:url",),
        "a work on conditions needs an address", 1, may_be=_TEXT, pattern=ADDRESS,
    ),
    Shape(
        "dateModifiedProperty", "Violation", "dataset", ("schema:dateModified",),
        "a date of the last change is needed, with a year and a month at least", 1, may_be=_TEXT, pattern=DATE,
    ),
    Shape("accessProperty", "Violation", "dataset", ("schema:url", "schema:distribution"), "an address or a distribution is needed", 1),
    Shape("descriptionProperty", "Warning", "dataset", ("schema:description",), "a description is recommended", 1, may_be=_TEXT),
    Shape("creatorProperty", "Warning", "dataset", ("schema:creator",), "a creator is recommended", 1),
    Shape("keywordsProperty", "Warning", "dataset", ("schema:keywords",), "keywords are recommended", 1),
    Shape(
        "keywordsNoCommaTest", "Warning", "dataset", ("schema:keywords",),
        "keywords are values of their own, without commas", may_be=("string", "iri", "node"), pattern=r"^[^,]*$",
    ),
    Shape(
        "metadataIdentifierProperty", "Warning", "dataset", ("schema:subjectOf",),
        "the record that describes the dataset is recommended", 1,
    ),
    Shape(
        "resourceMetadataProfileProperty", "Warning", "dataset", ("schema:subjectOf/dcterms:conformsTo",),
        "the record should say which profile it follows", 1,
    ),
    Shape(
        "otherIdentifierProperty", "Info", "dataset", ("schema:sameAs",),
        "other identifiers should be addresses or strings", may_be=("string", "number", "iri"),
    ),
    Shape(
        "responsiblePartyProperty", "Info", "dataset", ("schema:creator", "schema:editor", "schema:publisher"),
        "a responsible party is recommended", 1,
    ),
    Shape(
        "contributorProperty", "Info", "dataset", ("schema:contributor",),
        "contributors should be roles, persons, organisations or addresses", may_be=("schema:Role", "schema:Person", "schema:Organization", "iri"),
    ),
    Shape(
        "datePublishedProperty", "Info", "dataset", ("schema:datePublished",),
        "a date of publication is recommended, with a year and a month at least", 1, may_be=_TEXT, pattern=DATE,
    ),
    Shape(
        "distributionProperty", "Info", "dataset", ("schema:distribution",),
        "distributions should be downloads or services", may_be=("schema:DataDownload", "schema:WebAPI"),
    ),
    Shape(
        "providerProperty", "Info", "dataset", ("schema:provider",),
        "providers should be persons, organisations or addresses", may_be=("schema:Person", "schema:Organization", "iri"),
    ),
    Shape(
        "policiesProperty", "Info", "dataset", ("schema:publishingPrinciples",),
        "policies should be works or addresses", may_be=("schema:CreativeWork", "iri"),
    ),
    Shape(
        "policyContent", "Info", "dataset:schema:publishingPrinciples>schema:CreativeWork", ("schema:url", "schema:description"),
        "a policy needs an address or a description", 1, may_be=_TEXT,
    ),
    Shape(
        "policyName", "Info", "dataset:schema:publishingPrinciples>schema:CreativeWork", ("schema:name",),
        "a policy should have a name", 1, may_be=_TEXT,
    ),
    Shape(
        "relatedResourceProperty", "Info", "dataset", ("schema:relatedLink",),
        "related links should be LinkRoles", may_be=("schema:LinkRole",),
    ),
    Shape(
        "relatedResourceRelation", "Info", "dataset:schema:relatedLink>schema:LinkRole", ("schema:linkRelationship",),
        "a related link needs its relation", 1, may_be=("string", "iri", "schema:DefinedTerm"),
    ),
    Shape(
        "relatedResourceTarget", "Info", "dataset:schema:relatedLink>schema:LinkRole", ("schema:target",),
        "a related link's target should be an EntryPoint", may_be=("schema:EntryPoint",),
    ),
    Shape(
        "relatedResourceUrl", "Info", "schema:target>schema:EntryPoint", ("schema:url",),
        "a related link's target needs an address", 1, may_be=_TEXT,
    ),
    Shape("citationProperty", "Info", "dataset", ("schema:citation",), "schema:citation is not recommended", most=0),
    Shape(
        "metadataProfileProperty", "Violation", "record", ("dcterms:conformsTo",),
        "the record must follow the core and the discovery profile", 1, has=tuple(PROFILES),
    ),
    Shape("metadataSubjectProperty", "Violation", "record", ("schema:about",), "the record must say what it is about", 1),
    Shape(
        "catalogRecordTypeProperty", "Violation", "record", ("schema:additionalType",),
        "the record must be marked as a catalogue record", 1, has=("dcat:CatalogRecord",),
    ),
    Shape(
        "definedTermProperty", "Violation", "term", ("schema:identifier", "schema:name", "schema:termCode"),
        "a term needs an identifier, a code or a name of three letters", 1, may_be=("string", "schema:PropertyValue"), length=3, lenient=True,
    ),
    Shape("definedTermSet", "Info", "term", ("schema:inDefinedTermSet",), "a term's set should be an address or a string", may_be=_LINK),
    Shape("termCode", "Info", "term", ("schema:termCode",), "a term's code should be a string", may_be=_TEXT),
    Shape(
        "variableProperty", "Warning", "variable", ("schema:propertyID",),
        "a variable should name its property", 1, may_be=("string", "iri", "schema:DefinedTerm"), length=5,
    ),
    Shape("nameRequiredProperty", "Violation", "variable", ("schema:name",), "a variable needs a name", 1, may_be=_TEXT),
    Shape("name3Property", "Warning", "variable", ("schema:name",), "a variable's name should have three letters", may_be=_TEXT, length=3),
    Shape(
        "variableDescription", "Info", "variable", ("schema:description",),
        "a variable should be described in ten letters or more", 1, may_be=_TEXT, length=10,
    ),
    Shape(
        "variableTechnique", "Info", "variable", ("schema:measurementTechnique",),
        "a technique should be a string, an address or a term", may_be=("string", "iri", "schema:DefinedTerm"),
    ),
    Shape("variableUnitText", "Info", "variable", ("schema:unitText",), "a unit's text should be a string", may_be=_TEXT),
    Shape(
        "variableUnitCode", "Info", "variable", ("schema:unitCode",),
        "a unit's code should be a string, an address or a term", may_be=("string", "iri", "schema:DefinedTerm"),
    ),
    Shape("variableMinimum", "Info", "variable", ("schema:minValue",), "the least value should be a number", may_be=("number",)),
    Shape("variableMaximum", "Info", "variable", ("schema:maxValue",), "the greatest value should be a number", may_be=("number",)),
    Shape(
        "downloadProvider", "Violation", "schema:DataDownload", ("schema:provider",),
        "a download's provider must be a person or an organisation", may_be=("schema:Person", "schema:Organization"),
    ),
    Shape(
        "downloadChecksum", "Violation", "schema:DataDownload", ("spdx:checksum",),
        "a checksum must be an spdx:Checksum", may_be=("spdx:Checksum",),
    ),
    Shape(
        "checksumValue", "Violation", "spdx:checksum>spdx:Checksum", ("spdx:checksumValue",),
        "a checksum needs its value", 1, may_be=_TEXT,
    ),
    Shape(
        "spatialExtentProperty", "Violation", "schema:Place", ("schema:geo", "schema:name", "schema:identifier"),
        "a place needs a geometry, a name or an identifier", 1,
    ),
    Shape(
        "geoLatitude", "Violation", "schema:GeoCoordinates", ("schema:latitude",),
        "coordinates need a latitude, as a number", 1, may_be=("number",),
    ),
    Shape(
        "geoLongitude", "Violation", "schema:GeoCoordinates", ("schema:longitude",),
        "coordinates need a longitude, as a number", 1, may_be=("number",),
    ),
    Shape(
        "geoShapeNode", "Violation", "schema:GeoShape", ("schema:line", "schema:box"),
        "a shape needs a line or a box, as a string", 1, may_be=_TEXT,
    ),
    *(Shape(f"datasetNamespace{i}", "Violation", wrong, ("@type",), "the class is not in the namespace http://schema.org/", most=0) for i, wrong in enumerate(("http://schema.orgDataset/", "https://schema.org/Dataset", "https://schema.orgDataset/"), 1)),
)


def _many(value) -> list:
    return [] if value is None else [x for v in value for x in _many(v)] if isinstance(value, list) else [value]


def _kinds(value) -> list[str]:
    """What a value is: string, number, boolean; an object is its classes, and an iri if it has nothing but ``@id``."""
    if isinstance(value, dict):
        return ["iri"] if value.keys() == {"@id"} else ["node", *(t for t in _many(value.get("@type")) if isinstance(t, str))]
    return ["string" if isinstance(value, str) else "boolean" if isinstance(value, bool) else "number"]


def _targets(node: dict, classes: list[str], under: str | None, of_dataset: bool) -> list[str]:
    found = [*classes, *(f"{under}>{c}" for c in classes), *(f"dataset:{under}>{c}" for c in classes if of_dataset)]
    record = under == "schema:subjectOf" or "dcat:CatalogRecord" in _many(node.get("schema:additionalType"))
    if "schema:Dataset" in classes:
        found.append("record" if record else "dataset")
    if "schema:DefinedTerm" in classes and under in TERM_PLACES:
        found.append("term")
    if under == "schema:variableMeasured":
        found.append("variable")
    return found


def linked(text: str | None) -> Iterator[tuple]:
    """Nodes (node, place, targets, ...) and links (node, ..., property, at, kinds, value) of a document; blank strings and nulls are left out."""
    todo = [(v, "$", None, False) for v in parsed(text)]
    while todo:
        value, place, under, of_dataset = todo.pop()
        if isinstance(value, list):
            todo += [(v, f"{place}[{i}]", under, of_dataset) for i, v in enumerate(value)]
        if not isinstance(value, dict):
            continue
        node = value.get("@id") if isinstance(value.get("@id"), str) else place
        targets = _targets(value, _kinds(value)[1:], under, of_dataset)
        yield place, node, targets, None, None, None, None
        links = [(k, f"{place}.{k}", v) for k, v in value.items() if k != "@id"]
        links += [(f"{a}/{b}", f"{place}.{a}.{b}", o.get(b)) for a, b in STEPS for o in _many(value.get(a)) if isinstance(o, dict)]
        for name, at, held in links:
            for v in _many(held):
                if not isinstance(v, str) or v.strip():
                    own = v if isinstance(v, str) else v.get("@id") if isinstance(v, dict) and isinstance(v.get("@id"), str) else None
                    yield place, None, None, name, at, _kinds(v), own
        todo += [(v, f"{place}.{k}", k, "dataset" in targets) for k, v in value.items() if isinstance(v, (dict, list))]


def conformance(documents: DataFrame, key: str, json: str, shapes: tuple[Shape, ...] = SHAPES) -> DataFrame:
    """What each document breaks: (key, shape, severity, message, focus, at)."""
    spark = documents.sparkSession
    rows = in_tasks(documents, key, json, linked, "place string, node string, targets array<string>, property string, at string, kinds array<string>, value string")
    types = {"path": "array<string>", "may_be": "array<string>", "has": "array<string>", "least": "int", "most": "int", "length": "int", "lenient": "boolean"}
    listed = spark.createDataFrame([tuple([*x] if isinstance(x, tuple) else x for x in astuple(s)) for s in shapes], ", ".join(f"{f.name} {types.get(f.name, 'string')}" for f in fields(Shape)))
    nodes = rows.where(F.col("targets").isNotNull()).select(F.col(key).alias("n_key"), F.col("place").alias("n_place"), "node", F.explode(F.array_distinct("targets")).alias("n_target"))
    wanted = nodes.join(F.broadcast(listed), F.col("n_target") == F.col("target"))  # some fifty shapes
    links = rows.where(F.col("property").isNotNull()).select(key, "place", "property", "at", "kinds", "value")
    here = F.col("n_key").eqNullSafe(F.col(key)) & (F.col("n_place") == F.col("place")) & F.array_contains(F.col("path"), F.col("property"))
    met = wanted.join(links, here, "left")
    there, text = F.col("property").isNotNull(), F.array_contains("kinds", "string")
    kind_ok = (F.size("may_be") == 0) | F.arrays_overlap("kinds", "may_be")
    text_ok = ~text | ((F.col("pattern").isNull() | F.expr("value rlike pattern")) & (F.length("value") >= F.col("length")))
    valid = there & kind_ok & text_ok
    by = ["n_key", "n_place", "node", "name", "severity", "message", "least", "most", "has", "lenient"]
    found: dict[str, Column] = {
        "n": F.count_if(valid), "all": F.count_if(there), "values": F.collect_set(F.when(F.size("has") > 0, F.col("value"))), "bad": F.min(F.when(there & ~valid, F.col("at"))),
    }
    each = met.groupBy(*by).agg(*[c.alias(n) for n, c in found.items()])
    missing = F.col("n") < F.col("least")
    broken = missing | F.coalesce(F.col("all") > F.col("most"), F.lit(False)) | (F.col("bad").isNotNull() & ~F.col("lenient")) | (F.size(F.array_except("has", "values")) > 0)
    return each.where(broken).select(F.col("n_key").alias(key), F.col("name").alias("shape"), "severity", "message", F.col("node").alias("focus"), F.col("bad").alias("at"))


def as_text(results: DataFrame) -> Column:
    """One line for a result, as reports have it."""
    return F.concat_ws(" | ", results["message"], F.concat(F.lit("shape="), results["shape"]), F.concat(F.lit("focus_node="), results["focus"]))
