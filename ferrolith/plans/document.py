"""After merging: fallbacks for blanks, the envelope, required fields and profile shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrolith.functions.names import clean_publisher
from ferrolith.functions.values import strip
from ferrolith.plans.schema import ACTOR

# Context, profile addresses, and the licence that names its own holder.
CONTEXT = {"schema": "http://schema.org/", "dcterms": "http://purl.org/dc/terms/", "dcat": "http://www.w3.org/ns/dcat#", "prov": "http://www.w3.org/ns/prov#", "dqv": "http://www.w3.org/ns/dqv#"}
PROFILES = ["https://w3id.org/cdif/core/1.0", "https://w3id.org/cdif/discovery/1.0"]
STATE_LICENSE, STATE_HOLDER = "Datos Abiertos del Estado de Chile", "Estado de Chile"


def _blank(c: Column) -> Column:
    return F.coalesce(strip(c), F.lit("")) == ""


def organisation(name: Column) -> Column:
    blank = F.lit("")
    return F.when(~_blank(name), F.struct(F.lit("Organization").alias("kind"), name.alias("name"), *[blank.alias(c) for c in ("given", "family", "email", "id_scheme", "id_value", "affiliation")])).cast(ACTOR)


def fill_blanks(records: DataFrame, resource_url: Column, resource_publisher: Column) -> DataFrame:
    """Fallbacks, each into blanks only and each seeing the ones before: address, publisher, creator, holder, state licence."""
    out = records.withColumn("url", F.when(_blank(F.col("url")) & resource_url.rlike("^https?://"), resource_url).otherwise(F.col("url")))
    out = out.withColumn("publisher", F.coalesce(F.when(~_blank(F.col("publisher.name")), F.col("publisher")), organisation(clean_publisher(resource_publisher))))
    named = ~_blank(F.col("publisher.name"))
    out = out.withColumn("creator", F.when((F.coalesce(F.size("creator"), F.lit(0)) < 1) & named, F.array("publisher")).otherwise(F.col("creator")))
    out = out.withColumn("copyright_holder", F.when(_blank(F.col("copyright_holder")) & named, F.col("publisher.name")).otherwise(F.col("copyright_holder")))
    state = F.coalesce(F.exists("license", lambda x: x["name"] == STATE_LICENSE), F.lit(False))
    return out.withColumn("copyright_holder", F.when(_blank(F.col("copyright_holder")) & state, STATE_HOLDER).otherwise(F.col("copyright_holder")))


def backfill(records: DataFrame, works: DataFrame) -> DataFrame:
    """Blank name, creator, publisher and date of records with a DOI from ``works`` (doi, title, authors, publisher, issued)."""
    w = works.select(F.lower("doi").alias("w_doi"), F.col("title").alias("w_title"), F.col("authors").alias("w_authors"), F.col("publisher").alias("w_publisher"), F.col("issued").alias("w_issued")).dropDuplicates(["w_doi"])
    joined = records.join(w, (F.upper("identifier.scheme") == "DOI") & (F.lower("identifier.value") == F.col("w_doi")), "left")
    return joined.withColumns({
        "name": F.when(_blank(F.col("name")), F.coalesce("w_title", "name")).otherwise(F.col("name")),
        "creator": F.when(F.coalesce(F.size("creator"), F.lit(0)) < 1, F.coalesce(F.transform("w_authors", organisation), F.col("creator"))).otherwise(F.col("creator")),
        "publisher": F.when(_blank(F.col("publisher.name")), F.coalesce(organisation(F.col("w_publisher")), F.col("publisher"))).otherwise(F.col("publisher")),
        "date_published": F.when(_blank(F.col("date_published")), F.coalesce("w_issued", "date_published")).otherwise(F.col("date_published")),
    }).drop("w_doi", "w_title", "w_authors", "w_publisher", "w_issued")


def document_id(identifier: Column, key: Column) -> Column:
    """The identifier's address if it is one, else a name made from the key: the same in every run."""
    candidate = F.coalesce(F.nullif(identifier["url"], F.lit("")), identifier["value"])
    return F.when(candidate.rlike("^https?://"), candidate).otherwise(F.concat(F.lit("urn:ferrolith:"), F.sha2(key.cast("string"), 256)))


def envelope(records: DataFrame, today: str, key: str = "doc_id") -> DataFrame:
    """The record with context, type, id, date and the catalogue entry that says which profiles it follows."""
    own = document_id(F.col("identifier"), F.col(key))
    out = records.withColumns({"id": own, "type": F.array(F.lit("schema:Dataset")), "context": F.create_map(*[F.lit(x) for p in CONTEXT.items() for x in p]), "date_modified": F.lit(today)})
    entry = F.struct(F.concat("id", F.lit("#metadata")).alias("id"), F.lit("schema:Dataset").alias("type"), F.lit("dcat:CatalogRecord").alias("additional_type"), F.col("id").alias("about"), F.array(*map(F.lit, PROFILES)).alias("conforms_to"))
    return out.withColumn("subject_of", entry)


def required_missing() -> Column:
    """Names of required parts that a record with an envelope lacks."""
    filled = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    gaps = {
        "id": _blank(F.col("id")), "type": ~filled("type"), "name": _blank(F.col("name")), "identifier": _blank(F.col("identifier.value")) & _blank(F.col("identifier.url")),
        "date_modified": _blank(F.col("date_modified")), "subject_of": F.col("subject_of").isNull(),
        "license or conditions": ~filled("license") & ~filled("conditions"), "url or distribution": _blank(F.col("url")) & ~filled("distribution"),
    }
    return F.array_compact(F.array(*[F.when(gap, F.lit(name)) for name, gap in gaps.items()]))


def shape_results(records: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows (key, shape, severity) for each profile shape that a record with an envelope breaks."""
    filled = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    names = lambda c: F.coalesce(F.transform(c, lambda t: t["name"]), F.array().cast("array<string>"))
    shapes = [
        ("nameProperty", "Violation", _blank(F.col("name"))),
        ("resourceIdentifierProperty", "Violation", _blank(F.col("identifier.value")) & _blank(F.col("identifier.url"))),
        ("identifierSchemeProperty", "Warning", ~_blank(F.col("identifier.value")) & _blank(F.col("identifier.scheme"))),
        ("rightsProperty", "Violation", ~filled("license") & ~filled("conditions")),
        ("dateModifiedProperty", "Violation", ~F.coalesce(F.col("date_modified").rlike(r"^[0-9]{4}-[0-9]{2}(-[0-9]{2}(T.*)?)?$"), F.lit(False))),
        ("accessProperty", "Violation", _blank(F.col("url")) & ~filled("distribution")),
        ("metadataProfileProperty", "Violation", ~F.coalesce(F.size(F.array_intersect("subject_of.conforms_to", F.array(*map(F.lit, PROFILES)))) == len(PROFILES), F.lit(False))),
        ("metadataSubjectProperty", "Violation", _blank(F.col("subject_of.about"))),
        ("catalogRecordTypeProperty", "Violation", F.coalesce(F.col("subject_of.additional_type"), F.lit("")) != "dcat:CatalogRecord"),
        ("termLabelProperty", "Violation", F.exists(F.concat(names("keywords"), names("about")), lambda n: F.coalesce(F.length(n), F.lit(0)) < 3)),
        ("descriptionProperty", "Warning", _blank(F.col("description"))),
        ("creatorProperty", "Warning", ~filled("creator")),
        ("keywordsProperty", "Warning", ~filled("keywords")),
        ("keywordsNoCommaTest", "Warning", F.exists(names("keywords"), lambda n: F.contains(n, F.lit(",")))),
        ("metadataIdentifierProperty", "Warning", _blank(F.col("subject_of.id"))),
        ("datePublishedProperty", "Info", ~_blank(F.col("date_published")) & ~F.col("date_published").rlike(r"^[0-9]{4}(-[0-9]{2}(-[0-9]{2}(T.*)?)?)?$")),
        ("citationProperty", "Info", filled("citation")),
        ("distributionProperty", "Info", F.coalesce(F.exists("distribution", lambda d: _blank(d["url"])), F.lit(False))),
        ("relatedResourceProperty", "Info", F.coalesce(F.exists("related", lambda r: _blank(r["relation"]) | _blank(r["url"])), F.lit(False))),
    ]
    rows = F.explode(F.array_compact(F.array(*[F.when(F.coalesce(broken, F.lit(False)), F.struct(F.lit(s).alias("shape"), F.lit(v).alias("severity"))) for s, v, broken in shapes])))
    return records.select(key, rows.alias("r")).select(key, "r.shape", "r.severity")


def pids_of(records: DataFrame, key: str = "doc_id") -> DataFrame:
    """Every identifier in a record, repeats included: (key, scheme, value, location)."""
    one = lambda scheme, value, place: F.struct(scheme.alias("scheme"), value.alias("value"), place.alias("location"))
    doi_like = lambda v: v.rlike(r"(?i)^(https?://(dx\.)?doi\.org/)?10\.[0-9]{4,9}/\S+$")
    place = lambda name, i: F.concat(F.lit(f"{name}["), i.cast("string"), F.lit("]"))
    parts = F.concat(
        F.array(one(F.col("identifier.scheme"), F.col("identifier.value"), F.lit("identifier"))),
        F.transform("creator", lambda a, i: one(a["id_scheme"], a["id_value"], place("creator", i))),
        F.array(one(F.coalesce("publisher.id_scheme", F.lit("")), F.coalesce("publisher.id_value", F.lit("")), F.lit("publisher"))),
        F.transform(F.filter("same_as", lambda s: doi_like(s["value"])), lambda s, i: one(F.lit("DOI"), s["value"], place("same_as", i))),
        F.transform(F.filter("related", lambda r: doi_like(r["url"])), lambda r, i: one(F.lit("DOI"), r["url"], place("related", i))),
    )
    rows = records.select(key, F.explode(F.filter(parts, lambda p: (F.coalesce(p["scheme"], F.lit("")) != "") & (F.coalesce(p["value"], F.lit("")) != ""))).alias("p"))
    return rows.select(key, "p.scheme", "p.value", "p.location")
