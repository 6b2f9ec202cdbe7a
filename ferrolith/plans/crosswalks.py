"""Records in the layouts of three catalogues: DataCite 4.6, Croissant 1.1 and Dataverse. Projections only; nothing raises."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrolith.functions.identifiers import digest_kind
from ferrolith.functions.names import contact_line, email_in, frequency, language_code
from ferrolith.functions.values import first_filled, strip, year_of

# General resource types, contributor slots, subjects and author identifier schemes.
RESOURCE_TYPES = ["dataset", "software", "text", "image", "video", "audio", "collection", "event", "interactive resource", "model", "physical object", "service", "sound", "workflow", "other"]
SLOTS = {"Producer": "producer", "ContactPerson": "contact", "Editor": "editor", "Maintainer": "maintainer"}
SUBJECTS = [
    "Agricultural Sciences", "Arts and Humanities", "Astronomy and Astrophysics", "Business and Management", "Chemistry", "Computer and Information Science", "Earth and Environmental Sciences",
    "Engineering", "Law", "Mathematical Sciences", "Medicine, Health and Life Sciences", "Physics", "Social Sciences", "Other",
]
AUTHOR_SCHEMES = ["ORCID", "ROR", "ISNI", "LCNA", "VIAF", "GND", "DAI", "ResearcherID", "ScopusID"]
CROISSANT = "http://mlcommons.org/croissant/1.1"
# The terms of a Croissant document that are written here.
CROISSANT_CONTEXT = {
    "@language": "en", "@vocab": "http://schema.org/", "sc": "http://schema.org/", "cr": "http://mlcommons.org/croissant/", "dct": "http://purl.org/dc/terms/",
    "citeAs": "cr:citeAs", "conformsTo": "dct:conformsTo", "isLiveDataset": "cr:isLiveDataset", "sdVersion": "cr:sdVersion", "md5": "cr:md5",
}


def _or_blank(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def resource_type(kind: Column) -> Column:
    """Types of the vocabulary stay; anything else is a dataset, or nothing if it is an address."""
    return F.when(F.lower(kind).isin(RESOURCE_TYPES), kind).when(kind.startswith("http"), "").otherwise("Dataset")


def _name_or_blank(actor: Column) -> Column:
    return _or_blank(actor["name"])


def _in_slot(role: str, slot: str) -> Column:
    """What contributors of a role have for its slot, in their order: names, for the contact with the address; blanks are passed over."""
    actors = F.transform(F.filter("contributor", lambda c: c["role"] == role), lambda c: c["actor"])
    said = F.transform(actors, lambda a: contact_line(strip(a["name"]), strip(a["email"])) if slot == "contact" else _name_or_blank(a))
    return F.coalesce(F.filter(said, lambda v: v != ""), F.array().cast("array<string>"))


def slot_warnings() -> Column:
    """For each slot that several contributors claim, those that did not get it: ``slot: others``."""
    others = {slot: F.slice(_in_slot(role, slot), 2, F.greatest(F.size(_in_slot(role, slot)), F.lit(1))) for role, slot in SLOTS.items()}
    return F.array_compact(F.array(*[F.when(F.size(rest) > 0, F.concat(F.lit(f"{slot}: "), F.concat_ws(", ", rest))) for slot, rest in others.items()]))


def _credit(actor: Column, role: Column) -> Column:
    """A creator entry in the DataCite layout."""
    return F.struct(
        role.alias("role"), actor["name"].alias("name"), F.when(actor["kind"] == "Person", "Personal").otherwise("Organizational").alias("name_type"),
        actor["given"].alias("given_name"), actor["family"].alias("family_name"),
        actor["id_scheme"].alias("identifier_scheme"), actor["id_value"].alias("identifier"), actor["affiliation"].alias("affiliation"),
    )


def _office(actor: Column) -> Column:
    return F.struct(actor["name"].alias("name"), actor["id_scheme"].alias("scheme"), actor["id_value"].alias("identifier"))


def _descriptions() -> Column:
    """The abstract; techniques, each as a method, where no file could carry them."""
    entry = lambda text, kind: F.struct(text.alias("description"), F.lit(kind).alias("type"))
    usable = F.coalesce(F.exists("distribution", lambda d: _or_blank(d["url"]) != ""), F.lit(False))
    abstract = F.array_compact(F.array(F.when(_or_blank(F.col("description")) != "", entry(F.col("description"), "Abstract"))))
    methods = F.transform(F.filter("technique", lambda t: _or_blank(t) != ""), lambda t: entry(t, "Methods"))
    return F.when(usable, abstract).otherwise(F.concat(abstract, F.coalesce(methods, F.array().cast("array<struct<description:string,type:string>>"))))


#: Columns with a date and their types, in the order of the layout.
DATE_TYPES = {
    "date_created": "Created", "date_published": "Issued", "date_modified": "Updated",
    "copyright_year": "Copyrighted", "date_accepted": "Accepted", "date_submitted": "Submitted",
}


def _dates(columns: list[str]) -> Column:
    """Typed dates of the columns that there are, intervals of collection, and ends of embargoes with their conditions."""
    entry = lambda date, kind, about: F.struct(date.alias("date"), F.lit(kind).alias("type"), about.alias("information"))
    none = F.lit("")
    single = F.array_compact(F.array(*[F.when(_or_blank(F.col(c)) != "", entry(F.col(c), kind, none)) for c, kind in DATE_TYPES.items() if c in columns]))
    collected = F.transform(F.filter("temporal", lambda t: _or_blank(t) != ""), lambda t: entry(t, "Collected", none))
    available = F.transform(F.filter("conditions", lambda c: _or_blank(c["date"]) != ""), lambda c: entry(c["date"], "Available", _or_blank(c["condition"])))
    return F.concat(single, collected, available)


def _size(d: Column) -> Column:
    """A file's size with its unit; blank for an unknown size."""
    return F.when(d["size"].isNotNull(), F.concat_ws(" ", d["size"].cast("string"), F.nullif(d["unit"], F.lit(""))))


def datacite(records: DataFrame, key: str = "doc_id") -> DataFrame:
    """One column for each part of the DataCite layout, and warnings for contributors that found their slot taken."""
    r = F.col
    blank = F.lit("")
    conditions = F.concat_ws("; ", F.filter(F.transform("conditions", lambda c: c["condition"]), lambda c: _or_blank(c) != ""))
    doi_or_address = (
        F.when(r("identifier.scheme") == "DOI", "DOI").when(_or_blank(r("identifier.value")) != "", "Other").when(_or_blank(r("url")) != "", "URL").otherwise("")
    )
    resource = F.struct(
        first_filled(r("identifier.value"), r("identifier.url"), r("url")).alias("identifier"), doi_or_address.alias("identifier_type"),
        year_of(F.coalesce(first_filled(r("date_published"), r("date_created")), blank)).alias("publication_year"),
        resource_type(r("kind")).alias("resource_type"), _or_blank(r("version")).alias("version"), language_code(r("language")).alias("language"),
        *[_or_blank(F.get(_in_slot(role, slot), F.lit(0))).alias(slot) for role, slot in SLOTS.items()],
    )
    languages = F.array_compact(F.array(F.when(_or_blank(r("language")) != "", language_code(r("language")))))
    more_languages = F.transform(F.filter("other_languages", lambda x: _or_blank(x) != ""), language_code)
    others = F.filter("contributor", lambda c: ~c["role"].isin(list(SLOTS)))
    creators = F.concat(F.transform("creator", lambda a: _credit(a, F.lit("Creator"))), F.transform(others, lambda c: _credit(c["actor"], c["role"])))
    first_provider = F.get("provider", F.lit(0))
    publishers = F.array_compact(F.array(
        F.when(_name_or_blank(r("publisher")) != "", _office(r("publisher"))), F.when(F.size("provider") > 0, _office(first_provider)),
    ))
    subjects = F.transform(
        F.filter("keywords", lambda t: _or_blank(t["name"]) != ""),
        lambda t: F.struct(t["name"].alias("subject"), t["scheme"].alias("scheme"), t["identifier"].alias("value_uri")),
    )
    categories = F.transform(
        F.filter("about", lambda t: _or_blank(t["name"]) != ""), lambda t: F.struct(t["name"].alias("name"), _or_blank(t["scheme"]).alias("sub_category"))
    )
    named = frequency(r("periodicity"))
    event = F.struct(named.alias("frequency_type"), F.when(named == "", strip(r("periodicity"))).otherwise("").alias("description"))
    rights = F.transform("license", lambda x, i: F.struct(
        x["name"].alias("rights"), x["url"].alias("uri"), x["identifier"].alias("identifier"), F.when(_or_blank(x["identifier"]) != "", "SPDX").otherwise("").alias("scheme"),
        F.when(i == 0, conditions).otherwise("").alias("condition"), _or_blank(r("copyright_holder")).alias("holder"),
    ))
    links = F.filter("related", lambda x: F.lower(x["relation"]) != "thumbnail")
    related = F.concat(
        F.transform(links, lambda x: F.struct(x["url"].alias("identifier"), x["relation"].alias("relation"))),
        F.transform("derived_from", lambda d: F.struct(d["url"].alias("identifier"), F.lit("IsDerivedFrom").alias("relation"))),
    )
    alternates = F.transform(
        F.filter("same_as", lambda s: _or_blank(s["value"]) != ""),
        lambda s: F.struct(s["value"].alias("identifier"), F.when(s["value"].rlike("^https?://"), "URL").otherwise("Local").alias("type")),
    )
    media = F.transform("distribution", lambda d: F.struct(
        d["url"].alias("file_uri"), d["format"].alias("format"), _or_blank(_size(d)).alias("size"), _or_blank(d["checksum"]).alias("checksum"),
        F.lit("Digital").alias("physical_carrier"), F.concat_ws("; ", "technique").alias("measurement_technique"),
    ))
    return records.select(
        key, resource.alias("resource"),
        F.when(_or_blank(r("name")) != "", F.array(F.struct(r("name").alias("name"), F.lit("MainTitle").alias("type")))).otherwise(F.array()).alias("titles"),
        _descriptions().alias("descriptions"),
        F.concat(languages, F.coalesce(more_languages, F.array().cast("array<string>"))).alias("languages"),
        creators.alias("creators"), publishers.alias("publishers"), subjects.alias("subjects"), categories.alias("categories"),
        F.filter("audience", lambda a: _or_blank(a["audience"]) != "").alias("audiences"),
        _dates(records.columns).alias("dates"),
        F.when(_or_blank(r("periodicity")) != "", F.array(event)).otherwise(F.array()).alias("temporal_events"),
        F.transform("spatial", lambda s: F.struct(s["name"].alias("place"), s["description"].alias("description"), s["box"].alias("box"))).alias("geo_locations"),
        rights.alias("rights"),
        F.transform("funding", lambda f: F.struct(f["funder"]["name"].alias("funder"), f["name"].alias("award"), f["identifier"].alias("award_number"))).alias("funding_references"),
        related.alias("related_identifiers"), alternates.alias("alternate_identifiers"),
        F.transform("citation", lambda c: F.struct(c.alias("title"))).alias("citations"), media.alias("media_files"), slot_warnings().alias("warnings"),
    )


# Where identifiers of each scheme resolve.
RESOLVERS = {"ORCID": "https://orcid.org/", "ROR": "https://ror.org/", "ISNI": "https://isni.org/isni/", "DOI": "https://doi.org/"}


def address_of(scheme: Column, value: Column) -> Column:
    """Where an identifier resolves: itself if it is an address; null for other schemes and blanks."""
    made = F.coalesce(*[F.when(F.upper(scheme) == s, F.concat(F.lit(host), value)) for s, host in RESOLVERS.items()])
    return F.when(_or_blank(value) != "", F.when(value.rlike("^https?://"), value).otherwise(made))


def _agent(a: Column) -> Column:
    kind = F.when(a["kind"] == "Person", "sc:Person").otherwise("sc:Organization")
    return F.struct(kind.alias("type"), a["name"].alias("name"), address_of(a["id_scheme"], a["id_value"]).alias("url"))


def croissant(records: DataFrame, key: str = "doc_id") -> DataFrame:
    """Croissant fields, null where the layout leaves a field out, and warnings for what had to be made up or left out."""
    r = F.col
    identifier = first_filled(r("identifier.url"), F.when(F.upper("identifier.scheme") == "DOI", F.when(r("identifier.value").rlike("^https?://"), r("identifier.value")).otherwise(F.concat(F.lit("https://doi.org/"), F.nullif(r("identifier.value"), F.lit(""))))))
    licenses = F.filter(F.transform("license", lambda x: first_filled(x["url"], x["name"])), lambda x: x.isNotNull())
    creators = F.transform(F.filter("creator", lambda a: _or_blank(a["name"]) != ""), _agent)
    files = F.transform(F.filter("distribution", lambda d: _or_blank(d["url"]) != ""), lambda d: F.struct(d["url"].alias("content_url"), d["format"].alias("encoding_format"), _size(d).alias("content_size"), digest_kind(d["checksum"]).alias("digest"), F.when(digest_kind(d["checksum"]).isNotNull(), strip(d["checksum"])).alias("checksum")))
    url, published, created = first_filled(r("url"), identifier), F.nullif(r("date_published"), F.lit("")), F.nullif(r("date_created"), F.lit(""))
    warnings = F.array_compact(F.array(
        F.when(_or_blank(r("name")) == "", "name"), F.when(_or_blank(r("description")) == "", "description"), F.when(F.size(licenses) == 0, "license"), F.when(url.isNull(), "url"),
        F.when(F.size(creators) == 0, "creator"), F.when(published.isNull() & created.isNotNull(), "datePublished from dateCreated"), F.when(published.isNull() & created.isNull(), "datePublished"),
        F.when(F.exists("distribution", lambda d: (_or_blank(d["checksum"]) != "") & digest_kind(d["checksum"]).isNull()), "checksum"),
    ))
    return records.select(
        key, F.lit(CROISSANT).alias("conforms_to"), F.coalesce(first_filled(r("name"), r("identifier.value")), F.lit("Untitled resource")).alias("name"), F.coalesce(F.nullif(r("description"), F.lit("")), F.lit("No description was extracted for this resource.")).alias("description"),
        F.when(F.size(licenses) > 0, licenses).alias("license"), url.alias("url"), F.when(F.size(creators) > 0, creators).alias("creator"), F.when(_or_blank(r("publisher.name")) != "", _agent(r("publisher"))).alias("publisher"),
        F.coalesce(published, created).alias("date_published"), created.alias("date_created"),
        (F.nullif(r("date_modified"), F.lit("")) if "date_modified" in records.columns else F.lit(None).cast("string")).alias("date_modified"), F.when(F.size(files) > 0, files).alias("distribution"), F.when(F.size("keywords") > 0, F.transform("keywords", lambda t: t["name"])).alias("keywords"),
        F.nullif(r("version"), F.lit("")).alias("version"), F.nullif(language_code(r("language")), F.lit("")).alias("in_language"), F.when(F.size("same_as") > 0, F.transform("same_as", lambda s: s["value"])).alias("same_as"), warnings.alias("warnings"),
    )


def dataverse(records: DataFrame, subject: Column | None = None, key: str = "doc_id") -> DataFrame:
    """Fields of the citation block, and warnings. ``subject`` is one of SUBJECTS; without it every record is Other.

    The contact is the first ContactPerson with an address, else the first creator with one; without a name it takes
    the first author's. Nothing is left out that the server requires: placeholders stand in, each with a warning.
    """
    r = F.col
    known = lambda a: a["id_scheme"].isin(AUTHOR_SCHEMES) & (_or_blank(a["id_value"]) != "")
    author = lambda a: F.struct(
        a["name"].alias("author_name"), F.nullif(a["affiliation"], F.lit("")).alias("affiliation"),
        F.when(known(a), a["id_scheme"]).alias("identifier_scheme"), F.when(known(a), a["id_value"]).alias("identifier"),
    )
    authors_type = "array<struct<author_name:string,affiliation:string,identifier_scheme:string,identifier:string>>"
    nobody = F.array(F.struct(F.lit("Unknown"), F.lit(None), F.lit(None), F.lit(None))).cast(authors_type)
    has_mail = lambda a: email_in(a["email"]).isNotNull()
    person = F.get(F.filter("contributor", lambda c: (c["role"] == "ContactPerson") & has_mail(c["actor"])), F.lit(0))["actor"]
    chosen = F.coalesce(person, F.get(F.filter("creator", has_mail), F.lit(0)))
    allowed = F.when(subject.isin(SUBJECTS), subject).otherwise("Other") if subject is not None else F.lit("Other")
    found = F.coalesce(F.transform(F.filter("creator", lambda a: _or_blank(a["name"]) != ""), author), F.array().cast(authors_type))
    authors = F.when(F.size(found) > 0, found).otherwise(nobody)
    doi = F.when(F.upper("identifier.scheme") == "DOI", F.coalesce(F.nullif(r("identifier.url"), F.lit("")), address_of(r("identifier.scheme"), r("identifier.value"))))
    warnings = F.array_compact(F.array(
        F.when(_or_blank(r("name")) == "", "title"), F.when(F.size(found) == 0, "author"), F.when(chosen.isNull(), "contact"), F.when(_or_blank(r("description")) == "", "description"),
    ))
    return records.select(
        key, F.coalesce(first_filled(r("name"), r("identifier.value")), F.lit("Untitled resource")).alias("title"), authors.alias("author"),
        F.coalesce(chosen["name"], F.get(authors, F.lit(0))["author_name"]).alias("contact_name"), F.coalesce(email_in(chosen["email"]), F.lit("unknown@example.org")).alias("contact_email"),
        F.coalesce(F.nullif(r("description"), F.lit("")), F.lit("No description was extracted for this resource.")).alias("ds_description"), F.array(allowed).alias("subject"),
        F.transform(F.filter("keywords", lambda t: _or_blank(t["name"]) != ""), lambda t: t["name"]).alias("keyword"), first_filled(r("url"), doi).alias("alternative_url"), warnings.alias("warnings"),
    )


def _primitive(name: str, value: Column, kind: str = "primitive") -> Column:
    """A single field of the citation block; null without a value."""
    return F.when(value.isNotNull(), F.struct(value.alias("value"), F.lit(kind).alias("typeClass"), F.lit(False).alias("multiple"), F.lit(name).alias("typeName")))


def _several(name: str, values: Column, kind: str = "compound") -> Column:
    return F.struct(values.alias("value"), F.lit(kind).alias("typeClass"), F.lit(True).alias("multiple"), F.lit(name).alias("typeName"))


def dataverse_json(citation: DataFrame, key: str = "doc_id", license: str = "CC0 1.0", license_uri: str = "http://creativecommons.org/publicdomain/zero/1.0") -> DataFrame:
    """(key, json): rows of ``dataverse`` as the dataset that the server takes, each field with its type."""
    author = lambda a: F.struct(
        _primitive("authorName", a["author_name"]).alias("authorName"), _primitive("authorAffiliation", a["affiliation"]).alias("authorAffiliation"),
        _primitive("authorIdentifierScheme", a["identifier_scheme"], "controlledVocabulary").alias("authorIdentifierScheme"), _primitive("authorIdentifier", a["identifier"]).alias("authorIdentifier"),
    )
    contact = F.struct(_primitive("datasetContactName", F.col("contact_name")).alias("datasetContactName"), _primitive("datasetContactEmail", F.col("contact_email")).alias("datasetContactEmail"))
    keywords = F.transform("keyword", lambda k: F.struct(_primitive("keywordValue", k).alias("keywordValue")))
    fields = [
        _primitive("title", F.col("title")), _several("author", F.transform("author", author)), _several("datasetContact", F.array(contact)),
        _several("dsDescription", F.array(F.struct(_primitive("dsDescriptionValue", F.col("ds_description")).alias("dsDescriptionValue")))),
        _several("subject", F.col("subject"), "controlledVocabulary"), F.when(F.size("keyword") > 0, _several("keyword", keywords)), _primitive("alternativeURL", F.col("alternative_url")),
    ]
    head = F.concat(F.lit('{"datasetVersion":{"license":'), F.to_json(F.struct(F.lit(license).alias("name"), F.lit(license_uri).alias("uri"))), F.lit(',"metadataBlocks":{"citation":{"fields":['))
    return citation.select(key, F.concat(head, F.concat_ws(",", *[F.to_json(f) for f in fields]), F.lit('],"displayName":"Citation Metadata"}}}}')).alias("json"))


#: Members of a Croissant document, in their order, by column.
_CROISSANT_MEMBERS = {
    "conforms_to": "conformsTo", "name": "name", "description": "description", "license": "license", "url": "url", "creator": "creator", "publisher": "publisher",
    "date_published": "datePublished", "date_created": "dateCreated", "date_modified": "dateModified", "distribution": "distribution", "keywords": "keywords",
    "version": "version", "in_language": "inLanguage", "same_as": "sameAs",
}


def croissant_documents(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, json) of ``croissant`` rows: linked data with its context, agents and files as typed nodes, a file's digest under the name of its kind; absent
    members are left out."""
    agent = lambda a: F.when(a.isNotNull(), F.struct(a["type"].alias("@type"), a["name"].alias("name"), a["url"].alias("url")))
    digest = lambda d, kind: F.when(d["digest"] == kind, d["checksum"]).alias(kind)
    file = lambda d: F.struct(
        F.lit("cr:FileObject").alias("@type"), d["content_url"].alias("@id"), d["content_url"].alias("contentUrl"), F.nullif(d["encoding_format"], F.lit("")).alias("encodingFormat"),
        d["content_size"].alias("contentSize"), digest(d, "md5"), digest(d, "sha256"),
    )
    shaped = {"creator": F.transform("creator", agent), "publisher": agent(F.col("publisher")), "distribution": F.transform("distribution", file)}
    context = F.struct(*[F.lit(v).alias(k) for k, v in CROISSANT_CONTEXT.items()])
    members = [shaped.get(c, F.col(c)).alias(n) for c, n in _CROISSANT_MEMBERS.items() if c in rows.columns]
    return rows.select(key, F.to_json(F.struct(context.alias("@context"), F.lit("sc:Dataset").alias("@type"), *members), {"ignoreNullFields": "true"}).alias("json"))
