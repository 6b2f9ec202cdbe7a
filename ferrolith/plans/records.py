"""A rule-based extractor: records made from the columns of ``documents`` by fixed rules, for runs without any model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrolith.plans.schema import ACTOR, RECORD


def _empty(kind: str) -> Column:
    return F.array().cast(kind)


def _actor(kind: Column, name: Column, scheme: Column, value: Column) -> Column:
    blank = F.lit("")
    return F.struct(kind.alias("kind"), name.alias("name"), blank.alias("given"), blank.alias("family"), blank.alias("email"), scheme.alias("id_scheme"), value.alias("id_value"), blank.alias("affiliation")).cast(ACTOR)


def records_of(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, lang, source) as records: doc_id and the columns of RECORD."""
    k, source, lang = F.col("doc_id"), F.col("source"), F.col("lang")
    rest = lambda n: F.pmod(k, F.lit(n))
    number = k.cast("string")
    doi = F.concat(F.lit("10.5555/rec."), number)
    has_doi = rest(3) == 0
    person = _actor(F.lit("Person"), F.concat(F.lit("Ann "), source), F.when(rest(2) == 0, "ORCID").otherwise(""), F.when(rest(2) == 0, "0000-0002-1825-0097").otherwise(""))
    office = _actor(F.lit("Organization"), F.concat(F.lit("Office "), lang), F.lit(""), F.lit(""))
    cc = F.struct(F.lit("CC BY 4.0").alias("name"), F.lit("https://creativecommons.org/licenses/by/4.0/").alias("url"), F.lit("CC-BY-4.0").alias("identifier"))
    own = F.struct(F.concat(F.lit("Terms of "), source).alias("name"), F.lit("").alias("url"), F.lit("").alias("identifier"))
    licenses = F.when(rest(4) == 1, F.array(cc)).when(rest(4) == 2, F.array(own)).when(rest(4) == 3, F.array(cc, own)).otherwise(_empty(RECORD["license"]))
    term = lambda c: F.struct(c.alias("name"), F.lit("").alias("scheme"), F.lit("").alias("identifier"))
    file = F.struct(F.concat(F.lit("https://files.example.org/"), number, F.lit(".csv")).alias("url"), F.lit("CSV").alias("format"), (F.length("text") / 1000.0).cast("double").alias("size"), F.lit("kB").alias("unit"), F.md5("text").alias("checksum"))
    columns = {
        "name": F.when(rest(11) == 0, "").otherwise(F.concat(F.lit("Record "), number)),
        "description": F.when(rest(7) == 0, "").otherwise(F.col("text")),
        "url": F.when(rest(5) == 0, "").otherwise(F.concat(F.lit("https://data.example.org/"), source, F.lit("/"), number)),
        "identifier": F.struct(F.when(has_doi, "DOI").otherwise("").alias("scheme"), F.when(has_doi, doi).otherwise("").alias("value"), F.when(has_doi, F.concat(F.lit("https://doi.org/"), doi)).otherwise("").alias("url")),
        "license": licenses,
        "distribution": F.when(rest(3) == 1, F.array(file)).otherwise(_empty(RECORD["distribution"])),
        "kind": F.when(rest(13) == 0, "Report of things").otherwise("Dataset"),
        "language": lang,
        "date_created": F.when(rest(20) == 0, "").otherwise(F.concat((1990 + rest(30)).cast("string"), F.lit("-01-02"))),
        "date_published": F.when(rest(10) == 0, "").otherwise(F.concat((2000 + rest(25)).cast("string"), F.lit("-05"))),
        "keywords": F.when(rest(8) == 0, _empty(RECORD["keywords"])).otherwise(F.array(term(source), term(lang))),
        "creator": F.when(rest(6) == 0, _empty(RECORD["creator"])).when(rest(4) == 1, F.array(person, office)).otherwise(F.array(person)),
        "publisher": F.when(rest(9) != 0, _actor(F.lit("Organization"), F.concat(F.lit("Data Office "), source), F.lit(""), F.lit(""))),
    }
    default = lambda kind: _empty(kind) if kind.startswith("array") else F.lit("" if kind == "string" else None).cast(kind)
    return docs.select("doc_id", *[columns.get(c, default(kind)).cast(kind).alias(c) for c, kind in RECORD.items()])
