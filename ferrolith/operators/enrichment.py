"""Identifiers for the people and organisations that records name: only sure matches, and only where there is none yet.

Mentions are rows, so names are matched by joins over the whole batch; what is found goes back by place and position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrolith.functions.values import strip
from ferrolith.plans.schema import ACTOR, RECORD

#: What is found for one mention.
FOUND = "struct<scheme:string,value:string>"


def has_identifier(actor: Column) -> Column:
    """Whether an actor already carries a real identifier."""
    return F.coalesce(strip(actor["id_value"]), F.lit("")) != ""


def entry_has_identifier(entry: Column, member: str = "schema:identifier") -> Column:
    """The same for an entry of a linked-data document, a variant: its identifier may be an object or a list of objects."""
    held = F.try_variant_get(entry, f"$['{member}']", "variant")
    value = "$['schema:value']"
    one = F.coalesce(F.try_variant_get(held, value, "string"), F.lit("")) != ""
    several = F.exists(F.try_variant_get(held, "$", "array<variant>"), lambda x: F.coalesce(F.try_variant_get(x, value, "string"), F.lit("")) != "")
    kind = F.coalesce(F.schema_of_variant(held), F.lit(""))
    return F.when(kind.startswith("OBJECT"), one).when(kind.startswith("ARRAY"), F.coalesce(several, F.lit(False))).otherwise(False)


def is_sure(status: Column) -> Column:
    """A wrong identifier is worse than none: matches that need a review are not attached."""
    return F.coalesce(status == "auto", F.lit(False))


def mentions(records: DataFrame, key: str) -> DataFrame:
    """Everyone named without an identifier: (key, place, pos, person, name, given, family). Places: creator, affiliation, publisher, funder."""
    creators = records.select(key, F.lit("creator").alias("place"), F.posexplode("creator").alias("pos", "actor"))
    funders = records.select(key, F.lit("funder").alias("place"), F.posexplode(F.transform("funding", lambda g: g["funder"])).alias("pos", "actor"))
    publishers = records.select(key, F.lit("publisher").alias("place"), F.lit(0).alias("pos"), F.col("publisher").alias("actor"))
    named = creators.unionByName(publishers).unionByName(funders).where(F.col("actor").isNotNull())
    person = (F.col("actor.kind") == "Person") & (F.col("place") == "creator")
    open_ = named.where(~has_identifier(F.col("actor"))).select(key, "place", "pos", F.coalesce(person, F.lit(False)).alias("person"), "actor.name", "actor.given", "actor.family")
    offices = creators.where(F.coalesce(F.col("actor.affiliation"), F.lit("")) != "")
    offices = offices.select(key, F.lit("affiliation").alias("place"), "pos", F.lit(False).alias("person"), F.col("actor.affiliation").alias("name"), F.lit("").alias("given"), F.lit("").alias("family"))
    return open_.unionByName(offices)


def find(asked: DataFrame, key: str, organisations: DataFrame, people: DataFrame) -> DataFrame:
    """Sure matches of mentions: (key, place, pos, found).

    ``organisations`` (name, scheme, value, status) and ``people`` (given, family, value, status) have one row for each
    name. A person needs both names; everyone else is looked up as an organisation.
    """
    o = organisations.where(is_sure(F.col("status"))).select(F.col("name").alias("o_name"), F.struct("scheme", "value").cast(FOUND).alias("found"))
    p = people.where(is_sure(F.col("status"))).select(F.col("given").alias("p_given"), F.col("family").alias("p_family"), F.struct(F.lit("ORCID").alias("scheme"), "value").cast(FOUND).alias("found"))
    filled = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    offices = asked.where(~F.col("person") & filled("name")).join(o, F.col("name") == F.col("o_name"))
    persons = asked.where(F.col("person") & filled("given") & filled("family")).join(p, (F.col("given") == F.col("p_given")) & (F.col("family") == F.col("p_family")))
    columns = [key, "place", "pos", "found"]
    return offices.select(columns).unionByName(persons.select(columns))


def write_back(records: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """``records`` with what was found: identifiers of creators, publisher and funders, and a column ``affiliation_ids`` by creator position."""
    place = F.concat_ws(":", "place", F.col("pos").cast("string"))
    by_key = found.groupBy(F.col(key).alias("f_key")).agg(F.map_from_entries(F.collect_list(F.struct(place.alias("at"), "found"))).alias("found"))
    joined = records.join(by_key, F.col(key) == F.col("f_key"), "left").drop("f_key")
    at = lambda place, pos: F.try_element_at(F.col("found"), F.concat_ws(":", F.lit(place), pos.cast("string")))

    def filled(actor: Column, place: str, pos: Column) -> Column:
        new = at(place, pos)
        return F.when(new.isNotNull(), actor.withField("id_scheme", new["scheme"]).withField("id_value", new["value"])).otherwise(actor)

    return joined.withColumns({
        "creator": F.transform("creator", lambda a, i: filled(a, "creator", i)).cast(f"array<{ACTOR}>"),
        "publisher": F.when(F.col("publisher").isNotNull(), filled(F.col("publisher"), "publisher", F.lit(0))).cast(ACTOR),
        "funding": F.transform("funding", lambda g, i: F.when(g["funder"].isNotNull(), g.withField("funder", filled(g["funder"], "funder", i))).otherwise(g)).cast(RECORD["funding"]),
        "affiliation_ids": F.transform("creator", lambda a, i: at("affiliation", i)["value"]),
    }).drop("found")


def enrich(records: DataFrame, organisations: DataFrame, people: DataFrame, key: str = "doc_id") -> DataFrame:
    """All records, with the identifiers that sure matches give."""
    return write_back(records, find(mentions(records, key), key, organisations, people), key)
