"""Persistent identifiers: prefixes, formats, check digits and forms for comparison."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ferrolith.functions.values import strip

# Fixed patterns: formats of identifiers.
FORMATS = {
    "DOI": r"(?i)^10\.[0-9]{4,9}/\S+$",
    "ROR": r"^https://ror\.org/0[a-hjkmnp-tv-z0-9]{6}[0-9]{2}$",
    "ISNI": r"^[0-9]{15}[0-9X]$",
    "ORCID": r"^[0-9]{4}-[0-9]{4}-[0-9]{4}-[0-9]{3}[0-9X]$",
}
# Lengths of hexadecimal digests and their names.
DIGESTS = {64: "sha256", 32: "md5"}


def strip_doi(value: Column) -> Column:
    return F.regexp_replace(strip(value), r"(?i)^(https?://)?(dx\.)?doi\.org/", "")


def strip_orcid(value: Column) -> Column:
    return F.regexp_replace(strip(value), r"(?i)^https?://orcid\.org/", "")


def check_digit(digits: Column) -> Column:
    """ISO 7064 MOD 11-2 check character of the first fifteen digits; null if they are not digits."""
    total = F.aggregate(F.split(F.substring(digits, 1, 15), ""), F.lit(0).cast("bigint"), lambda a, x: (a + F.ascii(x) - 48) * 2)
    digit = F.pmod(12 - F.pmod(total, F.lit(11)), F.lit(11))
    return F.when(digits.rlike("^[0-9]{15}"), F.when(digit == 10, "X").otherwise(digit.cast("string")))


def check_digit_ok(sixteen: Column) -> Column:
    """Whether sixteen characters end in their check character; false for anything that is not fifteen digits and one more."""
    return F.coalesce(sixteen.rlike(r"^[0-9]{15}[0-9X]$") & (F.substring(sixteen, 16, 1) == check_digit(sixteen)), F.lit(False))


def normalized_pid(scheme: Column, value: Column) -> Column:
    """The value as its scheme writes it for a check."""
    return F.when(scheme == "DOI", strip_doi(value)).when(scheme == "ISNI", F.replace(strip(value), F.lit(" "), F.lit(""))).when(scheme == "ORCID", strip_orcid(value)).otherwise(strip(value))


def pid_format_ok(scheme: Column, value: Column) -> Column:
    """Format and check digit by scheme; schemes that are not known pass."""
    v = normalized_pid(scheme, value)
    return (
        F.when(scheme == "DOI", v.rlike(FORMATS["DOI"]))
        .when(scheme == "ROR", v.rlike(FORMATS["ROR"]))
        .when(scheme == "ISNI", check_digit_ok(v))
        .when(scheme == "ORCID", v.rlike(FORMATS["ORCID"]) & check_digit_ok(F.replace(v, F.lit("-"), F.lit(""))))
        .otherwise(True)
    )


def resolved_from_status(status: Column) -> Column:
    """True below 400, false for 404, else unknown."""
    return F.when(status < 400, True).when(status == 404, False)


def comparison_form(scheme: Column, value: Column) -> Column:
    """Identifiers alike are equal strings: digits of an ISNI, bare and lower-case ROR and ORCID."""
    kept = F.regexp_replace(F.upper(value), "[^0-9X]", "")
    upper = F.upper(scheme)
    return (
        F.when(upper == "ISNI", F.when(F.length(kept) == 16, kept).otherwise(""))
        .when(upper == "ROR", F.regexp_replace(F.lower(strip(value)), r"^https?://ror\.org/", ""))
        .when(upper == "ORCID", F.regexp_replace(F.lower(strip(value)), r"^https?://orcid\.org/", ""))
        .otherwise(F.lower(strip(value)))
    )


def scheme_of_url(url: Column) -> Column:
    """Scheme by the host of an identifier's address, null for others."""
    return F.when(url.rlike(r"(?i)^https?://ror\.org/"), "ROR").when(url.rlike(r"(?i)^https?://(www\.)?isni\.org/"), "ISNI").when(url.rlike(r"(?i)^https?://orcid\.org/"), "ORCID").when(url.rlike(r"(?i)^https?://(dx\.)?doi\.org/"), "DOI")


def digest_kind(digest: Column) -> Column:
    """``sha256`` or ``md5`` by the number of hexadecimal digits, else null."""
    hexadecimal = strip(digest).rlike("^[0-9A-Fa-f]+$")
    return F.when(hexadecimal & (F.length(strip(digest)) == 64), DIGESTS[64]).when(hexadecimal & (F.length(strip(digest)) == 32), DIGESTS[32])


def identifier_entries(ror: Column, isni: Column, orcid: Column) -> Column:
    """Identifiers that are there as (scheme, value, url), in the order ROR, ISNI, ORCID; addresses are not prefixed twice."""
    bare = lambda v, host: F.regexp_replace(v, rf"^https?://{host}/", "")
    entry = lambda scheme, v, value, url: F.when(F.coalesce(v, F.lit("")) != "", F.struct(F.lit(scheme).alias("scheme"), value.alias("value"), url.alias("url")))
    return F.array_compact(F.array(
        entry("ROR", ror, F.concat(F.lit("https://ror.org/"), bare(ror, r"ror\.org")), F.concat(F.lit("https://ror.org/"), bare(ror, r"ror\.org"))),
        entry("ISNI", isni, bare(isni, r"isni\.org/isni"), F.concat(F.lit("https://isni.org/isni/"), bare(isni, r"isni\.org/isni"))),
        entry("ORCID", orcid, bare(orcid, r"orcid\.org"), F.concat(F.lit("https://orcid.org/"), bare(orcid, r"orcid\.org"))),
    ))


def ror_display_name(names: Column) -> Column:
    """Of ``array<struct<value, types>>`` the name marked for display, else the first."""
    return F.coalesce(F.get(F.filter(names, lambda n: F.array_contains(n["types"], "ror_display")), 0)["value"], F.get(names, 0)["value"])


def ror_isni(external_ids: Column) -> Column:
    """Of ``array<struct<type, preferred, all>>`` the ISNI without spaces: the preferred one, else the first."""
    entry = F.get(F.filter(external_ids, lambda e: F.lower(e["type"]) == "isni"), 0)
    return F.replace(F.coalesce(F.nullif(entry["preferred"], F.lit("")), F.get(entry["all"], 0)), F.lit(" "), F.lit(""))


def ror_country(locations: Column) -> Column:
    """Country code of the first of ``array<struct<country_code>>``."""
    return F.upper(F.get(locations, 0)["country_code"])


def ror_parent(relationships: Column) -> Column:
    """First relation of the kind parent in ``array<struct<id, label, type>>``."""
    return F.get(F.filter(relationships, lambda r: F.lower(r["type"]) == "parent"), 0)


def scheme_of_host(url: Column) -> Column:
    """(scheme, value, url) of an identifier's address; an address of no known registry has neither scheme nor value."""
    scheme = F.when(scheme_of_url(url) == "DOI", None).otherwise(scheme_of_url(url))
    value = F.when(scheme.isNotNull(), F.nullif(F.regexp_extract(F.regexp_replace(url, r"/+$", ""), r"([^/]+)$", 1), F.lit("")))
    return F.struct(scheme.alias("scheme"), value.alias("value"), url.alias("url"))


def entity_identifiers(primary: Column, legacy: Column, same_as: Column) -> Column:
    """All identifiers of an entity as (scheme, value, url): its own, the older list where there is none of its own, and those that its other addresses are.

    ``primary`` is (scheme, value, url), ``legacy`` a list of such, ``same_as`` a list of addresses; entries without value and address, and repeats, are left out.
    """
    kind = "array<struct<scheme:string,value:string,url:string>>"
    filled = lambda x: (F.coalesce(x["value"], F.lit("")) != "") | (F.coalesce(x["url"], F.lit("")) != "")
    own = F.filter(F.array_compact(F.array(primary)).cast(kind), filled)
    older = F.filter(F.coalesce(legacy.cast(kind), F.array().cast(kind)), filled)
    others = F.transform(F.filter(F.coalesce(same_as, F.array().cast("array<string>")), lambda u: F.coalesce(u, F.lit("")) != ""), scheme_of_host).cast(kind)
    return F.array_distinct(F.concat(F.when(F.size(own) > 0, own).otherwise(older), others))
