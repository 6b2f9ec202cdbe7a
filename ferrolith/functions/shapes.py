"""Values of linked-data documents whose shape varies: a scalar or a list, a string or an object. Input is VARIANT."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ferrolith.functions.values import strip


def _is(v: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith(kind), F.lit(False))


def _strings(v: Column) -> Column:
    """The items of a list, or the value itself as the only item, as strings."""
    return F.when(_is(v, "ARRAY"), F.try_variant_get(v, "$", "array<string>")).otherwise(F.array(F.try_variant_get(v, "$", "string")))


def _filled(items: Column) -> Column:
    return F.filter(F.transform(items, strip), lambda x: x.isNotNull() & (x != ""))


def type_label(types: Column, default: str = "") -> Column:
    """The first label among a node's types, without its prefix: ``Person`` of ``["schema:Person"]`` or of the string alone."""
    bare = F.transform(_strings(types), lambda x: F.regexp_replace(x, r"^[^:]*:", ""))
    return F.coalesce(F.get(_filled(bare), F.lit(0)), F.lit(default))


def list_items(v: Column) -> Column:
    """The items of a list or of an ordered list object (``@list``); none for anything else."""
    return F.coalesce(F.try_variant_get(v, "$['@list']", "array<variant>"), F.when(_is(v, "ARRAY"), F.try_variant_get(v, "$", "array<variant>")), F.array().cast("array<variant>"))


def as_string(v: Column) -> Column:
    """A trimmed string: of a list the first filled item, of an object the value of its first key in alphabetical order."""
    of_object = F.get(F.map_values(F.try_variant_get(v, "$", "map<string,string>")), F.lit(0))
    found = F.when(_is(v, "ARRAY"), F.get(_filled(_strings(v)), F.lit(0))).when(_is(v, "OBJECT"), of_object).otherwise(F.try_variant_get(v, "$", "string"))
    return F.coalesce(strip(found), F.lit(""))


def as_strings(v: Column) -> Column:
    """A list of trimmed strings without blanks; a scalar is a list of one."""
    return F.coalesce(_filled(_strings(v)), F.array().cast("array<string>"))


def as_objects(v: Column, name: str = "schema:name") -> Column:
    """A list of objects, as JSON texts; a bare string becomes an object of its name, anything else is left out."""
    items = F.when(_is(v, "ARRAY"), F.try_variant_get(v, "$", "array<variant>")).otherwise(F.array(v))
    named = lambda x: F.to_json(F.struct(strip(F.try_variant_get(x, "$", "string")).alias(name)))
    text = F.transform(items, lambda x: F.when(_is(x, "OBJECT"), F.to_json(x)).when(_is(x, "STRING") & (strip(F.try_variant_get(x, "$", "string")) != ""), named(x)))
    return F.coalesce(F.filter(text, lambda x: x.isNotNull() & (x != "{}")), F.array().cast("array<string>"))


def as_object(v: Column, name: str = "schema:name") -> Column:
    """One object as JSON text: of a list its first item, of a string an object of its name; ``{}`` otherwise."""
    first = F.when(_is(v, "ARRAY"), F.get(F.try_variant_get(v, "$", "array<variant>"), F.lit(0))).otherwise(v)
    return F.coalesce(F.get(as_objects(first, name), F.lit(0)), F.lit("{}"))


def collapse_identifiers(identifiers: Column, same_as: Column) -> tuple[Column, Column]:
    """The first of several identifiers (scheme, value, url), and the other links with the rest of them added, by address or value; null for none."""
    rest = F.transform(F.slice(identifiers, 2, F.greatest(F.size(identifiers), F.lit(1))), lambda x: F.coalesce(F.nullif(x["url"], F.lit("")), x["value"], F.lit("")))
    links = F.concat(F.coalesce(same_as, F.array().cast("array<string>")), F.coalesce(rest, F.array().cast("array<string>")))
    return F.get(identifiers, F.lit(0)), F.when(F.size(links) > 0, links)


def is_role(node: Column) -> Column:
    """Whether a contributor entry is a role around an actor: by its keys, not by its type."""
    return F.try_variant_get(node, "$['schema:roleName']", "string").isNotNull() | F.try_variant_get(node, "$['schema:contributor']", "variant").isNotNull()


def id_and_title(file_name: Column) -> tuple[Column, Column]:
    """The numeric, perhaps hierarchical, identifier and the title of ``<id>. <title>.json``; nulls for other names."""
    pattern = r"(?s)^([0-9]+(?:\.[0-9]+)*)\.?\s*(.*)\.json$"
    fits = file_name.rlike(pattern)
    return F.when(fits, F.regexp_extract(file_name, pattern, 1)), F.when(fits, F.regexp_extract(file_name, pattern, 2))


def total_tokens(prompt: Column, completion: Column, total: Column) -> Column:
    """A call's tokens: as reported, or the sum of its parts where the report is zero or missing."""
    return F.when(F.coalesce(total, F.lit(0)) == 0, F.coalesce(prompt, F.lit(0)) + F.coalesce(completion, F.lit(0))).otherwise(total)


def display(values: Column) -> Column:
    """A set for people: sorted and joined by commas, ``(empty)`` for nothing."""
    return F.coalesce(F.nullif(F.concat_ws(", ", F.array_sort(values)), F.lit("")), F.lit("(empty)"))


def described(values: Column, found: Column, known: Column) -> Column:
    """One side of a measure for a report: no file, no way to read the measure, and nothing in the file are told apart."""
    return F.when(~found, "(file not found)").when(~known, "(no extractor for this metric)").otherwise(display(values))


def duration(seconds: Column) -> Column:
    """``75`` as ``1m 15s``, below a minute with one decimal."""
    return F.when(seconds < 60, F.format_string("%.1fs", seconds.cast("double"))).otherwise(F.format_string("%dm %ds", F.floor(seconds / 60).cast("int"), F.floor(seconds % 60).cast("int")))
