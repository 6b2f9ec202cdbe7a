"""Names of organisations and people, and strings made for people to read."""

from __future__ import annotations

import re
import unicodedata
from functools import cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ferrolith.functions.values import strip

# Abbreviations of Spanish institutions, longest first, and what they stand for.
ABBREVIATIONS = {
    "subsec.": "subsecretaria",
    "depto.": "departamento",
    "u. de": "universidad de",
    "univ.": "universidad",
    "inst.": "instituto",
    "dept.": "departamento",
    "serv.": "servicio",
    "min.": "ministerio",
    "mun.": "municipalidad",
    "gob.": "gobierno",
}
# Legal forms that are dropped at the end of a name.
LEGAL_FORMS = ["inc", "ltd", "limited", "llc", "gmbh", "corp", "corporation", "sa", "s.a.", "nv", "bv", "plc", "pty", "pte", "spa", "ag", "kg", "oyj", "ab", "as", "aps", "srl", "sarl", "bvba", "nvsa"]

# Language names and their two-letter codes.
LANGUAGE_CODES = {
    "spanish": "es", "español": "es", "espanol": "es", "english": "en", "inglés": "en", "ingles": "en", "portuguese": "pt", "portugués": "pt", "portugues": "pt",
    "french": "fr", "français": "fr", "francais": "fr", "german": "de", "deutsch": "de", "chinese": "zh", "中文": "zh", "japanese": "ja", "日本語": "ja", "korean": "ko", "한국어": "ko",
}
# How often something happens.
FREQUENCIES = {"mensual": "monthly", "monthly": "monthly", "diario": "daily", "daily": "daily", "semanal": "weekly", "weekly": "weekly", "anual": "yearly", "yearly": "yearly"}
# Characters that registry searches reserve.
RESERVED = r"""[\\+\-&|!(){}\[\]^"~*?:/]"""


@cache
def _folds() -> tuple[str, str]:
    """Letters of any script that decompose into one letter and marks, with that letter: made by the rule, not listed."""
    pairs = []
    for code in [*range(0xA0, 0x1100), *range(0x1200, 0xAC00), *range(0xF900, 0x10000)]:
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if len(base) == 1 and base != chr(code):
            pairs.append((chr(code), base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def fold_marks(text: Column) -> Column:
    """Accents and other marks off letters of any script, composed or as combining marks, in generated code; signs that stand for several
    letters, such as ligatures and Hangul syllables, stay as they are (``fold_accents`` takes those apart, too)."""
    return F.regexp_replace(F.translate(text, *_folds()), r"\p{Mn}+", "")


#: Bytes of text, at least, that are Python's at once.
FOLDED_AT_ONCE = 1 << 18


def _folded(texts: pa.Array) -> pa.Array:
    """``fold_accents`` of an Arrow column, some texts at a time: the rest of it, and of what has been made of it, stays Arrow's."""
    parts, lo, held = [pa.array([], pa.string())], 0, 0
    for hi, size in enumerate(pc.fill_null(pc.binary_length(texts), 0), 1):
        held += size.as_py()
        if held >= FOLDED_AT_ONCE or hi == len(texts):
            some = texts.slice(lo, hi - lo).to_pylist()
            parts.append(pa.array([None if s is None else "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)) for s in some], pa.string()))
            lo, held = hi, 0
    return pa.concat_arrays(parts)


@F.arrow_udf(StringType())
def _take_apart(text: pa.Array) -> pa.Array:
    return _folded(text)


def fold_accents(text: Column) -> Column:
    """Compatibility decomposition without combining marks, for any script (an Arrow function; Spark has no normaliser). ASCII stays as it is, and
    never goes to Python."""
    plain = F.octet_length(text) == F.length(text)
    return F.coalesce(F.when(plain, text), _take_apart(F.when(~plain, text)))


def expand_abbreviations(text: Column) -> Column:
    """Abbreviations at the start of a word in full; a longer one wins over a shorter."""
    for short, full in ABBREVIATIONS.items():
        pattern = r"\s+".join(re.escape(p) for p in short.split(" "))
        text = F.regexp_replace(text, rf"(?iU)\b{pattern}", full)
    return text


def normalize_org(name: Column) -> Column:
    """A name for comparison: lower case, no accents, abbreviations in full, no legal form, no punctuation but - and _."""
    text = expand_abbreviations(fold_marks(F.lower(strip(name))))
    forms = "|".join(re.escape(f) for f in LEGAL_FORMS)
    text = F.regexp_replace(text, rf"(?iU)\b({forms})\b\.?\s*$", "")
    text = F.regexp_replace(text, r"(?U)[^\w\s-]", "")
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))


def clean_publisher(name: Column) -> Column:
    """A publisher's name without the trailing government and country notes of one national catalogue."""
    return strip(F.regexp_replace(F.regexp_replace(name, r"(?i)\s*-\s*Gobierno de Chile\s*$", ""), r"(?i)\s*\(Chile\)\s*$", ""))


def escape_query(text: Column) -> Column:
    """Reserved characters of a registry search behind a backslash."""
    return F.regexp_replace(text, f"({RESERVED})", r"\\$1")


def lookup(table: dict[str, str], key: Column) -> Column:
    """A value of a short fixed table, null where the key is missing."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def language_code(name: Column) -> Column:
    """Two-letter code of a language's name; two letters pass through, anything else stays."""
    key = F.lower(strip(name))
    return F.coalesce(lookup(LANGUAGE_CODES, key), F.when(F.length(key) == 2, key), name)


def frequency(text: Column) -> Column:
    return F.coalesce(lookup(FREQUENCIES, F.lower(strip(text))), F.lit(""))


def output_name(hint: Column, doi: Column, title: Column) -> Column:
    """File name of a record: from the hint, the DOI or the title, in this order."""
    keep = lambda text, most: F.substring(F.regexp_replace(text, r"(?U)[^\w-]", ""), 1, most)
    return F.concat(
        F.when(F.coalesce(hint, F.lit("")) != "", keep(hint, 80))
        .when(F.coalesce(doi, F.lit("")) != "", F.replace(F.replace(doi, F.lit("/"), F.lit("_")), F.lit(":"), F.lit("-")))
        .when(F.coalesce(title, F.lit("")) != "", F.coalesce(F.nullif(F.trim(keep(title, 50)), F.lit("")), F.lit("untitled")))
        .otherwise("output"),
        F.lit(".json"),
    )


def model_label(model: Column) -> Column:
    """A model's name as a column name: ``.``, ``:`` and ``/`` written as underscores (``:`` as two)."""
    return F.replace(F.replace(F.replace(model, F.lit("."), F.lit("_")), F.lit(":"), F.lit("__")), F.lit("/"), F.lit("_"))


def split_provider(model: Column, default: str) -> tuple[Column, Column]:
    """``provider:model`` as two columns; without a colon the provider is the default."""
    parts = F.split(model, ":", 2)
    return F.when(F.size(parts) > 1, F.get(parts, 0)).otherwise(default), F.element_at(parts, -1)


def contact_line(name: Column, email: Column) -> Column:
    """``name (email)``, or whichever there is."""
    n, e = F.coalesce(name, F.lit("")), F.coalesce(email, F.lit(""))
    return F.when((n != "") & (e != ""), F.concat(n, F.lit(" ("), e, F.lit(")"))).when(n != "", n).otherwise(e)


def citation(title: Column, volume: Column, issue: Column, start_page: Column, end_page: Column, edition: Column, place: Column, date: Column) -> Column:
    """A reference as one sentence of the parts that are there; empty if none is."""
    t, v, i, a, b, e, p, d = (F.nullif(strip(c), F.lit("")) for c in (title, volume, issue, start_page, end_page, edition, place, date))
    joined = F.concat_ws(
        ", ", t,
        F.when(v.isNotNull(), F.concat(v, F.coalesce(F.concat(F.lit("("), i, F.lit(")")), F.lit("")))),
        F.when(a.isNotNull(), F.concat_ws("-", a, b)),
        F.concat(F.lit("ed. "), e), p, d,
    )
    return F.when(joined != "", F.concat(joined, F.lit("."))).otherwise("")


def render_prompt(template: Column, values: dict[str, Column]) -> Column:
    """``{key}`` written out, literally, in the order of the keys."""
    for key, value in values.items():
        template = F.replace(template, F.lit(f"{{{key}}}"), F.coalesce(value, F.lit("")))
    return template


#: Members of a resource that come first in a prompt, in this order.
FIRST_FIELDS = ("title", "description", "url", "doi", "fetched_content")


def prompt(template: Column, values: dict[str, Column], context: Column, resource: Column) -> Column:
    """A prompt: the template written out, then what earlier results gave, then the resource.

    ``context`` (array of field and value) and ``resource`` (map of texts) become lines ``key: value`` without the blank ones; of the resource the
    five known members come first, others after them by name. Parts without a line are left out.
    """
    line = lambda k, v: F.when(F.coalesce(strip(v), F.lit("")) != "", F.concat(k, F.lit(": "), v))
    earlier = F.concat_ws("\n", F.transform(context, lambda c: line(c["field"], c["value"])))
    own = F.coalesce(resource, F.create_map().cast("map<string,string>"))
    known = [line(F.lit(k), F.try_element_at(own, F.lit(k))) for k in FIRST_FIELDS]
    others = F.transform(F.array_sort(F.array_except(F.map_keys(own), F.array(*map(F.lit, FIRST_FIELDS)))), lambda k: line(k, F.try_element_at(own, k)))
    return F.concat_ws("\n\n", *[F.nullif(part, F.lit("")) for part in (render_prompt(template, values), earlier, F.concat_ws("\n", *known, others))])


def resource_block(fields: dict[str, Column]) -> Column:
    """Lines ``key: value`` of the fields that are not blank."""
    return F.concat_ws("\n", *[F.when(F.coalesce(strip(v), F.lit("")) != "", F.concat(F.lit(f"{k}: "), v)) for k, v in fields.items()])


# Fixed pattern: an address of electronic mail.
MAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


def email_in(text: Column) -> Column:
    """The first thing in a text that looks like an address of electronic mail, or null."""
    return F.nullif(F.regexp_extract(text, MAIL, 0), F.lit(""))


# What providers write when they refuse a key.
REFUSALS = ["401", "unauthorized", "invalid api key", "incorrect api key", "no auth credentials", "authenticationerror"]


def friendly_error(raw: Column, headline: str = "The API key was rejected: check it in the settings.") -> Column:
    """An error for people: a refused key gets a headline before the provider's own words, anything else stays as it is."""
    refused = F.exists(F.array(*map(F.lit, REFUSALS)), lambda mark: F.contains(F.lower(raw), mark))
    return F.when(refused, F.concat(F.lit(f"{headline} ("), raw, F.lit(")"))).otherwise(raw)


def scoring_form(text: Column) -> Column:
    """A name as measures compare it: without space at the ends, in lower case, without accents."""
    return fold_marks(F.lower(strip(text)))
