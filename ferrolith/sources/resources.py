"""Resource descriptions from JSON files, one object to a file: a file that cannot be read becomes a row with an error."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from json import dumps

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from ferrolith.functions.values import strip
from ferrolith.sources.stores import files_of, is_folder

#: Rows that a task hands on at once.
ROWS_AT_ONCE = 10_000
FIELDS = ["url", "title", "description", "doi", "fetched_content"]


def parse_resources(files: DataFrame, text: str = "value", path: str = "path") -> DataFrame:
    """(path, the five fields, extras as a variant, error) from whole texts of files."""
    parsed = files.withColumn("v", F.try_parse_json(F.col(text)))
    kind = F.schema_of_variant("v")
    error = F.when(F.col("v").isNull(), "not JSON").when(~kind.startswith("OBJECT"), "not an object")
    get = lambda k: F.try_variant_get("v", f"$.{k}", "string")
    ok = parsed.withColumn("error", error)
    return ok.select(F.col(path).alias("path"), *[F.when(F.col("error").isNull(), get(k)).alias(k) for k in FIELDS], F.when(F.col("error").isNull(), F.col("v")).alias("extras"), "error")


def in_few_tasks(files: DataFrame) -> DataFrame:
    """Rows of whole small files, in as many tasks as a shuffle has at most: Spark counts 4 MB for opening a file, and would start a task for every 32."""
    return files.coalesce(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def whole_files(spark: SparkSession, pattern: str) -> DataFrame:
    """Files of a folder or glob, without hidden and empty ones: (path, modificationTime, length, content).

    A folder that pyarrow reaches is listed in tasks (``stores.files_of``). What Spark's own reader finds otherwise, by a glob or in another store, the
    driver lists, and it has to hold about a kilobyte for each file.
    """
    if is_folder(spark, pattern):
        return files_of(spark, pattern)
    return in_few_tasks(spark.read.format("binaryFile").load(pattern))


def read_resources(spark: SparkSession, pattern: str) -> DataFrame:
    """Files of a folder (``*.json`` there, not below), of a glob, or one file; nothing there: one row with an error.

    Rows come in no order; sort by ``path`` where order matters. Folders are listed as in ``whole_files``.
    """
    if is_folder(spark, pattern):
        return parse_resources(files_of(spark, pattern, ".json", as_uris=True).select(F.col("content").cast("string").alias("value"), "path"))
    options = {"pathGlobFilter": "*.json", "recursiveFileLookup": "false"}
    try:
        files = spark.read.options(**options).text(pattern, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        missing = spark.createDataFrame([("{}", pattern)], "value string, path string")
        return parse_resources(missing).withColumn("error", F.lit("not found"))
    return parse_resources(in_few_tasks(files))


def unwrap_attributes(v: Column) -> Column:
    """The inner record of an envelope ``metadata.attributes``, or the record itself."""
    return F.coalesce(F.try_variant_get(v, "$.metadata.attributes", "variant"), v)


def read_review_csv(spark: SparkSession, path: str) -> DataFrame:
    """A review table with a header; a byte order mark before the first name is taken off."""
    rows = spark.read.csv(path, header=True)
    return rows.toDF(*[c.lstrip("﻿") for c in rows.columns])


def json_of(text: Column) -> Column:
    """JSON out of a model's answer: as it is, or from the first brace to the last."""
    return F.coalesce(F.try_parse_json(text), F.try_parse_json(F.regexp_extract(text, r"(?s)\{.*\}", 0)))


def coerced_list(text: Column, schema: StructType | str) -> Column:
    """A list that was given as a JSON string; null unless it is a list."""
    v = F.try_parse_json(text)
    return F.when(F.schema_of_variant(v).startswith("ARRAY"), F.from_json(text, schema))


def _unique(members: list[tuple[str, object]]) -> dict:
    found = dict(members)
    if len(found) < len(members):
        raise ValueError("a key stands twice")
    return found


def _no_constant(name: str) -> None:
    raise ValueError(f"{name} is not JSON")


def parsed(text: str | None):
    """A JSON text's value in a list, an empty list if it is none: a key given twice and nesting beyond the parser's are errors, as in a variant."""
    try:
        return [json.loads(text, object_pairs_hook=_unique, parse_constant=_no_constant)] if text is not None else []
    except (ValueError, RecursionError):
        return []


def visited(text: str | None) -> Iterator[tuple[str, str, str | None, object]]:
    """Every value inside a JSON text, each before those in it and in their order: (path, path of what holds it, member's key, value)."""
    todo: list[tuple[str, str, str | None, object]] = [("", "", None, v) for v in parsed(text)]
    while todo:
        path, _, _, value = todo[-1]
        yield todo.pop()
        if isinstance(value, dict):
            todo += [(f"{path}.{k}" if path else k, path, k, v) for k, v in reversed(value.items())]
        elif isinstance(value, list):
            todo += [(f"{path}[{i}]", path, None, v) for i, v in reversed([*enumerate(value)])]


#: JSON kinds by Python type.
JSON_KINDS = {dict: "object", list: "array", str: "string", bool: "boolean", int: "number", float: "number", type(None): "null"}


def in_tasks(docs: DataFrame, key: str, json_column: str, rows_of: Callable[[str | None], Iterator[tuple]], columns: str) -> DataFrame:
    """``rows_of`` each JSON text, behind its key: one pass of each task over its own texts, without a shuffle or a limit on rows or depth."""
    fields = [docs.schema[key], *_parse_datatype_string(columns).fields]
    shape = StructType(fields)
    types = to_arrow_schema(shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[tuple] = []
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for row in rows_of(text):
                    held.append((k, *row))
                    if len(held) == ROWS_AT_ONCE:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held, strict=True), types, strict=True)], schema=types)
                        held = []
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held, strict=True), types, strict=True)], schema=types)

    return docs.select(key, json_column).mapInArrow(run, shape)


def walk(docs: DataFrame, key: str, json: str) -> DataFrame:
    """Every value inside a JSON text, at any depth: (key, path, parent, name, kind, value).

    ``parent`` is the path of the object or list that holds it; ``name`` is the member's key, null for list items and the text itself; ``value`` is a
    string's text or another scalar as JSON, null for objects, lists and null.
    """

    def rows_of(text: str | None) -> Iterator[tuple]:
        for path, parent, name, v in visited(text):
            yield path, parent, name, JSON_KINDS[type(v)], v if isinstance(v, str) else None if v is None or isinstance(v, (dict, list)) else dumps(v)

    return in_tasks(docs, key, json, rows_of, "path string, parent string, name string, kind string, value string")


def id_pairs(docs: DataFrame, key: str, json: str, id_key: str = "value", scheme_key: str = "scheme") -> DataFrame:
    """Every object, at any depth, that holds both an identifier and its scheme as strings: (key, scheme, value, path)."""

    def rows_of(text: str | None) -> Iterator[tuple]:
        for path, _, _, v in visited(text):
            if isinstance(v, dict) and isinstance(v.get(id_key), str) and isinstance(v.get(scheme_key), str):
                yield v[scheme_key], v[id_key], path

    return in_tasks(docs, key, json, rows_of, "scheme string, value string, path string")


def closed_errors(docs: DataFrame, key: str, json: str, declared: list[tuple[str, str, bool]]) -> DataFrame:
    """What a configuration has against its declared keys, as rows (key, path, error): ``unknown``, ``missing``, ``not a ...``, ``empty``.

    ``declared`` are (path, kind, required), list items written ``[]``. Only the outermost of unknown keys is
    named; a required key counts as missing in each object that should hold it. A blank text is ``empty``, any other that is no JSON object an error, too.
    """
    spark = docs.sparkSession
    nodes = walk(docs, key, json)
    general = lambda c: F.regexp_replace(c, r"\[\d+\]", "[]")
    nodes = nodes.withColumns({"at": general(F.col("path")), "in": general(F.col("parent"))})
    known = spark.createDataFrame([("", "object", False), *declared], "d_path string, d_kind string, d_required boolean")
    seen = nodes.join(F.broadcast(known), F.col("at") == F.col("d_path"), "left")  # the declared keys alone
    held = known.select(F.col("d_path").alias("h_path"))
    unknown = seen.where(F.col("d_path").isNull() & F.col("name").isNotNull()).join(F.broadcast(held), F.col("in") == F.col("h_path")).select(key, "path", F.lit("unknown").alias("error"))
    wrong = seen.where(F.col("kind") != F.col("d_kind")).select(key, "path", F.concat(F.lit("not a "), "d_kind").alias("error"))
    wrong = wrong.where(F.col("path") != "")
    last = F.regexp_extract("d_path", r"([^.]*)$", 1)
    needed = known.where("d_required").select(F.regexp_replace("d_path", r"\.?[^.]*$", "").alias("n_in"), last.alias("n_name"))
    wanted = nodes.where(F.col("kind") == "object").join(F.broadcast(needed), F.col("at") == F.col("n_in")).select(F.col(key).alias("w_key"), F.col("path").alias("w_path"), "n_name")
    there = nodes.where(F.col("name").isNotNull()).select(key, "parent", "name")
    same = F.col("w_key").eqNullSafe(F.col(key)) & (F.col("w_path") == F.col("parent")) & (F.col("n_name") == F.col("name"))
    missing = wanted.join(there, same, "left_anti").select(F.col("w_key").alias(key), F.concat(F.when(F.col("w_path") != "", F.concat("w_path", F.lit("."))).otherwise(""), "n_name").alias("path"), F.lit("missing").alias("error"))
    blank = F.coalesce(strip(F.col(json)), F.lit("")) == ""
    whole = F.when(blank, "empty").when(~F.coalesce(F.schema_of_variant(F.try_parse_json(F.col(json))).startswith("OBJECT"), F.lit(False)), "not a JSON object")
    return unknown.unionByName(wrong).unionByName(missing).unionByName(docs.select(key, F.lit("").alias("path"), whole.alias("error")).where(F.col("error").isNotNull()))


def listed_objects(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, length, content) of the objects below a prefix or glob; empty objects, which stand for folders, are left out."""
    return whole_files(spark, pattern).where(F.col("length") > 0).select("path", "length", "content")


def needs_page(content: Column, url: Column) -> Column:
    """Whether a resource's page is worth fetching: it has an address and no content yet."""
    blank = lambda c: F.coalesce(strip(c), F.lit("")) == ""
    return blank(content) & ~blank(url)
