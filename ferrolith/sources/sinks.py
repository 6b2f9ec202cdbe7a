"""Documents as files, tables and reports."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, IntegerType, LongType, StringType, StructType

from ferrolith.operators.ranking import collision_names
from ferrolith.plans.schema import CURIES
from ferrolith.sources.files import write_folder


def as_json(documents: DataFrame, key: str, pretty: bool = False) -> DataFrame:
    """(key, json): known columns under their linked-data names and in their order, others after them by name; nulls left out."""
    known = [c for c in CURIES if c in documents.columns]
    rest = sorted(c for c in documents.columns if c not in CURIES and c != key)
    options = {"ignoreNullFields": "true"} | ({"pretty": "true"} if pretty else {})
    return documents.select(key, F.to_json(F.struct(*[F.col(c).alias(CURIES[c]) for c in known], *rest), options).alias("json"))


def write_documents(documents: DataFrame, path: str, key: str) -> None:
    """JSON lines below ``path``, one document to a line."""
    as_json(documents, key).select("json").write.mode("errorifexists").text(path)


def write_document_files(documents: DataFrame, folder: str, key: str, name: str, month: str, parts: int = 0) -> None:
    """One file of pretty JSON for each document, named by ``name``, and where documents share one also by ``month`` and a letter; many belong in ``parts``."""
    named = collision_names(documents.select(key, name, month), name, month, key).select(F.col(key).alias("n_key"), F.concat("final_name", F.lit(".json")).alias("name"))
    texts = as_json(documents.drop(name, month), key, pretty=True)
    write_folder(texts.join(named, F.col(key).eqNullSafe(F.col("n_key"))).select("name", F.col("json").alias("value")), folder, parts=parts)


def markdown_table(rows: DataFrame, most: int = 200) -> str:
    """A small result as a Markdown table; more than ``most`` rows are an error, not a shorter table."""
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} rows")
    lines = ["| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns)]
    return "\n".join([*lines, *("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in found)]) + "\n"


def write_with_export(documents: DataFrame, export: DataFrame, path: str, key: str) -> str | None:
    """Documents below ``path/documents``, an export of them below ``path/export``: if only the export fails, its error is returned as a warning."""
    write_documents(documents, f"{path}/documents", key)
    try:
        export.write.mode("errorifexists").parquet(f"{path}/export")
    except PySparkException as e:
        return f"export failed: {e.getCondition() or type(e).__name__}"
    return None


def append_results(rows: DataFrame, path: str, by: str) -> None:
    """Results of one model after the other, each in its own part: a run that is repeated replaces its part, an interrupted one keeps the rest."""
    rows.write.partitionBy(by).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


#: JSON Schema names of Spark's types.
_JSON_TYPES = {StringType: "string", DoubleType: "number", BooleanType: "boolean", LongType: "integer", IntegerType: "integer"}


def json_schema(kind: DataType) -> dict:
    """A JSON Schema for editors of files of this type; every member may be missing, none may be added."""
    if isinstance(kind, StructType):
        return {"type": "object", "properties": {f.name: json_schema(f.dataType) for f in kind.fields}, "additionalProperties": False}
    if isinstance(kind, ArrayType):
        return {"type": "array", "items": json_schema(kind.elementType)}
    return {"type": _JSON_TYPES[type(kind)]}
