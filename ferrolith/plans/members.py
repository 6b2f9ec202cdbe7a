"""An export model as a type: order, required members and merging, compiled from a StructType into column expressions.

The type says which members there are and in what order, at every depth; columns that are lists of structs are handled item by item.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, NumericType, StringType, StructType

from ferrolith.functions.values import strip


def ordered(value: Column, have: DataType, model: DataType) -> Column:
    """``value`` with the model's members in the model's order, null where it has none, and its further members after them as they come."""
    if isinstance(have, ArrayType) and isinstance(model, ArrayType):
        return F.transform(value, lambda x: ordered(x, have.elementType, model.elementType))
    if not isinstance(have, StructType) or not isinstance(model, StructType):
        return value if isinstance(have, (StructType, ArrayType)) or have == model else value.cast(model)
    own = {f.name: f.dataType for f in have.fields}
    members = [ordered(value[f.name], own[f.name], f.dataType) if f.name in own else F.lit(None).cast(f.dataType) for f in model.fields]
    names = [f.name for f in model.fields]
    rest = [n for n in own if n not in names]
    whole = F.struct(*[c.alias(n) for c, n in zip(members, names, strict=True)], *[value[n].alias(n) for n in rest])
    return F.when(value.isNotNull(), whole)


def _absent(value: Column, kind: DataType) -> Column:
    """Whether a required member is not there: null, a blank string or an empty list."""
    if isinstance(kind, StringType):
        return F.coalesce(strip(value), F.lit("")) == ""
    return F.coalesce(F.size(value), F.lit(0)) < 1 if isinstance(kind, ArrayType) else value.isNull()


def missing_members(value: Column, kind: DataType, required: set[str], path: str = "", at: Column | None = None) -> Column:
    """Places of required members that are not there; members of structs and list items count where those are there. List items are written ``[]`` in
    ``required`` and with their numbers in the result."""
    none = F.array().cast("array<string>")
    at = F.lit("") if at is None else at
    if isinstance(kind, ArrayType):
        return F.coalesce(F.flatten(F.transform(value, lambda x, i: missing_members(x, kind.elementType, required, f"{path}[]", F.concat(at, F.lit("["), i.cast("string"), F.lit("]"))))), none)
    if not isinstance(kind, StructType):
        return none
    parts = []
    for f in kind.fields:
        inner, place = f"{path}.{f.name}".lstrip("."), F.concat(at, F.lit(f".{f.name}" if path else f.name))
        if inner in required:
            parts.append(F.when(_absent(value[f.name], f.dataType), F.array(place)).otherwise(none))
        if any(r.startswith((f"{inner}.", f"{inner}[]")) for r in required):
            parts.append(missing_members(value[f.name], f.dataType, required, inner, place))
    return F.when(value.isNotNull(), F.concat(none, *parts)).otherwise(none)


def _falsy(value: Column, kind: DataType) -> Column:
    """Whether a value counts as nothing where members of a struct are filled."""
    if isinstance(kind, StringType):
        empty = value == ""
    elif isinstance(kind, BooleanType):
        empty = ~value
    elif isinstance(kind, NumericType):
        empty = value == 0
    elif isinstance(kind, ArrayType):
        empty = F.size(value) == 0
    else:
        return value.isNull()
    return value.isNull() | empty


def merged(first: Column, second: Column, kind: StructType) -> Column:
    """Two partial documents as one: of a member that both have, lists are joined, structs keep their filled members and take the others', and
    any other value is the second's."""

    def both(a: Column, b: Column, of: DataType) -> Column:
        if isinstance(of, ArrayType):
            return F.concat(a, b)
        if isinstance(of, StructType):
            return F.struct(*[F.when(_falsy(a[f.name], f.dataType) & (a[f.name].isNull() | ~_falsy(b[f.name], f.dataType)), b[f.name]).otherwise(a[f.name]).alias(f.name) for f in of.fields])
        return b

    member = lambda f: F.when(first[f.name].isNull(), second[f.name]).when(second[f.name].isNull(), first[f.name]).otherwise(both(first[f.name], second[f.name], f.dataType))
    return F.when(first.isNull(), second).when(second.isNull(), first).otherwise(F.struct(*[member(f).alias(f.name) for f in kind.fields]))
