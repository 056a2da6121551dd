"""Shapes compiled to columns.

A shape is {"type": T, "properties": {column: {constraint: bound}}, "extends": shape or list}. Constraints: required, min_count, max_count, datatype, minimum,
maximum, min_length, max_length, in, pattern, less_than, less_than_or_equals, equals, disjoint, or, and, not, if/then/else, shape, severity.
compile_shape gives two columns: errors and warnings, arrays of (path, constraint, message).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, NumericType, StringType, StructType

NUMBERS = {"integer": ("tinyint", "smallint", "int", "bigint"), "double": None, "float": None, "decimal": None}
FINDING = "struct<path:string,constraint:string,message:string>"


def resolve(shape: dict, registry: dict[str, dict] | None = None, seen: tuple = ()) -> dict:
    """The shape with all that it extends; what the child says wins, and a cycle stops."""
    out: dict = {"properties": {}}
    parents = shape.get("extends", [])
    for p in parents if isinstance(parents, list) else [parents]:
        parent = (registry or {}).get(p) if isinstance(p, str) else p
        if parent is None or id(parent) in seen:
            continue
        r = resolve(parent, registry, (*seen, id(shape)))
        out |= {k: v for k, v in r.items() if k != "properties"}
        for k, v in r["properties"].items():
            out["properties"][k] = out["properties"].get(k, {}) | v
    for k, v in shape.get("properties", {}).items():
        out["properties"][k] = out["properties"].get(k, {}) | v
    return out | {k: v for k, v in shape.items() if k not in ("properties", "extends")}


def _first(c: Column, kind: object) -> tuple[Column, object]:
    return (F.try_element_at(c, F.lit(1)), kind.elementType) if isinstance(kind, ArrayType) else (c, kind)


def _violated(v: Column, kind: object, name: str, bound: object, field: object) -> Column:
    """True where a value that is not null breaks one constraint."""
    text, number = isinstance(kind, StringType), isinstance(kind, NumericType)
    no = F.lit(False)
    if name == "minimum":
        return v < F.lit(bound) if number else no
    if name == "maximum":
        return v > F.lit(bound) if number else no
    if name == "min_length":
        return F.length(v) < bound if text else no
    if name == "max_length":
        return F.length(v) > bound if text else no
    if name == "in":
        return ~v.isin(*bound)
    if name == "pattern":
        return ~v.rlike(bound) if text else F.lit(True)
    if name == "datatype":
        short = str(bound).rpartition(":")[2]
        if short == "string":
            return F.lit(not text)
        if short == "boolean":
            return F.lit(not isinstance(kind, BooleanType))
        if short in NUMBERS:
            return F.lit(not (number and (NUMBERS[short] is None or kind.simpleString() in NUMBERS[short])))
        return no
    if name in ("less_than", "less_than_or_equals", "equals", "disjoint"):
        other = field(bound)
        return F.coalesce({"less_than": v >= other, "less_than_or_equals": v > other, "equals": v != other, "disjoint": v == other}[name], no)
    raise ValueError(f"unknown constraint {name}")


SIMPLE = ("datatype", "minimum", "maximum", "min_length", "max_length", "in", "pattern", "less_than", "less_than_or_equals", "equals", "disjoint")


def _passes(v: Column, kind: object, rule: dict, field: object) -> Column:
    checks = [~F.coalesce(_violated(v, kind, k, rule[k], field), F.lit(False)) for k in SIMPLE if k in rule]
    if "or" in rule:
        checks.append(reduce(lambda x, y: x | y, [_passes(v, kind, r, field) for r in rule["or"]]))
    if "and" in rule:
        checks.append(reduce(lambda x, y: x & y, [_passes(v, kind, r, field) for r in rule["and"]]))
    if "not" in rule:
        checks.append(~_passes(v, kind, rule["not"], field))
    if "if" in rule:
        holds = _passes(v, kind, rule["if"], field)
        checks.append(F.when(holds, _passes(v, kind, rule.get("then", {}), field)).otherwise(_passes(v, kind, rule.get("else", {}), field)))
    return reduce(lambda x, y: x & y, checks, F.lit(True))


def _finding(bad: Column, path: str, constraint: str, message: str) -> Column:
    return F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(path).alias("path"), F.lit(constraint).alias("constraint"), F.lit(message).alias("message")))


def _findings(shape: dict, schema: StructType, field: object, prefix: str = "") -> list[tuple[str, Column]]:
    out: list[tuple[str, Column]] = []
    if "type" in shape and "types" in schema.names:
        out.append(("error", _finding(~F.coalesce(F.array_contains(field("types"), shape["type"]), F.lit(False)), prefix + "@type", "type", f"must be {shape['type']}")))
    for name, rule in shape["properties"].items():
        where = "warning" if rule.get("severity") in ("warning", "info") else "error"
        path = prefix + name
        if name not in schema.names:
            if rule.get("required") or rule.get("min_count", 0) > 0:
                out.append((where, _finding(F.lit(True), path, "required" if rule.get("required") else "min_count", "is absent")))
            continue
        raw, kind = field(name), schema[name].dataType
        count = F.coalesce(F.size(raw), F.lit(0)) if isinstance(kind, ArrayType) else F.when(raw.isNull(), 0).otherwise(1)
        if "min_count" in rule:
            out.append((where, _finding(count < rule["min_count"], path, "min_count", f"needs at least {rule['min_count']} values")))
        if "max_count" in rule:
            out.append((where, _finding(count > rule["max_count"], path, "max_count", f"has more than {rule['max_count']} values")))
        v, kind = _first(raw, kind)
        if rule.get("required"):
            out.append((where, _finding(v.isNull(), path, "required", "is required")))
        if "shape" in rule and isinstance(kind, StructType):
            inner = _findings(resolve(rule["shape"]), kind, lambda n, v=v: v[n], path + "/")
            out += [(w, F.when(v.isNotNull(), c)) for w, c in inner]
        for k in SIMPLE:
            if k in rule:
                out.append((where, _finding(v.isNotNull() & _violated(v, kind, k, rule[k], field), path, k, f"breaks {k} {rule[k]}")))
        for k in ("or", "and", "not", "if"):
            if k in rule:
                part = {x: rule[x] for x in ((k, "then", "else") if k == "if" else (k,)) if x in rule}
                out.append((where, _finding(v.isNotNull() & ~_passes(v, kind, part, field), path, "conditional" if k == "if" else k, f"breaks {k}")))
    return out


def compile_shape(shape: dict, schema: StructType, registry: dict[str, dict] | None = None) -> tuple[Column, Column]:
    found = _findings(resolve(shape, registry), schema, F.col)
    pick = lambda w: F.filter(F.array(*[c for k, c in found if k == w]), lambda x: x.isNotNull()) if any(k == w for k, _ in found) else F.array().cast(f"array<{FINDING}>")
    return pick("error"), pick("warning")


def validate(df: DataFrame, shape: dict, registry: dict[str, dict] | None = None) -> DataFrame:
    """df with valid, errors and warnings."""
    errors, warnings = compile_shape(shape, df.schema, registry)
    return df.withColumns({"errors": errors, "warnings": warnings}).withColumn("valid", F.size("errors") == 0)


def validate_document(df: DataFrame, shapes: list[dict], node_id: str = "node_id", registry: dict[str, dict] | None = None) -> DataFrame:
    """(node_id, path, constraint, message): every node against each shape of one of its types."""
    parts = []
    for s in shapes:
        errors, _ = compile_shape(s, df.schema, registry)
        rows = df.where(F.array_contains("types", s["type"])).select(F.col(node_id), F.explode(errors).alias("e"))
        parts.append(rows.select(node_id, F.concat(F.col(node_id).cast("string"), F.lit("/"), F.col("e.path")).alias("path"), "e.constraint", "e.message"))
    return reduce(DataFrame.unionByName, parts)
