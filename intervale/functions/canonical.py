"""Canonical JSON as column expressions: keys in order, no blanks, text as it is but for what JSON escapes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# JSON's short escapes.
SHORT = {"\b": "\\b", "\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r"}


def json_string(text: Column) -> Column:
    """A JSON string; null is ``null``."""
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    controls = "[" + "".join(f"\\x{c:02x}" for c in range(32)) + "]"
    escaped = out
    for code in range(32):
        escaped = F.replace(escaped, F.lit(chr(code)), F.lit(SHORT.get(chr(code), f"\\u{code:04x}")))
    return F.coalesce(F.concat(F.lit('"'), F.when(out.rlike(controls), escaped).otherwise(out), F.lit('"')), F.lit("null"))


def json_number(value: Column) -> Column:
    """A double with a point always, plain from 0.0001 to 10**16, else with an exponent; digits are those Java writes."""
    text = value.cast("string")
    exact = F.when(F.abs(value) < 1e7, text.cast("decimal(38,30)").cast("string")).otherwise(text.cast("decimal(38,15)").cast("string"))
    digits = F.regexp_replace(F.regexp_replace(exact, r"0+$", ""), r"\.$", ".0")
    parts = F.split(text, "E")
    exponent = F.get(parts, F.lit(1)).cast("int")
    far = F.concat(F.regexp_replace(F.get(parts, F.lit(0)), r"\.0$", ""), F.lit("e"), F.when(exponent < 0, "-").otherwise("+"), F.format_string("%02d", F.abs(exponent)))
    small = F.abs(value).between(F.lit(1e-4), F.lit(9.999999999999998e15)) | (value == 0)
    return F.coalesce(F.when(small, digits).otherwise(far), F.lit("null"))


def canonical_json(value: Column, kind: T.DataType) -> Column:
    """The canonical JSON of a column of that type: structs and maps of strings as objects, arrays as lists."""
    joined = lambda items, a, b: F.concat(F.lit(a), F.array_join(items, ","), F.lit(b))
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        items = [F.concat(F.lit(f'"{f.name}":'), canonical_json(value.getField(f.name), f.dataType)) for f in fields]
        out = F.concat(F.lit("{"), F.concat_ws(",", *items), F.lit("}")) if items else F.lit("{}")
    elif isinstance(kind, T.ArrayType):
        out = joined(F.transform(value, lambda x: canonical_json(x, kind.elementType)), "[", "]")
    elif isinstance(kind, T.MapType):
        entries = F.array_sort(F.transform(F.map_entries(value), lambda e: F.struct(e["key"].cast("string").alias("k"), canonical_json(e["value"], kind.valueType).alias("v"))))
        out = joined(F.transform(entries, lambda e: F.concat(json_string(e["k"]), F.lit(":"), e["v"])), "{", "}")
    elif isinstance(kind, T.StringType):
        return json_string(value)
    elif isinstance(kind, T.DoubleType | T.FloatType):
        return json_number(value.cast("double"))
    else:
        out = value.cast("string")
    return F.when(value.isNull(), F.lit("null")).otherwise(out)
