"""Canonical JSON and hashes of nested values: the same value gives the same text whatever the order of its fields.

The text follows the column's type down to its leaves, so it is one expression without Python. JSON texts of unknown shape go through
Spark's variant type, whose objects keep their keys sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- Fixed values: characters with an escape of their own.
ESCAPES = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\f": "\\f", "\b": "\\b"}


def _unit(code: Column) -> Column:
    return F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(code)), 4, "0"))


def _escaped(char: Column) -> Column:
    code = F.ascii(char).cast("long")
    above = code - 0x10000
    pair = F.concat(_unit(0xD800 + F.shiftright(above, 10)), _unit(0xDC00 + above.bitwiseAND(F.lit(0x3FF).cast("long"))))
    own = F.try_element_at(F.create_map(*(F.lit(x) for item in ESCAPES.items() for x in item)), char)
    return F.coalesce(own, F.when(code.between(32, 126), char).when(code > 0xFFFF, pair).otherwise(_unit(code)))


def json_text(text: Column) -> Column:
    """A JSON string in ASCII."""
    inner = F.when(text.rlike(r"[^ !#-\[\]-~]"), F.array_join(F.transform(F.split(text, ""), _escaped), "")).otherwise(text)
    return F.concat(F.lit('"'), inner, F.lit('"'))


def _number(value: Column) -> Column:
    """A double as Python writes it: plain between 1e-4 and 1e16, else with an exponent of two digits at least."""
    plain = F.rtrim(value.cast("string").cast("decimal(38,21)").cast("string"), F.lit("0"))
    plain = F.when(plain.endswith("."), F.concat(plain, F.lit("0"))).otherwise(plain)
    parts = F.split(value.cast("string"), "E")
    power = F.get(parts, F.lit(1)).cast("int")
    digits = F.regexp_replace(F.get(parts, F.lit(0)), r"\.0$", "")
    far = F.concat(digits, F.lit("e"), F.when(power < 0, "-").otherwise("+"), F.when(F.abs(power) < 10, F.concat(F.lit("0"), F.abs(power).cast("string"))).otherwise(F.abs(power).cast("string")))
    size = F.abs(value)
    odd = F.isnan(value) | (size == float("inf"))
    return F.when(odd, F.regexp_replace(value.cast("string"), "^(-?)Inf.*$", "$1Infinity")).when(size == 0, value.cast("string")).when((size >= 1e-4) & (size < 1e16), plain).otherwise(far)


def canonical_json(value: Column, kind: T.DataType, comma: str = ",", colon: str = ":") -> Column:
    """The value's JSON text with sorted keys, in ASCII. Null is null at any depth.

    Structs and maps of texts are objects; their keys sort by their bytes. Decimals are numbers without trailing zeros, dates, times and binary values (as
    hexadecimal) texts. Doubles are written as Python writes them, as far as Java finds the same shortest digits.
    """
    again = lambda v, t: canonical_json(v, t, comma, colon)
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name.encode())
        parts = [F.concat(json_text(F.lit(f.name)), F.lit(colon), again(value.getField(f.name), f.dataType)) for f in fields]
        text = F.concat(F.lit("{"), F.concat_ws(comma, *parts), F.lit("}"))
    elif isinstance(kind, T.MapType):
        entries = F.array_sort(F.transform(F.map_keys(value), lambda k: F.struct(k.alias("k"), F.element_at(value, k).alias("v"))), lambda a, b: F.when(a["k"] < b["k"], -1).otherwise(1))
        text = F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(json_text(e["k"].cast("string")), F.lit(colon), again(e["v"], kind.valueType))), comma), F.lit("}"))
    elif isinstance(kind, T.ArrayType):
        text = F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: again(x, kind.elementType)), comma), F.lit("]"))
    elif isinstance(kind, T.BooleanType | T.IntegralType):
        text = value.cast("string")
    elif isinstance(kind, T.DoubleType | T.FloatType):
        text = _number(value.cast("double"))
    elif isinstance(kind, T.DecimalType):
        text = value.cast("string")
        text = F.when(text.contains("."), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)
    elif isinstance(kind, T.BinaryType):
        text = json_text(F.lower(F.hex(value)))
    else:
        text = json_text(value.cast("string"))
    return F.coalesce(F.when(value.isNotNull(), text), F.lit("null"))


def canonical_row(df: DataFrame, columns: list[str], comma: str = ",", colon: str = ":") -> Column:
    """The canonical JSON of these columns of a table as one object."""
    row = df.select(F.struct(*columns).alias("row"))
    return canonical_json(F.struct(*columns), row.schema["row"].dataType, comma, colon)


def canonical_text(json: Column) -> Column:
    """A JSON text with sorted keys at every depth and without blanks; characters and numbers as Spark's variant writes them. Broken JSON is null."""
    return F.to_json(F.try_parse_json(json))


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def hash_tree(rows: DataFrame, group: list[str], key: str, content: Column, depth: int = 2) -> DataFrame:
    """(group, prefix, n, digest): a hash tree for each group. A leaf hashes its rows' keys and contents in order, a node above its up to sixteen children.

    A row lies in the leaf that the first `depth` hexadecimal digits of its key's hash name, so equal groups have equal trees whatever their order and
    partitions, and two trees that differ lead to the leaves that differ. The root's prefix is empty. A leaf's rows are gathered in one row:
    choose a depth so that a group's rows by 16 ** depth are some thousands at most. Repeated rows count; null keys are together.
    """
    name = digest(F.coalesce(F.col(key).cast("string"), F.lit("")))
    leaf = rows.select(*group, name.alias("_name"), digest(F.coalesce(content, F.lit(""))).alias("_row"))
    leaf = leaf.groupBy(*group, F.substring("_name", 1, depth).alias("prefix")).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("_name", "_row"))).alias("_in"))
    level = leaf.select(*group, "prefix", "n", digest(F.array_join(F.transform("_in", lambda x: F.concat(x["_name"], F.lit("="), x["_row"])), ";")).alias("digest"))
    nodes = level
    for size in range(depth - 1, -1, -1):
        up = level.groupBy(*group, F.substring("prefix", 1, size).alias("prefix")).agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("prefix", "digest"))).alias("_in"))
        level = up.select(*group, "prefix", "n", digest(F.array_join(F.transform("_in", lambda x: F.concat(x["prefix"], F.lit(":"), x["digest"])), ";")).alias("digest"))
        nodes = nodes.unionByName(level)
    return nodes


def tree_changes(old: DataFrame, new: DataFrame, group: list[str], depth: int = 2) -> DataFrame:
    """(group, prefix) of the leaves in which two hash trees differ; empty where the roots agree."""
    leaves = lambda tree, as_: tree.filter(F.length("prefix") == depth).select(*group, "prefix", F.col("digest").alias(as_))
    both = leaves(old, "_old").join(leaves(new, "_new"), [*group, "prefix"], "full_outer")
    return both.filter(~F.col("_old").eqNullSafe(F.col("_new"))).select(*group, "prefix")
