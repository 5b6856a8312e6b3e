"""The three coercion regimes of schemaless records, as built-in column expressions.

(a) equality compares canonical strings; (b) aggregates take numeric values and
numeric strings; (c) ranges compare sort keys tagged by type. Each has a form
for typed columns and one for a field of a VARIANT record, where a missing field
differs from a null one.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What counts as a number in text; offset, width and text length of sort keys.
NUMERIC = r"^[ \t\n\r\x0b\f]*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?[ \t\n\r\x0b\f]*$"
INTEGER = r"^[ \t\n\r\x0b\f]*[+-]?\d+[ \t\n\r\x0b\f]*$"
KEY_OFFSET, KEY_WIDTH, KEY_SCALE, KEY_TEXT = 10**15, 19, 1000, 119

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FRACTIONAL = (T.FloatType, T.DoubleType, T.DecimalType)
_NESTED = (T.ArrayType, T.MapType, T.StructType)


def path_of(field: str) -> str:
    return "$['" + field.replace("\\", "\\\\").replace("'", "\\'") + "']"


def _with(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` names it."""
    return F.transform(F.array(value), f)[0]


def _kind(record: Column, field: str) -> Column:
    """Type of a field in a VARIANT record; null where the record has no such key."""
    return F.schema_of_variant(F.try_variant_get(record, path_of(field), "variant"))


def has_field(record: Column, field: str) -> Column:
    return _kind(record, field).isNotNull()


def _nested(kind: Column) -> Column:
    return kind.startswith("ARRAY") | kind.startswith("OBJECT")


def field_text(record: Column, field: str) -> Column:
    """Canonical text of a field; null only where the key is missing."""
    text = F.try_variant_get(record, path_of(field), "string")
    flag = F.when(text == "true", "1").otherwise("")
    return _with(_kind(record, field), lambda k: F.when(k == "VOID", "").when(k == "BOOLEAN", flag).when(_nested(k), "Array").when(k.isNotNull(), text))


def field_number(record: Column, field: str) -> Column:
    """A field as a double if it is a number or a numeric string, else null."""
    text = F.try_variant_get(record, path_of(field), "string")
    return _with(F.when(~_kind(record, field).isin("VOID", "BOOLEAN"), text), number_of_text)


def field_key(record: Column, field: str) -> Column:
    """Sort key of a field; null only where the key is missing."""
    flag = _kind(record, field) == "BOOLEAN"
    return _with(field_text(record, field), lambda t: F.when(t.isNotNull(), F.when(flag, _text_key(t)).otherwise(key_of_text(t))))


def number_of_text(text: Column) -> Column:
    return F.when(text.rlike(NUMERIC), F.trim(F.translate(text, "\t\n\r\x0b\f", "     ")).try_cast("double"))


def canonical(column: Column, kind: T.DataType) -> Column:
    """Canonical text of a typed column: null is the empty text, whole doubles have no fraction."""
    if isinstance(kind, T.BooleanType):
        return F.when(column, "1").otherwise("")
    if isinstance(kind, _NESTED):
        return F.when(column.isNull(), "").otherwise("Array")
    text = column.cast("string")
    if isinstance(kind, _FRACTIONAL):
        text = F.when((column == F.floor(column)) & (F.abs(column) < 1e15), column.try_cast("bigint").cast("string")).otherwise(text)
    return F.coalesce(text, F.lit(""))


def number(column: Column, kind: T.DataType) -> Column:
    """A typed column as a double; null for what aggregates don't count."""
    if isinstance(kind, _INTEGRAL + _FRACTIONAL):
        return column.cast("double")
    if isinstance(kind, T.StringType):
        return number_of_text(column)
    return F.lit(None).cast("double")


def _tagged(tag: str, value: Column) -> Column:
    return F.concat(F.lit(tag), F.lpad((value + F.lit(KEY_OFFSET)).cast("string"), KEY_WIDTH, "0"))


def _text_key(text: Column) -> Column:
    short = F.octet_length(text) <= KEY_TEXT
    return F.concat(F.lit("S"), F.when(short, text).otherwise(F.substring(text.cast("binary"), 1, KEY_TEXT).cast("string")))


def key_of_text(text: Column) -> Column:
    """Sort key of a canonical text: I for integers, F for other numbers (three decimals), S for the rest."""
    whole = F.when(text.rlike(INTEGER), F.trim(text).try_cast("bigint"))
    return _with(
        F.struct(text.alias("t"), whole.alias("i"), number_of_text(text).alias("v")),
        lambda x: F.when(x["t"] == "", "S").when(x["i"].isNotNull(), _tagged("I", x["i"])).when(x["v"].isNotNull(), _tagged("F", F.round(x["v"] * KEY_SCALE).try_cast("bigint"))).otherwise(_text_key(x["t"])),
    )


def sort_key(column: Column, kind: T.DataType) -> Column:
    """Sort key of a typed column; whole doubles count as integers, as they do once written as JSON."""
    if isinstance(kind, _INTEGRAL):
        return F.when(column.isNull(), "S").otherwise(_tagged("I", column.cast("bigint")))
    if isinstance(kind, _FRACTIONAL):
        value = column.cast("double")
        whole = value == value.try_cast("bigint")
        return F.when(value.isNull(), "S").when(whole, _tagged("I", value.try_cast("bigint"))).otherwise(_tagged("F", F.round(value * KEY_SCALE).try_cast("bigint")))
    if isinstance(kind, T.BooleanType):
        return F.when(column, "S1").otherwise("S")
    return key_of_text(F.coalesce(column.cast("string"), F.lit("")))


def decode_key(key: Column) -> Column:
    """The value of a sort key as text: integers and numbers to three decimals, or the text that was kept."""
    digits = F.substring(key, 2, KEY_WIDTH).try_cast("bigint") - F.lit(KEY_OFFSET)
    tag = F.substring(key, 1, 1)
    return F.when(tag == "I", digits.cast("string")).when(tag == "F", (digits / KEY_SCALE).cast("string")).otherwise(F.substr(key, F.lit(2)))


# The same for values in Python, for the sides of a predicate.


def text_of(value: Any) -> str:
    if value is None or value is False:
        return ""
    if value is True:
        return "1"
    if isinstance(value, float):
        return str(int(value)) if value.is_integer() and abs(value) < 1e15 else repr(value)
    return "Array" if isinstance(value, list | tuple | dict) else str(value)


def key_of(value: Any) -> str:
    text = text_of(value)
    if isinstance(value, bool):
        return "S" + text
    if text == "":
        return "S"
    if re.match(INTEGER, text) and -(2**63) <= int(text) < 2**63:
        return f"I{int(text) + KEY_OFFSET:0{KEY_WIDTH}d}"
    if re.match(NUMERIC, text):
        scaled = float(text) * KEY_SCALE
        return f"F{int(scaled + (0.5 if scaled >= 0 else -0.5)) + KEY_OFFSET:0{KEY_WIDTH}d}"
    return "S" + text.encode()[:KEY_TEXT].decode(errors="ignore")


def normal_id(value: Any) -> str:
    """The text an id is matched by: numeric strings in their shortest form."""
    text = text_of(value)
    if isinstance(value, str) and re.match(INTEGER, text):
        return str(int(text))
    return text_of(float(text)) if isinstance(value, str) and re.match(NUMERIC, text) else text
