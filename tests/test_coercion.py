import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftlog.functions import coercion as C

VALUES = [10, "20.5", None, True, [1], 100000000.0, False, 1.5, {"a": 1}, "", "abc", "007", "1e3", -5, "NaN", "1d"]


@pytest.fixture(scope="module")
def records(spark):
    rows = [(i, json.dumps({"v": v})) for i, v in enumerate(VALUES)] + [(99, '{"w":1}')]
    return spark.createDataFrame(rows, "i int, body string").select("i", F.parse_json("body").alias("record"))


def col(records, column):
    return {r["i"]: r["x"] for r in records.select("i", column.alias("x")).collect()}


def test_canonical_text(records):
    got = col(records, C.field_text(F.col("record"), "v"))
    assert [got[i] for i in range(10)] == ["10", "20.5", "", "1", "Array", "100000000", "", "1.5", "Array", ""]
    assert got[99] is None
    for i, v in enumerate(VALUES):
        assert got[i] == C.text_of(v)


def test_missing_is_not_null(records):
    got = col(records, C.has_field(F.col("record"), "v"))
    assert got[2] is True and got[99] is False


def test_numbers(records):
    got = col(records, C.field_number(F.col("record"), "v"))
    assert [got[i] for i in range(16)] == [10.0, 20.5, None, None, None, 1e8, None, 1.5, None, None, None, 7.0, 1000.0, -5.0, None, None]


def test_keys_put_types_before_values(records):
    got = col(records, C.field_key(F.col("record"), "v"))
    assert got[2] == "S" and got[6] == "S" and got[3] == "S1" and got[9] == "S" and got[10] == "Sabc"
    assert got[0] == "I0001000000000000010" and got[13] == "I0000999999999999995"
    assert got[1] == "F0001000000000020500" and got[99] is None
    for i, v in enumerate(VALUES):
        assert got[i] == C.key_of(v) or isinstance(v, list | dict)


@pytest.mark.parametrize("text,ok", [(t, True) for t in ("10", "1e3", " 5", "007", ".5", "5.", "-3", "+4")] + [(t, False) for t in ("abc", "", "0x1A", "NaN", "Infinity", "1d", "2f", "1e", "--1", "1 2")])
def test_numeric_text(spark, text, ok):
    got = spark.createDataFrame([(text,)], "t string").select(C.number_of_text(F.col("t"))).first()[0]
    assert (got is not None) == ok


def test_typed_columns(spark):
    df = spark.createDataFrame([(1, 1.5, True, "x" * 200, [1])], "a int, b double, c boolean, d string, e array<int>")
    kinds = {f.name: f.dataType for f in df.schema}
    got = df.select(*[C.canonical(F.col(c), kinds[c]).alias(c) for c in df.columns]).first()
    assert tuple(got) == ("1", "1.5", "1", "x" * 200, "Array")
    keys = df.select(*[C.sort_key(F.col(c), kinds[c]).alias(c) for c in "abcd"]).first()
    assert keys["d"] == "S" + "x" * 119 and keys["b"] < keys["a"] < keys["c"]
    assert df.select(C.number(F.col("c"), T.BooleanType())).first()[0] is None


def test_keys_decode(spark):
    keys = spark.createDataFrame([(C.key_of(v),) for v in (42, -7, 2.5, "abc")], "k string")
    assert [r[0] for r in keys.select(C.decode_key(F.col("k"))).collect()] == ["42", "-7", "2.5", "abc"]


@pytest.mark.parametrize("given,want", [("007", "7"), ("3.14", "3.14"), (42, "42"), ("abc", "abc"), (5.0, "5"), (None, "")])
def test_ids(given, want):
    assert C.normal_id(given) == want
