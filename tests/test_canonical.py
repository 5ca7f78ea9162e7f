"""Canonical JSON equals Python's on nested values."""
import json
import random
import struct

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.functions import canonical as C


def test_nested_values_equal_python(spark):
    inner = "struct<b:array<map<string,bigint>>,a:string,`ü k\"ey`:boolean>"
    schema = f"i int, z struct<x:{inner},flag:boolean,n:bigint,d:double,none:string>, m map<string,map<string,array<string>>>, e array<int>"
    texts = ["plain", 'quote " and \\ slash', "line\nfeed\ttab\r\b\f", "café 漢字 \U0001f600", "\x00\x1f\x7f\x80", "", "\\uABCD \\\\uABCD\x1f", "é\\\\\x1f\\", "\x1fÉ漢\x7f\x0e", "é" * 70000]
    rows = []
    for i, t in enumerate(texts):
        rows.append((i, {"x": {"b": [{"k" + t: i, "j": None}, {}, None], "a": t, 'ü k"ey': i % 2 == 0}, "flag": None, "n": -i * 10**17,
                         "d": i / 7, "none": None},
                     {t: {"z": [t, None], "a": []}, "b": None, "\U0001f600": {}, "￮": {}}, [3, None, 1]))
    rows += [(97, None, None, None), (98, {"x": None, "flag": True, "n": 2**63 - 1, "d": float("inf"), "none": ""}, {}, [])]
    df = spark.createDataFrame(rows, schema)
    got = {r.i: r.j for r in df.select("i", C.record_json(df).alias("j")).collect()}
    for i, z, m, e in rows:
        assert got[i] == json.dumps({"i": i, "z": z, "m": m, "e": e}, sort_keys=True), i


def test_numbers_equal_python(spark):
    rng = random.Random(3)
    values = [0.0, -0.0, 1.0, -1.5, 1e-4, 9.999e-5, 1e-5, 0.001, 123456.789, 1e7, 12345678.25, 1e15, 1e16, 1.5e16, 9007199254740993.0,
              1e22, 1.7976931348623157e308, -2.5e-300, 100.0, 1e100, 5e-7, float("inf"), float("-inf"), float("nan")]
    values += [struct.unpack("<d", rng.randbytes(8))[0] for _ in range(3000)] + [rng.uniform(-1e9, 1e9) for _ in range(3000)] + [5e-324, 2e23, 1e23, 2.0**70]
    values += [rng.uniform(-1, 1) * 10 ** rng.randint(-7, 18) for _ in range(400)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = {r.i: r.t for r in df.select("i", C.canonical_of(df, "v").alias("t")).collect()}
    assert [(got[i], json.dumps(v)) for i, v in enumerate(values) if got[i] != json.dumps(v)] == []


def test_dates_decimals_and_unknown_types(spark):
    df = spark.sql("SELECT date'2026-03-01' AS d, timestamp_ntz'2026-03-01 10:00:00.5' AS t, cast(1.50 AS decimal(10,2)) AS n, null AS v, "
                   "X'00' AS b, map(1, 2) AS k")
    assert df.select(C.record_json(df, ["d", "t", "n", "v"]).alias("j")).first().j == (
        '{"d": "2026-03-01", "n": 1.50, "t": "2026-03-01T10:00:00.500000", "v": null}')
    for name in ("b", "k"):
        with pytest.raises(TypeError):
            C.canonical_of(df, name)


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([("a", [1.5])], "s string, x array<double>")
    plan = df.select(F.sha2(C.record_json(df), 256))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and T.StructType.fromJson(df.schema.jsonValue()) == df.schema
