"""Display formats and missing-value functions: host functions and Column expressions must agree."""

import pytest
from pyspark.sql import functions as F

from marlstone.functions import MISSING, MISSING_A, MISSING_B, MISSING_Z, display, double_bits_tag, float_bits_tag, format_value, is_missing, is_missing_cell, label_key, missing_cell, missing_tag
from marlstone.functions.missing import double_code
from marlstone.operators import register_functions
from marlstone.sources.layout import TAGS

GOLDEN = [
    (3.14159, "%9.2f", "3.14"), (42, "%9.0f", "42"), (1.23456789, "%9.4f", "1.2346"), (-3.14, "%9.2f", "-3.14"), (0, "%9.2f", "0.00"), (-0.001, "%9.2f", "-0.00"), (-0.0, "%9.2f", "0.00"),
    (500729.345, "%9.2f", "500729.34"), (7667.125, "%9.2f", "7667.13"), (2.5, "%9.0f", "3"), (1e21, "%9.2f", "1e+21"), (1.005, "%9.2f", "1.00"),
    (1234567.89, "%9.2fc", "1,234,567.89"), (1234567, "%12.0fc", "1,234,567"), (999, "%9.2fc", "999.00"), (-1234567.89, "%9.2fc", "-1,234,567.89"),
    (1234.5, "%9.0g", "1234.5"), (42, "%9.0g", "42"), (0, "%9.0g", "0"), (-5.5, "%9.0g", "-5.5"), (1000000, "%9.0g", "1000000"), (1234567, "%12.0gc", "1,234,567"), (1234567.5, "%12.0gc", "1,234,567.5"),
    (1e21, "%9.0g", "1e+21"), (1e-7, "%9.0g", "1e-7"), (0.000001, "%9.0g", "0.000001"), (123456789012345680000.0, "%9.0g", "123456789012345680000"), (1.5e300, "%9.0g", "1.5e+300"), (float("inf"), "%9.0g", "Infinity"),
    (1234.5, "%9.2e", "1.23e+03"), (0.001234, "%9.4e", "1.2340e-03"), (-42, "%9.2e", "-4.20e+01"), (0, "%9.2e", "0.00e+00"), (1e100, "%9.2e", "1.00e+100"), (1e-100, "%9.2e", "1.00e-100"), (1.005, "%9.2e", "1.00e+00"), (12250, "%9.2e", "1.23e+04"), (9.999, "%9.2e", "1.00e+01"),
    (0, "%td", "01jan1960"), (21185, "%td", "01jan2018"), (-1, "%td", "31dec1959"), (14669, "%td", "29feb2000"), (1.9, "%td", "02jan1960"), (-715000, "%td", "25may2"),
    (0, "%tc", "01jan1960 00:00:00"), (86400000, "%tc", "02jan1960 00:00:00"), (3661000, "%tc", "01jan1960 01:01:01"), (-1, "%tc", "31dec1959 23:59:59"),
    (0, "%tw", "1960w1"), (52, "%tw", "1961w1"), (-1, "%tw", "1959w52"), (0, "%tm", "1960m1"), (12, "%tm", "1961m1"), (-1, "%tm", "1959m12"), (0, "%tq", "1960q1"), (4, "%tq", "1961q1"), (-1, "%tq", "1959q4"),
    (1.5, "%tw", "1960w2.5"), (-0.5, "%tw", "1959w0.5"), (2020, "%ty", "2020"), (5, "%th", "5"), (5, "%tC", "5"),
    (42, "%unknown", "42"), (42, "", "42"), (42, "%9s", "42"), (3.14, "%-9.2f", "3.14"), (3.14, "%09.2f", "3.14"), (3.14, "%+9.2f", "3.14"), (0, "%%td", "01jan1960"), (2.5, "9.2f", "2.50"), (5, "%9,2f", "5"), (5, "%21x", "5"),
]


@pytest.mark.parametrize("value,fmt,text", GOLDEN)
def test_host_format(value, fmt, text):
    assert format_value(value, fmt) == text


def test_texts_and_nulls_stay():
    assert format_value(None, "%9.2f") is None and format_value("hello", "%9.0g") == "hello" and format_value("", "%20s") == ""
    assert format_value(9e12, "%td") is None and format_value(9e12, "%td", js_compat=True) == "NaNundefinedNaN"
    assert format_value(1e21, "%12.0gc", js_compat=True) == "1e,+21" and format_value(1e21, "%12.0gc") == "1e+21"


@pytest.mark.parametrize("storage", ["double", "long"])
def test_columns_agree_with_the_host(spark, storage):
    cases = [(float(v), f, t) for v, f, t in GOLDEN if storage == "double" or (float(v).is_integer() and abs(v) < 2**31)]
    for fmt in sorted({f for _, f, _ in cases}):
        own = [(v, t) for v, f, t in cases if f == fmt]
        rows = spark.createDataFrame([(v, t) for v, t in own] + [(None, None)], "v double, t string").repartition(1)
        value = F.col("v") if storage == "double" else F.col("v").cast("int")
        for r in rows.select("v", "t", display(value, fmt, storage).alias("shown")).collect():
            assert r["shown"] == ("0.00" if r["t"] == "-0.00" and storage == "long" else r["t"]), (fmt, r)


def test_missing_tags(spark):
    assert MISSING < MISSING_A < MISSING_B < MISSING_Z < float("inf")
    for storage, first in (("byte", 101), ("int", 32741), ("long", 2147483621)):
        rows = spark.createDataFrame([(i, first + i) for i in range(-1, 28)], "i int, v long")
        assert {r["i"]: r["t"] for r in rows.select("i", missing_tag("v", storage).alias("t")).collect()} == {i: TAGS[i] if 0 <= i <= 26 else None for i in range(-1, 28)}
    values = [double_code(t) for t in TAGS] + [float("nan"), float("inf"), -1.0, 0.0, MISSING_Z * 1.0001, MISSING * (1 + 2.0**-13)]
    rows = spark.createDataFrame(list(enumerate(values)), "i int, v double")
    found = {r["i"]: r["t"] for r in rows.select("i", missing_tag("v").alias("t")).collect()}
    assert [found[i] for i in range(len(values))] == TAGS + [None] * 6
    floats = [2.0**127 * (1 + k / 4096) for k in range(28)]
    rows = spark.createDataFrame(list(enumerate(floats)), "i int, v double")
    found = {r["i"]: (r["t"], r["m"]) for r in rows.select("i", missing_tag("v", "float").alias("t"), is_missing("v", "float").alias("m")).collect()}
    assert [found[i][0] for i in range(28)] == TAGS + [None] and found[27][1] is False


def test_missing_bits_keys_and_cells(spark):
    rows = spark.createDataFrame([(0x7F000000, "."), (0x7F000800, ".a"), (0x7F00D000, ".z"), (0x7F000001, None), (0x7F00D800, None), (0, None)], "raw long, t string")
    assert all(r[0] == r[1] for r in rows.select("t", float_bits_tag("raw")).collect())
    eight = [(bytes.fromhex(x), t) for x, t in (("7FE0000000000000", "."), ("7FE0010000000000", ".a"), ("7FE01A0000000000", ".z"), ("7FE01B0000000000", None), ("7FE0000000000001", None), ("3FF0000000000000", None))]
    rows = spark.createDataFrame(eight, "raw binary, t string")
    assert all(r[0] == r[1] for r in rows.select("t", double_bits_tag("raw", False)).collect())
    rows = spark.createDataFrame([(x[::-1], t) for x, t in eight], "raw binary, t string")
    assert all(r[0] == r[1] for r in rows.select("t", double_bits_tag("raw")).collect())
    rows = spark.createDataFrame([(t, 2147483621 + i) for i, t in enumerate(TAGS)] + [("x", None)], "t string, k int")
    assert all(r[0] == r[1] for r in rows.select("k", label_key("t")).collect())
    row = spark.range(1).select(missing_cell(".b").alias("x")).select("x", is_missing_cell("x").alias("m")).first()
    assert row["m"] and row["x"]["missing"] == ".b"
    with pytest.raises(ValueError):
        missing_cell("b")


def test_sql_names(spark):
    register_functions(spark, {"yn": {0: "no", 1: "yes"}})
    row = spark.sql("SELECT dta_format(1234.5D, '%9.2fc') a, dta_missing_tag(102D, 'byte') b, dta_missing_key('.a') c, dta_label('yn', 1) d, dta_missing_tag(5D, 'byte') e").first()
    assert tuple(row) == ("1,234.50", ".a", 2147483622, "yes", None)
