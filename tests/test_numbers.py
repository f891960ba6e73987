"""Numbers as Python prints them, and column types inferred from sheets."""

import random

import pandas as pd
import pytest

from rxframe.functions.text import py_number
from rxframe.operators.context import MasterColumns, line_table
from rxframe.sources.files import read_csv_inferred

# worked out by hand from the rule
TABLE = [(1e7, "10000000.0"), (12345678.9, "12345678.9"), (1e15, "1000000000000000.0"), (1e16, "1e+16"), (1.5e16, "1.5e+16"),
         (123456789012345680.0, "1.2345678901234568e+17"), (9999999.0, "9999999.0"), (0.001, "0.001"), (0.0001, "0.0001"),
         (0.00012, "0.00012"), (1e-5, "1e-05"), (1.25e-7, "1.25e-07"), (1e100, "1e+100"), (1e-100, "1e-100"), (0.0, "0.0"),
         (-0.0, "-0.0"), (-2.5e7, "-25000000.0"), (-1e-5, "-1e-05"), (float("nan"), "nan"), (float("inf"), "inf"),
         (float("-inf"), "-inf"), (None, None), (19.9, "19.9"), (1234567890.125, "1234567890.125")]


def test_numbers(spark):
    df = spark.createDataFrame([(n, x) for n, (x, _) in enumerate(TABLE)], "n int, x double")
    got = [r["t"] for r in df.select("n", py_number("x").alias("t")).orderBy("n").collect()]
    assert got == [t for _, t in TABLE]
    r = random.Random(1)
    values = [r.uniform(-10, 10) * 10.0 ** r.randint(-12, 20) for _ in range(2000)] + [float(r.randint(0, 10**16)) for _ in range(500)]
    df = spark.createDataFrame([(x,) for x in values], "x double")
    wrong = [(r["x"], r["t"]) for r in df.select("x", py_number("x").alias("t")).collect() if str(r["x"]) != r["t"]]
    assert wrong == []


def test_context_line_prints_the_price(spark):
    cols = MasterColumns(trade="t", sci="s", form="f", strength="g", price="p", route="r")
    df = spark.createDataFrame([(1, "a", "b", "c", "d", 1e7, "e"), (2, "a", "b", "c", "d", None, "e")],
                               "o int, t string, s string, f string, g string, p double, r string")
    lines = [r["line"] for r in line_table(df, cols, "o").orderBy("o").collect()]
    assert "Price: 10000000.0 SAR" in lines[0] and "Price: nan SAR" in lines[1]


SHEET = '''i,f,g,n,b,c,s,e,big,w,q
1,1.5,1,NA,True,true,x,1e3,9223372036854775807, 7 ,"a
b"
-2,.5,,nan,FALSE,,1,-inf,9223372036854775808,+8,"1,5"
3,2.,3,,true,False,NULL,4,1,9,"say ""hi"""
'''
TYPES = {"i": "bigint", "f": "double", "g": "double", "n": "double", "b": "boolean", "c": "string", "s": "string", "e": "double",
         "big": "string", "w": "bigint", "q": "string"}


@pytest.mark.parametrize("files", [1, 2])
def test_inferred_types(spark, tmp_path, files):
    head, *rows = SHEET.split("\n", 1)[0], SHEET.split("\n", 1)[1]
    for n in range(files):
        (tmp_path / f"{n}.csv").write_text(head + "\n" + rows[0])
    df = read_csv_inferred(spark, str(tmp_path))
    assert dict(df.dtypes) == TYPES
    first = {c: [r[c] for r in df.limit(3).collect()] for c in df.columns}
    assert first["i"] == [1, -2, 3] and first["w"] == [7, 8, 9] and first["g"] == [1.0, None, 3.0]
    assert first["e"] == [1000.0, float("-inf"), 4.0] and first["b"] == [True, False, True]
    assert first["s"] == ["x", "1", None] and first["q"] == ["a\nb", "1,5", 'say "hi"']
    known = {"int64": "bigint", "float64": "double", "bool": "boolean", "object": "string", "str": "string"}
    theirs = pd.read_csv(tmp_path / "0.csv")
    assert {c: known[str(t)] for c, t in theirs.dtypes.items() if c != "big"} == {c: t for c, t in TYPES.items() if c != "big"}


def test_sheet_without_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n")
    df = read_csv_inferred(spark, str(tmp_path / "a.csv"))
    assert df.columns == ["x", "y"] and df.count() == 0
