"""Sources and sinks: JSON array files, CSV NA words, dictionaries, versions."""

import json
import os
import tempfile

from pyspark.sql import types as T

from rxframe.operators.clean import RAW_REGISTRY_SCHEMA, clean_registry
from rxframe.sources.files import (first_existing, flatten_envelopes, read_csv_table, read_dictionary,
                                   read_registry_json)
from rxframe.sources.versions import latest_version, write_new_version


def _tmp():
    return tempfile.mkdtemp(prefix="rxframe-src-", dir="/tmp")


def test_registry_json_array_file(spark):
    d = _tmp()
    records = [{"id": 1, "tradeName": "  Panadol ,Extra ", "strength": "500,,", "strengthUnit": "",
                "legalStatusEn": "", "legalStatus": "OTC", "agents": [{"nameEn": " b "}, {"nameEn": "a"}, {}]},
               {"id": 2, "scientificName": None, "price": 12.5}]
    with open(os.path.join(d, "raw.json"), "w", encoding="utf-8") as f:
        json.dump(records, f, ensure_ascii=False)
    raw = read_registry_json(spark, d, RAW_REGISTRY_SCHEMA, multiline=True)
    rows = {r["Trade Name"]: r for r in clean_registry(raw).collect()}
    r = rows["Panadol, Extra"]
    assert (r["Strength"], r["Legal Status"], r["Agents"]) == ("500", "OTC", "a, b")
    assert rows[""]["Price (SAR)"] == "12.5"          # a JSON number read as text


def test_csv_na_words(spark):
    d = _tmp()
    with open(os.path.join(d, "x.csv"), "w", encoding="utf-8") as f:
        f.write('name,qty,note\nNA,1,"multi\nline"\nnan,2,ok\n"a, b",,N/A\n')
    schema = T.StructType([T.StructField("name", T.StringType()), T.StructField("qty", T.IntegerType()),
                           T.StructField("note", T.StringType())])
    got = [tuple(r) for r in read_csv_table(spark, d, schema).orderBy("qty").collect()]
    assert sorted(got, key=str) == sorted([(None, 1, "multi\nline"), (None, 2, "ok"), ("a, b", None, None)], key=str)


def test_dictionary_and_versions(spark):
    d = _tmp()
    assert read_dictionary(spark, os.path.join(d, "missing.json")).count() == 0
    with open(os.path.join(d, "map.json"), "w", encoding="utf-8") as f:
        json.dump({"حساسية": "allergy, cetirizine", "x": "y"}, f, ensure_ascii=False)
    got = {r["key"]: r["value"] for r in read_dictionary(spark, os.path.join(d, "map.json")).collect()}
    assert got == {"حساسية": "allergy, cetirizine", "x": "y"}
    base = os.path.join(d, "master")
    assert latest_version(spark, base) is None
    write_new_version(spark.range(3), base)
    p2 = write_new_version(spark.range(5), base)
    assert latest_version(spark, base) == p2 and p2.endswith("v=2")
    assert first_existing(spark, [os.path.join(d, "nope"), p2]) == p2
    assert spark.read.parquet(latest_version(spark, base)).count() == 5


def test_envelopes(spark):
    rec = T.StructType([T.StructField("id", T.LongType())])
    pages = spark.createDataFrame([(1, '{"pageCount": 2, "results": [{"id": 1}, {"id": 2}]}'),
                                   (2, '{"pageCount": 2}'), (3, '{"pageCount": 2, "results": []}')],
                                  "page long, env string")
    assert sorted(r["id"] for r in flatten_envelopes(pages, "env", rec).collect()) == [1, 2]


def test_json_keeps_null_keys_csv_keeps_blanks_dictionary_last_wins(spark):
    from rxframe.sources.files import dictionary_entries, write_csv_table, write_registry_json
    d = _tmp()
    df = spark.createDataFrame([(1, None), (2, "  a  ")], "id int, v string")
    write_registry_json(df, os.path.join(d, "j"))
    raw = sorted(r[0] for r in spark.read.text(os.path.join(d, "j")).collect())
    assert raw == ['{"id":1,"v":null}', '{"id":2,"v":"  a  "}']
    write_csv_table(df, os.path.join(d, "c"), df.columns)
    assert sorted(map(tuple, read_csv_table(spark, os.path.join(d, "c"), df.schema).collect())) == [(1, None), (2, "  a  ")]
    rows = spark.createDataFrame([('{"a":"1","b":"x","a":"2"}',), (None,), ("{}",)], "j string")
    assert sorted(map(tuple, dictionary_entries(rows, "j").collect())) == [("a", "2"), ("b", "x")]
