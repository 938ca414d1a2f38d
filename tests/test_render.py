import json

from pyspark.sql import functions as F

from codestrata.functions import render as V
from codestrata.functions import toon


def test_tables_equal_the_plain_encoder(spark):
    texts = ["a", "", " a", "a ", "two words", "a,b", 'say "x"', "back\\slash", "x\ny", "tab\there", "a:b", "[1]", "{}", "12", "-5", "1e5", "1.5.2", "true", "null", "nulls", "-x", "#x", "x#y", "ü", None]
    rows = [{"name": t, "n": i} for i, t in enumerate(texts)]
    df = spark.createDataFrame([(1, [(t, i) for i, t in enumerate(texts)]), (2, [])], "id int, rows array<struct<name: string, n: int>>")
    out = {r["id"]: r for r in V.auto(df, "rows", ["name", "n"]).withColumn("toon", V.table_text(F.col("rows"), ["name", "n"])).collect()}
    assert out[1]["toon"] == toon.encode(rows)
    assert json.loads(V_json(df)) == rows
    assert out[1]["format"] == "toon" and out[1]["output"] == out[1]["toon"]
    assert out[1]["toon_cost"] == toon.size(out[1]["toon"])
    assert out[2]["format"] == "json" and out[2]["output"] == "[]"


def V_json(df):
    return df.where("id = 1").select(V.json_text(F.col("rows"))).first()[0]
