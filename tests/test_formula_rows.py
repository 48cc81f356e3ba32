"""Formulas of many sheets: dealt over all tasks, and read once for all sheets that share them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import spreadsheet


def test_sheets_of_one_partition_are_dealt_over_all_tasks(spark):
    rows = spark.range(0, 4_000, 1, 1).select("id", F.create_map(F.lit("A1"), F.col("id").cast("string"), F.lit("A2"), F.lit("=A1*2")).alias("cells"))
    got = spreadsheet.evaluated_rows(rows, ["id"]).withColumn("task", F.spark_partition_id()).collect()
    assert sorted((x.id, x.cell, x.value, x.refers) for x in got) == [(i, "A2", repr(i * 2.0), ["A1"]) for i in range(4_000)]
    assert len({x.task for x in got}) == 8


def test_formulas_are_read_once_and_errors_stay(spark):
    cells = {"A1": "3", "A2": "x", "A3": "=A1+1", "A4": "=1/0", "A5": "=A5", "A6": "=1+", "A7": "=FOO(1)", "A8": "=A3*'T'!B1", "A9": None, "A10": "", "A11": "=COUNTA(A1:A3)", "A12": "=A2+1", "A13": "=A1"}
    rows = spark.createDataFrame([(1, "p", cells), (2, "q", None), (3, None, {}), (4, "r", {"A1": "=2^0.5"})], "id long, tag string, cells map<string,string>")
    got = {(x.id, x.tag, x.cell): (x.value, x.refers) for x in spreadsheet.evaluated_rows(rows, ["id", "tag"]).collect()}
    want = {"A3": ("4.0", ["A1"]), "A4": (None, []), "A5": (None, ["A5"]), "A6": (None, []), "A7": (None, []), "A8": ("0.0", ["A3", "B1"]), "A11": ("3.0", ["A1:A3"]), "A12": (None, ["A2"]), "A13": ("3.0", ["A1"])}
    assert got == {(1, "p", c): v for c, v in want.items()} | {(4, "r", "A1"): (repr(round(2**0.5, 9)), [])}
    spreadsheet._tokens.cache_clear()
    for i in range(50):
        book = spreadsheet.Workbook({("S", "A1"): float(i), ("S", "A2"): "=SUM(A1:A1)+1"})
        assert book.value("S", "A2") == i + 1 and spreadsheet.references("=SUM(A1:A1)+1", "S") == [("S", "A1:A1")]
    assert spreadsheet._tokens.cache_info().misses == 1
