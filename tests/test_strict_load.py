import csv
import io

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Row

from tamiza.operators import strict_load as sl

GOOD = 'SHOP_0001,2024-02-29,"a, ""b""\nc",,Calificación 3 de 5,Alegría,4,x,ML_PROD_001,,m,n'


def reasons(spark, rows):
    df = spark.createDataFrame(rows, "record_id long, file_name string, record string, reason string, extra int")
    return {(r.record_id, r.record): r[-1] for r in sl.rejects(df.drop("reason")).collect()}


def test_reasons(spark):
    f, g = "raw_laptops_ml.csv", "reporte_correcciones_v7.csv"
    rows = [
        (1, f, GOOD, None, 1),
        (2, f, GOOD.replace("2024-02-29", "2023-02-29"), None, 1),
        (3, f, GOOD + ",x", None, 1),
        (4, f, GOOD.replace('""b""', '"b"'), None, 1),
        (5, f, 'a"b,c', None, 1),
        (6, f, None, None, 1),
        (7, f, "", None, 1),
        (8, g, "SHOP_0001,→a | Manual exacto", None, 1),
        (9, g, "SHOP_0001,→ a", None, 1),
        (10, g, "SHOP_001,→a", None, 1),
        (11, "other.csv", "a,b", None, 1),
        (12, g, 'SHOP_0001,"→a, b"', None, 1),
        (13, g, ",", None, 1),
        (13, g, "SHOP_0001,→b", None, 1),
        (None, g, "x", None, None),
    ]
    got = reasons(spark, rows)
    assert {k[0]: v for k, v in got.items()} == {
        2: "invalid_value", 3: "column_count", 4: "quoting", 5: "quoting", 6: "column_count", 7: "column_count",
        9: "invalid_value", 10: "invalid_value", 11: "unknown_file", 13: "invalid_value", None: "column_count",
    }


def test_typed_rows(spark):
    df = spark.createDataFrame([(1, "raw_laptops_ml.csv", GOOD)], "record_id long, file_name string, record string")
    (r,) = sl.load_strict(df, "raw_laptops_ml.csv", sl.REVIEWS).collect()
    assert (r._offset, r.raw_text, r.intensity, str(r.timestamp), r.clean_text) == (1, 'a, "b"\nc', 4, "2024-02-29", "")


def test_empty_and_long(spark):
    schema = "record_id long, file_name string, record string"
    assert sl.rejects(spark.createDataFrame([], schema)).count() == 0
    long = "SHOP_0001," + '"→' + '""x' * 200_000 + '"'
    bad = long[:-1]
    df = spark.createDataFrame([(1, "reporte_correcciones_v7.csv", long), (2, "reporte_correcciones_v7.csv", bad)], schema)
    assert [(r.record_id, r.reason) for r in sl.rejects(df).collect()] == [(2, "quoting")]


def test_fields_like_csv(spark):
    @settings(max_examples=1, deadline=None)
    @given(st.lists(st.lists(st.text(alphabet='a",;\n á', max_size=6), min_size=1, max_size=5), min_size=40, max_size=60))
    def check(tables):
        lines = []
        for row in tables:
            out = io.StringIO()
            csv.writer(out, lineterminator="").writerow(row)
            lines.append(out.getvalue() if row != [""] else "")
        df = spark.createDataFrame([Row(i=i, x=x) for i, x in enumerate(lines)], "i int, x string")
        got = df.select("i", df.x.rlike(sl.WELL_QUOTED).alias("ok"), sl.fields(df.x).alias("f")).orderBy("i").collect()
        assert all(r.ok for r in got)
        assert [list(r.f) for r in got] == tables

    check()
