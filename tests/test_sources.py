"""Records kept apart, families joined by bucket, and sketches against exact counts."""

import datetime
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from priorsight.operators import users
from priorsight.sources import files

SCHEMA = T.StructType([T.StructField("n", T.IntegerType()), T.StructField("name", T.StringType()), T.StructField("at", T.DoubleType())])


def test_csv_records_apart(spark, tmp_path):
    (tmp_path / "a.csv").write_text('name,n,more,at\nx,1,,2.5\ny,two,,3\nz,3\n"q, r",4,m,\n,,,\nw,5,m,1e3,extra\n')
    (tmp_path / "b.csv").write_text("name,n,more,at\nv,9999999999,k,oops\n")
    good, bad = files.read_csv_apart(spark, str(tmp_path), SCHEMA)
    assert sorted(map(tuple, good.collect()), key=repr) == sorted([(1, "x", 2.5), (4, "q, r", None)] + [r for r in map(tuple, good.collect()) if r == (None, None, None)], key=repr)
    found = {r.raw: r for r in bad.collect()}
    assert found["y,two,,3"].reason == "does not fit: n" and found["y,two,,3"].parsed.name == "y"
    assert found["z,3"].reason == "has not 4 fields" and found["w,5,m,1e3,extra"].reason == "has not 4 fields"
    assert found["v,9999999999,k,oops"].reason == "does not fit: n, at" and os.path.basename(found["v,9999999999,k,oops"].file) == "b.csv"
    # What a later query needs of a record does not change where the record is.
    assert good.count() + bad.count() == 7 and good.select("name").count() == good.count()
    with pytest.raises(ValueError):
        files.read_csv_apart(spark, str(tmp_path), T.StructType([*SCHEMA.fields, T.StructField("none", T.LongType())]))


def test_json_records_apart(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"n": 1, "name": "x", "at": 1.5}\n{"n": "one", "name": "y"}\n{"n": 2\n{"name": "z"}\n{"at": "far", "n": 3.5}\n')
    good, bad = files.read_json_apart(spark, str(tmp_path), SCHEMA)
    assert sorted(map(tuple, good.collect()), key=repr) == sorted([(1, "x", 1.5), (None, "z", None)], key=repr)
    assert {r.raw: r.reason for r in bad.collect()} == {
        '{"n": "one", "name": "y"}': "does not fit: n", '{"n": 2': "is no JSON", '{"at": "far", "n": 3.5}': "does not fit: n, at",
    }


def test_bucketed_families_meet_without_an_exchange(spark, tmp_path):
    store = str(tmp_path)
    rows = spark.range(500).select(F.concat(F.lit("k"), "id").alias("rowkey"), "id")
    for name, c in (("one", F.col("id") * 2), ("two", F.col("id") * 3), ("three", F.col("id") + 1)):
        files.write_bucketed(rows.filter(f"id % 7 <> {len(name)}").select("rowkey", c.alias(name), F.lit(0).alias("unused")), store, name, buckets=4)
    sets = {"one": ["one"], "two": ["two"], "three": ["three"]}
    got = files.assemble_bucketed(spark, store, sets, buckets=4)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("SortMergeJoin") >= 2 and "unused" not in plan
    want = {(f"k{i}", i * 2, i * 3 if i % 7 != 3 else None, i + 1 if i % 7 != 5 else None) for i in range(500) if i % 7 != 3}
    assert set(map(tuple, got.collect())) == want
    # A session that did not write the store finds the families there.
    for family in sets:
        spark.sql(f"drop table {files._bucketed(spark, store, family, 'rowkey', 4)}")
    again = files.assemble_bucketed(spark, store, sets, buckets=4)
    assert "Exchange" not in again._jdf.queryExecution().executedPlan().toString() and set(map(tuple, again.collect())) == want


def test_sketches_roll_up_within_their_error(spark):
    day = datetime.datetime(2024, 1, 1)
    log = spark.range(60_000).select(
        (F.col("id") % 3).alias("id"), (F.lit(day) + F.make_interval(days=(F.col("id") % 10).cast("int"))).alias("time"),
        F.when(F.col("id") % 3 == 2, None).otherwise(F.pmod(F.xxhash64("id"), F.lit(9_000))).alias("many"), (F.col("id") % 40).cast("string").alias("few"),
    )
    sketches = users.daily_sketches(log, ["many", "few"])
    assert sketches.count() == 30
    for upto in (datetime.date(2024, 1, 3), datetime.date(2024, 1, 31)):
        got = {r.id: r for r in users.rolled_up(sketches.filter(F.col("day") <= upto), ["many", "few"]).collect()}
        exact = log.filter(F.to_date("time") <= upto).groupBy("id").agg(F.count_distinct("many").alias("many"), F.count_distinct("few").alias("few"))
        for r in exact.collect():
            assert abs(got[r.id].many_Counts - r.many) <= 0.05 * r.many and got[r.id].few_Counts == r.few
