"""Pipelines, windows, tables, streams and the registered queries."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quarrystone.functions import metrics
from quarrystone.operators import encode
from quarrystone.operators.linear import OnlineLR
from quarrystone.plans import transforms
from quarrystone.plans.blueprint import Blueprint, Pipeline
from quarrystone.plans.diagnosis import DIA, E, PartitionHelper
from quarrystone.plans.windows import dynamic_groups
from quarrystone.streaming import online

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_pipeline_round_trip(spark):
    df = spark.createDataFrame([("F", 1.0, None), ("M", 2.0, 4.0), (None, 3.0, 6.0)], "g string, x double, y double")
    pipe = Blueprint(df).impute(["y"], "mean").scale(["x"]).ordinal_encode(["g"], unknown_value=-2, null_value=-1).materialize()
    new = spark.createDataFrame([("F", 2.0, None), ("X", 2.0, 1.0), (None, 2.0, 1.0)], "g string, x double, y double")
    rows = [tuple(r) for r in pipe.transform(new).collect()]
    assert rows == [(0.0, 0.0, 5.0), (-2.0, 0.0, 1.0), (-1.0, 0.0, 1.0)]
    again = Pipeline.from_json(pipe.to_json())
    assert [tuple(r) for r in again.transform(new).collect()] == rows


@pytest.mark.parametrize("kind", ["string", "long"])
def test_encodings_of_many_values(spark, kind):
    n = transforms.MAX_LITERALS + 500
    df = spark.range(3 * n).select("id", (F.col("id") % n).cast(kind).alias("g"), (F.col("id") % 7 % 2).cast("double").alias("t"), F.lit("x").alias("k"))
    new = spark.createDataFrame([(i, str(i)) for i in range(n)] + [(-1, "-5"), (-2, None)], "id long, g string").withColumn("g", F.col("g").cast(kind)).withColumn("k", F.lit("x"))
    for name, table in (("target_encode", encode.target_encode(df, "g", "t")), ("woe_encode", encode.woe_discrete(df, "g", "t")), ("iv_encode", encode.info_value_discrete(df, "g", "t", False))):
        codes = {int(r[0]): r[1] for r in table.collect()}
        mean = sum(codes.values()) / n
        pipe = getattr(Blueprint(df, target="t"), name)(["g", "k"], default="mean").materialize()
        pipe.feature_names_out_ = ["id", "g"]
        plain = new.select("id", getattr(transforms, name)(df, ["g"], target="t", default="mean")[0])
        for out in (pipe.transform(new), Pipeline.from_json(pipe.to_json()).transform(new), plain):
            got = {r.id: r.g for r in out.collect()}
            assert got.pop(-2) is None and got.pop(-1) == pytest.approx(mean)
            assert got == pytest.approx(codes)


def test_linear_and_conditional_impute(spark):
    df = spark.createDataFrame([(float(i), float(i * i), None if i == 3 else float(i + i * i)) for i in range(1, 9)], "a double, b double, c double")
    out = Blueprint(df).linear_impute(["a", "b"], "c").materialize(True)[1]
    assert [round(r.c, 6) for r in out.orderBy("a").collect()] == [i + i * i for i in range(1, 9)]


@pytest.mark.parametrize("closed, want", [("left", {0: 2, 2: 2, 4: 1}), ("right", {-2: 1, 0: 2, 2: 2}), ("both", {-2: 1, 0: 3, 2: 3, 4: 1})])
def test_closed_ends(spark, closed, want):
    df = spark.createDataFrame([(i,) for i in range(5)], "i long")
    assert {r.i: r.n for r in dynamic_groups(df, "i", [F.count(F.lit(1)).alias("n")], "2i", closed=closed).collect()} == want


def test_tables(spark):
    df = spark.createDataFrame([(1, "a", 0.5), (2, "a", 0.1), (None, "b", None)], "i int, s string, p double")
    d = DIA(df)
    assert d.infer_binary() == ["i", "s", "p"] and d.infer_prob() == ["p"]
    assert {r["column"]: r.null_count for r in d.special_values_report().collect()} == {"i": 1, "p": 1}
    assert PartitionHelper(df, "s").names() == ["df", "a", "b"]
    assert df.agg(*E(["i"], ["mean", "null_rate"])).columns == ["__len__", "i_mean", "i_null_rate"]


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([(float(i), 2.0 * i) for i in range(20)], "x double, y double").write.parquet(src)
    stream = spark.readStream.schema("x double, y double").parquet(src)
    model = OnlineLR()
    online.online_regression(stream, model, ["x"], "y", str(tmp_path / "ck")).awaitTermination()
    assert model.coeffs()[0] == pytest.approx(2.0)
    rows = spark.read.parquet(f"{SF}/events.parquet").limit(0)
    schema = rows.schema
    spark.read.parquet(f"{SF}/events.parquet").write.parquet(str(tmp_path / "ev"))
    out = online.windowed(spark.readStream.schema(schema).parquet(str(tmp_path / "ev")), "ts", [metrics.query_l1("value", F.lit(0.0)).alias("v")], "1 hour", "1 day")
    query = out.writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("w").count() > 0


def test_entry(spark):
    assert {r.segment for r in entry.entry(spark).collect()} == {"F", "O"}


@pytest.mark.parametrize("name", ["segment_metrics", "lin_reg", "woe", "query_kaplan_meier_prob", "query_knn_ptwise", "str_jaccard", "group_by_dynamic"])
def test_queries_equal_sql(spark, name):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    got = sorted(map(repr, (tuple(r[c] for c in sorted(df.columns)) for r in df.collect())))
    cur = con.execute(entry.oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    want = sorted(map(repr, (tuple(dict(zip(cols, r))[c] for c in sorted(cols)) for r in cur.fetchall())))
    assert got == want


def test_sql_has_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
