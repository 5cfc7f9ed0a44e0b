"""Small inline cases with known answers: NULLs, zero denominators, ties."""

from pyspark.sql import functions as F

from ratebook.functions import domain as D
from ratebook.functions import scalar as S
from ratebook.operators import metrics as M
from ratebook.operators.context import FIRST_NAME, primary_category
from ratebook.operators.shrink import shrunk_rate, shrunk_value
from ratebook.operators.grades import grade


def one(spark, col, row="1 AS x"):
    return spark.sql(f"SELECT {row}").select(col.alias("c")).first()["c"]


def test_ratio_of_zero_denominator_is_null(spark):
    assert one(spark, S.ratio(F.lit(1), F.lit(0))) is None
    assert one(spark, S.percent(F.lit(1), F.lit(4))) == 25.0


def test_clip_keeps_null(spark):
    assert one(spark, S.clip(F.lit(None).cast("double"), 20, 80)) is None
    assert one(spark, S.clip(F.lit(90.0), 20, 80)) == 80.0


def test_half_even(spark):
    assert [one(spark, S.half_even(F.lit(v))) for v in (0.5, 1.5, 2.5)] == [0.0, 2.0, 2.0]


def test_glue_is_null_with_a_null_part(spark):
    assert one(spark, S.glue(F.lit("a"), F.lit(None), sep=" ")) is None
    assert one(spark, S.glue(F.lit("a"), F.lit(3), sep="-")) == "a-3"


def test_numeric_codes_are_not_real(spark):
    assert one(spark, S.real_code(F.lit("123"))) is False
    assert one(spark, S.real_code(F.lit("NYA"))) is True
    assert one(spark, S.real_code(F.lit(None).cast("string"))) is False


def test_finite_or(spark):
    for v in (float("inf"), float("-inf"), None):
        assert one(spark, S.finite_or(F.lit(v).cast("double"))) == 0.0
    assert one(spark, S.finite_or(F.lit(2.5))) == 2.5


def test_spray_angles(spark):
    assert abs(one(spark, S.spray_angle(F.lit(1.0), F.lit(1.0))) - 33.75) < 1e-9
    assert abs(one(spark, S.spray_angle(F.lit(0.0), F.lit(-1.0))) - 135.0) < 1e-9
    assert one(spark, S.spray_angle_simple(F.lit(1.0), F.lit(0.0))) is None


def test_in_zone_is_false_without_inputs(spark):
    zone = lambda x: D.in_zone(F.lit(x).cast("double"), F.lit(2.0), F.lit(1.0), F.lit(3.0))
    assert one(spark, zone(0.83)) is True
    assert one(spark, zone(0.84)) is False
    assert one(spark, zone(None)) is False


def test_tags_and_positions(spark):
    rows = [
        ("FA", "FA", "SW", "SW"), ("FA", "SI", None, "SI"), ("FA", "FC", None, "HC"),
        ("CH", "FS", None, "FS"), ("SL", "CH", None, "SL"), ("CU", None, None, "CU"), (None, None, None, "XX"),
    ]
    df = spark.createDataFrame(rows, "g string, k string, s string, want string")
    assert df.filter(D.pitch_tag("g", "k", "s") != F.col("want")).count() == 0
    labels = [one(spark, D.position_label(F.lit(v).cast("int"))) for v in (1, 8, 12, 13, None)]
    assert labels == ["P", "OF", "UT", "NA", "NA"]


def test_metric_null_rules(spark):
    df = spark.createDataFrame(
        [(1, True, 1.0, "b"), (1, None, 2.0, "a"), (1, False, None, "b"), (2, None, None, None)],
        "id int, z boolean, v double, code string",
    )
    spec = [
        M.rate("inside", "z", "z IS NOT NULL", parts=True),
        M.rate("outside", "NOT z", "NOT z", parts=True),
        M.mean("v", "v", parts=True),
        M.total("v_sum", "v"),
        M.distinct("zs", "z"),
        M.sorted_list("codes", "code"),
        M.quantile("q", "v", 0.9, parts=True),
    ]
    rows = {r["id"]: r.asDict() for r in M.aggregate(df, ["id"], spec).collect()}
    assert rows[1] == {
        "id": 1, "inside": 50.0, "inside_num": 1, "inside_den": 2, "outside": 100.0,
        "outside_num": 1, "outside_den": 1, "v": 1.5, "v_n": 2, "v_sum": 3.0, "zs": 3,
        "codes": "a | b", "q": 2.0, "q_n": 2,
    }
    assert rows[2]["inside"] is None and rows[2]["v"] is None and rows[2]["v_sum"] == 0
    assert rows[2]["zs"] == 1 and rows[2]["codes"] == "" and rows[2]["q"] is None


def test_null_keys_form_a_group(spark):
    df = spark.createDataFrame([(None, 1), (None, 1), ("a", 2)], "k string, v int")
    rows = M.aggregate(df, ["k"], [M.count("n"), M.distinct("d", "v"), M.quantile("q", "v", 0.5)]).collect()
    assert {(r["k"], r["n"], r["d"], r["q"]) for r in rows} == {(None, 2, 1, 1.0), ("a", 1, 1, 2.0)}


def test_empty_input_keeps_schema(spark):
    df = spark.createDataFrame([], "k string, v double")
    out = M.aggregate(df, ["k"], [M.count("n"), M.quantile("q", "v", 0.5), M.sorted_list("l", "k")])
    assert out.columns == ["k", "n", "q", "l"] and out.count() == 0


def test_roll_up_equals_direct(spark):
    df = spark.range(200).selectExpr("id % 3 AS a", "id % 7 AS b", "id % 5 = 0 AS hit", "CAST(id AS double) AS v")
    spec = [M.rate("r", "hit", parts=True), M.mean("m", "v", "hit"), M.maximum("x", "v")]
    up = M.roll_up(M.partials(df, ["a", "b"], spec), ["a"], spec)
    assert sorted(up.collect()) == sorted(M.aggregate(df, ["a"], spec).collect())


def test_primary_category(spark):
    rows = [(1, "FA")] * 3 + [(1, "SI")] * 5 + [(2, "SI"), (2, "FA"), (2, "CH")]
    df = spark.createDataFrame(rows, "p int, tag string")
    most = dict(primary_category(df, ["p"], "tag", ["FA", "SI"]).collect())
    first = dict(primary_category(df, ["p"], "tag", ["FA", "SI"], FIRST_NAME).collect())
    assert most == {1: "SI", 2: "FA"} and first == {1: "FA", 2: "FA"}


def test_shrinkage_guards(spark):
    rows = [(10.0, 0.5), (None, 0.5), (10.0, None), (0.0, 0.5)]
    df = spark.createDataFrame(rows, "K double, mu double")
    got = [r["c"] for r in df.select(shrunk_rate(F.lit(3), F.lit(10)).alias("c")).collect()]
    assert got == [0.4, 0.3, 0.3, 0.3]
    got = [r["c"] for r in df.select(shrunk_value(F.lit(1.0), F.lit(10)).alias("c")).collect()]
    assert got == [0.75, 1.0, 1.0, 1.0]


def test_grade(spark):
    assert one(spark, grade(F.lit(0.5), F.lit(0.0), F.lit(1.0))) == 50
    assert one(spark, grade(F.lit(-9.0), F.lit(0.0), F.lit(1.0))) == 80
    assert one(spark, grade(F.lit(0.5), F.lit(1.0), F.lit(1.0))) is None
    assert one(spark, grade(F.lit(None).cast("double"), F.lit(0.0), F.lit(1.0))) is None
